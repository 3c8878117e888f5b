"""Readers and writers on small files."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigweave.functions import text as X
from sigweave.operators import corpus, labels, report
from sigweave.sources import files


def test_boxes_inventory_and_pairs(spark, tmp_path):
    (tmp_path / "labels").mkdir()
    (tmp_path / "images").mkdir()
    (tmp_path / "labels" / "a.txt").write_text("3.0 0.5 0.5 0.1 0.1\n\n12 0.1 0.1 0.2 0.2\n")
    (tmp_path / "labels" / "b.txt").write_text("\n")
    for n in ("a.png", "c.png"):
        (tmp_path / "images" / n).write_bytes(b"x")
    boxes = files.read_boxes(spark, str(tmp_path / "labels")).select(X.stem(F.col("path")).alias("s"), "class_id").collect()
    assert sorted((r["s"], r["class_id"]) for r in boxes) == [("a", 3), ("a", 12)]
    inv = files.scan_files(spark, str(tmp_path / "images"))
    pairs = files.pair_files(inv, files.scan_files(spark, str(tmp_path / "labels")))
    assert {r["stem"]: r["has_pair"] for r in pairs.collect()} == {"a": True, "c": False}


def test_tsv_keeps_none_as_a_class(spark, tmp_path):
    p = tmp_path / "w.txt"
    p.write_text("SID\tcrack\tn\na\tNone\t1.5\nb\tNA\tNA\nc\t\t2\n")
    s = T.StructType([T.StructField("SID", T.StringType()), T.StructField("crack", T.StringType()), T.StructField("n", T.DoubleType())])
    assert [tuple(r) for r in files.read_tsv(spark, str(p), s).orderBy("SID").collect()] == [("a", "None", 1.5), ("b", None, None), ("c", None, 2.0)]


def test_csv_manifest(spark, tmp_path):
    p = tmp_path / "m.csv"
    p.write_text("sid,split\na,train\nb,test\n")
    s = T.StructType([T.StructField("sid", T.StringType()), T.StructField("split", T.StringType())])
    assert files.read_manifest(spark, str(p), s).count() == 2


def test_label_json_skips_comment_ids(spark):
    d = spark.createDataFrame([('{"t1": {"a": "x", "b": "y"}, "_note": {"a": "z"}}',)], "j string")
    assert sorted(tuple(r) for r in files.unnest_label_json(d, "j").collect()) == [("t1", "a", "x"), ("t1", "b", "y")]


def test_shards_fall_back_in_order(spark, tmp_path):
    (tmp_path / "old.json").write_text('{"a": 1}\n')
    s = T.StructType([T.StructField("a", T.LongType())])
    got = files.read_shards(spark, [str(tmp_path / "new_*.json"), str(tmp_path / "old.json")], s).collect()
    assert [(r["a"], r["shard"]) for r in got] == [(1, "old.json")]
    with pytest.raises(FileNotFoundError):
        files.read_shards(spark, [str(tmp_path / "nothing_*.json")], s)


def test_incremental_keeps_done_rows(spark):
    done = spark.createDataFrame([(1, "old")], "k int, v string")
    new = spark.createDataFrame([(1, "new"), (2, "new")], "k int, v string")
    assert sorted(tuple(r) for r in files.incremental(new, done, ["k"]).collect()) == [(1, "old"), (2, "new")]


@pytest.mark.parametrize(
    "raw,want",
    [("other: <Yin_Def>", "yin_def"), ("red_tongue (red tongue body)", "red_tongue"), ("  A   B ., ", "a b "), ("x.,", "x"), (None, "")],
)
def test_clean_term(spark, raw, want):
    d = spark.createDataFrame([(raw,)], "c string")
    assert d.select(X.clean_term(F.col("c")).alias("v")).first()["v"] == want


def test_slug(spark):
    d = spark.createDataFrame([("  Bloating / fullness_after-eating!  É ",)], "c string")
    assert d.select(X.slug(F.col("c")).alias("v")).first()["v"] == "bloating-fullness-after-eating-é"


def test_redact_collapses_repeats(spark):
    d = spark.createDataFrame([("See Smith, https://x.org/a §2.3a p. 61 · Jones; the rest",)], "c string")
    got = d.select(X.redact(F.col("c"), ["Smith", "Jones"]).alias("v")).first()["v"]
    assert got == "See traditional texts; the rest"


def test_options_lookup(spark):
    d = spark.createDataFrame([("A:cold;B:damp heat", "B； Z")], "o string, a string")
    assert d.select(X.lookup_options(F.col("o"), F.col("a")).alias("v")).first()["v"] == ["damp heat", "Z"]


def test_bad_json_is_null(spark):
    d = spark.createDataFrame([(1, 'x {"k": 3} y'), (2, "x {k y}"), (3, "none")], "i int, t string")
    assert [r["k"] for r in d.select(X.extract_json(F.col("t"), "k int")["k"].alias("k")).collect()] == [3, None, None]


def test_license_longest_alias_and_rank(spark):
    d = spark.createDataFrame([("Big Book and web",), ("",), ("unknown",)], "s string")
    reg = {"bb": ("copyrighted", "summary"), "w": ("web", "quote")}
    got = corpus.resolve_license(d, F.col("s"), [("web", "w"), ("big book", "bb")], reg, {"copyrighted": 5, "web": 1}).collect()
    assert [(list(r["source_keys"]), r["license"], r["usage"]) for r in got] == [(["bb", "w"], "copyrighted", "summary"), (["authored"], "own", "authored-summary"), ([], "own", "authored-summary")]


def test_merge_labels_extra_overrides(spark):
    c = spark.createDataFrame([("t0", {"a": "1", "b": "2"})], "id string, labels map<string,string>")
    e = spark.createDataFrame([("t0", {"b": "9", "z": "0"})], "id string, labels map<string,string>")
    r = labels.merge_labels([(c, e, "s")]).first()
    assert (r["id"], r["labels"]) == ("s-t0", {"a": "1", "b": "9", "z": "0"})


def test_literal_argmax_default(spark):
    d = spark.createDataFrame([("the cat",), ("zzz",)], "t string")
    got = [r["o"] for r in d.select(report.literal_argmax(F.col("t"), [("cat", "x", 1.0), ("the", "y", 0.5)], "none").alias("o")).collect()]
    assert got == ["x", "none"]


def _sections(spark, parse, text):
    d = spark.createDataFrame([(1, text)], "k int, t string")
    return [(r["num"], r["title"], text[r["body_start"] : r["body_end"]]) for r in parse(d, "k", "t").orderBy("body_start").collect()]


def test_headings_behind_every_line_end(spark):
    text = "front\n\f1.2 Title one\nbody\r\n1.3 Title two\r\nmore\x0b\t2.1 Third\u2028last\r"
    assert _sections(spark, corpus.parse_numbered, text) == [
        ("1.2", "Title one", "body\r\n"), ("1.3", "Title two", "more\x0b"), ("2.1", "Third", "last\r"),
    ]


def test_titles_behind_tabs_and_form_feeds(spark):
    text = "\tPale Body\nx\f Red Tip \ny\n\t\t\tToo Deep\n"
    got = _sections(spark, corpus.parse_titled, text)
    assert got == [("1", "Pale Body", "x\f"), ("2", "Red Tip", "y\n\t\t\tToo Deep\n")]
    d = corpus.parse_titled(spark.createDataFrame([(1, text)], "k int, t string"), "k", "t")
    assert {(r["level"], r["parent"], r["chapter"]) for r in d.collect()} == {(1, None, "1"), (1, None, "2")}


def test_bad_box_lines_have_no_class(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x 0.5\n3.1234 0\n7 0.1\n")
    assert sorted((r["class_id"] for r in files.read_boxes(spark, str(tmp_path)).collect()), key=str) == [3, 7, None]


def test_names_are_taken_literally_in_redaction(spark):
    d = spark.createDataFrame([("see C++ (x. and axb)",)], "t string")
    assert d.select(X.redact(F.col("t"), ["C++", "(x."]).alias("v")).first()["v"] == "see traditional texts and axb)"


def test_csv_manifest_round_trip(spark, tmp_path):
    d = spark.createDataFrame([("a,b", None, 1), ('q"', "x\ny", 2)], "sid string, split string, n int")
    files.write_manifest_csv(d.filter("n = 1"), str(tmp_path / "m"))
    assert [tuple(r) for r in files.read_manifest(spark, str(tmp_path / "m"), d.schema).collect()] == [("a,b", None, 1)]


def test_artefact_merges_by_id(spark, tmp_path):
    """Only touched buckets are written again; a lost or repeated run changes nothing; of equal new ids one counts."""
    import os
    import random

    from sigweave.sources.artefact import Artefact

    r, want = random.Random(1), {}
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("v", T.StringType()), T.StructField("at", T.IntegerType())])
    for run in range(1, 5):
        store = Artefact(spark, str(tmp_path / "a"), schema, "id", 8)
        new = [(r.randrange(60 if run < 4 else 3), f"{run}-{i}", i) for i in range(40 if run < 4 else 2)] + [(None, "x", 1)]
        before = store.state()[1]
        assert store.merge(spark.createDataFrame(new, schema), run, [F.desc("at")])
        want |= {i: v for i, v, _ in new if i is not None}
        assert {x["id"]: x["v"] for x in store.read().collect()} == want and store.read().count() == len(want)
        touched = {b for b, held in store.state()[1].items() if held == run}
        assert {b: h for b, h in store.state()[1].items() if b not in touched} == {b: h for b, h in before.items() if b not in touched}
    assert len(touched) <= 2
    assert not store.merge(spark.createDataFrame([(1, "again", 1)], schema), 4)
    # a run that died before its state was whole: rows are there, nobody sees them, the repeated run replaces them
    os.makedirs(tmp_path / "a" / "rows" / "run=5" / "bucket=0")
    os.makedirs(tmp_path / "a" / "state" / "run=5" / "_temporary")
    spark.createDataFrame([(999, "lost", 1)], schema).write.mode("append").parquet(str(tmp_path / "a" / "rows" / "run=5" / "bucket=0"))
    assert {x["id"]: x["v"] for x in store.read().collect()} == want
    assert store.merge(spark.createDataFrame([(1, "five", 1)], schema), 5)
    assert {x["id"]: x["v"] for x in store.read().collect()} == want | {1: "five"}
    empty = Artefact(spark, str(tmp_path / "b"), schema, "id")
    assert empty.read().count() == 0 and empty.merge(spark.createDataFrame([], schema), 1) and empty.read().count() == 0
