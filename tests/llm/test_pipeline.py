"""The pipeline: what each stage keeps, and that its decisions take effect."""

import corpus_pipeline
import pytest
from test_pairs import plain_classes

from sigweave.llm import pii


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    base, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{sf}/documents.parquet"), {}
    out["input"] = docs
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(f"{base}/{name}")
        docs = out[name] = spark.read.parquet(f"{base}/{name}")
    return out


def test_columns(stages):
    for name in ("quality", "near_duplicates", "repeats", "personal_data"):
        assert stages[name].dtypes == stages["input"].dtypes
        assert stages[name].where("n_chars <> length(text)").isEmpty()


def test_one_of_each_group_stays(stages):
    rows = [(r.doc_id, r.text) for r in stages["quality"].collect()]
    want = {c for _, c in plain_classes(rows).values()}
    assert {r.doc_id for r in stages["near_duplicates"].collect()} == want


def test_clean_documents_stay(spark, sf, stages):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    good = stages["input"].join(labels.where("quality = 1"), "doc_id", "left_semi")
    kept = good.join(stages["quality"], "doc_id", "left_semi")
    assert kept.count() >= 0.98 * good.count()
    assert {r.doc_id for r in stages["repeats"].collect()} == {r.doc_id for r in stages["near_duplicates"].collect()}


def test_no_personal_data_is_left(stages):
    assert not any(pii.base_spans(r.text or "") for r in stages["personal_data"].collect())


def test_every_document_is_packed(stages):
    packed = stages["packing"]
    assert packed.select("doc_id").distinct().count() == stages["personal_data"].count()
    assert packed.groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").isEmpty()


def test_run_gives_the_rows_of_the_stages(spark, sf, stages):
    assert corpus_pipeline.run(spark, sf).count() == stages["packing"].count()


@pytest.mark.parametrize("n_chars", [True, False])
def test_stages_take_odd_rows_and_any_column_names(spark, sf, n_chars):
    """Null ids and texts, empty and repeated rows, columns named like those the stages make, no count of characters."""
    base = spark.read.parquet(f"{sf}/documents.parquet").limit(150)
    base = base.selectExpr("doc_id", "text", "lang", "n_chars" if n_chars else "1 as other")
    odd = [(None, None), (None, "a b c"), (None, "a b c"), (5_000_001, None), (5_000_002, ""), (5_000_003, "one two three four five six"), (5_000_003, "one two three four five six"), (5_000_004, "  ")]
    more = spark.createDataFrame([(i, t, "en", 0) for i, t in odd], base.schema)
    names = ["score", "id", "row", "drop", "again", "all", "words", "__score", "__id", "__row", "__again", "__first", "at", "b"]
    docs = base.unionByName(more).selectExpr("*", *[f"'x' as `{n}`" for n in names])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.dtypes == docs.dtypes, name
        rows = out.collect()
        docs = spark.createDataFrame(rows, docs.schema)
        assert all(r[n] == "x" for r in rows for n in names)
        if name == "near_duplicates":
            ids = [r.doc_id for r in rows]
            assert ids.count(5_000_003) <= 1 and ids.count(None) == [r.doc_id for r in before].count(None)
        before = rows
    packed = corpus_pipeline.pack_sequences(spark, docs, sf)
    assert packed.select("doc_id").distinct().count() == len({r.doc_id for r in before})


def test_stages_of_an_empty_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, docs, sf).count() == 0
