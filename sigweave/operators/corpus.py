"""Corpus work: headings and sections, glossary, term resolution, licences, lint, axes."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigweave.functions import text as X
from sigweave.operators.matching import contains_any
from sigweave.operators.ranking import previous_in_group
from sigweave.session import cut

# Heading grammars.
NUMBERED = r"^[ \t]*(\d+(?:\.\d+){1,3})[ \t]+(\S.*\S)[ \t]*$"
LEADER = r"\.[ \t]+\."
PAGE_END = r"\s\d{1,3}$"
TITLE = r"^[A-Z][A-Za-z][A-Za-z/&,'()\- ]{1,52}[A-Za-z)]$"
GLOSSARY = r"^\s*(\d{3,4})\s+(\S.*)$"
#: ends of lines beside the line feed and the carriage return, each one character
RARE_ENDS = "\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
LONE_RETURN = r"\r(?!\n)"
CJK = r"[\x{4E00}-\x{9FFF}]"
ROMANISED = r"^[a-zàáǎàāēéěèêīíǐìōóǒòūúǔùǖǘǚǜüA-Z' \-]+$"


def split_lines(text: Column) -> Column:
    """Lines of a text without their ends; every end is one character, but for `\\r\\n`, whose `\\r` stays on the line.

    Rarer ends become line feeds, which keeps all lengths; the pattern for lone carriage returns runs over texts with one only.
    """
    one = F.when(F.contains(text, F.lit("\r")), F.regexp_replace(text, LONE_RETURN, "\n")).otherwise(text)
    return F.split(F.translate(one, RARE_ENDS, "\n" * len(RARE_ENDS)), "\n")


def bare(line: Column) -> Column:
    """The line without the `\\r` of its end."""
    return F.when(line.endswith("\r"), F.substring(line, F.lit(1), F.length(line) - 1)).otherwise(line)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _starts(sizes: pd.Series) -> pd.Series:
    return sizes.map(lambda n: np.cumsum(n) - n)


def _lines(docs: DataFrame, key: str, text: str, head: Column, title: Column) -> DataFrame:
    """Heading candidates with their character span, found where their text lies: lines are neither shuffled nor sorted.

    A line's own end is no part of what the patterns see (so a heading before `\\r\\n` is one), but counts in the offsets,
    which are running sums inside the row.
    """
    x = docs.select(key, F.length(text).alias("_len"), split_lines(F.col(text)).alias("_l"))
    x = x.withColumn("_s", _starts(F.transform("_l", lambda c: F.length(c) + 1)))
    x = x.select(key, "_len", F.posexplode(F.arrays_zip("_l", "_s")).alias("pos", "z"))
    x = x.select(key, "_len", "pos", F.col("z._s").alias("start"), (F.length("z._l") + 1).alias("n"), bare(F.col("z._l")).alias("line"))
    s = x.select(key, "_len", "pos", "start", "n", head.alias("num"), title.alias("title")).filter("num is not null")
    return s.withColumn("stop", F.least(F.col("start") + F.col("n"), F.col("_len")))


def last_per_key(df: DataFrame, keys: Sequence[str], pos: str) -> DataFrame:
    """Keep the last occurrence per key (a body heading follows its contents entry)."""
    rn = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(pos)))
    return df.withColumn("_rn", rn).filter("_rn = 1").drop("_rn")


def spans(heads: DataFrame, key: str) -> DataFrame:
    """Body span: from heading end to the next heading start, or the end of the text."""
    nxt = F.coalesce(F.lead("start").over(W.partitionBy(key).orderBy("start")), F.col("_len"))
    return heads.withColumn("body_start", F.col("stop").cast("int")).withColumn("body_end", nxt.cast("int")).withColumn(
        "n_chars", (F.col("body_end") - F.col("body_start")).cast("int")
    )


def parse_numbered(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Numbered headings `N(.N){1,3} Title` with level, parent, chapter and body span."""
    line = F.col("line")
    num, title = F.regexp_extract(line, NUMBERED, 1), F.trim(F.regexp_extract(line, NUMBERED, 2))
    good = (
        (num != "") & ~line.rlike(LEADER) & ~line.rlike(PAGE_END)
        & (F.length(title) >= 3) & (F.length(title) <= 80) & title.rlike(r"^\p{L}")
    )
    h = _lines(docs, key, text, F.when(good, num), F.when(good, title))
    s = spans(last_per_key(h, [key, "num"], "pos"), key)
    parts = F.split("num", r"\.")
    return s.select(
        key, "num", "title", F.size(parts).alias("level"), F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), ".").alias("parent"),
        F.get(parts, F.lit(0)).alias("chapter"), "body_start", "body_end", "n_chars",
    )


def parse_titled(docs: DataFrame, key: str, text: str, max_words: int = 8, max_indent: int = 2) -> DataFrame:
    """Flush-left capitalised short lines as headings, numbered in document order; each is its own chapter."""
    line = F.col("line")
    title = F.regexp_replace(line, r"^\s+|\s+$", "")
    indent = F.length(F.regexp_extract(line, r"^[ \t]*", 0))
    good = (indent <= max_indent) & title.rlike(TITLE) & (F.size(F.split(title, r"\s+")) <= max_words)
    h = _lines(docs, key, text, F.when(good, title), F.when(good, title))
    s = spans(last_per_key(h, [key, "title"], "pos"), key)
    s = s.withColumn("num", F.row_number().over(W.partitionBy(key).orderBy("start")).cast("string"))
    flat = [F.lit(1).alias("level"), F.lit(None).cast("string").alias("parent"), F.col("num").alias("chapter")]
    return s.select(key, "num", "title", *flat, "body_start", "body_end", "n_chars")


def slice_sections(docs: DataFrame, sections: DataFrame, key: str, text: str) -> DataFrame:
    """Body text per section. Spans are gathered per document first (bounded by its
    headings), so each text crosses the join once instead of once per section."""
    sp = sections.groupBy(key).agg(F.collect_list(F.struct("num", "body_start", "n_chars")).alias("sp"))
    j = docs.select(key, F.col(text).alias("_t")).join(sp, key)
    cutter = F.transform("sp", lambda s: F.struct(s["num"].alias("num"), F.trim(F.substring(F.col("_t"), s["body_start"] + 1, s["n_chars"])).alias("body")))
    return j.select(key, F.explode(cutter).alias("s")).select(key, "s.*")


def section_scope(sections: DataFrame, chapters: Sequence[str] | None, min_chars: int = 200, limit: int = 0, order: Sequence[str] = ()) -> DataFrame:
    d = sections.filter(F.col("n_chars") >= min_chars)
    if chapters is not None:
        d = d.filter(F.col("chapter").isin(list(chapters)))
    return d.orderBy(*order).limit(limit) if limit else d


def parse_glossary(lines: DataFrame, line: str, pos: str) -> DataFrame:
    """Entry headers `code head ... CJK romanisation`; the first entry of a code stays."""
    c = F.col(line)
    rest = F.regexp_extract(c, GLOSSARY, 2)
    fields = F.split(F.trim(rest), r" {2,}")
    d = lines.filter(c.rlike(GLOSSARY) & c.rlike(CJK)).select(pos, F.regexp_extract(c, GLOSSARY, 1).alias("code"), fields.alias("f"))
    at = F.array_position(F.transform("f", lambda x: x.rlike(CJK)), F.lit(True)).cast("int")
    d = d.withColumn("at", at).filter("at > 0")
    nxt = F.trim(F.coalesce(F.get("f", F.col("at")), F.lit("")))
    roman = F.when((nxt != "") & nxt.rlike(ROMANISED), nxt).otherwise("")
    head = F.when((F.size("f") > 1) & (F.col("at") > 1), F.trim(F.get("f", F.lit(1)))).otherwise("")
    e = d.select("code", pos, F.struct(head.alias("en"), F.trim(F.get("f", F.col("at") - 1)).alias("zh"), roman.alias("romanised")).alias("e"))
    return e.groupBy("code").agg(F.min_by("e", pos).alias("e")).select("code", "e.*")


def search_terms(df: DataFrame, q: str, cols: Sequence[str]) -> DataFrame:
    """Case-insensitive containment in any of the columns."""
    hit = F.lit(False)
    for c in cols:
        hit = hit | F.lower(c).contains(q.lower())
    return df.filter(hit)


def resolve_terms(
    trip: DataFrame,
    features: Sequence[str],
    outcomes: Sequence[str],
    feature_alias: dict[str, tuple[str, str]],
    outcome_alias: dict[str, str],
    unobservable: Sequence[str],
) -> DataFrame:
    """Resolve raw (feature, value, outcome) strings to the vocabulary, with a status.

    Cascade: junk, canonical, alias, (outcomes) first alias inside the phrase in
    alias order, candidate. Unobservable features are candidates; features over 45
    characters are junk. The overall status is the worst. All dictionaries are
    literals, so this is a narrow map.
    """
    f, o = X.clean_term(F.col("feature")), X.clean_term(F.col("outcome"))
    d = trip.withColumn("_f", f).withColumn("_o", o)
    f, o = F.col("_f"), F.col("_o")
    lit_map = lambda m: F.create_map(*[x for k, v in m.items() for x in (F.lit(k), F.lit(v))])
    pair = lambda a, b: F.struct(F.lit(a).alias("feature"), F.lit(b).alias("value"))
    fa = F.try_element_at(F.create_map(*[x for k, v in feature_alias.items() for x in (F.lit(k), pair(*v))]), f)
    f_hidden = F.lit(False)
    for u in unobservable:
        f_hidden = f_hidden | f.contains(u)
    f_status = (
        F.when(X.is_junk(f), "junk").when(f.isin(list(features)), "mapped").when(fa.isNotNull(), "mapped").when(f_hidden, "candidate").when(F.length(f) > 45, "junk").otherwise("candidate")
    )
    f_key = F.when(f.isin(list(features)), f).when(fa.isNotNull(), fa["feature"]).otherwise(f)
    f_val = F.when(f.isin(list(features)), F.when(F.col("value") != "", F.col("value")).otherwise("present")).when(fa.isNotNull(), fa["value"]).otherwise(F.col("value"))
    oa = F.try_element_at(lit_map(outcome_alias), o)
    inside = F.get(contains_any(o, list(outcome_alias.items())), F.lit(0))["key"]
    o_key = F.when(o.isin(list(outcomes)), o).when(oa.isNotNull(), oa).when(inside.isNotNull(), inside).otherwise(o)
    o_status = F.when(X.is_junk(o), "junk").when(o.isin(list(outcomes)) | oa.isNotNull() | inside.isNotNull(), "mapped").otherwise("candidate")
    r = d.withColumn("f_status", f_status).withColumn("o_status", o_status)
    fs, os_ = F.col("f_status"), F.col("o_status")
    worst = F.when((fs == "junk") | (os_ == "junk"), "junk").when((fs == "candidate") | (os_ == "candidate"), "candidate").otherwise("mapped")
    gone = lambda s, c: F.when(s != "junk", c)
    keep = [c for c in trip.columns if c not in ("feature", "value", "outcome")]
    return r.select(*keep, gone(fs, f_key).alias("feature"), gone(fs, f_val).alias("value"), gone(os_, o_key).alias("outcome"), worst.alias("status"))


def review(trip: DataFrame, features: Sequence[str], outcomes: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Tallies of canonical (ok) / needs-normalising (norm) / junk triplets, and counts of unknown strings."""
    f = F.trim(F.regexp_replace("feature", r"\s*\(.*\)\s*$", ""))
    o = F.col("outcome")
    junk = F.col("feature").startswith("other:") | o.startswith("other:") | (F.length("feature") > 45) | (F.length("outcome") > 45)
    cls = F.when(junk, "junk").when(f.isin(list(features)) & o.isin(list(outcomes)), "ok").otherwise("norm")
    c = trip.select(f.alias("f"), o.alias("o"), cls.alias("cls"))
    unknown = c.filter("cls <> 'ok'").select(
        F.explode(
            F.array_compact(
                F.array(
                    F.when(~F.col("f").isin(list(features)), F.struct(F.lit("feature").alias("kind"), F.col("f").alias("term"))),
                    F.when(~F.col("o").isin(list(outcomes)), F.struct(F.lit("outcome").alias("kind"), F.col("o").alias("term"))),
                )
            )
        ).alias("u")
    )
    return c.groupBy("cls").agg(F.count("*").alias("n")), unknown.groupBy("u.kind", "u.term").agg(F.count("*").alias("n"))


def resolve_license(df: DataFrame, source: Column, aliases: Sequence[tuple[str, str]], registry: dict[str, tuple[str, str]], rank: dict[str, int]) -> DataFrame:
    """Registry keys named in a free-text source and the most restrictive licence with its usage.

    Aliases are tried longest first; ties in restrictiveness keep the first; no key
    means own text. The registry is a literal, so no join is needed.
    """
    ordered = sorted([(a.lower(), k) for a, k in aliases], key=lambda t: -len(t[0]))
    s = F.lower(F.coalesce(source, F.lit("")))
    keys = F.array_distinct(F.transform(contains_any(s, ordered), lambda e: e["key"]))
    d = df.withColumn("source_keys", F.when((F.size(keys) == 0) & (F.trim(s) == ""), F.array(F.lit("authored"))).otherwise(keys))
    lit = lambda vals: F.create_map(*[x for k, v in vals.items() for x in (F.lit(k), F.lit(v))])
    lic = lit({k: v[0] for k, v in registry.items()})
    use = lit({k: v[1] for k, v in registry.items()})
    rk = lit({k: rank.get(v[0], 1) for k, v in registry.items()})
    best = F.aggregate(
        "source_keys",
        F.struct(F.lit(-1).alias("r"), F.lit("own").alias("license"), F.lit("authored-summary").alias("usage")),
        lambda acc, k: F.when(
            F.coalesce(F.try_element_at(rk, k), F.lit(0)) > acc["r"],
            F.struct(F.coalesce(F.try_element_at(rk, k), F.lit(0)).alias("r"), F.coalesce(F.try_element_at(lic, k), F.lit("own")).alias("license"), F.coalesce(F.try_element_at(use, k), F.lit("authored-summary")).alias("usage")),
        ).otherwise(acc),
    )
    return d.withColumn("_b", best).withColumn("license", F.col("_b.license")).withColumn("usage", F.col("_b.usage")).drop("_b")


def type_and_tags(chunks: DataFrame, cid: str, text: str, types: dict[str, str], names: Sequence[tuple[str, str]]) -> DataFrame:
    """Chunk type from the id prefix; tags = outcomes whose name occurs in id or text."""
    prefix = F.substring_index(F.col(cid), ":", 1)
    typ = F.coalesce(F.try_element_at(F.create_map(*[x for k, v in types.items() for x in (F.lit(k), F.lit(v))]), prefix), F.lit("card"))
    body = F.lower(F.concat_ws(" ", cid, text))
    tags = F.array_sort(F.array_distinct(F.transform(contains_any(body, names), lambda e: e["key"])))
    return chunks.withColumn("type", typ).withColumn("tags", tags)


def prefix_key(text: Column, n: int = 80) -> Column:
    """First n characters of the lower-cased, blank-folded text.

    The first n units (a run of blanks, or one character) already hold them, so the
    rest of the text is not rewritten.
    """
    head = F.regexp_extract(text, rf"^((?:\s++|\S){{0,{n}}})", 1)
    return F.substring(F.regexp_replace(F.lower(head), r"\s+", " "), 1, n)


def near_dup(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Previous row (by id) with the same normalised 80-character prefix.

    Only prefixes seen more than once are ranked, and a prefix shared by a large
    part of the corpus is spread by the range-partitioned ranker.
    """
    d = cut(docs.select(key, F.md5(prefix_key(F.col(text))).alias("_p")))  # the text is read once
    many = d.groupBy("_p").agg(F.count("*").alias("_c")).filter("_c > 1").select("_p")
    return previous_in_group(d.join(many, "_p", "left_semi"), ["_p"], [F.col(key)], key, "previous").filter("previous is not null").select(key, "previous")


def lint_corpus(corpus: DataFrame, rowid: str, cid: str, text: str, source: str, n_keys: Column, usage: Column) -> DataFrame:
    """(rowid, level, issue): repeated ids, unregistered or pending sources; short, long or near-duplicate texts."""
    n = F.length(text)
    local = F.array_compact(
        F.array(
            F.when((F.col(source) != "") & (n_keys == 0), F.struct(F.lit("problem").alias("level"), F.lit("unregistered source").alias("issue"))),
            F.when(usage == "permission-pending", F.struct(F.lit("problem").alias("level"), F.lit("pending source").alias("issue"))),
            F.when(n < 40, F.struct(F.lit("warning").alias("level"), F.lit("very short").alias("issue"))),
            F.when(n > 900, F.struct(F.lit("warning").alias("level"), F.lit("long").alias("issue"))),
        )
    )
    per_row = corpus.select(rowid, F.explode(local).alias("x")).select(rowid, "x.*")
    # All but the first row of an id repeat it: the first is a map-side combined minimum.
    first = corpus.groupBy(cid).agg(F.min(rowid).alias("_first"), F.count("*").alias("_c")).filter("_c > 1")
    dup = corpus.select(rowid, cid).join(first, cid).filter(F.col(rowid) != F.col("_first")).select(rowid, F.lit("problem").alias("level"), F.lit("duplicate id").alias("issue"))
    near = near_dup(corpus, rowid, text).select(rowid, F.lit("warning").alias("level"), F.lit("near duplicate").alias("issue"))
    return per_row.unionByName(dup).unionByName(near)


def corpus_stats(df: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Counts by each dimension alone, in one pass (grouping sets)."""
    slots = F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).cast("string").alias("value")) for d in dims])
    return df.select(F.explode(slots).alias("s")).groupBy("s.dim", "s.value").agg(F.count("*").alias("n"))


def axis_recall(cases: DataFrame, ours: str, gold: str) -> DataFrame:
    """Directional consistency (any axis in common) overall and per gold axis; cases without gold axes drop."""
    c = cases.filter(F.size(gold) > 0).select(F.arrays_overlap(ours, gold).cast("int").alias("hit"), F.concat(F.array(F.lit("ALL")), F.array_distinct(gold)).alias("ax"))
    from sigweave.functions.scores import rnd

    return c.select("hit", F.explode("ax").alias("axis")).groupBy("axis").agg(F.count("*").alias("n"), F.sum("hit").alias("n_hit"), rnd(F.avg("hit"), 6).alias("rate"))
