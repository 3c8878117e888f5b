"""Substring joins. Literal dictionaries become a row-local expression; dictionaries that are tables
become an automaton, or, beyond a measured size, an equi join on anchors."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigweave.dims import checked_broadcast
from sigweave.functions.text import fold_ws
from sigweave.operators.automaton import Automaton
from sigweave.session import cut

SHINGLE = 5  # interior tokens used as an anchor
AUTOMATON_BYTES = 4 << 20  # of a dictionary (8 for each item and its text): states and arrays of a task are bounded by it
GRAM = 3  # characters that anchor an item without interior tokens


def contains_any(text: Column, entries: Sequence[tuple[str, str]]) -> Column:
    """Array of (pos, key) for every literal entry contained in `text`, in entry order."""
    return F.array_compact(
        F.array(*[F.when(text.contains(a), F.struct(F.lit(i).alias("pos"), F.lit(k).alias("key"))) for i, (a, k) in enumerate(entries)])
    )


def contains_first(text: Column, entries: Sequence[tuple[str, str]]) -> Column:
    """Key of the first (highest-priority) literal entry contained in `text`, else NULL."""
    out = None
    for a, k in entries:
        out = F.when(text.contains(a), F.lit(k)) if out is None else out.when(text.contains(a), F.lit(k))
    return out


def _shingles(tokens: Column, n: int) -> Column:
    """Hashes of all runs of n tokens."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(tokens) - (n - 1), F.lit(1)))
    return F.transform(starts, lambda i: F.xxhash64(F.array_join(F.slice(tokens, i, F.lit(n)), " ")))


def _substrings(c: Column, n: int) -> Column:
    """All substrings of exactly n characters."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(c) - (n - 1), F.lit(1)))
    return F.when(F.length(c) >= n, F.transform(starts, lambda i: F.substring(c, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def contains_join(texts: DataFrame, tid: str, text: str, items: DataFrame, iid: str, item: str, max_bytes: int | None = None) -> DataFrame:
    """Exact (tid, iid) pairs where the folded item is a substring of the folded text.

    The dictionary is measured first. Up to `max_bytes` (`AUTOMATON_BYTES`) it becomes one automaton, built on the
    driver and broadcast: each text is read once, in place, whatever the number of items, and only hits leave the task.
    A larger dictionary is anchored and joined (`anchored_join`), so nothing that grows with it is broadcast. Both ways
    give the same rows: one per text row and item row; null or blank items and texts match nothing.
    """
    it = items.select(iid, fold_ws(F.col(item)).alias("_item")).filter("_item <> ''")
    size = it.agg(F.sum(F.octet_length("_item") + 8).alias("n")).first()["n"] or 0
    if size > (AUTOMATON_BYTES if max_bytes is None else max_bytes):
        return anchored_join(texts, tid, text, items, iid, item)
    known = it.toArrow()
    number: dict[bytes, int] = {}
    nth = np.array([number.setdefault(w.encode(), len(number)) for w in known["_item"].to_pylist()], np.int64)
    rows = np.argsort(nth, kind="stable")  # rows of the dictionary by the number of their text
    first = np.searchsorted(nth[rows], np.arange(len(number) + 1))
    shared = texts.sparkSession.sparkContext.broadcast((Automaton(list(number)), known[iid].combine_chunks(), rows, first))

    def find(batches):
        automaton, ids, rows, first = shared.value
        for b in batches:
            c = b["_text"].cast(pa.large_binary())
            offsets = np.frombuffer(c.buffers()[1], np.int64)[c.offset : c.offset + len(c) + 1]
            at, hit = automaton.find(np.frombuffer(c.buffers()[2], np.uint8), offsets)
            n = first[hit + 1] - first[hit]
            each = np.repeat(first[hit] - np.cumsum(n) + n, n) + np.arange(n.sum())
            yield pa.RecordBatch.from_arrays([b[tid].take(pa.array(np.repeat(at, n))), ids.take(pa.array(rows[each]))], [tid, iid])

    schema = T.StructType([texts.schema[tid], items.schema[iid]])
    return texts.select(tid, fold_ws(F.col(text)).alias("_text")).filter("_text <> ''").mapInArrow(find, schema)


def anchored_join(texts: DataFrame, tid: str, text: str, items: DataFrame, iid: str, item: str) -> DataFrame:
    """`contains_join` for dictionaries too large for one task.

    Blanks around an item's interior tokens are part of the item, so those tokens
    are whole tokens of any text containing it. Their first five form an anchor
    shingle; texts emit the shingles of each anchor length, an equi join proposes
    candidates and `contains` verifies them on the whole text. Items with fewer
    than three tokens have no interior: their first three characters (or fewer, if
    they are shorter) are looked up among the texts' own. Anchors travel without
    item texts, which join by id once the candidates are known. Nothing is
    capped, no pair is emitted without a shared anchor.
    """
    it = items.select(iid, fold_ws(F.col(item)).alias("_item")).filter("_item <> ''")
    tk = it.withColumn("_tk", F.split("_item", " ")).withColumn("_n", F.least(F.size("_tk") - 2, F.lit(SHINGLE)))
    long = tk.filter("_n > 0").select(iid, "_n", F.xxhash64(F.array_join(F.slice(F.col("_tk"), F.lit(2), F.col("_n")), " ")).alias("_a"))
    short = tk.filter("_n <= 0").select(iid, F.least(F.length("_item"), F.lit(GRAM)).alias("_n"), F.substring("_item", 1, GRAM).alias("_g"))
    sizes = sorted(r["_n"] for r in long.select("_n").distinct().collect())  # at most SHINGLE values
    grams = sorted(r["_n"] for r in short.select("_n").distinct().collect())  # at most GRAM values

    tx = texts.select(tid, fold_ws(F.col(text)).alias("_text"))
    cands = []
    if sizes:
        tokens = tx.select(tid, F.split("_text", " ").alias("_tk"))
        found = F.array_distinct(F.concat(*[_shingles(F.col("_tk"), n) for n in sizes]))
        cands.append(tokens.select(tid, F.explode(found).alias("_a")).join(checked_broadcast(long.select(iid, "_a")), "_a").select(tid, iid))
    if grams:
        found = F.array_distinct(F.concat(*[_substrings(F.col("_text"), n) for n in grams]))
        cands.append(tx.select(tid, F.explode(found).alias("_g")).join(checked_broadcast(short.select(iid, "_g")), "_g").select(tid, iid))
    if not cands:
        return texts.select(tid).limit(0).withColumn(iid, F.lit(None).cast(items.schema[iid].dataType))
    pairs = cut(reduce(DataFrame.unionByName, cands).distinct())
    whole = checked_broadcast(pairs).join(tx, tid).join(it, iid)
    return whole.filter(F.col("_text").contains(F.col("_item"))).select(tid, iid)


def validate_citations(trip: DataFrame, sections: DataFrame, key: str, snippet: str, body: str, required: Sequence[str] = ()) -> DataFrame:
    """Keep triplets whose folded snippet is contained in their folded section; snippets cut to 200.

    Blank snippets or required fields drop. One equi join on the section key.
    """
    t = trip.filter(F.trim(F.coalesce(F.col(snippet), F.lit(""))) != "")
    for c in required:
        t = t.filter(F.trim(F.coalesce(F.col(c), F.lit(""))) != "")
    s = sections.select(key, F.col(body).alias("_body"))
    return t.join(s, key).filter(fold_ws(F.col("_body")).contains(fold_ws(F.col(snippet)))).drop("_body").withColumn(snippet, F.substring(F.trim(F.col(snippet)), 1, 200))
