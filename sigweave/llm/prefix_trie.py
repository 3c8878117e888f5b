"""Prefix trie of conversations by collapsing whole sequences, without walking it level by level.

Identical rebuilt conversations become one weighted sequence (its weight is their number, its name the smallest id). Only
these sequences send prefixes: a prefix is named by its length and four sums of 31-bit pieces of its turns' SHA-256 digests,
taken together with the turns' places, so names are running sums and no sequence has to lie in one row. Sequences that
are proper prefixes of others go by an anti-join; the rest are the leaves. Then two aggregates over the weighted prefixes
give all nodes:

* first the smallest name of each node. A sequence owns the nodes that carry its name; since fewer sequences pass through
  deeper nodes, it owns all its prefixes from some depth on. That depth is one number per sequence.
* with it every quantity of a subtree is a sum over the sequences that pass its top: members (weights), leaves, children
  (sequences that own a node one deeper), words of all members below, words of all nodes below (each counted by its owner).
  saved_tokens is the difference of the last two.

No group is gathered: ranks and running sums use range partitions with one total per conversation and partition, of which
only those that go over a boundary are needed (one per partition at most, so they are broadcast). Nodes that more than one
`SHARE`-th of all prefixes pass are fewer than `SHARE`; their names are broadcast, the others join by shuffle. The list of
the conversations that end at a node is hashed as a stream of chunks made per range partition.

Defined results: rows with a null conv_id take no part; a null role or text is empty; turns are ordered by turn (null
first), ties by role and text, repeated rows stay repeated turns; other columns are ignored; an empty table has no nodes.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from sigweave.operators.ranking import distributed_rank
from sigweave.session import cut

SHARE = 1000
PIECES = [f"p{i}" for i in range(4)]
SUMS = [*PIECES, "words"]


def _name(*at):
    """A prefix's name from its length and its sums."""
    return F.concat_ws(".", *[F.col(c).cast("string") if isinstance(c, str) else c for c in at])


def turns(talk: DataFrame) -> DataFrame:
    """(conv_id, i, digest, words) of talk(conv_id, turn, role, text): the turns in their order, i from 0."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = talk.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        role.alias("role"),
        text.alias("text"),
    )
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    ranked = distributed_rank(rows, ["conv_id"], order, "i")
    digest = F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    return ranked.select("conv_id", (F.col("i") - 1).alias("i"), digest.alias("digest"), words.alias("words"))


def rebuilt(own: DataFrame, group: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """(conv_id, len) of all conversations, and (conv_id, pos, digest, words) of their rebuilt turns, pos from 1.

    own(conv_id, i, digest, words). The first h turns come from the conversation that the group begins with.
    """
    n = own.groupBy("conv_id").agg(F.count("*").alias("n"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    n = n.withColumn("h", h).withColumn("head", F.col("conv_id") - F.col("conv_id") % group)
    heads = n.where("conv_id = head").select("head", F.col("n").alias("head_n"))
    convs = n.join(heads, "head", "left").withColumn("lead", F.least("h", F.coalesce("head_n", F.lit(0))))
    convs = cut(convs.select("conv_id", "head", "h", "lead", (F.col("lead") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("len")))
    first = own.where((F.col("i") < most - 1) & (F.col("conv_id") % group == 0)).withColumnRenamed("conv_id", "head")
    lead = first.join(convs, "head").where("i < h").select("conv_id", (F.col("i") + 1).alias("pos"), "digest", "words")
    rest = own.join(convs, "conv_id").where("i >= h").select("conv_id", (F.col("i") - F.col("h") + F.col("lead") + 1).alias("pos"), "digest", "words")
    return convs.select("conv_id", "len"), lead.unionByName(rest)


def _running(batches):
    """Running sums of SUMS inside the conversations of one sorted partition."""
    task, last, total = TaskContext.get().partitionId(), None, [0] * len(SUMS)
    for b in batches:
        cols = [b[c].to_pylist() for c in ("conv_id", *SUMS)]
        out: list[list[int]] = [[] for _ in SUMS]
        for conv, *values in zip(*cols, strict=True):
            if conv != last:
                last, total = conv, [0] * len(SUMS)
            total = [t + v for t, v in zip(total, values, strict=True)]
            for have, t in zip(out, total, strict=True):
                have.append(t)
        yield pa.RecordBatch.from_arrays(
            [b["conv_id"], b["pos"], b["words"], pa.array([task] * len(b), pa.int32()), *[pa.array(x, pa.int64()) for x in out]],
            ["conv_id", "pos", "own", "pid", *SUMS],
        )


def prefixes(rows: DataFrame) -> DataFrame:
    """(conv_id, pos, own, p0..p3, words): the sums over the first pos turns of rows(conv_id, pos, digest, words)."""
    piece = [F.conv(F.substring(F.sha2(F.concat_ws(":", "pos", "digest"), 256), 1 + 8 * i, 8), 16, 10).cast("long") % (1 << 31) for i in range(4)]
    flat = rows.select("conv_id", "pos", *[p.alias(c) for p, c in zip(piece, PIECES, strict=True)], "words")
    placed = cut(flat.repartitionByRange("conv_id", "pos").sortWithinPartitions("conv_id", "pos").mapInArrow(
        _running, "conv_id long, pos long, own long, pid int, " + ", ".join(f"{c} long" for c in SUMS)))
    totals = placed.groupBy("conv_id", "pid").agg(*[F.max(c).alias(c) for c in SUMS])
    before = W.partitionBy("conv_id").orderBy("pid").rowsBetween(W.unboundedPreceding, -1)
    carried = totals.select("conv_id", "pid", *[F.sum(c).over(before).alias(f"b_{c}") for c in SUMS]).where("b_p0 is not null")
    j = placed.join(F.broadcast(carried), ["conv_id", "pid"], "left")  # at most one conversation goes on into a partition
    return j.select("conv_id", "pos", "own", *[(F.col(c) + F.coalesce(f"b_{c}", F.lit(0))).alias(c) for c in SUMS])


def _chunks(batches):
    """Comma-joined ids of each sequence in one sorted partition, in chunks."""
    last, first, held = None, None, []
    for b in batches:
        rows = []
        for name, conv in zip(b["name"].to_pylist(), b["conv_id"].to_pylist(), strict=True):
            if held and (name != last or len(held) >= 5000):
                rows.append((last, first, ",".join(held)))
                held = []
            if not held:
                last, first = name, conv
            held.append(str(conv))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string()))], ["name", "first", "ids"])
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([last]), pa.array([first], pa.int64()), pa.array([",".join(held)])], ["name", "first", "ids"])


def _digests(batches):
    """SHA-256 of the chunks of each name, joined with commas."""
    last, h = None, None
    for b in batches:
        done = []
        for name, ids in zip(b["name"].to_pylist(), b["ids"].to_pylist(), strict=True):
            if name == last:
                h.update(b",")
            else:
                if h is not None:
                    done.append((last, h.hexdigest()))
                last, h = name, hashlib.sha256()
            h.update(ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], pa.string()) for i in (0, 1)], ["name", "ends_sha256"])
    if h is not None:
        yield pa.RecordBatch.from_arrays([pa.array([last]), pa.array([h.hexdigest()])], ["name", "ends_sha256"])


def end_lists(ends: DataFrame) -> DataFrame:
    """(name, ends_sha256) of ends(name, conv_id): the hash of each name's ascending ids, joined with commas."""
    chunks = ends.repartitionByRange("name", "conv_id").sortWithinPartitions("name", "conv_id").mapInArrow(_chunks, "name string, first long, ids string")
    return chunks.repartition("name").sortWithinPartitions("name", "first").mapInArrow(_digests, "name string, ends_sha256 string")


def named(rows: DataFrame, share: int = SHARE) -> DataFrame:
    """rows(name, conv_id, ...) with `top`, the smallest conv_id of the name, whatever share of the rows a name has."""
    nodes = cut(rows.groupBy("name").agg(F.min("conv_id").alias("top"), F.count("*").alias("size")))
    bound = F.lit((nodes.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]) // share + 1)
    hot = nodes.where(F.col("size") > bound).select("name", F.col("top").alias("hot"))  # fewer than `share` rows
    marked = rows.join(F.broadcast(hot), "name", "left")
    cool = marked.where("hot is null").join(nodes.select("name", "top"), "name")
    return marked.where("hot is not null").withColumn("top", F.col("hot")).select(*rows.columns, "top").unionByName(cool.select(*rows.columns, "top"))


def trie(talk: DataFrame, group: int = 20, most: int = 4, share: int = SHARE) -> DataFrame:
    """One row per node of the rebuilt conversations of talk(conv_id, turn, role, text)."""
    convs, rows = rebuilt(turns(talk), group, most)
    steps = prefixes(rows)
    zero = _name(*[F.lit(0)] * 5)
    full = steps.join(convs, "conv_id").where("pos = len").select("conv_id", "len", _name("pos", *PIECES).alias("name"), F.col("words").alias("total"))
    full = cut(full.unionByName(convs.where("len = 0").select("conv_id", "len", zero.alias("name"), F.lit(0).cast("long").alias("total"))))

    # identical conversations are one weighted sequence, named by the smallest id
    seqs = full.groupBy("name").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("weight"), F.first("len").alias("len"), F.first("total").alias("total"))
    seqs = cut(seqs.withColumnRenamed("name", "whole"))
    one = seqs.select("conv_id", "len")
    part = steps.join(one, "conv_id").select("conv_id", "pos", "len", _name("pos", *PIECES).alias("name"), "words", (F.col("words") - F.col("own")).alias("above"))
    root = one.select("conv_id", F.lit(0).cast("long").alias("pos"), "len", zero.alias("name"), *[F.lit(0).cast("long").alias(c) for c in ("words", "above")])
    part = cut(part.unionByName(root))
    inner = part.where("pos < len").select(F.col("name").alias("whole")).distinct()
    leaves = seqs.join(inner, "whole", "left_anti").select("conv_id", F.lit(1).alias("leaf"))

    tops = cut(named(part, share))
    not_own = F.col("top") != F.col("conv_id")
    depth = tops.groupBy("conv_id").agg(
        F.min(F.when(~not_own, F.col("pos"))).alias("owns"), F.max(F.when(not_own, F.struct("pos", "top", "words"))).alias("over")
    )
    facts = seqs.join(depth, "conv_id").join(leaves, "conv_id", "left").select(
        "conv_id", "weight", "total", "owns", F.col("over.top").alias("over"), F.coalesce("over.words", F.lit(0)).alias("before"), F.coalesce("leaf", F.lit(0)).alias("leaf")
    )
    j = tops.join(facts, "conv_id")
    parent = F.when(F.col("pos") == F.col("owns"), F.col("over")).otherwise(F.col("conv_id"))
    nodes = j.groupBy("name").agg(
        F.min("conv_id").alias("conv_id"),
        F.min("pos").alias("depth"),
        F.max(F.when((F.col("pos") >= F.col("owns")) & (F.col("pos") > 0), parent)).alias("parent_conv_id"),
        F.sum("weight").alias("n_convs"),
        F.sum(((F.col("len") > F.col("pos")) & (F.col("owns") <= F.col("pos") + 1)).cast("long")).alias("n_children"),
        F.sum(F.col("leaf").cast("long")).alias("n_leaves"),
        F.sum(F.col("weight") * (F.col("total") - F.col("above")) - (F.col("total") - F.greatest("above", "before"))).alias("saved_tokens"),
    )
    out = nodes.join(end_lists(full.select("name", "conv_id")), "name", "left")
    return out.withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256))).drop("name")


def op13_prefix_trie(spark, sf_dir: str) -> DataFrame:
    from sigweave.session import table

    return trie(table(spark, sf_dir, "conversations"))


OP13_SQL = r"""
WITH crc AS MATERIALIZED (
  SELECT list_transform(range(256), lambda i: list_reduce([0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[],
    lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END, i::UBIGINT)) AS t
), own AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS i,
    {'r': coalesce(role, ''), 't': coalesce(text, '')} AS x
  FROM conversations WHERE conv_id IS NOT NULL
), ids AS (
  SELECT conv_id, count(*) AS n, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda ch: unicode(ch)::UBIGINT) AS b FROM own GROUP BY conv_id
), heads AS (
  SELECT conv_id, n, conv_id - conv_id % 20 AS head,
    CAST(xor(list_reduce(b, lambda c, x: xor(t[CAST(xor(c, x) % 256 + 1 AS BIGINT)], c >> 8), 4294967295::UBIGINT), 4294967295::UBIGINT) % 4 AS BIGINT) AS h
  FROM ids, crc
), made AS (
  SELECT h.conv_id, o.i AS i, o.x FROM heads h JOIN own o ON o.conv_id = h.head AND o.i < h.h
  UNION ALL
  SELECT h.conv_id, o.i AS i, o.x FROM heads h JOIN own o ON o.conv_id = h.conv_id AND o.i >= h.h
), seqs AS (
  SELECT h.conv_id, coalesce(list(m.x ORDER BY m.i) FILTER (WHERE m.i IS NOT NULL), []) AS s FROM heads h LEFT JOIN made m ON m.conv_id = h.conv_id GROUP BY h.conv_id
), pre AS (
  SELECT conv_id, d, CASE WHEN d = 0 THEN [] ELSE s[1:d] END AS s, len(s) = d AS ends FROM seqs, unnest(range(0, len(s) + 1)) AS u(d)
), nodes AS (
  SELECT s, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256,
    CASE WHEN d = 0 THEN 0 ELSE (count(*) - 1) * len(regexp_extract_all(s[d].t, '[^\x20\x09-\x0D]+')) END AS saved
  FROM pre GROUP BY s, d
), kids AS (
  SELECT p.s, count(*) AS n FROM nodes c JOIN nodes p ON c.depth = p.depth + 1 AND (p.depth = 0 OR c.s[1:p.depth] = p.s) GROUP BY p.s
), below AS (
  SELECT u.s, sum(v.saved) AS saved, sum(CASE WHEN k.n IS NULL THEN 1 ELSE 0 END) AS leaves
  FROM nodes v LEFT JOIN kids k ON k.s = v.s, unnest(range(0, v.depth + 1)) AS a(d) JOIN nodes u ON u.depth = a.d AND (a.d = 0 OR u.s = v.s[1:a.d]) GROUP BY u.s
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, CAST(coalesce(k.n, 0) AS BIGINT) AS n_children, CAST(b.leaves AS BIGINT) AS n_leaves,
  CAST(b.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n JOIN below b ON b.s = n.s LEFT JOIN kids k ON k.s = n.s
LEFT JOIN nodes p ON p.depth = n.depth - 1 AND (p.depth = 0 OR p.s = n.s[1:p.depth])
"""
