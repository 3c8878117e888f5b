"""Spelling variants: words one edit apart, found by asymmetric chunks, and the frequent form each of them leads to.

Of two words one insertion, deletion or replacement apart, the shorter one (of equal lengths the smaller one) contributes
two disjoint chunks, its first and its last `length div 2` characters; the other one contributes its positional grams of
that size. One edit touches one chunk at most, so the other one is a gram of the longer word: in its place if it lies
before the edit, moved by the difference of lengths (none or one) if it lies behind. Only grams within that shift can
join, so only they are made: the first one and the last one, for the own length and for the one below. Chunks and grams
meet in an equi join; what is left of both words must then be exactly one edit apart.

Groups whose chunks times grams exceed `PAIRS` are not compared: their rows go through the same step again with what is
left of the words, under the longer key of both chunks. A group whose words have one character left is as large as the
alphabet allows and is compared as it is. Thus nothing is capped and no frequent chunk makes all its pairs.

Counts of words are added up per task before they are shuffled. A form has at least twice the word's count, so chains
end after 62 steps at most; they are followed by doubling, one table in the shared folder per round.

Defined results: null or empty texts have no words; a null doc_id counts as empty text in the hash that decides on
deletions; repeated rows count once each; words of a document are taken from its whole text, however long; other columns
are ignored; an empty table has no words.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from sigweave.session import cut

HELD, CHUNK = 200_000, 1 << 20
#: chunks times grams of a key up to which all of them are compared
PAIRS = 10_000
RUN = re.compile("[a-zÀ-ÿ]+")
LOW = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def runs(text: str, chunk: int = CHUNK) -> Iterator[list[str]]:
    """Lists of the lower-cased runs of one text; a list covers about `chunk` characters."""
    text = text.encode("utf-8", "surrogatepass").translate(LOW).decode("utf-8", "surrogatepass")
    at = 0
    while at < len(text):
        end = min(len(text), at + chunk)
        if tail := RUN.match(text, end):
            end = tail.end()
        yield RUN.findall(text, at, end)
        at = end


def misspelt(run: str, seed: int, every: int) -> str:
    """The run, or the run without one character where the hash that began with `seed` is divisible by `every`."""
    h = zlib.crc32(run.encode(), seed)
    if h % every:
        return run
    k = h % len(run)
    return run[:k] + run[k + 1 :]


def count_words(docs: DataFrame, every: int = 97) -> DataFrame:
    """(word, n) of docs(doc_id, text): lower-cased runs, one in `every` (document, run) without one character."""

    def counted(batches):
        held: Counter = Counter()

        def rows():
            batch = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return batch

        for b in batches:
            for d, t in zip(b["doc_id"], b["text"], strict=True):
                seed = zlib.crc32(f"{'' if (i := d.as_py()) is None else i}:".encode())
                for found in runs(t.as_py() or ""):
                    for run, n in Counter(found).items():
                        held[misspelt(run, seed, every)] += n
                    if len(held) > HELD:
                        yield rows()
        if held:
            yield rows()

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(counted, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


def _cut_off(rest: Column, size: Column) -> list[Column]:
    """Both (side, gram, what is left) of a text: its first and its last `size` characters."""
    n = F.char_length(rest)
    return [
        F.struct(F.lit("<").alias("side"), F.substring(rest, F.lit(1), size).alias("gram"), F.substring(rest, size + 1, n - size).alias("rest")),
        F.struct(F.lit(">").alias("side"), F.substring(rest, n - size + 1, size).alias("gram"), F.substring(rest, F.lit(1), n - size).alias("rest")),
    ]


def _step(rows: DataFrame) -> DataFrame:
    """Rows (key, word, n, more, rest) under the longer keys of both chunks; `more` is what `rest` has beyond the shorter word."""
    size = F.expr("(char_length(rest) - more) div 2").cast("int")
    parts = rows.select("key", "word", "n", "more", F.explode(F.array(*_cut_off(F.col("rest"), size))).alias("c"))
    return parts.select(F.concat("key", "c.side", "c.gram").alias("key"), "word", "n", "more", "c.rest")


def near_pairs(words: DataFrame, pairs: int = PAIRS) -> DataFrame:
    """(a, a_n, b, b_n) of all words(word, n) that are one edit apart, each pair once; words have two characters at least."""
    start = words.select("word", "n", F.char_length("word").alias("size"), F.col("word").alias("rest"))
    chunks = _step(start.select(F.col("size").cast("string").alias("key"), "word", "n", F.lit(0).alias("more"), "rest"))
    more = start.withColumn("more", F.explode(F.array(F.lit(0), F.lit(1)))).where("size - more >= 2")
    grams = _step(more.select(F.expr("cast(size - more as string)").alias("key"), "word", "n", "more", "rest"))
    found = []
    while True:
        c = chunks.groupBy("key").agg(F.count("*").alias("c"), F.max(F.char_length("rest")).alias("left"))
        g = grams.groupBy("key").agg(F.count("*").alias("g"))
        hot = cut(c.join(g, "key").where((F.col("left") > 1) & (F.col("c") * F.col("g") > pairs)).select("key"))
        any_hot = not hot.isEmpty()
        cool = [x.join(hot, "key", "left_anti") if any_hot else x for x in (chunks, grams)]
        a = cool[0].select("key", F.col("word").alias("a"), F.col("n").alias("a_n"), F.col("rest").alias("a_rest"))
        b = cool[1].select("key", F.col("word").alias("b"), F.col("n").alias("b_n"), F.col("rest").alias("b_rest"), "more")
        near = (F.levenshtein("a_rest", "b_rest", 1) == 1) & ((F.col("more") == 1) | (F.col("a") < F.col("b")))
        found.append(a.join(b, "key").where(near).select("a", "a_n", "b", "b_n"))
        if not any_hot:
            break
        chunks, grams = (cut(_step(x.join(hot, "key", "left_semi"))) for x in (chunks, grams))
    out = found[0]
    for more_pairs in found[1:]:
        out = out.unionByName(more_pairs)
    return out.dropDuplicates(["a", "b"])


def last_forms(forms: DataFrame) -> DataFrame:
    """(word, root) of forms(word, form): the end of the chain that starts at each word; every round doubles the reach."""
    links = cut(forms.where("form is not null").select("word", F.col("form").alias("root")))
    while True:
        on = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        nxt = cut(links.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        links = nxt.select("word", "root")
        if nxt.where("moved").isEmpty():
            return links


def variants(words: DataFrame, ratio: int = 2, pairs: int = PAIRS) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of words(word, n).

    The form is the near word of largest count (ties: smallest), if that is `ratio` (2 at least) times the word's count.
    """
    if ratio < 2:
        raise ValueError("forms must grow, or chains need not end")
    ends = near_pairs(words, pairs)
    both = ends.select(
        F.inline(
            F.array(
                F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")),
                F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n")),
            )
        )
    )
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    ok = -F.col("best.less") >= F.lit(ratio) * F.col("n")
    rows = cut(
        words.join(best, "word", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(ok, F.col("best.near")).alias("form"),
            F.when(ok, -F.col("best.less")).alias("form_n"),
        )
    )
    return rows.join(last_forms(rows), "word", "left").withColumn("root", F.coalesce("root", "word"))


def op11_spelling_variants(spark, sf_dir: str) -> DataFrame:
    from sigweave.session import table

    words = cut(count_words(table(spark, sf_dir, "documents")).where((F.char_length("word") >= 5) & (F.col("n") >= 3)))
    return variants(words).select("word", "form", "root", "n", "n_near", "form_n")


OP11_SQL = """
WITH RECURSIVE crc AS MATERIALIZED (
  SELECT list_transform(range(256), lambda i: list_reduce([0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[],
    lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END, i::UBIGINT)) AS t
), runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents)
  GROUP BY ALL
), bytes AS (
  SELECT run, n, flatten(list_transform(string_split(id || ':' || run, ''), lambda ch:
    CASE WHEN unicode(ch) < 128 THEN [unicode(ch)::UBIGINT] ELSE [195::UBIGINT, (unicode(ch) - 64)::UBIGINT] END)) AS b FROM runs
), hashed AS (
  SELECT run, n, xor(list_reduce(b, lambda c, x: xor(t[CAST(xor(c, x) % 256 + 1 AS BIGINT)], c >> 8), 4294967295::UBIGINT), 4294967295::UBIGINT) AS h
  FROM bytes, crc
), made AS (
  SELECT CASE WHEN h % 97 = 0 THEN left(run, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, n FROM hashed
), words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM made GROUP BY 1 HAVING length(word) >= 5 AND sum(n) >= 3
), dropped AS (
  SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS d FROM words, unnest(range(1, length(word) + 1)) AS u(i)
), near AS (
  SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM dropped a JOIN dropped b ON a.d = b.d AND a.i = b.i AND a.word <> b.word
  UNION
  SELECT a.word, a.n, b.word, b.n FROM dropped a JOIN words b ON a.d = b.word
  UNION
  SELECT b.word, b.n, a.word, a.n FROM dropped a JOIN words b ON a.d = b.word
), best AS (
  SELECT word, count(*) AS n_near, arg_min(near, (-near_n, near)) AS near, max(near_n) AS near_n FROM near GROUP BY word
), forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * w.n THEN near END AS form, CASE WHEN near_n >= 2 * w.n THEN near_n END AS form_n
  FROM words w LEFT JOIN best b ON w.word = b.word
), chain AS (
  SELECT word, word AS root, form FROM forms
  UNION ALL
  SELECT c.word, f.word, f.form FROM chain c JOIN forms f ON c.form = f.word
)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM forms f JOIN chain c ON c.word = f.word AND c.form IS NULL
"""
