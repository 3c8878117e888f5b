"""Token counts of sections by offsets: whole documents are encoded once, tokens are joined to sections by their spans.

A section is a span of code points; sections are ascending and do not overlap, gaps are allowed. Encoding whole texts (not
sections one by one) keeps every token as the model sees it, so the counts of a document's sections and of its gaps add up to
its tokens. A token's span runs from the character of its first byte to that of its last. Tokens that cross a boundary
are allocated by `rule`:

* `most` (default): to the section, or gap, with most of the token's bytes; the earlier one of equals
* `first`: to the section, or gap, of its first byte
* `last`: to the section, or gap, of its last byte

The interval join is one sorted search per document over both ends of all its tokens, without an exchange; ids never leave
the task. Very long texts are encoded in pieces of bounded size (`pretokens.py`), their offsets are integer arrays.

Defined results: a null or empty text is one empty section without tokens; repeated rows each get their rows; a null id
stays null; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sigweave.llm.byte_bpe import codec
from sigweave.llm.textbytes import text_bytes

RULES = ("most", "first", "last")


def lines(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte spans of the lines of a text, each with its line feed; they cover the text."""
    ends = np.flatnonzero(text == 10) + 1
    if not len(ends) or ends[-1] < len(text):
        ends = np.append(ends, len(text))
    return np.concatenate([[0], ends[:-1]]), ends


def place(point: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Number of the section that holds each byte: odd places are sections (2 * n + 1), even ones the gaps before them."""
    n = np.searchsorted(start, point, "right") - 1
    inside = (n >= 0) & (point < end[np.maximum(n, 0)])
    return np.where(inside, 2 * n + 1, 2 * n + 2)


def allocate(first: np.ndarray, last: np.ndarray, start: np.ndarray, end: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Place of every token with bytes [first, last), and whether it crosses a boundary."""
    a, b = place(first, start, end), place(last - 1, start, end)
    crosses = a != b
    out = b.copy() if rule == "last" else a.copy()
    if rule == "most":
        edges = np.stack([start, end], 1).ravel()  # place p lies between edge p - 1 and edge p
        for i in np.flatnonzero(crosses):
            p = np.arange(a[i], b[i] + 1)
            lo = np.where(p > 0, edges[np.maximum(p - 1, 0)], 0)
            hi = np.where(p < len(edges), edges[np.minimum(p, len(edges) - 1)], last[i])
            share = np.minimum(hi, last[i]) - np.maximum(lo, first[i])
            out[i] = p[np.argmax(share)]
    return out, crosses


def count_tokens(docs: DataFrame, path: str, sections: Callable = lines, rule: str = "most") -> DataFrame:
    """(doc_id, section, start, end, n_tokens, n_crossing) of every section of docs(doc_id, text).

    `sections` gives the byte spans of a text's sections at character boundaries; start and end come out in code points.
    Tokens of gaps form section -1 of the document, if there are any. n_crossing counts the section's tokens that cross a
    boundary.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")

    def run(batches):
        c = codec(path)
        for b in batches:
            doc, cols = [], [[] for _ in range(5)]
            ids = c.encode_all(t.as_py() or "" for t in b["text"])
            for d, t, found in zip(b["doc_id"].to_pylist(), text_bytes(b["text"]), ids, strict=True):
                last = np.cumsum(c.size[np.frombuffer(found, "<u4")])
                first = np.concatenate([[0], last[:-1]]) if len(last) else last
                start, end = sections(t)
                at, crosses = allocate(first, last, start, end, rule)
                n = np.bincount(at, minlength=2 * len(start) + 1)
                m = np.bincount(at[crosses], minlength=2 * len(start) + 1)
                points = np.concatenate([[0], np.cumsum((t & 0xC0) != 0x80)])
                rows = [np.arange(len(start)), points[start], points[end], n[1::2], m[1::2]]
                if n[::2].any():
                    rows = [np.append(x, y) for x, y in zip(rows, (-1, 0, points[-1], n[::2].sum(), m[::2].sum()), strict=True)]
                doc += [d] * len(rows[0])
                for have, x in zip(cols, rows, strict=True):
                    have.append(x)
            arrays = [pa.array(np.concatenate(x) if x else np.empty(0), pa.int64()) for x in cols]
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), *arrays], ["doc_id", "section", "start", "end", "n_tokens", "n_crossing"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, section long, start long, end long, n_tokens long, n_crossing long")


def op8_token_counts(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    import public_tokenizers

    from sigweave.session import table

    return count_tokens(table(spark, sf_dir, "documents"), path or public_tokenizers.path("byte_bpe_50k.tiktoken"))
