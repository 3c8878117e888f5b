"""Personal data in whole texts: base rules and a character BiLSTM-CRF trained on labelled spans.

Base rules (email, ip, card, phone) are applied as the contract states them, in forms that take linear time on any text.
The tagger is trained here on distinct windows of a bounded sample (`sample` windows, by hash): some about base spans of
each kind, some around digits and `@` without a span, some of the other text. Labelled windows come again with their spans
rewritten as people disguise them (`(at)`, blanks around dots, a phone without its country code, dots in a card, addresses
without digits), so that the model learns forms the rules miss; dotted words without an address are shown as such.

Every character of every text is covered: windows of `DECODE` characters overlap by twice `CONTEXT`. They are decoded
together; each character takes its tag from the window in which it is more central, and runs of tags over the whole text
become spans. Added spans are those that touch no base span and have at least `SHORTEST` characters; they need not hold a
digit or `@`, which only the base rules ask for. Equal texts of a batch are decoded once.

Defined results: a null text is empty (no spans, checksum of the empty string); repeated rows each get their row;
without any base span in the whole table nothing is added; texts of any length are handled in batches of windows.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sigweave.llm.bilstm_crf import Tagger
from sigweave.session import cut

KINDS = ("email", "ip", "card", "phone")
MARK = re.compile(r"[0-9@]")
WINDOW, MARGIN, SHORTEST = 48, 16, 7
#: widths of a window to be tagged and of its context on either side, windows in a batch, characters tagged together
DECODE, CONTEXT, BATCH, TOGETHER = 768, 32, 1024, 3 << 20
#: the contract's patterns; the first part of an email is found by hand, from its `@` to the left
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if c in "0123456789")


def emails(text: str) -> list[tuple[int, int]]:
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at)):
            out.append((start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base rules, by kind and start."""
    if not len(marks_of(text)):
        return []
    out = [(0, s, e) for s, e in emails(text)]
    out += [(1, *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
    out += [(2, *m.span()) for m in CARD.finditer(text) if 13 <= len(d := digits_of(m.group())) <= 19 and luhn(d)]
    out += [(3, *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits_of(m.group())) <= 15]
    return out


def _code(c: int) -> int:
    special = {ord(x): i for i, x in enumerate("@.-+()_%=\"' \n:,/at", 5)}
    if c in special:
        return special[c]
    return 1 if 48 <= c <= 57 else 2 if 97 <= c <= 122 else 3 if 65 <= c <= 90 else 4


CODES = np.array([_code(c) for c in range(256)], np.int16)
N_CODES = int(CODES.max()) + 1
#: tags: 0 outside, 1 + 2 * kind first character, 2 + 2 * kind a later one
N_TAGS = 1 + 2 * len(KINDS)


def points_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def codes_of(text: str) -> np.ndarray:
    return CODES.take(points_of(text), mode="clip")  # those beyond the table have its last code


#: strata of the training windows: the kinds, then windows without a span
MARKED, PLAIN, STRATA = len(KINDS), len(KINDS) + 1, len(KINDS) + 2
#: characters by which a disguise lengthens a span, about
DISGUISED = 8
#: forms of one example in training, at most
COPIES = 24


def windows_of(marks: np.ndarray, size: int) -> list[tuple[int, int, int, int]]:
    """(start, end, first, last): windows over `size` characters and the part of each that its tags count for."""
    out = []
    if not len(marks):
        return out
    gaps = np.flatnonzero(np.diff(marks) > 2 * MARGIN)
    for a, b in zip(marks[np.r_[0, gaps + 1]], marks[np.r_[gaps, len(marks) - 1]], strict=True):
        lo, hi = max(0, int(a) - MARGIN), min(size, int(b) + MARGIN + 1)
        starts = list(range(lo, max(lo + 1, hi - WINDOW // 2), WINDOW // 2))
        for i, s in enumerate(starts):
            first = lo if i == 0 else s + WINDOW // 4
            last = hi if i == len(starts) - 1 else s + WINDOW - WINDOW // 4
            out.append((s, min(s + WINDOW, size), first, last))
    return out


def tags_of(spans: Iterable[tuple[int, int, int]], size: int) -> np.ndarray:
    tags = np.zeros(size, np.int64)
    for kind, s, e in sorted(spans, key=lambda x: x[1]):
        if s < e and not tags[s:e].any():
            tags[s:e] = 2 + 2 * kind
            tags[s] = 1 + 2 * kind
    return tags


def spans_of(tags: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int]]:
    """Runs of one kind in tags of the characters at ascending places; a first tag or a gap begins a new run."""
    if not len(tags):
        return []
    kind = np.where(tags > 0, (tags - 1) // 2, -1)
    new = np.r_[True, (kind[1:] != kind[:-1]) | (np.diff(at) != 1) | (tags[1:] % 2 == 1)]
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(tags)] - 1
    return [(int(kind[a]), int(at[a]), int(at[b]) + 1) for a, b in zip(first, last, strict=True) if kind[a] >= 0]


def marks_of(text: str) -> np.ndarray:
    """Places of digits and `@`."""
    points = points_of(text)
    return np.flatnonzero((points - np.uint32(48) < 10) | (points == 64))


def cover(size: int) -> list[tuple[int, int, int, int]]:
    """(start, end, first, last): overlapping windows over a whole text and the part of each that its tags count for."""
    step = DECODE - 2 * CONTEXT
    starts = range(0, max(1, size - 2 * CONTEXT), step)
    last = len(starts) - 1
    return [(s, min(s + DECODE, size), s + CONTEXT * (i > 0), size if i == last else s + DECODE - CONTEXT) for i, s in enumerate(starts)]


def _tagged(texts: list[str], model: Tagger) -> list[list[tuple[int, int, int]]]:
    coded = [codes_of(t) for t in texts]
    tags = [np.zeros(len(c), np.int8) for c in coded]
    todo = sorted(((e - s, i, s, e, a, b) for i, c in enumerate(coded) if len(c) for s, e, a, b in cover(len(c))), reverse=True)
    for at in range(0, len(todo), BATCH):
        part = todo[at : at + BATCH]
        grid = np.zeros((len(part), part[0][0]), np.int16)
        for r, (_, i, s, e, _, _) in enumerate(part):
            grid[r, : e - s] = coded[i][s:e]
        got = model.decode(grid)
        for r in np.flatnonzero(got.any(1)):
            _, i, s, _, a, b = part[r]
            tags[i][a:b] = got[r, a - s : b - s]
    return [spans_of(t[at].astype(np.int64), at) for t in tags for at in [np.flatnonzero(t)]]


def model_spans(texts: list[str], model: Tagger) -> list[list[tuple[int, int, int]]]:
    """Spans of the tagger in every text, overlapping windows reconciled; some `TOGETHER` characters at a time."""
    out: list[list[tuple[int, int, int]]] = []
    group, size = [], 0
    for t in texts:
        group.append(t)
        size += len(t)
        if size >= TOGETHER:
            out += _tagged(group, model)
            group, size = [], 0
    return out + _tagged(group, model)


def added_spans(text: str, base: list[tuple[int, int, int]], tagged: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    out = []
    for kind, s, e in tagged:
        piece = text[s:e]
        s, e = s + len(piece) - len(piece.lstrip()), e - len(piece) + len(piece.rstrip())
        if e - s >= SHORTEST and not any(s < b and a < e for _, a, b in base):
            out.append((kind, s, e))
    return out


def detect(texts: list[str], model: Tagger | None) -> list[tuple[list, list]]:
    """(base spans, added spans) of every text."""
    once = list(dict.fromkeys(texts))  # equal texts are gone through once
    base = [base_spans(t) for t in once]
    tagged = model_spans(once, model) if model is not None else [[]] * len(once)
    found = {t: (b, added_spans(t, b, m)) for t, b, m in zip(once, base, tagged, strict=True)}
    return [found[t] for t in texts]


def disguise(kind: int, s: str, rng: np.random.Generator) -> str:
    """A span as people write it to get past rules."""
    if kind == 0:
        if rng.integers(2):  # an address need not hold digits
            s = re.sub("[0-9]+", lambda m: "letter"[: rng.integers(1, 7)], s)
        if rng.integers(2):
            s = re.sub(r"@[^.]+\.(?=.*\.)", "@", s)
        return s.replace("@", (" @ ", "(at)", " (at) ")[rng.integers(3)])
    way = rng.integers(2)
    if kind == 1:
        return s.replace(".", " . ") if way else s.replace(".", "-")
    if kind == 2:
        d = digits_of(s)
        return (". " if way else ".").join(d[i : i + 4] for i in range(0, len(d), 4))
    return re.sub(r"^\+[0-9]+\s*", "" if way else "00 ", s)


def example(text: str, spans: list[tuple[int, int, int]], rng: np.random.Generator | None) -> tuple[np.ndarray, np.ndarray]:
    """Codes and tags of one training window; with `rng` its spans are disguised, and it begins somewhere before the first."""
    if rng is not None:
        out, new, at = "", [], int(rng.integers(min((s for _, s, _ in spans), default=0) + 1))
        for kind, s, e in sorted(spans, key=lambda x: x[1]):
            if s < at:
                continue
            piece = disguise(kind, text[s:e], rng)
            out += text[at:s]
            new.append((kind, len(out), len(out) + len(piece)))
            out, at = out + piece, e
        text, spans = out + text[at:], new
    codes, tags = np.zeros(WINDOW, np.int16), np.zeros(WINDOW, np.int64)
    c, g = codes_of(text)[:WINDOW], tags_of(spans, len(text))[:WINDOW]
    codes[: len(c)], tags[: len(g)] = c, g
    return codes, tags


def labelled_windows(text: str, marks: np.ndarray) -> Iterable[tuple[int, int, int, list[tuple[int, int, int]]]]:
    """(stratum, start, end, spans inside) of a text's windows about its marks.

    A window about each base span has its kind as stratum, windows around digits and `@` without any span have `MARKED`.
    """
    if not len(marks):
        return
    spans, size = base_spans(text), len(text)
    held = np.zeros(size + 1, np.int64)
    for _, a, z in spans:
        held[a + 1 : z + 1] = 1
    held = np.cumsum(held)
    by_start = sorted(spans, key=lambda x: x[1])
    starts = [x[1] for x in by_start]
    longest = max((z - a for _, a, z in spans), default=0)
    for kind, a, z in by_start:
        room = max(0, WINDOW - DISGUISED - (z - a))  # the place in the window differs from span to span
        s = max(0, a - zlib.crc32(text[a:z].encode("utf-8", "surrogatepass")) % (room + 1))
        e = min(size, s + WINDOW)
        near = by_start[bisect_left(starts, s - longest) : bisect_left(starts, e)]
        s = max([s, *(y for _, x, y in near if x < s < y <= a)])  # a piece of another span is no example
        e = min([e, *(x for _, x, y in near if z <= x < e < y)])
        yield kind, s, e, [(k, max(x, s) - s, min(y, e) - s) for k, x, y in near if x < e and s < y]
    for s, e, _, _ in windows_of(marks, size):
        if held[e] == held[s]:
            yield MARKED, s, e, []


def plain_windows(text: str, marks: np.ndarray) -> list[bytes]:
    """Windows over the rest of the text, those of `PLAIN`, as bytes."""
    plain = np.ones(-(-len(text) // WINDOW), bool)
    plain[marks // WINDOW] = False
    starts = (np.flatnonzero(plain) * WINDOW).tolist()
    if text.isascii():
        data = text.encode()
        return [data[s : s + WINDOW] for s in starts]
    return [text[s : s + WINDOW].encode("utf-8", "surrogatepass") for s in starts]


def training_windows(docs: DataFrame, sample: int) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """At most about `sample` distinct windows with the base spans that lie in them: those of each stratum by hash.

    The first of a stratum in the whole table are among the first of some task, so each task hands on no more than these.
    """
    quota = [-(-sample // 8)] * (STRATA - 1) + [-(-3 * sample // 8)]  # most of a corpus is plain

    def run(batches):
        have: list[dict] = [{} for _ in range(STRATA)]
        bar = [np.iinfo(np.int64).max] * STRATA

        def offer(stratum: int, w: str, spans: str) -> None:
            raw = f"{w}\0{spans}".encode("utf-8", "surrogatepass")
            h = (zlib.crc32(raw) << 31) + (zlib.crc32(raw, 0x9E3779B9) >> 1)
            if h > bar[stratum]:
                return
            have[stratum][h, w, spans] = None
            if len(have[stratum]) >= 2 * quota[stratum]:
                have[stratum] = dict.fromkeys(sorted(have[stratum])[: quota[stratum]])
                bar[stratum] = max(have[stratum])[0]

        for b in batches:
            for text in b["text"].to_pylist():
                marks = marks_of(text or "")
                for stratum, s, e, own in labelled_windows(text or "", marks):
                    offer(stratum, text[s:e], " ".join(f"{k}:{a}:{z}" for k, a, z in own))
                for w in plain_windows(text or "", marks):
                    if zlib.crc32(b"\0", zlib.crc32(w)) <= bar[PLAIN] >> 31:  # most are far beyond the bar
                        offer(PLAIN, w.decode("utf-8", "surrogatepass"), "")
        rows = [(i, *x) for i, found in enumerate(have) for x in sorted(found)[: quota[i]]]
        if rows:
            cols = [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.string(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays(cols, ["stratum", "h", "w", "spans"])

    schema = "stratum int, h long, w string, spans string"
    rows = cut(docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, schema)).distinct()
    order = ["h", "w", "spans"]
    parts = [rows.where(F.col("stratum") == i).orderBy(*order).limit(quota[i]) for i in range(STRATA)]
    got = sorted(tuple(r) for r in reduce(DataFrame.unionAll, parts).collect())
    return [(w, [tuple(map(int, x.split(":"))) for x in spans.split()]) for _, _, w, spans in got]


def near_miss(text: str, rng: np.random.Generator) -> str:
    """A window of addresses without what makes them such: dotted words and numbers in a row are no address."""
    if rng.integers(2):
        text = re.sub("[0-9]+", lambda m: "xyz"[: len(m.group())], text)
    stop = (".", ". ")[rng.integers(2)]
    text = text.replace("@", (" ", stop)[rng.integers(2)]).replace(".", stop)
    at = int(rng.integers(len(text)))
    word = f"{text[at : at + int(rng.integers(2, 7))].strip(' .')}{stop}"
    return text if rng.integers(2) else text[:at] + word * (WINDOW // len(word))


def examples(windows: list[tuple[str, list[tuple[int, int, int]]]], sample: int, rng: np.random.Generator) -> list[tuple[np.ndarray, np.ndarray]]:
    """Every window as it is, and those with spans in disguises: where they are few, in up to `COPIES` each."""
    held = [(w, s) for w, s in windows if s]
    copies = min(COPIES, max(1, sample // max(1, len(held))))
    out = [example(w, s, None) for w, s in windows] + [example(w, s, rng) for w, s in held for _ in range(copies)]
    bare = [w for w, s in windows if not s and MARK.search(w)]
    out += [example(w[rng.integers(len(w)) :], [], None) for w in bare for _ in range(min(COPIES, sample // len(bare)))]
    mails = [w for w, s in held if all(kind == 0 for kind, _, _ in s)]
    return out + [example(near_miss(w, rng), [], None) for w in mails for _ in range(copies)]


def fit_tagger(docs: DataFrame, sample: int = 2500, epochs: int = 6, seed: int = 17) -> Tagger | None:
    """The tagger, trained on a bounded sample of windows of docs(text); None where no text has a base span."""
    got = training_windows(docs, sample)
    if not any(spans for _, spans in got):
        return None
    rows = examples(got, sample, np.random.default_rng(seed))
    model = Tagger(N_CODES, N_TAGS)
    model.train(np.stack([c for c, _ in rows]), np.stack([t for _, t in rows]), epochs=epochs)
    return model


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


def mask(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every span, or run of overlapping spans, replaced by the kind of its first."""
    out, at, done = [], 0, 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= done:
            out += [text[at:s], f"<{KINDS[kind].upper()}>"]
        done = at = max(done, e)
    return "".join(out) + text[at:]


def find_pii(docs: DataFrame, model: Tagger | None) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added): counts are of base spans."""

    def run(batches):
        for b in batches:
            texts = [t.as_py() or "" for t in b["text"]]
            found = detect(texts, model)
            cols = [b["doc_id"]]
            cols += [pa.array([sum(k == kind for k, _, _ in base) for base, _ in found], pa.int64()) for kind in range(len(KINDS))]
            cols.append(pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found], pa.string()))
            cols.append(pa.array([joined(base + more) for base, more in found], pa.string()))
            cols.append(pa.array([len(more) for _, more in found], pa.int64()))
            names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"]
            yield pa.RecordBatch.from_arrays(cols, names)

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def mask_pii(docs: DataFrame, model: Tagger | None) -> DataFrame:
    """All rows and columns of docs(text, ...), the personal data in `text` masked."""
    at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            texts = [t.as_py() for t in b.column(at)]
            found = detect([t or "" for t in texts], model)
            out = [t if t is None else mask(t, base + more) for t, (base, more) in zip(texts, found, strict=True)]
            cols = list(b.columns)
            cols[at] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(cols, b.schema.names)

    return docs.withColumn("text", F.col("text").cast("string")).mapInArrow(run, docs.withColumn("text", F.col("text").cast("string")).schema)


def op3_bilstm_pii(spark, sf_dir: str) -> DataFrame:
    from sigweave.session import table

    docs = table(spark, sf_dir, "documents")
    return find_pii(docs, fit_tagger(docs))
