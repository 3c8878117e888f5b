"""Byte-level BPE and packing against the public libraries and by adding up."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from sigweave.llm import byte_bpe, packing, token_counts
from sigweave.llm.pretokens import pre_tokens

RANKS, JSON = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def reference():
    import base64

    import tiktoken

    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts(n, seed=3):
    r = random.Random(seed)
    alphabet = "ab 's'll\n\t\x1c\x85\xa0 é漢字١½\U0001f600!?.,0123 \r\x0b"
    return ["".join(r.choice(alphabet) for _ in range(r.randint(0, 60))) for _ in range(n)] + ["a" * 5000, " " * 3000 + "x", "<|endoftext|>"]


def test_ids_equal_the_public_library(reference):
    c = byte_bpe.codec(RANKS)
    for t in odd_texts(3000):
        ids = c.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == reference.encode_ordinary(t), t
        assert c.decode(ids) == t.encode()


def test_perfect_hash_is_minimal_and_exact():
    c = byte_bpe.codec(RANKS)
    assert sorted(c.table.slot.tolist()) == list(range(len(c.word)))
    assert c.table.find([b"the", b"", b"no such pre-token"])[1:] == [-1, -1]


def test_memo_stays_bounded(monkeypatch, reference):
    monkeypatch.setattr(byte_bpe, "MEMO", 10)
    c = byte_bpe.Codec(RANKS)
    for t in odd_texts(200, 8):
        assert np.frombuffer(c.encode(t), "<u4").tolist() == reference.encode_ordinary(t)


def test_split_in_chunks_is_the_same():
    for t in odd_texts(500):
        whole = sum(pre_tokens(t), [])
        assert sum(pre_tokens(t, 40), []) == whole and "".join(whole) == t


def test_documents_round_trip(spark, sf, reference):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = byte_bpe.op9_byte_bpe(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = np.array(reference.encode_ordinary(texts[r.doc_id]), "<u4").tobytes()
        assert (r.n_tokens, r.ids_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_ids_and_texts_as_columns(spark):
    docs = spark.createDataFrame([(1, None, 2), (2, "", 2), (2, "Hé llo", 2), (None, "a", 2)], "doc_id long, text string, ids int")
    rows = byte_bpe.encode_rows(docs, RANKS)
    back = {(r.doc_id, r.text) for r in byte_bpe.decode_rows(rows, RANKS).collect()}
    assert back == {(1, ""), (2, ""), (2, "Hé llo"), (None, "a")}
    assert byte_bpe.encode_rows(docs.limit(0), RANKS).count() == 0


@pytest.mark.parametrize("n", [1, 2, 7, 300, 3000])
def test_fill_plan_uses_every_length_once(n):
    r = random.Random(n)
    counts: dict[int, int] = {}
    for _ in range(n):
        k = min(2047, int(r.lognormvariate(6, 1.2)) + 1)
        counts[k] = counts.get(k, 0) + r.choice([1, 1, 5])
    used = dict.fromkeys(counts, 0)
    for length, first, last, per, _, _ in packing.fill_plan(counts, 2048):
        assert first == used[length] and (last - first) % per == 0
        used[length] = last
    assert used == counts


def test_best_filling_is_the_best():
    r = random.Random(9)
    for _ in range(300):
        counts = {r.randint(1, 30): r.randint(1, 3) for _ in range(r.randint(0, 5))}
        room = r.randint(0, 60)
        sums = {0}
        for k, n in counts.items():
            sums = {s + k * i for s in sums for i in range(n + 1)}
        got = packing.best_filling(counts, room)
        assert sum(k * n for k, n in got.items()) == max(s for s in sums if s <= room)
        assert all(n <= counts[k] for k, n in got.items())


def check_packing(rows, ids, capacity):
    docs, sequences = {}, {}
    for r in rows:
        docs.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    assert set(docs) == set(ids)
    for d, parts in docs.items():
        at = 0
        for r in sorted(parts, key=lambda x: x.start):
            assert r.start == at and r.doc_tokens == len(ids[d])
            at += r.length
            assert zlib.crc32(np.array(ids[d][r.start : at], "<u4").tobytes()) == r.ids_crc32
        assert at == len(ids[d])
    for parts in sequences.values():
        at = 0
        for r in sorted(parts, key=lambda x: x.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(sequences)


def test_packing_of_documents(spark, sf):
    import tokenizers

    t = tokenizers.Tokenizer.from_file(JSON)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    ids = {d: t.encode(x or "", add_special_tokens=False).ids + [1] for d, x in texts.items()}
    n = check_packing(packing.op7_pack(spark, sf).collect(), ids, 2048)
    assert n <= 1.03 * sum(map(len, ids.values())) / 2048 + 2


def test_packing_of_odd_rows(spark, monkeypatch):
    import tokenizers

    monkeypatch.setattr(packing, "SLICE", 3)
    t = tokenizers.Tokenizer.from_file(JSON)
    texts = {1: None, 2: "", 3: "a <|endoftext|> b", 4: "word " * 5000, **{i: "same text" for i in range(10, 40)}, None: "x"}
    docs = spark.createDataFrame([(d, x, 7) for d, x in texts.items()], "doc_id long, text string, sequence_id int")
    ids = {d: t.encode(x or "", add_special_tokens=False).ids + [1] for d, x in texts.items()}
    check_packing(packing.pack(docs, JSON, 64).collect(), ids, 64)
    whole = packing.sequences(docs, JSON, 64).collect()
    assert sum(len(r.ids) for r in whole) == sum(map(len, ids.values()))
    assert packing.pack(docs.limit(0), JSON).count() == 0


def plain_places(spans, sections, rule):
    """Index of the section of each token span, -1 for a gap, byte by byte."""
    out = []
    for a, b in spans:
        owner = [next((i for i, (s, e) in enumerate(sections) if s <= x < e), None) for x in range(a, b)]
        runs = []
        for x, o in zip(range(a, b), owner, strict=True):
            gap = ("gap", sum(s <= x for s, _ in sections)) if o is None else o
            if not runs or runs[-1][0] != gap:
                runs.append([gap, 0])
            runs[-1][1] += 1
        best = {"first": runs[0], "last": runs[-1], "most": max(runs, key=lambda r: r[1])}[rule]
        out.append((-1 if isinstance(best[0], tuple) else best[0], len(runs) > 1))
    return out


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_allocation_equals_byte_by_byte(rule):
    r = random.Random(6)
    for _ in range(400):
        size = r.randint(1, 30)
        cuts = sorted({0, size, *(r.randint(0, size) for _ in range(8))})
        spans = list(zip(cuts, cuts[1:], strict=False))
        ends = sorted(r.sample(range(size + 1), 2 * min((size + 1) // 2, r.randint(0, 3))))
        sections = list(zip(ends[::2], ends[1::2], strict=True))
        start, end = np.array([s for s, _ in sections], int), np.array([e for _, e in sections], int)
        if not sections:
            continue
        at, crosses = token_counts.allocate(np.array([a for a, _ in spans]), np.array([b for _, b in spans]), start, end, rule)
        got = [((p - 1) // 2 if p % 2 else -1, bool(c)) for p, c in zip(at.tolist(), crosses, strict=True)]
        assert got == plain_places(spans, sections, rule), (spans, sections)


def test_counts_of_documents(spark, sf, reference):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {}
    for r in token_counts.op8_token_counts(spark, sf).collect():
        got.setdefault(r.doc_id, {})[r.section] = (r.start, r.end, r.n_tokens)
    assert set(got) == set(texts)
    for d, t in texts.items():
        at, want, spans, point = 0, [], [], 0
        for p in [x + "\n" for x in t.split("\n")[:-1]] + ([t.split("\n")[-1]] if t.split("\n")[-1] else []):
            want.append((at, at + len(p)))
            at += len(p)
        sections = [(len(t[:a].encode()), len(t[:b].encode())) for a, b in want]
        for i in reference.encode_ordinary(t):
            n = len(reference.decode_single_token_bytes(i))
            spans.append((point, point + n))
            point += n
        n = [0] * len(want)
        for a, b in spans[:400]:
            n[plain_places([(a, b)], sections, "most")[0][0]] += 1
        if len(spans) <= 400:
            assert [got[d][i] for i in range(len(want))] == [(*w, k) for w, k in zip(want, n, strict=True)]
        assert sum(x[2] for x in got[d].values()) == len(spans)


def test_counts_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (None, "a\n\n\nbé\U0001f600\n", 1), (2, "", 1)], "doc_id long, text string, section int")
    got = sorted((tuple(r)[:5] for r in token_counts.count_tokens(docs, RANKS).collect()), key=str)
    assert [x for x in got if x[0] is not None] == [(1, 0, 0, 0, 0), (2, 0, 0, 0, 0), (2, 0, 0, 0, 0)]
    rest = [x for x in got if x[0] is None]
    assert [x[1:4] for x in rest] == [(0, 0, 2), (1, 2, 3), (2, 3, 4), (3, 4, 8)]
    assert token_counts.count_tokens(docs.limit(0), RANKS).count() == 0
    head = lambda t: (np.array([0]), np.array([min(1, len(t))]))
    assert {(r.section, r.n_tokens > 0) for r in token_counts.count_tokens(docs.where("doc_id is null"), RANKS, head).collect()} == {(0, True), (-1, True)}
