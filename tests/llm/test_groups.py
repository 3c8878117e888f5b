"""Spelling variants, exact duplicates and the prefix trie against brute force, with odd rows and hot groups."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from sigweave.llm import exact_dedup, prefix_trie, spelling

# ---- spelling variants -----------------------------------------------------------------------------


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def plain_variants(count):
    out = {}
    near = {w: [x for x in count if one_edit(w, x)] for w in count}
    form = {}
    for w, n in count.items():
        best = min(near[w], key=lambda x: (-count[x], x), default=None)
        form[w] = best if best is not None and count[best] >= 2 * n else None
    for w, n in count.items():
        root = w
        while form[root]:
            root = form[root]
        out[w] = (n, len(near[w]), form[w], count.get(form[w]), root)
    return out


def some_words(seed, n, letters):
    r, out = random.Random(seed), {}
    while len(out) < n:
        base = r.choice(list(out)) if out and r.random() < 0.7 else "".join(r.choice(letters) for _ in range(r.randint(5, 9)))
        k = r.randrange(len(base) + 1)
        w = r.choice([base, base[:k] + r.choice(letters) + base[k:], base[:k] + base[k + 1 :], base[:k] + r.choice(letters) + base[k + 1 :]])
        if len(w) >= 5:
            out[w] = r.choice([3, 4, 5, 8, 16, 17, 40, 100])
    return out


@pytest.mark.parametrize("seed,letters,pairs", [(1, "abé", 10_000), (2, "ab", 3), (3, "aÿ", 1), (4, "abcdefgh", 20)])
def test_variants_equal_brute_force(spark, seed, letters, pairs):
    count = some_words(seed, 300, letters)
    got = spelling.variants(spark.createDataFrame(list(count.items()), "word string, n long"), pairs=pairs).collect()
    assert {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in got} == plain_variants(count) and len(got) == len(count)


def test_a_frequent_chunk_is_split_not_compared(spark):
    """Half of all words share their first half: no key is left with more than the bound, and no link is lost."""
    r = random.Random(5)
    words = {"aaaaaaaa" + "".join(r.choice("bcdefghijk") for _ in range(8)): 3 for _ in range(400)}
    words |= {w[:-1] + "z": 7 for w in list(words)[:50]} | {w[:9] + "x" + w[9:]: 9 for w in list(words)[50:90]}
    got = spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long"), pairs=200).collect()
    assert {x.word: (x.n, x.n_near, x.form, x.form_n, x.root) for x in got} == plain_variants(words)


def test_long_chains_and_empty_tables(spark):
    chain = {"aaaaa" + "b" * i: 3 * 2**i for i in range(20)}
    got = spelling.variants(spark.createDataFrame(list(chain.items()), "word string, n long")).collect()
    assert {r.root for r in got} == {"aaaaa" + "b" * 19}
    assert spelling.variants(spark.createDataFrame([], "word string, n long")).count() == 0


def test_words_of_documents(spark):
    long = "Straße × ÷ " + "Zeppelin " * 300_000
    rows = [(1, "ABCdé xyz\x00ÀB 12ab_c", 1), (1, "ABCdé xyz\x00ÀB 12ab_c", 1), (2, None, 1), (None, "hello", 1), (3, "", 1), (4, long, 1)]
    want = Counter()
    for d, t, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 5 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            want[run] += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string, word int")
    assert {r.word: r.n for r in spelling.count_words(docs, 5).collect()} == want
    assert [sum(map(len, x)) for x in [list(spelling.runs("abc " * 50, 7))]] == [50]
    assert spelling.count_words(docs.limit(0)).count() == 0


# ---- exact duplicates --------------------------------------------------------------------------------


def plain_copies(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups[t or ""].append(d)
    out = Counter()
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        left = True
        for i in ids:
            out[(i, keep, len(ids), left and i == keep, hashlib.sha256(t.encode()).hexdigest())] += 1
            left = left and i != keep
    return out


def copies(seed, n):
    r = random.Random(seed)
    return [(r.choice([None, r.randrange(n), r.randrange(n)]), r.choice([None, "", "hot", "hot", "Hot", "hot ", f"é{r.randrange(n // 3)}" * r.randrange(1, 300)])) for _ in range(n)]


@pytest.mark.parametrize("seed,key_of,room", [(1, exact_dedup.digest_key, 64), (2, exact_dedup.digest_key, 1), (3, lambda d: d[0] % 3, 2), (4, lambda d: 7, 1)])
def test_copies_equal_brute_force(spark, tmp_path, seed, key_of, room):
    """Also with keys that collide: chained texts are told apart by their bytes."""
    rows = copies(seed, 400)
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, key int, kept string").repartition(5)
    index = exact_dedup.build(docs, str(tmp_path / "i"), key_of=key_of, room=room)
    cols = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert Counter(tuple(r) for r in index.verdicts().select(*cols).collect()) == plain_copies(rows)
    pages = index.pages().collect()
    assert len(pages) == len({t or "" for _, t in rows})
    if key_of(b"1") != key_of(b"2"):
        assert max(Counter((r.bucket, r.depth, r.key % 2**64 >> 61) for r in pages).values()) <= room or seed == 3


def test_an_index_goes_on(spark, tmp_path):
    rows = copies(9, 300)
    frame = lambda x: spark.createDataFrame(x, "doc_id long, text string")
    old = exact_dedup.build(frame(rows[:200]), str(tmp_path / "a"))
    new = exact_dedup.build(frame(rows[200:]), str(tmp_path / "b"), base=old)
    whole = exact_dedup.build(frame(rows), str(tmp_path / "c"))
    of = lambda i: {(bytes(r.text), r.keep_id, r.group_size) for r in i.pages().collect()}
    assert of(new) == of(whole)
    want = {r.text_sha256: (r.keep_id, r.group_size) for r in whole.verdicts().collect()}
    got = new.verdicts().collect()
    assert len(got) == 100 and all((r.keep_id, r.group_size) == want[r.text_sha256] for r in got)


def test_empty_table_of_copies(spark, tmp_path):
    index = exact_dedup.build(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "e"))
    assert index.verdicts().count() == 0 and index.pages().count() == 0


def test_directory_doubles_and_keeps_its_order():
    r, tree = random.Random(1), exact_dedup.Directory(3, room=2)
    keys = [(5 << 61 | r.getrandbits(61)) - 2**64 for _ in range(500)]
    for k in keys:
        tree.place(k, str(k).encode())
    assert [tree.place(k, str(k).encode()) for k in keys] == list(range(500))
    assert len(tree.slots) == 1 << tree.depth and sorted(p[4] for p in tree.pages()) == list(range(500))
    assert all(len(b["chains"]) <= 2 for b in tree.slots)


# ---- prefix trie --------------------------------------------------------------------------------------


def plain_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    made = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        made[c] = tuple(own.get(c - c % 20, [])[:h] + v[h:])
    members = defaultdict(list)
    for c, s in made.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    kids = Counter(s[:-1] for s in members if s)
    leaves, saved = Counter(), Counter()
    for s, m in members.items():
        n = (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", s[-1][1])) if s else 0
        for d in range(len(s) + 1):
            leaves[s[:d]] += s not in kids
            saved[s[:d]] += n
    out = set()
    for s, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(made[c]) == len(s))
        parent = min(members[s[:-1]]) if s else None
        out.add((min(m), len(s), parent, len(m), kids[s], leaves[s], saved[s], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def talks(seed, n):
    r, rows = random.Random(seed), []
    for c in range(n):
        if c % 20 == 0 and r.random() < 0.3:
            continue
        hot = r.random() < 0.4
        for t in range(r.choice([1, 1, 2, 3, 5, 9])):
            rows.append((c, r.choice([t, t, None]), r.choice(["user", "", None]) if t % 2 else "user", "same old  words" if hot or t == 0 else r.choice(["a b", "", None, "a\x0bb c"])))
    return rows


COLS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


@pytest.mark.parametrize("seed,n,share", [(1, 60, 1000), (2, 300, 1000), (3, 300, 3)])
def test_trie_equals_brute_force(spark, seed, n, share):
    rows = talks(seed, n)
    talk = spark.createDataFrame([(*x, 1, "y") for x in rows], "conv_id long, turn long, role string, text string, name int, pos string").repartition(7)
    got = prefix_trie.trie(talk, share=share).select(*COLS).collect()
    assert {tuple(r) for r in got} == plain_trie(rows) and len(got) == len(set(got))


def test_trie_of_odd_rows(spark):
    frame = lambda x: spark.createDataFrame(x, "conv_id long, turn long, role string, text string")
    assert prefix_trie.trie(frame([])).count() == 0
    long = [(7, t, "user", f"w{t % 3}") for t in range(300)]  # one conversation over many partitions
    rows = long + [(7, 1, "user", "w1"), (None, 1, "user", "x"), (8, None, None, None), (9, 0, "user", "x " * 200_000)] + [(27, t, "user", f"w{t % 3}") for t in range(3, 40)]
    assert {tuple(r) for r in prefix_trie.trie(frame(rows).repartition(9)).select(*COLS).collect() if r.depth < 60} == {x for x in plain_trie(rows) if x[1] < 60}


def test_end_lists_are_streams(spark):
    rows = [("a", i) for i in range(12_000)] + [("b", 5), ("b", 40), ("c", -3)]
    got = {r.name: r.ends_sha256 for r in prefix_trie.end_lists(spark.createDataFrame(rows, "name string, conv_id long").repartition(6)).collect()}
    assert got == {n: hashlib.sha256(",".join(str(i) for m, i in rows if m == n).encode()).hexdigest() for n in "abc"}
