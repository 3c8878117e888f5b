"""Pre-tokens of a byte-level tokenizer: the matches of its public split pattern, in pieces of bounded size.

The pattern is the tokenizer's own (letters, numbers and other marks with one leading blank, contractions, white space).
Texts of ASCII and Latin-1 characters take an equal pattern with plain character ranges, which is much faster.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import regex

CHUNK = 1 << 20
#: characters of the texts whose new pre-tokens are learned at once
GROUP = 1 << 20
#: fixed values: the white space of the tokenizer's own engine, the letters and numbers of Latin-1
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LETTERS, NUMBERS = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", r"0-9\xb2\xb3\xb9\xbc-\xbe"


def _pattern(letters: str, numbers: str) -> str:
    return (
        rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?[^{SPACE}{letters}{numbers}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
    )


LATIN = re.compile(_pattern(LETTERS, NUMBERS))
ANY = regex.compile(_pattern(r"\p{L}", r"\p{N}"))
OUTSIDE = re.compile(r"[^\x00-\xff]")


def pre_tokens(text: str, chunk: int = CHUNK) -> Iterator[list[str]]:
    """Lists of the pre-tokens of one text, in order; a list covers about `chunk` characters at most."""
    pattern = ANY if OUTSIDE.search(text) else LATIN
    if len(text) <= chunk:
        yield pattern.findall(text)
        return
    at, size = 0, chunk
    while at < len(text):
        found = pattern.findall(text, at, at + size)
        if at + size < len(text):  # the last matches may change with what follows
            found = found[:-3]
            if not found:
                size *= 2
                continue
        at, size = at + sum(map(len, found)), chunk
        yield found


def in_groups(texts: Iterable[str], size: int = GROUP) -> Iterator[list[str]]:
    """The texts in their order, in lists of about `size` characters."""
    held, n = [], 0
    for t in texts:
        if held and n + len(t) > size:
            yield held
            held, n = [], 0
        held.append(t)
        n += len(t)
    if held:
        yield held


def encode_in_groups(texts: Iterable[str], memo: dict[str, bytes], limit: int, learn: Callable, whole: Callable[[str], bytes | None]) -> Iterator[bytes]:
    """Encoded texts in their order; what `learn` adds to the memo is asked for once per group of texts.

    `whole` encodes a text in another way, or gives None. A text longer than a group is gone through in chunks.
    """
    for group in in_groups(texts):
        if len(memo) > limit:
            memo.clear()
        ready = [whole(t) for t in group]
        if len(group) == 1 and ready[0] is None and len(group[0]) > CHUNK:
            out = []
            for words in pre_tokens(group[0]):
                if len(memo) > limit:
                    memo.clear()
                if new := set(words).difference(memo):
                    learn(new)
                out.append(b"".join(map(memo.__getitem__, words)))
            yield b"".join(out)
            continue
        lists = [[] if r is not None else [w for part in pre_tokens(t) for w in part] for t, r in zip(group, ready, strict=True)]
        if new := set().union(*lists).difference(memo):
            learn(new)
        for words, r in zip(lists, ready, strict=True):
            yield b"".join(map(memo.__getitem__, words)) if r is None else r
