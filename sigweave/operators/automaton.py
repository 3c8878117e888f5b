"""Dictionary look-up in texts by an Aho-Corasick automaton in arrays, run over many places of many texts at once.

The trie is numbered level by level, children in the order of (parent, byte), so the sorted array of `parent * 256 + byte`
is the trie: a state's child is found by one sorted search. Failure links complete it. The first states (the shallow ones,
where texts are nearly all the time) also have a row of a dense table with the failures already followed.

A batch of texts is one byte string cut into stretches; all stretches take a step at the same time, each with its own
state, so a step is a few array operations whatever the dictionary holds. A stretch starts early enough to have seen all
bytes an item can have, therefore texts of any length are spread evenly and nothing is found twice or missed.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

DENSE = 1 << 22  # cells of the dense table
STRETCH = 1024  # bytes of a stretch at least
FOUND = 1 << 20  # hits that are held before equal ones are put together
ANCHOR = 2048  # bytes of an item that the automaton holds; the rest of a longer one is compared in place


class Automaton:
    """All distinct byte strings `items` (not empty); their numbers come out."""

    def __init__(self, items: Sequence[bytes]):
        self.items = list(items)
        heads = sorted({w[:ANCHOR] for w in self.items})
        n = len(heads)
        size = np.fromiter(map(len, heads), np.int64, n)
        flat, start = np.frombuffer(b"".join(heads), np.uint8), np.cumsum(size) - size
        keys, bounds = [np.empty(0, np.int64)], [0, 1]
        at = np.zeros(n, np.int64)  # state of each head so far; heads are sorted, so states ascend with them
        ends = np.zeros(n, np.int64)
        for d in range(int(size.max()) if n else 0):
            rows = np.flatnonzero(size > d)
            k, inverse = np.unique(at[rows] << 8 | flat[start[rows] + d], return_inverse=True)
            at[rows] = bounds[-1] + inverse
            keys.append(k)
            bounds.append(bounds[-1] + len(k))
            done = rows[size[rows] == d + 1]
            ends[done] = at[done]
        self.keys = np.concatenate(keys)
        states = len(self.keys) + 1
        self.reach = int(size.max()) if n else 0
        self.fail = np.zeros(states, np.int32)
        self.head = np.full(states, -1, np.int32)
        self.head[ends] = np.arange(n)
        self.classes = np.zeros(256, np.int64)
        used = np.unique(flat)
        self.classes[used] = np.arange(1, len(used) + 1)
        width = len(used) + 1
        self.shallow = max(1, min(states, DENSE // width))
        self.dense = np.zeros((self.shallow, width), np.int32)
        self.link = np.zeros(states, np.int32)  # nearest shorter head that ends here as well
        for d in range(1, len(bounds) - 1):
            level = np.arange(bounds[d], bounds[d + 1])
            parent, byte = self.keys[level - 1] >> 8, self.keys[level - 1] & 255
            if d > 1:
                self.fail[level] = self._after(self.fail[parent].astype(np.int64), byte)
            f = self.fail[level]
            self.link[level] = np.where(self.head[f] >= 0, f, self.link[f])
        self._fill(bounds, used)
        self.hit = (self.head >= 0) | (self.link > 0)
        # numbers of the items that begin with each head
        where = {w: i for i, w in enumerate(heads)}
        self.of_head: list[list[int]] = [[] for _ in heads]
        for i, w in enumerate(self.items):
            self.of_head[where[w[:ANCHOR]]].append(i)

    def _child(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """Child of each state by a byte, or -1."""
        if not len(self.keys):
            return np.full(len(state), -1)
        key = state << 8 | byte
        i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[i] == key, i + 1, -1)

    def _after(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """State after a byte: failures are followed until a child is there."""
        out = self._child(state, byte)
        todo = np.flatnonzero((out < 0) & (state > 0))
        while len(todo):
            state = state.copy()
            state[todo] = self.fail[state[todo]]
            out[todo] = self._child(state[todo], byte[todo])
            todo = todo[(out[todo] < 0) & (state[todo] > 0)]
        return np.maximum(out, 0)

    def _fill(self, bounds: list[int], used: np.ndarray) -> None:
        """Rows of the dense table, level by level: the failure's row, then the own children."""
        for d in range(len(bounds) - 1):
            level = np.arange(bounds[d], min(bounds[d + 1], self.shallow))
            if not len(level):
                break
            if d:
                self.dense[level] = self.dense[self.fail[level]]
            lo, hi = np.searchsorted(self.keys, [level[0] << 8, (level[-1] + 1) << 8])
            k = self.keys[lo:hi]
            self.dense[k >> 8, self.classes[k & 255]] = np.arange(lo + 1, hi + 1)

    def find(self, flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (text, item) numbers; text i is flat[offsets[i]:offsets[i + 1]]."""
        size = np.diff(offsets)
        stretch = max(STRETCH, 2 * self.reach)
        parts = -(-size // stretch)
        text = np.repeat(np.arange(len(size)), parts)
        if not len(text) or not self.reach:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        begin = offsets[text] + (np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)) * stretch
        end = np.minimum(begin + stretch, offsets[text + 1])
        at = np.maximum(begin - self.reach + 1, offsets[text])
        order = np.argsort(at - end, kind="stable")  # the longest first: those at their end leave from the back
        text, end, at = text[order], end[order], at[order]
        steps = end - at
        state = np.zeros(len(text), np.int64)
        found, kept = [], 0
        for t in range(int(steps[0])):
            n = int(np.searchsorted(-steps, -t))
            if n < len(state):
                state, text, at = state[:n], text[:n], at[:n]
            byte = flat[at + t]
            deep = np.flatnonzero(state >= self.shallow) if self.shallow <= len(self.keys) else ()
            if len(deep):
                nxt = self.dense[np.minimum(state, self.shallow - 1), self.classes[byte]].astype(np.int64)
                nxt[deep] = self._deep(state[deep], byte[deep].astype(np.int64))
                state = nxt
            else:
                state = self.dense[state, self.classes[byte]].astype(np.int64)
            hits = np.flatnonzero(self.hit[state])
            if len(hits):
                found.append(np.unique(text[hits] * (len(self.keys) + 1) + state[hits]))
                kept += len(found[-1])
                if kept > FOUND and len(found) > 1:
                    found = [np.unique(np.concatenate(found))]
                    kept = len(found[0]) // 2
        return self._items(np.unique(np.concatenate(found)), flat, offsets) if found else (np.empty(0, np.int64),) * 2

    def _deep(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        out = self._child(state, byte)
        todo = np.flatnonzero(out < 0)
        while len(todo):
            state[todo] = self.fail[state[todo]]
            flat = state[todo] < self.shallow
            low = todo[flat]
            out[low] = self.dense[state[low], self.classes[byte[low]]]
            todo = todo[~flat]
            out[todo] = self._child(state[todo], byte[todo])
            todo = todo[out[todo] < 0]
        return out

    def _items(self, pairs: np.ndarray, flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Items of distinct (text, state) pairs: the state's own head and those along its links."""
        states = len(self.keys) + 1
        text, state = np.divmod(pairs, states)
        rows = []
        while len(text):
            own = self.head[state] >= 0
            rows.append(text[own] * states + state[own])
            text, state = text[self.link[state] > 0], self.link[state][self.link[state] > 0].astype(np.int64)
            both = np.unique(text * states + state)
            text, state = np.divmod(both, states)
        out_t, out_i = [], []
        for p in np.unique(np.concatenate(rows)).tolist():
            t, s = divmod(p, states)
            for i in self.of_head[self.head[s]]:
                w = self.items[i]
                if len(w) <= ANCHOR or w in flat[offsets[t] : offsets[t + 1]].tobytes():
                    out_t.append(t)
                    out_i.append(i)
        return np.array(out_t, np.int64), np.array(out_i, np.int64)
