"""Character-level bidirectional LSTM with CRF transitions, in numpy: training by Adam, decoding by Viterbi.

Inputs are fixed-length windows of character codes. An input is one code, so the product with the input weights is a row
lookup; all windows of a batch advance together. Gates and cells use the softsign curve x / (1 + |x|) where the usual LSTM
has logistic and hyperbolic curves: exponentials would take most of the time of a step. Training and decoding share it.
"""

from __future__ import annotations

import numpy as np


def softsign(x: np.ndarray) -> np.ndarray:
    return x / (1 + np.abs(x))


def slope(y: np.ndarray) -> np.ndarray:
    """Slope of the softsign curve where its value is y."""
    return (1 - np.abs(y)) ** 2


def logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis, keepdims=True))).squeeze(axis)


#: steps after a doubtful one whose best paths are looked at for many such steps together, and how many
AHEAD, SPOTS = 3, 4096


class Tagger:
    def __init__(self, codes: int, tags: int, hidden: int = 8, seed: int = 11):
        rng = np.random.default_rng(seed)
        f = lambda *s: (rng.normal(size=s) * 0.2).astype(np.float32)
        self.hidden, self.tags = hidden, tags
        self.p = {"out": f(2 * hidden, tags), "bias": np.zeros(tags, np.float32), "step": np.zeros((tags, tags), np.float32)}
        for d in "fb":
            self.p |= {f"x{d}": f(codes, 4 * hidden), f"h{d}": f(hidden, 4 * hidden)}
            self.p[f"x{d}"][:, hidden : 2 * hidden] += 1  # remember at first

    def _lstm(self, codes: np.ndarray, d: str, keep: bool):
        n, t, h = codes.shape[0], codes.shape[1], self.hidden
        out, states = np.empty((t, n, h), np.float32), []
        hid, cell = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
        wx, wh = self.p[f"x{d}"], self.p[f"h{d}"]
        for s in range(t) if d == "f" else range(t - 1, -1, -1):
            z = wx[codes[:, s]] + hid @ wh
            gates = 0.5 + 0.5 * softsign(z[:, : 3 * h])
            new, before = softsign(z[:, 3 * h :]), (hid, cell)
            cell = gates[:, h : 2 * h] * cell + gates[:, :h] * new
            squashed = softsign(cell)
            hid = gates[:, 2 * h :] * squashed
            out[s] = hid
            if keep:
                states.append((s, gates, new, squashed, before))
        return out, states

    def emissions(self, codes: np.ndarray) -> np.ndarray:
        """(step, tag, window) scores. Both directions advance together, from either end; only one step's states are kept."""
        (n, t), h = codes.shape, self.hidden
        by_gate = lambda w: w.reshape(-1, 4, h).transpose(1, 0, 2)
        half = np.float32(0.5)
        wx = np.concatenate([by_gate(self.p[f"x{d}"]) for d in "fb"], 1)  # (gate, code of one direction or the other, unit)
        wh = np.stack([by_gate(self.p[f"h{d}"] * half) for d in "fb"], 1)  # (gate, direction, unit, unit)
        out = np.ascontiguousarray(self.p["out"].reshape(2, h, self.tags).transpose(0, 2, 1) * half)
        steps, at = np.ascontiguousarray(codes.T), np.empty((2, n), np.intp)
        hid, cell = np.zeros((2, n, h), np.float32), np.zeros((2, n, h), np.float32)  # hid is kept at twice its value
        z, y, size = np.empty((4, 2, n, h), np.float32), np.empty((4, 2, n, h), np.float32), np.empty((2, n, h), np.float32)
        share, e = np.empty((2, self.tags, n), np.float32), np.empty((t, self.tags, n), np.float32)
        e[:] = self.p["bias"][:, None]
        for s in range(t):
            at[0] = steps[s]
            np.add(steps[t - 1 - s], len(self.p["xf"]), out=at[1])
            wx.take(at, 1, z, "clip")
            np.matmul(hid, wh, out=y)
            z += y
            np.abs(z, out=y)
            y += 1
            z /= y
            z[:3] += 1  # twice the gates
            cell *= z[1]
            z[0] *= z[3]
            cell += z[0]
            cell *= half
            np.abs(cell, out=size)
            size += 1
            np.divide(cell, size, out=hid)
            hid *= z[2]
            np.matmul(out, hid.transpose(0, 2, 1), out=share)
            e[s] += share[0]
            e[t - 1 - s] += share[1]
        return e

    def _doubtful(self, e: np.ndarray) -> np.ndarray:
        """(step, window): where tag 0 is not surely on the best path although it was at the step before.

        With tag 0 at one step, it is at the next one as well if it beats every other tag by more than that tag can gain
        over it on any way from there on. Where it does not, the best paths of the next `AHEAD` steps are looked at: in most
        places tag 0 is sure at one of them, and all tags before it were 0.
        """
        step, (t, k, n) = self.p["step"], e.shape
        gain = np.maximum(0, (step - step[0]).max(1))[1:, None]
        out = np.empty((t, n), bool)
        ahead = (step[0, 1:, None] + gain) - step[0, 0]
        others = np.empty((k - 1, n), np.float32)
        for s, x in enumerate(e):
            np.add(x[1:], ahead if s else gain, out=others)
            np.greater(others.max(0), x[0], out=out[s])
        spots = np.flatnonzero(out[: max(0, t - AHEAD)])
        for first in range(0, len(spots), SPOTS):
            at, windows = np.divmod(spots[first : first + SPOTS], n)
            best = np.where(at == 0, np.float32(0), step[0][:, None]) + self._scores(e, at, windows)
            for more in range(1, AHEAD + 1):
                from_0, high = best[0] + step[0, 0], best[0] + step[0][:, None]
                for tag in range(1, k):
                    np.maximum(high, best[tag] + step[tag][:, None], out=high)
                best, clear = high + self._scores(e, at + more, windows), from_0 == high[0]
                sure = clear & (best[1:] + gain <= best[0]).all(0)
                out[at[sure], windows[sure]] = False
                left = np.flatnonzero(clear & ~sure)
                at, windows, best = at[left], windows[left], best[:, left]
        return out

    @staticmethod
    def _scores(e: np.ndarray, at: np.ndarray, windows: np.ndarray) -> np.ndarray:
        """(tag, place) scores of single steps of windows."""
        _, k, n = e.shape
        return e.ravel().take(at * (k * n) + windows + np.arange(k)[:, None] * n)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """Best tags of each window: the best path is searched from each doubtful step until tag 0 is sure again.

        Windows are searched side by side and stand last in all arrays. The way back is taken only where some step may have come
        from another tag than 0.
        """
        e = self.emissions(codes)
        step, (t, k, n) = self.p["step"], e.shape
        doubt, gain = self._doubtful(e), np.maximum(0, (step - step[0]).max(1))[1:, None]
        tags = np.zeros((n, t), np.int64)
        at, windows = np.divmod(np.flatnonzero(doubt), n)
        doubts = np.append(np.sort(windows * t + at), n * t)

        def following(windows: np.ndarray, at: np.ndarray) -> np.ndarray:
            """The first doubtful step of each window from a step on, t where there is none."""
            return np.minimum(doubts[np.searchsorted(doubts, windows * t + at)] - windows * t, t)

        windows = np.unique(windows)
        at = following(windows, np.zeros_like(windows))
        start = np.where(np.arange(k) == 0, np.float32(0), np.float32(-1e30))[:, None]  # tag 0 before the first step
        best, first, clear = start.repeat(len(windows), 1), at.copy(), np.ones(len(windows), bool)
        place, kept, ends, size = np.empty((n, t), np.int32), [], [], 0
        while len(windows):
            place[windows, at] = np.arange(size, size + len(windows))
            kept.append(best)
            size += len(windows)
            ways = best[:, None] + step[:, :, None]
            high = ways.max(0)
            clear &= ways[0, 0] == high[0]
            best = np.where(at == 0, np.float32(0), high) + self._scores(e, at, windows)
            sure = (best[1:] + gain <= best[0]).all(0)
            over = (sure | (at == t - 1)) & ~(sure & clear)
            if over.any():
                ends.append((windows[over], first[over], at[over], best[:, over].argmax(0)))
            # windows that are sure go on at their next doubtful step, with tag 0 before it
            nxt = np.where(sure, following(windows, at + 1), at + 1)
            best = np.where(sure, start, best)
            first, clear = np.where(sure, nxt, first), clear | sure
            keep = nxt < t
            windows, at, first, clear, best = windows[keep], nxt[keep], first[keep], clear[keep], best[:, keep]
        if ends:
            w, lo, hi, tag = (np.concatenate(x) for x in zip(*ends, strict=True))
            before = np.concatenate(kept, 1)
            tags[w, hi] = tag
            while len(w):
                go = hi > lo
                w, lo, hi, tag = w[go], lo[go], hi[go], tag[go]
                tag = (before[:, place[w, hi]] + step[:, tag]).argmax(0)
                hi = hi - 1
                tags[w, hi] = tag
        return tags

    def _best_path(self, e: np.ndarray) -> np.ndarray:
        """Best tags of each window from scores (step, tag, window), the smaller tag among equals.

        The way ahead keeps the best score of every tag only; which tag came before is looked up on the way back, for the
        one tag of each window that was taken.
        """
        step, (t, k, n) = self.p["step"], e.shape
        best, room = np.empty_like(e), np.empty((k, k, n), np.float32)
        best[0] = e[0]
        for s in range(1, t):
            np.add(best[s - 1][:, None, :], step[:, :, None], out=room)
            high = room[0]
            for j in range(1, k):
                np.maximum(high, room[j], out=high)
            np.add(high, e[s], out=best[s])
        tags = np.empty((t, n), np.int64)
        tags[-1] = best[-1].argmax(0)
        for s in range(t - 1, 0, -1):
            after, now, high = step[:, tags[s]], np.zeros(n, np.int64), None
            for j in range(k):
                score = best[s - 1, j] + after[j]
                if high is None:
                    high = score
                else:
                    more = score > high
                    now[more] = j
                    np.maximum(high, score, out=high)
            tags[s - 1] = now
        return tags.T

    def _lstm_back(self, d: str, codes: np.ndarray, states: list, grad: np.ndarray, g: dict) -> None:
        h, wh = self.hidden, self.p[f"h{d}"]
        dh, dc = np.zeros_like(grad[0]), np.zeros_like(grad[0])
        gx, gh = np.zeros_like(self.p[f"x{d}"]), np.zeros_like(wh)
        for s, gates, new, squashed, (hid, cell) in reversed(states):
            i, f, o = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :]
            dh = dh + grad[s]
            dc = dc + dh * o * slope(squashed)
            turn = lambda g: 0.5 * slope(2 * g - 1)
            dz = np.concatenate([dc * new * turn(i), dc * cell * turn(f), dh * squashed * turn(o), dc * i * slope(new)], 1)
            np.add.at(gx, codes[:, s], dz)
            gh += hid.T @ dz
            dh, dc = dz @ wh.T, dc * f
        g[f"x{d}"], g[f"h{d}"] = gx, gh

    def gradients(self, codes: np.ndarray, tags: np.ndarray) -> tuple[float, dict]:
        """Mean negative log-likelihood of the tags and its gradients."""
        n, t = codes.shape
        (hf, sf), (hb, sb) = self._lstm(codes, "f", True), self._lstm(codes, "b", True)
        both, step = np.concatenate([hf, hb], 2), self.p["step"]
        e = both @ self.p["out"] + self.p["bias"]
        ahead = [e[0]]
        for x in e[1:]:
            ahead.append(logsumexp(ahead[-1][:, :, None] + step[None], 1) + x)
        total = logsumexp(ahead[-1], 1)
        behind, marginal = np.zeros_like(e[0]), np.empty_like(e)
        pair = np.zeros_like(step)
        for s in range(t - 1, -1, -1):
            marginal[s] = np.exp(ahead[s] + behind - total[:, None])
            if s:
                later = e[s] + behind
                pair += np.exp(ahead[s - 1][:, :, None] + step[None] + later[:, None, :] - total[:, None, None]).sum(0)
                behind = logsumexp(step[None] + later[:, None, :], 2)
        rows, gold = np.arange(n), tags.T
        score = sum(e[s][rows, gold[s]] for s in range(t)) + sum(step[gold[s - 1], gold[s]] for s in range(1, t))
        for s in range(t):
            marginal[s][rows, gold[s]] -= 1
        np.subtract.at(pair, (gold[:-1].ravel(), gold[1:].ravel()), 1)
        de = marginal / n
        g = {"step": pair / n, "bias": de.sum((0, 1)), "out": np.einsum("tnh,tnk->hk", both, de)}
        dboth = de @ self.p["out"].T
        self._lstm_back("f", codes, sf, dboth[:, :, : self.hidden], g)
        self._lstm_back("b", codes, sb, dboth[:, :, self.hidden :], g)
        return float((total - score).mean()), g

    def train(self, codes: np.ndarray, tags: np.ndarray, epochs: int = 6, batch: int = 40, rate: float = 0.02, least: int = 300, seed: int = 3) -> list[float]:
        rng, losses = np.random.default_rng(seed), []
        epochs = max(epochs, -(-least * batch // max(1, len(codes))))  # few windows are seen more often
        m, v, k = {a: np.zeros_like(x) for a, x in self.p.items()}, {a: np.zeros_like(x) for a, x in self.p.items()}, 0
        steps = epochs * -(-len(codes) // batch)
        for _ in range(epochs):
            order, loss = rng.permutation(len(codes)), 0.0
            for at in range(0, len(order), batch):
                rows = order[at : at + batch]
                value, g = self.gradients(codes[rows], tags[rows])
                loss += value * len(rows)
                size = np.sqrt(sum(float((x**2).sum()) for x in g.values()))
                k += 1
                now = rate * (1 - 0.9 * k / steps)
                for a in self.p:
                    x = g[a] * min(1.0, 5.0 / (size + 1e-9))
                    m[a] = 0.9 * m[a] + 0.1 * x
                    v[a] = 0.99 * v[a] + 0.01 * x * x
                    self.p[a] -= (now * (m[a] / (1 - 0.9**k)) / (np.sqrt(v[a] / (1 - 0.99**k)) + 1e-8)).astype(np.float32)
            losses.append(loss / max(1, len(codes)))
        return losses
