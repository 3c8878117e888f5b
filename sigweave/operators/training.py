"""Head scoring and weighted head training on vector columns."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigweave.functions import scores as S

SLOTS = 64  # partial sums of a part are added up in so many tasks first


def score_heads(df: DataFrame, vec: str, heads: Sequence[Sequence[float]]) -> DataFrame:
    """Add `logits`: one dot product per head. Head weights are literals, so this is a narrow map.

    A head with one weight more than the vector has components ends in its intercept.
    """
    x = F.concat(F.col(vec).cast("array<double>"), F.array(F.lit(1.0)))
    out = [S.dot(F.slice(x, 1, len(w)), F.array(*[F.lit(float(v)) for v in w])) for w in heads]
    return df.withColumn("logits", F.array(*out))


def head_score(confusion: DataFrame, n_classes: int) -> float:
    """Mean per-class F1 minus the mean ordinal error (|pred - gold| / (n - 1)), from confusion counts."""
    rows = [(int(x["gold"]), int(x["pred"]), x["n"]) for x in confusion.collect()]  # at most n_classes^2 rows
    total = sum(n for _, _, n in rows) or 1
    f1 = 0.0
    for c in range(n_classes):
        tp = sum(n for g, p, n in rows if g == c and p == c)
        both = sum(n for g, _, n in rows if g == c) + sum(n for _, p, n in rows if p == c)
        f1 += 2 * tp / both if both else 0.0
    return f1 / n_classes - sum(abs(g - p) * n for g, p, n in rows) / total / max(1, n_classes - 1)


def _softmax(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    z = x @ w.T
    z -= z.max(1, keepdims=True)
    e = np.exp(z)
    return e / e.sum(1, keepdims=True)


def _derivatives(w: np.ndarray):
    """Per batch: loss, gradient and the blocks of the Hessian of the weighted log loss at `w`, each a row of one part."""
    n_classes, d = w.shape

    def run(batches):
        task, made = TaskContext.get().partitionId(), 0
        for b in batches:
            if not b.num_rows:
                continue
            x = b["x"].flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, d - 1)
            x = np.concatenate([x, np.ones((len(x), 1))], 1)
            y, weight = b["y"].to_numpy(zero_copy_only=False), b["weight"].to_numpy(zero_copy_only=False)
            p = _softmax(x, w)
            hot = np.eye(n_classes)[y]
            parts = [np.append(((p - hot) * weight[:, None]).T @ x, -(weight @ np.log(np.maximum(p[np.arange(len(y)), y], 1e-300)))).ravel()]
            for i in range(n_classes):
                for j in range(i, n_classes):
                    parts.append((x.T @ (x * (weight * p[:, i] * ((i == j) - p[:, j]))[:, None])).ravel())
            n = len(parts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(n), pa.int32()), pa.array([task % SLOTS] * n, pa.int32()), pa.array([task << 32 | made] * n, pa.int64()), pa.array([v.tolist() for v in parts], pa.list_(pa.float64()))],
                ["part", "slot", "nth", "v"],
            )
            made += 1

    return run


def _added(t: pa.Table) -> pa.Table:
    """One row: the sum of the arrays, in the order of `nth`."""
    t = t.sort_by("nth")
    v = t["v"].combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1).sum(0)
    return pa.table({"part": t["part"].slice(0, 1), "nth": t["nth"].slice(0, 1), "v": pa.array([v.tolist()], pa.list_(pa.float64()))})


def fit_head(df: DataFrame, vec: str, target: str, weight: str, n_classes: int, reg: float, steps: int = 50, tol: float = 1e-11) -> np.ndarray:
    """Weights (class, component and intercept) of the weighted multinomial log loss plus reg / 2 * |weights|^2, without
    the intercepts, both per unit of weight; Newton steps, halved while the loss grows.

    A step is one pass over the rows: each batch sums its own gradient and Hessian blocks, the sums are added up in a
    fixed order in two rounds of grouped jobs, and only the sums (as large as the model squared) reach the driver.
    Rows without a target or with a weight that is not positive take no part.
    """
    rows = df.select(F.col(vec).cast("array<double>").alias("x"), F.col(target).cast("int").alias("y"), F.col(weight).cast("double").alias("weight"))
    rows = rows.filter("x is not null and y is not null and weight > 0")
    size = rows.agg(F.max(F.size("x")), F.min(F.size("x")), F.sum("weight")).first()
    if size[0] is None:
        raise ValueError("no rows to train on")
    if size[0] != size[1]:
        raise ValueError("vectors of different lengths")
    d, total = size[0] + 1, size[2]
    w, ridge = np.zeros((n_classes, d)), np.append(np.full(d - 1, reg), 0.0)

    def at(w: np.ndarray):
        part = rows.mapInArrow(_derivatives(w), "part int, slot int, nth long, v array<double>")
        some = part.groupBy("part", "slot").applyInArrow(_added, "part int, nth long, v array<double>")
        got = dict(zip(*[c.to_pylist() for c in some.groupBy("part").applyInArrow(_added, "part int, nth long, v array<double>").select("part", "v").toArrow().columns], strict=True))
        first = np.array(got[0])
        loss = first[-1] / total + (ridge * w * w).sum() / 2
        grad = first[:-1].reshape(n_classes, d) / total + ridge * w
        h, n = np.zeros((n_classes, d, n_classes, d)), 1
        for i in range(n_classes):
            for j in range(i, n_classes):
                h[i, :, j, :] = h[j, :, i, :] = np.array(got[n]).reshape(d, d) / total
                n += 1
            h[i, :, i, :] += np.diag(ridge)
        return loss, grad.ravel(), h.reshape(n_classes * d, n_classes * d)

    loss, grad, hess = at(w)
    for _ in range(steps):
        if np.abs(grad).max() < tol:
            break
        # all classes may move together without any effect, so the smallest solution is taken
        step, share = np.linalg.lstsq(hess, grad, rcond=1e-12)[0].reshape(w.shape), 1.0
        while True:
            new = w - share * step
            found = at(new)
            if found[0] <= loss + 1e-14 or share < 1e-6:
                break
            share /= 2
        w, (loss, grad, hess) = new, found
    return w


def predicted(df: DataFrame, vec: str, heads: np.ndarray) -> Column:
    """Class of the largest logit, the first of equals; `df` must have passed `score_heads`."""
    return (F.array_position("logits", F.array_max("logits")) - 1).cast("int")


def train_head(df: DataFrame, vec: str, target: str, weight: str, regs: Sequence[float], n_classes: int) -> tuple[np.ndarray, float]:
    """Weighted multinomial head per regularisation on `split = train`; the one with the best `head_score` on
    `split = val`. Returns (weights, chosen regularisation)."""
    best = None
    for reg in regs:
        w = fit_head(df.filter("split = 'train'"), vec, target, weight, n_classes, reg)
        c = evaluate_head(w, df.filter("split = 'val'"), vec, target)
        score = head_score(c, n_classes)
        if best is None or score > best[0]:
            best = (score, w, reg)
    return best[1], best[2]


def evaluate_head(heads: np.ndarray, df: DataFrame, vec: str, target: str) -> DataFrame:
    """Confusion counts per split."""
    p = score_heads(df, vec, heads.tolist())
    return p.groupBy("split", F.col(target).cast("int").alias("gold"), predicted(p, vec, heads).alias("pred")).agg(F.count("*").alias("n"))


def moments(heads: np.ndarray, df: DataFrame, vec: str, weight: str, reg: float) -> DataFrame:
    """(class, component, moment): weighted mean of p(class) times the component, plus the pull of the regularisation.

    At the minimum this is the weighted mean of (target = class) times the component: the gradient is their difference.
    The intercept is the component after the last one.
    """
    logits = score_heads(df, vec, heads.tolist()).select(F.concat(F.col(vec).cast("array<double>"), F.array(F.lit(1.0))).alias("x"), "logits", F.col(weight).cast("double").alias("w"))
    e = logits.select("x", "w", F.transform("logits", lambda z: F.exp(z - F.array_max("logits"))).alias("e"))
    p = e.select("x", "w", F.posexplode(F.transform("e", lambda v: v / F.aggregate("e", F.lit(0.0), lambda a, b: a + b))).alias("class", "p"))
    g = p.select("class", "w", "p", F.posexplode("x").alias("component", "v")).groupBy("class", "component")
    sums = g.agg((F.sum(F.col("w") * F.col("p") * F.col("v")) / F.sum("w")).alias("m"))
    pull = F.array(*[F.array(*[F.lit(float(reg * v)) for v in row[:-1]], F.lit(0.0)) for row in heads.tolist()])
    return sums.select("class", "component", (F.col("m") + F.get(F.get(pull, F.col("class")), F.col("component"))).alias("moment"))
