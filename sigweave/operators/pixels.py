"""Region statistics over a long pixel table for all images at once.

`px(image, x, y, c0, c1, c2, mask)`; c0 is lightness 0..255, c1/c2 colour axes
centred at 128. `by_image` places each image in one partition: after it, every
grouped step, window and join below on `image` needs no further exchange. An
image is bounded by its sensor, so per-image state is small.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigweave.functions import scores as S


def per_image():
    return W.partitionBy("image")


def by_image(images: DataFrame) -> DataFrame:
    """Rows dealt out by `image`; call it on whole images, before they become pixels."""
    return images.repartition("image")


def _mean(c: Column) -> Column:
    return F.sum(c) / F.count(c)


def zone_stats(px: DataFrame, zones: dict[str, Column], min_n: int = 20) -> DataFrame:
    """(image, zone, n, l, a, b): channel means per zone, NULL for zones under `min_n` pixels.

    Zones overlap (whole, tip, edge...), so they are conditional sums of one grouped
    aggregate rather than copies of the pixels.
    """
    aggs = []
    for i, c in enumerate(zones.values()):
        aggs.append(F.count(F.when(c, 1)).alias(f"n_{i}"))
        aggs += [F.sum(F.when(c, F.col(ch))).alias(f"{ch}_{i}") for ch in ("c0", "c1", "c2")]
    g = px.groupBy("image").agg(*aggs)
    slot = lambda i, z: F.struct(F.lit(z).alias("zone"), F.col(f"n_{i}").alias("n"), *[(F.col(f"c{k}_{i}") / F.nullif(F.col(f"n_{i}"), F.lit(0))).alias(f"_{k}") for k in range(3)])
    s = g.select("image", F.explode(F.array(*[slot(i, z) for i, z in enumerate(zones)])).alias("s")).select("image", "s.*").filter("n > 0")
    ok = F.col("n") >= min_n
    return s.select(
        "image", "zone", "n",
        F.when(ok, F.col("_0") * 100.0 / 255.0).alias("l"),
        F.when(ok, F.col("_1") - 128.0).alias("a"),
        F.when(ok, F.col("_2") - 128.0).alias("b"),
    )


def principal_axis(px: DataFrame) -> DataFrame:
    """Masked pixels with coordinates (t, w) along and across the long axis of the mask.

    Closed form of the 2x2 covariance: angle = atan2(2 sxy, sxx - syy) / 2.
    """
    m = px.filter("mask")
    x, y = F.col("x"), F.col("y")
    n = F.count("*").over(per_image())
    mom = m.select(
        "*", n.alias("_n"), F.sum("x").over(per_image()).alias("_sx"), F.sum("y").over(per_image()).alias("_sy"),
        F.sum(x * x).over(per_image()).alias("_sxx"), F.sum(y * y).over(per_image()).alias("_syy"), F.sum(x * y).over(per_image()).alias("_sxy"),
    )
    d = mom.select(*m.columns, (F.col("_sx") / F.col("_n")).alias("_cx"), (F.col("_sy") / F.col("_n")).alias("_cy"), "_n", "_sxx", "_syy", "_sxy")
    vxx = F.col("_sxx") / F.col("_n") - F.col("_cx") * F.col("_cx")
    vyy = F.col("_syy") / F.col("_n") - F.col("_cy") * F.col("_cy")
    vxy = F.col("_sxy") / F.col("_n") - F.col("_cx") * F.col("_cy")
    ang = F.lit(0.5) * F.atan2(S.rnd(F.lit(2.0) * vxy, 9), S.rnd(vxx - vyy, 9))
    e = d.withColumn("_th", ang)
    dx, dy = x - F.col("_cx"), y - F.col("_cy")
    return e.select(
        *m.columns,
        S.rnd(dx * F.cos("_th") + dy * F.sin("_th"), 6).alias("t"),
        S.rnd(dy * F.cos("_th") - dx * F.sin("_th"), 6).alias("w"),
    )


def axis_zones(axis: DataFrame) -> DataFrame:
    """Add `tn` (0 root .. 1 tip) and `third`; the tip is the narrower end.

    Width of an end = mean |w| beyond the outer quartile of t, both rounded half up to six digits. They are made from whole
    millionths, so that halves do not fall with the order of a sum.
    """
    millionths = lambda c: F.floor(c * 1e6 + F.lit(0.5)).cast("long")
    q = axis.withColumn("_tu", millionths(F.col("t"))).withColumn("_wu", millionths(F.abs("w")))
    quartile = lambda p: F.floor(F.percentile("_tu", F.lit(p)).over(per_image()) + F.lit(0.5))
    q = q.withColumn("_q1", quartile(0.25)).withColumn("_q3", quartile(0.75))
    total = lambda c, x: F.sum(F.when(c, x)).over(per_image()).cast("double")
    far = lambda c: F.floor(total(c, F.col("_wu")) / total(c, F.lit(1)) + F.lit(0.5))
    none = F.lit(10**15)
    e = q.withColumn("_pos", F.coalesce(far(F.col("_tu") > F.col("_q3")), none)).withColumn("_neg", F.coalesce(far(F.col("_tu") < F.col("_q1")), none))
    tt = F.when(F.col("_pos") < F.col("_neg"), F.col("t")).otherwise(-F.col("t"))
    e = e.withColumn("_tt", tt)
    lo, hi = F.min("_tt").over(per_image()), F.max("_tt").over(per_image())
    tn = S.rnd((F.col("_tt") - lo) / (hi - lo + F.lit(1e-6)), 6)
    third = F.when(F.col("tn") >= 0.66, "tip").when(F.col("tn") >= 0.33, "middle").otherwise("root")
    return e.withColumn("tn", tn).withColumn("third", third).select(*axis.columns, "tn", "third")


def mask_distance(px: DataFrame) -> DataFrame:
    """`px` with `dist`, the exact Euclidean distance of every pixel to the nearest one outside the mask.

    Separable: along each line the distance to the nearest pixel outside is a running maximum from both sides; along each
    column the squared distance is the lower envelope of one parabola per pixel. NULL where the image has nothing outside.
    """
    line = W.partitionBy("image", "y").rowsBetween(W.unboundedPreceding, 0)
    out = F.when(~F.col("mask"), F.col("x"))
    before, after = F.max(out).over(line.orderBy("x")), F.min(out).over(line.orderBy(F.desc("x")))
    gap = F.least(F.col("x") - before, after - F.col("x")).cast("double")
    rest = [c for c in px.columns if c not in ("image", "x")]
    lined = px.select(F.struct(*rest).alias("_px"), "image", "x", "y", F.coalesce(gap * gap, F.lit(float("nan"))).alias("_g"))
    columns = lined.groupBy("image", "x").agg(F.array_sort(F.collect_list(F.struct("y", "_g", "_px"))).alias("_c"))
    # the planner no longer knows where rows are after Python, so whole columns are dealt out by image, not pixels later on
    columns = by_image(columns.withColumn("_d", _distances(F.col("_c.y").cast("array<double>"), F.col("_c._g"))))
    rows = columns.select("image", "x", F.explode(F.arrays_zip(F.col("_c._px").alias("px"), F.col("_d").alias("d"))).alias("z"))
    kept = {"image": F.col("image"), "x": F.col("x"), **{c: F.col("z.px")[c].alias(c) for c in rest}}
    return rows.select(*[kept[c] for c in px.columns], F.when(~F.isnan("z.d"), F.col("z.d")).alias("dist"))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _distances(at: pd.Series, squared: pd.Series) -> pd.Series:
    """Distances of the pixels of each column (places ascending) from the squared ones along its lines."""
    size = at.map(len).to_numpy()
    flat = np.sqrt(lower_envelope(size, np.concatenate(at.tolist()), np.concatenate(squared.tolist())))
    return pd.Series(np.split(flat, np.cumsum(size)[:-1]))


def lower_envelope(size: np.ndarray, at: np.ndarray, height: np.ndarray) -> np.ndarray:
    """min over j of (at[i] - at[j])^2 + height[j] inside each column, for many columns at once.

    Columns lie one after another, `at` ascending in each; NaN heights are no parabolas. One step per place of the longest
    column: a new parabola takes the hidden ones off its column's stack; then all places are read off from left to right.
    """
    n, start = len(size), np.cumsum(size) - size
    deep = int(size.max()) if n else 0
    vertex, left = np.zeros((n, deep), np.int64), np.full((n, deep + 1), np.inf)  # parabolas of a column, and where each begins
    top = np.full(n, -1)
    for i in range(deep):
        lanes = np.flatnonzero(size > i)
        lanes = lanes[~np.isnan(height[start[lanes] + i])]
        new = start[lanes] + i
        border = np.full(len(lanes), -np.inf)
        todo = np.flatnonzero(top[lanes] >= 0)
        while len(todo):
            lane, v = lanes[todo], vertex[lanes[todo], top[lanes[todo]]]
            w = new[todo]
            border[todo] = (height[w] + at[w] ** 2 - height[v] - at[v] ** 2) / (2 * (at[w] - at[v]))
            hidden = border[todo] <= left[lane, top[lane]]
            top[lane[hidden]] -= 1
            todo = todo[hidden]
            empty = top[lanes[todo]] < 0
            border[todo[empty]] = -np.inf
            todo = todo[~empty]
        top[lanes] += 1
        vertex[lanes, top[lanes]] = new
        left[lanes, top[lanes]] = border
    out = np.full(len(at), np.nan)
    now = np.zeros(n, np.int64)
    for i in range(deep):
        lanes = np.flatnonzero((size > i) & (top >= 0))
        here = start[lanes] + i
        todo = lanes
        while len(todo):
            more = now[todo] < top[todo]
            todo = todo[more]
            todo = todo[left[todo, now[todo] + 1] < at[start[todo] + i]]
            now[todo] += 1
        v = vertex[lanes, now[lanes]]
        out[here] = (at[here] - at[v]) ** 2 + height[v]
    return out


def ring_zones(zoned: DataFrame) -> DataFrame:
    """Add `depth`, the share of the image's largest `dist`, and `ring`: centre, edge or other.

    A mask that fills its frame has no border: all of it is centre.
    """
    far = F.max("dist").over(per_image())
    depth = F.coalesce(S.rnd(F.col("dist") / (far + F.lit(1e-6)), 6), F.lit(1.0))
    ring = F.when(F.col("depth") >= 0.55, "center").when((F.col("depth") > 0.10) & (F.col("depth") <= 0.35), "edge").otherwise("other")
    return zoned.withColumn("depth", depth).withColumn("ring", ring)


def zone_map() -> dict[str, Column]:
    third, ring = F.col("third"), F.col("ring")
    return {
        "whole": F.lit(True),
        "tip": third == "tip",
        "middle": third == "middle",
        "root": third == "root",
        "center": ring == "center",
        "edge": ring == "edge",
        "sides": (third == "middle") & (ring == "edge"),
    }


def zone_contrast(stats: DataFrame) -> DataFrame:
    """Contrast signals per image from zone statistics (NULL when a zone is too small)."""
    pick = lambda z, c: F.max(F.when(F.col("zone") == z, F.col(c)))
    w = stats.groupBy("image").agg(*[pick(z, c).alias(f"{z}_{c}") for z in zone_map() for c in ("l", "a", "b")])
    d = lambda a, b: S.rnd(F.col(a) - F.col(b), 6)
    return w.select(
        "image",
        d("tip_a", "whole_a").alias("tip_delta"),
        d("sides_a", "whole_a").alias("side_delta"),
        d("tip_a", "root_a").alias("gradient"),
        d("center_l", "edge_l").alias("center_coating"),
        S.rnd((F.abs("edge_a") + F.abs("edge_b")) - (F.abs("center_a") + F.abs("center_b")), 6).alias("center_desat"),
    )


def zone_flags(contrast: DataFrame, tip_cut: float = 2.0, side_cut: float = 1.5) -> DataFrame:
    """Threshold to present/absent with severity clip(delta / 8, 0, 1)."""
    word = lambda c, t: F.when(F.col(c) > t, "present").otherwise("absent")
    sev = lambda c: S.rnd(S.clip(F.coalesce(F.col(c), F.lit(0.0)) / 8.0, 0.0, 1.0), 4)
    return contrast.select(
        "image", word("tip_delta", tip_cut).alias("red_tip"), sev("tip_delta").alias("tip_severity"),
        word("side_delta", side_cut).alias("red_sides"), sev("side_delta").alias("side_severity"),
    )


def gloss(px: DataFrame, bright: float = 210.0, chroma_max: float = 14.0, wet_at: float = 0.02) -> DataFrame:
    """Specular share of the mask: L >= max(210, its own p96) and chroma <= 14; wet from 2 %.

    L is an 8-bit channel, so the exact percentile keeps at most 256 counts.
    """
    m = px.filter("mask").withColumn("_hi", F.greatest(F.lit(bright), F.percentile("c0", F.lit(0.96)).over(per_image())))
    da, db = F.col("c1") - 128.0, F.col("c2") - 128.0
    spec = (F.col("c0") >= F.col("_hi") - 1e-9) & (da * da + db * db <= chroma_max * chroma_max)
    g = m.groupBy("image").agg((F.sum(spec.cast("int")) / F.count("*")).alias("_f"))
    return g.select(
        "image", S.rnd(F.col("_f"), 4).alias("gloss"), F.when(F.col("_f") >= wet_at, "wet").otherwise("normal").alias("moisture"),
        S.rnd(S.clip(F.col("_f") / 0.04, 0.0, 1.0), 4).alias("wet_severity"),
    )


def exposure(px: DataFrame) -> DataFrame:
    """Mean lightness, clipped shadow and highlight shares, tiered status."""
    share = lambda c: F.sum(c.cast("int")) / F.count("*")
    e = px.filter("mask").groupBy("image").agg(
        _mean(F.col("c0")).alias("mean_luma"), share(F.col("c0") <= 8).alias("clip_lo"), share(F.col("c0") >= 250).alias("clip_hi")
    )
    m, lo, hi = F.col("mean_luma"), F.col("clip_lo"), F.col("clip_hi")
    status = (
        F.when((m < 55) | (lo > 0.35) | (m > 220) | (hi > 0.25), "error").when((m < 80) | (m > 200) | (hi > 0.08), "warn").otherwise("ok")
    )
    return e.select("image", S.rnd(m, 4).alias("mean_luma"), S.rnd(lo, 6).alias("clip_lo"), S.rnd(hi, 6).alias("clip_hi"), status.alias("status"))


def sharpness(px: DataFrame, error_below: float = 45.0, warn_below: float = 110.0) -> DataFrame:
    """Variance of the 4-neighbour Laplacian over the mask's bounding box.

    Borders mirror without repeating the edge pixel: a missing neighbour takes
    the opposite one's value.
    """
    on = F.col("mask")
    box = px.select(
        "*", F.min(F.when(on, F.col("x"))).over(per_image()).alias("_x0"), F.max(F.when(on, F.col("x"))).over(per_image()).alias("_x1"),
        F.min(F.when(on, F.col("y"))).over(per_image()).alias("_y0"), F.max(F.when(on, F.col("y"))).over(per_image()).alias("_y1"),
    ).filter("x between _x0 and _x1 and y between _y0 and _y1")
    row, col = W.partitionBy("image", "y").orderBy("x"), W.partitionBy("image", "x").orderBy("y")
    n = box.select(
        "image", "c0", F.lag("c0").over(row).alias("l"), F.lead("c0").over(row).alias("r"), F.lag("c0").over(col).alias("u"), F.lead("c0").over(col).alias("d")
    )
    side = lambda a, b: F.coalesce(F.col(a), F.col(b), F.col("c0"))
    lap = (side("l", "r") + side("r", "l") + side("u", "d") + side("d", "u") - 4 * F.col("c0")).cast("double")
    v = n.withColumn("lap", lap).groupBy("image").agg(
        S.rnd(F.sum(F.col("lap") * F.col("lap")) / F.count("*") - (F.sum("lap") / F.count("*")) * (F.sum("lap") / F.count("*")), 4).alias("sharpness")
    )
    s = F.col("sharpness")
    return v.select("image", "sharpness", F.when(s < error_below, "error").when(s < warn_below, "warn").otherwise("ok").alias("status"))


def framing(px: DataFrame, target: tuple[float, float], width: int, height: int, present: float = 0.05, reliable: float = 0.12) -> DataFrame:
    """Coverage, centroid offset from the target, border contact and status with messages."""
    on = F.col("mask")
    g = px.groupBy("image").agg(
        (F.sum(on.cast("int")) / F.count("*")).alias("cov"),
        F.avg(F.when(on, F.col("x"))).alias("mx"), F.avg(F.when(on, F.col("y"))).alias("my"),
        F.min(F.when(on, F.col("x"))).alias("x0"), F.max(F.when(on, F.col("x"))).alias("x1"),
        F.min(F.when(on, F.col("y"))).alias("y0"), F.max(F.when(on, F.col("y"))).alias("y1"),
    )
    dx, dy = F.col("mx") / width - target[0], F.col("my") / height - target[1]
    g = g.withColumn("offset", S.rnd(F.sqrt(dx * dx + dy * dy), 6)).withColumn(
        "border", (F.col("x0") <= 1) | (F.col("x1") >= width - 2) | (F.col("y0") <= 1) | (F.col("y1") >= height - 2)
    )
    none = F.col("mx").isNull() | (F.col("cov") < present)
    msgs = F.array_compact(
        F.array(
            F.when(F.col("offset") > 0.12, F.lit("center")),
            F.when(F.col("cov") < reliable, F.lit("closer")),
            F.when(F.col("border") & (F.col("cov") > 0.45), F.lit("back")),
        )
    )
    return g.select(
        "image", S.rnd(F.col("cov"), 6).alias("coverage"), F.when(~none, F.col("offset")).alias("offset"),
        F.when(none, "error").when(F.size(msgs) > 0, "warn").otherwise("ok").alias("status"),
        F.when(none, "nothing detected").otherwise(F.array_join(msgs, ", ")).alias("message"),
        (~none & (F.col("cov") >= reliable)).alias("reliable"),
    )


def illuminant_gain(px: DataFrame, channels: Sequence[str] = ("c0", "c1", "c2"), p: int = 6, strength: float = 0.35) -> DataFrame:
    """Shades-of-grey white balance: power mean per channel, normalised, partly applied, clipped to 0..255."""
    ill = {c: F.pow(F.avg(F.pow(F.col(c).cast("double"), F.lit(float(p)))).over(per_image()), F.lit(1.0 / p)) for c in channels}
    d = px.select("*", *[e.alias(f"_i_{c}") for c, e in ill.items()])
    mean = sum((F.col(f"_i_{c}") for c in channels[1:]), F.col(f"_i_{channels[0]}")) / len(channels)
    gain = lambda c: F.lit(1.0) + strength * (F.col(f"_i_{c}") / (mean + 1e-6) - 1.0)
    return d.select(*[c for c in px.columns if c not in channels], *[F.floor(S.rnd(S.clip(F.col(c) / gain(c), 0.0, 255.0), 6)).alias(c) for c in channels])


def masked_pool(px: DataFrame, value: str = "v") -> DataFrame:
    """Masked mean (sum over mask / max(mask size, 1)) beside the global mean."""
    m = F.col("mask").cast("int")
    return px.groupBy("image").agg(
        S.rnd(F.sum(F.col(value) * m) / F.greatest(F.sum(m), F.lit(1)), 6).alias("masked"), S.rnd(F.sum(value) / F.count("*"), 6).alias("pooled")
    )


def dice_per_image(px: DataFrame, pred: str = "mask", gold: str = "gold", eps: float = 1e-6) -> DataFrame:
    n = lambda c: F.count(F.when(c, 1))
    p, g = F.col(pred), F.col(gold)
    a = px.groupBy("image").agg(n(p & g).alias("tp"), n(p & ~g).alias("fp"), n(~p & g).alias("fn"))
    den = 2 * F.col("tp") + F.col("fp") + F.col("fn")
    return a.withColumn("dice", 2 * F.col("tp") / (den + eps)).withColumn("iou", F.col("tp") / (F.col("tp") + F.col("fp") + F.col("fn") + eps))


def dice_summary(per: DataFrame, by: Sequence[str] = (), eps: float = 1e-6, low: float = 0.9) -> DataFrame:
    """Mean of per-image Dice / IoU, share under 0.9, and the pooled Dice, per source domain."""
    tp, fp, fn = F.sum("tp"), F.sum("fp"), F.sum("fn")
    return per.groupBy(*by).agg(
        F.count("*").alias("n"), S.rnd(F.avg("dice"), 6).alias("mean_dice"), S.rnd(F.avg("iou"), 6).alias("mean_iou"),
        S.rnd(F.avg((F.col("dice") < low).cast("int")), 6).alias("low_share"), S.rnd(2 * tp / (2 * tp + fp + fn + eps), 6).alias("pooled_dice"),
    )
