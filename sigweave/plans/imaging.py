"""Pixel, logit and head-scoring queries over `embeddings`: a 64-vector read as an 8 x 8 image."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigweave.functions import scores as S
from sigweave.operators import evaluate as E
from sigweave.operators import pixels as P
from sigweave.operators import signals as G
from sigweave.plans.base import query, r, with_
from sigweave.session import cut, table


def pixels(spark, sf) -> DataFrame:
    """Pixels of every image. Whole images are dealt out by id before they are spread into pixels, so the exchange moves
    one row per image and everything grouped by image afterwards needs no other."""
    e = P.by_image(table(spark, sf, "embeddings").select(F.col("vec_id").alias("image"), "label", "embedding"))
    e = e.select("image", "label", F.posexplode("embedding").alias("pos", "f"))
    v = F.col("f").cast("double")
    x, y = F.col("pos") % 8, F.floor(F.col("pos") / 8).cast("int")
    b = e.select("image", "label", x.alias("x"), y.alias("y"), v.alias("v"), (v > 0).alias("mask"), (v > 0.02).alias("gold"))
    ch = lambda c: F.floor(c + 0.5).cast("int")
    return b.select(
        "*",
        ch(S.clip(F.lit(128.0) + F.lit(560.0) * F.col("v"), 0.0, 255.0)).alias("c0"),
        ch(F.lit(128.0) + F.lit(60.0) * F.col("v") + (F.col("y") - 3.5) * 2).alias("c1"),
        ch(F.lit(128.0) + F.lit(40.0) * F.col("v") - (F.col("x") - 3.5) * 2).alias("c2"),
    )


C_PX = """px0 AS (SELECT vec_id AS image, label, i-1 AS pos, embedding[i]::DOUBLE AS v FROM embeddings, range(1, 65) t(i)),
px AS (SELECT image, label, CAST(pos % 8 AS INT) AS x, CAST(pos // 8 AS INT) AS y, v, v > 0 AS mask, v > 0.02::DOUBLE AS gold,
  CAST(floor(least(255.0::DOUBLE, greatest(0.0::DOUBLE, 128.0::DOUBLE + 560.0::DOUBLE*v)) + 0.5) AS INT) AS c0,
  CAST(floor(128.0::DOUBLE + 60.0::DOUBLE*v + ((pos // 8) - 3.5)*2 + 0.5) AS INT) AS c1,
  CAST(floor(128.0::DOUBLE + 40.0::DOUBLE*v - ((pos % 8) - 3.5)*2 + 0.5) AS INT) AS c2 FROM px0)"""
C_AXIS = f"""mo AS (SELECT image, count(*) AS n, sum(x)/count(*) AS cx, sum(y)/count(*) AS cy, sum(x*x)/count(*) AS qxx, sum(y*y)/count(*) AS qyy, sum(x*y)/count(*) AS qxy FROM px WHERE mask GROUP BY 1),
th AS (SELECT *, 0.5*atan2({r('2.0::DOUBLE*(qxy - cx*cy)', 9)}, {r('(qxx - cx*cx) - (qyy - cy*cy)', 9)}) AS th FROM mo),
ax AS (SELECT p.*, {r('(x-cx)*cos(th) + (y-cy)*sin(th)')} AS t, {r('(y-cy)*cos(th) - (x-cx)*sin(th)')} AS w FROM px p JOIN th USING (image) WHERE mask)"""
C_ZONES = f"""qt0 AS (SELECT *, CAST(floor(t*1e6+0.5) AS BIGINT) AS tu, CAST(floor(abs(w)*1e6+0.5) AS BIGINT) AS wu FROM ax),
qt AS (SELECT image, floor(quantile_cont(tu::DOUBLE, 0.25)+0.5) AS q1, floor(quantile_cont(tu::DOUBLE, 0.75)+0.5) AS q3 FROM qt0 GROUP BY 1),
en AS (SELECT image, coalesce(floor(sum(wu) FILTER (tu > q3)::DOUBLE/count(*) FILTER (tu > q3)+0.5), 1e15) AS pos, coalesce(floor(sum(wu) FILTER (tu < q1)::DOUBLE/count(*) FILTER (tu < q1)+0.5), 1e15) AS neg FROM qt0 JOIN qt USING (image) GROUP BY 1),
tt AS (SELECT a.*, CASE WHEN pos < neg THEN t ELSE -t END AS tt FROM ax a JOIN en USING (image)),
mm AS (SELECT image, min(tt) AS lo, max(tt) AS hi FROM tt GROUP BY 1),
zn AS (SELECT tt.* EXCLUDE (tt), {r('(tt-lo)/(hi-lo+1e-6)')} AS tn FROM tt JOIN mm USING (image)),
zo AS (SELECT *, CASE WHEN tn >= 0.66 THEN 'tip' WHEN tn >= 0.33 THEN 'middle' ELSE 'root' END AS third FROM zn)"""
C_RINGS = f"""ds AS (SELECT a.image, a.x, a.y, sqrt(min((a.x-o.x)*(a.x-o.x) + (a.y-o.y)*(a.y-o.y))::DOUBLE) AS dist FROM px a JOIN px o ON o.image = a.image AND a.mask AND NOT o.mask GROUP BY 1, 2, 3),
rg0 AS (SELECT z.*, coalesce({r('dist/(max(dist) OVER (PARTITION BY z.image) + 1e-6)')}, 1.0::DOUBLE) AS depth FROM zo z LEFT JOIN ds d ON d.image = z.image AND d.x = z.x AND d.y = z.y),
rg AS (SELECT *, CASE WHEN depth >= 0.55 THEN 'center' WHEN depth > 0.10 AND depth <= 0.35 THEN 'edge' ELSE 'other' END AS ring FROM rg0)"""
C_STATS = """zt AS (SELECT image, c0, c1, c2, unnest(list_filter([ 'whole', CASE WHEN third='tip' THEN 'tip' END, CASE WHEN third='middle' THEN 'middle' END, CASE WHEN third='root' THEN 'root' END,
  CASE WHEN ring='center' THEN 'center' END, CASE WHEN ring='edge' THEN 'edge' END, CASE WHEN ring='edge' AND third='middle' THEN 'sides' END], lambda z: z IS NOT NULL)) AS zone FROM rg),
zs AS (SELECT image, zone, count(*) AS n, CASE WHEN count(*) >= 5 THEN sum(c0)/count(*)*100.0/255.0 END AS l, CASE WHEN count(*) >= 5 THEN sum(c1)/count(*)-128.0 END AS a, CASE WHEN count(*) >= 5 THEN sum(c2)/count(*)-128.0 END AS b FROM zt GROUP BY 1, 2)"""
C_CON = f"""zw AS (SELECT image, max(a) FILTER (zone='tip') AS tip_a, max(a) FILTER (zone='whole') AS whole_a, max(a) FILTER (zone='sides') AS sides_a, max(a) FILTER (zone='root') AS root_a,
  max(l) FILTER (zone='center') AS center_l, max(l) FILTER (zone='edge') AS edge_l, max(a) FILTER (zone='edge') AS edge_a, max(b) FILTER (zone='edge') AS edge_b, max(a) FILTER (zone='center') AS center_a, max(b) FILTER (zone='center') AS center_b FROM zs GROUP BY 1),
zc AS (SELECT image, {r('tip_a-whole_a')} AS tip_delta, {r('sides_a-whole_a')} AS side_delta, {r('tip_a-root_a')} AS gradient, {r('center_l-edge_l')} AS center_coating, {r('(abs(edge_a)+abs(edge_b))-(abs(center_a)+abs(center_b))')} AS center_desat FROM zw)"""
P_ZONES = [C_PX, C_AXIS, C_ZONES]
P_STATS = [*P_ZONES, C_RINGS, C_STATS]


def rings(spark, sf):
    return P.ring_zones(P.axis_zones(P.principal_axis(P.mask_distance(pixels(spark, sf)))))


def stats(spark, sf):
    return P.zone_stats(rings(spark, sf), P.zone_map(), min_n=5)


@query("z1_zone_stats", with_(P_STATS, f"SELECT image, zone, n, {r('l')} AS l, {r('a')} AS a, {r('b')} AS b FROM zs"))
def z1(spark, sf):
    rd = lambda c: S.rnd(F.col(c), 6).alias(c)
    return stats(spark, sf).select("image", "zone", "n", rd("l"), rd("a"), rd("b"))


@query("z2_principal_axis", with_([C_PX, C_AXIS], "SELECT image, x, y, t, w FROM ax"))
def z2(spark, sf):
    return P.principal_axis(pixels(spark, sf)).select("image", "x", "y", "t", "w")


@query("z3_axis_zones", with_(P_ZONES, "SELECT image, x, y, tn, third FROM zo"))
def z3(spark, sf):
    return P.axis_zones(P.principal_axis(pixels(spark, sf))).select("image", "x", "y", "tn", "third")


@query("z4_ring_zones", with_([*P_ZONES, C_RINGS], "SELECT image, x, y, depth, ring, (ring = 'edge' AND third = 'middle') AS side FROM rg"))
def z4(spark, sf):
    return rings(spark, sf).select("image", "x", "y", "depth", "ring", ((F.col("ring") == "edge") & (F.col("third") == "middle")).alias("side"))


@query("z5_zone_contrast", with_([*P_STATS, C_CON], "SELECT * FROM zc"))
def z5(spark, sf):
    return P.zone_contrast(stats(spark, sf))


@query("z6_zone_flags", with_([*P_STATS, C_CON], f"""SELECT image, CASE WHEN tip_delta > 2.0 THEN 'present' ELSE 'absent' END AS red_tip, {r('least(1.0::DOUBLE, greatest(0.0::DOUBLE, coalesce(tip_delta, 0.0::DOUBLE)/8.0))', 4)} AS tip_severity,
  CASE WHEN side_delta > 1.5 THEN 'present' ELSE 'absent' END AS red_sides, {r('least(1.0::DOUBLE, greatest(0.0::DOUBLE, coalesce(side_delta, 0.0::DOUBLE)/8.0))', 4)} AS side_severity FROM zc"""))
def z6(spark, sf):
    return P.zone_flags(P.zone_contrast(stats(spark, sf)))


@query("z7_gloss", with_([C_PX], f""", h AS (SELECT image, greatest(210.0::DOUBLE, quantile_cont(c0::DOUBLE, 0.96)) AS hi FROM px WHERE mask GROUP BY 1),
 f AS (SELECT image, avg(CAST(c0 >= hi - 1e-9 AND (c1-128)*(c1-128)+(c2-128)*(c2-128) <= 196 AS INT)) AS f FROM px JOIN h USING (image) WHERE mask GROUP BY 1)
 SELECT image, {r('f', 4)} AS gloss, CASE WHEN f >= 0.02 THEN 'wet' ELSE 'normal' END AS moisture, {r('least(1.0::DOUBLE, f/0.04::DOUBLE)', 4)} AS wet_severity FROM f"""))
def z7(spark, sf):
    return P.gloss(pixels(spark, sf))


@query("z8_exposure", with_([C_PX], f""", e AS (SELECT image, avg(c0) AS m, avg(CAST(c0 <= 8 AS INT)) AS lo, avg(CAST(c0 >= 250 AS INT)) AS hi FROM px WHERE mask GROUP BY 1)
 SELECT image, {r('m', 4)} AS mean_luma, {r('lo')} AS clip_lo, {r('hi')} AS clip_hi, CASE WHEN m < 55 OR lo > 0.35 OR m > 220 OR hi > 0.25 THEN 'error' WHEN m < 80 OR m > 200 OR hi > 0.08 THEN 'warn' ELSE 'ok' END AS status FROM e"""))
def z8(spark, sf):
    return P.exposure(pixels(spark, sf))


@query("z9_sharpness", with_([C_PX], f""", bx AS (SELECT image, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM px WHERE mask GROUP BY 1),
 bp AS (SELECT p.image, x, y, c0 FROM px p JOIN bx USING (image) WHERE x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1),
 nb AS (SELECT p.image, p.c0, coalesce(l.c0, r_.c0, p.c0)+coalesce(r_.c0, l.c0, p.c0)+coalesce(u.c0, d.c0, p.c0)+coalesce(d.c0, u.c0, p.c0)-4*p.c0 AS lap FROM bp p
   LEFT JOIN bp l ON l.image=p.image AND l.y=p.y AND l.x=p.x-1 LEFT JOIN bp r_ ON r_.image=p.image AND r_.y=p.y AND r_.x=p.x+1
   LEFT JOIN bp u ON u.image=p.image AND u.x=p.x AND u.y=p.y-1 LEFT JOIN bp d ON d.image=p.image AND d.x=p.x AND d.y=p.y+1),
 v AS (SELECT image, {r('sum(lap*lap)/count(*) - (sum(lap)/count(*))*(sum(lap)/count(*))', 4)} AS sharpness FROM nb GROUP BY 1)
 SELECT image, sharpness, CASE WHEN sharpness < 45 THEN 'error' WHEN sharpness < 110 THEN 'warn' ELSE 'ok' END AS status FROM v"""))
def z9(spark, sf):
    return P.sharpness(pixels(spark, sf))


C_FRAME = f"""fr0 AS (SELECT image, avg(CAST(mask AS INT)) AS cov, avg(x) FILTER (mask) AS mx, avg(y) FILTER (mask) AS my, min(x) FILTER (mask) AS x0, max(x) FILTER (mask) AS x1, min(y) FILTER (mask) AS y0, max(y) FILTER (mask) AS y1 FROM px GROUP BY 1),
fr AS (SELECT *, {r('sqrt((mx/8-0.5)*(mx/8-0.5) + (my/8-0.5)*(my/8-0.5))')} AS offset_, (x0 <= 1 OR x1 >= 6 OR y0 <= 1 OR y1 >= 6) AS border FROM fr0)"""


@query("z10_framing", with_([C_PX, C_FRAME], f"""SELECT image, {r('cov')} AS coverage, CASE WHEN mx IS NOT NULL AND cov >= 0.05 THEN offset_ END AS "offset",
  CASE WHEN mx IS NULL OR cov < 0.05 THEN 'error' WHEN offset_ > 0.12 OR cov < 0.12 OR (border AND cov > 0.45) THEN 'warn' ELSE 'ok' END AS status,
  CASE WHEN mx IS NULL OR cov < 0.05 THEN 'nothing detected' ELSE array_to_string(list_filter([CASE WHEN offset_ > 0.12 THEN 'center' END, CASE WHEN cov < 0.12 THEN 'closer' END, CASE WHEN border AND cov > 0.45 THEN 'back' END], lambda m: m IS NOT NULL), ', ') END AS message,
  (mx IS NOT NULL AND cov >= 0.12) AS reliable FROM fr"""))
def z10(spark, sf):
    return P.framing(pixels(spark, sf), (0.5, 0.5), 8, 8)


def gain_sql(c: str) -> str:
    g = f"(1.0::DOUBLE + 0.35::DOUBLE*(i_{c}/((i_c0+i_c1+i_c2)/3 + 1e-6) - 1.0::DOUBLE))"
    return "CAST(floor(" + r(f"least(255.0::DOUBLE, greatest(0.0::DOUBLE, {c}/{g}))") + f") AS BIGINT) AS {c}"


@query("z11_illuminant_gain", with_([C_PX], f""", il AS (SELECT image, pow(avg(pow(c0::DOUBLE, 6)), 1.0::DOUBLE/6) AS i_c0, pow(avg(pow(c1::DOUBLE, 6)), 1.0::DOUBLE/6) AS i_c1, pow(avg(pow(c2::DOUBLE, 6)), 1.0::DOUBLE/6) AS i_c2 FROM px GROUP BY 1)
 SELECT image, x, y, {gain_sql('c0')}, {gain_sql('c1')}, {gain_sql('c2')} FROM px JOIN il USING (image)"""))
def z11(spark, sf):
    return P.illuminant_gain(pixels(spark, sf).select("image", "x", "y", "c0", "c1", "c2"))


@query("z12_masked_pool", with_([C_PX], f"SELECT image, {r('sum(v*CAST(mask AS INT))/greatest(sum(CAST(mask AS INT)), 1)')} AS masked, {r('sum(v)/count(*)')} AS pooled FROM px GROUP BY 1"))
def z12(spark, sf):
    return P.masked_pool(pixels(spark, sf))


C_DICE = """dc AS (SELECT image, label % 2 AS src, count(*) FILTER (mask AND gold) AS tp, count(*) FILTER (mask AND NOT gold) AS fp, count(*) FILTER (NOT mask AND gold) AS fn FROM px GROUP BY 1, 2),
dd AS (SELECT *, 2*tp/(2*tp+fp+fn+1e-6) AS dice, tp/(tp+fp+fn+1e-6) AS iou FROM dc)"""


@query("a22_dice", with_([C_PX, C_DICE], f"SELECT CAST(src AS INT) AS src, count(*) AS n, {r('avg(dice)')} AS mean_dice, {r('avg(iou)')} AS mean_iou, {r('avg(CAST(dice < 0.9 AS INT))')} AS low_share, {r('2*sum(tp)/(2*sum(tp)+sum(fp)+sum(fn)+1e-6)')} AS pooled_dice FROM dd GROUP BY 1"))
def a22(spark, sf):
    # The image's source domain is a function of the image, so it rides along in the image key.
    px = pixels(spark, sf).withColumn("src", F.col("label") % 2).withColumn("image", F.struct("image", "src"))
    return P.dice_summary(P.dice_per_image(px).withColumn("src", F.col("image.src")), ["src"])


@query("pr8_quality_gate", with_([C_PX, C_FRAME], f"""SELECT image, {r('cov')} AS coverage, cov >= 0.40 AND cov <= 0.60 AS accepted, CASE WHEN cov < 0.40 THEN 'not detected or too small' WHEN cov > 0.60 THEN 'implausibly large' ELSE '' END AS reasons FROM fr"""))
def pr8(spark, sf):
    c = pixels(spark, sf).groupBy("image").agg((F.sum(F.col("mask").cast("int")) / F.count("*")).alias("cov"))
    return G.quality_gate(c, F.col("cov"), 0.40, 0.60).select("image", S.rnd(F.col("cov"), 6).alias("coverage"), "accepted", F.array_join("reasons", "; ").alias("reasons"))


@query("pr9_escalate", with_([C_PX, C_FRAME], f""", e AS (SELECT image, avg(c0) AS m FROM px WHERE mask GROUP BY 1),
 s AS (SELECT f.image, CASE WHEN m < 150 THEN 'error' WHEN m < 180 THEN 'warn' ELSE 'ok' END AS light, CASE WHEN cov < 0.45 THEN 'warn' ELSE 'ok' END AS size_, CASE WHEN offset_ > 0.12 THEN 'warn' ELSE 'ok' END AS place FROM fr f JOIN e USING (image))
 SELECT image, CASE WHEN light = 'error' THEN 'error' WHEN light = 'warn' OR size_ = 'warn' OR place = 'warn' THEN 'warn' ELSE 'ok' END AS status,
 array_to_string(list_filter([CASE WHEN light <> 'ok' THEN 'light' END, CASE WHEN size_ <> 'ok' THEN 'closer' END, CASE WHEN place <> 'ok' THEN 'center' END], lambda m: m IS NOT NULL), '; ') AS message FROM s"""))
def pr9(spark, sf):
    on = F.col("mask")
    g = pixels(spark, sf).groupBy("image").agg(
        F.avg(F.when(on, F.col("c0"))).alias("m"), (F.sum(on.cast("int")) / F.count("*")).alias("cov"), F.avg(F.when(on, F.col("x"))).alias("mx"), F.avg(F.when(on, F.col("y"))).alias("my")
    )
    dx, dy = F.col("mx") / 8 - 0.5, F.col("my") / 8 - 0.5
    status, msg = G.escalate(
        [
            (F.when(F.col("m") < 150, "error").when(F.col("m") < 180, "warn").otherwise("ok"), "light"),
            (F.when(F.col("cov") < 0.45, "warn").otherwise("ok"), "closer"),
            (F.when(S.rnd(F.sqrt(dx * dx + dy * dy), 6) > 0.12, "warn").otherwise("ok"), "center"),
        ]
    )
    return g.select("image", status.alias("status"), msg.alias("message"))


@query("pr21_multi_label_rows", """SELECT vec_id, array_to_string(list_transform(embedding, lambda x: CAST(x > 0.1 AS INT)), '') AS targets, CASE WHEN label < 5 THEN label/10.0::DOUBLE ELSE 1.0 END AS mask_share FROM embeddings WHERE label <> 3""")
def pr21(spark, sf):
    e = table(spark, sf, "embeddings")
    masks = e.filter("label < 5").select("vec_id", (F.col("label") / 10.0).alias("m"))
    vec = F.transform("embedding", lambda x: (x > 0.1).cast("int").cast("string"))
    rows = e.filter("label <> 3").select("vec_id", F.array_join(vec, "").alias("targets"))
    return rows.join(masks, "vec_id", "left").select("vec_id", "targets", F.coalesce("m", F.lit(1.0)).alias("mask_share"))


NAMES = [f"s{i}" for i in range(64)]


@query("f16_softmax_score", f"""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: exp(x::DOUBLE*8 - list_max(embedding)::DOUBLE*8)) AS e FROM embeddings),
 p AS (SELECT vec_id, list_transform(e, lambda x: x/list_sum(e)) AS p FROM e)
 SELECT vec_id, 's' || (list_position(p, list_max(p))-1) AS value, {r('list_max(p)')} AS confidence, {r('list_sum(list_transform(range(1, 65), lambda i: (i-1)*p[i]))/63.0::DOUBLE')} AS severity FROM p""")
def f16(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") * 8).alias("z"))
    return G.softmax_score(e, "z", NAMES).select("vec_id", "value", S.rnd(F.col("confidence"), 6).alias("confidence"), S.rnd(F.col("severity"), 6).alias("severity"))


@query("f17_sigmoid_score", f"""SELECT vec_id, 's' || (i-1) AS feature, CASE WHEN 1.0/(1.0+exp(-(embedding[i]::DOUBLE))) > 0.5 THEN 'present' ELSE 'absent' END AS value, {r('1.0/(1.0+exp(-(embedding[i]::DOUBLE)))')} AS severity FROM embeddings, range(1, 65) t(i)""")
def f17(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("z"))
    return G.sigmoid_score(e, "z", NAMES).select("vec_id", "feature", "value", S.rnd(F.col("severity"), 6).alias("severity"))


# Three logits per vector (sums over its parts), gold = label mod 3, val / test by hash.
C_LOG = """lg AS (SELECT vec_id, label % 3 AS gold, list_transform([[1, 21], [22, 42], [43, 64]], lambda b: floor(list_sum(list_transform(embedding[b[1]:b[2]], lambda x: x::DOUBLE*10))*1e9+0.5)/1e9) AS z, substr(md5('3|' || vec_id), 1, 1) < '8' AS val FROM embeddings),
pr AS (SELECT ln(count(*) FILTER (gold = 0)/count(*)) AS l0, ln(count(*) FILTER (gold = 1)/count(*)) AS l1, ln(count(*) FILTER (gold = 2)/count(*)) AS l2 FROM lg),
taus AS (SELECT i/10.0::DOUBLE AS tau FROM range(0, 31) t(i))"""
_ADJ = [r(f"z[{i + 1}] - tau*l{i}", 9) for i in range(3)]
C_TAU = f"""pd AS (SELECT tau, gold, val, list_position([a0, a1, a2], greatest(a0, a1, a2))-1 AS pred FROM (SELECT tau, gold, val, {_ADJ[0]} AS a0, {_ADJ[1]} AS a1, {_ADJ[2]} AS a2 FROM lg, pr, taus)),
cf AS (SELECT tau, val, c, count(*) FILTER (gold = c AND pred = c) AS tp, count(*) FILTER (gold = c) AS g, count(*) FILTER (pred = c) AS p FROM pd, range(0, 3) k(c) GROUP BY 1, 2, 3),
rare AS (SELECT gold AS c FROM lg GROUP BY 1 ORDER BY count(*), 1 LIMIT 1),
mf AS (SELECT tau, val, {r('avg(coalesce(2*tp/nullif(g+p, 0), 0.0))', 9)} AS f, {r('max(CASE WHEN c = (SELECT c FROM rare) THEN coalesce(tp/nullif(g, 0), 0.0) END)')} AS mr FROM cf GROUP BY 1, 2),
bt AS (SELECT tau FROM mf WHERE val ORDER BY f DESC, tau LIMIT 1)"""


@query("a21_fit_tau", with_([C_LOG, C_TAU], """SELECT CASE WHEN z.val THEN 'val' ELSE 'test' END AS split, b.tau, z.f AS base_f1, b.f AS best_f1, z.mr AS base_recall, b.mr AS best_recall FROM mf z JOIN mf b ON b.val = z.val AND b.tau = (SELECT tau FROM bt) WHERE z.tau = 0"""))
def a21(spark, sf):
    e = table(spark, sf, "embeddings")
    part = lambda a, n: S.rnd(F.aggregate(F.slice("embedding", a, n), F.lit(0.0), lambda s, x: s + x.cast("double") * 10), 9)
    z = F.array(part(1, 21), part(22, 21), part(43, 22))
    val = F.substring(F.md5(F.concat_ws("|", F.lit("3"), F.col("vec_id").cast("string"))), 1, 1) < "8"
    lg = e.select((F.col("label") % 3).alias("gold"), z.alias("logits"), F.when(val, "val").otherwise("test").alias("split"))
    n = {x["gold"]: x["n"] for x in lg.groupBy("gold").agg(F.count("*").alias("n")).collect()}  # three classes
    total = sum(n.values())
    log_prior = [math.log(max(n.get(k, 0) / total, 1e-6)) for k in range(3)]
    rare = min(range(3), key=lambda k: (n.get(k, 0), k))
    s = cut(E.tau_scores(E.tau_confusion(lg, log_prior), 3, rare))
    return E.tau_report(s, E.fit_tau(s))


HEADS = [[round(((h * 7 + i * 3) % 11 - 5) / 5, 1) for i in range(64)] for h in range(3)]


@query("ml1_score_heads", f"""WITH w(head, w) AS (VALUES {", ".join(f"({h}, {HEADS[h]}::DOUBLE[])" for h in range(3))}),
 d AS (SELECT vec_id, head, list_sum(list_transform(range(1, 65), lambda i: embedding[i]::DOUBLE*w[i])) AS z FROM embeddings, w),
 g AS (SELECT vec_id, max(z) FILTER (head = 0) AS z0, max(z) FILTER (head = 1) AS z1, max(z) FILTER (head = 2) AS z2 FROM d GROUP BY 1),
 x AS (SELECT vec_id, [exp(z0-greatest(z0,z1,z2)), exp(z1-greatest(z0,z1,z2)), exp(z2-greatest(z0,z1,z2))] AS e FROM g)
 SELECT vec_id, 'h' || (list_position(e, list_max(e))-1) AS value, {r('list_max(e)/list_sum(e)')} AS confidence, {r('(e[2]+2*e[3])/list_sum(e)/2')} AS severity FROM x""")
def ml1(spark, sf):
    from sigweave.operators.training import score_heads

    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    z = score_heads(e, "embedding", HEADS)
    return G.softmax_score(z, "logits", ["h0", "h1", "h2"]).select("vec_id", "value", S.rnd(F.col("confidence"), 6).alias("confidence"), S.rnd(F.col("severity"), 6).alias("severity"))


C_HEADROWS = """hr0 AS (SELECT vec_id, CAST(label % 3 AS INT) AS target, embedding, CASE WHEN substr(md5('9|' || vec_id), 1, 1) < '4' THEN 'val' ELSE 'train' END AS split, CASE WHEN vec_id % 2 = 0 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS base FROM embeddings),
cw0 AS (SELECT target, 1.0::DOUBLE/sqrt(count(*)::DOUBLE) AS raw FROM hr0 WHERE split = 'train' GROUP BY 1),
cw AS (SELECT target, least(4.0::DOUBLE, greatest(0.5::DOUBLE, raw/(SELECT avg(raw) FROM cw0))) AS cw FROM cw0),
hr AS (SELECT h.*, base*cw AS weight FROM hr0 h JOIN cw USING (target))"""


def head_rows(spark, sf) -> DataFrame:
    """Vectors with target, split, and weight: source weight times class weight."""
    from sigweave.operators.sampling import class_weights

    e = table(spark, sf, "embeddings").select("vec_id", (F.col("label") % 3).cast("int").alias("target"), "embedding")
    h = F.substring(F.md5(F.concat_ws("|", F.lit("9"), F.col("vec_id").cast("string"))), 1, 1)
    e = e.withColumn("split", F.when(h < "4", "val").otherwise("train")).withColumn("base", F.when(F.col("vec_id") % 2 == 0, 2.0).otherwise(1.0))
    n = e.filter("split = 'train'").groupBy("target").agg(F.count("*").alias("n"))  # a row per class
    w = class_weights(n.select(F.lit("head").alias("feature"), F.col("target").alias("value"), "n"), "sqrt")
    return e.join(F.broadcast(w.select(F.col("value").alias("target"), F.col("weight").alias("cw"))), "target").withColumn("weight", F.col("base") * F.col("cw"))


@query("ml2_train_head", with_([C_HEADROWS], f"""SELECT CAST(c AS INT) AS class, CAST(i - 1 AS INT) AS component, {r('sum(CASE WHEN target = c THEN weight*CASE WHEN i = 65 THEN 1.0::DOUBLE ELSE embedding[i]::DOUBLE END ELSE 0.0::DOUBLE END)/sum(weight)', 7)} AS moment
  FROM hr, range(0, 3) a(c), range(1, 66) b(i) WHERE split = 'train' GROUP BY c, i"""))
def ml2(spark, sf):
    """The moments of the trained head over the training rows. They equal those of the targets only where the gradient of
    the loss is zero; these the SQL takes from the data alone."""
    from sigweave.operators.training import moments, train_head

    e = cut(head_rows(spark, sf))
    heads, reg = train_head(e, "embedding", "target", "weight", [0.001, 0.01, 0.1], 3)
    m = moments(heads, e.filter("split = 'train'"), "embedding", "weight", reg)
    return m.select("class", "component", S.rnd(F.col("moment"), 7).alias("moment"))
