"""Streaming queries over `events`, and round trips through the file formats."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigweave.functions import scores as S
from sigweave.plans import kb
from sigweave.plans import labelling as LB
from sigweave.plans.base import query, r, with_
from sigweave.session import scratch, table
from sigweave.sources import files as FS
from sigweave.streaming import scoring as ST


def events(spark, sf):
    return ST.event_stream(spark, f"{sf}/events*.parquet")


@query("st1_stream_score", with_([kb.VOTES.cte()], f"""SELECT event_id, user_id, outcome, {r('weight*least(1.0::DOUBLE, e.value/100.0::DOUBLE)')} AS weight FROM events e JOIN votes v ON v.feature = e.event_type AND v.value = 'present' WHERE e.value >= 5 AND e.value <= 400"""))
def st1(spark, sf):
    votes = kb.VOTES.small(spark).filter("value = 'present'")
    sev = F.least(F.lit(1.0), F.col("value") / F.lit(100.0))
    return ST.stream_score(events(spark, sf), votes, F.col("value").between(5, 400), F.col("event_type"), sev)


@query("st2_stream_refine", f"""WITH w AS (SELECT time_bucket(INTERVAL '1 day', ts, TIMESTAMP '1970-01-01') AS start, user_id AS entity, event_type AS outcome, count(*) AS n, sum(CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END*floor(value+0.5)) AS u FROM events GROUP BY 1, 2, 3),
  c AS (SELECT start, entity, outcome, sum(n) OVER k AS n_answers, sum(u) OVER k/1000.0::DOUBLE AS ev FROM w WINDOW k AS (PARTITION BY entity, outcome ORDER BY start))
  SELECT start, entity, outcome, n_answers, {r('1.0::DOUBLE/(1.0::DOUBLE+exp(-(ln(0.3::DOUBLE/(1.0::DOUBLE-0.3::DOUBLE)) + 1.4::DOUBLE*ev)))')} AS confidence FROM c""")
def st2(spark, sf):
    """Confidence of every (entity, outcome) after each of its days, sessions that end after three idle days included."""
    e = events(spark, sf)
    units = F.floor(F.col("value") + F.lit(0.5))
    a = e.select("ts", F.col("user_id").alias("entity"), F.col("event_type").alias("outcome"), F.when(F.col("event_id") % 2 == 0, units).otherwise(-units).alias("units"))
    d = ST.stream_refine_days(a, 0.3, idle="3 days")
    return d.withColumn("start", ST.utc_wall(F.col("start")))


@query("st3_stream_trend", f"""WITH w AS (SELECT time_bucket(INTERVAL '7 days', ts, TIMESTAMP '1970-01-01') AS s, user_id, event_type, count(*) AS n, sum(floor(value*100+0.5)) AS c FROM events GROUP BY 1, 2, 3)
  SELECT s AS start, s + INTERVAL '7 days' AS stop, user_id, event_type, n, {r('c/n', 4)} AS mean_cents, s + INTERVAL '7 days' <= (SELECT max(ts) FROM events) - INTERVAL '1 day' AS closed FROM w""")
def st3(spark, sf):
    t = ST.stream_trend(events(spark, sf), "value").drop("late_n")
    return t.withColumn("start", ST.utc_wall(F.col("start"))).withColumn("stop", ST.utc_wall(F.col("stop")))


# ---- file formats: the table goes out and comes back through the reader under test --------------


@query("src2_read_tsv", "SELECT n_nationkey AS sid, CASE WHEN n_nationkey % 3 = 0 THEN NULL WHEN n_nationkey % 3 = 1 THEN 'None' ELSE n_name END AS label, CASE WHEN n_nationkey % 5 <> 0 THEN n_regionkey*1.5::DOUBLE END AS x FROM nation")
def src2(spark, sf):
    n = table(spark, sf, "nation")
    k = F.col("n_nationkey")
    raw = n.select(k.cast("string").alias("sid"), F.when(k % 3 == 0, "NA").when(k % 3 == 1, "None").otherwise(F.col("n_name")).alias("label"), F.when(k % 5 != 0, (F.col("n_regionkey") * 1.5).cast("string")).otherwise("NA").alias("x"))
    out = scratch(spark, "tsv")
    raw.write.options(sep="\t", header=True).csv(out)
    schema = T.StructType([T.StructField("sid", T.IntegerType()), T.StructField("label", T.StringType()), T.StructField("x", T.DoubleType())])
    return FS.read_tsv(spark, out, schema)


@query("src3_manifest_io", with_([LB.C_MAN], "SELECT doc_id, source, lang, quality, grade_manual FROM man"))
def src3(spark, sf):
    out = scratch(spark, "manifest")
    cols = LB.manifest(spark, sf).select("doc_id", "source", "lang", "quality", "grade_manual")
    FS.write_manifest_csv(cols, out)
    return FS.read_manifest(spark, out, cols.schema)


@query("src6_corpus_io", "SELECT CAST(doc_id AS VARCHAR) AS id, md5(text) AS h, source, lang FROM documents")
def src6(spark, sf):
    d = table(spark, sf, "documents")
    rows = d.select(
        F.col("doc_id").cast("string").alias("id"), "text", "source", F.array("source").alias("source_keys"), F.lit("own").alias("license"), F.lit("authored-summary").alias("usage"), "lang", F.lit("card").alias("type"), F.array().cast("array<string>").alias("tags")
    )
    out = scratch(spark, "corpus")
    FS.write_corpus(rows, out)
    return FS.read_corpus(spark, out).select("id", F.md5("text").alias("h"), "source", "lang")


@query("src8_read_shards", "SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, role, CASE WHEN conv_id % 2 = 0 THEN 'even' ELSE 'odd' END AS shard FROM conversations")
def src8(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", "role")
    out = scratch(spark, "shards")
    for name, bit in (("even", 0), ("odd", 1)):
        c.filter(F.col("conv_id") % 2 == bit).write.json(f"{out}/{name}")
    schema = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType())])
    d = FS.read_shards(spark, [f"{out}/missing_*", f"{out}/*"], schema)
    return d.select("conv_id", "turn", "role", F.col("shard_dir").alias("shard"))


@query("src10_write_eval", with_(LB.P_PAIRS, f"SELECT 'rows' AS part, feature, count(*) AS n, {r('avg(CAST(pred = gold AS INT))')} AS accuracy FROM pairs GROUP BY 2 UNION ALL SELECT 'summary', 'ALL', count(*), {r('avg(CAST(pred = gold AS INT))')} FROM pairs"))
def src10(spark, sf):
    p = LB.pairs(spark, sf)
    acc = S.rnd(F.avg((F.col("pred") == F.col("gold")).cast("int")), 6).alias("accuracy")
    out = scratch(spark, "eval")
    FS.write_eval(p.agg(F.lit("ALL").alias("feature"), F.count("*").alias("n"), acc), p.groupBy("feature").agg(F.count("*").alias("n"), acc), out)
    schema = "feature string, n bigint, accuracy double"
    read = lambda k: spark.read.schema(schema).json(f"{out}/{k}").withColumn("part", F.lit(k))
    return read("rows").unionByName(read("summary"))


@query("src11_vector_files", "SELECT vec_id, label, embedding, vec_id % 3 = 0 AS again FROM embeddings")
def src11(spark, sf):
    """Vectors and their metadata go out as matrix files in two writes and come back by row ranges."""
    from sigweave.sources.vectors import VectorFiles

    spark.dataSource.register(VectorFiles)
    e = table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<float>").alias("embedding"), (F.col("vec_id") % 3 == 0).alias("again"))
    out = scratch(spark, "vectors")
    for again, mode in ((False, "overwrite"), (True, "append")):
        e.filter(F.col("again") == again).repartition(3, "vec_id").write.format("vector_files").mode(mode).save(out)
    return spark.read.format("vector_files").schema(e.schema).option("rows", 100).load(out)
