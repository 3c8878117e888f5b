"""Readers and writers for the reference formats. Schemas are explicit, never inferred."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigweave.functions.text import basename, stem


def scan_files(spark: SparkSession, glob: str, fmt: str = "binaryFile") -> DataFrame:
    """File inventory: (stem, path). File content is not read (column pruning)."""
    d = spark.read.format(fmt).option("recursiveFileLookup", "true").load(glob)
    path = F.col("path") if fmt == "binaryFile" else F.col("_metadata.file_path")
    return d.select(stem(path).alias("stem"), path.alias("path"))


def pair_files(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left inventory with the sibling path of the same stem and whether it exists."""
    r = right.select("stem", F.col("path").alias("pair_path"))
    return left.join(r, "stem", "left").withColumn("has_pair", F.col("pair_path").isNotNull())


def read_tsv(spark: SparkSession, path: str, schema: T.StructType, na: Sequence[str] = ("NA", "")) -> DataFrame:
    """Tab-separated table with an explicit missing-value list; a literal `None` stays a class.

    Columns are read as text, missing markers become NULL, then the declared types are cast.
    """
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema])
    d = spark.read.schema(text).options(sep="\t", header=True, nullValue="\u0000").csv(path)
    return d.select(*[F.when(~F.coalesce(F.col(f.name), F.lit("")).isin(list(na)), F.col(f.name)).cast(f.dataType).alias(f.name) for f in schema])


def read_manifest(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def write_manifest(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Columnar manifest, partitioned so that split or source filters prune files."""
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def write_manifest_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def parse_boxes(lines: DataFrame, text: str, keep: Sequence[str]) -> DataFrame:
    """Detection lines `class cx cy w h` to class ids; blank lines drop, `3.0` is class 3, no number is NULL."""
    tok = F.split(F.trim(F.col(text)), r"\s+")
    return lines.filter(F.trim(F.col(text)) != "").select(*keep, tok[0].try_cast("double").try_cast("int").alias("class_id"))


def read_boxes(spark: SparkSession, path: str) -> DataFrame:
    """(path, class_id) per annotation line of a directory of text files."""
    d = spark.read.option("recursiveFileLookup", "true").text(path).select("value", F.col("_metadata.file_path").alias("path"))
    return parse_boxes(d, "value", ["path"])


def unnest_label_json(df: DataFrame, col: str, keep: Sequence[str] = ()) -> DataFrame:
    """JSON text `{id: {feature: value}}` to (id, feature, value); ids starting with `_` are comments."""
    m = F.from_json(F.col(col), "map<string,map<string,string>>")
    outer = df.select(*keep, F.explode(m).alias("id", "f")).filter(~F.col("id").startswith("_"))
    return outer.select(*keep, "id", F.explode("f").alias("feature", "value"))


CORPUS = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("source_keys", T.ArrayType(T.StringType())),
        T.StructField("license", T.StringType()),
        T.StructField("usage", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
    ]
)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CORPUS).json(path)


def write_corpus(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_shards(spark: SparkSession, globs: Sequence[str], schema: T.StructType) -> DataFrame:
    """Sharded JSON artefacts tagged with their file; the first glob that matches wins."""
    for g in globs:
        try:
            d = spark.read.schema(schema).json(g)
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" in str(e):
                continue
            raise
        path = F.col("_metadata.file_path")
        return d.withColumn("shard", basename(path)).withColumn("shard_dir", F.element_at(F.split(path, "/"), -2))
    raise FileNotFoundError(f"no shard matches any of {list(globs)}")


def incremental(new: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Resume: keep what is done, append only rows whose key is not there yet."""
    return done.unionByName(new.join(done.select(*keys), list(keys), "left_anti"))


def write_eval(summary: DataFrame, rows: DataFrame, path: str) -> None:
    """One-row summary and per-row results side by side."""
    summary.write.mode("overwrite").json(f"{path}/summary")
    rows.write.mode("overwrite").json(f"{path}/rows")
