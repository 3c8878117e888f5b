"""The corpus pipeline: stages over `documents`, each written as Parquet and read again by the next.

Quality classifier (rejected documents go), n-gram Jaccard join (one document of each group stays), suffix-array
removal of repeated strings, masking of personal data, packing into token sequences.

Defined results: null texts stay null through the filters and are one end id in the sequences; null and repeated ids, empty
and repeated rows are handled as each stage's operator states it (rows with a null id are in no near-duplicate class and
stay; rows that repeat an id and a text with words stay once); an empty table gives an empty one; columns beside doc_id and
text come through all stages but the last, whatever their names; `n_chars` is kept true where it is there.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from sigweave.llm import jaccard_join, packing, pii, quality, suffix_dedup
from sigweave.session import release, scratch, share_package, table

#: no SQL form: a trained classifier and tagger, byte-level repeats and a packing plan; tests/llm compares with brute force
ORACLE_SQL = None
#: documents whose score is below it are rejected
QUALITY = 0.3


def _counted(docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def _unused(docs: DataFrame, name: str) -> str:
    """A column name that the table does not have, in any case of letters."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    release(spark)
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    score = _unused(docs, "score")
    return quality.with_score(docs, model, score).where(F.col(score) >= QUALITY).drop(score)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    release(spark)
    return jaccard_join.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 100 bytes that an earlier place has."""
    release(spark)
    return _counted(suffix_dedup.remove_repeats(docs))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind."""
    release(spark)
    return _counted(pii.mask_pii(docs, pii.fit_tagger(docs)))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the tokenised documents with their places in sequences."""
    release(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", keep_one_of_each),
    ("repeats", cut_repeats),
    ("personal_data", mask_personal_data),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in their order, from the documents of a folder."""
    share_package(spark)
    docs = table(spark, sf_dir, "documents")
    base = scratch(spark, "pipeline")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return docs
