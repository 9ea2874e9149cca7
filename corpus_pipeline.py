"""A corpus through four stages: toxicity, near-duplicates, personal data, packing.

Each stage takes all documents that the one before it kept and its decisions take effect; all but the last
return the columns of `documents`.  SQL can express none of the stages (a trained model,
similar shingle sets with components, keyed surrogates, a tokenizer), so ORACLE_SQL is None.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickspark.llm import packing, pii_surrogates, shingle_copies, toxicity
from tickspark.llm._common import clear_scratch, materialise, scratch_mark
from tickspark.llm.queries import KEY, byte_bpe

ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the rows that the severity model rejects; null and empty texts are never rejected, repeated rows share their fate."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.add_severity(docs, toxicity.fit(docs, labels), keep="clean")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row with the smallest id of each group of texts with at least 0.8 of their five-word shingles in common.

    Groups of op10 (SimHash, Golay keys, four bits) come first, each link checked by the exact similarity; bands give copies further apart.
    Decided by row: different texts under one id both stay, exact repeats of a row do not; texts without words
    (null, empty, white space) are one group; a null id stands after all others.
    """
    return shingle_copies.drop_near_copies(docs, words=5, similarity=0.8, fingerprint_words=4)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts surrogates for personal data into the texts; n_chars follows (null for a null text).  Every row stays."""
    new = pii_surrogates.pseudonymise(docs, KEY)
    return new.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places every row in sequences of 1024 tokens; a null text is that of an empty one, a long one gives several pieces."""
    return packing.pack(packing.pieces(docs, byte_bpe()))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", replace_personal_data),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage is written before the next one reads it, and what it left behind on its way is removed."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before = scratch_mark()
        out = stage(spark, docs, sf_dir)
        own = scratch_mark()
        docs = materialise(out, f"stage-{name}")
        clear_scratch(spark, before, own)
    return STAGES[-1][1](spark, docs, sf_dir)
