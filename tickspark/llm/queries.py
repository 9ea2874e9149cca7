"""Queries over the given tables, one for each operator of this subpackage, and their SQL where there is any."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collision_search, fill_in_middle, huffman_ids, lattice_score, lexical_index, oracle, packing, pii_surrogates, progressive_jpeg, quality_pu
from . import simhash_dedup, sp_tokens, toxicity, wordpiece_counts
from ._common import documents, materialise, shared_dir

#: The secret of the surrogates; a user gives their own.
KEY = "tickspark surrogates"


def byte_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def sp_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_collision_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return collision_search.nearest(vectors, F.col("vec_id") % 20 == 0, k=20)


def op2_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = materialise(progressive_jpeg.store(documents(spark, sf_dir)), "media")
    return progressive_jpeg.read_media(stored)


def op3_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.add_severity(docs.select("doc_id", "text"), model)
    return scored.selectExpr("doc_id", "round(p_toxic, 6) p_toxic", "round(expected_severity, 6) expected_severity", "rejected")


def op4_wordpiece_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece_counts.token_counts(documents(spark, sf_dir), sp_model())


def op5_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_surrogates.pseudonymise(documents(spark, sf_dir, "doc_id", "text"), KEY, details=True)


def op6_lattice_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_score.score(documents(spark, sf_dir), sp_model(), rounds=1)


def op7_swap_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(documents(spark, sf_dir), byte_bpe()))


def op8_huffman_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/tickspark/ids-{uuid.uuid4().hex}"
    huffman_ids.write_ids(documents(spark, sf_dir), byte_bpe(), path)
    return huffman_ids.read_ids(spark, path)


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp_tokens.encode_documents(documents(spark, sf_dir), sp_model())


def op10_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash_dedup.near_duplicate_groups(documents(spark, sf_dir))
    return groups.selectExpr("id doc_id", "lpad(lower(hex(fp)), 16, '0') fingerprint", "component_id")


def op11_lexical_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = lexical_index.build(documents(spark, sf_dir, "doc_id", "text"))
    return lexical_index.search(index, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), k=10)


def op12_quality_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_pu.classify(documents(spark, sf_dir, "doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fill_in_middle.transform(documents(spark, sf_dir, "doc_id", "text"))
    digests = {"output_sha256": F.sha2("output", 256), "restored_sha256": F.sha2(fill_in_middle.restored(), 256)}
    return rows.withColumns(digests).drop("text", "output")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        op1_collision_counting, op2_progressive_jpeg, op3_ordinal_toxicity, op4_wordpiece_counts, op5_pii_surrogates,
        op6_lattice_likelihood, op7_swap_packing, op8_huffman_ids, op9_sentencepiece, op10_simhash_golay,
        op11_lexical_strata, op12_quality_pu, op13_fill_in_middle,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op11_lexical_strata": oracle.LEXICAL, "op13_fill_in_middle": oracle.FILL_IN_MIDDLE}
