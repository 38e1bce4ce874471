"""The registered queries of this subpackage: each applies its operator to the whole of ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op2_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm.tokens import pack_tokens

    return pack_tokens(table(spark, sf_dir, "documents"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm.language import predict, remainder, train

    rest = remainder(F.col("doc_id"), 5)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs.filter(rest != 0))
    return predict(docs.select("doc_id", F.coalesce(rest == 0, F.lit(False)).alias("held_out"), "text"), model).drop("text")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm.packing import pack_blocks

    return pack_blocks(table(spark, sf_dir, "documents"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm.licenses import scan

    return scan(table(spark, sf_dir, "documents"))


def op6_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm.neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85).select("doc_id", "n_shingles", "component_id", "kept")


def op7_transport(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm.transport import store_digests

    return store_digests(table(spark, sf_dir, "documents"))


def op8_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm.shards import shard

    placed = shard(table(spark, sf_dir, "documents"), 16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm.language import remainder
    from siltstone.llm.toxicity import score, train

    rest = remainder(F.col("doc_id"), 4)
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = train(docs.filter(rest != 2), labels.filter(rest != 2))
    return score(docs.select("doc_id", F.coalesce(rest == 2, F.lit(False)).alias("held_out"), "text"), model).drop("text")


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm.fingerprints import edited_pairs

    return edited_pairs(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_mixing, op2_tokens, op3_language, op4_packing, op5_licenses, op6_neardup, op7_transport, op8_shards, op9_toxicity, op10_fingerprints)}
