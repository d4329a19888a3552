"""Registered queries of the training-data operators: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, hnsw, htmltext, langid, lattice, lexical, neardup, packing, pii, secrets, sharding, suffixdedup, whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spread(df: DataFrame) -> DataFrame:
    """A table read in fewer tasks than there are cores, dealt over all of them; larger tables as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _spread(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


def op2_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents")).drop("text_hash")


def op3_stratified_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, sf_dir, "documents"), 16)


def op4_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = _spread(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return bpe.round_trip(docs, path, public_tokenizers.PATTERN)


def op5_lattice_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan_versions(_table(spark, sf_dir, "documents").select("doc_id", "text")))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.removal_digest(_table(spark, sf_dir, "documents"))


def op8_hnsw_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    index = hnsw.build_index(vectors)
    return hnsw.nearest(index, vectors.filter(F.col("vec_id") % 100 == 0))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _spread(_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")).withColumn("held_out", langid.held_out())
    model = langid.train(docs.filter(~F.col("held_out")))
    return langid.predict(docs.select("doc_id", "text", "held_out"), model).drop("text")


def op10_consensus_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = htmltext.extract(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return text.withColumn("n_chars", F.length("text").cast("long"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_personal_data(_spread(_table(spark, sf_dir, "documents").select("doc_id", "text"))))


QUERIES = {
    f.__name__: f
    for f in (
        op1_best_fit_packing,
        op2_order_minhash,
        op3_stratified_sharding,
        op4_bpe_round_trip,
        op5_lattice_dedup,
        op6_secret_scan,
        op7_suffix_dedup,
        op8_hnsw_neighbours,
        op9_language_id,
        op10_consensus_html,
        op11_whitening,
        op12_lexical_search,
        op13_personal_data,
    )
}

ORACLES: dict[str, str] = {"op12_lexical_search": lexical.ORACLE}
