"""The corpus pipeline: language ID, near-duplicates, repeated passages, secrets, packing.

Each stage takes all documents that its predecessor kept and returns documents
again (the last returns packed pieces). ``run`` applies them in order, writing
each result as Parquet in the shared folder before the next stage reads it; a
stage's table is dropped once the next one is written.

Every stage passes extra columns through, whatever their names, and gives an empty
table for an empty one. A null or empty text has no language and goes in the first
stage; the later ones keep it as it is (an empty text is packed as its end token). Of
equal rows, and of documents that tie as near copies, the one of the smallest id stays.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duskline.llm import langid, neardup, packing, secrets, suffixdedup
from duskline.llm.common import discard, materialize

#: Documents of which a smaller share of n-grams belongs to any one language are rejected as junk.
MIN_LANGUAGE_SCORE = 0.2
#: Repeated strings of so many words are cut.
PASSAGE_WORDS = 51


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose text is in a learned language; ``lang`` stays as it came."""
    model = langid.train(docs.filter(~langid.held_out()))
    decided = langid.predict(docs, model)
    good = (F.col("lang_pred") != langid.UND) & (F.col("score") >= MIN_LANGUAGE_SCORE)
    return decided.filter(good).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of exact and near copies."""
    return neardup.drop_near_duplicates(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut out the passages that repeat."""
    return recount(suffixdedup.remove_repeated_passages(docs, words=PASSAGE_WORDS))


def secret_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets by their kind."""
    return recount(secrets.redact(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents into sequences of at most 2048 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


def recount(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


STAGES = [
    ("language", language),
    ("near_duplicates", near_copies),
    ("suffix_dedup", passages),
    ("secrets", secret_spans),
    ("packing", pack),
]

#: The tokenizer and the alignment of the stages have no SQL form; tests check each stage, and that run() equals their chain.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(before)
    return docs
