"""Proportional stratified interleaving of rows into shards.

Rows are shuffled with a seed inside each source, ranked there, sorted by
fractional rank (rank - 1/2) / rows of the source, and cut at equal row counts.
Every prefix of that order holds each source in proportion to within a row, so
every shard matches the corpus mixture. Law: ``rows`` (counts at most one apart).
Equal texts are rows like any other: a source or a group of copies that holds a
third of all rows is spread evenly over the shards.

Both sorts are range shuffles of a narrow table on nearly distinct keys, so no
source is gathered in one task. Nulls: a null source is a source of its own; a
null text counts no bytes and has the checksum of the empty string. Repeated
rows are separate rows. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import global_rank, materialize

MOST_BROADCAST = 20_000


def interleave(
    df: DataFrame, stratum: str, unique: list[Column], seed: int = 17, position: str = "position"
) -> DataFrame:
    """Add the 0-based position of each row in the proportional interleaving of its strata.

    ``df`` should be narrow and stored; ``unique`` are columns that tell its rows
    apart, mixed with ``seed`` to shuffle within a stratum.
    """
    shuffled = df.withColumn("_u", F.md5(F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in unique])))
    has = F.col(stratum).isNotNull()
    shuffled = shuffled.withColumn("_s", F.when(has, F.concat(F.lit("="), F.col(stratum).cast("string"))).otherwise(""))
    ranked = global_rank(shuffled, [F.col("_s"), F.col("_u"), *unique], "_rank", "shard-rank")
    sizes = ranked.groupBy("_s").agg(F.count(F.lit(1)).alias("_n"), F.min("_rank").alias("_first"))
    sizes = materialize(sizes, "shard-sources")
    # sources are usually few: then their counts go to the rows; many are joined by a shuffle
    few = sizes.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    placed = ranked.join(F.broadcast(sizes) if few else sizes, "_s").withColumn(
        "_f", (F.col("_rank") - F.col("_first") + F.lit(0.5)) / F.col("_n")
    )
    narrow = materialize(placed.drop("_rank", "_first", "_n"), "shard-fraction")
    return global_rank(narrow, [F.col("_f"), F.col("_s"), F.col("_u"), *unique], position, "shard-order").drop(
        "_f", "_s", "_u"
    )


def cut(df: DataFrame, n_shards: int, total: int, position: str = "position") -> DataFrame:
    """Cut the order into ``n_shards`` runs whose lengths differ by one at most; add shard and slot."""
    if n_shards < 1:
        raise ValueError("n_shards must be 1 or more")
    shard = F.expr(f"({position} * {n_shards}L) div {max(total, 1)}L")
    start = F.expr(f"(shard * {total}L + {n_shards - 1}L) div {n_shards}L")
    return df.withColumn("shard", shard.cast("int")).withColumn("slot", (F.col(position) - start).cast("long"))


def shard_documents(
    docs: DataFrame,
    n_shards: int = 16,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row per document: doc_id, source, size, text_crc32, law, shard, slot, grown_shard."""
    text = F.col(text_col)
    narrow = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).cast("long").alias("text_crc32"),
    )
    narrow = materialize(narrow, "shard-input")
    ordered = interleave(narrow, "source", [F.col("doc_id"), F.col("text_crc32")], seed)
    return cut(ordered, n_shards, narrow.count()).select(
        "doc_id",
        "source",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
