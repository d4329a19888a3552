"""Running sums over long orders without one task per key or for the whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_sums(df: DataFrame, key: str, order: list[str], values: dict[str, Column], chunk: Column) -> DataFrame:
    """Add to each row the sum of each value from its key's first row up to it, by ``order``.

    ``chunk`` must rise with the order (a day of the time, say). Sums run inside a key's chunks; what came before a
    chunk is summed from one row a chunk, so a hot key is spread over its chunks.
    """
    rows = df.withColumn("_chunk", chunk)
    totals = rows.groupBy(key, "_chunk").agg(*[F.sum(v).alias(f"_t_{n}") for n, v in values.items()])
    earlier = Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(key, "_chunk", *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_b_{n}") for n in values])
    inside = Window.partitionBy(key, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.withColumns({f"_i_{n}": F.sum(v).over(inside) for n, v in values.items()}).join(before, [key, "_chunk"])
    out = summed.withColumns({n: F.col(f"_b_{n}") + F.col(f"_i_{n}") for n in values})
    return out.drop("_chunk", *[f"_{x}_{n}" for n in values for x in "bi"])


def ranges_of(df: DataFrame, col: str, parts: int = 256) -> Column:
    """The number of the range of ``col`` that a row falls in, by approximate quantiles; rises with the column."""
    cuts = sorted(set(df.approxQuantile(col, [i / parts for i in range(1, parts)], 0.25 / parts)))
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col(col))) if cuts else F.lit(0)
