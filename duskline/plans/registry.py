"""Query registration: a Spark callable and, where SQL can express it, DuckDB SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The given tables and the security-shaped views over them (see ``views``)."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name in views.VIEWS:
            sql, tables = views.VIEWS[name]
            return self.spark.sql(sql, **{t: getattr(self, t) for t in tables})
        return self.table(name)


TIE = 3e-8


def rnd(col, digits: int = 5):
    """Round for comparison, ties moved up so that the last bit of a double doesn't decide them."""
    return F.round(F.col(col) + TIE if isinstance(col, str) else col + TIE, digits)


def rnd_many(col: str, digits: int):
    """``rnd`` for the columns of very many rows: ``round`` makes a decimal of each value, which takes most of the time."""
    return F.floor((F.col(col) + TIE) * 10.0**digits + 0.5) / 10.0**digits


def steady(sql: str) -> str:
    """``round(x, n)`` in SQL as ``rnd`` has it, and conditional counts as Spark has them: 64-bit, never null."""
    out, at = [], 0
    for m in re.finditer(r"\bround\(", sql):
        if m.start() < at:
            continue
        depth, comma, i = 1, -1, m.end()
        while depth:
            ch = sql[i]
            depth += (ch == "(") - (ch == ")")
            if ch == "," and depth == 1:
                comma = i
            i += 1
        body = steady(sql[m.end() : comma])
        out += [sql[at : m.start()], f"round(({body})::double + {TIE}, {sql[comma + 1 : i - 1].strip()})"]
        at = i
    text = "".join(out) + sql[at:]
    out, at = [], 0
    for m in re.finditer(r"\bcount_if\(", text):
        if m.start() < at:
            continue
        depth, i = 1, m.end()
        while depth:
            depth += (text[i] == "(") - (text[i] == ")")
            i += 1
        out += [text[at : m.start()], f"coalesce({text[m.start():i]}, 0)::bigint"]
        at = i
    return "".join(out) + text[at:]


def query(name: str, sql: str | None = None, *needs: str):
    """Register ``fn(tables) -> DataFrame`` as ``name``; ``needs`` are the views that the SQL uses."""

    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(spark, sf_dir))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = views.with_views(steady(sql), needs)
        return fn

    return add
