"""Plug-in points: rule sets, detectors, a match table, and SQL functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duskline.operators.rules import TextRule, match_rules

DETECTORS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def register_detector(name: str, fn: Callable[[DataFrame], DataFrame]) -> None:
    DETECTORS[name] = fn


class RuleSet:
    """Rules added, enabled and disabled at run time; ``to_df`` gives the enabled ones."""

    def __init__(self):
        self.rules: dict[str, tuple[str, str, bool]] = {}

    def add(self, rule_id: str, pattern: str, severity: str = "medium") -> RuleSet:
        self.rules[rule_id] = (pattern, severity, True)
        return self

    def _set(self, rule_id: str, on: bool) -> RuleSet:
        p, s, _ = self.rules[rule_id]
        self.rules[rule_id] = (p, s, on)
        return self

    def enable(self, rule_id: str) -> RuleSet:
        return self._set(rule_id, True)

    def disable(self, rule_id: str) -> RuleSet:
        return self._set(rule_id, False)

    def to_df(self, spark: SparkSession) -> DataFrame:
        rows = [(k, p, s) for k, (p, s, on) in self.rules.items() if on]
        return spark.createDataFrame(rows, "rule_id string, pattern string, severity string")

    def match(self, df: DataFrame, text: str) -> DataFrame:
        """The other columns with (rule_id, position, matched): the first match of every enabled rule in a row's text."""
        return match_rules(df, text, [TextRule(k, p) for k, (p, _, on) in self.rules.items() if on])


def match_table(df: DataFrame, key: str, text: str, patterns: dict[str, str]) -> DataFrame:
    """(key, type, value): all matches of named patterns."""

    def of(name: str, pattern: str):
        found = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
        return F.transform(found, lambda v: F.struct(F.lit(name).alias("type"), v.alias("value")))

    return df.select(key, F.explode(F.concat(*[of(n, p) for n, p in patterns.items()])).alias("m")).select(key, "m.type", "m.value")


def register_functions(spark: SparkSession) -> None:
    """Scalar helpers as temporary SQL functions, which the optimizer inlines."""
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION dl_normalize_path(p STRING) RETURNS STRING RETURN "
        "lower(regexp_replace(regexp_replace(p, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*', ''), '[?#].*$', ''))"
    )
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION dl_port_class(p INT) RETURNS STRING RETURN CASE WHEN p < 1024 THEN 'well_known' WHEN p < 49152 THEN 'registered' ELSE 'dynamic' END")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION dl_safe_ratio(a DOUBLE, b DOUBLE) RETURNS DOUBLE RETURN a / greatest(b, 0.001D)")
