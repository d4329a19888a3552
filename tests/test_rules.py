"""The rule matcher against trying every rule, and exact quantiles against numpy."""

from __future__ import annotations

import random
import re
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from duskline.operators import rules as U
from duskline.operators.quantiles import exact_quantiles, robust_outliers

PATTERNS = [
    r"(?i)union\s+select", r"drop\s+table|insert\s+into", r"[0-9]{4,}", r"\b[a-z]{6,}ing\b", r"(?:ab|cd)+ef", r"x?y?z?", r"(foo|)bar", r"a(?=bc)", r"(?i:Select)",
    r"<script", r"\.\./", r"é+t", r"q{2,3}w", r"(?:aa|b)(?:cc|d)", r"^start", r"end$", r"[^a]bc", r"(?>abc)d", r"(ab){0,2}cd", r"(?!ab)cd",
]


def test_required_literals():
    want = {r"(?i)union\s+select": {"select"}, r"drop\s+table|insert\s+into": {"table", "insert"}, r"(?:ab|cd)+ef": {"ab", "cd"}, r"(foo|)bar": {"bar"}, r"<script": {"<script"}, r"x?y?z?": None, r"[0-9]{4,}": None}
    for p, literals in want.items():
        got = U.required_literals(p)
        assert got == (None if literals is None else frozenset(literals)), p


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abcdefqwxyzSELCTUNIOM 019<>./ét\n", max_size=40))
def test_matcher_equals_trying_every_rule(text):
    matcher = MATCHER
    want = [(i, m.start() + 1, m.group()) for i, p in enumerate(PATTERNS) if (m := re.compile(p, re.ASCII).search(text))]
    assert matcher.first(text) == want
    assert matcher.every(text) == [(i, m.start() + 1, m.group()) for i, p in enumerate(PATTERNS) for m in re.finditer(p, text, re.ASCII)]


MATCHER = U.RuleMatcher([U.TextRule(str(i), p) for i, p in enumerate(PATTERNS)])


def test_match_rules_in_blocks(spark):
    rng = random.Random(2)
    words = ["union  select", "drop table", "12345", "abcdef", "a.b", "Select", "é", "", "interesting", "a.b.c"]
    rows = [(i, None if i % 17 == 0 else " ".join(rng.choice(words) for _ in range(4)), "x") for i in range(200)]
    df = spark.createDataFrame(rows, "id long, body string, rule_note string")
    rules = [U.TextRule(f"r{i}", p) for i, p in enumerate(PATTERNS)] + [U.TextRule("lit", "a.b", literal=True), U.TextRule("none", "zzz")]
    want = sorted((i, r.id, m.start() + 1, m.group()) for i, t, _ in rows if t is not None for r in rules if (m := re.search(re.escape(r.pattern) if r.literal else r.pattern, t, re.ASCII)))
    for block in (1 << 20, 40):
        got = U.match_rules(df, "body", rules, block=block)
        assert got.columns == ["id", "rule_note", "rule_id", "position", "matched"]
        assert sorted((r.id, r.rule_id, r.position, r.matched) for r in got.collect()) == want
    assert U.match_rules(df, "body", []).count() == 0 and U.match_rules(df.limit(0), "body", rules).count() == 0
    plan = U.match_rules(df, "body", rules)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan


def test_a_bad_rule_is_named():
    with pytest.raises(ValueError, match="'broken'"):
        U.RuleMatcher([U.TextRule("broken", "(")])


def test_ten_thousand_rules():
    rng = random.Random(3)
    rules = [U.TextRule(f"r{i}", rf"tok{i:05d}\s*=\s*[a-z]+") for i in range(10000)]
    matcher = U.RuleMatcher(rules)
    texts = [" ".join(f"tok{rng.randrange(10000):05d} = abc" if rng.random() < 0.2 else "plain words here" for _ in range(20)) for _ in range(300)]
    began = time.time()
    found = [matcher.first(t) for t in texts]
    assert time.time() - began < 2
    for t, f in zip(texts[:5], found):
        assert f == [(i, m.start() + 1, m.group()) for i, r in enumerate(rules) if (m := re.search(r.pattern, t))]


def test_exact_quantiles(spark):
    rng = np.random.default_rng(4)
    for values in (rng.normal(size=3000), np.repeat([1.0, 2.0, 3.0], [1000, 5, 1000]), np.array([7.0]), np.array([1.0, 2.0]), np.full(50, 3.0), rng.pareto(1.0, 2000)):
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
        got = exact_quantiles(df, "v", [0.0, 0.05, 0.5, 0.9, 0.95, 1.0], most=64)
        assert np.allclose(got, np.quantile(values, [0.0, 0.05, 0.5, 0.9, 0.95, 1.0]), rtol=1e-12, atol=1e-12)
    assert exact_quantiles(df.limit(0), "v", [0.5]) == [None]


def test_robust_outliers(spark):
    df = spark.createDataFrame([(f"k{i}", float(i % 5)) for i in range(50)] + [("far", 100.0), ("null", None)], "k string, v double")
    got = robust_outliers(df, "k", "v").collect()
    assert [(r.item, r.value) for r in got] == [("far", 100.0)] and abs(got[0].z - 0.6745 * 98 / 1) < 1e-9
    assert robust_outliers(df.withColumn("v", F.lit(1.0)), "k", "v").count() == 0 == robust_outliers(df.limit(0), "k", "v").count()
