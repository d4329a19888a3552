"""Anomalies of whole sessions against known runs of states, and clusters of anomalous runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import components
from .sequence import transitions

LONGEST = 5
# What to do about a type of anomaly.
ADVICE = {
    "impossible_transition": ("Investigate potential bot activity", "Check for session hijacking"),
    "timing_anomaly": ("Monitor for automated behavior", "Consider rate limiting"),
    "context_mismatch": ("Review authentication status", "Check for privilege escalation"),
    "rare_sequence": ("Monitor user behavior closely", "Consider additional verification"),
}


def runs_of(df: DataFrame, session: str, order: list[str], state: str, context: str | None = None, shortest: int = 2, longest: int = LONGEST) -> DataFrame:
    """(session, at, length, pattern, states, contexts): every contiguous run of ``shortest`` to ``longest`` states.

    ``at`` is the place of the run's first state, from 1. The frames hold ``longest`` rows, whatever the session's length.
    """
    w = Window.partitionBy(session).orderBy(*order)
    item = F.struct(F.col(state).cast("string").alias("s"), (F.col(context) if context else F.lit(None)).cast("string").alias("c"))
    rows = df.select(session, F.row_number().over(w).alias("at"), F.collect_list(item).over(w.rowsBetween(0, longest - 1)).alias("_near"))
    lengths = F.sequence(F.lit(shortest), F.lit(longest))
    rows = rows.filter(F.size("_near") >= shortest).withColumn("length", F.explode(F.filter(lengths, lambda n: n <= F.size("_near"))))
    run = F.slice("_near", F.lit(1), F.col("length"))
    return rows.select(
        session, "at", "length", F.array_join(F.transform(run, lambda x: x["s"]), ">").alias("pattern"),
        F.transform(run, lambda x: x["s"]).alias("states"), F.array_distinct(F.array_compact(F.transform(run, lambda x: x["c"]))).alias("contexts"),
    )


def pattern_profiles(df: DataFrame, session: str, order: list[str], state: str, context: str, risk: str, least: int = 1) -> DataFrame:
    """(pattern, count, support, states, contexts, mean_risk, risk_level, is_anomalous, confidence) of all runs.

    ``risk`` is a column of the rows; a session has its highest. A run's risk is the mean over its occurrences.
    """
    runs = runs_of(df, session, order, state, context)
    of = df.groupBy(session).agg(F.max(risk).alias("_r"))
    g = runs.join(of, session).groupBy("pattern").agg(
        F.count(F.lit(1)).alias("count"), F.count_distinct(session).alias("support"), F.any_value("states").alias("states"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("contexts")))).alias("contexts"), F.avg("_r").alias("mean_risk"),
    )
    r = F.col("mean_risk")
    level = F.when(r > 0.8, "critical").when(r > 0.6, "high").when(r > 0.4, "medium").otherwise("low")
    return g.filter(F.col("count") >= least).withColumns({
        "risk_level": level, "is_anomalous": F.coalesce(r > 0.7, F.lit(False)), "confidence": F.least(F.lit(0.95), F.col("count") / 50),
    })


def gap_model(df: DataFrame, session: str, order: list[str], state: str, seconds: Column, width: float = 6.0) -> DataFrame:
    """(context, next, low, high): bounds of the gap of each transition, its median less and plus ``width`` median deviations.

    Gaps are in seconds. The medians are over logarithmic classes of 5 %, so that they merge before the shuffle.
    """
    w = Window.partitionBy(session).orderBy(*order)
    t = df.withColumn("_at", seconds).select(F.lag(state).over(w).alias("context"), F.col(state).alias("next"), (F.col("_at") - F.lag("_at").over(w)).alias("gap"))
    t = t.filter(F.col("gap").isNotNull() & F.col("context").isNotNull())

    def median(rows: DataFrame, value: Column, name: str) -> DataFrame:
        keys = ["context", "next"]
        c = rows.groupBy(*keys, F.round(F.log(F.greatest(value, F.lit(1e-6))) / F.log(F.lit(1.05))).alias("_c")).agg(F.count(F.lit(1)).alias("_n"))
        upto, every = Window.partitionBy(*keys).orderBy("_c"), Window.partitionBy(*keys)
        c = c.withColumn("_k", F.sum("_n").over(upto)).withColumn("_t", F.sum("_n").over(every)).filter(2 * F.col("_k") >= F.col("_t"))
        return c.groupBy(*keys).agg(F.pow(F.lit(1.05), F.min("_c")).alias(name))

    mid = median(t, F.col("gap"), "mid")
    spread = median(t.join(mid, ["context", "next"]), F.abs(F.col("gap") - F.col("mid")), "mad")
    m, d = F.col("mid"), 1.4826 * F.col("mad")
    return mid.join(spread, ["context", "next"]).select("context", "next", F.greatest(F.lit(0.0), m - width * d).alias("low"), (m + width * d).alias("high"))


def sequence_anomalies(
    df: DataFrame, patterns: DataFrame, matrix: DataFrame, session: str, order: list[str], state: str, seconds: Column, context: str, risk: str,
    gaps: DataFrame | None = None, risky: float = 0.7,
) -> DataFrame:
    """Per session: scores of pattern, transitions and timing, the anomaly, its type, severity, factors and advice.

    - pattern: .8 if the whole session is no known run, .6 if it is seen under 5 times, .9 if it is anomalous, else .2
    - transition: .3 for each transition that ``matrix`` lacks, 1 at most
    - timing: .2 for each gap under 0.1 s or over 300 s, or outside the bounds of ``gaps`` (see ``gap_model``), 1 at most

    The anomaly is their sum by .4, .4 and .2. ``covered`` is the share of the session's states inside known runs.
    A session of one state is .5, rare and low. ``patterns`` has (pattern, count, is_anomalous); it meets each run once,
    and sessions never meet each other. ``matrix`` has (context, next, probability).
    """
    known = patterns.select("pattern", F.col("count").alias("_c"), F.col("is_anomalous").alias("_a"))
    sizes = df.groupBy(session).agg(
        F.count(F.lit(1)).alias("steps"), F.max(risk).alias("_risk"),
        F.bool_or(F.col(context) == "suspicious").alias("_sus"), F.bool_or(F.col(context) == "normal").alias("_nor"),
    )
    runs = runs_of(df, session, order, state).select(session, "at", "length", "pattern").join(known, "pattern", "left")
    # the whole session is the run from its first state as long as it; each start keeps its farthest known run
    starts = runs.groupBy(session, "at").agg(
        F.max(F.when(F.col("_c").isNotNull(), F.col("at") + F.col("length") - 1)).alias("_to"),
        F.collect_list(F.when(F.col("at") == 1, F.struct("length", "_c", "_a"))).alias("_first"),
    )
    reach = F.max("_to").over(Window.partitionBy(session).orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    new = F.greatest(F.lit(0), F.col("_to") - F.greatest(F.col("at") - 1, F.coalesce("_reach", F.lit(0))))
    covered = starts.withColumn("_reach", reach).groupBy(session).agg(
        F.sum(F.coalesce(new, F.lit(0))).alias("_covered"), F.max(F.when(F.col("at") == 1, F.col("_first"))).alias("_first")
    )
    w = Window.partitionBy(session).orderBy(*order)
    t = transitions(df.withColumn("_gap", seconds - F.lag(seconds).over(w)), session, order, state)
    t = t.join(matrix.select("context", "next", "probability"), ["context", "next"], "left")
    if gaps is not None:
        t = t.join(gaps.select("context", "next", "low", "high"), ["context", "next"], "left")
        odd = (F.col("_gap") < F.coalesce("low", F.lit(0.1))) | (F.col("_gap") > F.coalesce("high", F.lit(300.0)))
    else:
        odd = (F.col("_gap") < 0.1) | (F.col("_gap") > 300)
    steps = t.groupBy(session).agg(
        F.count_if(F.col("probability").isNull()).alias("_unseen"), F.count_if(F.col("probability") < 0.1).alias("_rare"), F.count_if(odd).alias("_odd")
    )
    out = sizes.join(steps, session, "left").join(covered, session, "left")
    whole = F.element_at(F.filter("_first", lambda x: x["length"] == F.col("steps")), 1)
    out = out.withColumn("_w", F.when(F.exists("_first", lambda x: x["length"] == F.col("steps")), whole))
    short = F.col("steps") < 2
    pattern = F.when(F.col("_w._c").isNull(), 0.8).when(F.col("_w._c") < 5, 0.6).when(F.col("_w._a"), 0.9).otherwise(0.2)
    out = out.withColumns({
        "pattern_score": F.when(~short, pattern),
        "transition_score": F.when(~short, F.least(F.lit(1.0), F.coalesce("_unseen", F.lit(0)) * 0.3)),
        "timing_score": F.when(~short, F.least(F.lit(1.0), F.coalesce("_odd", F.lit(0)) * 0.2)),
        "covered": F.coalesce("_covered", F.lit(0)) / F.col("steps"),
    })
    score = F.when(short, 0.5).otherwise(F.col("pattern_score") * 0.4 + F.col("transition_score") * 0.4 + F.col("timing_score") * 0.2)
    kind = (
        F.when(F.col("transition_score") > 0.8, "impossible_transition").when(F.col("timing_score") > 0.6, "timing_anomaly")
        .when(~short & F.col("_sus") & F.col("_nor"), "context_mismatch").otherwise("rare_sequence")
    )
    out = out.withColumn("score", score).withColumn("type", kind)
    s = F.col("score")
    severity = (
        F.when(short, "low").when((s > 0.9) | (F.col("type") == "impossible_transition"), "critical")
        .when(s > 0.7, "high").when(s > 0.5, "medium").otherwise("low")
    )
    factors = F.array_compact(F.array(
        F.when((F.coalesce("_unseen", F.lit(0)) + F.coalesce("_rare", F.lit(0))) > 0, F.lit("Invalid state transitions detected")),
        F.when(F.col("_sus"), F.lit("Suspicious behavioral context")),
        F.when(F.col("_risk") > 0.7, F.lit("High risk score assigned")),
    ))
    advice = F.create_map(*[x for k, v in ADVICE.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    none = F.array().cast("array<string>")
    return out.withColumns({
        "is_anomalous": ~short & (s > risky), "severity": severity, "risk_factors": F.when(short, none).otherwise(factors),
        "recommendations": F.when(short, none).otherwise(advice[F.col("type")]),
    }).select(session, "steps", "pattern_score", "transition_score", "timing_score", "covered", "score", "is_anomalous", "type", "severity", "risk_factors", "recommendations")


def similar_sets(sets: DataFrame, key: str, items: str, least: float, group: str | None = None) -> DataFrame:
    """(a, b, jaccard): pairs of distinct non-empty sets with a Jaccard similarity of ``least`` or more, exact.

    Prefix filter: items are ordered from rare to frequent; two such sets share one of the first
    ``size - ceil(least * size) + 1`` items of each. Only sets with a common item among these meet, and
    only if their sizes allow the similarity. ``group`` keeps sets of different groups apart.
    """
    g = F.col(group) if group else F.lit(0)
    base = sets.select(F.col(key).alias("_id"), F.array_distinct(items).alias("_set"), g.alias("_g")).filter(F.size("_set") > 0)
    each = base.select("_id", "_g", F.size("_set").alias("_n"), F.explode("_set").alias("_x"))
    df = each.groupBy("_x").agg(F.count(F.lit(1)).alias("_f"))
    order = Window.partitionBy("_id").orderBy("_f", "_x")
    keep = F.col("_n") - F.ceil(F.col("_n") * least - 1e-9) + 1
    prefix = each.join(df, "_x").withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= keep).select("_id", "_g", "_n", "_x")
    other = prefix.select(F.col("_id").alias("_id2"), F.col("_g").alias("_g2"), F.col("_n").alias("_n2"), F.col("_x").alias("_x2"))
    fits = (F.col("_x") == F.col("_x2")) & (F.col("_g") == F.col("_g2")) & (F.col("_id") < F.col("_id2"))
    size = (F.least("_n", "_n2") >= F.greatest("_n", "_n2") * least - 1e-9)
    pairs = prefix.join(other, fits & size).select("_id", "_id2").distinct()
    full = pairs.join(base.select("_id", "_set"), "_id").join(base.select(F.col("_id").alias("_id2"), F.col("_set").alias("_set2")), "_id2")
    both = F.size(F.array_intersect("_set", "_set2"))
    j = both / (F.size("_set") + F.size("_set2") - both)
    return full.select(F.col("_id").alias("a"), F.col("_id2").alias("b"), j.alias("jaccard")).filter(F.col("jaccard") >= least - 1e-12)


def anomaly_clusters(patterns: DataFrame, similarity: float = 1.0) -> DataFrame:
    """Clusters of the anomalous ``patterns`` (as ``pattern_profiles`` has them) of one risk level by their contexts.

    Patterns belong together if a chain of patterns leads from one to the other whose context sets have a Jaccard
    similarity of ``similarity`` or more (1: equal sets). Equal sets are one item of the join, so a set that very
    many patterns have costs no more. The cluster is named by its risk level and its first set. Severity: critical
    with a critical pattern, high if over half of its patterns are high, medium if any is. Contexts are common in over half, actions
    (counted with repeats) over .6 of the number of patterns. ``affected`` counts three occurrences of a pattern at most.
    """
    odd = patterns.filter("is_anomalous").withColumn("_set", F.concat_ws("|", "risk_level", F.array_join(F.array_sort("contexts"), ",")))
    sets = odd.groupBy("_set").agg(F.any_value("contexts").alias("contexts"), F.any_value("risk_level").alias("risk_level"))
    names = sets.select("_set", F.col("_set").alias("cluster"))
    if similarity < 1:
        links = similar_sets(sets, "_set", "contexts", similarity, "risk_level")
        found = components(links.select(F.col("a").alias("src"), F.col("b").alias("dst")))
        joined = names.join(found.withColumnRenamed("node", "_set"), "_set", "left")
        names = joined.select("_set", F.coalesce("component", "cluster").alias("cluster"))
    member = odd.join(names, "_set").select("cluster", "pattern", "count", "states", "contexts", "risk_level")
    level = F.col("risk_level")
    g = member.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("patterns"), F.count_if(level == "critical").alias("_critical"), F.count_if(level == "high").alias("_high"),
        F.sum(F.least(F.lit(3), "count")).alias("affected"),
        F.avg(F.when(level == "critical", 1.0).when(level == "high", 0.7).otherwise(0.3)).alias("risk_score"),
    )
    n = F.col("patterns")
    severity = F.when(F.col("_critical") > 0, "critical").when(F.col("_high") > 0.5 * n, "high").when(F.col("_high") > 0, "medium").otherwise("low")

    def common(column: Column, share: float, name: str) -> DataFrame:
        counts = member.select("cluster", F.explode(column).alias("_x")).groupBy("cluster", "_x").agg(F.count(F.lit(1)).alias("_n"))
        many = counts.join(g.select("cluster", "patterns"), "cluster").filter(F.col("_n") > share * n)
        return many.groupBy("cluster").agg(F.array_sort(F.collect_list("_x")).alias(name))

    empty = F.array().cast("array<string>")
    out = g.withColumn("severity", severity).drop("_critical", "_high")
    out = out.join(common(F.col("contexts"), 0.5, "common_contexts"), "cluster", "left").join(common(F.col("states"), 0.6, "common_actions"), "cluster", "left")
    return out.withColumns({c: F.coalesce(c, empty) for c in ("common_contexts", "common_actions")})
