"""Sequences of states per session: transitions, predictions, patterns, reduction."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sessionize(df: DataFrame, key: str, ts: str, tie: str, gap_seconds: int) -> DataFrame:
    """Number the sessions of each key: a gap of more than ``gap_seconds`` opens a new one."""
    w = Window.partitionBy(key).orderBy(ts, tie)
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    new = F.coalesce((us - F.lag(us).over(w)) > gap_seconds * 1_000_000, F.lit(True)).cast("int")
    return df.withColumn("_new", new).withColumn("session_no", F.sum("_new").over(w)).drop("_new")


def transitions(df: DataFrame, session: str, order: list[str], state: str, n: int = 1) -> DataFrame:
    """(context, next, and the row): each state with the ``n`` states before it in its session."""
    w = Window.partitionBy(session).orderBy(*order)
    context = F.concat_ws(">", *[F.lag(state, k).over(w) for k in range(n, 0, -1)])
    rows = df.withColumn("context", context).withColumn("next", F.col(state)).withColumn("_i", F.row_number().over(w))
    return rows.filter(F.col("_i") > n).drop("_i")


def learn_transitions(df: DataFrame, session: str, order: list[str], state: str, n: int = 1, lam: float = 1.0) -> DataFrame:
    """Transition counts with Laplace-smoothed probability (c + lam) / (sum c + lam m)."""
    t = transitions(df, session, order, state, n).groupBy("context", "next").agg(F.count(F.lit(1)).alias("count"))
    w = Window.partitionBy("context")
    p = (F.col("count") + lam) / (F.sum("count").over(w) + lam * F.count(F.lit(1)).over(w))
    return t.withColumn("probability", p)


def prune_transitions(matrix: DataFrame, least: int) -> DataFrame:
    return matrix.filter(F.col("count") >= least)


def predict_next(matrix: DataFrame, k: int = 5) -> DataFrame:
    """Per context the most probable next states, and an anomaly score of entropy and top probability."""
    w = Window.partitionBy("context").orderBy(F.desc("probability"), "next")
    top = matrix.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    whole = Window.partitionBy("context")
    entropy = F.sum(-F.col("probability") * F.log2("probability")).over(whole)
    n = F.count(F.lit(1)).over(whole)
    best = F.max("probability").over(whole)
    score = F.when(n > 1, entropy / F.log2(n)).otherwise(0.0) + (1 - best)
    return top.withColumn("anomaly_score", F.least(F.lit(1.0), score))


def validate_sequences(df: DataFrame, matrix: DataFrame, session: str, order: list[str], state: str, n: int = 1) -> DataFrame:
    """Per session: unseen transitions, improbable ones (under 0.1), validity and confidence."""
    t = transitions(df, session, order, state, n).join(matrix.select("context", "next", "probability"), ["context", "next"], "left")
    g = t.groupBy(session).agg(
        F.count(F.lit(1)).alias("steps"), F.count_if(F.col("probability").isNull()).alias("unseen"),
        F.count_if(F.col("probability") < 0.1).alias("improbable"),
    )
    out = g.withColumn("valid", F.col("unseen") == 0)
    return out.withColumn("confidence", 1 - (F.col("unseen") + 0.5 * F.col("improbable")) / F.col("steps"))


def discover_patterns(df: DataFrame, session: str, order: list[str], state: str, least: int = 2, shortest: int = 2, longest: int = 5):
    """Contiguous state runs of 2 to 5 with their count and support among sessions."""
    w = Window.partitionBy(session).orderBy(*order)
    rows = df.select(session, *order, F.col(state).alias("_s0"))
    for k in range(1, longest):
        rows = rows.withColumn(f"_s{k}", F.lead("_s0", k).over(w))
    runs = F.array(*[F.when(F.col(f"_s{k - 1}").isNotNull(), F.concat_ws(">", *[f"_s{i}" for i in range(k)])) for k in range(shortest, longest + 1)])
    grams = rows.select(session, F.explode(F.array_compact(runs)).alias("pattern"))
    g = grams.groupBy("pattern").agg(F.count(F.lit(1)).alias("count"), F.count_distinct(session).alias("support"))
    return g.filter(F.col("count") >= least)


def sequence_scores(df: DataFrame, matrix: DataFrame, session: str, order: list[str], state: str) -> DataFrame:
    """Per session: mean and greatest improbability (1 - probability, 1 if unseen) of its transitions."""
    t = transitions(df, session, order, state).join(matrix.select("context", "next", "probability"), ["context", "next"], "left")
    odd = 1 - F.coalesce("probability", F.lit(0.0))
    return t.groupBy(session).agg(F.avg(odd).alias("score"), F.max(odd).alias("worst"))


def user_journeys(df: DataFrame, session: str, order: list[str], state: str, seconds: Column, matrix: DataFrame, risky: float = 0.6) -> DataFrame:
    """Per session: first and last state, steps, path, duration of each step, total duration, anomaly flag, risk.

    ``seconds`` is the time of a row. A journey is anomalous if the mean improbability of its steps exceeds
    ``risky``; its risk is that of its least probable step. A path is as long as its session.
    """
    w = Window.partitionBy(session).orderBy(*order)
    rows = df.withColumn("_at", seconds).withColumn("_i", F.row_number().over(w)).withColumn("_d", F.lead("_at").over(w) - F.col("_at"))
    step = F.array_sort(F.collect_list(F.struct("_i", F.col(state).alias("state"), F.coalesce("_d", F.lit(0.0)).alias("d"))))
    g = rows.groupBy(session).agg(step.alias("_p"), (F.max("_at") - F.min("_at")).alias("duration"))
    g = g.withColumns({
        "start": F.col("_p")[0]["state"], "end": F.element_at("_p", -1)["state"], "steps": F.size("_p"),
        "path": F.transform("_p", lambda x: x["state"]), "step_durations": F.transform("_p", lambda x: x["d"]),
    }).drop("_p")
    out = g.join(sequence_scores(df, matrix, session, order, state), session, "left")
    out = out.withColumn("is_anomalous", F.coalesce(F.col("score") > risky, F.lit(False))).withColumn("risk", F.coalesce("worst", F.lit(0.0)))
    return out.drop("score", "worst")


def rate_patterns(patterns: DataFrame, odd: float = 0.005, risky: float = 0.001) -> DataFrame:
    """Add to (pattern, count, support) the probability among all, whether it is anomalous, and the risk level."""
    total = patterns.agg(F.sum("count").alias("_t"))
    p = patterns.crossJoin(F.broadcast(total)).withColumn("probability", F.col("count") / F.col("_t")).drop("_t")  # one row
    q = F.col("probability")
    return p.withColumn("is_anomalous", q < odd).withColumn("risk_level", F.when(q < risky, "high").when(q < odd, "medium").otherwise("low"))


def behavior_insights(patterns: DataFrame, sessions: DataFrame) -> DataFrame:
    """(insight, item, impact, affected): three common and two anomalous patterns, abandonment over 30 %, rare patterns.

    ``patterns`` is as ``rate_patterns`` gives it, ``sessions`` has (steps, is_complete).
    """
    most = [F.desc("count"), "pattern"]
    row = lambda d, name, impact: d.select(F.lit(name).alias("insight"), F.col("pattern").alias("item"), impact.alias("impact"), F.col("support").alias("affected"))
    common = row(patterns.filter("count > 10 AND NOT is_anomalous").orderBy(*most).limit(3), "common_pattern", F.lit("low"))
    odd = row(patterns.filter("is_anomalous AND risk_level <> 'low'").orderBy(*most).limit(2), "anomalous_sequence", F.lit("high"))
    left = sessions.agg(F.count_if((~F.col("is_complete")) & (F.col("steps") > 3)).alias("affected"), F.count(F.lit(1)).alias("_n"))
    left = left.filter(F.col("affected") > 0.3 * F.col("_n")).select(
        F.lit("journey_abandonment").alias("insight"), F.lit("sessions").alias("item"), F.lit("medium").alias("impact"), "affected"
    )
    rare = patterns.filter("count < 5 AND probability < 0.01").agg(F.min("pattern").alias("item"), F.sum("support").alias("affected"))
    rare = rare.filter("item IS NOT NULL").select(F.lit("rare_behavior").alias("insight"), "item", F.lit("medium").alias("impact"), "affected")
    return common.unionByName(odd).unionByName(left).unionByName(rare)


def markov_report(df: DataFrame, session: str, order: list[str], state: str, as_of: str, hours: int = 24, ts: str = "ts", risky: float = 0.6) -> DataFrame:
    """One row over a window: sequences, mean length, transitions, patterns, share of anomalous sequences."""
    end = F.lit(as_of).cast(df.schema[ts].dataType)
    late = df.filter((F.col(ts) > end - F.expr(f"INTERVAL {hours} HOUR")) & (F.col(ts) <= end))
    matrix = learn_transitions(late, session, order, state)
    lengths = late.groupBy(session).agg(F.count(F.lit(1)).alias("_n"))
    scores = lengths.join(sequence_scores(late, matrix, session, order, state), session, "left")
    a = scores.agg(
        F.count(F.lit(1)).alias("sequences"), F.avg("_n").alias("mean_length"), F.avg(F.coalesce((F.col("score") > risky).cast("int"), F.lit(0))).alias("anomaly_rate")
    )
    b = matrix.agg(F.count(F.lit(1)).alias("patterns"), F.coalesce(F.sum("count"), F.lit(0)).alias("transitions"))
    return a.crossJoin(F.broadcast(b))  # one row each


def behavior_trend(df: DataFrame, anomalous: Column, unit: str = "day", periods: int = 3, ts: str = "ts") -> DataFrame:
    """Anomaly rate of the last and the first periods, and the trend: improving below 0.8 of it, degrading above 1.2."""
    d = df.groupBy(F.date_trunc(unit, ts).alias("_d")).agg(F.avg(anomalous.cast("int")).alias("_r"))
    pick = lambda order, name: d.orderBy(order).limit(periods).agg(F.avg("_r").alias(name))
    out = pick(F.asc("_d"), "older").crossJoin(F.broadcast(pick(F.desc("_d"), "recent")))  # one row each
    r, o = F.col("recent"), F.col("older")
    return out.withColumn("trend", F.when(r < o * 0.8, "improving").when(r > o * 1.2, "degrading").otherwise("stable"))


def sequence_risk(anomaly: Column, deviation: Column, transition: Column, context: Column) -> Column:
    """Sequence anomaly .4, pattern deviation .3, transition risk .2, context violation .1; 1 at most."""
    return F.least(F.lit(1.0), anomaly * 0.4 + deviation * 0.3 + transition * 0.2 + context * 0.1)


def prediction_metrics(matrix: DataFrame, held: DataFrame) -> DataFrame:
    """How often the top prediction of a context is the next state in held-out transitions."""
    top = predict_next(matrix, 1).select("context", F.col("next").alias("_best"))
    return held.join(top, "context", "left").agg(F.count(F.lit(1)).alias("n"), F.avg(F.coalesce((F.col("_best") == F.col("next")).cast("double"), F.lit(0.0))).alias("accuracy"))


def compress_sequences(df: DataFrame, session: str, order: list[str], state: str, ratio: float = 0.7, least: int = 100) -> DataFrame:
    """Sessions over ``least`` states keep the share ``ratio`` of rows with the most frequent states, in time order.

    The share is taken as the decimal it is written as: 0.7 of 90 rows is 63, where doubles give 62.99.
    """
    freq = Window.partitionBy(session, state)
    rows = df.withColumn("_f", F.count(F.lit(1)).over(freq)).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(session)))
    rank = F.row_number().over(Window.partitionBy(session).orderBy(F.desc("_f"), *order))
    keep = (F.col("_n") <= least) | (F.col("_r") <= F.floor(F.col("_n") * F.lit(Decimal(str(ratio)))))
    return rows.withColumn("_r", rank).filter(keep).drop("_f", "_n", "_r")


def transition_probs(df: DataFrame, session: str, order: list[str], state: str, ts: str, as_of: str, n: int = 1, lam: float = 1.0) -> DataFrame:
    """``learn_transitions`` with last_seen and confidence: count / 100 times the recency, at most 0.95.

    The recency is exp(-hours / 168) of the hours from the last sight to ``as_of``; later sights count as now.
    """
    t = transitions(df, session, order, state, n).groupBy("context", "next").agg(F.count(F.lit(1)).alias("count"), F.max(ts).alias("last_seen"))
    w = Window.partitionBy("context")
    p = (F.col("count") + lam) / (F.sum("count").over(w) + lam * F.count(F.lit(1)).over(w))
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    hours = F.greatest((micros(F.lit(as_of)) - micros(F.col("last_seen"))) / 3.6e9, F.lit(0.0))
    return t.withColumn("probability", p).withColumn("confidence", F.least(F.lit(0.95), F.col("count") / 100 * F.exp(-hours / 168)))


def matrix_stats(matrix: DataFrame) -> DataFrame:
    """One row: states, contexts, transitions, observations, transitions per state (0 if none), last_seen if the matrix has it."""
    pairs = matrix.select(F.explode(F.array("context", "next")).alias("s")).agg(F.count_distinct("s").alias("states"))
    last = [F.max("last_seen").alias("last_seen")] if "last_seen" in matrix.columns else []
    g = matrix.agg(F.count_distinct("context").alias("contexts"), F.count(F.lit(1)).alias("transitions"), F.coalesce(F.sum("count"), F.lit(0)).alias("observations"), *last)
    out = g.crossJoin(F.broadcast(pairs))  # one row each
    return out.withColumn("per_state", F.coalesce(F.try_divide("transitions", "states"), F.lit(0.0)))


def transition_prob(matrix: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked`` (context, next and more) with the probability of each transition, 0 if it was never seen."""
    out = asked.join(matrix.select("context", "next", "probability"), ["context", "next"], "left")
    return out.withColumn("probability", F.coalesce("probability", F.lit(0.0)))
