"""Network forensics, hunting, incident investigation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import _checkpoint
from .quantiles import exact_quantiles


def port_scans(df: DataFrame, source: str, port: str, least: int = 100) -> DataFrame:
    return df.groupBy(source).agg(F.count_distinct(port).alias("ports")).filter(F.col("ports") > least)


def rare_groups(df: DataFrame, by: str, pct: float = 0.05) -> DataFrame:
    """Groups whose row count lies below the percentile of all groups' counts."""
    g = _checkpoint(df.groupBy(by).agg(F.count(F.lit(1)).alias("n")))
    (limit,) = exact_quantiles(g, "n", [pct])
    return g.filter(F.col("n") < F.lit(limit))


def hunt_above(df: DataFrame, by: str, measure: Column, pct: float) -> DataFrame:
    """Groups whose measure exceeds the percentile of all groups, with the ratio (10 at most)."""
    g = _checkpoint(df.groupBy(by).agg(measure.alias("value")))
    (limit,) = exact_quantiles(g, "value", [pct])
    risk = F.least(F.lit(10.0), F.try_divide(F.col("value").cast("double"), F.lit(limit)))
    return g.filter(F.col("value") > F.lit(limit)).withColumn("risk", F.coalesce(risk, F.lit(10.0)))


def hunt_dns(df: DataFrame, query: str, source: str, words: list[str]) -> DataFrame:
    """Suspicious queries with their sorted sources."""
    hit = F.lit(False)
    for w in words:
        hit = hit | F.col(query).contains(w)
    return df.filter(hit).groupBy(query).agg(F.array_sort(F.collect_set(source)).alias("sources"), F.count(F.lit(1)).alias("n"))


STAGES = ["initial_access", "execution", "persistence", "lateral_movement", "exfiltration"]


def kill_chain(df: DataFrame, kind: str, text: str) -> DataFrame:
    """A row per event and stage that its type or text suggests."""
    k, t = F.lower(F.col(kind)), F.lower(F.col(text))
    any_in = lambda c, *ws: F.array_contains(F.array(*[c.contains(w) for w in ws]), True)
    tests = [
        any_in(k, "login", "auth"), k.contains("exec") | any_in(t, "powershell", "cmd"), any_in(t, "registry", "startup", "scheduled task"),
        any_in(t, "remote", "psexec", "lateral"), any_in(k, "exfil", "large_upload") | t.contains("transfer"),
    ]
    stages = F.array_compact(F.array(*[F.when(c, F.lit(s)) for s, c in zip(STAGES, tests)]))
    return df.withColumn("stage", F.explode(stages))


def kill_chain_timeline(events: DataFrame, case: str, ts: str, kind: str, text: str) -> DataFrame:
    """(case, stage, n, first_seen, last_seen): how often and when each case shows a stage; an event may show several."""
    g = kill_chain(events, kind, text).groupBy(case, "stage")
    return g.agg(F.count(F.lit(1)).alias("n"), F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"))


def first_and_last(events: DataFrame, case: str, order: list[str], n: int) -> DataFrame:
    """The first and the last ``n`` events of each case by ``order``, each event once (``order`` tells events apart).

    Both cuts are limits of a group, which every task applies to its own rows before the shuffle, so a case of
    millions of events sends 2 n of them from a task.
    """
    def cut(columns) -> DataFrame:
        return events.withColumn("_r", F.row_number().over(Window.partitionBy(case).orderBy(*columns))).filter(F.col("_r") <= n).drop("_r")

    return cut(order).union(cut([F.desc(c) for c in order])).dropDuplicates([case, *order])


# The steps a report recommends.
REMEDIATION = (
    "Isolate affected endpoints", "Reset impacted credentials", "Block malicious indicators at edge/firewall", "Hunt for related IOCs in last 72h",
)


def incident_report(events: DataFrame, case: str, ts: str, tie: str, host: str, criticality: str, kind: str, text: str, n: int = 5) -> DataFrame:
    """A row per case: score, severity, systems, techniques, stages with first and last sight, timeline, summary, remedies.

    The timeline has the first and last ``n`` events; all else is from all events. Systems are the case's distinct hosts,
    techniques those that a text hints at, both sorted; stages follow the kill chain.
    """
    from .detect import ttps_of_text

    score = incident_score(events, case, host, criticality, kind, text).select(case, "events", "score", "severity")
    seen = events.groupBy(case).agg(F.array_sort(F.collect_set(host)).alias("systems"), F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"))
    hints = events.select(case, F.explode(ttps_of_text(F.col(text))).alias("_t")).groupBy(case).agg(F.array_sort(F.collect_set("_t")).alias("techniques"))
    place = F.array_position(F.array(*map(F.lit, STAGES)), F.col("stage"))
    stages = kill_chain_timeline(events, case, ts, kind, text).groupBy(case).agg(
        F.array_sort(F.collect_list(F.struct(place.alias("place"), "stage", "n", "first_seen", "last_seen"))).alias("stages")
    )
    ends = first_and_last(events.select(case, ts, tie, kind), case, [ts, tie], n)
    timeline = ends.groupBy(case).agg(F.array_sort(F.collect_list(F.struct(F.col(ts).alias("ts"), F.col(tie).alias("id"), F.col(kind).alias("kind")))).alias("timeline"))
    out = score.join(seen, case).join(hints, case, "left").join(stages, case, "left").join(timeline, case)
    return out.withColumns({
        "systems": F.coalesce("systems", F.array().cast("array<string>")), "techniques": F.coalesce("techniques", F.array().cast("array<string>")),
        "confidence": F.least(F.lit(1.0), 0.4 + 0.1 * F.size(F.coalesce("techniques", F.array().cast("array<string>")))),
        "summary": incident_summary(F.col(case), F.col("severity")),
        "remediation": F.array(*map(F.lit, REMEDIATION)),
    })


def hunt_all(df: DataFrame, source: str = "source", destination: str = "destination", port: str = "port", volume: str = "bytes") -> DataFrame:
    """(hunt, source, value, severity): what each hunt found, high; a hunt that found nothing has one row, low."""
    rows = [
        hunt_above(df, source, F.sum(volume), 0.95).select(F.lit("exfiltration").alias("hunt"), F.col(source).alias("source"), F.col("value").cast("double").alias("value")),
        hunt_above(df, source, F.count_distinct(destination), 0.9).select(F.lit("fanout").alias("hunt"), F.col(source).alias("source"), F.col("value").cast("double").alias("value")),
        port_scans(df, source, port).select(F.lit("scan").alias("hunt"), F.col(source).alias("source"), F.col("ports").cast("double").alias("value")),
    ]
    found = rows[0].unionByName(rows[1]).unionByName(rows[2])
    names = df.sparkSession.createDataFrame([("exfiltration",), ("fanout",), ("scan",)], "hunt string")
    severity = F.when(F.col("source").isNull(), "low").otherwise("high")
    return F.broadcast(names).join(found, "hunt", "left").select("hunt", "source", "value", severity.alias("severity"))  # three rows


def investigation_context(events: DataFrame, entities: DataFrame, as_of: str, hours: int = 72, ts: str = "ts") -> DataFrame:
    """Events of the last hours of every entity (case_id, ip) that has any."""
    end = F.lit(as_of).cast("timestamp_ntz")
    recent = events.filter((F.col(ts) <= end) & (F.col(ts) >= end - F.expr(f"INTERVAL {hours} HOUR")))
    return recent.join(entities.select("case_id", F.col("ip").alias("_ip")), F.col("ip") == F.col("_ip")).drop("_ip")


def shared_cases(entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((case_id, ip) of one case for each set of addresses, (case_id, like)): the cases with the addresses of case ``like``.

    Cases of the same addresses have the same events. So events meet one of them only, and what is found of it holds for
    the others (``for_all_cases``): the work grows with the events, not with events times cases.
    """
    sets = entities.groupBy("case_id").agg(F.sort_array(F.collect_list("ip")).alias("_ips"))
    likes = sets.groupBy("_ips").agg(F.min("case_id").alias("like"))
    members = sets.join(likes, "_ips").select("case_id", "like")
    return likes.select(F.col("like").alias("case_id"), F.explode("_ips").alias("ip")), members


def for_all_cases(found: DataFrame, members: DataFrame, case: str = "case_id") -> DataFrame:
    """What was found of the cases that stand for others, for every case."""
    out = found.withColumnRenamed(case, "like").join(members.withColumnRenamed("case_id", case), "like").select(*found.columns)
    return out.withColumn("summary", incident_summary(F.col(case), F.col("severity"))) if "summary" in found.columns else out


def incident_summary(case: Column, severity: Column) -> Column:
    return F.concat(F.lit("Incident around "), case.cast("string"), F.lit(" classified as "), severity, F.lit("."))


def incident_score(events: DataFrame, case: str, host: str, criticality: str, kind: str, text: str) -> DataFrame:
    """Severity of each case from its events, hosts, asset criticality, exfiltration and lateral movement."""
    k, t = F.lower(F.col(kind)), F.lower(F.col(text))
    exfil = (k.contains("exfil") | k.contains("large_upload") | t.contains("transfer")).cast("int")
    lateral = (t.contains("remote") | t.contains("psexec") | t.contains("lateral")).cast("int")
    g = events.groupBy(case).agg(
        F.count(F.lit(1)).alias("events"), F.count_distinct(host).alias("hosts"), F.coalesce(F.max(criticality), F.lit(1.0)).alias("criticality"),
        F.max(exfil).alias("exfil"), F.max(lateral).alias("lateral"),
    )
    s = (
        0.2 + F.least(F.lit(0.2), F.col("events") * 0.03) + F.least(F.lit(0.3), F.col("hosts") * 0.05) + F.least(F.lit(0.3), F.col("criticality") / 10)
        + F.col("exfil") * 0.2 + F.col("lateral") * 0.15
    )
    out = g.withColumn("score", F.least(F.lit(1.0), s))
    c = F.col("score")
    return out.withColumn("severity", F.when(c >= 0.8, "critical").when(c >= 0.65, "high").when(c >= 0.45, "medium").otherwise("low"))


def flow_anomalies(flows: DataFrame, least_z: float = 1.5) -> DataFrame:
    """(kind, entity, value, z): sources by fan-out and volume, destinations by fan-in, beyond ``least_z`` deviations."""
    measures = [
        ("fan_out", "source", F.count_distinct("destination")), ("fan_in", "destination", F.count_distinct("source")),
        ("volume", "source", F.sum("bytes")),
    ]
    out = None
    for kind, by, measure in measures:
        g = flows.groupBy(F.col(by).alias("entity")).agg(measure.cast("double").alias("value"))
        stats = g.agg(F.avg("value").alias("_m"), F.stddev_pop("value").alias("_d"))
        z = F.abs(F.col("value") - F.col("_m")) / (F.col("_d") + 0.001)
        odd = g.crossJoin(F.broadcast(stats)).select(F.lit(kind).alias("kind"), "entity", "value", z.alias("z"))  # one row
        out = odd if out is None else out.unionByName(odd)
    return out.filter(F.col("z") > least_z)


def forensic_report(df: DataFrame, scan_ports: int = 100) -> DataFrame:
    """The whole report as (section, metric, value): totals, protocols, times, ports, anomalies and topology."""
    from duskline.functions.scalars import port_class

    from .graph import topology
    from .report import temporal_profile, traffic_basic
    from .series import volume_anomalies

    row = lambda d, section, metric, value: d.select(F.lit(section).alias("section"), metric.cast("string").alias("metric"), value.cast("double").alias("value"))
    wide = lambda d, section: d.select(*[F.col(c).cast("double") for c in d.columns]).unpivot([], d.columns, "metric", "value").select(F.lit(section).alias("section"), "metric", "value")
    n = F.count(F.lit(1))
    basic = traffic_basic(df).drop("first", "last")
    protocols = df.groupBy("protocol").agg(n.alias("n"), F.sum("bytes").alias("b"))
    times = temporal_profile(df)
    ports = df.groupBy(port_class("port").alias("c")).agg(n.alias("n"))
    odd_hours = volume_anomalies(df.withColumn("_h", F.hour("ts")), F.col("_h"))
    graph = topology(df.select(F.concat(F.lit("s"), F.col("source").cast("string")).alias("src"), F.concat(F.lit("d"), F.col("destination").cast("string")).alias("dst")), two_kinds=True)
    parts = [
        wide(basic, "basic"), row(protocols, "protocol", F.col("protocol"), F.col("n")), row(protocols, "protocol_bytes", F.col("protocol"), F.col("b")),
        row(times, "time", F.concat_ws(":", "unit", F.col("slot").cast("string")), F.col("n")),
        row(times.filter("peak"), "peak", F.col("unit"), F.col("slot")), row(ports, "port_class", F.col("c"), F.col("n")),
        row(odd_hours.agg(n.alias("n")), "anomalies", F.lit("volume_hours"), F.col("n")),
        row(port_scans(df, "source", "port", scan_ports).agg(n.alias("n")), "anomalies", F.lit("port_scan_sources"), F.col("n")),
        row(rare_groups(df, "protocol").agg(n.alias("n")), "anomalies", F.lit("rare_protocols"), F.col("n")),
        wide(graph, "topology"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
