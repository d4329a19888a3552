"""Joins that enrich events: assets, geography, intelligence, baselines, policies, blocks, pairs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def enrich_assets(events: DataFrame, assets: DataFrame, ip: str = "ip", host: str = "host") -> DataFrame:
    """Add the asset's criticality: by ip first, then by host name, 1 by default. Two equi-joins in place of an OR."""
    best = F.max("criticality_score")
    by_ip = assets.groupBy(F.col("ip").alias("_ip")).agg(best.alias("_by_ip"))
    by_host = assets.groupBy(F.col("hostname").alias("_host")).agg(best.alias("_by_host"))
    out = events.join(by_ip, F.col(ip) == F.col("_ip"), "left").join(by_host, F.col(host) == F.col("_host"), "left")
    return out.withColumn("criticality", F.coalesce("_by_ip", "_by_host", F.lit(1.0))).drop("_ip", "_host", "_by_ip", "_by_host")


def ip_to_long(ip: Column | str) -> Column:
    parts = F.split(F.col(ip) if isinstance(ip, str) else ip, r"\.")
    return sum((parts[i].try_cast("bigint") * (256 ** (3 - i)) for i in range(4)), F.lit(0))


def range_join(left: DataFrame, point: Column, ranges: DataFrame, start: str, end: str, width: int, how: str = "left") -> DataFrame:
    """Join points to the ranges [start, end] that hold them, by equality on buckets of ``width``."""
    spread = ranges.withColumn("_b", F.explode(F.sequence((F.col(start) / width).cast("bigint"), (F.col(end) / width).cast("bigint"))))
    keyed = left.withColumn("_p", point).withColumn("_lb", (F.col("_p") / width).cast("bigint"))
    on = (F.col("_lb") == F.col("_b")) & F.col("_p").between(F.col(start), F.col(end))
    return keyed.join(spread, on, how).drop("_p", "_lb", "_b")


def enrich_geo(events: DataFrame, ranges: DataFrame, ip: str = "ip") -> DataFrame:
    """Add the columns of the range table (start_ip, end_ip, ...) whose range holds the address; buckets are /16."""
    return range_join(events, ip_to_long(ip), ranges, "start_ip", "end_ip", 65536).drop("start_ip", "end_ip")


def enrich_threat_intel(events: DataFrame, intel: DataFrame, ip: str = "ip") -> DataFrame:
    """Greatest score of the sources: malicious from 80, suspicious from 40; tags of sources from 60."""
    i = intel.withColumnRenamed("ip", "_ip")
    top = F.greatest(F.coalesce("virustotal_score", F.lit(0.0)), F.coalesce("abuseipdb_score", F.lit(0.0)))
    out = events.join(i, F.col(ip) == F.col("_ip"), "left").withColumn("intel_score", top)
    tags = F.array_compact(
        F.array(F.when(F.col("virustotal_score") >= 60, "virustotal"), F.when(F.col("abuseipdb_score") >= 60, "abuseipdb"))
    )
    verdict = F.when(F.col("intel_score") >= 80, "malicious").when(F.col("intel_score") >= 40, "suspicious").otherwise("clean")
    return out.withColumn("reputation", verdict).withColumn("intel_tags", tags).drop("_ip")


def ip_reputation(ips: DataFrame, intel: DataFrame, ip: str = "ip") -> DataFrame:
    """Distinct addresses with their verdict."""
    return enrich_threat_intel(ips.select(ip).distinct(), intel, ip).select(ip, "intel_score", "reputation")


def ioc_reputation(iocs: DataFrame, bad: DataFrame, good: DataFrame, ioc: str = "ioc") -> DataFrame:
    """0.5 for an unknown indicator, 0.9 if it is listed as malicious, 0.1 if it is allowed (which wins)."""
    b = bad.select(F.col(ioc).alias("_bad")).distinct()
    g = good.select(F.col(ioc).alias("_good")).distinct()
    out = iocs.join(b, F.col(ioc) == F.col("_bad"), "left").join(g, F.col(ioc) == F.col("_good"), "left")
    score = F.when(F.col("_good").isNotNull(), 0.1).when(F.col("_bad").isNotNull(), 0.9).otherwise(0.5)
    return out.withColumn("reputation", score).drop("_bad", "_good")


#: What one task is to hold: candidates of a pair join, and pairs if those of two entities meet in one task.
CANDIDATES, HELD = 8_000_000, 4_000_000


def pair_within(df: DataFrame, entity: str, ts: str, seconds: int, block: str | None = None, most: int = 4096, together: int | None = None) -> DataFrame:
    """Pairs of rows of different entities (structs a < b) that share ``block`` (if any) and lie within ``seconds``.

    An equi-join on the block and a bucket of half the time: a row meets its own bucket and the next two, so each two
    rows meet once, and are then put in the order of their entities. The buckets are counted first: the tasks follow from
    the pairs, not from the bytes, and a bucket of more than ``most`` rows is dealt to so many parts that each holds about
    ``most`` rows of the left side, and what is to meet it goes to every part, so no task holds a hot block. No pair is
    lost or made twice. Null entities and blocks pair with nothing.

    ``together``: all pairs of the same two entities are made in one task, of about so many pairs, and have a column
    ``_deal``, so that a grouping by ``_deal`` and the entities shuffles no pair. Entities are dealt to blocks, and a row
    goes to the tasks of its block with each other: rows are shuffled, by the root of the number of tasks.
    """
    key = F.col(block) if block else F.lit(0)
    rows = df.filter(F.col(entity).isNotNull() & F.col(ts).isNotNull() & key.isNotNull())
    bucket = F.floor(F.unix_timestamp(ts) * 2 / seconds).cast("bigint")
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    sizes = rows.groupBy(key.alias("_h"), bucket.alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    n = F.col("_n").cast("double")
    largest, squares = sizes.agg(F.max("_n"), F.sum(n * n)).first()
    cores = df.sparkSession.sparkContext.defaultParallelism
    parts = max(cores, math.ceil(3 * (squares or 0) / CANDIDATES))
    if together:
        blocks = math.ceil(math.sqrt(max(2 * cores, 4 * (squares or 0) / together)))
        x, y = F.col("_x"), F.col("_y")
        every = rows.select(F.struct(F.struct(*df.columns).alias("r"), F.col(entity).alias("e"), micros.alias("m")).alias("_r"), key.alias("_k"), bucket.alias("_t"), F.pmod(F.xxhash64(entity), F.lit(blocks)).cast("int").alias("_x"))
        every = every.withColumn("_y", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        every = every.select("_r", "_k", "_t", (F.least(x, y) * blocks + F.greatest(x, y)).alias("_ad"), (x <= y).alias("_left"), (x >= y).alias("_right"))
        every = every.repartition(2 * blocks * (blocks + 1), "_ad")  # four times the tasks that have rows: few share a partition
        own = F.struct(F.col("_t"), F.lit(True).alias("_l"))
        around = F.array(*[F.struct((F.col("_t") + i).alias("_t"), F.lit(False).alias("_l")) for i in range(-2, 3)])
        at = F.when(F.col("_left") & F.col("_right"), F.array_append(around, own)).when(F.col("_left"), F.array(own)).otherwise(around)
        met = every.select("_r", "_k", "_ad", F.explode(at).alias("_w")).groupBy("_ad", "_k", "_w._t").agg(*[F.collect_list(F.when(F.col("_w._l") == (c == "_a"), F.col("_r"))).alias(c) for c in ("_a", "_b")])
        met = met.select("_ad", F.explode("_a").alias("_a"), "_b").select("_ad", "_a", F.explode("_b").alias("_b"))
        a, b = F.col("_a"), F.col("_b")
        gap = F.abs(a["m"] - b["m"])
        # the tasks of a block with itself, multiples of blocks + 1, hold each two rows twice
        near = met.filter((gap <= seconds * 1_000_000) & ((a["e"] < b["e"]) | ((F.pmod("_ad", F.lit(blocks + 1)) > 0) & (a["e"] > b["e"]))))
        pick = lambda x, y: F.when(a["e"] < b["e"], x["r"]).otherwise(y["r"])
        return near.select(pick(a, b).alias("a"), pick(b, a).alias("b"), (gap / 1e6).alias("gap_seconds"), F.col("_ad").alias("_deal"))
    side = lambda x: rows.select(*[F.col(c).alias(f"_{x}{i}") for i, c in enumerate(df.columns)], key.alias(f"_{x}k"), bucket.alias(f"_{x}t"), micros.alias(f"_{x}m"))
    left, right = side("a"), side("b").select("*", F.posexplode(F.array(*[F.col("_bt") - i for i in range(3)])).alias("_step", "_to")).drop("_bt").withColumnRenamed("_to", "_bt")
    on = ["k", "t"]
    if (largest or 0) > most:
        hot = sizes.filter(F.col("_n") > most).select("_h", "_b", F.ceil(F.col("_n") / most).cast("int").alias("_p"))
        dealt = lambda d, x: d.join(hot, (F.col(f"_{x}k") == F.col("_h")) & (F.col(f"_{x}t") == F.col("_b")), "left").withColumn("_p", F.coalesce("_p", F.lit(1))).drop("_h", "_b")
        left = dealt(left, "a").withColumn("_as", F.pmod(F.xxhash64(*[f"_a{i}" for i in range(len(df.columns))]), F.col("_p")).cast("int")).drop("_p")
        right = dealt(right, "b").withColumn("_bs", F.explode(F.sequence(F.lit(0), F.col("_p") - 1))).drop("_p")
        on = ["k", "t", "s"]
    left, right = left.repartition(parts, *[f"_a{c}" for c in on]), right.repartition(parts, *[f"_b{c}" for c in on])
    pairs = left.join(right, [F.col(f"_a{c}") == F.col(f"_b{c}") for c in on])
    fits = F.col("_step") > 0
    at = df.columns.index(entity)
    first, second = F.col(f"_a{at}"), F.col(f"_b{at}")
    gap = F.abs(F.col("_am") - F.col("_bm"))
    near = (gap <= seconds * 1_000_000) & ((first < second) | (fits & (first > second)))
    ordered = lambda x, y: F.struct(*[F.when(first < second, F.col(f"_{x}{i}")).otherwise(F.col(f"_{y}{i}")).alias(c) for i, c in enumerate(df.columns)])
    return pairs.filter(near).select(ordered("a", "b").alias("a"), ordered("b", "a").alias("b"), (gap / 1e6).alias("gap_seconds"))


def attach_baseline(points: DataFrame, baselines: DataFrame, key: str, ts: str, value: str, within: str = "day") -> DataFrame:
    """As-of join: each point gets the latest baseline of its key at or before it.

    Baselines are carried forward inside time chunks (``within``), and from chunk to chunk by their last value,
    so a hot key is spread over its chunks.
    """
    p = points.withColumn("_kind", F.lit(1)).withColumn("_base", F.lit(None).cast("double"))
    b = baselines.select(F.col(key), F.col(ts), F.col(value).alias("_base"), F.lit(0).alias("_kind"))
    both = p.unionByName(b, allowMissingColumns=True).withColumn("_chunk", F.date_trunc(within, ts))
    ends = b.groupBy(key, F.date_trunc(within, ts).alias("_chunk")).agg(F.max_by("_base", ts).alias("_last"))
    chunks = both.select(key, "_chunk").distinct().join(ends, [key, "_chunk"], "left")
    earlier = Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = chunks.withColumn("_before", F.last("_last", ignorenulls=True).over(earlier)).drop("_last")
    inside = Window.partitionBy(key, "_chunk").orderBy(ts, "_kind").rowsBetween(Window.unboundedPreceding, 0)
    filled = both.withColumn("_now", F.last("_base", ignorenulls=True).over(inside)).filter("_kind = 1")
    out = filled.join(carried, [key, "_chunk"], "left").withColumn("baseline", F.coalesce("_now", "_before"))
    return out.drop("_kind", "_base", "_now", "_before", "_chunk")


def match_policy(requests: DataFrame, policies: DataFrame, key: str = "request_id") -> DataFrame:
    """The enabled policy of highest priority whose endpoint pattern (``*`` ends it) and sets fit each request.

    ``policies`` is a rule table; it is joined by condition.
    """
    prefix = F.regexp_replace("endpoint", r"\*$", "")
    wild = F.col("endpoint").endswith("*")
    fits = F.when(wild, F.col("path").startswith(prefix)).otherwise(F.col("path") == F.col("endpoint"))
    any_of = lambda col, arr: (F.size(arr) == 0) | F.array_contains(arr, F.col(col))
    joined = requests.join(policies.filter("enabled"), fits & any_of("method", F.col("methods")))
    best = Window.partitionBy(key).orderBy(F.desc("priority"), "policy_id")
    return joined.withColumn("_r", F.row_number().over(best)).filter("_r = 1").drop("_r")


def apply_blocks(requests: DataFrame, blocks: DataFrame) -> DataFrame:
    """Flag requests that fall in a blocked interval (ip, start, end) of their address."""
    b = blocks.select(F.col("ip").alias("_ip"), "start", "end")
    hit = requests.join(b, (F.col("ip") == F.col("_ip")) & F.col("ts").between(F.col("start"), F.col("end")), "left_semi")
    marked = hit.select("request_id").distinct().withColumn("blocked", F.lit(True))
    return requests.join(marked, "request_id", "left").withColumn("blocked", F.coalesce("blocked", F.lit(False)))


def combine(*frames: DataFrame) -> DataFrame:
    """Union by name; missing columns are null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def top_k(df: DataFrame, by: str, k: int) -> DataFrame:
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), by).limit(k)


def top_k_per_group(df: DataFrame, key: list[str], order: list[Column], k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter(F.col("rank") <= k)


def common_tokens(a: Column, b: Column, sep: str = r"[/ ]") -> Column:
    tokens = lambda x: F.filter(F.split(F.lower(x), sep), lambda y: F.length(y) > 0)
    return F.array_sort(F.array_intersect(tokens(a), tokens(b)))


def dedupe_alerts(df: DataFrame, keys: list[str], window: str, cap: int, least_rank: int = 0) -> DataFrame:
    """First alert per content hash and window, at least of a severity, at most ``cap`` a minute."""
    from duskline.functions.scalars import severity_rank

    h = F.sha2(F.concat_ws("|", *[F.col(k).cast("string") for k in keys]), 256)
    rows = df.filter(severity_rank("severity") >= least_rank).withColumn("alert_hash", h)
    first = Window.partitionBy("alert_hash", F.window("ts", window)).orderBy("ts", "request_id")
    once = rows.withColumn("_r", F.row_number().over(first)).filter("_r = 1").drop("_r")
    minute = Window.partitionBy(F.date_trunc("minute", "ts")).orderBy("ts", "request_id")
    return once.withColumn("_r", F.row_number().over(minute)).filter(F.col("_r") <= cap).drop("_r")


# --- filters, listings and hits -----------------------------------------------------------------


def filter_nodes(nodes: DataFrame, prop: str, text: str, order: str, offset: int = 0, limit: int = 100) -> DataFrame:
    """A page of the nodes whose property holds ``text``."""
    return page(nodes.filter(F.col(prop).contains(text)), [order], offset, limit)


def list_edges(edges: DataFrame, kind: str, offset: int = 0, limit: int = 100) -> DataFrame:
    """A page of the edges of one type."""
    return page(edges.filter(F.col("type") == kind), ["src", "dst"], offset, limit)


def suppress_whitelisted(alerts: DataFrame, rules: DataFrame, field: str = "ip", most_tune: float = 0.5) -> DataFrame:
    """Alerts whose ``field`` no rule (value, tune) with a tune of at most ``most_tune`` names."""
    return alerts.join(rules.filter(F.col("tune") <= most_tune), F.col(field) == F.col("value"), "left_anti")


def deception_hits(requests: DataFrame, traps: DataFrame, path: str = "path") -> DataFrame:
    """Requests for a decoy, with the kind of trap; ``traps`` has (trap_path, trap)."""
    return requests.join(traps, F.col(path) == F.col("trap_path")).drop("trap_path")


def session_chain(df: DataFrame) -> DataFrame:
    """Per user and session: the distinct addresses and paths, sorted."""
    sorted_set = lambda c: F.array_sort(F.collect_set(c))
    return df.groupBy("user_id", "session_id").agg(sorted_set("ip").alias("ips"), sorted_set("path").alias("paths"))


def access_path(df: DataFrame, key: str, value, k: int = 50, ts: str = "ts", tie: str = "request_id") -> DataFrame:
    """The first ``k`` requests of one user or session in time order, with their position."""
    first = df.filter(F.col(key) == F.lit(value)).orderBy(ts, tie).limit(k)
    return first.withColumn("position", F.row_number().over(Window.partitionBy(key).orderBy(ts, tie)))


def threat_patterns(df: DataFrame, since: str, least_risk: float, k: int = 100, ts: str = "ts") -> DataFrame:
    """Most frequent (type, path) of risky requests from a time on."""
    hit = df.filter((F.col(ts) >= F.lit(since).cast(df.schema[ts].dataType)) & (F.col("risk_score") > least_risk))
    return hit.groupBy("event_type", "path").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "event_type", "path").limit(k)


def devices_by_pattern(df: DataFrame, text: str, since: str | None = None, k: int = 50, ts: str = "ts") -> DataFrame:
    """Most frequent agents that hold ``text``, from a time on."""
    hit = df.filter(F.col("user_agent").contains(text))
    if since is not None:
        hit = hit.filter(F.col(ts) >= F.lit(since).cast(df.schema[ts].dataType))
    return hit.groupBy("user_agent").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "user_agent").limit(k)


def top_violators(df: DataFrame, bad: Column, key: str = "ip", k: int = 10, ts: str = "ts") -> DataFrame:
    """Keys with most violations, and when they were last seen."""
    g = df.filter(bad).groupBy(key).agg(F.count(F.lit(1)).alias("violations"), F.max(ts).alias("last_seen"))
    return g.orderBy(F.desc("violations"), key).limit(k)


def page(df: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def distinct_values(df: DataFrame, key: str, value: str) -> DataFrame:
    """Per key the sorted distinct values."""
    return df.groupBy(key).agg(F.array_sort(F.collect_set(value)).alias("values"))


def new_items(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Distinct rows of ``current``, marked ``new`` or ``kept`` by whether ``previous`` has them."""
    new = current.subtract(previous).withColumn("state", F.lit("new"))
    return new.unionByName(current.intersect(previous).withColumn("state", F.lit("kept")))


def kept_items(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Distinct rows of ``current`` that ``previous`` has too; null equals null."""
    return current.intersect(previous)


def user_session_ip(edges: DataFrame) -> DataFrame:
    """(user_id, session_id, ip): the chains of USED and CONNECTED_TO edges (src, dst, type) through a session."""
    used = edges.filter("type = 'USED'").select(F.col("src").alias("user_id"), F.col("dst").alias("session_id"))
    met = edges.filter("type = 'CONNECTED_TO'").select(F.col("src").alias("session_id"), F.col("dst").alias("ip"))
    return used.join(met, "session_id").select("user_id", "session_id", "ip").distinct()
