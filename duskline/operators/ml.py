"""Features, encoders, models and their evaluation."""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import _checkpoint
from .quantiles import exact_quantiles
from .running import ranges_of, running_sums


def request_features(df: DataFrame) -> DataFrame:
    """Requests with their rate per address and minute, endpoints per session, latency and error rate per address."""
    endpoints = df.groupBy("session_id").agg(F.count_distinct("path").alias("endpoints"))
    per_ip = df.groupBy("ip").agg(
        F.avg("duration_ms").alias("mean_latency"), F.avg((F.col("status_code") >= 400).cast("int")).alias("error_rate")
    )
    minute = Window.partitionBy("ip", F.date_trunc("minute", "ts"))
    return df.withColumn("per_minute", F.count(F.lit(1)).over(minute)).join(endpoints, "session_id").join(per_ip, "ip")


def ml_features(df: DataFrame) -> DataFrame:
    """``request_features`` with time, origin and agent flags."""
    from duskline.functions.scalars import browser_anomaly, is_bot

    return (
        request_features(df)
        .withColumn("hour", F.hour("ts"))
        .withColumn("day_of_week", F.weekday("ts"))
        .withColumn("is_weekend", (F.weekday("ts") >= 5).cast("int"))
        .withColumn("is_foreign", (~F.col("country").isin("US", "CA", "GB")).cast("int"))
        .withColumn("is_bot", is_bot("user_agent").cast("int"))
        .withColumn("browser_anomaly", browser_anomaly("user_agent").cast("int"))
    )


def impute(df: DataFrame, numeric: list[str], categorical: list[str]) -> DataFrame:
    """Nulls become the median of a numeric column, or ``unknown`` in a text column."""
    stats = df.agg(*[F.median(x).alias(f"_{x}") for x in numeric])
    out = df.crossJoin(F.broadcast(stats))  # one row
    for x in numeric:
        out = out.withColumn(x, F.coalesce(F.col(x).cast("double"), f"_{x}")).drop(f"_{x}")
    for x in categorical:
        out = out.withColumn(x, F.coalesce(x, F.lit("unknown")))
    return out


def label_encode(df: DataFrame, col: str) -> DataFrame:
    """Index values by their sort order, from 0; null has none.

    Distinct values are sorted by range over all tasks and numbered through the partitions' sizes.
    """
    values = df.select(col).filter(F.col(col).isNotNull()).distinct().orderBy(col)
    order = df.sparkSession.createDataFrame(values.rdd.zipWithIndex().map(lambda x: (x[0][0], x[1])), f"`{col}` {df.schema[col].dataType.simpleString()}, `{col}_index` long")
    return df.join(order, col, "left").withColumn(f"{col}_index", F.col(f"{col}_index").cast("int"))


def target_encode(df: DataFrame, col: str, label: str) -> DataFrame:
    return df.join(df.groupBy(col).agg(F.avg(label).alias(f"{col}_target")), col, "left")


def standard_scale(df: DataFrame, cols: list[str]) -> DataFrame:
    stats = df.agg(*[F.avg(x).alias(f"_m_{x}") for x in cols], *[F.stddev_pop(x).alias(f"_s_{x}") for x in cols])
    out = df.crossJoin(F.broadcast(stats))  # one row
    for x in cols:
        out = out.withColumn(x, F.coalesce(F.try_divide(F.col(x) - F.col(f"_m_{x}"), F.col(f"_s_{x}")), F.lit(0.0)))
    return out.drop(*[f"_m_{x}" for x in cols], *[f"_s_{x}" for x in cols])


def stratified_split(df: DataFrame, label: str, key: str, share: float = 0.8, seed: int = 42) -> DataFrame:
    """Add ``is_train``: the first share of each label's rows in hash order of the key.

    Rows are numbered inside 4096 ranges of the hash, and ranges by their counts, so that no task orders a whole label.
    """
    rows = df.withColumn("_h", F.xxhash64(F.lit(seed), key)).withColumn("_c", F.shiftright("_h", 52))
    sizes = rows.groupBy(F.col(label).alias("_l"), F.col("_c").alias("_c2")).agg(F.count(F.lit(1)).alias("_k"))
    earlier = Window.partitionBy("_l").orderBy("_c2").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.withColumns({"_b": F.coalesce(F.sum("_k").over(earlier), F.lit(0)), "_n": F.sum("_k").over(Window.partitionBy("_l"))})
    joined = rows.join(before, F.col(label).eqNullSafe(F.col("_l")) & (F.col("_c") == F.col("_c2")))
    r = F.col("_b") + F.row_number().over(Window.partitionBy(label, "_c").orderBy("_h", key))
    out = joined.withColumn("_r", r).withColumn("is_train", F.col("_r") <= F.floor(F.col("_n") * F.lit(Decimal(str(share)))))
    return out.select(*df.columns, "is_train")


def assemble(df: DataFrame, cols: list[str]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=cols, outputCol="features", handleInvalid="skip").transform(df)


def balanced(df: DataFrame, label: str) -> DataFrame:
    """Add weights inverse to the label's share."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n").alias("_t"), F.count(F.lit(1)).alias("_k"))
    w = counts.crossJoin(F.broadcast(total)).select(label, (F.col("_t") / (F.col("_k") * F.col("_n"))).alias("weight"))
    return df.join(F.broadcast(w), label)  # one row a label, which a shuffle would put into one task each


def train_forest(df: DataFrame, cols: list[str], label: str, trees: int = 20, seed: int = 42):
    from pyspark.ml.classification import RandomForestClassifier

    rows = assemble(balanced(df, label), cols)
    return RandomForestClassifier(labelCol=label, weightCol="weight", numTrees=trees, maxDepth=6, seed=seed).fit(rows)


def train_mlp(df: DataFrame, cols: list[str], label: str, layers=(64, 32, 16), seed: int = 42, iterations: int = 30):
    from pyspark.ml.classification import MultilayerPerceptronClassifier

    rows = assemble(df, cols)
    return MultilayerPerceptronClassifier(labelCol=label, layers=[len(cols), *layers, 2], seed=seed, maxIter=iterations).fit(rows)


def _grow(x: np.ndarray, depth: int, rng) -> tuple | int:
    if depth == 0 or len(x) <= 1:
        return len(x)
    f = int(rng.integers(x.shape[1]))
    lo, hi = x[:, f].min(), x[:, f].max()
    if lo == hi:
        return len(x)
    cut = float(rng.uniform(lo, hi))
    left = x[:, f] < cut
    return f, cut, _grow(x[left], depth - 1, rng), _grow(x[~left], depth - 1, rng)


def _path(n: float) -> float:
    return 0.0 if n <= 1 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def train_isolation(df: DataFrame, cols: list[str], key: str, trees: int = 50, sample: int = 256, seed: int = 42):
    """Isolation trees, each grown on its own hash sample; a list of trees.

    A sample has about ``sample`` rows, or fewer if the table has fewer than ``trees * sample``. Of a hash group that
    comes out larger, the ``4 * sample`` rows of least hash are taken, so that a fit can be repeated.
    """
    n = df.count()
    parts = df.withColumn("_h", F.pmod(F.xxhash64(F.lit(seed), key), F.lit(max(trees, -(-n // sample))))).filter(F.col("_h") < trees)
    parts = parts.withColumn("_o", F.xxhash64(F.lit(seed + 1), key))

    def grow(k: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        import pickle

        rng = np.random.default_rng(seed + int(k[0]))
        x = pdf.sort_values("_o")[cols].to_numpy(float)[: 4 * sample]
        return pd.DataFrame({"tree": [pickle.dumps((_grow(x, int(np.ceil(np.log2(max(len(x), 2)))), rng), len(x)))]})

    import pickle

    return [pickle.loads(r.tree) for r in parts.groupBy("_h").applyInPandas(grow, "tree binary").collect()]  # one row a tree


def isolation_score(df: DataFrame, forest: list, cols: list[str]) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(forest)

    @F.pandas_udf("double")
    def score(*xs: pd.Series) -> pd.Series:
        x = np.stack([s.to_numpy(float) for s in xs], axis=1)
        total, norm = np.zeros(len(x)), 0.0
        for tree, size in shared.value:
            stack = [(tree, np.arange(len(x)), 0)]
            while stack:
                node, rows, d = stack.pop()
                if isinstance(node, tuple):
                    f, cut, left, right = node
                    m = x[rows, f] < cut
                    stack += [(left, rows[m], d + 1), (right, rows[~m], d + 1)]
                else:
                    total[rows] += d + _path(node)
            norm += _path(size)
        return pd.Series(2.0 ** (-total / max(norm, 1e-9)))

    return df.withColumn("anomaly_score", score(*cols))


def ensemble_score(df: DataFrame, forest: str, network: str, anomaly: str) -> DataFrame:
    """0.4 forest + 0.4 network + 0.2 sigmoid(-anomaly), with the action by bands."""
    s = F.col(forest) * 0.4 + F.col(network) * 0.4 + 0.2 / (1 + F.exp(F.col(anomaly)))
    out = df.withColumn("threat_score", s)
    c = F.col("threat_score")
    return out.withColumn("action", F.when(c >= 0.9, "block").when(c >= 0.7, "challenge").when(c >= 0.5, "monitor").otherwise("allow"))


def reconstruction_anomalies(df: DataFrame, cols: list[str], k: int, pct: float = 0.95) -> DataFrame:
    """Rows whose squared error after PCA with ``k`` components exceeds the percentile of all errors."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    scaled = standard_scale(df, cols)
    rows = scaled.withColumn("features", array_to_vector(F.array(*[F.col(x).cast("double") for x in cols])))
    model = PCA(k=k, inputCol="features", outputCol="_pc").fit(rows)
    pc = model.pc.toArray()
    rows = model.transform(rows).withColumn("_z", vector_to_array("_pc"))
    error = F.lit(0.0)
    for i, x in enumerate(cols):
        back = sum((F.col("_z")[j] * float(pc[i, j]) for j in range(k)), F.lit(0.0))
        error = error + (F.col(x) - back) * (F.col(x) - back)
    rows = rows.withColumn("error", error).drop("_z", "_pc", "features")
    rows = _checkpoint(rows)
    (limit,) = exact_quantiles(rows, "error", [pct])
    return rows.withColumn("is_anomaly", F.col("error") > F.lit(limit))


def auc(df: DataFrame, prob: str, label: str) -> DataFrame:
    """Area under the ROC curve by the rank-sum formula, ties at mean rank; from counts per distinct score.

    Scores are ranked inside ranges of them, and ranges by their totals, so that no task orders all scores.
    """
    g = df.groupBy(prob).agg(F.sum(label).alias("p"), F.sum(1 - F.col(label)).alias("q"))
    g = g.withColumn("_all", F.lit(0))
    below = running_sums(g, "_all", [prob], {"_upto": F.col("q")}, ranges_of(df, prob))
    r = below.withColumn("_w", F.col("p") * (F.col("_upto") - F.col("q") / 2))
    return r.agg((F.sum("_w") / (F.sum("p") * F.sum("q"))).alias("auc"))


def needs_retrain(df: DataFrame, as_of: str, ts: str = "ts", least: int = 1000, max_age_hours: int = 24) -> DataFrame:
    """Whether enough data of the last 7 days or the age of the newest calls for training."""
    now = F.lit(as_of).cast("timestamp_ntz")
    fresh = df.filter((F.col(ts) > now - F.expr("INTERVAL 7 DAY")) & (F.col(ts) <= now))
    out = fresh.agg(F.count(F.lit(1)).alias("n"), F.max(ts).alias("newest"))
    return out.withColumn("retrain", (F.col("n") >= least) | (F.col("newest") < now - F.expr(f"INTERVAL {max_age_hours} HOUR")))


def encode(df: DataFrame, cols: list[str], label: str | None = None, most: int = 10) -> DataFrame:
    """``df`` with ``{col}_encoded``: the mean label of a value where a column has more than ``most`` values, else its index.

    Without a label every column is indexed. At most ``most + 1`` values of a column are looked for to decide. Null is
    no value and is encoded as null.
    """
    out = df
    for c in cols:
        many = label is not None and df.select(c).filter(F.col(c).isNotNull()).distinct().limit(most + 1).count() > most
        if many:
            means = df.filter(F.col(c).isNotNull()).groupBy(c).agg(F.avg(label).alias(f"{c}_encoded"))
            out = out.join(means, c, "left")
        else:
            out = label_encode(out, c).withColumnRenamed(f"{c}_index", f"{c}_encoded").withColumn(f"{c}_encoded", F.col(f"{c}_encoded").cast("double"))
    return out.select(*df.columns, *[f"{c}_encoded" for c in cols])


def confusion_matrix(df: DataFrame, pred: str, label: str) -> DataFrame:
    """(label, predicted, n) for every pair of classes that occur on either side, 0 included; rows with a null are left out."""
    counts = df.filter(F.col(pred).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(label).alias("label"), F.col(pred).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))
    classes = counts.select(F.explode(F.array("label", "predicted")).alias("c")).distinct()
    grid = classes.select(F.col("c").alias("label")).crossJoin(F.broadcast(classes.select(F.col("c").alias("predicted"))))  # classes, not rows
    return grid.join(counts, ["label", "predicted"], "left").select("label", "predicted", F.coalesce("n", F.lit(0)).alias("n"))


def evaluation_report(df: DataFrame, pred: str, label: str) -> DataFrame:
    """(class, precision, recall, f1, support) of each class, and of ``accuracy``, ``macro avg`` and ``weighted avg``.

    Everything follows from the confusion counts, one row per pair of classes; undefined ratios are 0. The accuracy
    stands in all three measures of its row.
    """
    m = confusion_matrix(df, pred, label)
    hit = F.sum(F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0)).alias("hit")
    rows = m.groupBy(F.col("label").cast("string").alias("class")).agg(hit, F.sum("n").alias("support"))
    cols = m.groupBy(F.col("predicted").cast("string").alias("class")).agg(F.sum("n").alias("_p"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    c = rows.join(cols, "class").withColumn("precision", ratio(F.col("hit"), F.col("_p"))).withColumn("recall", ratio(F.col("hit"), F.col("support")))
    c = c.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    measures = ["precision", "recall", "f1"]
    n = F.sum("support")
    accuracy = ratio(F.sum("hit"), n)
    total = c.agg(
        F.array(
            F.struct(F.lit("accuracy").alias("class"), *[accuracy.alias(x) for x in measures], n.alias("support")),
            F.struct(F.lit("macro avg").alias("class"), *[F.avg(x).alias(x) for x in measures], n.alias("support")),
            F.struct(F.lit("weighted avg").alias("class"), *[ratio(F.sum(F.col(x) * F.col("support")), n).alias(x) for x in measures], n.alias("support")),
        ).alias("t")
    )
    return c.select("class", *measures, "support").unionByName(total.select(F.explode("t").alias("x")).select("x.*"))
