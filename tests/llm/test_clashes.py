"""Columns of a table that have the names operators use for themselves pass through; ledgers go with release."""

from __future__ import annotations

import os

import numpy as np
from pyspark.sql import functions as F

from duskline.llm import common, htmltext, langid, neardup, packing, secrets, suffixdedup

NAMES = ["_key", "_spans", "_at", "_text", "_blob", "_found", "_h", "_id", "_th", "_decided", "_host", "_paths", "blob", "findings", "spans", "context", "n", "count"]


def table(spark, texts, name="text"):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], f"doc_id long, {name} string")
    return df.withColumns({n: F.concat(F.lit(f"{n}-"), F.col("doc_id").cast("string")) for n in NAMES})


def kept(rows, but=()):
    return all(r[n] == f"{n}-{r.doc_id}" for r in rows for n in NAMES if n not in but)


def test_clashing_columns(spark):
    words = " ".join(f"word{i}" for i in range(60))
    texts = ["token = abcdef12", words, "x " + words, None, "", "plain text of some words here"]
    docs = table(spark, texts)
    for out in (secrets.redact(docs), suffixdedup.remove_repeats(docs), suffixdedup.remove_repeated_passages(docs)):
        rows = out.collect()
        assert out.columns == docs.columns and len(rows) == 6 and kept(rows)
    found = secrets.digest(secrets.scan_versions(docs)).collect()
    assert {r.doc_id: r.n_assign for r in found}[0] == 1 and len(found) == 6
    left = neardup.drop_near_duplicates(docs).collect()
    assert kept(left) and len(left) >= 4
    lang = docs.withColumn("lang", F.lit("en"))
    rows = langid.predict(lang, langid.train(lang)).collect()
    assert kept(rows) and len(rows) == 6
    pages = table(spark, ["<html><body><article><p>Some words of a page that are its main text.</p></article></body></html>", None], "html")
    rows = htmltext.extract(pages.withColumn("url", F.lit("http://a.b/c")).withColumn("text", F.lit("old"))).collect()
    assert kept(rows) and len(rows) == 2 and "main text" in rows[0].text


def test_release_deletes_ledgers(spark):
    docs = spark.createDataFrame([(1, "token = abcdef12")], "doc_id long, text string")
    ledger = secrets.BlobLedger(spark)
    ledger.update(docs)
    path = ledger.path.removeprefix("file://")
    assert os.path.exists(path)
    common.release(spark)
    assert not os.path.exists(path)
    assert secrets.BlobLedger(spark, ledger.path).read() is None


def test_dot_rule_takes_the_greatest_product():
    """Residuals of 100 and 1000 are open: norm fills the tighter bin, dot the one along the piece."""
    cap = packing.Capacity(tokens=2000, documents=2000, attention=2000 * 2000)
    lengths, counts = np.array([1900, 1000, 90]), np.array([1, 1, 1])
    bins = {}
    for rule in ("norm", "dot"):
        segments, n = packing.plan_bins(lengths, counts, cap, rule)
        assert n == 2
        bins[rule] = {s[0]: s[3] for s in segments}
    assert bins["norm"][90] == bins["norm"][1900] and bins["dot"][90] == bins["dot"][1000]
