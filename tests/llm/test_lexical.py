"""Lexical search against scoring every document."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from duskline.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, q long, term string, score double, shard int"


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=10):
    """(item, rank, doc, score) by the contract's formula."""
    bags = [(d, Counter(terms(t)), len(terms(t))) for d, t in docs]
    bags = [b for b in bags if b[2]]
    big_n, big_l = len(bags), sum(n for *_, n in bags)
    df = Counter(t for _, bag, _ in bags for t in bag)
    out = []
    for item, text in items:
        scored = []
        for at, (d, bag, n) in enumerate(bags):
            m = 100 - 75 + (75 * n * big_n) // big_l
            s = sum(
                c * math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * ((1000000000 * bag[t]) // (1000 * bag[t] + 8 * m))
                for t, c in Counter(terms(text)).items() if t in bag
            )
            if s > 0:
                scored.append((-s, d is None, d or 0, at))
        out += [(item, r + 1, None if null else d, -s) for r, (s, null, d, _) in enumerate(sorted(scored)[:k])]
    return out


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)] + ["Été", "ÉTÉ", "naïve", "日本", "\U0001F600x"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    text = lambda n: " ".join(rng.choices(vocabulary, weights, k=n))
    docs = [(i, text(rng.randrange(1, 60))) for i in range(400)]
    docs += [(500 + i, docs[7][1]) for i in range(25)]  # ties
    docs += [(7, docs[7][1]), (None, docs[7][1]), (900, None), (901, ""), (902, "--- !! \x00"), (903, "W1,w2;W3\x7fw4"), (904, text(9000))]
    items = [(i, text(rng.randrange(1, 25))) for i in range(20)] + [(50, docs[7][1]), (51, None), (52, "nothingknown"), (53, "w1 " * 40), (None, "w2")]
    return docs, items


@pytest.mark.parametrize("shard", [1 << 19, 700])
def test_search(spark, corpus, shard):
    docs, items = corpus
    d = spark.createDataFrame([(*x, 1, "t", 0.5, 9) for x in docs], DOCS)
    q = spark.createDataFrame([(*x, 3) for x in items], "item_id long, text string, doc_id long")
    got = lexical.search(d, q, shard_postings=shard).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in got), key=key) == sorted(brute(docs, items), key=key)


def test_empty(spark, corpus):
    docs, items = corpus
    d = spark.createDataFrame(docs, "doc_id long, text string")
    q = spark.createDataFrame(items, "item_id long, text string")
    assert lexical.search(d.limit(0), q).collect() == [] == lexical.search(d, q.limit(0)).collect()


def test_best_positions_stop_early_and_are_exact():
    """Long lists: the k best are right and far from all documents are scored."""
    rng = np.random.default_rng(6)
    n, lists = 20000, 6
    strength = rng.pareto(2.0, n)
    term, doc, value = [], [], []
    for t in range(lists):
        docs = rng.choice(n, 15000, replace=False)
        term.append(np.full(len(docs), t))
        doc.append(docs)
        value.append((1e6 * strength[docs] * rng.uniform(0.9, 1.1, len(docs))).astype(np.int64))
    term, doc, value = map(np.concatenate, (term, doc, value))
    weight = np.arange(1, lists + 1)
    score = np.bincount(doc, value * weight[term], n).astype(np.int64)
    want = np.lexsort((np.arange(n), -score))[:10]
    reads: list[int] = []
    got, scores = lexical.best_positions(lexical.Lists(term, doc, value), np.arange(lists), weight, np.arange(n), 10, reads)
    assert got.tolist() == want.tolist() and scores.tolist() == score[want].tolist()
    assert reads[0] < n / 4
