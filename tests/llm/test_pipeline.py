from __future__ import annotations

import random

import public_tokenizers as P

import corpus_pipeline
from duskline.llm.packing import encoder


def test_pipeline(spark, tmp_path):
    en = "the quick brown fox jumps over the lazy dog and runs away from the old house with".split()
    texts = [" ".join(en[(i * 7 + k * (i + 1)) % len(en)] + ("" if k % 3 else str(i)) for k in range(60)) for i in range(12)]
    texts += [texts[0], None, "?? !!", "token=abcdefgh12 " + " ".join(en[::-1] * 4)]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        seen[name] = docs.collect()
        docs = spark.createDataFrame(seen[name], docs.schema)
    ids = lambda name: {r.doc_id for r in seen[name]}
    assert not {13, 14} & ids("language") and {0, 1, 11, 12} <= ids("language")
    assert {0, 12} & ids("near_duplicates") == {0}
    assert ids("secrets") == ids("near_duplicates") == ids("suffix_dedup")
    clean = {r.doc_id: r.text for r in seen["secrets"]}
    assert "token=abc" not in clean[15] and "[assign]" in clean[15]
    encode = encoder(P.path("byte_bpe_50k.json"))
    assert {r.doc_id: r.length for r in seen["packing"]} == {i: len(encode(t)) + 1 for i, t in clean.items()}
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(seen["packing"])


def test_passages_are_judged_by_words(spark):
    """51 short words that repeat are cut, 50 words that repeat are not, whatever their bytes."""
    rng = random.Random(6)

    def fill(n, size):
        return " ".join("".join(rng.choice("abcdefghij\u00e9") for _ in range(size)) for _ in range(n))

    short, under, long = fill(51, 3), fill(50, 12), fill(51, 20)
    texts, want = [], []
    for p in (short, under, long):
        for gap in (" ", "\n", "\u00a0"):
            a, b = fill(40, 6), fill(70, 6)
            texts.append(a + gap + p + gap + b)
            want.append(texts[-1] if p is under else a + gap + gap + b)
    texts += [None, "", "  ", short.replace(" ", "\u2003  "), short + " x " + short]
    want += [None, "", "  ", "", " x "]
    docs = spark.createDataFrame([(i, t, len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.passages(spark, docs, "").collect()}
    assert got == {i: (t, None if t is None else len(t)) for i, t in enumerate(want)}
