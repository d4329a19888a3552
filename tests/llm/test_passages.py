"""op7: passages of over 50 words that are shorter than the 400 bytes of the removal, against brute force."""

from __future__ import annotations

import random
from collections import Counter

from duskline.llm import suffixdedup


def brute(texts, n):
    """Words that lie in a string of ``n`` words that also starts anywhere else, as start:end of their runs in bytes."""
    split = [(t or "").split() for t in texts]
    seen = Counter(tuple(w[i : i + n]) for w in split for i in range(len(w) - n + 1))
    out = []
    for t, w in zip(texts, split):
        inside = set()
        for i in range(len(w) - n + 1):
            if seen[tuple(w[i : i + n])] > 1:
                inside.update(range(i, i + n))
        places, at = [], 0
        for word in w:
            at = t.index(word, at)
            places.append((len(t[:at].encode()), len(t[: at + len(word)].encode())))
            at += len(word)
        runs = []
        for i in sorted(inside):
            if i - 1 in inside:
                runs[-1][1] = places[i][1]
            else:
                runs.append(list(places[i]))
        out.append([tuple(r) for r in runs])
    return out


def check(spark, texts, words=51):
    rows = [(i, t) for i, t in enumerate(texts)]
    got = suffixdedup.removal_digest(spark.createDataFrame(rows, "doc_id long, text string"), words=words).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(by) == len(texts)
    for i, runs in enumerate(brute(texts, words)):
        r = by[i]
        assert r.passages == ",".join(f"{a}:{b}" for a, b in runs)
        assert (r.n_passages, r.n_passage_bytes) == (len(runs), sum(b - a for a, b in runs))
    return by


def test_passages_below_the_removed_length(spark):
    rng = random.Random(31)

    def prose(n):
        return " ".join(rng.choice(["étè", "la", "sol", "mar", "Ñu", "erd"]) + str(rng.randrange(10**3)) for _ in range(n))

    passage, short = prose(54), prose(50)
    assert len(passage.encode()) < 400
    texts = [f"{prose(90)} {passage} {prose(70)}" for _ in range(3)]
    texts += [passage.replace(" ", " \n"), f"{prose(60)} {short} {prose(60)}", f"{short} {prose(40)}", prose(200), None, "", "one"]
    own = prose(51)
    texts += [f"{own} {prose(5)} {own}", " ".join(["the"] * 70), " ".join(["the"] * 51)]
    by = check(spark, texts)
    # what the contract fixes for 400 bytes stays: none of these passages is removed
    assert [by[i].n_removed for i in range(7)] == [0] * 7
    assert [by[i].n_passages for i in range(7)] == [1, 1, 1, 1, 0, 0, 0]


def test_passages_of_few_words(spark):
    """A small vocabulary, so that repeats of about 51 words overlap and touch."""
    rng = random.Random(32)
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randrange(0, 160))) for _ in range(8)]
    texts += [" ".join((rng.choice(texts).split() * 2)[k : k + 75]) for k in range(0, 60, 7)]
    check(spark, texts)


def test_many_texts_each_too_short(spark):
    rows = [(i, "é" * 150) for i in range(9)]
    out = suffixdedup.removal_digest(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_passages) for r in out) == [(i, 300, 0, 0) for i in range(9)]
