"""Base spans against the plain regular expressions, and identifiers discovered by context."""

from __future__ import annotations

import hashlib
import random
import re
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from duskline.llm import pii

FORMS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, s):
    digits = re.sub("[^0-9]", "", s)
    if kind == "ip":
        return all(int(p) <= 255 for p in s.split("."))
    if kind == "card":
        twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
        return 13 <= len(digits) <= 19 and sum(d - 9 * (d > 9) for d in twice) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def brute(text):
    return [(rank, *m.span(), kind) for rank, (kind, p) in enumerate(FORMS.items()) for m in re.finditer(p, text) if passes(kind, m.group())]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a0123459.@+- ()%é", max_size=60))
def test_forms(text):
    assert pii.base_spans(text) == brute(text)


def test_forms_in_longer_texts():
    rng = random.Random(1)
    parts = ["a.b@c.de", "x@y", "@@", "1.2.3.4", "300.1.1.1", "01.002.3.255.9", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 010-2030",
             "+1", "++44 20 7946 0958", "0" * 30, "é", "\U0001F600", "token", "a" * 600 + "@b.c", "b" * 300 + "@" + "c" * 300 + ".d@e.f"]
    for _ in range(300):
        text = rng.choice(["", " "]).join(rng.choice(parts) + rng.choice(["", " ", ". ", "\n"]) for _ in range(12))
        assert pii.base_spans(text) == brute(text)


def test_very_long_runs_take_linear_time():
    began = time.time()
    for text in ("a" * 1_000_000, "1" * 1_000_000, "1." * 500_000, "+1" + " " * 1_000_000, "a@" * 300_000, "a@b." * 200_000, "(1" * 400_000):
        pii.finds_of(text, pii.base_spans(text))
    assert time.time() - began < 30


def rows_of(spark, texts):
    docs = spark.createDataFrame([(i, t, "row", "s") for i, t in enumerate(texts)], "doc_id long, text string, row string, spans string")
    return {r.doc_id: r for r in pii.digest(pii.find_personal_data(docs)).collect()}


def test_contexts_discover_what_forms_miss(spark):
    seeds = [f"Please call my office +1 (212) 555-01{i:02d} before noon" for i in range(8)]
    unseen = "Please call my office (646) 555-7788 today"
    further = [f"zz yy {i} Ring back on (646) 555-7788" if i == 0 else f"zz Ring back on +44 20 7946 0{i}11" for i in range(5)]
    other = "Ring back on 0207 946 0999 tomorrow"
    noise = ["the sum of 1234567890 is large", "part my office 12 and more", "sum of 99887766 is small"]
    mail = [f"write mail to: user{i}@host{i}.example.org now" for i in range(5)] + ["write mail to: ann (at) site (dot) example now", "mail to: bob[at]example.org"]
    texts = seeds + [unseen] + further + [other] + noise + mail + [None, ""]
    got = rows_of(spark, texts)
    assert len(got) == len(texts)
    spans = {t: got[i].spans for i, t in enumerate(texts)}
    at = unseen.index("(646)")
    assert spans[unseen] == f"context_phone:{at}:{at + 14}"
    assert "context_phone" in spans[further[0]] and "context_phone" in spans[other]  # by the instance, then by a new pattern
    assert all(spans[t] == "" for t in noise)
    assert spans[mail[5]].startswith("context_email") and spans[mail[6]].startswith("context_email")
    for i, t in enumerate(texts):
        base = ",".join(f"{k}:{a}:{b}" for _, a, b, k in brute(t or ""))
        assert got[i].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert spans[t].startswith(base)
        assert [got[i][f"n_{k}"] for k in FORMS] == [sum(s[3] == k for s in brute(t or "")) for k in FORMS]


def test_copies_are_one_instance_and_tables_may_be_empty(spark):
    got = rows_of(spark, ["call us under +1 212 555 0199 now"] * 50 + ["call us under 555 01 99 88 now"])
    assert got[50].spans == ""
    assert rows_of(spark, []) == {}


def test_large_and_null_ids(spark):
    ids = [2**60 + 1, None, 2**60 + 1]
    docs = spark.createDataFrame([(i, "a@b.cd") for i in ids], "doc_id long, text string")
    assert sorted((r.doc_id or 0) for r in pii.digest(pii.find_personal_data(docs)).collect()) == [0, 2**60 + 1, 2**60 + 1]
