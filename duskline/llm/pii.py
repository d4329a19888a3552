"""Personal data by patterns of form and by bootstrapped contexts.

Forms (e-mail, IPv4, card, phone) give the base spans. They are also the seeds
of a bootstrap: every seed, and every other string that looks like an
identifier, is an instance with up to three lexical patterns (the label before
it, the two words before it, the words on both sides). Spark keeps the graph of
distinct (pattern, instance) pairs and scores it in rounds: a pattern's
precision for a kind is the share of its instances that are known to be of the
kind; a pattern is trusted with ``MIN_SUPPORT`` known instances and a precision
of ``MIN_PRECISION``; an unknown instance is accepted when its trusted patterns
leave too little doubt (the product of one minus their precision) and its form
allows the kind. Accepted instances count as known in the next round, until a
round accepts none. All occurrences of accepted instances are added as spans of
kind ``context_<kind>``.

Copies of a text don't strengthen a pattern, as instances count once. The hot
patterns are split in the joins by a hash of the instance.

Spans are code points, end exclusive. A null text is empty. Empty tables give
empty results; repeated rows and ids are documents of their own; extra columns are
ignored. Ties: an instance accepted for two
kinds takes the one of less doubt, then the first by name.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Intermediates, batches_of_bytes, discard, materialize

# The base kinds in the order of the contract.
BASE = ("email", "ip", "card", "phone")
MIN_SUPPORT = 3
MIN_PRECISION = 0.6
MAX_DOUBT = 0.35
SALTS = 16
#: Words of a pattern are cut at so many characters; a context reaches so far.
WORD, REACH = 32, 96

SPAN = "struct<rank:int,start:long,end:long,kind:string>"
FIND = "struct<start:long,end:long,seed:string,allows:array<string>,instance:string,patterns:array<string>>"
SCANNED = f"doc_id long, spans array<{SPAN}>, finds array<{FIND}>"

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# what may be an identifier without one of the forms above
_NUMBER = re.compile(r"(?<![0-9A-Za-z@.+-])\(?[0-9](?:[\x20()./-]{0,2}[0-9])++(?![0-9A-Za-z@])")
_AT = re.compile(r"\x20?(?:\(at\)|\[at\]|\{at\}|@)\x20?", re.IGNORECASE)
_HOST = re.compile(r"[A-Za-z0-9-]++(?:(?:\.|\x20?(?:\(dot\)|\[dot\])\x20?)[A-Za-z0-9-]++)*+", re.IGNORECASE)
_COLONS = re.compile(r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{0,4}){3,7}(?![0-9A-Za-z:])")


def luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        n = ord(ch) - 48
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def _before(text: str, at: int, least: int) -> int:
    """Where the run of local-part characters that ends at ``at`` begins, not before ``least``."""
    lo = at
    while lo > least:
        step = max(least, lo - 256)
        run = _LOCAL.match(text[step:lo][::-1]).end()
        lo -= run
        if run < 256 or lo == step == least:
            break
    return lo


def emails(text: str):
    """Leftmost non-overlapping matches, found from their @, so that long runs without one cost nothing."""
    last, at = 0, text.find("@")
    while at >= 0:
        end = _DOMAIN.match(text, at + 1)
        if end:
            start = _before(text, at, last)
            if start < at:
                yield start, end.end()
                last = end.end()
        at = text.find("@", max(at + 1, last))


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(rank of the kind, start, end, kind), by kind, then start."""
    out = [(0, a, b, "email") for a, b in emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append((1, *m.span(), "ip"))
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 40:
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((2, *m.span(), "card"))
    at = text.find("+")
    while at >= 0:
        m = _PHONE.match(text, at)
        if m:
            if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append((3, *m.span(), "phone"))
            at = m.end() - 1
        at = text.find("+", at + 1)
    return out


def lookalikes(text: str):
    """(start, end, kinds its form allows) of strings that may be identifiers; they may overlap base spans."""
    for m in _NUMBER.finditer(text):
        if m.end() - m.start() <= 64:
            digits = sum(c.isdigit() for c in m.group())
            kinds = (["card"] if 12 <= digits <= 19 else []) + (["phone"] if 7 <= digits <= 15 else [])
            if kinds:
                yield *m.span(), kinds
    last = 0
    for m in _AT.finditer(text):
        host = _HOST.match(text, m.end())
        start = _before(text, m.start(), max(last, m.start() - 64))
        if host and start < m.start() and host.end() - m.end() <= 128:
            yield start, host.end(), ["email"]
            last = host.end()
    for m in _COLONS.finditer(text):
        yield *m.span(), ["ip"]


def contexts(text: str, start: int, end: int) -> list[str]:
    """The lexical patterns around a span."""
    word = lambda w: re.sub("[0-9]", "9", w.lower())[:WORD]
    left = [word(w) for w in text[max(0, start - REACH) : start].split()[-2:]]
    right = [word(w) for w in text[end : end + REACH].split()[:1]]
    out = []
    if left and left[-1][-1] in ":=#":
        out.append(f"label {left[-1]}")
    if len(left) == 2:
        out.append(f"after {left[0]} {left[1]}")
    if left and right:
        out.append(f"between {left[-1]} {right[0]}")
    return out


def finds_of(text: str, spans: list[tuple[int, int, int, str]]) -> list[dict]:
    """Seeds and lookalikes with their patterns; a lookalike that touches a seed is none."""
    taken = sorted((a, b) for _, a, b, _ in spans)
    out = []

    def add(a, b, seed, allows):
        patterns = contexts(text, a, b)
        if patterns:
            instance = " ".join(text[a:b].lower().split())
            out.append({"start": a, "end": b, "seed": seed, "allows": allows, "instance": instance, "patterns": patterns})

    for _, a, b, kind in spans:
        if b - a <= 256:
            add(a, b, kind, [kind])
    at, last = 0, 0
    for a, b, allows in sorted(lookalikes(text)):
        while at < len(taken) and taken[at][1] <= a:
            at += 1
        if a >= last and all(x >= b or y <= a for x, y in taken[at : at + 4]):
            add(a, b, None, allows)
            last = b
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans, finds) for every row: the base spans, and the instances with their patterns."""

    span, find = (pa.list_(pa.struct(fields)) for fields in (
        [("rank", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())],
        [("start", pa.int64()), ("end", pa.int64()), ("seed", pa.string()), ("allows", pa.list_(pa.string())),
         ("instance", pa.string()), ("patterns", pa.list_(pa.string()))],
    ))

    def run(batches):
        for batch in batches:
            for part in batches_of_bytes(batch, "text"):
                texts = [t or "" for t in part.column("text").to_pylist()]
                spans = [base_spans(t) for t in texts]
                finds = [finds_of(t, s) for t, s in zip(texts, spans)]
                spans = [[dict(zip(("rank", "start", "end", "kind"), s)) for s in row] for row in spans]
                columns = [part.column("doc_id"), pa.array(spans, span), pa.array(finds, find)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "spans", "finds"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCANNED)


def bootstrap(finds: DataFrame) -> DataFrame:
    """(instance, kind): the unseen identifiers that trusted patterns discover in ``finds(instance, seed, allows, patterns)``."""
    spark = finds.sparkSession
    edges = (
        finds.select("instance", "seed", "allows", F.explode("patterns").alias("pattern"))
        .groupBy("pattern", "instance")
        .agg(F.max("seed").alias("seed"), F.max("allows").alias("allows"))
    )
    # only patterns that have a seed and something unknown, or link such ones, can matter: the rest stays unscored
    edges = materialize(edges.withColumn("salt", F.pmod(F.xxhash64("instance"), F.lit(SALTS)).cast("int")), "pii-edges")
    accepted = materialize(spark.createDataFrame([], "instance string, kind string"), "pii-accepted")
    while True:
        known = edges.join(accepted, "instance", "left").withColumn("of", F.coalesce("seed", "kind"))
        # the instances of a pattern are distinct, so counts are supports; partial sums go first
        counts = known.groupBy("pattern", "of").agg(F.count("*").alias("n"))
        totals = counts.groupBy("pattern").agg(F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct(F.coalesce("of", F.lit("")), "n"))).alias("by"))
        trusted = (
            totals.select("pattern", "total", F.explode("by").alias("kind", "support"))
            .filter((F.col("kind") != "") & (F.col("support") >= MIN_SUPPORT) & (F.col("support") >= MIN_PRECISION * F.col("total")) & (F.col("support") < F.col("total")))
            .select("pattern", "kind", (F.col("support") / F.col("total")).alias("precision"))
        )
        salted = trusted.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        unknown = known.filter(F.col("of").isNull()).select("pattern", "salt", "instance", "allows")
        doubt = (
            unknown.join(salted, ["pattern", "salt"])
            .filter(F.array_contains("allows", F.col("kind")))
            .groupBy("instance", "kind")
            .agg(F.exp(F.sum(F.log(F.lit(1.0) - F.col("precision")))).alias("doubt"))
            .filter(F.col("doubt") <= MAX_DOUBT)
        )
        new = doubt.groupBy("instance").agg(F.min(F.struct("doubt", "kind")).alias("best")).select("instance", "best.kind")
        new = materialize(new, "pii-new")
        if new.isEmpty():
            discard(new, edges)
            return accepted
        grown = materialize(accepted.unionByName(new), "pii-accepted")
        discard(accepted, new)
        accepted = grown


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, spans): all spans of every row, base kinds first, each kind by start."""
    with Intermediates() as held:
        scanned = materialize(scan(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "pii-scanned")
        each = scanned.select("row", F.explode("finds").alias("f")).select("row", "f.*")
        accepted = bootstrap(each)
        extra = (
            each.filter(F.col("seed").isNull())
            .join(accepted, "instance")
            .select("row", F.struct(
                (F.lit(len(BASE)) + F.array_position(F.array(*map(F.lit, BASE)), F.col("kind"))).cast("int").alias("rank"),
                "start", "end", F.concat(F.lit("context_"), "kind").alias("kind"),
            ).alias("span"))
            .groupBy("row").agg(F.array_sort(F.collect_list("span")).alias("extra"))
        )
        extra = materialize(extra, "pii-extra")
        held.keep(scanned, extra)
        spans = F.concat("spans", F.coalesce("extra", F.array().cast(f"array<{SPAN}>")))
        return scanned.join(extra, "row", "left").select("row", "doc_id", spans.alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, the hash of their spans, and all spans as text."""
    as_text = lambda fs: F.concat_ws(
        ",", F.transform(fs, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string")))
    )
    base = F.filter("spans", lambda f: f["kind"].isin(*BASE))
    count = lambda k: F.size(F.filter("spans", lambda f: f["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(as_text(base), 256).alias("base_sha256"), as_text(F.col("spans")).alias("spans"))
