"""Secret scanning over an incremental blob ledger.

Every historical version of a path is content-addressed by the SHA-256 of its
text. The ledger, a Parquet table in shared storage, holds one row per blob and
scan: which (rule, rule version) pairs were run and what they found. A scan
takes each distinct blob once, runs only the rules whose current version the
ledger lacks for that blob, appends to the ledger, and joins findings back to
every path that ever had the blob. Copies are thus scanned once, and a new rule
version rescans with that rule alone.

Spans are code points, end exclusive. Nulls: a null text is the empty blob.
Empty tables give empty results; repeated rows and clashing extra columns pass
through, as only the named columns are used.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import database_dir, lean, materialize, set_aside

FINDING = "struct<start:long,rank:int,end:long,kind:string,rule:string>"
LEDGER = f"blob string, rules array<string>, findings array<{FINDING}>"


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    version: int = 1
    flags: int = 0
    group: int = 0
    least: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


# Kinds, patterns and least lengths of the base contract, in its order, then one added kind.
RULES = (
    Rule(
        "assign",
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        flags=re.IGNORECASE | re.ASCII,
        group=2,
        least=6,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", least=20),
    Rule("hex", r"[0-9a-f]+", least=24),
    # up to the END line; without one, the header and base64 lines that follow (line ends may be written \\n)
    Rule(
        "pem",
        r"-----BEGIN (?P<of>(?:[A-Z]+ )?)PRIVATE KEY-----"
        r"(?:(?:(?!-----BEGIN )[\s\S])*?-----END (?P=of)PRIVATE KEY-----"
        r"|(?:\s*\n[A-Za-z-]+: [^\r\n]*)*(?:(?:\s|\\[nr])*[A-Za-z0-9+/=]{24,})*(?:(?:\r?\n|\\n)[A-Za-z0-9+/]{1,23}={0,2}(?=\s*(?:\n|\Z)))?)",
        version=3,
    ),
)
#: The kinds of the base contract.
BASE = tuple(r.kind for r in RULES[:3])


def scanner(rules: tuple[Rule, ...]):
    """A function text -> findings that keeps, per rule, the leftmost non-overlapping matches that qualify."""
    compiled = []
    for rank, r in enumerate(rules):
        pattern = r.pattern
        if r.group == 0 and re.fullmatch(r"\[[^]]+\]\+", pattern):
            # maximal runs of a class: asking for the least length at once skips short runs inside the engine
            pattern = f"{pattern[:-1]}{{{r.least},}}"
        compiled.append((rank, r, re.compile(pattern, r.flags)))

    def scan(text: str, keys) -> list[tuple]:
        out = []
        for rank, r, pattern in compiled:
            if r.key in keys:
                for m in pattern.finditer(text):
                    a, b = m.span(r.group)
                    if b - a >= r.least:
                        out.append((m.start(), rank, m.end(), r.kind, r.key))
        return out

    return scan


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Run on each row (blob, text, due array<string>) the rules that are due."""

    def run(batches):
        scan = scanner(rules)
        for pdf in batches:
            found = [scan(t, set(due)) for t, due in zip(pdf["text"], pdf["due"])]
            found = [[dict(zip(("start", "rank", "end", "kind", "rule"), f)) for f in fs] for fs in found]
            yield pd.DataFrame({"blob": pdf["blob"], "rules": pdf["due"], "findings": found})

    return blobs.select("blob", "text", "due").mapInPandas(lean(run), LEDGER)


class BlobLedger:
    """The table of past scans at ``path``; by default a new one beside the intermediate tables, which ``release`` deletes."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = path or f"{database_dir(spark)}/ledger-{uuid.uuid4().hex}"

    def read(self) -> DataFrame | None:
        """All scans so far; None before the first."""
        try:
            return self.spark.read.schema(LEDGER).parquet(self.path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def update(self, versions: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> None:
        """Scan the unseen (blob, rule version) pairs of ``versions`` and append them."""
        content = F.coalesce(F.col(text_col), F.lit(""))
        blobs = versions.select(F.sha2(content, 256).alias("blob"), content.alias("text"))
        current = F.array(*[F.lit(r.key) for r in rules])
        if (past := self.read()) is not None:
            seen = past.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("seen"))
            blobs = blobs.join(seen, "blob", "left").withColumn(
                "due", F.array_except(current, F.coalesce("seen", F.array().cast("array<string>")))
            )
            blobs = blobs.filter(F.size("due") > 0).drop("seen")
        else:
            blobs = blobs.withColumn("due", current)
        scan_blobs(blobs.dropDuplicates(["blob"]), rules).write.mode("append").parquet(self.path)

    def findings(self, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """One row per scanned blob: all findings of the current rule versions, by start, then the order of ``rules``."""
        rank = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (r.key, i)])
        current = F.filter("findings", lambda f: F.map_contains_key(rank, f["rule"]))
        ranked = F.transform(
            current,
            lambda f: F.struct(f["start"].alias("start"), rank[f["rule"]].alias("rank"), f["end"].alias("end"),
                               f["kind"].alias("kind"), f["rule"].alias("rule")),
        )
        rows = self.read().withColumn("findings", ranked)
        return rows.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("findings"))).alias("findings"))


def scan_versions(
    versions: DataFrame, text_col: str = "text", ledger: BlobLedger | None = None, rules: tuple[Rule, ...] = RULES
) -> DataFrame:
    """All columns of ``versions`` but the text, with ``blob`` and its ``findings`` (which replace columns of these names)."""
    ledger = ledger or BlobLedger(versions.sparkSession)
    ledger.update(versions, text_col, rules)
    paths = versions.withColumn("blob", F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)).drop(text_col, "findings")
    # a table of its own, so that the join with a blob of very many paths can be split
    return paths.join(materialize(ledger.findings(rules), "secret-findings"), "blob", "left")


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, the hash of their spans, and all spans as text."""
    as_text = lambda fs: F.concat_ws(
        ",", F.transform(fs, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string")))
    )
    fs = F.coalesce("findings", F.array().cast(f"array<{FINDING}>"))
    base = F.filter(fs, lambda f: f["kind"].isin(*BASE))
    count = lambda k: F.size(F.filter(fs, lambda f: f["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id",
        count("assign"),
        count("access"),
        count("hex"),
        F.sha2(as_text(base), 256).alias("base_sha256"),
        as_text(fs).alias("spans"),
        "blob",
    )


def redact(docs: DataFrame, text_col: str = "text", ledger: BlobLedger | None = None) -> DataFrame:
    """Replace every found span by ``[kind]``, overlapping spans as one; all other columns stay as they are."""
    columns = docs.columns
    docs, back = set_aside(docs, "_blob", "_found")
    ledger = ledger or BlobLedger(docs.sparkSession)
    ledger.update(docs, text_col)
    hit = materialize(ledger.findings().filter(F.size("findings") > 0), "secret-findings")
    joined = docs.withColumn("_blob", F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)).join(
        hit.select(F.col("blob").alias("_blob"), F.col("findings").alias("_found")), "_blob", "left"
    )

    @F.pandas_udf("string")
    def cover(text: pd.Series, found: pd.Series) -> pd.Series:
        out = []
        for t, fs in zip(text, found):
            if t is not None and fs is not None and len(fs):
                parts, at = [], 0
                for f in fs:
                    if f["start"] >= at:
                        parts += [t[at : f["start"]], f"[{f['kind']}]"]
                    at = max(at, f["end"])
                t = "".join(parts) + t[at:]
            out.append(t)
        return pd.Series(out, dtype=object)

    covered = F.when(F.col("_found").isNull(), F.col(text_col)).otherwise(cover(F.col(text_col), F.col("_found")))
    return joined.withColumn(text_col, covered).drop("_blob", "_found").withColumnsRenamed(back).select(*columns)
