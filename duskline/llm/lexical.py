"""Ranked lexical search by the Best Position Algorithm over impact-ordered lists.

Documents are dealt to shards. A shard holds, for every term that some query
asks for, the list of its documents by falling impact. For a query, the search
reads its lists side by side from the top; every document met is scored at once
by direct accesses to all lists of the query, and these accesses mark their
positions as seen. The best position of a list is the last one up to which all
positions are seen; an unseen document can't score more than the sum of the
impacts there, which is often far below the sum at the last positions read. The
search ends when that sum is strictly below the k-th score, so that ties are
complete. Shard results are merged.

Impacts are integers (see ``impact``), so scores are exact. A row of documents
is a document of its own, also if its id or text is repeated; a row of queries is
a query of its own. Null texts have no terms. Documents without an id are ranked
last among equals. Empty tables and queries without known terms give no rows;
extra columns are ignored.
"""

from __future__ import annotations

import string

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Intermediates, materialize

#: What separates terms: ASCII other than letters and digits.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Postings of a shard (32 bytes each) and queries of a block, the bounds of what a task holds.
SHARD_POSTINGS = 1 << 19
BLOCK_QUERIES = 1024
#: Stands for "any term", so that a document's length is kept though none of its terms is asked for.
ANY = ""
LAST = (1 << 63) - 1


def terms(text: Column) -> Column:
    """The terms of a text in order, with repeats."""
    low = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.filter(F.split(low, SEPARATORS), lambda t: t != "")


def impact(tf: str, n: str, docs: int, total: int) -> Column:
    """``tf`` saturated against the document's length, in billionths of 1/1000."""
    return F.expr(f"(1000000000L * {tf}) div (1000L * {tf} + 8L * (25L + ((75L * {n} * {docs}L) div {total}L)))")


class Lists:
    """Impact-ordered lists of one shard, with direct access by (term, document)."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, value: np.ndarray):
        order = np.lexsort((doc, -value, term))
        self.term, self.doc, self.value = term[order], doc[order], value[order]
        self.names, self.start = np.unique(self.term, return_index=True)
        self.end = np.append(self.start[1:], len(term))
        self.docs = int(doc.max()) + 1
        slot = np.repeat(np.arange(len(self.names)), self.end - self.start)
        keys = slot * self.docs + self.doc
        self.by_key = np.argsort(keys)
        self.keys = keys[self.by_key]

    def find(self, slots: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Places of (list, document) for all pairs, -1 where the list lacks the document."""
        want = slots[:, None] * self.docs + docs[None, :]
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where(self.keys[at] == want, self.by_key[at], -1)


def best_positions(lists: Lists, names: np.ndarray, weight: np.ndarray, tie: np.ndarray, k: int, reads: list | None = None):
    """(documents, scores) of the k best for one query, by score, then ``tie`` (the documents' order).

    ``reads`` gets the number of documents scored.
    """
    slot = np.searchsorted(lists.names, names)
    known = slot < len(lists.names)
    known[known] = lists.names[slot[known]] == names[known]
    known &= weight > 0
    slot, weight = slot[known], weight[known]
    top_doc, top_score = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(slot):
        return top_doc, top_score
    start, end = lists.start[slot], lists.end[slot]
    first = np.cumsum(end - start) - (end - start)  # of each list in ``seen``
    seen = np.zeros(int((end - start).sum()), bool)
    best = start.copy()  # positions before it are all seen
    met = np.zeros(lists.docs, bool)
    depth, step, scored = 0, 16, 0
    while True:
        new = [lists.doc[a + depth : min(a + depth + step, b)] for a, b in zip(start, end) if a + depth < b]
        depth += step
        step = min(2 * step, 1024)
        fresh = np.unique(np.concatenate(new)) if new else np.zeros(0, np.int64)
        fresh = fresh[~met[fresh]]
        met[fresh] = True
        scored += len(fresh)
        at_once = max(1, (1 << 21) // len(slot))
        for lo in range(0, len(fresh), at_once):
            docs = fresh[lo : lo + at_once]
            places = lists.find(slot, docs)
            hit = places >= 0
            score = (np.where(hit, lists.value[places], 0) * weight[:, None]).sum(axis=0)
            rows, cols = np.nonzero(hit)
            seen[first[rows] + places[rows, cols] - start[rows]] = True
            top_doc, top_score = np.concatenate((top_doc, docs)), np.concatenate((top_score, score))
            order = np.lexsort((tie[top_doc], -top_score))[:k]
            top_doc, top_score = top_doc[order], top_score[order]
        bound = 0
        for i in range(len(slot)):
            rest = seen[first[i] + best[i] - start[i] : first[i] + end[i] - start[i]]
            gap = int(np.argmin(rest)) if len(rest) else 0
            best[i] += len(rest) if len(rest) and rest[gap] else gap
            if best[i] < end[i]:
                # what comes after the best position has at most its impact; nothing seen yet: the list's first
                bound += int(lists.value[max(best[i] - 1, start[i])]) * int(weight[i])
        if bound == 0 or (len(top_score) == k and bound < top_score[-1]):
            break
    if reads is not None:
        reads.append(scored)
    good = top_score > 0
    return top_doc[good], top_score[good]


def postings(docs: DataFrame, vocabulary: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, doc, n, term_id, tf) of the asked terms, and of ``ANY`` for every document with terms."""
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("doc"), terms(F.col(text_col)).alias("terms")
    ).filter(F.size("terms") > 0)
    each = rows.select(
        "row", "doc", F.size("terms").cast("long").alias("n"), F.explode(F.concat("terms", F.array(F.lit(ANY)))).alias("term")
    )
    return each.join(vocabulary, "term").groupBy("row", "doc", "n", "term_id").agg(F.count("*").alias("tf"))


def search(
    docs: DataFrame,
    queries: DataFrame,
    k: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    query_id: str = "item_id",
    query_text: str = "text",
    shard_postings: int = SHARD_POSTINGS,
) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each query with a score above 0."""
    with Intermediates() as held:
        asked = materialize(
            queries.select(
                F.monotonically_increasing_id().alias("q"), F.col(query_id).alias("item_id"), terms(F.col(query_text)).alias("terms")
            ),
            "lexical-queries",
        )
        each = asked.select("q", F.explode("terms").alias("term")).groupBy("q", "term").agg(F.count("*").alias("times"))
        each = materialize(each, "lexical-terms")
        sentinel = docs.sparkSession.createDataFrame([(ANY,)], "term string")
        vocabulary = each.select("term").distinct().unionByName(sentinel)
        vocabulary = materialize(vocabulary.withColumn("term_id", F.monotonically_increasing_id()), "lexical-vocabulary")
        any_id = vocabulary.filter(F.col("term") == ANY).first()["term_id"]
        found = materialize(postings(docs, vocabulary, id_col, text_col), "lexical-postings")
        sizes = found.agg(
            F.count("*").alias("all"),
            F.count(F.when(F.col("term_id") == any_id, 1)).alias("docs"),
            F.sum(F.when(F.col("term_id") == any_id, F.col("n"))).alias("total"),
        ).first()
        n_docs, total = sizes["docs"], sizes["total"] or 1
        real = found.filter(F.col("term_id") != any_id)
        weight = F.floor(F.lit(1000.0) * F.log(F.lit(2.0 * n_docs + 2.0) / (F.lit(2.0) * F.col("df") + F.lit(1.0))))
        weights = real.groupBy("term_id").agg(F.count("*").alias("df")).select("term_id", weight.alias("w"))
        weighted = each.join(vocabulary, "term").join(weights, "term_id").select("q", "term_id", (F.col("times") * F.col("w")).alias("weight"))
        weighted = materialize(weighted, "lexical-weights")
        blocks = -(-asked.count() // BLOCK_QUERIES) or 1
        shards = -(-sizes["all"] // shard_postings) or 1

        dealt = real.select(
            F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int").alias("shard"),
            F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
            "row", "doc", "term_id", impact("tf", "n", n_docs, total).alias("value"),
        )
        wanted = weighted.select(
            F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"),
            F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int").alias("block"),
            "q", "term_id", "weight",
        )

        def rank(key, have: pd.DataFrame, want: pd.DataFrame) -> pd.DataFrame:
            none = pd.DataFrame({"q": [], "doc": [], "row": [], "score": []})
            if not len(have) or not len(want):
                return none
            rows, local = np.unique(have["row"].to_numpy(np.int64), return_inverse=True)
            ids = np.full(len(rows), LAST, np.int64)
            ids[local] = have["doc"].to_numpy(np.int64)
            order = np.lexsort((rows, ids))
            tie = np.empty(len(rows), np.int64)
            tie[order] = np.arange(len(rows))
            lists = Lists(have["term_id"].to_numpy(np.int64), local, have["value"].to_numpy(np.int64))
            out = []
            for q, part in want.groupby("q", sort=True):
                at, score = best_positions(lists, part["term_id"].to_numpy(np.int64), part["weight"].to_numpy(np.int64), tie, k)
                out.append(pd.DataFrame({"q": q, "doc": ids[at], "row": rows[at], "score": score}))
            return pd.concat(out, ignore_index=True) if out else none

        hits = (
            dealt.groupBy("shard", "block")
            .cogroup(wanted.groupBy("shard", "block"))
            .applyInPandas(rank, "q long, doc long, row long, score long")
        )
        best = Window.partitionBy("q").orderBy(F.desc("score"), "doc", "row")
        top = hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).join(asked.select("q", "item_id"), "q")
        top = materialize(
            top.select("item_id", F.col("rank").cast("int").alias("rank"), F.nullif("doc", F.lit(LAST)).alias("doc_id"), "score"), "lexical-top"
        )
        held.keep(top)
        return top


TERM_SQL = f"regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '{SEPARATORS[0]}^{SEPARATORS[1:]}')"

#: The same ranking by scoring every document that shares a term.
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {TERM_SQL} AS t FROM documents),
one AS (SELECT r, doc_id, len(t) AS n, unnest(t) AS term FROM d WHERE len(t) > 0),
s AS (SELECT count(*) AS big_n, sum(len(t))::bigint AS big_l FROM d WHERE len(t) > 0),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({TERM_SQL}) AS term FROM benchmark) GROUP BY ALL),
tf AS (SELECT r, doc_id, n, term, count(*) AS tf FROM one WHERE term IN (SELECT term FROM q) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
imp AS (SELECT r, doc_id, term,
    floor(1000 * ln((2.0::double * big_n + 2) / (2.0::double * df + 1)))::bigint
    * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * big_n) // big_l))) AS value
  FROM tf JOIN df USING (term), s),
sc AS (SELECT item_id, r, doc_id, sum(times * value)::bigint AS score FROM q JOIN imp USING (term) GROUP BY ALL),
k AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, r) AS rank FROM sc WHERE score > 0)
SELECT item_id, rank::integer AS rank, doc_id, score FROM k WHERE rank <= 10
"""
