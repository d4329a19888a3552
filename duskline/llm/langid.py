"""Language identification with language-bitmask n-gram filters.

The filter is one bit-sliced Bloom filter: every position holds a bit mask of
languages. An n-gram's k positions are ANDed, which returns at once all
languages that (may) hold it. Per language the hits of a text are counted, the
count is corrected by the false-positive rate of that language's slice,
(hits - n * fp) / (1 - fp), and the largest corrected count decides; ties go to
the language first by name. The score is the corrected share of n-grams, 0 to 1.

Learning: n-gram document counts over about ``sample_per_lang`` labelled documents a
language (all, if it has fewer), chosen by a threshold on their hash, then the
``top_k`` most frequent n-grams of each language, so one document is enough for a
language to be learned. Both are documented bounds, so what reaches the driver and is
broadcast is at most ``top_k`` times the number of languages. Prediction uses the
text alone and covers whole texts.

N-grams are windows of four characters of the lower-cased text, anything but
letters becoming one boundary sign, that have a letter at their second place; so
every letter gives one. ``und``: null texts and texts without a letter. Empty
tables, repeated rows and extra columns are allowed.
"""

from __future__ import annotations

import sys
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, give_back, lean, materialize, mix64, set_aside

UND = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def ngrams(text: str) -> np.ndarray:
    """64-bit hashes of a text's n-grams, one per letter."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = _letters()[code]
    code = np.concatenate(([0], np.where(is_letter, code, 0), [0, 0])).astype(np.uint64)
    h = code[:-3]
    for k in (1, 2, 3):
        h = h * np.uint64(0x110001) + code[k : len(code) - 3 + k]
    return mix64(h[is_letter])


class BitmaskFilter:
    """Bit-sliced Bloom filters of all languages in one array of masks."""

    def __init__(self, langs: list[str], size: int, n_hashes: int = 3):
        self.langs = langs
        self.size = 1 << max(10, (size - 1).bit_length())
        self.n_hashes = n_hashes
        self.masks = np.zeros((max(1, -(-len(langs) // 64)), self.size), np.uint64)

    def _places(self, grams: np.ndarray):
        step = (grams >> np.uint64(32)) | np.uint64(1)
        for k in range(self.n_hashes):
            yield ((grams + np.uint64(k) * step) & np.uint64(self.size - 1)).astype(np.int64)

    def add(self, lang: int, grams: np.ndarray) -> None:
        bit = np.uint64(1 << (lang % 64))
        for at in self._places(grams):
            self.masks[lang // 64, at] |= bit

    def finish(self) -> BitmaskFilter:
        bits = [((self.masks[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(len(self.langs))]
        self.false = np.array(bits) ** self.n_hashes
        return self

    def hits(self, grams: np.ndarray) -> np.ndarray:
        """Per language, how many of the n-grams its filter holds."""
        masks = None
        for at in self._places(grams):
            row = self.masks[:, at]
            masks = row if masks is None else masks & row
        return np.array([((masks[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).sum() for i in range(len(self.langs))])

    def decide(self, text: str | None) -> tuple[str, float]:
        grams = ngrams(text) if text else ()
        if len(grams) == 0 or not self.langs:
            return UND, 0.0
        n = len(grams)
        right = (self.hits(grams) - n * self.false) / np.maximum(1 - self.false, 1e-9)
        best = int(np.argmax(right))
        return self.langs[best], float(min(1.0, max(0.0, right[best] / n)))


def train(
    labelled: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    key_col: str = "doc_id",
    sample_per_lang: int = 2000,
    top_k: int = 4096,
) -> BitmaskFilter:
    """Fit on a bounded, hash-chosen sample of the labelled rows (see the module's bounds)."""
    keys = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).alias("lang"),
        F.col(text_col).alias("text"),
        F.xxhash64(F.lit("langid"), F.col(key_col).cast("string")).alias("_h"),
    )
    # a row is in the sample if its hash is among the least of its language: a threshold per language from counts
    counts = keys.groupBy("lang").agg(F.count(F.lit(1)).alias("_n"))
    # stored, so that its size is known when the join is planned: few languages are broadcast and no text is shuffled
    counts = materialize(counts, "langid-counts")
    share = F.least(F.lit(1.0), F.lit(float(sample_per_lang)) / F.col("_n"))
    chosen = keys.join(counts, "lang").filter(
        F.col("_h") <= F.lit(-(2.0**63)) + share * F.lit(2.0**64)
    )

    def count(batches):
        for pdf in batches:
            for lang, text in zip(pdf["lang"], pdf["text"]):
                grams = np.unique(ngrams(text))
                yield pd.DataFrame({"lang": lang, "gram": grams.view(np.int64)})

    grams = chosen.select("lang", "text").mapInPandas(lean(count), "lang string, gram long")
    grams = grams.groupBy("lang", "gram").count()
    top = grams.withColumn(
        "_r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("count"), "gram"))
    ).filter(F.col("_r") <= top_k)
    # written first, so that texts reach Python workers in small batches
    top = materialize(top.select("lang", "gram"), "langid-top")
    rows = top.toPandas()
    discard(counts, top)
    langs = sorted(rows["lang"].unique())
    model = BitmaskFilter(langs, 16 * top_k)
    for i, lang in enumerate(langs):
        model.add(i, rows.loc[rows["lang"] == lang, "gram"].to_numpy(np.int64).view(np.uint64))
    return model.finish()


def predict(docs: DataFrame, model: BitmaskFilter, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with ``lang_pred`` and ``score`` (both replace columns of these names)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def decide(texts: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame([shared.value.decide(t) for t in texts], columns=["lang", "score"])
        give_back()
        return out

    docs, back = set_aside(docs, "_decided")
    found = docs.withColumn("_decided", decide(F.col(text_col)))
    found = found.withColumn("lang_pred", F.col("_decided.lang")).withColumn("score", F.col("_decided.score"))
    return found.drop("_decided").withColumnsRenamed(back)


def held_out(id_col: str = "doc_id"):
    """crc32 of the id as text, modulo 4, is 2; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))
