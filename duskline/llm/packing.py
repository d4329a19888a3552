"""Vector best-fit packing of tokenized documents into sequences.

A piece is a vector (tokens, 1 document, tokens**2 of attention cost) and a bin
has a capacity in each. Pieces are placed in decreasing order; among the open
bins that can take a piece under every constraint, the one is chosen whose
residual vector after placement has the least weighted norm (``norm``) or whose
residual has the greatest weighted dot product with the piece (``dot``). All
rules given are tried and the one with the fewest bins is kept.

A piece's vector depends on its length alone, so the whole plan is made from the
histogram of lengths: at most ``capacity`` rows, however large the corpus. Equal
bins form classes that are filled together. The plan says, for each length,
which ranks among the pieces of that length go to which bins; the pieces then
look up their place in parallel, with no sort of the corpus. Ranks come from
salted groups whose size is bounded, so a length that a third of all pieces
share is spread over many tasks.

Documents of more than ``capacity`` tokens are cut into pieces of ``capacity``,
the first of which may be shorter. Null texts are empty; with the end id each
document has one token at least; a null id stays null. Repeated rows are packed each. An empty table
gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batches_of_bytes, lean, materialize

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


@dataclass(frozen=True)
class Capacity:
    """What one sequence may hold, and how the three dimensions weigh in the choice of a bin."""

    tokens: int = 2048
    documents: int = 2048
    attention: int = 2048 * 2048
    weights: tuple[float, float, float] = (1.0, 0.1, 0.1)
    rules: tuple[str, ...] = ("norm", "dot")


def encoder(vocabulary: str):
    """A function text -> ids, as tokenizers has them from a ``.json`` file with add_special_tokens=False.

    Where the same vocabulary lies beside it as a ``.tiktoken`` file, texts that hold none of the added tokens are
    encoded by tiktoken: the ids are the same (a test compares them) in about a third of the time. Given a
    ``.tiktoken`` file, no text has special tokens.
    """
    import public_tokenizers
    import tiktoken

    from .bpe import load_ranks

    ranks = vocabulary.removesuffix(".json").removesuffix(".tiktoken") + ".tiktoken"
    plain = None
    if os.path.exists(ranks):
        plain = tiktoken.Encoding(
            "packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(ranks), special_tokens={}
        ).encode_ordinary
    if not vocabulary.endswith(".json"):
        return plain
    with open(vocabulary, encoding="utf-8") as f:
        head = f.read()
    added, _ = json.JSONDecoder().raw_decode(head, head.index("[", head.index('"added_tokens"')))
    added, tok = [a["content"] for a in added], []

    def whole(text: str) -> list[int]:
        if not tok:  # few texts hold an added token: the library's table is loaded for the first one
            from tokenizers import Tokenizer

            tok.append(Tokenizer.from_file(vocabulary))
        return tok[0].encode(text, add_special_tokens=False).ids

    return whole if plain is None else lambda t: whole(t) if any(a in t for a in added) else plain(t)


def tokenize_pieces(
    docs: DataFrame,
    vocabulary: str,
    capacity: int = 2048,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep_ids: bool = False,
) -> DataFrame:
    """One row per piece of each document: doc_id, piece, start, length, ids_crc32 (and ids)."""

    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode = encoder(vocabulary)
        for batch in batches:
            for part in batches_of_bytes(batch, "text"):
                rows, pieces, kept = [], [], []
                for row, text in enumerate(part.column("text").to_pylist()):
                    ids = np.array([*encode(text or ""), end_id], dtype="<u4")
                    head = len(ids) % capacity or capacity
                    cuts = [0, *range(head, len(ids) + 1, capacity)]
                    for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
                        rows.append(row)
                        pieces.append((piece, a, b - a, zlib.crc32(ids[a:b].tobytes())))
                        if keep_ids:
                            kept.append(ids[a:b].astype(np.int32))
                columns = list(zip(*pieces))
                types = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
                arrays = [part.column("doc_id").take(pa.array(rows, pa.int64()))]  # ids as they are, nulls too
                arrays += [pa.array(c, t) for c, t in zip(columns, types)]
                arrays += [pa.array(kept, pa.list_(pa.int32()))] if keep_ids else []
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                yield pa.RecordBatch.from_arrays(arrays, names[: len(arrays)])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(lean(run), PIECE + (", ids array<int>" if keep_ids else ""))


def plan_bins(lengths: np.ndarray, counts: np.ndarray, cap: Capacity, rule: str):
    """Place ``counts[i]`` pieces of ``lengths[i]`` tokens; return (segments, number of bins).

    A segment (length, first rank, last rank + 1, first bin, pieces a bin, offset) sends the pieces of one
    length with ranks in a range to consecutive bins.
    """
    full = np.array([cap.tokens, cap.documents, cap.attention], float)
    weight = np.array(cap.weights)
    first, size = np.zeros(64, np.int64), np.zeros(64, np.int64)  # classes of equal bins
    free = np.zeros((64, 3))
    n_classes, n_bins, segments = 0, 0, []
    for i in np.argsort(-lengths, kind="stable"):
        length, left, rank = int(lengths[i]), int(counts[i]), 0
        need = np.array([length, 1, length * length], float)
        if (need > full).any():
            raise ValueError(f"a piece of {length} tokens exceeds the capacity of an empty sequence")
        while left:
            fits = (free[:n_classes] >= need).all(axis=1) & (size[:n_classes] > 0)
            if fits.any():
                at = np.flatnonzero(fits)
                if rule == "norm":
                    score = -((((free[at] - need) / full) ** 2) * weight).sum(axis=1)
                else:
                    score = ((free[at] / full) * (need / full) * weight).sum(axis=1)
                c = at[np.argmax(score)]
            else:  # open as many empty bins as the rest may need
                if n_classes == len(size):
                    first, size, free = (np.concatenate((x, np.zeros_like(x))) for x in (first, size, free))
                each = int(min(cap.tokens // length, cap.documents, cap.attention // (length * length)))
                c, new = n_classes, -(-left // each)
                first[c], size[c], free[c] = n_bins, new, full
                n_classes, n_bins = n_classes + 1, n_bins + new
            each = int(min((free[c] // need).min(), left))  # one bin takes so many
            bins = min(int(size[c]), left // each)
            take = bins * each
            segments.append((length, rank, rank + take, int(first[c]), each, int(cap.tokens - free[c][0])))
            rest = int(size[c]) - bins
            if rest:
                if n_classes == len(size):
                    first, size, free = (np.concatenate((x, np.zeros_like(x))) for x in (first, size, free))
                first[n_classes], size[n_classes], free[n_classes] = first[c] + bins, rest, free[c]
                n_classes += 1
            size[c] = bins
            free[c] = free[c] - each * need
            if free[c].min() < 1:
                size[c] = 0  # full
            rank, left = rank + take, left - take
        if n_classes > 256:
            keep = size[:n_classes] > 0
            n = int(keep.sum())
            for x in (first, size, free):
                x[:n] = x[:n_classes][keep]
            n_classes = n
    return segments, n_bins


def pack(pieces: DataFrame, cap: Capacity = Capacity(), rows_per_group: int = 50_000) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to a stored table of pieces (columns of PIECE, others kept)."""
    histogram = pieces.groupBy("length").count().toPandas()  # at most cap.tokens rows
    lengths, counts = histogram["length"].to_numpy(np.int64), histogram["count"].to_numpy(np.int64)
    plans = [plan_bins(lengths, counts, cap, rule) for rule in cap.rules]
    segments, _ = min(plans, key=lambda p: p[1])
    by_length: dict[int, np.ndarray] = {}
    table = np.array(segments, np.int64).reshape(-1, 6)
    for length in np.unique(table[:, 0]):
        by_length[int(length)] = table[table[:, 0] == length][:, 1:]

    spark = pieces.sparkSession
    salts = spark.createDataFrame(
        [(int(a), int(b) // rows_per_group + 1) for a, b in zip(lengths, counts)], "length long, _salts int"
    )
    salted = pieces.join(F.broadcast(salts), "length").withColumn(
        "_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("_salts")).cast("int")
    )
    sizes = salted.groupBy("length", "_salt").count()
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_start", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    within = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (
        salted.withColumn("_row", F.row_number().over(within) - 1)
        .join(starts, ["length", "_salt"])
        .withColumn("_rank", F.col("_start") + F.col("_row"))
    )
    plan = spark.sparkContext.broadcast(by_length)

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        seq, off = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
        n, r = length.to_numpy(), rank.to_numpy()
        for value in np.unique(n):
            rows = np.flatnonzero(n == value)
            t = plan.value[int(value)]
            t = t[np.searchsorted(t[:, 0], r[rows], side="right") - 1]
            k = r[rows] - t[:, 0]
            seq[rows] = t[:, 2] + k // t[:, 3]
            off[rows] = t[:, 4] + k % t[:, 3] * value
        return pd.DataFrame({"sequence_id": seq, "offset": off})

    placed = ranked.withColumn("_place", place("length", "_rank"))
    keep = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    return placed.select(*keep, "_place.sequence_id", "_place.offset")


def pack_documents(docs: DataFrame, vocabulary: str, cap: Capacity = Capacity(), **columns) -> DataFrame:
    """Tokenize, cut and pack all documents: one row per piece with its sequence and offset."""
    return pack(materialize(tokenize_pieces(docs, vocabulary, cap.tokens, **columns), "pieces"), cap)
