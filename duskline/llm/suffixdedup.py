"""Removal of long repeated passages by prefix-free parsing.

A byte is removed if it lies in a string of ``length`` bytes (400) that also
starts anywhere else in the corpus, the same document included. Overlaps count;
strings are judged on the input; matches never cross documents.

Parsing: a rolling hash over ``gram`` bytes triggers a phrase start wherever it
is the least of ``window`` consecutive hashes, so triggers depend on content
alone and each string of ``length`` bytes holds one. Each text position i is
assigned the trigger that its own first ``window`` hashes choose; the positions
of one trigger form a phrase, and the phrase with its right context of
``length`` bytes is its extended phrase. Extended phrases with equal content are one entry
of the dictionary; the parse says where each entry occurs.

Corpus order: the suffixes of the dictionary entries, truncated at ``length``
bytes, stand for all text positions. Equal truncated suffixes have the same
trigger content behind their start and the same distance to it, so entries are
grouped by that content, and:
  1. an entry that the parse holds twice repeats in all its positions;
  2. an entry that occurs once needs its suffixes compared only if other entries
     share its trigger content; those are the borders of repeats. Their suffixes go in
     blocks: one whose common core occurs once repeats nowhere, one whose bytes all
     occur again repeats throughout, and only what is left is put in order.
The suffix array of what is left: within a core and a distance to the trigger,
truncated suffixes differ only in the ``BLOCK`` - 1 bytes around the core, so these
bytes are the sort key and no suffix is copied out. A range shuffle sorts them
over all tasks, whatever the size of a group; a suffix repeats if it equals its
neighbour in that order. Groups follow one another by hash, suffixes within a group
by their bytes. Work and shuffle grow with the number of phrases (about 2 /
window of the bytes), not with the number of suffixes, and no text is gathered
anywhere.

Nulls: a null text is empty. Texts shorter than ``length`` bytes are kept whole.
Repeated rows are separate texts, so they repeat each other. Empty tables and
extra columns are allowed.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import RollingHash, batches_of_bytes, discard, lean, materialize, mix64, set_aside, shuffle_partitions, utf8_bytes

GRAM = 16
WINDOW = 150
SEGMENT = 1 << 20
BLOCK = 25
CODE = 6
_WIDE_SPACES = [c.encode() for c in map(chr, range(128, 0x3001)) if c.isspace()]


def sliding_min(v: np.ndarray, window: int) -> np.ndarray:
    """Minimum of each run of ``window`` values, by doubling."""
    span, m = 1, v
    while span * 2 <= window:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    if span < window:
        m = np.minimum(m[: len(v) - window + 1], m[window - span : window - span + len(v) - window + 1])
    return m


def phrases(data: np.ndarray, offsets: np.ndarray, length: int, gram: int, window: int):
    """Phrases of concatenated texts: arrays (text, first, last, trigger) of positions, and the hash.

    A phrase covers the starts first..last of strings of ``length`` bytes whose trigger is the same.
    """
    empty = np.zeros(0, np.int64)
    if len(data) < length:
        return empty, empty, empty, empty, None
    rolling = RollingHash(data)
    grams = rolling.all_of(gram)
    bits = np.uint64(32)  # the same split everywhere, so that content alone decides ties
    keyed = (grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64)
    least = sliding_min(keyed, window)  # its low bits are the trigger's place: leftmost of equal hashes
    trigger = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    sizes = np.diff(offsets)
    starts = np.maximum(sizes - length + 1, 0)
    text = np.repeat(np.arange(len(sizes)), starts)
    if not len(text):  # texts enough, but each too short
        return empty, empty, empty, empty, None
    where = np.arange(starts.sum()) - np.repeat(np.cumsum(starts) - starts, starts) + np.repeat(offsets[:-1], starts)
    t = trigger[where]
    new = np.ones(len(t), bool)
    new[1:] = t[1:] != t[:-1]
    at = np.flatnonzero(new)
    end = np.append(at[1:], len(t)) - 1
    return text[at], where[at], where[end], t[at], rolling


#: Names of columns that the operators need for themselves; those of a table are set aside meanwhile.
OWN = ("_key", "_spans", "_at", "_text")


def with_text_key(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Equal rows (id and text) share a key; their marks are the same."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.withColumn("_key", F.xxhash64(F.col(id_col), text, F.crc32(text.cast("binary"))))


def parse(keyed: DataFrame, text_col: str, length: int, gram: int, window: int) -> DataFrame:
    """One row per phrase occurrence: context, entry, text key, place.

    ``context`` is the hash of what every string of the phrase has behind its trigger, ``entry`` that of the
    extended phrase; ``place`` packs the first start, the last start and the trigger relative to it.
    """

    def run(batches):
        for batch in batches:
            for part in batches_of_bytes(batch, "_text"):
                whole, bounds = utf8_bytes(part.column("_text"))
                key = part.column("_key").to_numpy(zero_copy_only=False)
                # a long text is parsed in segments of starts; a phrase that is cut there is compared as a border
                for at in range(0, max(len(whole), 1), SEGMENT):
                    long = len(whole) > 2 * SEGMENT and part.num_rows == 1
                    data = whole[at : at + SEGMENT + length - 1] if long else whole
                    offsets = np.array([0, len(data)]) if long else bounds
                    text, first, last, trigger, rolling = phrases(data, offsets, length, gram, window)
                    if len(text):
                        context = rolling.of(trigger, length - window)
                        shape = ((trigger - first) * 65536 + (last - first)).astype(np.uint64)
                        entry = mix64(rolling.of(first, last - first + length) + shape)
                        base = offsets[text] - (at if long else 0)
                        place = (first - base) << 32 | (last - first) << 16 | (trigger - first)
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(context.view(np.int64)),
                                pa.array(entry.view(np.int64)),
                                pa.array(key[text]),
                                pa.array(place),
                            ],
                            ["context", "entry", "_key", "place"],
                        )
                    if not long:
                        break

    source = keyed.select("_key", F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    return source.mapInArrow(lean(run), "context long, entry long, _key long, place long")


def repeated_spans(keyed: DataFrame, text_col: str, length: int, gram: int, window: int) -> DataFrame:
    """(_key, spans array<struct<a,b>>): byte ranges of each text that repeat; may overlap, ordered."""
    parsed = materialize(parse(keyed, text_col, length, gram, window), "phrases")
    # a table of its own, so that the join with a very common context can be split
    again = materialize(parsed.groupBy("context").count().filter("count > 1").select("context"), "contexts")
    occurrences = materialize(parsed.join(again, "context", "left_semi"), "phrases-shared")
    discard(parsed, again)
    entries = occurrences.groupBy("context", "entry").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("_key", "place")).alias("at")
    )
    entries = materialize(entries.select("context", "entry", "n", "at.*"), "entries")
    mixed = entries.groupBy("context").agg(F.count(F.lit(1)).alias("kinds"), F.min("n").alias("least"))
    # borders: the entries whose suffixes must be compared one by one, each at one place in the corpus
    borders = entries.join(mixed.filter("kinds > 1 and least = 1").select("context"), "context", "left_semi")
    places = borders.groupBy("_key").agg(F.collect_list(F.struct("context", "n", "place")).alias("_at"))
    blocks = materialize(border_blocks(keyed.join(places, "_key"), text_col, length), "blocks")
    # a block whose core occurs once repeats nowhere; one whose bytes occur again repeats all over
    group = ["context", "core"]
    alive = blocks.groupBy(*group).count().filter("count > 1").select(*group)
    alive = materialize(alive, "cores")
    every, blocks = blocks, materialize(blocks.join(alive, group, "left_semi"), "blocks-shared")
    discard(every, alive)
    covers = blocks.groupBy(*group, "lead", "outer").agg(F.count(F.lit(1)).alias("c"))
    size = F.length("outer") - (BLOCK - 2)
    covered = blocks.filter("n = 1").join(covers.filter("c > 1").drop("c"), [*group, "lead", "outer"]).select(
        "_key", F.col("start").alias("a"), (F.col("start") + size - 1).alias("b")
    )
    mixed = covers.groupBy(*group).agg(F.min("c").alias("least"), F.count(F.lit(1)).alias("kinds"))
    opened = blocks.join(mixed.filter("least = 1 and kinds > 1").select(*group), group, "left_semi")
    suffixes = opened.select("*", F.explode(F.sequence(F.lit(0), size - 1)).alias("i")).select(
        *group,
        (F.col("lead") - F.col("i")).alias("back"),
        F.expr(f"substring(outer, i + 1, {BLOCK - 1})").alias("around"),
        "n",
        "_key",
        (F.col("start") + F.col("i")).alias("start"),
    )
    # a suffix of an entry that occurs once and has an equal beside it in the order: mark it at its own place
    suffixes = materialize(suffixes, "suffixes")
    single = repeats_in_order(suffixes, [*group, "back", "around"])
    single = single.select("_key", F.col("start").alias("a"), F.col("start").alias("b"))
    single = materialize(covered.unionByName(single), "border-marks")
    discard(blocks, suffixes)
    first = F.shiftright("place", 32)
    whole = occurrences.join(entries.filter("n > 1").select("context", "entry"), ["context", "entry"]).select(
        "_key", first.cast("int").alias("a"), (first + F.shiftright("place", 16).bitwiseAND(F.lit(65535))).cast("int").alias("b")
    )
    marks = whole.unionByName(single).withColumn("b", F.col("b") + length)
    return marks.groupBy("_key").agg(F.array_sort(F.collect_set(F.struct("a", "b"))).alias("spans"))


def repeats_in_order(suffixes: DataFrame, order: list[str]) -> DataFrame:
    """(_key, start): the suffixes of single entries (n = 1) that equal a neighbour in the sort by ``order``."""

    def run(batches):
        held = None  # the row before, of which only the next one is not yet known
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            if held is not None:
                rows = pa.concat_tables([held, rows])
            same = np.ones(rows.num_rows - 1, bool)
            for c in order:
                column = rows.column(c)
                same &= pc.equal(column[:-1], column[1:]).to_numpy()
            repeats = np.append(same, False)
            repeats[1:] |= same
            if held is not None:
                repeats[0] |= before
            held, before = rows.slice(rows.num_rows - 1), bool(repeats[-1])
            yield from emit(rows.slice(0, rows.num_rows - 1), repeats[:-1])
        if held is not None:
            yield from emit(held, np.array([before]))

    def emit(rows, repeats):
        single = repeats & (rows.column("n").to_numpy() == 1)
        yield from rows.select(["_key", "start"]).filter(pa.array(single)).combine_chunks().to_batches()

    parts = shuffle_partitions(suffixes.sparkSession)
    ordered = suffixes.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return ordered.mapInArrow(lean(run), "_key long, start int")


def border_blocks(texts: DataFrame, text_col: str, length: int) -> DataFrame:
    """(context, core, n, _key, start, lead, outer): blocks of up to BLOCK suffixes of the given entries.

    Blocks are aligned to the trigger. ``core`` is the hash of what all strings of the block have in common,
    ``outer`` the block's bytes without it, of which ``lead`` stand before it. The truncated suffix that starts at
    the i-th of them is told from others of the core by lead - i and the BLOCK - 1 bytes of ``outer`` from i on.
    """

    def run(batches):
        for batch in batches:
            for part in batches_of_bytes(batch, "_text"):
                data, offsets = utf8_bytes(part.column("_text"))
                rolling = RollingHash(data)
                lists = part.column("_at")
                flat = lists.flatten()
                count = np.diff(lists.offsets.to_numpy()) if len(lists) else np.zeros(0, np.int64)
                row = np.repeat(np.arange(len(count)), count)
                f = {c: flat.field(c).to_numpy(zero_copy_only=False) for c in ("context", "n", "place")}
                first = (f["place"] >> 32) + offsets[row]
                last = first + (f["place"] >> 16 & 65535)
                trigger = first + (f["place"] & 65535)
                low = (trigger - last) // BLOCK
                blocks = (trigger - first) // BLOCK - low + 1
                e = np.repeat(np.arange(len(first)), blocks)
                k = np.arange(len(e)) - np.repeat(np.cumsum(blocks) - blocks, blocks) + low[e]
                top = trigger[e] - k * BLOCK  # the last start that the block may have
                begin, end = np.maximum(first[e], top - BLOCK + 1), np.minimum(last[e], top)
                inner = length - BLOCK + 1
                core = mix64(rolling.of(top, inner) + k.astype(np.uint64))
                lead = top - begin
                size = lead + end - top + BLOCK - 1
                bounds = np.concatenate(([0], np.cumsum(size)))
                at = np.arange(bounds[-1]) - np.repeat(bounds[:-1], size)
                at += np.repeat(begin, size) + np.where(at >= np.repeat(lead, size), inner, 0)
                outer = pa.BinaryArray.from_buffers(
                    pa.binary(), len(size), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(data[at].tobytes())]
                )
                key = part.column("_key").to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(f["context"][e]),
                        pa.array(core.view(np.int64)),
                        pa.array(f["n"][e]),
                        pa.array(key[row[e]]),
                        pa.array((begin - offsets[row[e]]).astype(np.int32)),
                        pa.array(lead.astype(np.int32)),
                        outer,
                    ],
                    ["context", "core", "n", "_key", "start", "lead", "outer"],
                )

    source = texts.select("_key", F.coalesce(F.col(text_col), F.lit("")).alias("_text"), "_at")
    return source.mapInArrow(lean(run), "context long, core long, n long, _key long, start int, lead int, outer binary")


def _merge(spans, size: int) -> list[tuple[int, int]]:
    """Maximal runs of sorted, possibly touching ranges, cut at ``size``."""
    runs: list[list[int]] = []
    for s in spans if spans is not None else ():
        a, b = s["a"], min(s["b"], size)
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], b)
        else:
            runs.append([a, b])
    return [(a, b) for a, b in runs]


def _passages(data: bytes, spans, words: int) -> list[tuple[int, int]]:
    """Maximal byte runs of the strings of ``words`` words whose codes start in ``spans``, first word to last."""
    if spans is None or not len(spans):
        return []
    first, end = word_places(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    runs: list[list[int]] = []
    for s in spans:
        # a start within a code is no start of a word
        a, b = -(-s["a"] // CODE), (s["b"] - words * CODE) // CODE + words
        if b - a < words:
            continue
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], b)
        else:
            runs.append([a, b])
    return [(int(first[a]), int(end[b - 1])) for a, b in runs]


def word_places(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end byte of each word of UTF-8 texts: the runs between white space, as ``str.split`` has them."""
    n = len(data)
    inside = ~(((data >= 9) & (data <= 13)) | ((data >= 28) & (data <= 32)))
    for space in _WIDE_SPACES:
        at = np.flatnonzero(data[: n - len(space) + 1] == space[0]) if n >= len(space) else np.zeros(0, np.int64)
        for k in range(1, len(space)):
            at = at[data[at + k] == space[k]]
        for k in range(len(space)):
            inside[at + k] = False
    bounds = np.zeros(n + 1, bool)
    bounds[offsets] = True
    start, stop = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1] | bounds[1:-1]
    stop[:-1] &= ~inside[1:] | bounds[1:-1]
    return np.flatnonzero(start), np.flatnonzero(stop) + 1


def word_codes():
    """A column function: each word of a text as ``CODE`` characters of its hash, so that words repeat as bytes do."""

    @F.pandas_udf("string")
    def code(text: pd.Series) -> pd.Series:
        out = []
        batch = pa.RecordBatch.from_arrays([pa.array(text, pa.large_string())], ["text"])
        for part in batches_of_bytes(batch, "text"):
            data, offsets = utf8_bytes(part.column("text"))
            first, end = word_places(data, offsets)
            h = RollingHash(data).of(first, end - first)
            bits = h[:, None] >> (np.arange(CODE, dtype=np.uint64) * np.uint64(6)) & np.uint64(63)
            codes = (bits + np.uint64(48)).astype(np.uint8).tobytes().decode("ascii")
            at = (np.searchsorted(first, offsets) * CODE).tolist()
            out += [codes[a:b] for a, b in zip(at[:-1], at[1:])]
        return pd.Series(out, dtype=object)

    return code


def mark_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = 400,
    gram: int = GRAM,
    window: int = WINDOW,
    by_words: bool = False,
    words: int | None = None,
) -> DataFrame:
    """All columns of ``docs`` with ``_spans``: the byte ranges that repeat (null if none).

    ``by_words``: the ranges are those of the text's word codes, and so is ``length``.
    ``words``: strings of so many words are looked for as well; ``_coded`` has the ranges of their codes.
    """
    if not (0 < gram < window <= min(length - gram, 65535) and length > BLOCK):
        raise ValueError("need gram < window <= length - gram")
    keyed = with_text_key(docs, id_col, text_col)
    coded = keyed.withColumn(text_col, word_codes()(F.col(text_col)))
    spans = repeated_spans(coded if by_words else keyed, text_col, length, gram, window)
    marked = keyed.join(spans.withColumnRenamed("spans", "_spans"), "_key", "left")
    if words:
        size = words * CODE
        spans = repeated_spans(coded, text_col, size, gram, size * 3 // 8)
        marked = marked.join(spans.withColumnRenamed("spans", "_coded"), "_key", "left")
    return marked.drop("_key")


def removal_digest(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, words: int = 51
) -> DataFrame:
    """Per document: bytes, removed bytes, removed runs, the hash of what is left, that as text, and its passages.

    In ``text`` a code point that is cut in part goes whole; the hash is of the bytes as they are. Many passages of
    over 50 words are shorter than ``length`` bytes and so are not removed. They are returned beside: each string of
    ``words`` words that also starts anywhere else lies in one of ``n_passages`` runs of ``n_passage_bytes`` bytes in
    all; ``passages`` has them as start:end in bytes, end exclusive, joined by commas.
    """

    @F.pandas_udf(
        "n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string,"
        " n_passages long, n_passage_bytes long, passages string"
    )
    def cut(text: pd.Series, spans: pd.Series, coded: pd.Series) -> pd.DataFrame:
        rows = []
        for t, s, c in zip(text, spans, coded):
            data = (t or "").encode("utf-8", "surrogatepass")
            runs = _merge(s, len(data))
            kept, at = [], 0
            for a, b in runs:
                kept.append(data[at:a])
                at = b
            kept.append(data[at:])
            digest = hashlib.sha256(b"".join(kept)).hexdigest()
            left = "".join(k.decode("utf-8", "ignore") for k in kept)
            found = _passages(data, c, words)
            size, listed = sum(b - a for a, b in found), ",".join(f"{a}:{b}" for a, b in found)
            rows.append((len(data), sum(b - a for a, b in runs), len(runs), digest, left, len(found), size, listed))
        names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "text", "n_passages", "n_passage_bytes", "passages"]
        return pd.DataFrame(rows, columns=names)

    marked = mark_repeats(docs.select(id_col, text_col), id_col, text_col, length, words=words)
    digest = cut(text_col, "_spans", "_coded")
    return marked.select(F.col(id_col).alias("doc_id"), digest.alias("_d")).select("doc_id", "_d.*")


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, window: int = WINDOW
) -> DataFrame:
    """``docs`` with the repeated bytes cut out; a code point that is cut in part goes whole."""

    @F.pandas_udf("string")
    def cut(text: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for t, s in zip(text, spans):
            if t is None or s is None or not len(s):
                out.append(t)
                continue
            data = t.encode("utf-8", "surrogatepass")
            kept, at = [], 0
            for a, b in _merge(s, len(data)):
                kept.append(data[at:a])
                at = b
            kept.append(data[at:])
            out.append("".join(k.decode("utf-8", "ignore") for k in kept))
        return pd.Series(out, dtype=object)

    columns = docs.columns
    docs, back = set_aside(docs, *OWN)
    marked = mark_repeats(docs, id_col, text_col, length, window=window)
    fresh = F.when(F.col("_spans").isNull(), F.col(text_col)).otherwise(cut(F.col(text_col), F.col("_spans")))
    return marked.withColumn(text_col, fresh).drop(*OWN).withColumnsRenamed(back).select(*columns)


def remove_repeated_passages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 51
) -> DataFrame:
    """``docs`` with each string of ``words`` words cut out that also starts anywhere else in the corpus.

    The parse runs over word codes of ``CODE`` bytes each; a span that holds part of a code only is cut back to whole
    words. White space between words does not count.
    """

    @F.pandas_udf("string")
    def cut(text: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for t, s in zip(text, spans):
            if t is None or s is None or not len(s):
                out.append(t)
                continue
            data = t.encode("utf-8", "surrogatepass")
            first, end = word_places(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
            kept, at = [], 0
            for a, b in _merge(s, CODE * len(first)):
                a, b = -(-a // CODE), b // CODE
                if b - a >= words:
                    kept.append(data[at : first[a]])
                    at = end[b - 1]
            kept.append(data[at:])
            out.append(b"".join(kept).decode("utf-8", "surrogatepass"))
        return pd.Series(out, dtype=object)

    length = words * CODE
    columns = docs.columns
    docs, back = set_aside(docs, *OWN)
    marked = mark_repeats(docs, id_col, text_col, length, window=length * 3 // 8, by_words=True)
    fresh = F.when(F.col("_spans").isNull(), F.col(text_col)).otherwise(cut(F.col(text_col), F.col("_spans")))
    return marked.withColumn(text_col, fresh).drop(*OWN).withColumnsRenamed(back).select(*columns)
