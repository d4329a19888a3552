"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A text is split by the vocabulary's pattern; each pre-token is merged on its own
as bytes. The queue holds one bucket of linked-list positions per merge rank and
a three-level bitmap of the non-empty buckets; find-first-set gives the next
rank, the leftmost position of its bucket is merged, and entries whose pair has
changed meanwhile are skipped as stale. A merge costs O(log bucket) with no scan
of the pre-token, so a pre-token of a million bytes is encoded in one pass over
its merges.

Texts are rows; Spark spreads them, and each task keeps a bounded cache from
pre-token to ids. Nulls: a null text encodes as an empty one (no ids); a null id stays null. Repeated
rows give repeated rows; an empty table gives none; extra columns are ignored.
"""

from __future__ import annotations

import base64
from heapq import heappop, heappush
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of_bytes


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


_BIT = [1 << k for k in range(64)]


class ByteBPE:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, cache_bytes: int = 192 << 20):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.n_ranks = max(ranks.values()) + 1
        self.split = regex.compile(pattern).findall
        self.cache: dict[str, tuple[int, ...]] = {}
        self.cache_bytes = cache_bytes
        self.cached = 0
        # the queue, empty between pre-tokens: positions by rank, and two levels of 64-bit words of the bitmap
        self._buckets: dict[int, list[int]] = {}
        self._low = [0] * (self.n_ranks // 64 + 1)
        self._mid = [0] * (self.n_ranks // 4096 + 1)

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Ids of one pre-token: merge the pair of least rank, leftmost first, until none has a rank."""
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return (whole,)
        n, rank_of, bit = len(piece), ranks.get, _BIT
        buckets, low, mid, top = self._buckets, self._low, self._mid, 0  # top: the third level, one integer
        after = list(range(1, n + 1))  # start of the next symbol; -1 once merged away
        before = list(range(-1, n - 1))
        pairs = [(rank_of(piece[i : i + 2]), i) for i in range(n - 1)]
        while True:
            for r, i in pairs:
                if r is not None:
                    if r in buckets:
                        heappush(buckets[r], i)
                    else:
                        buckets[r] = [i]
                        a = r >> 6
                        low[a] |= bit[r & 63]
                        mid[a >> 6] |= bit[a & 63]
                        top |= 1 << (a >> 6)
            pairs = ()
            while top:  # find first set, level by level
                c = (top & -top).bit_length() - 1
                a = (c << 6) + (mid[c] & -mid[c]).bit_length() - 1
                rank = (a << 6) + (low[a] & -low[a]).bit_length() - 1
                bucket = buckets[rank]
                i = heappop(bucket)
                if not bucket:
                    del buckets[rank]
                    low[a] ^= bit[rank & 63]
                    if not low[a]:
                        mid[c] ^= bit[a & 63]
                        if not mid[c]:
                            top ^= 1 << c
                j = after[i]
                if j < 0 or j >= n:
                    continue  # stale: merged away, or nothing follows any more
                k = after[j]
                if rank_of(piece[i:k]) != rank:
                    continue  # stale: the pair here is another one now
                after[i], after[j] = k, -1
                h = before[i]
                if k < n:
                    before[k] = i
                    pairs = ((rank_of(piece[i : after[k]]), i), (rank_of(piece[h:k]) if h >= 0 else None, h))
                elif h >= 0:
                    pairs = ((rank_of(piece[h:k]), h),)
                break
            else:
                break
        ids, i = [], 0
        while i < n:
            ids.append(ranks[piece[i : after[i]]])
            i = after[i]
        return tuple(ids)

    def encode(self, text: str) -> list[int]:
        cache, out = self.cache, []
        pieces = self.split(text)
        missing = set(pieces).difference(cache)
        big: dict[str, tuple[int, ...]] = {}
        for p in missing:
            ids = self.merge(p.encode("utf-8", "surrogatepass"))
            if len(p) <= 64:
                if self.cached > self.cache_bytes:
                    kept = {q: cache[q] for q in set(pieces) if q in cache}
                    cache.clear()
                    cache.update(kept)
                    self.cached = 0
                cache[p] = ids
                self.cached += 150 + 12 * len(p)
            else:
                big[p] = ids
        if big:
            out = list(chain.from_iterable(cache[p] if p in cache else big[p] for p in pieces))
        else:
            out = list(chain.from_iterable(map(cache.__getitem__, pieces)))
        return out

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


_PER_WORKER: dict[tuple[str, str], ByteBPE] = {}


def worker_bpe(ranks_path: str, pattern: str) -> ByteBPE:
    """The codec of this Python worker, kept with its cache from task to task."""
    key = (ranks_path, pattern)
    if key not in _PER_WORKER:
        _PER_WORKER[key] = ByteBPE(load_ranks(ranks_path), pattern)
    return _PER_WORKER[key]


def encode_documents(
    docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, ids array<int>): the ids of every whole text."""

    def run(batches):
        bpe = worker_bpe(ranks_path, pattern)
        for batch in batches:
            for part in batches_of_bytes(batch, "text"):
                ids = [bpe.encode(t or "") for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return _source(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """(doc_id, data binary): the bytes that the ids of each row stand for."""

    def run(batches):
        bpe = worker_bpe(ranks_path, "")
        for batch in batches:
            data = [None if ids is None else bpe.decode(ids) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(data, pa.binary())], ["doc_id", "data"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, data binary")


def round_trip(
    docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Encode every text, decode the ids, and return counts and digests of both, row by row."""
    import hashlib

    def run(batches):
        bpe = worker_bpe(ranks_path, pattern)
        decimal = {i: str(i) for i in bpe.tokens}.__getitem__
        sha = hashlib.sha256
        for batch in batches:
            for part in batches_of_bytes(batch, "text"):
                n, of_ids, of_bytes = [], [], []
                for text in part.column("text").to_pylist():
                    ids = bpe.encode(text or "")
                    n.append(len(ids))
                    of_ids.append(sha(",".join(map(decimal, ids)).encode()).hexdigest())
                    of_bytes.append(sha(bpe.decode(ids)).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return _source(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
