"""Pairs of rows near in time, made as arrays inside tasks: what is grouped or made distinct where it is made is never a row."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a chunk of time, pairs that a task holds at once, entities whose links fit a square, and pairs of two blocks.
ROWS, BATCH, SQUARE, MADE = 400_000, 2_000_000, 8192, 16_000_000


def codes(*columns: pd.Series) -> np.ndarray:
    """A number for each distinct row of the columns, from 0; -1 if one of them is null."""
    out, null = np.zeros(len(columns[0]) if columns else 0, np.int64), False
    for c in columns:
        k, values = pd.factorize(c)
        null = null | (k < 0)
        out = np.unique(out * (len(values) + 1) + k, return_inverse=True)[1]
    return np.where(null, -1, out) if columns else out


def ends(key: np.ndarray, at: np.ndarray, reach: int) -> np.ndarray:
    """For rows in the order of (key, at): the end of the rows that follow each within ``reach`` under the same key."""
    n = len(key)
    out = np.empty(n, np.int64)
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if n else np.zeros(0, np.int64)
    span = int(at.max() - at.min()) + reach + 1 if n else 1
    if len(starts) * span < 2**62:
        rank = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, n]))
        place = rank * span + (at - at.min()) if n else at
        return np.minimum(np.searchsorted(place, place + reach, "right"), np.r_[starts[1:], n][rank]) if n else out
    for s, e in zip(starts, np.r_[starts[1:], n]):
        out[s:e] = s + np.searchsorted(at[s:e], at[s:e] + reach, "right")
    return out


def pairs(end: np.ndarray, first: np.ndarray | None = None, most: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) with first[i] <= j < end[i] (first: the row after i), in batches of about ``most`` pairs."""
    start = np.arange(1, len(end) + 1) if first is None else first
    n = np.maximum(end - start, 0)
    total, lo, most = np.cumsum(n), 0, most or BATCH
    while lo < len(n):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + most, "right")))
        m = n[lo:hi]
        if m.sum():
            i = np.repeat(np.arange(lo, hi), m)
            yield i, np.arange(len(i)) + np.repeat(start[lo:hi] - (np.cumsum(m) - m), m)
        lo = hi


def _patterns(strength, attributes: dict[str, tuple[str, ...]], geo: dict[float, tuple[str, ...]], seconds: int, least: float, same: tuple[str, ...]) -> list[tuple[tuple[str, ...], int]]:
    """(columns that are equal, greatest gap in microseconds at which a pair then passes ``least``), the least such sets."""
    found: dict[frozenset, int] = {}
    for r in range(len(attributes) + 1):
        for chosen in itertools.combinations(attributes, r):
            for near, place in geo.items():
                keys = frozenset(same).union(place, *(attributes[c] for c in chosen))
                passes = lambda us: strength({a: set(attributes[a]) <= keys for a in attributes}, us / 1e6, near) > least  # noqa: B023, E731
                if not passes(0):
                    continue
                lo, hi = 0, seconds * 1_000_000
                while lo < hi:  # the strength falls with the gap
                    mid = (lo + hi + 1) // 2
                    lo, hi = (mid, hi) if passes(mid) else (lo, mid - 1)
                found[keys] = max(found.get(keys, -1), lo)
    return [(tuple(sorted(k)), g) for k, g in found.items() if not any(o < k and found[o] >= g for o in found)]


def in_chunks(rows: DataFrame, seconds: int) -> DataFrame:
    """Rows (microseconds ``_m``) dealt to chunks of time ``_c``, a task each; a chunk has the ``seconds`` before it too, not its own."""
    n, lo, hi = rows.agg(F.count(F.lit(1)), F.min("_m"), F.max("_m")).first()
    chunks = max(2 * rows.sparkSession.sparkContext.defaultParallelism, math.ceil(n / ROWS))
    width = max(seconds * 1_000_000, ((hi or 0) - (lo or 0)) // chunks + 1)
    since = F.col("_m") - F.lit(lo or 0)
    chunk = F.floor(since / width).cast("long")
    late = since >= (chunk + 1) * F.lit(width) - seconds * 1_000_000  # rows that the next chunk needs
    to = F.when(late, F.array(chunk, chunk + 1)).otherwise(F.array(chunk))
    return rows.select("*", F.posexplode(to).alias("_p", "_c")).withColumn("_own", F.col("_p") == 0).drop("_p").repartition(chunks, "_c")


def pair_means(df: DataFrame, entity: str, ts: str, seconds: int, block: str, prepare) -> DataFrame:
    """(entity, n, mean): for each entity, of its pairs with rows of others (``block``, ``seconds``), the number and the mean value.

    ``prepare(rows)`` gives a function of the pairs (i, j, microseconds) that gives their values, or NaN for those that do
    not count. A task has a chunk of time and adds up its pairs in batches, so no pair is ever a row: what is shuffled are
    the rows, and a sum for each entity of a chunk. Null entities and blocks pair with nothing.
    """
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    rows = df.filter(F.col(entity).isNotNull() & F.col(ts).isNotNull() & F.col(block).isNotNull()).withColumn("_m", micros)

    def add(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        pdf["_k"] = codes(pdf[block])
        pdf = pdf.sort_values(["_k", "_m"], ignore_index=True)
        e, names = pd.factorize(pdf[entity])
        m, own = pdf["_m"].to_numpy(), pdf["_own"].to_numpy(bool)
        value = prepare(pdf)
        n, total = np.zeros(len(names), np.int64), np.zeros(len(names))
        for i, j in pairs(ends(pdf["_k"].to_numpy(), m, seconds * 1_000_000)):
            ok = own[j] & (e[i] != e[j])
            i, j = i[ok], j[ok]
            v = value(i, j, m[j] - m[i])
            ok = ~np.isnan(v)
            for x in (e[i[ok]], e[j[ok]]):
                n += np.bincount(x, minlength=len(names))
                total += np.bincount(x, v[ok], len(names))
        met = np.flatnonzero(n)
        yield pd.DataFrame({"e": np.asarray(names, dtype=object)[met], "n": n[met], "total": total[met]})

    kind = df.schema[entity].dataType.simpleString()
    sums = by_group(in_chunks(rows, seconds), "_c", add, f"e {kind}, n bigint, total double")
    return sums.groupBy(F.col("e").alias(entity)).agg(F.sum("n").alias("n"), (F.sum("total") / F.sum("n")).alias("mean"))


def linked(df: DataFrame, entity: str, ts: str, seconds: int, strength, attributes: dict, geo: dict, least: float, same: tuple[str, ...] = ()) -> DataFrame:
    """(a, b), a < b: entities with two rows within ``seconds`` whose strength is above ``least``; each two once.

    ``strength(equal, gap_seconds, nearness)`` must not fall when more attributes are equal nor rise with the gap, so
    for each set of equal columns there is one greatest gap at which two rows link. Time is cut into chunks, a task has
    one and what leads up to it. Of the rows of an entity with equal attributes only the first and the last of a slot
    are kept, which changes no link as a slot is shorter than every greatest gap. In the task the rows that follow each
    one within the gap are marked in a square of entities, or beyond ``SQUARE`` entities listed and made distinct in
    batches. So links are shuffled, at most once a chunk, and never pairs of rows. Null entities link with nothing, null
    attributes equal nothing. ``same``: columns that must be equal.
    """
    patterns = _patterns(strength, attributes, geo, seconds, least, same)
    columns = sorted({c for k, _ in patterns for c in k})
    slot = max(1, min((g for _, g in patterns), default=0))
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    rows = df.filter(F.col(entity).isNotNull() & F.col(ts).isNotNull()).select(F.col(entity).alias("_e"), *columns, micros.alias("_m"))
    dealt = in_chunks(rows, seconds)
    kept = dealt.groupBy("_c", "_e", *columns, F.floor(F.col("_m") / slot).alias("_s")).agg(F.min("_m").alias("_first"), F.max("_m").alias("_last"))

    def link(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        e, names = pd.factorize(pdf["_e"], sort=True)
        first, last = pdf["_first"].to_numpy(), pdf["_last"].to_numpy()
        size = len(names)
        names = np.asarray(names, dtype=object)
        square = np.zeros((size, size), bool) if size <= SQUARE else None
        held: list[np.ndarray] = []

        def frame(a, b) -> pd.DataFrame:
            return pd.DataFrame({"a": names[a], "b": names[b]})

        for key, reach in patterns:
            k = codes(*(pdf[c] for c in key)) if key else np.zeros(len(pdf), np.int64)
            ok = k >= 0
            point = pd.DataFrame({"k": np.r_[k[ok], k[ok]], "m": np.r_[first[ok], last[ok]], "e": np.r_[e[ok], e[ok]]})
            # an entity may have many rows under one key in a slot: again its first and last
            point["s"] = point["m"] // slot
            few = point.groupby(["k", "e", "s"], sort=False)["m"].agg(["min", "max"]).reset_index()
            two = few["max"].to_numpy() > few["min"].to_numpy()
            kk, ee = (np.r_[few[c].to_numpy(), few[c].to_numpy()[two]] for c in "ke")
            mm = np.r_[few["min"].to_numpy(), few["max"].to_numpy()[two]]
            order = np.lexsort((mm, kk))
            kk, mm, ee = kk[order], mm[order], ee[order]
            end = ends(kk, mm, reach)
            if square is not None:
                long = np.flatnonzero(end - np.arange(len(end)) > 24)
                for i, x, stop in zip((long + 1).tolist(), ee[long].tolist(), end[long].tolist()):
                    square[x, ee[i:stop]] = True
                end[long] = 0
                for i, j in pairs(end):
                    square[ee[i], ee[j]] = True
                continue
            for i, j in pairs(end):
                x, y = ee[i], ee[j]
                held.append(np.unique(np.minimum(x, y)[x != y] * size + np.maximum(x, y)[x != y]))
                if sum(map(len, held)) > 2 * BATCH:
                    held = [np.unique(np.concatenate(held))]
                    if len(held[0]) > BATCH:
                        yield frame(*np.divmod(held.pop(), size))
        if square is not None:
            square |= square.T
            for x in range(size - 1):
                y = np.flatnonzero(square[x, x + 1 :]) + x + 1
                if len(y):
                    held.append(x * size + y)
                if sum(map(len, held)) > BATCH or x == size - 2:
                    if held:
                        yield frame(*np.divmod(np.concatenate(held), size))
                    held = []
        elif held:
            yield frame(*np.divmod(np.unique(np.concatenate(held)), size))

    kind = df.schema[entity].dataType.simpleString()
    return by_group(kept, "_c", link, f"a {kind}, b {kind}").distinct()


def windows(key: np.ndarray, at: np.ndarray, to_key: np.ndarray, to: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """For each (key, at): start and end of the rows (to_key, to), which are in order, of that key within ``reach``."""
    low = min((int(x.min()) for x in (at, to) if len(x)), default=0)
    span = max((int(x.max()) for x in (at, to) if len(x)), default=0) - low + 2 * reach + 2
    if int(max(key.max(initial=0), to_key.max(initial=0)) + 1) * span < 2**62:
        place, to_place = key * span + (at - low) + reach, to_key * span + (to - low) + reach
        return np.searchsorted(to_place, place - reach), np.searchsorted(to_place, place + reach, "right")
    start, end = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
    for k in np.unique(key):
        of, s, e = key == k, *np.searchsorted(to_key, [k, k + 1])
        start[of], end[of] = s + np.searchsorted(to[s:e], at[of] - reach), s + np.searchsorted(to[s:e], at[of] + reach, "right")
    return start, end


def by_entities(df: DataFrame, entity: str, ts: str, seconds: int, prepare, schema: str, block: str | None = None) -> DataFrame:
    """What is made of the pairs of rows of each two entities (equal ``block``, if any, within ``seconds``), pairs being no rows.

    Entities are dealt to blocks and a task has the rows of two blocks, so all pairs of two entities are in one task.
    The task goes through them in batches in the order of an entity. ``prepare(rows)`` (pandas) gives two functions:
    ``make(i, j, gap)`` gives the columns that are kept of pairs (row numbers, microseconds), and ``group(start,
    columns)`` those of a group for the columns in order of the groups that begin at ``start``. It must be right to
    group what was grouped. The result has the entities a < b and these columns. Null entities and blocks pair with nothing.
    """
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    rows = df.filter(F.col(entity).isNotNull() & F.col(ts).isNotNull() & (F.col(block).isNotNull() if block else F.lit(True)))
    bucket = F.floor(F.unix_timestamp(ts) * 2 / seconds)
    n = F.col("_n").cast("double")
    squares = rows.groupBy(*([block] if block else []), bucket.alias("_t")).agg(F.count(F.lit(1)).alias("_n")).agg(F.sum(n * n)).first()[0] or 0
    cores = df.sparkSession.sparkContext.defaultParallelism
    blocks = math.ceil(math.sqrt(max(4 * cores, 4 * squares / MADE)))
    x, y = F.pmod(F.xxhash64(entity), F.lit(blocks)).cast("int"), F.col("_y")
    every = rows.select("*", micros.alias("_m"), x.alias("_x"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_y"))
    x = F.col("_x")
    dealt = every.withColumn("_g", F.least(x, y) * blocks + F.greatest(x, y)).withColumn("_left", x <= y).drop("_x", "_y")
    dealt = dealt.repartition(blocks * (blocks + 1), "_g")  # twice the tasks that have rows: few share a partition
    reach = seconds * 1_000_000

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        g = table.column("_g")[0].as_py()
        pdf = table.drop_columns(["_g"]).to_pandas()
        e, names = pd.factorize(pdf[entity], sort=True)
        names = np.asarray(names)
        k = codes(pdf[block]) if block else np.zeros(len(pdf), np.int64)
        m, of = pdf["_m"].to_numpy(), pdf["_left"].to_numpy(bool)
        make, group = prepare(pdf)
        same = g % (blocks + 1) == 0  # a block with itself
        left, right = (np.flatnonzero(of), np.flatnonzero(of | same & of if same else ~of))
        left, right = left[np.argsort(e[left], kind="stable")], right[np.lexsort((m[right], k[right]))]
        first, end = windows(k[left], m[left], k[right], m[right], reach)
        held: list = []

        def grouped(parts):
            code, columns = np.concatenate([c for c, _ in parts]), [np.concatenate(x) for x in zip(*(c for _, c in parts))]
            order = np.argsort(code)
            code = code[order]
            start = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
            return code[start], group(start, [c[order] for c in columns])

        def batch(code, columns):
            a, b = np.divmod(code, len(names))
            ends_ = [pa.array(names[x]) for x in (np.minimum(a, b), np.maximum(a, b))]
            return pa.RecordBatch.from_arrays([*ends_, *map(pa.array, columns)], ["a", "b", *(f"c{i}" for i in range(len(columns)))])

        for i, j in pairs(end, first):
            last = i[-1] + 1 == len(left) or e[left[i[-1]]] != e[left[i[-1] + 1]] or None
            i, j = left[i], right[j]
            ok = e[i] < e[j] if same else e[i] != e[j]
            if not ok.all():
                i, j = i[ok], j[ok]
            if len(i):
                held.append(grouped([(e[i] * len(names) + e[j], make(i, j, np.abs(m[i] - m[j])))]))
            if len(held) > 1:
                held = [grouped(held)]
            if held and len(held[0][0]):
                # the groups of the entity at the end may go on in the next batch
                code, columns = held[0]
                cut = len(code) if last else int(np.searchsorted(code, (code[-1] // len(names)) * len(names)))
                if cut:
                    yield batch(code[:cut], [c[:cut] for c in columns])
                held = [(code[cut:], [c[cut:] for c in columns])] if cut < len(code) else []
        if held:
            yield batch(*held[0])

    columns = [c.split() for c in schema.split(", ") if c]
    kind = df.schema[entity].dataType.simpleString()
    made = dealt.groupBy("_g").applyInArrow(run, ", ".join([f"a {kind}, b {kind}", *(f"c{i} {c}" for i, (_, c) in enumerate(columns))]))
    return made.toDF("a", "b", *[name for name, _ in columns])


def classes(*columns: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """A number for each distinct row of the columns, nulls being values, and the first row of each."""
    out = np.zeros(len(columns[0]), np.int64)
    for c in columns:
        k, values = pd.factorize(c)
        out = np.unique(out * (len(values) + 1) + k + 1, return_inverse=True)[1]
    return out, np.unique(out, return_index=True)[1]


class PairTable:
    """``of(i, j)`` of two rows that depends on their classes alone: worked out once for each two classes that meet."""

    def __init__(self, number: np.ndarray, first: np.ndarray, of, most: int = 2_000_000):
        self.number, self.first, self.of, k = number.astype(np.int32), first, of, len(first)
        self.table = of(np.repeat(first, k), np.tile(first, k)) if k * k <= most else None

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        code = self.number[i].astype(np.int64) * len(self.first) + self.number[j]
        if self.table is not None:
            return self.table[code]
        met, at = np.unique(code, return_inverse=True)
        return self.of(self.first[met // len(self.first)], self.first[met % len(self.first)])[at]


def within_two(links: DataFrame) -> DataFrame:
    """(src, dst): nodes at one or two steps of each other, without loops; each two once in each direction.

    ``links`` has each link once in both directions. Where steps over two links are few they are joined. Where they are
    more than the rows that blocks need (all meet all, so nodes of many links share most of their neighbours), nodes
    are dealt to blocks, and a task has the links of two of them: it marks what is reached and lists each two once.
    """
    degree = links.groupBy("src").agg(F.count(F.lit(1)).alias("_d"))
    d = F.col("_d").cast("double")
    nodes, n, steps = degree.agg(F.count(F.lit(1)), F.coalesce(F.sum("_d"), F.lit(0)), F.coalesce(F.sum(d * d), F.lit(0.0))).first()
    cores = links.sparkSession.sparkContext.defaultParallelism
    blocks = max(math.ceil(math.sqrt(2 * cores)), math.ceil(2 * nodes / SQUARE), math.ceil(n / BATCH))
    if steps <= 2 * blocks * n:
        far = links.alias("l").join(links.alias("m"), F.col("l.dst") == F.col("m.src")).select(F.col("l.src").alias("src"), F.col("m.dst").alias("dst"))
        return links.union(far).filter("src <> dst").distinct()
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = links.select("src", "dst", F.lit(True).alias("_left"), block("src").alias("_x"), every.alias("_y"))
    right = links.select("src", "dst", F.lit(False).alias("_left"), every.alias("_x"), block("dst").alias("_y"))
    dealt = left.union(right).withColumn("_g", F.col("_x") * blocks + F.col("_y")).drop("_x", "_y").repartition(2 * blocks * blocks, "_g")

    def reach(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        of = pdf["_left"].to_numpy(bool)
        nodes, names = pd.factorize(pd.concat([pdf["src"], pdf["dst"]], ignore_index=True))
        src, dst = nodes[: len(pdf)], nodes[len(pdf) :]
        a, b = np.unique(src[of]), np.unique(dst[~of])
        at = np.full(len(names), -1)
        at[b] = np.arange(len(b))
        # by the node between: where it is reached from, and where it leads, itself included
        i, j = np.argsort(dst[of], kind="stable"), np.argsort(src[~of], kind="stable")
        came, start = dst[of][i], np.searchsorted(a, src[of][i])
        went, stop = src[~of][j], at[dst[~of][j]]
        names = np.asarray(names, dtype=object)
        rows = max(1, 4 * BATCH // max(1, len(b)))
        middle = np.unique(came)
        lo, hi, to_lo, to_hi = np.searchsorted(came, middle), np.searchsorted(came, middle, "right"), np.searchsorted(went, middle), np.searchsorted(went, middle, "right")
        for top in range(0, len(a), rows):
            square = np.zeros((min(rows, len(a) - top), len(b)), bool)
            for m, s, e, t, u in zip(middle.tolist(), lo.tolist(), hi.tolist(), to_lo.tolist(), to_hi.tolist()):
                x = start[s:e]
                x = x[(x >= top) & (x < top + rows)] - top
                if len(x):
                    square[x[:, None], stop[t:u]] = True
                    if at[m] >= 0:
                        square[x, at[m]] = True
            x, y = np.nonzero(square)
            x, y = a[x + top], b[y]
            if (x != y).any():
                yield pd.DataFrame({"src": names[x[x != y]], "dst": names[y[x != y]]})

    kind = links.schema["src"].dataType.simpleString()
    return by_group(dealt, "_g", reach, f"src {kind}, dst {kind}")


def forest(edges: DataFrame) -> DataFrame:
    """(src, dst): edges that join the same nodes as ``edges`` do, about one a node of each task."""

    def least(a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
        """The least node that each is joined with."""
        label = np.arange(size)
        while True:
            x, y = label[a], label[b]
            apart = x != y
            if not apart.any():
                return label
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = label[label]
                if (up == label).all():
                    break
                label = up

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def joined() -> pd.DataFrame:
            every = pd.concat(held, ignore_index=True)
            node, names = pd.factorize(pd.concat([every["src"], every["dst"]], ignore_index=True))
            label = least(node[: len(every)], node[len(every) :], len(names))
            few, names = np.flatnonzero(label < np.arange(len(names))), np.asarray(names)
            return pd.DataFrame({"src": names[few], "dst": names[label[few]]})

        for b in batches:
            held.append(b.to_pandas())
            n += b.num_rows
            if n > BATCH:
                held = [joined()]
                n = len(held[0])
                if n > BATCH // 2:
                    yield pa.RecordBatch.from_pandas(held.pop(), preserve_index=False)
                    n = 0
        if held:
            yield pa.RecordBatch.from_pandas(joined(), preserve_index=False)

    kind = edges.schema["src"].dataType.simpleString()
    return edges.filter("src <> dst").select("src", "dst").mapInArrow(thin, f"src {kind}, dst {kind}")


def node_blocks(nodes: int) -> int:
    """Blocks such that the neighbours of the nodes of two of them, as bits, take about 256 MB."""
    return max(4, math.ceil(2 * nodes * (nodes / 8) / 256e6))


def neighbour_bytes(nodes: int) -> float:
    return nodes / 8 * nodes * node_blocks(nodes)


def common_neighbours(edges: DataFrame, nodes: int) -> DataFrame:
    """(node, _t): triangles through each node that has any, ``edges`` being there once each.

    Nodes are numbered and dealt to blocks. The neighbours of a node are bits, and a task has those of two blocks: for
    each edge between them it counts the bits that both ends share. So paths of two edges are counted, never listed.
    """
    blocks = node_blocks(nodes)
    both = lambda e: e.select("src", "dst").union(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    least = both(edges).groupBy(F.col("src").alias("node")).agg(F.min(F.least("src", "dst")).alias("_l"))
    # nodes of one least neighbour stand near each other, so blocks that share no neighbours are seldom met
    hashed = least.withColumn("_b", F.pmod(F.xxhash64("_l"), F.lit(16)) * 16 + F.pmod(F.xxhash64("node"), F.lit(16)))
    sizes = hashed.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))  # 256 rows
    start = sizes.withColumn("_s", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = hashed.withColumn("_r", F.row_number().over(Window.partitionBy("_b").orderBy("_l", "node")) - 1).join(F.broadcast(start), "_b")
    number = ranked.select("node", (F.col("_s") + F.col("_r")).cast("int").alias("i"))
    if nodes <= 1_000_000:
        number = F.broadcast(number)  # two numbers a node
    ends = edges.join(number.toDF("src", "_i"), "src").join(number.toDF("dst", "_j"), "dst").select(F.col("_i").alias("src"), F.col("_j").alias("dst"))
    width = -(-nodes // 64) * 8
    strips = 4 * blocks
    tall = -(-nodes // strips)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits: dict[int, np.ndarray] = {}
        for b in batches:
            i, j = b.column(0).to_numpy(), b.column(1).to_numpy()
            for strip in np.unique(i // tall).tolist():
                of = i // tall == strip
                one = bits.setdefault(strip, np.zeros(tall * width, np.uint8))
                np.bitwise_or.at(one, (i[of] - strip * tall).astype(np.int64) * width + (j[of] >> 3), np.uint8(1) << (j[of] & 7).astype(np.uint8))
        for strip in list(bits):
            rows = bits.pop(strip).reshape(tall, width)
            seen = np.flatnonzero(rows.any(axis=1))
            for at in range(0, len(seen), 512):
                few = seen[at : at + 512]
                yield pa.RecordBatch.from_arrays([pa.array((few + strip * tall).astype(np.int32)), pa.array([rows[k].tobytes() for k in few], pa.binary())], ["i", "bits"])

    packed = both(ends).repartition(2 * strips, F.floor(F.col("src") / tall)).mapInArrow(pack, "i int, bits binary")
    size = -(-nodes // blocks)
    x, y = F.floor(F.col("i") / size).cast("int"), F.col("_y")
    dealt = packed.withColumn("_y", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("_g", F.least(x, y) * blocks + F.greatest(x, y)).drop("_y")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows, g = [], [], 0
        for b in batches:
            at.append(b.column("i").to_numpy())
            rows.append(np.stack([np.frombuffer(v.as_buffer(), np.uint64) for v in b.column("bits")]))
            g = b.column("_g")[0].as_py()
        i, bits = np.concatenate(at), np.concatenate(rows)
        del rows
        left, right = (np.flatnonzero(i // size == k) for k in divmod(g, blocks))
        if not len(left) or not len(right):
            return
        order = right[np.argsort(i[right])]
        a, b, near = i[left], i[order], bits[order]
        own = bits[left]
        use = own.any(axis=0) & near.any(axis=0)
        narrow, narrow_own = np.ascontiguousarray(near[:, use]), np.ascontiguousarray(own[:, use])
        del bits, near
        own = own.view(np.uint8)
        place, bit = b >> 3, np.uint8(1) << (b & 7).astype(np.uint8)
        through = np.zeros(nodes, np.int64)
        for k in range(len(left)):
            v = np.flatnonzero((own[k][place] & bit > 0) & ((b > a[k]) if g % (blocks + 1) == 0 else True))
            for lo in range(0, len(v), 256):
                some = v[lo : lo + 256]
                shared = np.bitwise_count(narrow[some] & narrow_own[k]).sum(axis=1, dtype=np.int64)
                through[b[some]] += shared
                through[a[k]] += shared.sum()
        found = np.flatnonzero(through)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(through[found])], ["i", "n"])

    counted = dealt.repartition(blocks * (blocks + 1), "_g").groupBy("_g").applyInArrow(meet, "i int, n bigint")
    # each triangle of a node is met at both of its edges there
    total = counted.groupBy("i").agg((F.sum("n") / 2).cast("long").alias("_t"))
    return number.join(total, "i").select("node", "_t")


def by_group(df: DataFrame, key: str, work, schema: str) -> DataFrame:
    """``work(frame)`` for all rows of each key; it may yield several frames."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from work(pd.concat(list(frames), ignore_index=True))

    return df.groupBy(key).applyInPandas(run, schema)
