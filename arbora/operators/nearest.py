"""Nearest rows of a table, exact in distance and, where distances are equal, in id.

Space is cut once, by medians of a sample, into cells of about ``CELL`` rows. A query's distance to its k-th nearest row of
the sample bounds its distance to its k-th nearest row of all, so it visits only the cells that the ball of that radius
meets. Every row is in one cell and none is left out. Rows travel packed, many to a record, and meet their queries in one
shuffle. Inside a cell the same cuts go on down to buckets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a cell, or the numbers it holds where vectors are long; rows of a bucket; numbers in the sample.
CELL, CELL_VALUES, BUCKET, SAMPLE = 50_000, 1 << 23, 512, 1 << 18
#: Numbers packed, and distances held, at once.
PACK, MATRIX = 1 << 21, 1 << 21


def cut(x: np.ndarray, size: int):
    """Tree of cuts (column, value, below, from there on) down to ``size`` points or equal ones, and its number of leaves."""
    leaves = 0

    def grow(p):
        nonlocal leaves
        lo, hi = (p.min(axis=0), p.max(axis=0)) if len(p) else (np.zeros(1), np.zeros(1))
        j = int((hi / 2 - lo / 2).argmax())
        if len(p) <= size or not hi[j] > lo[j]:
            leaves += 1
            return leaves - 1
        c = p[:, j]
        at = np.partition(c, len(c) // 2)[len(c) // 2]
        if not at > lo[j]:
            at = c[c > at].min()
        right = c >= at
        return j, float(at), grow(p[~right]), grow(p[right])

    return grow(x), leaves


def route(tree, x: np.ndarray, reach: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(leaf, numbers of the points in it), or of the points within ``reach`` of it and perhaps a few more."""

    def walk(node, rows):
        if not len(rows):
            return
        if isinstance(node, int):
            yield node, rows
            return
        j, at, left, right = node
        v = x[rows, j]
        if reach is None:
            below, above = v < at, v >= at
        else:
            r = reach[rows] * (1 + 1e-9) + np.abs(v) * 1e-15
            below, above = v - r < at, v + r >= at
        yield from walk(left, rows[below])
        yield from walk(right, rows[above])

    return walk(tree, np.arange(len(x)))


def squares(q: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances by one product, and for each query a bound of their error."""
    c = p.mean(axis=0)
    q, p = q - c, p - c
    qq, pp = (q * q).sum(axis=1), (p * p).sum(axis=1)
    return qq[:, None] + pp[None] - 2 * (q @ p.T), (qq + pp.max()) * (1e-15 * (p.shape[1] + 8))


def exact(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Distances of pairs of points, summed column by column."""
    s = np.zeros(len(q))
    for j in range(q.shape[1]):
        d = q[:, j] - p[:, j]
        s += d * d
    return np.sqrt(s)


def upper(q: np.ndarray, p: np.ndarray, k: int) -> np.ndarray:
    """For each query a bound of the squared distance to its point number ``k``, counted from 0; infinite if there is none."""
    out = np.full(len(q), np.inf)
    step = max(1, MATRIX // max(1, len(p)))
    for lo in range(0, len(q) if len(p) > k else 0, step):
        s, slack = squares(q[lo : lo + step], p)
        b = np.partition(s, k, axis=1)[:, k] + slack
        out[lo : lo + step] = np.where(np.isfinite(b), np.maximum(b, 0), np.inf)
    return out


def fold(x: np.ndarray, ids: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows by point and id, and which of them are among the ``keep`` least ids of their point. Equal points
    are equally far from any query, so no other row of a point can be wanted."""
    order = np.lexsort([ids, *x.T])
    s = x[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]).any(axis=1)
    start = np.flatnonzero(new)
    return order, np.arange(len(s)) - np.repeat(start, np.diff(np.append(start, len(s)))) < keep


def best(q: np.ndarray, o: np.ndarray, d: np.ndarray, k: int) -> np.ndarray:
    """Numbers of the ``k`` first pairs of each query by distance and id."""
    order = np.lexsort([o, d, q])
    s = q[order]
    start = np.flatnonzero(np.append(True, s[1:] != s[:-1])) if len(s) else np.zeros(0, np.int64)
    return order[np.arange(len(s)) - np.repeat(start, np.diff(np.append(start, len(s)))) < k]


class Cell:
    """Rows folded to different points, in buckets."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, k: int):
        order, kept = fold(x, ids, k + 1)
        order = order[kept]
        x, self.ids, self.k = x[order], ids[order], k
        self.rows = order
        first = np.ones(len(x), bool)
        first[1:] = (x[1:] != x[:-1]).any(axis=1)
        self.start = np.flatnonzero(first)
        self.many = np.diff(np.append(self.start, len(x)))
        self.p = x[self.start]
        self.tree, n = cut(self.p, max(BUCKET, 4 * (k + 1)))
        self.inside: list = [None] * n
        for leaf, at in route(self.tree, self.p):
            self.inside[leaf] = at

    def search(self, q: np.ndarray, q_ids: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, distance) by number: the k nearest rows of each query within its ``reach`` and with another id."""
        near = reach * reach * (1 + 1e-12)
        for leaf, at in route(self.tree, q):
            near[at] = np.minimum(near[at], upper(q[at], self.p[self.inside[leaf]], self.k))
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        waiting = 0

        def settle():
            a, b, d = (np.concatenate(c) for c in zip(*found))
            pick = best(a, self.ids[b], d, self.k)
            found[:] = [(a[pick], b[pick], d[pick])]

        for leaf, at in route(self.tree, q, np.sqrt(near)):
            mine = self.inside[leaf]
            step = max(1, MATRIX // len(mine))
            for lo in range(0, len(at), step):
                part = at[lo : lo + step]
                s, slack = squares(q[part], self.p[mine])
                a, b = np.nonzero(~(s > (near[part] * (1 + 1e-12) + slack)[:, None]))  # what is not a number is looked at, too
                a, b = part[a], mine[b]
                d, times = exact(q[a], self.p[b]), self.many[b]
                row = np.repeat(self.start[b] - (np.cumsum(times) - times), times) + np.arange(times.sum())
                a, d = np.repeat(a, times), np.repeat(d, times)
                other = (self.ids[row] != q_ids[a]) & np.isfinite(d)
                found.append((a[other], row[other], d[other]))
                waiting += int(other.sum())
                if waiting > MATRIX:
                    settle()
                    waiting = 0
        settle()
        a, b, d = found[0]
        return a, self.rows[b], d


def _vectors(column: pa.Array) -> np.ndarray:
    """Lists of one length as a matrix; NULL values are NaN."""
    if not len(column):
        return np.zeros((0, 0))
    values = column.flatten()
    width = len(values) // len(column)
    if len(values) % len(column) or (np.asarray(column.value_lengths()) != width).any():
        raise ValueError("vectors of several lengths")
    return values.to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(len(column), width)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array | None]]:
    """(ids, vectors, what is carried) of the rows with finite vectors, many at a time."""
    parts: list = []
    held = 0

    def whole():
        carried = [c for _, _, c in parts]
        return np.concatenate([i for i, _, _ in parts]), np.concatenate([x for _, x, _ in parts]), None if carried[0] is None else pa.concat_arrays(carried)

    for b in batches:
        if not b.num_rows:
            continue
        x = _vectors(b.column(1))
        ok = np.isfinite(x).all(axis=1)
        if ok.any():
            parts.append((b.column(0).to_numpy(zero_copy_only=False)[ok], x[ok], b.column(2).filter(pa.array(ok)) if b.num_columns > 2 else None))
            held += x.size + len(x)
        if held > PACK:
            yield whole()
            parts, held = [], 0
    if parts:
        yield whole()


#: Rows, or queries with their reach, of one cell.
_PACKED = "cell int, ids binary, x binary, reach binary, c binary, has binary"


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), *[pa.binary()] * 5]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], [f.split()[0] for f in _PACKED.split(", ")])


def nearest(df: DataFrame, id: str, vector: str, k: int, queries: DataFrame, carry: str | None = None) -> DataFrame:
    """(q, o, d, rk) and ``carry``, a number of the row o: the k nearest rows of ``df`` with another id for each row of
    ``queries``, numbered by distance and id. Ids are whole numbers, different in each table. Vectors have one length;
    rows whose vector is NULL or not finite are nobody's neighbours and have none."""
    spark = df.sparkSession
    names = [F.col(id).cast("long").alias("o"), F.col(vector).cast("array<double>").alias("v"), *([F.col(carry).cast("double").alias("c")] if carry else [])]
    rows = df.select(*names).where("o IS NOT NULL AND v IS NOT NULL")
    asked = queries.select(F.col(id).cast("long").alias("q"), F.col(vector).cast("array<double>").alias("v")).where("q IS NOT NULL AND v IS NOT NULL")
    n, width = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    share = max(1, -(-n * max(1, width) // SAMPLE))  # one row of so many is in the sample, which sets cuts and bounds only
    some = rows.where(F.pmod(F.xxhash64("o"), F.lit(share)) == 0).select("v").toArrow().column(0).combine_chunks()
    s = _vectors(some) if len(some) else np.zeros((0, max(1, width)))
    s = s[np.isfinite(s).all(axis=1)]
    per_cell = max(1, min(CELL, CELL_VALUES // max(1, width)))
    tree, cells = cut(s, max(1, len(s) * per_cell // max(n, 1)))
    fine, buckets = cut(s, max(BUCKET, 4 * (k + 1)))
    shared = spark.sparkContext.broadcast((s, tree, cells, fine, buckets))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, tree, cells, _, _ = shared.value
        for ids, x, c in _chunks(batches):
            out = []
            for cell, at in route(tree, x):
                if len(at) > 1024 and len(at) * cells > 4 * len(x):  # more than its share: perhaps one point many times
                    order, kept = fold(x[at], ids[at], k + 1)
                    at = at[order[kept]]
                mine = c.take(pa.array(at)) if c is not None else pa.array([], pa.float64())
                out.append((cell, ids[at].tobytes(), x[at].tobytes(), None, np.asarray(mine.fill_null(0.0), float).tobytes(), np.asarray(mine.is_valid(), bool).tobytes()))
            if out:
                yield _packed(out)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, tree, _, fine, buckets = shared.value
        inside: list = [None] * buckets
        for leaf, at in route(fine, s):
            inside[leaf] = at
        for ids, x, _ in _chunks(batches):
            r = np.full(len(x), np.inf)
            if len(s) > k:  # the row at k, counted from 0, is one of k others at least
                for leaf, at in route(fine, x):
                    r[at] = upper(x[at], s[inside[leaf]], k)
                wide = ~np.isfinite(r)
                r[wide] = upper(x[wide], s, k)
            r = np.sqrt(r)
            out = [(cell, ids[at].tobytes(), x[at].tobytes(), r[at].tobytes(), b"", b"") for cell, at in route(tree, x, r)]
            if out:
                yield _packed(out)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a cell come before its queries, of which only a block is held."""
        at, rows, index, asked, held = None, [], None, [], 0

        def answer():
            nonlocal index, asked, held
            if asked and rows:
                if index is None:
                    index = [np.concatenate(c) for c in zip(*rows)]
                    index[1] = Cell(index[1].reshape(len(index[0]), -1), index[0], k)
                ids, cell, c, has = index
                q_ids, x, reach = (np.concatenate(c) for c in zip(*asked))
                q, o, d = cell.search(x.reshape(len(q_ids), -1), q_ids, reach)
                cols = [pa.array(q_ids[q]), pa.array(ids[o]), pa.array(d), *([pa.array(c[o], mask=~has[o])] if carry else [])]
                yield pa.RecordBatch.from_arrays(cols, schema.names)
            asked, held = [], 0

        for b in batches:
            cell_of, reach_of = b.column(0).to_pylist(), b.column(3)
            for i, cell in enumerate(cell_of):
                if cell != at:
                    yield from answer()
                    at, rows, index = cell, [], None
                get = lambda j, kind: np.frombuffer(b.column(j)[i].as_buffer(), kind)  # noqa: B023, E731 - used at once
                if reach_of[i].is_valid:
                    asked.append((get(1, np.int64), get(2, float), get(3, float)))
                    held += len(asked[-1][1])
                    if held > PACK:
                        yield from answer()
                else:
                    rows.append((get(1, np.int64), get(2, float), get(4, float), get(5, bool)))
        yield from answer()

    schema = T.StructType([T.StructField("q", T.LongType()), T.StructField("o", T.LongType()), T.StructField("d", T.DoubleType()), *([T.StructField(carry, T.DoubleType())] if carry else [])])
    both = rows.mapInArrow(pack, _PACKED).unionByName(asked.mapInArrow(ask, _PACKED))
    near = both.repartition("cell").sortWithinPartitions("cell", F.col("reach").isNotNull()).mapInArrow(meet, schema)
    return near.withColumn("rk", F.row_number().over(Window.partitionBy("q").orderBy("d", "o"))).where(F.col("rk") <= k)
