"""Multi-objective selection: fronts, hypervolumes, crowding, novelty and population statistics, all minimised."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arbora.operators.nearest import nearest
from arbora.staging import stage

#: Candidates a task compares with each other.
BLOCK = 20_000


def dominated(points: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Which points some row of ``by`` dominates: nowhere greater and somewhere less."""
    out = np.zeros(len(points), bool)
    for lo in range(0, len(by), 256):
        b = by[lo : lo + 256]
        le = (b[None] <= points[:, None]).all(axis=2)
        lt = (b[None] < points[:, None]).any(axis=2)
        out |= (le & lt).any(axis=1)
    return out


def skyline(p: np.ndarray) -> np.ndarray:
    """Mask of the points no other point dominates; equal points all stay."""
    order = np.lexsort(p.T[::-1])
    keep: list[int] = []
    front = np.zeros((0, p.shape[1]))
    for lo in range(0, len(p), 512):
        chunk = order[lo : lo + 512]
        left = chunk[~dominated(p[chunk], front)] if len(front) else chunk
        left = left[~dominated(p[left], p[left])]
        keep.extend(left)
        front = p[keep]
    mask = np.zeros(len(p), bool)
    mask[keep] = True
    return mask


def pareto_front(df: DataFrame, objectives: list[str], by: list[str] | None = None, keep_equal: bool = True, id: str | None = None) -> DataFrame:
    """Rows whose objectives no other row (of its group) dominates.

    Rows with a NULL, NaN or infinite objective are failures and never part of a front. Blocks are reduced where they
    lie, then merged in fewer and fewer blocks; a block holds at most ``BLOCK`` rows unless they all are part of the
    front. ``keep_equal`` false keeps of equal points the one with the least ``id``.
    """
    by = by or []
    ok = df
    for o in objectives:
        ok = ok.where(F.col(o).isNotNull() & ~F.isnan(F.col(o).cast("double")) & (F.abs(F.col(o).cast("double")) != float("inf")))
    if not keep_equal:
        w = Window.partitionBy(*by, *objectives).orderBy(id)
        ok = ok.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def cut(pdf: pd.DataFrame) -> pd.DataFrame:
            if not by:
                return pdf[skyline(pdf[objectives].to_numpy(float))]
            parts = [g[skyline(g[objectives].to_numpy(float))] for _, g in pdf.groupby(by, dropna=False)]
            return pd.concat(parts) if parts else pdf

        held = None
        for pdf in batches:
            held = cut(pdf if held is None else pd.concat([held, pdf]))
            if len(held) > BLOCK:
                yield held
                held = None
        if held is not None and len(held):
            yield held

    front, before = stage(ok.mapInPandas(reduce, ok.schema), "front"), None
    while True:
        n = front.count()
        blocks = max(1, -(-n // BLOCK))
        keys = [F.col(c) for c in by]
        merged = front.repartition(blocks, *keys) if by and blocks > 1 else front.repartition(blocks)
        front = stage(merged.mapInPandas(reduce, ok.schema), "front")
        if blocks == 1 or n == before:
            break
        before = n
    if blocks > 1:  # a front larger than a block: test it against itself, block by block
        front = _against_all(front, objectives, by, blocks)
    return front


def _against_all(front: DataFrame, objectives: list[str], by: list[str], blocks: int) -> DataFrame:
    """Each block of a large front against every block that can dominate it.

    Blocks are ranges of the sum of the objectives: a row is dominated only by rows of a lesser sum, so block i meets the
    blocks up to i. Pairs of blocks meet by an equi-join of their numbers, two blocks in a task at a time.
    """
    total = sum((F.col(o).cast("double") for o in objectives), F.lit(0.0))
    marked = stage(front.withColumn("__i", F.monotonically_increasing_id()).withColumn("__s", total), "blocks")
    cuts = sorted(set(marked.approxQuantile("__s", [i / blocks for i in range(1, blocks)], 0.001)))
    at = F.size(F.filter(F.lit(cuts).cast("array<double>"), lambda c: F.col("__s") > c)) if cuts else F.lit(0)
    cut = marked.withColumn("__blk", at)
    points = cut.select("__i", *by, *objectives, F.col("__blk").alias("__p"), F.explode(F.sequence(F.lit(0), F.col("__blk"))).alias("__q"))
    others = cut.select(*by, *objectives, F.explode(F.sequence(F.col("__blk"), F.lit(len(cuts)))).alias("__p"), F.col("__blk").alias("__q"))

    def lost(mine: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
        if not by:
            return mine.loc[dominated(mine[objectives].to_numpy(float), other[objectives].to_numpy(float)), ["__i"]]
        groups = dict(list(other.groupby(by, dropna=False)))
        out = [g.loc[dominated(g[objectives].to_numpy(float), groups[k][objectives].to_numpy(float)), ["__i"]] for k, g in mine.groupby(by, dropna=False) if k in groups]
        return pd.concat(out) if out else mine[["__i"]][:0]

    hits = points.groupBy("__p", "__q").cogroup(others.groupBy("__p", "__q")).applyInPandas(lost, "__i long").distinct()
    return marked.join(hits, "__i", "left_anti").drop("__i", "__s")


def front_2d(df: DataFrame, f1: str, f2: str, by: list[str] | None = None) -> DataFrame:
    """Two-objective front by windows: a row stays if no row before it in f1 has a lesser or equal f2."""
    by = by or []
    ok = df.where(F.abs(F.col(f1)) < float("inf")).where(F.abs(F.col(f2)) < float("inf"))
    low = ok.groupBy(*by, f1).agg(F.min(f2).alias("__m"))
    w = Window.partitionBy(*by).orderBy(f1).rowsBetween(Window.unboundedPreceding, -1)
    best = low.withColumn("__p", F.min("__m").over(w)).where(F.col("__p").isNull() | (F.col("__m") < F.col("__p")))
    return ok.join(best.select(*by, f1, F.col("__m").alias(f2)), [*by, f1, f2], "left_semi")


def hypervolume(df: DataFrame, objectives: list[str], reference: list[float], by: list[str] | None = None) -> DataFrame:
    """Volume the fronts dominate below a reference point, per group; only fronts come to a task."""
    by = by or []
    front = pareto_front(df, objectives, by)
    ref = np.asarray(reference, float)

    def volume(p: np.ndarray) -> float:
        p = p[(p < ref[: p.shape[1]]).all(axis=1)]
        if not len(p):
            return 0.0
        if p.shape[1] == 1:
            return float(ref[0] - p.min())
        last = p.shape[1] - 1
        p = p[np.argsort(p[:, last])]
        total = 0.0
        for i in range(len(p)):
            top = p[i + 1, last] if i + 1 < len(p) else ref[last]
            if top > p[i, last]:
                total += (top - p[i, last]) * volume_sub(p[: i + 1, :last])
        return total

    def volume_sub(q: np.ndarray) -> float:
        return volume(q[skyline(q)] if q.shape[1] > 1 else q)

    keyed = front.select(*by, *objectives) if by else front.select(F.lit(0).alias("__all"), *objectives)
    keys = by or ["__all"]
    schema = T.StructType([*[keyed.schema[k] for k in keys], T.StructField("hypervolume", T.DoubleType())])

    def per_group(key, pdf):
        return pd.DataFrame([[*key, volume(pdf[objectives].drop_duplicates().to_numpy(float))]], columns=[*keys, "hypervolume"])

    out = keyed.groupBy(*keys).applyInPandas(per_group, schema)
    return out if by else out.drop("__all")


def staircase_area(df: DataFrame, f1: str, f2: str, by: list[str]) -> DataFrame:
    """Area under the staircase of a front in the unit square: corners (0, 1) and (1, 0) close it."""
    pts = front_2d(df, f1, f2, by).select(*by, F.col(f1).alias("a"), F.col(f2).alias("b")).distinct()
    keys = df.select(*by).distinct()
    ends = keys.select(*by, F.explode(F.array(F.struct(F.lit(0.0).alias("a"), F.lit(1.0).alias("b")), F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b")))).alias("e")).select(*by, "e.a", "e.b")
    w = Window.partitionBy(*by).orderBy("a", F.desc("b"))
    return pts.unionByName(ends).withColumn("nx", F.lead("a").over(w)).groupBy(*by).agg(F.sum(F.abs(F.col("nx") - F.col("a")) * F.col("b")).alias("auc"))


def ranks(df: DataFrame, id: str, objectives: list[str], most: int | None = None, rows: int | None = None) -> DataFrame:
    """(id, front) of all rows whose objectives are finite, or of the first ``most`` fronts, or of the first fronts that
    hold at least ``rows`` rows together (at least these; with two objectives all fronts come).

    With two objectives the distinct points pass one task in their order, spilled where they don't fit, which holds the
    least second objective of each front. With another number each front is taken off before the next is found.
    """
    rest = df
    for o in objectives:
        rest = rest.where(F.col(o).isNotNull() & ~F.isnan(F.col(o).cast("double")) & (F.abs(F.col(o).cast("double")) != float("inf")))
    if len(objectives) == 2:
        rest = stage(rest.select(id, *objectives), "rest")
        points = rest.select(*objectives).distinct().repartition(1).sortWithinPartitions(*objectives)
        fields = [points.schema[o] for o in objectives]
        fronts = points.mapInArrow(_fronts_2d, T.StructType([*fields, T.StructField("front", T.IntegerType())]))
        found = rest.join(fronts if most is None else fronts.where(F.col("front") < most), objectives)
        return found.select(id, "front")
    found, k, n = None, 0, 0
    while most is None or k < most:
        f = pareto_front(rest, objectives).select(id, F.lit(k).alias("front"))
        found = f if found is None else found.unionByName(f)
        rest = stage(rest.join(f.select(id), id, "left_anti"), "rest")
        k += 1
        if rows is not None and (n := n + f.count()) >= rows or rest.isEmpty():
            break
    return found


def _fronts_2d(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The front of distinct points in ascending order: one after the last front with a point that dominates."""
    least = []
    for b in batches:
        out = np.empty(len(b), np.int32)
        for i, y in enumerate(b.column(1).to_pylist()):
            out[i] = k = bisect_right(least, y)
            if k == len(least):
                least.append(y)
            else:
                least[k] = y
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out)], names=[*b.schema.names, "front"])


def z_score(df: DataFrame, objectives: list[str]) -> DataFrame:
    """Mean squared Mahalanobis distance to the mean, sample covariance; with up to two rows 0."""
    aggs = [F.count("*").alias("n"), *[F.avg(o).alias(f"m{i}") for i, o in enumerate(objectives)]]
    aggs += [F.covar_samp(a, b).alias(f"c{i}_{j}") for i, a in enumerate(objectives) for j, b in enumerate(objectives)]
    s = df.agg(*aggs).first()
    k = len(objectives)
    if (s["n"] or 0) <= 2:
        return df.sparkSession.range(1).select(F.lit(0.0).alias("z_score"))
    inv = np.linalg.pinv(np.array([[s[f"c{i}_{j}"] for j in range(k)] for i in range(k)]))
    q = F.lit(0.0)
    for i, a in enumerate(objectives):
        for j, b in enumerate(objectives):
            q = q + (F.col(a) - s[f"m{i}"]) * (F.col(b) - s[f"m{j}"]) * float(inv[i, j])
    return df.agg(F.avg(q).alias("z_score"))


def lexicase(df: DataFrame, objectives: list[str], id: str, seed: int, slack: float = 0.0) -> DataFrame:
    """Rows left when filtered by one objective after the other, in an order shuffled by ``seed``."""
    order = list(np.random.default_rng(seed).permutation(objectives))
    left = df
    for o in order:
        left = left.join(F.broadcast(left.agg(F.min(o).alias("__best")))).where(F.col(o) <= F.col("__best") + slack).drop("__best")
    return left


def tournament(df: DataFrame, id: str, objectives: list[str], k: int, seed: int) -> DataFrame:
    """k winners of pairings: rows are dealt into pairs by a seeded shuffle; the dominating row of a pair wins, else the
    one dealt first. Pairs meet by an equi-join on the pair's number."""
    dealt = df.withColumn("__h", F.xxhash64(id, F.lit(seed))).orderBy("__h").limit(2 * k)
    numbered = stage(dealt.withColumn("__n", F.row_number().over(Window.orderBy("__h")) - 1), "dealt")  # 2 k rows
    a = numbered.where("__n % 2 = 0").withColumn("__p", F.floor(F.col("__n") / 2))
    b = numbered.where("__n % 2 = 1").select(F.floor(F.col("__n") / 2).alias("__p"), F.col(id).alias("__id2"), *[F.col(o).alias(f"__2{o}") for o in objectives])
    wins, less = F.lit(True), F.lit(False)
    for o in objectives:
        wins, less = wins & (F.col(f"__2{o}") <= F.col(o)), less | (F.col(f"__2{o}") < F.col(o))
    return a.join(b, "__p", "left").select(F.when(wins & less, F.col("__id2")).otherwise(F.col(id)).alias(id))


def novelty(df: DataFrame, id: str, vector: str, k: int, queries: DataFrame | None = None, carry: str | None = None) -> DataFrame:
    """(q, o, d, rk) and ``carry`` of o: the k nearest other rows of each query row, whose mean distance is its novelty."""
    return nearest(df, id, vector, k, queries if queries is not None else df, carry)
