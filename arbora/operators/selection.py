"""Selection of parents and survivors from populations of any size; all objectives are minimised.

Neighbours in the order of an objective are found inside ranges of it and stitched at their ends, so no task sorts all
rows. Draws by weight are found by an equi-join on slices of the running weights. Only what the reader asks for (k rows,
or one front below a checked size) comes to one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbora.operators.objectives import _double, running_sums
from arbora.operators.pareto import BLOCK, ranks
from arbora.staging import stage


def neighbours(values: DataFrame, value: str, blocks: int = 256) -> DataFrame:
    """``values`` (one row per value) with the values before and after each, ``prev`` and ``next``, NULL at the ends."""
    cuts = sorted(set(values.approxQuantile(value, [i / blocks for i in range(1, blocks)], 0.001)))
    at = F.expr(f"size(filter(array({', '.join(map(_double, cuts))}), c -> `{value}` > c))") if cuts else F.lit(0)
    key = values.withColumn("__b", at)
    ends = key.groupBy("__b").agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    over = Window.orderBy("__b")  # at most `blocks` rows
    ends = ends.select("__b", F.lag("__hi").over(over).alias("__before"), F.lead("__lo").over(over).alias("__after"))
    w = Window.partitionBy("__b").orderBy(value)
    out = key.join(F.broadcast(ends), "__b")
    return out.withColumn("prev", F.coalesce(F.lag(value).over(w), "__before")).withColumn("next", F.coalesce(F.lead(value).over(w), "__after")).drop("__b", "__before", "__after")


def crowding(df: DataFrame, id: str, objectives: list[str]) -> DataFrame:
    """Crowding distance of the rows of one front: gaps to both neighbours in each objective, over its range.

    Rows of equal value stand in the order of their ids: inner ones have gap 0. Rows at either end of an objective are at
    infinite distance. An objective with one value only counts 0 between its ends. Rows delivered twice count once.
    """
    out, total = df.dropDuplicates([id, *objectives]), F.lit(0.0)
    for o in objectives:
        per = out.groupBy(o).agg(F.min(id).alias("__first"), F.max(id).alias("__last"))
        per = neighbours(per, o).join(F.broadcast(out.agg((F.max(o) - F.min(o)).alias("__range"))))  # one row
        out = out.join(per, o)
        low, high = F.when(F.col(id) == F.col("__first"), F.col("prev")).otherwise(F.col(o)), F.when(F.col(id) == F.col("__last"), F.col("next")).otherwise(F.col(o))
        gap = F.when(low.isNull() | high.isNull(), float("inf")).otherwise(F.coalesce((high - low) / F.nullif("__range", F.lit(0.0)), F.lit(0.0)))
        out = out.withColumn(f"__d_{o}", gap).drop("__first", "__last", "prev", "next", "__range")
        total = total + F.col(f"__d_{o}")
    return out.withColumn("crowding", total).select(*df.columns, "crowding")


def nsga2(df: DataFrame, id: str, objectives: list[str], k: int) -> DataFrame:
    """(id, front, crowding) of k survivors: whole fronts while they fit, the rest of the next by crowding distance, then
    id. ``crowding`` is within the row's own front. With fewer rows of finite objectives, all of them."""
    fronts = stage(ranks(df, id, objectives, rows=k), "fronts")
    sizes = running_sums(fronts.groupBy("front").agg(F.count("*").alias("n")), F.col("front"), {"before": F.col("n")})
    wanted = [r["front"] for r in sizes.where(F.col("before") < k).select("front").orderBy("front").collect()]  # at most k fronts
    rows = df.select(id, *objectives).dropDuplicates([id]).join(fronts.where(F.col("front") <= max(wanted, default=-1)), id)
    last = max(wanted, default=-1)
    inner = rows.where(F.col("front") < last).select(id, "front", F.lit(None).cast("double").alias("crowding"))
    edge = crowding(rows.where(F.col("front") == last), id, objectives)
    room = k - inner.count()
    return inner.unionByName(edge.orderBy(F.desc("crowding"), id).limit(room).select(id, "front", "crowding"))


def _wins(objectives: list[str], a: str, b: str) -> Column:
    """Whether the row with prefix a dominates the one with prefix b."""
    le, lt = F.lit(True), F.lit(False)
    for o in objectives:
        le, lt = le & (F.col(f"{a}.{o}") <= F.col(f"{b}.{o}")), lt | (F.col(f"{a}.{o}") < F.col(f"{b}.{o}"))
    return le & lt


def mating_weights(df: DataFrame, objectives: list[str], acceptable: list[float], goal: list[float], penalty: float = 1.0) -> DataFrame:
    """``df`` with ``weight``: 1 over 1 and the distances by which the objectives miss the acceptable values (times a
    penalty) and the goals. Infinite objectives give weight 0, which draws as the least positive weight."""
    miss = lambda bound: F.sqrt(sum((F.greatest(F.col(o) - v, F.lit(0.0)) ** 2 for o, v in zip(objectives, bound)), F.lit(0.0)))
    w = 1.0 / (1.0 + penalty * miss(acceptable) + miss(goal))
    return df.withColumn("weight", F.greatest(w, F.lit(float(np.finfo(float).eps))))


def draws(df: DataFrame, weight: str, n: int, seed: int) -> DataFrame:
    """n draws with replacement, in proportion to ``weight``: the drawn rows with the draw's number ``draw``.

    Draws are uniform points under the running weights. Rows and draws meet by slices of the whole weight, n in number, so
    a row with a third of all weight is found in a third of the slices and no task sees all draws.
    """
    total = df.agg(F.sum(weight)).first()[0] or 0.0
    if total <= 0:
        return df.limit(0).withColumn("draw", F.lit(0).cast("long"))
    order = stage(df.withColumn("__o", F.pmod(F.xxhash64(*df.columns, F.lit(seed)), F.lit(1 << 50)).cast("double")), "weighted")
    before = running_sums(order.groupBy("__o").agg(F.sum(weight).alias("__w")), F.col("__o"), {"__from": F.col("__w")}).select("__o", "__from")
    inner = Window.partitionBy("__o").orderBy(*df.columns).rowsBetween(Window.unboundedPreceding, -1)
    rows = order.join(before, "__o").withColumn("__from", F.col("__from") + F.coalesce(F.sum(weight).over(inner), F.lit(0.0))).withColumn("__till", F.col("__from") + F.col(weight))
    slice_ = lambda c: F.least(F.lit(n - 1), F.floor(c / total * n)).cast("long")
    rows = rows.withColumn("__s", F.explode(F.sequence(slice_(F.col("__from")), slice_(F.col("__till")))))
    at = df.sparkSession.range(n).select(F.col("id").alias("draw"), ((F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 50)) + 0.5) / float(1 << 50) * total).alias("__at"))
    at = at.withColumn("__s", slice_(F.col("__at")))
    return at.join(rows, "__s").where((F.col("__at") >= F.col("__from")) & (F.col("__at") < F.col("__till"))).select(*df.columns, "draw")


def weighted_tournament(df: DataFrame, id: str, objectives: list[str], k: int, acceptable: list[float], goal: list[float], penalty: float = 1.0, seed: int = 7) -> DataFrame:
    """(id, place) of k winners of pairings among rows drawn by :func:`mating_weights`.

    Draws come in groups of four different rows, each group giving two pairings; a dominating row wins, else the one of
    greater crowding distance, else a coin. Rows with NULL objectives are not drawn. k is rounded up to a multiple of two.
    """
    pop = df.select(id, *objectives).dropna().dropDuplicates([id])
    pop = stage(mating_weights(crowding(pop, id, objectives), objectives, acceptable, goal, penalty), "population")
    groups, tries = max(1, -(-k // 2)), 16
    # Draws with repeats left out are draws without replacement; sixteen give four different rows unless few have all weight.
    drawn = draws(pop, "weight", groups * tries, seed).select(F.floor(F.col("draw") / tries).alias("g"), "draw", F.struct(id, *objectives, "crowding").alias("r"))
    once = drawn.groupBy("g", F.col(f"r.{id}")).agg(F.min(F.struct("draw", "r")).alias("d"))
    four = once.groupBy("g").agg(F.slice(F.array_sort(F.collect_list("d")), 1, 4).alias("four"))
    pair = four.select("g", F.posexplode(F.array(*[F.struct(F.element_at(F.col("four.r"), F.least(F.lit(i), F.size("four"))).alias("a"), F.element_at(F.col("four.r"), F.least(F.lit(i + 1), F.size("four"))).alias("b")) for i in (1, 3)])).alias("p", "x")).select("g", "p", "x.a", "x.b")
    first = F.when(_wins(objectives, "a", "b"), True).when(_wins(objectives, "b", "a"), False).when(F.col("a.crowding") != F.col("b.crowding"), F.col("a.crowding") > F.col("b.crowding")).otherwise(F.pmod(F.xxhash64("g", "p", F.lit(seed)), F.lit(2)) == 0)
    return pair.select(F.when(first, F.col(f"a.{id}")).otherwise(F.col(f"b.{id}")).alias(id), (F.col("g") * 2 + F.col("p")).alias("place")).where(F.col("place") < k)


def spread_apart(points: np.ndarray, k: int) -> np.ndarray:
    """Indices of k points whose least distance from each other is as great as a greedy choice finds: the greatest of all
    distances at which taking every point that far from those taken leaves k of them."""
    n = len(points)
    if k <= 0 or k > n:
        return np.zeros(0, int)
    d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(axis=2))

    def taken(least: float) -> np.ndarray:
        free, out = np.ones(n, bool), []
        for i in range(n):
            if free[i]:
                out.append(i)
                free &= d[i] > least
        return np.array(out)

    levels = np.unique(np.concatenate([[0.0], d[np.triu_indices(n, 1)]]))
    lo, hi, best = 0, len(levels) - 1, np.arange(n)
    while lo <= hi:
        mid = (lo + hi) // 2
        if len(found := taken(levels[mid])) >= k:
            best, lo = found, mid + 1
        else:
            hi = mid - 1
    return best[:k]


#: Most rows of a front in which points are spread apart (all their distances stand in one task); beyond it, and for 500
#: wanted rows or more, crowding distance decides.
MOST_SPREAD, MOST_WANTED = 4000, 500


def max_distance_nsga(df: DataFrame, id: str, objectives: list[str], k: int) -> DataFrame:
    """(id, front) of k survivors: whole fronts while they fit; of the next, points as far from each other as can be."""
    survivors = stage(nsga2(df, id, objectives, k), "survivors")
    last = survivors.agg(F.max("front")).first()[0]
    if last is None:
        return survivors.select(id, "front")
    room = survivors.where(F.col("front") == last).count()
    fronts = ranks(df, id, objectives, rows=k).where(F.col("front") == last)
    edge = stage(df.select(id, *objectives).dropDuplicates([id]).join(fronts, id), "edge")
    if room >= MOST_WANTED or edge.count() > MOST_SPREAD:
        return survivors.select(id, "front")

    def far(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [b for b in batches if len(b)]
        if held:
            pdf = pd.concat(held).sort_values(id, kind="stable")
            kept = pdf.iloc[spread_apart(pdf[objectives].to_numpy(float), room)]
            yield kept[[id, "front"]]

    chosen = edge.coalesce(1).mapInPandas(far, edge.select(id, "front").schema)
    return survivors.where(F.col("front") < last).select(id, "front").unionByName(chosen)


def near_pairs(df: DataFrame, id: str, objectives: list[str], d: float) -> DataFrame:
    """(a, b, dist, n_a, n_b), a < b: the edges of the graph that joins rows at most ``d`` apart (Euclidean), between
    points. A point stands for all rows with its objectives, n of them, by their least id: rows of one point are joined to
    each other and to all rows of the point's neighbours, which is not spelt out. Points meet in a grid of cells of length
    d, each with the cells around it; NULL and non-finite rows have no edges."""
    ok = df.select(id, *objectives)
    for o in objectives:
        ok = ok.where(F.abs(F.col(o)) < float("inf"))
    ok = ok.groupBy(*objectives).agg(F.min(id).alias(id), F.count("*").alias("__n"))
    width = d if d > 0 else 1.0
    cells = [F.floor(F.col(o) / width).cast("long") for o in objectives]
    left = ok.select(F.col(id).alias("a"), F.col("__n").alias("n_a"), *[F.col(o).alias(f"a_{o}") for o in objectives], *[c.alias(f"g{i}") for i, c in enumerate(cells)])
    right = ok.select(F.col(id).alias("b"), F.col("__n").alias("n_b"), *[F.col(o).alias(f"b_{o}") for o in objectives], *[F.explode(F.array(*[c + s for s in (-1, 0, 1)])).alias(f"g{i}") if i == 0 else c.alias(f"c{i}") for i, c in enumerate(cells)])
    for i in range(1, len(objectives)):
        right = right.withColumn(f"g{i}", F.explode(F.array(*[F.col(f"c{i}") + s for s in (-1, 0, 1)]))).drop(f"c{i}")
    dist = F.sqrt(sum(((F.col(f"a_{o}") - F.col(f"b_{o}")) ** 2 for o in objectives), F.lit(0.0)))
    return left.join(right, [f"g{i}" for i in range(len(objectives))]).where(F.col("a") < F.col("b")).select("a", "b", dist.alias("dist"), "n_a", "n_b").where(F.col("dist") <= d)


def least_distance(df: DataFrame, id: str, objectives: list[str], nonzero: bool = False) -> DataFrame:
    """(distance,): the least Euclidean distance of two rows, or of two rows that are not equal; 0 if there are none.

    Neighbours in the order of the first objective bound it from above; the grid of that bound holds the true one.
    """
    ok = df.select(id, *objectives).dropDuplicates([id])
    for o in objectives:
        ok = ok.where(F.abs(F.col(o)) < float("inf"))
    points = stage(ok.groupBy(*objectives).agg(F.count("*").alias("n"), F.min(id).alias("id")), "points")
    top = points.agg(F.max("n"), F.count("*")).first()
    spark = df.sparkSession
    if (not nonzero and (top[0] or 0) > 1) or top[1] < 2:
        return spark.range(1).select(F.lit(0.0).alias("distance"))
    one = objectives[0]
    per = points.groupBy(one).agg(*[F.min(o).alias(f"n_{o}") for o in objectives[1:]], F.max(objectives[-1]).alias("__m"), F.count("*").alias("__k"))
    steps = neighbours(per, one)
    rest = points.join(steps.select(one, "next"), one)
    upper = rest.join(per.select(F.col(one).alias("next"), *[f"n_{o}" for o in objectives[1:]]), "next").agg(F.min(F.sqrt((F.col("next") - F.col(one)) ** 2 + sum(((F.col(o) - F.col(f"n_{o}")) ** 2 for o in objectives[1:]), F.lit(0.0))))).first()[0]
    w = Window.partitionBy(one).orderBy(*objectives[1:])
    same = points.where(F.lit(len(objectives) > 1)).withColumn("__d", F.sqrt(sum(((F.col(o) - F.lag(o).over(w)) ** 2 for o in objectives[1:]), F.lit(0.0)))).agg(F.min("__d")).first()[0] if len(objectives) > 1 else None
    bound = min(v for v in (upper, same) if v is not None)
    return near_pairs(points, "id", objectives, bound * (1 + 1e-12)).agg(F.coalesce(F.min("dist"), F.lit(bound)).alias("distance"))


def truncated_normals(means: np.ndarray, cov: np.ndarray, trials: int, low: np.ndarray, high: np.ndarray, seed: int) -> np.ndarray:
    """Gibbs samples (trials, n) of a normal distribution cut to a box; the first is the means."""
    rng, unit = np.random.default_rng(seed), NormalDist()
    h = np.linalg.inv(cov)
    dev = 1 / np.sqrt(np.diag(h))
    out = np.empty((trials, len(means)))
    x = np.clip(np.asarray(means, float), low, high)
    for t in range(trials):
        if t:
            for i in range(len(x)):
                mu = means[i] - dev[i] ** 2 * (h[i] @ (x - means) - h[i, i] * (x[i] - means[i]))
                a, b = unit.cdf((low[i] - mu) / dev[i]), unit.cdf((high[i] - mu) / dev[i])
                u = a + rng.random() * (b - a)
                x[i] = min(high[i], max(low[i], mu + dev[i] * unit.inv_cdf(u))) if 0 < u < 1 else (low[i] if u <= 0 else high[i])
        out[t] = x
    return out


def shrunk_covariance(x: np.ndarray) -> np.ndarray:
    """Ledoit-Wolf covariance of observations (rows): the sample covariance drawn towards a multiple of the identity."""
    n, p = x.shape
    c = x - x.mean(axis=0)
    s = c.T @ c / n
    mu = np.trace(s) / p
    apart = ((s - mu * np.eye(p)) ** 2).sum() / p
    noise = ((c**2).T @ (c**2) / n - s**2).sum() / (n * p)
    share = 0.0 if apart == 0 else min(1.0, noise / apart)
    return (1 - share) * s + share * mu * np.eye(p)


#: Most programs of a population whose joint distribution is sampled: it has (programs x objectives) squared entries.
MOST_FUZZY = 500


def fuzzy_shares(df: DataFrame, id: str, cases: list[str], low: list[float], high: list[float], trials: int = 1000, chains: int = 8, seed: int = 7) -> DataFrame:
    """(id, share): how often each program is on the front when its objectives are drawn from what its test cases allow.

    ``cases`` are array columns of results per test case, one per objective, cut into as many bins as the shortest has.
    Chains of samples run in tasks of their own. A population above ``MOST_FUZZY`` programs is an error.
    """
    from arbora.operators.pareto import skyline

    rows = df.select(id, *cases).dropDuplicates([id]).orderBy(id).limit(MOST_FUZZY + 1).toPandas()
    if len(rows) > MOST_FUZZY:
        raise ValueError(f"more than {MOST_FUZZY} programs")
    spark, field = df.sparkSession, df.schema[id]
    if not len(rows):
        return spark.createDataFrame([], f"`{id}` {field.dataType.simpleString()}, share double")
    mats = [np.stack(rows[c].map(lambda v: np.asarray(v, float))) for c in cases]
    bins = min(m.shape[1] for m in mats)
    pad = [np.pad(m, ((0, 0), (0, -m.shape[1] % bins)), constant_values=np.nan).reshape(len(m), -1, bins) for m in mats]
    seen = np.stack([np.nanmean(m, axis=1) for m in pad], axis=1).reshape(-1, bins)  # program by program, objective by objective
    means, cov = seen.mean(axis=1), shrunk_covariance(seen.T / math.sqrt(bins)) + 1e-12 * np.eye(len(seen))
    lo, hi, m = np.tile(low, len(rows)).astype(float), np.tile(high, len(rows)).astype(float), len(cases)
    shared = spark.sparkContext.broadcast((means, cov, lo, hi))

    def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for c in pdf["id"]:
                hits = np.zeros(len(shared.value[0]) // m)
                for s in truncated_normals(*shared.value[:2], max(1, trials // chains), *shared.value[2:], seed + int(c)):
                    hits += skyline(s.reshape(-1, m))
                yield pd.DataFrame({"at": np.arange(len(hits)), "n": hits})

    found = spark.range(chains).repartition(chains).mapInPandas(chain, "at long, n double").groupBy("at").agg(F.sum("n").alias("n"))
    names = spark.createDataFrame(rows[[id]].reset_index(names="at"))
    total = found.agg(F.sum("n")).first()[0]
    return names.join(found, "at").select(F.col(id).cast(field.dataType).alias(id), (F.col("n") / total).alias("share"))


def fuzzy_select(df: DataFrame, id: str, cases: list[str], low: list[float], high: list[float], k: int, trials: int = 1000, seed: int = 7) -> DataFrame:
    """k programs drawn with replacement by their :func:`fuzzy_shares`: (id, share, draw)."""
    return draws(stage(fuzzy_shares(df, id, cases, low, high, trials, seed=seed), "shares"), "share", k, seed)


def region_scaled(df: DataFrame, objectives: list[str], acceptable: list[float], known: list[float], crowd: str = "crowding", alpha: float = 0.5) -> DataFrame:
    """``df`` with its crowding distance scaled by the place of its objectives between what is acceptable (0 up to there) and
    what is known to be reached (1 from there on): times (1 + alpha) / (alpha + length of the vector of places)."""
    place = lambda o, lo, hi: F.when(F.col(o) >= hi, 1.0).when(F.col(o) > lo, (F.col(o) - lo) / (hi - lo)).otherwise(0.0)
    length = F.sqrt(sum((place(o, lo, hi) ** 2 for o, lo, hi in zip(objectives, acceptable, known)), F.lit(0.0)))
    return df.withColumn(crowd, F.col(crowd) * (1 + alpha) / (alpha + length))


def tier_adjusted(df: DataFrame, objectives: list[str], tiers: list[str], offset: float = 5e9) -> DataFrame:
    """Objectives with an offset for every tier (a boolean column) a row was not evaluated on."""
    missing = sum((F.when(F.coalesce(F.col(t), F.lit(False)), 0).otherwise(1) for t in tiers), F.lit(0))
    return df.select(*[(F.col(c) + offset * missing).alias(c) if c in objectives else F.col(c) for c in df.columns])


def gene_pool(df: DataFrame, id: str, objectives: list[str], ranges: list[tuple[float, float]], n: int = 100) -> DataFrame:
    """``df`` rows that lie in the range of more than one objective (kind 'well_rounded') or of exactly one
    ('specialist'), the first n of each by the number of rows that dominate them, then id. Dominators are counted only
    for rows in some range."""
    inside = sum((F.when(F.col(o).between(lo, hi), 1).otherwise(0) for o, (lo, hi) in zip(objectives, ranges)), F.lit(0))
    fronts = ranks(df, id, objectives)
    kinds = df.dropDuplicates([id]).withColumn("n_in_range", inside).where("n_in_range > 0").join(fronts, id)
    kinds = kinds.withColumn("kind", F.when(F.col("n_in_range") > 1, "well_rounded").otherwise("specialist"))
    w = Window.partitionBy("kind").orderBy("front", id)
    return kinds.withColumn("__rk", F.row_number().over(w)).where(F.col("__rk") <= n).drop("__rk")


def similar(df: DataFrame, id: str, objectives: list[str], percent: float = 0.01) -> DataFrame:
    """(id, first): for each row the least id with the same objectives up to ``percent``/100 of their value, itself if
    there is none: phenotypes that are equal or nearly so. Equal rows are one point, which meets others in cells of the
    logarithm of each objective, with the cells around them."""
    step = math.log1p(percent / 100)
    cell = lambda o: F.when(F.col(o) == 0, F.lit(0)).otherwise(F.signum(o) * (F.floor(F.log(F.abs(F.col(o))) / step) + (1 << 40))).cast("long")
    rows = df.select(id, *objectives).dropna()
    ok = rows.groupBy(*objectives).agg(F.min(id).alias(id))
    left = ok.select(F.col(id).alias("__a"), *[F.col(o).alias(f"a_{o}") for o in objectives], *[cell(o).alias(f"g{i}") for i, o in enumerate(objectives)])
    right = ok.select(F.col(id).alias("__b"), *[F.col(o).alias(f"b_{o}") for o in objectives])
    for i, o in enumerate(objectives):
        c = F.when(F.col(f"b_{o}") == 0, F.lit(0)).otherwise(F.signum(f"b_{o}") * (F.floor(F.log(F.abs(F.col(f"b_{o}"))) / step) + (1 << 40))).cast("long")
        right = right.withColumn(f"g{i}", F.explode(F.array(c - 1, c, c + 1)))
    near = F.lit(True)
    for o in objectives:
        a, b = F.col(f"a_{o}"), F.col(f"b_{o}")
        near = near & ((a == b) | (F.abs(a - b) < F.abs(a) * (percent / 100)))
    # A point's neighbours by their least ids; each of its rows has the first of them, or of its own point.
    hit = left.join(right, [f"g{i}" for i in range(len(objectives))]).where(near)
    first = hit.groupBy(*[F.col(f"a_{o}").alias(o) for o in objectives]).agg(F.min("__b").alias("first"))
    return rows.join(first, objectives, "left").groupBy(id).agg(F.least(F.min("first"), F.col(id)).alias("first"))
