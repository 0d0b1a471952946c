"""Objective functions: aggregates over predictions ``p`` and truths ``t``, all minimised.

Each objective is one aggregate expression, so any number of them is computed in a single pass with partial sums
before the shuffle. Nothing to aggregate gives NULL unless the objective defines a value.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbora.staging import stage

_VALID = "NOT ((p < 0) <> (t = -1))"  # sign of the prediction agrees with the 'no value' mark of the truth
_ACTIVITY = "avg(CASE WHEN {is} THEN CASE WHEN isnan(p) OR NOT ({ok}) THEN 1e0 ELSE 0e0 END END)"
_ALARM = "avg(CASE WHEN NOT ({is}) THEN CASE WHEN {ok} THEN 1e0 ELSE 0e0 END END)"

#: name -> aggregate over p and t; valid in Spark SQL and in the SQL check alike.
OBJECTIVES = {
    "false_positive": "count_if(t = 0 AND p <> 0)",
    "false_negative": "count_if(t = 1 AND p <> 1)",
    "false_positive_multi": "count_if(t = 0 AND p <> 0)",
    "false_negative_multi": "count_if(t = 1 AND p <> 1)",
    "false_positive_rate": "coalesce(count_if(t = 0 AND p <> 0) / nullif(CAST(count(*) AS DOUBLE), 0), 0.0)",
    "false_negative_rate": "coalesce(count_if(t = 1 AND p <> 1) / nullif(CAST(count(*) AS DOUBLE), 0), 0.0)",
    "f1_score_min": "1 - 2.0 * count_if(t = 1 AND p = 1) / nullif(2.0 * count_if(t = 1 AND p = 1) + count_if(t <> 1 AND p = 1) + count_if(t = 1 AND p <> 1), 0)",
    "precision_min": "1 - count_if(t = 1 AND p = 1) / nullif(CAST(count_if(p = 1) AS DOUBLE), 0)",
    "recall_min": "1 - count_if(t = 1 AND p = 1) / nullif(CAST(count_if(t = 1) AS DOUBLE), 0)",
    "accuracy_score": "1 - avg(CASE WHEN p = t THEN 1e0 ELSE 0e0 END)",
    "accuracy_score_multi": "CAST(count_if((t = 0 AND p <> 0) OR (t = 1 AND p <> 1)) AS DOUBLE) / count(*)",
    "objective0EvalFunction": "sqrt(avg((p - t) * (p - t)))",
    "objective1EvalFunction": "coalesce(avg(CASE WHEN p > t THEN p - t END), 0.0)",
    "objective2EvalFunction": "coalesce(avg(CASE WHEN p < t THEN t - p END), 0.0)",
    "objective4EvalFunction": "1 - avg(CASE WHEN abs(t - p) <= sqrt(0.25 + (0.013 * t) * (0.013 * t)) - 0.4 THEN 1e0 ELSE 0e0 END)",
    "objective5EvalFunction": "abs(avg(abs(t - p) / nullif(t, 0)))",
    "objective6EvalFunction": f"abs(avg(CASE WHEN {_VALID} THEN abs(t - p) / nullif(t, 0) END))",
    "objective7EvalFunction": f"sqrt(avg(CASE WHEN {_VALID} THEN (p - t) * (p - t) END))",
    "objective8EvalFunction": f"coalesce(avg(CASE WHEN {_VALID} AND p > t THEN p - t END), 0.0)",
    "objective9EvalFunction": f"coalesce(avg(CASE WHEN {_VALID} AND p < t THEN t - p END), 0.0)",
    "objective10EvalFunction": "count_if(p < 0)",
    "objective11EvalFunction": "count_if(p >= 0 AND t = -1)",
    "objective12EvalFunction": "count_if(p < 0 AND t <> -1)",
    "class0AccuracyEvalFunction": "CASE WHEN count_if(t = 0 AND (p < 0 OR p > 2)) = 0 THEN 1.0 ELSE count_if(t = 0 AND (p < 0 OR p > 2)) / nullif(CAST(count_if(t = 0) AS DOUBLE), 0) END",
    "class4AccuracyEvalFunction": "CASE WHEN count_if(t = 4 AND (p <= 2 OR p > 4)) = 0 THEN 1.0 ELSE count_if(t = 4 AND (p <= 2 OR p > 4)) / nullif(CAST(count_if(t = 4) AS DOUBLE), 0) END",
    "drinking_error_rate": _ACTIVITY.format(**{"is": "t = 2", "ok": "p > 1.5 AND p <= 2.5"}),
    "drinking_false_alarm_rate": _ALARM.format(**{"is": "t = 2", "ok": "p > 1.5 AND p <= 2.5"}),
    "shaking_error_rate": _ACTIVITY.format(**{"is": "t = 9", "ok": "p > 8.5 AND p <= 9.5"}),
    "shaking_false_alarm_rate": _ALARM.format(**{"is": "t = 9", "ok": "p > 8.5 AND p <= 9.5"}),
    "scratching_error_rate": _ACTIVITY.format(**{"is": "t = 1", "ok": "p = 1"}),
    "scratching_false_alarm_rate": _ALARM.format(**{"is": "t = 1", "ok": "p = 1"}),
    "count_over_predictions": "avg(CASE WHEN p > t THEN 1e0 ELSE 0e0 END)",
    "count_under_predictions": "avg(CASE WHEN p < t THEN 1e0 ELSE 0e0 END)",
    "overall_standard_deviation": "stddev_pop(p - t)",
    "standard_deviation_over": "stddev_pop(CASE WHEN p > t THEN p - t END)",
    "standard_deviation_under": "stddev_pop(CASE WHEN p < t THEN p - t END)",
    "average_percent_error": "avg(abs(p - t) / nullif(t, 0))",
    "average_precent_error_over": "avg(CASE WHEN p > t THEN abs(p - t) / nullif(t, 0) END)",
    "average_precent_error_under": "avg(CASE WHEN p < t THEN abs(p - t) / nullif(t, 0) END)",
    "max_over_prediction_error": "max(CASE WHEN p > t THEN p - t END)",
    "max_under_prediction_error": "max(CASE WHEN p < t THEN t - p END)",
    "continuous_mse": "sum(sqrt((p - t) * (p - t)))",
    "continuous_bias": "count(*) * avg(abs(p - t))",
    "continuous_var": "count(*) * var_pop(p - t)",
    "weighted_binary_crossentropy": "avg(-(2.0 * (CASE WHEN t = 1 THEN 1 ELSE 0 END) * ln(least(greatest(p / 10, 0.0001), 0.9999)) + (CASE WHEN t = 1 THEN 0 ELSE 1 END) * ln(1 - least(greatest(p / 10, 0.0001), 0.9999))))",
}


def evaluate(df: DataFrame, names: list[str], by: list[str] | None = None) -> DataFrame:
    """Several objectives of predictions p and truths t in one pass, per group of ``by``."""
    aggs = [F.expr(OBJECTIVES[n]).cast("double").alias(n) for n in names]
    return df.groupBy(*(by or [])).agg(*aggs)


def fold_average(df: DataFrame, names: list[str], fold: str = "fold") -> DataFrame:
    """Objectives per fold, then their plain mean over the folds; a fold that failed (NULL) makes the mean infinite."""
    per = evaluate(df, names, [fold])
    return per.agg(*[F.when(F.count(n) < F.count("*"), F.lit(float("inf"))).otherwise(F.avg(n)).alias(n) for n in names])


def running_sums(df: DataFrame, order: Column, sums: dict[str, Column], blocks: int = 256, descending: bool = False) -> DataFrame:
    """Running sums over all rows in some order, without one task that sees all rows.

    Rows are cut into ranges of the order by approximate quantiles; sums of whole ranges come first, then a window
    inside each range. ``df`` should hold one row per order value. Adds columns named as the keys of ``sums``, of the
    rows before (exclusive).
    """
    key = df.withColumn("__o", -order.cast("double") if descending else order.cast("double"))
    cuts = sorted(set(key.approxQuantile("__o", [i / blocks for i in range(1, blocks)], 0.001)))
    at = F.lit(0)
    if cuts:
        at = F.aggregate(F.lit(cuts).cast("array<double>"), F.lit(0), lambda a, c: a + F.when(F.col("__o") > c, 1).otherwise(0)) if len(cuts) <= 16 else F.expr(f"size(filter(array({', '.join(map(_double, cuts))}), c -> __o > c))")
    key = key.withColumn("__b", at).select("*", *[c.alias(f"__v_{n}") for n, c in sums.items()])
    per = key.groupBy("__b").agg(*[F.sum(f"__v_{n}").alias(f"__t_{n}") for n in sums])
    ahead = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)  # at most `blocks` rows
    base = per.select("__b", *[F.coalesce(F.sum(f"__t_{n}").over(ahead), F.lit(0)).alias(f"__t_{n}") for n in sums])
    inside = Window.partitionBy("__b").orderBy("__o").rowsBetween(Window.unboundedPreceding, -1)
    out = key.join(F.broadcast(base), "__b")
    return out.select(*df.columns, *[(F.col(f"__t_{n}") + F.coalesce(F.sum(f"__v_{n}").over(inside), F.lit(0))).alias(n) for n in sums])


def _double(v: float) -> str:
    return f"double('{v!r}')"


def _by_score(df: DataFrame, score: str, label: str) -> DataFrame:
    return df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(score).alias("s")).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))


def macro_scores(df: DataFrame) -> DataFrame:
    """(precision_min, recall_min): 1 less the plain mean over all classes, predicted or true, of precision and of recall. A
    class never predicted has precision 0, one that is never true recall 0."""
    cells = df.where(F.col("p").isNotNull() & F.col("t").isNotNull()).groupBy("p", "t").agg(F.count("*").alias("n"))
    ends = cells.select(F.explode(F.array(F.struct(F.col("p").alias("c"), F.col("n").alias("said"), F.lit(0).cast("long").alias("was")), F.struct(F.col("t").alias("c"), F.lit(0).cast("long").alias("said"), F.col("n").alias("was")))).alias("x"), F.when(F.col("p") == F.col("t"), F.col("n")).otherwise(0).alias("hit"))
    per = ends.groupBy("x.c").agg(F.sum("x.said").alias("said"), F.sum("x.was").alias("was"), (F.sum("hit") / 2).alias("hit"))
    share = lambda d: F.coalesce(F.col("hit") / F.nullif(F.col(d), F.lit(0)), F.lit(0.0))
    return per.agg((1 - F.avg(share("said"))).alias("precision_min"), (1 - F.avg(share("was"))).alias("recall_min"))


def multilabel_error(df: DataFrame, p: str = "p", t: str = "t", fail_trivial: bool = False) -> DataFrame:
    """(value,): share of rows whose label vector (an array) is not wholly right. With ``fail_trivial`` it is infinite if all
    labels predicted are 1, or all are 0. No rows give NULL."""
    every = lambda v: F.count_if(~F.forall(p, lambda x: x == v)) == 0
    wrong = F.avg(F.when(F.col(p) == F.col(t), 0.0).otherwise(1.0))
    return df.agg((F.when((F.count("*") > 0) & (every(1) | every(0)), float("inf")).otherwise(wrong) if fail_trivial else wrong).alias("value"))


def program_measures(df: DataFrame, tree: str = "tree") -> DataFrame:
    """``df`` with the measures of its programs: ``height``, ``n_inputs`` (occurrences of ARG0), ``depth_breadth`` (a lower
    tree always beats a higher one, then a wider one a narrower), ``n_trees`` (the main one and each defined below it) and
    ``capped_elements``. NULL programs have NULL measures."""
    main = F.regexp_extract(tree, r"^\s*([^\n]*)", 1)
    steps = F.regexp_extract_all(main, F.lit("[()]"), F.lit(0))
    walk = F.aggregate(steps, F.struct(F.lit(0).alias("at"), F.lit(0).alias("top")), lambda a, c: F.struct((a["at"] + F.when(c == "(", 1).otherwise(-1)).alias("at"), F.greatest(a["top"], a["at"] + F.when(c == "(", 1).otherwise(-1)).alias("top")))
    out = df.withColumn("height", walk["top"]).withColumn("n_inputs", F.size(F.regexp_extract_all(main, F.lit("ARG0"), F.lit(0))))
    out = out.withColumn("n_inputs", F.when(F.col(tree).isNotNull(), F.col("n_inputs"))).withColumn("depth_breadth", F.col("height") - F.col("n_inputs") / (F.pow(F.lit(3.0), F.col("height")) + 1))
    out = out.withColumn("n_trees", F.when(F.col(tree).isNotNull(), 1 + F.size(F.regexp_extract_all(tree, F.lit(r"(?m)^\s*(?:adf|mod)_\d+\s*:"), F.lit(0)))))
    return out.withColumn("capped_elements", F.greatest(F.col("n_trees"), F.when(F.col(tree).isNotNull(), 1707)))


def roc_auc(df: DataFrame, score: str = "p", label: str = "t") -> DataFrame:
    """Area under the ROC curve; ties count half. NULL if a class is missing."""
    r = running_sums(_by_score(df, score, label), F.col("s"), {"below": F.col("neg")})
    total = r.agg(F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2.0)).alias("u"), F.sum("pos").alias("np"), F.sum("neg").alias("nn"))
    return total.select((F.col("u") / F.when(F.col("np") * F.col("nn") > 0, F.col("np") * F.col("nn"))).alias("roc_auc"))


def average_precision(df: DataFrame, score: str = "p", label: str = "t") -> DataFrame:
    """Mean precision over the positives, at the end of each group of equal scores."""
    r = running_sums(_by_score(df, score, label), F.col("s"), {"tp": F.col("pos"), "fp": F.col("neg")}, descending=True)
    hit = F.col("tp") + F.col("pos")
    seen = hit + F.col("fp") + F.col("neg")
    return r.agg((F.sum(F.col("pos") * hit / seen) / F.when(F.sum("pos") > 0, F.sum("pos"))).alias("average_precision"))


def confusion(df: DataFrame) -> DataFrame:
    return df.groupBy("t", "p").agg(F.count("*").alias("n"))


def cluster_errors(df: DataFrame) -> DataFrame:
    """Pair errors of two partitions, from their contingency table: pairs together in p but not in t, and the other way,
    each over all pairs."""
    pairs = lambda c: c * (c - 1) / 2.0
    cells = df.groupBy("p", "t").agg(F.count("*").alias("n"))
    both = cells.agg(F.sum(pairs(F.col("n"))).alias("b"), F.sum("n").alias("all"))
    in_p = cells.groupBy("p").agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).alias("in_p"))
    in_t = cells.groupBy("t").agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).alias("in_t"))
    one = both.join(in_p).join(in_t)  # one row each
    return one.select(((F.col("in_p") - F.col("b")) / pairs(F.col("all"))).alias("cluster_error1"), ((F.col("in_t") - F.col("b")) / pairs(F.col("all"))).alias("cluster_error2"))


def assignment(cost: list[list[float]]) -> float:
    """Least total cost of a one-to-one assignment (rows to columns), by successive shortest paths."""
    n, m = len(cost), len(cost[0]) if cost else 0
    if n > m:
        return assignment([list(c) for c in zip(*cost)])
    u, v, match = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        low, way, used = [float("inf")] * (m + 1), [0] * (m + 1), [False] * (m + 1)
        while match[j0]:
            used[j0] = True
            delta, j1 = float("inf"), 0
            for j in range(1, m + 1):
                if not used[j]:
                    c = cost[match[j0] - 1][j - 1] - u[match[j0]] - v[j]
                    if c < low[j]:
                        low[j], way[j] = c, j0
                    if low[j] < delta:
                        delta, j1 = low[j], j
            for j in range(m + 1):
                if used[j]:
                    u[match[j]] += delta
                    v[j] -= delta
                else:
                    low[j] -= delta
            j0 = j1
        while j0:
            match[j0], j0 = match[way[j0]], way[j0]
    return -v[0]


def partition_distance(df: DataFrame, most_clusters: int = 2000) -> float:
    """Fewest elements to take out so that partitions p and t agree: from the contingency table, which must be small. NULL
    labels are left out. More clusters than ``most_clusters`` in either partition are an error, found before the table is fetched."""
    df = df.where(F.col("p").isNotNull() & F.col("t").isNotNull())
    if max(df.agg(F.countDistinct("p"), F.countDistinct("t")).first()) > most_clusters:
        raise ValueError(f"more than {most_clusters} clusters")
    cells = df.groupBy("p", "t").agg(F.count("*").alias("n")).collect()
    rows, cols = sorted({c["p"] for c in cells}), sorted({c["t"] for c in cells})
    if not cells:
        return 0.0
    size = max(len(rows), len(cols))
    table = [[0.0] * size for _ in range(size)]
    row, col = {p: i for i, p in enumerate(rows)}, {t: i for i, t in enumerate(cols)}
    for c in cells:
        table[row[c["p"]]][col[c["t"]]] = -float(c["n"])
    return sum(c["n"] for c in cells) + assignment(table)


def _near(a: DataFrame, b: DataFrame, radius: float) -> DataFrame:
    """Pairs (img, a, b, d) of points of one image within a radius, by a grid: each point meets only its 9 cells."""
    cell = lambda c: F.floor(F.col(c) / radius).cast("long")
    left = a.select("img", F.col("id").alias("a"), F.col("r").alias("ra"), F.col("c").alias("ca")).withColumn("gr", F.floor(F.col("ra") / radius).cast("long")).withColumn("gc", F.floor(F.col("ca") / radius).cast("long"))
    around = F.array(*[F.struct((cell("r") + i).alias("gr"), (cell("c") + j).alias("gc")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    right = b.select("img", F.col("id").alias("b"), F.col("r").alias("rb"), F.col("c").alias("cb"), F.explode(around).alias("g")).select("img", "b", "rb", "cb", "g.gr", "g.gc")
    d = F.sqrt((F.col("ra") - F.col("rb")) ** 2 + (F.col("ca") - F.col("cb")) ** 2)
    return left.join(right, ["img", "gr", "gc"]).select("img", "a", "b", d.alias("d")).where(F.col("d") <= radius)


def centroid_counts(detections: DataFrame, targets: DataFrame, radius: float = 4.0) -> DataFrame:
    """Per image: detections without a target, targets without a detection, mean least distance of matched targets.
    Both have (img, id, r, c)."""
    near = stage(_near(detections, targets, radius), "near")  # read three times
    fp = detections.join(near.select("img", F.col("a").alias("id")).distinct(), ["img", "id"], "left_anti").groupBy("img").agg(F.count("*").alias("fp"))
    fn = targets.join(near.select("img", F.col("b").alias("id")).distinct(), ["img", "id"], "left_anti").groupBy("img").agg(F.count("*").alias("fn"))
    dist = near.groupBy("img", "b").agg(F.min("d").alias("d")).groupBy("img").agg(F.avg("d").alias("mean_dist"))
    every = detections.select("img").union(targets.select("img")).distinct()
    return every.join(fp, "img", "left").join(fn, "img", "left").join(dist, "img", "left").select("img", F.coalesce("fp", F.lit(0)).alias("n_false_positive"), F.coalesce("fn", F.lit(0)).alias("n_false_negative"), "mean_dist")


#: Most points of one image that are matched with each other in a task; more are an error, not a sample.
MOST_POINTS = 100_000


def unmatched_targets(detections: DataFrame, targets: DataFrame, radius: float = 4.0) -> DataFrame:
    """(img, n_false_negative): targets left when no detection may confirm two. Every target goes to its nearest
    detection; a detection confirms the nearest target it got, if within the radius, and hands the others back, or else
    all it got are missed. Detections that got nothing are out. Repeated until either side is empty.

    Images without targets have no row. Ties go to the least id.
    """
    points = lambda d, n: d.groupBy(F.col("img").cast("long").alias("img")).agg(F.array_sort(F.collect_list(F.struct("id", "r", "c"))).alias(n))
    both = points(targets, "t").join(points(detections, "d"), "img", "left")

    def run(batches):
        for b in batches:
            misses = []
            for ts, ds in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                if max(len(ts), len(ds or [])) > MOST_POINTS:
                    raise ValueError(f"more than {MOST_POINTS} points in an image")
                left, free, missed = np.array([[p["r"], p["c"]] for p in ts]), np.array([[p["r"], p["c"]] for p in ds or []]).reshape(-1, 2), 0
                while len(left) and len(free):
                    d = np.sqrt(((left[:, None] - free[None]) ** 2).sum(axis=2))
                    to, back, kept = d.argmin(axis=1), [], []
                    for k in np.unique(to):
                        got = np.flatnonzero(to == k)
                        best = got[d[got, k].argmin()]
                        if d[best, k] > radius:
                            missed += len(got)
                            kept.append(k)
                        else:
                            back += [g for g in got if g != best]
                    left, free = left[sorted(back)], free[kept]
                misses.append(missed + len(left))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(misses, pa.int64())], names=["img", "n_false_negative"])

    return both.mapInArrow(run, "img long, n_false_negative long")


def matched_distance(detections: DataFrame, targets: DataFrame, radius: float = 4.0) -> DataFrame:
    """Per image the sum of distances when targets, by id, each take their nearest free detection within the radius.

    Only the few pairs within the radius of one image come together in a task.
    """

    def greedy(batches):
        for b in batches:
            img, pairs = b.column(0), b.column(1).to_pylist()
            total, matched = [], []
            for near in pairs:
                taken, served, d = set(), set(), 0.0
                for p in sorted(near, key=lambda p: (p["b"], p["d"], p["a"])):
                    if p["b"] not in served and p["a"] not in taken:
                        taken.add(p["a"])
                        served.add(p["b"])
                        d += p["d"]
                total.append(d)
                matched.append(len(served))
            yield pa.RecordBatch.from_arrays([img, pa.array(total, pa.float64()), pa.array(matched, pa.int64())], names=["img", "total", "matched"])

    pairs = _near(detections, targets, radius).groupBy(F.col("img").cast("long").alias("img")).agg(F.collect_list(F.struct("a", "b", "d")).alias("pairs"))
    return pairs.mapInArrow(greedy, "img long, total double, matched long")
