"""Queries of objectives, fronts and population statistics, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.io import table
from arbora.operators import objectives as V
from arbora.operators import pareto as P
from arbora.operators import selection as S

_EVAL = "SELECT l_orderkey AS img, CAST(l_quantity % 10 AS DOUBLE) AS p, CAST((l_quantity + l_linenumber) % 10 AS DOUBLE) - 1 AS t, l_discount AS score, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label FROM lineitem"


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").selectExpr("l_orderkey AS img", "CAST(l_quantity % 10 AS DOUBLE) AS p", "CAST((l_quantity + l_linenumber) % 10 AS DOUBLE) - 1 AS t", "l_discount AS score", "CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label", "CAST(pmod(l_orderkey, 5) AS INT) AS fold")


def _objective(name: str):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return V.evaluate(predictions(spark, folder), [name]).select(F.round(name, 6).alias("value"))

    return run


QUERIES = {f"obj_{n}": _objective(n) for n in V.OBJECTIVES}


def _share(of: str, among: str) -> str:
    return f"coalesce(sum(n) FILTER ({of}), 0) / nullif(sum(n) FILTER ({among}), 0)"


def _mean(value: str, among: str) -> str:
    return f"sum(n * ({value})) FILTER ({among}) / nullif(sum(n) FILTER ({among}), 0)"


def _deviation(among: str) -> str:
    return f"sqrt(greatest({_mean('(p - t) * (p - t)', among)} - pow({_mean('p - t', among)}, 2), 0))"


def _count(of: str) -> str:
    return f"coalesce(sum(n) FILTER ({of}), 0)"


_ANY, _AGREES, _KNOWN = "n > 0", "(p < 0) = (t = -1)", "t <> 0"
_Q = "greatest(least(p / 10, 0.9999), 0.0001)"
#: The objectives said again, as sums over the table of confusion with n rows in each cell: no rows are read there, and
#: shares of the wrong stand where the operators take 1 less the right.
CHECK = {
    "false_positive": f"{_count('t = 0')} - {_count('t = 0 AND p = 0')}",
    "false_negative": f"{_count('t = 1')} - {_count('t = 1 AND p = 1')}",
    "false_positive_multi": _count("t = 0 AND (p < 0 OR p > 0)"),
    "false_negative_multi": _count("t = 1 AND (p < 1 OR p > 1)"),
    "false_positive_rate": f"({_count('t = 0')} - {_count('t = 0 AND p = 0')}) / sum(n)",
    "false_negative_rate": f"({_count('t = 1')} - {_count('t = 1 AND p = 1')}) / sum(n)",
    "f1_score_min": f"1 - 2 / (1 / ({_share('t = 1 AND p = 1', 'p = 1')}) + 1 / ({_share('t = 1 AND p = 1', 't = 1')}))",
    "precision_min": _share("t <> 1 AND p = 1", "p = 1"),
    "recall_min": _share("t = 1 AND p <> 1", "t = 1"),
    "accuracy_score": _share("p <> t", _ANY),
    "accuracy_score_multi": f"{_share('t = 0 AND p <> 0', _ANY)} + {_share('t = 1 AND p <> 1', _ANY)}",
    "objective0EvalFunction": "sqrt(sum(n * (p * p - 2 * p * t + t * t)) / sum(n))",
    "objective1EvalFunction": _mean("p - t", "p > t"),
    "objective2EvalFunction": _mean("t - p", "t > p"),
    "objective4EvalFunction": _share("abs(p - t) + 0.4 > sqrt(0.25 + pow(0.013 * t, 2))", _ANY),
    "objective5EvalFunction": f"abs({_mean('abs(p - t) / nullif(t, 0)', _KNOWN)})",
    "objective6EvalFunction": f"abs({_mean('abs(p - t) / nullif(t, 0)', f'{_KNOWN} AND {_AGREES}')})",
    "objective7EvalFunction": f"sqrt({_mean('pow(p - t, 2)', _AGREES)})",
    "objective8EvalFunction": f"coalesce({_mean('p - t', f'{_AGREES} AND p > t')}, 0)",
    "objective9EvalFunction": f"coalesce({_mean('t - p', f'{_AGREES} AND t > p')}, 0)",
    "objective10EvalFunction": _count("sign(p) = -1"),
    "objective11EvalFunction": f"{_count('t = -1')} - {_count('t = -1 AND p < 0')}",
    "objective12EvalFunction": f"{_count('p < 0')} - {_count('p < 0 AND t = -1')}",
    "class0AccuracyEvalFunction": f"coalesce(nullif({_share('t = 0 AND NOT (p BETWEEN 0 AND 2)', 't = 0')}, 0), 1)",
    "class4AccuracyEvalFunction": f"coalesce(nullif({_share('t = 4 AND NOT (p > 2 AND p <= 4)', 't = 4')}, 0), 1)",
    "drinking_error_rate": f"1 - {_share('t = 2 AND p > 1.5 AND p <= 2.5', 't = 2')}",
    "drinking_false_alarm_rate": _share("t <> 2 AND p > 1.5 AND p <= 2.5", "t <> 2"),
    "shaking_error_rate": f"1 - {_share('t = 9 AND p > 8.5 AND p <= 9.5', 't = 9')}",
    "shaking_false_alarm_rate": _share("t <> 9 AND p > 8.5 AND p <= 9.5", "t <> 9"),
    "scratching_error_rate": f"1 - {_share('t = 1 AND p = 1', 't = 1')}",
    "scratching_false_alarm_rate": _share("t <> 1 AND p = 1", "t <> 1"),
    "count_over_predictions": _share("p - t > 0", _ANY),
    "count_under_predictions": _share("t - p > 0", _ANY),
    "overall_standard_deviation": _deviation(_ANY),
    "standard_deviation_over": _deviation("p > t"),
    "standard_deviation_under": _deviation("t > p"),
    "average_percent_error": _mean("abs(p - t) / nullif(t, 0)", _KNOWN),
    "average_precent_error_over": _mean("(p - t) / nullif(t, 0)", f"{_KNOWN} AND p > t"),
    "average_precent_error_under": _mean("(t - p) / nullif(t, 0)", f"{_KNOWN} AND t > p"),
    "max_over_prediction_error": "nullif(greatest(max(p - t), 0), 0)",
    "max_under_prediction_error": "nullif(greatest(max(t - p), 0), 0)",
    "continuous_mse": "sum(n * abs(p - t))",
    "continuous_bias": "sum(n * greatest(p - t, t - p))",
    "continuous_var": "sum(n * (p - t) * (p - t)) - pow(sum(n * (p - t)), 2) / sum(n)",
    "weighted_binary_crossentropy": f"-sum(n * CASE WHEN t = 1 THEN 2 * ln({_Q}) ELSE ln(1 - {_Q}) END) / sum(n)",
}
SQL = {f"obj_{n}": f"SELECT round(CAST({e} AS DOUBLE), 6) AS value FROM (SELECT p, t, CAST(count(*) AS DOUBLE) AS n FROM ({_EVAL}) GROUP BY p, t)" for n, e in CHECK.items()}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


_MAIN = ["false_positive", "false_negative", "objective0EvalFunction", "accuracy_score"]


@query(f"SELECT {', '.join(f'round(avg({n}), 6) AS {n}' for n in _MAIN)} FROM (SELECT img % 5 AS fold, {', '.join(f'CAST({V.OBJECTIVES[n]} AS DOUBLE) AS {n}' for n in _MAIN)} FROM ({_EVAL}) GROUP BY img % 5)")
def obj_fold_average(spark, folder):
    """Objectives averaged over folds."""
    return V.fold_average(predictions(spark, folder), _MAIN).select(*[F.round(n, 6).alias(n) for n in _MAIN])


_AUC = f"SELECT (sum(CASE WHEN label = 1 THEN rk END) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label) * sum(1 - label)) AS a FROM (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rk FROM ({_EVAL}))"


@query(f"SELECT round(a, 6) AS roc_auc FROM ({_AUC})")
def obj_roc_auc(spark, folder):
    return V.roc_auc(predictions(spark, folder), "score", "label").select(F.round("roc_auc", 6).alias("roc_auc"))


@query(f"SELECT round(1 - a, 6) AS auroc FROM ({_AUC})")
def obj_auroc(spark, folder):
    return V.roc_auc(predictions(spark, folder), "score", "label").select(F.round(1 - F.col("roc_auc"), 6).alias("auroc"))


@query(f"SELECT round(sum(pos * hit / CAST(seen AS DOUBLE)) / sum(pos), 6) AS average_precision FROM (SELECT pos, sum(pos) OVER (ORDER BY score DESC) AS hit, sum(n) OVER (ORDER BY score DESC) AS seen FROM (SELECT score, sum(label) AS pos, count(*) AS n FROM ({_EVAL}) GROUP BY score))")
def obj_precision_auc(spark, folder):
    return V.average_precision(predictions(spark, folder), "score", "label").select(F.round("average_precision", 6).alias("average_precision"))


@query(f"SELECT t, p, count(*) AS n FROM ({_EVAL}) GROUP BY t, p")
def obj_confusion_matrix(spark, folder):
    return V.confusion(predictions(spark, folder))


_PAIR = "n * (n - 1) / 2.0"


@query(
    f"""WITH c AS (SELECT p, t, count(*) AS n FROM ({_EVAL}) GROUP BY p, t), b AS (SELECT sum({_PAIR}) AS b, sum(n) AS a FROM c),
    x AS (SELECT sum({_PAIR}) AS s FROM (SELECT sum(n) AS n FROM c GROUP BY p)), y AS (SELECT sum({_PAIR}) AS s FROM (SELECT sum(n) AS n FROM c GROUP BY t))
    SELECT round((x.s - b.b) / (b.a * (b.a - 1) / 2.0), 6) AS cluster_error1, round((y.s - b.b) / (b.a * (b.a - 1) / 2.0), 6) AS cluster_error2 FROM b, x, y"""
)
def obj_cluster_errors(spark, folder):
    return V.cluster_errors(predictions(spark, folder)).select(F.round("cluster_error1", 6).alias("cluster_error1"), F.round("cluster_error2", 6).alias("cluster_error2"))


@query()
def obj_cluster_partition_distance(spark, folder):
    d = V.partition_distance(predictions(spark, folder))
    return spark.range(1).select(F.lit(d).alias("distance"))


def _points(spark, folder):
    """Detections and targets: lines of an order as points of one image."""
    t = table(spark, folder, "lineitem").selectExpr("l_orderkey AS img", "l_linenumber AS id", "l_quantity AS r", "CAST(l_partkey % 50 AS DOUBLE) AS c")
    u = table(spark, folder, "lineitem").selectExpr("l_orderkey AS img", "l_linenumber AS id", "CAST(l_suppkey % 50 AS DOUBLE) AS r", "l_quantity AS c")
    return t, u


_PTS = "WITH d AS (SELECT l_orderkey AS img, l_linenumber AS id, l_quantity AS r, CAST(l_partkey % 50 AS DOUBLE) AS c FROM lineitem), g AS (SELECT l_orderkey AS img, l_linenumber AS id, CAST(l_suppkey % 50 AS DOUBLE) AS r, l_quantity AS c FROM lineitem), n AS (SELECT d.img, d.id AS a, g.id AS b, sqrt(pow(d.r - g.r, 2) + pow(d.c - g.c, 2)) AS dist FROM d JOIN g ON d.img = g.img WHERE sqrt(pow(d.r - g.r, 2) + pow(d.c - g.c, 2)) <= 4)"


@query(
    _PTS
    + """ SELECT i.img, (SELECT count(*) FROM d WHERE d.img = i.img AND NOT EXISTS (SELECT 1 FROM n WHERE n.img = d.img AND n.a = d.id)) AS n_false_positive,
    (SELECT count(*) FROM g WHERE g.img = i.img AND NOT EXISTS (SELECT 1 FROM n WHERE n.img = g.img AND n.b = g.id)) AS n_false_negative,
    (SELECT round(avg(m), 6) FROM (SELECT min(dist) AS m FROM n WHERE n.img = i.img GROUP BY b)) AS mean_dist FROM (SELECT DISTINCT img FROM d) i"""
)
def obj_centroids(spark, folder):
    """false_positive_centroid, false_negative_centroid, mean_dist_from_target per image."""
    return V.centroid_counts(*_points(spark, folder)).withColumn("mean_dist", F.round("mean_dist", 6))


@query()
def obj_distance_from_target(spark, folder):
    """Greedy matched distances per image; also counts matches, as false_negative_centroid2 needs."""
    return V.matched_distance(*_points(spark, folder)).withColumn("total", F.round("total", 6))


@query(f"SELECT * FROM (SELECT img, p, t, CASE WHEN p > t THEN 'over' WHEN p < t THEN 'under' END AS side FROM ({_EVAL})) WHERE side IS NOT NULL")
def obj_over_under_rows(spark, folder):
    """get_over_predicted_inds and get_under_predicted_inds."""
    return predictions(spark, folder).select("img", "p", "t", F.when(F.col("p") > F.col("t"), "over").when(F.col("p") < F.col("t"), "under").alias("side")).where("side is not null")


@query("SELECT round(CAST(1 - avg(CASE WHEN pv = tv THEN 1.0 ELSE 0.0 END) AS DOUBLE), 6) AS value FROM (SELECT list(p ORDER BY id) AS pv, list(t ORDER BY id) AS tv FROM (SELECT l_orderkey AS img, l_linenumber AS id, l_quantity % 3 AS p, (l_quantity + CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) % 3 AS t FROM lineitem) GROUP BY img)")
def obj_multilabel_accuracy_score(spark, folder):
    """1 - share of rows whose whole label vector is right."""
    t = table(spark, folder, "lineitem").selectExpr("l_orderkey AS img", "l_linenumber AS id", "l_quantity % 3 AS p", "(l_quantity + CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) % 3 AS t")
    v = t.groupBy("img").agg(F.array_sort(F.collect_list(F.struct("id", "p", "t"))).alias("v")).select(F.when(F.col("v.p") == F.col("v.t"), 1.0).otherwise(0.0).alias("hit"))
    return v.agg(F.round(1 - F.avg("hit"), 6).alias("value"))


_CLASSES = f"WITH e AS (SELECT p, t FROM ({_EVAL})), k AS (SELECT DISTINCT unnest([p, t]) AS c FROM e)"


@query(f"""{_CLASSES} SELECT round(1 - avg(coalesce(hit / nullif(said, 0), 0)), 6) AS precision_min, round(1 - avg(coalesce(hit / nullif(was, 0), 0)), 6) AS recall_min FROM (
  SELECT c, CAST(count_if(p = c AND t = c) AS DOUBLE) AS hit, count_if(p = c) AS said, count_if(t = c) AS was FROM k, e GROUP BY c)""")
def obj_macro_scores(spark, folder):
    """Macro precision and recall."""
    return V.macro_scores(predictions(spark, folder)).select(F.round("precision_min", 6).alias("precision_min"), F.round("recall_min", 6).alias("recall_min"))


@query("SELECT round(CAST(count_if(pv <> tv) AS DOUBLE) / count(*), 6) AS value, 'inf'::DOUBLE AS trivial FROM (SELECT list(p ORDER BY id) AS pv, list(t ORDER BY id) AS tv FROM (SELECT l_orderkey AS img, l_linenumber AS id, l_quantity % 2 AS p, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS t FROM lineitem) GROUP BY img)")
def obj_multilabel_fail_trivial(spark, folder):
    """Share of rows not wholly right, and the failure of a trivial prediction."""
    t = table(spark, folder, "lineitem").selectExpr("l_orderkey AS img", "l_linenumber AS id", "CAST(l_quantity % 2 AS INT) AS p", "CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS t")
    v = t.groupBy("img").agg(F.array_sort(F.collect_list(F.struct("id", "p", "t"))).alias("v")).select(F.col("v.p").alias("p"), F.col("v.t").alias("t"))
    flat = v.withColumn("p", F.transform("p", lambda x: F.lit(1)))
    one, other = V.multilabel_error(v, fail_trivial=True).select(F.round("value", 6).alias("value")), V.multilabel_error(flat, fail_trivial=True).select(F.col("value").alias("trivial"))
    return one.join(other)  # one row each


@query()
def obj_false_negative_centroid2(spark, folder):
    """Targets left per image when no detection confirms two."""
    return V.unmatched_targets(*_points(spark, folder))


_WALK = r"""(SELECT hash, max(d) AS height FROM (SELECT hash, sum(CASE WHEN c = '(' THEN 1 ELSE -1 END) OVER (PARTITION BY hash ORDER BY i) AS d FROM
  (SELECT hash, unnest(cs) AS c, generate_subscripts(cs, 1) AS i FROM (SELECT hash, regexp_extract_all(main, '[()]') AS cs FROM m))) GROUP BY hash)"""


@query(
    rf"""WITH m AS (SELECT lower(trim(hash)) AS hash, min(tree) AS tree, split_part(ltrim(min(tree), chr(9) || chr(10) || chr(13) || ' '), chr(10), 1) AS main FROM individuals WHERE tree IS NOT NULL GROUP BY 1)
  SELECT m.hash, CAST(coalesce(height, 0) AS INT) AS height, round(coalesce(height, 0) - (len(main) - len(replace(main, 'ARG0', ''))) / 4 / (pow(3e0, coalesce(height, 0)) + 1), 9) AS depth_breadth, 1707 AS capped_elements FROM m LEFT JOIN {_WALK} w ON w.hash = m.hash"""
)
def obj_program_measures(spark, folder):
    """depth_breadth_eval_function and num_elements_eval_function_capped of each program."""
    t = table(spark, folder, "individuals").where("tree is not null").groupBy(F.lower(F.trim("hash")).alias("hash")).agg(F.min("tree").alias("tree"))
    return V.program_measures(t).select("hash", "height", F.round("depth_breadth", 9).alias("depth_breadth"), "capped_elements")


# --- fronts and populations --------------------------------------------------------------------------------------------

_IND = "(SELECT DISTINCT lower(trim(hash)) AS hash, evaluation_gen AS gen, reviews_error_rate AS f1, reviews_num_params AS f2 FROM individuals WHERE reviews_error_rate IS NOT NULL AND reviews_num_params IS NOT NULL AND isfinite(reviews_error_rate) AND isfinite(reviews_num_params))"


def scored(spark, folder):
    t = table(spark, folder, "individuals").select(F.lower(F.trim("hash")).alias("hash"), F.col("evaluation_gen").alias("gen"), F.col("reviews_error_rate").alias("f1"), F.col("reviews_num_params").alias("f2")).distinct()
    return t.where("f1 is not null and f2 is not null and abs(f1) < double('infinity') and abs(f2) < double('infinity')")


_BETTER = "b.f1 <= a.f1 AND b.f2 <= a.f2 AND (b.f1 < a.f1 OR b.f2 < a.f2)"


@query(f"WITH i AS {_IND} SELECT hash, f1, f2 FROM i a WHERE NOT EXISTS (SELECT 1 FROM i b WHERE {_BETTER})")
def pareto_front(spark, folder):
    return P.pareto_front(scored(spark, folder).select("hash", "f1", "f2").distinct(), ["f1", "f2"]).select("hash", "f1", "f2")


@query(f"WITH i AS {_IND} SELECT gen, hash, f1, f2 FROM i a WHERE NOT EXISTS (SELECT 1 FROM i b WHERE b.gen = a.gen AND {_BETTER})")
def pareto_by_generation(spark, folder):
    return P.front_2d(scored(spark, folder), "f1", "f2", ["gen"]).select("gen", "hash", "f1", "f2")


@query(f"WITH i AS {_IND} SELECT min(hash) AS hash, f1, f2 FROM i a WHERE NOT EXISTS (SELECT 1 FROM i b WHERE {_BETTER}) GROUP BY f1, f2")
def pareto_one_of_equals(spark, folder):
    """Of equal points one stays."""
    return P.pareto_front(scored(spark, folder).select("hash", "f1", "f2").distinct(), ["f1", "f2"], keep_equal=False, id="hash").select("hash", "f1", "f2")


@query(
    f"""WITH i AS {_IND}, f AS (SELECT DISTINCT gen, f1, f2 FROM i a WHERE NOT EXISTS (SELECT 1 FROM i b WHERE b.gen = a.gen AND {_BETTER})),
    s AS (SELECT gen, f1, f2, lead(f1, 1, 1e0) OVER (PARTITION BY gen ORDER BY f1) AS nx FROM f WHERE f1 < 1 AND f2 < 1e6)
    SELECT g.gen, round(coalesce(sum((nx - f1) * (1e6 - f2)), 0), 3) AS hypervolume FROM (SELECT DISTINCT gen FROM f) g LEFT JOIN s ON s.gen = g.gen GROUP BY g.gen"""
)
def pareto_hypervolume(spark, folder):
    """Hypervolume below (1, 10^6) per generation."""
    return P.hypervolume(scored(spark, folder), ["f1", "f2"], [1.0, 1e6], ["gen"]).select("gen", F.round("hypervolume", 3).alias("hypervolume"))


_UNIT = "(SELECT gen, f1 AS a, f2 / 1000000.0 AS b FROM i)"


@query(
    f"""WITH i AS {_IND}, u AS {_UNIT}, f AS (SELECT DISTINCT gen, a, b FROM u x WHERE NOT EXISTS (SELECT 1 FROM u y WHERE y.gen = x.gen AND y.a <= x.a AND y.b <= x.b AND (y.a < x.a OR y.b < x.b))),
    e AS (SELECT * FROM f UNION ALL SELECT DISTINCT gen, 0.0, 1.0 FROM u UNION ALL SELECT DISTINCT gen, 1.0, 0.0 FROM u)
    SELECT gen, round(sum(abs(nx - a) * b), 6) AS auc FROM (SELECT *, lead(a) OVER (PARTITION BY gen ORDER BY a, b DESC) AS nx FROM e) GROUP BY gen"""
)
def pareto_front_auc(spark, folder):
    u = scored(spark, folder).select("gen", F.col("f1").alias("a"), (F.col("f2") / 1000000.0).alias("b"))
    return P.staircase_area(u, "a", "b", ["gen"]).select("gen", F.round("auc", 6).alias("auc"))


def _one_each(spark, folder):
    """Programs with one pair of objectives each: the least of those stored."""
    return scored(spark, folder).groupBy("hash").agg(F.min(F.struct("f1", "f2")).alias("f")).select("hash", "f.f1", "f.f2")


_ONE_EACH = f"(SELECT hash, f.f1 AS f1, f.f2 AS f2 FROM (SELECT hash, min({{'f1': f1, 'f2': f2}}) AS f FROM {_IND} GROUP BY hash))"
#: Fronts are taken off one after the other from a list of what is left.
_LOSES = "len(list_filter(rest, lambda b: b.f1 <= a.f1 AND b.f2 <= a.f2 AND (b.f1 < a.f1 OR b.f2 < a.f2))) > 0"
_PEEL = f"""WITH RECURSIVE o AS {_ONE_EACH}, s(k, rest, front) AS (SELECT -1, l, l[1:0] FROM (SELECT list({{'h': hash, 'f1': f1, 'f2': f2}}) AS l FROM o)
    UNION ALL SELECT k + 1, list_filter(rest, lambda a: {_LOSES}), list_filter(rest, lambda a: NOT ({_LOSES})) FROM s WHERE len(rest) > 0),
  r AS (SELECT k AS front, p.h AS hash, p.f1 AS f1, p.f2 AS f2 FROM (SELECT k, unnest(front) AS p FROM s WHERE k >= 0)),
  d AS (SELECT *, (lead(f1) OVER a - lag(f1) OVER a) / nullif(max(f1) OVER w - min(f1) OVER w, 0) AS d1, (lead(f2) OVER b - lag(f2) OVER b) / nullif(max(f2) OVER w - min(f2) OVER w, 0) AS d2,
      lead(f1) OVER a IS NULL OR lag(f1) OVER a IS NULL OR lead(f2) OVER b IS NULL OR lag(f2) OVER b IS NULL AS ends FROM r
    WINDOW w AS (PARTITION BY front), a AS (PARTITION BY front ORDER BY f1, hash), b AS (PARTITION BY front ORDER BY f2, hash)),
  c AS (SELECT hash, front, f1, f2, CASE WHEN ends THEN 'inf'::DOUBLE ELSE coalesce(d1, 0) + coalesce(d2, 0) END AS crowding FROM d)"""


@query(f"{_PEEL} SELECT hash, CAST(front AS INT) AS front FROM r")
def pareto_ranks(spark, folder):
    """The front of every program."""
    return P.ranks(_one_each(spark, folder), "hash", ["f1", "f2"])


@query(f"{_PEEL} SELECT hash, round(crowding, 6) AS crowding FROM c WHERE front = 0")
def pareto_crowding(spark, folder):
    f = P.pareto_front(_one_each(spark, folder), ["f1", "f2"])
    return S.crowding(f, "hash", ["f1", "f2"]).select("hash", F.round("crowding", 6).alias("crowding"))


@query(f"{_PEEL} SELECT hash, CAST(front AS INT) AS front FROM c ORDER BY front, crowding DESC, hash LIMIT 60")
def select_nsga2(spark, folder):
    """Sixty survivors by front and crowding distance."""
    return S.nsga2(_one_each(spark, folder), "hash", ["f1", "f2"], 60).select("hash", "front")


@query()
def select_nsga2_weighted(spark, folder):
    """Forty parents by weighted tournaments with acceptable values and goals."""
    return S.weighted_tournament(_one_each(spark, folder), "hash", ["f1", "f2"], 40, [0.3, 5e5], [0.1, 1e5])


@query()
def select_max_distance(spark, folder):
    """Sixty survivors, the last front's spread apart."""
    return S.max_distance_nsga(_one_each(spark, folder), "hash", ["f1", "f2"], 60)


_SCALED = f"(SELECT hash, f1, f2 / 1e6 AS f2 FROM {_ONE_EACH})"


def _scaled(spark, folder):
    return _one_each(spark, folder).withColumn("f2", F.col("f2") / 1e6)


@query(f"WITH i AS (SELECT min(hash) AS hash, f1, f2, count(*) AS n FROM {_SCALED} GROUP BY f1, f2) SELECT a.hash AS a, b.hash AS b, a.n AS n_a, b.n AS n_b, round(sqrt(pow(a.f1 - b.f1, 2) + pow(a.f2 - b.f2, 2)), 9) AS dist FROM i a, i b WHERE a.hash < b.hash AND sqrt(pow(a.f1 - b.f1, 2) + pow(a.f2 - b.f2, 2)) <= 0.003")
def select_distance_graph(spark, folder):
    """Programs at most 0.003 apart in objectives; equal ones stand as one with their number."""
    return S.near_pairs(_scaled(spark, folder), "hash", ["f1", "f2"], 0.003).withColumn("dist", F.round("dist", 9))


_GAPS = "SELECT round(coalesce(min(sqrt(pow(a.f1 - b.f1, 2) + pow(a.f2 - b.f2, 2))), 0), 9) AS distance FROM i a, i b WHERE a.hash < b.hash"


@query(f"WITH i AS {_SCALED} {_GAPS}")
def pop_min_objective_distance(spark, folder):
    return S.least_distance(_scaled(spark, folder), "hash", ["f1", "f2"]).select(F.round("distance", 9).alias("distance"))


@query(f"WITH i AS {_SCALED} {_GAPS} AND (a.f1 <> b.f1 OR a.f2 <> b.f2)")
def pop_min_nonzero_objective_distance(spark, folder):
    return S.least_distance(_scaled(spark, folder), "hash", ["f1", "f2"], nonzero=True).select(F.round("distance", 9).alias("distance"))


@query(f"SELECT hash, round(1 / (1 + 2.0 * sqrt(pow(greatest(f1 - 0.3, 0), 2) + pow(greatest(f2 - 0.5, 0), 2)) + sqrt(pow(greatest(f1 - 0.1, 0), 2) + pow(greatest(f2 - 0.1, 0), 2))), 9) AS weight FROM {_SCALED}")
def select_mating_weights(spark, folder):
    return S.mating_weights(_scaled(spark, folder), ["f1", "f2"], [0.3, 0.5], [0.1, 0.1], 2.0).select("hash", F.round("weight", 9).alias("weight"))


@query(f"{_PEEL} SELECT hash, round(crowding * 1.5 / (0.5 + sqrt(pow(least(greatest((f1 - 0.1) / 0.3, 0), 1), 2) + pow(least(greatest((f2 - 1e4) / 9e4, 0), 1), 2))), 6) AS crowding FROM c WHERE front = 0")
def pareto_crowding_region(spark, folder):
    """HCDScaleMin: crowding distance scaled by the region of interest."""
    f = S.crowding(P.pareto_front(_one_each(spark, folder), ["f1", "f2"]), "hash", ["f1", "f2"])
    return S.region_scaled(f, ["f1", "f2"], [0.1, 1e4], [0.4, 1e5]).select("hash", F.round("crowding", 6).alias("crowding"))


@query(f"SELECT hash, f1 + CASE WHEN f1 < 0.5 THEN 0 ELSE 5e9 END + CASE WHEN f2 < 1e5 THEN 0 ELSE 5e9 END AS f1 FROM {_ONE_EACH}")
def pop_tier_adjusted(spark, folder):
    """Objectives with an offset for each tier a program was not evaluated on."""
    t = _one_each(spark, folder).withColumn("t1", F.col("f1") < 0.5).withColumn("t2", F.col("f2") < 1e5)
    return S.tier_adjusted(t, ["f1"], ["t1", "t2"]).select("hash", "f1")


@query(f"""{_PEEL} SELECT hash, kind FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY front, hash) AS rk FROM (SELECT hash, front,
    CASE WHEN f1 BETWEEN 0.1 AND 0.35 AND f2 BETWEEN 1e4 AND 3e5 THEN 'well_rounded' WHEN f1 BETWEEN 0.1 AND 0.35 OR f2 BETWEEN 1e4 AND 3e5 THEN 'specialist' END AS kind FROM r) WHERE kind IS NOT NULL) WHERE rk <= 25""")
def select_gene_pool(spark, folder):
    """Well-rounded programs and specialists by ranges of the objectives, the first 25 of each."""
    return S.gene_pool(_one_each(spark, folder), "hash", ["f1", "f2"], [(0.1, 0.35), (1e4, 3e5)], 25).select("hash", "kind")


@query(f"WITH i AS {_ONE_EACH} SELECT a.hash, min(b.hash) AS first FROM i a JOIN i b ON b.hash <= a.hash AND (a.f1 = b.f1 OR abs(a.f1 - b.f1) < abs(a.f1) * 0.02) AND (a.f2 = b.f2 OR abs(a.f2 - b.f2) < abs(a.f2) * 0.02) GROUP BY a.hash")
def pop_similar_phenotypes(spark, folder):
    """For each program the first whose objectives agree with its own up to two per cent."""
    return S.similar(_one_each(spark, folder), "hash", ["f1", "f2"], 2.0)


def _lexicase_order() -> list[str]:
    import numpy as np

    return [str(o) for o in np.random.default_rng(7).permutation(["f1", "f2"])]


@query("WITH i AS {i}, x AS (SELECT * FROM i WHERE {a} = (SELECT min({a}) FROM i)) SELECT DISTINCT hash, f1, f2 FROM x WHERE {b} = (SELECT min({b}) FROM x)".format(i=_IND, a=_lexicase_order()[0], b=_lexicase_order()[1]))
def select_lexicase(spark, folder):
    return P.lexicase(scored(spark, folder).select("hash", "f1", "f2").distinct(), ["f1", "f2"], "hash", 7)


@query()
def select_tournament(spark, folder):
    return P.tournament(scored(spark, folder).select("hash", "f1", "f2").dropDuplicates(["hash"]), "hash", ["f1", "f2"], 50, 7)


@query(f"WITH i AS {_IND}, m AS (SELECT avg(f1) m1, avg(f2) m2, covar_samp(f1, f1) a, covar_samp(f1, f2) b, covar_samp(f2, f2) d FROM i) SELECT round(avg(((f1 - m1) * (f1 - m1) * d - 2 * (f1 - m1) * (f2 - m2) * b + (f2 - m2) * (f2 - m2) * a) / (a * d - b * b)), 4) AS z_score FROM i, m")
def pop_z_score(spark, folder):
    return P.z_score(scored(spark, folder), ["f1", "f2"]).select(F.round("z_score", 4).alias("z_score"))


@query(
    """WITH e AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS v FROM embeddings)
    SELECT q, round(avg(d), 5) AS novelty FROM (SELECT a.vec_id AS q, sqrt(list_sum(list_transform(range(1, 65), lambda i: pow(a.v[i] - b.v[i], 2)))) AS d, row_number() OVER (PARTITION BY a.vec_id ORDER BY sqrt(list_sum(list_transform(range(1, 65), lambda i: pow(a.v[i] - b.v[i], 2))))) AS rk FROM e a, e b WHERE a.vec_id <> b.vec_id AND a.vec_id % 20 = 0) WHERE rk <= 5 GROUP BY q"""
)
def pop_novelty_knn(spark, folder):
    """Mean distance to the 5 nearest of all rows, for every row whose id is divisible by 20."""
    e = table(spark, folder, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    near = P.novelty(e, "vec_id", "v", 5, e.where("vec_id % 20 = 0"))
    return near.groupBy("q").agg(F.round(F.avg("d"), 5).alias("novelty"))


@query("SELECT evaluation_gen AS gen, round(avg(len(regexp_extract_all(tree, '[A-Za-z0-9_.]+'))), 6) AS tree_size FROM (SELECT DISTINCT hash, evaluation_gen, tree, recorded_at FROM individuals WHERE tree IS NOT NULL) GROUP BY evaluation_gen")
def pop_tree_size(spark, folder):
    t = table(spark, folder, "individuals").select("hash", "evaluation_gen", "tree", "recorded_at").where("tree is not null").distinct()
    return t.groupBy(F.col("evaluation_gen").alias("gen")).agg(F.round(F.avg(F.size(F.regexp_extract_all("tree", F.lit("[A-Za-z0-9_.]+"), F.lit(0)))), 6).alias("tree_size"))
