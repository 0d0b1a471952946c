"""Queries that run whole programs: parsed, planned, learned and scored; and per-row clustering."""

from __future__ import annotations

from pyspark.sql import functions as F

import arbora.functions.clustering  # noqa: F401 - registers the operators
from arbora.functions.registry import OPS
from arbora.io import table
from arbora.operators import learners as L
from arbora.operators import objectives as V
from arbora.operators.dataset import S2F, apply, if_then_else, slices
from arbora.plans import program as G
from arbora.plans.layers import infer, network
from arbora.queries.kernels import _query as _kernel_query

QUERIES: dict = {}
SQL: dict[str, str] = {}
_CLUSTER = [o for o in OPS.values() if o.kernel and o.kernel.__module__.endswith("clustering")]
QUERIES |= {f"op_{o.name}": _kernel_query(o) for o in _CLUSTER}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def instances(spark, folder):
    """orders as instances: four features, a stream of the same, whether the order is finished as target."""
    t = table(spark, folder, "orders")
    x = F.array(F.col("o_totalprice") / 1000, (F.col("o_custkey") % 100).cast("double"), F.month("o_orderdate").cast("double"), F.length("o_orderpriority").cast("double"))
    return t.select(F.col("o_orderkey").alias("row_id"), x.alias("features"), x.alias("stream"), F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0).alias("target"))


_X = "[o_totalprice / 1000, CAST(o_custkey % 100 AS DOUBLE), CAST(month(o_orderdate) AS DOUBLE), CAST(length(o_orderpriority) AS DOUBLE)]"


@query(
    f"""WITH i AS (SELECT CASE WHEN o_orderstatus = 'F' THEN 1e0 ELSE 0e0 END AS t, list_transform({_X}, lambda v: v * 0.5)[1:2] AS x FROM orders)
    SELECT count_if(t = 0 AND p <> 0) AS false_positive, count_if(t = 1 AND p <> 1) AS false_negative, round(sqrt(avg((p - t) * (p - t))), 6) AS rmse FROM (SELECT t, CASE WHEN x[1] >= 75.5 THEN 1e0 ELSE 0e0 END AS p FROM i)"""
)
def program_threshold(spark, folder):
    """A program without a learner, parsed, run and scored in one pass."""
    out = G.run("MyBinaryThreshold(SelectRange(DataMultiplyFloat(ARG0, 0.5), 0, 2), 75.5)", instances(spark, folder))
    s = out.select(F.element_at("features", 1).alias("p"), F.col("target").alias("t"))
    return V.evaluate(s, ["false_positive", "false_negative", "objective0EvalFunction"]).select(F.col("false_positive").cast("long").alias("false_positive"), F.col("false_negative").cast("long").alias("false_negative"), F.round("objective0EvalFunction", 6).alias("rmse"))


@query(f"SELECT o_orderkey AS row_id, round(list_sum(x), 6) AS total FROM (SELECT *, CASE WHEN o_custkey % 100 <> 0 THEN list_transform({_X}, lambda v: v + 1) ELSE {_X} END AS x FROM orders)")
def program_if_then_else(spark, folder):
    d = instances(spark, folder)
    out = if_then_else(d, apply("DataAddInt", [d], "FEATURES_TO_FEATURES", 1), d, 1)
    return out.select("row_id", F.round(F.aggregate("features", F.lit(0.0), lambda a, v: a + v), 6).alias("total"))


@query(f"SELECT o_orderkey AS row_id, len(list_concat({_X}, [1])) AS n, round(list_sum({_X}), 6) AS appended FROM orders")
def program_stream_to_features(spark, folder):
    """A mode that appends: the sum of the stream joins the features."""
    out = apply("MySum", [instances(spark, folder)], S2F)
    return out.select("row_id", F.size("features").alias("n"), F.round(F.element_at("features", -1), 6).alias("appended"))


@query("SELECT vec_id AS row_id, w AS \"window\", round(list_sum(list_transform(embedding[w * 8 + 1:w * 8 + 16], lambda v: CAST(v AS DOUBLE))), 6) AS total FROM embeddings, LATERAL (SELECT unnest(range(0, 7)) AS w)")
def program_hopping_slices(spark, folder):
    """Every full window of 16 samples, 8 apart."""
    e = table(spark, folder, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("embedding").cast("array<double>").alias("stream"))
    return slices(e, 16, 8).select("row_id", "window", F.round(F.aggregate("values", F.lit(0.0), lambda a, v: a + v), 6).alias("total"))


@query()
def program_folds(spark, folder):
    """A chain of operators and a decision tree over five folds, scored per fold and averaged."""
    d = G.folds(instances(spark, folder))
    out = None
    for k in range(5):
        p = G.run("Learner(ZeroOneNorm(DataAddFloat(ARG0, 1.5)), LearnerType('DECISION_TREE', {'maxDepth': 3}), EnsembleType('SINGLE'))", d.where(F.col("fold") == k))
        s = p.where("split = 'test'").select("fold", F.col("prediction").alias("p"), F.col("target").alias("t"))
        out = s if out is None else out.unionByName(s)
    return V.fold_average(out, ["accuracy_score", "false_positive_rate", "false_negative_rate"])


def _learner(name, params, ensemble="SINGLE"):
    def run(spark, folder):
        d = instances(spark, folder)
        if name.endswith("REGRESSION") or name in ("OMP", "BLUP"):
            d = d.withColumn("target", F.element_at("features", 2)).withColumn("features", F.concat(F.slice("features", 1, 1), F.slice("features", 3, 2)))
        d = d.withColumn("split", F.when(F.col("row_id") % 5 == 0, "test").otherwise("train"))
        if name.startswith("KNN"):  # the query set: rows whose id is divisible by 20, against all rows
            d = d.withColumn("split", F.when(F.pmod("row_id", F.lit(20)) == 0, "test").otherwise("train"))
            asked = d.where("split = 'test'")
            near = L.novelty(d.where("split = 'train'"), "row_id", "features", params["k"], asked, "target")
            t = near.groupBy(F.col("q").alias("row_id")).agg(F.avg("target").alias("m"))
            out = asked.join(t, "row_id").withColumn("prediction", F.col("m") if name == "KNN_REGRESSION" else (F.col("m") > 0.5).cast("double"))
        else:
            out = L.learn(d, name, params, ensemble)
        s = out.where("split = 'test'").select(F.col("prediction").alias("p"), F.col("target").alias("t"))
        return V.evaluate(s, ["accuracy_score", "objective0EvalFunction"]).select(F.round("accuracy_score", 6).alias("accuracy_score"), F.round("objective0EvalFunction", 6).alias("objective0EvalFunction"))

    return run


_PARAMS = {"KNN": {"k": 5}, "KNN_REGRESSION": {"k": 5}, "KMEANS": {"k": 2}, "GMM": {"k": 2}, "BISECTING": {"k": 2}, "RAND_FOREST": {"numTrees": 5}, "EXTRATREES": {"numTrees": 5}, "RANDFOREST_REGRESSION": {"numTrees": 5}}
QUERIES |= {f"learner_{n}": _learner(n, _PARAMS.get(n, {})) for n in L.LEARNERS}
QUERIES |= {"learner_bagged": _learner("DECISION_TREE", {}, "BAGGED"), "learner_adaboost": _learner("DECISION_TREE", {"maxDepth": 2}, "ADABOOST")}


_ROWS = f"(SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 1e0 ELSE 0e0 END AS t, {_X} AS x FROM orders)"
#: The same for regression: the second feature is the target.
_REGRESSION = "(SELECT id, x[2] AS t, [x[1], x[3], x[4]] AS x FROM " + _ROWS + ")"
_SCORES = "SELECT round(CAST(count_if(p <> t) AS DOUBLE) / count(*), 6) AS accuracy_score, round(sqrt(avg(pow(p - t, 2))), 6) AS \"objective0EvalFunction\" FROM "
_NEAREST = """(SELECT q, {vote} AS p, any_value(t) AS t FROM (SELECT a.id AS q, a.t, b.t AS v, row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.x, b.x), b.id) AS rk FROM {rows} a, {rows} b WHERE a.id % 20 = 0 AND b.id % 20 <> 0) WHERE rk <= 5 GROUP BY q)"""
_WIDTH = 1e-9
SQL |= {
    "learner_ARGMAX": f"{_SCORES} (SELECT t, list_position(x, list_max(x)) - 1 AS p FROM {_ROWS} WHERE id % 5 = 0)",
    "learner_ARGMIN": f"{_SCORES} (SELECT t, list_position(x, list_min(x)) - 1 AS p FROM {_ROWS} WHERE id % 5 = 0)",
    "learner_DEPTH_ESTIMATE": f"{_SCORES} (SELECT t, (x[4] - x[1]) * sqrt(1 - pow(sin(radians(20)) / 1.33e0, 2)) AS p FROM {_ROWS} WHERE id % 5 = 0)",
    "learner_KNN": _SCORES + _NEAREST.format(rows=_ROWS, vote="CASE WHEN avg(v) > 0.5 THEN 1e0 ELSE 0e0 END"),
    "learner_KNN_REGRESSION": _SCORES + _NEAREST.format(rows=_REGRESSION, vote="avg(v)"),
    # Normal densities per class, with a share of the widest feature's variance added to every variance.
    "learner_BAYES": f"""WITH r AS {_ROWS}, e AS (SELECT id, t, unnest(range(1, 5)) AS k, unnest(x) AS v FROM r),
      w AS (SELECT max(s) * {_WIDTH!r} AS w FROM (SELECT var_pop(v) AS s FROM e WHERE id % 5 <> 0 GROUP BY k)),
      m AS (SELECT t, k, avg(v) AS m, var_pop(v) + any_value(w) AS s FROM e, w WHERE id % 5 <> 0 GROUP BY t, k),
      c AS (SELECT t, ln(count(*)) AS prior FROM r WHERE id % 5 <> 0 GROUP BY t),
      s AS (SELECT e.id, any_value(e.t) AS t, m.t AS p, any_value(prior) + sum(-ln(s) / 2 - pow(v - m, 2) / (2 * s)) AS score FROM e JOIN m ON m.k = e.k JOIN c ON c.t = m.t WHERE e.id % 5 = 0 GROUP BY e.id, m.t)
      {_SCORES} (SELECT id, any_value(t) AS t, max_by(p, score) AS p FROM s GROUP BY id)""",
    # Least squares by the normal equations of three features, solved as regressions on what the others leave.
    "learner_LINEAR_REGRESSION": f"""WITH r AS (SELECT id, t, x[1] AS a, x[2] AS b, x[3] AS c FROM {{rows}}), n AS (SELECT * FROM r WHERE id % 5 <> 0),
      s AS (SELECT covar_pop(a, a) aa, covar_pop(a, b) ab, covar_pop(a, c) ac, covar_pop(b, b) bb, covar_pop(b, c) bc, covar_pop(c, c) cc, covar_pop(a, t) a_t, covar_pop(b, t) b_t, covar_pop(c, t) c_t, avg(a) ma, avg(b) mb, avg(c) mc, avg(t) mt FROM n),
      d AS (SELECT *, aa * (bb * cc - bc * bc) - ab * (ab * cc - bc * ac) + ac * (ab * bc - bb * ac) AS det FROM s),
      w AS (SELECT *, (a_t * (bb * cc - bc * bc) - ab * (b_t * cc - bc * c_t) + ac * (b_t * bc - bb * c_t)) / det AS wa,
        (aa * (b_t * cc - c_t * bc) - a_t * (ab * cc - bc * ac) + ac * (ab * c_t - b_t * ac)) / det AS wb,
        (aa * (bb * c_t - bc * b_t) - ab * (ab * c_t - b_t * ac) + a_t * (ab * bc - bb * ac)) / det AS wc FROM d)
      {_SCORES} (SELECT r.t, mt + wa * (a - ma) + wb * (b - mb) + wc * (c - mc) AS p FROM r, w WHERE id % 5 = 0)""".replace("{rows}", _REGRESSION),
}


@query()
def layers_parameters(spark, folder):
    """Number of parameters of each stored network, from its layer tree and the modules defined below it."""
    t = table(spark, folder, "nnlearnerstatistics").select("rec_id", "current_tree").distinct()

    @F.pandas_udf("long")
    def count(trees):
        def one(text):
            try:
                tree, modules = network(text)
                return infer(tree, (28, 28, 1), modules)[1]
            except (ValueError, AttributeError):
                return None

        return trees.map(one).astype("Int64")

    return t.select("rec_id", count("current_tree").alias("n_params"))


def _fitted(call):
    def run(spark, folder):
        d = instances(spark, folder).withColumn("split", F.when(F.col("row_id") % 5 == 0, "test").otherwise("train"))
        out = G.run(call, d)
        return out.select("row_id", F.posexplode("features").alias("pos", "val")).withColumn("val", F.round("val", 5))

    return run


QUERIES |= {
    f"fit_{n}": _fitted(f"{n}(ARG0, {a})")
    for n, a in {"mySelKBest": 2, "mySelPercentile": 50, "mySelFpr": 0.05, "mySelFdr": 0.05, "mySelFwe": 0.05, "mySelGenUni": "1, 2", "myVarThresh": 1.5, "myPCA": 2, "mySparsePCA": 2, "myICA": 2, "mySpectralEmbedding": 2}.items()
}

_CELLS = f"SELECT id, t, unnest(range(1, 5)) AS k, unnest(x) AS v FROM {_ROWS}"
_KEPT = f"""WITH e AS ({_CELLS}), g AS (SELECT k, t, count(*) AS n, avg(v) AS m, var_pop(v) AS s FROM e WHERE id % 5 <> 0 GROUP BY k, t),
  f AS (SELECT g.k, sum(n * pow(m - mm, 2)) / sum(n * s) AS f, any_value(vv) AS vv FROM g JOIN (SELECT k, avg(v) AS mm, var_pop(v) AS vv FROM e WHERE id % 5 <> 0 GROUP BY k) a ON a.k = g.k GROUP BY g.k)
  SELECT e.id AS row_id, CAST(row_number() OVER (PARTITION BY e.id ORDER BY e.k) - 1 AS INT) AS pos, round(v, 5) AS val FROM e WHERE k IN ({{rule}})"""
SQL |= {f"fit_{n}": _KEPT.replace("{rule}", "SELECT k FROM f ORDER BY f DESC, k LIMIT 2") for n in ("mySelKBest", "mySelPercentile", "mySelGenUni")}
SQL["fit_myVarThresh"] = _KEPT.replace("{rule}", "SELECT k FROM f WHERE vv > 1.5")
