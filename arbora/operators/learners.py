"""Learners: fit on the train split, predict on both, and append the prediction to the features."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml import classification as C
from pyspark.ml import clustering as K
from pyspark.ml import regression as R
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.operators.pareto import novelty
from arbora.staging import stage

SEED = 101
#: Rows of one step of the passive-aggressive learner.
MINI_BATCH = 16
_ROW = {"featuresCol": "__vec", "predictionCol": "prediction"}


def _supervised(make, **fixed):
    return lambda p: make(**_ROW, labelCol="target", **{**fixed, **p})


def _one_vs_rest(make, **fixed):
    return lambda p: C.OneVsRest(**_ROW, labelCol="target", classifier=make(featuresCol="__vec", labelCol="target", **{**fixed, **p}))


#: Learner name -> estimator from its parameters.
ESTIMATORS = {
    "SVM": _one_vs_rest(C.LinearSVC, maxIter=20),
    "BAYES": _supervised(C.NaiveBayes, modelType="gaussian"),
    "DECISION_TREE": _supervised(C.DecisionTreeClassifier, seed=SEED),
    "RAND_FOREST": _supervised(C.RandomForestClassifier, seed=SEED),
    "EXTRATREES": _supervised(C.RandomForestClassifier, seed=SEED, featureSubsetStrategy="onethird"),
    "BOOSTING": _one_vs_rest(C.GBTClassifier, maxIter=10, seed=SEED),
    "XGBOOST": _one_vs_rest(C.GBTClassifier, maxIter=10, stepSize=0.037, maxDepth=5, subsamplingRate=0.8, seed=SEED),
    "LIGHTGBM": _one_vs_rest(C.GBTClassifier, maxIter=10, maxDepth=6, seed=SEED),
    "LOGR": _supervised(C.LogisticRegression, maxIter=20),
    "SGD": _one_vs_rest(C.LinearSVC, maxIter=5),
    "KMEANS": lambda p: K.KMeans(**_ROW, **{"seed": SEED, **p}),
    "GMM": lambda p: K.GaussianMixture(**_ROW, seed=SEED, **p),
    "BISECTING": lambda p: K.BisectingKMeans(**_ROW, seed=SEED, **p),
    "BOOSTING_REGRESSION": _supervised(R.GBTRegressor, maxIter=10, seed=SEED),
    "RANDFOREST_REGRESSION": _supervised(R.RandomForestRegressor, seed=SEED),
    "DECISIONTREE_REGRESSION": _supervised(R.DecisionTreeRegressor, seed=SEED),
    "SVM_REGRESSION": _supervised(R.LinearRegression, loss="huber", maxIter=20),
    "LINEAR_REGRESSION": _supervised(R.LinearRegression, maxIter=20),
}


def _dnn(df: DataFrame, p: dict):
    first = df.select(F.size("features").alias("n")).first()
    classes = int(df.agg(F.max("target")).first()[0]) + 1
    return C.MultilayerPerceptronClassifier(**_ROW, labelCol="target", layers=[first["n"], *p.get("layers", [8]), max(2, classes)], maxIter=p.get("maxIter", 30), seed=SEED)


def fit(train: DataFrame, name: str, params: dict):
    t = train.withColumn("__vec", array_to_vector("features"))
    return (_dnn(train, params) if name == "DNN" else ESTIMATORS[name](params)).fit(t)


def learn(df: DataFrame, name: str, params: dict | None = None, ensemble: str = "SINGLE", bags: int = 3) -> DataFrame:
    """Rows (split, features, target and others) with ``prediction`` added and appended to the features.

    Train rows with a NULL target are not fitted. ``BAGGED`` averages (numbers) or votes (classes) over seeded samples of
    the train rows. Fewer than two distinct train targets are an error, except for clusterers.
    """
    params = params or {}
    if name in ("KNN", "KNN_REGRESSION"):
        return _appended(knn(df, int(params.get("k", 5)), name == "KNN_REGRESSION"))
    if name in _SOLVERS:
        return _appended(_SOLVERS[name](df, **params))
    if name in ("ARGMAX", "ARGMIN", "DEPTH_ESTIMATE"):
        x = F.col("features")
        rate = float(params.get("rate", 1.0))
        angle = float(params.get("off_nadir_angle", 20.0))
        bent = math.cos(math.asin(math.sin(math.radians(angle if angle > 0 else 20.0)) / 1.33))  # in water
        depth = F.when(F.size(x) < 2, -1.0).otherwise((F.element_at(x, -1) - F.element_at(x, 1)) / rate * bent)
        found = {"ARGMAX": (F.array_position(x, F.array_max(x)) - 1) / rate, "ARGMIN": (F.array_position(x, F.array_min(x)) - 1) / rate, "DEPTH_ESTIMATE": depth}[name]
        return _appended(df.withColumn("prediction", found.cast("double")))
    train = df.where((F.col("split") == "train") & F.col("target").isNotNull())
    if name not in ("KMEANS", "GMM", "BISECTING") and train.agg(F.min("target") == F.max("target")).first()[0] is not False:
        raise ValueError("fewer than two distinct training targets")
    if ensemble == "ADABOOST":
        return _appended(adaboost(df, name, params))
    if ensemble == "BAGGED":
        out = df.withColumn("__votes", F.array().cast("array<double>"))
        for b in range(bags):
            m = fit(train.sample(True, 1.0, SEED + b), name, params)
            out = _predict(m, out).withColumn("__votes", F.concat("__votes", F.array("prediction"))).drop("prediction")
        mean = F.aggregate("__votes", F.lit(0.0), lambda a, v: a + v) / bags
        return _appended(out.withColumn("prediction", mean if name.endswith("REGRESSION") else F.element_at(F.array_sort("__votes"), bags // 2 + 1)).drop("__votes"))
    return _appended(_predict(fit(train, name, params), df))


def _predict(model, df: DataFrame) -> DataFrame:
    out = model.transform(df.withColumn("__vec", array_to_vector("features")))
    return out.select(*df.columns, F.col("prediction").cast("double").alias("prediction"))


def _appended(df: DataFrame) -> DataFrame:
    return df.withColumn("features", F.concat("features", F.array("prediction")))


def adaboost(df: DataFrame, name: str, params: dict, rounds: int = 3) -> DataFrame:
    """Boosting of two or more classes by reweighted samples: rows the last learner got wrong weigh more."""
    out = df.withColumn("__w", F.lit(1.0)).withColumn("__score", F.create_map().cast("map<double,double>"))
    for b in range(rounds):
        train = out.where((F.col("split") == "train") & F.col("target").isNotNull())
        copies = train.where(F.rand(SEED + b) < F.least(F.col("__w"), F.lit(1.0)))
        m = fit(copies, name, params)
        out = stage(_predict(m, out), "boost")
        r = out.where("split = 'train'").agg((F.sum(F.when(F.col("prediction") != F.col("target"), F.col("__w")).otherwise(0.0)) / F.sum("__w")).alias("e")).first()
        e = min(max(r["e"] or 0.0, 1e-6), 0.999)
        vote = float(np.log((1 - e) / e)) + 1.0
        own = F.map_from_arrays(F.array("prediction"), F.array(F.lit(vote)))
        out = out.withColumn("__score", F.map_zip_with("__score", own, lambda k, a, c: F.coalesce(a, F.lit(0.0)) + F.coalesce(c, F.lit(0.0))))
        out = out.withColumn("__w", F.when(F.col("prediction") != F.col("target"), F.col("__w")).otherwise(F.col("__w") * e / (1 - e) + 0.05)).drop("prediction")
    best = F.aggregate(F.map_entries("__score"), F.struct(F.lit(None).cast("double").alias("key"), F.lit(-1e300).alias("value")), lambda a, x: F.when(x["value"] > a["value"], x).otherwise(a))
    return out.withColumn("prediction", best["key"]).drop("__w", "__score")


def knn(df: DataFrame, k: int, regression: bool = False) -> DataFrame:
    """Vote (ties: least class) or mean of the k nearest train rows, the least ids of equally near ones; a train row is not
    its own neighbour."""
    train = df.where((F.col("split") == "train") & F.col("target").isNotNull())
    t = novelty(train, "row_id", "features", k, df, "target")
    if regression:
        p = t.groupBy("q").agg(F.avg("target").alias("prediction"))
    else:
        v = t.groupBy("q", "target").agg(F.count("*").alias("n"))
        p = v.groupBy("q").agg(F.min_by("target", F.struct(-F.col("n"), F.col("target"))).cast("double").alias("prediction"))
    return df.join(p.withColumnRenamed("q", "row_id"), "row_id", "left")


def _gram(df: DataFrame, degree: int):
    """X'X and X'y of the train rows with a constant, summed over partitions; ``degree`` columns in all."""
    train = df.where((F.col("split") == "train") & F.col("target").isNotNull()).select("features", "target")
    width = degree + 1

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = np.zeros((width, width + 1))
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["features"].map(lambda v: np.asarray(v, float)).to_list())
                x = np.concatenate([np.ones((len(x), 1)), x], axis=1)
                g += x.T @ np.concatenate([x, pdf["target"].to_numpy(float)[:, None]], axis=1)
        yield pd.DataFrame({"i": np.repeat(np.arange(width), width + 1), "j": np.tile(np.arange(width + 1), width), "v": g.ravel()})

    out = np.zeros((width, width + 1))
    for r in train.mapInPandas(part, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[r["i"], r["j"]] = r["v"]
    return out[:, :-1], out[:, -1]


def _linear(df: DataFrame, w: np.ndarray) -> DataFrame:
    y = F.lit(float(w[0]))
    for i, c in enumerate(w[1:]):
        if c:
            y = y + F.element_at("features", i + 1) * float(c)
    return df.withColumn("prediction", y)


def omp(df: DataFrame, nonzero: int = 2) -> DataFrame:
    """Orthogonal matching pursuit on the Gram matrix: one pass over the rows."""
    n = df.select(F.size("features").alias("n")).first()["n"]
    g, b = _gram(df, n)
    pick, w = [0], np.zeros(n + 1)
    for _ in range(min(int(nonzero), n) + 1):
        w = np.zeros(n + 1)
        w[pick] = np.linalg.lstsq(g[np.ix_(pick, pick)], b[pick], rcond=None)[0]
        left = np.abs(b - g @ w) / np.sqrt(np.maximum(np.diag(g), 1e-12))
        left[pick] = -1
        if len(pick) > nonzero:
            break
        pick.append(int(left.argmax()))
    return _linear(df, w)


def gaussian_process(df: DataFrame, centres: int = 200, gamma: float = 1.0, noise: float = 0.1) -> DataFrame:
    """Best linear unbiased prediction with an RBF kernel on a bounded set of centres: a documented sample of train rows;
    the normal equations are summed over all train rows."""
    train = df.where((F.col("split") == "train") & F.col("target").isNotNull())
    at = np.stack([np.asarray(r[0], float) for r in train.select("features").orderBy(F.xxhash64("row_id")).limit(centres).collect()])
    scale = at.std(axis=0) + 1e-9
    shared = df.sparkSession.sparkContext.broadcast((at / scale, scale))

    @F.pandas_udf("array<double>")
    def phi(x: pd.Series) -> pd.Series:
        c, s = shared.value
        if not len(x):
            return pd.Series([], dtype=object)
        v = np.stack(x.map(lambda r: np.asarray(r, float)).to_list()) / s
        d = np.exp(-gamma / c.shape[1] * np.maximum((v**2).sum(1)[:, None] + (c**2).sum(1)[None] - 2 * v @ c.T, 0))
        return pd.Series(list(d))

    z = df.withColumn("__raw", F.col("features")).withColumn("features", phi("features"))
    g, b = _gram(z, len(at))
    w = np.linalg.solve(g + noise * np.eye(len(g)), b)
    out = df.sparkSession.sparkContext.broadcast(w)

    @F.pandas_udf("double")
    def dot(x: pd.Series) -> pd.Series:
        return x.map(lambda v: float(out.value[0] + np.dot(out.value[1:], v)))

    return z.withColumn("prediction", dot("features")).withColumn("features", F.col("__raw")).drop("__raw")


def passive_aggressive(df: DataFrame, c: float = 1.0, epochs: int = 2) -> DataFrame:
    """Averaged passive-aggressive weights: each partition learns on its own rows, the mean is the start of the next
    epoch. Two classes: target 0 against the rest."""
    train = df.where((F.col("split") == "train") & F.col("target").isNotNull()).select("features", "target")
    n = df.select(F.size("features").alias("n")).first()["n"]
    w = np.zeros(n + 1)
    for _ in range(int(epochs)):
        start = df.sparkSession.sparkContext.broadcast(w)

        def part(batches: Iterator[pd.DataFrame], start=start) -> Iterator[pd.DataFrame]:
            v, seen = start.value.copy(), 0
            for pdf in batches:
                # A step per mini-batch, the mean of its rows' steps.
                for lo in range(0, len(pdf), MINI_BATCH):
                    part = pdf.iloc[lo : lo + MINI_BATCH]
                    x = np.column_stack([np.ones(len(part)), np.stack(part["features"].map(lambda f: np.asarray(f, float)).to_list())])
                    y = np.where(part["target"].to_numpy() != 0, 1.0, -1.0)
                    step = np.minimum(c, np.maximum(0.0, 1 - y * (x @ v)) / (x**2).sum(axis=1)) * y
                    v, seen = v + step @ x / len(x), seen + len(x)
            yield pd.DataFrame({"i": np.arange(len(v)), "v": v * seen, "n": np.full(len(v), seen)})

        for r in train.mapInPandas(part, "i int, v double, n long").groupBy("i").agg((F.sum("v") / F.greatest(F.sum("n"), F.lit(1))).alias("v")).collect():
            w[r["i"]] = r["v"]
    return _linear(df, w).withColumn("prediction", F.when(F.col("prediction") > 0, 1.0).otherwise(0.0))


def adaboost_regression(df: DataFrame, rounds: int = 3, **params) -> DataFrame:
    """Sum of small trees, each fitted to what the ones before left over."""
    out = df.withColumn("__y", F.col("target")).withColumn("__sum", F.lit(0.0))
    for _ in range(int(rounds)):
        m = fit(out.where((F.col("split") == "train") & F.col("__y").isNotNull()).withColumn("target", F.col("__y") - F.col("__sum")), "DECISIONTREE_REGRESSION", params)
        out = stage(_predict(m, out).withColumn("__sum", F.col("__sum") + 0.5 * F.col("prediction")).drop("prediction"), "boost")
    return out.withColumn("prediction", F.col("__sum")).drop("__y", "__sum")


_SOLVERS = {"OMP": omp, "BLUP": gaussian_process, "PASSIVE": passive_aggressive, "ADABOOST_REGRESSION": adaboost_regression}
LEARNERS = sorted([*ESTIMATORS, *_SOLVERS, "DNN", "KNN", "KNN_REGRESSION", "ARGMAX", "ARGMIN", "DEPTH_ESTIMATE"])
