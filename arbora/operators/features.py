"""Column scores and selection, decomposition, and encodings of targets, from aggregates in one pass over the rows."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def anova_f(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """(column, f): one-way F of each column over the classes, from sums per class. NULL where nothing varies within
    classes, as for a constant column."""
    long = df.select(F.col(label).alias("l"), F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x")).select("l", "x.column", "x.v").where("v is not null")
    g = long.groupBy("column", "l").agg(F.count("*").alias("n"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"))
    t = g.groupBy("column").agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b"))
    between = F.col("b") - F.col("s") * F.col("s") / F.col("n")
    within = F.col("q") - F.col("b")
    ratio = F.try_divide(F.try_divide(between, F.col("k") - 1), F.try_divide(within, F.col("n") - F.col("k")))
    return t.select("column", ratio.alias("f"))


def chi2(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """(column, chi2): of non-negative columns as frequencies against the classes."""
    long = df.select(F.col(label).alias("l"), F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x")).select("l", "x.column", "x.v")
    g = long.groupBy("column", "l").agg(F.count("*").alias("n"), F.sum("v").alias("o"))
    t = g.groupBy("column").agg(F.sum("n").alias("tn"), F.sum("o").alias("to"))
    e = F.try_divide(F.col("to") * F.col("n"), F.col("tn"))
    return g.join(t, "column").groupBy("column").agg(F.sum(F.try_divide((F.col("o") - e) ** 2, e)).alias("chi2"))


def regression_f(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """(column, f): F of the correlation with a numeric target."""
    r = df.agg(F.count("*").alias("n"), *[F.corr(c, target).alias(f"r{i}") for i, c in enumerate(columns)])
    long = r.select("n", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"r{i}").alias("r")) for i, c in enumerate(columns)])).alias("x")).select("n", "x.*")
    return long.select("column", (F.try_divide(F.col("r") ** 2, 1 - F.col("r") ** 2) * (F.col("n") - 2)).alias("f"))


def variances(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, variance) by population."""
    v = df.agg(*[F.var_pop(c).alias(f"v{i}") for i, c in enumerate(columns)])
    return v.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"v{i}").alias("variance")) for i, c in enumerate(columns)])).alias("x")).select("x.*")


def select(df: DataFrame, columns: list[str], label: str, mode: str = "k_best", param: float = 2) -> list[str]:
    """Columns kept by F against the classes: the best ``k``, a top percentile, or by p value (``fpr``, ``fdr``, ``fwe``)."""
    rows = anova_f(df, columns, label).collect()
    f = {r["column"]: r["f"] or 0.0 for r in rows}
    ranked = sorted(columns, key=lambda c: (-f.get(c, 0.0), columns.index(c)))
    if mode == "k_best":
        return [c for c in columns if c in ranked[: int(param)]]
    if mode == "percentile":
        return [c for c in columns if c in ranked[: max(1, round(len(columns) * param / 100))]]
    k = df.select(label).distinct().count()
    n = df.count()
    p = {c: f_tail(f.get(c, 0.0), k - 1, n - k) for c in columns}
    if mode == "fpr":
        return [c for c in columns if p[c] < param]
    if mode == "fwe":
        return [c for c in columns if p[c] < param / len(columns)]
    if mode == "fdr":
        order = sorted(columns, key=p.get)
        last = max((i for i, c in enumerate(order) if p[c] <= param * (i + 1) / len(order)), default=-1)
        return [c for c in columns if c in order[: last + 1]]
    raise ValueError(mode)


MODES = ["percentile", "k_best", "fpr", "fdr", "fwe"]


def f_tail(f: float, a: float, b: float) -> float:
    """Chance of a greater F with a and b degrees of freedom, by the incomplete beta function."""
    if f <= 0 or a <= 0 or b <= 0:
        return 1.0
    x, p, q = b / (b + a * f), b / 2, a / 2
    if x > (p + 1) / (p + q + 2):
        return 1 - _beta(1 - x, q, p)
    return _beta(x, p, q)


def _beta(x: float, a: float, b: float) -> float:
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(max(x, 1e-300)) + b * math.log1p(-x)) / a
    total, term, n = 1.0, 1.0, 0
    while abs(term) > 1e-15 * total and n < 100_000:
        term *= (a + b + n) * x / (a + 1 + n)
        total += term
        n += 1
    return front * total


def centred(df: DataFrame, columns: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """Mean, sample covariance and number of rows, in one pass."""
    aggs = [F.count("*").alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)]]
    aggs += [F.covar_samp(a, b).alias(f"c{i}_{j}") for i, a in enumerate(columns) for j, b in enumerate(columns) if j >= i]
    r = df.agg(*aggs).first()
    k = len(columns)
    return np.array([r[f"m{i}"] for i in range(k)], float), np.array([[r[f"c{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)], float), r["n"]


def project(df: DataFrame, columns: list[str], mean: np.ndarray, basis: np.ndarray, prefix: str = "pc") -> DataFrame:
    """``df`` with (x - mean) @ basis in new columns; stays in the JVM."""
    for j in range(basis.shape[1]):
        v = F.lit(0.0)
        for i, c in enumerate(columns):
            v = v + (F.col(c) - float(mean[i])) * float(basis[i, j])
        df = df.withColumn(f"{prefix}{j}", v)
    return df


def pca(df: DataFrame, columns: list[str], k: int, whiten: bool = False) -> DataFrame:
    mean, cov, _ = centred(df, columns)
    value, vector = np.linalg.eigh(cov)
    order = np.argsort(value)[::-1][:k]
    basis = vector[:, order] * np.sign(vector[np.abs(vector[:, order]).argmax(axis=0), order])
    return project(df, columns, mean, basis / np.sqrt(np.maximum(value[order], 1e-12)) if whiten else basis)


def sparse_pca(df: DataFrame, columns: list[str], k: int, alpha: float = 0.1, rounds: int = 100) -> DataFrame:
    """Leading directions of the covariance with small loadings set to zero, found one after the other."""
    mean, cov, _ = centred(df, columns)
    basis = []
    for _ in range(k):
        v = np.linalg.eigh(cov)[1][:, -1]
        for _ in range(rounds):
            u = cov @ v
            u = np.sign(u) * np.maximum(np.abs(u) - alpha * np.abs(u).max(), 0)
            v = u / (np.linalg.norm(u) or 1.0)
        basis.append(v)
        cov = cov - (v @ cov @ v) * np.outer(v, v)
    return project(df, columns, mean, np.stack(basis, axis=1))


def ica(df: DataFrame, columns: list[str], k: int, rounds: int = 15, seed: int = 7) -> DataFrame:
    """Independent components: whitened rows, fixed-point iterations with kurtosis; each round is one aggregate pass."""
    mean, cov, _ = centred(df, columns)
    value, vector = np.linalg.eigh(cov)
    order = np.argsort(value)[::-1][:k]
    white = vector[:, order] / np.sqrt(np.maximum(value[order], 1e-12))
    z = project(df, columns, mean, white, "__z")
    w = np.linalg.qr(np.random.default_rng(seed).normal(size=(k, k)))[0]
    for _ in range(rounds):
        aggs = []
        for a in range(k):
            y = sum((F.col(f"__z{i}") * float(w[a, i]) for i in range(k)), F.lit(0.0))
            aggs += [F.avg(F.col(f"__z{i}") * y * y * y).alias(f"g{a}_{i}") for i in range(k)]
        r = z.agg(*aggs).first()
        new = np.array([[r[f"g{a}_{i}"] for i in range(k)] for a in range(k)]) - 3 * w
        u, _, vt = np.linalg.svd(new)
        new = u @ vt
        moved = np.abs(np.abs((new * w).sum(axis=1)) - 1).max()
        w = new
        if moved < 1e-6:
            break
    return project(df, columns, mean, white @ w.T, "ic")


def one_hot(df: DataFrame, column: str, output: str = "one_hot", most: int = 10_000) -> DataFrame:
    """Target as an array of 0 and 1 over the sorted classes; more than ``most`` classes are an error."""
    classes = [r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column).limit(most + 1).collect()]
    if len(classes) > most:
        raise ValueError(f"more than {most} classes")
    return df.withColumn(output, F.array(*[F.coalesce((F.col(column) == c).cast("int"), F.lit(0)) for c in classes]))


def vector_columns(df: DataFrame, vector: str, size: int, prefix: str = "f") -> DataFrame:
    a = vector_to_array(vector) if dict(df.dtypes)[vector] == "vector" else F.col(vector)
    return df.select("*", *[a[i].cast("double").alias(f"{prefix}{i}") for i in range(size)])


#: Landmarks of the spectral embedding: a sample of train rows, bounded by this number whatever the size of the data.
LANDMARKS = 300


def spectral_embedding(df: DataFrame, columns: list[str], k: int, train: str = "true", gamma: float = 1.0) -> DataFrame:
    """Leading eigenvectors of a similarity graph over a bounded sample of rows, carried to every row by its similarity
    to that sample (Nystroem). Rows are embedded one by one in Arrow batches."""
    at = np.array(df.where(train).orderBy(F.xxhash64(*columns)).select(*columns).limit(LANDMARKS).collect(), float)
    scale = at.std(axis=0) + 1e-9
    c = at / scale
    a = np.exp(-gamma / len(columns) * ((c[:, None] - c[None]) ** 2).sum(axis=2))
    d = a.sum(axis=1)
    value, vector = np.linalg.eigh(a / np.sqrt(d[:, None] * d[None]))
    pick = np.argsort(value)[::-1][1 : k + 1]
    basis = vector[:, pick] / value[pick] / np.sqrt(d)[:, None]
    shared = df.sparkSession.sparkContext.broadcast((c, scale, basis))

    @F.pandas_udf("array<double>")
    def embed(rows: pd.Series) -> pd.Series:
        c, scale, basis = shared.value
        if not len(rows):
            return pd.Series([], dtype=object)
        x = np.stack(rows.map(lambda v: np.asarray(v, float)).to_list()) / scale
        w = np.exp(-gamma / x.shape[1] * np.maximum((x**2).sum(1)[:, None] + (c**2).sum(1)[None] - 2 * x @ c.T, 0))
        return pd.Series(list(w / np.sqrt(np.maximum(w.sum(axis=1, keepdims=True), 1e-12)) @ basis))

    return df.withColumn("__e", embed(F.array(*[F.col(c).cast("double") for c in columns]))).select("*", *[F.col("__e")[j].alias(f"se{j}") for j in range(k)]).drop("__e")


_SELECT = {"mySelKBest": "k_best", "mySelPercentile": "percentile", "mySelFpr": "fpr", "mySelFdr": "fdr", "mySelFwe": "fwe"}
_PROJECT = {"myPCA": pca, "mySparsePCA": sparse_pca, "myICA": ica}
FIT_NAMES = [*_SELECT, "mySelGenUni", "myVarThresh", *_PROJECT, "mySpectralEmbedding"]


def fit_transform(df: DataFrame, name: str, *args) -> DataFrame:
    """An operator that is fitted on the train rows and changes the features of all rows (row_id, split, features,
    target). All rows must have as many features; a column kept or made is one feature of the result."""
    width = df.select(F.size("features").alias("n")).first()
    if width is None or width["n"] < 1:
        return df
    cols = [f"__f{i}" for i in range(width["n"])]
    wide = df.select("*", *[F.col("features")[i].alias(c) for i, c in enumerate(cols)])
    train = wide.where((F.col("split") == "train") & F.col("target").isNotNull())
    if name == "mySelGenUni":
        name, args = {v: k for k, v in _SELECT.items()}[MODES[int(args[0]) % len(MODES)]], args[1:]
    if name in _SELECT:
        kept = select(train, cols, "target", _SELECT[name], float(args[-1]) if args else 2)
        return wide.withColumn("features", F.array(*[F.col(c) for c in kept])).drop(*cols)
    if name == "myVarThresh":
        least = float(args[0]) if args else 0.0
        kept = sorted((r["column"] for r in variances(train, cols).collect() if r["variance"] is not None and r["variance"] > least), key=cols.index)
        return wide.withColumn("features", F.array(*[F.col(c) for c in kept])).drop(*cols)
    k = max(1, min(int(args[0]) if args else 2, len(cols)))
    if name == "mySpectralEmbedding":
        out = spectral_embedding(wide, cols, k, "split = 'train'")
    else:
        out = _PROJECT[name](wide, cols, k)
    new = [c for c in out.columns if c not in wide.columns]
    return out.withColumn("features", F.array(*[F.col(c) for c in new])).drop(*cols, *new)
