import math

import numpy as np
import pytest

import arbora.functions.vector  # noqa: F401
from arbora.functions.registry import OPS, find
from arbora.operators import dataset as D

X = np.array([0.5, -1.5, 2.5, 0.0, 3.5, -0.25, 1.0, 1.0])
N, I = len(X), np.arange(len(X))
Y = X[::-1]

WANT = {
    "AbsoluteValue": np.abs(X), "Exponetial": np.exp(X), "Sine": np.sin(X), "Cosine": np.cos(X), "Tangent": np.tan(X), "ArcTangent": np.arctan(X), "Round": np.round(X),
    "DataAddFloat": X + 2.5, "DataSubtractInt": X - 2, "DataMultiplyFloat": X * 2.5, "DataDivideInt": X / 2, "Fraction": X / 2, "DataIntegerDivide": X // 0.3,
    "WindowHann": X * np.hanning(N), "WindowBartlett": X * np.bartlett(N), "WindowBlackman": X * np.blackman(N), "WindowCosine": X * np.sin(math.pi * I / (N - 1)), "WindowLanczos": X * np.sinc(2 * I / (N - 1) - 1),
    "Rebase": X - X.min(), "ZeroOneNorm": (X - X.min()) / np.ptp(X), "StandardNorm": (X - X.mean()) / X.std(), "MatchedFiltering": np.full(N, X.mean()),
    "MyBinaryThreshold": (X >= 1.2e-9) * 1.0, "ThresholdToZeroFloat": np.where(X < 0.5, 0, X), "MySum": [X.sum()], "MyProd": [X.prod()], "MyNorm": [np.linalg.norm(X)],
    "MyDiff": np.convolve(X, [1, -1], "same"), "MyAverager": np.convolve(X, np.ones(5) / 5, "same"), "MyAutoCorr": np.fft.ifft(np.abs(np.fft.fft(X)) ** 2).real, "RemoveFeature": np.delete(X, 1), "SelectRange": X[3:20],
    "nlargest": np.unique(X)[::-1][:5], "ArgMax": [X.argmax()], "MinLoc": [X.argmin()], "ScalarMax": np.maximum(X, 1),
}
WANT2 = {"DataAddPair": X + Y, "DataMultiplyPair": X * Y, "Cv2GreaterThan": (X > Y) * 255.0, "Cv2Max": np.maximum(X, Y), "SubtractSaturate": np.maximum(X - Y, 0), "CrossCorrelation": np.fft.ifft(np.conj(np.fft.fft(X)) * np.fft.fft(Y)).real}


def test_native_operators_against_numpy(spark):
    df = spark.createDataFrame([(X.tolist(), Y.tolist())], "x array<double>, y array<double>")
    cols = {**{k: 1 for k in WANT}, **{k: 2 for k in WANT2}}
    row = df.selectExpr(*[f"{OPS[n].native(['x', 'y'][:k], OPS[n].params)} AS `{n}`" for n, k in cols.items()]).first()
    for n, v in {**WANT, **WANT2}.items():
        np.testing.assert_allclose(row[n], v, atol=1e-9, err_msg=n)


def test_division_by_zero_logs_and_guards(spark):
    df = spark.createDataFrame([([0.0, 2.0, -2.0], [0.0, 0.0, 0.0])], "x array<double>, y array<double>")
    big = 1.7976931348623157e308
    r = df.selectExpr(f"{OPS['DataDividePair'].native(['x', 'y'], {})} AS d", f"{OPS['Log'].native(['x'], {})} AS l", f"{OPS['ZeroOneNorm'].native(['y'], {})} AS z").first()
    assert r["d"] == [0.0, big, -big] and r["l"] == [-big, math.log(2), 0.0] and r["z"] == [0.0, 0.0, 0.0]


SCHEMA = "row_id long, features array<double>, stream array<double>, tag string"


@pytest.fixture(scope="module")
def data(spark):
    return spark.createDataFrame([(1, [1.0, 2.0], [3.0, 4.0], "a"), (2, [], None, "b"), (3, [5.0], [6.0], None), (3, None, [], "c")], SCHEMA)


def test_modes_nulls_and_empties(spark, data):
    got = {(r["row_id"], r["tag"]): r for r in D.apply("DataAddInt", [data], D.F2F, 1).collect()}
    assert got[1, "a"]["features"] == [2.0, 3.0] and got[2, "b"]["features"] == [] and got[3, "c"]["features"] is None
    got = {(r["row_id"], r["tag"]): r["features"] for r in D.apply("MySum", [data], D.S2F).collect()}
    assert got[1, "a"] == [1.0, 2.0, 7.0] and got[2, "b"] == []
    assert D.apply("DataAddInt", [data.limit(0)], D.F2F, 1).count() == 0
    k = {(r["row_id"], r["tag"]): r["features"] for r in D.apply("MyCumSum", [data], D.F2F).collect()}
    assert k[1, "a"] == [1.0, 3.0] and k[2, "b"] == [] and k[3, "c"] is None


def test_pairs_slices_labels(spark, data):
    one = data.where("row_id = 1")
    assert D.apply("DataAddPair", [one, one], D.F2F).first()["features"] == [2.0, 4.0]
    assert D.if_then_else(one, one, D.apply("DataAddInt", [one], D.F2F, 1), 0).first()["features"] == [1.0, 2.0]
    assert [r["values"] for r in D.slices(data, 1, 1).where("row_id = 1").collect()] == [[3.0], [4.0]]
    lab = spark.createDataFrame([(0, 7.0), (1, 8.0), (2, 9.0)], "pos long, label double")
    inst = data.where("tag in ('a', 'b') or tag is null").select("row_id", "features")
    assert {r["row_id"]: r["target"] for r in D.map_labels(inst, lab).collect()} == {1: [7.0, 8.0], 3: [9.0]}
    with pytest.raises(ValueError):
        D.apply("DataAddPair", [one], D.F2F)
    assert find("XyzDataAddPair").name == "DataAddPair"
    with pytest.raises(KeyError):
        find("Nothing")
