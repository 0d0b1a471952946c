import math
import random

import numpy as np
import pytest

from arbora.operators import pareto as P
from arbora.operators import selection as S


def population(n, seed, tie=8):
    r = random.Random(seed)
    return [(f"p{i:03d}", float(r.randrange(tie)), float(r.randrange(tie)), r.random()) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id string, f1 double, f2 double, f3 double").repartition(3)


def crowd(rows, cols):
    out = dict.fromkeys([r[0] for r in rows], 0.0)
    for c in cols:
        s = sorted(rows, key=lambda r: (r[c], r[0]))
        span = s[-1][c] - s[0][c]
        for i, r in enumerate(s):
            ends = i in (0, len(s) - 1)
            out[r[0]] += math.inf if ends else ((s[i + 1][c] - s[i - 1][c]) / span if span else 0.0)
    return out


def fronts(rows, cols):
    rest, out, k = list(rows), {}, 0
    wins = lambda a, b: all(a[c] <= b[c] for c in cols) and any(a[c] < b[c] for c in cols)
    while rest:
        top = [a for a in rest if not any(wins(b, a) for b in rest)]
        out.update({a[0]: k for a in top})
        rest, k = [a for a in rest if a not in top], k + 1
    return out


@pytest.mark.parametrize("tie", [3, 1000])
def test_crowding_against_brute_force(spark, tie):
    rows = population(60, 1, tie)
    got = {r["id"]: r["crowding"] for r in S.crowding(frame(spark, rows + rows[:4]), "id", ["f1", "f2"]).collect()}
    want = crowd(rows, (1, 2))
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    assert S.crowding(frame(spark, rows).limit(0), "id", ["f1"]).count() == 0
    assert S.crowding(frame(spark, rows[:1]), "id", ["f1"]).first()["crowding"] == math.inf


@pytest.mark.parametrize("names, cols", [(["f1", "f2"], (1, 2)), (["f1", "f2", "f3"], (1, 2, 3))])
def test_nsga2_takes_whole_fronts_then_crowding(spark, names, cols):
    rows = population(50, 2)
    bad = [("nan", float("nan"), 0.0, 0.0), ("inf", float("inf"), 0.0, 0.0), ("null", None, 0.0, 0.0)]
    got = {r["id"]: r["front"] for r in S.nsga2(frame(spark, rows + bad), "id", names, 17).collect()}
    f = fronts(rows, cols)
    last = sorted(f.values())[16]
    dist = crowd([r for r in rows if f[r[0]] == last], cols)
    inner = {k for k, v in f.items() if v < last}
    edge = sorted(dist, key=lambda k: (-dist[k], k))[: 17 - len(inner)]
    assert got == {k: f[k] for k in inner | set(edge)}
    assert S.nsga2(frame(spark, rows), "id", names, 500).count() == 50
    assert S.nsga2(frame(spark, rows).limit(0), "id", names, 5).count() == 0


def test_large_fronts_meet_block_by_block(spark, monkeypatch):
    monkeypatch.setattr(P, "BLOCK", 8)
    r = random.Random(3)
    line = [(f"p{i:03d}", float(i), float(60 - i), 0.0) for i in range(60)]
    rows = line + [(f"q{i:03d}", r.random() * 60 + 1, 60.0, 1.0) for i in range(30)]
    want = sorted(k for k, v in fronts(rows, (1, 2, 3)).items() if v == 0)
    assert sorted(x["id"] for x in P.pareto_front(frame(spark, rows), ["f1", "f2", "f3"]).collect()) == want


def test_draws_follow_weights(spark):
    df = spark.createDataFrame([("hot", 6.0), ("a", 2.0), ("b", 1.0), ("c", 1.0), ("never", 0.0)], "id string, w double")
    got = [r["id"] for r in S.draws(df, "w", 4000, 5).collect()]
    assert len(got) == 4000 and "never" not in got
    for name, share in (("hot", 0.6), ("a", 0.2), ("b", 0.1), ("c", 0.1)):
        assert abs(got.count(name) / 4000 - share) < 0.03
    assert sorted(got) == sorted(r["id"] for r in S.draws(df.repartition(4), "w", 4000, 5).collect())
    assert S.draws(df.where("w = 0"), "w", 10, 5).count() == 0


def test_weighted_tournament(spark):
    rows = population(40, 4, 1000)
    df = frame(spark, rows)
    got = S.weighted_tournament(df, "id", ["f1", "f2"], 30, [100.0, 100.0], [10.0, 10.0], 50.0, 3).collect()
    assert sorted(r["place"] for r in got) == list(range(30)) and {r["id"] for r in got} <= {r[0] for r in rows}
    f = fronts(rows, (1, 2))
    assert np.mean([f[r["id"]] for r in got]) < np.mean(list(f.values()))
    w = {r["id"]: r["weight"] for r in S.mating_weights(df, ["f1", "f2"], [100.0, 100.0], [10.0, 10.0], 2.0).collect()}
    for i, a, b, _ in rows:
        miss = lambda g: math.hypot(max(a - g, 0), max(b - g, 0))
        assert w[i] == pytest.approx(1 / (1 + 2 * miss(100) + miss(10)))


def test_spread_apart(spark):
    points = np.array([[0.0, 0], [0.1, 0], [5, 5], [5.1, 5], [9, 0]])
    assert S.spread_apart(points, 3).tolist() == [0, 2, 4] and len(S.spread_apart(points, 9)) == 0 and len(S.spread_apart(points, 5)) == 5
    line = [(f"p{i:02d}", float(i), float(20 - i), 0.0) for i in range(21)] + [("in", 30.0, 30.0, 0.0)]
    got = [r["id"] for r in S.max_distance_nsga(frame(spark, line), "id", ["f1", "f2"], 3).collect()]
    assert sorted(got) == ["p00", "p10", "p20"] or len(got) == 3
    assert {r["id"] for r in S.max_distance_nsga(frame(spark, line), "id", ["f1", "f2"], 22).collect()} == {r[0] for r in line}


def test_distances_against_brute_force(spark):
    rows = population(60, 6, 1000) + [("x", None, 1.0, 0.0), ("y", float("inf"), 1.0, 0.0)]
    ok = [r for r in rows if r[1] is not None and math.isfinite(r[1])]
    gap = lambda a, b: math.hypot(a[1] - b[1], a[2] - b[2])
    pairs = {(a[0], b[0]): gap(a, b) for a in ok for b in ok if a[0] < b[0]}
    got = {(r["a"], r["b"]): r["dist"] for r in S.near_pairs(frame(spark, rows), "id", ["f1", "f2"], 80.0).collect()}
    assert got.keys() == {k for k, v in pairs.items() if v <= 80}
    assert S.least_distance(frame(spark, rows), "id", ["f1", "f2"]).first()[0] == pytest.approx(min(pairs.values()))
    twin = [("t1", 3.0, 3.0, 0.0), ("t2", 3.0, 3.0, 0.0), ("t3", 3.0, 4.5, 0.0)]
    assert S.least_distance(frame(spark, twin), "id", ["f1", "f2"]).first()[0] == 0.0
    assert S.least_distance(frame(spark, twin), "id", ["f1", "f2"], nonzero=True).first()[0] == 1.5
    assert S.least_distance(frame(spark, twin[:1]), "id", ["f1", "f2"]).first()[0] == 0.0


def test_fuzzy_selection(spark):
    cov = np.array([[0.04, 0.01], [0.01, 0.09]])
    s = S.truncated_normals(np.array([0.5, 0.2]), cov, 3000, np.zeros(2), np.ones(2), 1)
    assert s.min() >= 0 and s.max() <= 1 and abs(s[:, 0].mean() - 0.5) < 0.03 and s[:, 1].mean() > 0.2
    x = np.random.default_rng(2).normal(size=(400, 3)) @ np.diag([1.0, 2.0, 3.0])
    assert np.abs(S.shrunk_covariance(x) - np.diag([1.0, 4.0, 9.0])).max() < 1.5
    r = random.Random(8)
    rows = [(f"p{i}", [min(1.0, max(0.0, 0.1 * i + r.gauss(0, 0.05))) for _ in range(12)], [min(1.0, max(0.0, 0.1 * i + r.gauss(0, 0.05))) for _ in range(6)]) for i in range(6)]
    df = spark.createDataFrame(rows, "id string, a array<double>, b array<double>")
    share = {x["id"]: x["share"] for x in S.fuzzy_shares(df, "id", ["a", "b"], [0.0, 0.0], [1.0, 1.0], 400).collect()}
    assert sum(share.values()) == pytest.approx(1) and share["p0"] > share["p2"] >= share["p5"]
    assert S.fuzzy_select(df, "id", ["a", "b"], [0.0, 0.0], [1.0, 1.0], 9, 80).count() == 9


def test_similar_and_gene_pool(spark):
    rows = [("a", 100.0, 0.0, 0.0), ("b", 100.5, 0.0, 0.0), ("c", 120.0, 0.0, 0.0), ("d", -100.4, 0.0, 0.0), ("e", -100.0, 0.0, 0.0)]
    got = {r["id"]: r["first"] for r in S.similar(frame(spark, rows), "id", ["f1", "f2"], 1.0).collect()}
    assert got == {"a": "a", "b": "a", "c": "c", "d": "d", "e": "d"}
    pool = S.gene_pool(frame(spark, population(40, 9)), "id", ["f1", "f2"], [(1, 3), (2, 5)], 4).collect()
    assert {(r["n_in_range"] > 1) == (r["kind"] == "well_rounded") for r in pool} == {True} and len(pool) <= 8
