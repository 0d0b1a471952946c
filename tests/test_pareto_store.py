import math
import random

import numpy as np
import pytest

from arbora.operators import pareto as P
from arbora.operators import store as S

SCHEMA = "id long, f1 double, f2 double, f3 double, extra string"


def rows(n, seed):
    r = random.Random(seed)
    out = [(i, float(r.randrange(30)), float(r.randrange(30)), float(r.randrange(30)), "x") for i in range(n)]
    return out + [(900, float("inf"), 0.0, 0.0, None), (901, None, 0.0, 0.0, None), (902, float("nan"), 0.0, 0.0, None)] + out[:3]


def brute(rs, k):
    ok = [r for r in rs if all(v is not None and np.isfinite(v) for v in r[1 : 1 + k])]
    return sorted(r[0] for r in ok if not any(all(b <= a for a, b in zip(r[1 : 1 + k], q[1 : 1 + k])) and q[1 : 1 + k] != r[1 : 1 + k] for q in ok))


@pytest.mark.parametrize("block", [20_000, 7])
def test_front(spark, monkeypatch, block):
    monkeypatch.setattr(P, "BLOCK", block)
    rs = rows(200, 1)
    df = spark.createDataFrame(rs, SCHEMA).repartition(4)
    for k in (2, 3):
        names = ["f1", "f2", "f3"][:k]
        assert sorted(r["id"] for r in P.pareto_front(df, names).collect()) == brute(rs, k)
    assert sorted(r["id"] for r in P.front_2d(df, "f1", "f2").collect()) == brute(rs, 2)
    assert P.pareto_front(df.limit(0), ["f1", "f2"]).count() == 0


def test_hypervolume(spark):
    df = spark.createDataFrame([(1, 1.0, 3.0, 1.0, ""), (2, 2.0, 1.0, 1.0, ""), (3, 3.0, 3.0, 3.0, "")], SCHEMA)
    assert P.hypervolume(df, ["f1", "f2"], [4.0, 4.0]).first()[0] == pytest.approx(7)
    assert P.hypervolume(df, ["f1", "f2", "f3"], [4.0, 4.0, 4.0]).first()[0] == pytest.approx(21)


def test_selection(spark):
    rs = [r for r in rows(100, 2)[:100]]
    df = spark.createDataFrame(rs, SCHEMA)
    won = P.tournament(df, "id", ["f1", "f2"], 10, 3).collect()
    assert len(won) == 10
    best = min(r[1] for r in rs)
    assert all(dict(zip([r[0] for r in rs], rs))[x["id"]][1] >= best for x in P.lexicase(df, ["f1", "f2"], "id", 1).collect())
    assert P.z_score(df.limit(2), ["f1"]).first()[0] == 0.0
    f = P.ranks(df, "id", ["f1", "f2"], 2).collect()
    assert {r["id"] for r in f if r["front"] == 0} == set(brute(rs, 2))


def test_ranks_of_all_rows(spark):
    rs = rows(90, 4)
    df = spark.createDataFrame(rs, SCHEMA)
    finite = [r for r in rs if all(x is not None and abs(x) < float("inf") for x in r[1:3])]
    want, left = {}, finite
    while left:
        better = lambda a, b: a[1] <= b[1] and a[2] <= b[2] and a[1:3] != b[1:3]
        front = [r for r in left if not any(better(o, r) for o in left)]
        want |= dict.fromkeys([r[0] for r in front], max(want.values(), default=-1) + 1)
        left = [r for r in left if r[0] not in want]
    assert max(want.values()) > 5
    assert {r["id"]: r["front"] for r in P.ranks(df, "id", ["f1", "f2"]).collect()} == want
    one = {r["id"]: r["front"] for r in P.ranks(df.limit(20), "id", ["f1"]).collect()}
    assert len(one) == len([r for r in df.limit(20).collect() if r["f1"] is not None and abs(r["f1"]) < float("inf")])


def test_novelty(spark):
    r = np.random.default_rng(1)
    v = r.normal(size=(60, 4))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>").repartition(3)
    got = {x["q"]: x["m"] for x in P.novelty(df, "id", "v", 3).groupBy("q").agg(P.F.avg("d").alias("m")).collect()}
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    for i in range(60):
        assert got[i] == pytest.approx(np.sort(d[i])[:3].mean())


def first_by_distance_and_id(rows, q, k):
    """The definition: other rows in order of distance, summed column by column, and id."""
    far = []
    for i, v in rows:
        s = 0.0
        for a, b in zip(q[1], v):
            s += (a - b) * (a - b)
        far.append((math.sqrt(s), i))
    return sorted(x for x in far if x[1] != q[0])[:k]


@pytest.mark.parametrize("kind", ["lattice", "one point often", "far from zero", "long"])
def test_novelty_is_exact_in_cells_and_ties(spark, monkeypatch, kind):
    """Equally near rows are decided by id, however rows are spread over partitions, cells and buckets."""
    from arbora.operators import nearest as N

    monkeypatch.setattr(N, "CELL", 150)
    monkeypatch.setattr(N, "SAMPLE", 600)
    r = np.random.default_rng(3)
    n = 700
    v = {
        "lattice": lambda: r.integers(0, 4, (n, 3)),
        "one point often": lambda: np.where(r.random((n, 1)) < 0.8, 7, r.integers(0, 9, (n, 2))),
        "far from zero": lambda: 1e9 + r.integers(0, 9, (n, 2)) / 4,
        "long": lambda: r.normal(size=(n, 40)),
    }[kind]().astype(float)
    rows = [(int(i), x.tolist(), float(i % 7) if i % 11 else None) for i, x in zip(r.permutation(n), v)]
    odd = [(-1, None, 1.0), (-2, [math.nan] * v.shape[1], 1.0), (-3, [math.inf] * v.shape[1], 1.0)]
    df = spark.createDataFrame(rows + odd, "id long, v array<double>, t double").repartition(5)
    asked = spark.createDataFrame([x for x in rows if x[0] % 9 == 0] + odd + [(5000, [-50.0] * v.shape[1], 0.0)], df.schema)
    got = {}
    for x in P.novelty(df, "id", "v", 4, asked, "t").orderBy("q", "rk").collect():
        got.setdefault(x["q"], []).append((x["d"], x["o"]))
        assert x["t"] == (float(x["o"] % 7) if x["o"] % 11 else None)
    want = {x[0]: first_by_distance_and_id([y[:2] for y in rows], x, 4) for x in asked.where("id >= 0").collect()}
    assert got == want

    # The same in one cell, in buckets and with few distances held at once.
    monkeypatch.setattr(N, "BUCKET", 16)
    monkeypatch.setattr(N, "MATRIX", 500)
    ids, q = np.array([x[0] for x in rows]), np.flatnonzero([x[0] % 9 == 0 for x in rows])
    a, b, d = N.Cell(v, ids, 4).search(v[q], ids[q], np.full(len(q), np.inf))
    inside = {}
    for i, o, far in zip(ids[q[a]], ids[b], d):
        inside.setdefault(int(i), []).append((float(far), int(o)))
    assert {i: sorted(x) for i, x in inside.items()} == {i: want[i] for i in inside} and len(inside) == len(q)


def test_novelty_with_fewer_rows_than_neighbours(spark):
    df = spark.createDataFrame([(1, [0.0]), (2, [3.0])], "id long, v array<double>")
    assert [(x["q"], x["o"], x["d"]) for x in P.novelty(df, "id", "v", 5).orderBy("q").collect()] == [(1, 2, 3.0), (2, 1, 3.0)]
    assert P.novelty(df.where("id > 2"), "id", "v", 5, df).count() == 0 and P.novelty(df, "id", "v", 5, df.where("id > 2")).count() == 0


def entries(spark, n, seed):
    r = random.Random(seed)
    rs = [(f"e{i}", r.choice([5.0, 10.0, 20.0, 37.5, 400.0]), float(r.randrange(8))) for i in range(n)]
    return rs, spark.createDataFrame(rs, "id string, size_kb double, value double")


def test_eviction(spark):
    rs, df = entries(spark, 80, 5)
    left, want = 500.0, []
    for i, s, _ in sorted(rs, key=lambda x: (-x[2], x[0])):
        if s <= left:
            want.append(i)
            left -= s
    assert sorted(x["id"] for x in S.keep_greedy(df, 500.0).collect()) == sorted(want)
    used, want = 0.0, []
    for i, s, _ in sorted(rs, key=lambda x: (-x[2], x[0])):
        used += s
        if used <= 500.0:
            want.append(i)
    assert sorted(x["id"] for x in S.keep_prefix(df, 500.0).collect()) == sorted(want)
    assert S.keep_greedy(df.limit(0), 10.0).count() == 0


def test_knapsack(spark):
    import itertools

    rs, df = entries(spark, 12, 6)
    cap = 100.0
    best = max(sum(v for _, _, v in c) for k in range(13) for c in itertools.combinations(rs, k) if sum(s for _, s, _ in c) <= cap)
    got = S.knapsack(df, cap, bins=200).collect()
    assert sum(x["size_kb"] for x in got) <= cap and sum(x["value"] for x in got) == best


def test_knapsack_keeps_all_that_fit(spark):
    df = spark.createDataFrame([(i, 0.5, 1.0 + i % 7) for i in range(3000)] + [(3000, 0.0, 1.0), (3001, None, 1.0), (3002, 1.0, 0.0)], "id long, size_kb double, value double")
    assert {x["id"] for x in S.knapsack(df, 1500.0).collect()} == set(range(3001))


def test_knapsack_is_exact_beyond_the_core(spark):
    import random

    for seed, n, core in ((1, 1500, 10_000), (2, 1500, 4), (3, 400, 1), (4, 60, 2)):
        r = random.Random(seed)
        rs = [(i, r.randrange(1, 30), float(r.randrange(1, 60))) for i in range(n)]
        rs += [(n + i, 6, 18.0) for i in range(20)]  # many of one ratio
        cap = sum(s for _, s, _ in rs) // 3
        best = [0.0] * (cap + 1)
        for _, s, v in rs:
            for c in range(cap, s - 1, -1):
                best[c] = max(best[c], best[c - s] + v)
        got = S.knapsack(spark.createDataFrame([(i, float(s), v) for i, s, v in rs], "id long, size_kb double, value double"), float(cap), core=core).collect()
        assert len({x["id"] for x in got}) == len(got) and sum(x["size_kb"] for x in got) <= cap and sum(x["value"] for x in got) == best[cap]


def test_upsert_and_insert(spark):
    t = spark.createDataFrame([("a", 1, "x"), ("b", None, "y")], "k string, n int, s string")
    c = spark.createDataFrame([("a", 2, None, 9), ("a", 3, "z", 9), ("c", 5, "w", 9), ("b", 1, None, 9)], "k string, n int, s string, other int")
    assert sorted(tuple(r) for r in S.upsert(t, c, ["k"], add=["n"], put=["s"]).collect()) == [("a", 6, "z"), ("b", 1, "y"), ("c", 5, "w")]
    assert sorted(r["k"] for r in S.insert_missing(t, c.select("k"), ["k"]).collect()) == ["a", "b", "c"]


def test_welch(spark):
    a = spark.createDataFrame([(1, x) for x in (1.0, 2.0, 3.0, 4.0)], "g int, v double")
    b = spark.createDataFrame([(1, x) for x in (3.0, 5.0, 7.0, 9.0)], "g int, v double")
    r = S.welch(a, b, "g", "v").first()
    assert r["t"] == pytest.approx(-2.4248711305964283) and r["dof"] == pytest.approx(4.411764705882353) and r["p_value"] == pytest.approx(0.0665, abs=2e-3)


def test_layers(spark):
    t = spark.createDataFrame([(1, "A(B(ARG0), B(1))"), (2, None), (2, "")], "id int, tree string")
    assert {tuple(r) for r in S.layer_counts(t, ["id"], "tree").collect()} == {(1, "A", 1), (1, "B", 2)}
