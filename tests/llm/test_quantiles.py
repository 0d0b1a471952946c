import math
import random
from datetime import date, datetime, timedelta

import pytest

from arbora.llm import quantiles as Q

DAY = date(2031, 3, 3)
SCHEMA = "host string, x double, y double, at timestamp_ntz, field string, b int"


def made(n, seed):
    r = random.Random(seed)
    rows = []
    for _ in range(n):
        host = r.choice(["hot"] * 6 + ["a", "b", None])
        x = r.choice([r.lognormvariate(0, 3), -r.random(), 0.0, 1.5, None, float("nan"), float("inf"), -float("inf"), 1e-12])
        at = None if r.random() < 0.02 else datetime(2031, 3, 3) + timedelta(hours=r.randrange(0, 24 * 12))
        rows.append((host, x, float(r.randrange(5)), at, "f", 1))
    return rows


def brute(rows, col, q, first, last):
    groups = {}
    for r in rows:
        v = r[col]
        if r[3] and first <= r[3].date() <= last and v is not None and math.isfinite(v):
            groups.setdefault(r[0], []).append(v)
    return {g: (sorted(v)[max(1, math.ceil(round(q * len(v), 9))) - 1], len(v)) for g, v in groups.items()}


@pytest.mark.parametrize("rows_broadcast", [100_000, 1])
def test_against_brute_force(spark, monkeypatch, rows_broadcast):
    monkeypatch.setattr(Q, "BROADCAST_ROWS", rows_broadcast)
    rows = made(2500, 1)
    half = [spark.createDataFrame(part, SCHEMA) for part in (rows[:1000], rows[1000:])]
    partials = Q.combine(*[Q.day_partials(d, "host", ["x", "y"], "at") for d in half])
    spans = [("all", DAY, DAY + timedelta(20)), ("some", DAY + timedelta(2), DAY + timedelta(5)), ("one", DAY, DAY), ("none", DAY - timedelta(9), DAY - timedelta(8))]
    qs = [0.0, 0.1, 0.5, 0.99, 1.0]
    got = Q.percentiles(partials, spans, qs).withColumn("value", Q.bucket_value(Q.F.col("bucket"))).collect()
    seen = {(r["grp"], r["field"], r["span"], r["q"]): (r["value"], r["n"]) for r in got}
    assert len(seen) == len(got)
    want = {(g, f, s, q): v for c, f in ((1, "x"), (2, "y")) for s, a, z in spans for q in qs for g, v in brute(rows, c, q, a, z).items()}
    assert seen.keys() == want.keys()
    for k, (v, n) in want.items():
        assert seen[k][1] == n
        assert abs(seen[k][0] - v) <= 1.01 * Q.EPS * abs(v) + Q.MIN, (k, v, seen[k])
    assert min(r["rounds"] for r in got) >= 1 and max(r["rounds"] for r in got) > 3


def test_empty(spark):
    p = Q.day_partials(spark.createDataFrame([], SCHEMA), "host", ["x"], "at")
    assert Q.percentiles(p, [("all", DAY, DAY)], [0.5]).count() == 0
