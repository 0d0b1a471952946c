import random
from datetime import datetime, timedelta

from arbora.operators import orphans as O

T0 = datetime(2031, 3, 3)
REFS, TARGETS = "n int, ref string, ts timestamp_ntz, k string, day string", "id string, recorded_at timestamp_ntz, purged_at timestamp_ntz, delta int"


def norm(s):
    return (s or "").strip().lower() or None


def brute(refs, targets):
    out = []
    for r in refs:
        if (k := norm(r[1])) is None:
            continue
        if r[2] is None or not any(norm(t[0]) == k and t[1] is not None and t[1] <= r[2] and (t[2] is None or t[2] > r[2]) for t in targets):
            out.append(r)
    return out


def made(seed, n):
    r = random.Random(seed)
    at = lambda: T0 + timedelta(minutes=r.randrange(0, 6000, 7)) if r.random() < 0.97 else None
    name = lambda: r.choice([None, "", " ", "A", " a\t", "b", "B ", "c", "d\xa0", "hot", "HOT", "hot", "hot"])
    refs = [(i, name(), at(), "x", None) for i in range(n)]
    targets = [(name(), s, r.choice([None, at(), s]), 1) for _ in range(40) for s in [at()]]
    return refs + refs[:5], targets + targets[:6]


def test_against_brute_force(spark):
    for seed in range(3):
        refs, targets = made(seed, 200)
        got = O.orphans(spark.createDataFrame(refs, REFS), spark.createDataFrame(targets, TARGETS)).collect()
        assert sorted(x["n"] for x in got) == sorted(x[0] for x in brute(refs, targets))
        assert set(got[0].asDict()) == {"n", "ref", "ts", "k", "day"}


def test_empty(spark):
    refs, targets = made(1, 20)
    none_r, none_t = spark.createDataFrame([], REFS), spark.createDataFrame([], TARGETS)
    assert O.orphans(none_r, spark.createDataFrame(targets, TARGETS)).count() == 0
    assert O.orphans(spark.createDataFrame(refs, REFS), none_t).count() == sum(norm(r[1]) is not None for r in refs)


def test_short_slots(spark, monkeypatch):
    """Slots get shorter where a key has many steps; the rows found stay the same."""
    monkeypatch.setattr(O, "MOST_STEPS", 2)
    refs, targets = made(7, 200)
    targets += [("hot", T0 + timedelta(seconds=i), T0 + timedelta(seconds=i, microseconds=500_000), 1) for i in range(100)]
    refs += [(1000 + i, "hot", T0 + timedelta(seconds=i / 4), "", "") for i in range(400)]
    made_t = spark.createDataFrame(targets, TARGETS)
    assert O.slot_width(O.existence_deltas(made_t)) == 1_000_000
    got = O.orphans(spark.createDataFrame(refs, REFS), made_t).collect()
    assert sorted(x["n"] for x in got) == sorted(x[0] for x in brute(refs, targets))


def test_state_and_deltas_equal_recompute(spark):
    schema = REFS + ", gone timestamp_ntz"
    later = lambda r, t: t and (t + timedelta(minutes=r.randrange(1, 900)) if r.random() < 0.4 else None)
    refs, targets = made(9, 300)
    r = random.Random(1)
    refs = [(*x, later(r, x[2])) for x in refs]
    deltas = O.reference_deltas(spark.createDataFrame(refs, schema), until="gone").unionByName(O.existence_deltas(spark.createDataFrame(targets, TARGETS)))
    deltas = deltas.withColumn("ts", O.F.coalesce("ts", O.F.lit(T0).cast("timestamp_ntz")))
    whole = sorted(map(tuple, O.state(deltas).collect()))
    first, second = T0 + timedelta(minutes=1500), T0 + timedelta(minutes=4000)
    s = O.state(deltas.where(O.F.col("ts") >= second))
    s = O.merged(s, deltas.where(O.F.col("ts") < first))
    s = O.merged(s, deltas.where((O.F.col("ts") >= first) & (O.F.col("ts") < second)))
    assert sorted(map(tuple, s.collect())) == whole
    counts = {}
    for x in refs:
        if k := norm(x[1]):
            counts.setdefault(k, [0, 0])[0] += x[5] is None
    for t in targets:
        if (k := norm(t[0])) and t[1] is not None and t[2] is None:
            counts.setdefault(k, [0, 0])[1] += 1
    assert {k: [a, b] for k, a, b in whole} == {k: v for k, v in counts.items() if v != [0, 0]}
    assert {x["k"] for x in O.current(s).collect()} == {k for k, (a, b) in counts.items() if a > 0 and b == 0}


def test_retracted_reference_is_no_orphan(spark):
    refs = [(1, "a", T0, "", "", T0 + timedelta(1)), (2, "b", T0, "", "", None), (3, "c", T0, "", "", T0)]
    d = O.reference_deltas(spark.createDataFrame(refs, REFS + ", gone timestamp_ntz"), until="gone")
    assert [tuple(x) for x in O.current(O.state(d)).collect()] == [("b", 1, 0)]
