from datetime import datetime, timedelta

from arbora.operators import reports as R

T0 = datetime(2031, 3, 3)
PEOPLE = "hash string, age double, evaluation_status string, evaluation_gen int, reviews_error_rate double, reviews_num_params double, tree string, recorded_at timestamp_ntz, purged_at timestamp_ntz"
FRONT = "id long, optimization int, generation int, hash string"
CACHE = "id string, host_id string, dirty int, size_kb double, num_reads int, num_writes int, read_time double, write_time double, recorded_at timestamp_ntz"
METHODS = "id string, host_id string, num_eval int, error int, eval_time double, recorded_at timestamp_ntz"
LINKS = "rec_id long, method_id string, cache_id string"


def calls(p, f, c, m, l):
    return [
        R.lookup(p, "hash", "a"), R.status_counts(p), R.count_status(p, "EVALUATED"), R.random_unevaluated(p, 2, 7), R.last_front(p, f), R.front_members(p, f, 0), R.sizes(f), R.absent(c), R.cache_sizes(c), R.cache_hits(c),
        R.host_statistics(c, m), R.keys_per_day(c), R.methods_with_entries(m, l, c), R.double_links(l), R.running_time(m), R.generation_statistics(f, p), R.front_sizes(f, f), R.with_primitive(p, "f(", "f"), R.best(p, 2),
        R.mean_and_variance(p, "evaluation_gen", "reviews_error_rate"), R.cumulative_fronts(f), R.front_ages(f, p), R.same_text(p), R.breadth(p),
    ]


def test_empty_and_null_tables(spark):
    schemas = (PEOPLE, FRONT, CACHE, METHODS, LINKS)
    counts = [d.count() for d in calls(*[spark.createDataFrame([], s) for s in schemas])]
    assert counts == [0, 0, 1] + [0] * 21
    for d in calls(*[spark.createDataFrame([(None,) * (s.count(",") + 1)], s) for s in schemas]):
        d.count()


def test_by_hand(spark):
    inf = float("inf")
    people = spark.createDataFrame([(" A", 1.0, "EVALUATED", 0, 0.5, 3.0, "F(x)", T0, None), (" A", 1.0, "EVALUATED", 0, 0.5, 3.0, "F(x)", T0, None), ("b", 2.0, "NOT_EVALUATED", 0, inf, None, "f(X)", T0, T0), ("c", 1.0, "NOT_EVALUATED", 1, 0.1, 1.0, None, T0, None)], PEOPLE)
    p = R.records(people, *people.columns, key="hash")
    assert p.count() == 3 and R.lookup(p, "hash", "a").first()["n_rows"] == 1
    assert {r["evaluation_status"]: r["n"] for r in R.status_counts(p).collect()} == {"EVALUATED": 1, "NOT_EVALUATED": 1}
    assert sorted(r["hash"] for r in R.random_unevaluated(p, 5, 7).collect()) == ["b", "c"]
    assert [r["hash"] for r in R.best(p, 9).collect()] == ["c", "a"]
    assert sorted(r["hash"] for r in R.with_primitive(p, "f(x", "f").collect()) == ["a", "b"]
    fronts = spark.createDataFrame([(1, 0, 0, "a"), (2, 0, 2, "a"), (3, 0, 2, "c"), (4, 1, 0, "b")], FRONT)
    assert [r["hash"] for r in R.last_front(p, fronts).collect()] == ["b"]
    assert {r["generation"]: r["n"] for r in R.cumulative_fronts(fronts).collect()} == {0: 2, 2: 3}
    links = spark.createDataFrame([(1, "m", "x"), (2, "m", "X "), (3, "m", "y"), (4, "n", "x"), (5, "n", " ")], LINKS)
    assert [tuple(r) for r in R.double_links(links).collect()] == [("m", 2)]
    m = spark.createDataFrame([("m", "h", 1, 0, 1.0, T0), ("n", "h", 1, 0, inf, T0), ("o", "h", 1, 0, 2.0, T0 + timedelta(hours=1)), ("q", "h", 1, 0, 4.0, T0 + timedelta(days=1))], METHODS)
    assert sorted(r["running"] for r in R.running_time(m).collect()) == [1.0, 3.0, 4.0]
