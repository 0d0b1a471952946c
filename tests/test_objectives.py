import random

import pytest

from arbora.operators import objectives as V


def frame(spark, rows):
    return spark.createDataFrame([(float(a) if a is not None else None, float(b) if b is not None else None) for a, b in rows], "p double, t double")


def test_golden_counts(spark):
    ones = frame(spark, [(1, 0)] * 5)
    r = V.evaluate(ones, ["false_positive", "false_negative", "false_positive_rate"]).first()
    assert tuple(r) == (5, 0, 1)
    r = V.evaluate(frame(spark, [(0, 1)] * 5), ["false_negative", "false_negative_rate", "objective0EvalFunction"]).first()
    assert tuple(r) == (5, 1, 1)
    r = V.evaluate(frame(spark, [(1, 1), (0, 0)]), ["objective0EvalFunction", "accuracy_score", "f1_score_min", "overall_standard_deviation"]).first()
    assert tuple(r) == (0, 0, 0, 0)


def test_every_objective_on_empty(spark):
    assert V.evaluate(frame(spark, []), list(V.OBJECTIVES)).count() == 1


def test_auc_and_precision_with_ties(spark):
    r = random.Random(4)
    rows = [(r.randrange(6), r.randrange(2)) for _ in range(120)] + [(None, 1), (2, None)]
    ok = [(p, t) for p, t in rows if p is not None and t is not None]
    pos, neg = [p for p, t in ok if t == 1], [p for p, t in ok if t != 1]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    assert V.roc_auc(frame(spark, rows)).first()[0] == pytest.approx(want)
    ap = sum(sum(1 for q in pos if q >= p) / sum(1 for q, _ in ok if q >= p) for p in pos) / len(pos)
    assert V.average_precision(frame(spark, rows)).first()[0] == pytest.approx(ap)
    assert V.roc_auc(frame(spark, [(1, 1)])).first()[0] is None


def test_partitions_and_assignment(spark):
    assert V.assignment([[4, 1, 3], [2, 0, 5], [3, 2, 2]]) == 5
    assert V.partition_distance(frame(spark, [(0, 5), (0, 5), (1, 6), (1, 5)])) == 1
    assert V.partition_distance(frame(spark, [])) == 0
    r = V.cluster_errors(frame(spark, [(0, 0), (0, 1), (1, 1)])).first()
    assert tuple(r) == pytest.approx((1 / 3, 1 / 3))


def test_centroids(spark):
    schema = "img long, id int, r double, c double"
    d = spark.createDataFrame([(1, 1, 0.0, 0.0), (1, 2, 50.0, 50.0), (2, 1, 1.0, 1.0)], schema)
    t = spark.createDataFrame([(1, 1, 3.0, 0.0), (3, 1, 0.0, 0.0)], schema)
    got = {x["img"]: tuple(x)[1:] for x in V.centroid_counts(d, t).collect()}
    assert got == {1: (1, 0, 3.0), 2: (1, 0, None), 3: (0, 1, None)}
    assert [tuple(x) for x in V.matched_distance(d, t).collect()] == [(1, 3.0, 1)]


def test_running_sums(spark):
    df = spark.range(500).selectExpr("id * 1.0 as s", "id % 7 as v")
    got = {r["s"]: r["b"] for r in V.running_sums(df, V.F.col("s"), {"b": V.F.col("v")}, blocks=9).collect()}
    total = 0
    for i in range(500):
        assert got[float(i)] == total
        total += i % 7


def test_macro_scores_and_trivial_predictions(spark):
    rows = [(0, 0), (0, 1), (1, 1), (2, 1), (2, 2), (2, 2)]
    r = V.macro_scores(spark.createDataFrame([(float(p), float(t)) for p, t in rows] + [(None, 1.0)], "p double, t double")).first()
    assert r["precision_min"] == pytest.approx(1 - (1 / 2 + 1 + 2 / 3) / 3) and r["recall_min"] == pytest.approx(1 - (1 + 1 / 3 + 1) / 3)
    df = spark.createDataFrame([([1, 0], [1, 0]), ([0, 0], [1, 0])], "p array<int>, t array<int>")
    assert V.multilabel_error(df, fail_trivial=True).first()[0] == 0.5
    assert V.multilabel_error(df.where("p[0] = 0"), fail_trivial=True).first()[0] == float("inf")
    assert V.multilabel_error(df.limit(0), fail_trivial=True).first()[0] is None


def test_targets_no_detection_confirms_twice(spark):
    near = spark.createDataFrame([(1, 1, 0.0, 0.0), (1, 2, 10.0, 0.0), (2, 1, 5.0, 5.0), (3, 1, 1.0, 1.0)], "img long, id int, r double, c double")
    goals = spark.createDataFrame([(1, 1, 0.0, 1.0), (1, 2, 0.0, 2.0), (1, 3, 10.0, 1.0), (2, 1, 50.0, 5.0), (4, 1, 1.0, 1.0)], "img long, id int, r double, c double")
    # Image 1: both targets at the first detection, which confirms one and is used up; image 2: too far; 4: no detection.
    assert {r["img"]: r["n_false_negative"] for r in V.unmatched_targets(near, goals).collect()} == {1: 1, 2: 1, 4: 1}


def test_program_measures_agree_with_the_parser(spark):
    from arbora.plans.program import parse

    texts = ["F(G(ARG0, 1), ARG0)", "ARG0", "F(ARG0)\nmod_1: G(H(ARG0))", "F(G(H(ARG0, 2)), G(ARG0))"]
    got = {r["tree"]: r for r in V.program_measures(spark.createDataFrame([(t,) for t in texts] + [(None,)], "tree string")).collect()}
    for t in texts:
        n = parse(t.split("\n")[0])
        assert got[t]["height"] == n.height and got[t]["n_inputs"] == str(n).count("ARG0")
        assert got[t]["depth_breadth"] == pytest.approx(n.height - got[t]["n_inputs"] / (3**n.height + 1)) and got[t]["capped_elements"] == 1707
    assert got[texts[2]]["n_trees"] == 2 and got[None]["height"] is None and got[None]["capped_elements"] is None
