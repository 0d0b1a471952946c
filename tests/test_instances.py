import pytest

from arbora.operators import instances as I
from arbora.operators.instances import F
from arbora.plans.program import parse

SCHEMA = "row_id long, features array<double>, stream array<double>, target double, split string"


def test_rows_columns_and_targets(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], [4.0], 0.0, "train"), (2, [3.0], [8.0], 1.0, "train"), (3, None, None, 5.0, "test"), (4, [], [2.0], 2.0, "train")], SCHEMA)
    assert {r["row_id"]: r["value"] for r in I.feature(df, 1).collect()} == {1: 2.0, 2: None, 3: None, 4: None}
    assert I.observation(df, 2).first()["features"] == [3.0] and I.observation(df, 9).count() == 0
    assert {r["row_id"]: r["encoded"] for r in I.encoded_targets(df).collect()} == {1: [1, 0, 0], 2: [0, 1, 0], 3: [0, 0, 0], 4: [0, 0, 1]}
    assert {r["row_id"]: r["encoded"] for r in I.encoded_targets(df.where("row_id <> 4")).collect()} == {1: [0.0], 2: [1.0], 3: [5.0]}
    assert {r["row_id"]: r["stream"] for r in I.scaled_by_train(df).collect()} == {1: [0.5], 2: [1.0], 3: None, 4: [0.25]}
    assert I.checked_targets(df).count() == 4
    for few in (df.where("row_id = 1"), df.limit(0)):
        with pytest.raises(ValueError):
            I.checked_targets(few)


def test_crops_and_windows(spark):
    df = spark.createDataFrame([(1, [float(i) for i in range(12)]), (2, None)], "row_id long, x array<double>")
    got = df.select(I.cropped("x", 4, 1, 2, 5, 5).alias("c"), I.window_values("x", 4, 0, 0, 3, 1).alias("w")).collect()
    assert got[0]["c"] == [6.0, 7.0, 10.0, 11.0] and got[1]["c"] is None
    assert got[0]["w"] == [0.0, 0.0, 1.0, 0.0, 1.0, 4.0, 4.0, 5.0]
    assert {(r["r"], r["c"]) for r in I.target_points(df, "x", 4, 9.5).collect()} == {(2, 2), (2, 3)}


def test_word_vectors(spark, tmp_path):
    (tmp_path / "v.txt").write_text("2 2\nsun 1 2\nMoon 3 4\nbad x 1\nMARS 5 6\n")
    t = I.vector_file(spark, str(tmp_path / "v.txt"))
    assert sorted(r["term"] for r in t.collect()) == ["MARS", "Moon", "sun"]
    vocab = spark.createDataFrame([(1, "sun"), (2, "moon"), (3, "mars"), (4, "SUN"), (5, "void")], "idx long, term string")
    got = {r["term"]: r["vector"] for r in I.embedding_matrix(vocab, t, t.where("term = 'sun'")).collect()}
    assert got == {"sun": [1, 2, 1, 2], "moon": [3, 4, 0, 0], "mars": [5, 6, 0, 0], "SUN": [1, 2, 1, 2], "void": [0, 0, 0, 0]}
    terms = spark.createDataFrame([(1, "sun"), (1, "sun"), (1, "Moon"), (2, "void")], "id long, term string")
    mean = {(r["id"], r["dim"]): r["value"] for r in I.text_vectors(terms, t).collect()}
    assert mean == {(1, 0): pytest.approx(5 / 3), (1, 1): pytest.approx(8 / 3)}


def test_offspring_do_not_depend_on_partitions(spark):
    rows = [(f"p{i:02d}", f"MyAverager(Sine(ARG0), {i})" if i % 2 else f"MySum(MyDiff(Cosine(ARG0)), {i}.5)") for i in range(30)] + [("bad", "F(("), ("none", None), (None, "F(ARG0)")]
    df = spark.createDataFrame(rows, "id string, tree string")
    rates = {"crossover": 0.6, "constants": 0.5, "terminal": 0.5, "shrink": 0.2, "swap": 0.2, "remove": 0.2, "insert": 0.2}
    runs = [sorted(map(tuple, I.varied(df.repartition(n), "id", "tree", rates, 5).select("id", F.coalesce("child", F.lit("")), "made_by").collect())) for n in (1, 5)]
    assert runs[0] == runs[1] and len(runs[0]) == 32
    got = {r[0]: r for r in runs[0]}
    assert got["bad"] == ("bad", "F((", "") and got["none"][1] == ""
    assert all(str(parse(c)) for i, c, m in runs[0] if m) and sum(bool(m) for _, _, m in runs[0]) > 15
    assert sorted(map(tuple, I.varied(df, "id", "tree", {}, 5).where("id like 'p%'").select("id", "child").collect())) == sorted(rows[:30])
    assert I.varied(df.limit(0), "id", "tree", rates).count() == 0
