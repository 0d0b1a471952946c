import gzip

import numpy as np
import pytest

from arbora.operators import text as W
from arbora.plans import program as G
from arbora.plans import variation as M
from arbora.plans.layers import infer
from arbora.sources import loaders as R
from arbora.sources.sinks import cached, fold_hash, plan_key


def test_parse_and_hash():
    t = G.parse("Learner( F(ARG0,1, 2.5) , LearnerType('SVM', {'C': 1}), EnsembleType('SINGLE'))")
    assert str(G.parse(str(t))) == str(t) and t.height == 2 and len(G.program_hash(t)) == 64
    for bad in ("F(", "F(A", "F)", "F(A) B", "", "F(A,,B)"):
        with pytest.raises(ValueError):
            G.parse(bad)


def test_run_program(spark):
    d = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, [4.0, 5.0, 6.0])], "row_id long, features array<double>").selectExpr("*", "features as stream")
    out = G.run("DataAddPair(mod_1, DataAddInt(ARG0, 1))", d, {"mod_1": "DataMultiplyInt(ARG0, 2)"})
    assert {r["row_id"]: r["features"] for r in out.collect()} == {1: [4.0, 7.0, 10.0], 2: [13.0, 16.0, 19.0]}
    f = G.folds(d, 3)
    assert f.count() == 6 and f.where("split = 'test'").count() == 2
    assert [r["ok"] for r in G.flagged(G.run("ArcSine(ARG0)", d)).collect()] == [False, False]
    with pytest.raises(KeyError):
        G.run("Unknown(ARG0)", d)


def test_chain_is_one_projection(spark):
    d = spark.range(3).selectExpr("id as row_id", "array(1D, 2D) as features", "array(1D) as stream")
    plan = G.run("Sine(DataAddInt(Rebase(ARG0), 1))", d)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_variation_keeps_programs_readable():
    a, b = G.parse("F(G(ARG0, 1), H(ARG0, 2.5), 3)"), G.parse("K(L(M(ARG0), 7), 8)")
    for s in range(20):
        for t in (*M.crossover(a, b, s), *M.crossover(a, b, s, whole=False), *M.swap_constants(a, b, s), M.mutate_terminal(a, s), M.insert(a, "N", s), M.remove(b, s), M.swap(a, ["X", "Y"], s), M.shrink(a, s), M.grow({"F": 1, "G": 3}, 4, s)):
            assert str(G.parse(str(t))) == str(t)
        assert [str(x) for x in M.crossover(a, b, s)] == [str(x) for x in M.crossover(a, b, s)]


def test_layer_shapes():
    assert infer(G.parse("OutputLayer(DenseLayer(10, InputLayer(ARG0)))"), (4,)) == ((10,), 50)
    assert infer(G.parse("GlobalMaxLayer(MaxPoolLayer(2, ConvLayer(3, InputLayer(ARG0))))"), (8, 8, 1)) == ((3,), 30)


def test_layer_modules(spark, tmp_path):
    from arbora.queries.programs import QUERIES

    dense = lambda *a: f"DenseLayer({', '.join(map(str, a))})"
    trees = [
        f"OutputLayer({dense(10, 'InputLayer(ARG0)')})",  # (1 + 1) * 10
        f"OutputLayer({dense(10, 'mod_1', 'InputLayer(ARG0)')})\nmod_1: {dense(5, 'InputLayer(ARG0)')}",  # and (1 + 1) * 5
        f"OutputLayer(\n    {dense(10, 'mod_1')})\r\nmod_1: DenseLayer(5,\n    mod_2)\nmod_2: {dense(3, 'ARG0')}",  # 2 * 3 + 4 * 5 + 6 * 10
        f"{dense(10, 'mod_2(mod_2(InputLayer(ARG0)))')}\nmod_2: {dense(3, 'ARG0')}",  # 2 * 3 + 4 * 3 + 4 * 10
        f"{dense(10, 'mod_7', 'InputLayer(ARG0)')}\nmod_1: {dense(5, 'ARG0')}",  # an unknown module, an unused one
        f"{dense(10, 'mod_1')}\nmod_1: {dense(5, 'mod_2')}\nmod_2: {dense(5, 'mod_1')}",
    ]
    spark.createDataFrame(list(enumerate(trees)), "rec_id long, current_tree string").write.parquet(str(tmp_path / "nnlearnerstatistics.parquet"))
    got = {r["rec_id"]: r["n_params"] for r in QUERIES["layers_parameters"](spark, str(tmp_path)).collect()}
    assert got == {0: 20, 1: 30, 2: 86, 3: 58, 4: 20, 5: None}


def test_text_queries_do_the_whole_operator(spark, tmp_path):
    from arbora.operators import text as W
    from arbora.queries.texts import QUERIES

    texts = ["The queue moved the queue. The learner split the queue. A front moved at night. The learner moved at night.", "A front split the module. The module moved. The queue split the front.", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    want = {(r["doc_id"], r["pos"]): round(r["rank"], 6) for r in W.text_rank(df, "doc_id", "text", 10).collect()}
    assert {(r["doc_id"], r["pos"]): r["rank"] for r in QUERIES["text_rank"](spark, str(tmp_path)).collect()} == want
    assert want != {(r["doc_id"], r["pos"]): round(r["rank"], 6) for r in W.text_rank(df, "doc_id", "text", 3).collect()}
    vectors = {}
    for r in QUERIES["text_word_vectors"](spark, str(tmp_path)).collect():
        vectors.setdefault(r["doc_id"], {})[r["dim"]] = r["value"]
    assert all(sorted(v) == list(range(16)) for v in vectors.values()) and len(vectors) == 3
    assert all(abs(sum(x * x for x in vectors[i].values()) - 1) < 1e-2 for i in (0, 1))


def write(path, text, zipped=False):
    (gzip.open(path, "wt") if zipped else open(path, "w")).write(text)
    return str(path)


def test_loaders(spark, tmp_path):
    p = write(tmp_path / "f.csv", "#h\n1,2,0\n3,4,1\n")
    assert sorted((r["features"], r["target"]) for r in R.features_csv(spark, p).collect()) == [([1.0, 2.0], 0.0), ([3.0, 4.0], 1.0)]
    with gzip.open(tmp_path / "g.csv.gz", "wt") as f:
        f.write("#h\n1,2,0\n")
    assert R.features_csv(spark, str(tmp_path / "g.csv.gz")).first()["features"] == [1.0, 2.0]
    p = write(tmp_path / "t.csv", 'text,a,b\n"x, ""y""\nz",1,0\n')
    r = R.text_csv(spark, p, 2).first()
    assert r["text"] == 'x, "y"\nz' and r["target"] == [1.0, 0.0]
    p = write(tmp_path / "s.csv", "text,v\nhello,[1 2.5]\n")
    assert R.summaries_csv(spark, p).first()["target"] == [1.0, 2.5]
    p = write(tmp_path / "m.csv", "N=2\n0,1,2,1,3,4,9\n")
    r = R.many_to_one(spark, p).first()
    assert r["stream"] == [[1.0, 3.0], [2.0, 4.0]] and r["target"] == [9.0]
    p = write(tmp_path / "mm.csv", "0,1,1,2\n0,5,1,6\n")
    r = R.many_to_many(spark, p).first()
    assert r["stream"] == [[1.0, 2.0]] and r["target"] == [5.0, 6.0]
    p = write(tmp_path / "ms.csv", "2,1\n1,2,3,4\n7,8\n")
    r = R.many_to_some(spark, p, 2, 1).first()
    assert r["stream"] == [[1.0, 2.0], [3.0, 4.0]] and r["target"] == [[7.0], [8.0]]
    p = write(tmp_path / "i.csv", "2,2,1\n1,2,3,4\n0,1\n")
    r = R.images_csv(spark, p, 2, 2).first()
    assert r["image"]["data"] == [1.0, 2.0, 3.0, 4.0] and r["target"][0]["c"] == 1.0
    p = write(tmp_path / "w.txt", "ab 12 \ncd  x \n")
    assert [tuple(r) for r in R.fixed_width(spark, p, [("a", 3, "string"), ("n", 3, "int")]).collect()] == [("ab", 12), ("cd", None)]
    p = write(tmp_path / "c.csv", "a,b\n 1 , x \n")
    assert tuple(R.trimmed_csv(spark, p).first()) == ("1", "x")
    p = write(tmp_path / "p.txt", "# c\nF(ARG0)\nmod_1: G(ARG0) # d\n")
    assert [tuple(r) for r in R.programs(spark, p).collect()] == [(None, "F(ARG0)"), ("mod_1", "G(ARG0)")]
    p = write(tmp_path / "l.txt", "start\nGeneration 1\nx\nGeneration 2\n")
    assert [r["generation"] for r in R.run_log(spark, p).orderBy("line").collect()] == [None, 1, 1, 2]
    np.savez(tmp_path / "z.npz", x=np.ones((2, 3)), y=np.zeros(2))
    assert R.npz(spark, str(tmp_path / "z.npz")).count() == 2
    (tmp_path / "img").mkdir()
    (tmp_path / "img/a.bin").write_bytes(b"1")
    (tmp_path / "img/b.bin").write_bytes(b"2")
    lab = write(tmp_path / "labels.csv", "0\n1\n")
    assert {r["path"][-5:]: r["target"] for r in R.image_directory(spark, str(tmp_path / "img"), lab).collect()} == {"a.bin": [0.0], "b.bin": [1.0]}


def test_cache_and_hash(spark):
    d = spark.range(5).selectExpr("id", "id * 2 as v")
    assert plan_key(d) == plan_key(spark.range(5).selectExpr("id", "id * 2 as v"))
    assert cached(d).count() == 5 and cached(d).count() == 5
    assert fold_hash(d).first() == fold_hash(d.repartition(3)).first()


def test_cache_tells_folders_apart(spark, tmp_path):
    for name, n in (("a", 3), ("b", 7)):
        spark.range(n).write.parquet(str(tmp_path / name))
    read = lambda name: spark.read.parquet(str(tmp_path / name)).where("id >= 0")
    assert cached(read("a")).count() == 3 and cached(read("b")).count() == 7 and cached(read("a")).count() == 3
    before = plan_key(read("a"))
    spark.range(5).write.mode("overwrite").parquet(str(tmp_path / "a"))
    assert plan_key(read("a")) != before and cached(read("a")).count() == 5
    assert plan_key(spark.createDataFrame([(1,)], "id long")) is None


def test_text(spark):
    for w, s in {"caresses": "caress", "ponies": "poni", "hopping": "hop", "relational": "relat", "adjustable": "adjust", "controlling": "control", "sky": "sky"}.items():
        assert W.stem(w) == s
    d = spark.createDataFrame([(1, "The cat saw the dog. The dog ran!"), (2, None), (3, "")], "id int, text string")
    assert {(r["term"], r["n"]) for r in W.count_vectors(d, "id", "text").collect()} == {("the", 3), ("cat", 1), ("saw", 1), ("dog", 2), ("ran", 1)}
    assert {r["term"] for r in W.count_vectors(d, "id", "text", start=1, end=1).where("n = 2").collect()} == {"the dog"}
    assert {r["id"]: r["ids"] for r in W.sequences(d, "id", "text", 2, 4).collect()} == {1: [1, 2, 1, 2], 2: [0] * 4, 3: [0] * 4}
    assert sum(r["weight"] ** 2 for r in W.tfidf(d, "id", "text").collect()) == pytest.approx(1)
    assert sum(r["value"] ** 2 for r in W.hashing_vectors(d, "id", "text").collect()) == pytest.approx(1)
    assert {r["id"]: r["stemmed"] for r in W.stemmed(d, "text", 1).collect()}[2] is None


def test_streaming_equals_batch(spark, tmp_path):
    from arbora.streaming import events as E

    ev = spark.range(200).selectExpr("id % 3 as user_id", "timestamp_seconds(id * 60) as ts", "concat('t', id % 2) as event_type", "cast(id as double) as value")
    ev.repartition(4).write.parquet(str(tmp_path / "ev"))
    s = E.read_events(spark, str(tmp_path / "ev"), ev.schema)
    q = E.hopping(s, "30 minutes", "15 minutes").writeStream.outputMode("complete").format("memory").queryName("hop").start()
    q.processAllAvailable()
    q.stop()
    key = lambda df: sorted((str(r["start"]), r["event_type"], r["n"], r["total"]) for r in df.collect())
    assert key(spark.table("hop")) == key(E.hopping(ev, "30 minutes", "15 minutes"))
    q = E.running_mean(s, 5).writeStream.outputMode("update").format("memory").queryName("mean").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("mean").select("user_id").distinct().count() == 3
    (tmp_path / "prog").mkdir()
    (tmp_path / "prog/a.txt").write_text("# no\nF(ARG0)\nG(ARG0)\n")
    seen = []
    E.evaluation_queue(spark, str(tmp_path / "prog"), str(tmp_path / "ck"), lambda df, i: seen.extend(r["program"] for r in df.collect())).awaitTermination(60)
    assert sorted(seen) == ["F(ARG0)", "G(ARG0)"]


def test_fitted_operators_and_random_rows(spark):
    import random

    r = random.Random(1)
    rows = [(i, [float(i % 2) * 3 + r.random(), r.random(), 5.0, r.gauss(0, 2)], float(i % 2), "train" if i % 5 else "test") for i in range(100)]
    d = spark.createDataFrame(rows, "row_id long, features array<double>, target double, split string")
    assert G.run("mySelKBest(ARG0, 1)", d).first()["features"] == rows[0][1][:1]
    assert len(G.run("myVarThresh(ARG0, 0.01)", d).first()["features"]) == 3
    for n in ("myPCA", "myICA", "mySparsePCA", "mySpectralEmbedding"):
        out = G.run(f"{n}(ARG0, 2)", d)
        assert out.count() == 100 and {len(x["features"]) for x in out.collect()} == {2}
    a, b = (sorted((x["row_id"], tuple(x["features"])) for x in G.run("RandomNormal(ARG0, 0.0, 1.0)", d).collect()) for _ in range(2))
    assert a == b and abs(sum(v for _, f in a for v in f) / 400) < 0.3
    assert sorted(G.run("RandomShuffle(ARG0)", d).where("row_id = 3").first()["features"]) == sorted(rows[3][1])
    c = spark.createDataFrame([([1.0, 0.0], [[1.0, 2.0], [3.0, 4.0]]), ([0.0], [[5.0, 6.0]])], "target array<double>, labels array<array<double>>")
    from arbora.operators.dataset import filter_centroids

    assert [x["target"] for x in filter_centroids(c).collect()] == [[[1.0, 2.0]], [[-1.0, -1.0]]]


def test_text_rank_stays_in_the_task_of_its_text(spark, monkeypatch):
    """Ranks by the definition, on texts of every shape, whether the pairs of sizes fit one block or not; no stage, no shuffle."""
    import math
    import random
    import re

    from arbora.operators import text as W

    r = random.Random(5)
    words = [f"w{i}" for i in range(12)]
    texts = [" ".join(" ".join(r.choices(words, k=r.randrange(7))) + r.choice(".!?") for _ in range(n)) for n in (0, 1, 2, 9, 30)] + [None, "", "One word. Two alike here. Nothing shared at all."]

    def ranks(text, rounds=10):
        s = {p: set(re.findall(r"\w{2,}", x.lower())) for p, x in enumerate(re.split(r"(?<=[.!?])\s+", text or ""))}
        s = {p: x for p, x in s.items() if len(x) > 1}
        w = {(a, b): len(s[a] & s[b]) / (math.log(len(s[a])) + math.log(len(s[b]))) for a in s for b in s if a != b and s[a] & s[b]}
        out = {a: sum(x for (c, _), x in w.items() if c == a) for a in s}
        rank = dict.fromkeys(s, 1.0)
        for _ in range(rounds):
            rank = {b: 0.15 + 0.85 * sum(rank[a] * x / out[a] for (a, c), x in w.items() if c == b) for b in s}
        return rank

    df = spark.createDataFrame([(f"t{i}", t) for i, t in enumerate(texts)], "id string, body string")
    want = {(f"t{i}", p): v for i, t in enumerate(texts) for p, v in ranks(t).items()}
    monkeypatch.setattr("arbora.operators.text.stage", None)
    got = W.text_rank(df, "id", "body")
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    got = {(x["id"], x["pos"]): x["rank"] for x in got.collect()}
    assert set(got) == set(want) and len(want) > 30 and all(abs(got[k] - want[k]) < 1e-9 for k in want)

    bags = [sorted(set(r.choices(range(12), k=r.randrange(2, 9)))) for _ in range(40)]
    bags = [b for b in bags if len(b) > 1]
    at = [np.zeros(len(bags), np.int64), np.array([len(b) for b in bags]), np.repeat(np.arange(len(bags)), [len(b) for b in bags]), np.concatenate(bags)]
    one = W.sentence_ranks(*at, 10)
    monkeypatch.setattr(W, "RANK_PAIRS", 7)
    assert np.allclose(W.sentence_ranks(*at, 10), one, rtol=0, atol=1e-12)


@pytest.mark.parametrize("name", ["learner_KNN", "learner_KNN_REGRESSION"])
def test_nearest_neighbour_queries_decide_ties_by_id(spark, tmp_path, name):
    """Many orders are equal or equally near: the five of least id vote, as in the SQL of the query."""
    import datetime
    import math
    import random

    from arbora.queries.programs import QUERIES

    r = random.Random(8)
    orders = [(i, r.randrange(4), r.choice("FO"), float(r.randrange(3) * 1000), datetime.datetime(1995, r.randrange(1, 3), 1), "1-URGENT") for i in range(1200)]
    r.shuffle(orders)
    schema = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"
    spark.createDataFrame(orders, schema).repartition(3).write.parquet(str(tmp_path / "orders.parquet"))
    regression = name == "learner_KNN_REGRESSION"
    rows = [(k, float(c) if regression else float(s == "F"), ([p / 1000] if regression else [p / 1000, c]) + [d.month, 8.0]) for k, c, s, p, d, _ in orders]
    train = [x for x in rows if x[0] % 20]
    pairs = []
    for _, t, x in (q for q in rows if q[0] % 20 == 0):
        near = sorted((math.dist(x, o[2]), o[0], o[1]) for o in train)[:5]
        m = sum(n[2] for n in near) / 5
        pairs.append((m if regression else float(m > 0.5), t))
    got = QUERIES[name](spark, str(tmp_path)).first()
    assert got["accuracy_score"] == round(sum(p != t for p, t in pairs) / len(pairs), 6)
    assert got["objective0EvalFunction"] == pytest.approx(math.sqrt(sum((p - t) ** 2 for p, t in pairs) / len(pairs)), abs=1e-6)
