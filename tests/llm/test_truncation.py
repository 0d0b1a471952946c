import random

from arbora.llm import truncation as T

NAMES, THINGS, PLACES = ["the scheduler", "our team", "a student", "nobody"], ["queue", "learner", "front", "module", "cache entry"], ["before lunch", "at night", "on both hosts", "in the dry run"]


def whole(r):
    out = " ".join(f"{r.choice(NAMES).capitalize()} {r.choice(['checked', 'split', 'moved'])} the {r.choice(THINGS)} {r.randrange(900)} times {r.choice(PLACES)}{r.choice('.!?')}" for _ in range(r.randrange(2, 9)))
    return out + r.choice(["", "", "", f"\n-- {r.choice(NAMES)}, rack {r.randrange(9)}", f"\n- folds: {r.randrange(9)}\n- units: {r.randrange(99)}", "\n```\nF(ARG0, 1)\n```"])


def made(n, seed):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        text, cut = whole(r), False
        if r.random() < 0.1:
            text = text.split("\n")[0]
            at = r.randrange(30, len(text) - 20)
            while text[at - 1] in ".!?" or text[at - 2] in ".!?":
                at += 1
            text, cut = text[:at] + r.choice(["", "", "…", "...", "�"]), True
        rows.append((i, text, r.choice(["en", "EN", "en-GB", None]), cut))
    return rows


def test_held_out_accuracy(spark):
    rows = made(4000, 5)
    df = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string").repartition(3)
    got = {r["doc_id"] for r in T.truncated(df).where("cut").collect()}
    true = {r[0] for r in rows if r[3]}
    assert len(got & true) / len(true) > 0.93 and len(got & true) / max(len(got), 1) > 0.93


def test_sample_keeps_no_own_vote(spark):
    r = random.Random(6)
    rows = []
    for i in range(3000):  # words of their own: no other text has the last characters of a cut one
        text = " ".join("".join(r.choices("abcdefghij", k=r.randrange(3, 9))) for _ in range(r.randrange(20, 60)))
        cut = r.random() < 0.1
        rows.append((i, text if cut else text + ".", "en", cut))
    df = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string").repartition(3)
    true = {r[0] for r in rows if r[3]}
    for args in ({}, {"train_texts": 2999}, {"train_texts": 2400}, {"train_texts": 1500}):
        got = {r["doc_id"] for r in T.truncated(df, **args).where("cut").collect()}
        assert len(got & true) / len(true) > 0.95 and len(got & true) / max(len(got), 1) > 0.95, args


def test_edge_cases(spark):
    schema = "doc_id long, text string, lang string, score_ int, h string"
    assert T.truncated(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, None, "en", 1, ""), (2, "", None, 1, ""), (3, " \n", "", 1, ""), (4, "…", "x", 1, ""), (5, "word " * 60_000, "en", 1, ""), (6, "Done.", "de", 1, ""), (6, "Done.", "de", 1, "")]
    out = T.truncated(spark.createDataFrame(rows, schema))
    assert out.columns == ["doc_id", "lang", "score_", "h", "score", "threshold", "cut"]
    assert sorted(r["doc_id"] for r in out.collect()) == [5, 6, 6]


def test_contexts_at_ends_agree():
    import numpy as np

    texts = [T.folded(t) for t in ["a", "ab\nc", 'x (y "z', "```\ncode ``` ```` x", "long " * 40 + "\nend", "a « b\n", "x\n\n- units: 12", "y\n", "é🎉"]]
    ends = T.end_contexts(texts)
    at = np.cumsum([len(t) + max(T.ORDERS) for t in texts]) - 1
    for k, (places, h, is_end) in enumerate(T.place_contexts(texts)):
        assert (places[is_end] == at).all() and (h[is_end] == ends[:, k]).all()
    only = set(ends[:, 0].tolist())
    for k, (places, h, is_end) in enumerate(T.place_contexts(texts, lambda x: np.isin(x, ends))):
        assert (h[is_end] == ends[:, k]).all() and set(h.tolist()) <= set(ends[:, k].tolist()) | only
