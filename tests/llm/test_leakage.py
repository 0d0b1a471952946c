import random
import re

from arbora.llm import leakage

WORD = re.compile(r"[^\W_]+")


def brute(docs, items, n):
    grams = {}
    for i, t in items:
        w = [x.casefold() for x in WORD.findall(t or "")]
        for k in range(len(w) - n + 1):
            grams.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = set()
    for d, t in docs:
        w = [x.casefold() for x in WORD.findall(t or "")]
        for k in range(len(w) - n + 1):
            out |= {(d, i) for i in grams.get(tuple(w[k : k + n]), ())}
    return out


def made(seed):
    r = random.Random(seed)
    sentence = lambda n: r.choice([" ", ", ", "_", " \n"]).join(r.choice(["alpha", "Beta", "γάμμα", "é1", "x", "7", "ß", "one_two"]) for _ in range(n))
    items = [(i, sentence(r.randrange(2, 30))) for i in range(12)] + [(90, None), (91, ""), (0, sentence(15)), (92, "same words " * 10), (93, "same words " * 9)]
    docs = [(d, sentence(r.randrange(0, 60))) for d in range(80)] + [(200, None), (201, ""), (202, "... " + items[3][1].upper() + "!"), (203, "same words " * 40)]
    return docs + docs[:2], items


def test_against_brute_force(spark, monkeypatch):
    docs, items = made(2)
    d = spark.createDataFrame([(*x, 0) for x in docs], "doc_id long, text string, item_id int")
    t = spark.createDataFrame(items, "item_id long, text string")
    for n, size in ((12, 1 << 20), (4, 1 << 20), (4, 300)):
        monkeypatch.setattr(leakage, "ITEM_BYTES", size)
        got = leakage.leaked_spans(d, t, words=n).collect()
        assert {(r["doc_id"], r["item_id"]) for r in got} == brute(docs, items, n)
        texts = dict(docs)
        for r in got:
            assert len(WORD.findall(texts[r["doc_id"]][r["begin"] : r["end"]])) == r["n_words"] >= n


def test_empty(spark):
    d, t = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert leakage.leaked_spans(d, t).count() == 0
    assert leakage.leaked_spans(spark.createDataFrame([(1, "x " * 50_000)], d.schema), t.limit(0), words=3).count() == 0
