import random
import re
from collections import Counter

import pytest

from arbora.llm import neardup

TOKEN = re.compile(r"[A-Za-z0-9_.]+")


def made(n, seed):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + [f"{i}.5" for i in range(400)]
    rows = []
    for i in range(n):
        if rows and r.random() < 0.5:
            words = TOKEN.findall(r.choice(rows)[2] or "") or ["x"]
            for _ in range(r.randrange(0, 5)):
                words[r.randrange(len(words))] = r.choice(vocabulary)
            r.random() < 0.3 and r.shuffle(words)
        else:
            words = [r.choice(vocabulary) for _ in range(r.randrange(1, 30))]
        text = r.choice([", ", "(", " "]).join(words)
        rows.append((r.choice(["t", "u"]), f"h{i}", text.upper() if r.random() < 0.2 else text))
    rows += [("t", None, "a b c"), ("t", "null", None), ("u", "blank", " ,"), ("u", "empty", ""), *rows[:4], ("t", "h1", "another text of h1")]
    rows += [("t", f"copy{i}", "one two three 3.5") for i in range(30)]
    return rows


def brute(rows, t):
    sets = sorted({(a, b, tuple(sorted(Counter(w.lower() for w in TOKEN.findall(c)).items()))) for a, b, c in rows if b is not None and c is not None and TOKEN.search(c)})
    out = set()
    for i, (a, b, x) in enumerate(sets):
        for a2, b2, y in sets[:i]:
            if a == a2 and b != b2:
                p, q = Counter(dict(x)), Counter(dict(y))
                if sum((p & q).values()) * 1000 >= t * sum((p | q).values()):
                    out.add((a, min(b, b2), max(b, b2)))
    return out


@pytest.mark.parametrize("permille, costs", [(700, (1.0, 20.0)), (700, (0.0, 1e6)), (800, (1.0, 200.0))])
def test_against_brute_force(spark, monkeypatch, permille, costs):
    monkeypatch.setattr(neardup, "READ_COST", costs[0])
    monkeypatch.setattr(neardup, "VERIFY_COST", costs[1])
    rows = made(150, 7)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "tbl string, id string, text string, e int, c string")
    members, links = neardup.near_duplicates(df, permille=permille)
    assert {tuple(r) for r in neardup.linked_ids(members, links).collect()} == brute(rows, permille)


def test_levels_rise_with_cost():
    import numpy as np

    sums = np.array([[1000.0, 1050, 1100, 1150], [1e5, 1.01e5, 1.02e5, 1.03e5]])
    levels = neardup._levels(np.array([50, 50]), np.array([35, 35]), sums, 100_000)
    assert levels[1] > levels[0] >= 1


def test_empty_and_long(spark):
    schema = "tbl string, id string, text string"
    members, links = neardup.near_duplicates(spark.createDataFrame([], schema))
    assert members.count() == 0 and links.count() == 0
    long = " ".join(f"w{i}" for i in range(50_000))
    members, links = neardup.near_duplicates(spark.createDataFrame([("t", "a", long), ("t", "b", long + " more")], schema))
    assert neardup.linked_ids(members, links).count() == 1
    assert {r["n_links"] for r in neardup.classed(members, links).collect()} == {1}


def test_hot_keys_in_blocks(spark, monkeypatch):
    """Keys cut into blocks give the same links and the same pairs of copies."""
    r = random.Random(4)
    rows = [("t", f"h{i:03d}", "F(a, b, c, d, " + ", ".join(r.choices(["e", "f", "g", "h"], k=3)) + ")") for i in range(120)]
    df = spark.createDataFrame(rows, "tbl string, id string, text string")
    want = sorted(map(tuple, neardup.linked_ids(*neardup.near_duplicates(df)).collect()))
    monkeypatch.setattr(neardup, "BLOCK", 7)
    assert sorted(map(tuple, neardup.linked_ids(*neardup.near_duplicates(df)).collect())) == want and len(want) > 3000
