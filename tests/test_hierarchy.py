import random

import pytest

from arbora.operators import hierarchy as H


def brute(rows):
    up, names = {}, {n for n, _ in rows if n is not None}
    for n, p in rows:
        if n is not None and p is not None and (n not in up or p < up[n]):
            up[n] = p
    out = {}
    for n in names:
        line = [n]
        while up.get(line[-1]) in names and len(line) <= len(names):
            line.append(up[line[-1]])
        out[n] = None if len(line) > len(names) else line[::-1]
    return out


def made(n, seed):
    r = random.Random(seed)
    rows = [(f"n{i}", f"n{r.randrange(max(0, i - 3), i)}" if i and r.random() < 0.97 else None) for i in range(n)]
    rows += [("c1", "c2"), ("c2", "c3"), ("c3", "c1"), ("in", "c1"), ("in2", "in"), ("self", "self"), ("gone", "nowhere"), (None, "n1"), ("n5", None)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("block_rows", [250_000, 20])
def test_against_brute_force(spark, block_rows):
    rows = made(150, 3)
    want = brute(rows)
    df = spark.createDataFrame(rows, "node string, parent string").repartition(4)
    got = {r["node"]: r for r in H.hierarchy(df, block_rows=block_rows).collect()}
    assert got.keys() == want.keys()
    for n, line in want.items():
        assert (got[n]["root"], got[n]["depth"], got[n]["cyclic"]) == ((line[0], len(line) - 1, False) if line else (None, None, True))


def test_paths_descendants_circles(spark):
    rows = made(60, 4)
    want = brute(rows)
    df = spark.createDataFrame(rows, "node string, parent string")
    p = H.paths(df)
    assert {r["node"]: r["path"] for r in p.collect()} == {n: x for n, x in want.items() if x}
    closure = {(a, n, len(x) - 1 - i) for n, x in want.items() if x for i, a in enumerate(x[:-1])}
    assert {tuple(r) for r in H.descendants(p).collect()} == closure
    assert {tuple(r) for r in H.circles(df).collect()} == {("c1", "c1", 3), ("c2", "c1", 3), ("c3", "c1", 3), ("self", "self", 1)}


def test_empty_and_repeated(spark):
    assert H.hierarchy(spark.createDataFrame([], "node string, parent string")).count() == 0
    df = spark.createDataFrame([("a", None, 1), ("a", None, 1), ("b", "a", 2)], "node string, parent string, root int")
    assert sorted(tuple(r) for r in H.hierarchy(df).collect()) == [("a", "a", 0, False), ("b", "a", 1, False)]


@pytest.mark.parametrize("block_rows, length", [(2, 40), (4, 94), (3, 130)])
def test_long_lines_in_small_blocks_are_no_circles(spark, block_rows, length):
    rows = [(f"n{i:03d}", f"n{i - 1:03d}" if i else None) for i in range(length)]
    got = {r["node"]: (r["root"], r["depth"], r["cyclic"]) for r in H.hierarchy(spark.createDataFrame(rows, "node string, parent string").repartition(6), block_rows=block_rows).collect()}
    assert got == {n: ("n000", int(n[1:]), False) for n, _ in rows}
