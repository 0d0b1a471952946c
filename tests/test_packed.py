import random

import pytest

from arbora.keys import WHITE
from arbora.operators import packed as P
from arbora.operators.packed import split_packed

SEP = WHITE + ",;|/"


def brute(field):
    """The rule, one character at a time."""
    if field is None:
        return []
    s = field.strip(WHITE)
    if len(s) > 1 and s[0] == "[" and s[-1] == "]":
        s = s[1:-1].strip(WHITE)
    out, i = [], 0
    while i < len(s):
        if s[i] in SEP:
            i += 1
            continue
        if s[i] in "\"'":
            q, v = s[i], ""
            i += 1
            while True:
                if s[i] == "\\" and s[i + 1] == q:
                    v, i = v + q, i + 2
                elif s[i] == q and s[i + 1 : i + 2] == q:
                    v, i = v + q, i + 2
                elif s[i] == q:
                    i += 1
                    break
                else:
                    v, i = v + s[i], i + 1
            out.append(v.strip(WHITE))
            continue
        v, deep = "", 0
        while i < len(s) and (deep or s[i] not in SEP):
            if s[i] in "\"'" and deep:
                q, v = s[i], v + s[i]
                i += 1
                while s[i] != q:
                    v, i = v + s[i], i + 1
            deep += {"(": 1, ")": -1}.get(s[i], 0)
            v, i = v + s[i], i + 1
        out.append(v)
    return [v for v in out if v]


FIXED = [
    None, "", "  ", "[]", "[ ]", ",;|", "a", " a ,b;c|d/e f\tg\nh ", "['a', 'b c', \"d,e\"]", '"a ""b"" c";d', '"a \\"b\\" c" | d',
    'F(x, "p; q|1", 2), z', "F(G(a, b), c) /H(1)", "[F(a), b]", "x,,y,", '"F(x, ""p; q"", 3)"', "[\"a\"] ", "'it''s'", 'a\xa0b', "{'n': 1}" if False else "L('B', {'n': 87, 'r': 0.5})",
    'F("a) b", c), d',
]


def made(n):
    r = random.Random(5)
    word = lambda: r.choice(["ab12" * 16, "mod_7", "seed-1", "x", "Ä1"])

    def value():
        k = r.randrange(6)
        if k == 0:
            return f"F({word()}, G({word()}), \"k; {word()}|1\")"
        if k == 1:
            return '"' + f"{word()}, {word()}" + '"'
        if k == 2:
            return "'" + f"{word()} | {word()}" + "'"
        if k == 3:
            return '"N(a, ""q; w"", 1)"'
        return word()

    return [r.choice(["{}", "[{}]", " {} "]).format("".join(value() + r.choice([",", "; ", " | ", "/", "\t", " , "]) for _ in range(r.randrange(1, 6)))) for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    fields = FIXED + made(300)
    return list(enumerate(fields))


def test_against_brute_force(spark, rows):
    df = spark.createDataFrame(rows, "rec_id long, f string")
    got = {}
    for r in split_packed(df, "f").collect():
        got.setdefault(r["rec_id"], []).append((r["pos"], r["val"]))
    for i, f in rows:
        assert [v for _, v in sorted(got.get(i, []))] == brute(f), f
        assert [p for p, _ in sorted(got.get(i, []))] == list(range(1, len(brute(f)) + 1))


def test_empty_unclosed_long_and_clashing(spark):
    schema = "rec_id long, f string, n int, shape string, b string"
    assert split_packed(spark.createDataFrame([], schema), "f").count() == 0
    long = ",".join(["v"] * 50_000)
    df = spark.createDataFrame([(1, "'a,b", 1, "s", "t"), (1, "'a,b", 1, "s", "t"), (2, "F(a,b", None, None, None), (3, long, 1, "", "")], schema)
    out = split_packed(df, "f")
    assert out.columns == ["rec_id", "f", "n", "shape", "b", "pos", "val"]
    by = {}
    for r in out.select("rec_id", "val").collect():
        by.setdefault(r["rec_id"], []).append(r["val"])
    assert sorted(by[1]) == ["'a", "'a", "b", "b"] and by[2] == ["F(a", "b"] and len(by[3]) == 50_000
    with pytest.raises(ValueError):
        split_packed(out, "f")


def read(field, codes):
    return [v for v, _ in P.parse(field, P.cheapest(field, codes))]


def test_value_codes_decide(spark):
    """The same field reads one way by the counts of one table, another way by those of another, and a third without codes."""
    free = P.Codes({}, 0.0, {})
    fields = [f for _, f in enumerate(made(300))]
    changed = sum(read(P.strip_brackets(f), free) != read(P.strip_brackets(f), P.PRIOR) for f in fields)
    assert changed > 100
    counts = lambda rows: P.learned(spark.createDataFrame(rows, "shape string, n long"))
    split = counts([("w#3", 100_000), ("", 400_000)])
    whole = counts([("w#3", 3), ("w/w#3", 100_000), ("", 700_000), ("/", 100_000)])
    assert read("abcd/efg", split) == ["abcd", "efg"]
    assert read("abc/efg", whole) == ["abc/efg"]
    quoted = counts([("w, w#4", 50_000), ("w#3", 50_000), ("", 700_000)])
    assert read("'abcd, efgh', ijkl'", quoted) == ["abcd, efgh", "ijkl'"]
    assert read("'abcd, efgh', ijkl'", free) == ["'abcd", "efgh'", "ijkl'"]


def test_codes_cover_all_shapes(spark, monkeypatch):
    monkeypatch.setattr(P, "MOST_SHAPES", 2)
    c = P.learned(spark.createDataFrame([("a#1", 50), ("a#1", 14), ("b#1", 32), ("c#1", 20), ("d#1", 11), ("", 500)], "shape string, n long"))
    assert set(c.shapes) == {"a#1", "b#1"} and abs(c.shapes["a#1"] - 1) < 1e-9 and abs(c.escape - (2 + 2)) < 1e-9


def test_skeleton_decides_alike():
    for f in FIXED + made(200):
        if f:
            b = P.strip_brackets(f)
            assert read(b, P.PRIOR) == [v for v, _ in P.parse(b, P.chooser(P.PRIOR)(b))]
