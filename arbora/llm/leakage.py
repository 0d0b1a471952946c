"""Evaluation texts in training texts, found by one Aho-Corasick automaton over normalised passages.

Words are runs of letters and digits, compared without letter case. Each run of ``words`` consecutive words of a test
item is a pattern, bounded by spaces; a text is normalised the same way, scanned once, and every hit is carried back to
its place in the original text. Items are few; their patterns are shipped to every task as long as they fit in
``ITEM_BYTES``. More items than that are scanned in blocks, each block with an automaton of its own.
"""

from __future__ import annotations

import uuid
from bisect import bisect_right
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of item text in one automaton. Bounds what is broadcast.
ITEM_BYTES = 16 << 20
_WORD = regex.compile(r"[^\W_]+")
_built: dict = {}


def words_of(text: str) -> list[str]:
    return [w.casefold() for w in _WORD.findall(text)]


def patterns(items: list[tuple[int, str]], words: int) -> dict[str, list[tuple[int, int]]]:
    """Normalised runs of ``words`` words to the (item, place) they stand at."""
    out: dict[str, list[tuple[int, int]]] = {}
    for item, text in items:
        ws = words_of(text)
        for i in range(len(ws) - words + 1):
            out.setdefault(" " + " ".join(ws[i : i + words]) + " ", []).append((item, i))
    return out


def _automaton(key: str, items: list[tuple[int, str]], words: int):
    if key not in _built:
        a = ahocorasick.Automaton()
        for p, places in patterns(items, words).items():
            a.add_word(p, (len(p), places))
        if len(a):
            a.make_automaton()
        _built.clear()
        _built[key] = a
    return _built[key]


def _hits(text: str, automaton, words: int) -> dict[int, list[tuple[int, int]]]:
    """For each item the (first, last) word of every hit in the text."""
    ws = words_of(text)
    if len(ws) < words:
        return {}
    starts, at = [], 1
    for w in ws:
        starts.append(at)
        at += len(w) + 1
    out: dict[int, list[tuple[int, int]]] = {}
    for end, (length, places) in automaton.iter(" " + " ".join(ws) + " "):
        first = bisect_right(starts, end - length + 2) - 1
        for item in {i for i, _ in places}:
            out.setdefault(item, []).append((first, first + words - 1))
    return out


def leaked_spans(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", words: int = 12) -> DataFrame:
    """(doc_id, item_id, begin, end, n_words): each maximal stretch of a document covered by hits of one item.

    begin and end are character offsets in the stored text (end exclusive). NULL, empty and short texts have no hit;
    items with fewer than ``words`` words can have none. Repeated items and repeated documents give repeated rows only
    if their ids are repeated too: a document row counts as often as it comes. Extra columns are ignored.
    """
    spark = documents.sparkSession
    rows = items.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t")).where("i is not null and t is not null")
    docs = documents.select(F.col(doc_id).cast("long").alias("d"), F.col(text).alias("t")).where("t is not null")
    total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, -(-total // ITEM_BYTES))
    found = []
    for block in range(blocks):
        mine = [(r["i"], r["t"]) for r in rows.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == block).collect()]
        found.append(_scan(docs, spark.sparkContext.broadcast(mine), words))
    return reduce(DataFrame.unionByName, found).toDF(doc_id, item_id, "begin", "end", "n_words")


def _scan(docs: DataFrame, shared, words: int) -> DataFrame:
    name = uuid.uuid4().hex  # a worker builds the automaton once

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(name, shared.value, words)
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            if len(automaton):
                for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if not (hits := _hits(t, automaton, words)):
                        continue
                    offsets = [m.span() for m in _WORD.finditer(t)]
                    for item, runs in hits.items():
                        runs.sort()
                        i = 0
                        while i < len(runs):
                            a, z = runs[i]
                            while i + 1 < len(runs) and runs[i + 1][0] <= z + 1:
                                i += 1
                                z = max(z, runs[i][1])
                            i += 1
                            for c, v in zip(out, (d, item, offsets[a][0], offsets[z][1], z - a + 1)):
                                c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()))], names=["d", "i", "b", "e", "n"])

    return docs.mapInArrow(run, "d long, i long, b int, e int, n int")
