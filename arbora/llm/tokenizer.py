"""Encoding of a corpus with a public byte-level BPE vocabulary, in batched numpy merge rounds.

A batch of texts is cut into words by the vocabulary's pattern. The distinct new words of the batch lie in one flat
array of symbols. Each round looks up all adjacent pairs at once by binary search over the sorted pair keys, takes the
lowest rank of each word and merges it everywhere it occurs in that word. Words are done when no pair of theirs has a
rank; the rounds go on over the others. Words seen before come from a bounded memory of each worker.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Where the vocabulary files are; a parameter everywhere.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that cuts text into words before the merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words a worker remembers, and the longest word it remembers (bytes).
REMEMBERED, LONGEST = 200_000, 64
_NONE = np.int64(1 << 40)


class BytePairs:
    """A rank file as arrays: for each pair of ids that merges, the id it becomes. Ids are ranks."""

    def __init__(self, path: str, pattern: str = PATTERN):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(r) for a, r in (line.split() for line in f if line.strip())}
        self.byte_ids = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        keys, becomes = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    becomes.append(rank)
        order = np.argsort(np.array(keys, np.int64), kind="stable")
        self.keys, self.becomes = np.array(keys, np.int64)[order], np.array(becomes, np.int64)[order]
        self.words = regex.compile(pattern)
        self.memory: dict[str, np.ndarray] = {}

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        want = left << np.int64(32) | right
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where(self.keys[at] == want, self.becomes[at], _NONE)

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each word (none empty)."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        sym = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), lengths)
        done: list[np.ndarray] = [np.zeros(0, np.int64)] * len(words)

        def finish(sym: np.ndarray, word: np.ndarray) -> None:
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]]) if len(word) else np.zeros(0, np.int64)
            for w, part in zip(word[starts], np.split(sym, starts[1:])):
                done[w] = part

        while len(sym):
            rank = np.full(len(sym), _NONE)
            same = word[1:] == word[:-1]
            rank[:-1][same] = self._ranks(sym[:-1][same], sym[1:][same])
            starts = np.flatnonzero(np.r_[True, ~same])
            low = np.minimum.reduceat(rank, starts)
            per = np.repeat(low, np.diff(np.r_[starts, len(sym)]))
            hit = (rank == per) & (per < _NONE)
            # Overlapping hits (a a a) merge from the left: every second of a run.
            at = np.flatnonzero(hit)
            if len(at):
                run = np.r_[0, np.cumsum(np.diff(at) != 1)]
                first = at[np.r_[True, np.diff(run) != 0]]
                at = at[(at - first[run]) % 2 == 0]
            sym = sym.copy()
            sym[at] = rank[at]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            over = per == _NONE
            finish(sym[over], word[over])
            keep &= ~over
            sym, word = sym[keep], word[keep]
        return done

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts, and the number of ids of each. NULL and empty texts have none."""
        cut = [self.words.findall(t) if t else [] for t in texts]
        fresh = list({w for ws in cut for w in ws} - self.memory.keys())
        ids = dict(zip(fresh, self.merge([w.encode("utf-8", "surrogatepass") for w in fresh])))
        memory = self.memory
        flat = [memory[w] if w in memory else ids[w] for ws in cut for w in ws]
        sizes = np.fromiter(map(len, flat), np.int64, len(flat))
        owner = np.repeat(np.arange(len(texts)), [len(ws) for ws in cut])
        per_text = np.bincount(owner, sizes, len(texts)).astype(np.int64) if len(owner) else np.zeros(len(texts), np.int64)
        if len(memory) + len(ids) > REMEMBERED:
            memory.clear()
        if len(ids) <= REMEMBERED:
            memory.update((w, v) for w, v in ids.items() if len(w) <= LONGEST)
        return (np.concatenate(flat) if flat else np.zeros(0, np.int64)), per_text


@lru_cache(maxsize=4)
def load(path: str, pattern: str = PATTERN) -> BytePairs:
    return BytePairs(path, pattern)


def encoded(df: DataFrame, text: str = "text", ids: str = "ids", path: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """``df`` with the token ids of ``text`` in a new column ``ids`` (ARRAY<INT>), without special tokens.

    NULL and empty texts have an empty list. White space only, repeated rows and very long texts are encoded like any
    other; the whole text counts. Strings of special tokens in a text are ordinary text. Other columns are kept; a
    column named ``ids`` must not exist. One narrow pass; the vocabulary is read from ``path`` on each executor.
    """
    if ids in df.columns:
        raise ValueError(f"column {ids!r} exists already")
    at = df.columns.index(text)
    schema = T.StructType([*df.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        for batch in batches:
            for part in (batch.slice(i, 2000) for i in range(0, batch.num_rows, 2000)):
                flat, n = bpe.encode(part.column(at).to_pylist())
                offsets = pa.array(np.r_[0, np.cumsum(n)].astype(np.int32))
                lists = pa.ListArray.from_arrays(offsets, pa.array(flat.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], names=[f"c{i}" for i in range(part.num_columns + 1)])

    return df.mapInArrow(run, schema)


def token_counts(df: DataFrame, by: str, text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """(by, n_texts, n_tokens): texts and tokens per value of a column, combined before the shuffle."""
    e = encoded(df.select(by, text), text, "__ids", path)
    return e.groupBy(by).agg(F.count("*").alias("n_texts"), F.sum(F.size("__ids")).cast("long").alias("n_tokens"))
