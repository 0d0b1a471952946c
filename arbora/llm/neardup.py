"""Near-duplicate records by adaptive multi-match prefixes.

Records are multisets of tokens; the n-th occurrence of a token is an element of its own, so multiset similarity
(shared counts over greater counts) is Jaccard similarity of sets. Records with the same multiset are first folded
into one class. Elements are put in one global order, rarest first, and each class is indexed by a prefix of its
elements. A class of ``n`` elements with similarity bound ``t`` has an L-prefix of ``n - ceil(t n) + L`` elements, and
two classes with similarity ``t`` or more share at least L elements of their L-prefixes. L is chosen for each class:
longer prefixes read longer posting lists, but ask for more shared elements before a pair is verified. A pair is held
to the smaller L of its two classes, each posting carrying the level at which its element enters the prefix.

Before counting, pairs pass two bounds that lose nothing: the sizes must allow the similarity, and the symmetric
difference (at least the Hamming distance of two parity bitmaps) must not be too large. What is left is verified
exactly on the whole token multisets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.staging import drop_stage, stage

#: Buckets of the element counts that give the global order; bounds what is broadcast (4 bytes each).
BUCKETS = 1 << 20
#: Greatest L, and the costs (in posting reads) of one posting and of one pair to verify.
MOST_L, READ_COST, VERIFY_COST = 4, 1.0, 20.0
#: Most rows of one join key that meet in one task; more are split into blocks, and each pair of blocks is a key of its own.
BLOCK = 5000
_TOKEN = regex.compile(r"[A-Za-z0-9_.]+")


@lru_cache(maxsize=1 << 18)
def _hash(token: str) -> int:
    return xxhash.xxh64_intdigest(token)


def elements(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(row, element) of all texts, sorted by row and element. An element is a 64-bit hash of token and occurrence."""
    tokens = [_TOKEN.findall(t) for t in texts]
    row = np.repeat(np.arange(len(texts)), [len(t) for t in tokens])
    h = np.fromiter((_hash(w.lower()) for t in tokens for w in t), np.uint64, len(row))
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    start = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0)) if len(h) else np.zeros(0, int)
    occurrence = (np.arange(len(h)) - start).astype(np.uint64)
    with np.errstate(over="ignore"):
        x = h + occurrence * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
    order = np.lexsort((x, row))
    return row[order], x[order]


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(tbl, id, text) to (tbl, id, sig, elems); sig is 128 bits of the table and its multiset. Elements of different
    tables differ, so that no posting list mixes tables."""
    for b in batches:
        row, x = elements(b.column(2).to_pylist())
        mix = np.array([_hash("tbl " + t) for t in b.column(0).to_pylist()], np.uint64)
        x = x ^ mix[row]
        ends = np.searchsorted(row, np.arange(b.num_rows + 1))
        raw = x.tobytes()
        sig = [xxhash.xxh3_128_digest(raw[8 * i : 8 * j]) for i, j in zip(ends[:-1], ends[1:])]
        elems = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x.view(np.int64)))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sig, pa.binary()), elems], names=["tbl", "id", "sig", "elems"])


def _levels(n: np.ndarray, need: np.ndarray, sums: np.ndarray, total: int) -> np.ndarray:
    """For each class the L of least estimated cost. sums[:, L-1]: postings read with an L-prefix."""
    cost = np.empty_like(sums)
    lam = sums / max(total, 1)
    for level in range(1, sums.shape[1] + 1):
        term, below = np.exp(-lam[:, level - 1]), np.zeros(len(n))
        for k in range(level):
            below += term
            term = term * lam[:, level - 1] / (k + 1)
        cost[:, level - 1] = READ_COST * sums[:, level - 1] + VERIFY_COST * total * np.clip(1 - below, 0, 1)
        cost[:, level - 1][need < level] = np.inf
    return np.argmin(cost, axis=1) + 1


def _postings(counts, permille: int, total: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = counts.value
        for b in batches:
            lists = b.column(1)
            x = lists.values.to_numpy(zero_copy_only=False).view(np.uint64)
            off = lists.offsets.to_numpy()
            x = x[off[0] : off[-1]]
            n = np.diff(off)
            row = np.repeat(np.arange(len(n)), n)
            df = seen[(x & np.uint64(BUCKETS - 1)).astype(np.int64)].astype(np.int64)
            bits = np.zeros((len(n), 2), np.uint64)
            for word in range(2):
                mine = ((x >> np.uint64(40)) & np.uint64(1)) == word
                np.bitwise_xor.at(bits[:, word], row[mine], np.uint64(1) << ((x[mine] >> np.uint64(41)) & np.uint64(63)))
            order = np.lexsort((x, df, row))
            x, df, row = x[order], df[order], row[order]
            first = np.concatenate(([0], np.cumsum(n)[:-1])) if len(n) else np.zeros(0, np.int64)
            pos = np.arange(len(x)) - first[row] if len(x) else np.zeros(0, np.int64)
            need = -(-permille * n // 1000)
            base = n - need + 1
            sums = np.stack([np.bincount(row, np.where((pos < (base + k)[row]) & (df > 1), df, 0), len(n)) for k in range(MOST_L)], axis=1)
            level = _levels(n, need, sums, total)
            enters = np.maximum(pos - base[row] + 2, 1)
            keep = (enters <= level[row]) & (df > 1)
            r = row[keep]
            cid = b.column(0).to_numpy(zero_copy_only=False)
            cols = [pa.array((x[keep] >> np.uint64(32)).astype(np.uint32).view(np.int32)), pa.array(cid[r]), pa.array(n[r].astype(np.int32)), pa.array((enters[keep] * 16 + level[r]).astype(np.int32)), pa.array(bits[r, 0].view(np.int64)), pa.array(bits[r, 1].view(np.int64))]
            yield pa.RecordBatch.from_arrays(cols, names=["e", "c", "n", "lvls", "b0", "b1"])

    return run


def near_duplicates(records: DataFrame, tbl: str = "tbl", id: str = "id", text: str = "text", permille: int = 700) -> tuple[DataFrame, DataFrame]:
    """Classes of equal multisets, and links between classes with similarity ``permille``/1000 or more.

    Returns (members, links): members (tbl, id, cls) has one row per distinct id and class, links (tbl, cls_a, cls_b,
    similarity) one row per pair of different classes of one tbl. NULL ids and NULL texts are left out. Texts without
    tokens (empty, blank) have no similarity and are left out too. Repeated rows count once; an id with several texts
    belongs to several classes. Extra columns are ignored. Texts are taken whole.
    """
    spark = records.sparkSession
    rows = records.select(F.col(tbl).cast("string").alias("tbl"), F.col(id).cast("string").alias("id"), F.col(text).alias("text")).where("id is not null and text is not null")
    made = stage(rows.mapInArrow(_classes, "tbl string, id string, sig binary, elems array<long>").where(F.size("elems") > 0), "multisets")
    # Class ids are 64 bits of the signature: among 10^9 classes the chance that any two share one is below 3 %.
    classes = stage(made.groupBy("tbl", "sig").agg(F.first("elems").alias("elems")).select(F.xxhash64("sig").alias("c"), "tbl", "elems"), "classes")
    total = classes.count()
    members = stage(made.select("tbl", "id", F.xxhash64("sig").alias("cls")).distinct(), "members")
    drop_stage(made)

    counted = classes.select(F.explode("elems").alias("e")).groupBy(F.col("e").bitwiseAND(BUCKETS - 1).cast("int").alias("b")).agg(F.count("*").alias("n")).toArrow()
    seen = np.zeros(BUCKETS, np.uint32)
    seen[counted["b"].to_numpy()] = np.minimum(counted["n"].to_numpy(), 0xFFFFFFFF)
    counts = spark.sparkContext.broadcast(seen)

    posted = classes.select("c", "elems").mapInArrow(_postings(counts, permille, total), "e int, c long, n int, lvls int, b0 long, b1 long")
    a, b = pair_sides(posted, ["e"], "c", ["c", "n", "lvls", "b0", "b1"])
    less = F.least(F.col("lvls_a") % 16, F.col("lvls_b") % 16)
    enters = F.greatest(F.shiftright("lvls_a", 4), F.shiftright("lvls_b", 4))
    apart = F.bit_count(F.col("b0_a").bitwiseXOR(F.col("b0_b"))) + F.bit_count(F.col("b1_a").bitwiseXOR(F.col("b1_b")))
    # J >= t  <=>  |A xor B| <= (|A| + |B|) (1 - t) / (1 + t)
    close = apart * (1000 + permille) <= (F.col("n_a") + F.col("n_b")) * (1000 - permille)
    sized = (F.col("n_a") * 1000 >= F.col("n_b") * permille) & (F.col("n_b") * 1000 >= F.col("n_a") * permille)
    pairs = a.join(b, ["e", "block_a", "block_b"]).where((F.col("c_a") < F.col("c_b")) & sized & close & (enters <= less))
    candidates = stage(pairs.groupBy("c_a", "c_b").agg(F.count("*").alias("shared"), F.first(less).alias("need")).where("shared >= need").select("c_a", "c_b"), "candidates")
    return members, _verified(candidates, classes, permille)


def pair_sides(rows: DataFrame, by: list[str], id: str, cols: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both sides of a self-join of ``rows`` on ``by``: columns ``cols`` with suffix, and the blocks to join on as well.

    A key with more than ``BLOCK`` rows is cut into blocks by ``id``; its rows go to every block of the other side, so
    all pairs of the key still meet, spread over as many tasks as there are pairs of blocks. Nothing is dropped.
    """
    hot = stage(rows.groupBy(*by).agg(F.count("*").alias("n")).where(F.col("n") > BLOCK).select(*by, F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "hot")
    n_hot = hot.count()
    if n_hot == 0:
        return tuple(rows.select(*by, *[F.lit(0).alias(f"block_{t}") for t in "ab"], *[F.col(x).alias(f"{x}_{s}") for x in cols]) for s in "ab")
    both = rows.join(F.broadcast(hot) if n_hot <= 100_000 else hot, by, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    mine, every = F.pmod(F.xxhash64(id), F.col("blocks")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    left = both.select(*by, mine.alias("block_a"), every.alias("block_b"), *[F.col(x).alias(f"{x}_a") for x in cols])
    right = both.select(*by, every.alias("block_a"), mine.alias("block_b"), *[F.col(x).alias(f"{x}_b") for x in cols])
    return left, right


def _verified(candidates: DataFrame, classes: DataFrame, permille: int) -> DataFrame:
    one = classes.select(F.col("c").alias("c_a"), F.col("tbl").alias("t_a"), F.col("elems").alias("x_a"))
    two = classes.select(F.col("c").alias("c_b"), F.col("tbl").alias("t_b"), F.col("elems").alias("x_b"))
    both = candidates.join(one, "c_a").join(two, "c_b").where(F.col("t_a") == F.col("t_b"))
    shared = F.size(F.array_intersect("x_a", "x_b"))
    union = F.size("x_a") + F.size("x_b") - shared
    return both.where(shared * 1000 >= union * permille).select(F.col("t_a").alias("tbl"), F.col("c_a").alias("cls_a"), F.col("c_b").alias("cls_b"), (shared / union).alias("similarity"))


def linked_ids(members: DataFrame, links: DataFrame) -> DataFrame:
    """(tbl, id_a, id_b) of all pairs of different ids, id_a < id_b, in one class or in two linked classes."""
    m = members.select(F.col("tbl"), F.col("id"), F.col("cls"))
    a = m.select("tbl", F.col("id").alias("id_a"), F.col("cls").alias("cls_a"))
    b = m.select("tbl", F.col("id").alias("id_b"), F.col("cls").alias("cls_b"))
    across = links.select("tbl", "cls_a", "cls_b").join(a, ["tbl", "cls_a"]).join(b, ["tbl", "cls_b"])
    across = across.where(F.col("id_a") != F.col("id_b")).select("tbl", F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"))
    left, right = pair_sides(m, ["tbl", "cls"], "id", ["id"])
    within = left.join(right, ["tbl", "cls", "block_a", "block_b"]).where(F.col("id_a") < F.col("id_b")).select("tbl", "id_a", "id_b")
    return across.unionByName(within).distinct()


def classed(members: DataFrame, links: DataFrame) -> DataFrame:
    """(tbl, id, cls, least_id, n_copies, n_links): one row per id and class, with the least id and the number of ids in
    its class, and its class's links."""
    copies = members.groupBy("tbl", "cls").agg(F.min("id").alias("least_id"), F.count("*").alias("n_copies"))
    ends = links.select("tbl", F.explode(F.array("cls_a", "cls_b")).alias("cls")).groupBy("tbl", "cls").agg(F.count("*").alias("n_links"))
    return members.join(copies, ["tbl", "cls"]).join(ends, ["tbl", "cls"], "left").withColumn("n_links", F.coalesce("n_links", F.lit(0)))

