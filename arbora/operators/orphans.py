"""References to records that do not exist at the time, from signed counts per key.

Everything that happens to a key is a signed delta: a record that becomes visible adds 1 to its existence count, one
that is purged takes 1 off, a reference adds 1 to its reference count and a retracted one takes 1 off. The state is one
row per key, (k, n_refs, n_exist); states of separate loads, and later deltas, merge by adding. Keys with positive
references and zero existence are the current orphans (:func:`state`, :func:`merged`, :func:`current`).

For the rows that were orphans at their own time, the same deltas are added up by key and slot of time, so that a key
with a third of all rows shrinks to a row per slot before anything runs over it. Running sums over slots give the counts
a slot begins with. Suspects are the slots with positive references in which existence is zero at some moment; only
their references are looked at again, each reading the count at its own moment from the slot's few steps. A slot is a
day, or as much shorter as it takes for no key to have more than ``MOST_STEPS`` steps in one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbora.keys import key

#: Most existence steps of one key in one slot, and the lengths of slots in microseconds. The last holds at most 1000.
MOST_STEPS, SLOTS = 10_000, (86_400_000_000, 3_600_000_000, 60_000_000, 1_000_000, 1_000)
_MOVES = "array<struct<ts:timestamp_ntz,delta:bigint>>"


def _spans(k: Column, since: Column, until: Column) -> Column:
    """The two steps of something there from ``since`` until ``until``; none if it never is."""
    steps = F.array(F.struct(k.alias("k"), since.alias("ts"), F.lit(1).cast("long").alias("d")), F.struct(k.alias("k"), until.alias("ts"), F.lit(-1).cast("long").alias("d")))
    there = k.isNotNull() & since.isNotNull() & (until.isNull() | (until > since))
    return F.filter(F.when(there, steps), lambda s: s["ts"].isNotNull())


def existence_deltas(targets: DataFrame, key_col: str = "id", since: str = "recorded_at", until: str | None = "purged_at") -> DataFrame:
    """(k, ts, d_refs, d_exist): +1 at ``since``, -1 at ``until``. Rows that never are visible (no key, no start, or an
    end not after the start) give none."""
    end = F.col(until) if until else F.lit(None).cast("timestamp_ntz")
    t = targets.select(F.explode(_spans(key(key_col), F.col(since), end)).alias("x"))
    return t.select("x.k", "x.ts", F.lit(0).cast("long").alias("d_refs"), F.col("x.d").alias("d_exist"))


def reference_deltas(references: DataFrame, ref: str = "ref", since: str = "ts", until: str | None = None) -> DataFrame:
    """(k, ts, d_refs, d_exist): +1 per reference, -1 when it is retracted at ``until``. A reference without a time
    counts from the beginning (its delta has a NULL ts); a NULL or blank ref is none."""
    k = key(ref)
    end = F.col(until) if until else F.lit(None).cast("timestamp_ntz")
    r = references.select(k.alias("k"), F.col(since).alias("s"), end.alias("u")).where("k is not null and (u is null or s is null or u > s)")
    steps = F.array(F.struct(F.col("s").alias("ts"), F.lit(1).cast("long").alias("d")), F.when(F.col("u").isNotNull(), F.struct(F.col("u").alias("ts"), F.lit(-1).cast("long").alias("d"))))
    r = r.select("k", F.explode(F.filter(steps, lambda s: s.isNotNull())).alias("x")) if until else r.select("k", F.struct(F.col("s").alias("ts"), F.lit(1).cast("long").alias("d")).alias("x"))
    return r.select("k", "x.ts", F.col("x.d").alias("d_refs"), F.lit(0).cast("long").alias("d_exist"))


def state(deltas: DataFrame) -> DataFrame:
    """(k, n_refs, n_exist): signed counts per key after all deltas. Keys whose counts are both zero are dropped."""
    sums = deltas.groupBy("k").agg(F.sum("d_refs").alias("n_refs"), F.sum("d_exist").alias("n_exist"))
    return sums.where((F.col("n_refs") != 0) | (F.col("n_exist") != 0))


def merged(states: DataFrame, deltas: DataFrame) -> DataFrame:
    """A state brought forward by later deltas; equals the state of all deltas, in whatever order they came."""
    return state(states.select("k", F.col("n_refs").alias("d_refs"), F.col("n_exist").alias("d_exist")).unionByName(deltas.select("k", "d_refs", "d_exist")))


def current(states: DataFrame) -> DataFrame:
    """(k, n_refs, n_exist) of the keys with positive references and no existence: the current orphan report."""
    return states.where((F.col("n_refs") > 0) & (F.col("n_exist") <= 0))


def _slot(ts: str, width: int) -> Column:
    return F.floor(F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', `{ts}`)") / F.lit(width))


def _moments(exist: DataFrame) -> DataFrame:
    """Steps of existence at one moment as one."""
    return exist.groupBy("k", "ts").agg(F.sum("d_exist").alias("delta")).where(F.col("delta") != 0)


def slot_width(exist: DataFrame) -> int:
    """The longest slot in which no key has more than ``MOST_STEPS`` steps."""
    for width in SLOTS:
        most = exist.groupBy("k", _slot("ts", width).alias("slot")).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
        if (most or 0) <= MOST_STEPS:
            break
    return width


def suspects(exist: DataFrame, refs: DataFrame, width: int) -> DataFrame:
    """(k, slot, before, moves) of the slots with positive references in which existence is zero at some moment: the count
    a slot begins with, and its steps. ``refs`` are signed reference deltas."""
    per = _moments(exist).groupBy("k", _slot("ts", width).alias("slot")).agg(F.sum("delta").alias("net"), F.array_sort(F.collect_list(F.struct("ts", "delta"))).alias("moves"))
    per = per.select("k", "slot", "net", "moves", F.lit(0).cast("long").alias("n_new"))
    asked = refs.where("ts is not null").groupBy("k", _slot("ts", width).alias("slot")).agg(F.sum("d_refs").alias("n_new"))
    asked = asked.select("k", "slot", F.lit(0).cast("long").alias("net"), F.lit(None).cast(_MOVES).alias("moves"), "n_new")
    both = per.unionByName(asked).groupBy("k", "slot").agg(F.sum("net").alias("net"), F.first("moves", ignorenulls=True).alias("moves"), F.sum("n_new").alias("n_new"))
    before = F.coalesce(F.sum("net").over(Window.partitionBy("k").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return both.select("k", "slot", before.alias("before"), "moves", "n_new").where((F.col("n_new") > 0) & ((F.col("before") <= 0) | F.col("moves").isNotNull())).drop("n_new")


def orphans(references: DataFrame, targets: DataFrame, target_key: str = "id", since: str = "recorded_at", until: str | None = "purged_at") -> DataFrame:
    """The rows of ``references`` (columns ref, ts and any others) whose key has no visible target at ``ts``.

    A NULL or blank ref is no reference and never an orphan. A reference with a NULL time finds nothing and is an
    orphan. A target counts from ``since`` (inclusive) until ``until`` (exclusive; NULL: for ever). Several targets
    with one key, repeated rows and returning records are counted, not overwritten. Rows are kept as often as they
    come. Extra columns are kept; names that begin with two underscores are the operator's own.
    """
    exist = existence_deltas(targets, target_key, since, until)
    width = slot_width(exist)
    refs = references.withColumn("__k", key("ref")).where(F.col("__k").isNotNull())
    found = suspects(exist, reference_deltas(references), width)
    found = found.select(F.col("k").alias("__k"), F.col("slot").alias("__slot"), F.col("before").alias("__before"), F.coalesce("moves", F.array().cast(_MOVES)).alias("__moves"))
    hit = refs.where(F.col("ts").isNotNull()).withColumn("__slot", _slot("ts", width)).join(found, ["__k", "__slot"])
    count = F.aggregate("__moves", F.col("__before"), lambda n, m: n + F.when(m["ts"] <= F.col("ts"), m["delta"]).otherwise(F.lit(0).cast("long")))
    return hit.where(count <= 0).select(*references.columns).unionByName(refs.where(F.col("ts").isNull()).select(*references.columns))
