"""Percentiles of very large numeric columns: daily partials that combine, and selection over them.

A daily partial is, per group, field and day, a run of sorted value buckets with counts. Bucket bounds grow by a
factor, so a bucket's middle is within a relative error ``eps`` of each value in it; a run has at most
``2 ln(largest / MIN) / ln(bound ratio)`` buckets, whatever the number of rows. Runs of any days combine by adding.

Percentiles over a span of days come by distributed multi-select on the runs. Every run proposes its local median of
the range still open, the median of the proposals weighted by counts becomes the pivot, all runs count three ways,
ranges that cannot hold the rank are discarded, and so on until the rank falls on the pivot. One pass counts for a
pivot and proposes for both sides of it. Where one run alone holds all values still open, its proposal is the pivot
and its count is the whole count, so it goes through the same rounds in its own task. Ranks are exact, so the error is
that of the buckets alone. No pass sorts or moves the values of a group to one place.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from datetime import date
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbora.staging import stage

#: Relative error of a percentile's value; values nearer to zero than MIN count as zero.
EPS, MIN = 0.005, 1e-9
#: Most rows of (day, selection) that are broadcast; about 50 bytes each.
BROADCAST_ROWS = 100_000
_STATE = "lo long, hi long, piv long, k long, since int, till int, rounds int"
_ROUND = f"gk string, sel int, lt long, eq long, gt long, med_lt long, med_gt long, hit long, steps int, {_STATE}"
_WIDE = 1 << 42
_LOW, _HIGH = -(1 << 40), 1 << 40


def bucket(v: Column, eps: float = EPS) -> Column:
    """Signed bucket number, in the order of the values."""
    ratio = math.log((1 + eps) / (1 - eps))
    at = (F.floor((F.log(F.abs(v)) - math.log(MIN)) / ratio) + 1).cast("long")
    return F.when(F.abs(v) < MIN, F.lit(0).cast("long")).when(v > 0, at).otherwise(-at)


def bucket_value(b: Column, eps: float = EPS) -> Column:
    """The middle of a bucket, as a 32-bit float in a double."""
    g = (1 + eps) / (1 - eps)
    mid = F.signum(b.cast("double")) * MIN * F.pow(F.lit(g), F.abs(b).cast("double")) * (2 / (g + 1))
    return F.when(b == 0, F.lit(0.0)).otherwise(mid).cast("float").cast("double")


def measured(df: DataFrame, group: str, fields: list[str], ts: str) -> DataFrame:
    """(grp, day, field, v): one row per measurement."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("v")) for f in fields])
    rows = df.select(F.col(group).cast("string").alias("grp"), F.to_date(ts).alias("day"), F.explode(pairs).alias("x")).select("grp", "day", "x.field", "x.v")
    return rows.where(F.col("day").isNotNull() & F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") != float("inf")))


def day_partials(df: DataFrame, group: str, fields: list[str], ts: str, eps: float = EPS) -> DataFrame:
    """(grp, field, day, b, c): sorted buckets and their counts.

    NULL, NaN and infinite values are no measurements. A NULL group is a group of its own; rows without a time belong
    to no day and are left out. Repeated rows count as often as they come. Counting by bucket is combined before the
    shuffle, so a group with a third of all rows costs no more than its number of buckets.
    """
    counts = measured(df, group, fields, ts).groupBy("grp", "field", "day", bucket(F.col("v"), eps).alias("b")).agg(F.count("*").alias("n"))
    return _runs(counts)


def combine(*partials: DataFrame) -> DataFrame:
    """Partials of separate loads as one: counts of equal buckets are added."""
    parts = [p.select("grp", "field", "day", F.explode(F.arrays_zip("b", "c")).alias("x")).select("grp", "field", "day", F.col("x.b").alias("b"), F.col("x.c").alias("n")) for p in partials]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return _runs(rows.groupBy("grp", "field", "day", "b").agg(F.sum("n").alias("n")))


def _runs(counts: DataFrame) -> DataFrame:
    run = F.array_sort(F.collect_list(F.struct("b", "n")))
    return counts.groupBy("grp", "field", "day").agg(run.alias("run")).select("grp", "field", "day", F.col("run.b").alias("b"), F.col("run.n").alias("c"))


def _middle(cum: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Index of the weighted lower median of entries i..j-1; cum has a leading zero."""
    half = cum[i] + (cum[j] - cum[i] + 1) // 2
    return np.clip(np.searchsorted(cum, half) - 1, i, np.maximum(j - 1, i))


def _flat(runs: pa.Array, weights: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of a batch end to end: lengths, buckets, and counts summed up with a leading zero."""
    length = runs.value_lengths().to_numpy(zero_copy_only=False)
    return length, runs.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(weights.flatten().to_numpy(zero_copy_only=False))))


def _propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(grp, field, day, b, c) to the number of values and the local median of each run."""
    for batch in batches:
        length, b, cum = _flat(batch.column(3), batch.column(4))
        end = np.cumsum(length)
        med = b[_middle(cum, end - length, end)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(cum[end] - cum[end - length]), pa.array(med)], names=["grp", "field", "day", "n", "med"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gk, b, c, sels) to what each run counts and proposes for its selections, each with its state. A selection that is the
    run's alone is taken through all its rounds."""
    for batch in batches:
        length, b, cum = _flat(batch.column(1), batch.column(2))
        sels = batch.column(3).flatten()
        ids, lo, hi, piv, k, alone = (sels.field(f).to_numpy(zero_copy_only=False) for f in ("sel", "lo", "hi", "piv", "k", "alone"))
        run = np.repeat(np.arange(batch.num_rows), batch.column(3).value_lengths().to_numpy(zero_copy_only=False))
        # Buckets of all runs of the batch in one sorted array.
        key = np.repeat(np.arange(batch.num_rows), length) * _WIDE + b
        at = lambda x, side: np.searchsorted(key, run * _WIDE + x, side)
        i, j = at(lo, "right"), at(hi, "left")
        j = np.maximum(i, j)
        p, q = np.clip(at(piv, "left"), i, j), np.clip(at(piv, "right"), i, j)
        lt, eq, gt, last = cum[p] - cum[i], cum[q] - cum[p], cum[j] - cum[q], len(b) - 1
        med_lt, med_gt = b[np.minimum(_middle(cum, i, p), last)], b[np.minimum(_middle(cum, q, j), last)]
        k, hit, steps = k.copy(), np.full(len(ids), -_WIDE), np.ones(len(ids), np.int32)
        some = np.flatnonzero(j > i)
        open_ = some[alone[some]]
        while len(open_):
            less, same = cum[p[open_]] - cum[i[open_]], cum[q[open_]] - cum[p[open_]]
            left, right = k[open_] <= less, k[open_] > less + same
            found = open_[~left & ~right]
            hit[found] = b[p[found]]
            j[open_[left]] = p[open_[left]]
            i[open_[right]] = q[open_[right]]
            k[open_[right]] -= (less + same)[right]
            open_ = open_[left | right]
            p[open_] = _middle(cum, i[open_], j[open_])
            q[open_] = p[open_] + 1
            steps[open_] += 1
        cols = [pa.array(x[some]) for x in (lt, eq, gt, med_lt, med_gt)]
        gk = batch.column(0).take(pa.array(run[some]))
        yield pa.RecordBatch.from_arrays([gk, pa.array(ids[some]), *cols, pa.array(hit[some], mask=hit[some] == -_WIDE), pa.array(steps[some]), *[sels.field(f).take(pa.array(some)) for f in _CARRIED]], names=_NAMES)


_NAMES, _CARRIED = [f.split()[0] for f in _ROUND.split(", ")], [f.split()[0] for f in _STATE.split(", ")]


def percentiles(partials: DataFrame, spans: list[tuple[str, date, date]], qs: list[float]) -> DataFrame:
    """(grp, field, span, since, till, q, n, bucket, rounds): for each group and field with a value in the span, the
    bucket of the value of rank ``max(1, ceil(q n))``, and the rounds of pivots it took.

    ``spans`` are (name, first day, last day), both inclusive; any days may be asked for, overlapping or not. Groups
    without a value in a span, and empty partials, give no row. The bucket's value is within the partials' relative error.
    """
    spark = partials.sparkSession
    gk = F.to_json(F.struct("grp", "field"))
    day = F.unix_date("day").alias("day")
    runs = stage(partials.select(gk.alias("gk"), "grp", "field", day, "b", "c"), "runs")
    asked = spark.createDataFrame([(i * len(qs) + k, n, a.isoformat(), z.isoformat(), float(q)) for i, (n, a, z) in enumerate(spans) for k, q in enumerate(qs)], "sel int, span string, since string, till string, q double")
    asked = asked.withColumn("since", F.unix_date(F.to_date("since"))).withColumn("till", F.unix_date(F.to_date("till")))
    # A number and a proposal per group and day: joined by day to the spans that cover it.
    first = runs.select("grp", "field", "day", "b", "c").mapInArrow(_propose, "grp string, field string, day int, n long, med long")
    covered = asked.select("sel", "span", "since", "till", "q", F.explode(F.sequence("since", "till")).alias("day"))
    if sum((z - a).days + 1 for _, a, z in spans) * len(qs) <= BROADCAST_ROWS:
        covered = F.broadcast(covered)
    state = first.join(covered, "day").groupBy("grp", "field", "sel", "span", "since", "till", "q").agg(F.sum("n").alias("n"), _weighted_median("med", "n").alias("piv"), F.count("*").alias("held"))
    rank = F.greatest(F.lit(1).cast("long"), F.ceil(F.round(F.col("q") * F.col("n"), 9)).cast("long"))
    asked_of = stage(state.select(gk.alias("gk"), "grp", "field", "sel", "span", "since", "till", "q", "n", rank.alias("k"), "piv", "held"), "selections")
    state = asked_of.select("gk", "sel", F.lit(_LOW).cast("long").alias("lo"), F.lit(_HIGH).cast("long").alias("hi"), "piv", "k", "since", "till", F.lit(0).alias("rounds"), "held", F.lit(None).cast("long").alias("found"))
    steps = []
    while not (busy := state.where(F.col("found").isNull())).isEmpty():
        votes = _with_selections(runs, busy).mapInArrow(_count, _ROUND).groupBy("gk", "sel").agg(
            *[F.sum(c).alias(c) for c in ("lt", "eq", "gt")],
            *[_weighted_median(f"med_{s}", s).alias(f"med_{s}") for s in ("lt", "gt")],
            *[F.count_if(F.col(s) > 0).alias(f"held_{s}") for s in ("lt", "gt")],
            *[F.max(c).alias(c) for c in ("hit", "steps", *_CARRIED)],  # the state is the same in all rows of a selection
        )
        left, right = F.col("k") <= F.col("lt"), F.col("k") > F.col("lt") + F.col("eq")
        side = lambda c: F.when(left, F.col(f"{c}_lt")).when(right, F.col(f"{c}_gt"))
        state = stage(votes.select(
            "gk", "sel",
            F.when(right, F.col("piv")).otherwise(F.col("lo")).alias("lo"),
            F.when(left, F.col("piv")).otherwise(F.col("hi")).alias("hi"),
            side("med").alias("piv"),
            F.when(right, F.col("k") - F.col("lt") - F.col("eq")).otherwise(F.col("k")).alias("k"),
            "since", "till",
            (F.col("rounds") + F.col("steps")).alias("rounds"),
            side("held").alias("held"),
            F.coalesce("hit", F.when(~left & ~right, F.col("piv"))).alias("found"),
        ), "state")
        steps.append(state)
    done = reduce(DataFrame.unionByName, steps or [state]).where(F.col("found").isNotNull()).select("gk", "sel", "found", "rounds")
    out = asked_of.join(done, ["gk", "sel"])
    return out.select("grp", "field", "span", F.date_from_unix_date("since").alias("since"), F.date_from_unix_date("till").alias("till"), "q", "n", F.col("found").alias("bucket"), "rounds")


def _weighted_median(value: str, weight: str) -> Column:
    return F.floor(F.expr(f"percentile({value}, 0.5, {weight})"))


def _with_selections(runs: DataFrame, open_: DataFrame) -> DataFrame:
    """(gk, b, c, sels): runs with the open selections that cover their day. Each selection meets only the runs of its own
    days; a run has at most as many selections as spans cover a day, times ranks."""
    days = open_.select("gk", F.explode(F.sequence("since", "till")).alias("day"), F.struct("sel", *_CARRIED, (F.col("held") == 1).alias("alone")).alias("s"))
    sels = days.groupBy("gk", "day").agg(F.collect_list("s").alias("sels"))
    return runs.select("gk", "day", "b", "c").join(sels, ["gk", "day"]).select("gk", "b", "c", "sels")
