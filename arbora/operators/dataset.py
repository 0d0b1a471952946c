"""Operators on datasets: rows with arrays, paired by row id, by mode and axis.

A dataset is a DataFrame with ``row_id`` and array columns ``features`` and ``stream``. A mode says where an operator
reads and writes: features to features, stream to stream (both overwrite), or stream to features (appends). Datasets
are paired by ``row_id``; rows without a partner are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

import arbora.functions.detection
import arbora.functions.kernels
import arbora.functions.vector  # noqa: F401 - these register the operators
from arbora.functions.registry import Op, find

F2F, S2S, S2F = "FEATURES_TO_FEATURES", "STREAM_TO_STREAM", "STREAM_TO_FEATURES"
_COLUMNS = {F2F: ("features", "features"), S2S: ("stream", "stream"), S2F: ("stream", "features")}


def finite(col: Column | str) -> Column:
    """True if every element of an array is a finite number."""
    c = F.col(col) if isinstance(col, str) else col
    return F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))


def _shaped(values: np.ndarray, width: int | None) -> np.ndarray | None:
    """Rows of pixels as images of a width, or square ones; None if they are no such images."""
    n = values.shape[1]
    w = width or int(round(n**0.5))
    return values.reshape(len(values), n // w, w) if n % w == 0 and (width or w * w == n) else None


def fit_kernel(df: DataFrame, op: Op, source: str, params: dict, points: str | None = None, width: int | None = None) -> np.ndarray:
    """What an operator learns from all rows: sums of a few numbers per row, added up over the cluster in a pass of its own.
    ``points`` is a column of target points, an array of (row, column) per image."""
    cols = [source] + ([points] if points else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            groups: dict[int, list[int]] = {}
            values = [None if v is None else np.asarray(v, float) for v in b.column(0).to_numpy(zero_copy_only=False)]
            for r, v in enumerate(values):
                if v is not None and len(v):
                    groups.setdefault(len(v), []).append(r)
            at = b.column(1).to_pylist() if points else None
            for rows in groups.values():
                if (x := _shaped(np.stack([values[r] for r in rows]), width)) is None:
                    continue
                s = op.fit(x, [at[r] for r in rows] if points else None, **params).sum(axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(s), dtype=np.int32)), pa.array(s)], names=["at", "s"])

    got = df.select(*cols).mapInArrow(run, "at int, s double").groupBy("at").agg(F.sum("s").alias("s")).collect()
    size = len(op.fit(np.zeros((0, 1, 1)), None, **params)[:1].T)
    out = np.zeros(size)
    for r in got:
        out[r["at"]] = r["s"]
    return out


def run_kernel(df: DataFrame, op: Op, inputs: list[str], output: str, params: dict, width: int | None = None, points: str | None = None, train: DataFrame | None = None) -> DataFrame:
    """A kernel on array columns, batch by batch; rows of one length (and images of one shape) run together.

    NULL and empty arrays, and rows whose inputs differ in length, give NULL. Images are row-major, of the given
    ``width`` or else square. Operators that learn a template learn it from ``train`` (default ``df``), around the target
    ``points`` there or else the brightest pixels; without any, the template is zero.
    """
    if op.fit:
        params = {**params, "fitted": fit_kernel(df if train is None else train, op, inputs[0], params, points, width)}
    rest = [c for c in df.columns if c != output]
    schema = T.StructType([*[df.schema[c] for c in rest], T.StructField(output, T.ArrayType(T.DoubleType()))])
    at = [df.columns.index(c) for c in inputs]
    keep = [df.columns.index(c) for c in rest]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            xs = [[None if v is None else np.asarray(v, float) for v in b.column(i).to_numpy(zero_copy_only=False)] for i in at]
            out: list = [None] * b.num_rows
            groups: dict[int, list[int]] = {}
            for r, row in enumerate(zip(*xs)):
                if all(v is not None and len(v) == len(row[0]) > 0 for v in row):
                    groups.setdefault(len(row[0]), []).append(r)
            for n, rows in groups.items():
                stacked = [np.stack([x[r] for r in rows]) for x in xs]
                if op.image:
                    stacked = [_shaped(s, width) for s in stacked]
                    if stacked[0] is None:
                        continue
                with np.errstate(all="ignore"):
                    result = op.kernel(*stacked, **params)
                for r, v in zip(rows, result):
                    out[r] = np.asarray(v, float).ravel()
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in keep], pa.array(out, pa.list_(pa.float64()))], names=[f"c{i}" for i in range(len(keep) + 1)])

    return df.mapInArrow(run, schema)


def apply(name: str, datasets: list[DataFrame], mode: str = F2F, *args) -> DataFrame:
    """An operator on one to four datasets; the first gives the other columns of the result. Operators that learn a
    template learn it from the rows of split 'train', where there are splits, around the points in ``target``, where
    these are points."""
    op = find(name)
    if len(datasets) != op.inputs:
        raise ValueError(f"{name} takes {op.inputs} datasets, not {len(datasets)}")
    source, target = _COLUMNS[mode]
    params = op.fill(args)
    df = datasets[0].withColumn("__x0", F.col(source))
    for k, other in enumerate(datasets[1:], 1):
        df = df.join(other.select("row_id", F.col(source).alias(f"__x{k}")), "row_id")
    names = [f"__x{k}" for k in range(op.inputs)]
    if op.native:
        df = df.withColumn("__out", F.expr(op.native(names, params)))
    else:
        learn = {}
        if op.fit and isinstance(df.schema["target"].dataType if "target" in df.columns else None, T.ArrayType) and isinstance(df.schema["target"].dataType.elementType, T.ArrayType):
            learn["points"] = "target"
        if op.fit and "split" in df.columns:
            learn["train"] = df.where("split = 'train'")
        df = run_kernel(df, op, names, "__out", params, **learn)
    out = F.concat(F.coalesce(F.col("features"), F.array().cast("array<double>")), F.col("__out")) if mode == S2F else F.col("__out")
    empty = F.coalesce(F.size(source), F.lit(-1)) <= 0
    return df.withColumn(target, F.when(empty, F.col(target)).otherwise(out)).drop("__out", *names)


def if_then_else(condition: DataFrame, yes: DataFrame, no: DataFrame, column: int, mode: str = F2F) -> DataFrame:
    """Row by row the payload of ``yes`` or ``no``, by element ``column`` of the condition's features."""
    c, t = _COLUMNS[mode][0], _COLUMNS[mode][1]
    j = yes.join(no.select("row_id", F.col(c).alias("__no")), "row_id").join(condition.select("row_id", F.try_element_at("features", F.lit(column + 1)).alias("__if")), "row_id")
    return j.withColumn(t, F.when(F.coalesce("__if", F.lit(0.0)) != 0, F.col(c)).otherwise(F.col("__no"))).drop("__no", "__if")


def slices(df: DataFrame, size: int, step: int, col: str = "stream") -> DataFrame:
    """Every full hopping window of a row: (row_id, window, values)."""
    n = F.floor((F.size(col) - size) / step).cast("int")
    windows = F.when(F.size(col) >= size, F.transform(F.sequence(F.lit(0), n), lambda k: F.slice(F.col(col), k * step + 1, size)))
    return df.select("row_id", F.posexplode(windows).alias("window", "values"))


def copy_stream_to_target(df: DataFrame) -> DataFrame:
    return df.withColumn("target", F.col("stream"))


def map_labels(instances: DataFrame, labels: DataFrame) -> DataFrame:
    """Hand a flat list of labels (pos from 0, label) out to the elements of non-empty instances, in row order.

    Offsets come from the sizes of the rows before, added up over blocks of rows first, so no task sees all rows.
    """
    from pyspark.sql import Window

    sizes = instances.select("row_id", F.coalesce(F.size("features"), F.lit(0)).alias("n")).withColumn("blk", F.floor(F.col("row_id") / 65536))
    per = sizes.groupBy("blk").agg(F.sum("n").alias("t"))
    before = per.select("blk", F.coalesce(F.sum("t").over(Window.orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    w = Window.partitionBy("blk").orderBy("row_id").rowsBetween(Window.unboundedPreceding, -1)
    start = sizes.join(before, "blk").select("row_id", "n", (F.col("base") + F.coalesce(F.sum("n").over(w), F.lit(0))).alias("s")).where("n > 0")
    cells = start.select("row_id", F.posexplode(F.sequence("s", F.col("s") + F.col("n") - 1)).alias("at", "pos"))
    return cells.join(labels, "pos").groupBy("row_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "label"))), lambda x: x["label"]).alias("target"))


def filter_centroids(df: DataFrame) -> DataFrame:
    """Detections (``labels``) whose predicted ``target`` is not zero, as the new target; none gives one (-1, -1)."""
    kept = F.transform(F.filter(F.arrays_zip("target", "labels"), lambda z: F.coalesce(z["target"], F.lit(0.0)) != 0), lambda z: z["labels"])
    none = F.array(F.array(F.lit(-1.0), F.lit(-1.0)))
    return df.withColumn("target", F.when(F.size(kept) > 0, kept).otherwise(none))
