"""Loaders of instance files and stores, as explicit schemas over Spark's own readers.

The first line of a delimited file is always a header and never data. Lines are numbered by their place in the file
where an order matters: files are small or were split one per partition, as gzip files are.
"""

from __future__ import annotations

import io
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_STREAM = "row_id long, stream array<array<double>>, target array<double>"


def features_csv(spark: SparkSession, path: str) -> DataFrame:
    """(row_id, features, target): numbers of each line, the last one the target. Large files are split; the order of
    lines is not kept."""
    lines = spark.read.schema("value string").csv(path, sep="\u0001", quote="", header=True, enforceSchema=True).where("trim(value) <> ''")
    x = F.transform(F.split("value", ","), lambda v: F.trim(v).try_cast("double"))
    return lines.select(F.monotonically_increasing_id().alias("row_id"), F.slice(x, 1, F.size(x) - 1).alias("features"), F.element_at(x, -1).alias("target"))


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their number in the file and a row id that is unique over files. A file is read as one record by the
    JVM and cut into lines there."""
    files = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    cut = files.select("file", F.posexplode(F.split(F.regexp_replace("value", "\r?\n$", ""), "\r?\n")).alias("line", "value"))
    return cut.select("file", "line", "value", (F.pmod(F.xxhash64("file"), F.lit(1 << 31)) * (1 << 31) + F.col("line")).alias("row_id"))


def text_csv(spark: SparkSession, path: str, labels: int = 1) -> DataFrame:
    """(row_id, text, target): quoted text, then one label or more."""
    schema = ", ".join(["text string", *[f"l{i} double" for i in range(labels)]])
    t = spark.read.schema(schema).csv(path, header=True, quote='"', escape='"', multiLine=True, enforceSchema=True)
    return t.select(F.xxhash64("text", *[f"l{i}" for i in range(labels)]).alias("row_id"), "text", F.array(*[f"l{i}" for i in range(labels)]).alias("target"))


def summaries_csv(spark: SparkSession, path: str) -> DataFrame:
    """(row_id, text, target): text and a bracketed, space-separated vector."""
    t = spark.read.schema("text string, v string").csv(path, header=True, quote='"', escape='"', multiLine=True, enforceSchema=True)
    v = F.transform(F.filter(F.split(F.regexp_replace("v", r"[\[\]]", " "), r"\s+"), lambda x: x != ""), lambda x: x.cast("float"))
    return t.select(F.xxhash64("text", "v").alias("row_id"), "text", v.alias("target"))


def many_to_one(spark: SparkSession, path: str) -> DataFrame:
    """Streams of time and value pairs with one truth: lines ``t,v,t,v,..,truth``; ``N=k`` in the first line means k
    values after each time."""
    lines = _numbered(spark, path)
    k = lines.where("line = 0").select("file", F.coalesce(F.try_to_number(F.regexp_extract("value", r"N\s*=\s*(\d+)", 1), F.lit("999")), F.lit(1)).cast("int").alias("k"), F.col("value").rlike("N\\s*=").alias("head"))
    x = F.transform(F.split("value", ","), lambda v: v.try_cast("double"))
    body = lines.join(F.broadcast(k), "file").where("line > 0 or not head").select("row_id", "k", x.alias("x"))
    n = F.floor((F.size("x") - 1) / (F.col("k") + 1)).cast("int")
    stream = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda c: F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get("x", i * (F.col("k") + 1) + 1 + c)))
    return body.select("row_id", stream.alias("stream"), F.array(F.element_at("x", -1)).alias("target"))


def _pairs(spark: SparkSession, path: str, skip: int) -> DataFrame:
    """Lines two by two, after ``skip`` header lines: (file, pair, a, b)."""
    lines = _numbered(spark, path).where((F.col("line") >= skip) & (F.trim("value") != ""))
    cells = F.transform(F.split("value", ","), lambda v: F.trim(v).try_cast("double"))
    p = lines.select("file", F.floor((F.col("line") - skip) / 2).alias("pair"), F.pmod(F.col("line") - skip, F.lit(2)).alias("side"), cells.alias("x"))
    return p.groupBy("file", "pair").agg(F.max(F.when(F.col("side") == 0, F.col("x"))).alias("a"), F.max(F.when(F.col("side") == 1, F.col("x"))).alias("b"))


def _every_second(col: str):
    return F.transform(F.sequence(F.lit(1), F.size(col) - 1, F.lit(2)), lambda i: F.get(F.col(col), i))


def many_to_many(spark: SparkSession, path: str) -> DataFrame:
    """Pairs of lines, a sample and a truth, each ``t,v,t,v,..``."""
    return _pairs(spark, path, 0).select(F.xxhash64("file", "pair").alias("row_id"), F.array(_every_second("a")).alias("stream"), _every_second("b").alias("target"))


def many_to_some(spark: SparkSession, path: str, n: int, m: int) -> DataFrame:
    """Pairs of lines cut into rows of ``n`` and ``m`` numbers, after a header line."""
    cut = lambda c, w: F.transform(F.sequence(F.lit(0), F.floor(F.size(c) / w).cast("int") - 1), lambda i: F.slice(F.col(c), i * w + 1, w))
    return _pairs(spark, path, 1).select(F.xxhash64("file", "pair").alias("row_id"), cut("a", n).alias("stream"), cut("b", m).alias("target"))


def images_csv(spark: SparkSession, path: str, height: int, width: int, channels: int = 1) -> DataFrame:
    """Pairs of lines, a flattened image and its centroids, after a header line."""
    p = _pairs(spark, path, 1)
    centroids = F.transform(F.sequence(F.lit(0), F.floor(F.size("b") / 2).cast("int") - 1), lambda i: F.struct(F.get("b", i * 2).alias("r"), F.get("b", i * 2 + 1).alias("c")))
    return p.select(F.xxhash64("file", "pair").alias("row_id"), F.struct(F.lit(height).alias("h"), F.lit(width).alias("w"), F.lit(channels).alias("c"), F.col("a").alias("data")).alias("image"), F.when(F.size("b") > 1, centroids).alias("target"))


def image_directory(spark: SparkSession, folder: str, labels: str) -> DataFrame:
    """Image files with the labels of a CSV in the order of their names: (row_id, path, content, target).

    Ranks of names are over file names alone, of which there are as many as images in one directory.
    """
    from pyspark.sql import Window

    files = spark.read.format("binaryFile").load(folder)
    rank = files.select("path", (F.row_number().over(Window.orderBy("path")) - 1).alias("line"))
    lab = _numbered(spark, labels).where("trim(value) <> ''").select("line", F.transform(F.split("value", ","), lambda v: v.try_cast("double")).alias("target"))
    return files.join(rank, "path").join(lab, "line").select(F.col("line").cast("long").alias("row_id"), "path", "content", "target")


def npz(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Arrays ``arr`` of (payload, truth) rows in .npz files: (row_id, features or stream, target). Object arrays are not
    unpickled; convert such files once."""
    name = "stream array<array<double>>" if stream else "features array<double>"

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p, content in zip(pdf["path"], pdf["content"]):
                with np.load(io.BytesIO(content), allow_pickle=False) as z:
                    x, t = z["x"].astype(float), z["y"].astype(float).reshape(len(z["x"]), -1)
                base = zlib.crc32(p.encode()) << 31
                yield pd.DataFrame({"row_id": base + np.arange(len(x)), "x": [r.tolist() for r in (x if stream else x.reshape(len(x), -1))], "target": [r.tolist() for r in t]}).rename(columns={"x": name.split()[0]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(read, f"row_id long, {name}, target array<double>")


def fixed_width(spark: SparkSession, path: str, layout: list[tuple[str, int, str]]) -> DataFrame:
    """Lines cut by (name, length, type); values are trimmed, empty ones NULL."""
    at, cols = 1, []
    for name, length, kind in layout:
        v = F.trim(F.substring("value", at, length))
        cols.append(F.when(v != "", v).try_cast(kind).alias(name))
        at += length
    return spark.read.text(path).select(*cols)


def trimmed_csv(spark: SparkSession, path: str) -> DataFrame:
    """Every field of a CSV without white space around it."""
    t = spark.read.csv(path, header=True)
    return t.select(*[F.trim(F.col(f"`{c}`")).alias(c.strip()) for c in t.columns])


def programs(spark: SparkSession, path: str) -> DataFrame:
    """Program files: ``name: expression`` lines define modules, other lines are programs; ``#`` begins a comment."""
    t = spark.read.text(path).select(F.trim(F.regexp_replace("value", r"#.*$", "")).alias("v")).where("v <> ''")
    return t.select(F.when(F.col("v").rlike(r"^\w+\s*:"), F.regexp_extract("v", r"^(\w+)", 1)).alias("name"), F.regexp_replace("v", r"^\w+\s*:\s*", "").alias("expr"))


def run_log(spark: SparkSession, path: str) -> DataFrame:
    """(generation, line, value) of a run's log: lines belong to the last ``generation n`` line above them in the file."""
    from pyspark.sql import Window

    lines = _numbered(spark, path)
    g = F.regexp_extract("value", r"(?i)generation\D*(\d+)", 1)
    w = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("generation", F.last(F.when(g != "", g).cast("int"), ignorenulls=True).over(w)).select("generation", "line", "value")


def store_table(spark: SparkSession, url: str, name: str, **options: str) -> DataFrame:
    """A table of a relational run store, by JDBC."""
    return spark.read.format("jdbc").options(url=url, dbtable=name, **options).load()
