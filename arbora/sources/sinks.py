"""Sinks: tables, reports, and a cache of intermediate results keyed by plan."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.staging import shared_folder


def write_table(df: DataFrame, path: str, by: list[str] | None = None, mode: str = "overwrite") -> None:
    w = df.write.mode(mode)
    (w.partitionBy(*by) if by else w).parquet(path)


def write_report(df: DataFrame, path: str, form: str = "csv") -> None:
    """A small report as gzip CSV or JSON."""
    (df.write.mode("overwrite").option("compression", "gzip").json(path) if form == "json" else df.write.mode("overwrite").option("header", True).option("compression", "gzip").csv(path))


def plan_key(df: DataFrame) -> str | None:
    """A key of what a DataFrame computes and from what: its analysed plan without expression numbers, as a tree that is
    not cut short, and every input file with its length and time of change. None for plans
    over rows held in memory, which neither say."""
    plan = df._jdf.queryExecution().analyzed()
    jvm = df.sparkSession.sparkContext._jvm
    conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    tree = plan.treeString(True, False, 2**31 - 1, False, False)
    if re.search(r"LogicalRDD|LocalRelation|ExternalRDD", tree):
        return None
    parts = [re.sub(r"#\d+L?", "", tree), df.schema.json()]
    for f in sorted(df.inputFiles()):
        path = jvm.org.apache.hadoop.fs.Path(f)
        s = path.getFileSystem(conf).getFileStatus(path)
        parts.append(f"{f} {s.getLen()} {s.getModificationTime()}")
    return hashlib.sha256("\n".join(parts).encode()).hexdigest()


def cached(df: DataFrame, cost_seconds: float = 0.0, least_seconds: float = 0.0) -> DataFrame:
    """``df`` read from the shared folder if an equal plan was written there before; else written, if computing it costs
    at least ``least_seconds``. Half-written entries have no ``_SUCCESS`` mark and are not read. Plans without a key are
    not kept."""
    spark = df.sparkSession
    if (key := plan_key(df)) is None:
        return df
    path = f"{shared_folder(spark)}/arbora-cache-{key}"
    jvm = spark.sparkContext._jvm
    done = jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    fs = done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(done):
        if cost_seconds < least_seconds:
            return df
        df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fold_hash(df: DataFrame) -> DataFrame:
    """One hash of all rows whatever their order: XOR and sum of row hashes, with the number of rows."""
    h = F.xxhash64(*df.columns)
    return df.agg(F.count("*").alias("n"), F.bit_xor(h).alias("x"), F.sum(F.pmod(h, F.lit(1 << 31))).alias("s"))
