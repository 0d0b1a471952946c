"""Writes to the run store as merges of change sets: every function takes a table and its changes and returns the table
after them. Many changes of one key are added up before they meet the table, so a hot key is one row in the join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.operators.store import insert_missing, upsert


def insert_modules(modules: DataFrame, rows: DataFrame) -> DataFrame:
    """New modules by number; a number that exists keeps its row."""
    return insert_missing(modules, rows, ["mod_num"])


def update_modules(modules: DataFrame, rows: DataFrame) -> DataFrame:
    """Age, tree, error and weights of known and new modules; occurrences are added."""
    put = [c for c in ("age", "tree", "error_string", "weights", "pickle") if c in modules.columns and c in rows.columns]
    return upsert(modules, rows, ["mod_num"], add=["num_occur"] if "num_occur" in rows.columns else [], put=put)


def insert_networks(stats: DataFrame, rows: DataFrame) -> DataFrame:
    """New (hash, age) rows of network statistics."""
    return insert_missing(stats, rows, ["hash", "age"])


def update_networks(stats: DataFrame, rows: DataFrame) -> DataFrame:
    """Parents, tree and error of network statistics by (hash, age)."""
    return upsert(stats, rows, ["hash", "age"], put=[c for c in ("parents", "current_tree", "error_string") if c in stats.columns and c in rows.columns])


def append_numbered(table: DataFrame, rows: DataFrame, id: str = "id") -> DataFrame:
    """``rows`` appended under new ids above all old ones: unique and ascending, not without gaps, as no task numbers
    all rows. This is how a generation's history and front are added."""
    top = table.agg(F.coalesce(F.max(id), F.lit(0))).first()[0]
    new = rows.withColumn(id, (F.lit(top + 1) + F.monotonically_increasing_id()).cast(table.schema[id].dataType))
    return table.unionByName(new, allowMissingColumns=True)


def set_dirty(cache: DataFrame, ids: DataFrame, host: str | None = None) -> DataFrame:
    """Entries of ``ids`` marked as absent from disk; after a failed write, those of the writing host only."""
    hit = ids.select("id").distinct().withColumn("__hit", F.lit(True))
    mark = F.col("__hit") if host is None else F.col("__hit") & (F.col("host_id") == host)
    return cache.join(hit, "id", "left").withColumn("dirty", F.when(mark, 1).otherwise(F.col("dirty")).cast(cache.schema["dirty"].dataType)).select(*cache.columns)


def written(cache: DataFrame, writes: DataFrame, with_size: bool = True) -> DataFrame:
    """Entries written: write time added, on disk, and their size where it was measured."""
    w = writes.withColumn("dirty", F.lit(0))
    return upsert(cache, w, ["id"], add=["write_time"], put=["dirty", *(["size_kb"] if with_size else [])])


def add_times(table: DataFrame, times: DataFrame, column: str) -> DataFrame:
    """A time or counter column increased by all changes of its key."""
    return upsert(table, times, ["id"], add=[column])


def set_error(methods: DataFrame, errors: DataFrame) -> DataFrame:
    """Methods that failed: flag and text; the greatest text where one method failed several times."""
    return upsert(methods, errors.withColumn("error", F.lit(1)), ["id"], put=["error", "error_string"])


def set_special_error(methods: DataFrame, texts: DataFrame) -> DataFrame:
    """Only the text of an error."""
    return upsert(methods, texts, ["id"], put=["error_string"])


def insert_statistics(statistics: DataFrame, row: DataFrame) -> DataFrame:
    """Statistics of a generation appended; columns either side lacks are added and NULL."""
    return statistics.unionByName(row, allowMissingColumns=True)
