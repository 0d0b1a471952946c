"""Streaming forms of windowed operators, evaluation queues and online learners, on Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_events(spark: SparkSession, folder: str, schema, files_per_trigger: int = 10) -> DataFrame:
    """Parquet files of a folder as a stream, times as instants."""
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def hopping(events: DataFrame, size: str, slide: str, late: str = "10 minutes", by: str = "event_type") -> DataFrame:
    """Sums and counts per hopping window; rows later than the watermark are left out."""
    w = F.window("ts", size, slide)
    src = events.withWatermark("ts", late) if events.isStreaming else events
    g = src.groupBy(w.alias("w"), by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("start"), by, "n", "total")


def sessions(events: DataFrame, gap: str, late: str = "10 minutes", by: str = "user_id") -> DataFrame:
    """Sessions of a user, closed by a gap."""
    src = events.withWatermark("ts", late) if events.isStreaming else events
    g = src.groupBy(F.session_window("ts", gap).alias("w"), by).agg(F.count("*").alias("n"))
    return g.select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def running_mean(events: DataFrame, size: int = 5) -> DataFrame:
    """Per user the mean of the last ``size`` values after each batch; the state is those values alone."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        for pdf in batches:
            held = (held + pdf.sort_values("ts")["value"].tolist())[-size:]
        state.update((held,))
        yield pd.DataFrame({"user_id": [key[0]], "mean": [sum(held) / len(held) if held else None]})

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, mean double", "held array<double>", "update", GroupStateTimeout.NoTimeout)


def evaluation_queue(spark: SparkSession, folder: str, checkpoint: str, evaluate: Callable[[DataFrame, int], None]):
    """Program files dropped into a folder are handed to ``evaluate`` batch by batch, each once; ends when all are read."""
    s = spark.readStream.text(folder).select(F.trim("value").alias("program")).where("program <> '' and not program like '#%'")
    return s.writeStream.foreachBatch(evaluate).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def online_learner(stream: DataFrame, checkpoint: str, update: Callable[[DataFrame, int], None]):
    """A learner fed batch by batch; ``update`` keeps the weights (see learners.passive_aggressive)."""
    return stream.writeStream.foreachBatch(update).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
