"""Queries of the problems on texts and training data, and their SQL."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.io import table
from arbora.keys import key
from arbora.llm import leakage, neardup, quantiles, tokenizer, truncation
from arbora.llm.sql import SQL
from arbora.staging import stage


#: Percentiles asked for, and the fields measured.
QS, FIELDS = [0.05, 0.5, 0.9, 0.99], ["eval_time", "overhead_time"]


def _methods(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "methods").select("id", "host_id", "eval_time", "overhead_time", "recorded_at").dropDuplicates()


def _partials(spark: SparkSession, folder: str) -> DataFrame:
    """Daily partials of methods; a row delivered twice is one measurement."""
    return quantiles.day_partials(_methods(spark, folder), "host_id", FIELDS, "recorded_at")


def p1_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """Percentiles per host for each day, each week (from Monday) and all days."""
    partials = stage(_partials(spark, folder), "partials")
    first, last = partials.agg(F.min("day"), F.max("day")).first()
    days = [first + timedelta(i) for i in range((last - first).days + 1)] if first else []
    weeks = sorted({d - timedelta(d.weekday()) for d in days})
    spans = [("day", d, d) for d in days] + [("week", d, d + timedelta(6)) for d in weeks] + ([("all", first, last)] if first else [])
    p = quantiles.percentiles(partials, spans, QS)
    return p.select(F.col("grp").alias("host_id"), "field", "span", F.col("since").cast("string").alias("since"), "q", "n", quantiles.bucket_value(F.col("bucket")).alias("value"))


def p1_within(spark: SparkSession, folder: str) -> DataFrame:
    """Percentiles per host over all days held against the measurements themselves: ``within`` is true if the value of
    exactly that rank lies within the stated error of the one reported. Measurements are counted, not sorted."""
    partials = stage(_partials(spark, folder), "partials")
    first, last = partials.agg(F.min("day"), F.max("day")).first()
    p = quantiles.percentiles(partials, [("all", first, last)] if first else [], QS)
    p = stage(p.select("grp", "field", "q", "n", quantiles.bucket_value(F.col("bucket")).alias("value")), "percentiles")
    rows = quantiles.measured(_methods(spark, folder), "host_id", FIELDS, "recorded_at").select("grp", "field", "v")
    slack = 1.01 * quantiles.EPS * F.abs("value") + quantiles.MIN
    asked = p.groupBy("grp", "field").agg(F.collect_list(F.struct("q", "n", (F.col("value") - slack).alias("low"), (F.col("value") + slack).alias("high"))).alias("asked"))
    held = rows.join(asked, rows["grp"].eqNullSafe(asked["grp"]) & (rows["field"] == asked["field"])).select(rows["grp"], rows["field"], "v", F.explode("asked").alias("a"))
    counts = held.groupBy("grp", "field", F.col("a.q").alias("q"), F.col("a.n").alias("n")).agg(F.count_if(F.col("v") < F.col("a.low")).alias("below"), F.count_if(F.col("v") <= F.col("a.high")).alias("upto"))
    k = F.greatest(F.lit(1), F.ceil(F.round(F.col("q") * F.col("n"), 9)))
    return counts.select(F.col("grp").alias("host_id"), "field", "q", "n", ((F.col("below") < k) & (k <= F.col("upto"))).alias("within"))


def p1_day_partials(spark: SparkSession, folder: str) -> DataFrame:
    """What is kept per host and day to combine later: number of values and of buckets, least and greatest bucket."""
    p = _partials(spark, folder)
    return p.select(F.col("grp").alias("host_id"), "field", F.col("day").cast("string").alias("day"), F.aggregate("c", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"), F.size("b").alias("n_buckets"), F.element_at("b", 1).alias("first_bucket"), F.element_at("b", -1).alias("last_bucket"))


def _trees(spark: SparkSession, folder: str) -> DataFrame:
    a = table(spark, folder, "individuals").select(F.lit("individuals").alias("tbl"), key("hash").alias("id"), F.col("tree").alias("text"))
    b = table(spark, folder, "nnlearnerstatistics").select(F.lit("nnlearnerstatistics").alias("tbl"), key("hash").alias("id"), F.col("current_tree").alias("text"))
    return a.unionByName(b)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    members, links = neardup.near_duplicates(_trees(spark, folder))
    return neardup.linked_ids(members, links).select("tbl", F.col("id_a").alias("hash_a"), F.col("id_b").alias("hash_b"))


def p3_classes(spark: SparkSession, folder: str) -> DataFrame:
    """One row per program and class of equal trees, with the number of copies and of links to other classes. A class is
    named by the least of its programs."""
    c = neardup.classed(*neardup.near_duplicates(_trees(spark, folder)))
    return c.select("tbl", F.col("id").alias("hash"), F.col("least_id").alias("class_hash"), "n_copies", "n_links")


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokenizer.encoded(table(spark, folder, "documents").select("doc_id", "text")).select("doc_id", "ids")


def p6_source_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Texts and tokens per source."""
    return tokenizer.token_counts(table(spark, folder, "documents"), "source")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.leaked_spans(table(spark, folder, "documents"), table(spark, folder, "eval_items")).select("doc_id", "item_id").distinct()


def p7_spans(spark: SparkSession, folder: str) -> DataFrame:
    """Where in each document the passages stand."""
    return leakage.leaked_spans(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p7_items(spark: SparkSession, folder: str) -> DataFrame:
    """Per suite and item: documents it leaked into."""
    found = p7_found(spark, folder).groupBy("item_id").agg(F.count("*").alias("n_docs"))
    return table(spark, folder, "eval_items").select("item_id", "suite").distinct().join(found, "item_id")


def _cut(spark: SparkSession, folder: str) -> DataFrame:
    return truncation.truncated(table(spark, folder, "documents").select("doc_id", "lang", "source", "text"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return _cut(spark, folder).where("cut").select("doc_id")


def p8_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Per source: texts, texts cut off, and their share."""
    g = _cut(spark, folder).groupBy("source").agg(F.count("*").alias("n_texts"), F.count_if("cut").alias("n_cut"))
    return g.withColumn("share", F.col("n_cut") / F.col("n_texts"))


QUERIES = {f.__name__: f for f in (p1_percentiles, p1_within, p1_day_partials, p3_found, p3_classes, p6_ids, p6_source_tokens, p7_found, p7_spans, p7_items, p8_found, p8_sources)}
__all__ = ["QUERIES", "SQL"]
