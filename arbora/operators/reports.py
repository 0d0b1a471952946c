"""Reports and look-ups over the run store, as DataFrame operators. Tables come cleaned: one row per delivered record, keys in
lower case without spaces (see :func:`records`)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Finite numbers are those below this bound.
FINITE = 1e300


def records(df: DataFrame, *columns: str, key: str | None = None) -> DataFrame:
    """Rows delivered twice count once; ``key`` is compared in lower case without spaces around it."""
    cols = [F.lower(F.trim(key)).alias(key) if c == key else F.col(c) for c in columns or df.columns]
    return df.select(*cols).distinct()


def finite(c: str) -> Column:
    return F.abs(F.col(c)) < FINITE


def lookup(df: DataFrame, key: str, value: str | None) -> DataFrame:
    """Rows of one key, with their number ``n_rows``."""
    mine = df.where(F.col(key) == value)
    return mine.join(F.broadcast(mine.groupBy(key).agg(F.count("*").alias("n_rows"))), key)  # one row


def status_counts(people: DataFrame) -> DataFrame:
    return people.where(F.col("purged_at").isNull()).groupBy("evaluation_status").agg(F.count("*").alias("n"))


def count_status(people: DataFrame, *status: str) -> DataFrame:
    return people.where(F.col("evaluation_status").isin(*status)).agg(F.count("*").alias("n"))


def random_unevaluated(people: DataFrame, n: int, seed: int) -> DataFrame:
    """n unevaluated programs in a seeded random order, marked as in progress. Only the n come to one place."""
    waiting = people.where(F.col("evaluation_status") == "NOT_EVALUATED").select("hash").distinct()
    return waiting.orderBy(F.md5(F.concat(F.lit(str(seed)), "hash")), "hash").limit(n).withColumn("evaluation_status", F.lit("IN_PROGRESS"))


def last_front(people: DataFrame, fronts: DataFrame) -> DataFrame:
    """Programs on the front of the last generation of the last optimisation."""
    at = fronts.agg(F.max(F.struct("optimization", "generation")).alias("at")).select("at.optimization", "at.generation")
    members = fronts.join(F.broadcast(at), ["optimization", "generation"]).select("hash")  # one row
    return people.join(members.where(F.col("hash").isNotNull()), "hash", "left_semi")


def front_members(people: DataFrame, fronts: DataFrame, optimization: int) -> DataFrame:
    """Front members of each generation with their objectives."""
    scores = people.select("hash", "reviews_error_rate", "reviews_num_params").distinct()
    return fronts.where(F.col("optimization") == optimization).select("generation", "hash").distinct().join(scores, "hash")


def sizes(history: DataFrame) -> DataFrame:
    return history.groupBy("optimization", "generation").agg(F.countDistinct("hash").alias("n"))


def absent(cache: DataFrame) -> DataFrame:
    """Entries that are not on disk, for whatever reason, marked as absent."""
    return cache.withColumn("dirty", F.when(F.col("dirty") != 0, 1).otherwise(F.col("dirty")))


def cache_sizes(cache: DataFrame) -> DataFrame:
    return cache.groupBy("host_id").agg(F.sum(F.when(F.col("dirty") == 0, F.col("size_kb")).otherwise(0)).alias("size_kb"))


def cache_hits(cache: DataFrame) -> DataFrame:
    return cache.groupBy("host_id").agg(F.coalesce(F.sum("num_reads"), F.lit(0)).alias("hits"))


def host_statistics(cache: DataFrame, methods: DataFrame) -> DataFrame:
    """Sums over cache and methods per host, NULL as 0, with a derived total. NaN and infinite times are left out."""
    clean = lambda c: F.when(~F.isnan(c), F.col(c))
    c = cache.where(F.col("host_id").isNotNull()).groupBy("host_id").agg(F.count_if(F.col("dirty") == 0).alias("keys_held"), F.sum("num_reads").alias("reads"), F.sum("num_writes").alias("writes"), F.sum(clean("read_time")).alias("read_time"), F.sum(clean("write_time")).alias("write_time"))
    m = methods.where(F.col("host_id").isNotNull()).groupBy("host_id").agg(F.count("*").alias("n_methods"), F.sum("error").alias("errors"), F.sum(F.when(finite("eval_time"), F.col("eval_time"))).alias("eval_time"))
    sums = ["keys_held", "reads", "writes", "read_time", "write_time", "n_methods", "errors", "eval_time"]
    j = c.join(m, "host_id", "full").select("host_id", *[F.coalesce(s, F.lit(0)).alias(s) for s in sums])
    return j.withColumn("total_time", F.col("eval_time") + F.col("read_time") + F.col("write_time"))


def keys_per_day(cache: DataFrame) -> DataFrame:
    """New entries per day and the change against the day before; the window sees a row per day."""
    day = cache.groupBy(F.to_date("recorded_at").cast("string").alias("day")).agg(F.count("*").alias("keys_added"))
    return day.withColumn("delta", F.col("keys_added") - F.lag("keys_added").over(Window.orderBy("day")))


def methods_with_entries(methods: DataFrame, links: DataFrame, cache: DataFrame) -> DataFrame:
    """Methods with their cache entries, where there are any."""
    held = cache.groupBy(F.col("id").alias("cache_id")).agg(F.min("dirty").alias("dirty"))
    named = links.select(F.col("method_id").alias("id"), F.lower(F.trim("cache_id")).alias("cache_id")).distinct()
    return methods.select("id", "host_id", "num_eval").distinct().join(named, "id", "left").join(held, "cache_id", "left").select("id", "host_id", "num_eval", "cache_id", "dirty")


def double_links(links: DataFrame) -> DataFrame:
    """Methods linked to more than one entry, an error on writing."""
    named = links.select("method_id", F.lower(F.trim("cache_id")).alias("c")).where(F.col("c").isNotNull() & (F.col("c") != ""))
    return named.groupBy("method_id").agg(F.countDistinct("c").alias("n_links")).where("n_links > 1")


def running_time(methods: DataFrame) -> DataFrame:
    """Evaluation time so far, per host and day."""
    m = methods.select("host_id", "id", "recorded_at", "eval_time").where(finite("eval_time")).distinct()
    w = Window.partitionBy("host_id", F.to_date("recorded_at")).orderBy("recorded_at", "id", "eval_time")
    return m.select("host_id", "id", "recorded_at", F.sum("eval_time").over(w).alias("running"))


def generation_statistics(history: DataFrame, people: DataFrame) -> DataFrame:
    s = history.select("generation", "hash").join(people.select("hash", "reviews_error_rate").where(finite("reviews_error_rate")), "hash").distinct()
    return s.groupBy("generation").agg(F.count("*").alias("n"), F.avg("reviews_error_rate").alias("mean_error"), F.min("reviews_error_rate").alias("best_error"))


def front_sizes(history: DataFrame, fronts: DataFrame) -> DataFrame:
    """Front sizes per generation, from the one before where missing; the window sees a row per generation."""
    f = fronts.groupBy("generation").agg(F.countDistinct("hash").alias("n"))
    g = history.select("generation").distinct().join(f, "generation", "left")
    return g.withColumn("last_n", F.coalesce("n", F.lag("n").over(Window.orderBy("generation"))))


def with_primitive(people: DataFrame, primitive: str, root: str) -> DataFrame:
    """Programs that call a primitive and have a root, without regard to case."""
    t = F.lower("tree")
    return people.where(t.contains(primitive) & t.startswith(root)).select("hash")


def best(people: DataFrame, n: int) -> DataFrame:
    """A top-k report."""
    return people.where(finite("reviews_error_rate")).orderBy("reviews_error_rate", "hash", "recorded_at").limit(n).select("hash", "reviews_error_rate")


def mean_and_variance(people: DataFrame, by: str, value: str) -> DataFrame:
    return people.where(finite(value)).groupBy(by).agg(F.avg(value).alias("mean"), F.var_pop(value).alias("variance"))


def cumulative_fronts(fronts: DataFrame) -> DataFrame:
    """Programs that were on a front up to each generation: first appearances per generation, added up over generations, of
    which there is a row each."""
    since = fronts.groupBy("hash").agg(F.min("generation").alias("generation")).groupBy("generation").agg(F.count("*").alias("new"))
    g = fronts.select("generation").distinct().join(since, "generation", "left")
    w = Window.orderBy("generation").rowsBetween(Window.unboundedPreceding, 0)
    return g.select("generation", F.sum(F.coalesce("new", F.lit(0))).over(w).alias("n"))


def front_ages(fronts: DataFrame, people: DataFrame) -> DataFrame:
    return fronts.select("generation", "hash").distinct().join(people.groupBy("hash").agg(F.max("age").alias("age")), "hash")


def same_text(people: DataFrame) -> DataFrame:
    """Programs with one text: how many, and the least hash."""
    return people.select("hash", "tree").where(F.col("tree").isNotNull()).distinct().groupBy("tree").agg(F.count("*").alias("n"), F.min("hash").alias("hash"))


def breadth(people: DataFrame) -> DataFrame:
    """Rows per program, as a minimised objective."""
    return people.where(F.col("tree").isNotNull()).groupBy("hash").agg((-F.count("*")).alias("breadth"))
