"""Relational queries over the run store, with their SQL. Tables hold rows delivered twice; each counts once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arbora.io import table
from arbora.operators import reports as R
from arbora.operators import store as S

QUERIES: dict = {}
SQL: dict[str, str] = {}
_DOCS: dict[str, str] = {}


def check(name: str, text: str, doc: str = "") -> None:
    """The SQL that checks a query; ``doc`` says what both answer. The queries stand at the end."""
    SQL[name], _DOCS[name] = text, doc


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


_I = "(SELECT DISTINCT lower(trim(hash)) AS hash, age, evaluation_status, evaluation_gen, elapsed_time, reviews_error_rate, reviews_num_params, tree, recorded_at, purged_at FROM individuals)"
_C = "(SELECT DISTINCT * FROM cache_entries)"
_M = "(SELECT DISTINCT * FROM methods)"
_P = "(SELECT DISTINCT id, optimization, generation, lower(trim(hash)) AS hash FROM paretofront WHERE hash IS NOT NULL)"
_H = "(SELECT DISTINCT id, optimization, generation, lower(trim(hash)) AS hash FROM history WHERE hash IS NOT NULL)"
_N = "(SELECT DISTINCT rec_id, lower(trim(hash)) AS hash, age, current_tree FROM nnlearnerstatistics)"

check("store_select", f"SELECT hash, age, evaluation_status, count(*) OVER (PARTITION BY hash) AS n_rows FROM {_I} i WHERE hash = (SELECT min(lower(trim(hash))) FROM individuals)", "look-up by key, with the number of its rows")
check("store_select_nn", f"SELECT rec_id, hash, age FROM {_N} n WHERE hash = (SELECT min(lower(trim(hash))) FROM nnlearnerstatistics) AND age >= 0", "look-up by key and age")
check("store_status_counts", f"SELECT evaluation_status, count(*) AS n FROM {_I} i WHERE purged_at IS NULL GROUP BY evaluation_status", "numbers evaluated, waiting, in progress")
check("store_num_evaluated", f"SELECT count(*) AS n FROM {_I} i WHERE evaluation_status = 'EVALUATED'")
check("store_num_waiting", f"SELECT count(*) AS n FROM {_I} i WHERE evaluation_status = 'WAITING_FOR_MASTER'")
check("store_unevaluated", f"SELECT count(*) AS n FROM {_I} i WHERE evaluation_status = 'NOT_EVALUATED' OR evaluation_status = 'IN_PROGRESS'")
check("store_evaluated_individuals", f"SELECT hash, age, evaluation_gen, elapsed_time FROM {_I} i WHERE evaluation_status = 'WAITING_FOR_MASTER'")
check("store_random_uneval", f"SELECT hash, 'IN_PROGRESS' AS evaluation_status FROM (SELECT DISTINCT hash FROM {_I} i WHERE evaluation_status = 'NOT_EVALUATED') u ORDER BY md5(concat('7', hash)), hash LIMIT 20", "twenty unevaluated programs in a seeded random order, marked")
check("store_num_gens", "SELECT max(generation) AS last_generation FROM history")
check("store_seeded_pareto", f"SELECT hash, age, evaluation_gen FROM {_I} i WHERE hash IN (SELECT hash FROM {_P} p WHERE optimization = (SELECT max(optimization) FROM paretofront) AND generation = (SELECT max(generation) FROM paretofront WHERE optimization = (SELECT max(optimization) FROM paretofront)))", "programs on the last front of the last optimisation")
check("store_pareto", f"SELECT p.generation, p.hash, i.reviews_error_rate, i.reviews_num_params FROM (SELECT DISTINCT generation, hash FROM {_P} p0 WHERE optimization = 0) p JOIN (SELECT DISTINCT hash, reviews_error_rate, reviews_num_params FROM {_I} i0) i ON i.hash = p.hash", "front members of each generation with their objectives")
check("store_history_sizes", f"SELECT optimization, generation, count(DISTINCT hash) AS n FROM {_H} h GROUP BY optimization, generation")
check("store_reset_cache_rows", f"SELECT id, host_id, recorded_at, CASE WHEN dirty <> 0 THEN 1 ELSE dirty END AS dirty FROM {_C} c", "entries of a host that are not on disk are marked absent")
check("store_cache_size", f"SELECT host_id, round(sum(CASE WHEN dirty = 0 THEN size_kb ELSE 0 END), 3) AS size_kb FROM {_C} c GROUP BY host_id")
check("store_cache_hits", f"SELECT host_id, coalesce(sum(num_reads), 0) AS hits FROM {_C} c GROUP BY host_id")
check(
    "store_cache_statistics",
    f"""SELECT coalesce(c.host_id, m.host_id) AS host_id, coalesce(keys_held, 0) AS keys_held, coalesce(reads, 0) AS reads, coalesce(writes, 0) AS writes, round(coalesce(read_time, 0), 4) AS read_time,
    round(coalesce(write_time, 0), 4) AS write_time, coalesce(n_methods, 0) AS n_methods, coalesce(errors, 0) AS errors, round(coalesce(eval_time, 0), 3) AS eval_time, round(coalesce(eval_time, 0) + coalesce(read_time, 0) + coalesce(write_time, 0), 3) AS total_time
    FROM (SELECT host_id, sum(CASE WHEN dirty = 0 THEN 1 ELSE 0 END) AS keys_held, sum(num_reads) AS reads, sum(num_writes) AS writes, sum(CASE WHEN NOT isnan(read_time) THEN read_time END) AS read_time, sum(CASE WHEN NOT isnan(write_time) THEN write_time END) AS write_time FROM {_C} c0 WHERE host_id IS NOT NULL GROUP BY host_id) c
    FULL JOIN (SELECT host_id, count(*) AS n_methods, sum(error) AS errors, sum(CASE WHEN abs(eval_time) < 1e300 THEN eval_time END) AS eval_time FROM {_M} m0 WHERE host_id IS NOT NULL GROUP BY host_id) m ON m.host_id = c.host_id""",
    "sums over cache and methods per host, NULL as 0, with a derived total",
)
check("store_keys_added", f"SELECT day, keys_added, keys_added - lag(keys_added) OVER (ORDER BY day) AS delta FROM (SELECT CAST(CAST(recorded_at AS DATE) AS STRING) AS day, count(*) AS keys_added FROM {_C} c GROUP BY 1) d", "new entries per day and the change against the day before; a row per day")
check("store_query_method", f"SELECT m.id, m.host_id, m.num_eval, l.cache_id, c.dirty FROM (SELECT DISTINCT id, host_id, num_eval FROM {_M} m0) m LEFT JOIN (SELECT DISTINCT method_id, lower(trim(cache_id)) AS cache_id FROM mcm) l ON l.method_id = m.id LEFT JOIN (SELECT id, min(dirty) AS dirty FROM {_C} c0 GROUP BY id) c ON c.id = l.cache_id", "methods with their cache entries, where there are any")
check("store_double_links", "SELECT method_id, count(DISTINCT lower(trim(cache_id))) AS n_links FROM mcm WHERE cache_id IS NOT NULL AND trim(cache_id) <> '' GROUP BY method_id HAVING count(DISTINCT lower(trim(cache_id))) > 1", "methods linked to more than one entry, an error on writing")
check("store_eval_time_running", f"SELECT host_id, id, recorded_at, round(sum(eval_time) OVER (PARTITION BY host_id, CAST(recorded_at AS DATE) ORDER BY recorded_at, id, eval_time), 3) AS running FROM (SELECT DISTINCT host_id, id, recorded_at, eval_time FROM {_M} m0 WHERE abs(eval_time) < 1e300) m", "evaluation time so far, per host and day")
check("store_select_statistics", f"SELECT generation, count(*) AS n, round(avg(reviews_error_rate), 6) AS mean_error, round(min(reviews_error_rate), 6) AS best_error FROM (SELECT DISTINCT h.generation, h.hash, i.reviews_error_rate FROM {_H} h JOIN {_I} i ON i.hash = h.hash WHERE abs(i.reviews_error_rate) < 1e300) s GROUP BY generation")
check("report_process_db", f"SELECT generation, n, last_n FROM (SELECT g.generation, f.n, coalesce(f.n, lag(f.n) OVER (ORDER BY g.generation)) AS last_n FROM (SELECT DISTINCT generation FROM {_H} h) g LEFT JOIN (SELECT generation, count(DISTINCT hash) AS n FROM {_P} p GROUP BY generation) f ON f.generation = g.generation) x", "front sizes per generation, from the one before where missing; a row per generation")
check("report_valid", f"SELECT hash, reviews_error_rate, reviews_num_params FROM {_I} i WHERE reviews_error_rate < 1e300 AND reviews_num_params < 1e300")
check("report_invalid", f"SELECT hash, reviews_error_rate FROM {_I} i WHERE reviews_error_rate > 1e300 AND NOT isnan(reviews_error_rate)")
check("report_filter", f"SELECT hash FROM {_I} i WHERE lower(tree) LIKE '%layer(%' AND lower(tree) LIKE 'nnlearner(%'", "programs with a primitive, and with a root")
check("report_best", f"SELECT hash, reviews_error_rate FROM {_I} i WHERE abs(reviews_error_rate) < 1e300 ORDER BY reviews_error_rate, hash, recorded_at LIMIT 10", "a top-k report")
check("report_mean_variance", f"SELECT evaluation_gen, round(avg(reviews_error_rate), 6) AS mean, round(var_pop(reviews_error_rate), 6) AS variance FROM {_I} i WHERE abs(reviews_error_rate) < 1e300 GROUP BY evaluation_gen")
check("report_cumulative_front", f"SELECT g.generation, count(DISTINCT p.hash) AS n FROM (SELECT DISTINCT generation FROM {_P} p0) g JOIN (SELECT hash, min(generation) AS since FROM {_P} p1 GROUP BY hash) p ON p.since <= g.generation GROUP BY g.generation", "programs that were on a front up to each generation")
check("report_join", f"SELECT p.generation, p.hash, i.age FROM (SELECT DISTINCT generation, hash FROM {_P} p0) p JOIN (SELECT hash, max(age) AS age FROM {_I} i0 GROUP BY hash) i ON i.hash = p.hash")
check("report_dedupe", f"SELECT tree, count(*) AS n, min(hash) AS hash FROM (SELECT DISTINCT hash, tree FROM {_I} i WHERE tree IS NOT NULL) t GROUP BY tree", "programs with one text")
check("report_breadth", f"SELECT hash, -count(*) AS breadth FROM (SELECT hash, tree FROM {_I} i WHERE tree IS NOT NULL) t GROUP BY hash", "rows per program, as a minimised objective")

_LEARNERS = ("knn", "svm", "bayes", "gmm", "logr", "sgd", "extra", "tree")


@query(f"SELECT evaluation_gen, {', '.join(f'round(avg(CASE WHEN contains(lower(tree), {chr(39)}learnertype({n}{chr(39)}) THEN 1e0 ELSE 0e0 END), 6) AS {n}' for n in _LEARNERS)} FROM {_I} i WHERE tree IS NOT NULL GROUP BY evaluation_gen")
def report_freq(spark, folder):
    """Share of each learner per generation."""
    t = table(spark, folder, "individuals").where("tree is not null").select(F.lower(F.trim("hash")).alias("hash"), "age", "evaluation_status", "evaluation_gen", "elapsed_time", "reviews_error_rate", "reviews_num_params", "tree", "recorded_at", "purged_at").distinct()
    return t.groupBy("evaluation_gen").agg(*[F.round(F.avg(F.when(F.contains(F.lower("tree"), F.lit(f"learnertype({n}")), 1.0).otherwise(0.0)), 6).alias(n) for n in _LEARNERS])


@query("SELECT evaluation_gen, round(quantile_cont(reviews_error_rate, 0.25), 6) AS q1, round(quantile_cont(reviews_error_rate, 0.5), 6) AS median, round(quantile_cont(reviews_error_rate, 0.75), 6) AS q3 FROM individuals WHERE abs(reviews_error_rate) < 1e300 GROUP BY evaluation_gen")
def report_boxplot(spark, folder):
    t = table(spark, folder, "individuals").where("abs(reviews_error_rate) < 1e300")
    q = t.groupBy("evaluation_gen").agg(F.percentile("reviews_error_rate", [0.25, 0.5, 0.75]).alias("q"))
    return q.select("evaluation_gen", *[F.round(F.col("q")[i], 6).alias(n) for i, n in enumerate(("q1", "median", "q3"))])


@query()
def report_pvalues(spark, folder):
    """Welch tests per generation: error rates of programs with modules against those without."""
    t = table(spark, folder, "individuals").where("abs(reviews_error_rate) < 1e300 and tree is not null")
    has = F.lower("tree").contains("mod_")
    w = S.welch(t.where(has), t.where(~has), "evaluation_gen", "reviews_error_rate")
    return w.select("evaluation_gen", F.round("t", 6).alias("t"), F.round("p_value", 6).alias("p_value"))


_W = "regexp_extract_all({}, '(\\w+)\\(', 1)"


@query(f"SELECT layer, count(*) AS n FROM (SELECT unnest({_W.format('current_tree')}) AS layer FROM (SELECT DISTINCT rec_id, current_tree FROM nnlearnerstatistics)) GROUP BY layer")
def layers_all(spark, folder):
    """extract_layer_frequencies over all programs."""
    t = table(spark, folder, "nnlearnerstatistics").select("rec_id", "current_tree").distinct()
    return S.layer_counts(t, [], "current_tree")


@query(f"SELECT hash, layer, count(*) AS n FROM (SELECT hash, unnest({_W.format('tree')}) AS layer FROM (SELECT DISTINCT lower(trim(hash)) AS hash, tree FROM individuals)) GROUP BY hash, layer")
def layers_by_individual(spark, folder):
    t = table(spark, folder, "individuals").select(F.lower(F.trim("hash")).alias("hash"), "tree").distinct()
    return S.layer_counts(t, ["hash"], "tree")


_LG = f"SELECT DISTINCT evaluation_gen AS gen, hash, layer FROM (SELECT evaluation_gen, lower(trim(hash)) AS hash, unnest({_W.format('tree')}) AS layer FROM (SELECT DISTINCT evaluation_gen, hash, tree FROM individuals WHERE evaluation_gen IS NOT NULL))"


@query(f"WITH l AS ({_LG}), g AS (SELECT DISTINCT gen, layer FROM l) SELECT l.gen, l.hash, round(avg(CASE WHEN g.layer IS NULL THEN 1e0 ELSE 0e0 END), 6) AS novelty, min(CASE WHEN g.layer IS NULL THEN 1 ELSE 0 END) AS novelty_prod, CAST(-sum(CASE WHEN g.layer IS NULL THEN 0 ELSE 1 END) AS BIGINT) AS novelty_inv FROM l LEFT JOIN g ON g.gen = l.gen - 1 AND g.layer = l.layer GROUP BY l.gen, l.hash")
def layers_novelty(spark, folder):
    """layer_novelty, layer_novelty_prod, layer_novelty_inv against the generation before."""
    t = table(spark, folder, "individuals").where("evaluation_gen is not null").select(F.col("evaluation_gen").alias("gen"), F.lower(F.trim("hash")).alias("hash"), "tree").distinct()
    l = t.select("gen", "hash", F.explode(F.regexp_extract_all("tree", F.lit(r"(\w+)\("), F.lit(1))).alias("layer")).distinct()
    g = l.select((F.col("gen") + 1).alias("gen"), "layer", F.lit(1).alias("seen")).distinct()
    j = l.join(g, ["gen", "layer"], "left").withColumn("new", F.when(F.col("seen").isNull(), 1).otherwise(0))
    return j.groupBy("gen", "hash").agg(F.round(F.avg("new"), 6).alias("novelty"), F.min("new").alias("novelty_prod"), (-F.sum(1 - F.col("new"))).alias("novelty_inv"))


def _entries(spark, folder):
    return table(spark, folder, "cache_entries").distinct().where("purged_at is null").dropDuplicates(["id"])


def _values(spark, folder):
    links = table(spark, folder, "mcm").select("method_id", F.lower(F.trim("cache_id")).alias("cache_id")).distinct()
    methods = table(spark, folder, "methods").groupBy("id").agg(F.max("eval_time").alias("eval_time"), F.max("num_eval").alias("num_eval"), F.max("num_ref").alias("num_ref"))
    return S.eviction_values(_entries(spark, folder), links, methods)


_V = """(SELECT c.id, c.size_kb, coalesce(s.saved, 0.0) * c.num_reads * (c.hits_last_gen / CAST((SELECT max(hits_last_gen) + 1 FROM (SELECT DISTINCT * FROM cache_entries WHERE purged_at IS NULL)) AS DOUBLE) + 1.0::DOUBLE / (c.gens_since_last_hit + 1)) AS value
  FROM (SELECT DISTINCT * FROM cache_entries WHERE purged_at IS NULL) c LEFT JOIN (SELECT l.cache_id, sum(m.saved) AS saved FROM (SELECT DISTINCT method_id, lower(trim(cache_id)) AS cache_id FROM mcm) l
  JOIN (SELECT id, CASE WHEN max(num_eval) > 0 THEN max(eval_time) / max(num_eval) * (max(num_ref) - max(num_eval)) END AS saved FROM methods GROUP BY id) m ON m.id = l.method_id WHERE abs(m.saved) < 1e300 GROUP BY l.cache_id) s ON s.cache_id = c.id)"""


@query(f"SELECT id, round(value, 3) AS value FROM {_V}")
def store_optimize_cache(spark, folder):
    """Worth of each entry that is there now."""
    return _values(spark, folder).select("id", F.round("value", 3).alias("value"))


def _capacity(df):
    return float(df.agg(F.sum("size_kb")).first()[0] or 0.0) / 3


_RV = f"(SELECT id, size_kb, round(value, 6) AS value FROM {_V})"


@query(f"SELECT id FROM (SELECT id, sum(size_kb) OVER (ORDER BY value DESC, id ROWS UNBOUNDED PRECEDING) AS used FROM {_RV}) WHERE used <= (SELECT sum(size_kb) / 3 FROM (SELECT DISTINCT * FROM cache_entries WHERE purged_at IS NULL))")
def store_heap_invalidation(spark, folder):
    """Entries left when the least worth go until a third of the sizes is kept."""
    v = _values(spark, folder).withColumn("value", F.round("value", 6))
    return S.keep_prefix(v, _capacity(v)).select("id")


@query(
    f"""WITH RECURSIVE o AS (SELECT id, size_kb, value, row_number() OVER (ORDER BY value DESC, id) AS i FROM {_RV} WHERE size_kb IS NOT NULL),
    g(i, id, value, room, kept) AS (SELECT CAST(0 AS BIGINT), '', 0e0, (SELECT sum(size_kb) / 3 FROM (SELECT DISTINCT * FROM cache_entries WHERE purged_at IS NULL)), FALSE
      UNION ALL SELECT o.i, o.id, o.value, CASE WHEN o.size_kb <= g.room THEN g.room - o.size_kb ELSE g.room END, o.size_kb <= g.room FROM g JOIN o ON o.i = g.i + 1)
    SELECT id, value FROM g WHERE kept"""
)
def store_sort_and_greed(spark, folder):
    """Entries kept greedily, skipping what does not fit."""
    v = _values(spark, folder).withColumn("value", F.round("value", 6))
    return S.keep_greedy(v, _capacity(v)).select("id", "value")


@query()
def store_knapsack(spark, folder):
    v = _values(spark, folder)
    return S.knapsack(v, _capacity(v)).select("id", F.round("value", 3).alias("value"))


@query("SELECT c.id, CAST(sum(c.num_reads) + coalesce(max(u.n), 0) AS BIGINT) AS num_reads FROM (SELECT id, sum(num_reads) AS num_reads FROM (SELECT DISTINCT * FROM cache_entries) GROUP BY id) c LEFT JOIN (SELECT lower(trim(cache_id)) AS id, count(*) AS n FROM (SELECT DISTINCT * FROM mcm) WHERE cache_id IS NOT NULL GROUP BY 1) u ON u.id = c.id GROUP BY c.id")
def store_apply_reads(spark, folder):
    """update_ref_and_read, increment_num_reads and the other counters: additions by key, here one read per link."""
    t = table(spark, folder, "cache_entries").distinct().groupBy("id").agg(F.sum("num_reads").alias("num_reads"))
    u = table(spark, folder, "mcm").distinct().where("cache_id is not null").select(F.lower(F.trim("cache_id")).alias("id"), F.lit(1).alias("num_reads"))
    return S.upsert(t, u.join(t.select("id"), "id", "left_semi"), ["id"], add=["num_reads"])


@query("SELECT id, max(host_id) AS host_id FROM (SELECT id, host_id FROM cache_entries UNION ALL SELECT DISTINCT lower(trim(cache_id)), NULL FROM mcm WHERE cache_id IS NOT NULL AND trim(cache_id) <> '') GROUP BY id")
def store_insert_missing(spark, folder):
    """add_host, insert if absent: entries that only links know are added."""
    t = table(spark, folder, "cache_entries").groupBy("id").agg(F.max("host_id").alias("host_id"))
    new = table(spark, folder, "mcm").select(F.lower(F.trim("cache_id")).alias("id")).where("id is not null and id <> ''")
    return S.insert_missing(t, new, ["id"])


@query()
def store_functional_hash(spark, folder):
    """One hash over all rows of a table, whatever their order: bitwise sums of row hashes."""
    t = table(spark, folder, "individuals").select(F.sha2(F.to_json(F.struct("hash", "tree", "age")), 256).alias("h"))
    parts = [F.bit_xor(F.conv(F.substring("h", 16 * i + 1, 15), 16, 10).cast("long")).alias(f"h{i}") for i in range(4)]
    return t.agg(F.count("*").alias("n"), *parts)


@query("SELECT lower(trim(hash)) AS hash, sha256(tree) AS tree_hash FROM individuals WHERE tree IS NOT NULL")
def store_hash_string(spark, folder):
    return table(spark, folder, "individuals").where("tree is not null").select(F.lower(F.trim("hash")).alias("hash"), F.sha2("tree", 256).alias("tree_hash"))


@query("SELECT user_id, event_id, round(value - coalesce(lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0), 6) AS diff, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5, 6) AS mean5, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) AS total FROM events")
def series_windows(spark, folder):
    """MyDiff, MyAverager and MyCumSum over a series kept as rows: per user in time order."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    t = table(spark, folder, "events")
    return t.select("user_id", "event_id", F.round(F.col("value") - F.coalesce(F.lag("value").over(w), F.lit(0.0)), 6).alias("diff"), F.round(F.sum("value").over(w.rowsBetween(-2, 2)) / 5, 6).alias("mean5"), F.round(F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, 0)), 4).alias("total"))


# Answered by the operators of ``reports``; their SQL stands above.
_PEOPLE = ("hash", "age", "evaluation_status", "evaluation_gen", "elapsed_time", "reviews_error_rate", "reviews_num_params", "tree", "recorded_at", "purged_at")


def _people(s, f):
    return R.records(table(s, f, "individuals"), *_PEOPLE, key="hash")


def _fronts(s, f, name="paretofront"):
    return R.records(table(s, f, name), "id", "optimization", "generation", "hash", key="hash").where(F.col("hash").isNotNull())


def _history(s, f):
    return _fronts(s, f, "history")


def _cache(s, f):
    return R.records(table(s, f, "cache_entries"))


def _methods(s, f):
    return R.records(table(s, f, "methods"))


def _least(s, f, name):
    return table(s, f, name).agg(F.min(F.lower(F.trim("hash")))).first()[0]


def _rounded(df, **places):
    return df.select(*[F.round(c, places[c]).alias(c) if c in places else F.col(c) for c in df.columns])


def _networks(s, f):
    return R.records(table(s, f, "nnlearnerstatistics"), "rec_id", "hash", "age", "current_tree", key="hash")


QUERIES |= {
    "store_select": lambda s, f: R.lookup(_people(s, f), "hash", _least(s, f, "individuals")).select("hash", "age", "evaluation_status", "n_rows"),
    "store_select_nn": lambda s, f: R.lookup(_networks(s, f), "hash", _least(s, f, "nnlearnerstatistics")).where("age >= 0").select("rec_id", "hash", "age"),
    "store_status_counts": lambda s, f: R.status_counts(_people(s, f)),
    "store_num_evaluated": lambda s, f: R.count_status(_people(s, f), "EVALUATED"),
    "store_num_waiting": lambda s, f: R.count_status(_people(s, f), "WAITING_FOR_MASTER"),
    "store_unevaluated": lambda s, f: R.count_status(_people(s, f), "NOT_EVALUATED", "IN_PROGRESS"),
    "store_evaluated_individuals": lambda s, f: _people(s, f).where("evaluation_status = 'WAITING_FOR_MASTER'").select("hash", "age", "evaluation_gen", "elapsed_time"),
    "store_random_uneval": lambda s, f: R.random_unevaluated(_people(s, f), 20, 7),
    "store_num_gens": lambda s, f: table(s, f, "history").agg(F.max("generation").alias("last_generation")),
    "store_seeded_pareto": lambda s, f: R.last_front(_people(s, f), R.records(table(s, f, "paretofront"), "id", "optimization", "generation", "hash", key="hash")).select("hash", "age", "evaluation_gen"),
    "store_pareto": lambda s, f: R.front_members(_people(s, f), _fronts(s, f), 0).select("generation", "hash", "reviews_error_rate", "reviews_num_params"),
    "store_history_sizes": lambda s, f: R.sizes(_history(s, f)),
    "store_reset_cache_rows": lambda s, f: R.absent(_cache(s, f)).select("id", "host_id", "recorded_at", "dirty"),
    "store_cache_size": lambda s, f: _rounded(R.cache_sizes(_cache(s, f)), size_kb=3),
    "store_cache_hits": lambda s, f: R.cache_hits(_cache(s, f)),
    "store_cache_statistics": lambda s, f: _rounded(R.host_statistics(_cache(s, f), _methods(s, f)), read_time=4, write_time=4, eval_time=3, total_time=3),
    "store_keys_added": lambda s, f: R.keys_per_day(_cache(s, f)),
    "store_query_method": lambda s, f: R.methods_with_entries(_methods(s, f), table(s, f, "mcm"), _cache(s, f)),
    "store_double_links": lambda s, f: R.double_links(table(s, f, "mcm")),
    "store_eval_time_running": lambda s, f: _rounded(R.running_time(_methods(s, f)), running=3),
    "store_select_statistics": lambda s, f: _rounded(R.generation_statistics(_history(s, f), _people(s, f)), mean_error=6, best_error=6),
    "report_process_db": lambda s, f: R.front_sizes(_history(s, f), _fronts(s, f)).select("generation", "n", "last_n"),
    "report_valid": lambda s, f: _people(s, f).where(f"reviews_error_rate < {R.FINITE} and reviews_num_params < {R.FINITE}").select("hash", "reviews_error_rate", "reviews_num_params"),
    "report_invalid": lambda s, f: _people(s, f).where((F.col("reviews_error_rate") > R.FINITE) & ~F.isnan("reviews_error_rate")).select("hash", "reviews_error_rate"),
    "report_filter": lambda s, f: R.with_primitive(_people(s, f), "layer(", "nnlearner("),
    "report_best": lambda s, f: R.best(_people(s, f), 10),
    "report_mean_variance": lambda s, f: _rounded(R.mean_and_variance(_people(s, f), "evaluation_gen", "reviews_error_rate"), mean=6, variance=6),
    "report_cumulative_front": lambda s, f: R.cumulative_fronts(_fronts(s, f)),
    "report_join": lambda s, f: R.front_ages(_fronts(s, f), _people(s, f)).select("generation", "hash", "age"),
    "report_dedupe": lambda s, f: R.same_text(_people(s, f)),
    "report_breadth": lambda s, f: R.breadth(_people(s, f)),
}
