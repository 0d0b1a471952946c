"""Queries of writes to the run store, each with SQL that states the table after the change."""

from __future__ import annotations

from pyspark.sql import functions as F

from arbora.io import table
from arbora.operators import writes as S

QUERIES: dict = {}
SQL: dict[str, str] = {}
_METHODS, _CACHE = ["eval_time", "overhead_time"], ["write_time", "read_overhead_time", "write_overhead_time"]
_M = "(SELECT id, round(max(eval_time), 6) AS eval_time, round(max(overhead_time), 6) AS overhead_time, max(num_eval) AS num_eval, max(error) AS error, max(error_string) AS error_string FROM methods GROUP BY id)"
_C = "(SELECT id, max(host_id) AS host_id, round(max(write_time), 6) AS write_time, round(max(read_overhead_time), 6) AS read_overhead_time, round(max(write_overhead_time), 6) AS write_overhead_time, round(max(size_kb), 6) AS size_kb, max(dirty) AS dirty FROM cache_entries GROUP BY id)"
_L = "(SELECT DISTINCT rec_id, method_id, lower(trim(cache_id)) AS cache_id FROM mcm)"


def _table(spark, folder, name):
    aggs = {"methods": [*[F.round(F.max(c), 6).alias(c) for c in _METHODS], *[F.max(c).alias(c) for c in ("num_eval", "error", "error_string")]], "cache_entries": [F.max("host_id").alias("host_id"), *[F.round(F.max(c), 6).alias(c) for c in (*_CACHE, "size_kb")], F.max("dirty").alias("dirty")]}
    return table(spark, folder, name).groupBy("id").agg(*aggs[name])


def _links(spark, folder, name):
    t = table(spark, folder, "mcm").select("rec_id", "method_id", F.lower(F.trim("cache_id")).alias("cache_id")).distinct()
    known = _table(spark, folder, name).select("id")
    return t.withColumn("id", F.col("method_id") if name == "methods" else F.col("cache_id")).join(known, "id", "left_semi")


def _added(query: str, name: str, column: str, amount: str) -> None:
    key, base = ("method_id", _M) if name == "methods" else ("cache_id", _C)

    def run(spark, folder):
        changes = _links(spark, folder, name).select("id", F.expr(amount).alias(column))
        return S.add_times(_table(spark, folder, name), changes, column).select("id", F.round(column, 6).alias(column))

    run.__doc__ = f"{column} of {name} increased once per link"
    QUERIES[query] = run
    SQL[query] = f"SELECT b.id, round(CASE WHEN n IS NULL THEN b.{column} ELSE coalesce(b.{column}, 0) + n END, 6) AS {column} FROM {base} b LEFT JOIN (SELECT {key} AS k, sum({amount}) AS n FROM {_L} GROUP BY 1) l ON l.k = b.id"


for _q, _n, _c, _a in (
    ("update_eval_time", "methods", "eval_time", "(rec_id % 7) / 4.0"),
    ("update_overhead_time", "methods", "overhead_time", "(rec_id % 5) / 8.0"),
    ("increment_num_eval", "methods", "num_eval", "1"),
    ("update_read_overhead_time", "cache_entries", "read_overhead_time", "(rec_id % 3) / 2.0"),
    ("update_write_overhead_time", "cache_entries", "write_overhead_time", "(rec_id % 9) / 16.0"),
):
    _added(f"write_{_q}", _n, _c, _a)


def query(sql: str):
    def put(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return put


_W = f"(SELECT cache_id AS k, sum((rec_id % 4) / 2.0) AS t, max(CAST(rec_id % 1000 AS DOUBLE)) AS s FROM {_L} GROUP BY 1)"


def _writes(spark, folder):
    return _links(spark, folder, "cache_entries").select("id", F.expr("(rec_id % 4) / 2.0").alias("write_time"), (F.col("rec_id") % 1000).cast("double").alias("size_kb"))


@query(f"SELECT id, round(CASE WHEN t IS NULL THEN write_time ELSE coalesce(write_time, 0) + t END, 6) AS write_time, coalesce(s, size_kb) AS size_kb, CASE WHEN t IS NULL THEN dirty ELSE 0 END AS dirty FROM {_C} LEFT JOIN {_W} ON k = id")
def write_update_time_size(spark, folder):
    out = S.written(_table(spark, folder, "cache_entries"), _writes(spark, folder))
    return out.select("id", F.round("write_time", 6).alias("write_time"), "size_kb", "dirty")


@query(f"SELECT id, round(CASE WHEN t IS NULL THEN write_time ELSE coalesce(write_time, 0) + t END, 6) AS write_time, size_kb, CASE WHEN t IS NULL THEN dirty ELSE 0 END AS dirty FROM {_C} LEFT JOIN {_W} ON k = id")
def write_update_time_size_dirty(spark, folder):
    out = S.written(_table(spark, folder, "cache_entries"), _writes(spark, folder), with_size=False)
    return out.select("id", F.round("write_time", 6).alias("write_time"), "size_kb", "dirty")


@query(f"SELECT id, CASE WHEN id IN (SELECT cache_id FROM {_L} WHERE rec_id % 3 = 0) THEN 1 ELSE dirty END AS dirty FROM {_C}")
def write_set_dirty(spark, folder):
    return S.set_dirty(_table(spark, folder, "cache_entries"), _links(spark, folder, "cache_entries").where("rec_id % 3 = 0")).select("id", "dirty")


@query(f"SELECT id, CASE WHEN host_id = (SELECT min(host_id) FROM cache_entries) AND id IN (SELECT cache_id FROM {_L} WHERE rec_id % 3 = 0) THEN 1 ELSE dirty END AS dirty FROM {_C}")
def write_set_dirty_rollback(spark, folder):
    """Only the entries of the host whose write failed."""
    host = table(spark, folder, "cache_entries").agg(F.min("host_id")).first()[0]
    return S.set_dirty(_table(spark, folder, "cache_entries"), _links(spark, folder, "cache_entries").where("rec_id % 3 = 0"), host).select("id", "dirty")


_E = f"(SELECT method_id AS k, max('failed at ' || CAST(rec_id AS VARCHAR)) AS e FROM {_L} WHERE rec_id % 11 = 0 GROUP BY 1)"


def _errors(spark, folder):
    return _links(spark, folder, "methods").where("rec_id % 11 = 0").select("id", F.concat(F.lit("failed at "), F.col("rec_id").cast("string")).alias("error_string"))


@query(f"SELECT id, CASE WHEN e IS NULL THEN error ELSE 1 END AS error, coalesce(e, error_string) AS error_string FROM {_M} LEFT JOIN {_E} ON k = id")
def write_set_error(spark, folder):
    return S.set_error(_table(spark, folder, "methods"), _errors(spark, folder)).select("id", "error", "error_string")


@query(f"SELECT id, error, coalesce(e, error_string) AS error_string FROM {_M} LEFT JOIN {_E} ON k = id")
def write_set_special_error(spark, folder):
    return S.set_special_error(_table(spark, folder, "methods"), _errors(spark, folder)).select("id", "error", "error_string")


_N = "(SELECT lower(trim(hash)) AS hash, age, max(parents) AS parents, max(current_tree) AS current_tree FROM nnlearnerstatistics WHERE hash IS NOT NULL GROUP BY 1, 2)"


def _networks(spark, folder):
    t = table(spark, folder, "nnlearnerstatistics").where("hash is not null")
    return t.groupBy(F.lower(F.trim("hash")).alias("hash"), "age").agg(F.max("parents").alias("parents"), F.max("current_tree").alias("current_tree"))


_NEW = f"(SELECT hash, coalesce(age, 0) + 0.5 * (len(hash) % 2) AS age, '' AS parents FROM {_N})"


def _later(spark, folder):
    n = _networks(spark, folder)
    return n.select("hash", (F.coalesce("age", F.lit(0.0)) + 0.5 * (F.length("hash") % 2)).alias("age"), F.lit("").alias("parents")).distinct()


@query(f"SELECT hash, age, parents, current_tree FROM {_N} UNION ALL SELECT DISTINCT hash, age, parents, NULL FROM {_NEW} w WHERE NOT EXISTS (SELECT 1 FROM {_N} n WHERE n.hash = w.hash AND n.age = w.age)")
def write_insert_networks(spark, folder):
    return S.insert_networks(_networks(spark, folder), _later(spark, folder))


@query(f"SELECT coalesce(n.hash, w.hash) AS hash, coalesce(n.age, w.age) AS age, coalesce(w.parents, n.parents) AS parents, n.current_tree FROM {_N} n FULL JOIN (SELECT DISTINCT * FROM {_NEW}) w ON n.hash = w.hash AND n.age = w.age")
def write_update_networks(spark, folder):
    return S.update_networks(_networks(spark, folder), _later(spark, folder))


_MOD = r"(SELECT CAST(m AS INT) AS mod_num, CAST(count(*) AS INT) AS num_occur, min(lower(trim(hash))) AS tree FROM (SELECT hash, unnest(regexp_extract_all(current_tree, 'mod_(\d+)', 1)) AS m FROM nnlearnerstatistics WHERE hash IS NOT NULL) GROUP BY 1)"


def _modules(spark, folder):
    t = table(spark, folder, "nnlearnerstatistics").where("hash is not null").select(F.lower(F.trim("hash")).alias("hash"), F.explode(F.regexp_extract_all("current_tree", F.lit(r"mod_(\d+)"), F.lit(1))).alias("m"))
    return t.groupBy(F.col("m").cast("int").alias("mod_num")).agg(F.count("*").cast("int").alias("num_occur"), F.min("hash").alias("tree"))


@query(f"SELECT mod_num, num_occur, tree FROM {_MOD} UNION ALL SELECT DISTINCT mod_num + 100, 0, NULL FROM {_MOD} WHERE mod_num + 100 NOT IN (SELECT mod_num FROM {_MOD})")
def write_insert_modules(spark, folder):
    m = _modules(spark, folder)
    return S.insert_modules(m, m.select((F.col("mod_num") + 100).alias("mod_num"), F.lit(0).alias("num_occur")))


@query(f"SELECT coalesce(a.mod_num, b.mod_num) AS mod_num, coalesce(a.num_occur, 0) + coalesce(b.n, 0) AS num_occur, coalesce(b.t, a.tree) AS tree FROM {_MOD} a FULL JOIN (SELECT mod_num + 100 AS mod_num, num_occur AS n, tree AS t FROM {_MOD}) b ON b.mod_num = a.mod_num")
def write_update_modules(spark, folder):
    m = _modules(spark, folder)
    return S.update_modules(m, m.select((F.col("mod_num") + 100).alias("mod_num"), "num_occur", "tree"))


def _appended(name: str) -> None:
    def run(spark, folder):
        t = table(spark, folder, name).select("id", "optimization", "generation", "hash").distinct()
        last = t.agg(F.max("generation")).first()[0]
        new = t.where(F.col("generation") == last).select("optimization", (F.col("generation") + 1).alias("generation"), "hash")
        old = t.agg(F.max("id").alias("top"))
        out = S.append_numbered(t, new).join(F.broadcast(old))  # one row
        return out.groupBy("generation", (F.col("id") > F.col("top")).alias("is_new")).agg(F.count("*").alias("n"), F.countDistinct("id").alias("n_ids"))

    run.__doc__ = f"A generation appended to {name}, by generation: rows, distinct ids, and whether these are new"
    key = {"history": "write_add_history", "paretofront": "write_add_pareto_front"}[name]
    t = f"(SELECT DISTINCT id, optimization, generation, hash FROM {name})"
    QUERIES[key] = run
    SQL[key] = f"SELECT generation, FALSE AS is_new, count(*) AS n, count(DISTINCT id) AS n_ids FROM {t} GROUP BY generation UNION ALL SELECT max(generation) + 1, TRUE, count(*), count(*) FROM {t} WHERE generation = (SELECT max(generation) FROM {name})"


for _name in ("history", "paretofront"):
    _appended(_name)


@query("SELECT generation, n_programs, -1 AS n_fronts FROM (SELECT generation, count(DISTINCT hash) AS n_programs FROM history GROUP BY generation) UNION ALL SELECT generation, -1, count(DISTINCT hash) FROM paretofront GROUP BY generation")
def write_insert_statistics(spark, folder):
    """Statistics whose columns differ from those stored so far; -1 where there are none."""
    a = table(spark, folder, "history").groupBy("generation").agg(F.countDistinct("hash").alias("n_programs"))
    out = S.insert_statistics(a, table(spark, folder, "paretofront").groupBy("generation").agg(F.countDistinct("hash").alias("n_fronts")))
    return out.select("generation", *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("n_programs", "n_fronts")])
