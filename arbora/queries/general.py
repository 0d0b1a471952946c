"""Queries of the general data problems: hierarchies (p2), orphan references (p4), packed fields (p5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.io import table
from arbora.keys import WHITE, key
from arbora.operators import hierarchy as H
from arbora.operators import orphans as O
from arbora.operators.packed import split_packed


def _programs(spark: SparkSession, folder: str) -> DataFrame:
    """(node, parent) of nnlearnerstatistics: parent is the first value of parents."""
    t = table(spark, folder, "nnlearnerstatistics").select(key("hash").alias("node"), "parents")
    first = split_packed(t, "parents").where("pos = 1").select("node", key("val").alias("parent"))
    return t.select("node", F.lit(None).cast("string").alias("parent")).unionByName(first).where(F.col("node").isNotNull()).groupBy("node").agg(F.min("parent").alias("parent"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    h = H.hierarchy(_programs(spark, folder))
    return h.select(F.col("node").alias("hash"), F.coalesce("root", F.lit("")).alias("root_hash"), F.coalesce("depth", F.lit(-1)).cast("int").alias("node_depth"))


def p2_paths(spark: SparkSession, folder: str) -> DataFrame:
    return H.paths(_programs(spark, folder)).select(F.col("node").alias("hash"), F.col("root").alias("root_hash"), F.col("depth").alias("node_depth"), F.concat_ws(">", "path").alias("full_path"))


def p2_descendants(spark: SparkSession, folder: str) -> DataFrame:
    d = H.descendants(H.paths(_programs(spark, folder)))
    return d.select(F.col("ancestor").alias("ancestor_hash"), F.col("node").alias("hash"), F.col("distance"))


def p2_circles(spark: SparkSession, folder: str) -> DataFrame:
    return H.circles(_programs(spark, folder)).select(F.col("node").alias("hash"), F.col("circle").alias("circle_hash"), F.col("length").alias("circle_length"))


def _references(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """References to individuals, and to cache entries: (tbl, rec_id, period, ref, ts)."""

    def of(name: str, rec: str, ref: str, period) -> DataFrame:
        t = table(spark, folder, name)
        return t.select(F.lit(name).alias("tbl"), F.col(rec).alias("rec_id"), period.cast("string").alias("period"), F.col(ref).alias("ref"), F.col("recorded_at").alias("ts"))

    day = F.to_date("recorded_at")
    people = of("history", "id", "hash", F.col("generation")).unionByName(of("paretofront", "id", "hash", F.col("generation"))).unionByName(of("mim", "rec_id", "ind_hash", day))
    return people, of("mcm", "rec_id", "cache_id", day)


def _orphans(spark: SparkSession, folder: str) -> DataFrame:
    people, cached = _references(spark, folder)
    a = O.orphans(people, table(spark, folder, "individuals"), "hash")
    b = O.orphans(cached, table(spark, folder, "cache_entries"), "id")
    return a.unionByName(b).dropDuplicates(["tbl", "rec_id"])


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return _orphans(spark, folder).select("tbl", "rec_id")


def p4_report(spark: SparkSession, folder: str) -> DataFrame:
    """Orphan rows per table and generation or day."""
    return _orphans(spark, folder).groupBy("tbl", "period").agg(F.count("*").alias("n_orphans"))


def _states(spark: SparkSession, folder: str) -> list[tuple[str, DataFrame]]:
    """Signed counts per key of individuals and of cache entries. Rows delivered twice are one delta."""
    people, cached = _references(spark, folder)
    out = []
    for name, refs, k in (("individuals", people, "hash"), ("cache_entries", cached, "id")):
        exist = O.existence_deltas(table(spark, folder, name).select(k, "recorded_at", "purged_at").dropDuplicates(), k)
        out.append((name, O.state(O.reference_deltas(refs.dropDuplicates(["tbl", "rec_id"])).unionByName(exist))))
    return out


def p4_current(spark: SparkSession, folder: str) -> DataFrame:
    """Keys with references and no record that exists now."""
    (a, x), (b, y) = _states(spark, folder)
    both = O.current(x).withColumn("target", F.lit(a)).unionByName(O.current(y).withColumn("target", F.lit(b)))
    return both.select("target", F.col("k").alias("ref_key"), "n_refs")


def p4_state(spark: SparkSession, folder: str) -> DataFrame:
    """The state that later deltas are merged into: per key, references and existing records."""
    (a, x), (b, y) = _states(spark, folder)
    return x.withColumn("target", F.lit(a)).unionByName(y.withColumn("target", F.lit(b))).select("target", F.col("k").alias("ref_key"), "n_refs", "n_exist")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    t = table(spark, folder, "nnlearnerstatistics").select("rec_id", "parents").where(F.col("parents").isNotNull()).dropDuplicates(["rec_id"])
    return split_packed(t, "parents").select("rec_id", "pos", "val")


QUERIES = {f.__name__: f for f in (p2_found, p2_paths, p2_descendants, p2_circles, p4_found, p4_report, p4_current, p4_state, p5_found)}

_CHARS = "||".join(f"chr({ord(c)})" for c in WHITE)
_K = f"nullif(lower(trim({{c}}, {_CHARS})), '')"
_CASES = " UNION ".join(
    f"""SELECT '{t}' AS tbl, r.{i} AS rec_id, CAST({p} AS VARCHAR) AS period FROM {t} r
    WHERE {_K.format(c="r." + c)} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {o} x
      WHERE {_K.format(c="x." + k)} = {_K.format(c="r." + c)} AND x.recorded_at <= r.recorded_at AND (x.purged_at IS NULL OR x.purged_at > r.recorded_at))"""
    for t, i, c, o, k, p in (
        ("history", "id", "hash", "individuals", "hash", "r.generation"),
        ("paretofront", "id", "hash", "individuals", "hash", "r.generation"),
        ("mim", "rec_id", "ind_hash", "individuals", "hash", "CAST(r.recorded_at AS DATE)"),
        ("mcm", "rec_id", "cache_id", "cache_entries", "id", "CAST(r.recorded_at AS DATE)"),
    )
)
_ONE = "(SELECT tbl, rec_id, min(period) AS period FROM (" + _CASES + ") GROUP BY tbl, rec_id)"
_CURRENT = " UNION ALL ".join(
    f"""SELECT '{o}' AS target, k AS ref_key, count(*) AS n_refs FROM ({" UNION ".join(f"SELECT DISTINCT '{t}' AS tbl, {i} AS rec_id, {_K.format(c=c)} AS k FROM {t}" for t, i, c in refs)}) r
    WHERE k IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {o} x WHERE {_K.format(c="x." + kc)} = r.k AND x.recorded_at IS NOT NULL AND x.purged_at IS NULL) GROUP BY k"""
    for o, kc, refs in (("individuals", "hash", (("history", "id", "hash"), ("paretofront", "id", "hash"), ("mim", "rec_id", "ind_hash"))), ("cache_entries", "id", (("mcm", "rec_id", "cache_id"),)))
)
_STATE = " UNION ALL ".join(
    f"""SELECT '{o}' AS target, k AS ref_key, CAST(sum(r) AS BIGINT) AS n_refs, CAST(sum(e) AS BIGINT) AS n_exist FROM (
      SELECT k, 1 AS r, 0 AS e FROM ({" UNION ".join(f"SELECT DISTINCT '{t}' AS tbl, {i} AS rec_id, {_K.format(c=c)} AS k FROM {t}" for t, i, c in refs)})
      UNION ALL SELECT {_K.format(c=kc)}, 0, 1 FROM (SELECT DISTINCT {kc}, recorded_at, purged_at FROM {o}) WHERE recorded_at IS NOT NULL AND purged_at IS NULL)
    WHERE k IS NOT NULL GROUP BY k"""
    for o, kc, refs in (("individuals", "hash", (("history", "id", "hash"), ("paretofront", "id", "hash"), ("mim", "rec_id", "ind_hash"))), ("cache_entries", "id", (("mcm", "rec_id", "cache_id"),)))
)
SQL = {
    "p4_state": _STATE,
    "p4_found": f"SELECT tbl, rec_id FROM {_ONE}",
    "p4_report": f"SELECT tbl, period, count(*) AS n_orphans FROM {_ONE} GROUP BY tbl, period",
    "p4_current": _CURRENT,
}

# The first value of parents: what is quoted, or runs up to a separator. A value in parentheses is no hash, wherever cut.
_FIRST = r"""regexp_extract(regexp_replace(parents, '^\s*\[(.*)\]\s*$', '\1', 's'), '^[\s,;|/]*(?:"([^"]*)"|''([^'']*)''|([^\s,;|/"'']+))', ['a', 'b', 'c'])"""
SQL["p2_found"] = f"""WITH RECURSIVE f AS (SELECT {_K.format(c="hash")} AS node, {_FIRST} AS v FROM nnlearnerstatistics),
  n AS (SELECT node, min({_K.format(c="v.a || v.b || v.c")}) AS parent FROM f WHERE node IS NOT NULL GROUP BY node),
  u AS (SELECT a.node, b.node AS parent FROM n a LEFT JOIN n b ON b.node = a.parent),
  w(node, cur, d) AS (SELECT node, node, 0 FROM u UNION ALL SELECT w.node, u.parent, w.d + 1 FROM w JOIN u ON u.node = w.cur WHERE u.parent IS NOT NULL AND w.d <= (SELECT count(*) FROM u))
  SELECT u.node AS hash, coalesce(r.cur, '') AS root_hash, CAST(coalesce(r.d, -1) AS INT) AS node_depth
  FROM u LEFT JOIN (SELECT w.node, w.cur, w.d FROM w JOIN u ON u.node = w.cur WHERE u.parent IS NULL) r ON r.node = u.node"""

_TREE = f"""WITH RECURSIVE f AS (SELECT {_K.format(c="hash")} AS node, {_FIRST} AS v FROM nnlearnerstatistics),
  n AS (SELECT node, min({_K.format(c="v.a || v.b || v.c")}) AS parent FROM f WHERE node IS NOT NULL GROUP BY node),
  u AS (SELECT a.node, b.node AS parent FROM n a LEFT JOIN n b ON b.node = a.parent),
  t(node, root, depth, path) AS (SELECT node, node, 0, [node] FROM u WHERE parent IS NULL
    UNION ALL SELECT u.node, t.root, t.depth + 1, list_append(t.path, u.node) FROM u JOIN t ON u.parent = t.node)"""
SQL["p2_paths"] = f"{_TREE} SELECT node AS hash, root AS root_hash, CAST(depth AS INT) AS node_depth, array_to_string(path, '>') AS full_path FROM t"
SQL["p2_descendants"] = f"""{_TREE} SELECT path[i] AS ancestor_hash, node AS hash, CAST(depth + 1 - i AS INT) AS distance
  FROM (SELECT *, unnest(range(1, depth + 1)) AS i FROM t)"""
SQL["p2_circles"] = f"""{_TREE}, bad AS (SELECT * FROM u WHERE node NOT IN (SELECT node FROM t)),
  w(node, cur, low, d) AS (SELECT node, parent, least(node, parent), 1 FROM bad
    UNION ALL SELECT w.node, b.parent, least(w.low, b.parent), w.d + 1 FROM w JOIN bad b ON b.node = w.cur WHERE w.cur <> w.node AND w.d <= (SELECT count(*) FROM bad))
  SELECT node AS hash, low AS circle_hash, CAST(d AS BIGINT) AS circle_length FROM w WHERE cur = node"""

# The rule of packed fields as an automaton that reads one character a step. Modes: 0 between values, 1 in a plain value,
# 2 in a quoted one; a separator is put behind each field, which ends its last value.
_SEPARATOR = f"instr({_CHARS} || ',;|/', c) > 0"
_SINGLE, _DOUBLE, _SLASH = "chr(39)", "chr(34)", "chr(92)"
_PAIR = f"mode = 2 AND (c = {_SLASH} OR c = q) AND d = q"
_ENDS = f"((mode = 1 AND sep AND depth = 0 AND pq = '') OR (mode = 2 AND c = q AND NOT ({_PAIR})))"
_STEP = f"""SELECT rec_id, body, CASE WHEN {_PAIR} THEN i + 2 ELSE i + 1 END AS i,
    CASE WHEN mode = 0 THEN CASE WHEN sep THEN 0 WHEN quote THEN 2 ELSE 1 END WHEN {_ENDS} THEN 0 ELSE mode END AS mode,
    CASE WHEN mode = 0 AND quote THEN c ELSE q END AS q,
    CASE WHEN mode = 0 OR {_ENDS} THEN 0 ELSE depth END + CASE WHEN mode = 2 OR pq <> '' THEN 0 WHEN c = '(' THEN 1 WHEN c = ')' THEN -1 ELSE 0 END AS depth,
    CASE WHEN mode <> 1 THEN '' WHEN pq = '' AND quote AND depth > 0 THEN c WHEN pq <> '' AND c = pq THEN '' ELSE pq END AS pq,
    CASE WHEN mode = 0 THEN CASE WHEN sep OR quote THEN '' ELSE c END WHEN {_ENDS} THEN '' WHEN {_PAIR} THEN cur || q ELSE cur || c END AS cur,
    CASE WHEN {_ENDS} AND trim(cur, {_CHARS}) <> '' THEN list_append(vals, trim(cur, {_CHARS})) ELSE vals END AS vals
  FROM (SELECT *, {_SEPARATOR} AS sep, c IN ({_SINGLE}, {_DOUBLE}) AS quote FROM (SELECT *, body[i] AS c, body[i + 1] AS d FROM s WHERE i <= len(body)))"""
SQL["p5_found"] = f"""WITH RECURSIVE b AS (SELECT rec_id, any_value(trim(parents, {_CHARS})) AS f FROM nnlearnerstatistics WHERE parents IS NOT NULL GROUP BY rec_id),
  s(rec_id, body, i, mode, q, depth, pq, cur, vals) AS (SELECT rec_id, CASE WHEN f LIKE '[%]' THEN f[2:len(f) - 1] ELSE f END || '|', CAST(1 AS BIGINT), 0, '', 0, '', '', CAST([] AS VARCHAR[]) FROM b UNION ALL {_STEP})
  SELECT rec_id, CAST(pos AS INT) AS pos, vals[pos] AS val FROM (SELECT rec_id, vals, unnest(range(1, len(vals) + 1)) AS pos FROM s WHERE i > len(body))"""
