"""Queries of the loaders: a table is written in the layout of an instance file, in the shared folder, and loaded back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.io import table
from arbora.sources import loaders as R
from arbora.staging import scratch

QUERIES: dict = {}
SQL: dict[str, str] = {}
FILES = 8


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def _path(spark, name: str) -> str:
    return scratch(spark, f"source-{name}")


def _lines(df: DataFrame, name: str, key: str, header: str | None = None) -> str:
    """Text files of whole records (a column ``value``, which may be several lines), dealt out by ``key``; ``header`` is the
    first line of each."""
    path = _path(df.sparkSession, name)
    rows = df.select(F.pmod(F.xxhash64(key), F.lit(FILES)).alias("k"), F.lit(1).alias("o"), "value")
    if header is not None:
        rows = rows.unionByName(rows.select("k").distinct().select("k", F.lit(0).alias("o"), F.lit(header).alias("value")))
    rows.repartition(FILES, "k").sortWithinPartitions("k", "o").select("k", "value").write.partitionBy("k").text(path)
    return f"{path}/k=*"


def _vectors(spark, folder):
    return table(spark, folder, "embeddings").select("vec_id", F.transform("embedding", lambda v: F.round(v.cast("double"), 6)).alias("v"))


_V = "(SELECT vec_id, list_transform(embedding, lambda v: round(CAST(v AS DOUBLE), 6)) AS v FROM embeddings)"
_joined = lambda c: F.array_join(F.transform(c, lambda v: v.cast("string")), ",")


@query("SELECT CAST(l_orderkey AS DOUBLE) AS a, l_quantity AS b, l_discount AS c, CAST(l_linenumber AS DOUBLE) AS target FROM lineitem")
def source_features_csv(spark, folder):
    t = table(spark, folder, "lineitem")
    path = _path(spark, "features")
    t.select("l_orderkey", "l_quantity", "l_discount", "l_linenumber").write.option("header", True).option("compression", "gzip").csv(path)
    d = R.features_csv(spark, path)
    return d.select(*[F.element_at("features", i + 1).alias(c) for i, c in enumerate("abc")], "target")


@query(r"SELECT sha256(regexp_replace(text, '[\r\n]+', ' ', 'g')) AS text_hash, CAST(doc_id AS DOUBLE) AS a, CAST(n_chars AS DOUBLE) AS b FROM documents WHERE regexp_matches(text, '[^ \r\n]')")
def source_text_csv(spark, folder):
    t = table(spark, folder, "documents").withColumn("text", F.regexp_replace("text", r"[\r\n]+", " ")).where(F.col("text").rlike("[^ ]"))
    path = _path(spark, "text")
    t.select("text", "doc_id", "n_chars").write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("quoteAll", True).csv(path)
    d = R.text_csv(spark, path, 2)
    return d.select(F.sha2("text", 256).alias("text_hash"), F.get("target", 0).alias("a"), F.get("target", 1).alias("b"))


_LONG = "SELECT vec_id, CAST(p - 1 AS INT) AS pos, round({v}, 4) AS val FROM {t}, LATERAL (SELECT unnest(range(1, len(v) + 1)) AS p)"


@query(_LONG.format(v="CAST(CAST(v[p] AS FLOAT) AS DOUBLE)", t=_V))
def source_summaries(spark, folder):
    """A text and a bracketed vector."""
    t = _vectors(spark, folder).select(F.concat(F.lit("vector "), F.col("vec_id").cast("string")).alias("text"), F.concat(F.lit("["), F.array_join(F.transform("v", lambda v: v.cast("string")), " "), F.lit("]")).alias("v"))
    path = _path(spark, "summaries")
    t.write.option("header", True).csv(path)
    return R.summaries_csv(spark, path).select(F.regexp_extract("text", r"(\d+)", 1).cast("long").alias("vec_id"), F.posexplode("target").alias("pos", "val")).withColumn("val", F.round(F.col("val").cast("double"), 4))


@query(f"SELECT vec_id, c AS axis, CAST(p AS INT) AS pos, v[2 * p + c + 1] AS val FROM {_V}, LATERAL (SELECT unnest(range(0, 32)) AS p), LATERAL (SELECT unnest([0, 1]) AS c)")
def source_many_to_one(spark, folder):
    """Two values after each time, and one truth."""
    cells = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.array(i.cast("double"), F.get("v", 2 * i), F.get("v", 2 * i + 1))))
    path = _lines(_vectors(spark, folder).select("vec_id", F.concat(_joined(cells), F.lit(","), F.col("vec_id").cast("string")).alias("value")), "one", "vec_id", "N=2")
    d = R.many_to_one(spark, path)
    return d.select(F.get("target", 0).cast("long").alias("vec_id"), F.posexplode("stream").alias("axis", "s")).select("vec_id", "axis", F.posexplode("s").alias("pos", "val"))


def _timed(c):
    return _joined(F.flatten(F.transform(c, lambda v, i: F.array(i.cast("double"), v))))


@query(f"SELECT vec_id, CAST(p - 1 AS INT) AS pos, v[p] AS val, -v[p] AS truth FROM {_V}, LATERAL (SELECT unnest(range(1, 65)) AS p)")
def source_many_to_many(spark, folder):
    """A line of samples and a line of truths; the row's key is the first value of both."""
    key = F.array(F.col("vec_id").cast("double"))
    rows = _vectors(spark, folder).select("vec_id", F.concat(_timed(F.concat(key, "v")), F.lit("\n"), _timed(F.concat(key, F.transform("v", lambda v: -v)))).alias("value"))
    d = R.many_to_many(spark, _lines(rows, "many", "vec_id"))
    d = d.select(F.get(F.get("stream", 0), 0).cast("long").alias("vec_id"), F.posexplode(F.arrays_zip(F.slice(F.get("stream", 0), 2, 64).alias("a"), F.slice("target", 2, 64).alias("b"))).alias("pos", "z"))
    return d.select("vec_id", "pos", F.col("z.a").alias("val"), F.col("z.b").alias("truth"))


@query(f"SELECT vec_id, CAST(p - 1 AS INT) AS pos, v[p] AS val, CASE WHEN p <= 2 THEN p - 1e0 END AS truth FROM {_V}, LATERAL (SELECT unnest(range(1, 65)) AS p)")
def source_many_to_some(spark, folder):
    """Lines cut into rows of 65 and of 3 numbers, each led by the key."""
    rows = _vectors(spark, folder).select("vec_id", F.concat(F.col("vec_id").cast("string"), F.lit(","), _joined("v"), F.lit("\n"), F.col("vec_id").cast("string"), F.lit(",0,1")).alias("value"))
    d = R.many_to_some(spark, _lines(rows, "some", "vec_id", "65,3"), 65, 3)
    d = d.select(F.get(F.get("stream", 0), 0).cast("long").alias("vec_id"), F.slice(F.get("target", 0), 2, 2).alias("t"), F.posexplode(F.slice(F.get("stream", 0), 2, 64)).alias("pos", "val"))
    return d.select("vec_id", "pos", "val", F.get("t", F.col("pos")).alias("truth"))


@query(f"SELECT vec_id, 8 AS h, 8 AS w, round(list_sum(v), 6) AS total, v[1] AS r, v[2] AS c FROM {_V}")
def source_images_csv(spark, folder):
    """A flattened image and the places in it."""
    rows = _vectors(spark, folder).select("vec_id", F.concat(_joined("v"), F.lit("\n"), _joined(F.concat(F.slice("v", 1, 2), F.array(F.col("vec_id").cast("double"), F.lit(0.0))))).alias("value"))
    d = R.images_csv(spark, _lines(rows, "images", "vec_id", "8,8,1"), 8, 8)
    total = F.aggregate("image.data", F.lit(0.0), lambda a, v: a + v)
    return d.select(F.element_at("target", 2)["r"].cast("long").alias("vec_id"), F.col("image.h").alias("h"), F.col("image.w").alias("w"), F.round(total, 6).alias("total"), F.get("target", 0)["r"].alias("r"), F.get("target", 0)["c"].alias("c"))


@query("SELECT n_name AS name, n_nationkey AS nationkey, n_regionkey AS regionkey FROM nation")
def source_fixed_width(spark, folder):
    t = table(spark, folder, "nation").select(F.col("n_nationkey"), F.concat(F.rpad("n_name", 30, " "), F.lpad(F.col("n_nationkey").cast("string"), 8, " "), F.lpad(F.col("n_regionkey").cast("string"), 4, " ")).alias("value"))
    return R.fixed_width(spark, _lines(t, "fixed", "n_nationkey"), [("name", 30, "string"), ("nationkey", 8, "bigint"), ("regionkey", 4, "bigint")])


@query("SELECT trim(n_name) AS name, CAST(n_nationkey AS VARCHAR) AS nationkey FROM nation")
def source_trimmed_csv(spark, folder):
    t = table(spark, folder, "nation").select(F.col("n_nationkey"), F.concat(F.lit("  "), F.col("n_name"), F.lit(" , "), F.col("n_nationkey").cast("string"), F.lit(" ")).alias("value"))
    return R.trimmed_csv(spark, _lines(t, "trimmed", "n_nationkey", " name , nationkey"))


@query("SELECT count(*) AS n, count(DISTINCT expr) AS n_different FROM (SELECT trim(regexp_replace(tree, '\\s+', ' ', 'g')) AS expr FROM individuals WHERE tree IS NOT NULL) WHERE expr <> '' AND expr NOT LIKE '%#%' AND NOT regexp_matches(expr, '^\\w+\\s*:')".replace("\\\\", "\\"))
def source_programs(spark, folder):
    """Programs written one to a line and read back."""
    t = table(spark, folder, "individuals").where("tree is not null").select("hash", F.trim(F.regexp_replace("tree", r"\s+", " ")).alias("value")).where(~F.col("value").contains("#") & (F.col("value") != "") & ~F.col("value").rlike(r"^\w+\s*:"))
    return R.programs(spark, _lines(t, "programs", "hash", "# programs of a run")).agg(F.count("*").alias("n"), F.countDistinct("expr").alias("n_different"))
