"""Queries of small operators on instances, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from arbora.io import table
from arbora.operators import instances as I
from arbora.operators import text as W
from arbora.queries.programs import _ROWS, instances
from arbora.queries.sources import _lines
from arbora.queries.texts import _T, docs

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def _split(spark, folder):
    return instances(spark, folder).withColumn("split", F.when(F.col("row_id") % 5 == 0, "test").otherwise("train"))


def _images(spark, folder):
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("row_id"), F.transform("embedding", lambda v: v.cast("double")).alias("stream"), F.col("label").cast("double").alias("target"), F.when(F.col("vec_id") % 5 == 0, "test").otherwise("train").alias("split"))


_E = "(SELECT vec_id, label, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS x FROM embeddings)"


@query(f"SELECT id AS row_id, round(x[3], 6) AS value, t AS target FROM {_ROWS}")
def instance_feature(spark, folder):
    """featSelect: one feature of all rows with the target."""
    return I.feature(instances(spark, folder), 2).withColumn("value", F.round("value", 6))


@query(f"SELECT CAST(p - 1 AS INT) AS pos, round(x[p], 6) AS value, t AS target FROM {_ROWS}, LATERAL (SELECT unnest(range(1, 5)) AS p) WHERE id = (SELECT min(o_orderkey) FROM orders)")
def instance_observation(spark, folder):
    """obsSelect: one row with its target."""
    d = instances(spark, folder)
    return I.observation(d, d.agg(F.min("row_id")).first()[0]).select(F.posexplode("features").alias("pos", "value"), "target").withColumn("value", F.round("value", 6))


@query(f"SELECT vec_id AS row_id, CAST(p - 1 AS INT) AS pos, round(x[p], 6) AS value FROM {_E}, LATERAL (SELECT unnest(range(1, 65)) AS p)")
def instance_flattened(spark, folder):
    """flatten_obj_array and get_flattened_target: nested arrays end to end."""
    d = _images(spark, folder).withColumn("stream", F.transform(F.sequence(F.lit(0), F.lit(7)), lambda r: F.slice("stream", r * 8 + 1, 8)))
    return I.flattened(d).withColumn("value", F.round("value", 6))


@query(f"SELECT vec_id AS row_id, CAST(p - 1 AS INT) AS pos, round(x[p] / (SELECT max(list_max(x)) FROM {_E} WHERE vec_id % 5 <> 0), 6) AS value FROM {_E}, LATERAL (SELECT unnest(range(1, 65)) AS p)")
def instance_scaled_by_train(spark, folder):
    """processImages: train and test over the greatest value of the train rows."""
    return I.scaled_by_train(I.checked_targets(_images(spark, folder))).select("row_id", F.posexplode("stream").alias("pos", "value")).withColumn("value", F.round("value", 6))


@query(f"SELECT vec_id AS row_id, CAST(p - 1 AS INT) AS pos, CASE WHEN classes[p] = label THEN 1e0 ELSE 0e0 END AS value FROM {_E}, (SELECT list(label ORDER BY label) AS classes FROM (SELECT DISTINCT label FROM embeddings WHERE vec_id % 5 <> 0)), LATERAL (SELECT unnest(range(1, len(classes) + 1)) AS p)")
def instance_encoded_targets(spark, folder):
    """preprocessDataPair: targets over the classes of the train rows."""
    return I.encoded_targets(_images(spark, folder)).select("row_id", F.posexplode("encoded").alias("pos", "value"))


@query(f"SELECT vec_id AS row_id, CAST(p AS INT) AS pos, round(x[(p // 3 + 2) * 8 + p % 3 + 6], 6) AS value FROM {_E}, LATERAL (SELECT unnest(range(0, 12)) AS p)")
def instance_cropped(spark, folder):
    """bbox_grid and crop_img: the box of four rows from row 2 and up to five columns from column 5."""
    return _images(spark, folder).select("row_id", F.posexplode(I.cropped("stream", 8, 2, 5, 4, 5)).alias("pos", "value")).withColumn("value", F.round("value", 6))


_FOLD = "CASE WHEN {a} < 0 THEN -({a}) - 1 WHEN {a} > 7 THEN 15 - ({a}) ELSE {a} END"
_PLACE = f"({_FOLD.format(a='(0 + o // 7 - 3)')}) * 8 + ({_FOLD.format(a='(6 + o % 7 - 3)')}) + 1"


@query(f"SELECT vec_id AS row_id, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY o) - 1 AS INT) AS pos, round(x[{_PLACE}], 6) AS value FROM {_E}, LATERAL (SELECT unnest(range(0, 49)) AS o) WHERE greatest(abs(o // 7 - 3), abs(o % 7 - 3)) > 1")
def instance_window_values(spark, folder):
    """get_image_sample and get_image_values: a window with a hole at a corner, edges mirrored."""
    return _images(spark, folder).select("row_id", F.posexplode(I.window_values("stream", 8, 0, 6)).alias("pos", "value")).withColumn("value", F.round("value", 6))


@query(f"SELECT vec_id AS row_id, CAST((p - 1) // 8 AS INT) AS r, CAST((p - 1) % 8 AS INT) AS c, round(x[p], 6) AS value FROM {_E}, LATERAL (SELECT unnest(range(1, 65)) AS p) WHERE x[p] > 0.1")
def instance_target_points(spark, folder):
    """get_target_points: places above a level."""
    return I.target_points(_images(spark, folder), "stream", 8, 0.1).withColumn("value", F.round("value", 6))


@query(f"SELECT vec_id AS row_id, round(list_dot_product(x, list_reverse(x)), 6) AS value FROM {_E}")
def instance_inner_product(spark, folder):
    """broadcast_inner: products of two arrays summed."""
    return _images(spark, folder).withColumn("y", F.reverse("stream")).select("row_id", F.round(I.inner_product("stream", "y"), 6).alias("value"))


@query("SELECT l_orderkey, l_linenumber, l_quantity / 4 AS at, CASE WHEN l_quantity / 4 >= 12 THEN 11 ELSE CAST(floor(l_quantity / 4) + CASE WHEN l_quantity / 4 - floor(l_quantity / 4) > 0.5 AND floor(l_quantity / 4) + 1 < 12 THEN 1 ELSE 0 END AS INT) END AS cell FROM lineitem WHERE l_quantity / 4 <= 12")
def instance_nearest_cell(spark, folder):
    """closest_grid and round_options: the cell of a grid nearest to a place, on each axis."""
    t = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 4).alias("at")).where("at <= 12")
    return t.withColumn("cell", I.nearest_cell("at", 12))


_CLAMP = "greatest(0, least(7, CAST({} AS INT)))"
_WEIGH = " + ".join(f"x[{_CLAMP.format(f'floor(y) + {i}')} * 8 + {_CLAMP.format(f'floor(z) + {j}')} + 1] * (1 - abs(y - floor(y) - {i})) * (1 - abs(z - floor(z) - {j}))" for i in (0, 1) for j in (0, 1))


@query(f"SELECT vec_id AS row_id, CAST(p AS INT) AS pos, round({_WEIGH}, 6) AS value FROM (SELECT vec_id, x, p, (p // 12 + 0.5e0) * 8 / 5 - 0.5 AS y, (p % 12 + 0.5e0) * 8 / 12 - 0.5 AS z FROM {_E}, LATERAL (SELECT unnest(range(0, 60)) AS p))")
def instance_resized(spark, folder):
    """warp_img: an image of 8 by 8 as one of 5 by 12."""
    return _images(spark, folder).select("row_id", F.posexplode(I.resized("stream", 8, 5, 12)).alias("pos", "value")).withColumn("value", F.round("value", 6))


def _vectors(spark, folder):
    """A table of word vectors as a file would give it: every second of the 300 most frequent terms, some in capitals."""
    v = W.vocabulary(docs(spark, folder), "text", 300).where("idx % 2 = 1")
    term = F.when(F.col("idx") % 3 == 0, F.upper("term")).otherwise(F.col("term"))
    rows = v.select("idx", F.concat_ws(" ", term, *[(F.col("idx") * k / 8).cast("string") for k in (1, 2, 4)]).alias("value"))
    return I.vector_file(spark, _lines(rows, "vectors", "idx", "150 3"))


_VOCABULARY = f"(SELECT term, row_number() OVER (ORDER BY n DESC, term) AS idx FROM (SELECT term, count(*) AS n FROM {_T} GROUP BY term ORDER BY n DESC, term LIMIT 300))"


@query(f"SELECT idx, term, CAST(p AS INT) AS pos, CASE WHEN idx % 2 = 1 THEN idx * pow(2, p) / 8 ELSE 0e0 END AS value FROM {_VOCABULARY}, LATERAL (SELECT unnest(range(0, 3)) AS p)")
def text_embedding_matrix(spark, folder):
    """get_embedding_matrix: vectors of a vocabulary from a file, with casing fallbacks and zeros."""
    m = I.embedding_matrix(W.vocabulary(docs(spark, folder), "text", 300).select("idx", "term"), _vectors(spark, folder))
    return m.select("idx", "term", F.posexplode("vector").alias("pos", "value"))


@query(f"SELECT idx, term, CAST(p AS INT) AS pos, CASE WHEN idx % 2 = 1 THEN idx * pow(2, p % 3) / 8 ELSE 0e0 END AS value FROM {_VOCABULARY}, LATERAL (SELECT unnest(range(0, 6)) AS p)")
def text_embedding_matrix_two(spark, folder):
    """get_glove_fasttext_embedding_matrix: two tables joined end to end."""
    t = _vectors(spark, folder)
    m = I.embedding_matrix(W.vocabulary(docs(spark, folder), "text", 300).select("idx", "term"), t, t)
    return m.select("idx", "term", F.posexplode("vector").alias("pos", "value"))


@query(f"SELECT doc_id AS id, CAST(p AS INT) AS dim, round(avg(idx * pow(2, p) / 8), 6) AS value FROM {_T} t JOIN (SELECT * FROM {_VOCABULARY} WHERE idx % 2 = 1 AND idx % 3 <> 0) v ON v.term = t.term, LATERAL (SELECT unnest(range(0, 3)) AS p) GROUP BY doc_id, p")
def text_pretrained_vectors(spark, folder):
    """PretrainedEmbeddingLayer: the mean of a text's word vectors."""
    terms = docs(spark, folder).select(F.col("doc_id").alias("id"), F.explode(W.tokens("text")).alias("term"))
    return I.text_vectors(terms, _vectors(spark, folder)).withColumn("value", F.round("value", 6))


_FAMILIES = ", ".join(f"('{n}', '{f}')" for n, f in I.families())
_TREES = "(SELECT DISTINCT lower(trim(hash)) AS hash, tree FROM individuals WHERE tree IS NOT NULL)"


@query(rf"WITH c AS (SELECT hash, tree, unnest(regexp_extract_all(tree, '([\w.<>&\-]+)\(', 1)) AS name FROM {_TREES}), f(name, family) AS (VALUES {_FAMILIES}) SELECT hash, coalesce(family, 'other') AS family, round(CAST(count(*) AS DOUBLE) / max(total), 6) AS share FROM c LEFT JOIN f ON f.name = c.name JOIN (SELECT hash AS h, count(*) AS total FROM c GROUP BY 1) t ON t.h = c.hash GROUP BY 1, 2")
def report_primitive_families(spark, folder):
    """primitive_parse: share of the operator families in each program."""
    t = table(spark, folder, "individuals").where("tree is not null").select(F.lower(F.trim("hash")).alias("hash"), "tree").distinct()
    return I.family_shares(t, "hash", "tree").withColumn("share", F.round("share", 6))


@query(f"SELECT min(hash) AS hash, sha256(tree) AS tree_hash, count(*) AS n FROM {_TREES} GROUP BY tree")
def pop_similar_programs(spark, folder):
    """my_similar: programs with the same string, one each."""
    t = table(spark, folder, "individuals").where("tree is not null").select(F.lower(F.trim("hash")).alias("hash"), "tree").distinct()
    return t.groupBy("tree").agg(F.min("hash").alias("hash"), F.count("*").alias("n")).select("hash", F.sha2("tree", 256).alias("tree_hash"), "n")


@query()
def program_offspring(spark, folder):
    """simulateMateMut: offspring of all stored programs."""
    t = table(spark, folder, "individuals").where("tree is not null").groupBy(F.lower(F.trim("hash")).alias("hash")).agg(F.min("tree").alias("tree"))
    return I.varied(t, "hash", "tree", {"crossover": 0.5, "constants": 0.3, "terminal": 0.3, "shrink": 0.1, "swap": 0.1, "remove": 0.1, "insert": 0.1})
