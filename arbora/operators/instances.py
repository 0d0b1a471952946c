"""Small operators on instances: rows and columns of a matrix, targets, crops and windows of images, vectors of words."""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbora.functions.registry import OPS


def observation(df: DataFrame, row_id: int) -> DataFrame:
    """One row's features and target."""
    return df.where(F.col("row_id") == row_id).select("features", "target")


def feature(df: DataFrame, k: int) -> DataFrame:
    """(row_id, value, target): one feature of all rows, NULL where a row has fewer."""
    return df.select("row_id", F.get("features", k).alias("value"), "target")


def flattened(df: DataFrame, nested: str = "stream", depth: int = 1) -> DataFrame:
    """(row_id, pos, value): all numbers of a nested array, inner arrays one after the other."""
    c = F.col(nested)
    for _ in range(depth):
        c = F.flatten(c)
    return df.select("row_id", F.posexplode(c).alias("pos", "value"))


def checked_targets(df: DataFrame) -> DataFrame:
    """``df``, if its train rows have at least two targets; else an error."""
    least, most = df.where((F.col("split") == "train") & F.col("target").isNotNull()).agg(F.min("target"), F.max("target")).first()
    if least is None or least == most:
        raise ValueError("fewer than two distinct training targets")
    return df


def scaled_by_train(df: DataFrame, col: str = "stream") -> DataFrame:
    """An array column of all rows over the greatest value of the train rows; unchanged if that is 0 or missing."""
    top = df.where("split = 'train'").agg(F.max(F.array_max(col)).alias("__top"))
    by = F.when(F.coalesce("__top", F.lit(0.0)) != 0, F.col("__top")).otherwise(1.0)
    return df.join(F.broadcast(top)).withColumn(col, F.transform(col, lambda v: v / by)).drop("__top")  # one row


def encoded_targets(df: DataFrame) -> DataFrame:
    """``df`` with ``encoded``: the target as it is if the train rows have up to two classes, else one place for each class of
    the train rows in their order, all zero for a class these lack."""
    classes = df.where((F.col("split") == "train") & F.col("target").isNotNull()).agg(F.array_sort(F.collect_set("target")).alias("__classes"))
    hot = F.transform("__classes", lambda c: F.when(c == F.col("target"), 1.0).otherwise(0.0))
    return df.join(F.broadcast(classes)).withColumn("encoded", F.when(F.size("__classes") > 2, hot).otherwise(F.array(F.col("target").cast("double")))).drop("__classes")  # one row


def cropped(image: str, width: int, top: int, left: int, height: int, wide: int) -> Column:
    """A box of a row-major image, cut at its edges."""
    h = (F.size(image) / width).cast("int")
    rows = F.filter(F.sequence(F.lit(top), F.lit(top + height - 1)), lambda r: (r >= 0) & (r < h))
    lo, hi = max(left, 0), min(left + wide, width)
    cells = F.flatten(F.transform(rows, lambda r: F.slice(F.col(image), r * width + lo + 1, max(hi - lo, 0))))
    return F.when(F.col(image).isNotNull(), cells)


def window_values(image: str, width: int, row: int, col: int, size: int = 7, hole: int = 3) -> Column:
    """Values of the window around a place without the hole in its middle, edges mirrored with the edge repeated."""
    h = (F.size(image) / width).cast("int")
    half, inner = size // 2, hole // 2
    fold = lambda at, n: F.when(at < 0, -at - 1).when(at >= n, 2 * n - 1 - at).otherwise(at)
    cells = [F.get(image, fold(F.lit(row + y), h) * width + fold(F.lit(col + x), F.lit(width))) for y in range(-half, half + 1) for x in range(-half, half + 1) if max(abs(y), abs(x)) > inner]
    return F.array(*cells)


def nearest_cell(at: str, size: int) -> Column:
    """The cell of a grid of ``size`` cells nearest to a place, the lower of two equally near; places at 0 and at ``size``
    belong to the first and the last cell. NULL where neither neighbour is a cell."""
    x = F.col(at)
    lo, hi = F.floor(x), F.ceil(x)
    inside = lambda c: (c >= 0) & (c < size)
    near = F.when(inside(lo) & (~inside(hi) | (x - lo <= hi - x)), lo).when(inside(hi), hi)
    return F.when(x == size, F.lit(size - 1)).otherwise(near).cast("int")


def resized(image: str, width: int, rows: int, cols: int) -> Column:
    """A row-major image of another size: each pixel is weighed from the four around its place, edges repeated."""
    h = (F.size(image) / width).cast("int")

    def at(k: Column, scale: Column) -> Column:
        return (k + 0.5) * scale - 0.5

    def pixel(r: Column, c: Column) -> Column:
        return F.get(image, (F.greatest(F.lit(0), F.least(h - 1, r)) * width + F.greatest(F.lit(0), F.least(F.lit(width - 1), c))).cast("int"))

    def cell(k: Column) -> Column:
        y, x = at(F.floor(k / cols), h / float(rows)), at(k % cols, F.lit(width / cols))
        r, c = F.floor(y), F.floor(x)
        return (pixel(r, c) * (1 - (x - c)) + pixel(r, c + 1) * (x - c)) * (1 - (y - r)) + (pixel(r + 1, c) * (1 - (x - c)) + pixel(r + 1, c + 1) * (x - c)) * (y - r)

    return F.when(F.size(image) > 0, F.transform(F.sequence(F.lit(0), F.lit(rows * cols - 1)), cell))


def target_points(df: DataFrame, image: str, width: int, above: float = 0.0) -> DataFrame:
    """(row_id, r, c, value): places of an image above a level."""
    return df.select("row_id", F.posexplode(image).alias("at", "value")).where(F.col("value") > above).select("row_id", F.floor(F.col("at") / width).cast("int").alias("r"), (F.col("at") % width).alias("c"), "value")


def inner_product(a: str, b: str) -> Column:
    """Sum of products of two arrays of one length, NULL for others."""
    return F.when(F.size(a) == F.size(b), F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v))


def embedding_matrix(vocabulary: DataFrame, *tables: DataFrame) -> DataFrame:
    """(idx, term, vector): the vectors of each term of a vocabulary (idx, term) from tables (term, vector), joined end to end.

    A term a table lacks is looked up in lower case, then with a capital, then in capitals, and is zeros at last. Each
    table should have one length of vectors; a term it has several times gets the greatest.
    """
    out = vocabulary.select("idx", "term")
    for k, t in enumerate(tables):
        size = t.agg(F.coalesce(F.max(F.size("vector")), F.lit(0)).alias("n")).first()["n"]
        known = t.groupBy("term").agg(F.max("vector").alias("v"))
        forms = F.array(*[F.struct(F.lit(i).alias("rank"), f.alias("form")) for i, f in enumerate((F.col("term"), F.lower("term"), F.initcap("term"), F.upper("term")))])
        tried = vocabulary.select("idx", F.explode(forms).alias("f")).join(known.withColumnRenamed("term", "form"), F.col("f.form") == F.col("form"))
        best = tried.groupBy("idx").agg(F.min_by("v", "f.rank").alias(f"v{k}"))
        out = out.join(best, "idx", "left").withColumn(f"v{k}", F.coalesce(f"v{k}", F.array_repeat(F.lit(0.0), size)))
    return out.select("idx", "term", F.concat(*[F.col(f"v{k}") for k in range(len(tables))]).alias("vector"))


def text_vectors(terms: DataFrame, table: DataFrame) -> DataFrame:
    """(id, dim, value): mean vector of the known terms of each text, from (id, term) with repetitions. Texts without known
    terms have no rows. Counts are combined per text and term before vectors are opened up."""
    counts = terms.groupBy("id", "term").agg(F.count("*").alias("n"))
    long = counts.join(table.select("term", "vector"), "term").select("id", "n", F.posexplode("vector").alias("dim", "v"))
    return long.groupBy("id", "dim").agg((F.sum(F.col("n") * F.col("v")) / F.sum("n")).alias("value"))


def families() -> list[tuple[str, str]]:
    """(operator, family) of the registry: the module an operator's kernel is from, or 'vector' for native ones."""
    return [(o.name, o.kernel.__module__.rsplit(".", 1)[-1] if o.kernel else "vector") for o in OPS.values()]


def family_shares(programs: DataFrame, id: str, tree: str) -> DataFrame:
    """(id, family, share): what share of a program's calls are operators of each family; 'other' for calls outside the
    registry. Programs without calls have no rows."""
    known = programs.sparkSession.createDataFrame(families(), "name string, family string")
    calls = programs.select(id, F.explode(F.regexp_extract_all(tree, F.lit(r"([\w.<>&\-]+)\("), F.lit(1))).alias("name"))
    n = calls.join(F.broadcast(known), "name", "left").groupBy(id, F.coalesce("family", F.lit("other")).alias("family")).agg(F.count("*").alias("n"))
    total = calls.groupBy(id).agg(F.count("*").alias("total"))
    return n.join(total, id).select(id, "family", (F.col("n") / F.col("total")).alias("share"))


def varied(programs: DataFrame, id: str, tree: str, rates: dict[str, float], seed: int = 7) -> DataFrame:
    """(id, child, made_by): offspring of a population. Programs are dealt into pairs by a seeded order; a pair is crossed with
    the rate of ``crossover`` (and ``constants``), then each program is mutated with the rates of ``terminal``, ``shrink``,
    ``swap``, ``remove`` and ``insert``. Same programs, rates and seed give the same offspring under any partitioning.
    Programs that cannot be read are handed on as they are. An id counts once, with its least tree; NULL ids are left out.
    """
    from arbora.plans import variation as V
    from arbora.plans.program import parse

    # Rows fall to as many places as there are pairs by their hash, a few to each; no task numbers all rows.
    once = programs.where(F.col(id).isNotNull()).groupBy(id).agg(F.min(tree).alias(tree))
    n = max(1, once.count() // 2)
    dealt = once.withColumn("__pair", F.pmod(F.xxhash64(id, F.lit(seed)), F.lit(n)))
    names = sorted(OPS)

    def children(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values(id, kind="stable").to_dict("records")
        out = []
        for at in range(0, len(rows), 2):
            two, made = rows[at : at + 2], [[], []]
            trees = []
            for row in two:
                try:
                    trees.append(parse(row[tree]))
                except (ValueError, AttributeError, TypeError):
                    trees.append(None)
            r = random.Random(f"{seed} {two[0][id]}")
            if len(trees) == 2 and None not in trees:
                for name, op in (("crossover", V.crossover), ("constants", V.swap_constants)):
                    if r.random() < rates.get(name, 0.0):
                        trees = list(op(*trees, r.randrange(1 << 30)))
                        made = [m + [name] for m in made]
            for k, row in enumerate(two):
                t = trees[k]
                for name, op in (("terminal", V.mutate_terminal), ("shrink", V.shrink), ("swap", lambda x, s: V.swap(x, names, s)), ("remove", V.remove), ("insert", lambda x, s: V.insert(x, "Copy", s))):
                    if r.random() < rates.get(name, 0.0) and t is not None:
                        t, made[k] = op(t, r.randrange(1 << 30)), made[k] + [name]
                out.append((row[id], row[tree] if t is None or not made[k] else str(t), ",".join(made[k])))
        return pd.DataFrame(out, columns=[id, "child", "made_by"])

    return dealt.groupBy("__pair").applyInPandas(children, f"`{id}` {programs.schema[id].dataType.simpleString()}, child string, made_by string")


def vector_file(spark, path: str) -> DataFrame:
    """(term, vector): a text file of word vectors, a word and its numbers on a line; lines of two fields (a heading) and
    lines whose numbers cannot be read are left out."""
    x = F.split(F.trim("value"), " ")
    t = spark.read.text(path).select(F.get(x, F.lit(0)).alias("term"), F.transform(F.slice(x, 2, 1 << 20), lambda v: v.try_cast("double")).alias("vector"))
    return t.where((F.size("vector") > 1) & ~F.exists("vector", lambda v: v.isNull()))
