"""The run store: upserts, running totals and cache eviction over tables of programs, methods and cache entries."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arbora.operators.objectives import running_sums
from arbora.staging import stage


def upsert(table: DataFrame, changes: DataFrame, keys: list[str], add: list[str] = (), put: list[str] = ()) -> DataFrame:
    """``table`` with the rows of ``changes`` merged in: columns in ``add`` are summed, those in ``put`` replaced where
    the change is not NULL, and rows with new keys appended. Several changes of one key are first combined (sums, and
    the greatest value to put). Other columns of new rows are NULL; extra columns of ``changes`` are ignored."""
    c = changes.groupBy(*keys).agg(*[F.sum(a).alias(f"__a_{a}") for a in add], *[F.max(p).alias(f"__p_{p}") for p in put], F.lit(True).alias("__hit"))
    j = table.withColumn("__old", F.lit(True)).join(c, keys, "full")
    out = []
    for f in table.columns:
        v = F.col(f)
        if f in add:
            v = F.when(F.col("__hit"), F.coalesce(F.col(f), F.lit(0)) + F.coalesce(F.col(f"__a_{f}"), F.lit(0))).otherwise(F.col(f)).cast(table.schema[f].dataType)
        elif f in put:
            v = F.coalesce(F.col(f"__p_{f}"), F.col(f))
        out.append(v.alias(f))
    return j.select(*out)


def insert_missing(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``table`` and those ``rows`` whose key it does not have yet, each key once; missing columns are NULL."""
    return table.unionByName(rows.join(table.select(*keys).distinct(), keys, "left_anti").dropDuplicates(keys), allowMissingColumns=True)


def eviction_values(cache: DataFrame, links: DataFrame, methods: DataFrame) -> DataFrame:
    """Worth of each cache entry: time its methods would cost again, weighted by recent hits and idle generations.

    value = reads * sum((eval_time / num_eval) * (num_ref - num_eval)) * (hits / (most hits + 1) + 1 / (idle + 1))
    """
    m = methods.select(F.col("id").alias("method_id"), F.when(F.col("num_eval") > 0, F.col("eval_time") / F.col("num_eval") * (F.col("num_ref") - F.col("num_eval"))).alias("saved")).where(F.abs("saved") < float("inf"))
    per = links.select("method_id", F.col("cache_id").alias("id")).join(m, "method_id").groupBy("id").agg(F.sum("saved").alias("saved"))
    most = cache.agg((F.coalesce(F.max("hits_last_gen"), F.lit(0)) + 1).alias("most"))
    v = cache.join(per, "id", "left").join(F.broadcast(most))  # one row
    recent = F.col("hits_last_gen") / F.col("most") + 1.0 / (F.col("gens_since_last_hit") + 1)
    return v.select("id", "host_id", "size_kb", (F.coalesce("saved", F.lit(0.0)) * F.col("num_reads") * recent).alias("value"))


def keep_prefix(values: DataFrame, capacity: float) -> DataFrame:
    """Entries kept when the least worth are evicted until the rest fits: value descending, ties by id."""
    ranked = values.withColumn("__k", F.col("value"))
    per_value = ranked.groupBy("__k").agg(F.sum("size_kb").alias("__size"))
    above = running_sums(per_value, F.col("__k"), {"__above": F.col("__size")}, descending=True)
    w = Window.partitionBy("__k").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    out = ranked.join(above.select("__k", "__above"), "__k").withColumn("__used", F.col("__above") + F.sum("size_kb").over(w))
    return out.where(F.col("__used") <= capacity).drop("__k", "__above", "__used")


def keep_greedy(values: DataFrame, capacity: float, most_rounds: int = 200) -> DataFrame:
    """Entries kept by value descending, each if it still fits (skipping, not stopping), exactly.

    In a round all entries before the first that does not fit are kept at once; entries larger than what is left are
    dropped. Each round is a running sum over ranges, so no task sees all entries.
    """
    rest = stage(values.select("id", "size_kb", "value"), "greedy")
    kept, left = None, float(capacity)
    for _ in range(most_rounds):
        rest = stage(rest.where(F.col("size_kb") <= left), "greedy")
        if rest.isEmpty():
            break
        per_value = rest.groupBy("value").agg(F.sum("size_kb").alias("s"))
        above = running_sums(per_value, F.col("value"), {"above": F.col("s")}, descending=True).select("value", "above")
        w = Window.partitionBy("value").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
        run = stage(rest.join(above, "value").withColumn("used", F.col("above") + F.sum("size_kb").over(w)), "greedy")
        take = run.where(F.col("used") <= left)
        used = take.agg(F.max("used")).first()[0] or 0.0
        kept = take.select("id", "size_kb", "value") if kept is None else kept.unionByName(take.select("id", "size_kb", "value"))
        rest, left = run.where(F.col("used") > left).select("id", "size_kb", "value"), left - used
    else:
        raise RuntimeError("greedy selection did not end; raise most_rounds")
    return kept if kept is not None else values.select("id", "size_kb", "value").limit(0)


def knapsack(values: DataFrame, capacity: float, bins: int | None = None, most: int = 2_000_000, core: int = 10_000) -> DataFrame:
    """Entries of greatest total value that fit, whatever their number (exact to 1e-12 of the total value).

    Without ``bins`` sizes count as they are; with it, rounded up to ``capacity / bins``. Entries of a NULL size are
    never kept, ids are unique. If not all entries of positive value fit, the best by value per size are taken up to the
    break. By the bound at the break, leaving that choice costs each entry a known loss; an exact programme decides
    the ``core`` entries of least loss, and more of them until no other entry can improve the total. More than ``most``
    states of the programme are an error, never a worse selection.
    """
    w, cap = (F.col("size_kb").cast("double"), float(capacity)) if bins is None else (F.greatest(F.lit(1), F.ceil(F.col("size_kb") / (capacity / bins))).cast("double"), float(bins))
    sized = values.where(F.col("size_kb").isNotNull() & (F.col("value") > 0)).select("id", "size_kb", "value", F.greatest(w, F.lit(0.0)).alias("w"))
    c = stage(sized.where(F.col("w") <= cap).withColumn("ratio", F.when(F.col("w") > 0, F.col("value") / F.col("w")).otherwise(F.lit(np.finfo(float).max))), "knapsack")
    if (c.agg(F.sum("w")).first()[0] or 0.0) <= cap:
        return c.select("id", "size_kb", "value")
    per = c.groupBy("ratio").agg(F.sum("w").alias("w"))
    edge = running_sums(per, F.col("ratio"), {"above": F.col("w")}, descending=True).where(F.col("above") <= cap).orderBy("ratio").first()
    rate = F.lit(edge["ratio"])
    at = c.where(F.col("ratio") == rate).withColumn("take", F.sum("w").over(Window.orderBy("id").rowsBetween(Window.unboundedPreceding, 0)) <= cap - edge["above"])  # those of one ratio
    marked = c.where(F.col("ratio") != rate).withColumn("take", F.col("ratio") > rate).unionByName(at)
    marked = stage(marked.withColumn("loss", F.abs(F.col("value") - F.col("w") * rate)), "knapsack")
    used, got = marked.where("take").agg(F.coalesce(F.sum("w"), F.lit(0.0)), F.coalesce(F.sum("value"), F.lit(0.0))).first()
    while True:
        near = marked.orderBy("loss", "id").limit(core).select("id", "w", "value", "take", "loss").toArrow()
        n = {x: near[x].to_numpy() for x in ("w", "value", "take", "loss")}
        flips, gap = _flips(n["w"], n["value"], n["take"], n["loss"], cap, used, got, edge["ratio"], most)
        if marked.where(F.col("loss") < gap).count() <= near.num_rows:
            break
        core *= 8
    if flips:
        other = values.sparkSession.createDataFrame([(near["id"][i].as_py(),) for i in flips], T.StructType([marked.schema["id"]]))
        marked = marked.join(F.broadcast(other.withColumn("flip", F.lit(True))), "id", "left").withColumn("take", F.col("take") != F.coalesce("flip", F.lit(False)))
    return marked.where("take").select("id", "size_kb", "value")


def _flips(w, v, take, loss, cap: float, used: float, got: float, rate: float, most: int) -> tuple[list[int], float]:
    """Which entries (by ascending loss) to decide otherwise than ``take`` for the greatest value, and how far that may be
    from the bound. States are the undominated pairs of size and value; one that has lost the gap can't improve."""
    bound = got + (cap - used) * rate
    best, at, gap = got, -1, bound - got
    size, value, lost, node = np.array([used]), np.array([got]), np.zeros(1), np.full(1, -1)
    before, entry, n = [], [], 0
    for i in range(len(w)):
        room = gap - 1e-12 * bound
        if loss[i] >= room:
            break
        d = -1.0 if take[i] else 1.0
        on = lost + loss[i] < room
        s, x, l = size[on] + d * w[i], value[on] + d * v[i], lost[on] + loss[i]
        own = np.arange(n, n + len(s))
        before.append(node[on])
        entry.append(np.full(len(s), i))
        n += len(s)
        fit = np.flatnonzero(s <= cap)
        if len(fit) and x[k := fit[np.argmax(x[fit])]] > best:
            best, at = x[k], own[k]
            gap = bound - best
        size, value, lost, node = np.append(size, s), np.append(value, x), np.append(lost, l), np.append(node, own)
        order = np.lexsort((-value, size))
        highest = np.maximum.accumulate(value[order])
        order = order[np.append(True, value[order][1:] > highest[:-1])]
        order = order[lost[order] < max(gap - 1e-12 * bound, 0.0)]
        size, value, lost, node = size[order], value[order], lost[order], node[order]
        if len(size) > most or n > 50 * most:
            raise RuntimeError("the exact selection needs too many states; raise most, or give bins")
    out = []
    if n:
        before, entry = np.concatenate(before), np.concatenate(entry)
    while at >= 0:
        out.append(int(entry[at]))
        at = before[at]
    return out, gap - 1e-12 * bound


def layer_counts(trees: DataFrame, by: list[str], text: str) -> DataFrame:
    """(by, layer, n): names that open a parenthesis, counted."""
    names = F.regexp_extract_all(text, F.lit(r"(\w+)\("), F.lit(1))
    return trees.select(*by, F.explode(names).alias("layer")).groupBy(*by, "layer").agg(F.count("*").alias("n"))


def welch(a: DataFrame, b: DataFrame, by: str, value: str) -> DataFrame:
    """Welch's t test of two samples per group: (by, t, df, p_value). Fewer than two values in a sample give NULL."""
    s = lambda d, n: d.groupBy(by).agg(F.count(value).alias(f"n{n}"), F.avg(value).alias(f"m{n}"), F.var_samp(value).alias(f"v{n}"))
    j = s(a, 1).join(s(b, 2), by)
    x, y = F.col("v1") / F.col("n1"), F.col("v2") / F.col("n2")
    t = (F.col("m1") - F.col("m2")) / F.sqrt(x + y)
    dof = (x + y) ** 2 / (x * x / (F.col("n1") - 1) + y * y / (F.col("n2") - 1))
    ok = (F.col("n1") > 1) & (F.col("n2") > 1) & (x + y > 0)
    r = j.where(ok).select(by, t.alias("t"), dof.alias("dof"))
    return r.withColumn("p_value", _two_sided("t", "dof"))


def _two_sided(t: str, dof: str) -> Column:
    """Tail of Student's t by the continued fraction of the incomplete beta function, vectorised."""

    @F.pandas_udf("double")
    def tail(t: pd.Series, dof: pd.Series) -> pd.Series:
        from math import lgamma

        def beta(a: np.ndarray, b: float, x: np.ndarray) -> np.ndarray:
            front = np.array([np.exp(lgamma(p + b) - lgamma(p) - lgamma(b)) for p in a]) * x**a * (1 - x) ** b / a
            f, c, d = np.ones_like(x), np.ones_like(x), np.zeros_like(x)
            for i in range(300):
                m = i // 2
                if i == 0:
                    n = np.ones_like(x)
                elif i % 2 == 0:
                    n = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
                else:
                    n = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
                d = 1 / np.where(np.abs(1 + n * d) < 1e-30, 1e-30, 1 + n * d)
                c = np.where(np.abs(1 + n / c) < 1e-30, 1e-30, 1 + n / c)
                f = f * c * d
            return front * (f - 1)

        t, v = t.to_numpy(float), dof.to_numpy(float)
        x = v / (v + t * t)
        flip = x > (v / 2 + 1) / (v / 2 + 2.5)
        direct = beta(v / 2, 0.5, np.where(flip, 0.5, x))
        y = 1 - x
        other = np.array([_beta_ab(0.5, a, z) for a, z in zip(v / 2, np.where(flip, y, 0.5))])
        return pd.Series(np.where(flip, 1 - other, direct))

    return tail(t, dof)


def _beta_ab(a: float, b: float, x: float) -> float:
    from math import exp, lgamma, log

    if x <= 0:
        return 0.0
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(max(1 - x, 1e-300))) / a
    total, term = 1.0, 1.0
    for n in range(5000):  # series of the hypergeometric function
        term *= (a + b + n) * x / (a + 1 + n)
        total += term
        if term < 1e-15 * total:
            break
    return front * total
