"""Parent-child links to full hierarchies: root, depth, path, descendants, and lines that run in a circle.

Links are resolved by weighted disjoint-set forests. Blocks of links are first reduced inside their partition, each
node then pointing at the farthest ancestor its block knows, with the offset to it. What is left to merge are the
boundary links: those of nodes other nodes point at. They are merged block by block, in ever fewer blocks, until
none is left; a block never holds more than ``block_rows`` links. Where chains cross more blocks than reduction can
join, pointers jump (one distributed join doubles the distance), so the number of rounds is logarithmic.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.staging import stage

#: Most links a task holds at once.
BLOCK_ROWS = 250_000
_LINKS = "node string, ptr string, off long, cyc boolean"


def _forest(nodes: list, ptrs: list, offs: list, cycs: list) -> tuple[list, list, list]:
    """Local forest with offsets: for each node the end of its line within the block, the distance, and whether the
    line ends in a circle."""
    up = {n: (p, o, c) for n, p, o, c in zip(nodes, ptrs, offs, cycs)}
    done: dict = {}
    for start in up:
        line, on_line, at = [], set(), start
        while at in up and at not in done and at not in on_line:
            line.append(at)
            on_line.add(at)
            if up[at][2]:
                break
            at = up[at][0]
        if at in done:
            end, off, cyc = done[at]
        elif at in on_line:
            end, off, cyc = at, 0, True
        else:
            end, off, cyc = at, 0, False
        for n in reversed(line):
            off += up[n][1]
            done[n] = (end, off, cyc)
    found = [done[n] for n in nodes]
    return [f[0] for f in found], [f[1] for f in found], [f[2] for f in found]


def _reduce(block_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0

        def flush():
            t = pa.Table.from_batches(held)
            nodes = t.column(0).to_pylist()
            end, off, cyc = _forest(nodes, t.column(1).to_pylist(), t.column(2).to_pylist(), t.column(3).to_pylist())
            return pa.RecordBatch.from_arrays([pa.array(nodes, pa.string()), pa.array(end, pa.string()), pa.array(off, pa.int64()), pa.array(cyc, pa.bool_())], names=["node", "ptr", "off", "cyc"])

        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= block_rows:
                yield flush()
                held, rows = [], 0
        if rows:
            yield flush()

    return run


def _follow(links: DataFrame, further: DataFrame) -> DataFrame:
    """Each link lengthened by the link its end has in ``further``, if any."""
    f = further.select(F.col("node").alias("ptr"), F.col("ptr").alias("p2"), F.col("off").alias("o2"), F.col("cyc").alias("c2"))
    return links.join(f, "ptr", "left").select(
        "node",
        F.when(F.col("cyc"), F.col("ptr")).otherwise(F.coalesce("p2", "ptr")).alias("ptr"),
        (F.col("off") + F.when(F.col("cyc"), 0).otherwise(F.coalesce("o2", F.lit(0)))).alias("off"),
        (F.col("cyc") | F.coalesce("c2", F.lit(False))).alias("cyc"),
    )


def _resolve(links: DataFrame, block_rows: int, jumps: int = 0, first: int = 0) -> DataFrame:
    """Links (node, ptr, off, cyc), one per node, to (node, end of line, distance, cyc). ``first`` is the number of
    boundary links before any jump: a pointer that has not ended spans at least 2^jumps of them."""
    local = stage(links.mapInArrow(_reduce(block_rows), _LINKS), "forest")
    ends = local.where(~F.col("cyc")).select(F.col("ptr").alias("node")).distinct()
    boundary = stage(local.join(ends, "node", "left_semi"), "boundary")
    size = boundary.count()
    first = first or size
    if size == 0:
        return local
    if size <= block_rows:
        merged = boundary.repartition(1).mapInArrow(_reduce(1 << 62), _LINKS)
    elif jumps > first.bit_length():
        merged = boundary.withColumn("cyc", F.lit(True))  # jumped farther than any line without a circle is long
    else:
        blocks = -(-size // block_rows)
        jumped = _follow(boundary, boundary)
        merged = _resolve(jumped.repartition(blocks, F.xxhash64("ptr", F.lit(jumps))), block_rows, jumps + 1, first)
    return stage(_follow(local, merged), "resolved")


def hierarchy(nodes: DataFrame, node: str = "node", parent: str = "parent", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(node, root, depth, cyclic) for each node of a table of unique (node, parent).

    A node whose parent is NULL or no node is a root: depth 0, itself as root. A node whose line runs in a circle,
    be it part of the circle or only leading to it, has root NULL, depth NULL and cyclic true; its own parent makes a
    circle of one. An empty table gives an empty result. NULL nodes are left out; extra columns are ignored. If a
    node comes with several rows, one of its smallest non-NULL parent is kept.
    """
    known = nodes.where(F.col(node).isNotNull()).groupBy(F.col(node).cast("string").alias("node")).agg(F.min(F.col(parent).cast("string")).alias("parent"))
    known = stage(known, "nodes")
    links = known.where(F.col("parent").isNotNull()).join(known.select(F.col("node").alias("parent")), "parent", "left_semi")
    links = links.select("node", F.col("parent").alias("ptr"), F.lit(1).cast("long").alias("off"), F.lit(False).alias("cyc"))
    done = _resolve(links, block_rows)
    out = known.select("node").join(done, "node", "left")
    return out.select(
        "node",
        F.when(~F.coalesce("cyc", F.lit(False)), F.coalesce("ptr", "node")).alias("root"),
        F.when(~F.coalesce("cyc", F.lit(False)), F.coalesce("off", F.lit(0))).cast("int").alias("depth"),
        F.coalesce("cyc", F.lit(False)).alias("cyclic"),
    )


def paths(nodes: DataFrame, node: str = "node", parent: str = "parent", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(node, root, depth, path) for each node not on or above a circle; path runs from the root to the node.

    Paths are put together from an index of jumps: after round k each node knows its next 2^k ancestors, so the number
    of joins is the logarithm of the greatest depth. Nodes in circles are given by :func:`circles`.
    """
    h = stage(hierarchy(nodes, node, parent, block_rows), "depths")
    acyclic = h.where(~F.col("cyclic")).select("node", "root", "depth")
    deepest = acyclic.agg(F.max("depth")).first()[0] or 0
    up = nodes.where(F.col(node).isNotNull()).groupBy(F.col(node).cast("string").alias("node")).agg(F.min(F.col(parent).cast("string")).alias("ptr"))
    at = acyclic.join(up, "node").select("node", F.when(F.col("depth") > 0, F.col("ptr")).alias("ptr"), F.array("node").alias("seg"))
    for _ in range(int(deepest).bit_length()):
        at = stage(at, "jumps")
        nxt = at.select(F.col("node").alias("ptr"), F.col("ptr").alias("p2"), F.col("seg").alias("s2"))
        at = at.join(nxt, "ptr", "left").select("node", F.col("p2").alias("ptr"), F.when(F.col("s2").isNull(), F.col("seg")).otherwise(F.concat("seg", "s2")).alias("seg"))
    return acyclic.join(at, "node").select("node", "root", "depth", F.reverse("seg").alias("path"))


def descendants(of: DataFrame) -> DataFrame:
    """(ancestor, node, distance) for every proper ancestor of every node, from the result of :func:`paths`.

    One narrow step without a shuffle: no task gathers the descendants of one node.
    """
    return of.select("node", "depth", F.posexplode("path").alias("at", "ancestor")).where(F.col("at") < F.col("depth")).select("ancestor", "node", (F.col("depth") - F.col("at")).cast("int").alias("distance"))


def circles(nodes: DataFrame, node: str = "node", parent: str = "parent", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(node, circle, length) for each node that is part of a circle; circle is its least node.

    Only nodes whose line never ends are looked at. Minima travel along the circle by jumps of doubling length.
    """
    h = stage(hierarchy(nodes, node, parent, block_rows), "depths")
    bad = h.where("cyclic").select("node")
    up = nodes.where(F.col(node).isNotNull()).groupBy(F.col(node).cast("string").alias("node")).agg(F.min(F.col(parent).cast("string")).alias("ptr"))
    at = stage(bad.join(up, "node"), "lines")
    rounds = at.count().bit_length()
    # Nodes still reached after that many jumps are on a circle; leaders-in are not reached by anyone so far away.
    step = at
    for _ in range(rounds):
        nxt = step.select(F.col("node").alias("ptr"), F.col("ptr").alias("p2"))
        step = stage(step.join(nxt, "ptr").select("node", F.col("p2").alias("ptr")), "far")
    on = stage(at.join(step.select(F.col("ptr").alias("node")).distinct(), "node", "left_semi"), "on")
    low = on.withColumn("low", F.col("node"))
    for _ in range(rounds):
        nxt = low.select(F.col("node").alias("ptr"), F.col("ptr").alias("p2"), F.col("low").alias("l2"))
        low = stage(low.join(nxt, "ptr").select("node", F.col("p2").alias("ptr"), F.least("low", "l2").alias("low")), "low")
    sizes = low.groupBy("low").agg(F.count("*").alias("length"))
    return low.join(sizes, "low").select("node", F.col("low").alias("circle"), "length")
