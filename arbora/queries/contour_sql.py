"""SQL for edges, connected objects and their measures on images of 8 by 8.

Labels spread one pixel a step in a recursion, a row per image. Areas and lengths are counted over pixels, hulls are the
pairs of pixels with no other pixel on their right.
"""

from __future__ import annotations

import math

from arbora.queries.image_sql import _BYTES, D1, S3, filtered, near, pixels, square, weighted

_IMAGES = f"im AS MATERIALIZED (SELECT vec_id, {_BYTES} AS x FROM embeddings)"
_EDGES = f"""g0 AS (SELECT *, {filtered('x', weighted(S3, D1), 'edge')} AS gx, {filtered('x', weighted(D1, S3), 'edge')} AS gy FROM im),
  g1 AS (SELECT *, {pixels('gx[k + 1] * gx[k + 1] + gy[k + 1] * gy[k + 1]')} AS m2, {pixels('((CAST(round(atan2(gy[k + 1], gx[k + 1]) / (pi() / 4)) AS INT) % 4) + 4) % 4')} AS way FROM g0),
  g2 AS (SELECT *, {pixels("CASE way[k + 1] WHEN 0 THEN m2[k + 1] > A AND m2[k + 1] >= B WHEN 1 THEN m2[k + 1] > C AND m2[k + 1] >= D WHEN 2 THEN m2[k + 1] > E AND m2[k + 1] >= F ELSE m2[k + 1] > G AND m2[k + 1] >= H END")} AS thin FROM g1),
  g3 AS (SELECT vec_id, x, {pixels('thin[k + 1] AND m2[k + 1] > 2500')} AS mask, {pixels('thin[k + 1] AND m2[k + 1] > 22500')} AS strong FROM g2)"""
for _mark, _at in {"A": (0, -1), "B": (0, 1), "C": (-1, -1), "D": (1, 1), "E": (-1, 0), "F": (1, 0), "G": (-1, 1), "H": (1, -1)}.items():
    _y, _x = _at
    _inside = f"(CASE WHEN k // 8 + {_y} BETWEEN 0 AND 7 AND k % 8 + {_x} BETWEEN 0 AND 7 THEN m2[(k // 8 + {_y}) * 8 + k % 8 + {_x} + 1] ELSE 0 END)"
    _EDGES = _EDGES.replace(f"> {_mark} ", f"> {_inside} ").replace(f">= {_mark} ", f">= {_inside} ")


def _labelled(source: str, diagonal: bool) -> str:
    """Labels of connected true pixels of ``source`` (vec_id, x, mask): the least place in each object, from 1."""
    around = [o for o in square(3) if diagonal or abs(o[0]) + abs(o[1]) < 2]
    step = pixels(f"CASE WHEN mask[k + 1] THEN list_min(list_filter({near('lab', around, 'zero')}, lambda v: v > 0)) ELSE 0 END")
    return f"""lb(vec_id, x, mask, lab, step) AS (SELECT vec_id, x, mask, {pixels('CASE WHEN mask[k + 1] THEN k + 1.0::DOUBLE ELSE 0::DOUBLE END')}, 0 FROM {source}
    UNION ALL SELECT vec_id, x, mask, {step}, step + 1 FROM lb WHERE step < 48),
  px AS MATERIALIZED (SELECT vec_id, p, (p - 1) // 8 AS r, (p - 1) % 8 AS c, lab[p] AS l, x[p] AS v FROM (SELECT vec_id, x, lab, unnest(range(1, 65)) AS p FROM lb WHERE step = 48) WHERE lab[p] > 0)"""


_WITH_EDGES = f"WITH RECURSIVE {_IMAGES}, {_EDGES}, {_labelled('g3', True)}, ob AS MATERIALIZED (SELECT * FROM px WHERE (vec_id, l) IN (SELECT px.vec_id, px.l FROM px JOIN g3 ON g3.vec_id = px.vec_id WHERE g3.strong[px.p]))"
_WITH_BRIGHT = f"WITH RECURSIVE {_IMAGES}, br AS (SELECT vec_id, x, list_transform(x, lambda v: v > 0) AS mask FROM im), {_labelled('br', True)}, ob AS MATERIALIZED (SELECT * FROM px)"
#: Measures of each object, as the kernels define them.
_MEASURES = """inner_ AS (SELECT a.vec_id, a.l, a.p, count(b.p) AS sides FROM ob a LEFT JOIN ob b ON b.vec_id = a.vec_id AND b.l = a.l AND abs(a.r - b.r) + abs(a.c - b.c) = 1 GROUP BY 1, 2, 3),
  lengths AS (SELECT vec_id, l, count_if(sides < 4) AS length FROM inner_ GROUP BY 1, 2),
  sides AS (SELECT a.vec_id, a.l, a.r AS ar, a.c AS ac, b.r AS br, b.c AS bc FROM ob a JOIN ob b ON b.vec_id = a.vec_id AND b.l = a.l AND b.p <> a.p
    WHERE NOT EXISTS (SELECT 1 FROM ob d WHERE d.vec_id = a.vec_id AND d.l = a.l AND ((b.r - a.r) * (d.c - a.c) - (b.c - a.c) * (d.r - a.r) < 0
      OR ((b.r - a.r) * (d.c - a.c) - (b.c - a.c) * (d.r - a.r) = 0 AND ((b.r - a.r) * (d.r - a.r) + (b.c - a.c) * (d.c - a.c) < 0
        OR (b.r - a.r) * (d.r - a.r) + (b.c - a.c) * (d.c - a.c) > (b.r - a.r) * (b.r - a.r) + (b.c - a.c) * (b.c - a.c)))))),
  hulls AS (SELECT vec_id, l, abs(sum(ar * bc - ac * br)) / 2e0 AS hull, avg(ar) AS mr, avg(ac) AS mc FROM sides GROUP BY 1, 2),
  radii AS (SELECT s.vec_id, s.l, max(sqrt(pow(s.ar - h.mr, 2) + pow(s.ac - h.mc, 2))) AS radius FROM sides s JOIN hulls h ON h.vec_id = s.vec_id AND h.l = s.l GROUP BY 1, 2),
  boxes AS (SELECT vec_id, l, count(*) AS n, max(r) - min(r) + 1 AS height, max(c) - min(c) + 1 AS width FROM ob GROUP BY 1, 2),
  ms AS (SELECT b.vec_id, b.l, length, width / CAST(height AS DOUBLE) AS aspect, greatest(n - length / 2e0 - 1, 0) AS area, width * height AS box, coalesce(hull, 0) AS hull, pi() * pow(coalesce(radius, 0), 2) AS circle
    FROM boxes b JOIN lengths ln ON ln.vec_id = b.vec_id AND ln.l = b.l LEFT JOIN hulls h ON h.vec_id = b.vec_id AND h.l = b.l LEFT JOIN radii q ON q.vec_id = b.vec_id AND q.l = b.l)"""
_OF = {
    "area": "area", "length": "length", "aspect": "aspect", "extent": "area / box", "solidity": "coalesce(area / nullif(hull, 0), 0)", "diameter": "sqrt(4 * area / pi())",
    "circle": "circle", "circle_extent": "coalesce(area / nullif(circle, 0), 0)", "convex": "CASE WHEN hull <= area + 0.5 THEN 1 ELSE 0 END",
}


def _drawn(keep: str, start: str = _WITH_EDGES) -> str:
    return f"""{start}, {_MEASURES} SELECT im.vec_id, CAST(g.p - 1 AS INT) AS pos, CASE WHEN o.p IS NULL THEN 0e0 ELSE 255e0 END AS val
      FROM im CROSS JOIN (SELECT unnest(range(1, 65)) AS p) g LEFT JOIN (SELECT ob.vec_id, ob.p FROM ob JOIN ms ON ms.vec_id = ob.vec_id AND ms.l = ob.l WHERE {keep}) o ON o.vec_id = im.vec_id AND o.p = g.p"""


def _between(measure: str, low: float, high: float) -> str:
    bounds = [f"({_OF[measure]}) >= {low!r}::DOUBLE"] * (low > -math.inf) + [f"({_OF[measure]}) <= {high!r}::DOUBLE"] * (high < math.inf)
    return " AND ".join(bounds)


SQL = {
    "op_EdgeDetectionCanny": f"""{_WITH_EDGES} SELECT im.vec_id, CAST(g.p - 1 AS INT) AS pos, CASE WHEN o.p IS NULL THEN 0e0 ELSE 255e0 END AS val
      FROM im CROSS JOIN (SELECT unnest(range(1, 65)) AS p) g LEFT JOIN ob o ON o.vec_id = im.vec_id AND o.p = g.p""",
    "op_ContoursConvexConcave": _drawn(_between("convex", 1, 1)),
    "op_ContourMaskConvex": _drawn(_between("convex", 1, 1)),
    "op_ContoursMinArea": _drawn(_between("area", 10.0, math.inf)),
    "op_ContoursMaxArea": _drawn(_between("area", -math.inf, 10.0)),
    "op_ContoursMinLength": _drawn(_between("length", 10.0, math.inf)),
    "op_ContoursMaxLength": _drawn(_between("length", -math.inf, 10.0), _WITH_BRIGHT),
    "op_ContourMask": _drawn(_between("area", 0.0, math.inf)),
}
for _name, _measure, _bound in (("Area", "area", 10.0), ("Length", "length", 10.0), ("EnclosingCircle", "circle", 10.0), ("ExtentEnclosingCircle", "circle_extent", 0.5), ("AspectRatio", "aspect", 0.5), ("Extent", "extent", 0.5), ("Solidity", "solidity", 0.5), ("EquDiameter", "diameter", 2.0)):
    SQL[f"op_ContourMaskMin{_name}"] = _drawn(_between(_measure, _bound, math.inf))
    SQL[f"op_ContourMaskMax{_name}"] = _drawn(_between(_measure, -math.inf, _bound))
    SQL[f"op_ContourMaskRange{_name}"] = _drawn(_between(_measure, 0.0, _bound))
del SQL["op_ContourMaskRangeArea"]

_CROSS = f"WITH RECURSIVE {_IMAGES}, br AS (SELECT vec_id, x, list_transform(x, lambda v: v > 0) AS mask FROM im), {_labelled('br', False)}"


def _listed(start: str, columns: list[str], rows: str) -> str:
    """Numbers of each object one after the other, objects in the order of their labels."""
    each = " UNION ALL ".join(f"SELECT vec_id, k, {i} AS j, {c} AS val FROM o" for i, c in enumerate(columns))
    return f"""{start}, o AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY l) - 1 AS k FROM ({rows})) SELECT vec_id, CAST({len(columns)} * k + j AS INT) AS pos, round(CAST(val AS DOUBLE), 6) AS val FROM ({each})"""


SQL["op_LabelObjects"] = _listed(_CROSS, ["r", "c"], "SELECT vec_id, l, (min(r) + max(r)) / 2e0 AS r, (min(c) + max(c)) / 2e0 AS c FROM px GROUP BY 1, 2")
SQL["op_LabelByCenterOfMass"] = _listed(
    _CROSS,
    ["mx", "my"],
    "SELECT vec_id, l, sum(w * c) / coalesce(nullif(sum(w), 0), 1) AS mx, sum(w * r) / coalesce(nullif(sum(w), 0), 1) AS my FROM (SELECT px.*, im.x[65 - px.p] AS w FROM px JOIN im ON im.vec_id = px.vec_id) GROUP BY 1, 2",
)
_STARS = f"""WITH RECURSIVE {_IMAGES}, bs AS (SELECT vec_id, list_transform(x, lambda v: v - list_median(x)) AS x, list_stddev_pop(x) AS s FROM im),
  br AS (SELECT vec_id, x, list_transform(x, lambda v: v > s) AS mask FROM bs), {_labelled('br', False)}"""
_CENTRES = "SELECT vec_id, l, sum(v * r) / sum(v) AS r, sum(v * c) / sum(v) AS c FROM px GROUP BY 1, 2"
SQL["op_SEPObjectDetection"] = _listed(_STARS, ["r", "c"], f"{_CENTRES} HAVING sum(v) >= 0")
