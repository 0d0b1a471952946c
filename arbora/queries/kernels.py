"""One query per numpy kernel, on the embeddings as rows of 64 samples or as images of 8 by 8."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.functions.registry import OPS, Op
from arbora.operators.dataset import run_kernel
from arbora.queries.contour_sql import SQL as CONTOUR_SQL
from arbora.queries.image_sql import SQL as IMAGE_SQL
from arbora.queries.signal_sql import SQL as SIGNAL_SQL
from arbora.queries.vectors import rows


#: Decimal places, where 6 would cut values that are whole multiples of a smaller fraction in half.
_PLACES = {"ConvolveChannelMerge": 8}


def _query(op: Op):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        r = rows(spark, folder, op.image)
        if op.inputs == 4:
            r = r.withColumn("u", F.expr("concat(slice(y, 2, size(y)), slice(y, 1, 1))"))
        out = run_kernel(r, op, ["x", "y", "z", "u"][: op.inputs], "out", op.params)
        return out.select("vec_id", F.posexplode("out").alias("pos", "val")).select("vec_id", "pos", F.round("val", _PLACES.get(op.name, 6)).alias("val"))

    run.__doc__ = f"{op.name}: {op.doc}"
    return run


_KERNELS = [op for op in OPS.values() if op.kernel]
_key = {op.name: "op_" + re.sub(r"\W", "_", op.name) for op in _KERNELS}
QUERIES = {_key[op.name]: _query(op) for op in _KERNELS}

# SQL for the kernels that lists can express
_X = "list_transform(embedding, lambda v: CAST(v AS DOUBLE))"
_B = "list_transform(embedding, lambda v: CAST(CAST(floor(abs(CAST(v AS DOUBLE)) * 997) AS BIGINT) % 256 AS DOUBLE))"


def _sql(expr: str, image: bool) -> str:
    return f"""WITH a AS (SELECT vec_id, {_B if image else _X} AS x FROM embeddings), c AS (SELECT vec_id, {expr} AS r FROM a)
      SELECT vec_id, CAST(p - 1 AS INT) AS pos, round(CAST(r[p] AS DOUBLE), 6) AS val FROM c, LATERAL (SELECT unnest(range(1, len(r) + 1)) AS p)"""


def _around(x: str, near: str, agg: str) -> str:
    return f"list_transform(range(0, 64), lambda k: {agg}(list_transform(list_filter(range(0, 64), lambda j: {near}), lambda j: {x}[j + 1])))"


_NEAR = {"Rect": "abs(j // 8 - k // 8) <= 1 AND abs(j % 8 - k % 8) <= 1", "Cross": "abs(j // 8 - k // 8) + abs(j % 8 - k % 8) <= 1"}


def _morph(kind: str, near: str) -> str:
    lo, hi = (lambda x: _around(x, near, "list_min")), (lambda x: _around(x, near, "list_max"))
    less = lambda a, b: f"list_transform(range(1, 65), lambda j: ({a})[j] - ({b})[j])"
    return {"Erosion": lo("x"), "Dilate": hi("x"), "Gradient": less("hi", "lo"), "Open": "op", "Close": "cl", "Tophat": less("x", "op"), "Blackhat": less("cl", "x")}[kind]


def _morph_sql(kind: str, near: str) -> str:
    a = f"SELECT vec_id, {_B} AS x FROM embeddings"
    b = f"SELECT vec_id, x, {_around('x', near, 'list_min')} AS lo, {_around('x', near, 'list_max')} AS hi FROM ({a})"
    c = f"SELECT *, {_around('lo', near, 'list_max')} AS op, {_around('hi', near, 'list_min')} AS cl FROM ({b})"
    return f"""WITH c AS (SELECT vec_id, {_morph(kind, near)} AS r FROM ({c}))
      SELECT vec_id, CAST(p - 1 AS INT) AS pos, round(CAST(r[p] AS DOUBLE), 6) AS val FROM c, LATERAL (SELECT unnest(range(1, len(r) + 1)) AS p)"""


_PI = "pi()"
SQL = {
    "op_MyCumSum": _sql("list_transform(x, lambda v, i: list_sum(x[1:i]))", False),
    "op_MyCumProd": _sql("list_transform(x, lambda v, i: list_product(x[1:i]))", False),
    "op_FFT": _sql(f"list_transform(range(0, 64), lambda k: sqrt(pow(list_sum(list_transform(x, lambda v, i: v * cos(2 * {_PI} * k * (i - 1) / 64))), 2) + pow(list_sum(list_transform(x, lambda v, i: v * sin(2 * {_PI} * k * (i - 1) / 64))), 2)))", False),
    "op_MyDCT": _sql(f"list_transform(range(0, 64), lambda k: CASE WHEN k = 0 THEN sqrt(1.0 / 64) ELSE sqrt(2.0 / 64) END * list_sum(list_transform(x, lambda v, i: v * cos({_PI} * (2 * i - 1) * k / 128))))", False),
    "op_KalmanFilter": None,
    "op_LowpassFourierShift": _sql("list_transform(range(0, 64), lambda k: x[((k // 8 + 5) % 8) * 8 + (k % 8 + 5) % 8 + 1])", True),
    "op_HighpassFourierShift": _sql("list_transform(range(0, 64), lambda k: x[k + 1] - x[((k // 8 + 5) % 8) * 8 + (k % 8 + 5) % 8 + 1])", True),
    "op_BackgroundSubtraction": _sql("list_transform(range(0, 64), lambda k: x[k + 1] - list_median(list_transform(list_filter(range(0, 64), lambda j: (j // 8) // 4 = (k // 8) // 4 AND (j % 8) // 4 = (k % 8) // 4), lambda j: x[j + 1])))", True),
    "op_Cv2DFTReal": _sql(f"list_transform(range(0, 64), lambda k: list_sum(list_transform(x, lambda v, i: v * cos(2 * {_PI} * ((k // 8) * ((i - 1) // 8) + (k % 8) * ((i - 1) % 8)) / 8))))", True),
    "op_MinimumFilter": _sql(f"list_transform(range(0, 64), lambda k: CASE WHEN x[k + 1] < 0.3 AND x[k + 1] = ({_around('x', _NEAR['Rect'], 'list_min')})[k + 1] THEN 1 ELSE 0 END)", True),
}
SQL = {k: s for k, s in SQL.items() if s}
for _kind in ("Erosion", "Dilate", "Open", "Close", "Gradient", "Tophat", "Blackhat"):
    for _shape, _near in _NEAR.items():
        SQL[f"op_Morph{_kind}{_shape}"] = _morph_sql(_kind, _near)
# A 3 by 3 ellipse is a cross.
SQL |= {f"op_Morph{_kind}Ellipse": SQL[f"op_Morph{_kind}Cross"] for _kind in ("Erosion", "Dilate", "Open", "Close", "Gradient", "Tophat", "Blackhat")}
SQL |= IMAGE_SQL | CONTOUR_SQL | SIGNAL_SQL
