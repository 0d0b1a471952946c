"""One query per native array operator, on the embeddings as rows of 64 values, and its SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import arbora.functions.vector  # noqa: F401 - registers the operators
from arbora.functions.registry import OPS, Op
from arbora.io import table

#: Operators on 8-bit images get whole numbers from 0 to 255.
_BYTES = {"Cv2Sqrt", "Cv2Log", "CenterOfMass", "ConvertBW", "ConvertToCounts", "ScalarAdd", "ScalarSubtract", "ScalarMultiply", "ScalarDivide", "Cv2ScaleAbs", "BitwiseNOT", "AdjustConstrastGamma", "AdjustConstrastLog", "BitwiseAnd", "BitwiseOr", "BitwiseXOr", "Cv2Add", "Cv2AddWeighted", "Cv2Subtract", "Cv2Multiply", "Cv2Divide", "SubtractSaturate", "InRange", "ToUint8Scale", "LocalPoolingMean", "LocalPoolingMax", "LocalPoolingMedian", "Log", "MySnapshot"}


def _is_bytes(op: Op) -> bool:
    return op.name in _BYTES or op.name.startswith("Threshold")


def _name(op: Op) -> str:
    return "op_" + re.sub(r"\W", "_", op.name.replace(">", "Gt").replace("<", "Lt"))


def rows(spark: SparkSession, folder: str, as_bytes: bool = False) -> DataFrame:
    """(vec_id, x, y, z): the embedding, its reverse, and a rotation by one."""
    x = "transform(embedding, v -> CAST(v AS DOUBLE))"
    if as_bytes:
        x = "transform(embedding, v -> CAST(pmod(CAST(floor(abs(CAST(v AS DOUBLE)) * 997) AS BIGINT), 256) AS DOUBLE))"
    t = table(spark, folder, "embeddings").select("vec_id", F.expr(x).alias("x"))
    return t.select("vec_id", "x", F.expr("reverse(x)").alias("y"), F.expr("concat(slice(x, 2, size(x)), slice(x, 1, 1))").alias("z"))


def _query(op: Op):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        out = op.native(["x", "y", "z"][: op.inputs], op.params)
        r = rows(spark, folder, _is_bytes(op)).select("vec_id", F.posexplode(F.expr(out)).alias("pos", "val"))
        return r.select("vec_id", "pos", F.round("val", 6).alias("val"))

    run.__doc__ = f"{op.name}: {op.doc}"
    return run


def _sql(op: Op) -> str:
    x = "list_transform(embedding, lambda v: CAST(v AS DOUBLE))"
    if _is_bytes(op):
        x = "list_transform(embedding, lambda v: CAST(CAST(floor(abs(CAST(v AS DOUBLE)) * 997) AS BIGINT) % 256 AS DOUBLE))"
    out = op.ansi(["x", "y", "z"][: op.inputs], op.params)
    return f"""WITH a AS (SELECT vec_id, {x} AS x FROM embeddings),
      b AS (SELECT vec_id, x, list_reverse(x) AS y, list_concat(x[2:], x[1:1]) AS z FROM a),
      c AS (SELECT vec_id, {out} AS r FROM b)
      SELECT vec_id, CAST(p - 1 AS INT) AS pos, round(CAST(r[p] AS DOUBLE), 6) AS val FROM c, LATERAL (SELECT unnest(range(1, len(r) + 1)) AS p)"""


def _wide(op: Op):
    """The same rows as images of 4 by 16 (or 2 by 4 by 8 cells)."""
    shape = {"rows": 4, "cols": 8} if "rows" in op.params else {"width": 16}
    return Op(op.name, op.inputs, {**op.params, **shape}, op.native, op.ansi, doc=op.doc)


_NATIVE = [op for op in OPS.values() if op.native]
QUERIES = {_name(op): _query(op) for op in _NATIVE}
_WIDE = [_wide(op) for op in _NATIVE if {"width", "rows"} & set(op.params)]
QUERIES |= {_name(op) + "_wide": _query(op) for op in _WIDE}
SQL = {_name(op) + "_wide": _sql(op) for op in _WIDE} | {_name(op): _sql(op) for op in _NATIVE if op.ansi}
