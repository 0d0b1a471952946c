"""One query per layer, on the embeddings as rows of 64 samples or images of 8 by 8, with SQL that says the same by sums."""

from __future__ import annotations

from pyspark.sql import functions as F

from arbora.io import table
from arbora.operators import objectives as V
from arbora.plans.network import STEP, TURN, forward, learn_network
from arbora.queries.image_sql import near, square
from arbora.queries.programs import instances

QUERIES: dict = {}
SQL: dict[str, str] = {}
_VECTOR, _SEQUENCE, _IMAGE = None, (64, 1), (8, 8, 1)
_X = "list_transform(embedding, lambda v: CAST(v AS DOUBLE))"


def w(place: str, tensor: int, fan_in: int) -> str:
    """The rule of weights in SQL."""
    return f"(sin({STEP!r}::DOUBLE * ({place} + 1) + {TURN * tensor!r}::DOUBLE) / sqrt({fan_in}))"


def layer(name: str, tree: str, shape, sql: str | None = None, whole: str | None = None) -> None:
    """``sql`` is a list of the layer's output from ``x``; ``whole`` a query giving (vec_id, r)."""

    def run(spark, folder):
        t = table(spark, folder, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("features"))
        return forward(t, tree, "features", shape).select("vec_id", F.posexplode("features").alias("pos", "val")).withColumn("val", F.round("val", 6))

    run.__doc__ = tree
    QUERIES[f"layer_{name}"] = run
    rows = whole or (f"SELECT vec_id, {sql} AS r FROM (SELECT vec_id, {_X} AS x FROM embeddings)" if sql else None)
    if rows:
        SQL[f"layer_{name}"] = f"SELECT vec_id, CAST(q - 1 AS INT) AS pos, round(CAST(r[q] AS DOUBLE), 6) AS val FROM ({rows}), LATERAL (SELECT unnest(range(1, len(r) + 1)) AS q)"


def _dense(x: str, n_in: int, n_out: int, tensor: int) -> str:
    return f"list_transform(range(0, {n_out}), lambda f: list_sum(list_transform(range(0, {n_in}), lambda i: {x}[i + 1] * {w(f'(i * {n_out} + f)', tensor, n_in)})))"


def _conv2(x: str, n_out: int, tensor: int) -> str:
    """A 3 by 3 convolution of one channel, zeros beyond the edges: places, then filters."""
    return f"list_transform(range(0, {64 * n_out}), lambda kf: list_sum(list_transform(range(0, 9), lambda o: ({_at(x, 'kf // ' + str(n_out))})[o + 1] * {w(f'(o * {n_out} + kf % {n_out})', tensor, 9)})))"


def _at(x: str, k: str) -> str:
    return near(x, square(3), "zero").replace("lambda o:", "lambda n:").replace("o.y", "n.y").replace("o.x", "n.x").replace("k // 8", f"({k}) // 8").replace("k % 8", f"({k}) % 8")


def _conv1(x: str, n_out: int, tensor: int) -> str:
    return f"list_transform(range(0, {64 * n_out}), lambda kf: list_sum(list_transform(range(0, 3), lambda o: CASE WHEN kf // {n_out} + o BETWEEN 1 AND 64 THEN {x}[kf // {n_out} + o] ELSE 0 END * {w(f'(o * {n_out} + kf % {n_out})', tensor, 3)})))"


def _pool2(f: str, size: int) -> str:
    return f"list_transform(range(0, 16), lambda k: {f}(list_transform(range(0, 4), lambda o: x[(k // 4 * 2 + o // 2) * 8 + k % 4 * 2 + o % 2 + 1])))"


def _pool1(f: str) -> str:
    return f"list_transform(range(0, 32), lambda k: {f}(x[2 * k + 1:2 * k + 2]))"


def _each(value: str) -> str:
    return f"list_transform(x, lambda v: {value})"


_RELU, _ELU = "greatest(v, 0)", "CASE WHEN v > 0 THEN v ELSE exp(v) - 1 END"
_IN = "InputLayer(ARG0)"
layer("InputLayer", _IN, _VECTOR, "x")
layer("InitLayerList", "InitLayerList(ARG0)", _VECTOR, "x")
layer("PassLayerList", f"PassLayerList({_IN})", _VECTOR, "x")
layer("OutputLayer", f"OutputLayer({_IN})", _VECTOR, "x")
layer("NoSkip", f"NoSkip({_IN})", _VECTOR, "x")
layer("NoPooling", f"NoPooling({_IN})", _VECTOR, "x")
layer("DropoutLayer", f"DropoutLayer(0.5, {_IN})", _VECTOR, "x")
layer("DenseLayer", f"DenseLayer(4, reluAct, {_IN})", _VECTOR, f"list_transform({_dense('x', 64, 4, 1)}, lambda v: {_RELU})")
layer("LinearLayer", f"LinearLayer(4, {_IN})", _VECTOR, _dense("x", 64, 4, 1))
layer("DenseConnection", f"DenseConnection(4, {_IN})", _VECTOR, _dense("x", 64, 4, 1))
layer("ReluLayer", f"ReluLayer({_IN})", _VECTOR, _each(_RELU))
layer("ELUActivationLayer", f"ELUActivationLayer({_IN})", _VECTOR, _each(_ELU))
layer("LeakyReLULayer", f"LeakyReLULayer(0.2, {_IN})", _VECTOR, _each("CASE WHEN v > 0 THEN v ELSE 0.2::DOUBLE * v END"))
layer("Conv2DLayer", f"Conv2DLayer(2, eluAct, {_IN})", _IMAGE, f"list_transform({_conv2('x', 2, 1)}, lambda v: {_ELU})")
layer("ConvLayer", f"ConvLayer(2, {_IN})", _IMAGE, _conv2("x", 2, 1))
layer("Conv2DConnection", f"Conv2DConnection(2, {_IN})", _IMAGE, _conv2("x", 2, 1))
layer("Conv1DLayer", f"Conv1DLayer(2, {_IN})", _SEQUENCE, _conv1("x", 2, 1))
layer("Conv1DConnection", f"Conv1DConnection(2, {_IN})", _SEQUENCE, _conv1("x", 2, 1))
layer("SeparableConv2DLayer", f"SeparableConv2DLayer(2, {_IN})", _IMAGE, whole=f"SELECT vec_id, list_transform(range(0, 128), lambda kf: a[kf // 2 + 1] * {w('(kf % 2)', 2, 1)}) AS r FROM (SELECT vec_id, {_conv2('x', 1, 1)} AS a FROM (SELECT vec_id, {_X} AS x FROM embeddings))")
layer("ResBlock", f"ResBlock(1, {_IN})", _IMAGE, whole=f"SELECT vec_id, list_transform(range(1, 65), lambda k: x[k] + b[k]) AS r FROM (SELECT *, {_conv2('a', 1, 2)} AS b FROM (SELECT vec_id, x, list_transform({_conv2('x', 1, 1)}, lambda v: {_RELU}) AS a FROM (SELECT vec_id, {_X} AS x FROM embeddings)))")
layer("MaxPoolingLayer2D", f"MaxPoolingLayer2D(2, {_IN})", _IMAGE, _pool2("list_max", 2))
layer("MaxPoolingLayer", f"MaxPoolingLayer(2, {_IN})", _IMAGE, _pool2("list_max", 2))
layer("AveragePoolingLayer2D", f"AveragePoolingLayer2D(2, {_IN})", _IMAGE, _pool2("list_avg", 2))
layer("MaxPoolingLayer1D", f"MaxPoolingLayer1D(2, {_IN})", _SEQUENCE, _pool1("list_max"))
layer("AveragePoolingLayer1D", f"AveragePoolingLayer1D(2, {_IN})", _SEQUENCE, _pool1("list_avg"))
layer("GlobalMaxPoolingLayer1D", f"GlobalMaxPoolingLayer1D({_IN})", _SEQUENCE, "[list_max(x)]")
layer("GlobalAveragePoolingLayer1D", f"GlobalAveragePoolingLayer1D({_IN})", _SEQUENCE, "[list_avg(x)]")
layer("GlobalMaxPoolingLayer2D", f"GlobalMaxPoolingLayer2D(ConvLayer(2, {_IN}))", _IMAGE, whole=f"SELECT vec_id, list_transform([0, 1], lambda f: list_max(list_filter(c, lambda v, i: (i - 1) % 2 = f))) AS r FROM (SELECT vec_id, {_conv2('x', 2, 1)} AS c FROM (SELECT vec_id, {_X} AS x FROM embeddings))")
layer("GlobalAveragePoolingLayer2D", f"GlobalAveragePoolingLayer2D(ConvLayer(2, {_IN}))", _IMAGE, whole=f"SELECT vec_id, list_transform([0, 1], lambda f: list_avg(list_filter(c, lambda v, i: (i - 1) % 2 = f))) AS r FROM (SELECT vec_id, {_conv2('x', 2, 1)} AS c FROM (SELECT vec_id, {_X} AS x FROM embeddings))")
layer("FlattenLayer", f"FlattenLayer({_IN})", _IMAGE, "x")
layer("ZeroPadding2DLayer", f"ZeroPadding2DLayer({_IN})", _IMAGE, "list_transform(range(0, 100), lambda k: CASE WHEN k // 10 BETWEEN 1 AND 8 AND k % 10 BETWEEN 1 AND 8 THEN x[(k // 10 - 1) * 8 + k % 10] ELSE 0 END)")
layer("ConcatenateLayer", f"ConcatenateLayer(DenseLayer(2, {_IN}), {_IN})", _VECTOR, f"list_concat({_dense('x', 64, 2, 1)}, x)")
layer("AddLayer", f"AddLayer(DenseLayer(3, {_IN}), DenseLayer(3, {_IN}))", _VECTOR, f"list_transform(range(1, 4), lambda q: ({_dense('x', 64, 3, 1)})[q] + ({_dense('x', 64, 3, 2)})[q])")
layer("EmbeddingLayer", f"EmbeddingLayer(2, 50, {_IN})", _VECTOR, f"list_transform(range(0, 128), lambda q: {w('(CAST(trunc(abs(x[q // 2 + 1])) AS INT) % 50 * 2 + q % 2)', 1, 1)})")
layer("PatchEmbedding", f"PatchEmbedding(2, 4, {_IN})", _IMAGE, f"list_transform(range(0, 8), lambda q: list_sum(list_transform(range(0, 16), lambda o: x[(q // 2 // 2 * 4 + o // 4) * 8 + q // 2 % 2 * 4 + o % 4 + 1] * {w('(o * 2 + q % 2)', 1, 16)})) + {w('q', 2, 2)})")
layer("PatchEmbedding2DInputLayer", "PatchEmbedding2DInputLayer(2, 4, ARG0)", _IMAGE, f"list_transform(range(0, 8), lambda q: list_sum(list_transform(range(0, 16), lambda o: x[(q // 2 // 2 * 4 + o // 4) * 8 + q // 2 % 2 * 4 + o % 4 + 1] * {w('(o * 2 + q % 2)', 1, 16)})) + {w('q', 2, 2)})")
layer("PatchEmbedding1DInputLayer", "PatchEmbedding1DInputLayer(2, 16, ARG0)", _SEQUENCE, f"list_transform(range(0, 8), lambda q: list_sum(list_transform(range(0, 16), lambda o: x[q // 2 * 16 + o + 1] * {w('(o * 2 + q % 2)', 1, 16)})) + {w('q', 2, 2)})")
layer("AttentionLayer", f"AttentionLayer({_IN}, {_IN})", (8, 8), "list_transform(range(0, 64), lambda k: list_sum(list_transform(range(0, 8), lambda j: exp(list_sum(list_transform(range(1, 9), lambda d: x[k // 8 * 8 + d] * x[j * 8 + d]))) * x[j * 8 + k % 8 + 1])) / list_sum(list_transform(range(0, 8), lambda j: exp(list_sum(list_transform(range(1, 9), lambda d: x[k // 8 * 8 + d] * x[j * 8 + d]))))))")
layer("Module", f"DenseLayer(2, mod_1)\nmod_1: DenseLayer(3, tanhAct, {_IN})", _VECTOR, whole=f"SELECT vec_id, {_dense('a', 3, 2, 2)} AS r FROM (SELECT vec_id, list_transform({_dense('x', 64, 3, 1)}, lambda v: (exp(v) - exp(-v)) / (exp(v) + exp(-v))) AS a FROM (SELECT vec_id, {_X} AS x FROM embeddings))")


def _recurrent(gates: int, update: str) -> str:
    """Two units over 64 steps, one step a round of the recursion: state (h0, h1, c0, c1)."""
    wx = [w(str(g * 2 + u), 1, 1) for g in range(gates) for u in range(2)]
    a = [f"x[t + 1] * {wx[i]}" for i in range(2 * gates)]
    u = [f"(h0 * {w(str(i), 2, 2)} + h1 * {w(str(2 * gates + i), 2, 2)})" for i in range(2 * gates)]
    names = ", ".join([*[f"{v} AS a{i}" for i, v in enumerate(a)], *[f"{v} AS u{i}" for i, v in enumerate(u)]])
    return f"""WITH RECURSIVE s(vec_id, x, t, h0, h1, c0, c1) AS (SELECT vec_id, {_X}, 0, 0e0, 0e0, 0e0, 0e0 FROM embeddings
      UNION ALL SELECT vec_id, x, t + 1, {update} FROM (SELECT *, {names} FROM s WHERE t < 64))
      SELECT vec_id, [h0, h1] AS r FROM s WHERE t = 64"""


_SIG, _TANH = "(1 / (1 + exp(-({}))))", "(1 - 2 / (exp(2 * ({})) + 1))"
_CELL = [f"({_SIG.format(f'a{2 + u} + u{2 + u}')} * c{u} + {_SIG.format(f'a{u} + u{u}')} * {_TANH.format(f'a{4 + u} + u{4 + u}')})" for u in (0, 1)]
layer("LSTMLayer", f"LSTMLayer(2, {_IN})", _SEQUENCE, whole=_recurrent(4, ", ".join([f"{_SIG.format(f'a{6 + u} + u{6 + u}')} * {_TANH.format(_CELL[u])}" for u in (0, 1)] + _CELL)))
_Z = [_SIG.format(f"a{u} + u{u}") for u in (0, 1)]
_H = [f"({_Z[u]} * h{u} + (1 - {_Z[u]}) * {_TANH.format(f'a{4 + u} + ' + _SIG.format(f'a{2 + u} + u{2 + u}') + f' * u{4 + u}')})" for u in (0, 1)]
layer("GRULayer", f"GRULayer(2, {_IN})", _SEQUENCE, whole=_recurrent(3, ", ".join([*_H, "0e0", "0e0"])))


def network_learner(spark, folder):
    """NNLearner: a network of two hidden layers with a trained read-out, scored on the test rows."""
    d = instances(spark, folder).withColumn("split", F.when(F.col("row_id") % 5 == 0, "test").otherwise("train"))
    d = d.withColumn("features", F.transform("features", lambda v: v / 100))
    out = learn_network(d, f"DenseLayer(16, tanhAct, DenseLayer(16, tanhAct, {_IN}))")
    return V.evaluate(out.where("split = 'test'").select(F.col("prediction").alias("p"), F.col("target").alias("t")), ["accuracy_score"])


QUERIES["network_learner"] = network_learner
