"""Layer trees executed: a network's forward pass over Arrow batches, and networks learned on top of it.

A tree such as ``DenseLayer(4, reluAct, ConvLayer(2, FlattenLayer(InputLayer(ARG0))))`` is evaluated from the leaves up on
arrays of (rows, *shape), all rows of a batch at once. Numbers among a layer's arguments are sizes in the order of its
signature, names say its activation, normalisation and padding. Weights are those of a table of trained ones, or come
from a fixed rule of position and layer, so that a network gives the same on every executor. Dropout and noise are off,
as after training; batch normalisation has the moments it starts with.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arbora.plans.layers import KINDS, network
from arbora.plans.program import Node

#: The rule of weights: sin(STEP * (place + 1) + TURN * tensor) over the root of the number of inputs.
STEP, TURN = 12.9898, 78.233


def rule_weights(shape: tuple[int, ...], tensor: int, fan_in: int) -> np.ndarray:
    n = math.prod(shape)
    return (np.sin(STEP * (np.arange(n) + 1) + TURN * tensor) / math.sqrt(max(fan_in, 1))).reshape(shape)


def activation(x: np.ndarray, name: str) -> np.ndarray:
    """An activation by what its name contains; names without one leave values as they are."""
    n = name.lower()
    if "leaky" in n:
        return np.where(x > 0, x, 0.01 * x)
    if "selu" in n:
        return 1.0507009873554805 * np.where(x > 0, x, 1.6732632423543772 * np.expm1(np.minimum(x, 0)))
    if "elu" in n and "relu" not in n:
        return np.where(x > 0, x, np.expm1(np.minimum(x, 0)))
    if "relu" in n:
        return np.maximum(x, 0)
    if "softplus" in n:
        return np.logaddexp(0, x)
    if "softmax" in n:
        e = np.exp(x - x.max(axis=-1, keepdims=True))
        return e / e.sum(axis=-1, keepdims=True)
    if "sigmoid" in n:
        return _sigmoid(x)
    return np.tanh(x) if "tanh" in n else x


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -700, 700)))


def normalised(x: np.ndarray, name: str) -> np.ndarray:
    """Layer norm over the last axis, instance norm over the places of each channel; others start as the identity."""
    n = name.lower()
    axes = (-1,) if "layernorm" in n else tuple(range(1, x.ndim - 1)) or (-1,) if "instancenorm" in n else None
    if axes is None:
        return x
    return (x - x.mean(axis=axes, keepdims=True)) / np.sqrt(x.var(axis=axes, keepdims=True) + 1e-3)


class Forward:
    """One evaluation of a tree; ``weights`` maps a tensor's number to a trained array."""

    def __init__(self, modules: dict[str, Node] | None = None, weights: dict[int, np.ndarray] | None = None):
        self.modules, self.weights, self.tensor = modules or {}, weights or {}, 0

    def take(self, shape: tuple[int, ...], fan_in: int) -> np.ndarray:
        self.tensor += 1
        w = self.weights.get(self.tensor)
        return rule_weights(shape, self.tensor, fan_in) if w is None else w.reshape(shape)

    def run(self, node: Node, data: np.ndarray, inside: tuple[str, ...] = ()) -> np.ndarray:
        name = str(node.value).lower()
        if name in inside:
            raise ValueError(f"{name} uses itself")
        if node.args is None:
            return self.run(self.modules[name], data, (*inside, name)) if name in self.modules else data
        below = [self.run(a, data, inside) for a in node.args if a.args is not None or str(a.value).lower() in self.modules]
        if name in self.modules:
            return self.run(self.modules[name], below[-1] if below else data, (*inside, name))
        numbers = [float(a.value) for a in node.args if a.args is None and isinstance(a.value, (int, float)) and not isinstance(a.value, bool)]
        names = [str(a.value) for a in node.args if a.args is None and not isinstance(a.value, (int, float))]
        x = below[-1] if below else data
        out = self.layer(str(node.value), x, below, numbers, names)
        for n in names:
            out = normalised(activation(out, n), n)
        return out

    def layer(self, name: str, x: np.ndarray, below: list, numbers: list, names: list) -> np.ndarray:
        kind, size = KINDS.get(name, "same"), lambda i, d: max(1, int(abs(numbers[i]))) if len(numbers) > i else d
        valid = any("valid" in n.lower() for n in names)
        if name in ("ReluLayer", "ELUActivationLayer"):
            return activation(x, name)
        if name == "LeakyReLULayer":
            return np.where(x > 0, x, (numbers[0] if numbers else 0.01) * x)
        if name == "AddLayer":
            return sum(below[1:], below[0]) if below and all(b.shape == below[0].shape for b in below) else x
        if name == "AttentionLayer":
            return self.attention(below[0], below[-1]) if len(below) > 1 else self.attention(x, x)
        if name in ("ResBlock", "ResidualBlock"):
            y = activation(self.conv(x, size(0, x.shape[-1]), size(1, 3), 1, False), "relu")
            y = self.conv(y, x.shape[-1], size(1, 3), 1, False)
            return x + y
        if name == "PatchEmbedding" or name.startswith("PatchEmbedding"):
            return self.patches(x, size(0, 8), size(1, 2))
        if kind == "dense":
            return x @ self.take((x.shape[-1], size(0, 8)), x.shape[-1])
        if kind == "embed":
            table = self.take((size(1, 10_000), size(0, 8)), 1)
            return table[np.abs(x).astype(int) % len(table)]
        if kind == "conv":
            one = "1D" in name or x.ndim == 3
            if "Separable" in name:
                return self.separable(x, size(0, 8), size(1, 3), size(2, 1), valid)
            return self.conv(x if x.ndim > 2 else x[..., None], size(0, 8), size(1, 3), size(2, 1), valid, one)
        if kind == "pool":
            return self.pool(x, size(0, 2), size(1, size(0, 2)), "Average" in name)
        if kind == "global":
            axes = tuple(range(1, x.ndim - 1))
            return (x.mean(axis=axes) if "Average" in name else x.max(axis=axes)) if axes else x
        if kind == "flat":
            return x.reshape(len(x), -1)
        if kind == "pad":
            return np.pad(x, ((0, 0), *[(1, 1)] * (x.ndim - 2), (0, 0)))
        if kind in ("lstm", "gru"):
            return self.recurrent(x if x.ndim == 3 else x.reshape(len(x), -1, 1), size(0, 8), kind, any(n.lower() == "true" or "seq" in n.lower() for n in names))
        if kind == "concat":
            same = below and all(b.shape[:-1] == below[0].shape[:-1] for b in below)
            return np.concatenate(below, axis=-1) if same else np.concatenate([b.reshape(len(b), -1) for b in below], axis=1) if below else x
        return x

    def conv(self, x, out: int, k: int, stride: int, valid: bool, one: bool | None = None) -> np.ndarray:
        dims = x.ndim - 2
        w = self.take((k,) * dims + (x.shape[-1], out), k**dims * x.shape[-1])
        win = _windows(x, k, stride, valid, 0.0)  # (rows, *places, channels, *window)
        return np.einsum("nlci,ico->nlo", win, w) if dims == 1 else np.einsum("nhwcij,ijco->nhwo", win, w)

    def separable(self, x, out: int, k: int, stride: int, valid: bool) -> np.ndarray:
        win = _windows(x, k, stride, valid, 0.0)
        each = np.einsum("nhwcij,ijc->nhwc", win, self.take((k, k, x.shape[-1]), k * k))
        return each @ self.take((x.shape[-1], out), x.shape[-1])

    def pool(self, x, k: int, stride: int, mean: bool) -> np.ndarray:
        if x.ndim < 3:
            x = x[..., None]
        axes = tuple(range(x.ndim, 2 * x.ndim - 2))
        if not mean:
            return _windows(x, k, stride, False, -np.inf).max(axis=axes)
        return _windows(x, k, stride, False, 0.0).sum(axis=axes) / _windows(np.ones_like(x), k, stride, False, 0.0).sum(axis=axes)

    def patches(self, x, out: int, p: int) -> np.ndarray:
        """Patches flattened and embedded, with a rule of position added: (rows, patches, out)."""
        if x.ndim == 3:
            n = x.shape[1] // p
            flat = x[:, : n * p].reshape(len(x), n, p * x.shape[2])
        else:
            h, w = x.shape[1] // p, x.shape[2] // p
            flat = x[:, : h * p, : w * p].reshape(len(x), h, p, w, p, x.shape[3]).transpose(0, 1, 3, 2, 4, 5).reshape(len(x), h * w, -1)
        return flat @ self.take((flat.shape[-1], out), flat.shape[-1]) + self.take((flat.shape[1], out), out)

    def attention(self, q, v) -> np.ndarray:
        q, v = (a if a.ndim == 3 else a.reshape(len(a), -1, 1) for a in (q, v))
        return activation(q @ v.transpose(0, 2, 1), "softmax") @ v

    def recurrent(self, x, units: int, kind: str, sequence: bool) -> np.ndarray:
        gates = 4 if kind == "lstm" else 3
        wx, wh = self.take((x.shape[-1], gates * units), x.shape[-1]), self.take((units, gates * units), units)
        h = np.zeros((len(x), units))
        c, every = np.zeros_like(h), []
        for t in range(x.shape[1]):
            a = x[:, t] @ wx
            if kind == "lstm":
                i, f, g, o = np.split(a + h @ wh, 4, axis=1)
                c = _sigmoid(f) * c + _sigmoid(i) * np.tanh(g)
                h = _sigmoid(o) * np.tanh(c)
            else:
                u = h @ wh
                z, r = _sigmoid(a[:, :units] + u[:, :units]), _sigmoid(a[:, units : 2 * units] + u[:, units : 2 * units])
                h = z * h + (1 - z) * np.tanh(a[:, 2 * units :] + r * u[:, 2 * units :])
            every.append(h)
        return np.stack(every, axis=1) if sequence else h


def _windows(x, k: int, stride: int, valid: bool, fill: float) -> np.ndarray:
    """Windows of k in every place dimension, 'same' unless ``valid``, every ``stride`` places."""
    axes = tuple(range(1, x.ndim - 1))
    if not valid:
        pads = []
        for a in axes:
            total = max((-(-x.shape[a] // stride) - 1) * stride + k - x.shape[a], 0)
            pads.append((total // 2, total - total // 2))
        x = np.pad(x, ((0, 0), *pads, (0, 0)), constant_values=fill)
    win = sliding_window_view(x, (k,) * len(axes), axis=axes)
    return win[(slice(None), *[slice(None, None, stride)] * len(axes))]


def forward(df: DataFrame, tree: str, column: str = "features", shape: tuple[int, ...] | None = None, output: str = "features", weights: dict[int, np.ndarray] | None = None) -> DataFrame:
    """``df`` with ``output``: what the network makes of each row's array ``column``, flattened.

    ``shape`` is that of one row's data, (length, channels) or (height, width, channels); the default is a vector. Rows
    whose array is NULL or of another size give NULL. Weights are broadcast: a few arrays whose size the tree bounds.
    """
    main, modules = network(tree)
    shared = df.sparkSession.sparkContext.broadcast(weights or {})
    rest = [c for c in df.columns if c != output]
    schema = T.StructType([*[df.schema[c] for c in rest], T.StructField(output, T.ArrayType(T.DoubleType()))])
    at, keep = df.columns.index(column), [df.columns.index(c) for c in rest]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = [None if v is None else np.asarray(v, float) for v in b.column(at).to_numpy(zero_copy_only=False)]
            out: list = [None] * b.num_rows
            groups: dict[int, list[int]] = {}
            for r, v in enumerate(values):
                if v is not None and len(v) and (shape is None or len(v) == math.prod(shape)):
                    groups.setdefault(len(v), []).append(r)
            for n, rows in groups.items():
                x = np.stack([values[r] for r in rows]).reshape(len(rows), *(shape or (n,)))
                result = Forward(modules, shared.value).run(main, x).reshape(len(rows), -1)
                for r, v in zip(rows, result):
                    out[r] = v
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in keep], pa.array(out, pa.list_(pa.float64()))], names=[f"c{i}" for i in range(len(keep) + 1)])

    return df.mapInArrow(run, schema)


def learn_network(df: DataFrame, tree: str, shape: tuple[int, ...] | None = None, learner: str = "LOGR", **params) -> DataFrame:
    """A network as a learner: its layers with the weights of the rule make the features, and the layer that reads them out
    is trained on the train split (``LOGR`` for classes, ``LINEAR_REGRESSION`` for numbers). Rows (row_id, split, features,
    target) get ``prediction``; their own features are kept with the prediction appended, as learners do."""
    from arbora.operators.learners import learn

    deep = forward(df, tree, "features", shape, "__deep").withColumn("__raw", F.col("features")).withColumn("features", F.col("__deep")).drop("__deep")
    out = learn(deep, learner, params)
    return out.withColumn("features", F.concat("__raw", F.array("prediction"))).drop("__raw")
