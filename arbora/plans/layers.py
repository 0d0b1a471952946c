"""Network layers as a typed plan: shapes are inferred and parameters counted without building a network."""

from __future__ import annotations

import math
import re

from arbora.plans.program import Node, parse

_DEFINITION = re.compile(r"(?:^|[\r\n])[ \t]*(mod_\w+)[ \t]*:", re.IGNORECASE)

#: Kind of shape rule of each layer, by name.
KINDS = {
    "InputLayer": "input", "StreamInput": "input", "ImagePatchInput": "input", "WordTableLayer": "input", "EmbeddingLayer": "embed", "DenseLayer": "dense", "LinearLayer": "dense", "OutputLayer": "same", "PassLayer": "same", "PassLayerList": "same", "DropLayer": "same",
    "DropoutLayer": "same", "NormLayer": "norm", "ReluLayer": "same", "ELUActivationLayer": "same", "LeakyReLULayer": "same", "NoiseLayer": "same", "Conv1DLayer": "conv", "ConvLayer1D": "conv", "Conv2DLayer": "conv", "ConvLayer": "conv", "SeparableConv2DLayer": "conv", "SeparableConvLayer": "conv",
    "MaxPoolLayer": "pool", "MaxPoolingLayer": "pool", "MaxPoolingLayer1D": "pool", "MaxPoolingLayer2D": "pool", "AveragePoolLayer": "pool", "AveragePoolingLayer1D": "pool", "AveragePoolingLayer2D": "pool", "GlobalMaxLayer": "global", "GlobalMaxPoolingLayer1D": "global", "GlobalMaxPoolingLayer2D": "global",
    "GlobalAverageLayer": "global", "GlobalAveragePoolingLayer1D": "global", "GlobalAveragePoolingLayer2D": "global", "FlattenLayer": "flat", "ZeroPadLayer": "pad", "ZeroPadding2DLayer": "pad", "LSTMLayer": "lstm", "LstmLayer": "lstm", "GRULayer": "gru", "GruLayer": "gru", "ConcatLayer": "concat", "ConcatenateLayer": "concat",
    "AddLayer": "same", "ResBlock": "conv", "ResidualBlock": "conv", "AttentionLayer": "same", "InitLayerList": "input", "NoSkip": "same", "NoPooling": "same", "DenseConnection": "dense", "Conv1DConnection": "conv", "Conv2DConnection": "conv", "PatchEmbedding": "patch", "PatchEmbedding1DInputLayer": "patch", "PatchEmbedding2DInputLayer": "patch", "Module": "same",
}


def network(text: str) -> tuple[Node, dict[str, Node]]:
    """The tree of a stored network and the modules its ``mod_N: ...`` definitions give, each over one line or several."""
    main, *rest = _DEFINITION.split(text)
    return parse(main), {name.lower(): parse(tree) for name, tree in zip(rest[::2], rest[1::2])}


def infer(node: Node, data_shape: tuple[int, ...], modules: dict[str, Node] | None = None, inside: tuple[str, ...] = ()) -> tuple[tuple[int, ...], int]:
    """(output shape, number of parameters) of a layer tree. Unknown layers keep the shape and have no parameters, and so
    do names of modules that ``modules`` lacks. Each use of a module counts, a module called with arguments is applied to
    the last of them, and one that uses itself is an error. ``inside`` has the modules around the tree."""
    modules = modules or {}
    name = str(node.value).lower()
    if name in inside:
        raise ValueError(f"{name} uses itself")
    if node.args is None:
        return infer(modules[name], data_shape, modules, (*inside, name)) if name in modules else (data_shape, 0)
    kind = KINDS.get(str(node.value), "same")
    sizes = [int(abs(a.value)) for a in node.args if isinstance(a.value, (int, float)) and not isinstance(a.value, bool)]
    size = max(1, sizes[0]) if sizes else 8
    below = [infer(a, data_shape, modules, inside) for a in node.args if a.args is not None or str(a.value).lower() in modules]
    if name in modules:
        shape, params = infer(modules[name], below[-1][0] if below else data_shape, modules, (*inside, name))
        return shape, params + sum(p for _, p in below)
    shape, params = below[-1] if below else (data_shape, 0)
    params = sum(p for _, p in below)
    last = shape[-1] if shape else 1
    if kind == "dense":
        return (*shape[:-1], size), params + (last + 1) * size
    at = lambda i, d: max(1, sizes[i]) if len(sizes) > i else d
    valid = any("valid" in str(a.value).lower() for a in node.args if a.args is None)
    if kind == "embed":
        return (*shape, size), params + at(1, 10_000) * size
    if kind == "conv":
        flat = shape if len(shape) > 1 else (*shape, 1)
        last, rank, k, stride = flat[-1], len(flat) - 1, at(1, 3), at(2, 1)
        if name in ("resblock", "residualblock"):
            return shape, params + (k**rank * last + 1) * size + (k**rank * size + 1) * last
        places = tuple(max(1, -(-(s - k + 1) // stride)) if valid else -(-s // stride) for s in flat[:-1])
        if "separable" in name:
            return (*places, size), params + k**rank * last + (last + 1) * size
        return (*places, size), params + (k**rank * last + 1) * size
    if kind == "patch":
        p = at(1, 2)
        n = math.prod(s // p for s in shape[:-1])
        return (n, size), params + (p ** (len(shape) - 1) * last + 1) * size + n * size
    if kind == "pool":
        flat, stride = shape if len(shape) > 1 else (*shape, 1), at(1, at(0, 2))
        return tuple(max(1, -(-s // stride)) for s in flat[:-1]) + flat[-1:], params
    if kind == "global":
        return (last,), params
    if kind == "flat":
        return (math.prod(shape),), params
    if kind == "pad":
        return tuple(s + 2 for s in shape[:-1]) + shape[-1:], params
    if kind == "norm":
        return shape, params + 2 * last
    if kind in ("lstm", "gru"):
        gates = 4 if kind == "lstm" else 3
        return (size,), params + gates * size * (last + size + 1)
    if kind == "concat":
        return (sum(math.prod(s) for s, _ in below) or last,), params
    return shape, params
