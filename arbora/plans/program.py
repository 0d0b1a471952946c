"""Programs: strings such as ``MyAverager(Sine(ARG0), FEATURES_TO_FEATURES, 5)`` parsed and run as lazy DataFrames."""

from __future__ import annotations

import ast
import hashlib
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.functions.registry import find
from arbora.operators import dataset as D
from arbora.operators.features import FIT_NAMES, fit_transform
from arbora.operators.learners import learn

_TOKEN = re.compile(r"""\s*(?:(?P<name>[A-Za-z_][\w.<>&\-]*)|(?P<num>-?\d+(?:\.\d*)?(?:[eE][+-]?\d+)?)|(?P<str>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<map>\{[^{}]*\})|(?P<mark>[(),]))""")


@dataclass(frozen=True)
class Node:
    """A call (``args`` is a tuple) or a leaf (``args`` is None); ``value`` is the name or constant."""

    value: object
    args: tuple | None = None

    def __str__(self) -> str:
        if self.args is None:
            return self.value if isinstance(self.value, str) else repr(self.value)
        return f"{self.value}({', '.join(map(str, self.args))})"

    @property
    def nodes(self) -> list[Node]:
        return [self, *[n for a in self.args or () for n in a.nodes]]

    @property
    def height(self) -> int:
        return 1 + max((a.height for a in self.args), default=0) if self.args else 0


def parse(text: str) -> Node:
    """The tree of a program. Malformed text is an error that names the place."""
    tokens, at = [], 0
    text = text.strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m or m.end() == at:
            raise ValueError(f"cannot read the program at {at}: {text[at:at + 20]!r}")
        tokens.append((m.lastgroup, m[m.lastgroup], m.start(m.lastgroup)))
        at = m.end()
    pos = 0

    def expression() -> Node:
        nonlocal pos
        if pos >= len(tokens):
            raise ValueError("the program ends too early")
        kind, value, place = tokens[pos]
        pos += 1
        if kind == "num":
            return Node(float(value) if re.search(r"[.eE]", value) else int(value))
        if kind in ("str", "map"):
            return Node(ast.literal_eval(value) if kind == "map" else value)
        if kind == "mark":
            raise ValueError(f"unexpected {value!r} at {place}")
        if pos < len(tokens) and tokens[pos][1] == "(" and tokens[pos][0] == "mark":
            pos += 1
            args = []
            while not (pos < len(tokens) and tokens[pos][0] == "mark" and tokens[pos][1] == ")"):
                args.append(expression())
                if pos < len(tokens) and tokens[pos][1] == ",":
                    pos += 1
                elif pos >= len(tokens):
                    raise ValueError("a parenthesis is not closed")
            pos += 1
            return Node(value, tuple(args))
        return Node(value)

    out = expression()
    if pos != len(tokens):
        raise ValueError(f"text after the program at {tokens[pos][2]}")
    return out


def program_hash(node: Node) -> str:
    """SHA-256 of the canonical text."""
    return hashlib.sha256(str(node).encode()).hexdigest()


def run(program: str | Node, data: DataFrame, modules: dict[str, str] | None = None) -> DataFrame:
    """The program on a dataset (row_id, split, fold, features, stream, target). Equal subtrees are built once; the result
    is lazy, and native operators in a row become one projection."""
    tree = parse(program) if isinstance(program, str) else program
    known: dict[str, DataFrame] = {}

    def build(n: Node) -> DataFrame:
        if (k := str(n)) in known:
            return known[k]
        known[k] = out = _call(n)
        return out

    def _call(n: Node) -> DataFrame:
        if n.args is None:
            if str(n.value).startswith("ARG"):
                return data
            if modules and n.value in modules:
                return build(parse(modules[n.value]))
            raise ValueError(f"{n.value!r} is no dataset")
        inputs = [a for a in n.args if a.args is not None and a.value not in ("LearnerType", "EnsembleType") or str(a.value).startswith(("ARG", "mod_"))]
        mode = next((str(a.value).split(".")[-1] for a in n.args if str(a.value).split(".")[-1] in (D.F2F, D.S2S, D.S2F)), D.F2F)
        mode = next((m for a in n.args for w, m in (("FEATURES", D.F2F), ("STREAM", D.S2S), ("STREAM_TO_FEATURES", D.S2F)) if a.value == w), mode)
        rest = [a for a in n.args if a not in inputs]
        numbers = [{"trueBool": True, "falseBool": False}.get(a.value, a.value) for a in rest if isinstance(a.value, (int, float)) or a.value in ("trueBool", "falseBool")]
        if n.value == "Learner":
            kind = next(a for a in rest if a.value == "LearnerType")
            name = str(kind.args[0].value).strip("'\"")
            params = next((a.value for a in kind.args if isinstance(a.value, dict)), {})
            ens = next((str(a.args[0].value).strip("'\"") for a in rest if a.value == "EnsembleType"), "SINGLE")
            return learn(build(inputs[0]), name, params, ens)
        if n.value == "myIfThenElse":
            return D.if_then_else(*[build(a) for a in inputs[:3]], int(numbers[0]) if numbers else 0, mode)
        if n.value == "CopyStreamToTarget":
            return D.copy_stream_to_target(build(inputs[0]))
        if n.value == "FilterCentroids":
            return D.filter_centroids(build(inputs[0]))
        if n.value in FIT_NAMES:
            return fit_transform(build(inputs[0]), n.value, *numbers)
        op = find(str(n.value))
        return D.apply(op.name, [build(a) for a in inputs[: op.inputs]], mode, *numbers)

    return build(tree)


def folds(df: DataFrame, n: int = 5) -> DataFrame:
    """A dataset on all folds at once: each row is test in the fold its id hashes to and train in the others."""
    own = F.pmod(F.xxhash64("row_id"), F.lit(n)).cast("int")
    each = df.withColumn("__own", own).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return each.withColumn("split", F.when(F.col("fold") == F.col("__own"), "test").otherwise("train")).drop("__own")


def flagged(df: DataFrame) -> DataFrame:
    """Adds ``ok``: false where the features hold a value that is not finite, which fails the whole program."""
    return df.withColumn("ok", F.coalesce(D.finite("features"), F.lit(False)))
