"""The operator registry: every dataset operator by name, with its parameters and its way of running.

A *native* operator is one Spark SQL expression over array columns, so a chain of them stays one projection in the
JVM. A *kernel* is a numpy function of one row's arrays, run on Arrow batches where Spark has no built-in equivalent.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Op:
    name: str
    inputs: int
    params: dict = field(default_factory=dict)
    native: Callable[..., str] | None = None  # (input texts, params) -> Spark SQL text
    ansi: Callable[..., str] | None = None  # the same for the SQL check
    kernel: Callable | None = None  # numpy: (arrays, **params) -> array
    image: bool = False  # works on a row-major square image rather than a vector
    doc: str = ""
    fit: Callable | None = None  # numpy: (array, points or None, **params) -> a row of addends per row; their sums over
    # all rows reach the kernel as ``fitted``, so that no row's result depends on which rows share its batch

    def fill(self, args: tuple) -> dict:
        """Parameters by position over the defaults."""
        return {**self.params, **dict(zip(self.params, args))}


OPS: dict[str, Op] = {}


def register(op: Op) -> Op:
    """Add an operator; this is also the way for plug-ins to bring their own."""
    OPS[op.name] = op
    return op


def find(name: str) -> Op:
    """An operator by name. Names with a vendor's prefix before ``Data`` are found without it."""
    if name in OPS:
        return OPS[name]
    at = name.find("Data")
    if at > 0 and name[at:] in OPS:
        return OPS[name[at:]]
    raise KeyError(f"no operator {name!r}")
