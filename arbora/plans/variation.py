"""Variation of program trees on the driver, all seeded: crossover, mutation, layers added, removed and swapped."""

from __future__ import annotations

import random

from arbora.plans.program import Node


def places(tree: Node, at: tuple = ()) -> list[tuple]:
    """Paths to all nodes, the root first."""
    return [at, *[p for i, a in enumerate(tree.args or ()) for p in places(a, (*at, i))]]


def get(tree: Node, at: tuple) -> Node:
    for i in at:
        tree = tree.args[i]
    return tree


def put(tree: Node, at: tuple, new: Node) -> Node:
    if not at:
        return new
    args = list(tree.args)
    args[at[0]] = put(args[at[0]], at[1:], new)
    return Node(tree.value, tuple(args))


def kind(n: Node) -> str:
    """What may stand in for what: calls for calls, numbers for numbers of one type, other leaves for each other."""
    return "call" if n.args is not None else type(n.value).__name__


def crossover(a: Node, b: Node, seed: int, whole: bool = True) -> tuple[Node, Node]:
    """Exchange of subtrees of one kind. ``whole`` false exchanges only middles: the first data argument stays."""
    r = random.Random(seed)
    pa = [p for p in places(a) if p and kind(get(a, p)) == "call"] or [p for p in places(a) if p]
    r.shuffle(pa)
    for p in pa:
        fit = [q for q in places(b) if q and kind(get(b, q)) == kind(get(a, p))]
        if fit:
            q = r.choice(fit)
            x, y = get(a, p), get(b, q)
            if not whole and x.args and y.args:
                x, y = Node(x.value, (y.args[0], *x.args[1:])), Node(y.value, (x.args[0], *y.args[1:]))
            return put(a, p, y), put(b, q, x)
    return a, b


def swap_constants(a: Node, b: Node, seed: int) -> tuple[Node, Node]:
    r = random.Random(seed)
    for t in ("int", "float"):
        pa, pb = ([p for p in places(x) if kind(get(x, p)) == t] for x in (a, b))
        if pa and pb:
            p, q = r.choice(pa), r.choice(pb)
            return put(a, p, get(b, q)), put(b, q, get(a, p))
    return a, b


def mutate_terminal(tree: Node, seed: int, only: str | None = None) -> Node:
    """A constant drawn anew from around its magnitude."""
    r = random.Random(seed)
    ps = [p for p in places(tree) if kind(get(tree, p)) in ((only,) if only else ("int", "float"))]
    if not ps:
        return tree
    p = r.choice(ps)
    v = get(tree, p).value
    return put(tree, p, Node(r.randint(0, max(1, 2 * abs(v))) if isinstance(v, int) else round(r.uniform(0, max(1.0, 2 * abs(v))), 5)))


def insert(tree: Node, layer: str, seed: int, extra: tuple = ()) -> Node:
    """A call put around a subtree (insert_adf, insert_modifyLearner, add_layer)."""
    r = random.Random(seed)
    p = r.choice([p for p in places(tree) if p and kind(get(tree, p)) == "call"] or [()])
    return put(tree, p, Node(layer, (get(tree, p), *extra)))


def remove(tree: Node, seed: int) -> Node:
    """A call replaced by its first data argument (remove_layer)."""
    r = random.Random(seed)
    ps = [p for p in places(tree) if p and get(tree, p).args and (get(tree, p).args[0].args is not None or str(get(tree, p).args[0].value).startswith("ARG"))]
    return put(tree, p := r.choice(ps), get(tree, p).args[0]) if ps else tree


def swap(tree: Node, names: list[str], seed: int) -> Node:
    """A call renamed, its arguments kept (swap_layer)."""
    r = random.Random(seed)
    ps = [p for p in places(tree) if p and kind(get(tree, p)) == "call"]
    return put(tree, p := r.choice(ps), Node(r.choice(names), get(tree, p).args)) if ps else tree


def shrink(tree: Node, seed: int) -> Node:
    """A branch replaced by one of its leaves (modify_layer)."""
    r = random.Random(seed)
    ps = [p for p in places(tree) if p and kind(get(tree, p)) == "call"]
    if not ps:
        return tree
    p = r.choice(ps)
    leaves = [n for n in get(tree, p).nodes if n.args is None and isinstance(n.value, str)]
    return put(tree, p, r.choice(leaves)) if leaves else tree


def grow(names: dict[str, int], depth: int, seed: int) -> Node:
    """A random program: ``names`` gives calls with their numbers of datasets."""
    r = random.Random(seed)

    def make(d: int) -> Node:
        if d == 0:
            return Node("ARG0")
        name = r.choice(sorted(names))
        return Node(name, tuple(make(d - 1 if i == 0 else r.randrange(d)) for i in range(names[name])))

    return make(depth)
