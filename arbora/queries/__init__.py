"""All queries of the core library, and their SQL."""

from __future__ import annotations

from arbora.queries import evaluation, general, instances, kernels, networks, programs, sources, store, streams, texts, vectors, writes

_MODULES = [general, vectors, kernels, evaluation, store, writes, sources, texts, programs, networks, instances, streams]


def queries() -> dict:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _MODULES for k, s in m.SQL.items()}
