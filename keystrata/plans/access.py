"""Which way a predicate reads a keyed table.

Catalyst does the reading: a bound on the key becomes a pushed filter that skips files and row groups. This is the plain answer to
"how", for explain and for tests; it runs no job.
"""

from __future__ import annotations

from dataclasses import dataclass

from keystrata.sql import binder
from keystrata.sql.parser import Comparison
from keystrata.types import INT64_MAX, INT64_MIN, TableSchema

POINT, RANGE, FULL = "POINT_LOOKUP", "RANGE_SCAN", "FULL_SCAN"


@dataclass(frozen=True)
class AccessPath:
    kind: str
    key: int | None = None
    low: int | None = None
    high: int | None = None
    residual: tuple[Comparison, ...] = ()


def access_path(where: tuple[Comparison, ...], schema: TableSchema) -> AccessPath:
    """Rules in order: equality on the key, bounds on the key, else everything. All but a point's own equality are rechecked."""
    binder.check(where, schema)
    on_key = [c for c in where if c.column == schema.key]
    for c in on_key:
        if c.op == "=":
            return AccessPath(POINT, key=c.value, residual=tuple(x for x in where if x is not c))
    if not on_key:
        return AccessPath(FULL, residual=where)
    low, high = INT64_MIN, INT64_MAX
    for c in on_key:
        if c.op in (">", ">="):
            low = max(low, min(c.value + (c.op == ">"), INT64_MAX))
        else:
            high = min(high, max(c.value - (c.op == "<"), INT64_MIN))
    return AccessPath(RANGE, low=max(low, 0), high=high, residual=where)
