"""From comparisons to Column expressions, with the types checked first."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column as SparkColumn
from pyspark.sql import functions as F

from keystrata.sql.parser import Comparison
from keystrata.types import TableSchema, check_type

_OPERATORS = {"=": operator.eq, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}


def check(where: tuple[Comparison, ...], schema: TableSchema) -> None:
    for c in where:
        check_type(schema.column(c.column), c.value)


def condition(where: tuple[Comparison, ...]) -> SparkColumn | None:
    """The conjunction; None if it is empty, which is true."""
    parts = [_OPERATORS[c.op](F.col(f"`{c.column}`"), F.lit(c.value)) for c in where]
    return reduce(operator.and_, parts) if parts else None
