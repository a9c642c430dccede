"""The strict type system of keyed tables: two types, no nulls, an integer primary key in front."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql.types import LongType, StringType, StructField, StructType

from keystrata.errors import SqlError

INT64_MIN, INT64_MAX = -(1 << 63), (1 << 63) - 1
MAX_KEY = (1 << 48) - 1
MAX_ROW_BYTES = 64
TYPES = {"INTEGER": LongType(), "TEXT": StringType()}


@dataclass(frozen=True)
class Column:
    name: str
    type: str  # a key of TYPES


@dataclass(frozen=True)
class TableSchema:
    """The first column is the primary key. ``max_row_bytes`` bounds the others' payload; None lifts the bound."""

    name: str
    columns: tuple[Column, ...]
    max_row_bytes: int | None = MAX_ROW_BYTES

    def __post_init__(self):
        names = [c.name for c in self.columns]
        if not names or self.columns[0].type != "INTEGER":
            raise SqlError("the first column must be INTEGER: it is the primary key")
        if len(set(names)) != len(names):
            raise SqlError(f"table {self.name} names a column twice")

    @property
    def key(self) -> str:
        return self.columns[0].name

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    def column(self, name: str) -> Column:
        for c in self.columns:
            if c.name == name:
                return c
        raise SqlError(f"table {self.name} has no column {name}")

    def struct(self) -> StructType:
        return StructType([StructField(c.name, TYPES[c.type], False) for c in self.columns])

    def check_row(self, values: tuple) -> None:
        """Key first, then arity, types and size."""
        if not values or type(values[0]) is not int:
            raise SqlError("the primary key must be an integer")
        if not 0 <= values[0] <= MAX_KEY:
            raise SqlError(f"the primary key must be from 0 to {MAX_KEY}")
        if len(values) != len(self.columns):
            raise SqlError(f"table {self.name} has {len(self.columns)} columns, not {len(values)}")
        size = 0
        for c, v in zip(self.columns, values, strict=True):
            check_type(c, v)
            if c.name != self.key:
                size += 8 if c.type == "INTEGER" else 2 + len(v.encode())
        if self.max_row_bytes is not None and size > self.max_row_bytes:
            raise SqlError(f"a row of {size} bytes exceeds {self.max_row_bytes}")

    def to_json(self) -> dict:
        return {"columns": [[c.name, c.type] for c in self.columns], "max_row_bytes": self.max_row_bytes}

    @staticmethod
    def from_json(name: str, x: dict) -> TableSchema:
        return TableSchema(name, tuple(Column(*c) for c in x["columns"]), x["max_row_bytes"])


def check_type(column: Column, value) -> None:
    """A literal's type must equal the column's: Spark would coerce, this doesn't."""
    if type(value) is not (int if column.type == "INTEGER" else str):
        raise SqlError(f"column {column.name} is {column.type}, the value {value!r} isn't")
    if type(value) is int and not INT64_MIN <= value <= INT64_MAX:
        raise SqlError(f"integer out of range: {value}")
