"""Column functions of the storage format: packed keys and payload sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from keystrata.types import MAX_KEY


def pack_key(table_id: Column, key: Column) -> Column:
    return F.shiftleft(table_id.cast("long"), 48).bitwiseOR(key.cast("long").bitwiseAND(F.lit(MAX_KEY)))


def unpack_table(packed: Column) -> Column:
    return F.shiftrightunsigned(packed, 48)


def unpack_key(packed: Column) -> Column:
    return packed.bitwiseAND(F.lit(MAX_KEY))


def payload_bytes(schema: StructType, key: str) -> Column:
    """Bytes of a row beyond its key: 8 for a number, 2 and its own for a text."""
    size = F.lit(0).cast("long")
    for f in schema:
        if f.name != key:
            size = size + (F.octet_length(f.name).cast("long") + 2 if isinstance(f.dataType, StringType) else 8)
    return size
