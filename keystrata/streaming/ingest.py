"""Streaming into a keyed table: every micro-batch is one commit (beyond the reference)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from keystrata.engine import Engine
from keystrata.operators.log import newest


def upsert_stream(engine: Engine, table: str, stream: DataFrame, checkpoint: str, order: str, **trigger) -> StreamingQuery:
    """Upsert a stream; of a batch's rows with one key the last by ``order`` counts. Replaying a batch leaves the same table."""
    schema = engine.table(table).schema

    def write(batch: DataFrame, _: int) -> None:
        engine.upsert(table, newest(batch, schema.key, order).select(*schema.names), unique=True)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
