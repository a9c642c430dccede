"""Tables in the cluster's shared folder, and fixed-size sketches that tasks fill and Spark folds."""

from __future__ import annotations

import ctypes
import functools
import io
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset on a local master, as in tests, a temporary one for this application."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = _own.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="keystrata-"))
    return at


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: cuts lineage, and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete what ``written`` made, once nothing reads it any more."""
    spark = df.sparkSession
    for f in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


_shipped: set[str] = set()
#: Rows and bytes of an Arrow batch (a larger row stands alone).
BATCH_ROWS, BATCH_BYTES = 1000, 32 << 20


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once for each application, so that it needn't be installed there.

    Arrow batches of this session get smaller, since texts may be long: a worker holds a whole batch.
    """
    if int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").removesuffix("b")) > BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = Path(__file__).resolve().parents[1]
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    at = os.path.join(tempfile.mkdtemp(prefix="keystrata-"), "keystrata_package.zip")
    Path(at).write_bytes(held.getvalue())
    spark.sparkContext.addPyFile(at)
    _shipped.add(app)


def release() -> None:
    """Give the system what this process has freed: a Python worker lives on between tasks, beside a JVM that needs the memory."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim:
        trim(0)


def released(f):
    """The same function of batches, which releases what it has freed when a task's (or group's) batches are done."""

    @functools.wraps(f)
    def run(batches):
        try:
            yield from f(batches)
        finally:
            release()

    return run


def map_arrow(df: DataFrame, f, schema) -> DataFrame:
    """mapInArrow with this package at hand on the executors."""
    ship(df.sparkSession)
    return df.mapInArrow(released(f), schema)


#: Bytes of text whose hashes one reducing task takes; so many tasks share the work from as many MB on.
RANGE_BYTES, EVEN_RANGES = 32 << 20, 64


def n_ranges_for(docs: DataFrame, column: str = "text") -> int:
    """Into how many hash ranges to deal what is made of these texts: it follows their measured bytes."""
    total = docs.agg(F.sum(F.octet_length(column))).first()[0] or 0
    return max(1, min(EVEN_RANGES, total >> 20), -(-total // RANGE_BYTES))


def filter_slots(h: np.ndarray, bits: int, k: int) -> np.ndarray:
    """k bit positions of a Bloom filter for each 64-bit hash (double hashing)."""
    a, b = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return ((a[:, None] + np.arange(k, dtype=np.uint64) * b[:, None]) & np.uint64(bits - 1)).astype(np.int64)


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays as byte planes (high planes of small or sorted numbers compress well), with their types and lengths in front."""
    head = np.array([len(arrays), *(x for a in arrays for x in (ord(a.dtype.char), len(a)))], dtype=np.int64).tobytes()
    planes = [np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(planes))


def unpacked(payload: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(payload)
    k = int(np.frombuffer(raw, dtype=np.int64, count=1)[0])
    told = np.frombuffer(raw, dtype=np.int64, count=2 * k, offset=8).tolist()
    at, out = 8 + 16 * k, []
    for kind, n in zip(told[::2], told[1::2], strict=True):
        t = np.dtype(chr(kind))
        planes = np.frombuffer(raw, dtype=np.uint8, count=t.itemsize * n, offset=at).reshape(t.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).view(t).ravel())
        at += t.itemsize * n
    return out


def deltas(a: np.ndarray) -> np.ndarray:
    return np.diff(a, prepend=a.dtype.type(0))


PIECE_SCHEMA = "part int, payload binary"
_PIECE = pa.schema([("part", pa.int32()), ("payload", pa.binary())])


def squeeze(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).tobytes())


def unsqueeze(b: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), dtype=dtype)


def pieces(arrays: list[np.ndarray], n_parts: int) -> pa.RecordBatch:
    """A sketch of one task, cut into parts of equal length so that many tasks can fold it.

    Several arrays of equal length are cut alike; a part's payload holds its slice of each in turn.
    """
    cut = [np.split(a, n_parts) for a in arrays]
    payload = [squeeze(np.concatenate([c[p] for c in cut])) for p in range(n_parts)]
    return pa.RecordBatch.from_arrays([pa.array(range(n_parts), pa.int32()), pa.array(payload, pa.binary())], schema=_PIECE)


def folded(parts: DataFrame, n_parts: int, dtype, combine: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> dict[int, np.ndarray]:
    """Fold all tasks' pieces part by part, and bring the one sketch to the driver.

    The sketch has a size that its parameters fix, whatever the input. A reducing task streams over its
    parts' pieces and holds one array for each part.
    """

    def fold(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a = unsqueeze(payload, dtype)
                held[part] = combine(held[part], a) if part in held else a.copy()
        for part, a in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([squeeze(a)], pa.binary())], schema=_PIECE)

    rows = map_arrow(parts.repartition(n_parts, "part"), fold, PIECE_SCHEMA).collect()
    return {r["part"]: unsqueeze(r["payload"], dtype) for r in rows}
