"""Removal of lines that many documents share.

Two Bloom filters over line hashes, one for keys seen at least once and one for keys seen at least twice,
are filled by every task and folded. Only keys that the second one holds go into a shuffle, where they are
counted exactly and their first occurrence is chosen. A filter's false positives cost shuffle, never a
line. The filters' size follows the number of lines up to a bound that can be broadcast; beyond that there are more suspects, and the same result.

The lines to drop, found in many documents each, are far fewer than documents. While their measured size can be broadcast, every text is
cut where it is read and none is shuffled; beyond, each document's own lines to drop meet it in a join.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from keystrata.llm.shared import PIECE_SCHEMA, discard, filter_slots, folded, map_arrow, pieces, written
from keystrata.llm.textbytes import chunks

#: Hash functions of each filter, bits for each line, the least and most bits of a filter (64 MB are broadcast at most; about
#: 3 x 10^8 lines leave it half empty), and the parts it is folded in.
BLOOM_HASHES, BITS_A_LINE, LEAST_BITS, MOST_BITS, BLOOM_PARTS = 3, 12, 1 << 20, 1 << 29, 64
#: Bytes of lines to drop (and 100 for each) that may be broadcast.
BROADCAST_BYTES = 48 << 20
_STRIP = b" \t\n\x0b\x0c\r"


def line_key(line: bytes) -> bytes:
    """White space stripped at both ends, A-Z lower-cased (bytes.lower() knows ASCII alone)."""
    return line.strip(_STRIP).lower()


def _long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (least <= 1 or len(key.decode("utf-8", "replace")) >= least)


class TwiceFilter:
    """Which keys may have been seen twice; never misses one."""

    def __init__(self, packed: np.ndarray, bits: int, k: int):
        self.packed, self.bits, self.k = packed, bits, k

    def has(self, h: np.ndarray) -> np.ndarray:
        s = filter_slots(h, self.bits, self.k)
        return ((self.packed[s >> 3] >> (s & 7).astype(np.uint8)) & 1).all(axis=1)


def _fill(batches, least: int, bits: int, k: int):
    once, twice = np.zeros(bits // 8, dtype=np.uint8), np.zeros(bits // 8, dtype=np.uint8)
    for chunk in chunks(batches):
        seen = []
        for text in chunk.column(0).cast(pa.large_binary()).to_pylist():
            keys = {line_key(x) for x in (text or b"").split(b"\n")}
            seen += [xxhash.xxh3_64_intdigest(x) for x in keys if _long_enough(x, least)]
        h, n = np.unique(np.array(seen, dtype=np.uint64), return_counts=True)
        s = filter_slots(h, bits, k)
        at, bit = s >> 3, np.uint8(1) << (s & 7).astype(np.uint8)
        again = (n > 1) | ((once[at] & bit) > 0).all(axis=1)
        np.bitwise_or.at(twice, at[again].ravel(), bit[again].ravel())
        np.bitwise_or.at(once, at.ravel(), bit.ravel())
    yield pieces([once, twice], BLOOM_PARTS)


def _both(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Fold (once, twice) of two tasks: what both have seen has been seen twice."""
    n = len(a) // 2
    return np.concatenate((a[:n] | b[:n], a[n:] | b[n:] | (a[:n] & b[:n])))


def bits_for(lines: int) -> int:
    """The power of two of at least ``BITS_A_LINE`` bits a line, within the bounds."""
    return min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_A_LINE * max(1, lines) - 1).bit_length()))


def twice_filter(docs: DataFrame, least: int = 1, bits: int | None = None, k: int = BLOOM_HASHES) -> TwiceFilter:
    if bits is None:
        breaks = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit("")))
        bits = bits_for(docs.agg(F.sum(F.coalesce(breaks, F.lit(0)) + 1)).first()[0] or 0)
    parts = map_arrow(docs.select("text"), lambda it: _fill(it, least, bits, k), PIECE_SCHEMA)
    got = folded(parts, BLOOM_PARTS, np.uint8, _both)
    size = bits // 8 // BLOOM_PARTS
    empty = np.zeros(2 * size, dtype=np.uint8)
    return TwiceFilter(np.concatenate([got.get(p, empty)[size:] for p in range(BLOOM_PARTS)]), bits, k)


_COUNT = "key binary, n long, least long"
_COUNT_ARROW = pa.schema([("key", pa.binary()), ("n", pa.int64()), ("least", pa.int64())])


def _counts(batches, least: int, filter_of):
    """(key, documents of the chunk that have it, their smallest id) of the suspected keys."""
    for batch in _suspects(((c.append_column("mark", pa.nulls(c.num_rows, pa.int64()))) for c in batches), least, filter_of):
        yield batch.select(["key", "n", "least"])


_SUSPECT = "key binary, n long, least long, holders array<struct<doc_id:long,mark:long,line:int>>"
_HOLDERS = pa.list_(pa.struct([("doc_id", pa.int64()), ("mark", pa.int64()), ("line", pa.int32())]))
_SUSPECT_ARROW = pa.schema([("key", pa.binary()), ("n", pa.int64()), ("least", pa.int64()), ("holders", _HOLDERS)])


def _suspects(batches, least: int, filter_of):
    """(key, documents of the chunk that have it, their smallest id, who they are): one row for each key and chunk."""
    twice = filter_of()
    for chunk in chunks(batches):
        ids, marks = chunk.column(0).to_pylist(), chunk.column(2).to_pylist()
        keys, where = [], []
        for i, text in enumerate(chunk.column(1).cast(pa.large_binary()).to_pylist()):
            first: dict[bytes, int] = {}
            for j, line in enumerate((text or b"").split(b"\n")):
                first.setdefault(line_key(line), j)
            for key, j in first.items():
                if _long_enough(key, least):
                    keys.append(key)
                    where.append((i, j))
        if not keys:
            continue
        hit = twice.has(np.array([xxhash.xxh3_64_intdigest(x) for x in keys], dtype=np.uint64))
        found: dict[bytes, list] = {}
        for k in np.flatnonzero(hit).tolist():
            i, j = where[k]
            found.setdefault(keys[k], []).append({"doc_id": ids[i], "mark": marks[i], "line": j})
        if found:
            least_id = [min((x["doc_id"] for x in v if x["doc_id"] is not None), default=None) for v in found.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array([len(v) for v in found.values()], pa.int64()), pa.array(least_id, pa.int64()), pa.array(list(found.values()), _HOLDERS)], schema=_SUSPECT_ARROW)


def _cut(batches, schema: pa.Schema, keep_lines):
    """Replace text, and append n_lines and n_dropped; ``keep_lines(chunk)`` gives for each row the lines kept of all its lines."""
    for chunk in chunks(batches):
        at = chunk.schema.get_field_index("text")
        texts, n_lines, n_dropped = [], [], []
        for lines, kept in keep_lines(chunk, at):
            n_lines.append(len(lines))
            n_dropped.append(len(lines) - len(kept))
            texts.append(b"\n".join(kept))
        columns = [*chunk.columns[: len(schema) - 2], pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())]
        columns[at] = pa.array(texts, pa.large_binary()).cast(schema.field(at).type)
        yield pa.RecordBatch.from_arrays(columns, schema=schema)


def _lines(chunk: pa.RecordBatch, at: int):
    return ((text or b"").split(b"\n") for text in chunk.column(at).cast(pa.large_binary()).to_pylist())


def _by_keys(sent, keep_first: bool):
    """Lines kept where all keys to drop are at hand, each with the smallest doc_id that has it."""

    def keep(chunk, at):
        least = sent.value
        ids = chunk.column(chunk.schema.get_field_index("doc_id")).cast(pa.int64()).to_pylist() if keep_first else [None] * chunk.num_rows
        for doc_id, lines in zip(ids, _lines(chunk, at), strict=True):
            kept, seen = [], set()
            for x in lines:
                key = line_key(x)
                if key not in least:
                    kept.append(x)
                elif doc_id is not None and least[key] == doc_id and key not in seen:
                    kept.append(x)
                    seen.add(key)
            yield lines, kept

    return keep


def _by_marks(chunk, at):
    """Lines kept where the last column lists (line, kept here) of the keys to drop."""
    for lines, gone in zip(_lines(chunk, at), chunk.column(chunk.num_columns - 1).to_pylist(), strict=True):
        if not gone:
            yield lines, lines
            continue
        keep = {g["line"] for g in gone if g["first"]}
        keys = {line_key(lines[g["line"]]) for g in gone}
        yield lines, [x for j, x in enumerate(lines) if j in keep or line_key(x) not in keys]


def drop_common_lines(
    docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False, bits: int | None = None, hashes: int = BLOOM_HASHES, broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """All columns of ``docs``, text without the lines whose key ``min_docs`` documents have, plus n_lines and n_dropped.

    A line's key is the line stripped of white space, A-Z lower-cased; keys under ``min_chars`` code points
    never count. With ``keep_first`` the document with the smallest doc_id keeps the key's first line.
    Each row is a document, so repeated rows count separately, whatever their doc_id; a null or empty text is one empty line.
    A null doc_id is never the first. Names n_lines and n_dropped in ``docs`` are replaced; no other name matters.
    """
    docs = docs.drop("n_lines", "n_dropped")
    spark = docs.sparkSession
    twice = twice_filter(docs, min_chars, bits, hashes)
    n_bits = twice.bits
    sent = spark.sparkContext.broadcast(twice.packed.tobytes())
    filter_of = lambda: TwiceFilter(np.frombuffer(sent.value, dtype=np.uint8), n_bits, hashes)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counts = map_arrow(texts, lambda it: _counts(it, min_chars, filter_of), _COUNT)
    # a table, not a subplan: should a join follow, it has a plain exchange on either side, so Spark can split a hot key's holders
    common = written(counts.groupBy("key").agg(F.sum("n").alias("n"), F.min("least").alias("least")).where(F.col("n") >= min_docs).select("key", "least"), "common")
    out = StructType([*docs.schema.fields, StructField("n_lines", LongType()), StructField("n_dropped", LongType())])
    arrow = to_arrow_schema(out)
    if (common.agg(F.sum(F.octet_length("key") + 100)).first()[0] or 0) <= broadcast_bytes:
        drop = spark.sparkContext.broadcast({bytes(r["key"]): r["least"] for r in common.collect()})
        discard(common)
        return map_arrow(docs, lambda it: _cut(it, arrow, _by_keys(drop, keep_first)), out)
    doc, mark, gone, m = (f"_{uuid.uuid4().hex}" for _ in range(4))  # no column of the caller's has these names
    marked = docs.withColumn(m, F.xxhash64("text"))
    suspects = map_arrow(marked.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col(m).alias("mark")), lambda it: _suspects(it, min_chars, filter_of), _SUSPECT)
    drops = (
        suspects.select("key", "holders").join(common, "key")
        .select(F.explode("holders").alias("h"), "least")
        .select("h.*", (F.lit(keep_first) & F.coalesce(F.col("h.doc_id") == F.col("least"), F.lit(False))).alias("first"))
        .groupBy("doc_id", "mark").agg(F.collect_set(F.struct("line", "first")).alias(gone))
        .withColumnsRenamed({"doc_id": doc, "mark": mark})
    )
    joined = marked.join(drops, F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & (F.col(m) == F.col(mark)), "left").select(*[F.col(f"`{c}`") for c in docs.columns], gone)
    return map_arrow(joined, lambda it: _cut(it, arrow, _by_marks), out)


def digest(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """The contract's columns, from ``drop_common_lines``."""
    kept = drop_common_lines(docs.select("doc_id", "text"), min_docs, min_chars)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


def query(spark, sf_dir: str) -> DataFrame:
    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM d),
k AS (SELECT r, doc_id, line, i, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE c.key IS NOT NULL))::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE c.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN c ON k.key = c.key GROUP BY r, doc_id
"""
