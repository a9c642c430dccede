"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the windows of ``size`` consecutive words of the benchmark items (an item of fewer words is one
pattern). For each pattern length there is a block shift table: how far a search may jump if the block of two words
that ends at the current position is the last of the window looked at. Where the shift is 0, the hash of the pattern's
last block selects a bucket of patterns, which are compared with the text directly.
"""

from __future__ import annotations

import uuid
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from keystrata.llm.shared import map_arrow, written
from keystrata.llm.textbytes import ALNUM_LOWER, Texts, Words, chunks, mix

SIZE, MIN_ITEMS = 8, 2
#: Bytes of benchmark text that one scan takes (a worker holds some 70 times as much); a larger benchmark is searched in several scans.
BLOCK_BYTES = 4 << 20
SHIFT_SLOTS = 1 << 20


def _word_lists(texts: pa.Array) -> list[tuple[list[bytes], np.ndarray]]:
    w = Words(Texts(texts, lower=True), ALNUM_LOWER)
    h = w.hashes()
    return [([w.bytes_of(k) for k in range(a, b)], h[a:b]) for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)]


def _blocks(h: np.ndarray, width: int) -> np.ndarray:
    """Slots of the block that ends at each word: the last ``width`` words, which is 2, or 1 for patterns of one word."""
    if width == 1:
        return (h & np.uint64(SHIFT_SLOTS - 1)).astype(np.int64)
    out = np.zeros(len(h), dtype=np.int64)
    out[1:] = (mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]) & np.uint64(SHIFT_SLOTS - 1)).astype(np.int64)
    return out


class Matcher:
    """Shift table and suffix buckets for patterns of ``length`` words."""

    def __init__(self, length: int):
        self.length, self.width = length, min(2, length)
        self.shift = np.full(SHIFT_SLOTS, min(length - self.width + 1, 255), dtype=np.uint8)
        self.buckets: dict[int, dict[tuple[bytes, ...], set]] = defaultdict(dict)

    def add(self, words: list[bytes], hashes: np.ndarray, item) -> None:
        slots = _blocks(hashes, self.width)
        for j in range(self.width - 1, self.length):
            self.shift[slots[j]] = min(self.shift[slots[j]], self.length - 1 - j)
        self.buckets[int(slots[-1])].setdefault(tuple(words), set()).add(item)

    def search(self, words: Words, hashes: np.ndarray):
        """(text, first word, items) of each occurrence."""
        slots = _blocks(hashes, self.width)
        jumps = self.shift[slots].tobytes()
        for text, (a, b) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)):
            at = a + self.length - 1
            while at < b:
                jump = jumps[at]
                if jump:
                    at += jump
                    continue
                bucket = self.buckets.get(int(slots[at]))
                if bucket:
                    start = at - self.length + 1
                    items = bucket.get(tuple(words.bytes_of(k) for k in range(start, at + 1)))
                    if items:
                        yield text, start, items
                at += 1


def compiled(items: list[tuple[object, str]], size: int = SIZE) -> list[Matcher]:
    by_length: dict[int, Matcher] = {}
    for (item, _), (words, hashes) in zip(items, _word_lists(pa.array([t for _, t in items], pa.string())), strict=True):
        n = min(size, len(words))
        if n:
            matcher = by_length.setdefault(n, Matcher(n))
            for k in range(len(words) - n + 1):
                matcher.add(words[k : k + n], hashes[k : k + n], item)
    return list(by_length.values())


_HIT, _ITEMS = pa.list_(pa.int64()), pa.list_(pa.string())


def _scan(batches, sent, size: int, first: bool, names: list[str]):
    """Append, or extend, the words hit (as intervals start, end, start, end, ...) and the items found."""
    matchers = compiled(sent.value, size)
    for chunk in chunks(batches):
        held = chunk.num_columns if first else chunk.num_columns - 3
        words = Words(Texts(chunk.column(chunk.schema.get_field_index("text")), lower=True), ALNUM_LOWER)
        hashes = words.hashes()
        spans, items = defaultdict(list), defaultdict(set)
        if not first:
            for i, (s, t) in enumerate(zip(chunk.column(held + 1).to_pylist(), chunk.column(held + 2).to_pylist(), strict=True)):
                spans[i] += zip(s[::2], s[1::2], strict=True)
                items[i] |= set(t)
        for m in matchers:
            for text, start, found in m.search(words, hashes):
                at = start - int(words.first[text])
                spans[text].append((at, at + m.length))
                items[text] |= found
        hit = []
        for i in range(len(words.counts)):
            merged: list[int] = []
            for a, b in sorted(spans[i]) if i in spans else ():
                if merged and a <= merged[-1]:
                    merged[-1] = max(merged[-1], b)
                else:
                    merged += (a, b)
            hit.append(merged)
        arrays = [*chunk.columns[:held], pa.array(words.counts.astype(np.int64)), pa.array(hit, _HIT), pa.array([sorted(items[i]) if i in items else [] for i in range(len(hit))], _ITEMS)]
        yield pa.RecordBatch.from_arrays(arrays, names=[*chunk.schema.names[:held], *names])


def _blocks_of(items: DataFrame, block_bytes: int) -> list[DataFrame]:
    """Items dealt by hash into as many blocks as it takes for each to have at most ``block_bytes`` bytes, or one item."""
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    while True:
        block = F.pmod(F.xxhash64("item", "text"), F.lit(n))
        large = items.groupBy(block.alias("block")).agg(F.sum(F.octet_length("text")).alias("bytes"), F.count("*").alias("k")).where((F.col("bytes") > block_bytes) & (F.col("k") > 1))
        if n == 1 or large.isEmpty():
            return [items.where(block == k) for k in range(n)]
        n *= 2


def find_contamination(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """All columns of ``docs`` plus n_words, hit (word intervals start, end, ... in text order) and items (found item_ids).

    No shuffle: the benchmark, whose bytes are counted first, goes to the tasks in blocks of at most ``block_bytes`` (a
    longer item alone), and each block takes one scan. Null and empty texts have no words and no hits; items without words or without item_id
    aren't sought; rows that repeat an item_id are one item, and equal ones are sought once. Repeated documents are judged each. Empty tables give
    no hits, or no rows. Columns n_words, hit and items in ``docs`` are replaced; no other name matters.
    """
    docs = docs.drop("n_words", "hit", "items")
    spark = docs.sparkSession
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item"), "text").distinct()
    names = [f"_{uuid.uuid4().hex}" for _ in range(3)]
    fields = [StructField(n, t) for n, t in zip(names, (LongType(), ArrayType(LongType()), ArrayType(StringType())), strict=True)]
    schema, out, blocks = StructType([*docs.schema.fields, *fields]), docs, _blocks_of(items, block_bytes)
    for k, block in enumerate(blocks):
        sent = spark.sparkContext.broadcast([(r["item"], r["text"]) for r in block.collect()])
        out = map_arrow(out, lambda it, sent=sent, first=k == 0: _scan(it, sent, size, first, names), schema)
        if k + 1 < len(blocks):
            out = written(out, "decontamination")
    return out.withColumnsRenamed(dict(zip(names, ("n_words", "hit", "items"), strict=True)))


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, min_items: int = MIN_ITEMS) -> DataFrame:
    """The documents in which fewer than ``min_items`` benchmark items occur, with the columns of ``docs``."""
    own = {c: f"_{uuid.uuid4().hex}" for c in docs.columns if c in ("n_words", "hit", "items")}  # the caller's come back as they were
    found = find_contamination(docs.withColumnsRenamed(own), benchmark, size)
    return found.where(F.size("items") < min_items).select(*[F.col(f"`{own.get(c, c)}`").alias(c) for c in docs.columns])


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contract's columns, from ``find_contamination``."""
    found = find_contamination(docs.select("doc_id", "text"), benchmark)
    n_hit = F.aggregate("hit", F.struct(F.lit(0).cast("long").alias("n"), F.lit(1).cast("long").alias("sign")), lambda s, x: F.struct((s["n"] - s["sign"] * x).alias("n"), (-s["sign"]).alias("sign")), lambda s: s["n"])
    n_items = F.size("items").cast("long")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), n_items.alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (n_items >= MIN_ITEMS).alias("contaminated"))


def query(spark, sf_dir: str) -> DataFrame:
    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _lower(column: str) -> str:
    return f"translate({column}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


_WORD = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_lower("coalesce(text, '')")}, {_WORD}) AS words FROM documents),
b AS (SELECT item_id, regexp_extract_all({_lower("text")}, {_WORD}) AS words FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
p AS (SELECT item_id, len(words) AS n, words, unnest(range(1, greatest(len(words) - 7, 1) + 1)) AS i FROM b WHERE len(words) > 0),
q AS (SELECT DISTINCT item_id, least(n, 8) AS n, array_to_string(words[i:i + least(n, 8) - 1], ' ') AS g FROM p),
l AS (SELECT DISTINCT n FROM q),
w AS (SELECT doc_id, n, words, unnest(range(1, len(words) - n + 2)) AS i FROM d, l),
g AS (SELECT doc_id, n, i, array_to_string(words[i:i + n - 1], ' ') AS g FROM w),
h AS (SELECT g.doc_id, g.n, i, item_id FROM g JOIN q ON g.n = q.n AND g.g = q.g),
c AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM h GROUP BY doc_id)
SELECT d.doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN c ON d.doc_id = c.doc_id LEFT JOIN t ON d.doc_id = t.doc_id
"""
