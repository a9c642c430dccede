"""Removal of repeated token windows (exact substring deduplication).

Rabin-Karp hashes of every window of ``size`` consecutive words are compared over the whole corpus.
A window goes if its word sequence also starts in a document with a smaller doc_id; overlapping and
touching windows merge into maximal intervals of words.

Plan: one scan hashes all windows. A task keeps each hash once for a buffer of its documents, with the smallest doc_id,
and sends it to a hash range, packed with the buffer's other hashes of that range. So a passage that
a third of all documents share makes one entry a buffer, and a window costs about 9 bytes of shuffle rather than a row.
The number of ranges follows the bytes of text, so each is sorted on its own in bounded memory; the answers (doc_id, covered
hashes) meet the texts, compressed, in one join.

Windows are equal if two independent Rabin-Karp hashes agree, one whole (61 bits) and 16 bits of the other: two
different ones among 10^10 windows do so with a chance of some 10^-3, whatever the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystrata.llm.shared import deltas, map_arrow, n_ranges_for, packed, unpacked
from keystrata.llm.textbytes import NOT_SPACE, OTHER_BASE, Texts, Words, chunks, windows

#: Windows that a scanning task holds before it sends them.
BUFFER = 1 << 21
_BLOB = "range int, payload binary, doc_id long, covered binary"
_BLOB_ARROW = pa.schema([("range", pa.int32()), ("payload", pa.binary()), ("doc_id", pa.int64()), ("covered", pa.binary())])
_COVER = "doc_id long, covered binary"
_COVER_ARROW = pa.schema([("doc_id", pa.int64()), ("covered", pa.binary())])


def _grouped(h: np.ndarray, check: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(h, check, doc) sorted by window, where each window begins, and the smallest doc of each row's window."""
    order = np.argsort(h, kind="stable")
    if len(h) and ((h[order][1:] == h[order][:-1]) & (check[order][1:] != check[order][:-1])).any():
        order = np.lexsort((check, h))
    h, check, doc = h[order], check[order], doc[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (check[1:] != check[:-1])
    at = np.flatnonzero(new)
    least = np.minimum.reduceat(doc, at) if len(at) else doc
    return h, check, doc, at, least


def _by_doc(doc_id: np.ndarray, hashes: np.ndarray) -> pa.RecordBatch:
    order = np.argsort(doc_id, kind="stable")
    doc_id, hashes = doc_id[order], hashes[order]
    at = np.flatnonzero(np.concatenate(([True], doc_id[1:] != doc_id[:-1]))) if len(doc_id) else np.zeros(0, np.int64)
    ends = np.append(at[1:], len(doc_id))
    packed = pa.array([hashes[a:b].tobytes() for a, b in zip(at, ends, strict=True)] if len(at) else [], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(doc_id[at], pa.int64()), packed], schema=_COVER_ARROW)


def _sent(h: np.ndarray, check: np.ndarray, doc: np.ndarray, n_ranges: int) -> Iterator[pa.RecordBatch]:
    """Of a buffer: its distinct windows, by range; and those that the buffer itself shows to be repeated."""
    h, check, doc, at, least = _grouped(h, check, doc)
    late = doc != np.repeat(least, np.diff(np.append(at, len(h))))
    if late.any():
        local = _by_doc(doc[late], h[late])
        n = local.num_rows
        spread = (local.column(0).to_numpy() % n_ranges).astype(np.int32)  # any range does: it hands them on
        yield pa.RecordBatch.from_arrays([pa.array(spread), pa.nulls(n, pa.binary()), *local.columns], schema=_BLOB_ARROW)
    h, check = h[at], check[at]
    bounds = np.array([-(-(k << 32) // n_ranges) << 32 for k in range(1, n_ranges)], dtype=np.uint64)
    edges = np.concatenate(([0], np.searchsorted(h, bounds), [len(h)]))
    full = np.flatnonzero(np.diff(edges))
    blobs = []
    for a, b in zip(edges[full], edges[full + 1], strict=True):
        ids, own = np.unique(least[a:b], return_inverse=True)
        blobs.append(packed(deltas(h[a:b]), check[a:b], deltas(ids), own.astype(np.uint32)))
    yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(blobs, pa.binary()), pa.nulls(len(full), pa.int64()), pa.nulls(len(full), pa.binary())], schema=_BLOB_ARROW)


def _window_blobs(size: int, n_ranges: int):
    def run(batches):
        held: list[tuple] = []
        n = 0
        for chunk in chunks(batches):
            ids = chunk.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            words = Words(Texts(chunk.column(1)), NOT_SPACE)
            hashes = words.hashes()
            h, _, text = windows(hashes, words.first, size)
            check, _, _ = windows(hashes, words.first, size, base=OTHER_BASE)
            held.append((h, (check & np.uint64(0xFFFF)).astype(np.uint16), ids[text]))
            n += len(h)
            if n >= BUFFER:
                yield from _sent(*(np.concatenate(x) for x in zip(*held, strict=True)), n_ranges)
                held, n = [], 0
        if n:
            yield from _sent(*(np.concatenate(x) for x in zip(*held, strict=True)), n_ranges)

    return run


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of one range: the windows of which some document with a smaller id has one too."""
    parts = []
    for batch in batches:
        local = batch.filter(batch.column(1).is_null()).select(["doc_id", "covered"])
        if local.num_rows:
            yield local
        for b in batch.column(1).drop_null().to_pylist():
            h, check, ids, own = unpacked(b)
            parts.append((np.cumsum(h, dtype=np.uint64), check, np.cumsum(ids)[own]))
    if not parts:
        return
    h, _, doc, at, least = _grouped(*(np.concatenate(x) for x in zip(*parts, strict=True)))
    late = doc != np.repeat(least, np.diff(np.append(at, len(h))))
    yield _by_doc(doc[late], h[late])


def repeated_windows(docs: DataFrame, size: int = 13, n_ranges: int | None = None) -> DataFrame:
    """(doc_id, covered): packed hashes of a document's windows that also start in a document with a smaller id.

    A document may have several rows. ``n_ranges`` bounds a reducing task to 1 / n_ranges of all
    window hashes; by default it follows the bytes of text. A document gets at most one answer from each range and buffer.
    """
    texts = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n_ranges = n_ranges or n_ranges_for(texts)
    blobs = map_arrow(texts, _window_blobs(size, n_ranges), _BLOB).repartitionById(n_ranges, "range")  # a task reads one range; by hash some would get several
    return blobs.groupBy("range").applyInArrow(_repeats, _COVER)


def _squeezed(batches):
    for chunk in chunks(batches):
        press = zstandard.ZstdCompressor(level=1)
        texts, there = Texts(chunk.column(1)), chunk.column(1).is_valid().to_pylist()
        yield pa.RecordBatch.from_arrays([chunk.column(0), pa.array([press.compress(texts.bytes_of(i)) if ok else None for i, ok in enumerate(there)], pa.binary())], names=["doc_id", "text"])


def _opened(batches):
    """As ``chunks``, of texts that come compressed."""
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            open_ = zstandard.ZstdDecompressor()
            texts = pa.array([None if t is None else open_.decompress(t) for t in part.column(0).to_pylist()], pa.large_binary())
            yield from chunks([pa.RecordBatch.from_arrays([texts, *part.columns[1:]], names=["text", *part.schema.names[1:]])])


def _cut(size: int):
    schema = pa.schema([("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.binary())])

    def run(batches):
        for chunk in _opened(batches):
            words = Words(Texts(chunk.column(0)), NOT_SPACE)
            covers = chunk.column(1)
            n_words = words.counts.astype(np.int64)
            gone = np.zeros(len(words) + 1, dtype=np.int64)
            some = np.flatnonzero(covers.is_valid().to_numpy(zero_copy_only=False))
            if len(some):
                h, start, text = windows(words.hashes(), words.first, size)
                first = np.searchsorted(text, np.arange(len(words.counts) + 1))
                for i in some:
                    a, b = first[i], first[i + 1]
                    hit = start[a:b][np.isin(h[a:b], np.frombuffer(b"".join(covers[int(i)].as_py()), dtype=np.uint64))]
                    np.add.at(gone, hit, 1)
                    np.add.at(gone, hit + size, -1)
            removed = np.cumsum(gone)[:-1] > 0
            sums = np.concatenate(([0], np.cumsum(removed)))
            n_removed = sums[words.first[1:]] - sums[words.first[:-1]]
            kept = []
            for i in range(len(n_words)):
                own = words.texts.bytes_of(i).split()  # bytes.split() knows exactly these six separators
                if n_removed[i]:
                    own = [w for w, x in zip(own, removed[words.first[i] : words.first[i + 1]].tolist(), strict=True) if not x]
                kept.append(b" ".join(own))
            yield chunk, pa.RecordBatch.from_arrays([pa.array(n_words), pa.array(n_removed.astype(np.int64)), pa.array(kept, pa.binary())], schema=schema)

    return run


def remove_repeats(docs: DataFrame, size: int = 13, n_ranges: int | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_removed, text without the repeated windows (words joined by one space).

    Null and empty texts have no words and give an empty text. Rows with a null doc_id neither cover others nor
    lose words. Rows that share a doc_id are one document: none covers the other. Texts shorter than
    ``size`` words have no window. Other columns of ``docs`` are ignored.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    covers = repeated_windows(base, size, n_ranges).groupBy("doc_id").agg(F.collect_list("covered").alias("covers"))
    texts = lambda rows: map_arrow(base.where(rows), _squeezed, "doc_id long, text binary")
    joined = texts("doc_id is not null").join(covers, "doc_id", "left").select("text", "covers", "doc_id")
    anonymous = texts("doc_id is null").select("text", F.lit(None).cast("array<binary>").alias("covers"), "doc_id")
    cut = _cut(size)

    def run(batches):
        for chunk, found in cut(batches):
            yield pa.RecordBatch.from_arrays([chunk.column(2), found.column(0), found.column(1), found.column(2).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "text"])

    made = "doc_id long, n_words long, n_removed long, text string"
    return map_arrow(joined, run, made).unionByName(map_arrow(anonymous, run, made))


def digest(docs: DataFrame, size: int = 13) -> DataFrame:
    """The contract's columns, from ``remove_repeats``."""
    return remove_repeats(docs, size).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def query(spark, sf_dir: str) -> DataFrame:
    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
p AS (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 11, 1))) AS i FROM w),
g AS (SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS g FROM p),
m AS (SELECT g, min(doc_id) AS least FROM g GROUP BY g HAVING count(DISTINCT doc_id) > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM g JOIN m USING (g) WHERE doc_id > least),
r AS (SELECT doc_id, list(i) AS gone FROM c GROUP BY doc_id)
SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
  sha256(CASE WHEN gone IS NULL THEN array_to_string(words, ' ')
    ELSE coalesce((SELECT string_agg(x.word, ' ' ORDER BY x.i) FROM (SELECT unnest(words) AS word, generate_subscripts(words, 1) AS i) x WHERE NOT list_contains(gone, x.i)), '') END) AS kept_sha256
FROM w LEFT JOIN r ON w.doc_id = r.doc_id
"""
