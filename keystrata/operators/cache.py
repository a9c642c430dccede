"""Replaying an access trace through page caches: hits under LRU-K, of which LRU is the case k = 1.

A cache's decisions depend on all accesses before, so one trace is one sequential fold: traces are dealt to tasks by
their id, sorted there (with spilling), and streamed in Arrow batches. All sizes and policies ride on the same pass. A fold
holds ``frames`` pages and their last k access times, never the trace.
"""

from __future__ import annotations

import heapq
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OUT = "trace string, k long, frames long, accesses long, hits long"
_ARROW = pa.schema([("trace", pa.string()), *[(c, pa.int64()) for c in ("k", "frames", "accesses", "hits")]])


class LruK:
    """Evicts first the pages with fewer than k accesses, by their first one; then by the k-th last access, oldest first.

    A page that was evicted is forgotten. Victims wait in a heap; entries of older states are skipped when they surface.
    """

    def __init__(self, frames: int, k: int):
        if frames < 1 or k < 1:
            raise ValueError("frames and k must be at least 1")
        self.frames, self.k, self.now, self.hits = frames, k, 0, 0
        self.pages: dict[object, deque[int]] = {}
        self.heap: list[tuple[bool, int, int, object]] = []

    def _entry(self, page) -> tuple[bool, int]:
        seen = self.pages[page]
        return len(seen) >= self.k, seen[0]

    def _evict(self) -> None:
        while True:
            full, since, _, page = heapq.heappop(self.heap)
            if page in self.pages and self._entry(page) == (full, since):
                del self.pages[page]
                return

    def access(self, page) -> bool:
        hit = page in self.pages
        self.hits += hit
        if not hit:
            if len(self.pages) >= self.frames:
                self._evict()
            self.pages[page] = deque(maxlen=self.k)
        self.pages[page].append(self.now)
        self.now += 1
        heapq.heappush(self.heap, (*self._entry(page), self.now, page))
        if len(self.heap) > 8 * self.frames + 64:
            self.heap = [(*self._entry(p), i, p) for i, p in enumerate(self.pages)]
            heapq.heapify(self.heap)
        return hit


def _replay(configs: list[tuple[int, int]]):
    def run(batches):
        trace, caches, begun = None, [], False

        def told():
            rows = [(trace, c.k, c.frames, c.now, c.hits) for c in caches]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), _ARROW.types, strict=True)], schema=_ARROW)

        for batch in batches:
            for at, page in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if not begun or at != trace:
                    if begun:
                        yield told()
                    trace, begun, caches = at, True, [LruK(frames, k) for k, frames in configs]
                for cache in caches:
                    cache.access(page)
        if begun:
            yield told()

    return run


def replay(accesses: DataFrame, frames: list[int], ks: list[int]) -> DataFrame:
    """(trace, k, frames, accesses, hits) for each trace of ``accesses`` (trace, pos, page) and each pair of k and frames.

    A trace is replayed by ascending pos (null first; a tie goes by page). A null page is a page of its own, null traces are one trace,
    other columns are ignored, and an empty table gives no rows.
    """
    configs = [(k, f) for k in ks for f in frames]
    rows = accesses.select(F.col("trace").cast("string").alias("trace"), "pos", "page").repartition("trace").sortWithinPartitions("trace", "pos", "page")
    return rows.mapInArrow(_replay(configs), OUT)
