"""Exact top-k inner-product search with ball trees.

Vectors that lie near each other share a shard: cells fitted on a bounded sample only say where a vector goes, and every vector is in a shard. Each shard gets
one ball tree, which is stored with it. A block of queries goes down a tree best first: nodes are ordered by the upper
bound of the inner product, q.c + |q| r, and a query leaves a branch whose bound lies under its current k-th score. Scores are shared
in two ways: within a task from shard to shard, and between tasks by a first round, in which each query
meets the group of shards with the nearest root and whose k-th scores all other tasks start from. Before the second round
the roots' bounds are held against those scores, so that only groups of shards that can still matter to a block are sent to it.

Queries and shards meet in cells of a grid, block by block, so a task holds a few shards and a few
query blocks however many there are.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keystrata.llm.shared import discard, map_arrow, ship, written

#: Most rows of a shard, of a query block and of a leaf; wide vectors make shards and blocks shorter, of PACK_BYTES at most.
SHARD, BLOCK, LEAF = 8192, 512, 64
PACK_BYTES = 8 << 20
#: Shards and, on average, query blocks of one cell of the grid.
CELL_SHARDS, CELL_BLOCKS = 4, 4
#: Vectors that the cells of the first split are fitted on (about; twice as many at most), and the most such cells.
SAMPLE, COARSE = 8192, 256
#: Roots of shards that are held against a block at a time, on average.
ROOTS = 2048
LEAST = np.iinfo(np.int64).min


def _schema(*fields: tuple[str, pa.DataType]) -> tuple[pa.Schema, str]:
    names = {pa.int64(): "long", pa.int32(): "int", pa.float64(): "double", pa.binary(): "binary"}
    return pa.schema(fields), ", ".join(f"{n} {names[t]}" for n, t in fields)


_L, _I, _D, _B = pa.int64(), pa.int32(), pa.float64(), pa.binary()
_SHARD_ARROW, _SHARD = _schema(("g", _L), ("width", _I), ("bytes", _I), ("ids", _B), ("vectors", _B), ("nodes", _B), ("centers", _B), ("radii", _B), ("center", _B), ("radius", _D), ("norm", _D))
_BLOCK_ARROW, _BLOCK = _schema(("block", _L), ("width", _I), ("bytes", _I), ("ids", _B), ("vectors", _B))
_ROOTS_ARROW, _ROOTS = _schema(("part", _L), ("r_width", _I), ("r_g", _B), ("r_center", _B), ("r_radius", _B), ("r_norm", _B))
_FIT_ARROW, _FIT = _schema(("width", _I), ("centers", _B))
_NEAR_ARROW, _NEAR = _schema(("block", _L), ("row", _I), ("score", _D), ("g", _L))
_PAIR_ARROW, _PAIR = _schema(("block", _L), ("g", _L))
_HIT_ARROW, _HIT = _schema(("query_id", _L), ("vec_id", _L), ("score", _L))


def quantised(column: pa.Array, scale: int) -> np.ndarray:
    """Lists of finite numbers as rows of floor(scale * x), shorter ones padded with zeros; beyond 62 bits they saturate."""
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(lengths), max(1, int(lengths.max(initial=0)))), dtype=np.int64)
    out[np.arange(out.shape[1]) < lengths[:, None]] = np.clip(np.floor(scale * x), -(2.0**62), 2.0**62).astype(np.int64)
    return out


def _wide(m: np.ndarray, width: int) -> np.ndarray:
    return np.pad(m, ((0, 0), (0, width - m.shape[1]))) if m.shape[1] < width else m


def _stacked(parts: list[np.ndarray]) -> np.ndarray:
    width = max(m.shape[1] for m in parts)
    return np.concatenate([_wide(m, width) for m in parts])


def _narrow(m: np.ndarray) -> np.ndarray:
    """The same integers in the fewest bytes of 2, 4 and 8 that hold them all."""
    low, high = int(m.min(initial=0)), int(m.max(initial=0))
    return next(m.astype(t) for t in (np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max)


def _content(r: dict) -> tuple[np.ndarray, np.ndarray]:
    """(ids, vectors) of a stored shard or query block."""
    return np.frombuffer(r["ids"], dtype=np.int64), np.frombuffer(r["vectors"], dtype=f"i{r['bytes']}").reshape(-1, r["width"]).astype(np.int64)


def _runs(batches, size: int, scale: int):
    """(ids, vectors) of consecutive rows (vec_id, embedding), ``size`` at a time, or fewer if they are wide."""
    ids, rows, held = [], [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        ids.append(batch.column(0).to_numpy())
        rows.append(quantised(batch.column(1), scale))
        held += batch.num_rows
        size = max(1, min(size, PACK_BYTES // (8 * rows[-1].shape[1])))
        if held >= size:
            i, m = np.concatenate(ids), _stacked(rows)
            full = held - held % size
            for a in range(0, full, size):
                yield i[a : a + size], m[a : a + size]
            ids, rows, held = [i[full:]], [m[full:]], held - full
    if held:
        yield np.concatenate(ids), _stacked(rows)


def _fitted(n_cells: int, scale: int):
    """Of a sample's vectors the centers of a ball tree's leaves, from one side of the space to the other."""

    def run(batches):
        parts = [quantised(b.column(1), scale) for b in batches if b.num_rows]
        if parts:
            x = _stacked(parts)
            tree = BallTree(np.arange(len(x)), x, leaf=-(-len(x) // n_cells))
            leaves = sorted((a, k) for k, (a, _, left) in enumerate(tree.nodes) if left < 0)
            c = tree.centers[[k for _, k in leaves]]
            yield pa.RecordBatch.from_arrays([pa.array([c.shape[1]], _I), pa.array([c.tobytes()], _B)], schema=_FIT_ARROW)

    return run


def _placed(centers: np.ndarray, scale: int):
    """Rows with the number of the nearest center; it decides where a vector is stored and nothing else."""

    def run(batches):
        for batch in batches:
            x = quantised(batch.column(1), scale).astype(np.float64)
            width = max(x.shape[1], centers.shape[1])
            c = _wide(centers, width)
            near = ((c * c).sum(axis=1) / 2 - _wide(x, width) @ c.T).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32))], names=[*batch.schema.names, "cell"])

    return run


def _shards(size: int, scale: int):
    def run(batches):
        first = TaskContext.get().partitionId() << 32  # a task that runs again gives its groups the same names
        for k, (ids, vectors) in enumerate(_runs(batches, size, scale)):
            t = BallTree(ids, vectors)
            own = _narrow(t.vectors)
            blobs = [a.tobytes() for a in (t.ids, own, np.array(t.nodes, dtype=np.int64), t.centers, t.radii, t.centers[0])]
            yield pa.RecordBatch.from_arrays([pa.array([first + k // CELL_SHARDS]), pa.array([vectors.shape[1]], _I), pa.array([own.itemsize], _I), *(pa.array([b], _B) for b in blobs), pa.array([t.radii[0]]), pa.array([t.norm])], schema=_SHARD_ARROW)

    return run


def _blocks(size: int, scale: int):
    def run(batches):
        first = TaskContext.get().partitionId() << 32
        for k, (ids, vectors) in enumerate(_runs(batches, size, scale)):
            own = _narrow(vectors)
            yield pa.RecordBatch.from_arrays([pa.array([first + k]), pa.array([own.shape[1]], _I), pa.array([own.itemsize], _I), pa.array([ids.tobytes()], _B), pa.array([own.tobytes()], _B)], schema=_BLOCK_ARROW)

    return run


class BallTree:
    """Rows of each node lie together after ``order``; nodes[i] = (from, to, left child or -1), children at left, left + 1."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF):
        x = vectors.astype(np.float64)
        order = np.arange(len(ids))
        self.nodes: list[list[int]] = [[0, len(ids), -1]]
        centers, radii = [], []
        at = 0
        while at < len(self.nodes):
            a, b, _ = self.nodes[at]
            own = x[order[a:b]]
            center = own.mean(axis=0)
            away = np.sqrt(((own - center) ** 2).sum(axis=1))
            centers.append(center)
            radii.append(away.max())
            if b - a > leaf and radii[-1] > 0:
                far = own[away.argmax()]
                other = own[((own - far) ** 2).sum(axis=1).argmax()]
                order[a:b] = order[a:b][np.argsort(own @ (other - far), kind="stable")]
                self.nodes[at][2] = len(self.nodes)
                mid = (a + b) // 2
                self.nodes += [[a, mid, -1], [mid, b, -1]]
            at += 1
        self.centers, self.radii = np.array(centers), np.array(radii)
        self.ids, self.vectors = ids[order], vectors[order]
        self.norm = float(np.sqrt((x * x).sum(axis=1)).max()) if len(ids) else 0.0

    @classmethod
    def stored(cls, r: dict) -> BallTree:
        t = cls.__new__(cls)
        t.ids, t.vectors = _content(r)
        t.nodes = np.frombuffer(r["nodes"], dtype=np.int64).reshape(-1, 3).tolist()
        t.centers, t.radii = np.frombuffer(r["centers"]).reshape(-1, r["width"]), np.frombuffer(r["radii"])
        t.norm = r["norm"]
        return t


def _scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Integer inner products; beyond 64 bits they saturate."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * max(1, q.shape[1])
    if most < 2**53:
        return (q.astype(np.float64) @ v.astype(np.float64).T).astype(np.int64)
    if most < 2**63:
        return q @ v.T
    exact = q.astype(object) @ v.astype(object).T
    return np.clip(exact, LEAST + 1, np.iinfo(np.int64).max).astype(np.int64)


class Search:
    """The best k so far of a block of queries."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, floor: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.kth = floor.copy()
        self.found_score = np.full((len(ids), k), LEAST)
        self.found_id = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.norms = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1))
        self.visited = 0

    def descend(self, tree: BallTree) -> None:
        width = max(self.vectors.shape[1], tree.vectors.shape[1])
        q, v, c = _wide(self.vectors, width), _wide(tree.vectors, width), _wide(tree.centers, width)
        slack = 1e-9 * (1 + self.norms * tree.norm)
        everyone = np.arange(len(self.ids))
        lowest = float(LEAST)  # scores saturate there, so bounds do too
        bound = np.maximum(q.astype(np.float64) @ c[0] + self.norms * tree.radii[0] + slack, lowest)
        heap = [(-bound.max(), 0, everyone, bound)]
        while heap:
            _, node, who, bound = heapq.heappop(heap)
            alive = bound >= self.kth[who]
            who, bound = who[alive], bound[alive]
            if not len(who):
                continue
            self.visited += 1
            a, b, left = tree.nodes[node]
            if left < 0:
                self._take(who, tree.ids[a:b], _scores(q[who], v[a:b]))
                continue
            for child in (left, left + 1):
                below = np.minimum(bound, q[who].astype(np.float64) @ c[child] + self.norms[who] * tree.radii[child] + slack[who])
                below = np.maximum(below, lowest)
                keep = below >= self.kth[who]
                if keep.any():
                    heapq.heappush(heap, (-below[keep].max(), child, who[keep], below[keep]))

    def _take(self, who: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        i, j = np.nonzero((scores >= self.kth[who][:, None]) & (ids[None, :] != self.ids[who][:, None]))
        if not len(i):
            return
        some, k = np.unique(who[i]), self.k
        owner = np.concatenate((who[i], np.repeat(some, k)))
        score = np.concatenate((scores[i, j], self.found_score[some].ravel()))
        vec = np.concatenate((ids[j], self.found_id[some].ravel()))
        order = np.lexsort((vec, np.invert(score), owner))  # invert: descending, without overflow
        owner, score, vec = owner[order], score[order], vec[order]
        rank = np.arange(len(owner)) - np.searchsorted(owner, owner)
        best = rank < k
        self.found_score[owner[best], rank[best]] = score[best]
        self.found_id[owner[best], rank[best]] = vec[best]
        self.kth[some] = np.maximum(self.kth[some], self.found_score[some, k - 1])

    def hits(self) -> pa.RecordBatch:
        i, j = np.nonzero(self.found_score != LEAST)
        return pa.RecordBatch.from_arrays([pa.array(self.ids[i]), pa.array(self.found_id[i, j]), pa.array(self.found_score[i, j])], schema=_HIT_ARROW)


def _cell(k: int):
    def run(shards: pa.Table, blocks: pa.Table) -> pa.Table:
        trees = [BallTree.stored(r) for r in shards.to_pylist()]
        out = []
        for r in blocks.to_pylist():
            s = Search(*_content(r), np.frombuffer(r["floor"], dtype=np.int64), k)
            for tree in trees:
                s.descend(tree)
            out.append(s.hits())
        return pa.Table.from_batches(out, schema=_HIT_ARROW)

    return run


def _gathered(roots: pa.Table) -> pa.Table:
    """Roots of shards, as one row."""
    rows = roots.to_pylist()
    c = _stacked([np.frombuffer(r["center"])[None, :] for r in rows])
    blobs = [np.array([r["g"] for r in rows], dtype=np.int64), c, np.array([r["radius"] for r in rows]), np.array([r["norm"] for r in rows])]
    return pa.Table.from_arrays([pa.array([rows[0]["part"]], _L), pa.array([c.shape[1]], _I), *(pa.array([b.tobytes()], _B) for b in blobs)], schema=_ROOTS_ARROW)


def _met(batches):
    """(row, query block, q, group of each root, centers, radii, norms) of blocks beside roots, in one width."""
    for batch in batches:
        for r in batch.to_pylist():
            c = np.frombuffer(r["r_center"]).reshape(-1, r["r_width"])
            q = _content(r)[1].astype(np.float64)
            width = max(q.shape[1], c.shape[1])
            yield r, _wide(q, width), np.frombuffer(r["r_g"], dtype=np.int64), _wide(c, width), np.frombuffer(r["r_radius"]), np.frombuffer(r["r_norm"])


def _nearest(batches):
    """The group of the root with the highest inner product, for each query of a block."""
    for r, q, g, c, _, _ in _met(batches):
        score = q @ c.T
        best = score.argmax(axis=1)
        n = len(q)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, r["block"])), pa.array(np.arange(n, dtype=np.int32)), pa.array(score[np.arange(n), best]), pa.array(g[best])], schema=_NEAR_ARROW)


def _wanted(batches):
    """The groups with a root whose bound reaches the k-th score of a query of the block."""
    for r, q, g, c, radii, norms in _met(batches):
        length = np.sqrt((q * q).sum(axis=1))[:, None]
        bound = q @ c.T + length * radii + 1e-9 * (1 + length * norms)
        alive = np.maximum(bound, float(LEAST)) >= np.frombuffer(r["floor"], dtype=np.int64)[:, None]
        some = np.unique(g[alive.any(axis=0)])
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), r["block"])), pa.array(some)], schema=_PAIR_ARROW)


def _with_floor(batches):
    """Query blocks, each with the k-th scores known of its queries."""
    for batch in batches:
        floors = []
        for ids, known in zip(batch.column("ids").to_pylist(), batch.column("known").to_pylist(), strict=True):
            by = {x["query_id"]: x["kth"] for x in known or ()}
            floors.append(np.array([by.get(i, LEAST) for i in np.frombuffer(ids, dtype=np.int64).tolist()], dtype=np.int64).tobytes())
        yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in _BLOCK_ARROW), pa.array(floors, _B)], names=[*_BLOCK_ARROW.names, "floor"])


def _query_ids(batches):
    for batch in batches:
        for block, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = np.frombuffer(ids, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.full(len(own), block))], names=["query_id", "block"])


#: Rows that take part.
_VALID = "vec_id is not null and embedding is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k candidates with the highest integer inner product, ties to the smaller vec_id.

    Both inputs have vec_id and embedding; components become floor(scale * x). Rows with a null vec_id,
    null vector or a null or non-finite component take no part. A query is never its own candidate (rows that
    share its vec_id aren't either). Of queries that repeat a vec_id the smallest of the vectors that take part counts; candidates that repeat one count each.
    Other columns are ignored. Vectors of unequal
    length are taken as padded with zeros. Fewer than k candidates give fewer rows; no queries or no candidates give none.
    ``shard`` and ``block`` are the most rows of a shard and of a query block; they and the sample change the cost, not the result.
    """
    spark = vectors.sparkSession
    ship(spark)
    id_ = F.col("vec_id").cast("long").alias("vec_id")
    base = vectors.where(_VALID).select(id_, "embedding")
    asked = queries.where(_VALID).groupBy(id_).agg(F.min("embedding").alias("embedding"))
    n = vectors.count()
    centers = np.zeros((1, 1))
    if n > shard:
        some = base.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 40)) < F.lit(int(min(1.0, SAMPLE / n) * (1 << 40)))).limit(2 * SAMPLE)
        for fit in map_arrow(some.coalesce(1), _fitted(min(COARSE, -(-n // shard)), scale), _FIT).collect():
            centers = np.frombuffer(fit["centers"]).reshape(-1, fit["width"])

    def by_cell(df: DataFrame) -> DataFrame:
        """Rows in the order of their cells; a cell with very many rows, even equal ones, is cut by what follows it in the order."""
        order = ["cell", "vec_id", "nth"]
        kind = df.schema["embedding"].dataType.simpleString()
        placed = map_arrow(df, _placed(centers, scale), f"vec_id long, embedding {kind}, cell int").withColumn("nth", F.monotonically_increasing_id())
        return placed.repartitionByRange(*order).sortWithinPartitions(*order).select("vec_id", "embedding")

    shards = written(map_arrow(by_cell(base), _shards(shard, scale), _SHARD), "shards")
    blocks = written(map_arrow(by_cell(asked), _blocks(block, scale), _BLOCK), "query-blocks")
    parts, columns = max(1, -(-shards.count() // ROOTS)), max(1, -(-blocks.count() // CELL_BLOCKS))
    roots = shards.select("g", "center", "radius", "norm").withColumn("part", F.pmod(F.xxhash64("g", "center"), F.lit(parts)).cast("long"))
    roots = written(roots.groupBy("part").applyInArrow(_gathered, _ROOTS), "roots")

    def beside_roots(b: DataFrame) -> DataFrame:
        return b.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))).join(roots, "part").drop("part")

    def with_floors(known: DataFrame | None) -> DataFrame:
        b = blocks.withColumn("known", F.lit(None).cast("array<struct<query_id:long,kth:long>>")) if known is None else blocks.join(known, "block", "left")
        return map_arrow(b, _with_floor, f"{_BLOCK}, floor binary")

    def searched(pairs: DataFrame, b: DataFrame) -> DataFrame:
        h = F.pmod(F.xxhash64("block"), F.lit(columns)).alias("h")
        left, right = shards.drop("center", "radius").join(pairs.select("g", h).distinct(), "g"), b.join(pairs.select("block", "g", h), "block")
        return left.groupBy("g", "h").cogroup(right.groupBy("g", "h")).applyInArrow(_cell(k), _HIT)

    near = map_arrow(beside_roots(blocks), _nearest, _NEAR).groupBy("block", "row").agg(F.max(F.struct("score", "g")).alias("m"))
    home = written(near.select("block", F.col("m.g").alias("g")).distinct(), "home-cells")
    first = written(searched(home, with_floors(None)), "first-round")
    scores = first.groupBy("query_id").agg(F.sort_array(F.collect_list("score"), asc=False).alias("s")).where(F.size("s") >= k)  # at most k of each cell
    kth = scores.select("query_id", F.element_at("s", k).alias("kth"))
    named = map_arrow(blocks.select("block", "ids"), _query_ids, "query_id long, block long")
    known = named.join(kth, "query_id").groupBy("block").agg(F.collect_list(F.struct("query_id", "kth")).alias("known"))
    floored = written(with_floors(known), "floors")
    wanted = written(map_arrow(beside_roots(floored), _wanted, _PAIR).distinct().join(home, ["block", "g"], "left_anti"), "cells")
    rest = written(searched(wanted, floored), "second-round")
    for done in (shards, blocks, roots, home, floored, wanted):
        discard(done)
    best = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return first.unionByName(rest).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(vectors, vectors.where("vec_id % 50 = 0"))


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
