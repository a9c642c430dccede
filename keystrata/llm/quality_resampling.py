"""Quality classifier by importance resampling.

Two generative models over hashed n-grams (words, punctuation runs, and pairs of both) are counted: one from labelled target
documents, one from all documents. A document's importance weight is the ratio of its probabilities under the two. The
sample is the top k by normalised log weight plus a Gumbel draw, which samples k documents without replacement in
proportion to the normalised weights.

Log weights are sums over a text's n-grams, far apart for texts of different length. They are normalised by what target documents of about
that length, held back from the target model, have: a log weight per n-gram at their median becomes ``SHARPNESS``, one at the line that nearly
all of them reach becomes 0. So the draw decides near that line, and not between texts that are clearly good or bad.

k is a parameter; unless given it is the number of documents at or above that line. The k-th largest key is found exactly, by
counting keys digit by digit; only counts go to the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from keystrata.llm.shared import PIECE_SCHEMA, discard, folded, map_arrow, pieces, written
from keystrata.llm.textbytes import Texts, Words, byte_set, chunks, mix

#: Hash buckets of the models (2 x 4 MB are broadcast), and the parts a task's counts are sent in.
BUCKETS, PARTS = 1 << 20, 64
#: At most about so many labelled target documents are used, half to count, half to set k.
TARGET_SAMPLE = 20_000
#: Pseudo-counts that pull rare n-grams to a ratio of 1, and the share of held-back target documents that may fall out.
SHRINK, MISSED = 2.0, 0.002
#: Normalised log weight of the median of held-back target documents, in units in which a Gumbel draw has a standard deviation of 1.3.
SHARPNESS = 10.0
#: A class of lengths has at least so many held-back documents, if there are as many; what is added to a number of n-grams, so
#: that the few of a short text don't stretch its class's factor by chance.
CLASS_SIZE, SLACK = 500, 30

_LETTER = ~byte_set((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x5E), (0x60, 0x60), (0x7B, 0x7F))
_PUNCTUATION = ~_LETTER & ~byte_set((0x00, 0x20), (0x7F, 0x7F))


def ngrams(column: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """(bucket, text) of each n-gram of one or two tokens; a token is a run of word bytes or a run of punctuation."""
    texts = Texts(column)
    a, b = Words(texts, _LETTER), Words(texts, _PUNCTUATION)
    starts = np.concatenate((a.starts, b.starts))
    order = np.argsort(starts, kind="stable")
    h = np.concatenate((a.hashes(), b.hashes()))[order]
    owner = np.concatenate((a.owner(), b.owner()))[order]
    pair = mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])
    same = owner[:-1] == owner[1:]
    bucket = (np.concatenate((h, pair[same])) & np.uint64(BUCKETS - 1)).astype(np.int64)
    return bucket, np.concatenate((owner, owner[:-1][same])), len(texts)


def _target_half(ids, target: set[int]) -> np.ndarray:
    return np.array([i in target for i in ids], dtype=bool)


def _count(batches, sent):
    target = set(np.frombuffer(sent.value, dtype=np.int64).tolist())
    raw, good = np.zeros(BUCKETS, dtype=np.int64), np.zeros(BUCKETS, dtype=np.int64)
    for chunk in chunks(batches):
        bucket, owner, _ = ngrams(chunk.column(1))
        raw += np.bincount(bucket, minlength=BUCKETS)
        own = _target_half(chunk.column(0).to_pylist(), target)
        if own.any():
            good += np.bincount(bucket[own[owner]], minlength=BUCKETS)
    yield pieces([raw, good], PARTS)


def gumbel(ids, seed: str) -> np.ndarray:
    """A standard Gumbel draw for each doc_id, from its hash."""
    h = np.array([xxhash.xxh3_64_intdigest(f"{seed}:{i}") for i in ids], dtype=np.uint64)
    u = ((h >> np.uint64(12)).astype(np.float64) + 0.5) / float(1 << 52)
    return -np.log(-np.log(u))


class Scale:
    """What held-back target documents have, by class of number of n-grams: the line all but ``missed`` of them reach, and the median."""

    def __init__(self, n: np.ndarray, weight: np.ndarray, missed: float):
        order = np.argsort(n, kind="stable")
        n, score = n[order], (weight / (n + SLACK))[order]
        classes = max(1, len(n) // CLASS_SIZE)
        self.bounds = np.unique([n[i * len(n) // classes] for i in range(1, classes)]).astype(np.int64)
        own = np.searchsorted(self.bounds, n, side="right")
        found = [score[own == c] for c in range(len(self.bounds) + 1)]
        # equal numbers may leave the first class without documents: it takes the next one's scale
        found = [x if len(x) else found[c + 1] for c, x in enumerate(found)]
        self.low = np.array([np.quantile(x, missed, method="lower") for x in found])
        self.span = np.maximum(np.array([np.median(x) for x in found]) - self.low, 1e-6)

    def normal(self, n: np.ndarray, weight: np.ndarray) -> np.ndarray:
        c = np.searchsorted(self.bounds, n, side="right")
        return SHARPNESS * (weight / (n + SLACK) - self.low[c]) / self.span[c]


class Resampler:
    """The fitted models: log ratio of each bucket."""

    def __init__(self, sent, seed: str):
        self.ratio, self.seed = np.frombuffer(sent.value, dtype=np.float32).astype(np.float64), seed

    def weights(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Number of n-grams, and log weight, of each text; equal texts have equal ones, whatever stands beside them."""
        bucket, owner, n = ngrams(column)
        return np.bincount(owner, minlength=n), np.bincount(owner, weights=self.ratio[bucket], minlength=n).astype(np.float64)


_WEIGHED = "doc_id long, n long, log_weight double, draw double, held boolean"


def _weigh(batches, sent, kept, seed: str):
    model, keep = Resampler(sent, seed), set(np.frombuffer(kept.value, dtype=np.int64).tolist())
    for chunk in chunks(batches):
        ids = chunk.column(0).to_pylist()
        n, weight = model.weights(chunk.column(1))
        arrays = [chunk.column(0), pa.array(n.astype(np.int64)), pa.array(weight), pa.array(gumbel(ids, seed)), pa.array([i in keep for i in ids], pa.bool_())]
        yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n", "log_weight", "draw", "held"])


def _keyed(batches, scale: Scale):
    for batch in batches:
        n, weight, draw = (batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2, 3))
        normal = scale.normal(n, weight)
        key = normal + draw
        bits = key.view(np.int64)  # as an integer in the same order: of negative numbers all bits but the sign turn over
        x = np.where(bits >= 0, bits, bits ^ np.int64(0x7FFFFFFFFFFFFFFF))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(key), pa.array(x), pa.array(normal >= 0)], names=["doc_id", "key", "x", "reaches"])


_DIGIT = 16


def kth_largest(values: DataFrame, k: int) -> tuple[int, int]:
    """(the k-th largest of the long column ``x``, how many are greater), by four counts of at most 2 ** 16 groups."""
    high, above = 0, 0
    for shift in (48, 32, 16, 0):
        digit = (F.shiftright("x", shift) if shift == 48 else F.shiftright("x", shift).bitwiseAND(0xFFFF)).alias("d")
        rows = values if shift == 48 else values.where(F.shiftright("x", shift + _DIGIT) == high)
        for d, n in sorted(rows.groupBy(digit).count().collect(), reverse=True):
            if above + n >= k:
                high = d if shift == 48 else (high << _DIGIT) | d
                break
            above += n
    return high, above


class Line:
    """Who is in the sample: keys above ``key``, and of those equal to it the documents up to ``doc_id`` (null ids are last)."""

    def __init__(self, key: float, doc_id: int | None, nulls: bool):
        self.key, self.doc_id, self.nulls = key, doc_id, nulls

    def takes(self, ids: pa.Array, key: np.ndarray) -> np.ndarray:
        tied = np.array([self.nulls if i is None else self.doc_id is not None and i <= self.doc_id for i in ids.to_pylist()], dtype=bool)
        return (key > self.key) | ((key == self.key) & tied)


def _line(keys: DataFrame, k: int) -> Line:
    """The line that leaves exactly k rows, or a few more where rows that repeat a doc_id and its key stand on it."""
    x, above = kth_largest(keys.select("x"), k)
    tied = keys.where(F.col("x") == x)
    key = tied.select("key").first()[0]
    n_tied, n_ids = tied.agg(F.count("*"), F.count("doc_id")).first()
    left = k - above
    if left >= n_tied or n_tied == 1:
        return Line(key, (1 << 63) - 1, True)
    if left > n_ids:
        return Line(key, (1 << 63) - 1, True)  # rows without an id can't be told apart
    last, _ = kth_largest(tied.where("doc_id is not null").select((-1 - F.col("doc_id")).alias("x")), left)
    return Line(key, -1 - last, False)


def _sample(batches, sent, seed: str, scale: Scale | None, line: Line | None, schema: pa.Schema):
    model = Resampler(sent, seed)
    for chunk in chunks(batches):
        at = chunk.schema.get_field_index
        ids = chunk.column(at("doc_id")).cast(pa.int64())
        n, weight = model.weights(chunk.column(at("text")))
        key = gumbel(ids.to_pylist(), seed) + (scale.normal(n, weight) if scale else 0.0)
        out = pa.RecordBatch.from_arrays([*chunk.columns, pa.array(weight), pa.array(key)], schema=schema)
        yield out if line is None else out.filter(pa.array(line.takes(ids, key)))


def target_ids(labels: DataFrame, most: int = TARGET_SAMPLE, seed: str = "target") -> tuple[list[int], list[int]]:
    """Labelled good documents (quality 1, toxic 0 in all their labels), at most about ``most``: those to count, and those held back."""
    good = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("q"), F.max("toxic").alias("t")).where("q = 1 and t = 0")
    n = good.count()
    share = min(1.0, most / max(n, 1))
    draw = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1_000_000))
    ids = sorted(r["doc_id"] for r in good.where(draw < int(share * 1_000_000)).select("doc_id").collect())
    ids.sort(key=lambda i: xxhash.xxh3_64_intdigest(f"{seed}-half:{i}"))
    return ids[::2], ids[1::2] or ids


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None, missed: float = MISSED, target_sample: int = TARGET_SAMPLE, seed: str = "gumbel") -> DataFrame:
    """The k sampled rows of ``docs`` with all their columns, plus log_weight and key (normalised log weight plus Gumbel draw).

    Three scans without a shuffle of text: one counts n-grams of all documents and of the target sample, one weighs all documents, one samples.
    The target sample is the one thing that is bounded (``target_sample`` documents). k is by default the number of documents whose
    weight reaches the line that all but a share of ``missed`` of the held-back target documents of their length reach; k or fewer rows give all. Equal keys go
    to the smaller doc_id, null last; rows that repeat a doc_id and text have one key, and where they stand at the k-th place they stay together.
    Rows that share a doc_id, or have none, share a draw. Null and empty texts have weight 0. With one labelled target document that one
    is counted and held back; with none, nothing is known of the target and every document stays. Columns log_weight and key in ``docs`` are replaced.
    """
    docs = docs.drop("log_weight", "key")
    spark = docs.sparkSession
    counted, held = target_ids(labels, target_sample)
    ids = spark.sparkContext.broadcast(np.array(counted, dtype=np.int64).tobytes())
    pairs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = folded(map_arrow(pairs, lambda it: _count(it, ids), PIECE_SCHEMA), PARTS, np.int64, np.add)
    size = BUCKETS // PARTS
    empty = np.zeros(2 * size, dtype=np.int64)
    got = [parts.get(p, empty) for p in range(PARTS)]
    raw, good = np.concatenate([g[:size] for g in got]), np.concatenate([g[size:] for g in got])
    expected = raw * (good.sum() / max(1, raw.sum()))
    ratio = np.log((good + SHRINK) / (expected + SHRINK)).astype(np.float32)
    sent = spark.sparkContext.broadcast(ratio.tobytes())
    kept = spark.sparkContext.broadcast(np.array(held, dtype=np.int64).tobytes())
    scale = line = None
    if counted:
        weighed = written(map_arrow(pairs, lambda it: _weigh(it, sent, kept, seed), _WEIGHED), "weighed")
        rows = weighed.where("held").groupBy("doc_id").agg(F.min("n").alias("n"), F.min("log_weight").alias("w")).collect()
        if rows:
            scale = fitted = Scale(np.array([r["n"] for r in rows]), np.array([r["w"] for r in rows]), missed)
            keys = written(map_arrow(weighed, lambda it: _keyed(it, fitted), "doc_id long, key double, x long, reaches boolean"), "keys")
            n, reach = keys.agg(F.count("*"), F.count(F.when(F.col("reaches"), 1))).first()
            k = reach if k is None else k
            if k < n:
                line = _line(keys, k) if k > 0 else Line(float("inf"), None, False)
            discard(keys)
        discard(weighed)
    out = StructType([*docs.schema.fields, StructField("log_weight", DoubleType()), StructField("key", DoubleType())])
    arrow = to_arrow_schema(out)
    return map_arrow(docs, lambda it: _sample(it, sent, seed, scale, line, arrow), out)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return resample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).drop("text")
