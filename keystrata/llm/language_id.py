"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. A word's probability is the
sum over all its segmentations into pieces, which a forward algorithm takes in one go; a text's is the product over its
words. Pieces are bytes, so every word has a segmentation. The piece probabilities are learned by expectation
maximisation (forward-backward) from word counts of a bounded sample of labelled rows.

Words are runs of letters (A-Z lower-cased, all bytes beyond ASCII), preceded by a space, as the vocabulary
has them. A word is scored whole, whatever its length, as in scripts without spaces: all words of a chunk advance together, byte by byte, and
keep only as many values as the longest piece has bytes.
"""

from __future__ import annotations

import base64
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keystrata.llm.shared import map_arrow
from keystrata.llm.textbytes import Texts, Words, byte_set, chunks, run_hashes

#: Default path of the vocabulary (one base64 piece and its rank a line), read on the driver.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Bounds of what is learned from: about so many labelled rows of each language, of their distinct words so many (the most frequent),
#: of longer words parts of so many bytes. Rounds of expectation maximisation; pseudo-count of a piece.
SAMPLE, LEARN_WORDS, LEARN_BYTES, ROUNDS, PSEUDO = 400, 100_000, 128, 3, 0.05
#: What is broadcast has 4 bytes for each piece and language; more languages are refused.
MOST_LANGUAGES = 400
#: Words whose scores a worker remembers, and cells of the lattice that it holds.
CACHE, CELLS = 400_000, 1 << 22
_LETTERS = byte_set((ord("a"), ord("z")), (0x80, 0xFF))
_ASCII_LETTERS = byte_set((ord("a"), ord("z")), (ord("A"), ord("Z")))
_SLOTS = 1 << 20


def read_vocabulary(path: str) -> list[bytes]:
    """The pieces that can stand in a word: letters, preceded by a space or not."""
    with open(path, "rb") as f:
        pieces = [base64.b64decode(line.split()[0]) for line in f if line.strip()]
    return [p for p in pieces if p and p != b" " and _LETTERS[np.frombuffer(p[1:] if p[:1] == b" " else p, dtype=np.uint8)].all()] + [b" "]


class Pieces:
    """Looks up many byte strings at once. A piece is in the first table unless its slot was taken; then it is in the second."""

    def __init__(self, pieces: list[bytes]):
        self.pieces, self.none = pieces, len(pieces)
        ends = np.cumsum([len(p) for p in pieces])
        starts = np.concatenate(([0], ends[:-1])) if len(pieces) else ends
        keys = np.append(run_hashes(np.frombuffer(b"".join(pieces), dtype=np.uint8), starts, ends), np.uint64(0))
        self.keys, self.lengths = keys, np.array(sorted({len(p) for p in pieces}), dtype=np.int64)
        self.longest = int(self.lengths[-1]) if len(pieces) else 1
        self.first = np.full(_SLOTS, self.none, dtype=np.int32)
        slot = (keys[:-1] & np.uint64(_SLOTS - 1)).astype(np.int64)
        self.first[slot[::-1]] = np.arange(len(pieces), dtype=np.int32)[::-1]
        rest = np.flatnonzero(self.first[slot] != np.arange(len(pieces)))
        self.rest = rest[np.argsort(keys[rest])]
        self.rest_keys = keys[self.rest]

    def find(self, h: np.ndarray) -> np.ndarray:
        at = self.first[(h & np.uint64(_SLOTS - 1)).astype(np.int64)]
        wrong = np.flatnonzero((self.keys[at] != h) & (at != self.none))
        if len(wrong):
            k = np.minimum(np.searchsorted(self.rest_keys, h[wrong]), max(0, len(self.rest) - 1))
            ok = self.rest_keys[k] == h[wrong] if len(self.rest) else np.zeros(len(wrong), dtype=bool)
            at[wrong] = np.where(ok, self.rest[k] if len(self.rest) else 0, self.none)
        at[self.keys[at] != h] = self.none
        return at

    def lattice(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, low: int, high: int) -> np.ndarray:
        """The piece (or none) of each word, each position from ``low`` to ``high`` (negative ones have none) and each length of a piece."""
        out = np.full((len(starts), high - low, len(self.lengths)), self.none, dtype=np.int32)
        at = np.arange(max(low, 0), high)
        for k, size in enumerate(self.lengths.tolist()):
            word, j = np.nonzero(at[None, :] + size <= sizes[:, None])
            if len(word):
                begin = starts[word] + at[j]
                out[word, at[j] - low, k] = self.find(run_hashes(data, begin, begin + size))
        return out


def _joined(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order, data, start, size) of the words, longest first."""
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    order = np.argsort(-sizes, kind="stable")
    sizes = sizes[order]
    return order, np.frombuffer(b"".join(words[i] for i in order.tolist()), dtype=np.uint8), np.cumsum(sizes) - sizes, sizes


def word_scores(words: list[bytes], pieces: Pieces, p: np.ndarray) -> np.ndarray:
    """Log probability of each word under each language; ``p`` has a row for each piece and one of zeros."""
    out = np.zeros((len(words), p.shape[1]))
    if not words or not p.shape[1]:
        return out
    order, data, starts, sizes = _joined(words)
    at, scores, span, lengths = 0, np.zeros((len(words), p.shape[1])), pieces.longest, pieces.lengths
    while at < len(words):  # as many words as the lattice of their first bytes has room for
        width = int(sizes[at]) + span
        to = min(len(words), at + max(1, CELLS // (min(width, 4 * span) * len(lengths))))
        scores[at:to] = _forward(data, starts[at:to], sizes[at:to], pieces, p)
        at = to
    out[order] = scores
    return out


def _forward(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, pieces: Pieces, p: np.ndarray) -> np.ndarray:
    """Words come longest first. ``alpha`` holds the last values of each word, by position modulo their number, over a scale."""
    span, lengths = pieces.longest, pieces.lengths
    ring, most = span + 1, int(sizes[0])
    block = max(3 * span, CELLS // (len(starts) * len(lengths)) - span)
    alpha = np.zeros((len(starts), ring, p.shape[1]))
    alpha[:, 0] = 1.0
    scale = np.zeros((len(starts), p.shape[1]))
    out = np.zeros((len(starts), p.shape[1]))
    alive = np.searchsorted(-sizes, -np.arange(most + 1), side="right")  # words of t bytes or more
    out[alive[1] if most else 0 :] = 0.0
    for low in range(0, most, block):
        high = min(most, low + block)
        n = int(alive[low + 1])
        found = pieces.lattice(data, starts[:n], sizes[:n], low - span, high)
        for t in range(low + 1, high + 1):
            n, k = int(alive[t]), int(np.searchsorted(lengths, t, side="right"))
            begin = t - lengths[:k]
            value = (alpha[:n, begin % ring] * p[found[:n, begin - low + span, np.arange(k)]]).sum(axis=1)
            alpha[:n, t % ring] = value
            done = int(alive[t + 1]) if t < most else 0
            with np.errstate(divide="ignore"):
                out[done:n] = np.log(value[done:]) + scale[done:n]
            if t % 8 == 0 and t < most:
                top = alpha[:done].max(axis=1)
                top[top == 0] = 1.0
                alpha[:done] /= top[:, None]
                scale[:done] += np.log(top)
    return np.maximum(out, -1e30)


def expected_counts(words: list[bytes], weights: np.ndarray, pieces: Pieces, p: np.ndarray) -> np.ndarray:
    """Expected uses of each piece over all segmentations of the words, for one language (forward-backward, in logarithms)."""
    out = np.zeros(len(pieces.pieces) + 1)
    order, data, starts, sizes = _joined(words)
    weights, lengths, at = weights[order], pieces.lengths, 0
    with np.errstate(divide="ignore"):
        log_p = np.log(p)
    while at < len(words):
        most = int(sizes[at])
        to = min(len(words), at + max(1, CELLS // 4 // max(1, most * len(lengths))))
        n, own = sizes[at:to], np.arange(to - at)
        found = pieces.lattice(data, starts[at:to], n, 0, most)
        alpha, beta = (np.full((to - at, most + 1), -np.inf) for _ in range(2))
        alpha[:, 0], beta[own, n] = 0.0, 0.0
        for t in range(1, most + 1):
            k = int(np.searchsorted(lengths, t, side="right"))
            begin = t - lengths[:k]
            alpha[:, t] = np.logaddexp.reduce(alpha[:, begin] + log_p[found[:, begin, np.arange(k)]], axis=1)
        for t in range(most - 1, -1, -1):
            k = int(np.searchsorted(lengths, most - t, side="right"))
            beta[:, t] = np.logaddexp(beta[:, t], np.logaddexp.reduce(beta[:, t + lengths[:k]] + log_p[found[:, t, :k]], axis=1))
        whole = alpha[own, n]
        for t in range(most):
            k = int(np.searchsorted(lengths, most - t, side="right"))
            piece = found[:, t, :k]
            use = np.exp(alpha[:, t, None] + log_p[piece] + beta[:, t + lengths[:k]] - whole[:, None]) * weights[at:to, None]
            out += np.bincount(piece.ravel(), weights=np.nan_to_num(use).ravel(), minlength=len(out))
        at = to
    out[-1] = 0.0
    return out


def _count_words(batches):
    for chunk in chunks(batches):
        words = Words(Texts(chunk.column(1), lower=True), _LETTERS)
        langs = chunk.column(0).to_pylist()
        counts: Counter = Counter()
        for i, lang in enumerate(langs):
            own = (words.bytes_of(k) for k in range(int(words.first[i]), int(words.first[i + 1])))
            counts.update((lang, w[j : j + LEARN_BYTES]) for w in own for j in range(0, len(w), LEARN_BYTES))
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["lang", "word", "n"])


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


class Model:
    def __init__(self, languages: list[str], pieces: list[bytes], p: np.ndarray):
        self.languages, self.pieces, self.p = languages, pieces, p


def learn(docs: DataFrame, sample: int = SAMPLE, vocabulary: str = VOCABULARY, most_words: int = LEARN_WORDS) -> Model:
    """Piece probabilities of each lang value in ``docs``, from about ``sample`` of its rows, chosen by a hash of doc_id.

    Of a language's sampled rows at most ``most_words`` distinct words go to the driver, the most frequent.
    """
    known = docs.where("lang is not null and text is not null and doc_id is not null")
    sizes = sorted((r["lang"], r["count"]) for r in known.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect())
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    pieces = Pieces(read_vocabulary(vocabulary))
    if not sizes:
        return Model([], pieces.pieces, np.zeros((len(pieces.pieces) + 1, 0)))
    draw = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1_000_000))
    share = F.create_map(*[F.lit(x) for lang, n in sizes for x in (lang, int(min(1.0, sample / n) * 1_000_000))])
    rows = map_arrow(known.where(draw < share[F.col("lang")]).select("lang", "text"), _count_words, "lang string, word binary, n long")
    often = rows.groupBy("lang", "word").agg(F.sum("n").alias("n")).withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "word"))).where(F.col("rank") <= most_words)
    counts: dict[str, Counter] = {lang: Counter() for lang, _ in sizes}
    for r in often.collect():
        counts[r["lang"]][b" " + bytes(r["word"])] += r["n"]
    p = np.zeros((len(pieces.pieces) + 1, len(sizes)))
    for k, (lang, _) in enumerate(sizes):
        words = sorted(counts[lang])
        weights = np.array([counts[lang][w] for w in words], dtype=np.float64)
        own = np.append(np.full(len(pieces.pieces), 1.0 / len(pieces.pieces)), 0.0)
        for _ in range(ROUNDS):
            got = expected_counts(words, weights, pieces, own)[:-1] + PSEUDO
            own = np.append(got / got.sum(), 0.0)
        p[:, k] = own
    return Model([lang for lang, _ in sizes], pieces.pieces, p.astype(np.float32))


def _identify(batches, sent):
    model = sent.value
    pieces = Pieces(model.pieces)
    languages = np.array(model.languages, dtype=object)
    known, scores = np.zeros(0, dtype=np.uint64), np.zeros((0, len(languages)), dtype=np.float32)
    for chunk in chunks(batches):
        texts = Texts(chunk.column(1), lower=True)
        n = len(texts)
        words = Words(texts, _LETTERS)
        h, at, inverse = np.unique(words.hashes(), return_index=True, return_inverse=True)
        new = ~np.isin(h, known, assume_unique=True)
        got = word_scores([b" " + words.bytes_of(int(k)) for k in at[new]], pieces, model.p)
        merged_h, merged = np.concatenate((known, h[new])), np.concatenate((scores, got.astype(np.float32)))
        order = np.argsort(merged_h)
        known, scores = merged_h[order], merged[order]
        value = scores[np.searchsorted(known, h)][inverse]
        owner = words.owner()
        total = np.stack([np.bincount(owner, weights=value[:, k], minlength=n) for k in range(len(languages))], axis=1) if len(languages) else np.zeros((n, 0))
        if len(known) > CACHE:
            known, scores = known[:0], scores[:0]
        ascii_letters = np.concatenate(([0], np.cumsum(_ASCII_LETTERS[texts.data])))
        some = ascii_letters[texts.offsets[1:]] > ascii_letters[texts.offsets[:-1]]
        for i in np.flatnonzero(~some & (words.counts > 0)).tolist():
            some[i] = any(c.isalpha() for c in texts.bytes_of(i).decode("utf-8", "replace"))
        if len(languages):
            best = total.argmax(axis=1)
            score = 1.0 / np.exp(total - total[np.arange(n), best][:, None]).sum(axis=1)
            pred = np.where(some, languages[best], "und")
            score = np.where(some, score, 0.0)
        else:
            pred, score = np.full(n, "und", dtype=object), np.zeros(n)
        yield pa.RecordBatch.from_arrays([*chunk.columns[:1], pa.array(pred.tolist(), pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) of each row of ``docs``: the likeliest language of its whole text and its posterior at equal priors.

    ``und`` with score 0 where the text is null or has no letter, or nothing was learned. Ties go to the first language by code
    point. Only the text counts. Repeated rows give repeated results; a null doc_id stays null; other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), lambda it: _identify(it, sent), "doc_id long, lang_pred string, score double")


def query(spark, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs, learn(docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0), vocabulary=vocabulary))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
