"""Exact Jaccard similarity join on word shingles, and the components of its links.

A document is the set of its distinct shingles. Equal sets (128 bits) are one node, so exact copies cost nothing further.
Shingles are ordered rare first, by how often all documents have them; two sets with the wanted similarity share a shingle
among their first few (prefix filtering), and only prefixes meet.

The order needs the count of every shingle. A scan sends each shingle once a buffer of documents, as a fingerprint of 32 bits
within a hash range; ranges and buffers have a bounded size, so their numbers grow with the text. A range counts its fingerprints and answers each
buffer with the counts of those that occur twice or more. All others come first in the order, and nothing can meet at them: so the answers
alone tell a node's prefix. Fingerprints that collide only make a shingle look more frequent, for all documents alike.

Links are then sought where prefixes meet, component by component: in each star round every node is compared with the
leader it shares most prefix shingles with, and what is linked becomes one component. The last round takes all pairs of nodes that
still are in different components and share a prefix shingle, after length and positional filters and a suffix filter on
short summaries of whole sets, so that the join's rows follow the links and not the square of a group. A pair within
a component need not be looked at, since its link could change nothing; no other pair is left out. Verification, once a pair,
applies a suffix filter on the sets' hashes, counts common hashes, and compares what passes word by word.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystrata.llm.graph import components
from keystrata.llm.shared import PIECE_SCHEMA, deltas, discard, filter_slots, folded, map_arrow, n_ranges_for, packed, pieces, released, unpacked, written
from keystrata.llm.textbytes import NOT_SPACE, Texts, Words, chunks, mix, windows

SHINGLE, PERCENT = 5, 80
#: Shingles that a scanning task holds before it sends them.
BUFFER = 1 << 21
#: Bytes from which on a batch of what a buffer sends is full.
SENT_BYTES = 1 << 20
#: Bits of the filter of candidates' doc_ids (2 MB are broadcast), and the parts it is folded in.
CANDIDATE_BITS, PARTS = 1 << 24, 64
STAR_ROUNDS = 1
#: Columns of 64 parity bits that summarise a set.
PARITY = ("p0", "p1", "p2", "p3")


class Sets:
    """The shingle sets of a chunk: ``h`` sorted within each text, of text i from first[i] to first[i + 1]."""

    def __init__(self, column: pa.Array, size: int):
        words = Words(Texts(column, lower=True), NOT_SPACE)
        h, _, text = windows(words.hashes(), words.first, size, short=True)
        order = np.lexsort((h, text))
        h, text = h[order], text[order]
        new = np.ones(len(h), dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
        self.h, self.text = h[new], text[new]
        self.first = np.searchsorted(self.text, np.arange(len(column) + 1))
        self.n = np.diff(self.first)

    def signature(self, seed: int) -> np.ndarray:
        """Equal sets have equal signatures: a sum of mixed hashes, mixed with the size."""
        sums = np.zeros(len(self.h) + 1, dtype=np.uint64)
        np.cumsum(mix(self.h ^ np.uint64(seed)), out=sums[1:])
        return mix((sums[self.first[1:]] - sums[self.first[:-1]]) + self.n.astype(np.uint64)).view(np.int64)

    def parity(self) -> list[np.ndarray]:
        """For each set the parities of its numbers of elements in 256 slots, as words of 64 bits."""
        slot = mix(self.h ^ np.uint64(0x2545F4914F6CDD1D)) >> np.uint64(56)
        bit, word = np.uint64(1) << (slot & np.uint64(63)), slot >> np.uint64(6)
        out = []
        for k in range(len(PARITY)):
            sums = np.zeros(len(self.h) + 1, dtype=np.uint64)
            np.bitwise_xor.accumulate(np.where(word == k, bit, np.uint64(0)), out=sums[1:])
            out.append((sums[self.first[1:]] ^ sums[self.first[:-1]]).view(np.int64))
        return out


#: Seeds of the two halves of a signature.
_SIG, _SIG2 = 0x5851F42D4C957F2D, 0x14057B7EF767814F
#: What a scan sends: documents of a buffer, fingerprints of a buffer for a range, and a range's answer to a buffer.
_DOCUMENTS, _POSTINGS, _ANSWER = 0, 1, 2
_SENT = "at int, kind int, buffer long, payload binary"
_SENT_ARROW = pa.schema([("at", pa.int32()), ("kind", pa.int32()), ("buffer", pa.int64()), ("payload", pa.binary())])


class _Buffer:
    """Documents and distinct sets of a part of a task's rows; nodes are numbered within it."""

    def __init__(self, name: int, n_ranges: int, seed: int):
        self.name, self.n_ranges, self.seed = name, n_ranges, seed
        self.docs: list[tuple] = []
        self.nodes: list[tuple] = []
        self.h: list[np.ndarray] = []
        self.node: list[np.ndarray] = []
        self.known: dict[tuple[int, int], int] = {}
        self.size = 0

    def add(self, ids: pa.Array, marks: pa.Array, sets: Sets) -> None:
        sig, sig2, parity = sets.signature(_SIG + self.seed), sets.signature(_SIG2 + self.seed), sets.parity()
        number = np.full(len(sets.n), -1, dtype=np.int64)
        valid = ids.is_valid().to_numpy(zero_copy_only=False)
        fresh = []
        for i in np.flatnonzero((sets.n > 0) & valid).tolist():
            key = (int(sig[i]), int(sig2[i]))
            number[i] = self.known.setdefault(key, len(self.known))
            if number[i] == len(self.known) - 1 and (not fresh or number[i] > number[fresh[-1]]):
                fresh.append(i)
        new = np.zeros(len(sets.n), dtype=bool)
        new[fresh] = True
        self.docs.append((ids.fill_null(0).to_numpy().astype(np.int64), valid.astype(np.uint8), marks.to_numpy().astype(np.int64), sets.n.astype(np.int64), number))
        self.nodes.append((sig[fresh], sig2[fresh], sets.n[fresh].astype(np.int64), *(p[fresh] for p in parity)))
        keep = new[sets.text]
        self.h.append(sets.h[keep])
        self.node.append(number[sets.text[keep]].astype(np.uint32))
        self.size += int(keep.sum()) + len(ids)

    def sent(self) -> Iterator[pa.RecordBatch]:
        """What the buffer holds, range by range in batches of about ``SENT_BYTES``; it is empty afterwards.

        Some 16 MB a column: so nothing is kept longer than needed, and what can be is computed in place.
        """
        docs = [np.concatenate(x) for x in zip(*self.docs, strict=True)]
        nodes = [np.concatenate(x) for x in zip(*self.nodes, strict=True)]
        key = np.concatenate(self.h)
        self.h.clear()
        node = np.concatenate(self.node)
        for held in (self.docs, self.nodes, self.node, self.known):
            held.clear()
        where = key >> np.uint64(32)
        where *= np.uint64(self.n_ranges)
        where &= ~np.uint64(0xFFFFFFFF)  # the range, in the upper half
        key &= np.uint64(0xFFFFFFFF)
        key |= where
        del where
        order = np.argsort(key, kind="stable")
        node = node[order]
        key = key[order]
        del order
        edges = np.searchsorted(key, np.arange(self.n_ranges + 1, dtype=np.uint64) << np.uint64(32))
        at, blobs, size = [], [], 0
        for r in np.flatnonzero(np.diff(edges)).tolist():
            a, b = edges[r], edges[r + 1]
            at.append(r)
            blobs.append(packed(deltas((key[a:b] & np.uint64(0xFFFFFFFF)).astype(np.uint32)), node[a:b]))
            size += len(blobs[-1])
            if size >= SENT_BYTES:
                yield self._batch(at, _POSTINGS, blobs)
                at, blobs, size = [], [], 0
        del key, node
        if at:
            yield self._batch(at, _POSTINGS, blobs)
        yield self._batch([-1 - self.name % self.n_ranges], _DOCUMENTS, [packed(*docs, *nodes)])

    def _batch(self, at: list[int], kind: int, blobs: list[bytes]) -> pa.RecordBatch:
        k = len(at)
        return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([kind] * k, pa.int32()), pa.array([self.name] * k, pa.int64()), pa.array(blobs, pa.binary())], schema=_SENT_ARROW)


def _scan(size: int, n_ranges: int, seed: int):
    def run(batches):
        first = TaskContext.get().partitionId() << 32  # a task that runs again gives its buffers the same names
        held = _Buffer(first, n_ranges, seed)
        for chunk in chunks(batches):
            held.add(chunk.column(0), chunk.column(2), Sets(chunk.column(1), size))
            if held.size >= BUFFER:
                yield from held.sent()
                held = _Buffer(held.name + 1, n_ranges, seed)
        if held.docs:
            yield from held.sent()

    return run


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of one range: the fingerprints that occur twice or more, with their counts, a row for each buffer that has some."""
    at, names, prints, nodes = 0, [], [], []
    for batch in batches:
        at = batch.column(0)[0].as_py() if batch.num_rows else at
        if at < 0:  # documents, which go on to their buffer
            yield batch
            continue
        for name, payload in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            delta, node = unpacked(payload)
            names.append(name)
            prints.append(np.cumsum(delta, dtype=np.uint32))
            nodes.append(node)
    if not names:
        return
    blob = np.repeat(np.arange(len(names), dtype=np.uint32), [len(x) for x in prints])
    prints, nodes = np.concatenate(prints), np.concatenate(nodes)
    order = np.argsort(prints, kind="stable")
    prints, nodes, blob = prints[order], nodes[order], blob[order]
    del order
    edges = np.flatnonzero(np.concatenate(([True], prints[1:] != prints[:-1], [True])))
    counts = np.diff(edges)
    often = np.repeat(counts, counts)
    some = often > 1
    prints, nodes, blob, often = prints[some], nodes[some], blob[some], often[some].astype(np.uint32)
    order = np.argsort(blob, kind="stable")
    prints, nodes, blob, often = prints[order], nodes[order], blob[order], often[order]
    edges = np.searchsorted(blob, np.arange(len(names) + 1))
    full = np.flatnonzero(np.diff(edges)).tolist()
    blobs = [packed(np.array([at], dtype=np.int64), deltas(prints[a:b]), nodes[a:b], often[a:b]) for a, b in ((edges[k], edges[k + 1]) for k in full)]
    yield pa.RecordBatch.from_arrays([pa.array([at] * len(full), pa.int32()), pa.array([_ANSWER] * len(full), pa.int32()), pa.array([names[k] for k in full], pa.int64()), pa.array(blobs, pa.binary())], schema=_SENT_ARROW)


_FOUND_FIELDS = [("doc_id", pa.int64()), ("mark", pa.int64()), ("n", pa.int32()), ("sig", pa.int64()), ("sig2", pa.int64()), *((p, pa.int64()) for p in PARITY), ("token", pa.int64()), ("pos", pa.int32()), ("is_doc", pa.bool_())]
_FOUND_ARROW = pa.schema(_FOUND_FIELDS)
_FOUND = f"doc_id long, mark long, n int, sig long, sig2 long, {' long, '.join(PARITY)} long, token long, pos int, is_doc boolean"


def _prefixes(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of one buffer: a row for each document, and one for each prefix shingle of a node that occurs elsewhere too."""
        own, answers = [], []
        for batch in batches:
            for kind, payload in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
                (own if kind == _DOCUMENTS else answers).append(unpacked(payload))
        ids, valid, marks, size, number, sig, sig2, n, *parity = own[0]
        some = number >= 0
        of = lambda a: pa.array(a[np.maximum(number, 0)] if len(a) else np.zeros(len(number), dtype=np.int64), mask=~some)
        k = len(ids)
        yield pa.RecordBatch.from_arrays([pa.array(ids, mask=valid == 0), pa.array(marks), pa.array(size.astype(np.int32)), of(sig), of(sig2), *map(of, parity), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int32()), pa.array([True] * k, pa.bool_())], schema=_FOUND_ARROW)
        if not answers:
            return
        token = np.concatenate([(a[0].astype(np.int64) << 32) | np.cumsum(a[1], dtype=np.uint32).astype(np.int64) for a in answers])
        node, often = np.concatenate([a[2] for a in answers]).astype(np.int64), np.concatenate([a[3] for a in answers])
        answers.clear()
        order = np.lexsort((token, often, node))
        token, node = token[order], node[order]
        del order, often
        shared = np.bincount(node, minlength=len(n))
        pos = np.arange(len(node)) - np.concatenate(([0], np.cumsum(shared)[:-1]))[node] + (n - shared)[node]
        keep = pos < (n - -(-(percent * n) // 100) + 1)[node]
        token, node, pos = token[keep], node[keep], pos[keep]
        new = np.ones(len(token), dtype=bool)  # colliding fingerprints of one set: the first position counts
        new[1:] = (token[1:] != token[:-1]) | (node[1:] != node[:-1])
        token, node, pos = token[new], node[new], pos[new]
        k = len(token)
        yield pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.array(n[node].astype(np.int32)), pa.array(sig[node]), pa.array(sig2[node]), *(pa.nulls(k, pa.int64()) for _ in PARITY), pa.array(token), pa.array(pos.astype(np.int32)), pa.array([False] * k, pa.bool_())], schema=_FOUND_ARROW)

    return run


def least_overlap(total: np.ndarray, percent: int) -> np.ndarray:
    """The least common shingles of two sets of together ``total`` that make them similar: 100 i >= percent (total - i)."""
    return -(-(percent * total) // (100 + percent))


def _in_filter(ids: np.ndarray) -> np.ndarray:
    return filter_slots(mix(ids.view(np.uint64)), CANDIDATE_BITS, 2)


def _filter_bits(batches):
    bits = np.zeros(CANDIDATE_BITS, dtype=bool)
    for batch in batches:
        bits[_in_filter(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)).ravel()] = True
    yield pieces([np.packbits(bits, bitorder="little")], PARTS)


def normal_words(text: bytes) -> bytes:
    """Lower-cased words, joined by one space."""
    return b" ".join(text.lower().split())  # bytes know ASCII letters and the six separators only


def _candidate_texts(size: int, seed: int, sent):
    schema = pa.schema([("doc_id", pa.int64()), ("sig", pa.int64()), ("words", pa.binary())])

    def run(batches):
        bits = np.frombuffer(sent.value, dtype=np.uint8)
        for batch in batches:
            s = _in_filter(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64))
            batch = batch.filter(pa.array(((bits[s >> 3] >> (s & 7).astype(np.uint8)) & 1).all(axis=1)))
            for chunk in chunks([batch]):
                sets, texts = Sets(chunk.column(1), size), Texts(chunk.column(1))
                some = np.flatnonzero(sets.n)
                yield pa.RecordBatch.from_arrays([chunk.column(0).take(pa.array(some)), pa.array(sets.signature(_SIG + seed)[some]), pa.array([normal_words(texts.bytes_of(i)) for i in some], pa.binary())], schema=schema)

    return run


def _texts_of(pairs: DataFrame, known: DataFrame, texts: DataFrame, size: int, seed: int) -> DataFrame:
    """(sig, words) of every node in ``pairs``, from one document that has it, as a table.

    A filter of fixed size over those documents' ids spares the others of a scan; a join then settles it.
    """
    nodes = pairs.select(F.col("u").alias("sig")).unionByName(pairs.select(F.col("v").alias("sig"))).distinct()
    holders = written(known.select("sig", F.col("least").alias("doc_id")).join(nodes, "sig"), "holders")
    bits = folded(map_arrow(holders.select("doc_id"), _filter_bits, PIECE_SCHEMA), PARTS, np.uint8, np.bitwise_or)
    none = np.zeros(CANDIDATE_BITS // 8 // PARTS, dtype=np.uint8)
    maybe = pairs.sparkSession.sparkContext.broadcast(np.concatenate([bits.get(p, none) for p in range(PARTS)]).tobytes())
    found = map_arrow(texts, _candidate_texts(size, seed, maybe), "doc_id long, sig long, words binary")
    out = written(found.join(holders, ["sig", "doc_id"]).select("sig", "words").dropDuplicates(["sig"]), "words")
    discard(holders)
    return out


def suffix_bound(a: np.ndarray, b: np.ndarray, depth: int = 2) -> int:
    """An upper bound of the number of common elements of two sorted sets, by splitting both at a's middle element."""
    if depth == 0 or not len(a) or not len(b):
        return min(len(a), len(b))
    mid = len(a) // 2
    at = int(np.searchsorted(b, a[mid]))
    same = int(at < len(b) and b[at] == a[mid])
    return suffix_bound(a[:mid], b[:at], depth - 1) + same + suffix_bound(a[mid + 1 :], b[at + same :], depth - 1)


def shingle_set(words: bytes, size: int) -> set[tuple[bytes, ...]]:
    """The shingles of normal words, as words."""
    w = words.split(b" ")
    return {tuple(w)} if len(w) < size else set(zip(*(w[k:] for k in range(size)), strict=False))


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sets of sorted hashes are similar."""
    need = int(least_overlap(np.int64(len(a) + len(b)), percent))
    if suffix_bound(a, b) < need:
        return False
    return len(a) + len(b) - len(np.union1d(a, b)) >= need


def _verified(size: int, percent: int):
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches):
        leader: tuple[bytes, set] = (b"", set())
        for chunk in chunks(batches, "b"):
            a, b = Sets(chunk.column(2), size), Sets(chunk.column(3), size)
            keep = [linked(a.h[a.first[i] : a.first[i + 1]], b.h[b.first[i] : b.first[i + 1]], percent) for i in range(chunk.num_rows)]
            for i in np.flatnonzero(keep).tolist():  # hashes agree; so do the words, but for collisions
                own, other = chunk.column(2)[i].as_py(), chunk.column(3)[i].as_py()
                if leader[0] != own:
                    leader = own, shingle_set(own, size)
                x, y = leader[1], shingle_set(other, size)
                keep[i] = len(x & y) >= int(least_overlap(np.int64(len(x) + len(y)), percent))
            yield pa.RecordBatch.from_arrays(chunk.columns[:2], schema=schema).filter(pa.array(keep, pa.bool_()))

    return run


def _links(pairs: DataFrame, words: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (u, v) of signatures that are similar; v's words are sent to u's, which may have many v."""
    of = words.withColumnRenamed("words", "b").withColumnRenamed("sig", "v")
    met = pairs.join(of, "v").join(words.select(F.col("sig").alias("u"), F.col("words").alias("a")), "u")
    return map_arrow(met.select("u", "v", "a", "b"), _verified(size, percent), "u long, v long")


def _similar_enough(n: str, pos: str, other_n: str, other_pos: str, percent: int):
    """Length filter, and positional filter: what can be common from this shingle on suffices if it is the first common one.

    A similar pair passes at its first common shingle; at later ones it may fail.
    """
    need = F.ceil((F.col(n) + F.col(other_n)) * percent / F.lit(100 + percent))
    rest = F.least(F.col(n) - F.col(pos), F.col(other_n) - F.col(other_pos))
    return (F.least(n, other_n) * 100 >= F.greatest(n, other_n) * percent) & (rest >= need)


def _differ_little(n: str, other_n: str, percent: int):
    """Suffix filter on summaries: two sets differ in as many elements at least as their parities differ in slots."""
    differ = " + ".join(f"bit_count({p} ^ s{p})" for p in PARITY)
    total = F.col(n) + F.col(other_n)
    return F.expr(differ) <= total - 2 * F.ceil(total * percent / F.lit(100 + percent))


def _star_pairs(placed: DataFrame, percent: int, turn: int) -> DataFrame:
    """(u, v): each node v with the leader u, of another component, that it shares most prefix shingles with.

    Every prefix shingle has one leader: in the first round the node that meets most others at its shingles, which is
    the likely original of a group of near copies; later one chosen by a hash that changes from round to round.
    Sizes and leaders are tables, so that their joins with a shingle that very many nodes have can be split.
    """
    if turn:
        placed = placed.withColumn("rank", F.xxhash64(F.lit(turn), "sig"))
    else:
        sizes = written(placed.groupBy("token").agg(F.count("*").alias("k")), "sizes")
        degree = placed.join(sizes, "token").groupBy("sig").agg((-F.sum("k")).alias("rank"))
        placed = placed.join(degree, "sig")
    lead = F.min(F.struct("rank", F.col("sig").alias("lead"), F.col("n").alias("lead_n"), F.col("pos").alias("lead_pos"), F.col("component").alias("lead_component")))
    leader = written(placed.groupBy("token").agg(lead.alias("l"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("token", "l.*").drop("rank"), "leaders")
    met = placed.drop("rank").join(leader, "token").where(F.col("component") != F.col("lead_component")).where(_similar_enough("n", "pos", "lead_n", "lead_pos", percent))
    shared = met.groupBy("sig", "lead").agg(F.count("*").alias("shared"))
    best = shared.groupBy("sig").agg(F.max(F.struct("shared", "lead")).alias("m"))
    return best.select(F.col("m.lead").alias("u"), F.col("sig").alias("v"))


def _open_pairs(placed: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """All pairs of nodes in different components that meet at a prefix shingle and pass the length, positional and suffix filters.

    Where a shingle's nodes are of one component there is nothing to do. Else the nodes outside the component that most
    of its nodes are in meet all others, so a group that is one component by now makes no pairs within itself.
    """
    sizes = placed.groupBy("token", "component").agg(F.count("*").alias("k"))
    main = sizes.groupBy("token").agg(F.max(F.struct("k", "component")).alias("m"), F.count("*").alias("c")).where("c > 1").select("token", F.col("m.component").alias("main"))
    open_ = placed.join(written(main, "mains"), "token")
    open_ = open_.join(nodes.select("sig", *PARITY), "sig")
    names = {"sig": "s", "n": "sn", "pos": "sp", "component": "sc"} | {p: f"s{p}" for p in PARITY}
    left = open_.where("component <> main").select("token", *[F.col(k).alias(v) for k, v in names.items()])
    met = left.join(open_, "token").where((F.col("component") != F.col("sc")) & ((F.col("component") == F.col("main")) | (F.col("sig") < F.col("s"))))
    met = met.where(_similar_enough("n", "pos", "sn", "sp", percent)).where(_differ_little("n", "sn", percent))
    return met.select(F.greatest("s", "sig").alias("u"), F.least("s", "sig").alias("v")).distinct()


def _classes(docs: DataFrame, size: int, percent: int, n_ranges: int | None) -> DataFrame:
    """(doc_id, mark, n, component, component_id) of each row of ``docs`` (doc_id, text, mark); component tells apart what shares a component_id."""
    n_ranges, seed = n_ranges or n_ranges_for(docs), 0
    while True:
        sent = map_arrow(docs, _scan(size, n_ranges, seed), _SENT)
        counted = sent.repartitionById(n_ranges, "at").groupBy("at").applyInArrow(released(_counted), _SENT)  # a task counts one range; by hash some would get several
        first = written(counted.repartition(n_ranges, "buffer").groupBy("buffer").applyInArrow(released(_prefixes(percent)), _FOUND), "prefixes")
        known = first.where("is_doc").select("doc_id", "mark", "n", "sig", "sig2", *PARITY)
        nodes = written(known.where("sig is not null").groupBy("sig", "sig2").agg(F.min("doc_id").alias("least"), *[F.min(p).alias(p) for p in PARITY]), "nodes")
        if nodes.groupBy("sig").agg(F.count("*").alias("k")).where("k > 1").isEmpty():
            break
        discard(first)  # half a signature names a node from here on, so two sets that share it need other seeds
        discard(nodes)
        seed += 1
    real = docs.where("doc_id is not null and text is not null")
    rows = first.where("not is_doc").select("token", "sig", "n", "pos")
    met = written(rows.groupBy("token").agg(F.min("sig").alias("lo"), F.max("sig").alias("hi")).where("lo <> hi").select("token"), "met")
    meetings = written(rows.join(met, "token").repartition("token", "sig").groupBy("token", "sig").agg(F.min("n").alias("n"), F.min("pos").alias("pos")), "meetings")
    place = written(meetings.select("sig").distinct().withColumn("component", F.col("sig")), "components")
    for turn in range(STAR_ROUNDS + 1):
        placed = written(meetings.join(place, "sig"), "placed") if turn else meetings.withColumn("component", F.col("sig"))
        pairs = written(_star_pairs(placed, percent, turn) if turn < STAR_ROUNDS else _open_pairs(placed, nodes, percent), "pairs")
        words = _texts_of(pairs, nodes, real, size, seed)
        links = _links(pairs, words, size, percent)
        as_edges = links.join(place.withColumnsRenamed({"sig": "u", "component": "a"}), "u").join(place.withColumnsRenamed({"sig": "v", "component": "b"}), "v")
        joined = components(as_edges.select(F.col("a").alias("u"), F.col("b").alias("v")))
        place = written(place.join(joined, place["component"] == joined["node"], "left").select("sig", F.coalesce(joined["component"], place["component"]).alias("component")), "components")
        for done in (pairs, words, *([placed] if turn else [])):
            discard(done)
    discard(met)
    discard(meetings)
    # of each node the least doc_id of its component, as tables: the joins then have a plain exchange on either side, so a hot key can be split
    by = nodes.select("sig", "least").join(place, "sig", "left").select("sig", "least", F.coalesce("component", "sig").alias("component"))
    least = written(by.groupBy("component").agg(F.min("least").alias("component_id")), "least")
    of = written(by.select("sig", "component").join(least, "component").select("sig", "component", "component_id"), "classes")
    some = known.where("sig is not null").join(of, "sig").select("doc_id", "mark", "n", "component", "component_id")
    rest = known.where("sig is null").select("doc_id", "mark", "n", F.lit(None).cast("long").alias("component"), F.col("doc_id").alias("component_id"))
    return some.unionByName(rest)


def _input(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("mark"))


def similar_components(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, n_ranges: int | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of ``docs``: the smallest doc_id that links reach, itself included.

    Two documents link if 100 |A and B| >= percent |A or B|. Null, empty and wordless texts have no shingles, link with nothing
    and are a component of their own; a text of fewer words than a shingle has one. Repeated rows and exact copies share a component;
    rows that repeat a doc_id with other words do so only if links reach. A row with a null doc_id takes no part and gets component null.
    Other columns are ignored, whatever their names. ``n_ranges`` bounds a counting task to 1 / n_ranges of all shingles (by default it follows the bytes
    of text). ``docs`` is read several times and has to give the same rows in the same order each time, as files do.
    """
    return _classes(_input(docs), size, percent, n_ranges).select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row of ``docs``, with all its columns, for each group of similar documents: the one with the smallest doc_id (then text hash).

    Wordless texts (null, empty, white space) are like nothing and stay, as rows with a null doc_id do. Rows that repeat a
    doc_id and its text are one document: one of them stays. Rows that repeat a doc_id with another text are documents of their own.
    """
    found = written(_classes(_input(docs), size, percent, None).where("component is not null").select("doc_id", "mark", "component"), "members")
    own = F.struct("doc_id", "mark")
    first = written(found.groupBy("component").agg(F.min(own).alias("first")), "firsts")
    id_, mark = (f"_{uuid.uuid4().hex}" for _ in range(2))  # no column of the caller's has these names
    others = written(found.join(first, "component").where(own != F.col("first")).select(F.col("doc_id").alias(id_), F.col("mark").alias(mark)).distinct(), "others")
    twice = written(found.groupBy("doc_id", "mark").agg(F.count("*").alias("k")).where("k > 1").select(F.col("doc_id").alias(id_), F.col("mark").alias(mark)), "repeated")
    rows = docs.withColumn(id_, F.col("doc_id").cast("long")).withColumn(mark, F.xxhash64("text"))
    kept = rows.join(others, [id_, mark], "left_anti")
    if not twice.isEmpty():
        kept = kept.join(twice, [id_, mark], "left_anti").unionByName(kept.join(twice, [id_, mark], "left_semi").dropDuplicates([id_, mark]))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    return similar_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS words FROM documents),
p AS (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM w WHERE len(words) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS g FROM p),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS origin, doc_id AS reached FROM w UNION SELECT r.origin, e.b FROM r JOIN e ON r.reached = e.a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id
FROM w LEFT JOIN n ON w.doc_id = n.doc_id JOIN (SELECT origin, min(reached) AS component_id FROM r GROUP BY origin) c ON c.origin = w.doc_id
"""
