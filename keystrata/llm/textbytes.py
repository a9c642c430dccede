"""Word splitting and hashing over whole Arrow text columns with numpy.

A column's texts lie one after another in one byte buffer, so a batch is split and hashed in a few
vector operations instead of word by word. UTF-8 keeps every ASCII separator a byte of its own, hence
the word classes below, which name ASCII characters only, can be applied to bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

U64 = np.uint64

#: Bytes of text that are handled at once; bounds what a Python worker holds (about 40 times as much).
CHUNK_BYTES = 1 << 20


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: ``[^\x20\x09-\x0D]``
NOT_SPACE = ~byte_set((0x20, 0x20), (0x09, 0x0D))
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]``: digits, a-z and everything beyond ASCII
ALNUM_LOWER = ~byte_set((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_WEYL, _MIX1, _MIX2 = 0x9E3779B97F4A7C15, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53

#: Window hashes are Rabin-Karp hashes modulo this prime, to this base.
PRIME = (1 << 61) - 1
_BASE = 0x0A3EC647659359AC
#: Another base, for a second hash that is independent of the first.
OTHER_BASE = 0x16E8FEB86659FD93
#: Words of more bytes are hashed one by one.
_LONG_WORD = 256


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that low and high bits are equally usable."""
    h = h ^ (h >> U64(33))
    h *= U64(_MIX1)
    h ^= h >> U64(33)
    h *= U64(_MIX2)
    h ^= h >> U64(33)
    return h


def _reduced(x: np.ndarray) -> np.ndarray:
    x = (x >> U64(61)) + (x & U64(PRIME))
    return np.where(x >= U64(PRIME), x - U64(PRIME), x)


def times(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    """a b modulo the prime, of numbers below it, by halves that fit 64 bits."""
    low, half = U64((1 << 31) - 1), U64((1 << 30) - 1)
    a1, a0, b1, b0 = a >> U64(31), a & low, b >> U64(31), b & low
    middle = a0 * b1 + a1 * b0
    return _reduced(a1 * b1 * U64(2) + (middle >> U64(30)) + ((middle & half) << U64(31)) + a0 * b0)


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo the prime."""
    held = _powers.get(base)
    if held is None:
        held = np.ones(1, dtype=U64)
    while len(held) < n:
        held = np.concatenate((held, times(held, U64(pow(base, len(held), PRIME)))))
    _powers[base] = held
    return held[:n]


def rolling(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = _BASE) -> np.ndarray:
    """The Rabin-Karp hash of each values[start:end] modulo the prime, from one prefix sum."""
    terms = times(_reduced(values), powers(base, len(values)))
    sums = np.zeros(len(values) + 1, dtype=U64)
    # both halves of 2 ** 32 terms fit 64 bits
    sums[1:] = _reduced(times(_reduced(np.cumsum(terms >> U64(32))), U64(1 << 32)) + _reduced(np.cumsum(terms & U64(0xFFFFFFFF))))
    return times(_reduced(sums[ends] + U64(PRIME) - sums[starts]), powers(pow(base, -1, PRIME), len(values) + 1)[starts])


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of the bytes of each data[start:end]: 8 bytes at a time are mixed in, over all runs at once.

    It isn't a polynomial of the bytes, so no pattern of text makes two runs of any length collide but by chance;
    runs of one length of up to 8 bytes never do.
    """
    sizes = ends - starts
    h = mix(sizes.astype(U64) * U64(_WEYL) + U64(seed))
    padded = np.concatenate((data, np.zeros(8, dtype=np.uint8)))
    eight = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    some, done = np.flatnonzero(sizes <= _LONG_WORD), 0
    while True:
        some = some[sizes[some] > done]
        if not len(some):
            break
        block, left = eight[starts[some] + done], sizes[some] - done
        short = left < 8
        block = np.where(short, block & ((U64(1) << (U64(8) * np.where(short, left, 0).astype(U64))) - U64(1)), block)
        h[some] = mix(h[some] ^ block)
        done += 8
    for k in np.flatnonzero(sizes > _LONG_WORD).tolist():
        h[k] = xxhash.xxh3_64_intdigest(data[starts[k] : ends[k]].tobytes(), seed=seed)
    return h


class Texts:
    """The texts of a chunk: ``data`` holds their bytes, ``offsets`` where each begins (and the last ends)."""

    def __init__(self, column: pa.Array, lower: bool = False):
        if column.null_count:
            column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
        wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
        _, offsets, data = column.buffers()
        n = len(column)
        kind = np.int64 if wide else np.int32
        if n == 0 or offsets is None:
            self.offsets, self.data = np.zeros(n + 1, dtype=np.int64), np.zeros(0, dtype=np.uint8)
        else:
            o = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + n + 1].astype(np.int64)
            raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
            self.data, self.offsets = raw[o[0] : o[-1]], o - o[0]
        if lower:
            self.data = LOWER[self.data]

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def bytes_of(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


class Words:
    """The words of a chunk's texts: maximal runs of bytes in ``member``, never across two texts."""

    def __init__(self, texts: Texts, member: np.ndarray):
        self.texts = texts
        inside = member[texts.data]
        n = len(inside)
        begins, finishes = inside.copy(), inside.copy()
        if n:
            cuts = texts.offsets[1:-1]
            cuts = cuts[(cuts > 0) & (cuts < n)]
            before = inside[:-1].copy()
            after = inside[1:].copy()
            before[cuts - 1] = False
            after[cuts - 1] = False
            begins[1:] &= ~before
            finishes[:-1] &= ~after
        self.starts = np.flatnonzero(begins)
        self.ends = np.flatnonzero(finishes) + 1
        #: words of text i are those from first[i] up to first[i + 1]
        self.first = np.searchsorted(self.starts, texts.offsets)
        self.counts = np.diff(self.first)

    def __len__(self) -> int:
        return len(self.starts)

    def owner(self) -> np.ndarray:
        """The text that each word belongs to."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self, seed: int = 0) -> np.ndarray:
        return run_hashes(self.texts.data, self.starts, self.ends, seed)

    def bytes_of(self, k: int) -> bytes:
        return self.texts.data[self.starts[k] : self.ends[k]].tobytes()


def windows(words: np.ndarray, first: np.ndarray, size: int, short: bool = False, base: int = _BASE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` consecutive words within a text.

    Returns (hash, first word, text) of each window. With ``short``, a text of fewer words, but not
    none, counts as one window.
    """
    counts = np.diff(first)
    n = np.maximum(counts - size + 1, 0)
    if short:
        n = np.where((counts > 0) & (counts < size), 1, n)
    text = np.repeat(np.arange(len(counts)), n)
    before = np.concatenate(([0], np.cumsum(n)))[:-1]
    start = np.arange(len(text)) - before[text] + first[:-1][text]
    end = np.minimum(start + size, first[1:][text])
    h = rolling(words, start, end, base) + (end - start).astype(U64) * U64(_WEYL)
    return mix(h), start, text


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Zero-copy slices of the batches with about ``most`` bytes of text each; a longer text stands alone and whole."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        offsets = Texts(batch.column(batch.schema.get_field_index(column))).offsets
        at = 0
        while at < n:
            to = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
            to = min(max(to, at + 1), n)
            yield batch.slice(at, to - at)
            at = to
