"""Vectorised whole-text tokenising and hashing for Arrow batches.

Words are ``[^\\x20\\x09-\\x0D]+`` everywhere in this subpackage.  Texts are
read as one UTF-8 byte buffer per block of documents, and every per-word or
per-window value is a NumPy array over that buffer, so no Python object is
made per word.  All hashes are fixed functions of the bytes: they agree
between tasks, executors and reruns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes of text that are tokenised at once; bounds the arrays below.
BLOCK_BYTES = 2 << 20

_B = int.from_bytes(b"\x1d\x8e\x4e\x27\xc4\x7d\x12\x4f", "little")
_BINV = pow(_B, -1, 1 << 64)
_M1, _M2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F

SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finalising bijection (xor-shift-multiply), vectorised."""
    x = x + U64((seed * _M1 + 0x632BE59BD9B4E019) & (2**64 - 1))
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_T = mix(np.arange(256, dtype=U64), 7)
_T_LOWER = _T.copy()
_T_LOWER[65:91] = _T[97:123]

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept between calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        out = np.full(size, U64(base), dtype=U64)
        out[0] = 1
        have = _powers[base] = np.multiply.accumulate(out)
    return have[:n]


def string_buffer(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the n+1 offsets of a string column (null: empty)."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = pc.fill_null(arr, "")
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    _, offs, data = arr.buffers()
    offsets = np.frombuffer(offs, dtype=np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, dtype=np.uint8), offsets - offsets[0]
    return np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of at most ``limit`` bytes, or of one row."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n, i + BLOCK_DOCS)
        yield i, j
        i = j


class Words:
    """Words of a block of documents.

    ``start``/``end`` are byte positions in ``buf``; ``first`` has, for each
    document, the index of its first word, and one more entry at the end.
    """

    __slots__ = ("buf", "start", "end", "first")

    def __init__(self, buf: np.ndarray, offsets: np.ndarray):
        self.buf = buf
        solid = ~SPACE[buf]
        edge = np.zeros(len(buf) + 1, dtype=bool)
        edge[offsets] = True
        begin, finish = solid.copy(), solid.copy()
        if len(buf):
            begin[1:] &= ~solid[:-1] | edge[1:-1]
            finish[:-1] &= ~solid[1:] | edge[1:-1]
        self.start = np.flatnonzero(begin)
        self.end = np.flatnonzero(finish) + 1
        self.first = np.searchsorted(self.start, offsets)

    def __len__(self) -> int:
        return len(self.start)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self, lower: bool = False) -> np.ndarray:
        return spans(self.buf, self.start, self.end, lower)


def spans(buf: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each byte span; spans must not overlap and ascend."""
    out = np.zeros(len(start), dtype=U64)
    i = 0
    while i < len(start):  # pieces, so that the arrays stay small for a very long text
        j = int(np.searchsorted(end, start[i] + BLOCK_BYTES, side="right"))
        j = max(j, i + 1)
        lo, hi = int(start[i]), int(end[j - 1])
        total = np.zeros(hi - lo + 1, dtype=U64)
        np.cumsum((_T_LOWER if lower else _T)[buf[lo:hi]] * powers(_B, hi - lo), out=total[1:])
        s, e = start[i:j] - lo, end[i:j] - lo
        out[i:j] = (total[e] - total[s]) * powers(_BINV, hi - lo)[s] + (e - s).astype(U64) * U64(_M2)
        i = j
    return mix(out)


def grams(h: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """Hash of each k consecutive entries; len(h)-k+1 values."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=U64)
    base = (_M1 + 2 * seed * _M2) % 2**64 | 1
    total = np.zeros(len(h) + 1, dtype=U64)
    np.cumsum(h * powers(base, len(h)), out=total[1:])
    return mix((total[k:] - total[:-k]) * powers(pow(base, -1, 1 << 64), n), seed)


def grouped(binary_sizes: np.ndarray) -> np.ndarray:
    """Offsets of groups of these sizes."""
    out = np.zeros(len(binary_sizes) + 1, dtype=np.int64)
    np.cumsum(binary_sizes, out=out[1:])
    return out


def pack_bits(flags: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each group's flags as bytes of eight, low bit first; bytes and offsets."""
    sizes = np.diff(offsets)
    out = grouped((sizes + 7) // 8)
    at = np.flatnonzero(flags)
    group = np.searchsorted(offsets, at, side="right") - 1
    pos = at - offsets[group]
    data = np.bincount(out[group] + pos // 8, weights=np.left_shift(1, pos % 8), minlength=out[-1])
    return data.astype(np.uint8), out


def within(first: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of the n-k+1 windows over all words lie inside one document."""
    ok = np.ones(max(0, n - k + 1), dtype=bool)
    for edge in first[1:-1]:
        ok[max(0, edge - k + 1) : edge] = False
    return ok


#: Documents in a block at most, and bits of a shingle's hash: both share 64 bits.
BLOCK_DOCS, SHINGLE_BITS = 4096, 52


def shingles(words: Words, k: int = 5, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles of each document as ascending 52-bit hashes.

    A document of fewer than k words has its whole word sequence as its one
    shingle.  Returns the hashes and n+1 offsets by document.  One sort of
    (document, hash) keys serves for distinctness and for order.
    """
    h = words.hashes(lower)
    first, count = words.first, words.counts
    if len(count) > BLOCK_DOCS:
        raise ValueError(f"a block holds at most {BLOCK_DOCS} documents")
    g = grams(h, k)
    doc = words.doc()
    ok = within(first, k, len(h))
    short = np.flatnonzero((count > 0) & (count < k))
    tail = np.array([grams(h[first[d] : first[d + 1]], int(count[d]), 100 + int(count[d]))[0] for d in short], dtype=U64)
    key = np.concatenate([(doc[: len(g)].astype(U64) << U64(SHINGLE_BITS) | g >> U64(12))[ok], short.astype(U64) << U64(SHINGLE_BITS) | tail >> U64(12)])
    key.sort()
    keep = np.ones(len(key), dtype=bool)
    keep[1:] = key[1:] != key[:-1]
    key = key[keep]
    return key & U64((1 << SHINGLE_BITS) - 1), np.searchsorted(key >> U64(SHINGLE_BITS), np.arange(len(first), dtype=U64))


def cut(h: np.ndarray, size: int) -> bytes:
    """The low ``size`` bytes of each hash, sent to a shard beside the shard's number."""
    return np.ascontiguousarray(h.view(np.uint8).reshape(-1, 8)[:, :size]).tobytes()


def wide(sent: bytes, size: int) -> np.ndarray:
    out = np.zeros((len(sent) // size, 8), dtype=np.uint8)
    out[:, :size] = np.frombuffer(sent, dtype=np.uint8).reshape(-1, size)
    return out.reshape(-1).view(U64)


def binary_slices(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """An Arrow binary column: row i holds data[bounds[i]:bounds[i+1]]."""
    raw = np.ascontiguousarray(data)
    offs = (np.asarray(bounds, dtype=np.int64) * raw.itemsize).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(offs) - 1, [None, pa.py_buffer(offs), pa.py_buffer(raw)]).cast(pa.binary())
