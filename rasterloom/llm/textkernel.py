"""Vectorised word and n-gram hashing over Arrow string columns."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

from .common import lean_memory

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.ones(256, bool)
_IN_WORD[[9, 10, 11, 12, 13, 32]] = False
_P = 0x9E3779B97F4A7C15
_Q = 0xD1342543DE82EF95 | 1
_M = (1 << 64) - 1
#: Bytes of text that are handled at a time; longer texts are handled whole.
CHUNK = 1 << 20


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Powers:
    """Powers of a base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse, self.n = base, pow(base, -1, 1 << 64), 0

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = max(n, CHUNK + 1)
            self.up, self.down = _powers(self.base, self.n), _powers(self.inverse, self.n)
        return self.up[:n], self.down[:n]


_GRAMS = _Powers(_Q)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit (splitmix64)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_chunks(column: pa.Array, chunk: int = CHUNK):
    """Split a string column into runs of rows of about `chunk` bytes: (first row, end row, bytes, offsets).

    Null texts count as empty. offsets has one entry more than there are rows, relative to the bytes.
    """
    lean_memory()
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + chunk, "right")) - 1)
        b = min(b, n)
        yield a, b, raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def find_words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word starts, word ends, and for each row the index of its first word (with the total at the end)."""
    inside = _IN_WORD[buf]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < len(buf))]
    begins[edge] |= inside[edge]
    ends[edge - 1] |= inside[edge - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


#: Words of more bytes are hashed one by one.
_SHORT = 64
_LEFT = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False, key: int = 0) -> np.ndarray:
    """64-bit hash of each word, of A-Z as a-z if `lower`.

    Eight bytes at a time go through a mixing step that isn't linear; words of one length up to eight
    bytes never collide. With a key that nobody knows beforehand no text can be made to collide on
    purpose. What two words with one hash are is for the caller to compare.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    p = np.zeros(len(buf) + 8, np.uint8)
    p[: len(buf)] = _LOWER[buf] if lower else buf
    eight = np.ndarray(len(buf) + 1, "<u8", p, 0, (1,))
    size = ends - starts
    h = mix((size.astype(np.uint64) + np.uint64(key & _M)) * np.uint64(_P))
    h = mix(h ^ (eight[starts] & _LEFT[np.minimum(size, 8)]))
    more, at = np.flatnonzero((size > 8) & (size <= _SHORT)), 8
    while len(more):
        h[more] = mix(h[more] ^ (eight[starts[more] + at] & _LEFT[np.minimum(size[more] - at, 8)]))
        at += 8
        more = more[size[more] > at]
    for i in np.flatnonzero(size > _SHORT).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(p[starts[i] : ends[i]], digest_size=8, key=(key & _M).to_bytes(8, "little")).digest(), "little")
    return h


def _pieces(buf: np.ndarray):
    """A long row cut at white space: (first byte, bytes). A word isn't cut."""
    a = 0
    while a < len(buf):
        b = min(a + CHUNK, len(buf))
        while b < len(buf) and _IN_WORD[buf[b]]:
            more = np.flatnonzero(~_IN_WORD[buf[b : b + 4096]])
            b = b + int(more[0]) if len(more) else min(b + 4096, len(buf))
        yield a, buf[a:b]
        a = b


def row_words(buf: np.ndarray, offsets: np.ndarray, lower: bool = False, key: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes, index of each row's first word, with the total at the end). A long row is cut at white space on the way."""
    if len(buf) <= 2 * CHUNK or len(offsets) > 2:
        starts, ends, first = find_words(buf, offsets)
        return word_hashes(buf, starts, ends, lower, key), first
    parts = []
    for _, piece in _pieces(buf):
        starts, ends, _ = find_words(piece, np.array([0, len(piece)]))
        parts.append(word_hashes(piece, starts, ends, lower, key))
    words = np.concatenate(parts)
    return words, np.array([0, len(words)])


def row_digests(buf: np.ndarray, offsets: np.ndarray, lower: bool = False) -> list[bytes]:
    """SHA-256 of each row's word sequence: the words' bytes, their lengths, their number. Empty for rows without words."""
    if lower:
        buf = _LOWER[buf]
    n = len(offsets) - 1
    if len(buf) <= 2 * CHUNK or n > 1:
        starts, ends, first = find_words(buf, offsets)
        size = (ends - starts).astype("<u4")
        off = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
        data, sizes = memoryview(buf[_IN_WORD[buf]]), memoryview(size)
        out = []
        for a, b, x, y in zip(first.tolist(), first[1:].tolist(), off[first].tolist(), off[first[1:]].tolist()):
            if a == b:
                out.append(b"")
                continue
            h = hashlib.sha256(data[x:y])
            h.update(sizes[a:b])
            h.update((b - a).to_bytes(8, "little"))
            out.append(h.digest())
        return out
    h, sizes = hashlib.sha256(), []
    for _, piece in _pieces(buf):
        starts, ends, _ = find_words(piece, np.array([0, len(piece)]))
        h.update(piece[_IN_WORD[piece]])
        sizes.append((ends - starts).astype("<u4"))
    size = np.concatenate(sizes)
    h.update(size)
    h.update(len(size).to_bytes(8, "little"))
    return [h.digest() if len(size) else b""]


def row_text(buf: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(the words' bytes, each word followed by one space; where each begins, and the end; each row's first word, and the end): what `row_words` hashes, to be compared."""
    if lower:
        buf = _LOWER[buf]
    if len(buf) <= 2 * CHUNK or len(offsets) > 2:
        starts, ends, first = find_words(buf, offsets)
        return *joined_words(buf, starts, ends), first
    parts, ats, base = [], [], 0
    for _, piece in _pieces(buf):
        starts, ends, _ = find_words(piece, np.array([0, len(piece)]))
        out, at = joined_words(piece, starts, ends)
        parts.append(out), ats.append(at[:-1] + base)
        base += len(out)
    at = np.append(np.concatenate(ats), base)
    return np.concatenate(parts), at, np.array([0, len(at) - 1])


def gram_hashes(words: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """Hash of every run of k consecutive words; entry i starts at word i. Runs may cross rows: callers mask those. Of more than eight words it is a polynomial, a filter only."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    if salt:
        words = mix(words ^ np.uint64(salt))
    if k <= 8:
        h = words[:n]
        for j in range(1, k):
            h = mix(h * np.uint64(_Q) + words[j : j + n])
        return mix(h)
    up, down = _GRAMS.get(len(words) + 1)
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[:-1], out=total[1:])
    return mix((total[k:] - total[:-k]) * down[:n])


def whole_hash(words: np.ndarray, salt: int = 0) -> int:
    """Hash of a whole word sequence of any length."""
    h = np.array([salt ^ len(words)], np.uint64)
    for w in words:
        h = mix(h * np.uint64(_Q) + w)
    return int(h[0])


def joined_words(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the words' bytes, each followed by a space; where each begins, and the end)."""
    size = ends - starts
    at = np.concatenate([[0], np.cumsum(size + 1)])
    out = np.full(int(at[-1]), 32, np.uint8)
    off = np.concatenate([[0], np.cumsum(size)])
    step = np.arange(int(off[-1]))
    out[step + np.repeat(at[:-1] - off[:-1], size)] = buf[step + np.repeat(starts - off[:-1], size)]
    return out, at
