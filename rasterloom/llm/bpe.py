"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

Texts become arrays of code point classes. A small automaton says where a piece begins; each class
is a function from states to states, and functions compose associatively: blocks of text compose
their functions side by side, the blocks' functions are scanned, and a second pass gives every
character its state. No regular expression runs. Pieces are looked up in a bounded cache of merged
pairs; their character ranges are retained so that a range of text can be matched with its ids.

Defined results: null text counts as empty and has no ids; texts of any length are encoded whole;
control strings in a text are ordinary text; ids in any order can be decoded; an empty table gives
an empty result; other columns pass through `encode` only if asked for.
"""

from __future__ import annotations

import base64
import hashlib
import sys
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import lean_memory

# Symbols
_L, _N, _P, _A2, _A3, _WMID, _WSP, _WOTHER, _RESET = range(9)
# States: between pieces; in letters; digits; others; white space; after a leading space; one or two letters of a contraction to come
_NONE, _INL, _INN, _INP, _INW, _LEAD, _C1, _C2 = range(8)
#: White space of the pattern's \s (fixed values: the White_Space property).
_SPACES = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_BLOCK = 256


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """next[symbol, state] and begins[symbol, state]."""
    nxt, beg = np.zeros((9, 8), np.uint8), np.ones((9, 8), bool)
    for sym, own in ((_L, _INL), (_N, _INN), (_P, _INP), (_WMID, _INW)):
        nxt[sym] = own
        beg[sym, own] = False
        if sym != _WMID:
            beg[sym, _LEAD] = False
    nxt[_L, _C2], nxt[_L, _C1] = _C1, _NONE
    beg[_L, [_C1, _C2]] = False
    for sym, ahead in ((_A2, _C1), (_A3, _C2)):
        nxt[sym] = ahead
        nxt[sym, [_INP, _LEAD]] = _INP
        beg[sym, [_INP, _LEAD]] = False
    nxt[_WSP], nxt[_WOTHER], nxt[_RESET] = _LEAD, _NONE, _NONE
    return nxt, beg


_NEXT, _BEGINS = _tables()
_CLASS: np.ndarray | None = None


def _classes() -> np.ndarray:
    """Class of each code point: 0 letter, 1 number, 2 other, 5 white space."""
    global _CLASS
    if _CLASS is None:
        kind = {"L": _L, "N": _N}
        table = np.fromiter((kind.get(unicodedata.category(chr(c))[0], _P) for c in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
        table[_SPACES] = _WMID
        _CLASS = table
    return _CLASS


def symbols(cp: np.ndarray, reset: np.ndarray) -> np.ndarray:
    """Symbols of code points; `reset` marks separators between texts."""
    sym = _classes()[np.where(reset, 0, cp)]
    sym[reset] = _RESET
    n = len(cp)
    space = sym == _WMID
    last = np.zeros(n, bool)
    last[:-1] = space[:-1] & ~space[1:] & ~reset[1:]
    sym[last] = np.where(cp[last] == 0x20, _WSP, _WOTHER)
    at = np.flatnonzero(cp == 0x27)
    at = at[~reset[at]]
    if len(at):
        padded = np.concatenate([np.where(reset, 0, cp), np.zeros(2, cp.dtype)])
        a, b = padded[at + 1], padded[at + 2]
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        sym[at[one]] = _A2
        sym[at[two & ~one]] = _A3
    return sym


def scan(sym: np.ndarray) -> np.ndarray:
    """Where a piece begins: composes the transition functions block by block, scans the blocks, then replays them."""
    n = len(sym)
    if not n:
        return np.zeros(0, bool)
    rows = -(-n // _BLOCK)
    grid = np.full(rows * _BLOCK, _RESET, np.uint8)
    grid[:n] = sym
    grid = np.ascontiguousarray(grid.reshape(rows, _BLOCK).T)
    flat = _NEXT.ravel()
    whole = np.broadcast_to(np.arange(8, dtype=np.uint8), (rows, 8)).copy()
    for s in grid:  # function of each block: composition of its symbols' functions
        whole = flat[(s.astype(np.intp) * 8)[:, None] + whole]
    into = np.zeros(rows, np.uint8)
    prefix, width = whole, 1
    while width < rows:  # associative scan over the blocks by doubling
        later = prefix.copy()
        later[width:] = np.take_along_axis(prefix[width:], prefix[:-width].astype(np.intp), 1)
        prefix, width = later, width * 2
    into[1:] = prefix[:-1, _NONE]
    out = np.empty(grid.shape, bool)
    begins, state = _BEGINS.ravel(), into
    for i, s in enumerate(grid):
        k = s.astype(np.intp) * 8 + state
        out[i] = begins[k]
        state = flat[k]
    return out.T.reshape(-1)[:n]


class Codec:
    """Ranks of a vocabulary file, with a bounded cache of encoded pieces."""

    def __init__(self, path: str, cache: int = 120_000):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.bytes_of = {v: k for k, v in self.ranks.items()}
        self.names = {v: str(v) for v in self.bytes_of}
        # Two generations: what the older one has and is used again moves on, the rest is dropped with it.
        self.cache: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.most = cache

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Merge the adjacent pair of lowest rank, leftmost first, until no pair has a rank."""
        ranks = self.ranks
        if (whole := ranks.get(piece)) is not None:
            return (whole,)
        if len(piece) > 96:
            return self._merge_long(piece)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        pairs = [ranks.get(a + b, 1 << 60) for a, b in zip(parts, parts[1:])]
        while pairs:
            low = min(pairs)
            if low == 1 << 60:
                break
            i = pairs.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i < len(pairs):
                pairs[i] = ranks.get(parts[i] + parts[i + 1], 1 << 60)
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], 1 << 60)
        return tuple(ranks[p] for p in parts)

    def _merge_long(self, piece: bytes) -> tuple[int, ...]:
        """The same with a heap, for pieces so long that searching them again and again would be quadratic."""
        import heapq

        ranks, n = self.ranks, len(piece)
        end = list(range(1, n + 1))  # end of the part that begins at i
        back = list(range(-1, n - 1))
        alive = [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not alive[i] or end[i] >= n or end[end[i]] != stop:
                continue
            gone = end[i]
            alive[gone] = False
            end[i] = stop
            if stop < n:
                back[stop] = i
                if (r := ranks.get(piece[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (b := back[i]) >= 0 and (r := ranks.get(piece[b:stop])) is not None:
                heapq.heappush(heap, (r, b, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return tuple(out)

    def ids_of(self, piece: str) -> tuple[int, ...]:
        got = self.cache.get(piece) or self.older.get(piece) or self.merge(piece.encode("utf-8", "surrogatepass"))
        if len(piece) <= 64:
            if len(self.cache) >= self.most:
                self.older, self.cache = self.cache, {}
            self.cache[piece] = got
        return got

    def pieces(self, texts: list[str]):
        """Per text its piece bounds in characters, an array that starts with 0 and ends with the length."""
        joined = "\x00".join(texts)
        cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        reset = np.zeros(len(cp), bool)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
        reset[starts[1:] - 1] = True
        at = np.flatnonzero(scan(symbols(cp, reset)))
        first = np.searchsorted(at, starts)
        last = np.searchsorted(at, starts + lengths)
        for k, s in enumerate(starts.tolist()):
            yield np.append(at[first[k] : last[k]] - s, lengths[k]) if lengths[k] else np.zeros(1, np.int64)

    def encode(self, texts: list[str]):
        """Per text (ids, piece bounds in characters)."""
        get, miss = self.cache.get, self.ids_of
        for text, bounds in zip(texts, self.pieces(texts)):
            ids: list[int] = []
            b = bounds.tolist()
            for s, e in zip(b, b[1:]):
                piece = text[s:e]
                ids += get(piece) or miss(piece)
            yield ids, bounds

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec a worker and vocabulary."""
    if path not in _CODECS:
        lean_memory()
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def _runs(texts: list[str], most: int = 1 << 20):
    """Consecutive texts of about `most` characters together."""
    a = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield a, i
            a, size = i, 0
        size += len(t) + 1
    if a < len(texts):
        yield a, len(texts)


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", bounds: bool = False) -> DataFrame:
    """(id_col, ids array<int>) per row, with `bounds` also the pieces' character bounds and their first ids' places."""

    def run(batches):
        c = codec(path)
        for batch in _parts(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in _runs(texts):
                ids, cuts, firsts = [], [], []
                for t, (i, at) in zip(texts[a:b], c.encode(texts[a:b])):
                    ids.append(np.array(i, np.int32))
                    if bounds:
                        cuts.append(at)
                        each = [len(c.cache.get(t[s:e]) or c.ids_of(t[s:e])) for s, e in zip(at, at[1:])]
                        firsts.append(np.concatenate([[0], np.cumsum(each)]) if each else np.zeros(1, np.int64))
                cols = [batch.column(0).slice(a, b - a), _lists(ids, np.int32)]
                cols += [_lists(cuts, np.int32), _lists(firsts, np.int32)] if bounds else []
                yield pa.RecordBatch.from_arrays(cols, names=names)

    names = [id_col, "ids", *(["bounds", "first_id"] if bounds else [])]
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, ids array<int>" + (", bounds array<int>, first_id array<int>" if bounds else "")
    return df.select(id_col, text_col).mapInArrow(run, schema)


def _parts(batches, rows: int = 512):
    """Batches in slices of a few rows, so that few texts are Python strings at a time."""
    for batch in batches:
        for a in range(0, len(batch), rows):
            yield batch.slice(a, rows)


def _lists(arrays: list[np.ndarray], dtype) -> pa.Array:
    off = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
    flat = np.concatenate(arrays).astype(dtype) if arrays else np.zeros(0, dtype)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(flat))


def decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id_col, decoded binary) per row; null ids decode to nothing."""

    def run(batches):
        c = codec(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.decode(i or ()) for i in batch.column(1).to_pylist()], pa.binary())], names=[id_col, "decoded"])

    return df.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, decoded binary")


def round_trip(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens, ids_sha256, decoded_sha256): encodes each text and decodes the ids again in one pass."""

    def run(batches):
        c = codec(path)
        for batch in _parts(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n, ids_sha, text_sha = [], [], []
            for a, b in _runs(texts):
                for ids, _ in c.encode(texts[a:b]):
                    n.append(len(ids))
                    ids_sha.append(hashlib.sha256(",".join(map(c.names.__getitem__, ids)).encode()).hexdigest())
                    text_sha.append(hashlib.sha256(c.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
