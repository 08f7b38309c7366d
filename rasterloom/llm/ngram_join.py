"""N-gram Jaccard join as a blocked sparse matrix product.

Rows of the matrix are texts, columns are n-grams. Texts with equal word sequences are one row (a class,
told by SHA-256). The columns have one order for all: by the number of rows that have them, the rarest
first, and after all others those that are frequent in some task (so that no bucket fills up with one of
them). By size alone a row of n entries with a partner at similarity t shares one of its first
n - ceil(t n) + 1 columns, so only that part of the matrix is multiplied; columns of one row alone fill
most of it and are never listed:

1. entries are sorted by column and streamed; columns with one row go. Every other row is compared
   with its columns' first rows, whole, and labelled by the smallest it is linked with. That is linear
   in the entries and joins up large groups of near copies without their pairs.
2. The product proper: rows of columns that aren't all under one label are multiplied in blocks of
   about `block` by `block` rows, over all columns. Overlaps are accumulated strip by strip and pairs
   below the bound that follows from their sizes are discarded where they arise. No link across labels
   is lost, and links under one label change nothing. A block is written once to the shared folder; the
   task of a pair of blocks reads the two.

Columns are 64-bit hashes under a key that is drawn for each run, so that no text can be written to make
two of them collide; they find candidates. Whether two rows link is told by their words themselves
(`Shingles`), and so is what a class is. The order of the columns costs or saves time, never a link: it
only has to be the same for all rows.

Defined results: null or empty texts have size 0 and link with nothing; texts below n words are one
n-gram; texts of any length are taken whole; a row without id is a component of its own, null; rows that
repeat an id are one node of the graph but keep their own sizes; ties need no rule; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import secrets
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sketch
from .common import components, open_fs, scratch, settle, small_batches, tidy, write_file
from .textkernel import gram_hashes, row_digests, row_text, row_words, text_chunks, whole_hash


def gram_sets(column: pa.Array, n: int, key: int):
    """(row, sorted distinct n-gram hashes, digest of its words) of every row with words."""
    for a, b, buf, offsets in text_chunks(column):
        words, first = row_words(buf, offsets, lower=True, key=key)
        grams, digests, f = gram_hashes(words, n), row_digests(buf, offsets, lower=True), first.tolist()
        for k in range(b - a):
            size = f[k + 1] - f[k]
            if size >= n:
                g = np.sort(grams[f[k] : f[k + 1] - n + 1])
                yield a + k, g[np.concatenate([[True], g[1:] != g[:-1]])], digests[k]
            elif size:
                yield a + k, np.array([whole_hash(words[f[k] : f[k + 1]], salt=size)], np.uint64), digests[k]


def _class_of(digest: bytes) -> int:
    """What a class goes by in columns; the few classes that share it find each other's candidates, and are compared by their own words."""
    return int.from_bytes(digest[:8], "little", signed=True)


class Shingles:
    """The distinct n-grams of a text's words, for exact comparison: words are numbered by themselves, n-grams by the numbers of their words."""

    def __init__(self, text: bytes, n: int):
        self.words, self.n = text.split(), n

    @cached_property
    def steps(self):
        """(words' numbers, ranks of the runs of 2, 3 ... words); the last are the n-grams, or the whole text where it is shorter."""
        number: dict[bytes, int] = {}
        ids = np.array([number.setdefault(w, len(number)) for w in self.words], np.int64)
        self.sizes, tables, run = len(number), [], ids
        for k in range(1, min(self.n, len(ids))):
            table, run = np.unique(run[:-1] * len(number) + ids[k:], return_inverse=True)
            tables.append(table)
        return number, tables, int(run.max()) + 1

    def __len__(self) -> int:
        return self.steps[2]

    def common(self, text: bytes) -> tuple[int, int]:
        """(n-grams that both have, n-grams of the other)."""
        number, tables, _ = self.steps
        words = text.split()
        whole = min(self.n, len(words))
        other: dict[bytes, int] = {}
        ids = np.array([number.get(w, -1) for w in words], np.int64)
        own = np.array([other.setdefault(w, len(other)) for w in words], np.int64)
        run, mine, size = ids, own, 0
        for k in range(1, whole):
            mine = np.unique(mine[:-1] * len(other) + own[k:], return_inverse=True)[1]
        size = int(mine.max()) + 1
        if whole != min(self.n, len(self.words)):
            return 0, size
        for k, table in enumerate(tables, 1):
            code = np.where((run[:-1] >= 0) & (ids[k:] >= 0), run[:-1] * len(number) + ids[k:], -1)
            at = np.minimum(np.searchsorted(table, code), len(table) - 1)
            run = np.where(table[at] == code, at, -1)
        return len(np.unique(run[run >= 0])), size


def linked(a: Shingles, b: bytes, percent: int) -> bool:
    common, size = a.common(b)
    return 100 * common >= percent * (len(a) + size - common)


_SCAN = "gram long, cls long, digest binary, n int, doc long"


def scan_sets(df: DataFrame, n: int, key: int, often: int = 16, flush: int = 1 << 20) -> DataFrame:
    """One pass over id, text: (null, class, its digest, size, id) of each row and (n-gram, nulls, count, null) of n-grams seen `often` times in a task's stretch."""

    def run(batches):
        names = [f.split()[0] for f in _SCAN.split(", ")]
        held, total = [], 0

        def frequent():
            g, c = np.unique(np.concatenate(held), return_counts=True)
            hot = c >= often
            m = int(hot.sum())
            return pa.RecordBatch.from_arrays([pa.array(g[hot].view(np.int64)), pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary()), pa.array(c[hot].astype(np.int32)), pa.nulls(m, pa.int64())], names=names)

        for batch in batches:
            ids = batch.column(0)
            digests, cls, size = [b""] * len(ids), np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int32)
            for row, grams, digest in gram_sets(batch.column(1), n, key):
                digests[row], cls[row], size[row] = digest, _class_of(digest), len(grams)
                held.append(grams)
                total += len(grams)
                if total > flush:
                    yield frequent()
                    held, total = [], 0
            yield pa.RecordBatch.from_arrays([pa.nulls(len(ids), pa.int64()), pa.array(cls), pa.array(digests, pa.binary()), pa.array(size), ids], names=names)
        if held:
            yield frequent()

    return df.select("id", "text").mapInArrow(run, _SCAN)


_PACKED = "bucket int, task int, owners binary, counts binary, keys binary, doc int, cls long, n int, late int"
#: Bytes of an n-gram's hash that are sent beside its bucket. Hashes that agree in those count as one column: that adds pairs to verify and loses none.
_KEY = 4


def packed_grams(df: DataFrame, n: int, key: int, t: float, frequent: np.ndarray, bits: int, firsts: np.ndarray) -> DataFrame:
    """Every class's n-grams but the frequent ones, by hash bucket, packed; and a head row for each class.

    firsts: bitmap of the classes' smallest ids, so that hardly any class is sent twice; a task sends it once.

    A row is either a packed run (bucket >= 0: owners' numbers, counts and keys), a head (bucket -1:
    task, doc, cls, n, late), or the frequent n-grams of a class that could need them (bucket -2).
    """
    sent = df.sparkSession.sparkContext.broadcast((frequent, firsts))
    flush = max(1 << 20, 1 << (bits + 4))  # so that a bucket's run has some entries

    def run(batches):
        from pyspark import TaskContext

        (hot, known), task, seen = sent.value, TaskContext.get().partitionId(), set()
        names = [f.split()[0] for f in _PACKED.split(", ")]
        types = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.int64(), pa.int32(), pa.int32()]
        grams_held, sizes, first, rows, number = [], [], 0, [], 0

        def out():
            nonlocal first, rows, grams_held, sizes
            g = np.concatenate(grams_held) if grams_held else np.zeros(0, np.uint64)
            own = np.repeat(np.arange(len(sizes), dtype=np.uint32), sizes) + np.uint32(first)
            bucket = (g >> np.uint64(64 - bits)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            g, own, bucket = g[order], own[order], bucket[order]
            keys = np.ascontiguousarray(g.view(np.uint8).reshape(-1, 8)[:, :_KEY])
            cut = np.flatnonzero(np.diff(bucket)) + 1
            for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(g)]):
                if b > a:
                    o = own[a:b]
                    at = np.flatnonzero(np.concatenate([[True], o[1:] != o[:-1]]))
                    rows.append((int(bucket[a]), task, o[at].tobytes(), np.diff(np.append(at, b - a)).astype(np.uint32).tobytes(), keys[a:b].tobytes(), None, None, None, None))
            batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(types)], names=names)
            first, rows, grams_held, sizes = number, [], [], []
            return batch

        held = 0
        for batch in batches:
            some = batch.filter(pa.array(sketch.test(known, batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))))
            for _, grams, digest in gram_sets(some.column(1), n, key):
                if digest in seen:
                    continue
                seen.add(digest)
                cls = _class_of(digest)
                size, late = len(grams), np.zeros(0, np.int64)
                if len(hot[0]):
                    i = np.minimum(np.searchsorted(hot[0], grams), len(hot[0]) - 1)
                    place = np.where(hot[0][i] == grams, hot[1][i], np.uint64(0))
                    late = np.flatnonzero(place)
                rows.append((-1, task, None, None, None, number, cls, size, len(late)))
                if len(late):
                    if len(late) >= math.ceil(t * size - 1e-9):
                        rows.append((-2, task, place[late].astype("<u8").tobytes(), None, grams[late].tobytes(), number, cls, size, len(late)))
                    grams = grams[place == 0]
                grams_held.append(grams), sizes.append(len(grams))
                number += 1
                held += size
                if held > flush:
                    yield out()
                    held = 0
        if rows:
            yield out()

    return df.select("id", "text").where("id is not null").mapInArrow(run, _PACKED)


_REPEATED = "task int, doc int, df int, gram long, cls long, n int, late int"
_LATE = 1 << 30


def repeated_grams(packed: DataFrame) -> DataFrame:
    """(task, doc, df, gram) of n-grams that several rows have, df is how many; heads with df -1; frequent ones after all others."""

    def run(batches):
        names = [f.split()[0] for f in _REPEATED.split(", ")]
        now, held = None, []

        def none(m, k):
            return pa.nulls(m, k)

        def out():
            keys = np.frombuffer(b"".join(h[3] for h in held), np.uint8).reshape(-1, _KEY)
            wide = np.zeros((len(keys), 8), np.uint8)
            wide[:, :_KEY] = keys
            k = wide.view("<u8").ravel() | np.uint64(now) << np.uint64(8 * _KEY)
            counts = [np.frombuffer(h[2], np.uint32) for h in held]
            own = np.repeat(np.concatenate([np.frombuffer(h[1], np.uint32) for h in held]), np.concatenate(counts)).astype(np.int32)
            task = np.repeat(np.array([h[0] for h in held], np.int32), [int(c.sum()) for c in counts])
            order = np.argsort(k)
            k, own, task = k[order], own[order], task[order]
            at = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            df = np.repeat(np.diff(np.append(at, len(k))), np.diff(np.append(at, len(k))))
            on = df > 1
            for a in range(0, int(on.sum()), 1 << 16):
                s = slice(a, a + (1 << 16))
                cols = [task[on][s], own[on][s], np.minimum(df[on][s], _LATE - 1).astype(np.int32), k[on][s].view(np.int64)]
                m = len(cols[0])
                yield pa.RecordBatch.from_arrays([*map(pa.array, cols), none(m, pa.int64()), none(m, pa.int32()), none(m, pa.int32())], names=names)

        for batch in batches:
            c = [batch.column(i) for i in range(batch.num_columns)]
            kinds = c[0].to_numpy(zero_copy_only=False)
            heads = pa.array(np.flatnonzero(kinds == -1))
            if len(heads):
                m = len(heads)
                yield pa.RecordBatch.from_arrays([c[1].take(heads), c[5].take(heads), pa.array(np.full(m, -1, np.int32)), none(m, pa.int64()), c[6].take(heads), c[7].take(heads), c[8].take(heads)], names=names)
            for i in np.flatnonzero(kinds == -2).tolist():
                place, grams = (np.frombuffer(c[j][i].as_py(), "<u8") for j in (2, 4))
                m = len(grams)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(m, c[1][i].as_py(), np.int32)), pa.array(np.full(m, c[5][i].as_py(), np.int32)), pa.array((place + np.uint64(_LATE)).astype(np.int32)), pa.array(grams.view(np.int64)), none(m, pa.int64()), none(m, pa.int32()), none(m, pa.int32())], names=names)
            for i in np.flatnonzero(kinds >= 0).tolist():
                if kinds[i] != now:
                    if held:
                        yield from out()
                    now, held = int(kinds[i]), []
                held.append((c[1][i].as_py(), c[2][i].as_py(), c[3][i].as_py(), c[4][i].as_py()))
        if held:
            yield from out()

    # Heads and frequent ones are dealt by class: they need no company here.
    place = F.when(F.col("bucket") >= 0, F.col("bucket")).otherwise(F.pmod(F.xxhash64("cls"), F.lit(1 << 20)))
    return packed.repartition(place).sortWithinPartitions("bucket").mapInArrow(run, _REPEATED)


_ENTRIES = "gram long, cls long, n int, p int"


def prefix_entries(repeated: DataFrame, t: float) -> DataFrame:
    """(gram, class, set size, prefix length) of the shared columns in each row's prefix: n-grams of one row alone come first and aren't listed, then the others by rising df."""

    def run(batches):
        names = [f.split()[0] for f in _ENTRIES.split(", ")]
        rest: list[np.ndarray] | None = None
        for batch in batches:
            cols = [np.asarray(batch.column(i).fill_null(0)) for i in range(7)]
            cols = cols if rest is None else [np.concatenate([r, c]) for r, c in zip(rest, cols)]
            heads = np.flatnonzero(cols[2] == -1)
            last = heads[-1] if len(heads) else 0
            yield from done([c[:last] for c in cols], names)
            rest = [c[last:].copy() for c in cols]
        if rest is not None:
            yield from done(rest, names)

    def done(cols, names):
        at = np.flatnonzero(cols[2] == -1)
        if not len(at):
            return
        size = np.diff(np.append(at, len(cols[0])))
        n, late = cols[5][at].astype(np.int64), cols[6][at]
        frequent = np.add.reduceat((cols[2] >= _LATE).astype(np.int64), at)
        alone = n - late - (size - 1 - frequent)
        p = n - np.ceil(t * n - 1e-9).astype(np.int64) + 1
        take = np.clip(p - alone, 0, size - 1)
        if not take.any():
            return
        off = np.concatenate([[0], np.cumsum(take)])
        i = np.repeat(at + 1 - off[:-1], take) + np.arange(off[-1])
        own = np.repeat(np.arange(len(at)), take)
        yield pa.RecordBatch.from_arrays([pa.array(cols[3][i]), pa.array(cols[4][at][own]), pa.array(n[own].astype(np.int32)), pa.array(p[own].astype(np.int32))], names=names)

    return repeated.repartition("task", "doc").sortWithinPartitions("task", "doc", "df", "gram").mapInArrow(run, _ENTRIES)


_POSTS = "gram long, cls long, n int, p int, lead long, leads array<long>"
#: How many rows of a column every other row of it is compared with first.
LEADS = 2


def shared_columns(entries: DataFrame) -> DataFrame:
    """Entries of columns with several rows, each with its column's first row and the first LEADS rows before it."""

    def run(batches):
        names = [f.split()[0] for f in _POSTS.split(", ")]
        kept = None  # of the column that goes on: the first row while it is alone, else (gram, last class, first rows, rows so far)
        for batch in batches:
            g, c, n, p = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            if not len(g):
                continue
            lead, seen = [], 0
            if kept is not None and len(kept) == 1:
                g, c, n, p = (np.concatenate([[x], y]) for x, y in zip(kept[0], (g, c, n, p)))
            keep = np.ones(len(g), bool)  # one entry a row and column
            keep[1:] = (g[1:] != g[:-1]) | (c[1:] != c[:-1])
            if kept is not None and len(kept) == 4 and g[0] == kept[0]:
                keep[0] = c[0] != kept[1]
                lead, seen = kept[2], kept[3]
            if not keep.any():
                continue
            g, c, n, p = g[keep], c[keep], n[keep], p[keep]
            at = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
            if seen and g[0] != kept[0]:
                lead, seen = [], 0
            size = np.diff(np.append(at, len(g)))
            start = np.repeat(at, size)
            place = np.arange(len(g)) - start
            place[: size[0]] += seen
            firsts = np.zeros((len(g), LEADS), np.int64)
            for k in range(LEADS):
                firsts[:, k] = c[np.minimum(start + k, len(g) - 1)]
                own = lead[k] if k < len(lead) else c[min(k - len(lead), len(c) - 1)]
                firsts[: size[0], k] = own
            total = size.copy()
            total[0] += seen
            send = np.repeat(total > 1, size)
            last = len(g) - 1
            if total[-1] > 1:
                in_last = firsts[last].tolist()
                kept = (g[last], c[last], in_last[: min(LEADS, int(total[-1]))], int(total[-1]))
            else:
                kept = ((g[last], c[last], n[last], p[last]),)
            s = np.flatnonzero(send)
            if len(s):
                mask = place[s][:, None] > np.arange(LEADS)
                off = np.concatenate([[0], np.cumsum(mask.sum(1))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(off), pa.array(firsts[s][mask]))
                yield pa.RecordBatch.from_arrays([pa.array(g[s]), pa.array(c[s]), pa.array(n[s].astype(np.int32)), pa.array(p[s].astype(np.int32)), pa.array(firsts[s, 0]), lists], names=names)

    return entries.repartition(F.col("gram")).sortWithinPartitions("gram", "cls").mapInArrow(run, _POSTS)


def make_texts(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """(num, data): the words of the wanted classes (num, digest, doc), made anew where their texts are read."""
    count = wanted.count()
    bitmap = sketch.bitmap_of(wanted.select("doc"), min(26, sketch.bits_for(count)))
    sent = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches):
        for batch in batches:
            hit = sketch.test(sent.value, batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
            some = batch.filter(pa.array(hit))
            for a, b, buf, offsets in text_chunks(some.column(1)):
                text, at, first = row_text(buf, offsets, lower=True)
                ends = at[first].tolist()
                data = [text[x:y].tobytes() for x, y in zip(ends, ends[1:])]
                yield pa.RecordBatch.from_arrays([some.column(0).slice(a, b - a), pa.array(row_digests(buf, offsets, lower=True), pa.binary()), pa.array(data, pa.binary())], names=["doc", "digest", "data"])

    made = docs.select("id", "text").where("id is not null").mapInArrow(run, "doc long, digest binary, data binary")
    return made.join(wanted, ["digest", "doc"]).dropDuplicates(["num"]).select("num", "data")


def verify(pairs: DataFrame, texts: DataFrame, n: int, percent: int, salts: int = 32, share: int = 256) -> DataFrame:
    """Links (a, b) among pairs of classes, compared word by word; of the links that a task finds those that span its components.

    A row's text goes once to each of its tasks: `salts` of them, or one for `share` pairs where it has more.
    """
    many = pairs.groupBy(F.col("a").alias("k")).agg(F.count(F.lit(1)).alias("pairs")).where(F.col("pairs") > salts * share)
    of = F.coalesce(F.ceil(F.col("pairs") / share), F.lit(salts))
    right = pairs.join(many, F.col("a") == F.col("k"), "left").select("a", "b", F.pmod(F.xxhash64("b"), of).cast("int").alias("salt"))
    left = right.select("a", "salt").distinct().join(texts, F.col("a") == F.col("num")).select("a", "salt", F.lit(None).cast("long").alias("b"), "data")
    right = right.join(texts, F.col("b") == F.col("num")).select("a", "salt", "b", "data")
    both = left.union(right).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())

    def run(batches):
        now, mine, parent = None, None, {}
        for batch in batches:
            a_out, b_out = [], []
            for i, (a, salt, b) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(3)))):
                if b is None:
                    now, mine = (a, salt), Shingles(batch.column(3)[i].as_py(), n)
                elif now == (a, salt):
                    x, y = _root(parent, a), _root(parent, b)
                    if x != y and linked(mine, batch.column(3)[i].as_py(), percent):
                        parent[max(x, y)] = min(x, y)
                        a_out.append(a), b_out.append(b)
            if a_out:
                yield pa.RecordBatch.from_pydict({"a": pa.array(a_out, pa.int64()), "b": pa.array(b_out, pa.int64())})
            if len(parent) > 1 << 20:
                parent = {}

    return both.mapInArrow(run, "a long, b long")


def _root(parent: dict[int, int], v: int) -> int:
    while (up := parent.setdefault(v, v)) != v:
        parent[v] = v = parent[up]
    return v


def overlaps(rows: list[np.ndarray], others: list[np.ndarray]):
    """Strips of the product of two blocks' incidence matrices: (place of the row, its overlap with every other row)."""
    flat = np.concatenate(others)
    own = np.repeat(np.arange(len(others)), [len(x) for x in others])
    order = np.argsort(flat, kind="stable")
    flat, own = flat[order], own[order]
    for k, grams in enumerate(rows):
        lo, hi = np.searchsorted(flat, grams, "left"), np.searchsorted(flat, grams, "right")
        size = hi - lo
        some = size > 0
        lo, size = lo[some], size[some]
        off = np.concatenate([[0], np.cumsum(size)])
        yield k, np.bincount(own[np.repeat(lo - off[:-1], size) + np.arange(off[-1])], minlength=len(others))


def product(left: Block, right: Block, n: int, key: int, percent: int) -> list[tuple[int, int]]:
    """Links between rows of two blocks under different labels, those that join labels: overlaps say which may link, their words which do."""
    parent: dict[int, int] = {}
    found, exact = [], {}
    sets, others = ([g for _, g, _ in gram_sets(pa.array(b.data, pa.large_binary()).cast(pa.large_string()), n, key)] for b in (left, right))
    size = np.array([len(g) for g in others])
    for k, common in overlaps(sets, others):
        ok = (100 * common >= percent * (len(sets[k]) + size - common)) & (right.comp != left.comp[k])
        for m in np.flatnonzero(ok).tolist():
            x, y = _root(parent, int(left.comp[k])), _root(parent, int(right.comp[m]))
            if x == y:
                continue
            if k not in exact:
                exact = {k: Shingles(left.data[k], n)}
            if linked(exact[k], right.data[m], percent):
                parent[max(x, y)] = min(x, y)
                found.append((int(left.num[k]), int(right.num[m])))
    return found


class Block:
    """Rows of a block: classes, their labels, their words."""

    def __init__(self, num, comp, data: list[bytes]):
        self.num, self.comp, self.data = np.asarray(num, np.int64), np.asarray(comp, np.int64), data

    def pack(self) -> bytes:
        """Rows' number, classes, labels, lengths, words."""
        sizes = np.array([len(d) for d in self.data], np.int64)
        return b"".join([np.int64(len(sizes)).tobytes(), self.num.tobytes(), self.comp.tobytes(), sizes.tobytes(), *self.data])

    @classmethod
    def unpack(cls, raw: bytes) -> Block:
        n = int(np.frombuffer(raw, np.int64, 1)[0])
        num, comp, sizes = np.frombuffer(raw, np.int64, 3 * n, 8).reshape(3, n)
        off = np.concatenate([[0], np.cumsum(sizes)]) + 8 + 24 * n
        return cls(num, comp, [raw[x:y] for x, y in zip(off.tolist(), off[1:].tolist())])


def block_links(posts: DataFrame, texts: DataFrame, n: int, key: int, block: int, percent: int) -> DataFrame:
    """Links (a, b) across labels among rows that share a column; posts has their label `comp`.

    Rows of columns with the same first row form a group, which is cut in blocks of about `block`
    rows. A group of one block is multiplied where it is; of a larger one each block is written once,
    and each pair of blocks is a task's that reads the two. Their whole incidence matrices are
    multiplied, strip by strip, and of the pairs whose overlap reaches the bound for their sizes those
    that link and join components are kept.
    """
    spark = posts.sparkSession
    mixed = posts.groupBy("gram").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y").select("gram")
    rows = posts.join(mixed, "gram", "left_semi").groupBy("lead", "num").agg(F.first("comp").alias("comp"), F.first("n").alias("n"))
    # About `block` rows a block, and about a million n-grams where rows are long.
    large = rows.groupBy("lead").agg(F.ceil(F.greatest(F.count(F.lit(1)) / block, F.sum("n") / 1_000_000)).cast("int").alias("blocks"))
    rows = rows.drop("n").join(large, "lead").join(texts, "num").withColumn("own", F.pmod(F.xxhash64("num"), F.col("blocks")).cast("int"))
    folder, schema = scratch(spark, "blocks"), "a long, b long, lead long, own int, blocks int, path string, at long, size long"

    def write(batches):
        from pyspark import TaskContext

        name = f"{folder}/{TaskContext.get().partitionId()}-{TaskContext.get().taskAttemptId()}.bin"
        names = [f.split()[0] for f in schema.split(", ")]
        at, links, index, now, held, number = 0, [], [], None, [], 0

        def done():
            nonlocal at, number
            b = Block(*zip(*held)) if held else None
            if now[2] == 1:
                links.extend(product(b, b, n, key, percent))
            else:
                raw = b.pack()
                path = name.replace(".bin", f"-{number}.bin")
                write_file(path, [raw])
                index.append((*now, path, 0, len(raw)))
                number += 1

        def out():
            rows = [(a, b, *[None] * 6) for a, b in links] + [(None, None, *i) for i in index]
            batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)
            links.clear(), index.clear()
            return batch

        types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
        for batch in batches:
            for k, (lead, own, blocks, num, comp) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(5)))):
                if (lead, own, blocks) != now:
                    if now:
                        done()
                    now, held = (lead, own, blocks), []
                held.append((num, comp, batch.column(5)[k].as_py()))
            if len(links) + len(index) > 1 << 12:
                yield out()
        if now:
            done()
        if links or index:
            yield out()

    own = rows.select("lead", "own", "blocks", "num", "comp", "data").repartition("lead", "own").sortWithinPartitions("lead", "own", "num").mapInArrow(write, schema)
    own = settle(own, "blocked")
    ref = F.struct("own", "path", "at", "size")
    pairs = own.where("path is not null").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = pairs.groupBy("lead", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).agg(F.array_sort(F.collect_set(ref)).alias("refs"))

    def read(batches):
        def load(r):
            fs, path = open_fs(r["path"])
            with fs.open_input_file(path) as f:
                f.seek(r["at"])
                return Block.unpack(f.read(r["size"]))

        for batch in batches:
            for i, j, refs in zip(*(batch.column(c).to_pylist() for c in range(3))):
                if i == j or len(refs) == 2:  # a block may have got no rows
                    left = load(refs[0])
                    links = product(left, load(refs[1]) if len(refs) == 2 else left, n, key, percent)
                    if links:
                        yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    between = pairs.select("i", "j", "refs").repartition(F.xxhash64("lead", "i", "j")).mapInArrow(read, "a long, b long")
    return own.where("path is null").select("a", "b").union(between)


def near_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 75, block: int = 512, frequent: int = 1 << 18) -> DataFrame:
    """One row per input row: id_col, n_shingles, component_id (the smallest id reachable by links)."""
    with small_batches(df.sparkSession):
        return _near_components(df, id_col, text_col, n, percent, block, frequent)


def _near_components(df: DataFrame, id_col: str, text_col: str, n: int, percent: int, block: int, frequent: int) -> DataFrame:
    t, spark, key = percent / 100, df.sparkSession, secrets.randbits(64)
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    found = settle(scan_sets(docs, n, key), "sets")
    hot = found.where("gram is not null").groupBy("gram").agg(F.sum("n").alias("c")).orderBy(F.desc("c"), "gram").limit(frequent).collect()  # at most `frequent` rows
    table = np.array([r[0] for r in hot], np.int64).view(np.uint64)
    place = np.arange(len(table), 0, -1).astype(np.uint64)  # the most frequent has the last place
    by = np.argsort(table)
    hot_table = (table[by], place[by])
    nodes = found.where("gram is null").select(F.col("doc").alias("id"), "cls", "digest", F.col("n").alias("size"))
    # Classes get numbers of their own, since rows may repeat an id with another text; written, the numbers stay.
    classes = nodes.where("size > 0 and id is not null").groupBy("digest").agg(F.first("cls").alias("cls"), F.min("id").alias("doc"), F.first("size").alias("size"))
    classes = settle(classes.withColumn("num", F.monotonically_increasing_id()), "classes")
    total = nodes.agg(F.sum("size")).first()[0] or 0
    bits = min(20, max(5, int(total // 1_500_000).bit_length()))  # about a million n-grams a bucket
    firsts = sketch.bitmap_of(classes.select("doc"), min(26, sketch.bits_for(classes.count())))
    repeated = repeated_grams(packed_grams(docs, n, key, t, hot_table, bits, firsts))
    posts = settle(shared_columns(prefix_entries(repeated, t)), "columns")
    tidy(spark)
    posts = posts.join(classes.select("cls", "num", "size"), "cls").select("gram", "num", F.col("size").alias("n"), "lead", "leads")
    wanted = settle(posts.select("num").distinct().join(classes, "num").select("num", "digest", "doc"), "wanted")
    texts = settle(make_texts(wanted, docs), "words")
    # Each row against the first rows of its columns. Labels say what that joins; they needn't be complete.
    sized = F.least("na", "nb") >= F.greatest("na", "nb") * F.lit(t) - 1e-9
    star = posts.select(F.explode("leads").alias("l"), F.col("num").alias("b"), F.col("n").alias("nb")).distinct()
    star = star.join(classes.select(F.col("cls").alias("l"), F.col("num").alias("a"), F.col("size").alias("na")), "l").where(sized & (F.col("a") != F.col("b"))).select("a", "b")
    links = settle(verify(settle(star, "star"), texts, n, percent), "star-links")
    label = links.groupBy(F.col("b").alias("c")).agg(F.min("a").alias("m"))
    up = label.select(F.col("c").alias("d"), F.col("m").alias("m2"))
    label = label.join(up, F.col("m") == F.col("d"), "left").select("c", F.coalesce("m2", "m").alias("m"))
    posts = posts.join(label, F.col("num") == F.col("c"), "left").select("gram", "num", "n", "lead", F.coalesce("m", "num").alias("comp"))
    links = links.union(settle(block_links(settle(posts, "labelled"), texts, n, key, block, percent), "product"))
    tidy(spark)
    # From classes to ids: a class's smallest id stands for it.
    first = classes.select(F.col("num").alias("a"), F.col("doc").alias("doc_a"))
    other = classes.select(F.col("num").alias("b"), F.col("doc").alias("doc_b"))
    between = links.join(first, "a").join(other, "b").select(F.col("doc_a").alias("a"), F.col("doc_b").alias("b"))
    label = components(between, "near").select(F.col("id").alias("k"), "component_id")
    label = classes.select(F.col("digest").alias("d"), "doc").join(label, F.col("doc") == F.col("k"), "left").select("d", F.coalesce("component_id", "doc").alias("component_id"))
    out = nodes.join(label, (F.col("digest") == F.col("d")) & (F.col("size") > 0) & F.col("id").isNotNull(), "left")
    return out.select(F.col("id").alias(id_col), F.col("size").cast("long").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of df but for those in a group of near copies that isn't the group's smallest id, with all columns."""
    gone = near_components(df, id_col, text_col, **options).where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("__gone")).distinct()
    gone = settle(gone, "near-gone")
    return df.join(gone, df[id_col] == F.col("__gone"), "left_anti")
