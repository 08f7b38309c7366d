"""Substring dedup with a count-min prefilter.

A window is `window` consecutive words of one text. Every window has a key: the smallest hash of the
runs of `gram` words inside it. Equal windows have equal keys, and neighbouring windows mostly share
theirs, so a text of n words has about 2 n / (window - gram) keys. Partition sketches count keys and
are merged; a key's estimate is never below the number of texts' stretches that hold any one of its
windows. A second pass takes only stretches whose key is estimated repeated and groups them exactly,
by the SHA-256 of their words, never by the hashes that the sketch counts:

1. whole stretches by the digest of all their words: every later copy is removed as it stands;
2. of keys with several different stretches, the first copy of each, window by window, by the digest of
   each window's words. Their texts are read a third time, by identifier.

Sums and minima are partial before they are shuffled, so that a passage in a third of all texts
sends a few rows a task; the few windows that very many texts have are looked up in a broadcast of at
most `_HOT` rows. If the corpus outgrows the largest sketch, more stretches are grouped exactly,
and the result stays the same.

Defined results: null text has no words; null ids count above all others and never remove each
other's words, nor do rows with one id; texts below one window stay whole, texts of any length are
judged whole; repeated rows are judged alike; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sketch
from .common import settle
from .textkernel import gram_hashes, row_text, row_words, text_chunks

_LAST = (1 << 63) - 1
#: Windows that more than a `_HOT`-th of all judged windows, and more than _OFTEN, are equal to: never more than `_HOT`.
_HOT, _OFTEN = 1000, 10_000


def _window_keys(words: np.ndarray, window: int, gram: int) -> np.ndarray:
    """Smallest gram hash in each window, by doubling."""
    low = gram_hashes(words, gram)
    m, width = window - gram + 1, 1
    while width * 2 <= m:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    rest = m - width
    return np.minimum(low[:-rest], low[rest:]) if rest else low


def stretches(column: pa.Array, window: int, gram: int):
    """Runs of windows of one row with one key: (first row, row of each, first word in its text, windows, key, first word in the chunk, the chunk)."""
    for a, b, buf, offsets in text_chunks(column):
        words, first = row_words(buf, offsets)
        if len(words) < window:
            continue
        keys = _window_keys(words, window, gram)
        row = np.repeat(np.arange(b - a), np.diff(first))
        inside = row[: len(keys)] == row[window - 1 :]
        change = np.ones(len(keys), bool)
        change[1:] = (keys[1:] != keys[:-1]) | (row[1 : len(keys)] != row[: len(keys) - 1]) | ~inside[:-1]
        change |= ~inside
        at = np.flatnonzero(change)
        size = np.diff(np.append(at, len(keys)))
        some = inside[at]
        at, size = at[some], size[some]
        yield a, row[at], at - first[row[at]], size, keys[at], at, (buf, offsets)


def _digest(data: bytes) -> bytes:
    return hashlib.sha256(data).digest()


_SPANS = "key long, digest binary, size int, id long, text_hash long, start int"


def repeated_spans(df: DataFrame, window: int, gram: int) -> DataFrame:
    """df: id, text_hash, text. Stretches whose key the sketch holds for repeated."""
    total = df.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = sketch.bits_for(total * 2 // (6 * (window - gram)))

    def count(batches):
        c = sketch.Counter(bits)
        for batch in batches:
            for _, _, _, _, keys, _, _ in stretches(batch.column(0), window, gram):
                c.add(keys)
                if c.held > 1 << 19:
                    yield sketch.tile_batch(list(c.tiles()))
        if c.held:
            yield sketch.tile_batch(list(c.tiles()))

    bitmap = sketch.merge(df.select("text").mapInArrow(count, sketch.TILES), bits, 2)
    sent = df.sparkSession.sparkContext.broadcast(bitmap)

    def take(batches):
        for batch in batches:
            ids = batch.column(0).fill_null(_LAST).to_numpy(zero_copy_only=False)
            hashes = batch.column(1).to_numpy(zero_copy_only=False)
            for a, row, start, size, keys, at, chunk in stretches(batch.column(2), window, gram):
                hit = sketch.test(sent.value, keys)
                if not hit.any():
                    continue
                row, start, size, keys, at = row[hit], start[hit], size[hit], keys[hit], at[hit]
                text, where, _ = row_text(*chunk)
                text = memoryview(text)
                digests = [_digest(text[x:y]) for x, y in zip(where[at].tolist(), where[at + size + window - 1].tolist())]
                cols = [keys.view(np.int64), digests, size.astype(np.int32), ids[a + row], hashes[a + row], start.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, cols)], names=[f.split()[0] for f in _SPANS.split(", ")])

    return df.select("id", "text_hash", "text").mapInArrow(take, _SPANS)


_WINDOWS = "w binary, id long, text_hash long, start int"


def span_windows(df: DataFrame, spans: DataFrame, window: int) -> DataFrame:
    """(digest, id, text_hash, start) of each window of the spans (id, text_hash, start, size), out of the texts df: id, text_hash, text."""
    wanted = settle(spans.groupBy("id", "text_hash").agg(F.sort_array(F.collect_set(F.struct("start", "size"))).alias("c")), "wanted")
    bitmap = sketch.bitmap_of(wanted.select("text_hash").distinct(), min(26, sketch.bits_for(wanted.count())))
    sent = df.sparkSession.sparkContext.broadcast(bitmap)

    def near(batches):
        for batch in batches:
            yield batch.filter(pa.array(sketch.test(sent.value, batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))))

    some = df.select(F.coalesce("id", F.lit(_LAST)).alias("id"), "text_hash", "text").mapInArrow(near, "id long, text_hash long, text string")
    k, h = F.col("id").alias("k"), F.col("text_hash").alias("h")
    both = some.join(wanted.select(k, h, F.col("c.start").alias("starts"), F.col("c.size").alias("sizes")), (F.col("id") == F.col("k")) & (F.col("text_hash") == F.col("h")))

    def run(batches):
        names = [f.split()[0] for f in _WINDOWS.split(", ")]
        for batch in batches:
            for i, (key, mark, starts, sizes) in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 1, 3, 4)))):
                for _, _, buf, offsets in text_chunks(batch.column(2).slice(i, 1)):
                    text, where, _ = row_text(buf, offsets)
                text = memoryview(text)
                at = np.concatenate([np.arange(s, s + n) for s, n in zip(starts, sizes)])
                for a in range(0, len(at), 1 << 14):
                    b = at[a : a + (1 << 14)]
                    digests = [_digest(text[x:y]) for x, y in zip(where[b].tolist(), where[b + window].tolist())]
                    cols = [digests, np.full(len(b), key), np.full(len(b), mark), b.astype(np.int32)]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, cols)], names=names)

    return both.select("id", "text_hash", "text", "starts", "sizes").mapInArrow(run, _WINDOWS)


def repeats(df: DataFrame, window: int, gram: int) -> DataFrame:
    """(id, text_hash, start, size): windows, as runs of starts, that also start in a text with a smaller id."""
    spans = settle(repeated_spans(df, window, gram), "spans")
    same = ["key", "digest"]
    firsts = spans.groupBy(*same).agg(F.min("id").alias("low"), F.max("id").alias("high"))
    firsts = settle(firsts, "firsts")
    mixed = firsts.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("low").alias("a"), F.max("high").alias("z")).where("n > 1 and a < z").select("key", F.lit(True).alias("mixed"))
    firsts = firsts.join(mixed, "key", "left").where("mixed or low < high")
    judged = settle(spans.join(firsts, same).select("id", "text_hash", "start", "size", (F.col("id") > F.col("low")).alias("later"), "mixed"), "judged")
    copies = judged.where("later").select("id", "text_hash", "start", "size")
    single = settle(span_windows(df, judged.where("not later and mixed"), window), "windows")
    lows = settle(single.groupBy("w").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count(F.lit(1)).alias("n")).where("low < high"), "lows")
    often = max(_OFTEN, single.count() // _HOT)
    marked = single.join(F.broadcast(lows.where(F.col("n") > often).select("w", "low")), "w", "left")
    rest = marked.where("low is null").drop("low").join(lows.where(F.col("n") <= often).select("w", "low"), "w")
    more = marked.where("low is not null").unionByName(rest).where("id > low").select("id", "text_hash", "start", F.lit(1).alias("size"))
    return copies.union(more)


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, gram: int = 16, with_text: bool = False) -> DataFrame:
    """One row per input row: id_col, n_words, n_removed, kept_sha256, with `with_text` also kept_text."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    cuts = repeats(rows, window, gram).groupBy("id", "text_hash").agg(F.collect_set(F.struct("start", "size")).alias("cuts"))
    cuts = settle(cuts, "cuts").withColumnRenamed("text_hash", "h").select(F.col("id").alias("k"), "h", F.col("cuts.start").alias("starts"), F.col("cuts.size").alias("sizes"))
    joined = rows.join(cuts, (F.coalesce("id", F.lit(_LAST)) == F.col("k")) & (F.col("text_hash") == F.col("h")), "left").select("id", "text", "starts", "sizes")

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for a in range(0, len(ids), 256):
                n, gone, digests, kept = [], [], [], []
                b = min(len(ids), a + 256)
                for text, starts, sizes in zip(*(batch.column(i).slice(a, b - a).to_pylist() for i in (1, 2, 3))):
                    words = (text or "").encode("utf-8", "surrogatepass").split()
                    n.append(len(words))
                    if starts:
                        edge = np.zeros(len(words) + 1, np.int64)
                        np.add.at(edge, np.array(starts), 1)
                        np.add.at(edge, np.array(starts) + np.array(sizes) + window - 1, -1)
                        stay = np.cumsum(edge)[:-1] == 0
                        words = [words[i] for i in np.flatnonzero(stay).tolist()]
                    gone.append(n[-1] - len(words))
                    out = b" ".join(words)
                    digests.append(hashlib.sha256(out).hexdigest())
                    if with_text:
                        kept.append(out.decode("utf-8", "surrogatepass"))
                cols = [ids.slice(a, b - a), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(digests, pa.string())]
                yield pa.RecordBatch.from_arrays(cols + [pa.array(kept, pa.string())] * with_text, names=names)

    names = [id_col, "n_words", "n_removed", "kept_sha256"] + ["kept_text"] * with_text
    return joined.mapInArrow(run, f"`{id_col}` long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text)
