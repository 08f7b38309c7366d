"""Token-ID output: flat unsigned integer files with 64-bit document offsets.

Documents are range-partitioned by id and sorted; every task writes one pair of files. A file of ids
is nothing but little-endian unsigned integers, 2 bytes each where the vocabulary fits, else 4. Its
index has the document ids and the 64-bit offsets of the documents in the file. Bases of the
partitions are prefix sums over one manifest row per file, so a document's place among all ids is
its partition's base plus its offset. Local files are read through memory maps, others by ranges.

A task writes under a name of its own; only files named by the manifest count, so a task that runs
twice leaves at most a file that nothing refers to.

Defined results: null text counts as empty and still gets the end id; null ids sort first; rows
that repeat an id are written in the order of their texts' hashes; an empty table gives no files; other columns
are ignored.
"""

from __future__ import annotations

import json
import mmap
import re
import struct
import sys
import uuid
import zlib
from array import array
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lean_memory, open_fs, scratch, settle, spread, write_file

_HEAD = struct.Struct("<8sIIQQ")  # magic, bytes an id, version, documents, ids
_MAGIC = b"TOKIDS\x00\x01"
_MANIFEST = "part int, ids_file string, index_file string, n_docs long, n_ids long, width int"
def _head(width: int, docs: int, ids: int) -> bytes:
    return _HEAD.pack(_MAGIC, width, 1, docs, ids)


class WordTokenizer:
    """Encodes with the tokenizers library, each distinct piece of text once while it stays cached.

    That is right for vocabularies that lower-case texts, drop white space and never join letters and
    other marks, or text across white space; texts are then cut at ASCII white space and before marks
    that end a word of ASCII letters, and A-Z are lowered beforehand. A file with another normalizer or
    pre-tokenizer than `_KNOWN` has its texts encoded whole, as have texts that could hold a special
    token's string.
    """

    # The settings that the cuts are right for.
    _KNOWN = {
        "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
        "pre_tokenizer": {
            "type": "Sequence",
            "pretokenizers": [
                {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
                {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
            ],
        },
    }

    #: ASCII marks but the apostrophe, after a letter and up to the end of a word. The first mark is tested before the letter: that is twice as fast.
    _MARKS = rb"[!-&(-/:-@\[-`{-~](?<=[a-z].)[!-&(-/:-@\[-`{-~]*(?=[ \t\n\x0b\x0c\r]|$)"

    def __init__(self, path: str, cache: int = 800_000):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        parts = {k: getattr(self.tok, k) for k in self._KNOWN}
        added = self.tok.get_added_tokens_decoder().values()
        self.cuts = all(p is not None and json.loads(p.__getstate__()) == self._KNOWN[k] for k, p in parts.items()) and all(t.content.startswith("<|") and t.special for t in added)
        self.width = 2 if self.tok.get_vocab_size() <= 1 << 16 else 4
        self.code = "H" if self.width == 2 else "I"
        self.cut = re.compile(self._MARKS).sub
        marks = [(t.content.encode(), i) for i, t in self.tok.get_added_tokens_decoder().items() if t.special and not (t.normalized or t.lstrip or t.rstrip or t.single_word)]
        self.mark = next((m for m in marks if m[0].startswith(b"<|")), None)  # texts with "<|" don't come here
        self.cache: dict[bytes, bytes] = {}
        self.most = cache

    def _plain(self, texts: list[str]) -> list[bytes]:
        if sys.byteorder != "little":
            raise RuntimeError("files are little-endian; this machine is not")
        return [array(self.code, e.ids).tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[bytes]) -> list[bytes]:
        """Ids of single words, many to a call: joined by a special token, which keeps them apart, and cut at its id."""
        if self.mark is None:
            return self._plain([w.decode("utf-8", "surrogatepass") for w in words])
        text, mark = self.mark
        groups = [words[a : a + 256] for a in range(0, len(words), 256)]
        joined = [text.join(g).decode("utf-8", "surrogatepass") for g in groups]
        out: list[bytes] = []
        for group, e in zip(groups, self.tok.encode_batch_fast(joined, add_special_tokens=False)):
            ids = np.array(e.ids, f"<u{self.width}")
            at = np.flatnonzero(ids == mark)
            if len(at) != len(group) - 1:
                raise RuntimeError("a word's ids hold the mark between words")
            raw, cuts = ids.tobytes(), (at * self.width).tolist()
            out += [raw[a:b] for a, b in zip([0, *(c + self.width for c in cuts)], [*cuts, len(raw)])]
        return out

    def encode(self, texts: list[str], end_id: int) -> list[bytes]:
        """Each text's ids, the end id included, as they stand in the file."""
        cut, end = self.cut, array(self.code, [end_id]).tobytes()
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        split = [None if b"<|" in r or not self.cuts else cut(rb" \g<0>", r.lower()).split() for r in raw]
        seen = set().union(*[s for s in split if s])
        if len(self.cache) > self.most:  # what is in use now stays
            self.cache = {w: self.cache[w] for w in seen.intersection(self.cache)}
        new = list(seen.difference(self.cache))
        for a in range(0, len(new), 20_000):
            part = new[a : a + 20_000]
            self.cache.update(zip(part, self._words(part)))
        get = self.cache.__getitem__
        return [b"".join(self._plain([t]) if s is None else map(get, s)) + end for t, s in zip(texts, split)]


_TOKENIZERS: dict[str, WordTokenizer] = {}


def _tokenizer(path: str) -> WordTokenizer:
    if path not in _TOKENIZERS:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        lean_memory()
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def write_tokens(df: DataFrame, tokenizer: str, out_dir: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, batch_chars: int = 2_000_000) -> DataFrame:
    """Writes the files and returns the manifest with `base`, the ids of all files before each."""

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        tok = _tokenizer(tokenizer)
        name = f"{out_dir}/part-{part:06d}-{uuid.uuid4().hex[:8]}"
        ids_out, docs, nulls, lengths = [], [], [], []
        sink = None
        for batch in batches:
            keys = batch.column(0)
            docs.append(keys.fill_null(0).cast(pa.int64()).to_numpy(zero_copy_only=False))
            nulls.append(keys.is_null().to_numpy(zero_copy_only=False))
            texts = batch.column(1)
            a = 0
            sizes = np.asarray(pa.compute.fill_null(pa.compute.utf8_length(texts), 0))
            while a < len(texts):
                b = max(a + 1, a + int(np.searchsorted(np.cumsum(sizes[a:]), batch_chars)))
                ids_out = tok.encode([t or "" for t in texts.slice(a, b - a).to_pylist()], end_id)
                lengths += [len(x) // tok.width for x in ids_out]
                if sink is None:
                    fs, path = open_fs(f"{name}.bin")
                    fs.create_dir(path.rpartition("/")[0], recursive=True)
                    sink = fs.open_output_stream(path)
                sink.write(b"".join(ids_out))
                a = b
        if sink is None:
            return
        sink.close()
        ends = np.concatenate([[0], np.cumsum(np.array(lengths, np.uint64))]).astype("<u8")
        write_file(f"{name}.idx", [_head(tok.width, len(lengths), int(ends[-1])), np.concatenate(docs).astype("<i8").tobytes(), ends.tobytes(), np.concatenate(nulls).astype("u1").tobytes()])
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "ids_file": [f"{name}.bin"], "index_file": [f"{name}.idx"], "n_docs": [len(lengths)], "n_ids": [int(ends[-1])], "width": pa.array([tok.width], pa.int32())})

    rows = df.select(id_col, text_col)
    tie = F.xxhash64(text_col)
    ordered = rows.repartitionByRange(F.col(id_col).asc_nulls_first(), tie).sortWithinPartitions(F.col(id_col).asc_nulls_first(), tie)
    manifest = settle(ordered.mapInArrow(run, _MANIFEST), "manifest")
    return with_bases(manifest)


def with_bases(manifest: DataFrame) -> DataFrame:
    """Adds `base`: one row a file meets in the sum, so it stays small at any size of the corpus."""
    return manifest.withColumn("base", F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n_ids"))


class TokenFile:
    """One pair of files: ids(k) is the k-th document's ids, without reading the rest."""

    def __init__(self, ids_file: str, index_file: str):
        fs, path = open_fs(index_file)
        with fs.open_input_stream(path) as f:
            raw = f.read()
        magic, self.width, _, n, total = _HEAD.unpack_from(raw)
        if magic != _MAGIC or len(raw) != _HEAD.size + 17 * n + 8:
            raise ValueError(f"not an index of token ids: {index_file}")
        self.doc_ids = np.frombuffer(raw, "<i8", n, _HEAD.size)
        self.offsets = np.frombuffer(raw, "<u8", n + 1, _HEAD.size + 8 * n).astype(np.int64)
        self.null_id = np.frombuffer(raw, bool, n, _HEAD.size + 16 * n + 8)
        self.fs, self.path = open_fs(ids_file)
        if self.fs.type_name == "local":
            if Path(self.path).stat().st_size != total * self.width:
                raise ValueError(f"token file has another size than its index says: {ids_file}")
            with open(self.path, "rb") as f:
                self.map = np.frombuffer(mmap.mmap(f.fileno(), 0, prot=mmap.PROT_READ), f"<u{self.width}") if total else np.zeros(0, f"<u{self.width}")
        else:
            self.map, self.file = None, self.fs.open_input_file(self.path)

    def __len__(self) -> int:
        return len(self.doc_ids)

    def ids(self, k: int) -> np.ndarray:
        a, b = self.offsets[k], self.offsets[k + 1]
        if self.map is not None:
            return self.map[a:b]
        return np.frombuffer(self.file.read_at(int(b - a) * self.width, int(a) * self.width), f"<u{self.width}")


def read_tokens(manifest: DataFrame, ids: bool = False, most: int = 1 << 25) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files, with `ids` also its ids. A task reads about `most` ids of a file."""

    def run(batches):
        for batch in batches:
            for ids_file, index_file, base, k, parts in zip(*(batch.column(i).to_pylist() for i in range(5))):
                f = TokenFile(ids_file, index_file)
                end = len(f) * (k + 1) // parts
                for a in range(len(f) * k // parts, end, 4096):
                    b = min(end, a + 4096)
                    got = [f.ids(k) for k in range(a, b)]
                    cols = {
                        "doc_id": pa.array(f.doc_ids[a:b], mask=f.null_id[a:b]),
                        "start": pa.array(f.offsets[a:b] + base),
                        "n_tokens": pa.array(np.diff(f.offsets[a : b + 1])),
                        "ids_crc32": pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in got], pa.int64()),
                    }
                    if ids:
                        cols["ids"] = pa.array([x.astype(np.int64) for x in got], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_pydict(cols)

    files = manifest.select("ids_file", "index_file", "base", F.greatest(F.ceil(F.col("n_ids") / most), F.lit(1)).cast("int").alias("parts"))
    files = files.select("ids_file", "index_file", "base", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("k"), "parts")
    return spread(files.withColumn("at", F.xxhash64("ids_file", "k")), "at").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if ids else ""))


def tokenized(spark: SparkSession, df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, out_dir: str | None = None) -> DataFrame:
    """Writes df's texts and reads the files back."""
    manifest = write_tokens(df, tokenizer, out_dir or scratch(spark, "tokens"), id_col, text_col, end_id)
    return read_tokens(settle(manifest, "bases"))
