"""WARC writing with revisit records, and a salvage reader.

Writer: one gzip member a record, files of at most `roll` bytes before a new one begins. Of records
with equal payloads the one with the smallest id is the response and the others revisit it; payload
digests and sizes alone are shuffled to find that, hot groups are cut by partial aggregation.

Reader: records are read one after another from compressed or plain archives. When a check fails
(member checksum, version line, header, length, digest) the reader looks for the next gzip member or
version line that starts a valid record, goes on from there and logs the bytes between as a
quarantined gap. Nothing but bytes in logged gaps is skipped. Files are read through a window, so
that memory is bounded by the largest record.

Defined results: a null payload is an empty one; payloads below `least` bytes are always responses;
null ids count above all others; of rows that repeat an id and a payload one is the response;
an empty table writes nothing; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import open_fs, scratch, settle, spread

_GZIP = b"\x1f\x8b\x08"
_VERSION = b"WARC/1."
_STEP = 1 << 20


# -- writer ---------------------------------------------------------------


def find_revisits(df: DataFrame, id_col: str, payload_col: str, least: int = 100) -> DataFrame:
    """(id, payload_digest, payload_bytes, refers_to) of the rows that revisit another."""
    data = F.coalesce(F.col(payload_col), F.lit(""))
    keys = df.select(F.col(id_col).alias("id"), F.sha2(data, 256).alias("digest"), F.octet_length(data).alias("size")).where(F.col("size") >= least)
    keys = settle(keys, "payloads")
    first = keys.groupBy("digest", "size").agg(F.min("id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return keys.join(first, ["digest", "size"]).select("id", F.col("digest").alias("payload_digest"), F.col("size").cast("long").alias("payload_bytes"), "refers_to")


def _record(kind: str, rid: str, url: str, payload: bytes, digest: str, refers: str | None, key: str) -> bytes:
    body = b"" if kind == "revisit" else payload
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{rid}>", "WARC-Date: 2024-01-01T00:00:00Z", f"WARC-Target-URI: {url}",
        f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(body).hexdigest()}", f"X-Payload-Length: {len(payload)}", f"X-Row-ID: {key}",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:uuid:{refers}>", f"X-Refers-To-Row: {refers_key(refers)}"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + body + b"\r\n\r\n"


def row_uuid(key) -> str:
    """A record id that follows from the row id, readable back with refers_key."""
    return str(uuid.UUID(int=((int(key) & ((1 << 64) - 1)) << 64) | 0x5741524352454344))


def refers_key(rid: str | None):
    if rid is None:
        return None
    v = uuid.UUID(rid).int >> 64
    return v - (1 << 64) if v >> 63 else v


def _safe(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")


def write_warc(df: DataFrame, out_dir: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 100, roll: int = 64 << 20, level: int = 4, compress: bool = True) -> DataFrame:
    """Writes the archives; returns (path, n_records, n_bytes), one row a file."""
    back = find_revisits(df, id_col, payload_col, least)
    # A row is its id's first copy unless the digest's response is another id; of rows repeating an id, one leads.
    twins = back.groupBy("id", "payload_digest").agg(F.first("refers_to").alias("refers_to"), F.count(F.lit(1)).alias("twins")).where("id <> refers_to or id is null or twins > 1")
    rows = df.select(F.col(id_col).alias("__id"), F.col(url_col).cast("string").alias("__url"), F.coalesce(F.col(payload_col), F.lit("")).alias("__data"))
    rows = rows.withColumn("__digest", F.sha2("__data", 256))
    twins = twins.select(F.col("id").alias("__tid"), F.col("payload_digest").alias("__td"), F.col("refers_to").alias("__refers"), "twins")
    rows = rows.join(twins, rows["__id"].eqNullSafe(F.col("__tid")) & (rows["__digest"] == F.col("__td")), "left")
    lead = F.lit(False)
    if not twins.where("twins > 1 and (__tid = __refers or __refers is null)").isEmpty():
        rows = rows.withColumn("__n", F.row_number().over(Window.partitionBy("__id", "__digest").orderBy("__url")))
        lead = (F.col("__n") == 1) & (F.col("__id").eqNullSafe(F.col("__refers")))
    refers = F.when(lead, F.lit(None)).otherwise(F.col("__refers"))
    rows = rows.select("__id", "__url", "__data", refers.alias("__refers"))

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        sink = path = fs = None
        n = size = 0
        for batch in batches:
            for key, url, data, refers in zip(*(batch.column(i) for i in range(4))):
                key, refers = key.as_py(), refers.as_py()
                payload = data.as_buffer().to_pybytes() if data.is_valid else b""
                digest = hashlib.sha256(payload).hexdigest()
                kind = "response" if refers is None else "revisit"
                rid = str(uuid.uuid4()) if key is None else row_uuid(key)
                rec = _record(kind, rid, _safe(url.as_py()), payload, digest, None if refers is None else row_uuid(refers), "" if key is None else str(key))
                if compress:
                    z = zlib.compressobj(level, zlib.DEFLATED, 31)
                    rec = z.compress(rec) + z.flush()
                if sink is not None and size + len(rec) > roll:
                    sink.close()
                    yield pa.RecordBatch.from_pydict({"path": [path], "n_records": [n], "n_bytes": [size]})
                    sink = None
                if sink is None:
                    path, n, size = f"{out_dir}/part-{part:06d}-{uuid.uuid4().hex[:8]}.warc" + ".gz" * compress, 0, 0
                    fs, local = open_fs(path)
                    fs.create_dir(local.rpartition("/")[0], recursive=True)
                    sink = fs.open_output_stream(local, compression=None)
                sink.write(rec)
                n, size = n + 1, size + len(rec)
        if sink is not None:
            sink.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "n_records": [n], "n_bytes": [size]})

    return settle(rows.mapInArrow(run, "path string, n_records long, n_bytes long"), "archives")


# -- reader ---------------------------------------------------------------


class _Bytes:
    """A window over a file: at(offset, n) reads no more than it must."""

    def __init__(self, path: str):
        fs, local = open_fs(path)
        self.file = fs.open_input_file(local)
        self.size = self.file.size()
        self.start, self.data = 0, b""

    def at(self, offset: int, n: int) -> bytes:
        n = max(0, min(n, self.size - offset))
        if not (self.start <= offset and offset + n <= self.start + len(self.data)):
            self.start, self.data = offset, self.file.read_at(min(max(n, _STEP), self.size - offset), offset)
        return self.data[offset - self.start : offset - self.start + n]

    def find(self, offset: int, ends: tuple[bytes, ...]) -> int:
        """The first place at or after offset where one of the marks begins, or the size."""
        while offset < self.size:
            part = self.at(offset, _STEP)
            hits = [i for m in ends if (i := part.find(m)) >= 0]
            if hits:
                return offset + min(hits)
            if offset + len(part) >= self.size:
                break
            offset += len(part) - max(map(len, ends)) + 1
        return self.size


class Bad(Exception):
    """A check failed."""


def _parse(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not re.fullmatch(r"WARC/1\.[01]", lines[0]):
        raise Bad("version line")
    out: dict[str, str] = {}
    for line in lines[1:]:
        name, sep, value = line.partition(":")
        if not sep:
            raise Bad("header line")
        out[name.strip().lower()] = value.strip()
    if "warc-type" not in out or not out.get("content-length", "").isdigit():
        raise Bad("header fields")
    return out


def _verify(head: dict[str, str], body: bytes) -> None:
    want = head.get("warc-block-digest", "")
    if want.startswith("sha256:") and hashlib.sha256(body).hexdigest() != want[7:]:
        raise Bad("block digest")


def _member(src: _Bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """The record in the gzip member at `at`, and where the member ends."""
    z = zlib.decompressobj(31)
    parts, pos = [], at
    try:
        while not z.eof:
            piece = src.at(pos, 1 << 16)
            if not piece:
                raise Bad("member cut off")
            parts.append(z.decompress(piece))
            pos += len(piece)
    except zlib.error as e:
        raise Bad("member checksum" if "check" in str(e) else "member") from None
    raw, end = b"".join(parts), pos - len(z.unused_data)
    cut = raw.find(b"\r\n\r\n")
    if cut < 0:
        raise Bad("header end")
    head = _parse(raw[:cut])
    n = int(head["content-length"])
    body = raw[cut + 4 : cut + 4 + n]
    if len(body) != n or raw[cut + 4 + n :] != b"\r\n\r\n":
        raise Bad("length")
    _verify(head, body)
    return head, body, end


def _plain(src: _Bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    if not re.fullmatch(rb"WARC/1\.[01]\r\n", src.at(at, 10)):
        raise Bad("version line")
    step = 1 << 16
    while (cut := src.at(at, step).find(b"\r\n\r\n")) < 0:
        if at + step >= src.size:
            raise Bad("header end")
        step *= 2
    head = _parse(src.at(at, cut))
    n, begin = int(head["content-length"]), at + cut + 4
    if begin + n + 4 > src.size:
        raise Bad("length")
    body = src.at(begin, n)
    if src.at(begin + n, 4) != b"\r\n\r\n":
        raise Bad("record end")
    _verify(head, body)
    return head, body, begin + n + 4


def salvage(path: str):
    """Yields ("record", offset, end, head, body) and ("gap", offset, end, reason, None), which together cover the file."""
    src = _Bytes(path)
    pos, lost, reason = 0, None, ""
    while pos < src.size:
        mark = src.at(pos, 8)
        try:
            if mark.startswith(_GZIP):
                head, body, end = _member(src, pos)
            elif mark.startswith(_VERSION):
                head, body, end = _plain(src, pos)
            else:
                raise Bad("no record begins here")
        except Bad as e:
            if lost is None:
                lost, reason = pos, str(e)
            pos = src.find(pos + 1, (_GZIP, _VERSION))
            continue
        if lost is not None:
            yield "gap", lost, pos, reason, None
            lost = None
        yield "record", pos, end, head, body
        pos = end
    if lost is not None:
        yield "gap", lost, src.size, reason, None


_READ = "path string, kind string, begins long, ends long, reason string, record_type string, row_id long, url string, payload_digest string, payload_bytes long, refers_to long, payload binary"


def read_warc(files: DataFrame, payload: bool = True) -> DataFrame:
    """Records and gaps of the archives in column `path`; kind is "record" or "gap".

    With a column `n_records`, what was written into each, a file that gives another number of records is an error.
    """

    def run(batches):
        names = [f.split()[0] for f in _READ.split(", ")]
        for batch in batches:
            for path, written in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows, held, found = [], 0, 0
                for what, a, b, head, body in salvage(path):
                    found += what == "record"
                    if what == "gap":
                        rows.append((path, what, a, b, head, None, None, None, None, None, None, None))
                    else:
                        kind = head["warc-type"]
                        digest = hashlib.sha256(body).hexdigest() if kind != "revisit" else head.get("warc-payload-digest", "").removeprefix("sha256:")
                        size = len(body) if kind != "revisit" else int(head.get("x-payload-length", "0"))
                        key, refers = head.get("x-row-id", ""), head.get("x-refers-to-row", "")
                        rows.append((path, what, a, b, None, kind, int(key) if key else None, head.get("warc-target-uri"), digest, size, int(refers) if refers else None, body if payload else None))
                        held += len(body) if payload else 200
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema=_SCHEMA)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema=_SCHEMA)
                if written is not None and found != written:
                    raise RuntimeError(f"{written} records written and {found} read: {path}")

    return spread(files.select("path", F.col("n_records") if "n_records" in files.columns else F.lit(None).cast("long").alias("n_records")), "path").mapInArrow(run, _READ)


_SCHEMA = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[t]) for n, t in (f.split() for f in _READ.split(", "))])


def archive_round_trip(spark: SparkSession, pages: DataFrame, least: int = 100, out_dir: str | None = None) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) as read back from the archives."""
    files = write_warc(pages, out_dir or scratch(spark, "warc"), least=least)
    got = read_warc(files, payload=False).where("kind = 'record'")
    return got.select(F.col("row_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")
