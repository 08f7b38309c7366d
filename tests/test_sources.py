import io
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.sources import export, frames, jpeg, simulate, store, video
from rasterloom.streaming import growth


def tiff(pages):
    """A little-endian, uncompressed grey stack."""
    out, at = bytearray(b"II*\x00\x00\x00\x00\x00"), 4
    for p in pages:
        data = len(out)
        out += p.tobytes() + b"\x00" * (p.size % 2)
        out[at : at + 4] = struct.pack("<I", len(out))
        tags = [(256, 4, p.shape[1]), (257, 4, p.shape[0]), (258, 3, 8), (259, 3, 1), (273, 4, data), (277, 3, 1), (279, 4, p.size)]
        out += struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", t, k, 1, v) for t, k, v in tags) + b"\x00\x00\x00\x00"
        at = len(out) - 4
    return bytes(out)


@pytest.fixture
def folder(tmp_path):
    rng = np.random.default_rng(0)
    a = rng.integers(0, 255, (4, 6, 3), dtype=np.uint8)
    g = rng.integers(0, 255, (5, 7), dtype=np.uint8)
    np.save(tmp_path / "im10.npy", a)
    np.save(tmp_path / "im9.npy", np.stack([g, g]))
    (tmp_path / "c.png").write_bytes(export.png(a))
    (tmp_path / "g.png").write_bytes(export.png(g))
    (tmp_path / "p.pgm").write_bytes(b"P5\n# note\n7 5\n255\n" + g.tobytes())
    (tmp_path / "s.tif").write_bytes(tiff([g, 255 - g]))
    return tmp_path, a, g


def test_decoders(folder):
    path, a, g = folder
    one = lambda n: [np.frombuffer(p[4], np.uint8).reshape(p[1], p[2], p[3]) for p in frames.pages(n, (path / n).read_bytes())]
    assert (one("im10.npy")[0] == a).all() and (one("c.png")[0] == a).all()
    assert (one("g.png")[0][:, :, 0] == g).all() and (one("p.pgm")[0][:, :, 0] == g).all() and len(one("im9.npy")) == 2
    s = one("s.tif")
    assert (s[0][:, :, 0] == g).all() and (s[1][:, :, 0] == 255 - g).all()


# Places of an 8 by 8 block in the order of the file.
ZIGZAG = (
    0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28,
    35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63,
)


def write_jpeg(planes, factors, every=0, kind=0xC0):
    """planes of one size, each sampled down by its factors (of rows, of columns); all codes have 8 bits, all quantisers are 1."""
    h, w = planes[0].shape
    vs, hs = (max(f[i] for f in factors) for i in (0, 1))
    seg = lambda k, body: bytes([0xFF, k]) + struct.pack(">H", len(body) + 2) + body
    symbols = {0: list(range(12)), 1: [0, 0xF0] + [r << 4 | s for r in range(16) for s in range(1, 11)]}
    out = b"\xff\xd8" + seg(0xDB, b"\x00" + b"\x01" * 64)
    out += seg(kind, struct.pack(">BHHB", 8, h, w, len(planes)) + b"".join(bytes([i + 1, (hs // f[1]) << 4 | vs // f[0], 0]) for i, f in enumerate(factors)))
    for c in (0, 1):
        out += seg(0xC4, bytes([c << 4]) + bytes([0] * 7 + [len(symbols[c])] + [0] * 8) + bytes(symbols[c]))
    out += seg(0xDD, struct.pack(">H", every)) if every else b""
    out += seg(0xDA, bytes([len(planes)]) + b"".join(bytes([i + 1, 0]) for i in range(len(planes))) + b"\x00\x3f\x00")
    down, across = -(-h // (8 * vs)), -(-w // (8 * hs))
    k, x = np.arange(8)[:, None], np.arange(8)[None, :]
    cos = np.cos((2 * x + 1) * k * np.pi / 16) / 2 * np.where(k == 0, np.sqrt(0.5), 1)
    parts = []
    for p, (fy, fx) in zip(planes, factors):
        full = np.pad(p.astype(float) - 128, ((0, down * 8 * vs - h), (0, across * 8 * hs - w)), mode="edge")
        parts.append(full.reshape(full.shape[0] // fy, fy, full.shape[1] // fx, fx).mean((1, 3)))
    bits, done, before = "", b"", [0] * len(planes)

    def number(v):
        n = abs(v).bit_length()
        return n, (format(v if v > 0 else v + (1 << n) - 1, f"0{n}b") if n else "")

    def flush():
        nonlocal bits
        bits += "1" * (-len(bits) % 8)
        data = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")
        bits = ""
        return data

    for m in range(down * across):
        if every and m and m % every == 0:
            done += flush() + bytes([0xFF, 0xD0 + (m // every - 1) % 8])
            before = [0] * len(planes)
        for c, (fy, fx) in enumerate(factors):
            v, u = vs // fy, hs // fx
            for j in range(u * v):
                y, z = (m // across * v + j // u) * 8, (m % across * u + j % u) * 8
                q = np.rint(cos @ parts[c][y : y + 8, z : z + 8] @ cos.T).astype(int).ravel()[list(ZIGZAG)].tolist()
                n, tail = number(q[0] - before[c])
                before[c] = q[0]
                bits += format(symbols[0].index(n), "08b") + tail
                zeros = 0
                last = max((i for i in range(64) if q[i]), default=0)
                for a in q[1 : last + 1]:
                    if not a:
                        zeros += 1
                        continue
                    while zeros > 15:
                        bits, zeros = bits + format(symbols[1].index(0xF0), "08b"), zeros - 16
                    n, tail = number(a)
                    bits, zeros = bits + format(symbols[1].index(zeros << 4 | n), "08b") + tail, 0
                bits += format(symbols[1].index(0), "08b") if last < 63 else ""
    return out + done + flush() + b"\xff\xd9"


@pytest.mark.parametrize("every", [0, 2])
@pytest.mark.parametrize("size", [(8, 8), (19, 33), (40, 17)])
def test_jpeg(size, every):
    rng = np.random.default_rng(1)
    y, x = np.indices(size)
    grey = (y * 5 + x * 3 + rng.integers(0, 30, size)) % 256
    assert np.abs(jpeg.decode(write_jpeg([grey], [(1, 1)], every))[:, :, 0].astype(int) - grey).max() <= 2
    smooth = [128 + 60 * np.sin(y / 9 + k) * np.cos(x / 7) for k in range(3)]
    for factors in ([(1, 1)] * 3, [(1, 1), (2, 2), (2, 2)], [(1, 1), (1, 2), (1, 2)]):
        got = jpeg.decode(write_jpeg(smooth, factors, every)).astype(float)
        a, b, c = smooth[0], smooth[1] - 128, smooth[2] - 128
        want = np.clip(np.stack([a + 1.402 * c, a - 0.344136 * b - 0.714136 * c, a + 1.772 * b], 2), 0, 255)
        assert np.abs(got - want).mean() < (1 if factors[1] == (1, 1) else 8)
    with pytest.raises(ValueError, match="baseline"):
        jpeg.decode(write_jpeg([grey], [(1, 1)], 0, 0xC2))


def test_videos_come_back(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(2)
    shot = {k: rng.integers(0, 256, (5, 6, 7, c), dtype=np.uint8) for k, c in (("a", 3), ("b", 1))}
    rows = [(k, t, 6, 7, a.shape[3], bytearray(a[t].tobytes())) for k, a in shot.items() for t in range(5)]
    d = spark.createDataFrame(rows, "arena string, t int, height int, width int, channels int, data binary")
    made = video.write_videos(d, str(tmp_path / "v"), ["arena"], "t").collect()
    assert sorted((r.arena, r.frames) for r in made) == [("a", 5), ("b", 5)]
    for r in made:
        raw = open(r.path, "rb").read()
        assert len(raw) == r.size == struct.unpack("<I", raw[4:8])[0] + 8
        got = video.decode(raw)
        assert (got == (shot[r.arena] if r.arena == "a" else shot["b"].repeat(3, 3))).all()
    assert frames.read_frames(spark, str(tmp_path / "v"), "avi").count() == 10
    (tmp_path / "v" / "x.raw").write_bytes(b"1")
    with pytest.raises(Exception, match="no decoder"):
        frames.read_frames(spark, str(tmp_path / "v")).collect()
    assert frames.read_frames(spark, str(tmp_path / "v"), strict=False).count() == 10
    monkeypatch.setattr(video, "MOST", 2 * 6 * 24)
    parts = video.write_videos(d, str(tmp_path / "w"), ["arena"], "t").collect()
    assert sum(r.frames for r in parts) == 10 and len(parts) > 2
    grey = rng.integers(0, 256, (16, 16))
    clip = write_jpeg([grey], [(1, 1)])
    head = video.head(16, 16, 1, 25).replace(struct.pack("<HHI", 1, 24, 0), struct.pack("<HH4s", 1, 24, b"MJPG"))
    assert np.abs(video.decode(head + b"00dc" + struct.pack("<I", len(clip)) + clip)[0, :, :, 0].astype(int) - grey).max() <= 2


def test_array_store(spark, tmp_path):
    own = f"file://{tmp_path}/store"
    assert store.keys(spark, own) == [] and store.read_array(spark, own, "a") is None and not store.remove_key(spark, own, "a")
    d = spark.createDataFrame([(0, [2, 2], bytearray(b"abcd")), (1, [2, 2], bytearray(b"efgh"))], store.ARRAY)
    store.append_array(d, own, "a")
    store.append_array(d, own, "a")
    store.write_array(d, own, "b")
    assert store.keys(spark, own) == ["a", "b"]
    assert [(r.at, bytes(r.data)) for r in store.read_array(spark, own, "a").orderBy("at").collect()] == [(0, b"abcd"), (1, b"efgh"), (2, b"abcd"), (3, b"efgh")]
    assert store.remove_key(spark, own, "a") and store.keys(spark, own) == ["b"]


def test_read_list_and_pixels(spark, folder):
    path, a, g = folder
    assert [r.path.rpartition("/")[2] for r in frames.list_images(spark, str(path), "npy", "IM").orderBy("place").collect()] == ["im9.npy", "im10.npy"]
    got = frames.read_frames(spark, str(path))
    assert got.count() == 8
    px = frames.to_pixels(got.where(F.col("path").endswith("c.png")), ["path"])
    assert px.count() == 24 and all(r.c0 == a[r.y, r.x, 0] and r.c2 == a[r.y, r.x, 2] for r in px.collect())
    spark.dataSource.register(frames.FrameSource)
    assert spark.read.format("frames").load(str(path)).count() == 8
    names = spark.createDataFrame([("a.PNG",), ("b.cr2",)], "path string")
    assert [r[0] for r in names.select(frames.is_raw_image(F.col("path"))).collect()] == [False, True]


def test_sinks(spark, folder, tmp_path):
    path, a, _ = folder
    d = frames.read_frames(spark, str(path), "png").withColumn("n", F.regexp_extract("path", r"(\w)\.png$", 1))
    out = export.write_images(d, str(tmp_path / "out"), ["n"]).collect()
    assert len(out) == 2
    back = frames.read_frames(spark, str(tmp_path / "out"))
    assert sorted(bytes(r.data) for r in back.collect()) == sorted(bytes(r.data) for r in d.collect())
    t = spark.createDataFrame([(1, 2.5), (2, None)], "arena int, area double")
    export.write_results(t, str(tmp_path / "r"))
    assert sorted(map(str, export.read_results(spark, str(tmp_path / "r"), "arena int, area double").collect())) == sorted(map(str, t.collect()))
    export.write_by_arena(t, str(tmp_path / "b"))
    export.write_by_arena(spark.createDataFrame([(2, 7.0)], "arena int, area double"), str(tmp_path / "b"))
    assert {(r.arena, r.area) for r in spark.read.parquet(str(tmp_path / "b")).collect()} == {(1, 2.5), (2, 7.0)}
    assert export.read_arena(spark, str(tmp_path / "b"), 2).count() == 1
    export.write_settings(spark, str(tmp_path / "s"), {"a": [1, 2]})
    assert export.read_settings(spark, str(tmp_path / "s")) == {"a": [1, 2]} and export.read_settings(spark, str(tmp_path / "none")) is None


def test_capture_times(spark):
    d = spark.createDataFrame([("a", 0, "2024:01:31 23:50:00"), ("a", 1, "2024:02:01 00:20:00"), ("b", 0, None), ("b", 1, "x")], "folder string, place int, stamp string")
    m = frames.capture_minutes(d, ["folder"])
    assert [r.minutes for r in m.orderBy("folder", "place").collect()] == [0, 30, 0, 1]
    assert frames.time_steps(m, ["folder"]).where("folder = 'a'").first().time_step == 30


def test_upright(spark):
    a = np.arange(6, dtype=np.uint8).reshape(2, 3)
    turned = np.rot90(a, 1)
    rows = [("f", i, *x.shape, 1, bytearray(np.ascontiguousarray(x).tobytes())) for i, x in enumerate((a, turned))]
    d = spark.createDataFrame(rows, "folder string, t int, height int, width int, channels int, data binary")
    assert all(bytes(r.data) == a.tobytes() for r in frames.upright(d, ["folder"], "t").collect())


def test_simulations(spark):
    g = simulate.growing_colonies(spark, 5, 60, 4)
    n = [r.n for r in g.groupBy("t").agg(F.count(F.lit(1)).alias("n")).orderBy("t").collect()]
    assert n == sorted(n) and n[-1] > n[0]
    assert sorted(map(str, g.collect())) == sorted(map(str, simulate.growing_colonies(spark, 5, 60, 4).collect()))
    m = simulate.moving_cells(spark, 200, 10, 5, 4, 6)
    assert m.select("blob").distinct().count() == 5
    c = simulate.colorize(simulate.noisy_circle(spark, 20).withColumn("on", F.lit(True)).withColumn("t", F.lit(0)), ["t"])
    assert all(0 <= r.b <= 255 for r in c.collect())


def test_streams(spark, tmp_path):
    rows = [("a", 0, 5.0), ("a", 1, 6.0), ("a", 2, 20.0), ("b", 0, 1.0)]
    for i, r in enumerate(rows):
        spark.createDataFrame([r], "arena string, t int, area double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("arena string, t int, area double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = growth.first_moves(stream, 10.0).writeStream.format("memory").queryName("moves").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = [tuple(r) for r in spark.sql("select * from moves").collect()]
    assert got == [("a", 2)]
    px = spark.createDataFrame([("a", "2024-01-01 00:00:10"), ("a", "2024-01-01 00:00:50"), ("a", "2024-01-01 00:02:00")], "arena string, at string").select("arena", F.to_timestamp("at").alias("at"))
    px.write.parquet(str(tmp_path / "px"))
    s = spark.readStream.schema(px.schema).parquet(str(tmp_path / "px"))
    q = growth.areas(s, "at", "1 minute", "0 seconds").writeStream.format("memory").queryName("areas").outputMode("append").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [r.area for r in spark.sql("select * from areas").collect()] == [2]
