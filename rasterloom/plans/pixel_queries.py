"""More registered queries: formulas, coordinate sets, drawing, drift, ranges in time."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import formulas, series
from ..operators import arenas, descriptors, drawing, pixels, segmentation
from ..sources import frames
from ..sources import store, video
from .bridge import CURVE, IMG, VID, curves, foreground, images, table, videos
from . import pipeline, search
from .queries import _BGR, _BYTES, _CROSS, _ERODE, _GRID, _OTSU, _bgr, query


@query("SELECT event_id, value * 2.5::DOUBLE + 1 AS v FROM events", "v", "event_id")
def linear_values(spark, sf):
    return table(spark, sf, "events").select("event_id", formulas.linear_model(F.col("value"), F.lit(2.5), F.lit(1.0)).alias("v"))


@query(f"{IMG}, c AS (SELECT img, avg(x) AS cx FROM fg GROUP BY img)\n--\nSELECT img, y, x, (x - cx) ** 2 AS square, (x - cx) ** 3 AS cube FROM fg JOIN c USING (img)", "square, cube", "img, y, x")
def power_distances(spark, sf):
    f = foreground(spark, sf)
    d = f.join(f.groupBy("img").agg(F.avg("x").alias("cx")), "img")
    return d.select("img", "y", "x", *[formulas.power_distance(F.col("x"), F.col("cx"), n).alias(a) for n, a in ((2, "square"), (3, "cube"))])


@query("SELECT p_partkey, greatest(round_even(log10(greatest(p_size * 997, p_partkey)) - 2, 0), 2)::INT AS width FROM part", "", "p_partkey, width")
def contour_widths(spark, sf):
    return table(spark, sf, "part").select("p_partkey", formulas.contour_width(F.col("p_size") * 997, F.col("p_partkey")).alias("width"))


_BOX = 'bx AS (SELECT img, min(y) AS "top", max(y) AS bottom FROM fg GROUP BY img)'


@query(f'{IMG}, {_BOX}\n--\nSELECT img, greatest(round_even(("top" + bottom) / 2.0::DOUBLE - (bottom - "top") / 2.0::DOUBLE * 1.5, 0), 0)::INT AS low, least(round_even(("top" + bottom) / 2.0::DOUBLE + (bottom - "top") / 2.0::DOUBLE * 1.5, 0), 8)::INT AS high FROM bx', "", "img, low, high")
def scaled_corners(spark, sf):
    low, high = formulas.scale_corners(F.col("top"), F.col("bottom"), 1.5, F.lit(8))
    return pixels.boxes(foreground(spark, sf), ["img"]).select("img", low.alias("low"), high.alias("high"))


for _value, _name in ((1, "set_pixels"), (0, "cleared_pixels")):

    def _written(spark, sf, value=_value):
        mask = images(spark, sf).select("img", "y", "x", F.lit(7).alias("v"))
        own = pixels.set_values(mask, foreground(spark, sf), ["img", "y", "x"], value) if value else pixels.clear_values(mask, foreground(spark, sf), ["img", "y", "x"])
        return own.select("img", "y", "x", "v")

    _written.__name__ = _name
    query(f"{IMG}\n--\nSELECT i.img, i.y, i.x, CASE WHEN fg.img IS NULL THEN 7 ELSE {_value} END AS v FROM img i LEFT JOIN fg ON fg.img = i.img AND fg.y = i.y AND fg.x = i.x", "", "img, y, x, v")(_written)

for _by, _name in ((1, "padded_coordinates"), (-1, "unpadded_coordinates")):

    def _moved(spark, sf, by=_by):
        return pixels.shift(foreground(spark, sf), by)

    _moved.__name__ = _name
    query(f"{IMG}\n--\nSELECT img, y + {_by} AS y, x + {_by} AS x FROM fg", "", "img, y, x")(_moved)


@query(f"{IMG}\n--\nSELECT img, y - 2 AS y, x - 1 AS x FROM fg WHERE y BETWEEN 2 AND 5 AND x BETWEEN 1 AND 6", "", "img, y, x")
def cropped_pixels(spark, sf):
    return pixels.crop(foreground(spark, sf), 2, 6, 1, 7)


@query(f"""{VID}, l AS (SELECT arena, t, quantile_cont(v, 0.9) AS level FROM vid GROUP BY ALL), d AS (SELECT arena, t, 60 + level - arg_max(level, t) OVER (PARTITION BY arena) AS threshold FROM l),
f AS (SELECT *, bool_and(threshold BETWEEN 0 AND 255) OVER (PARTITION BY arena) AS fine FROM d)
--
SELECT arena, t, y, x FROM vid JOIN f USING (arena, t) WHERE fine AND v < threshold""", "", "arena, t, y, x")
def dark_segmentation(spark, sf):
    v = videos(spark, sf)
    return segmentation.luminance_segmentation(v, segmentation.background_levels(v, ["arena"], True), ["arena"], 60.0, lighter=True)


@query(f"""{VID}, m AS (SELECT arena, t, count(*) AS area, avg(x) AS cx, avg(y) AS cy FROM vid WHERE v > 95 GROUP BY ALL)
--
SELECT arena, t, coalesce(area, 0) AS area, coalesce(cx, 0) AS cx, coalesce(cy, 0) AS cy FROM frames LEFT JOIN m USING (arena, t)""", "cx, cy", "arena, t, area")
def frame_descriptors(spark, sf):
    v = videos(spark, sf)
    return descriptors.per_frame(v.where("v > 95"), v.select("arena", "t").distinct(), wanted=("area", "cx", "cy"))


_DILATED = f"di AS (SELECT DISTINCT img, y + dy AS y, x + dx AS x FROM fg, (VALUES {_CROSS}) o(dy, dx) WHERE y + dy BETWEEN 0 AND 7 AND x + dx BETWEEN 0 AND 7)"


@query(f"{IMG}, {_ERODE}\n--\nSELECT DISTINCT img, y + dy AS y, x + dx AS x FROM er, (VALUES {_CROSS}) o(dy, dx) WHERE y + dy BETWEEN 0 AND 7 AND x + dx BETWEEN 0 AND 7", "", "img, y, x")
def opening(spark, sf):
    return pixels.opened(foreground(spark, sf), ["img"], pixels.CROSS, 8, 8)


@query(f"""{IMG}, {_DILATED}, ne AS (SELECT di.img, di.y, di.x, di.y + dy AS ny, di.x + dx AS nx FROM di, (VALUES {_CROSS}) o(dy, dx))
--
SELECT ne.img, ne.y, ne.x FROM ne LEFT JOIN di ON di.img = ne.img AND di.y = ny AND di.x = nx GROUP BY ALL HAVING bool_and(di.img IS NOT NULL OR ny NOT BETWEEN 0 AND 7 OR nx NOT BETWEEN 0 AND 7)""", "", "img, y, x")
def closing(spark, sf):
    return pixels.closed(foreground(spark, sf), ["img"], pixels.CROSS, 8, 8)


@query("""m AS (SELECT min(value) AS a, max(value) AS b FROM events)
--
SELECT event_id, round_even((value - a) / (b - a) * 255, 0)::INT AS red, round_even((1 - (value - a) / (b - a)) * 255, 0)::INT AS blue, round_even(10 + 190 * (event_id % 7) / 6.0::DOUBLE, 0)::INT AS step FROM events, m""", "", "event_id, red, blue, step")
def gradient_colours(spark, sf):
    e = table(spark, sf, "events")
    ends = e.agg(F.min("value").alias("a"), F.max("value").alias("b"))
    c = formulas.gradient_colour(F.col("value"), F.col("a"), F.col("b"))
    step = formulas.colour_steps((10, 0, 0), (200, 0, 0), F.col("event_id") % 7, 7)
    return e.crossJoin(F.broadcast(ends)).select("event_id", c[0].alias("red"), c[2].alias("blue"), step[0].alias("step"))  # ends is one row


@query(f"{VID}\n--\nSELECT arena, count(*) AS n FROM vid WHERE arena NOT IN ('view') GROUP BY arena", "", "arena, n")
def analysed_arenas(spark, sf):
    return arenas.analysed(videos(spark, sf), ["view"]).groupBy("arena").agg(F.count(F.lit(1)).alias("n"))


@query(f"{IMG}\n--\nSELECT img, 1 AS arena, y, x FROM fg", "", "img, arena, y, x")
def whole_images(spark, sf):
    box = spark.createDataFrame(arenas.whole_image(8, 8), "arena int, top int, bottom int, left int, right int")
    return arenas.into_arenas(foreground(spark, sf), box).select("img", "arena", "y", "x")


@query("""s AS (SELECT event_type, epoch(ts) / 60 AS m, lag(epoch(ts) / 60) OVER (PARTITION BY event_type ORDER BY epoch(ts)) AS b FROM events), d AS (SELECT event_type, avg(m - b) AS m FROM s GROUP BY event_type)
--
SELECT event_type, CASE WHEN m > 0 THEN round_even(m / 10 ** floor(log10(m)), 0) * 10 ** floor(log10(m)) ELSE m END AS time_step FROM d""", "time_step", "event_type")
def time_steps(spark, sf):
    return frames.time_steps(table(spark, sf, "events").select("event_type", (F.unix_micros(F.col("ts").cast("timestamp")) / 60e6).alias("minutes")), ["event_type"])


@query("""m AS (SELECT event_type, min(value * 10 - event_id % 300) AS lo, max(value * event_id) AS hi FROM events GROUP BY event_type)
--
SELECT event_type, CASE WHEN lo >= 0 THEN CASE WHEN hi < 256 THEN 'uint8' WHEN hi < 65536 THEN 'uint16' WHEN hi < 4294967296 THEN 'uint32' ELSE 'uint64' END
  ELSE CASE WHEN lo >= -128 AND hi < 128 THEN 'int8' WHEN lo >= -32768 AND hi < 32768 THEN 'int16' WHEN lo >= -2147483648 AND hi < 2147483648 THEN 'int32' ELSE 'int64' END END AS type FROM m""", "", "event_type, type")
def smallest_types(spark, sf):
    m = table(spark, sf, "events").groupBy("event_type").agg(F.min(F.col("value") * 10 - F.col("event_id") % 300).alias("lo"), F.max(F.col("value") * F.col("event_id")).alias("hi"))
    return m.select("event_type", formulas.smallest_type(F.col("lo"), F.col("hi")).alias("type"))


@query(f"""{IMG}, a AS (SELECT * FROM fg WHERE y < 3), b AS (SELECT * FROM fg WHERE y > 4 AND img % 5 > 0), d AS (SELECT a.img, min((a.y - b.y) ** 2 + (a.x - b.x) ** 2) AS d FROM a JOIN b USING (img) GROUP BY a.img)
--
SELECT img, sqrt(d) AS distance FROM (SELECT DISTINCT img FROM a) LEFT JOIN d USING (img)""", "distance", "img")
def nearest_distances(spark, sf):
    f = foreground(spark, sf)
    return pixels.nearest_distance(f.where("y < 3"), f.where("y > 4 and img % 5 > 0"), ["img"], 1)


_OUTLINE = f"{_ERODE}, co AS (SELECT img, y, x FROM fg EXCEPT SELECT img, y, x FROM es)"


@query(f"""{IMG}, {_BYTES}, {_BGR}, {_OUTLINE}
--
SELECT p.img, p.y, p.x, CASE WHEN c.img IS NULL THEN b ELSE 1 END AS b, CASE WHEN c.img IS NULL THEN g ELSE 2 END AS g, CASE WHEN c.img IS NULL THEN r ELSE 3 END AS r FROM bgr p LEFT JOIN co c ON c.img = p.img AND c.y = p.y AND c.x = p.x""", "", "img, y, x, b, g, r")
def drawn_masks(spark, sf):
    return drawing.draw_mask(_bgr(spark, sf), foreground(spark, sf), ["img"], (1, 2, 3), only_contours=True)


@query(f"""{IMG}, {_BYTES}, {_BGR}, {_OUTLINE}, wi AS (SELECT DISTINCT img, y + dy AS y, x + dx AS x FROM co, (VALUES {_CROSS}) o(dy, dx)),
br AS (SELECT img, CASE WHEN avg((b + g + r) / 3::DOUBLE) > 126 THEN 255 ELSE 0 END AS c FROM bgr GROUP BY img)
--
SELECT p.img, p.y, p.x, CASE WHEN w.img IS NULL THEN b ELSE c END AS b, CASE WHEN w.img IS NULL THEN g ELSE c END AS g, CASE WHEN w.img IS NULL THEN r ELSE c END AS r FROM bgr p JOIN br USING (img) LEFT JOIN wi w ON w.img = p.img AND w.y = p.y AND w.x = p.x""", "", "img, y, x, b, g, r")
def drawn_outlines(spark, sf):
    return drawing.draw_outline(_bgr(spark, sf), foreground(spark, sf), ["img"], widen=1)


_RAW = IMG.replace("img AS (\n", "raw AS (\n").replace("FROM img WHERE", "FROM raw WHERE")


@query(f"""{_RAW}, {_DILATED}, ri AS (SELECT img, y, x FROM di EXCEPT SELECT img, y, x FROM fg), le AS (SELECT raw.img, avg(v) AS level FROM raw JOIN ri USING (img, y, x) GROUP BY raw.img),
img AS (SELECT r.img, r.y, r.x, CASE WHEN fg.img IS NOT NULL AND level IS NOT NULL THEN level ELSE v END AS v FROM raw r LEFT JOIN le ON le.img = r.img LEFT JOIN fg ON fg.img = r.img AND fg.y = r.y AND fg.x = r.x), {_OTSU}
--
SELECT img, y, x FROM img JOIN otsu USING (img) WHERE v > threshold""", "", "img, y, x")
def drift_corrected(spark, sf):
    return drawing.without_drift(images(spark, sf), foreground(spark, sf), ["img"])[1].select("img", "y", "x")


@query(f"""{VID}, fi AS (SELECT arena, y, x, (y * 3 + x) % 11 AS field FROM (SELECT DISTINCT arena, y, x FROM vid)), en AS (SELECT arena, max(field) AS near, min(field) AS far FROM fi WHERE field > 0 GROUP BY arena),
st AS (SELECT arena, t, y, x FROM vid WHERE v > 90), se AS (SELECT arena, min(CASE WHEN field = near THEN t END) AS a, min(CASE WHEN field = far THEN t END) AS b FROM st JOIN fi USING (arena, y, x) JOIN en USING (arena) GROUP BY arena),
r AS (SELECT arena, near, far, CASE WHEN a <= coalesce(b, last) THEN a ELSE 0 END AS f, coalesce(b, last) AS e FROM en JOIN (SELECT arena, max(t) AS last FROM frames GROUP BY arena) USING (arena) LEFT JOIN se USING (arena)),
u AS (SELECT *, unnest(generate_series(f, e)) AS t FROM r WHERE e >= f)
--
SELECT arena, t::INT AS t, round_even(near + (far - near) * CASE WHEN e > f THEN (t - f) / (e - f)::DOUBLE ELSE 0 END, 0) AS radius FROM u""", "radius", "arena, t")
def radii_against_time(spark, sf):
    v = videos(spark, sf)
    field = v.select("arena", "y", "x").distinct().withColumn("field", (F.col("y") * 3 + F.col("x")) % 11)
    return drawing.radius_against_time(v.where("v > 90").select("arena", "t", "y", "x"), field, ["arena"], v.select("arena", "t").distinct())


@query(f"""{CURVE}, q AS (SELECT k, i, y - lag(y, 1, 0) OVER (PARTITION BY k ORDER BY i) AS y FROM curve), b AS (SELECT k, (i // 5)::BIGINT AS block, avg(y) AS mean FROM q GROUP BY ALL HAVING count(*) = 5),
m AS (SELECT k, avg(d) AS mean_step FROM (SELECT k, y - lag(y) OVER (PARTITION BY k ORDER BY i) AS d FROM q) GROUP BY k), c AS (SELECT k, block, lead(mean) OVER (PARTITION BY k ORDER BY block) - mean AS change FROM b)
--
SELECT k, block, change, mean_step FROM c JOIN m USING (k) WHERE change < mean_step""", "change, mean_step", "k, block")
def weekly_shifts(spark, sf):
    c = curves(spark, sf)
    w = Window.partitionBy("k").orderBy("i")
    return series.slope_shifts(c.withColumn("y", F.col("y") - F.lag("y", 1, 0.0).over(w)), ["k"], "i", "y", 5)


@query()
def filter_search(spark, sf):
    return search.search_filters(images(spark, sf), ["img"], 5)


# -- modes of an analysis ----------------------------------------------------------------

_ORIGIN = """og AS (SELECT arena, y, x FROM vid JOIN (SELECT arena, min(t) AS t FROM vid GROUP BY arena) USING (arena, t) WHERE v > 40),
c0 AS (SELECT arena, y, x, max(v) AS c FROM vid JOIN (SELECT arena, min(t) AS t0 FROM vid GROUP BY arena) USING (arena) WHERE t < t0 + 3 AND (arena, y, x) IN (SELECT (arena, y, x) FROM og) GROUP BY ALL),
cov AS (SELECT arena, min(c) AS base FROM c0 WHERE c <> 0 GROUP BY arena),
"""
_PICKED = """q AS (SELECT *, sum((NOT fine)::INT) OVER (PARTITION BY arena ORDER BY place) AS br FROM gr), q2 AS (SELECT *, min(br) OVER (PARTITION BY arena) AS fr FROM q WHERE fine),
q3 AS (SELECT *, row_number() OVER (PARTITION BY arena ORDER BY place) AS o FROM q2 WHERE br = fr),
pk AS (SELECT arena, coalesce(max(threshold), 0) AS threshold FROM (SELECT DISTINCT arena FROM gr) a LEFT JOIN (SELECT arena, arg_max(threshold, o) AS threshold FROM q3 WHERE o <= 3 GROUP BY arena) b USING (arena) GROUP BY arena)"""
_LUMINANCE = f"""{VID}, {_ORIGIN}{_GRID.partition("GROUP BY arena),")[2].strip()}, {_PICKED},
lv AS (SELECT arena, t, quantile_cont(v, 0.1) AS level FROM vid GROUP BY ALL), dr AS (SELECT arena, t, threshold + level - arg_max(level, t) OVER (PARTITION BY arena) AS threshold FROM lv JOIN pk USING (arena)),
ok AS (SELECT *, bool_and(threshold BETWEEN 0 AND 255) OVER (PARTITION BY arena) AS fine FROM dr),
lu AS (SELECT arena, t, y, x FROM vid JOIN ok USING (arena, t) WHERE fine AND v > ok.threshold)"""


def _origin(v):
    return v.join(v.groupBy("arena").agg(F.min("t").alias("t")), ["arena", "t"], "left_semi").where("v > 40").select("arena", "y", "x")


@query(f"{_LUMINANCE}\n--\nSELECT arena, t, y, x FROM lu", "", "arena, t, y, x")
def luminance_draft(spark, sf):
    v = videos(spark, sf)
    return pipeline.luminance_draft(v, _origin(v), False, 45)


def _mode(spark, sf, **settings) -> pipeline.Results:
    v = videos(spark, sf)
    second = v.withColumn("v", 255 - F.col("v")) if "logical" in settings else None
    return pipeline.analyse(v, Settings(most_growth=45 / 288, **settings), 12, 12, second=second, origin=_origin(v))


@query(f"""{_LUMINANCE}
--
SELECT arena, t, count(lu.arena) AS drafted FROM frames LEFT JOIN lu USING (arena, t) GROUP BY arena, t""", "", "arena, t, drafted")
def luminance_areas(spark, sf):
    v = videos(spark, sf)
    found = pipeline.detected(v, Settings(detection=("luminance",), most_growth=45 / 288), 144, _origin(v))
    n = found.groupBy("arena", "t").agg(F.count(F.lit(1)).alias("n"))
    return v.select("arena", "t").distinct().join(n, ["arena", "t"], "left").select("arena", "t", F.coalesce("n", F.lit(0)).alias("drafted"))


@query()
def analysis_luminance(spark, sf):
    return _mode(spark, sf, detection=("luminance",)).frames


@query()
def analysis_slope(spark, sf):
    return _mode(spark, sf, detection=("slope",)).frames


@query()
def analysis_luminance_or_slope(spark, sf):
    return _mode(spark, sf, detection=("luminance", "slope"), detection_join="Or").frames


@query()
def analysis_two_conversions(spark, sf):
    return _mode(spark, sf, logical="Xor").frames


@query()
def analysis_leaving(spark, sf):
    return _mode(spark, sf, mode="move and grow", fading=0.1).frames


@query()
def analysis_growth(spark, sf):
    return _mode(spark, sf).growth


# -- files ----------------------------------------------------------------


def _video_frames(spark, sf):
    """(arena, t, height, width, channels, data): videos as 12 by 12 frames of bytes, 0 where nothing is."""
    v = videos(spark, sf).select("arena", "t", (F.col("y") * 12 + F.col("x")).alias("p"), F.least(F.greatest(F.floor("v"), F.lit(0)), F.lit(255)).cast("int").alias("v"))
    m = v.groupBy("arena", "t").agg(F.map_from_entries(F.collect_list(F.struct("p", "v"))).alias("m"))
    cells = F.transform(F.sequence(F.lit(0), F.lit(143)), lambda p: F.lpad(F.hex(F.coalesce(F.try_element_at("m", p), F.lit(0))), 2, "0"))
    twelve = F.lit(12)
    return m.select("arena", "t", twelve.alias("height"), twelve.alias("width"), F.lit(1).alias("channels"), F.unhex(F.array_join(cells, "")).alias("data"))


_FRAMES = f"""{VID}, bt AS (SELECT arena, t, y, x, least(greatest(floor(v), 0), 255)::INT AS v FROM vid), nf AS (SELECT arena, t, row_number() OVER (PARTITION BY arena ORDER BY t) - 1 AS page FROM frames),
full_ AS (SELECT arena, page::INT AS page, c // 12 AS y, c % 12 AS x, t FROM nf, range(0, 144) r(c))"""


@query(f"""{_FRAMES}
--
SELECT arena, page, f.y::INT AS y, f.x::INT AS x, coalesce(v, 0) AS red, coalesce(v, 0) AS blue FROM full_ f LEFT JOIN bt b USING (arena, t, y, x)""", "", "arena, page, y, x, red, blue")
def video_files(spark, sf):
    """Videos written as files and read back as pixels."""
    folder = store.shared_folder(spark, "videos")
    video.write_videos(_video_frames(spark, sf), folder, ["arena"], "t").write.format("noop").mode("overwrite").save()
    read = frames.read_frames(spark, folder, "avi").withColumn("arena", F.regexp_extract("path", r"([^/]+)\.avi$", 1))
    return frames.to_pixels(read, ["arena", "page"]).select("arena", "page", "y", "x", F.col("c0").alias("red"), F.col("c2").alias("blue"))


@query(f"""{_FRAMES}
--
SELECT page::BIGINT AS place, 12 AS height, sum(coalesce(v, 0) * (f.y * 12 + f.x + 1))::BIGINT AS total FROM full_ f LEFT JOIN bt b USING (arena, t, y, x) WHERE arena = 'click' GROUP BY page
UNION ALL SELECT page::BIGINT + (SELECT count(*) FROM nf WHERE arena = 'click'), 12, sum(coalesce(v, 0) * (f.y * 12 + f.x + 1))::BIGINT FROM full_ f LEFT JOIN bt b USING (arena, t, y, x) WHERE arena = 'view' GROUP BY page""", "place, height, total")
def array_store(spark, sf):
    """One arena's frames written, another's appended, a third key written and removed, all read back."""
    own, w = store.shared_folder(spark, "arrays"), Window.partitionBy("arena").orderBy("t")
    d = _video_frames(spark, sf).select("arena", (F.row_number().over(w) - 1).cast("long").alias("at"), F.array("height", "width").alias("shape"), "data")
    store.write_array(d.where("arena = 'click'"), own, "frames")
    store.append_array(d.where("arena = 'view'"), own, "frames")
    store.write_array(d.where("arena = 'view'"), own, "other")
    store.remove_key(spark, own, "other")
    (key,) = store.keys(spark, own)
    total = F.aggregate(F.sequence(F.lit(1), F.length("data")), F.lit(0).cast("long"), lambda s, i: s + i * F.conv(F.hex(F.substring("data", i, F.lit(1))), 16, 10).cast("long"))
    return store.read_array(spark, own, key).select(F.col("at").alias("place"), F.col("shape")[0].alias("height"), total.alias("total"))
