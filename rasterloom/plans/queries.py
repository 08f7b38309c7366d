"""Registered queries: each applies one operator to rasters made from the tables, with the same in SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..config import Settings
from ..functions import color, formulas, series
from ..functions import kernels as K
from ..operators import arenas
from ..operators import components as C
from ..operators import descriptors, dynamics, filters, growth, motion, network, pixels, polygon, segmentation, tracking
from . import pipeline, search
from .bridge import CURVE, IMG, VID, curves, foreground, images, table, videos

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, floats: str = "", others: str = ""):
    """Registers a query; floats are rounded to six places on both sides, and zero has one sign."""

    def add(f: Query) -> Query:
        def rounded(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            return df.select(*[(F.round(c.name, 6) + 0.0).alias(c.name) if isinstance(c.dataType, DoubleType) else F.col(c.name) for c in df.schema])

        QUERIES[f.__name__] = rounded
        if sql:
            cols = [c.strip() for c in others.split(",") if c.strip()] + [f"round({c.strip()}, 6) + 0.0 AS {c.strip()}" for c in floats.split(",") if c.strip()]
            head, _, body = sql.strip().rpartition("\n--\n")
            SQL[f.__name__] = (f"WITH {'RECURSIVE ' if 'UNION' in head else ''}{head}\n" if head else "") + f"SELECT {', '.join(cols)} FROM (\n{body}\n)"
        return f

    return add


# -- descriptors ----------------------------------------------------------------

_MOMENTS = """m AS (
  SELECT img, count(*) AS area, avg(x) AS cx, avg(y) AS cy, var_pop(x) AS c20, var_pop(y) AS c02, covar_pop(x, y) AS c11, stddev_pop(x) AS sx, stddev_pop(y) AS sy FROM fg GROUP BY img),
h AS (
  SELECT fg.img, avg((x - cx) ** 3) AS tx, avg((y - cy) ** 3) AS ty, avg((x - cx) ** 4) AS fx, avg((y - cy) ** 4) AS fy FROM fg JOIN m USING (img) GROUP BY fg.img),
a AS (SELECT *, sqrt(4 * c11 * c11 + (c20 - c02) ** 2) AS root FROM m JOIN h USING (img)),
b AS (SELECT *, sqrt(6 * (c20 + c02 + root)) AS major, sqrt(greatest(6 * (c20 + c02 - root), 0)) AS minor FROM a)"""


@query(f"""{IMG}, {_MOMENTS}
--
SELECT img, area, cx, cy, sx AS standard_deviation_x, sy AS standard_deviation_y,
  CASE WHEN sx > 0 THEN tx / sx ** 3 ELSE 0 END AS skewness_x, CASE WHEN sy > 0 THEN ty / sy ** 3 ELSE 0 END AS skewness_y,
  CASE WHEN sx > 0 THEN fx / sx ** 4 ELSE 0 END AS kurtosis_x, CASE WHEN sy > 0 THEN fy / sy ** 4 ELSE 0 END AS kurtosis_y,
  major AS major_axis_len, minor AS minor_axis_len,
  CASE WHEN c20 = c02 THEN 0 ELSE 0.5 * atan(2 * c11 / (c20 - c02)) + CASE WHEN c20 < c02 THEN pi() / 2 ELSE 0 END END AS axes_orientation,
  CASE WHEN major > 0 THEN sqrt(greatest(1 - (minor / major) ** 2, 0)) ELSE 0 END AS eccentricity
FROM b""", "cx, cy, standard_deviation_x, standard_deviation_y, skewness_x, skewness_y, kurtosis_x, kurtosis_y, major_axis_len, minor_axis_len, axes_orientation, eccentricity", "img, area")
def shape_moments(spark, sf):
    return descriptors.moments(foreground(spark, sf), ["img"])


@query(f"{IMG}\n--\nSELECT img, " + ", ".join(f"sum(x ** {p} * y ** {q})::DOUBLE AS m{p}{q}" for p in range(4) for q in range(4 - p)) + " FROM fg GROUP BY img", ", ".join(f"m{p}{q}" for p in range(4) for q in range(4 - p)), "img")
def raw_moments(spark, sf):
    return descriptors.raw_moments(foreground(spark, sf), ["img"])


@query(f"""{IMG}
--
SELECT img, count(*) * 0.25 AS area, (max(x) - min(x)) * 0.5 AS major_axis_len, count(*) * 0.5 AS area_reference FROM fg GROUP BY img""", "area, major_axis_len, area_reference", "img")
def scaled_descriptors(spark, sf):
    g = foreground(spark, sf).groupBy("img").agg(F.count(F.lit(1)).cast("double").alias("area"), (F.max("x") - F.min("x")).cast("double").alias("major_axis_len"))
    other = descriptors.scale(g, 0.25, "reference").select("img", F.col("area").alias("area_reference"))
    return descriptors.scale(g, 0.25).join(other, "img")


@query(f"""{IMG}, e AS (SELECT min(v) AS a, max(v) AS b, img FROM img GROUP BY img)
--
SELECT img, y, x, CASE WHEN b > a THEN round_even((v - a) * 255 / (b - a), 0) ELSE 0 END::INT AS v FROM img JOIN e USING (img)""", "", "img, y, x, v")
def contrast_stretch(spark, sf):
    d = images(spark, sf)
    ends = d.groupBy("img").agg(F.min("v").alias("a"), F.max("v").alias("b"))
    return d.join(ends, "img").select("img", "y", "x", formulas.stretch_uint8(F.col("v"), F.col("a"), F.col("b")).alias("v"))


@query("SELECT event_id, ((round_even(value * 10 - 300, 0)::BIGINT % 256 + 256) % 256)::INT AS v FROM events", "", "event_id, v")
def wrap_bytes(spark, sf):
    return table(spark, sf, "events").select("event_id", formulas.wrap_uint8(F.col("value") * 10 - 300).alias("v"))


@query(f"""{IMG}
--
SELECT a.img, sum(abs(a.v - b.v)) AS difference, sqrt(sum((a.v - b.v) ** 2)) AS distance FROM img a JOIN img b ON b.img = a.img + 1 AND a.y = b.y AND a.x = b.x GROUP BY a.img""", "difference, distance", "img")
def neighbour_differences(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("img"), F.col("embedding").cast("array<double>").alias("a"))
    n = e.select((F.col("img") - 1).alias("img"), F.col("a").alias("b"))
    diff = F.aggregate(F.zip_with("a", "b", lambda p, q: F.abs(p - q)), F.lit(0.0), lambda s, d: s + d)
    return e.join(n, "img").select("img", diff.alias("difference"), formulas.euclidean(F.col("a"), F.col("b")).alias("distance"))


# -- series ----------------------------------------------------------------


@query(f"""{CURVE}, s AS (
  SELECT k, i, y, i AS p, count(*) OVER (PARTITION BY k) - 1 - i AS q, lead(y, 1) OVER w AS a1, lead(y, 2) OVER w AS a2, lag(y, 1) OVER w AS b1 FROM curve WINDOW w AS (PARTITION BY k ORDER BY i))
--
SELECT k, i, (y + CASE WHEN least(p, q) >= 1 THEN a1 + b1 ELSE 0 END + CASE WHEN least(p, q) >= 2 THEN a2 ELSE 0 END) / (1 + CASE WHEN least(p, q) >= 1 THEN 2 ELSE 0 END + CASE WHEN least(p, q) >= 2 THEN 1 ELSE 0 END) AS smooth FROM s""", "smooth", "k, i")
def moving_average(spark, sf):
    return series.moving_average(curves(spark, sf), ["k"], "i", "y", 5).select("k", "i", "smooth")


@query(f"""{CURVE}, s AS (
  SELECT k, i, y, first_value(y) OVER (PARTITION BY k ORDER BY i) AS f, last_value(y) OVER (PARTITION BY k ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l,
    lag(y, 1) OVER w AS b1, lag(y, 2) OVER w AS b2, lead(y, 1) OVER w AS a1 FROM curve WINDOW w AS (PARTITION BY k ORDER BY i))
--
SELECT k, i, (y + coalesce(b1, f) + coalesce(b2, f) + coalesce(a1, l)) / 4 AS smooth FROM s""", "smooth", "k, i")
def edge_padded_mean(spark, sf):
    return series.edge_padded_mean(curves(spark, sf), ["k"], "i", "y", 4).select("k", "i", "smooth")


@query(f"""{CURVE}, s AS (SELECT k, i, y, lag(y) OVER w AS a, lead(y) OVER w AS b FROM curve WINDOW w AS (PARTITION BY k ORDER BY i))
--
SELECT k, i, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN (b - a) / 2 WHEN b IS NOT NULL THEN b - y WHEN a IS NOT NULL THEN y - a END AS slope FROM s""", "slope", "k, i")
def temporal_gradient(spark, sf):
    return curves(spark, sf).select("k", "i", series.gradient(["k"], "i", "y").alias("slope"))


@query(f"""{CURVE}, f AS (SELECT k, i, y, first_value(y) OVER (PARTITION BY k ORDER BY i) AS a FROM curve)
--
SELECT k, min(CASE WHEN y >= a + 500 THEN i END) AS first_move FROM f GROUP BY k""", "", "k, first_move")
def first_move(spark, sf):
    return series.first_reaching(curves(spark, sf), ["k"], "i", "y", 500.0)


@query(f"""{CURVE}
--
SELECT k, coalesce(regr_slope(y, i), 0) AS slope, coalesce(regr_intercept(y, i), avg(y)) AS intercept, coalesce(corr(y, i), 0) AS r FROM curve GROUP BY k""", "slope, intercept, r", "k")
def linear_fits(spark, sf):
    return series.linear_fit(curves(spark, sf), ["k"], "i", "y")


_BLOCKS = "b AS (SELECT k, (i // 5)::BIGINT AS block, avg(y) AS mean FROM curve GROUP BY ALL HAVING count(*) = 5)"


@query(f"{CURVE}, {_BLOCKS}\n--\nSELECT k, block, mean FROM b", "mean", "k, block")
def block_means(spark, sf):
    return series.block_means(curves(spark, sf), ["k"], "i", "y", 5)


@query(f"""{CURVE}, {_BLOCKS}, d AS (SELECT k, y - lag(y) OVER (PARTITION BY k ORDER BY i) AS d FROM curve), m AS (SELECT k, avg(d) AS mean_step FROM d GROUP BY k),
c AS (SELECT k, block, lead(mean) OVER (PARTITION BY k ORDER BY block) - mean AS change FROM b)
--
SELECT k, block, change, mean_step FROM c JOIN m USING (k) WHERE change < mean_step""", "change, mean_step", "k, block")
def slope_shifts(spark, sf):
    return series.slope_shifts(curves(spark, sf), ["k"], "i", "y", 5)


_GROWTH = f"""{CURVE}, c0 AS (SELECT k, (row_number() OVER (PARTITION BY k ORDER BY i) - 1)::INT AS i, y FROM curve WHERE NOT (i = 0 AND y = 0)),
c AS (SELECT k, i, CASE WHEN y = 0 THEN min(CASE WHEN y > 0 THEN y END) OVER (PARTITION BY k) ELSE y END AS y FROM c0),
e AS (SELECT k, count(*) AS n, max(y) - min(y) AS span, max(CASE WHEN i = 1 THEN y END) AS y1 FROM c GROUP BY k),
f AS (SELECT k, min(CASE WHEN y > y1 + 0.1 * span THEN i END) AS ms, min(CASE WHEN y > y1 + 0.01 * span THEN i END) AS me FROM c JOIN e USING (k) GROUP BY k),
bb AS (SELECT k, i // 5 AS b, avg(y) AS m FROM c GROUP BY ALL HAVING count(*) = 5),
bd AS (SELECT k, b, lead(m) OVER (PARTITION BY k ORDER BY b) - m AS d FROM bb),
st AS (SELECT k, (max(CASE WHEN i = n - 1 THEN y END) - max(CASE WHEN i = 0 THEN y END)) / (max(n) - 1) AS g FROM c JOIN e USING (k) GROUP BY k),
ru AS (SELECT c.k, min(i) AS r FROM c JOIN e USING (k) JOIN bd ON bd.k = c.k AND i = (b + 1) * 5 - 1 JOIN st ON st.k = c.k WHERE y > y1 + 0.9 * span AND d < g GROUP BY c.k),
lim AS (SELECT k, n, span, ms, me, r, coalesce(r, n - 1) AS last FROM e JOIN f USING (k) LEFT JOIN ru USING (k)),
p AS (SELECT a.k, a.i AS i, b.i AS j FROM c a JOIN lim USING (k) JOIN c b ON b.k = a.k WHERE a.i <= ms AND b.i BETWEEN ms AND last AND b.i > a.i AND abs(b.y - a.y) > 0.5 * span),
w AS (SELECT p.k, p.i, p.j, regr_slope(y, c.i) AS slope, regr_intercept(y, c.i) AS icpt, regr_r2(y, c.i) AS r2 FROM p JOIN c ON c.k = p.k AND c.i BETWEEN p.i AND p.j GROUP BY ALL),
z AS (SELECT p.k, p.i, p.j, regr_slope(ln(y), c.i) AS slope, regr_intercept(ln(y), c.i) AS icpt, regr_r2(ln(y), c.i) AS r2 FROM p JOIN lim ON lim.k = p.k AND p.i < me JOIN c ON c.k = p.k AND c.i BETWEEN p.i AND p.j GROUP BY ALL),
lin AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY round(r2, 10) DESC, i, j) AS o FROM w) WHERE o = 1),
ex AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY round(r2, 10) DESC, i, j) AS o FROM z) WHERE o = 1)"""


@query(f"""{_GROWTH}
--
SELECT lim.k, ex.icpt AS exp_intercept, ex.slope AS exp_slope, ex.i AS exp_start, ex.j AS exp_end, ex.r2 AS exp_r2, lin.icpt AS lin_intercept, lin.slope AS lin_slope, lin.i AS lin_start, lin.j AS lin_end, lin.r2 AS lin_r2,
  r::DOUBLE AS rupture_time, c.y AS rupture_value, r IS NULL AS is_censored
FROM lim LEFT JOIN ex ON ex.k = lim.k LEFT JOIN lin ON lin.k = lim.k LEFT JOIN c ON c.k = lim.k AND c.i = r""", "exp_intercept, exp_slope, exp_r2, lin_intercept, lin_slope, lin_r2, rupture_time, rupture_value", "k, exp_start, exp_end, lin_start, lin_end, is_censored")
def growth_features(spark, sf):
    return growth.features(curves(spark, sf), ["k"], "i", "y")


@query()
def bootstrap_means(spark, sf):
    return series.bootstrap_mean(table(spark, sf, "events").select("event_type", "value"), ["event_type"], "value", 10_000)


# -- segmentation ----------------------------------------------------------------

_OTSU = """e AS (SELECT img, min(v) AS lo, max(v) AS hi FROM img GROUP BY img),
hb AS (SELECT img, lo, hi, CASE WHEN hi > lo THEN least(floor((v - lo) * 256 / (hi - lo)), 255) ELSE 0 END::INT AS b, count(*) AS n FROM img JOIN e USING (img) GROUP BY ALL),
hm AS (SELECT *, lo + (b + 0.5::DOUBLE) * (hi - lo) / 256 AS mid FROM hb),
hc AS (SELECT img, b, mid, lo, sum(n) OVER u AS w1, sum(n * mid) OVER u AS s1, sum(n) OVER d AS w2, sum(n * mid) OVER d AS s2 FROM hm
  WINDOW u AS (PARTITION BY img ORDER BY b ROWS UNBOUNDED PRECEDING), d AS (PARTITION BY img ORDER BY b ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
hv AS (SELECT *, coalesce(round(w1 * w2 * (s1 / w1 - s2 / w2) ** 2, 6), -1) AS var FROM hc),
otsu AS (SELECT img, CASE WHEN w2 IS NULL THEN lo ELSE mid END AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY img ORDER BY var DESC, b) AS o FROM hv) WHERE o = 1)"""


@query(f"{IMG}, {_OTSU}\n--\nSELECT img, threshold FROM otsu", "threshold", "img")
def otsu_thresholds(spark, sf):
    return segmentation.otsu_thresholds(images(spark, sf), ["img"])


@query(f"""{IMG}, {_OTSU}, o AS (SELECT img, y, x, v > threshold AS p FROM img JOIN otsu USING (img)), s AS (SELECT img, sum(p::INT) * 2 >= count(*) AS flip FROM o GROUP BY img)
--
SELECT img, y, x FROM o JOIN s USING (img) WHERE p <> flip""", "", "img, y, x")
def otsu_segmentation(spark, sf):
    return segmentation.otsu_segmentation(images(spark, sf), ["img"]).select("img", "y", "x")


@query(f"{VID}\n--\nSELECT arena, t, quantile_cont(v, 0.1) AS level FROM vid GROUP BY ALL", "level", "arena, t")
def background_levels(spark, sf):
    return segmentation.background_levels(videos(spark, sf), ["arena"], lighter=False)


@query(f"""{VID}, l AS (SELECT arena, t, quantile_cont(v, 0.1) AS level FROM vid GROUP BY ALL), d AS (SELECT arena, t, 60 + level - arg_max(level, t) OVER (PARTITION BY arena) AS threshold FROM l),
f AS (SELECT *, bool_and(threshold BETWEEN 0 AND 255) OVER (PARTITION BY arena) AS fine FROM d)
--
SELECT arena, t, y, x FROM vid JOIN f USING (arena, t) WHERE fine AND v > threshold""", "", "arena, t, y, x")
def luminance_segmentation(spark, sf):
    v = videos(spark, sf)
    return segmentation.luminance_segmentation(v, segmentation.background_levels(v, ["arena"], False), ["arena"], 60.0, lighter=False)


_GRID = """cov AS (SELECT arena, quantile_cont(v, 0.5) AS base FROM vid GROUP BY arena),
cand AS (SELECT arena, (i - 1)::INT AS place, (1 - e::DOUBLE) * base AS threshold FROM cov, (SELECT generate_subscripts(l, 1) AS i, unnest(l) AS e FROM (SELECT [0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1, 0.0, -0.1, -0.2, -0.3, -0.4, -0.5, -0.6]::DOUBLE[] AS l))),
st AS (SELECT arena, t, v, lag(v) OVER (PARTITION BY arena, y, x ORDER BY t) AS b FROM vid),
fr AS (SELECT arena, place, threshold, t, sum((v > threshold)::INT) AS area, coalesce(sum(CASE WHEN b IS NOT NULL THEN ((v > threshold) <> (b > threshold))::INT END), 0) AS change FROM st JOIN cand USING (arena) GROUP BY ALL),
gr AS (SELECT arena, place, threshold, max(area)::BIGINT AS area, max(change)::BIGINT AS change, max(area) < 45 AND max(change) < 45 AS fine FROM fr GROUP BY ALL)"""


def _grid(spark, sf):
    v = videos(spark, sf)
    covering = v.groupBy("arena").agg(F.percentile("v", 0.5).alias("base"))
    return segmentation.threshold_grid(v, covering, ["arena"], False, 45)


@query(f"{VID}, {_GRID}\n--\nSELECT * FROM gr", "threshold", "arena, place, area, change, fine")
def threshold_grid(spark, sf):
    return _grid(spark, sf)


@query(f"""{VID}, {_GRID}, q AS (SELECT *, sum((NOT fine)::INT) OVER (PARTITION BY arena ORDER BY place) AS br FROM gr),
q2 AS (SELECT *, min(br) OVER (PARTITION BY arena) AS fr FROM q WHERE fine), q3 AS (SELECT *, row_number() OVER (PARTITION BY arena ORDER BY place) AS o FROM q2 WHERE br = fr)
--
SELECT arena, coalesce(max(threshold), 0) AS threshold FROM (SELECT DISTINCT arena FROM gr) a LEFT JOIN (SELECT arena, arg_max(threshold, o) AS threshold FROM q3 WHERE o <= 3 GROUP BY arena) b USING (arena) GROUP BY arena""", "threshold", "arena")
def picked_threshold(spark, sf):
    return segmentation.pick_threshold(_grid(spark, sf), ["arena"])


_BYTES = "by8 AS (SELECT img, y, x, least(greatest(floor(v * 400 + 128), 0), 255)::INT AS v FROM img)"


def _bytes(spark, sf):
    return images(spark, sf).withColumn("v", F.least(F.greatest(F.floor(F.col("v") * 400 + 128), F.lit(0)), F.lit(255)).cast("int"))


@query(f"""{IMG}, {_BYTES}, mk AS (SELECT img, v AS b, sum(CASE WHEN y BETWEEN 2 AND 5 AND x BETWEEN 2 AND 5 THEN 1 ELSE -1 END) AS d FROM by8 GROUP BY ALL),
al AS (SELECT g.img, i AS b, coalesce(d, 0) AS d FROM (SELECT DISTINCT img FROM mk) g, range(0, 256) r(i) LEFT JOIN mk ON mk.img = g.img AND mk.b = i),
sc AS (SELECT img, b, coalesce(sum(d) OVER (PARTITION BY img ORDER BY b ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS more FROM al)
--
SELECT img, min(CASE WHEN more > 0 THEN b END)::INT AS threshold FROM sc GROUP BY img""", "", "img, threshold")
def mask_thresholds(spark, sf):
    d = _bytes(spark, sf)
    return segmentation.mask_threshold(d, d.where("y between 2 and 5 and x between 2 and 5"), ["img"])


@query(f"""{IMG}
--
SELECT img, avg(CASE WHEN y BETWEEN 2 AND 5 AND x BETWEEN 2 AND 5 THEN v END) AS inside, avg(CASE WHEN NOT (y BETWEEN 2 AND 5 AND x BETWEEN 2 AND 5) THEN v END) AS outside,
  avg(CASE WHEN NOT (y BETWEEN 2 AND 5 AND x BETWEEN 2 AND 5) THEN v END) > avg(CASE WHEN y BETWEEN 2 AND 5 AND x BETWEEN 2 AND 5 THEN v END) AS lighter_background FROM img GROUP BY img""", "inside, outside", "img, lighter_background")
def lighter_background(spark, sf):
    d = images(spark, sf)
    return segmentation.inside_outside(d, d.where("y between 2 and 5 and x between 2 and 5"), ["img"])


_BGR = """bgr AS (SELECT img, y, x, v AS b, coalesce(lead(v) OVER (PARTITION BY img ORDER BY y, x), v) AS g, coalesce(lag(v) OVER (PARTITION BY img ORDER BY y, x), v) AS r FROM by8)"""


def _bgr(spark, sf):
    w = Window.partitionBy("img").orderBy("y", "x")
    return _bytes(spark, sf).select("img", "y", "x", F.col("v").alias("b"), F.coalesce(F.lead("v").over(w), "v").alias("g"), F.coalesce(F.lag("v").over(w), "v").alias("r"))


_HUE = """CASE WHEN mx = mn THEN 0 WHEN mx = r THEN (g - b) * 60.0::DOUBLE / (mx - mn) WHEN mx = g THEN (b - r) * 60.0::DOUBLE / (mx - mn) + 120 ELSE (r - g) * 60.0::DOUBLE / (mx - mn) + 240 END"""


@query(f"""{IMG}, {_BYTES}, {_BGR}, c AS (SELECT *, greatest(b, g, r) AS mx, least(b, g, r) AS mn, r * 0.299::DOUBLE + g * 0.587::DOUBLE + b * 0.114::DOUBLE AS l FROM bgr), d AS (SELECT *, {_HUE} AS h FROM c)
--
SELECT img, y, x, (round_even(CASE WHEN h < 0 THEN h + 360 ELSE h END / 2, 0)::INT % 180) AS hue, CASE WHEN mx > 0 THEN round_even((mx - mn) * 255.0::DOUBLE / mx, 0) ELSE 0 END::INT AS saturation, mx AS value,
  round_even(l, 0)::INT AS luma, least(greatest(round_even((b - l) * 0.492::DOUBLE + 128, 0), 0), 255)::INT AS u, least(greatest(round_even((r - l) * 0.877::DOUBLE + 128, 0), 0), 255)::INT AS v,
  round_even((mx + mn)::DOUBLE / 2, 0)::INT AS lightness FROM d""", "", "img, y, x, hue, saturation, value, luma, u, v, lightness")
def colour_spaces(spark, sf):
    s = color.spaces(F.col("b"), F.col("g"), F.col("r"))
    names = {"hue": s["hsv"][0], "saturation": s["hsv"][1], "value": s["hsv"][2], "luma": s["yuv"][0], "u": s["yuv"][1], "v": s["yuv"][2], "lightness": s["hls"][1]}
    return _bgr(spark, sf).select("img", "y", "x", *[c.alias(n) for n, c in names.items()])


_LIN = lambda c: f"CASE WHEN {c} / 255.0::DOUBLE <= 0.04045 THEN {c} / 255.0::DOUBLE / 12.92 ELSE (({c} / 255.0::DOUBLE + 0.055) / 1.055) ** 2.4 END"
_F3 = lambda v: f"CASE WHEN {v} > 0.008856 THEN {v} ** (1.0::DOUBLE / 3) ELSE {v} * 7.787 + 16.0::DOUBLE / 116 END"


@query(f"""{IMG}, {_BYTES}, {_BGR}, n AS (SELECT img, y, x, {_LIN('r')} AS lr, {_LIN('g')} AS lg, {_LIN('b')} AS lb FROM bgr),
q AS (SELECT img, y, x, (0.412453::DOUBLE * lr + 0.357580::DOUBLE * lg + 0.180423::DOUBLE * lb) / 0.950456::DOUBLE AS cx, 0.212671::DOUBLE * lr + 0.715160::DOUBLE * lg + 0.072169::DOUBLE * lb AS cy, (0.019334::DOUBLE * lr + 0.119193::DOUBLE * lg + 0.950227::DOUBLE * lb) / 1.088754::DOUBLE AS cz FROM n)
--
SELECT img, y, x, least(greatest(round_even((CASE WHEN cy > 0.008856 THEN cy ** (1.0::DOUBLE / 3) * 116 - 16 ELSE cy * 903.3 END) * (255.0::DOUBLE / 100), 0), 0), 255)::INT AS l,
  least(greatest(round_even((({_F3('cx')}) - ({_F3('cy')})) * 500 + 128, 0), 0), 255)::INT AS a, least(greatest(round_even((({_F3('cy')}) - ({_F3('cz')})) * 200 + 128, 0), 0), 255)::INT AS b FROM q""", "", "img, y, x, l, a, b")
def lab_space(spark, sf):
    l, a, b = color.lab(F.col("b"), F.col("g"), F.col("r"))  # noqa: E741
    return _bgr(spark, sf).select("img", "y", "x", l.alias("l"), a.alias("a"), b.alias("b"))


@query(f"""{IMG}, {_BYTES}, {_BGR}
--
SELECT img, y, x, (b * 1.0 + g * 2.0 + greatest(b, g, r) * 0.5)::DOUBLE AS v FROM bgr""", "v", "img, y, x")
def colour_combination(spark, sf):
    first, _, _ = color.split_weights({"bgr": [1, 2, 0], "hsv": [0, 0, 0.5], "lab2": [1, 0, 0], "luv": [0, 0, 0], "logical": "And"})
    return _bgr(spark, sf).select("img", "y", "x", color.combine(first, F.col("b"), F.col("g"), F.col("r")).alias("v"))


@query()
def first_principal_component(spark, sf):
    return segmentation.first_component(_bgr(spark, sf), ["img"]).select("img", "y", "x", "pc1", "variance_share")


@query()
def kmeans_clusters(spark, sf):
    d = segmentation.kmeans_pixels(images(spark, sf), 3)
    return d.groupBy("img", "cluster").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"))


@query()
def local_threshold_votes(spark, sf):
    return segmentation.local_votes(images(spark, sf), ["img"], 4, 2)


# -- pixel sets ----------------------------------------------------------------


def _pair(spark, sf):
    f = foreground(spark, sf)
    return f, f.select((F.col("img") - 1).alias("img"), "y", "x")


for _how, _op in (("And", "INTERSECT"), ("Or", "UNION"), ("Xor", None)):
    _nx = "nx AS (SELECT img - 1 AS img, y, x FROM fg)"
    _body = f"SELECT img, y, x FROM fg {_op} SELECT img, y, x FROM nx" if _op else "(SELECT img, y, x FROM fg EXCEPT SELECT img, y, x FROM nx) UNION ALL (SELECT img, y, x FROM nx EXCEPT SELECT img, y, x FROM fg)"

    def _logical(spark, sf, how=_how):
        return pixels.combine(*_pair(spark, sf), ["img", "y", "x"], how)

    _logical.__name__ = f"logical_{_how.lower()}"
    query(f"{IMG}, {_nx}\n--\n{_body}", "", "img, y, x")(_logical)


@query(f"{IMG}, nx AS (SELECT img - 1 AS img, y, x FROM fg)\n--\nSELECT img, y, x FROM fg EXCEPT SELECT img, y, x FROM nx", "", "img, y, x")
def removed_coordinates(spark, sf):
    return pixels.without(*_pair(spark, sf), ["img", "y", "x"])


@query(f"{IMG}, nx AS (SELECT img - 1 AS img, y, x FROM fg)\n--\nSELECT img, y, x FROM fg INTERSECT SELECT img, y, x FROM nx", "", "img, y, x")
def common_coordinates(spark, sf):
    return pixels.common(*_pair(spark, sf), ["img", "y", "x"])


@query("SELECT event_id, user_id, event_type, count(*) OVER (PARTITION BY user_id, event_type, ts::DATE) > 1 AS repeated FROM events", "", "event_id, user_id, event_type, repeated")
def repeated_coordinates(spark, sf):
    d = table(spark, sf, "events").withColumn("day", F.to_date("ts"))
    return pixels.repeated(d, ["user_id", "event_type", "day"]).select("event_id", "user_id", "event_type", "repeated")


@query(f"""{VID}, n AS (SELECT arena, count(*) AS n FROM frames GROUP BY arena)
--
SELECT arena, y, x FROM vid JOIN n USING (arena) GROUP BY arena, y, x, n HAVING count(*) >= n // 2""", "", "arena, y, x")
def median_shape(spark, sf):
    v = videos(spark, sf)
    n = v.select("arena", "t").distinct().groupBy("arena").agg(F.count(F.lit(1)).alias("n"))
    return pixels.median_shape(v, ["arena"], n)


for _before, _after, _least in ((1, 1, 2), (2, 2, 2), (5, 0, 6)):

    def _votes(spark, sf, b=_before, a=_after, m=_least):
        v = videos(spark, sf)
        return pixels.frame_votes(v, ["arena"], b, a, v.select("arena", "t").distinct(), m)

    _votes.__name__ = f"frame_votes_{_before + _after + 1}"
    query(f"""{VID}
--
SELECT f.arena, f.t, y, x FROM frames f JOIN vid v ON v.arena = f.arena AND v.t BETWEEN f.t - {_before} AND f.t + {_after} GROUP BY ALL HAVING count(*) >= {_least}""", "", "arena, t, y, x")(_votes)


@query(f"""{VID}, s AS (SELECT arena, y, x FROM vid WHERE t = 0), w AS (SELECT v.arena, v.t, count(*) AS n FROM vid v LEFT JOIN s ON s.arena = v.arena AND s.y = v.y AND s.x = v.x WHERE s.arena IS NULL GROUP BY ALL)
--
SELECT arena, t, coalesce(n, 0) AS newly_explored FROM frames LEFT JOIN w USING (arena, t)""", "", "arena, t, newly_explored")
def newly_explored(spark, sf):
    v = videos(spark, sf)
    return pixels.newly_explored(v, ["arena"], v.select("arena", "t").distinct())


_NEAR = "SELECT a.img, a.y, a.x, count(*) FILTER (b.v {test})::INT AS count FROM img a JOIN (SELECT * FROM (VALUES {offs}) o(dy, dx)) o ON true JOIN img b ON b.img = a.img AND b.y = least(greatest(a.y + dy, 0), 7) AND b.x = least(greatest(a.x + dx, 0), 7) GROUP BY a.img, a.y, a.x"
for _name, _offs, _test, _cond in (("neighbours_above", pixels.SQUARE, "> 0", lambda c: c > 0), ("neighbours_below", pixels.CROSS, "< -0.1", lambda c: c < -0.1), ("neighbours_diagonal", pixels.DIAGONAL, "> 0.05", lambda c: c > 0.05)):

    def _counts(spark, sf, offs=_offs, cond=_cond):
        return pixels.neighbour_counts(images(spark, sf), ["img"], cond(F.col("v")), offs, 8, 8)

    _counts.__name__ = _name
    query(f"{IMG}\n--\n" + _NEAR.format(test=_test, offs=", ".join(map(str, _offs))), "", "img, y, x, count")(_counts)


_CROSS = "(0, 0), (-1, 0), (0, -1), (0, 1), (1, 0)"


@query(f"{IMG}\n--\nSELECT DISTINCT img, y + dy AS y, x + dx AS x FROM fg, (VALUES {_CROSS}) o(dy, dx) WHERE y + dy BETWEEN 0 AND 7 AND x + dx BETWEEN 0 AND 7", "", "img, y, x")
def dilation(spark, sf):
    return pixels.dilate(foreground(spark, sf), ["img"], pixels.CROSS, 8, 8)


_ERODE = f"""ne AS (SELECT f.img, f.y, f.x, f.y + dy AS ny, f.x + dx AS nx FROM fg f, (VALUES {_CROSS}) o(dy, dx)),
er AS (SELECT ne.img, ne.y, ne.x FROM ne LEFT JOIN fg ON fg.img = ne.img AND fg.y = ny AND fg.x = nx GROUP BY ALL HAVING bool_and(fg.img IS NOT NULL OR ny NOT BETWEEN 0 AND 7 OR nx NOT BETWEEN 0 AND 7)),
es AS (SELECT ne.img, ne.y, ne.x FROM ne LEFT JOIN fg ON fg.img = ne.img AND fg.y = ny AND fg.x = nx GROUP BY ALL HAVING bool_and(fg.img IS NOT NULL))"""


@query(f"{IMG}, {_ERODE}\n--\nSELECT img, y, x FROM er", "", "img, y, x")
def erosion(spark, sf):
    return pixels.erode(foreground(spark, sf), ["img"], pixels.CROSS, 8, 8)


@query(f"{IMG}, {_ERODE}\n--\nSELECT img, y, x FROM fg EXCEPT SELECT img, y, x FROM es", "", "img, y, x")
def contour_pixels(spark, sf):
    return pixels.contours(foreground(spark, sf), ["img"])


@query(f"""{IMG}, a AS (SELECT * FROM fg WHERE y < 3), b AS (SELECT * FROM fg WHERE y > 4), d AS (SELECT a.img, min((a.y - b.y) ** 2 + (a.x - b.x) ** 2) AS d FROM a JOIN b USING (img) GROUP BY a.img)
--
SELECT img, sqrt(d) AS distance FROM d""", "distance", "img")
def least_distances(spark, sf):
    f = foreground(spark, sf)
    return pixels.least_distance(f.where("y < 3"), f.where("y > 4"), ["img"], 11)


for _far in (True, False):

    def _extreme(spark, sf, far=_far):
        return pixels.extreme_pair(foreground(spark, sf), ["img"], far).select("img", "distance")

    _extreme.__name__ = "farthest_pairs" if _far else "closest_pairs"
    query(f"{IMG}\n--\nSELECT a.img, {'max' if _far else 'min'}(sqrt((a.y - b.y) ** 2 + (a.x - b.x) ** 2)) AS distance FROM fg a JOIN fg b ON a.img = b.img AND (a.y < b.y OR (a.y = b.y AND a.x < b.x)) GROUP BY a.img", "distance", "img")(_extreme)


@query(f"""{IMG}, k AS (SELECT img, min(y) AS y0, min(x) AS x0 FROM fg GROUP BY img), b AS (SELECT DISTINCT fg.img, s, (y - y0) // s AS by_, (x - x0) // s AS bx FROM fg JOIN k USING (img), (VALUES (4), (2), (1)) v(s)),
l AS (SELECT img, ln(count(*)) AS n, ln(1.0::DOUBLE / s) AS q FROM b GROUP BY img, s)
--
SELECT img, coalesce(regr_slope(n, q), 0) AS fractal_dimension, coalesce(CASE WHEN isnan(corr(n, q)) THEN 0 ELSE corr(n, q) END, 0) AS fractal_r_value, count(*) AS fractal_box_nb FROM l GROUP BY img""", "fractal_dimension, fractal_r_value", "img, fractal_box_nb")
def box_dimension(spark, sf):
    return pixels.box_dimension(foreground(spark, sf), ["img"], (4, 2, 1))


@query(f"{IMG}\n--\nSELECT img, min(y) - 1 AS top, max(y) + 1 AS bottom, min(x) - 1 AS \"left\", max(x) + 1 AS \"right\" FROM fg GROUP BY img", "", 'img, top, bottom, "left", "right"')
def zoom_boxes(spark, sf):
    return pixels.boxes(foreground(spark, sf), ["img"], 1)


@query(f"{IMG}, c AS (SELECT img, x, count(*) AS n FROM fg GROUP BY ALL), g AS (SELECT i.img, r.x, coalesce(n, 0) > 3 AS f FROM (SELECT DISTINCT img FROM img) i, range(0, 8) r(x) LEFT JOIN c ON c.img = i.img AND c.x = r.x), l AS (SELECT *, lag(f) OVER w AS a, lead(f) OVER w AS b FROM g WINDOW w AS (PARTITION BY img ORDER BY x))\n--\nSELECT img, x::INT AS x, f AND NOT coalesce(a, false) AS starts, f AND NOT coalesce(b, false) AS ends FROM l WHERE f AND (NOT coalesce(a, false) OR NOT coalesce(b, false))", "", "img, x, starts, ends")
def projection_runs(spark, sf):
    f = foreground(spark, sf)
    n = pixels.projections(f, ["img"], "x")
    dense = images(spark, sf).select("img", "x").distinct().join(n, ["img", "x"], "left").withColumn("full", F.coalesce("pixels", F.lit(0)) > 3)
    return series.run_bounds(dense, ["img"], "x", "full")


@query(f"""{IMG}
--
SELECT img, ((sum((y = 0)::INT) = 8)::INT + (sum((y = 7)::INT) = 8)::INT + (sum((x = 0)::INT) = 8)::INT + (sum((x = 7)::INT) = 8)::INT)::INT AS full_borders FROM img WHERE v > -0.1 GROUP BY img""", "", "img, full_borders")
def border_attestation(spark, sf):
    return pixels.full_borders(images(spark, sf).where("v > -0.1"), ["img"], 8, 8)


@query(f"""{IMG}
--
SELECT img, y, x, ((y + 0.5 - 4) / 4) ** 2 + ((x + 0.5 - 4) / 4) ** 2 <= 1 AS inside, y = 0 OR x = 0 OR y = 7 OR x = 7 AS border FROM img""", "", "img, y, x, inside, border")
def ellipse_mask(spark, sf):
    h = F.lit(8)
    return images(spark, sf).select("img", "y", "x", formulas.elliptic(F.col("y"), F.col("x"), h, h).alias("inside"), formulas.on_border(F.col("y"), F.col("x"), h, h).alias("border"))


# -- components ----------------------------------------------------------------

_CC = """r(img, y, x, root) AS (SELECT img, y, x, y * 8 + x FROM fg UNION SELECT b.img, b.y, b.x, r.root FROM r JOIN fg b ON b.img = r.img AND abs(b.y - r.y) <= 1 AND abs(b.x - r.x) <= 1 WHERE r.root < b.y * 8 + b.x),
cr AS (SELECT img, y, x, min(root) AS root FROM r GROUP BY ALL),
cc AS (SELECT img, y, x, dense_rank() OVER (PARTITION BY img ORDER BY root)::INT AS component FROM cr),
cs AS (SELECT img, component, count(*) AS area, min(y) AS top, min(x) AS "left", max(y) AS bottom, max(x) AS "right", avg(y) AS cy, avg(x) AS cx FROM cc GROUP BY ALL)"""


def _labelled(spark, sf):
    return C.components(foreground(spark, sf), ["img"])


@query(f"{IMG}, {_CC}\n--\nSELECT * FROM cs", "cy, cx", 'img, component, area, top, "left", bottom, "right"')
def component_stats(spark, sf):
    return C.stats(_labelled(spark, sf), ["img"])


@query(f"{IMG}, {_CC}\n--\nSELECT img, component, area, row_number() OVER (PARTITION BY img ORDER BY area DESC, component DESC)::INT AS rank FROM cs", "", "img, component, area, rank")
def component_ranks(spark, sf):
    return C.rank_by_size(C.stats(_labelled(spark, sf), ["img"]), ["img"]).select("img", "component", "area", "rank")


@query(f"{IMG}, {_CC}, b AS (SELECT img, component FROM (SELECT *, row_number() OVER (PARTITION BY img ORDER BY area DESC, component) AS o FROM cs) WHERE o = 1)\n--\nSELECT img, y, x, component FROM cc JOIN b USING (img, component)", "", "img, y, x, component")
def largest_component(spark, sf):
    return C.keep_largest(_labelled(spark, sf), ["img"]).select("img", "y", "x", "component")


@query(f"{IMG}, {_CC}\n--\nSELECT img, y, x, component FROM cc JOIN cs USING (img, component) WHERE area BETWEEN 3 AND 20", "", "img, y, x, component")
def sized_components(spark, sf):
    return C.keep_sizes(_labelled(spark, sf), ["img"], 3, 20).select("img", "y", "x", "component")


@query(f"{IMG}, {_CC}, h AS (SELECT DISTINCT c.img, component FROM cc c JOIN fg f ON f.img = c.img + 1 AND f.y = c.y AND f.x = c.x)\n--\nSELECT img, y, x, component FROM cc JOIN h USING (img, component)", "", "img, y, x, component")
def touching_components(spark, sf):
    _, ref = _pair(spark, sf)
    return C.touching(_labelled(spark, sf), ref, ["img"]).select("img", "y", "x", "component")


@query(f"{IMG}, {_CC}, s AS (SELECT c.img, component, count(*) AS n FROM cc c JOIN fg f ON f.img = c.img + 1 AND f.y = c.y AND f.x = c.x GROUP BY ALL)\n--\nSELECT img, component, n AS shared FROM (SELECT *, row_number() OVER (PARTITION BY img ORDER BY n DESC, component) AS o FROM s) WHERE o = 1", "", "img, component, shared")
def main_components(spark, sf):
    _, ref = _pair(spark, sf)
    return C.main_component(_labelled(spark, sf), ref, ["img"])


@query(f"""{IMG}, bg AS (SELECT i.img, i.y, i.x FROM (SELECT img, y, x FROM img WHERE v <= 0) i),
r(img, y, x, out) AS (SELECT img, y, x, 1 FROM bg b WHERE y IN (0, 7) OR x IN (0, 7) UNION SELECT b.img, b.y, b.x, 1 FROM r JOIN bg b ON b.img = r.img AND abs(b.y - r.y) + abs(b.x - r.x) = 1),
ho AS (SELECT img, y, x FROM bg EXCEPT SELECT img, y, x FROM r)
--
SELECT g.img, count(ho.img)::INT AS total_hole_area FROM (SELECT DISTINCT img FROM fg) g LEFT JOIN ho USING (img) GROUP BY g.img""", "", "img, total_hole_area")
def hole_areas(spark, sf):
    return C.holes(foreground(spark, sf), ["img"]).select("img", "total_hole_area")


@query(f"{IMG}, {_CC}, l AS (SELECT *, floor((row_number() OVER (PARTITION BY img ORDER BY cy, cx, component) - 1) / ceil(count(*) OVER (PARTITION BY img) / 2.0)) AS line FROM cs)\n--\nSELECT img, component, row_number() OVER (PARTITION BY img ORDER BY line, cx, cy, component)::INT AS place FROM l", "", "img, component, place")
def reading_order(spark, sf):
    return C.reading_order(C.stats(_labelled(spark, sf), ["img"]), ["img"], 2).select("img", "component", "place")


@query()
def arena_boxes(spark, sf):
    s = C.stats(_labelled(spark, sf), ["img"])
    return C.same_sized_boxes(C.arena_boxes(s, ["img"], 8, 8), ["img"], 8, 8)


@query(f"""{IMG}, bg AS (SELECT i.img, a.y, b.x FROM (SELECT DISTINCT img FROM fg) i, range(-1, 9) a(y), range(-1, 9) b(x) EXCEPT SELECT img, y, x FROM fg),
r(img, y, x) AS (SELECT img, y, x FROM bg WHERE y = -1 AND x = -1 UNION SELECT b.img, b.y, b.x FROM r JOIN bg b ON b.img = r.img AND abs(b.y - r.y) <= 1 AND abs(b.x - r.x) <= 1)
--
SELECT img, y::INT AS y, x::INT AS x FROM (SELECT img, y, x FROM fg UNION ALL (SELECT img, y, x FROM bg EXCEPT SELECT img, y, x FROM r))""", "", "img, y, x")
def closed_holes(spark, sf):
    return C.filled(foreground(spark, sf), ["img"])


@query()
def outline_descriptors(spark, sf):
    return polygon.shape_table(foreground(spark, sf), ["img"])


# -- time ----------------------------------------------------------------


def _tracked(spark, sf):
    v = videos(spark, sf)
    return tracking.colonies(v, ["arena"], 12, 12, 2, v.select("arena", "t").distinct())


@query()
def colony_tracks(spark, sf):
    return tracking.centroids(_tracked(spark, sf), ["arena"])


@query()
def colony_shapes(spark, sf):
    return tracking.colony_descriptors(_tracked(spark, sf), ["arena"])


_PATH = """u AS (SELECT user_id AS colony, ts, value AS x, (value * 7 + user_id) % 50 AS y FROM events), d AS (SELECT colony, arg_min(y, ts) AS y0, arg_min(x, ts) AS x0, arg_max(y, ts) AS y1, arg_max(x, ts) AS x1, count(*) AS frames FROM u GROUP BY colony),
p AS (SELECT *, sqrt((y1 - y0) ** 2 + (x1 - x0) ** 2) AS distance FROM d), a AS (SELECT *, atan2(y0 - y1, x1 - x0) AS angle FROM p WHERE distance > 0)"""


def _paths(spark, sf):
    e = table(spark, sf, "events").select(F.lit(0).alias("arena"), F.col("user_id").alias("colony"), F.col("ts").alias("t"), F.col("value").alias("x"), ((F.col("value") * 7 + F.col("user_id")) % 50).alias("y"), F.lit(1).alias("area"))
    return tracking.paths(e, ["arena"])


@query(f"{_PATH}\n--\nSELECT colony, frames, distance, angle FROM a", "distance, angle", "colony, frames")
def colony_directions(spark, sf):
    return tracking.directions(_paths(spark, sf)).select("colony", "frames", "distance", "angle")


@query(f"{_PATH}, b AS (SELECT least(floor(((pi() / 2 - angle) - 2 * pi() * floor((pi() / 2 - angle) / (2 * pi()))) * 12 / (2 * pi())), 11)::INT AS bin FROM a), n AS (SELECT bin, count(*) AS n FROM b GROUP BY bin)\n--\nSELECT bin, n, n / max(n) OVER () AS share FROM n", "share", "bin, n")
def direction_rose(spark, sf):
    return tracking.rose(tracking.directions(_paths(spark, sf)), ["arena"]).drop("arena")


@query(f"{_PATH}\n--\nSELECT atan2(avg(sin(angle)), avg(cos(angle))) AS mean_angle, sqrt(avg(sin(angle)) ** 2 + avg(cos(angle)) ** 2) AS concentration FROM a", "mean_angle, concentration")
def mean_direction(spark, sf):
    return tracking.mean_direction(tracking.directions(_paths(spark, sf)), ["arena"]).drop("arena")


@query(f"{_PATH}\n--\nSELECT colony, frames, row_number() OVER (ORDER BY frames DESC, colony)::INT AS place FROM p ORDER BY place LIMIT 10", "", "colony, frames, place")
def top_colonies(spark, sf):
    return tracking.top_colonies(_paths(spark, sf), ["arena"], "frames", 10).select("colony", "frames", "place")


@query(f"{VID}, c AS (SELECT arena, t, y AS colony, sum(v) AS s FROM vid GROUP BY ALL)\n--\nSELECT arena, t, max(s) FILTER (colony = 0) AS v0, max(s) FILTER (colony = 1) AS v1, max(s) FILTER (colony = 2) AS v2 FROM c GROUP BY ALL", "v0, v1, v2", "arena, t")
def wide_table(spark, sf):
    c = videos(spark, sf).groupBy("arena", "t", F.col("y").alias("colony")).agg(F.sum("v").alias("v"))
    return tracking.wide(c, ["arena"], "v", [0, 1, 2])


@query()
def shape_states(spark, sf):
    v = videos(spark, sf)
    rules = motion.Rules(max_distance=3)
    states = motion.track_shapes(v, ["arena"], 12, 12, rules, v.select("arena", "t").distinct())
    return descriptors.moments(states, ["arena", "t"], ("area", "cx", "cy"))


@query(f"""{VID}, m AS (SELECT *, v / nullif(avg(v) OVER (PARTITION BY arena, t), 0) AS q FROM vid), s AS (SELECT arena, t, y, x, q, lag(q) OVER w AS a, lead(q) OVER w AS b FROM m WINDOW w AS (PARTITION BY arena, y, x ORDER BY t)),
z AS (SELECT arena, t, y, x, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN (b - a) / 4 WHEN b IS NOT NULL THEN (b - q) / 2 WHEN a IS NOT NULL THEN (q - a) / 2 END AS slope FROM s)
--
SELECT arena, t, y, x, sign(slope)::INT AS sign FROM z WHERE slope IS NOT NULL""", "", "arena, t, y, x, sign")
def oscillation_signs(spark, sf):
    return motion.oscillation_signs(videos(spark, sf), ["arena"], 2)


@query(f"""{VID}, m AS (SELECT *, v / nullif(avg(v) OVER (PARTITION BY arena, t), 0) AS q FROM vid), s AS (SELECT arena, t, y, x, q, lag(q) OVER w AS a, lead(q) OVER w AS b FROM m WINDOW w AS (PARTITION BY arena, y, x ORDER BY t)),
z AS (SELECT arena, t, y, x, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN (b - a) / 4 WHEN b IS NOT NULL THEN (b - q) / 2 WHEN a IS NOT NULL THEN (q - a) / 2 END AS slope FROM s),
g AS (SELECT arena, t, y, x, sign(slope)::INT AS sign, CASE sign(slope)::INT WHEN 1 THEN 1 ELSE 2 END AS phase FROM z WHERE slope <> 0),
o AS (SELECT dy, dx FROM range(-1, 2) a(dy), range(-1, 2) b(dx) WHERE dy <> 0 OR dx <> 0),
n AS (SELECT g.arena, g.t, g.y + dy AS y, g.x + dx AS x, phase, count(*) AS n FROM g, o GROUP BY ALL HAVING count(*) > 4),
k AS (SELECT n.* FROM n JOIN (SELECT arena, t, y, x FROM z WHERE slope IS NOT NULL) p USING (arena, t, y, x))
--
SELECT DISTINCT k.arena, k.t, k.y::INT AS y, k.x::INT AS x, k.phase FROM k, o JOIN k l ON l.arena = k.arena AND l.t = k.t AND l.phase = k.phase AND l.y = k.y + dy AND l.x = k.x + dx""", "", "arena, t, y, x, phase")
def oscillating_zones(spark, sf):
    return motion.oscillating_zones(motion.oscillation_signs(videos(spark, sf), ["arena"]), ["arena"])


@query(f"{VID}, n AS (SELECT arena, count(*) AS n FROM frames GROUP BY arena)\n--\nSELECT arena, n, CASE WHEN n >= 40 THEN n // 20 ELSE 1 END::INT AS step, n < 2 AS still FROM n", "", "arena, n, step, still")
def frame_ranges(spark, sf):
    return motion.frame_ranges(videos(spark, sf).select("arena", "t").distinct(), ["arena"])


@query(f"""{VID}, a AS (SELECT arena, t, count(*) AS n, max(y) - min(y) + 1 AS h, max(x) - min(x) + 1 AS w FROM vid GROUP BY ALL), s AS (SELECT arena, t, n / (h * w)::DOUBLE AS solidity FROM a),
b AS (SELECT arena, avg(solidity) AS calm FROM s WHERE t <= 3 GROUP BY arena)
--
SELECT s.arena, min(CASE WHEN t >= 3 AND solidity < 0.9 * calm THEN t END) AS iso_digi_transi, CASE WHEN max(calm) IS NOT NULL THEN (min(CASE WHEN t >= 3 AND solidity < 0.9 * calm THEN t END) IS NULL)::INT END AS is_growth_isotropic FROM s LEFT JOIN b USING (arena) GROUP BY s.arena""", "", "arena, iso_digi_transi, is_growth_isotropic")
def growth_transitions(spark, sf):
    a = videos(spark, sf).groupBy("arena", "t").agg((F.count(F.lit(1)) / ((F.max("y") - F.min("y") + 1) * (F.max("x") - F.min("x") + 1))).alias("solidity"))
    return growth.transitions(a.withColumn("first_move", F.lit(3)), ["arena"])


# -- candidates, names, times ----------------------------------------------------------------


@query("""f AS (SELECT c_custkey AS candidate, c_nationkey AS components, round(c_acctbal) AS area FROM customer WHERE c_nationkey >= 1),
r AS (SELECT *, dense_rank() OVER (ORDER BY components) AS r1, dense_rank() OVER (ORDER BY area) AS r2 FROM f), s AS (SELECT *, max(r1) OVER () - r1 + r2 - 1 AS score FROM r)
--
SELECT candidate, score::INT AS score, row_number() OVER (ORDER BY score DESC, candidate)::INT AS place FROM s ORDER BY place LIMIT 20""", "", "candidate, score, place")
def candidate_scores(spark, sf):
    f = table(spark, sf, "customer").select(F.col("c_custkey").alias("candidate"), F.col("c_nationkey").alias("components"), F.round("c_acctbal").alias("area"))
    s = filters.score_candidates(filters.fair_candidates(f, least_area=-1e9), ["components"], ["area"])
    return filters.best_candidates(s).select("candidate", "score", "place")


@query()
def filtered_images(spark, sf):
    d = images(spark, sf)
    out = None
    for name in K.FILTERS:
        one = filters.apply_filter(d, ["img"], name, 1.0).groupBy("img").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("deviation")).withColumn("filter", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


@query()
def background_images(spark, sf):
    return filters.opened_background(images(spark, sf), ["img"], 1)


def _some_networks(spark, sf):
    return network.skeletons(foreground(spark, sf), ["img"])


@query()
def skeleton_pixels(spark, sf):
    return _some_networks(spark, sf)


@query()
def graph_vertices(spark, sf):
    return network.vertex_table(network.graphs(_some_networks(spark, sf), ["img"]), ["img"])


@query()
def graph_edges(spark, sf):
    s = _some_networks(spark, sf)
    return network.unique_edges(network.edge_table(network.graphs(s, ["img"]), s, ["img"], images(spark, sf)), ["img"])


@query()
def contracted_edges(spark, sf):
    s = _some_networks(spark, sf)
    return network.contract(network.edge_table(network.graphs(s, ["img"]), s, ["img"]), ["img"])


@query()
def network_methods(spark, sf):
    return network.best_method(network.method_scores(images(spark, sf), ["img"]), ["img"])


@query("SELECT p_partkey, CASE WHEN length(p_name) > 8 THEN p_name[1:4] || '...' || right(p_name, 4) ELSE p_name END AS short FROM part", "", "p_partkey, short")
def short_paths(spark, sf):
    return table(spark, sf, "part").select("p_partkey", formulas.short_path(F.col("p_name"), 4, 4).alias("short"))


@query("""n AS (SELECT p_partkey, 'image' || (p_partkey % 1000) || '.tif' AS name FROM part)
--
SELECT p_partkey, name, 'image' || lpad((p_partkey % 1000)::VARCHAR, 20, '0') || '.tif' AS key FROM n""", "", "p_partkey, name, key")
def natural_keys(spark, sf):
    d = table(spark, sf, "part").select("p_partkey", F.concat(F.lit("image"), (F.col("p_partkey") % 1000).cast("string"), F.lit(".tif")).alias("name"))
    return d.withColumn("key", formulas.natural_key(F.col("name")))


@query("""s AS (SELECT c_nationkey, arg_min(c_acctbal, {'d': abs(c_acctbal - 1000), 'k': c_custkey}) AS nearest FROM customer GROUP BY c_nationkey)
--
SELECT c_nationkey, nearest FROM s""", "nearest", "c_nationkey")
def nearest_values(spark, sf):
    c = table(spark, sf, "customer")
    return c.groupBy("c_nationkey").agg(F.min_by("c_acctbal", F.struct(F.abs(F.col("c_acctbal") - 1000), F.col("c_custkey"))).alias("nearest"))


@query("""t AS (SELECT o_orderpriority AS k, o_orderkey, date_diff('second', min(o_orderdate) OVER (PARTITION BY o_orderpriority), o_orderdate) / 60.0::DOUBLE AS minutes FROM orders)
--
SELECT k, o_orderkey, minutes FROM t""", "minutes", "k, o_orderkey")
def capture_minutes(spark, sf):
    from ..sources.frames import capture_minutes as minutes

    o = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("k"), "o_orderkey", F.date_format("o_orderdate", "yyyy:MM:dd HH:mm:ss").alias("stamp"), F.col("o_orderkey").alias("place"))
    return minutes(o, ["k"]).select("k", "o_orderkey", "minutes")


# -- arenas and whole analyses ----------------------------------------------------------------


@query(f"""{IMG}, {_CC}, m AS (SELECT img, quantile_cont(area, 0.5) AS m, stddev_pop(area) AS s FROM cs GROUP BY img),
tl AS (SELECT (i - 1)::INT AS i, 0.75::DOUBLE - (i - 1) * 0.05::DOUBLE AS t FROM range(1, 16) r(i)), tn AS (SELECT img, i, count(*) AS n FROM cs JOIN m USING (img), tl WHERE abs(area - m) <= round(t, 2) * m GROUP BY ALL),
hit AS (SELECT img, min(i) AS i FROM tn WHERE n = 2 GROUP BY img)
--
SELECT cs.img, component, area FROM cs JOIN m USING (img) LEFT JOIN hit USING (img) LEFT JOIN tl ON tl.i = hit.i WHERE CASE WHEN hit.i IS NOT NULL THEN abs(area - m) <= round(t, 2) * m ELSE abs(area - m) <= 3 * s END""", "", "img, component, area")
def selected_shapes(spark, sf):
    return arenas.select_shapes(C.stats(_labelled(spark, sf), ["img"]), ["img"], 2).select("img", "component", "area")


@query(f"{IMG}, {_CC}\n--\nSELECT img, (1.5::DOUBLE / avg(\"right\" - \"left\" + 1)) ** 2 AS pixel_area FROM cs GROUP BY img", "pixel_area", "img")
def pixel_areas(spark, sf):
    return arenas.pixel_area(C.stats(_labelled(spark, sf), ["img"]), ["img"], 8, blob_mm=1.5)


@query(f"{IMG}, {_CC}, b AS (SELECT img, ((bottom + 1 - top) * (\"right\" + 1 - \"left\"))::DOUBLE AS a FROM cs), m AS (SELECT img, quantile_cont(a, 0.5) AS m FROM b GROUP BY img)\n--\nSELECT img, bool_or(a > 10 * m OR a * 10 < m) AS odd FROM b JOIN m USING (img) GROUP BY img", "", "img, odd")
def odd_sized_arenas(spark, sf):
    b = C.stats(_labelled(spark, sf), ["img"]).withColumn("bottom", F.col("bottom") + 1).withColumn("right", F.col("right") + 1)
    return arenas.odd_sized(b, ["img"], 10.0)


@query(f"""{VID}, b AS (SELECT * FROM (VALUES (1, 0, 6, 0, 6), (2, 4, 12, 5, 12)) b(box, t0, b0, l0, r0))
--
SELECT arena AS folder, box AS arena, t, y - t0 AS y, x - l0 AS x, v FROM vid JOIN b ON y >= t0 AND y < b0 AND x >= l0 AND x < r0""", "v", "folder, arena, t, y, x")
def arena_pixels(spark, sf):
    boxes = spark.createDataFrame([(1, 0, 6, 0, 6), (2, 4, 12, 5, 12)], "arena int, top int, bottom int, left int, right int")
    v = videos(spark, sf).withColumnRenamed("arena", "folder")
    return arenas.into_arenas(v, boxes, tile=4).select("folder", "arena", "t", "y", "x", "v")


@query(f"{VID}, f AS (SELECT arena, t, count(*) AS n, sum(v) AS s FROM vid GROUP BY ALL)\n--\nSELECT arena, arg_min(n, t) AS first_pixels, arg_max(n, t) AS last_pixels, arg_min(s, t) AS first_total, arg_max(s, t) AS last_total FROM f GROUP BY arena", "first_total, last_total", "arena, first_pixels, last_pixels")
def end_frames(spark, sf):
    f = videos(spark, sf).groupBy("arena", "t").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("s"))
    e = arenas.end_frames(f, ["arena"], "t", ["n", "s"])
    return e.select("arena", F.col("first.n").alias("first_pixels"), F.col("last.n").alias("last_pixels"), F.col("first.s").alias("first_total"), F.col("last.s").alias("last_total"))


@query(f"{IMG}, {_BYTES}, {_BGR}\n--\nSELECT img, bool_and(b = g AND g = r) AS grey FROM bgr GROUP BY img", "", "img, grey")
def grey_images(spark, sf):
    return arenas.is_grey(_bgr(spark, sf), ["img"])


@query()
def moving_boxes(spark, sf):
    return arenas.moving_boxes(_tracked(spark, sf), ["arena"], 12, 12, 1)


@query()
def crop_boxes(spark, sf):
    f = foreground(spark, sf)
    runs = {}
    for axis in ("x", "y"):
        dense = images(spark, sf).select("img", axis).distinct().join(pixels.projections(f, ["img"], axis), ["img", axis], "left").withColumn("full", F.coalesce("pixels", F.lit(0)) > 3)
        runs[axis] = series.run_bounds(dense, ["img"], axis, "full").withColumnRenamed(axis, "place")
    return arenas.crop_box(runs["x"], runs["y"], ["img"], 8, 8)


@query()
def channel_search(spark, sf):
    return search.search_channels(_bgr(spark, sf), ["img"], 5)


@query()
def logical_search(spark, sf):
    d = _bgr(spark, sf)
    return search.search_logical(d, ["img"], search.search_channels(d, ["img"], 2))


@query()
def channel_sums(spark, sf):
    d = _bgr(spark, sf)
    return search.search_sums(d, ["img"], search.search_channels(d, ["img"], 19))


def _analysis(spark, sf) -> pipeline.Results:
    return pipeline.analyse(videos(spark, sf), Settings(most_distance=3, fractal=True, networks=True), 12, 12)


@query()
def analysis_frames(spark, sf):
    return _analysis(spark, sf).frames


@query()
def analysis_arenas(spark, sf):
    return _analysis(spark, sf).arenas


@query()
def analysis_edges(spark, sf):
    return _analysis(spark, sf).edges


# -- dynamics ----------------------------------------------------------------

for _how, _order in (("largest", "area DESC, component"), ("most_central", "round((cy - 4) ** 2 + (cx - 4) ** 2, 6), component")):

    def _origins(spark, sf, how=_how):
        return dynamics.origin_component(C.stats(_labelled(spark, sf), ["img"]), ["img"], 8, 8, how)

    _origins.__name__ = f"origin_{_how}"
    query(f"{IMG}, {_CC}\n--\nSELECT img, component, area, least(area * 1.2::DOUBLE, area + 250.0::DOUBLE) AS substantial FROM (SELECT *, row_number() OVER (PARTITION BY img ORDER BY {_order}) AS o FROM cs) WHERE o = 1", "substantial", "img, component, area")(_origins)


@query(f"""{VID}, a AS (SELECT arena, t, count(*) AS area FROM vid GROUP BY ALL), o AS (SELECT arena, least(area * 1.2::DOUBLE, area + 250.0::DOUBLE) AS s FROM a WHERE t = 0),
n AS (SELECT arena, t, sum((area > s)::INT) OVER (PARTITION BY arena ORDER BY t) AS n FROM a JOIN o USING (arena))
--
SELECT arena, min(CASE WHEN n >= 3 THEN t END) AS substantial_time FROM n GROUP BY arena""", "", "arena, substantial_time")
def substantial_times(spark, sf):
    a = videos(spark, sf).groupBy("arena", "t").agg(F.count(F.lit(1)).alias("area"))
    o = a.where("t = 0").select("arena", F.least(F.col("area") * 1.2, F.col("area") + 250.0).alias("substantial"))
    return dynamics.substantial_times(a, o, ["arena"])


@query(f"""{VID}, e AS (SELECT arena, min(t) AS a, max(t) AS b FROM frames GROUP BY arena), f AS (SELECT * FROM frames JOIN e USING (arena)),
i AS (SELECT f.arena, f.t, y, x FROM f JOIN vid v ON v.arena = f.arena AND v.t BETWEEN f.t - 2 AND f.t + 2 WHERE f.t >= a + 2 AND f.t <= b - 1 GROUP BY ALL HAVING count(*) >= 2),
o AS (SELECT DISTINCT f.arena, f.t, y, x FROM f JOIN vid v ON v.arena = f.arena AND ((f.t < a + 2 AND v.t IN (a, a + 1)) OR (f.t >= a + 2 AND f.t > b - 1 AND v.t IN (b - 1, b))))
--
SELECT * FROM i UNION ALL SELECT * FROM o""", "", "arena, t, y, x")
def network_votes(spark, sf):
    v = videos(spark, sf)
    return dynamics.network_votes(v, ["arena"], v.select("arena", "t").distinct())


@query()
def network_states(spark, sf):
    v = videos(spark, sf)
    f = v.select("arena", "t").distinct()
    return dynamics.network_states(dynamics.network_votes(v, ["arena"], f), ["arena"], 12, 12, 0.2, 5, all_frames=f)


@query()
def covering_steps(spark, sf):
    v = videos(spark, sf)
    noise = v.groupBy("arena").agg((F.percentile("v", 0.1)).alias("noise"))
    return dynamics.covering_steps(v, ["arena"], noise, v.select("arena", "t").distinct())


@query()
def slope_segmentation(spark, sf):
    v = videos(spark, sf)
    base = motion.slopes(v, ["arena"]).groupBy("arena").agg(F.percentile("slope", 0.6).alias("base"))
    return dynamics.slope_segmentation(v, ["arena"], base, False, 60)


@query()
def filled_states(spark, sf):
    v = videos(spark, sf)
    states = motion.track_shapes(v, ["arena"], 12, 12, motion.Rules(), v.select("arena", "t").distinct())
    return dynamics.filled_states(states, ["arena"], 12, 12)


def queries() -> dict[str, Query]:
    from . import pixel_queries  # noqa: F401  registers more

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(SQL)
