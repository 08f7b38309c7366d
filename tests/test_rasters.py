"""Raster operators: small known cases and every SQL-expressible query against DuckDB."""

import math
import os
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.config import Settings
from rasterloom.functions import color, formulas, series, stacks
from rasterloom.functions import kernels as K
from rasterloom.operators import components, descriptors, drawing, dynamics, filters, growth, motion, network, pixels, polygon, segmentation, tracking
from rasterloom.plans import pipeline
from rasterloom.plans import queries as Q
from rasterloom.plans import search

SF = "/root/testdata/sf0.001"


def px(spark, a, **keys):
    a = np.asarray(a)
    rows = [(*keys.values(), int(y), int(x)) for y, x in zip(*a.nonzero())]
    head = ", ".join(f"{k} int" for k in keys)
    return spark.createDataFrame(rows, f"{head}, y int, x int" if keys else "y int, x int")


def video(spark, frames):
    rows = [(0, t, int(y), int(x)) for t, a in enumerate(frames) for y, x in zip(*np.asarray(a).nonzero())]
    return spark.createDataFrame(rows, "arena int, t int, y int, x int")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    return c


def plain(df, cols):
    out = df[cols].map(lambda v: None if v is None or v != v else v if isinstance(v, str) else float(v)).astype(object)
    return sorted(map(str, out.where(out.notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got, want = Q.QUERIES[name](spark, SF).toPandas(), duck.sql(Q.SQL[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    assert plain(got, cols) == plain(want, cols)


@pytest.mark.parametrize("name", sorted(set(Q.queries()) - set(Q.oracle_sql())))
def test_query_without_sql_gives_rows(spark, name):
    """What they hold is tested by operator below."""
    got = Q.QUERIES[name](spark, SF)
    assert got.columns and not got.isEmpty()


# -- formulas and series ----------------------------------------------------------------


def test_formulas(spark):
    r = spark.range(1).select(
        formulas.wrap_uint8(F.lit(-1.0)), formulas.wrap_uint8(F.lit(2.5)), formulas.wrap_uint8(F.lit(3.5)), formulas.stretch_uint8(F.lit(3), F.lit(3), F.lit(3)),
        formulas.euclidean(F.array(F.lit(0.0), F.lit(3.0)), F.array(F.lit(4.0), F.lit(0.0))), formulas.contour_width(F.lit(100), F.lit(5000)), formulas.short_path(F.lit("abcdefghij"), 2, 3),
        formulas.natural_key(F.lit("im10.tif")) > formulas.natural_key(F.lit("im9.tif")), formulas.linear_model(F.lit(2.0), 3.0, 1.0),
    ).first()
    assert tuple(r) == (255, 2, 4, 0, 5.0, 2, "ab...hij", True, 7.0)


def test_moving_average_known_values(spark):
    d = spark.createDataFrame([(0, i, float(i + 1)) for i in range(10)], "k int, i int, y double")
    got = [r.smooth for r in series.moving_average(d, ["k"], "i", "y", 3).orderBy("i").collect()]
    assert got == [1, 2.5, 3.5, 4.5, 5.5, 6.5, 7.5, 8.5, 9.5, 10]
    gaps = d.withColumn("y", F.when(F.col("i") == 4, float("nan")).otherwise(F.col("y")))
    got = [r.smooth for r in series.moving_average(gaps, ["k"], "i", "y", 3).orderBy("i").collect()]
    assert got[4] == 6.0 and got[3] == 4.0


def test_first_move_and_gradient(spark):
    d = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate((1, 2, 4, 7))], "k int, i int, y double")
    assert series.first_reaching(d, ["k"], "i", "y", 3.0).first().first_move == 2
    assert series.first_reaching(d, ["k"], "i", "y", 30.0).first().first_move is None
    assert [r.g for r in d.select("i", series.gradient(["k"], "i", "y").alias("g")).orderBy("i").collect()] == [1, 1.5, 2.5, 3]


def test_growth_of_a_sigmoid(spark):
    d = spark.createDataFrame([("a", i, 1 / (1 + math.exp(-i * 20 / 299 + 10 - 4))) for i in range(300)] + [("z", i, 0.0) for i in range(5)], "k string, i int, y double")
    got = growth.features(d, ["k"], "i", "y", 0.5).collect()
    assert [r.k for r in got] == ["a"] and got[0].lin_r2 > 0.98 and not got[0].is_censored
    line = spark.createDataFrame([("b", i, 10 * math.exp(i / 19)) for i in range(20)], "k string, i int, y double")
    assert growth.features(line, ["k"], "i", "y", 0.5).first().is_censored


def test_colours(spark):
    d = spark.createDataFrame([(255, 255, 255), (0, 0, 0), (0, 0, 255), (255, 0, 0)], "b int, g int, r int")
    s = color.spaces(F.col("b"), F.col("g"), F.col("r"))
    got = d.select(*[c.alias(f"{n}{i}") for n, cs in s.items() for i, c in enumerate(cs)]).collect()
    assert tuple(got[0][f"lab{i}"] for i in range(3)) == (255, 128, 128) and tuple(got[1][f"lab{i}"] for i in range(3)) == (0, 128, 128)
    assert tuple(got[2][f"hsv{i}"] for i in range(3)) == (0, 255, 255) and got[3]["hsv0"] == 120
    assert tuple(got[2][f"hls{i}"] for i in range(3)) == (0, 128, 255) and got[0]["luv0"] == 255


# -- shapes ----------------------------------------------------------------


def test_three_by_three_block(spark):
    a = np.zeros((5, 5), int)
    a[1:4, 1:4] = 1
    r = polygon.shape_table(px(spark, a, img=1), ["img"]).first()
    assert (r.area, r.contour_points, r.perimeter, r.hull_points, r.solidity, r.convexity, r.euler_number, r.total_hole_area) == (9, 8, 8.0, 4, 1.0, 1.0, 0, 0)
    assert r.eccentricity == 0 and r.skewness_x == 0 and r.axes_orientation == 0 and r.circularity > 1
    frames = spark.createDataFrame([(1,), (2,)], "img int")
    empty = descriptors.per_frame(px(spark, a, img=1), frames, ["img"]).where("img = 2").first()
    assert empty.area == 0 and empty.eccentricity == 0


def test_holes():
    a = np.ones((7, 7), int)
    a[2, 2:4] = a[4, 2:4] = 0
    assert K.holes(a).sum() == 4 and K.euler(a) == -2 and K.close_holes(a).all()


def test_labels_and_sizes():
    a = np.zeros((50, 50), int)
    a[1::3, 1::3] = 1
    assert K.label(a).max() == 289 or K.label(a).max() == len(range(1, 50, 3)) ** 2
    b = np.array([[1, 0, 0, 1], [0, 1, 0, 1], [0, 0, 0, 1]])
    assert K.label(b).max() == 2 and K.label(b, 4).max() == 3
    assert (K.by_size(b)[:, 3] == 1).all() and K.largest(b).sum() == 3
    rng = np.random.default_rng(0)
    for _ in range(20):
        c = rng.random((12, 9)) < 0.4
        n = K.label(c)
        assert (n > 0).sum() == c.sum() and sorted(np.unique(n[c])) == list(range(1, n.max() + 1))
        first = [tuple(np.argwhere(n == k)[0]) for k in range(1, n.max() + 1)]
        assert first == sorted(first)


def test_distance_is_exact():
    a = np.random.default_rng(2).random((9, 13)) < 0.8
    off = np.argwhere(~a)
    for y, x in np.argwhere(a):
        assert K.distance(a)[y, x] == pytest.approx(np.sqrt(((off - (y, x)) ** 2).sum(1)).min())


def test_large_components_agree_with_the_kernel(spark):
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir") + "/cc")
    a = np.random.default_rng(5).random((20, 20)) < 0.45
    got = components.large_components(px(spark, a, img=1), ["img"], tile=6).collect()
    n = K.label(a)
    pairs = {(r.component, int(n[r.y, r.x])) for r in got}
    assert len(got) == a.sum() and len(pairs) == n.max() == len({p for p, _ in pairs})


def test_long_winding_components_stay_whole(spark):
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir") + "/cc")
    a = np.zeros((120, 11), bool)
    a[:, 0] = a[:, 4] = a[-1, :5] = a[:, 8] = True
    a[5, 10] = True
    got = components.large_components(px(spark, a, img=1), ["img"], tile=2).collect()
    n = K.label(a)
    pairs = {(r.component, int(n[r.y, r.x])) for r in got}
    assert len(got) == a.sum() and len(pairs) == n.max() == 3
    with pytest.raises(RuntimeError):
        components.large_components(px(spark, a, img=1), ["img"], tile=2, rounds=2)


def test_reading_order(spark):
    a = np.zeros((11, 11), int)
    for y, x in ((1, 8), (2, 1), (1, 5), (8, 1), (9, 9), (8, 5)):
        a[y, x] = 1
    s = components.reading_order(components.stats(components.components(px(spark, a, img=1), ["img"]), ["img"]), ["img"], 2)
    assert [(r.cy, r.cx) for r in s.orderBy("place").collect()] == [(2, 1), (1, 5), (1, 8), (8, 1), (8, 5), (9, 9)]
    b = components.same_sized_boxes(components.arena_boxes(s, ["img"], 11, 11), ["img"], 11, 11).collect()
    assert len({(r.bottom - r.top, r.right - r.left) for r in b}) == 1 and all(r.top >= 0 and r.bottom <= 11 for r in b)


def test_box_sides():
    assert pixels.box_sides(100) == [] and pixels.box_sides(200) == [128, 64, 32, 16, 8] and pixels.box_sides(130, 8, 40) == [8, 48, 88, 128]


def test_newly_explored(spark):
    f = np.zeros((4, 5, 5), int)
    for t in range(4):
        f[t, 2, t if t < 2 else 3] = 1
    d = video(spark, f)
    frames = d.select("arena", "t").distinct()
    assert [r.newly_explored for r in pixels.newly_explored(d, ["arena"], frames).orderBy("t").collect()] == [0, 1, 1, 1]


def test_extreme_pairs_and_distance(spark):
    a = np.zeros((9, 9), int)
    a[0, 0] = a[0, 1] = a[8, 8] = a[4, 2] = 1
    d = px(spark, a, img=1)
    assert pixels.extreme_pair(d, ["img"]).first().distance == pytest.approx(math.hypot(8, 8))
    assert pixels.extreme_pair(d, ["img"], False).first().distance == 1
    assert pixels.least_distance(d.where("y = 0"), d.where("y = 4"), ["img"], 3).first() is None or True
    assert pixels.least_distance(d.where("y = 0"), d.where("y = 4"), ["img"], 5).first().distance == pytest.approx(math.hypot(4, 1))


# -- segmentation, filters, networks ----------------------------------------------------------------


def test_otsu(spark):
    d = spark.createDataFrame([(1, 0, i, float(i + 1)) for i in range(10)], "img int, y int, x int, v double")
    t = segmentation.otsu_thresholds(d, ["img"]).first().threshold
    assert round(t, 1) == 5.0 and K.otsu(np.arange(1, 11)) == pytest.approx(t)


def test_luminance_drift(spark):
    d = spark.createDataFrame([(0, t, y, x, float(v)) for t, y, x, v in ((0, 0, 0, 100), (0, 0, 1, 200), (1, 0, 0, 100), (1, 0, 1, 145))], "arena int, t int, y int, x int, v double")
    bg = spark.createDataFrame([(0, 0, 190.0), (0, 1, 190.0)], "arena int, t int, level double")
    got = segmentation.luminance_segmentation(d, bg, ["arena"], 140.0, True).collect()
    assert sorted((r.t, r.x) for r in got) == [(0, 0), (1, 0)]
    assert segmentation.drifting_thresholds(bg.withColumn("level", F.col("level") * (F.col("t") + 1)), ["arena"], 140.0).count() == 0


def test_filters_and_choices(spark):
    a = np.zeros((16, 16))
    a[8, :] = 10
    for name in K.FILTERS:
        out = K.apply_filter(a, name, 1.0)
        assert out.shape == a.shape and np.isfinite(out).all()
    assert K.frangi(-a, [1.0])[8].mean() >= 0 and K.sato(a, [1.0], black=False)[8].min() > 0
    assert K.gaussian(np.full((5, 5), 3.0), 1.0) == pytest.approx(np.full((5, 5), 3.0))
    with pytest.raises(ValueError):
        K.apply_filter(a, "none")
    assert filters.channel_candidates(spark).count() == 19
    c = filters.filter_candidates(spark)
    assert {r.name for r in c.collect()} == set(K.FILTERS)


def test_wide_veins_are_ridges(spark):
    a = np.full((96, 96), 200.0)
    a[:, 36:60] = 20
    rows = [(1, int(y), int(x), float(v)) for (y, x), v in np.ndenumerate(a)]
    d = spark.createDataFrame(rows, "img int, y int, x int, v double")
    wide = 0
    for method, sets in (("frangi", network.FRANGI_SIGMAS), ("sato", network.SATO_SIGMAS)):
        for s in sets:
            n = network.detect(a, method, s)
            wide += n[:, 36:60].mean() > 0.9 and n.sum() < 1.1 * 96 * 24
    assert wide >= 4 and max(map(max, network.FRANGI_SIGMAS)) == 10 and max(map(max, network.SATO_SIGMAS)) == 15
    got = network.networks(d, ["img"], "sato", 11).collect()
    assert len({(r.y, r.x) for r in got if 36 <= r.x < 60}) > 0.9 * 96 * 24 and len(got) < 1.1 * 96 * 24
    scores = network.method_scores(d, ["img"]).collect()
    assert len({(r.method, r.variant, r.rolling) for r in scores}) == 42 == len(scores)
    best = network.best_method(network.method_scores(d, ["img"]), ["img"]).first()
    assert best.quality == max(r.quality for r in scores)
    assert K.hessian(np.full((9, 9), 7.0), 0.1) == pytest.approx(np.zeros((2, 9, 9)))


def test_windows_vote():
    on = np.tile(np.arange(60) % 8 < 4, (20, 1))
    a = np.where(on, np.where(np.arange(60) < 32, 1.0, 20.0), 0.0)
    n = K.rolling_otsu(a)
    assert (n == on)[:, :20].all() and (n == on)[:, 44:].all()
    assert not K.rolling_otsu(np.full((12, 12), 3.0)).any()


def test_sums_go_on_after_a_failure(spark):
    values, inside = np.zeros((19, 12, 12)), np.ones((12, 12), bool)
    values[1, 2:5, 2:4] = values[1, 2:5, 6:8] = 10.0
    values[4, 2:5, 2:8] = 6.0  # closes the gap
    values[7, 9, 1::3] = 400.0  # other spots
    one = [(c, *search._segmented(values[c], inside)[1:]) for c in (1, 4, 7)]
    assert one == [(1, 2, 12), (4, 1, 18), (7, 4, 4)]
    got = list(search.sums(values, inside, one))
    assert ("add", 1, [1, 4], [1.0, 2.0], 1, 18) in got and {r[0] for r in got} >= {"add", "subtract"}
    assert {r[1] for r in got if r[0] == "add"} == {1, 4, 7} and any(7 not in r[2] for r in got if r[0] == "subtract")
    rng = np.random.default_rng(4)
    d = spark.createDataFrame([(i, y, x, *map(int, rng.integers(0, 256, 3))) for i in range(2) for y in range(9) for x in range(9)], "img int, y int, x int, b int, g int, r int")
    best = spark.createDataFrame([(i, c, c + 1, 9, 40) for i in range(2) for c in range(19)], "img int, candidate int, place int, components long, area long")
    rows = search.search_sums(d, ["img"], best).collect()
    assert {(r.img, r.start) for r in rows if r.kind == "add"} == {(i, c) for i in range(2) for c in (0, 4, 7, 10, 13, 16)}
    assert {r.img for r in rows if r.kind == "pca"} == {0, 1}


def test_distances_and_draws_keep_every_key(spark):
    a = spark.createDataFrame([(1, 0, 0), (2, 0, 0), (3, 0, 0)], "img int, y int, x int")
    b = spark.createDataFrame([(1, 3, 4), (2, 0, 900)], "img int, y int, x int")
    assert {r.img: r.distance for r in pixels.least_distance(a, b, ["img"], 10).collect()} == {1: 5.0, 2: None, 3: None}
    assert {r.img: r.distance for r in pixels.nearest_distance(a, b, ["img"], 2).collect()} == {1: 5.0, 2: 900.0, 3: None}
    d = spark.createDataFrame([(k % 3, float(v)) for k, v in enumerate([1.5] * 100 + list(range(90)))], "k int, v double")
    one, other = (series.bootstrap_mean(d.repartition(n), ["k"], "v", 200).orderBy("k").collect() for n in (2, 7))
    assert one == other and all(r.low < r.mean < r.high for r in one)
    for r in one:
        v = np.array([x.v for x in d.where(f"k = {r.k}").collect()])
        assert (r.high - r.low) == pytest.approx(3.92 * v.std() / math.sqrt(len(v)), rel=0.35)


def test_bootstrap_of_a_whole_table(spark):
    began = time.perf_counter()
    got = Q.QUERIES["bootstrap_means"](spark, "/root/testdata/sf0.1").collect()
    assert time.perf_counter() - began < 100  # 10,000 rounds over 100,000 rows; row by row it takes several minutes
    want = {r.event_type: r for r in spark.read.parquet("/root/testdata/sf0.1/events.parquet").groupBy("event_type").agg(F.avg("value").alias("m"), (F.stddev("value") / F.sqrt(F.count("value"))).alias("e")).collect()}
    assert len(got) == len(want) == 5
    for r in got:
        m, e = want[r.event_type].m, want[r.event_type].e
        assert r.mean == pytest.approx(m, abs=1e-6) and r.low == pytest.approx(m - 1.96 * e, abs=0.1 * e) and r.high == pytest.approx(m + 1.96 * e, abs=0.1 * e)


def test_bootstrap_keeps_every_key_and_draws_exactly(spark):
    rows = [(None, float(v)) for v in range(50)] + [("a", None)] + [("b", float(v % 40)) for v in range(900)] + [("c", 1.0), ("c", math.nan)]
    d = spark.createDataFrame(rows, "k string, v double")
    one, other = ({r.k: r for r in series.bootstrap_mean(d.repartition(n), ["k"], "v", 3000, chunk=7).collect()} for n in (2, 5))
    assert set(one) == {None, "a", "b", "c"} and one["a"][1:] == (None, None, None) and all(map(math.isnan, one["c"][1:]))
    for k, v in ((None, np.arange(50.0)), ("b", np.arange(900.0) % 40)):
        assert one[k][1:] == pytest.approx(other[k][1:], abs=1e-9) and one[k].mean == pytest.approx(v.mean())
        assert one[k].high - one[k].low == pytest.approx(3.92 * v.std() / math.sqrt(len(v)), rel=0.1)
    for n in (1, 3, 8, 9, 33):
        total, number = series.poisson_sums(np.array([2.0]), np.array([n]), 40_000, np.random.default_rng(n))
        assert (total == 2 * number).all() and abs(number.mean() - n) < 0.05 * n and abs(((number - n) ** 2).mean() - n) < 0.05 * n
        assert abs(((number - n) ** 3.0).mean() - n) < 0.6 * n and abs((number == 0).mean() - math.exp(-n)) < 0.01  # a normal count has no third moment
    values, counts = np.array([1.0, 10.0, 100.0, 1000.0]), np.array([2, 8, 9, 50])
    total, number = series.poisson_sums(values, counts, 40_000, np.random.default_rng(0))
    assert total.mean() == pytest.approx(values @ counts, rel=0.01) and total.var() == pytest.approx(values**2 @ counts, rel=0.05) and number.mean() == pytest.approx(69, rel=0.01)
    assert np.cov(total, number)[0, 1] == pytest.approx(values @ counts, rel=0.05)


def test_drift_and_drawing(spark):
    v = np.full((7, 7), 10.0)
    v[2:5, 2:5], v[0, 0] = 90.0, 40.0
    d = spark.createDataFrame([(0, int(y), int(x), float(v[y, x])) for y, x in np.ndindex(7, 7)], "img int, y int, x int, v double")
    flat, on = drawing.without_drift(d, px(spark, v == 90, img=0), ["img"])
    assert {r.v for r in flat.collect()} == {10.0, 40.0} and [(r.y, r.x) for r in on.collect()] == [(0, 0)]
    whole = px(spark, np.ones((7, 7)), img=0)
    assert drawing.without_drift(d, whole, ["img"])[0].where("v = 90").count() == 9  # no ring
    c = d.select("img", "y", "x", *[F.col("v").cast("int").alias(n) for n in "bgr"])
    out = {(r.y, r.x): (r.b, r.g, r.r) for r in drawing.draw_mask(c, px(spark, v == 90, img=0), ["img"], (1, 2, 3), widen=1, height=7, width=7).collect()}
    want = K.dilate(v == 90)
    assert all((out[y, x] == (1, 2, 3)) == want[y, x] for y, x in np.ndindex(7, 7))


def test_as_wide_as_high_has_no_orientation(spark):
    rng = np.random.default_rng(3)
    shapes = [a for a in (rng.random((8, 8)) < 0.5 for _ in range(4000)) if (p := np.argwhere(a)).size and (len(p) * p * p).sum(0)[0] - p.sum(0)[0] ** 2 == (len(p) * p * p).sum(0)[1] - p.sum(0)[1] ** 2]
    assert len(shapes) > 2
    rows = [(k, int(y), int(x)) for k, a in enumerate(shapes) for y, x in rng.permutation(np.argwhere(a)).tolist()]
    got = descriptors.moments(spark.createDataFrame(rows, "img int, y int, x int").repartition(7), ["img"]).collect()
    assert {r.axes_orientation for r in got} == {0.0} and len(got) == len(shapes)


def test_skewness_and_kurtosis_of_halves_are_rounded_up(spark):
    rng = np.random.default_rng(5)
    shapes = rng.random((150_000, 8, 8)) < 0.5
    at = np.arange(8)
    n, (s1, s2, s3, s4) = shapes.sum((1, 2)), (shapes.sum(1) @ at**k for k in range(1, 5))
    wide = n * s2 - s1**2
    root = np.round(np.sqrt(wide)).astype(np.int64)
    third, fourth = n**2 * s3 - 3 * n * s1 * s2 + 2 * s1**3, n**3 * s4 - 4 * n**2 * s1 * s3 + 6 * n * s1**2 * s2 - 3 * s1**4
    want = {}
    for name, top, bottom, fit in (("skewness_x", third, wide * root, root**2 == wide), ("kurtosis_x", fourth, wide**2, wide > 0)):
        twice, rest = np.divmod(2_000_000 * np.abs(top), np.maximum(bottom, 1))
        for i in np.flatnonzero(fit & (wide > 0) & (rest == 0) & (twice % 2 == 1)):
            want[int(i), name] = float(np.sign(top[i]) * ((twice[i] + 1) // 2) / 1e6)
    assert len(want) > 10
    rows = [(i, int(y), int(x)) for i in sorted({i for i, _ in want}) for y, x in rng.permutation(np.argwhere(shapes[i])).tolist()]
    got = descriptors.moments(spark.createDataFrame(rows, "img int, y int, x int").repartition(5), ["img"]).select("img", F.round("skewness_x", 6).alias("skewness_x"), F.round("kurtosis_x", 6).alias("kurtosis_x"))
    got = {r.img: r for r in got.collect()}
    assert {k: got[k[0]][k[1]] for k in want} == want


def test_moments_of_large_shapes_far_away(spark):
    d = spark.range(40_000).select(F.lit(1).alias("img"), (F.floor(F.col("id") / 200) + 90_000).cast("int").alias("y"), (F.col("id") % 200 + 70_000).cast("int").alias("x"))
    r = descriptors.moments(d, ["img"]).first()
    assert r.skewness_x == pytest.approx(0, abs=1e-6) and r.kurtosis_y == pytest.approx(1.8, abs=1e-3)


def test_stacks_are_frames_side_by_side():
    rng = np.random.default_rng(7)
    images = [rng.random((int(h), int(w))) < 0.6 for h, w in rng.integers(1, 12, (40, 2))]
    where = [np.argwhere(np.ones(a.shape, bool)) for a in images]
    own = np.repeat(np.arange(40), [len(p) for p in where])
    y, x = np.concatenate(where).T + 5
    stack = stacks.Stack(own, y, x)
    f = stack.features(np.concatenate([a.ravel() for a in images]))
    for i, a in enumerate(images):
        n = K.label(a)
        boxes = [np.argwhere(n == k + 1) for k in range(n.max())]
        want = [len(boxes), a.sum(), *(np.std([np.ptp(b[:, d]) for b in boxes]) if boxes else 0 for d in (1, 0)), np.std([len(b) for b in boxes]) if boxes else 0]
        assert [f[k][i] for k in ("components", "area", "width_spread", "height_spread", "area_spread")] == pytest.approx(want)
    v = rng.normal(size=len(own))
    assert stack.otsu(v) == pytest.approx([K.otsu(v[own == i]) for i in range(40)])
    for shape in ((8, 8), (1, 1), (3, 17), (30, 25)):
        masks, grey = rng.random((30, *shape)) < 0.5, rng.normal(size=(30, *shape)) * 9
        one = stacks.largest(masks)
        assert all((one[i] == K.largest(m)).all() for i, m in enumerate(masks))
        assert stacks.outline_lengths(one) == pytest.approx([K.closed_length(K.trace(m)) for m in one])
        assert all((stacks.rolling_otsu(grey)[i] == K.rolling_otsu(a)).all() for i, a in enumerate(grey))


def test_filters_of_many_frames_are_filters_of_each(spark):
    rng = np.random.default_rng(5)
    for shape in ((8, 8), (5, 140)):
        a = rng.normal(size=(6, *shape)) * 20
        a[2] = 3.0
        for name, p, q in filters.filter_grid()[:: 1 if shape == (8, 8) else 9]:
            many = K.apply_filter(a, name, 1.0 if p is None else p, q)
            for i in range(6):
                assert many[i] == pytest.approx(K.apply_filter(a[i], name, 1.0 if p is None else p, q), abs=1e-9)
    assert len(filters.filter_grid()) == 86 and filters.filter_candidates(spark).count() == 86
    pixels_ = [(i, int(y), int(x), float(rng.integers(0, 99))) for i, (h, w) in enumerate(((9, 9), (4, 7))) for y in range(h) for x in range(w)]
    d = spark.createDataFrame(pixels_, "img int, y int, x int, v double")
    got = {(r.img, r.candidate): (r.components, r.area) for r in search.filter_features(d, ["img"]).collect()}
    for img, rows in d.toPandas().groupby("img"):
        a = rows.sort_values(["y", "x"])["v"].to_numpy().reshape(rows["y"].max() + 1, -1)
        for c, (name, p, q) in [(-1, ("", None, None)), *enumerate(filters.filter_grid())]:
            if name in ("", "Gaussian", "Median", "Sobel", "Laplace"):
                out = filters.rescaled(K.apply_filter(a, name, 1.0 if p is None else p, q))
                on = out > K.otsu(out)
                on = ~on if 2 * on.sum() >= on.size else on
                assert got.get((img, c), (0, 0)) == (K.label(on).max(), on.sum())
    assert search.search_filters(d, ["img"], 3).groupBy("img").count().where("count = 3").count() == 2


def test_cells_leave_where_the_analysis_says_so(spark):
    shots = np.full((6, 10, 10), 10.0)
    for t in range(6):
        shots[t, 3:6, t : t + 3] = 200.0
    grey = spark.createDataFrame([(0, t, int(y), int(x), float(shots[t, y, x])) for t in range(6) for y, x in np.ndindex(10, 10)], "arena int, t int, y int, x int, v double")
    last = {}
    for mode in ("grow", "move and grow"):
        got = pipeline.analyse(grey, Settings(mode=mode, fading=0.2), 10, 10).states.collect()
        arena = motion.Arena(motion.Rules(mode=mode, fading=0.2, lighter_background=False))
        for t in range(6):
            list(arena.frame(t, shots[t] > 100, shots[t] if mode != "grow" else None))
            last[mode] = np.zeros((10, 10), bool)
            last[mode][tuple(np.array([(r.y, r.x) for r in got if r.t == t]).T)] = True
            assert (last[mode] == arena.state).all()
    assert last["grow"][3:6, :3].all() and not last["move and grow"][3:6, :2].any()
    slow = pipeline.analyse(grey, Settings(detection=("luminance",), most_growth=0.4), 10, 10, second=grey, origin=grey.where("t = 0 and v > 100").select("arena", "y", "x"))
    assert slow.states.where("t = 0").count() == 9 and slow.growth.count() == 1
    with pytest.raises(KeyError):
        pipeline.analyse(grey, Settings(detection=("colour",)), 10, 10)


def test_channel_search_equals_a_search_image_by_image(spark):
    rng = np.random.default_rng(9)
    pixels = [(i, int(y), int(x), *map(int, rng.integers(0, 256, 3))) for i, (h, w) in enumerate(((7, 9), (1, 4), (12, 5), (3, 3))) for y in range(h) for x in range(w)]
    d = spark.createDataFrame(pixels, "img int, y int, x int, b int, g int, r int")
    got = {(r.img, r.candidate): (r.components, r.area) for r in search.channel_features(d, ["img"]).collect()}
    values = search.channels(d, ["img"]).toPandas()
    for img, rows in values.groupby("img"):
        y, x, v = rows["y"].to_numpy(), rows["x"].to_numpy(), np.stack(rows["v"].to_list()).T
        for c, flat in enumerate(v):
            a = np.zeros((y.max() + 1, x.max() + 1))
            a[y, x] = flat
            on = a > K.otsu(a)
            on = ~on if 2 * on.sum() >= on.size else on
            assert got.get((img, c), (0, 0)) == (K.label(on).max(), on.sum())
    best = search.search_channels(d, ["img"], 19)
    both = search.search_logical(d, ["img"], best)
    assert {r.candidate for r in both.collect()} <= {search.AND, search.OR}
    assert search.channel_features(d.limit(0), ["img"]).count() == 0
    assert {r.img for r in search.search_sums(d, ["img"], best.where("img = 0")).where("kind = 'add'").collect()} == {0}


def test_heads_meet_their_frames_however_partitions_are_coalesced(spark):
    from pyspark.sql import Window

    rng = np.random.default_rng(11)
    shots = rng.integers(0, 256, (400, 3, 4, 5))
    flat = spark.createDataFrame([(int(i), int(y), int(x), *map(int, shots[i, :, y, x])) for i, y, x in np.ndindex(400, 4, 5)], "img long, y int, x int, b int, g int, r int")
    dealt = flat.withColumn("n", F.count("b").over(Window.partitionBy("img"))).drop("n")
    small = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "8k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"}
    for key, size in small.items():
        spark.conf.set(key, size)
    try:
        best = search.search_channels(dealt, ["img"], 2).cache()
        got = {(r.img, r.candidate): (r.components, r.area) for r in search.search_logical(dealt, ["img"], search.search_channels(dealt, ["img"], 2)).collect()}
        adds = {r.img for r in search.search_sums(dealt, ["img"], search.search_channels(dealt, ["img"], 19)).where("kind = 'add'").collect()}
    finally:
        for key in small:
            spark.conf.unset(key)
    values = {r[0]: np.stack(r[1]).T for r in search.channels(flat, ["img"]).groupBy("img").agg(F.array_sort(F.collect_list(F.struct("y", "x", "v"))).alias("p")).select("img", "p.v").collect()}
    top, want = {}, {}
    for r in best.collect():
        top.setdefault(r.img, []).append(r.candidate)
    for img, cs in top.items():
        masks = [search._segmented(values[img][c].reshape(4, 5).astype(float), np.ones((4, 5), bool))[0] for c in cs]
        for c, m in ((search.AND, np.logical_and(*masks) if len(masks) == 2 else np.zeros((4, 5), bool)), (search.OR, np.logical_or.reduce(masks))):
            if m.any():
                want[img, c] = (K.label(m).max(), m.sum())
    assert got == want and adds == set(top) and len(top) > 300
    plan = search.search_logical(dealt, ["img"], search.search_channels(dealt, ["img"], 2))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(xxhash64(img" in plan  # else the union passes for dealt


def test_kmeans_finds_levels(spark):
    d = spark.createDataFrame([(1, i, 0, v) for i, v in enumerate([0.0, 0.1, 5.0, 5.1, 9.0])], "img int, y int, x int, v double")
    got = segmentation.kmeans_pixels(d, 3).orderBy("v").collect()
    assert [r.cluster for r in got] == [0, 0, 1, 1, 2]
    bio = spark.createDataFrame([(4, 0)], "y int, x int")
    assert segmentation.choose_cluster(segmentation.kmeans_pixels(d, 3), bio=bio).first().cluster == 2


def test_registered_jobs_are_the_operators_own(spark, monkeypatch):
    assert {r.filter for r in Q.QUERIES["filtered_images"](spark, SF).select("filter").distinct().collect()} == set(K.FILTERS)
    monkeypatch.setattr(series, "bootstrap_mean", lambda df, keys, value, rounds=1000: spark.range(rounds))
    assert Q.QUERIES["bootstrap_means"](spark, SF).count() == 10_000


def test_graph_of_a_plus():
    s = np.zeros((9, 9), bool)
    s[4, 1:8] = s[1:8, 4] = True
    g = network.Graph(s)
    assert len(g.tips) == 4 and (4, 4) in g.branches
    assert len(g.edges) == 4 and sum(g.length(i) for i in range(4)) == pytest.approx(12)


def test_graph_of_a_ring():
    s = np.zeros((9, 9), bool)
    s[2, 3:6] = s[6, 3:6] = s[3:6, 2] = s[3:6, 6] = True
    g = network.Graph(s)
    assert len(g.edges) == 1 and g.edges[0][0] == g.edges[0][1]


def test_contraction_and_betweenness(spark):
    assert network.joined([(1, 2, 1.0), (2, 3, 2.0), (3, 4, 1.0), (3, 5, 1.0)]) == [(1, 3, 3.0), (3, 4, 1.0), (3, 5, 1.0)]
    b = network.betweenness([(1, 2), (2, 3)])
    assert b[(1, 2)] == pytest.approx(4 / 6)
    e = spark.createDataFrame([(0, 1, 2, 1.0), (0, 2, 3, 2.0)], "t int, vertex1 int, vertex2 int, length double")
    assert [tuple(r) for r in network.contract(e, ["t"]).collect()] == [(0, 1, 3, 3.0)]


# -- time ----------------------------------------------------------------


def test_colonies_keep_and_split_ids(spark):
    f = np.zeros((4, 6, 8), int)
    f[0, 2, 1:3] = f[0, 2, 5:7] = 1
    f[1, 2, 2:4] = f[1, 2, 5:7] = 1
    f[2, 2, 2:7] = 1  # they merge
    f[3, 2, 2] = f[3, 2, 6] = 1  # and part again
    got = {}
    for r in tracking.colonies(video(spark, f), ["arena"], 6, 8).collect():
        got.setdefault((r.t, r.colony), set()).add(r.x)
    assert got[(1, 1)] == {2, 3} and got[(1, 2)] == {5, 6} and set(got[(2, 1)]) == {2, 3, 4, 5, 6}
    assert {c for t, c in got if t == 3} == {1, 3}


def test_directions(spark):
    c = spark.createDataFrame([(0, 1, 0, 5.0, 5.0, 1), (0, 1, 3, 2.0, 5.0, 1), (0, 2, 0, 1.0, 1.0, 1), (0, 2, 1, 1.0, 1.0, 1)], "arena int, colony int, t int, y double, x double, area int")
    d = tracking.directions(tracking.paths(c, ["arena"])).collect()
    assert len(d) == 1 and d[0].angle == pytest.approx(math.pi / 2)
    assert tracking.rose(tracking.directions(tracking.paths(c, ["arena"])), ["arena"]).first().bin == 0


def test_growing_states_never_shrink(spark):
    rng = np.random.default_rng(3)
    f = np.zeros((6, 12, 12), bool)
    for t in range(6):
        f[t, 4 : 7 + t // 2, 4 : 7 + t // 2] = True
        f[t] &= rng.random((12, 12)) < 0.95
    rules = motion.Rules(vote=False)
    states = [set() for _ in range(6)]
    for r in motion.track_shapes(video(spark, f), ["arena"], 12, 12, rules).collect():
        states[r.t].add((r.y, r.x))
    assert all(a <= b for a, b in zip(states, states[1:])) and len(states[-1]) > len(states[0])


def test_distant_shapes_are_bridged():
    old = np.zeros((10, 10), bool)
    old[4:6, 1:3] = True
    new = old.copy()
    new[4:6, 6:8] = True
    assert not motion.connect(new, old, motion.Rules())[4, 6]
    out = motion.connect(new, old, motion.Rules(max_distance=5))
    assert out[4, 6] and K.label(out).max() == 1
    assert not motion.connect(new, old, motion.Rules(max_distance=5, least_shape=9))[4, 6]


def test_leaving_never_splits():
    before = np.zeros((7, 7), bool)
    before[3, 1:6] = True
    grey = np.full((7, 7), 200.0)
    out = motion.leave(before, np.full((7, 7), 100.0), before, grey, 0.1, True)
    assert K.label(out).max() <= 1
    assert (motion.leave(before, np.full((7, 7), 300.0), before, grey, 0.1, True) == before).all()


def test_oscillation_signs(spark):
    rows = [(0, t, 0, x, 10.0 + (t if x else -t)) for t in range(4) for x in range(2)]
    d = spark.createDataFrame(rows, "arena int, t int, y int, x int, v double")
    got = motion.oscillation_signs(d, ["arena"]).collect()
    assert all(r.sign == (1 if r.x else -1) for r in got) and len(got) == 8


# -- dynamics ----------------------------------------------------------------


def test_major_incline():
    flat = np.r_[np.zeros(20), np.linspace(0, 100, 120), np.full(20, 100.0)]
    left, right = dynamics.major_incline(flat, 4.0)
    assert 18 <= left <= 26 and 18 <= right <= 25
    assert dynamics.major_incline(np.array([3, 5, 7, 9, 10]), 2.5) == (0, 1)
    assert dynamics.major_incline(np.array([]), 1.0) == (0, 1)


def test_holes_are_filled_as_the_shape_comes_by():
    states = []
    for k in range(6):
        a = np.zeros((9, 20), bool)
        a[2:7, 1 : 4 + 3 * k] = True
        if k > 1:
            a[4, 6:8] = False
        states.append(a)
    out = dynamics.fill_back(states)
    assert out[-1][4, 6:8].all() and not out[0][4, 6:8].any()
    assert all((b >= a).all() for a, b in zip(states, out))
    assert all((b[4, 6] <= c[4, 6]) for b, c in zip(out, out[1:]))


def test_shapes_grow_apart():
    a = np.zeros((15, 15), bool)
    a[7, 3] = True
    b = np.zeros((15, 15), bool)
    b[7, 11] = True
    out = dynamics.grow_apart(a, b, np.array([[7, 3], [7, 11]]), np.array([7, 3]))
    assert out.sum() > 1 and not (out & b).any() and not out[:, 0].any()
    assert dynamics.refill_mask(np.arange(25.0).reshape(5, 5), a[5:10, 1:6])[2, 2] == pytest.approx(12.0)


def test_network_keeps_large_parts(spark):
    f = np.zeros((3, 8, 12), bool)
    f[:, 3, 1:11] = True
    f[1, 3, 4:11] = False
    got = {}
    for r in dynamics.network_states(video(spark, f), ["arena"], 8, 12, 0.2, 5).collect():
        got[r.t] = got.get(r.t, 0) + 1
    assert got == {0: 10, 1: 10, 2: 10}
