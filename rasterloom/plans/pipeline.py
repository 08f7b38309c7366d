"""From pixels of arenas to result tables: segmentation, states, descriptors, first moves, transitions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import color, series
from ..operators import descriptors, dynamics, growth, motion, network, pixels, polygon, segmentation, tracking


@dataclass
class Results:
    """Tables of one analysis; each is lazy and costs nothing until it is used."""

    states: DataFrame
    frames: DataFrame
    arenas: DataFrame
    colonies: DataFrame
    centroids: DataFrame
    vertices: DataFrame | None = None
    edges: DataFrame | None = None
    edge_pixels: DataFrame | None = None
    oscillations: DataFrame | None = None
    fractals: DataFrame | None = None
    growth: DataFrame | None = None


def greyscale(colour_pixels: DataFrame, settings: Settings) -> DataFrame:
    """(arena, t, y, x, v) out of (arena, t, y, x, b, g, r)."""
    return colour_pixels.select("arena", "t", "y", "x", color.combine(settings.colours, F.col("b"), F.col("g"), F.col("r")).alias("v"))


def draft(grey: DataFrame) -> DataFrame:
    """Each frame by its own Otsu threshold."""
    return segmentation.otsu_segmentation(grey, ["arena", "t"]).select("arena", "t", "y", "x")


def covering(df: DataFrame, origin: DataFrame, lighter: bool, first_frames: int, value: str = "v") -> DataFrame:
    """(arena, base): the value that covers the origin (arena, y, x): of its pixels' least (light background) or largest values in the first frames the largest or least."""
    start = df.groupBy("arena").agg(F.min("t").alias("__t0"))
    first = df.join(start, "arena").where(F.col("t") < F.col("__t0") + first_frames).join(origin.select("arena", "y", "x"), ["arena", "y", "x"], "left_semi")
    near, far = (F.min, F.max) if lighter else (F.max, F.min)
    return first.groupBy("arena", "y", "x").agg(near(value).alias("__c")).where("__c <> 0").groupBy("arena").agg(far("__c").alias("base"))


def luminance_draft(grey: DataFrame, origin: DataFrame, lighter: bool, limit: float, first_frames: int = 3) -> DataFrame:
    """(arena, t, y, x) beyond the threshold that the grid picks, which drifts with the background."""
    base = covering(grey, origin, lighter, first_frames)
    picked = segmentation.pick_threshold(segmentation.threshold_grid(grey, base, ["arena"], lighter, limit), ["arena"])
    return segmentation.luminance_segmentation(grey, segmentation.background_levels(grey, ["arena"], lighter), ["arena"], picked, lighter)


def slope_draft(grey: DataFrame, origin: DataFrame, lighter: bool, limit: float, first_frames: int = 3, step: int = 1) -> DataFrame:
    """(arena, t, y, x) whose slope is beyond the threshold that the grid picks."""
    base = covering(motion.slopes(grey, ["arena"], step).where("slope is not null"), origin, lighter, first_frames, "slope")
    return dynamics.slope_segmentation(grey, ["arena"], base, lighter, limit, step)


def detected(grey: DataFrame, settings: Settings, pixels_of_an_arena: int, origin: DataFrame | None = None) -> DataFrame:
    """The draft by the settings' detection: frame by frame, by luminance, by slope, or by both joined. origin: (arena, y, x), by default the first frame's own draft."""
    if settings.detection == ("frame",):
        return draft(grey)
    lighter, limit = bool(settings.lighter_background), pixels_of_an_arena * settings.most_growth * 2
    if origin is None:
        first = grey.groupBy("arena").agg(F.min("t").alias("t"))
        origin = draft(grey.join(first, ["arena", "t"], "left_semi")).select("arena", "y", "x")
    kinds = {"luminance": luminance_draft, "slope": slope_draft}
    parts = [kinds[k](grey, origin, lighter, limit, settings.first_frames) for k in settings.detection]
    return dynamics.detect(parts, settings.detection_join)


def analyse(grey: DataFrame, settings: Settings, height: int, width: int, segmented: DataFrame | None = None, timings: DataFrame | None = None, second: DataFrame | None = None, origin: DataFrame | None = None) -> Results:
    """grey: (arena, t, y, x, v); segmented: a draft (arena, t, y, x) in place of the settings' detection; timings: (arena, t, time).

    second: another conversion like grey, whose draft is joined to the first's by the settings' logical operation.
    """
    keys = ["arena", "t"]
    if settings.excluded:
        grey = grey.where(~F.col("arena").isin(*settings.excluded))
    all_frames = grey.select(*keys).distinct()
    found = detected(grey, settings, height * width, origin) if segmented is None else segmented
    if second is not None and settings.logical != "None":
        found = pixels.combine(found, detected(second, settings, height * width, origin), ["arena", "t", "y", "x"], settings.logical)
    rules = motion.Rules(mode=settings.mode, max_distance=settings.most_distance, lighter_background=bool(settings.lighter_background), fading=settings.fading)
    states = motion.track_shapes(found, ["arena"], height, width, rules, all_frames, grey)
    table = all_frames.join(polygon.shape_table(states, keys), keys, "left").na.fill(0)
    table = table.join(pixels.newly_explored(states, ["arena"], all_frames).withColumnRenamed("newly_explored", "newly_explored_area"), keys)
    if timings is not None:
        table = table.join(timings, keys, "left")
    else:
        table = table.withColumn("time", F.col("t") * F.lit(float(settings.time_step)))
    first = series.first_reaching(table, ["arena"], "t", "area", settings.first_move_threshold)
    turns = growth.transitions(table.join(first, "arena"), ["arena"])
    last = table.groupBy("arena").agg(F.max_by("area", "t").alias("final_area"))
    arenas = first.join(last, "arena").join(turns, "arena", "left")
    colonies = tracking.colonies(states, ["arena"], height, width, settings.least_size, all_frames)
    out = Results(states, table, arenas, colonies, tracking.centroids(colonies, ["arena"]))
    out.growth = growth.features(table.select("arena", "t", "area"), ["arena"], "t", "area", settings.time_step)
    if settings.image_width_mm:
        area = (settings.image_width_mm / width) ** 2
        out.frames = descriptors.scale(out.frames, area, settings.unit_mode)
        out.arenas = descriptors.scale(out.arenas, area, settings.unit_mode)
    if settings.networks:
        skeleton = network.skeletons(states, keys)
        g = network.graphs(skeleton, keys)
        out.vertices, out.edges, out.edge_pixels = network.vertex_table(g, keys), network.edge_table(g, skeleton, keys, grey), network.edge_pixels(g, keys)
    if settings.fractal:
        sides = pixels.box_sides(min(height, width)) or [max(min(height, width) // 2, 2), 1]
        out.fractals = pixels.box_dimension(states, keys, sides)
    out.oscillations = motion.oscillating_zones(motion.oscillation_signs(grey.join(states, [*keys, "y", "x"], "left_semi"), ["arena"], int(settings.oscillation_period)), ["arena"])
    return out
