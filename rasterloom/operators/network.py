"""Networks: ridge detection, skeletons, and graphs of vertices and edges by frame."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions import stacks
from . import frames

#: Sigma sets that are tried, from fine fibres to wide veins.
FRANGI_SIGMAS = ((0.75,), (0.5, 1.0), (1.0, 2.0), (1.0, 2.0, 3.0), (0.3, 0.5, 0.8), (0.5, 1.0, 2.0, 4.0), (1.0, 2.0, 4.0, 8.0), (0.5, 1.0, 1.5, 2.5), (0.5, 1.5, 3.0, 6.0, 10.0))
SATO_SIGMAS = (
    (0.01, 0.05, 0.1, 0.15), (0.1, 0.2, 0.4, 0.8), (0.25, 0.75), (0.1, 0.2, 0.4, 0.8, 1.6), (0.8, 1.5), (1.5, 3.0), (0.8, 1.5, 2.5), (1.0, 2.5, 5.0),
    (0.5, 1.0, 2.0), (1.5, 2.5, 4.0), (1.0, 1.5, 2.0, 3.0), (2.0, 5.0, 10.0, 15.0),
)


def quality(a: np.ndarray) -> float:
    """Squared outline of the largest component over all foreground: long thin shapes score high."""
    n = int(a.sum())
    return K.closed_length(K.trace(K.largest(a))) ** 2 / n if n else 0.0


def ridges(a: np.ndarray, method: str, sigmas, black: bool = True, seen: dict | None = None) -> np.ndarray:
    """The strongest response of all scales; `seen` keeps the responses of a frame's scales for its other sets."""
    seen = {} if seen is None else seen
    for s in sigmas:
        if (method, s) not in seen:
            seen[method, s] = {"frangi": K.frangi, "sato": K.sato}[method](a, (s,), black=black)
    return np.maximum.reduce([seen[method, s] for s in sigmas])


def segment(ridge: np.ndarray, rolling: bool = False) -> np.ndarray:
    """Above the frame's Otsu threshold, or by the votes of rolling windows."""
    if rolling:
        return K.rolling_otsu(ridge)
    return ridge > K.otsu(ridge) if ridge.max() > ridge.min() else np.zeros(ridge.shape, bool)


def detect(a: np.ndarray, method: str, sigmas, black: bool = True, rolling: bool = False) -> np.ndarray:
    return segment(ridges(a, method, sigmas, black), rolling)


def qualities(masks: np.ndarray) -> np.ndarray:
    """`quality` of each of an array of masks."""
    n = masks.sum((1, 2))
    return np.where(n > 0, stacks.outline_lengths(stacks.largest(masks)) ** 2 / np.maximum(n, 1), 0.0)


def method_scores(df: DataFrame, keys: Sequence[str], value: str = "v", black: bool = True, rolling: bool = True) -> DataFrame:
    """(keys, method, variant, rolling, quality) of all variants on every frame, each by one threshold and, if `rolling`, by windows too. Frames of one size go through together."""

    def kernel(stack, v):
        for at, a, _, _ in stack.by_size(v):
            seen: dict = {}
            for method, sets in (("frangi", FRANGI_SIGMAS), ("sato", SATO_SIGMAS)):
                for i, s in enumerate(sets):
                    ridge = ridges(a, method, s, black, seen)
                    for roll in (False, True) if rolling else (False,):
                        m = stacks.rolling_otsu(ridge) if roll else stacks.above_otsu(ridge)
                        yield at, [method] * len(at), np.full(len(at), i), np.full(len(at), roll), qualities(m)

    return frames.run_stacks(df, keys, value, kernel, "method string, variant int, rolling boolean, quality double", pixels=1 << 15)


def best_method(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, method, variant, rolling, quality); of equals the first in the order of the sets, one threshold before windows."""
    first = F.struct("quality", F.col("method") == "frangi", -F.col("variant"), ~F.col("rolling"))
    return scores.groupBy(*keys).agg(F.max_by(F.struct("method", "variant", "rolling"), first).alias("m"), F.max("quality").alias("quality")).select(*keys, "m.method", "m.variant", "m.rolling", "quality")


def networks(df: DataFrame, keys: Sequence[str], method: str, variant: int, value: str = "v", black: bool = True, width: int = 3, one: bool = True, rolling: bool = False) -> DataFrame:
    """Network pixels by one method, small gaps closed, the largest component alone if `one`."""
    sigmas = (FRANGI_SIGMAS if method == "frangi" else SATO_SIGMAS)[variant]

    def kernel(a, y0, x0):
        n = detect(a, method, sigmas, black, rolling)
        shape = K.disk(max(width // 2, 1))
        n = K.erode(K.dilate(n, shape), shape)
        n = K.largest(n) if one else n
        for y, x in zip(*n.nonzero()):
            yield int(y) + y0, int(x) + x0

    return frames.run(frames.pack(df, keys, value), keys, kernel, "y int, x int")


def pseudopods(df: DataFrame, keys: Sequence[str], value: str = "v", lighter_background: bool = True, least: int = 50) -> DataFrame:
    """Wide bright zones: distance inside the shape times contrast, above its Otsu threshold, in components of `least` pixels or more."""

    def kernel(a, y0, x0):
        grey = -a if lighter_background else a
        on = grey > K.otsu(grey)
        score = K.distance(on) * (grey - grey.min())
        wide = score > K.otsu(score[on]) if on.any() and np.ptp(score[on]) > 0 else np.zeros(a.shape, bool)
        n = K.label(wide)
        s = K.sizes(n)
        for y, x in zip(*(wide & (s[n] >= least)).nonzero()):
            yield int(y) + y0, int(x) + x0

    return frames.run(frames.pack(df, keys, value), keys, kernel, "y int, x int")


class Graph:
    """Vertices and edges of a skeleton.

    Tips have one neighbour, or only a mutually touching pair; branchings have three or more
    neighbours that aren't all in touch. Touching branchings are one vertex each; edges are the runs of
    skeleton pixels between vertices, edges of length one join touching vertices.
    """

    def __init__(self, s: np.ndarray, widths: np.ndarray | None = None):
        self.skeleton = K.fill_small_loops(K.largest(s)) if s.any() else s
        self.widths = widths
        self._find_vertices()
        self._find_edges()

    def _around(self, p):
        h, w = self.skeleton.shape
        return [(p[0] + dy, p[1] + dx) for dy, dx in K._RING if 0 <= p[0] + dy < h and 0 <= p[1] + dx < w and self.skeleton[p[0] + dy, p[1] + dx]]

    @staticmethod
    def _crossings(p, around) -> int:
        ring = [(p[0] + dy, p[1] + dx) in around for dy, dx in K._RING]
        return sum(not a and b for a, b in zip(ring, ring[1:] + ring[:1]))

    def _find_vertices(self):
        self.tips, self.branches = set(), set()
        for p in map(tuple, np.argwhere(self.skeleton).tolist()):
            near = set(self._around(p))
            turns = self._crossings(p, near)
            if len(near) <= 1 or (len(near) == 2 and turns == 1):
                self.tips.add(p)
            elif turns >= 3:
                self.branches.add(p)
        self.vertices = {p: i for i, p in enumerate(sorted(self.tips | self.branches), 1)}

    def _find_edges(self):
        self.edges: list[tuple[int, int, list[tuple[int, int]]]] = []
        taken: set[tuple[int, int]] = set()
        for p in self.vertices:
            for q in self._around(p):
                if q in self.vertices:
                    if p < q:
                        self.edges.append((self.vertices[p], self.vertices[q], []))
                elif q not in taken:
                    self._follow(p, q, taken)
        rest = self.skeleton.copy()
        for y, x in [*taken, *self.vertices]:
            rest[y, x] = False
        n = K.label(rest)
        for k in range(1, int(n.max()) + 1):  # closed loops without a vertex get one at their first pixel
            pixels = list(map(tuple, np.argwhere(n == k).tolist()))
            if len(pixels) > 2:
                touching = sorted({v for p in pixels for q in self._around(p) if (v := self.vertices.get(q))})
                if not touching:
                    self.vertices[pixels[0]] = max(self.vertices.values(), default=0) + 1
                    touching, pixels = [self.vertices[pixels[0]]], pixels[1:]
                self.edges.append((touching[0], touching[-1], pixels))

    def _follow(self, p, q, taken):
        path, before = [q], {p}
        taken.add(q)
        while True:
            ahead = [r for r in self._around(path[-1]) if r not in before and r not in taken]
            ends = [r for r in ahead if r in self.vertices]
            if ends:
                four = [r for r in ends if abs(r[0] - path[-1][0]) + abs(r[1] - path[-1][1]) == 1]
                self.edges.append((self.vertices[p], self.vertices[(four or ends)[0]], path))
                return
            if not ahead:
                if p in self._around(path[-1]) and len(path) > 2:
                    self.edges.append((self.vertices[p], self.vertices[p], path))
                else:
                    taken.difference_update(path[1:])
                return
            ahead.sort(key=lambda r: abs(r[0] - path[-1][0]) + abs(r[1] - path[-1][1]))
            before = {path[-1], p} if len(path) < 2 else {path[-1]}
            path.append(ahead[0])
            taken.add(ahead[0])

    def length(self, i: int) -> float:
        a, b, pixels = self.edges[i]
        at = {v: k for k, v in self.vertices.items()}
        line = np.array([at[a], *pixels, at[b]])
        return float(np.sqrt((np.diff(line, axis=0) ** 2).sum(1)).sum())


def skeletons(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, y, x, width) of the skeleton of each frame's largest component; width is twice the distance to the background."""

    def kernel(a, y0, x0):
        p = np.pad(a, 1)
        s = K.fill_small_loops(K.skeleton(K.largest(p)))
        d = K.distance(p)
        for y, x in zip(*s.nonzero()):
            yield int(y) + y0 - 1, int(x) + x0 - 1, float(2 * d[y, x])

    return frames.run(frames.pack(df, keys), keys, kernel, "y int, x int, width double")


def graphs(skeleton: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Tagged rows by frame: kind "vertex" (id, y, x, is_tip), "edge" (id, v1, v2, length), "pixel" (id, y, x)."""

    def kernel(a, y0, x0):
        g = Graph(np.pad(a, 1))
        for (y, x), i in g.vertices.items():
            yield "vertex", i, y + y0 - 1, x + x0 - 1, None, None, None, (y, x) in g.tips
        for i, (v1, v2, pixels) in enumerate(g.edges, 1):
            yield "edge", i, None, None, v1, v2, g.length(i - 1), None
            for y, x in pixels:
                yield "pixel", i, y + y0 - 1, x + x0 - 1, None, None, None, None

    return frames.run(frames.pack(skeleton, keys), keys, kernel, "kind string, id int, y int, x int, v1 int, v2 int, length double, is_tip boolean")


def vertex_table(g: DataFrame, keys: Sequence[str], origin: DataFrame | None = None, growing: DataFrame | None = None) -> DataFrame:
    """(keys, y, x, vertex_id, is_tip, origin, vertex_connected): origin 1 on the origin's outline, 2 in growing areas."""
    v = g.where("kind = 'vertex'").select(*keys, "y", "x", F.col("id").alias("vertex_id"), "is_tip")
    ends = g.where("kind = 'edge'").select(*keys, F.explode(F.array("v1", "v2")).alias("vertex_id")).distinct().withColumn("c", F.lit(True))
    v = v.join(ends, [*keys, "vertex_id"], "left").withColumn("vertex_connected", F.coalesce("c", F.lit(False))).drop("c").withColumn("origin", F.lit(0))
    for n, area in ((1, origin), (2, growing)):
        if area is not None:
            on = [k for k in [*keys, "y", "x"] if k in area.columns]
            v = v.join(area.select(*on).distinct().withColumn("h", F.lit(n)), on, "left").withColumn("origin", F.coalesce("h", "origin")).drop("h")
    return v.select(*keys, "y", "x", "vertex_id", "is_tip", "origin", "vertex_connected")


def edge_table(g: DataFrame, skeleton: DataFrame, keys: Sequence[str], grey: DataFrame | None = None) -> DataFrame:
    """(keys, edge_id, vertex1, vertex2, length, average_width, intensity)."""
    px = g.where("kind = 'pixel'").select(*keys, F.col("id").alias("edge_id"), "y", "x").join(skeleton.select(*keys, "y", "x", "width"), [*keys, "y", "x"], "left")
    px = px.join(grey.select(*keys, "y", "x", F.col("v").alias("g")), [*keys, "y", "x"], "left") if grey is not None else px.withColumn("g", F.lit(None).cast("double"))
    means = px.groupBy(*keys, "edge_id").agg(F.avg("width").alias("average_width"), F.avg("g").alias("intensity"))
    e = g.where("kind = 'edge'").select(*keys, F.col("id").alias("edge_id"), F.col("v1").alias("vertex1"), F.col("v2").alias("vertex2"), "length")
    return e.join(means, [*keys, "edge_id"], "left")


def edge_pixels(g: DataFrame, keys: Sequence[str]) -> DataFrame:
    return g.where("kind = 'pixel'").select(*keys, "y", "x", F.col("id").alias("edge_id"))


def unique_edges(edge: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Edges without repeats of the same ends and length."""
    return edge.withColumn("__a", F.least("vertex1", "vertex2")).withColumn("__b", F.greatest("vertex1", "vertex2")).dropDuplicates([*keys, "__a", "__b", "length"]).drop("__a", "__b")


def degrees(edge: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Ends per vertex; a loop counts twice."""
    return edge.select(*keys, F.explode(F.array("vertex1", "vertex2")).alias("vertex_id")).groupBy(*keys, "vertex_id").agg(F.count(F.lit(1)).alias("degree"))


def contract(edge: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Edges (vertex1, vertex2, length) with vertices of degree 2 taken out and their two edges joined, frame by frame."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for i in range(len(batch)):
                own = [batch.column(k)[i].as_py() for k in range(len(keys))]
                for a, b, n in joined([(e["vertex1"], e["vertex2"], e["length"]) for e in batch.column(len(keys))[i].as_py()]):
                    rows.append((*own, a, b, n))
            if rows:
                names = [*keys, "vertex1", "vertex2", "length"]
                types = [f.type for f in batch.schema][: len(keys)] + [pa.int32(), pa.int32(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)

    packed = edge.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("vertex1", "vertex2", "length"))).alias("e"))
    key_types = ", ".join(f"`{k}` {edge.schema[k].dataType.simpleString()}" for k in keys)
    return packed.mapInArrow(run, f"{key_types}, vertex1 int, vertex2 int, length double")


def joined(edges: list[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
    """Edges of one graph without vertices of degree 2; a lone loop keeps one."""
    own = dict(enumerate(edges))
    at: dict[int, list[int]] = {}
    for i, (a, b, _) in own.items():
        at.setdefault(a, []).append(i)
        at.setdefault(b, []).append(i)
    for v in sorted(at):
        if len(at[v]) == 2 and at[v][0] != at[v][1]:
            i, j = at[v]
            (a, b, m), (c, d, n) = own.pop(i), own.pop(j)
            p, q = b if a == v else a, d if c == v else c
            own[i] = (min(p, q), max(p, q), m + n)
            at[q] = [i if k == j else k for k in at[q]]
            at[v] = []
    return sorted(own.values())


def betweenness(edges: list[tuple[int, int]]) -> dict[tuple[int, int], float]:
    """Share of shortest paths that use an edge, by accumulation from every vertex."""
    from collections import deque

    near: dict[int, set[int]] = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    total = {(min(a, b), max(a, b)): 0.0 for a, b in edges}
    for s in near:
        order, dist, ways, before = [], {s: 0}, {s: 1.0}, {}
        todo = deque([s])
        while todo:
            v = todo.popleft()
            order.append(v)
            for w in near[v]:
                if w not in dist:
                    dist[w] = dist[v] + 1
                    todo.append(w)
                if dist[w] == dist[v] + 1:
                    ways[w] = ways.get(w, 0.0) + ways[v]
                    before.setdefault(w, []).append(v)
        flow = dict.fromkeys(order, 0.0)
        for w in reversed(order):
            for v in before.get(w, ()):
                part = ways[v] / ways[w] * (1 + flow[w])
                total[(min(v, w), max(v, w))] += part
                flow[v] += part
    n = len(near)
    return {e: x / (n * (n - 1)) if n > 1 else 0.0 for e, x in total.items()}
