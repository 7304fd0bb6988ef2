"""Distance joins: boxes within a distance, nearest neighbours, exact mesh distance."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as g
from ..runtime import cut
from ..schema import BOX, TRIANGLE
from .candidates import box_join, extent, usable
from .objects import boxes

NAMES = ("a_object_id", "b_object_id")


def _boxes(df: DataFrame) -> DataFrame:
    return df if "min_x" in df.columns else boxes(df)


def aabb_intersect_join(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of objects whose boxes strictly intersect."""
    return box_join(_boxes(a).select("object_id", *BOX), _boxes(b).select("object_id", *BOX)).select(*NAMES)


def within_distance_join(a: DataFrame, b: DataFrame, distance: float, same: bool = False) -> DataFrame:
    """Pairs whose boxes are at most ``distance`` apart, with ``mindist``; ``same`` leaves out an object with itself."""
    met = box_join(_boxes(a).select("object_id", *BOX), _boxes(b).select("object_id", *BOX), reach=distance)
    met = met.withColumn("mindist", g.box_gap()).where(F.col("mindist") <= distance)
    if same:
        met = met.where(F.col("a_object_id") != F.col("b_object_id"))
    return met.select(*NAMES, "mindist")


def knn_join(a: DataFrame, b: DataFrame, k: int, same: bool = False) -> DataFrame:
    """The ``k`` objects of ``b`` whose boxes are nearest to each of ``a``: ``mindist``, then centre distance, then id.

    The radius starts where a box of that reach holds about ``k`` objects of ``b`` if they lie evenly, or at the gap
    to all of them, and doubles until every object has ``k`` neighbours within it; objects that
    have them drop out of later rounds. Objects without a usable box have no neighbours and are none;
    the search ends when the radius spans both datasets.
    """
    left, right = cut(usable(_boxes(a).select("object_id", *BOX))), cut(usable(_boxes(b).select("object_id", *BOX)))
    most = right.count()
    k_here = min(k, most)
    own, all_ = (df.agg(*[getattr(F, c[:3])(c).alias(c) for c in BOX], F.avg(extent()).alias("size")).first() for df in (left, right))
    if k_here < 1 or own["min_x"] is None:
        radius = span = -1.0
    else:
        spans = [all_[f"max_{x}"] - all_[f"min_{x}"] for x in "xyz"]
        gap = max(max(own[f"min_{x}"] - all_[f"max_{x}"], all_[f"min_{x}"] - own[f"max_{x}"], 0.0) for x in "xyz")
        span = sum((max(own[f"max_{x}"], all_[f"max_{x}"]) - min(own[f"min_{x}"], all_[f"min_{x}"])) ** 2 for x in "xyz") ** 0.5 + 1e-9
        volume = math.prod(max(s, all_["size"], 1e-9) for s in spans)
        radius = max(gap, ((k_here + 1) * volume / most) ** (1 / 3) / 2, span * 1e-9)
    open_, done = left, []
    rank = Window.partitionBy("a_object_id").orderBy("mindist", "centredist", "b_object_id")
    last = span < 0
    while not last and not open_.isEmpty():
        last = radius >= span  # every pair is within reach: what is found is all there is
        met = box_join(open_, right, reach=radius).withColumn("mindist", g.box_gap()).where(F.col("mindist") <= radius)
        if same:
            met = met.where(F.col("a_object_id") != F.col("b_object_id"))
        best = met.withColumn("centredist", g.box_centre_distance()).withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k_here)
        best = cut(best.select(*NAMES, "rank", "mindist", "centredist"))
        if last:
            done.append(best)
            break
        full = best.where(F.col("rank") == k_here).select(F.col("a_object_id").alias("object_id"))
        done.append(best.join(full, best["a_object_id"] == full["object_id"], "left_semi"))
        open_ = cut(open_.join(full, "object_id", "left_anti"))
        radius *= 2
    if not done:
        empty = left.select(F.col("object_id").alias(NAMES[0]), F.col("object_id").alias(NAMES[1])).where(F.lit(False))
        return empty.withColumns({"rank": F.lit(0), "mindist": F.lit(0.0), "centredist": F.lit(0.0)})
    out = done[0]
    for df in done[1:]:
        out = out.unionByName(df)
    return out


def _corners(prefix: str):
    return tuple(tuple(F.col(f"{prefix}{c}{x}") for x in "xyz") for c in "pqr")


def _triangles_of(pairs: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    side = lambda df, s: df.select(F.col("object_id").alias(f"{s}_object_id"), *[F.col(c).alias(f"{s}_{c}") for c in TRIANGLE])
    return pairs.select(*NAMES).join(side(a, "a"), "a_object_id").join(side(b, "b"), "b_object_id")


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", a, b)


def _share(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a / b`` cut to [0, 1]; 0 where ``b`` is 0."""
    return np.clip(np.divide(a, b, out=np.zeros_like(a), where=b != 0), 0, 1)


def _to_segment(x, a, b) -> np.ndarray:
    d = b - a
    r = x - a - d * _share(_dot(x - a, d), _dot(d, d))[:, None]
    return _dot(r, r)


def _segments(a, b, c, d) -> np.ndarray:
    """Squared distance of segments."""
    u, v, w = b - a, d - c, a - c
    uu, uv, vv, uw, vw = _dot(u, u), _dot(u, v), _dot(v, v), _dot(u, w), _dot(v, w)
    s = _share(uv * vw - vv * uw, uu * vv - uv * uv)
    t = _share(uv * s + vw, vv)
    s = _share(uv * t - uw, uu)
    r = w + u * s[:, None] - v * t[:, None]
    return np.minimum.reduce([_dot(r, r), _to_segment(a, c, d), _to_segment(b, c, d), _to_segment(c, a, b), _to_segment(d, a, b)])


def _above(x, t) -> np.ndarray:
    """Squared distance of points to triangles they lie above; infinite beside them."""
    n = np.cross(t[1] - t[0], t[2] - t[0])
    nn, h = _dot(n, n), _dot(x - t[0], n)
    inside = nn > 0
    for p, q in ((0, 1), (1, 2), (2, 0)):
        inside &= _dot(np.cross(t[q] - t[p], x - t[p]), n) >= 0
    return np.where(inside, np.divide(h * h, nn, out=np.zeros_like(h), where=nn != 0), np.inf)


def _pierces(s, e, t) -> np.ndarray:
    """Whether segments meet triangles."""
    d, e1, e2, m = e - s, t[1] - t[0], t[2] - t[0], s - t[0]
    h, g_ = np.cross(d, e2), np.cross(m, e1)
    det = _dot(e1, h)
    w, size, n = np.sign(det), np.abs(det), np.sqrt(_dot(d, d))
    u, v, k = w * _dot(m, h), w * _dot(d, g_), w * _dot(e2, g_)
    return (det != 0) & (n >= g.EPS) & (u >= 0) & (v >= 0) & (u + v <= size) & (k * n >= g.EPS * size) & (k * n <= (n + g.EPS) * size)


def triangle_distances(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Distances of pairs of triangles, of shape (3, n, 3) each; 0 where they meet."""
    sides = ((0, 1), (1, 2), (2, 0))
    near = [_segments(one[a], one[b], two[c], two[d]) for a, b in sides for c, d in sides]
    near += [_above(x, other) for t, other in ((one, two), (two, one)) for x in t]
    meet = np.logical_or.reduce([_pierces(t[a], t[b], other) for t, other in ((one, two), (two, one)) for a, b in sides])
    return np.where(meet, 0.0, np.sqrt(np.minimum.reduce(near)))


def mesh_distance(pairs: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """``distance`` of the meshes of each pair: the least over their triangles.

    As one expression a triangle pair's distance is too large to compile; the kernel runs over Arrow batches.
    """
    rows = _triangles_of(pairs, a, b).select(*NAMES, *[f"{s}_{c}" for s in "ab" for c in TRIANGLE])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            one, two = (frame.iloc[:, k : k + 9].to_numpy().reshape(-1, 3, 3).transpose(1, 0, 2) for k in (2, 11))
            out = frame.iloc[:, :2].assign(d=triangle_distances(one, two))
            yield out.groupby(list(NAMES), as_index=False)["d"].min()

    kinds = [rows.schema[n].dataType.simpleString() for n in NAMES]
    least = rows.mapInPandas(run, f"{NAMES[0]} {kinds[0]}, {NAMES[1]} {kinds[1]}, d double")
    return least.groupBy(*NAMES).agg(F.min("d").alias("distance"))


def mesh_intersects(pairs: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """Whether any triangles of each pair meet."""
    rows = _triangles_of(pairs, a, b).select(*NAMES, g.triangles_meet(_corners("a_"), _corners("b_")).alias("hit"))
    return rows.groupBy(*NAMES).agg(F.bool_or("hit").alias("intersects"))


def distance_range(distances: DataFrame, hausdorff_a: float = 0.0, proxy_a: float = 0.0, hausdorff_b: float = 0.0, proxy_b: float = 0.0) -> DataFrame:
    """The range of the true distance if the meshes are simplified, from their slacks."""
    d = F.col("distance")
    return distances.withColumns({"mindist": F.greatest(d - proxy_a - proxy_b, F.lit(0.0)), "maxdist": d + hausdorff_a + hausdorff_b})


def surface_samples(triangles: DataFrame, n: int = 3) -> DataFrame:
    """Points on each triangle: a barycentric grid of ``n`` steps per side."""
    ij = F.explode(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: F.transform(F.sequence(F.lit(0), F.lit(n) - i), lambda j: F.struct(i.alias("i"), j.alias("j"))))))
    rows = triangles.select("tri_idx", "object_id", *TRIANGLE, ij.alias("g"))
    at = [F.col("p" + x) + (F.col("q" + x) - F.col("p" + x)) * F.col("g.i") / n + (F.col("r" + x) - F.col("p" + x)) * F.col("g.j") / n for x in "xyz"]
    return rows.select("tri_idx", "object_id", *[c.alias(x) for c, x in zip(at, "xyz")])


def hausdorff(a: DataFrame, b: DataFrame, samples: int = 3) -> DataFrame:
    """Per object that both sides hold: least, greatest and mean distance of a's surface samples to b's mesh."""
    points = surface_samples(a, samples).withColumn("_n", F.xxhash64("tri_idx", "x", "y", "z"))
    faces = b.select("object_id", *TRIANGLE)
    rows = points.join(faces, "object_id").withColumn("d", F.sqrt(g.point_triangle_distance2(tuple(F.col(x) for x in "xyz"), g.vec("p"), g.vec("q"), g.vec("r"))))
    near = rows.groupBy("object_id", "tri_idx", "_n").agg(F.min("d").alias("d"))
    return near.groupBy("object_id").agg(F.min("d").alias("min_distance"), F.max("d").alias("max_distance"), F.avg("d").alias("avg_distance"))


def skeleton(triangles: DataFrame, per_object: int = 4, rounds: int = 2) -> DataFrame:
    """``object_id, core, x, y, z``: skeleton points of each object, by rounds of nearest-core means of its vertices."""
    from .objects import vertices

    points = cut(vertices(triangles))
    first = Window.partitionBy("object_id").orderBy(F.xxhash64("x", "y", "z"))
    cores = points.withColumn("core", F.row_number().over(first)).where(F.col("core") <= per_object)
    for _ in range(rounds):
        near = nearest_core(points, cores)
        cores = near.groupBy("object_id", "core").agg(*[F.avg(c).alias(c) for c in "xyz"])
    return cores.select("object_id", "core", "x", "y", "z")


def nearest_core(points: DataFrame, cores: DataFrame) -> DataFrame:
    """Each point (any columns with ``object_id, x, y, z``) with the nearest core of its object."""
    named = cores.groupBy("object_id").agg(F.collect_list(F.struct("core", "x", "y", "z")).alias("_cores"))  # a few per object
    far = F.transform("_cores", lambda c: F.struct(((c["x"] - F.col("x")) * (c["x"] - F.col("x")) + (c["y"] - F.col("y")) * (c["y"] - F.col("y")) + (c["z"] - F.col("z")) * (c["z"] - F.col("z"))).alias("d"), c["core"].alias("core")))
    return points.join(named, "object_id").withColumn("core", F.array_min(far)["core"]).drop("_cores")


def voxels(triangles: DataFrame, cores: DataFrame) -> DataFrame:
    """Triangles with the core nearest to their first vertex."""
    return nearest_core(triangles.withColumns({a: F.col("p" + a) for a in "xyz"}), cores).drop("x", "y", "z")
