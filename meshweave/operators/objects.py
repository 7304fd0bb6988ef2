"""Per-object and per-dataset features of triangles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..schema import AXES, CORNERS


def boxes(triangles: DataFrame, *more: Column) -> DataFrame:
    """``object_id`` and its bounding box, with ``more`` aggregates in the same pass."""
    aggs = [f(getattr(F, how)(*[c + a for c in CORNERS])).alias(f"{name}_{a}") for name, f, how in (("min", F.min, "least"), ("max", F.max, "greatest")) for a in AXES]
    return triangles.groupBy("object_id").agg(*aggs, *more)


def dataset_bounds(triangles: DataFrame) -> DataFrame:
    """One row: the bounding box of all triangles."""
    aggs = [f(getattr(F, how)(*[c + a for c in CORNERS])).alias(f"{name}_{a}") for name, f, how in (("min", F.min, "least"), ("max", F.max, "greatest")) for a in AXES]
    return triangles.agg(*aggs)


def first_vertices(triangles: DataFrame) -> DataFrame:
    """``object_id, x, y, z``: corner 0 of the object's first triangle."""
    first = F.min_by(F.struct("px", "py", "pz"), "tri_idx").alias("v")
    return triangles.groupBy("object_id").agg(first).select("object_id", F.col("v.px").alias("x"), F.col("v.py").alias("y"), F.col("v.pz").alias("z"))


def features(triangles: DataFrame) -> DataFrame:
    """Box, first vertex, volume, volume ratio and average size of each object, in one shuffle.

    The volume sums tetrahedra over a reference point; any is right for a closed
    mesh, so the sums are kept that move it to the box's centre afterwards.
    """
    p, q, r = g.vec("p"), g.vec("q"), g.vec("r")
    sums = [F.sum(g.signed_tetra(p, q, r)).alias("_v0")]
    n = g.triangle_normal(p, q, r)
    sums += [F.sum(n[i]).alias(f"_n{a}") for i, a in enumerate(AXES)]
    first = F.min_by(F.struct("px", "py", "pz"), "tri_idx").alias("_first")
    rows = boxes(triangles, *sums, first)
    # det(p-c, q-c, r-c) = det(p, q, r) - c . ((q-p) x (r-p))
    centre = [(F.col(f"min_{a}") + F.col(f"max_{a}")) / 2 for a in AXES]
    six = F.col("_v0") - centre[0] * F.col("_nx") - centre[1] * F.col("_ny") - centre[2] * F.col("_nz")
    rows = rows.withColumn("volume", F.abs(six) / 6)
    ratio = F.least(F.lit(1.0), F.col("volume") / F.greatest(g.box_volume(), F.lit(1e-9)))
    size = sum((F.col(f"max_{a}") - F.col(f"min_{a}") for a in AXES[1:]), F.col("max_x") - F.col("min_x")) / 3
    rows = rows.withColumns({"vol_ratio": ratio, "avg_size": size, **{f"first_{a}": F.col(f"_first.p{a}") for a in AXES}})
    return rows.drop("_v0", "_nx", "_ny", "_nz", "_first")


def vertices(triangles: DataFrame) -> DataFrame:
    """``object_id, x, y, z``: the distinct vertices of each object."""
    corner = F.explode(F.array(*[F.struct(*[F.col(c + a).alias(a) for a in AXES]) for c in CORNERS]))
    return triangles.select("object_id", corner.alias("v")).select("object_id", "v.*").distinct()


def indexed_vertices(triangles: DataFrame) -> DataFrame:
    """Distinct vertices with ``vertex``, their number within the object in order of coordinates."""
    from pyspark.sql.window import Window

    return vertices(triangles).withColumn("vertex", F.row_number().over(Window.partitionBy("object_id").orderBy(*AXES)) - 1)


def centroids(triangles: DataFrame) -> DataFrame:
    """The mean of each object's distinct vertices."""
    return vertices(triangles).groupBy("object_id").agg(*[F.avg(a).alias(a) for a in AXES])


def surface(triangles: DataFrame) -> DataFrame:
    """``object_id, area, n_triangles``."""
    return triangles.groupBy("object_id").agg(F.sum(g.triangle_area(g.vec("p"), g.vec("q"), g.vec("r"))).alias("area"), F.count("*").alias("n_triangles"))


def count_objects(triangles: DataFrame) -> DataFrame:
    return triangles.agg(F.count_distinct("object_id").alias("n_objects"))


def translate(triangles: DataFrame, by: tuple) -> DataFrame:
    """All triangles moved by a vector of numbers or Columns."""
    return triangles.withColumns({c + a: F.col(c + a) + F.lit(d) if not isinstance(d, Column) else F.col(c + a) + d for c in CORNERS for a, d in zip(AXES, by)})


def shuffle_objects(triangles: DataFrame, seed: int, reach: float = 15.0) -> DataFrame:
    """Each object moved by its own vector, uniform in [-reach, reach) per axis and fixed by the seed."""
    move = [F.pmod(F.xxhash64(F.col("object_id"), F.lit(seed), F.lit(i)), F.lit(1 << 30)) / float(1 << 30) * (2 * reach) - reach for i in range(3)]
    return translate(triangles, tuple(move))


def resize(triangles: DataFrame, factor: float) -> DataFrame:
    """Objects shrunk or grown about the centres of their boxes."""
    centre = boxes(triangles).select("object_id", *[((F.col(f"min_{a}") + F.col(f"max_{a}")) / 2).alias(f"_c{a}") for a in AXES])
    rows = triangles.join(centre, "object_id")
    return rows.withColumns({c + a: F.col(f"_c{a}") + (F.col(c + a) - F.col(f"_c{a}")) * factor for c in CORNERS for a in AXES}).drop(*[f"_c{a}" for a in AXES])


def barycentres(triangles: DataFrame) -> DataFrame:
    return triangles.select("tri_idx", "object_id", *[((F.col("p" + a) + F.col("q" + a) + F.col("r" + a)) / 3).alias(a) for a in AXES])


def face_boxes(triangles: DataFrame) -> DataFrame:
    return triangles.select("tri_idx", "object_id", *[getattr(F, how)(*[c + a for c in CORNERS]).alias(f"{name}_{a}") for name, how in (("min", "least"), ("max", "greatest")) for a in AXES])


def open_edges(edges: DataFrame) -> DataFrame:
    """Edges that do not have exactly two triangles: where a mesh is open."""
    return edges.where("n_triangles != 2")
