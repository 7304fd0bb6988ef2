"""Generators of test meshes and points, on ``spark.range`` with hashes for chance."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .schema import AXES, CORNERS, TRIANGLE

#: The eight corners of a cube, 1 at the far end of an axis, and its twelve faces (fixed values).
CUBE = ((0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0), (0, 0, 1), (1, 0, 1), (1, 1, 1), (0, 1, 1))
FACES = ((0, 2, 1), (0, 3, 2), (4, 5, 6), (4, 6, 7), (0, 1, 5), (0, 5, 4), (1, 2, 6), (1, 6, 5), (2, 3, 7), (2, 7, 6), (3, 0, 4), (3, 4, 7))


def face_bits() -> list[list[float]]:
    """For each face, 0 or 1 for the nine coordinates of its corners."""
    return [[float(x) for corner in face for x in CUBE[corner]] for face in FACES]


def uniform(seed: int, *of) -> Column:
    """A number in [0, 1) fixed by a seed and columns."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *of), 11) / F.lit(float(1 << 53))


def box_triangles(rows: DataFrame) -> DataFrame:
    """Rows with ``object_id`` and a box as twelve triangles each."""
    faces = F.array(*[F.struct(F.lit(i).alias("n"), *[(F.col(f"max_{c[1]}") if bit else F.col(f"min_{c[1]}")).alias(c) for c, bit in zip(TRIANGLE, bits)]) for i, bits in enumerate(face_bits())])
    return rows.select("object_id", F.explode(faces).alias("f")).select((F.col("object_id") * 12 + F.col("f.n")).alias("tri_idx"), "object_id", *[F.col(f"f.{c}").alias(c) for c in TRIANGLE])


def cube_triangles(objects: DataFrame) -> DataFrame:
    """``object_id, cx, cy, cz, size`` (low corner and edge) as triangles."""
    return box_triangles(objects.select("object_id", *[F.col(f"c{a}").alias(f"min_{a}") for a in AXES], *[(F.col(f"c{a}") + F.col("size")).alias(f"max_{a}") for a in AXES]))


def cubes(spark: SparkSession, n: int, extent: float = 100.0, smallest: float = 1.0, largest: float = 5.0, seed: int = 0) -> DataFrame:
    """Random cubes within ``[0, extent]`` cubed, as objects."""
    rows = spark.range(n).withColumnRenamed("id", "object_id")
    size = F.lit(smallest) + uniform(seed, "object_id", F.lit("s")) * (largest - smallest)
    rows = rows.withColumn("size", size)
    return rows.withColumns({f"c{a}": uniform(seed, "object_id", F.lit(a)) * (F.lit(extent) - F.col("size")) for a in AXES})


def cube_extent(mean_size: float, selectivity: float) -> float:
    """The side of a universe in which cubes meet with the given chance."""
    return 2 * mean_size / selectivity ** (1 / 3)


def sphere_extent(mean_cube: float, mean_square: float, mean: float, selectivity: float) -> float:
    return (math.pi / 3 * (mean_cube + 3 * mean_square * mean) / selectivity) ** (1 / 3)


def cube_selectivity(extents: tuple[float, float, float], mean_size: float) -> float:
    """The chance that two cubes meet."""
    return math.prod(min(1.0, 2 * mean_size / u) for u in extents)


def cubes_by_selectivity(spark: SparkSession, n: int, selectivity: float, smallest: float = 1.0, largest: float = 5.0, seed: int = 0) -> DataFrame:
    return cubes(spark, n, cube_extent((smallest + largest) / 2, selectivity), smallest, largest, seed)


def instances(template: DataFrame, placed: DataFrame) -> DataFrame:
    """A one-object template, normalised to unit extent, at each row of ``object_id, cx, cy, cz, size``."""
    low = [F.min(F.least(*[c + a for c in CORNERS])).alias(f"l{a}") for a in AXES]
    high = [F.max(F.greatest(*[c + a for c in CORNERS])).alias(f"h{a}") for a in AXES]
    frame = template.agg(*low, *high, F.count("*").alias("n")).first()
    unit = max(frame[f"h{a}"] - frame[f"l{a}"] for a in AXES) or 1.0
    shape = template.select("tri_idx", *[((F.col(c) - frame[f"l{c[1]}"]) / unit).alias(c) for c in TRIANGLE])
    packed = shape.agg(F.sort_array(F.collect_list(F.struct("tri_idx", *TRIANGLE))).alias("faces"))  # one template
    rows = placed.join(F.broadcast(packed)).select("object_id", "cx", "cy", "cz", "size", F.posexplode("faces").alias("n", "f"))
    return rows.select((F.col("object_id") * frame["n"] + F.col("n")).alias("tri_idx"), "object_id", *[(F.col(f"c{c[1]}") + F.col(f"f.{c}") * F.col("size")).alias(c) for c in TRIANGLE])


def sphere_faces(rings: int = 8, sectors: int = 12) -> list[list[float]]:
    """The nine coordinates of each triangle of a unit sphere."""
    def at(i: int, j: int) -> tuple[float, float, float]:
        t, f = math.pi * i / rings, 2 * math.pi * (j % sectors) / sectors
        return (math.sin(t) * math.cos(f), math.sin(t) * math.sin(f), math.cos(t)) if 0 < i < rings else (0.0, 0.0, 1.0 if i == 0 else -1.0)

    faces = []
    for i in range(rings):
        for j in range(sectors):
            a, b, c, d = at(i, j), at(i + 1, j), at(i + 1, j + 1), at(i, j + 1)
            faces += ([(a, b, c)] if i < rings - 1 else []) + ([(a, c, d)] if i > 0 else [])
    return [[x for v in f for x in v] for f in faces]


def sphere_template(spark: SparkSession, rings: int = 8, sectors: int = 12) -> DataFrame:
    """A unit sphere of triangles."""
    rows = [(n, 0, *f) for n, f in enumerate(sphere_faces(rings, sectors))]
    return spark.createDataFrame(rows, "tri_idx long, object_id long, " + ", ".join(f"{c} double" for c in TRIANGLE))


def points_in_box(spark: SparkSession, n: int, low: tuple, high: tuple, seed: int = 0) -> DataFrame:
    rows = spark.range(n).withColumnRenamed("id", "point_id")
    return rows.withColumns({a: F.lit(float(l)) + uniform(seed, "point_id", F.lit(a)) * (float(h) - float(l)) for a, l, h in zip(AXES, low, high)})


def points_in_dataset(triangles: DataFrame, n: int, seed: int = 0) -> DataFrame:
    from .operators.objects import dataset_bounds

    row = dataset_bounds(triangles).first()
    return points_in_box(triangles.sparkSession, n, tuple(row[f"min_{a}"] for a in AXES), tuple(row[f"max_{a}"] for a in AXES), seed)


def diagonal_points(spark: SparkSession, n: int, low: tuple, high: tuple, sigma: float = 0.01, seed: int = 42, clip: bool = False) -> DataFrame:
    """Points along the diagonal of the xy box with Gaussian noise across it; z uniform."""
    rows = spark.range(n).withColumnRenamed("id", "point_id")
    t = uniform(seed, "point_id", F.lit("t"))
    u, v = (F.greatest(uniform(seed, "point_id", F.lit(k)), F.lit(1e-12)) for k in ("u", "v"))
    noise = F.sqrt(-2 * F.log(u)) * F.cos(v * (2 * math.pi)) * sigma
    dx, dy = high[0] - low[0], high[1] - low[1]
    x, y = F.lit(float(low[0])) + t * dx - noise * dy, F.lit(float(low[1])) + t * dy + noise * dx
    if clip:
        x, y = (F.greatest(F.lit(float(l)), F.least(F.lit(float(h)), c)) for c, l, h in ((x, low[0], high[0]), (y, low[1], high[1])))
    return rows.withColumns({"x": x, "y": y, "z": F.lit(float(low[2])) + uniform(seed, "point_id", F.lit("z")) * (high[2] - low[2])})


def sample(rows: DataFrame, k: int, *key: str, seed: int = 0) -> DataFrame:
    """``k`` rows drawn evenly, fixed by the seed."""
    return rows.orderBy(F.xxhash64(F.lit(seed), *key), *key).limit(k)
