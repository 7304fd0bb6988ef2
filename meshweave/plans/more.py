"""Further registered queries: files, generators, face features, and meshes that are no cubes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import generate, sinks
from ..functions import geometry as g
from ..operators import distance, edges, joins, objects
from ..runtime import shared_path, tune
from ..schema import AXES, TRIANGLE
from ..sources import readers
from .queries import _GAP, _HIT, AB, CB, CENTRE_IN, MEET, SIDES, mesh, objects_sql, placed, points, query, rounded, triangles_sql

# --- files: written to the shared folder and read back ---------------------------------------


@query(f"WITH {objects_sql('a')}, {objects_sql('p', 'pts')} SELECT p.id AS \"pointId\", a.id AS \"polygonId\" FROM pts p JOIN obj_a a ON {CENTRE_IN('a')}")
def csv_points(spark, d):
    path = shared_path(spark, "points-csv")
    sinks.write_csv(joins.point_in_mesh(points(spark, d), mesh(spark, d, "a"), "per_object"), path, "points")
    return spark.read.csv(path, header=True, schema="pointId long, polygonId long")


@query(f"WITH {AB} SELECT a.id AS a_object_id, b.id AS b_object_id FROM obj_a a, obj_b b WHERE {MEET}")
def csv_pairs(spark, d):
    path = shared_path(spark, "pairs-csv")
    sinks.write_csv(distance.aabb_intersect_join(mesh(spark, d, "a"), mesh(spark, d, "b")), path, "containment", ordered=True)
    return spark.read.csv(path, header=True, schema="a_object_id long, b_object_id long")


def _measures(triangles: DataFrame) -> DataFrame:
    """One row: objects, triangles, area and bounds of a mesh, rounded."""
    rows = objects.surface(triangles).agg(F.count("*").alias("n_objects"), F.sum("n_triangles").alias("n_triangles"), F.round(F.sum("area"), 3).alias("area"))
    bounds = objects.dataset_bounds(triangles).select(F.round("min_x", 6).alias("min_x"), F.round("max_z", 6).alias("max_z"))
    return rows.crossJoin(bounds)  # one row each


_CUBES = "SELECT count(*) AS n_objects, (12 * count(*))::BIGINT AS n_triangles, round(sum(6*size*size), 3) AS area, round(min(x0), 6) AS min_x, round(max(z1), 6) AS max_z"


@query(f"WITH {objects_sql('b')} {_CUBES} FROM obj_b")
def off_round_trip(spark, d):
    path = shared_path(spark, "off")
    sinks.off_lines(mesh(spark, d, "b")).select("value").write.text(path)
    return _measures(readers.read_off(spark, path))


@query(f"WITH {objects_sql('p', 'pts')} SELECT count(*) AS n, count(*) AS n_ids, round(min(cx), 6) AS min_x, round(max(cy), 6) AS max_y, round(sum(cz), 3) AS sum_z FROM pts")
def point_file(spark, d):
    path = shared_path(spark, "points")
    at = F.concat_ws(" ", *[F.col(a).cast("string") for a in AXES])
    points(spark, d).select(F.concat(F.lit("POINT Z ("), at, F.lit(")"))).write.text(path)
    return readers.read_points(spark, path).agg(F.count("*").alias("n"), (F.max("point_id") + 1).alias("n_ids"), F.round(F.min("x"), 6).alias("min_x"), F.round(F.max("y"), 6).alias("max_y"), F.round(F.sum("z"), 3).alias("sum_z"))


@query(f"WITH {objects_sql('b')} SELECT count(*) AS n_objects, (2 * count(*))::BIGINT AS n_triangles, round(sum(size*size), 3) AS area, round(min(x0), 6) AS min_x, 0e0 AS max_z FROM obj_b")
def polygon_file(spark, d):
    """Squares as polygons in a text file, cut into triangles."""
    path = shared_path(spark, "polygons")
    x, y, u, v = F.col("cx"), F.col("cy"), F.col("cx") + F.col("size"), F.col("cy") + F.col("size")
    ring = F.concat_ws(", ", *[F.concat_ws(" ", a.cast("string"), b.cast("string")) for a, b in ((x, y), (u, y), (u, v), (x, v), (x, y))])
    placed(tune(spark), d, *SIDES["b"]).select(F.concat(F.lit("POLYGON (("), ring, F.lit("))"))).write.text(path)
    return _measures(readers.read_wkt(spark, path))


@query(f"WITH {objects_sql('c')} SELECT id AS object_id, 12 AS n_faces FROM obj_c")
def surface_texts(spark, d):
    return sinks.surfaces(mesh(spark, d, "c")).select("object_id", (F.size(F.split("wkt", r"\(\(")) - 1 - F.when(F.col("wkt").startswith("POLYHEDRALSURFACE Z (("), 0).otherwise(0)).alias("n_faces"))


# --- faces, edges and generators --------------------------------------------------------------


@query(f"WITH {triangles_sql('a')} SELECT tri_idx, object_id, round((px+qx+rx)/3, 6) AS x, round((py+qy+ry)/3, 6) AS y, round((pz+qz+rz)/3, 6) AS z FROM tri_a")
def barycentres(spark, d):
    return rounded(objects.barycentres(mesh(spark, d, "a")), *AXES)


@query(f"WITH {triangles_sql('a')} SELECT tri_idx, object_id, " + ", ".join(f"{f}(p{x}, q{x}, r{x}) AS {m}_{x}" for m, f in (("min", "least"), ("max", "greatest")) for x in AXES) + " FROM tri_a")
def face_boxes(spark, d):
    return objects.face_boxes(mesh(spark, d, "a"))


@query(f"WITH {triangles_sql('a')} SELECT tri_idx, true AS own, false AS beside FROM tri_a")
def in_triangle_cylinder(spark, d):
    """A face's barycentre lies over it, the mirror of a corner at another does not."""
    p, q, r = g.vec("p"), g.vec("q"), g.vec("r")
    centre = tuple((a + b + c) / 3 for a, b, c in zip(p, q, r))
    far = tuple(a * 2 - b for a, b in zip(p, q))
    return mesh(spark, d, "a").select("tri_idx", g.in_triangle_cylinder(centre, p, q, r).alias("own"), g.in_triangle_cylinder(far, p, q, r).alias("beside"))


@query(f"WITH {objects_sql('a')} SELECT count(*) * 3 AS n_open, count(*) AS n_objects FROM obj_a")
def open_edges(spark, d):
    """Cubes without their first face are open along its three edges."""
    found = objects.open_edges(edges.unique_edges(mesh(spark, d, "a").where("tri_idx % 12 <> 0")))
    return found.agg(F.count("*").alias("n_open"), F.count_distinct(F.col("source_objects")[0]).alias("n_objects"))


@query(f"WITH {objects_sql('a')} SELECT id AS object_id, round(x0 + size/4, 6) AS min_x, round(y1 - size/4, 6) AS max_y FROM obj_a")
def resized(spark, d):
    return rounded(objects.boxes(objects.resize(mesh(spark, d, "a"), 0.5)).select("object_id", "min_x", "max_y"), "min_x", "max_y")


@query(f"WITH {objects_sql('b')} SELECT id AS object_id, 0e0 AS min_distance, 0.25e0 AS max_distance FROM obj_b")
def hausdorff(spark, d):
    """Cubes against themselves moved by a quarter: samples on faces across the move are that far off."""
    b = mesh(spark, d, "b")
    found = distance.hausdorff(b, objects.translate(b, (0.0, 0.0, 0.25)))
    return rounded(found.select("object_id", "min_distance", "max_distance"), "min_distance", "max_distance")


@query(f"WITH {CB} SELECT a.id AS a_object_id, b.id AS b_object_id, round(greatest(sqrt({_GAP}) - 0.3e0, 0e0), 6) AS mindist, round(sqrt({_GAP}) + 0.7e0, 6) AS maxdist FROM obj_a a, obj_b b WHERE sqrt({_GAP}) <= 2e0")
def distance_ranges(spark, d):
    near = distance.within_distance_join(mesh(spark, d, "c"), mesh(spark, d, "b"), 2.0).withColumnRenamed("mindist", "distance")
    return rounded(distance.distance_range(near, 0.5, 0.1, 0.2, 0.2).drop("distance"), "mindist", "maxdist")


@query("SELECT count(*) AS n, count(*) AS n_inside, count(*) AS n_sized FROM part")
def generated_cubes(spark, d):
    n = spark.read.parquet(f"{d}/part.parquet").count()
    rows = generate.cubes(spark, n, 50.0, 1.0, 5.0, seed=3)
    inside = F.lit(True)
    for a in AXES:
        inside = inside & (F.col(f"c{a}") >= 0) & (F.col(f"c{a}") + F.col("size") <= 50 + 1e-9)
    return rows.agg(F.count("*").alias("n"), F.count_if(inside).alias("n_inside"), F.count_if(F.col("size").between(1, 5)).alias("n_sized"))


@query("SELECT count(*) AS n, count(*) AS n_clipped, count(*) AS n_inside, least(count(*), 100) AS n_sampled FROM supplier")
def generated_points(spark, d):
    n = spark.read.parquet(f"{d}/supplier.parquet").count()
    within = lambda df: df.where("x between 0 and 9 and y between 0 and 9 and z between 0 and 9")
    line = generate.diagonal_points(spark, n, (0, 0, 0), (9, 9, 9), clip=True)
    box = generate.points_in_box(spark, n, (0, 0, 0), (9, 9, 9), seed=5)
    counts = [df.agg(F.count("*").alias(name)) for df, name in ((box, "n"), (within(line), "n_clipped"), (within(box), "n_inside"), (generate.sample(box, 100, "point_id").distinct(), "n_sampled"))]
    out = counts[0]
    for one in counts[1:]:
        out = out.crossJoin(one)  # one row each
    return out


# --- spheres: meshes with slanted faces and a volume ratio below 1 ------------------------------

RINGS, SECTORS = 6, 8


def _sphere() -> list[list[float]]:
    """The template's triangles, moved to a low corner of 0 and a longest side of 1."""
    faces = generate.sphere_faces(RINGS, SECTORS)
    low = [min(f[i] for f in faces for i in range(k, 9, 3)) for k in range(3)]
    high = [max(f[i] for f in faces for i in range(k, 9, 3)) for k in range(3)]
    unit = max(h - lo for lo, h in zip(low, high))
    return [[(x - low[i % 3]) / unit for i, x in enumerate(f)] for f in faces]


def _volume() -> float:
    total = 0.0
    for px, py, pz, qx, qy, qz, rx, ry, rz in _sphere():
        total += (py * qz - pz * qy) * rx + (pz * qx - px * qz) * ry + (px * qy - py * qx) * rz
    return abs(total) / 6


def spheres(spark, d, side: str) -> DataFrame:
    return generate.instances(generate.sphere_template(spark, RINGS, SECTORS), placed(tune(spark), d, *SIDES[side]))


def spheres_sql(side: str) -> str:
    """CTEs ``obj_<side>`` (with the spheres' boxes), ``tri_<side>`` and ``edge_<side>``."""
    faces = _sphere()
    rows = ", ".join(f"({n}, {', '.join(f'{x!r}::DOUBLE' for x in f)})" for n, f in enumerate(faces))
    names = ", ".join(f"f{c}" for c in TRIANGLE)
    cols = ", ".join(f"c{c[1]}+f{c}*size AS {c}" for c in TRIANGLE)
    top = {a: max(f[i] for f in faces for i in range(k, 9, 3)) for k, a in enumerate(AXES)}
    box = ", ".join(f"c{a} AS {a}0, c{a}+{top[a]!r}::DOUBLE*size AS {a}1" for a in AXES)
    base = objects_sql(side, f"cube_{side}")
    three = " UNION ALL ".join(f"SELECT tri_idx, {i} AS edge_no, object_id, {', '.join(f'{a}{x} AS s{x}' for x in AXES)}, {', '.join(f'{b}{x} AS e{x}' for x in AXES)} FROM tri_{side}" for i, (a, b) in enumerate((("p", "q"), ("q", "r"), ("r", "p"))))
    return f"""{base}, obj_{side} AS (SELECT id, cx, cy, cz, size, {box} FROM cube_{side}),
      tri_{side} AS MATERIALIZED (SELECT id*{len(faces)}+n AS tri_idx, id AS object_id, {cols} FROM obj_{side}, (VALUES {rows}) fa(n, {names})), edge_{side} AS MATERIALIZED ({three})"""


@query(f"WITH {spheres_sql('c')} SELECT id AS object_id, round({_volume()!r}::DOUBLE*size*size*size, 6) AS volume, round({_volume()!r}::DOUBLE*size*size*size/((x1-x0)*(y1-y0)*(z1-z0)), 6) AS vol_ratio FROM obj_c")
def sphere_features(spark, d):
    return rounded(objects.features(spheres(spark, d, "c")).select("object_id", "volume", "vol_ratio"), "volume", "vol_ratio")


def _directed(a: str, b: str) -> str:
    rows = f"(SELECT c.o1, c.o2, e.*, t.px, t.py, t.pz, t.qx, t.qy, t.qz, t.rx, t.ry, t.rz FROM (SELECT a.id AS o1, b.id AS o2 FROM obj_{a} a, obj_{b} b WHERE {MEET}) c JOIN edge_{a} e ON e.object_id = c.o1 JOIN tri_{b} t ON t.object_id = c.o2)"
    return "SELECT o1, o2 FROM " + _HIT.format(rows=rows)


@query(f"WITH {spheres_sql('c')}, {spheres_sql('b')} SELECT o1 AS object_id_mesh1, o2 AS object_id_mesh2 FROM ({_directed('c', 'b')}) UNION SELECT o2, o1 FROM ({_directed('b', 'c')})")
def sphere_overlap(spark, d):
    return joins.overlap(spheres(spark, d, "c"), spheres(spark, d, "b"))
