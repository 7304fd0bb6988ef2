"""The registered queries over meshes derived from the TPC-H-like tables.

Cubes come from ``part`` (A), ``customer`` (B) and ``supplier`` (C), points from
``orders``; their places are quadratic residues of the keys. Every table has moduli and
an offset of its own, so that no two coordinates of different tables tie.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import generate
from ..functions import geometry as g
from ..operators import distance, edges, grid, joins, objects
from ..runtime import tune
from ..schema import AXES, BOX, TRIANGLE

SIDES = {"a": ("part", "p_partkey", 11), "b": ("customer", "c_custkey", 77777), "c": ("supplier", "s_suppkey", 5)}
#: A residue's factors of the key squared and of the key.
FACTORS = {"cx": (7919, 31), "cy": (104729, 57), "cz": (1299709, 91)}
SIZE = (15485863, 17, 1009)
#: By salt: the moduli of the three axes, and the offset of a residue.
MODULI = {11: ((10007, 10009, 10037), 0.25), 77777: ((10039, 10061, 10067), 0.5), 5: ((10069, 10079, 10091), 0.75), 3: ((10093, 10099, 10103), 0.125)}


def residues(salt: int) -> dict[str, tuple[int, int, int, float]]:
    """For each axis: the factors, the modulus and the offset."""
    moduli, offset = MODULI[salt]
    return {name: (*FACTORS[name], m, offset) for name, m in zip(FACTORS, moduli)}


GRID_RES = 16


def universe(spark: SparkSession, sf_dir: str) -> float:
    """The side of the universe: 40 for 2,000 parts, growing with their cube root, in whole units."""
    n = spark.read.parquet(f"{sf_dir}/part.parquet").count()
    return float(math.ceil(40.0 * (n / 2000.0) ** (1 / 3) - 1e-6))


def placed(spark: SparkSession, sf_dir: str, table: str, key: str, salt: int) -> DataFrame:
    """``object_id, cx, cy, cz, size`` of each row of a table."""
    u = universe(spark, sf_dir)
    k = F.col(key).cast("long")

    def part(a: int, b: int, m: int, offset: float = 0.0) -> Column:
        rest = k % m  # the same residue, without products that outgrow a long
        return (((rest * rest * F.lit(a).cast("long") + rest * F.lit(b) + F.lit(salt)) % m) + F.lit(offset)) / F.lit(float(m))

    cols = {name: part(*spec) * u for name, spec in residues(salt).items()}
    own = F.struct(*[c.alias(n) for n, c in cols.items()], (F.lit(1.0) + part(*SIZE) * 4.0).alias("size"))
    # through a generator, so that the optimiser doesn't copy the formulas into every coordinate of every face
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(k.alias("object_id"), F.explode(F.array(own)).alias("o")).select("object_id", "o.*")


def mesh(spark: SparkSession, sf_dir: str, side: str) -> DataFrame:
    tune(spark)
    return generate.cube_triangles(placed(spark, sf_dir, *SIDES[side]))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return placed(spark, sf_dir, "orders", "o_orderkey", 3).select(F.col("object_id").alias("point_id"), F.col("cx").alias("x"), F.col("cy").alias("y"), F.col("cz").alias("z"))


# --- the same inputs in SQL ------------------------------------------------------------


def _u() -> str:
    return "(SELECT ceil(40e0*pow(count(*)/2000e0, 1e0/3e0) - 1e-6) AS u FROM part)"


def _part(key: str, salt: int, a: int, b: int, m: int, offset: float = 0.0) -> str:
    return f"(((({key}*{key}*{a}::BIGINT + {key}*{b} + {salt}) % {m})+{offset}e0)/{m}e0)"


def objects_sql(side: str, name: str | None = None) -> str:
    """A CTE ``obj_<side>`` with the cubes and their boxes."""
    table, key, salt = {**SIDES, "p": ("orders", "o_orderkey", 3)}[side]
    cols = ", ".join(f"{_part(key, salt, *spec)}*u AS {c}" for c, spec in residues(salt).items())
    return f"""{name or 'obj_' + side} AS (SELECT *, cx AS x0, cy AS y0, cz AS z0, cx+size AS x1, cy+size AS y1, cz+size AS z1 FROM
      (SELECT {key}::BIGINT AS id, {cols}, 1e0+{_part(key, salt, *SIZE)}*4e0 AS size FROM {table}, {_u()} un))"""


def triangles_sql(side: str) -> str:
    """CTEs ``obj_<side>`` and ``tri_<side>``."""
    rows = ", ".join("(" + ", ".join(map(str, [n, *[f"{b:g}e0" for b in bits]])) + ")" for n, bits in enumerate(generate.face_bits()))
    names = ", ".join(f"f{c}" for c in TRIANGLE)
    cols = ", ".join(f"CASE WHEN f{c} > 0 THEN c{c[1]}+size ELSE c{c[1]} END AS {c}" for c in TRIANGLE)
    return f"{objects_sql(side)}, tri_{side} AS MATERIALIZED (SELECT id*12+n AS tri_idx, id AS object_id, {cols} FROM obj_{side}, (VALUES {rows}) fa(n, {names}))"


def edges_sql(side: str) -> str:
    three = " UNION ALL ".join(f"SELECT tri_idx, {i} AS edge_no, object_id, {', '.join(f'{a}{x} AS s{x}' for x in AXES)}, {', '.join(f'{b}{x} AS e{x}' for x in AXES)} FROM tri_{side}" for i, (a, b) in enumerate((("p", "q"), ("q", "r"), ("r", "p"))))
    return f"{triangles_sql(side)}, edge_{side} AS MATERIALIZED ({three})"


MEET = "a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1 AND a.z0 < b.z1 AND b.z0 < a.z1"


def _within(i: str, o: str) -> str:
    return " AND ".join(f"{o}.{x}0 < {i}.{x}0 AND {i}.{x}1 < {o}.{x}1" for x in AXES)


def _first_in(i: str, o: str) -> str:
    return " AND ".join(f"{o}.{x}0 < {i}.{x}0 AND {i}.{x}0 < {o}.{x}1" for x in AXES)


#: Surfaces of two cubes cross exactly if their boxes meet and neither holds the other.
CROSS = f"({MEET}) AND NOT ({_within('a', 'b')}) AND NOT ({_within('b', 'a')})"
PAIRS = "a.id AS object_id_mesh1, b.id AS object_id_mesh2"
AB = f"{objects_sql('a')}, {objects_sql('b')}"
CENTRE_IN = lambda o: " AND ".join(f"{o}.{x}0 < p.c{x} AND p.c{x} < {o}.{x}1" for x in AXES)

_HIT = """(SELECT h.*, sqrt(dx*dx+dy*dy+dz*dz) AS n, sign(det) AS w, abs(det) AS ad FROM (SELECT *, e1x*hx+e1y*hy+e1z*hz AS det, mx*hx+my*hy+mz*hz AS un,
  dx*gx+dy*gy+dz*gz AS vn, e2x*gx+e2y*gy+e2z*gz AS tn FROM (SELECT *, dy*e2z-dz*e2y AS hx, dz*e2x-dx*e2z AS hy, dx*e2y-dy*e2x AS hz,
  my*e1z-mz*e1y AS gx, mz*e1x-mx*e1z AS gy, mx*e1y-my*e1x AS gz FROM (SELECT o1, o2, ex-sx AS dx, ey-sy AS dy, ez-sz AS dz, qx-px AS e1x, qy-py AS e1y, qz-pz AS e1z,
  rx-px AS e2x, ry-py AS e2y, rz-pz AS e2z, sx-px AS mx, sy-py AS my, sz-pz AS mz FROM {rows}))) h)
  WHERE det <> 0 AND n >= 1e-6 AND w*un >= 0 AND w*vn >= 0 AND w*(un+vn) <= ad AND w*tn*n >= 1e-6*ad AND w*tn*n <= (n+1e-6)*ad"""


def directed_sql(a: str, b: str, distinct_edges: bool = True) -> str:
    """``o1, o2`` of every hit of an edge of ``a`` on a triangle of ``b``."""
    key = "least((round(sx*1e5), round(sy*1e5), round(sz*1e5)), (round(ex*1e5), round(ey*1e5), round(ez*1e5))), greatest((round(sx*1e5), round(sy*1e5), round(sz*1e5)), (round(ex*1e5), round(ey*1e5), round(ez*1e5)))"
    once = f" QUALIFY row_number() OVER (PARTITION BY object_id, {key} ORDER BY tri_idx, edge_no) = 1" if distinct_edges else ""
    rows = f"(SELECT c.o1, c.o2, e.*, t.px, t.py, t.pz, t.qx, t.qy, t.qz, t.rx, t.ry, t.rz FROM (SELECT a.id AS o1, b.id AS o2 FROM obj_{a} a, obj_{b} b WHERE {MEET}) c JOIN (SELECT * FROM edge_{a}{once}) e ON e.object_id = c.o1 JOIN tri_{b} t ON t.object_id = c.o2)"
    return "SELECT o1, o2 FROM " + _HIT.format(rows=rows)


EDGES_AB = f"{edges_sql('a')}, {edges_sql('b')}"

# --- grids in SQL ---------------------------------------------------------------------


def cells_sql(side: str, res: int = GRID_RES) -> str:
    """A CTE ``cells_<side>`` of grid statistics in the frame [0, u] cubed; cubes have ratio 1."""
    span = lambda x: f"greatest(0, trunc({x}0/(u/{res}e0)))::BIGINT AS l{x}, least({res - 1}, trunc(({x}1-1e-5)/(u/{res}e0)))::BIGINT AS h{x}, trunc((({x}0+{x}1)/2)/(u/{res}e0))::BIGINT AS m{x}"
    g_ = f"(SELECT *, {span('x')}, {span('y')}, {span('z')}, least(1e0, size*size*size/greatest(size*size*size, 1e-9)) AS ratio FROM obj_{side}, {_u()} un2)"
    return f"""{objects_sql(side)}, cells_{side} AS (SELECT cell_idx, sum(c)::BIGINT AS center_count, sum(t)::BIGINT AS touch_count, coalesce(sum(s)/nullif(sum(t),0),0e0) AS avg_size_mean, coalesce(sum(r)/nullif(sum(t),0),0e0) AS vol_ratio FROM (
      SELECT (mz*{res}+my)*{res}+mx AS cell_idx, 1 AS c, 0 AS t, 0e0 AS s, 0e0 AS r FROM {g_} WHERE mx BETWEEN 0 AND {res - 1} AND my BETWEEN 0 AND {res - 1} AND mz BETWEEN 0 AND {res - 1}
      UNION ALL SELECT (iz*{res}+iy)*{res}+ix, 0, 1, size, ratio FROM {g_} q, range({res}) rx(ix), range({res}) ry(iy), range({res}) rz(iz) WHERE ix BETWEEN lx AND hx AND iy BETWEEN ly AND hy AND iz BETWEEN lz AND hz) GROUP BY cell_idx)"""


MEANS = lambda s: f"(SELECT coalesce(sum(avg_size_mean*touch_count)/nullif(sum(touch_count),0),0e0) AS s{s}, coalesce(sum(vol_ratio*touch_count)/nullif(sum(touch_count),0),1e0) AS r{s} FROM cells_{s}) m{s}"
ESTIMATE = f"""{cells_sql('a')}, {cells_sql('b')}, est AS (SELECT raw, greatest(1e0, pow(sa*cbrt(ra)+sb*cbrt(rb),3)/greatest(v,1e-9)) AS alpha FROM
  (SELECT coalesce(sum(ca.touch_count*cb.touch_count*least(1e0, pow(ca.avg_size_mean+cb.avg_size_mean+0.001e0,3)/pow(u/{GRID_RES}e0,3)*pow(sqrt(ca.vol_ratio*cb.vol_ratio),0.8e0))),0e0) AS raw
   FROM cells_a ca JOIN cells_b cb USING (cell_idx), {_u()} un3 WHERE ca.touch_count > 0 AND cb.touch_count > 0),
  {MEANS('a')}, {MEANS('b')}, (SELECT pow(u/{GRID_RES}e0,3) AS v FROM {_u()}))"""


# --- the queries ---------------------------------------------------------------------------

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(sql: str | None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query(f"WITH {objects_sql('a')}, {objects_sql('p', 'pts')} SELECT point_id, polygon_id FROM (SELECT p.id AS point_id, count_if(p.cz > a.z0)%2 AS odd, arg_min(a.id, CASE WHEN p.cz < a.z0 THEN a.z0 - p.cz ELSE a.z1 - p.cz END) AS polygon_id FROM pts p JOIN obj_a a ON a.x0 < p.cx AND p.cx < a.x1 AND a.y0 < p.cy AND p.cy < a.y1 AND p.cz < a.z1 GROUP BY p.id) WHERE odd = 1")
def pim_global(spark, d):
    return joins.point_in_mesh(points(spark, d), mesh(spark, d, "a"))


@query(f"WITH {objects_sql('a')}, {objects_sql('p', 'pts')} SELECT p.id AS point_id, a.id AS polygon_id FROM pts p JOIN obj_a a ON {CENTRE_IN('a')}")
def pim_per_object(spark, d):
    return joins.point_in_mesh(points(spark, d), mesh(spark, d, "a"), "per_object")


@query(QUERIES["pim_global"][1])
def filter_refine(spark, d):
    return joins.filter_refine(points(spark, d), mesh(spark, d, "a"))


_INSIDE = "SELECT p.id AS point_id FROM pts p JOIN obj_a a ON a.x0 < p.cx AND p.cx < a.x1 AND a.y0 < p.cy AND p.cy < a.y1 AND a.z0 < p.cz AND p.cz < a.z1 GROUP BY p.id HAVING count(*) % 2 = 1"


@query(f"WITH {objects_sql('a')}, {objects_sql('p', 'pts')}, bx AS (SELECT min(x0) u0, max(x1) u1, min(y0) v0, max(y1) v1, min(z0) w0, max(z1) w1 FROM obj_a), ins AS ({_INSIDE}) SELECT count(*) AS total, count_if(c) AS candidates, count(*)-count_if(c) AS filtered, count_if(i) AS inside, count(*)-count_if(i) AS outside, 100e0*count_if(i)/count(*) AS inside_percent FROM (SELECT cx BETWEEN u0 AND u1 AND cy BETWEEN v0 AND v1 AND cz BETWEEN w0 AND w1 AS c, id IN (SELECT point_id FROM ins) AS i FROM pts, bx)")
def point_summary(spark, d):
    return joins.point_summary(points(spark, d), mesh(spark, d, "a"))


@query(f"WITH {triangles_sql('a')} SELECT * FROM tri_a")
def triangles_from_objects(spark, d):
    return mesh(spark, d, "a")


@query(f"WITH {objects_sql('a')} SELECT id AS object_id, x0 AS min_x, y0 AS min_y, z0 AS min_z, x1 AS max_x, y1 AS max_y, z1 AS max_z FROM obj_a")
def object_aabb(spark, d):
    return objects.boxes(mesh(spark, d, "a"))


@query(f"WITH {objects_sql('a')} SELECT id AS object_id, round((x1-x0)*(y1-y0)*(z1-z0), 6) AS volume, 1e0 AS vol_ratio, round((x1-x0+y1-y0+z1-z0)/3, 6) AS avg_size, x0 AS first_x, y0 AS first_y, z0 AS first_z FROM obj_a")
def object_features(spark, d):
    rows = objects.features(mesh(spark, d, "a")).select("object_id", "volume", "vol_ratio", "avg_size", "first_x", "first_y", "first_z")
    return rounded(rows, "volume", "vol_ratio", "avg_size")


@query(f"WITH {objects_sql('a')} SELECT id AS object_id, x0 AS x, y0 AS y, z0 AS z FROM obj_a")
def first_vertex(spark, d):
    return objects.first_vertices(mesh(spark, d, "a"))


@query(f"WITH {objects_sql('a')} SELECT id AS object_id, round((x0+x1)/2, 6) AS x, round((y0+y1)/2, 6) AS y, round((z0+z1)/2, 6) AS z FROM obj_a")
def object_centroid(spark, d):
    return rounded(objects.centroids(mesh(spark, d, "a")), *AXES)


@query(f"WITH {objects_sql('a')} SELECT id AS object_id, round(6*size*size, 6) AS area, 12 AS n_triangles FROM obj_a")
def mesh_area(spark, d):
    return rounded(objects.surface(mesh(spark, d, "a")), "area")


@query("SELECT count(DISTINCT p_partkey) AS n_objects FROM part")
def distinct_objects(spark, d):
    return objects.count_objects(mesh(spark, d, "a"))


@query(f"WITH {objects_sql('a')} SELECT min(x0) AS min_x, min(y0) AS min_y, min(z0) AS min_z, max(x1) AS max_x, max(y1) AS max_y, max(z1) AS max_z FROM obj_a")
def dataset_bounds(spark, d):
    return objects.dataset_bounds(mesh(spark, d, "a"))


_KEY = "least((round(sx*1e5)::BIGINT, round(sy*1e5)::BIGINT, round(sz*1e5)::BIGINT), (round(ex*1e5)::BIGINT, round(ey*1e5)::BIGINT, round(ez*1e5)::BIGINT)) AS lo, greatest((round(sx*1e5)::BIGINT, round(sy*1e5)::BIGINT, round(sz*1e5)::BIGINT), (round(ex*1e5)::BIGINT, round(ey*1e5)::BIGINT, round(ez*1e5)::BIGINT)) AS hi"


@query(f"WITH {edges_sql('a')} SELECT arg_min(sx, n) AS sx, arg_min(sy, n) AS sy, arg_min(sz, n) AS sz, arg_min(ex, n) AS ex, arg_min(ey, n) AS ey, arg_min(ez, n) AS ez, count(*) AS n_triangles, count(DISTINCT object_id) AS n_owners, arg_min(object_id, n) AS first_owner FROM (SELECT *, tri_idx*3+edge_no AS n, {_KEY} FROM edge_a) GROUP BY lo, hi")
def unique_edges(spark, d):
    rows = edges.unique_edges(mesh(spark, d, "a"))
    return rows.select("sx", "sy", "sz", "ex", "ey", "ez", "n_triangles", F.size("source_objects").cast("long").alias("n_owners"), F.col("source_objects")[0].alias("first_owner"))


@query(f"WITH {edges_sql('a')}, moved AS (SELECT tri_idx, edge_no, object_id + k*1000000 AS object_id, sx, sy, sz, ex, ey, ez, k FROM edge_a, (VALUES (0), (1)) v(k)) SELECT n_owners, count(*) AS n_edges FROM (SELECT count(DISTINCT object_id) AS n_owners FROM (SELECT *, {_KEY} FROM moved) GROUP BY lo, hi) GROUP BY n_owners")
def edge_multi_owner(spark, d):
    a = mesh(spark, d, "a")
    twin = a.withColumns({"object_id": F.col("object_id") + 1_000_000, "tri_idx": F.col("tri_idx") + 12_000_000})
    return edges.unique_edges(a.unionByName(twin)).groupBy(F.size("source_objects").cast("long").alias("n_owners")).agg(F.count("*").alias("n_edges"))


@query(f"WITH {cells_sql('a')} SELECT cell_idx, center_count, touch_count, round(avg_size_mean, 6) AS avg_size_mean, round(vol_ratio, 6) AS vol_ratio FROM cells_a")
def grid_cells(spark, d):
    return rounded(grid.cell_statistics(mesh(spark, d, "a"), grid.Grid.world(universe(spark, d), GRID_RES)), "avg_size_mean", "vol_ratio")


@query(f"WITH {cells_sql('a')} SELECT round(sa, 6) AS avg_size, round(ra, 6) AS vol_ratio FROM {MEANS('a')}")
def grid_global_means(spark, d):
    return rounded(grid.global_means(grid.cell_statistics(mesh(spark, d, "a"), grid.Grid.world(universe(spark, d), GRID_RES))), "avg_size", "vol_ratio")


@query(f"WITH {cells_sql('a')}, {cells_sql('b')} SELECT cell_idx, a.touch_count AS ta, b.touch_count AS tb FROM cells_a a JOIN cells_b b USING (cell_idx) WHERE a.touch_count > 0 AND b.touch_count > 0")
def grid_cell_join(spark, d):
    frame = grid.Grid.world(universe(spark, d), GRID_RES)
    return grid.joined_cells(*[grid.cell_statistics(mesh(spark, d, s), frame) for s in "ab"]).select("cell_idx", "ta", "tb")


@query(f"WITH {ESTIMATE}, e2 AS (SELECT *, floor(raw/alpha)::BIGINT AS expected FROM est) SELECT round(raw, 4) AS raw, round(alpha, 6) AS alpha, expected, CASE WHEN expected = 0 THEN 16777216 ELSE (SELECT min(1::BIGINT << k) FROM range(63) r(k) WHERE (1::BIGINT << k) >= greatest(1024, least(floor(expected/0.5e0)::BIGINT, 1073741824))) END AS table_pow2, (greatest(1024, least(floor(expected/0.5e0)::BIGINT, 1073741824)) // 2)*2 + 1 AS table_odd, (greatest(1024, least(floor(expected/0.5e0)::BIGINT, 2147483648)) // 2)*2 + 1 AS table_odd_direct FROM e2")
def estimate(spark, d):
    frame = grid.Grid.world(universe(spark, d), GRID_RES)
    rows = grid.estimate(*[grid.cell_statistics(mesh(spark, d, s), frame) for s in "ab"], frame)
    return rows.withColumns({"raw": F.round("raw", 4), "alpha": F.round("alpha", 6)})


@query(f"WITH {ESTIMATE} SELECT round(raw, 4) AS raw, 1e0 AS alpha, floor(raw)::BIGINT AS expected FROM est")
def estimate_raw(spark, d):
    frame = grid.Grid.world(universe(spark, d), GRID_RES)
    rows = grid.estimate(*[grid.cell_statistics(mesh(spark, d, s), frame) for s in "ab"], frame, alpha=False)
    return rows.select(F.round("raw", 4).alias("raw"), "alpha", "expected")


@query(f"WITH {AB} SELECT a.id AS a_object_id, b.id AS b_object_id FROM obj_a a, obj_b b WHERE {MEET}")
def candidate_pairs(spark, d):
    return distance.aabb_intersect_join(mesh(spark, d, "a"), mesh(spark, d, "b"))


@query(f"WITH {AB} SELECT {PAIRS} FROM obj_a a, obj_b b WHERE {CROSS}")
def overlap_both(spark, d):
    return joins.overlap(mesh(spark, d, "a"), mesh(spark, d, "b"))


@query(f"WITH {EDGES_AB} SELECT DISTINCT o1 AS object_id_mesh1, o2 AS object_id_mesh2 FROM ({directed_sql('a', 'b')})")
def overlap_m1_m2(spark, d):
    return joins.overlap(mesh(spark, d, "a"), mesh(spark, d, "b"), "mesh1_to_mesh2")


@query(f"WITH {EDGES_AB} SELECT DISTINCT o2 AS object_id_mesh1, o1 AS object_id_mesh2 FROM ({directed_sql('b', 'a')})")
def overlap_m2_m1(spark, d):
    return joins.overlap(mesh(spark, d, "a"), mesh(spark, d, "b"), "mesh2_to_mesh1")


@query(QUERIES["overlap_both"][1])
def overlap_triangle_edges(spark, d):
    return joins.overlap(mesh(spark, d, "a"), mesh(spark, d, "b"), unique=False)


@query(f"WITH {EDGES_AB} SELECT o1 AS object_id_mesh1, o2 AS object_id_mesh2, count(*) AS hits FROM ({directed_sql('a', 'b')}) GROUP BY o1, o2")
def overlap_hits_per_pair(spark, d):
    return joins.overlap_hits(mesh(spark, d, "a"), mesh(spark, d, "b"), "mesh1_to_mesh2").groupBy(*joins.PAIR).agg(F.count("*").alias("hits"))


@query(f"WITH {AB} SELECT {PAIRS}, (a.id << 32) | b.id AS pair_key FROM obj_a a, obj_b b WHERE {CROSS}")
def overlap_packed(spark, d):
    return joins.packed(joins.overlap(mesh(spark, d, "a"), mesh(spark, d, "b")))


@query(f"WITH {AB} SELECT {PAIRS} FROM obj_a a, obj_b b WHERE ({CROSS}) OR ({_first_in('a', 'b')}) OR ({_first_in('b', 'a')})")
def intersection_both(spark, d):
    return joins.intersection(mesh(spark, d, "a"), mesh(spark, d, "b"))


@query(f"WITH {EDGES_AB} SELECT o1 AS object_id_mesh1, o2 AS object_id_mesh2 FROM ({directed_sql('a', 'b')}) UNION SELECT {PAIRS} FROM obj_a a, obj_b b WHERE {_first_in('a', 'b')}")
def intersection_m1_m2(spark, d):
    return joins.intersection(mesh(spark, d, "a"), mesh(spark, d, "b"), "mesh1_to_mesh2")


@query(f"WITH {EDGES_AB} SELECT o2 AS object_id_mesh1, o1 AS object_id_mesh2 FROM ({directed_sql('b', 'a')}) UNION SELECT {PAIRS} FROM obj_a a, obj_b b WHERE {_first_in('b', 'a')}")
def intersection_m2_m1(spark, d):
    return joins.intersection(mesh(spark, d, "a"), mesh(spark, d, "b"), "mesh2_to_mesh1")


@query(f"WITH {AB} SELECT a.id AS a_object_id, b.id AS b_object_id FROM obj_a a, obj_b b WHERE {_within('b', 'a')}")
def containment(spark, d):
    return joins.containment(mesh(spark, d, "a"), mesh(spark, d, "b"))


@query(f"WITH {AB} SELECT a.id AS a_object_id, b.id AS b_object_id, CASE WHEN {_within('b', 'a')} THEN 'containment' ELSE 'overlap' END AS pair_type FROM obj_a a, obj_b b WHERE ({CROSS}) OR ({_within('b', 'a')})")
def containment_with_overlap(spark, d):
    return joins.containment(mesh(spark, d, "a"), mesh(spark, d, "b"), include_overlap_pairs=True)


def _hits_sql(i: str, o: str) -> str:
    """First vertices of ``i`` below faces of cubes of ``o``: 1 hit inside, 2 below."""
    return f"SELECT i.id AS source_object_id, o.id AS target_object_id, CASE WHEN i.z0 < o.z0 THEN 2 ELSE 1 END AS n FROM obj_{i} i, obj_{o} o WHERE o.x0 < i.x0 AND i.x0 < o.x1 AND o.y0 < i.y0 AND i.y0 < o.y1 AND i.z0 < o.z1"


@query(f"WITH {AB} SELECT 'mesh1_to_mesh2' AS direction, source_object_id, target_object_id, n::BIGINT AS target_ray_hits FROM ({_hits_sql('a', 'b')}) WHERE n = 1 UNION ALL SELECT 'mesh2_to_mesh1', source_object_id, target_object_id, n::BIGINT FROM ({_hits_sql('b', 'a')}) WHERE n = 1")
def pair_hit_tracking(spark, d):
    return joins.pair_hits(mesh(spark, d, "a"), mesh(spark, d, "b"))


def _tracking_sql(name: str, i: str, o: str) -> str:
    return f"SELECT '{name}' AS direction, s.id AS source_object_id, coalesce(sum(n),0)::BIGINT+1 AS iterations, count(DISTINCT target_object_id) AS candidate_count, 0::BIGINT AS candidate_overflow_events FROM obj_{i} s LEFT JOIN ({_hits_sql(i, o)}) h ON h.source_object_id = s.id GROUP BY s.id"


_TRACKING = f"WITH {AB}, track AS ({_tracking_sql('mesh1_to_mesh2', 'a', 'b')} UNION ALL {_tracking_sql('mesh2_to_mesh1', 'b', 'a')})"


@query(f"{_TRACKING} SELECT * FROM track")
def containment_tracking(spark, d):
    return joins.containment_tracking(mesh(spark, d, "a"), mesh(spark, d, "b"))


@query(f"{_TRACKING} SELECT count(*) AS sources, sum(iterations)::BIGINT AS iterations_total, max(iterations) AS iterations_max, (sum(iterations)*1000 // count(*))::BIGINT AS iterations_avg_x1000, sum(candidate_count)::BIGINT AS candidates_total, max(candidate_count) AS candidates_max, (sum(candidate_count)*1000 // count(*))::BIGINT AS candidates_avg_x1000, sum(candidate_overflow_events)::BIGINT AS overflow_total FROM track")
def profiling_counters(spark, d):
    return joins.profile(joins.containment_tracking(mesh(spark, d, "a"), mesh(spark, d, "b")))


_GAP = " + ".join(f"pow(greatest(a.{x}0-b.{x}1, b.{x}0-a.{x}1, 0e0), 2)" for x in AXES)
_CENTRE = " + ".join(f"pow((a.{x}0+a.{x}1)/2-(b.{x}0+b.{x}1)/2, 2)" for x in AXES)
CB = f"{objects_sql('c', 'obj_a')}, {objects_sql('b')}"


@query(f"WITH {CB} SELECT a.id AS a_object_id, b.id AS b_object_id, round(sqrt({_GAP}), 6) AS mindist FROM obj_a a, obj_b b WHERE sqrt({_GAP}) <= 2e0")
def within_distance_join(spark, d):
    return rounded(distance.within_distance_join(mesh(spark, d, "c"), mesh(spark, d, "b"), 2.0), "mindist")


@query(f"WITH {CB} SELECT a.id AS a_object_id, b.id AS b_object_id, row_number() OVER (PARTITION BY a.id ORDER BY sqrt({_GAP}), sqrt({_CENTRE}), b.id)::INT AS rank, round(sqrt({_GAP}), 6) AS mindist, round(sqrt({_CENTRE}), 6) AS centredist FROM obj_a a, obj_b b QUALIFY rank <= 5")
def knn_join(spark, d):
    return rounded(distance.knn_join(mesh(spark, d, "c"), mesh(spark, d, "b"), 5), "mindist", "centredist")


@query(f"WITH {CB} SELECT a.id AS a_object_id, b.id AS b_object_id, CASE WHEN {CROSS} THEN 0e0 WHEN {MEET} THEN round(least({', '.join(f'abs(a.{x}0-b.{x}0), abs(a.{x}1-b.{x}1)' for x in AXES)}), 6) ELSE round(sqrt({_GAP}), 6) END AS distance FROM obj_a a, obj_b b WHERE sqrt({_GAP}) <= 1e0")
def mesh_distance(spark, d):
    a, b = mesh(spark, d, "c"), mesh(spark, d, "b")
    return rounded(distance.mesh_distance(distance.within_distance_join(a, b, 1.0), a, b), "distance")


@query(f"WITH {CB} SELECT a.id AS a_object_id, b.id AS b_object_id, {CROSS} AS intersects FROM obj_a a, obj_b b WHERE {MEET}")
def mesh_intersects(spark, d):
    a, b = mesh(spark, d, "c"), mesh(spark, d, "b")
    return distance.mesh_intersects(distance.aabb_intersect_join(a, b), a, b)


@query(f"WITH {objects_sql('a')} SELECT id AS object_id, round(x0+1.5e0, 6) AS min_x, round(y0-2e0, 6) AS min_y, round(z1+0.25e0, 6) AS max_z FROM obj_a")
def translate_mesh(spark, d):
    return rounded(objects.boxes(objects.translate(mesh(spark, d, "a"), (1.5, -2.0, 0.25))).select("object_id", "min_x", "min_y", "max_z"), "min_x", "min_y", "max_z")


@query("SELECT count(*) AS n_objects, count(*) AS n_rigid, count(*) AS n_in_reach FROM part")
def shuffle_translate(spark, d):
    a = mesh(spark, d, "a")
    before, after = objects.boxes(a), objects.boxes(objects.shuffle_objects(a, seed=7))
    both = before.select("object_id", *[F.col(c).alias("o" + c) for c in BOX]).join(after, "object_id")
    moved = [F.col(f"min_{x}") - F.col(f"omin_{x}") for x in AXES]
    rigid = sum((F.abs((F.col(f"max_{x}") - F.col(f"omax_{x}")) - m) for x, m in zip(AXES, moved)), F.lit(0.0)) < 1e-9
    return both.agg(F.count("*").alias("n_objects"), F.count_if(rigid).alias("n_rigid"), F.count_if(F.greatest(*[F.abs(m) for m in moved]) <= 15).alias("n_in_reach"))


@query(f"WITH {objects_sql('a')} SELECT 12 AS n_triangles, min(x0) AS min_x, max(z1) AS max_z FROM obj_a")
def box_mesh(spark, d):
    box = objects.dataset_bounds(mesh(spark, d, "a")).withColumn("object_id", F.lit(0).cast("long"))
    return generate.box_triangles(box).agg(F.count("*").alias("n_triangles"), F.min("px").alias("min_x"), F.max("rz").alias("max_z"))


@query(f"WITH {objects_sql('a')} SELECT round((max(x1)-min(x0))*(max(y1)-min(y0))*(max(z1)-min(z0)), 4) AS volume, round(sqrt(pow(max(x1)-min(x0),2)+pow(max(y1)-min(y0),2)+pow(max(z1)-min(z0),2)), 6) AS diagonal FROM obj_a")
def box_measures(spark, d):
    return objects.dataset_bounds(mesh(spark, d, "a")).select(F.round(g.box_volume(), 4).alias("volume"), F.round(g.box_diagonal(), 6).alias("diagonal"))


@query(f"WITH {objects_sql('a')}, {objects_sql('p', 'pts')} SELECT p.id AS point_id FROM pts p, (SELECT min(x0) u0, max(x1) u1, min(y0) v0, max(y1) v1, min(z0) w0, max(z1) w1 FROM obj_a) WHERE cx BETWEEN u0 AND u1 AND cy BETWEEN v0 AND v1 AND cz BETWEEN w0 AND w1")
def points_in_bounds(spark, d):
    return joins.points_in_bounds(points(spark, d), mesh(spark, d, "a")).select("point_id")


@query(f"WITH {AB} SELECT round(least(1e0, 2*s/u)*least(1e0, 2*s/u)*least(1e0, 2*s/u), 9) AS theory, round(n/(na*nb*1e0), 9) AS measured FROM (SELECT avg(size) AS s FROM (SELECT size FROM obj_a UNION ALL SELECT size FROM obj_b)), {_u()} un3, (SELECT count(*) AS n FROM obj_a a, obj_b b WHERE {MEET}), (SELECT count(*) AS na FROM obj_a), (SELECT count(*) AS nb FROM obj_b)")
def cube_selectivity_theory(spark, d):
    tune(spark)
    a, b = (placed(spark, d, *SIDES[s]) for s in "ab")
    mean = a.select("size").unionByName(b.select("size")).agg(F.avg("size").alias("s"))
    chance = F.least(F.lit(1.0), F.lit(2.0) * F.col("s") / F.lit(universe(spark, d)))
    met = candidate_pairs(spark, d).agg(F.count("*").alias("n"))
    sizes = a.agg(F.count("*").alias("na")).crossJoin(b.agg(F.count("*").alias("nb")))  # one row each
    return mean.crossJoin(met).crossJoin(sizes).select(F.round(chance * chance * chance, 9).alias("theory"), F.round(F.col("n") / (F.col("na") * F.col("nb")).cast("double"), 9).alias("measured"))


@query(f"WITH {objects_sql('a')} SELECT id AS object_id, 8 AS n_vertices FROM obj_a")
def vertex_index(spark, d):
    return objects.indexed_vertices(mesh(spark, d, "a")).groupBy("object_id").agg((F.max("vertex") + 1).cast("long").alias("n_vertices"))


@query(f"WITH {objects_sql('b')} SELECT id AS object_id, (sum(12) OVER (ORDER BY id) - 12)::BIGINT AS \"offset\" FROM obj_b")
def exclusive_scan(spark, d):
    return joins.running_offsets(objects.surface(mesh(spark, d, "b")), "n_triangles", "object_id").select("object_id", "offset")


from . import more  # noqa: E402, F401 - adds its queries


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}
