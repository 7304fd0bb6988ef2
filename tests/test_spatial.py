"""Geometry, joins and features on hand-made meshes, and relations between results."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshweave import generate
from meshweave.functions import geometry as g
from meshweave.operators import candidates, distance, edges, grid, joins, objects
from meshweave.schema import TRIANGLE, TRIANGLE_DDL


def cubes(spark, *rows):
    return generate.cube_triangles(spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)], "object_id long, cx double, cy double, cz double, size double"))


def points(spark, *rows):
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)], "point_id long, x double, y double, z double")


def prism(spark):
    """A concave L-shaped prism of height 1: the square [0, 2] squared without [1, 2] squared."""
    ring = [(0, 0), (2, 0), (2, 1), (1, 1), (1, 2), (0, 2)]
    cap = [(0, 1, 3), (1, 2, 3), (0, 3, 5), (3, 4, 5)]
    faces = [[(*ring[i], 0) for i in t[::-1]] for t in cap] + [[(*ring[i], 1) for i in t] for t in cap]
    for a, b in zip(ring, ring[1:] + ring[:1]):
        faces += [[(*a, 0), (*b, 0), (*b, 1)], [(*a, 0), (*b, 1), (*a, 1)]]
    return spark.createDataFrame([(n, 0, *[float(x) for v in f for x in v]) for n, f in enumerate(faces)], TRIANGLE_DDL)


def pairs(df):
    return {tuple(r) for r in df.collect()}


A = [(0, 0, 0, 10), (20, 0, 0, 2), (40, 0, 0, 4), (60, 0, 0, 1)]
B = [(2.1, 2.2, 2.3, 3), (21.1, 1.2, 1.3, 2), (38.9, -1.2, -1.1, 9), (80, 0, 0, 1)]


def test_joins_on_cubes(spark):
    a, b = cubes(spark, *A), cubes(spark, *B)
    assert pairs(joins.overlap(a, b)) == {(1, 1)} == pairs(joins.overlap(a, b, unique=False))
    assert pairs(joins.containment(a, b)) == {(0, 0)}
    assert pairs(joins.containment(a, b, include_overlap_pairs=True)) == {(0, 0, "containment"), (1, 1, "overlap")}
    assert pairs(joins.intersection(a, b)) == {(0, 0), (1, 1), (2, 2)}
    assert pairs(joins.intersection(b, a)) == {(0, 0), (1, 1), (2, 2)}
    both = pairs(joins.overlap(a, b, "mesh1_to_mesh2")) | pairs(joins.overlap(a, b, "mesh2_to_mesh1"))
    assert both == {(1, 1)}
    moved = [objects.translate(m, (100.5, -3.25, 7.0)) for m in (a, b)]
    assert pairs(joins.intersection(*moved)) == {(0, 0), (1, 1), (2, 2)}
    track = {(r["direction"], r["source_object_id"]): r for r in joins.containment_tracking(a, b).collect()}
    assert len(track) == 8 and track["mesh2_to_mesh1", 0]["iterations"] == 2 and track["mesh1_to_mesh2", 3]["candidate_count"] == 0
    assert ("mesh2_to_mesh1", 0, 0, 1) in pairs(joins.pair_hits(a, b))
    with pytest.raises(ValueError):
        joins.overlap(a, b, "sideways")


def test_points(spark):
    nested = cubes(spark, (0, 0, 0, 10), (2, 2, 2, 4))
    asked = points(spark, (1, 1, 1), (3, 3, 3), (5, 5, 20), (5, 5, -5), (50, 5, 5), (5, 4, 0.5))
    assert pairs(joins.point_in_mesh(asked, nested)) == {(0, 0), (5, 1)}  # the nearest crossing names the object
    assert pairs(joins.point_in_mesh(asked, nested, "per_object")) == {(0, 0), (1, 0), (1, 1), (5, 0)}
    assert pairs(joins.filter_refine(asked, nested)) == {(0, 0), (5, 1)}
    row = joins.point_summary(asked, nested).first()
    assert (row["total"], row["candidates"], row["filtered"], row["inside"], row["outside"]) == (6, 3, 3, 2, 4)
    notch = points(spark, (1.5, 1.5, 0.5), (0.5, 1.5, 0.5), (1.0, 0.5, 0.5), (0.5, 0.5, 0.5), (1.5, 0.5, 2))
    assert pairs(joins.point_in_mesh(notch, prism(spark))) == {(1, 0), (2, 0), (3, 0)}
    flat = generate.box_triangles(spark.createDataFrame([(0, 0.0, 0.0, 0.0, 2.0, 2.0, 0.0)], "object_id long, min_x double, min_y double, min_z double, max_x double, max_y double, max_z double")).where("tri_idx < 2")
    assert pairs(joins.point_in_mesh(points(spark, (1, 0.5, -1), (1, 0.5, 0), (1, 1, -1)), flat)) == {(0, 0), (2, 0)}
    assert joins.point_in_mesh(asked.limit(0), nested).count() == 0 == joins.point_in_mesh(asked, nested.limit(0)).count()


@pytest.mark.parametrize("s, e, hit", [
    ((0.2, 0.2, -1), (0.2, 0.2, 1), True), ((0.9, 0.9, -1), (0.9, 0.9, 1), False), ((0.2, 0.2, 0), (0.2, 0.2, 1), False),
    ((0.2, 0.2, -1), (0.2, 0.2, 0), True), ((0.2, 0.2, 0), (0.4, 0.2, 0), False), ((0.2, 0.2, 0.5), (0.2, 0.2, 0.5), False), ((0.2, 0.2, 1), (0.2, 0.2, -1), True),
])
def test_segment_hits_triangle(spark, s, e, hit):
    lit = lambda v: tuple(F.lit(float(x)) for x in v)
    tri = [lit(v) for v in ((0, 0, 0), (1, 0, 0), (0, 1, 0))]
    assert spark.range(1).select(g.segment_hits_triangle(lit(s), lit(e), *tri).alias("h")).first()["h"] is hit


def test_features_and_edges(spark):
    a = cubes(spark, (1, 2, 3, 2))
    row = objects.features(a).first()
    assert (row["volume"], row["vol_ratio"], row["avg_size"], row["first_x"]) == pytest.approx((8, 1, 2, 1))
    assert objects.features(prism(spark)).first()["vol_ratio"] == pytest.approx(0.75)
    assert edges.unique_edges(a).count() == 18 and objects.open_edges(edges.unique_edges(a)).count() == 0
    two = cubes(spark, (0, 0, 0, 1), (0, 0, 0, 1))
    assert {tuple(r["source_objects"]) for r in edges.unique_edges(two).collect()} == {(0, 1)}
    numbered = edges.numbered(two.repartition(5), "tri_idx", name="n").collect()
    assert sorted((r["n"], r["tri_idx"]) for r in numbered) == [(i, i) for i in range(24)]
    assert objects.surface(a).first()["area"] == pytest.approx(24)
    assert objects.boxes(objects.resize(a, 0.5)).first()["min_x"] == pytest.approx(1.5)


def test_box_join_equals_nested_loop(spark):
    rng = np.random.default_rng(1)
    def boxes(n, big):
        low = rng.uniform(-20, 20, (n, 3))
        return [(i, *map(float, low[i]), *map(float, low[i] + rng.uniform(0.1, big if i % 10 else 30, 3))) for i in range(n)]
    cols = "object_id long, min_x double, min_y double, min_z double, max_x double, max_y double, max_z double"
    x, y = boxes(80, 2), boxes(90, 5)
    meets = lambda p, q, r=0.0: all(p[1 + k] - r < q[4 + k] and q[1 + k] - r < p[4 + k] for k in range(3))
    a, b = spark.createDataFrame(x, cols), spark.createDataFrame(y, cols)
    got = candidates.candidate_pairs(a, b).collect()
    assert sorted(map(tuple, got)) == sorted((p[0], q[0]) for p in x for q in y if meets(p, q))
    gap = lambda p, q: sum(max(p[1 + k] - q[4 + k], q[1 + k] - p[4 + k], 0) ** 2 for k in range(3)) ** 0.5
    near = {(r[0], r[1]) for r in distance.within_distance_join(a, b, 1.5).collect()}
    assert near == {(p[0], q[0]) for p in x for q in y if gap(p, q) <= 1.5}
    knn = {}
    for r in distance.knn_join(a, b, 3).collect():
        knn.setdefault(r["a_object_id"], []).append((r["rank"], round(r["mindist"], 9)))
    for p in x:
        assert [d for _, d in sorted(knn[p[0]])] == [round(d, 9) for d in sorted(gap(p, q) for q in y)[:3]]


def test_knn_ends_without_usable_boxes(spark):
    cols = "object_id long, min_x double, min_y double, min_z double, max_x double, max_y double, max_z double"
    box = lambda i, x: (i, x, x, x, x + 1.0, x + 1.0, x + 1.0)
    none, nan = (8, *[None] * 6), (9, *[float("nan")] * 6)
    a, b = (spark.createDataFrame(rows, cols) for rows in ([box(0, 0.0), none, nan], [box(0, 1e6), none, nan]))
    assert [(r["a_object_id"], r["b_object_id"]) for r in distance.knn_join(a, b, 2).collect()] == [(0, 0)]
    assert distance.knn_join(a, b.where("object_id > 0"), 2).count() == 0 == distance.knn_join(a.where("object_id > 0"), b, 1).count()
    assert [r["b_object_id"] for r in distance.knn_join(a.unionAll(b.where("object_id = 0").withColumn("object_id", F.lit(1).cast("long"))), a, 3, same=True).collect()] == [0]


def test_large_meshes_meet_in_cells(spark, monkeypatch):
    """Spheres of many faces: in cells and all against all alike."""
    placed = lambda *rows: spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)], "object_id long, cx double, cy double, cz double, size double")
    a = generate.instances(generate.sphere_template(spark, 12, 16), placed((0, 0, 0, 4), (10, 0, 0, 1)))
    b = generate.instances(generate.sphere_template(spark, 10, 14), placed((1.1, 0.2, 0.3, 4), (1.5, 1.4, 1.3, 1), (10.3, 0.1, 0.2, 2))).unionByName(cubes(spark, (0.1, 0.2, 0.3, 2.5)).withColumns({"object_id": F.lit(7).cast("long"), "tri_idx": F.col("tri_idx") + 10_000}))
    found = []
    for limit in (10**9, 0):
        monkeypatch.setattr(joins, "PAIRWISE", limit)
        found.append(sorted(map(tuple, joins.overlap_hits(a, b).collect())))
    assert found[0] == found[1] and len(found[0]) > 50
    assert {(0, 0), (0, 7), (1, 2)} == set(found[0])


def test_grid(spark):
    a = cubes(spark, (0.5, 0.5, 0.5, 1), (3.5, 3.5, 3.5, 3))
    frame = grid.Grid.world(4, 4)
    cells = {r["cell_idx"]: r for r in grid.cell_statistics(a, frame).collect()}
    assert cells[0]["touch_count"] == 1 and sum(r["center_count"] for r in cells.values()) == 1 and len(cells) == 9
    stats = grid.cell_statistics(a, frame)
    row = grid.estimate(stats, stats, frame).first()
    assert row["raw"] > 0 and row["alpha"] >= 1 and row["expected"] == 0 and row["table_pow2"] == 1 << 24 and row["table_odd"] == 1025
    with pytest.raises(ValueError):
        grid.estimate(stats, stats, frame, grid.Grid.world(5, 4))


def test_distances(spark):
    a, b = cubes(spark, (0, 0, 0, 1)), cubes(spark, (3, 0.1, 0.2, 1), (0.5, 0.4, 0.3, 1), (2, 2, 2, 1))
    every = candidates.box_join(objects.boxes(a), objects.boxes(b), reach=10.0).select("a_object_id", "b_object_id")
    got = {r["b_object_id"]: r["distance"] for r in distance.mesh_distance(every, a, b).collect()}
    assert got == pytest.approx({0: 2.0, 1: 0.0, 2: 3**0.5})
    assert {r["b_object_id"]: r["intersects"] for r in distance.mesh_intersects(every, a, b).collect()} == {0: False, 1: True, 2: False}
    assert distance.hausdorff(a, a).first()["max_distance"] == pytest.approx(0, abs=1e-9)
    assert distance.skeleton(a, 2).count() == 2 and distance.voxels(a, distance.skeleton(a, 2)).count() == 12


def test_small_functions(spark):
    row = spark.createDataFrame([(1,), (2,), (3,), (1024,), (1025,)], "n long").select(g.next_power_of_two(F.col("n")).alias("p")).collect()
    assert [r["p"] for r in row] == [1, 2, 4, 1024, 2048]
    key = spark.createDataFrame([(7, 9)], "object_id_mesh1 long, object_id_mesh2 long").select(g.pack_pair(F.col("object_id_mesh1"), F.col("object_id_mesh2")).alias("k"))
    assert key.select(*g.unpack_pair(F.col("k"))).first() == (7, 9)
    assert generate.cube_selectivity((10, 10, 10), 1) == pytest.approx(0.008) and generate.cube_extent(2.5, 0.125) == pytest.approx(10)
    shifted = objects.shuffle_objects(cubes(spark, *A), 5)
    assert shifted.collect() == objects.shuffle_objects(cubes(spark, *A), 5).collect()
    sphere = generate.sphere_template(spark)
    placed = generate.instances(sphere, generate.cubes(spark, 3, seed=1))
    assert placed.count() == 3 * sphere.count() and objects.open_edges(edges.unique_edges(placed)).count() == 0
    assert generate.diagonal_points(spark, 10, (0, 0, 0), (1, 1, 1), clip=True).where("x between 0 and 1").count() == 10
    assert len(TRIANGLE) == 9
