"""What only large tables show, on small ones made to look alike."""

import numpy as np
import pytest

from meshweave import generate
from meshweave.operators import joins
from meshweave.plans import queries as plans

from .test_spatial import cubes, pairs, points


@pytest.fixture
def keys(spark, tmp_path):
    """Writes tables of a few bytes of keys, from a first key on; gives their folder."""
    def write(n: int = 200, first: int = 0) -> str:
        for table, key in (("part", "p_partkey"), ("customer", "c_custkey"), ("supplier", "s_suppkey"), ("orders", "o_orderkey")):
            spark.range(first, first + n).withColumnRenamed("id", key).write.parquet(str(tmp_path / f"{table}.parquet"))
        return str(tmp_path)

    return write


@pytest.mark.parametrize("name", ["containment", "overlap_both", "overlap_triangle_edges", "hausdorff", "intersection_both", "profiling_counters"])
def test_meshes_are_not_broadcast_by_the_size_of_their_files(spark, keys, name):
    """The plan before any size is measured: a mesh of a few bytes of keys is no small table."""
    plan = plans.queries()[name](spark, keys())._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan and "BroadcastHashJoin" not in plan and "BroadcastNestedLoopJoin" not in plan


def as_sql_has_it(spark, folder: str, name: str) -> None:
    """Compares a query with its SQL, run by DuckDB on keys too wide to overflow."""
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for table, key in (("part", "p_partkey"), ("customer", "c_custkey"), ("supplier", "s_suppkey"), ("orders", "o_orderkey")):
        con.execute(f"CREATE VIEW {table} AS SELECT {key}::HUGEINT AS {key} FROM '{folder}/{table}.parquet/*.parquet'")
    got = plans.queries()[name](spark, folder)
    rows = con.sql(plans.oracle_sql()[name])
    assert list(rows.columns) == got.columns
    plain = lambda row: tuple(float(x) if isinstance(x, (int, float)) else x for x in row)
    assert sorted(map(plain, got.collect())) == sorted(map(plain, rows.fetchall()))


@pytest.mark.parametrize("name", ["point_file", "point_summary", "points_in_bounds", "box_measures", "barycentres", "box_mesh", "candidate_pairs", "cube_selectivity_theory", "csv_pairs", "dataset_bounds", "distinct_objects", "edge_multi_owner", "sphere_overlap", "containment_with_overlap"])
def test_keys_whose_squares_overflow(spark, keys, name):
    as_sql_has_it(spark, keys(40, 1_199_000), name)


def test_vertices_close_below_a_face(spark):
    """1e-5 below the bottom, or the top, is below it."""
    a, b = cubes(spark, (0, 0, 0, 10)), cubes(spark, (2, 2, -1e-5, 1), (4, 4, 10 - 1e-5, 1))
    track = {(r["direction"], r["source_object_id"]): (r["iterations"], r["candidate_count"]) for r in joins.containment_tracking(a, b).collect()}
    assert track["mesh2_to_mesh1", 0] == (3, 1) and track["mesh2_to_mesh1", 1] == (2, 1)
    assert pairs(joins.pair_hits(a, b)) == {("mesh2_to_mesh1", 1, 0, 1)}


def test_points_meet_only_objects_around_them(spark):
    """A tower of cubes is not met by points under it, whole or open; spheres of many faces meet in cells."""
    tower = cubes(spark, *[(0, 0, 3 * i, 2) for i in range(30)])
    low = points(spark, (0.7, 0.9, 1), (0.7, 0.9, -5))
    assert joins.near_hits(low, tower).count() == 1 and joins.point_hits(low, tower).count() == 119
    rng = np.random.default_rng(2)
    placed = spark.createDataFrame([(100 + i, *map(float, rng.uniform(0, 6, 3)), float(s)) for i, s in enumerate((1, 2, 4, 8))], "object_id long, cx double, cy double, cz double, size double")
    balls = generate.instances(generate.sphere_template(spark, 10, 14), placed)
    mesh = balls.unionByName(cubes(spark, *[(*rng.uniform(0, 6, 3), rng.uniform(0.5, 6)) for _ in range(12)])).where("object_id <> 3 OR tri_idx % 12 <> 4 AND tri_idx % 12 <> 1")  # one cube is open
    asked = points(spark, *rng.uniform(-2, 9, (400, 3)))
    every = {}
    for r in joins.point_hits(asked, mesh).collect():
        every.setdefault(r["point_id"], []).append((r["t"], r["tri_idx"], r["object_id"]))
    odd = {(p, o) for p, hits in every.items() for o in {h[2] for h in hits} if sum(h[2] == o for h in hits) % 2}
    assert pairs(joins.point_in_mesh(asked, mesh, "per_object")) == odd and len(odd) > 50 and any(o == 3 for _, o in odd)
    assert pairs(joins.point_in_mesh(asked, mesh)) == {(p, min(hits)[2]) for p, hits in every.items() if len(hits) % 2}
