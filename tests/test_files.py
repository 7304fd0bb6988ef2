"""Readers, writers, triangulation and the engine's calls, by round trips."""

import json

import pytest
from pyspark.sql import functions as F

from meshweave import engine, metrics, sinks
from meshweave.functions.triangulate import FAILED, REPAIRED, STANDARD, area, triangulate
from meshweave.operators import edges, joins, objects
from meshweave.sources import readers

from .test_spatial import A, B, cubes, pairs, points


def rows(df):
    return sorted(tuple(r)[1:] for r in df.collect())


def test_obj(spark, tmp_path):
    a = cubes(spark, *A)
    sinks.write_obj(a, str(tmp_path / "o"))
    text = "\n".join(p.read_text() for p in sorted((tmp_path / "o").glob("part*")))
    path = tmp_path / "all.obj"
    path.write_text(text + "\no quad\nv 0 0 0\nv 1 0 0\nv 1 1 0\nv 0 1 0\nf 1 2 3 4\no empty\n")
    got = readers.read_mesh(spark, str(path))
    assert got.count() == 48 and got.select("object_id").distinct().count() == 4
    assert sorted(map(str, objects.boxes(got).drop("object_id").collect())) == sorted(map(str, objects.boxes(a).drop("object_id").collect()))
    with pytest.raises(ValueError):
        readers.read_obj(spark, "x.OBJ")


def test_binary(spark, tmp_path):
    a = cubes(spark, *A)
    path = tmp_path / "a.pre"
    path.write_bytes(sinks.binary_bytes(a))
    assert rows(readers.read_mesh(spark, str(path))) == rows(a)
    assert readers.read_binary_edges(spark, str(path)).count() == edges.unique_edges(a).count()
    with pytest.raises(ValueError):
        readers.parse_binary(b"\0" * 100)


def test_points_and_polygons(spark, tmp_path):
    (tmp_path / "p.txt").write_text("# c\nPOINT Z (1.0 2.0 3.0)\n\n  -1 0 2\nPOINT (5 6)\nnonsense\n")
    assert [tuple(r) for r in readers.read_points(spark, str(tmp_path / "p.txt")).orderBy("point_id").collect()] == [(0, 1.0, 2.0, 3.0), (1, -1.0, 0.0, 2.0), (2, 5.0, 6.0, 0.0)]
    assert readers.read_points(spark, None).count() == 3
    (tmp_path / "w.wkt").write_text("POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 1 2, 2 2, 2 1, 1 1))\nMULTIPOLYGON (((10 0, 11 0, 11 1, 10 0)), ((20 0, 21 0, 21 1, 20 1, 20 0)))\nPOLYGON ((0 0, 1 1))\nPOLYGON ((a b, c))\nother\n")
    made = readers.triangulated(readers.read_polygons(spark, str(tmp_path / "w.wkt")))
    assert {r["method"]: r["n"] for r in readers.triangulation_statistics(made).collect()} == {STANDARD: 3, FAILED: 1}
    mesh = readers.read_mesh(spark, str(tmp_path / "w.wkt"))
    assert {r["object_id"]: round(r["area"], 9) for r in objects.surface(mesh).collect()} == {0: 15.0, 1: 0.5, 2: 1.0}
    assert pairs(joins.point_in_mesh(points(spark, (0.5, 0.4, -1), (1.5, 1.6, -1), (20.5, 0.25, -1)), mesh)) == {(0, 0), (2, 2)}


def test_triangulate():
    size = lambda found: sum(abs(area(list(t))) for t in found)
    assert triangulate([(0, 0), (2, 0), (2, 1), (1, 1), (1, 2), (0, 2)], [])[0] == STANDARD
    assert size(triangulate([(0, 0), (2, 0), (2, 1), (1, 1), (1, 2), (0, 2)], [])[1]) == pytest.approx(3)
    code, found = triangulate([(0, 0), (2, 2), (2, 0), (0, 2)], [])
    assert code == REPAIRED and size(found) == pytest.approx(2)
    assert triangulate([(0, 0), (1, 1)], []) == (FAILED, [])


def test_other_formats(spark, tmp_path):
    a = cubes(spark, *A)
    (tmp_path / "g.txt").write_text("vertices: 0 0 0 1 0 0 0 1 0\nnormals: 0 0 1\nindices: 0 1 2\ntriangleToObject: 7\n")
    assert tuple(readers.read_geometry_text(spark, str(tmp_path / "g.txt")).first())[:2] == (0, 7)
    sinks.off_lines(a).select("value").coalesce(1).write.text(str(tmp_path / "m.off"))
    assert sorted(map(str, objects.boxes(readers.read_off(spark, str(tmp_path / "m.off"))).drop("object_id").collect())) == sorted(map(str, objects.boxes(a).drop("object_id").collect()))
    (tmp_path / "b.json").write_text('{"min": [0, 1, 2], "max": [3, 4, 5]}')
    assert tuple(readers.read_bounds(spark, str(tmp_path / "b.json")).first()) == (0.0, 1.0, 2.0, 3.0, 4.0, 5.0)
    assert sinks.surfaces(a).first()["wkt"].startswith("POLYHEDRALSURFACE Z (((")
    assert sinks.insert_statements(a, "t").first()["value"].startswith("INSERT INTO t VALUES (")
    with pytest.raises(NotImplementedError):
        readers.read_mesh(spark, "x.dt")
    assert readers.tasks("a,b", "p") == [("a", "p"), ("b", "p")]


def test_engine(spark, tmp_path):
    a, b = cubes(spark, *A), cubes(spark, *B)
    for name, m in (("a", a), ("b", b)):
        m.write.parquet(str(tmp_path / f"{name}.parquet"))
    da, db = (engine.preprocess(spark, str(tmp_path / f"{n}.parquet"), resolution=8, world=100) for n in "ab")
    assert pairs(engine.overlap(da, db)) == {(1, 1)} and pairs(engine.containment(da, db)) == {(0, 0)}
    assert engine.estimate(da, db).count() == 1 and da.objects.count() == 4
    sinks.write_csv(engine.intersection(da, db), str(tmp_path / "out"), "intersection", ordered=True)
    assert spark.read.csv(str(tmp_path / "out"), header=True).columns == ["a_object_id", "b_object_id"]
    timer = metrics.Timer()
    with timer.phase("Query"):
        pass
    assert "query_0" in json.loads(timer.json())["phases"] and metrics.repeated(lambda: 1, 2)["min"] >= 0
    (tmp_path / "p.txt").write_text("1 1 1\n")
    with pytest.warns(UserWarning):
        done = engine.point_tasks(spark, f"{tmp_path}/a.parquet,{tmp_path}/none.parquet", f"{tmp_path}/p.txt")
    assert [pairs(x) for x in done.values()] == [{(0, 0)}]


def test_stream(spark, tmp_path):
    from meshweave.streaming.points import stream_point_in_mesh

    asked = points(spark, (1, 1, 1), (50, 50, 50))
    asked.write.parquet(str(tmp_path / "in"))
    got = []
    stream = spark.readStream.schema(asked.schema).parquet(str(tmp_path / "in"))
    query = stream_point_in_mesh(stream, cubes(spark, *A), lambda df, n: got.extend(df.collect()), str(tmp_path / "ck"))
    query.processAllAvailable()
    query.stop()
    assert [tuple(r) for r in got] == [(0, 0)]


def test_registry():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 40
    assert F is not None
