"""Readers of mesh, polygon and point files, through Spark's own file readers.

Files whose numbering is global (OBJ, binary) are one task each; text formats of one
record per line are split like any text.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.triangulate import FAILED, triangulate
from ..operators.edges import numbered
from ..schema import TRIANGLE, TRIANGLE_DDL

#: Header of the binary geometry format (fixed values).
MAGIC, VERSION = 0x52334442, 2
HEADER = struct.Struct("<II6QBB6x")


def _frame(rows: list) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["tri_idx", "object_id", *TRIANGLE])


# --- OBJ ------------------------------------------------------------------------


def parse_obj(text: str) -> list[tuple]:
    """Triangles of an OBJ text. A shape with no face, or a face that is no triangle, is skipped whole; ids are dense over the others."""
    vertices: list[tuple[float, ...]] = []
    shapes: list[list[list[int]]] = [[]]
    for line in text.splitlines():
        parts = line.split()
        if not parts or parts[0].startswith("#"):
            continue
        if parts[0] == "v":
            vertices.append(tuple(map(float, parts[1:4])))
        elif parts[0] in ("o", "g"):
            shapes.append([])
        elif parts[0] == "f":
            at = [int(p.split("/")[0]) for p in parts[1:]]
            shapes[-1].append([i - 1 if i > 0 else len(vertices) + i for i in at])
    out, n = [], 0
    for faces in shapes:
        if not faces or any(len(f) != 3 for f in faces):
            continue
        for face in faces:
            out.append((len(out), n, *[c for i in face for c in vertices[i]]))
        n += 1
    return out


def read_obj(spark: SparkSession, path: str) -> DataFrame:
    """Triangles of one ``.obj`` file."""
    if not path.endswith(".obj"):
        raise ValueError(f"{path} does not end in .obj")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for text in frame["value"]:
                yield _frame(parse_obj(text))

    return spark.read.text(path, wholetext=True).mapInPandas(run, TRIANGLE_DDL)


# --- polygons --------------------------------------------------------------------


def read_polygons(spark: SparkSession, path: str) -> DataFrame:
    """``polygon_id, rings``: each POLYGON, and each part of a MULTIPOLYGON, with its rings as lists of [x, y].

    Ids are dense in file order over all parts; lines that do not parse are skipped.
    """
    lines = spark.read.text(path).where(F.upper("value").contains("POLYGON"))
    lines = lines.select(F.monotonically_increasing_id().alias("_line"), F.upper(F.trim("value")).alias("v"))
    number = r"[-+0-9.eE]+"
    ring = rf"\(\s*{number}\s+{number}[^()]*\)"
    parts = F.regexp_extract_all("v", F.lit(rf"(\(\s*{ring}(?:\s*,\s*{ring})*\s*\))"), F.lit(1))
    rows = lines.select("_line", F.posexplode(parts).alias("_part", "t"))
    rings = F.transform(F.regexp_extract_all("t", F.lit(r"\(([^()]*)\)"), F.lit(1)), lambda r: F.transform(F.split(F.trim(r), r"\s*,\s*"), lambda p: F.transform(F.slice(F.split(F.trim(p), r"\s+"), 1, 2), lambda c: c.try_cast("double"))))
    rows = rows.withColumn("rings", rings).where(F.forall("rings", lambda r: F.forall(r, lambda p: (F.size(p) == 2) & F.forall(p, lambda c: c.isNotNull()))))
    return numbered(rows, "_line", "_part", name="polygon_id").select("polygon_id", "rings")


def triangulated(polygons: DataFrame) -> DataFrame:
    """``polygon_id, method`` and triangles at z = 0, in arrays; failed polygons have none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for n, rings in zip(frame["polygon_id"], frame["rings"]):
                rings = [[(float(x), float(y)) for x, y in r] for r in rings]
                code, found = triangulate(rings[0], rings[1:]) if rings else (FAILED, [])
                rows.append((n, code, [[c for p in t for c in (*p, 0.0)] for t in found]))
            yield pd.DataFrame(rows, columns=["polygon_id", "method", "triangles"])

    return polygons.mapInPandas(run, "polygon_id long, method int, triangles array<array<double>>")


def polygon_triangles(made: DataFrame) -> DataFrame:
    """Triangles of triangulated polygons; a polygon with a triangle of two equal corners is dropped."""
    corner = lambda t, i: F.slice(t, 3 * i + 1, 3)
    bad = F.exists("triangles", lambda t: (corner(t, 0) == corner(t, 1)) | (corner(t, 1) == corner(t, 2)) | (corner(t, 0) == corner(t, 2)))
    rows = made.where(~bad & (F.size("triangles") > 0)).select("polygon_id", F.posexplode("triangles").alias("n", "t"))
    rows = numbered(rows, "polygon_id", "n", name="tri_idx")
    return rows.select("tri_idx", F.col("polygon_id").alias("object_id"), *[F.col("t")[i].alias(c) for i, c in enumerate(TRIANGLE)])


def triangulation_statistics(made: DataFrame) -> DataFrame:
    """``method, n``: 0 as it is, 1 repaired, 2 decomposed, 3 failed."""
    return made.groupBy("method").agg(F.count("*").alias("n"))


def read_wkt(spark: SparkSession, path: str) -> DataFrame:
    """Triangles of the polygons of a text file, at z = 0."""
    return polygon_triangles(triangulated(read_polygons(spark, path)))


# --- points -----------------------------------------------------------------------


def read_points(spark: SparkSession, path: str | None) -> DataFrame:
    """``point_id, x, y, z`` of ``POINT (x y z)`` lines and bare numbers; ids dense in file order.

    Blank lines and ``#`` comments are skipped, a missing z is 0. Without a path: three demonstration points.
    """
    if not path:
        return spark.createDataFrame([(0, 0.0, 0.0, -1.0), (1, 0.5, 0.5, -1.0), (2, 2.0, 2.0, -1.0)], "point_id long, x double, y double, z double")
    number = r"([-+]?[0-9.]+(?:[eE][-+]?[0-9]+)?)"
    row = F.ltrim("value")
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("_line"), row.alias("v")).where(F.col("v").rlike(r"^(POINT|[0-9-])"))
    body = F.regexp_replace("v", r"^POINT\s*Z?\s*\(?", "")
    at = F.regexp_extract_all(body, F.lit(number), F.lit(1))
    rows = lines.select("_line", at.alias("c")).where(F.size("c") >= 2)
    xyz = [F.coalesce(F.get("c", i).cast("double"), F.lit(0.0)).alias(a) for i, a in enumerate("xyz")]
    return numbered(rows.select("_line", *xyz), "_line", name="point_id").select("point_id", "x", "y", "z")


# --- binary geometry -----------------------------------------------------------------


def parse_binary(raw: bytes) -> dict[str, np.ndarray]:
    """The sections of a binary geometry file."""
    magic, version, n_vertices, n_indices, n_maps, n_edges, n_owners, n_triangles, has_grid, has_edges = HEADER.unpack_from(raw)
    if magic != MAGIC or version != VERSION:
        raise ValueError(f"not a binary geometry file of version {VERSION}: magic {magic:#x}, version {version}")
    at = HEADER.size

    def take(kind, *shape) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(raw, kind, int(np.prod(shape)), at).reshape(shape)
        at += out.nbytes
        return out

    found = {"vertices": take("<f4", n_vertices, 3), "indices": take("<u4", n_indices, 3), "objects": take("<i4", n_maps)}
    if has_edges:
        found |= {"starts": take("<f4", n_edges, 3), "ends": take("<f4", n_edges, 3), "offsets": take("<i4", n_edges), "counts": take("<i4", n_edges), "owners": take("<i4", n_owners)}
    if has_grid:
        found |= {"low": take("<f4", 3), "high": take("<f4", 3), "res": take("<u4", 4)[:3]}
        found["cells"] = take(np.dtype([("center", "<u4"), ("touch", "<u4"), ("size", "<f4"), ("ratio", "<f4")]), int(np.prod(found["res"])))
    return found


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    """Triangles of binary geometry files."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for raw in frame["content"]:
                x = parse_binary(bytes(raw))
                corners = x["vertices"].astype(float)[x["indices"]].reshape(-1, 9)
                yield pd.DataFrame({"tri_idx": np.arange(len(corners)), "object_id": x["objects"].astype(np.int64), **dict(zip(TRIANGLE, corners.T))})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, TRIANGLE_DDL)


def read_binary_edges(spark: SparkSession, path: str) -> DataFrame:
    """Edges with their owners; an error if the file has none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for raw in frame["content"]:
                x = parse_binary(bytes(raw))
                if "starts" not in x:
                    raise ValueError("the file has no edges")
                owners = [x["owners"][o : o + n].tolist() for o, n in zip(x["offsets"], x["counts"])]
                yield pd.DataFrame({"edge_idx": np.arange(len(owners)), **dict(zip(("sx", "sy", "sz"), x["starts"].astype(float).T)), **dict(zip(("ex", "ey", "ez"), x["ends"].astype(float).T)), "source_objects": owners})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "edge_idx long, sx double, sy double, sz double, ex double, ey double, ez double, source_objects array<long>")


# --- other formats -------------------------------------------------------------------------


def read_geometry_text(spark: SparkSession, path: str) -> DataFrame:
    """Triangles of a text file with lines ``vertices:``, ``indices:`` and ``triangleToObject:``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for text in frame["value"]:
                parts = {k.strip(): v.split() for k, _, v in (line.partition(":") for line in text.splitlines())}
                v = np.array(parts["vertices"], float).reshape(-1, 3)
                corners = v[np.array(parts["indices"], int)].reshape(-1, 9)
                yield pd.DataFrame({"tri_idx": np.arange(len(corners)), "object_id": np.array(parts.get("triangleToObject", [0] * len(corners)), np.int64), **dict(zip(TRIANGLE, corners.T))})

    return spark.read.text(path, wholetext=True).mapInPandas(run, TRIANGLE_DDL)


def read_off(spark: SparkSession, path: str) -> DataFrame:
    """Triangles of OFF meshes, one per line with ``|`` for new lines; faces are fanned out."""
    lines = numbered(spark.read.text(path).where(F.trim("value") != "").select(F.monotonically_increasing_id().alias("_line"), "value"), "_line", name="object_id")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for n, value in zip(frame["object_id"], frame["value"]):
                words = iter(value.replace("|", "\n").split())
                if next(words) != "OFF":
                    continue
                n_v, n_f, _ = (int(next(words)) for _ in range(3))
                v = [tuple(float(next(words)) for _ in range(3)) for _ in range(n_v)]
                k = 0
                for _ in range(n_f):
                    face = [int(next(words)) for _ in range(int(next(words)))]
                    for i in range(1, len(face) - 1):
                        rows.append((k, n, *v[face[0]], *v[face[i]], *v[face[i + 1]]))
                        k += 1
            yield _frame(rows)

    # faces are numbered within their object first, then through all objects
    faces = lines.select("object_id", "value").mapInPandas(run, TRIANGLE_DDL).withColumnRenamed("tri_idx", "_face")
    return numbered(faces, "object_id", "_face", name="tri_idx").select("tri_idx", "object_id", *TRIANGLE)


def read_bounds(spark: SparkSession, path: str) -> DataFrame:
    """A ``{"min": [...], "max": [...]}`` file as one row of a box."""
    row = spark.read.json(path, multiLine=True, schema="min array<double>, max array<double>")
    return row.select(*[F.col(m)[i].alias(f"{m}_{a}") for m in ("min", "max") for i, a in enumerate("xyz")])


def read_tiles(spark: SparkSession, path: str) -> DataFrame:
    """Tile files: only a raw payload could be read; the compressed codec is not supported."""
    raise NotImplementedError(f"{path}: progressive compressed tiles are not supported; convert them to OFF, OBJ or the binary format")


def read_mesh(spark: SparkSession, path: str, mode: str = "mesh") -> DataFrame:
    """Triangles of a file, by its extension; ``mode="wkt"`` forces the polygon reader."""
    end = os.path.splitext(path)[1].lower()
    if mode == "wkt":
        return read_wkt(spark, path)
    if end == ".parquet":
        return spark.read.parquet(path)
    readers = {".obj": read_obj, ".dt": read_tiles, ".pre": read_binary, ".off": read_off}
    return readers.get(end, read_wkt)(spark, path)


def tasks(geometries: str, points: str) -> list[tuple[str, str]]:
    """Comma-separated lists of files, paired; a list of one goes with every entry of the other."""
    a, b = ([x.strip() for x in s.split(",") if x.strip()] for s in (geometries, points))
    if len(a) != len(b) and 1 not in (len(a), len(b)):
        raise ValueError(f"{len(a)} geometries and {len(b)} point files")
    n = max(len(a), len(b))
    return [(a[i % len(a)], b[i % len(b)]) for i in range(n)]
