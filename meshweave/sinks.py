"""Writers: result tables as CSV, meshes as OBJ, WKT, INSERT statements and the binary format, timings as JSON."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators.edges import unique_edges
from .schema import CORNERS, TRIANGLE
from .sources.readers import HEADER, MAGIC, VERSION

#: Column names of the result files.
HEADINGS = {
    "points": {"point_id": "pointId", "polygon_id": "polygonId"},
    "overlap": {},
    "intersection": {"object_id_mesh1": "a_object_id", "object_id_mesh2": "b_object_id"},
    "containment": {},
    "pair_hits": {},
    "tracking": {},
}


def write_csv(rows: DataFrame, path: str, kind: str, ordered: bool = False) -> None:
    """A result as CSV with a header; ``ordered`` sorts by all columns, over all files."""
    named = rows.withColumnsRenamed(HEADINGS[kind])
    (named.orderBy(*named.columns) if ordered else named).write.mode("overwrite").csv(path, header=True)


def obj_lines(triangles: DataFrame) -> DataFrame:
    """``object_id, value``: each object as OBJ text with relative vertex numbers, so parts can be joined in any order."""
    corners = F.array_join(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("tri_idx", *TRIANGLE))), lambda t: F.array(*[F.concat_ws(" ", F.lit("v"), *[t[c + a].cast("string") for a in "xyz"]) for c in CORNERS], F.lit("f -3 -2 -1")))), "\n")
    return triangles.groupBy("object_id").agg(corners.alias("v")).select("object_id", F.concat(F.lit("o object_"), F.col("object_id").cast("string"), F.lit("\n"), F.col("v")).alias("value"))


def write_obj(triangles: DataFrame, path: str) -> None:
    obj_lines(triangles).sortWithinPartitions("object_id").select("value").write.mode("overwrite").text(path)


def surfaces(triangles: DataFrame) -> DataFrame:
    """``object_id, wkt``: each object as ``POLYHEDRALSURFACE Z``."""
    at = lambda t, c: F.concat_ws(" ", *[t[c + a].cast("string") for a in "xyz"])
    ring = lambda t: F.concat(F.lit("(("), F.concat_ws(", ", at(t, "p"), at(t, "q"), at(t, "r"), at(t, "p")), F.lit("))"))
    rings = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tri_idx", *TRIANGLE))), ring), ", ")
    return triangles.groupBy("object_id").agg(F.concat(F.lit("POLYHEDRALSURFACE Z ("), rings, F.lit(")")).alias("wkt"))


def insert_statements(triangles: DataFrame, table: str) -> DataFrame:
    return surfaces(triangles).select(F.format_string(f"INSERT INTO {table} VALUES (%d, ST_GeomFromEWKT('%s'));", "object_id", "wkt").alias("value"))


def off_lines(triangles: DataFrame) -> DataFrame:
    """``object_id, value``: each object as OFF in one line, ``|`` for new lines."""
    ordered = F.array_sort(F.collect_list(F.struct("tri_idx", *TRIANGLE)))
    rows = triangles.groupBy("object_id").agg(ordered.alias("t"))
    vertices = F.flatten(F.transform("t", lambda t: F.array(*[F.concat_ws(" ", *[t[c + a].cast("string") for a in "xyz"]) for c in CORNERS])))
    faces = F.transform("t", lambda t, i: F.concat_ws(" ", F.lit("3"), *[(i * 3 + k).cast("string") for k in range(3)]))
    head = F.concat_ws(" ", (F.size("t") * 3).cast("string"), F.size("t").cast("string"), F.lit("0"))
    return rows.select("object_id", F.concat_ws("|", F.lit("OFF"), head, F.array_join(vertices, "|"), F.array_join(faces, "|")).alias("value"))


def binary_bytes(triangles: DataFrame) -> bytes:
    """The binary exchange file of a dataset. The format is one file, so the dataset must fit the driver."""
    t = triangles.orderBy("tri_idx").toPandas()
    corners = t[list(TRIANGLE)].to_numpy().astype("<f4").reshape(-1, 3)
    owner = np.repeat(t["object_id"].to_numpy(), 3)
    keyed = np.rec.fromarrays([owner, *corners.T])
    _, first, inverse = np.unique(keyed, return_index=True, return_inverse=True)
    edges = unique_edges(triangles).select("sx", "sy", "sz", "ex", "ey", "ez", "source_objects", "key").orderBy("key").toPandas()
    counts = np.array([len(x) for x in edges["source_objects"]], "<i4")
    flat = np.array([o for x in edges["source_objects"] for o in x], "<i4")
    head = HEADER.pack(MAGIC, VERSION, len(first), len(t), len(t), len(edges), len(flat), len(t), 0, 1)
    parts = [corners[first], inverse.astype("<u4"), t["object_id"].to_numpy().astype("<i4"), edges[["sx", "sy", "sz"]].to_numpy().astype("<f4"), edges[["ex", "ey", "ez"]].to_numpy().astype("<f4"), np.concatenate([[0], np.cumsum(counts)[:-1]]).astype("<i4") if len(counts) else counts, counts, flat]
    return head + b"".join(np.ascontiguousarray(p).tobytes() for p in parts)


def timing_json(phases: list[tuple[str, float]], counters: dict[str, int]) -> str:
    """Phases as ``{name}_{n}`` with their durations, counters and the total."""
    out = {f"{name.lower().replace(' ', '_')}_{n}": {"duration_us": round(s * 1e6), "duration_ms": round(s * 1e3, 3)} for n, (name, s) in enumerate(phases)}
    total = sum(s for _, s in phases)
    return json.dumps({"phases": out, "counters": counters, "total": {"duration_us": round(total * 1e6), "duration_ms": round(total * 1e3, 3)}})
