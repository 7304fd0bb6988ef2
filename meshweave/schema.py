"""Column conventions.

A mesh dataset is a frame of triangles, ``tri_idx, object_id`` and nine coordinates;
an object is the set of triangles with one ``object_id``. Coordinates are doubles.
"""

AXES = ("x", "y", "z")
CORNERS = ("p", "q", "r")
TRIANGLE = tuple(c + a for c in CORNERS for a in AXES)
SEGMENT = tuple(c + a for c in "se" for a in AXES)
BOX = tuple(f"{m}_{a}" for m in ("min", "max") for a in AXES)
TRIANGLE_DDL = "tri_idx long, object_id long, " + ", ".join(f"{c} double" for c in TRIANGLE)
POINT_DDL = "point_id long, x double, y double, z double"
