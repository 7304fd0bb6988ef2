"""Point-in-mesh, overlap, intersection and containment joins, and their diagnostics.

Each is a broad phase on boxes and an exact test on what it leaves: an equi-join
on cells or ids with a residual predicate, never a nested loop.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..runtime import cut
from ..schema import AXES, BOX, SEGMENT, TRIANGLE
from .candidates import box_join, extent, level_of, levels_of, usable
from .edges import triangle_edges, unique_edges
from .objects import boxes, dataset_bounds, first_vertices

PAIR = ("object_id_mesh1", "object_id_mesh2")


# --- points -------------------------------------------------------------------


def _slopes(of: str, a: str, b: str) -> list[Column]:
    """An edge of a triangle seen along z, from its lower end (in y, then x) to its upper: both directions of an edge give the same."""
    low = (F.col(a + "y") < F.col(b + "y")) | ((F.col(a + "y") == F.col(b + "y")) & (F.col(a + "x") <= F.col(b + "x")))
    ends = [F.when(low, F.col(u + x)).otherwise(F.col(v + x)) for u, v in ((a, b), (b, a)) for x in "xy"]
    return [e.alias(f"{of}{n}") for e, n in zip(ends, ("lx", "ly", "hx", "hy"))]


def _upward(triangles: DataFrame) -> DataFrame:
    """The usable triangles that do not stand upright, with normals, bounds and the slopes of their sides."""
    p, q, r = g.vec("p"), g.vec("q"), g.vec("r")
    normal = g.triangle_normal(p, q, r)
    faces = usable(triangles, *TRIANGLE).select("tri_idx", "object_id", *TRIANGLE, *[n.alias("n" + x) for n, x in zip(normal, AXES)]).where("nz <> 0")
    bounds = {f"{m}_{x}": getattr(F, how)(*[c + x for c in "pqr"]) for m, how in (("min", "least"), ("max", "greatest")) for x in AXES}
    sides = [c for name, (u, v) in zip("abc", (("p", "q"), ("q", "r"), ("r", "p"))) for c in _slopes(name, u, v)]
    return faces.withColumns(bounds).select("tri_idx", "object_id", "px", "py", "pz", "nx", "ny", "nz", *[f"{m}_{x}" for m in ("min", "max") for x in AXES], *sides)


#: The columns of ``_upward`` that the exact test takes.
TESTED = ("tri_idx", "object_id", "px", "py", "pz", "nx", "ny", "nz", *[e + n for e in "abc" for n in ("lx", "ly", "hx", "hy")])


def _risen(met: DataFrame, above: float, closed: bool, *more: str) -> DataFrame:
    """Of points joined with triangles, the pairs where the triangle is above, with the rise ``t``."""
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    crosses = [(F.col(f"{e}ly") <= y) & (y < F.col(f"{e}hy")) & ((x - F.col(f"{e}lx")) * (F.col(f"{e}hy") - F.col(f"{e}ly")) < (F.col(f"{e}hx") - F.col(f"{e}lx")) * (y - F.col(f"{e}ly"))) for e in "abc"]
    met = met.where((z < F.col("max_z")) & ((crosses[0] != crosses[1]) != crosses[2]))
    rise = F.col("pz") - z - ((x - F.col("px")) * F.col("nx") + (y - F.col("py")) * F.col("ny")) / F.col("nz")
    met = met.select("point_id", *more, "object_id", "tri_idx", rise.alias("t"))
    return met.where(F.col("t") >= above if closed else F.col("t") > above)


def point_hits(points: DataFrame, triangles: DataFrame, above: float = 0.0, closed: bool = False) -> DataFrame:
    """``point_id, object_id, tri_idx, t``: the triangles above each point, on the ray towards +z.

    Points and triangles meet in columns of cells of the xy plane, by an equi-join;
    ``t`` is the rise, over ``above`` (or equal to it, if ``closed``). Triangles that stand upright are never above.
    """
    faces = _upward(triangles)
    level = level_of(extent(("x", "y")), 1)
    levels = levels_of(faces, size=extent(("x", "y")), finer=1) or [0]  # a triangle stands at its own level, a point looks at every level in use
    size = F.pow(F.lit(2.0), F.col("level"))
    span = lambda x: F.sequence(F.floor(F.col(f"min_{x}") / size), F.floor(F.col(f"max_{x}") / size))
    dealt = faces.withColumn("level", level).select("level", *TESTED, "max_z", F.explode(span("x")).alias("cell_x"), span("y").alias("_y")).select("*", F.explode("_y").alias("cell_y")).drop("_y")
    asked = usable(points.select("point_id", "x", "y", "z"), *AXES).select("*", F.explode(F.array(*map(F.lit, levels))).alias("level"))
    asked = asked.select("*", F.floor(F.col("x") / size).alias("cell_x"), F.floor(F.col("y") / size).alias("cell_y"))
    return _risen(asked.join(dealt, ["level", "cell_x", "cell_y"]), above, closed)


#: Triangles of an object up to which a point in its box meets all of them; beyond, those of the point's column of cells.
FEW = 64


def outlines(triangles: DataFrame) -> DataFrame:
    """``object_id``, its box, ``shut`` and ``cell``: the size of the cells of its triangles in the xy plane, 0 for few triangles.

    An object is shut if every edge belongs to an even number of its triangles: then any line crosses it
    evenly. It shows in the exclusive or of its edges' hashes.
    """
    faces = usable(triangles, *TRIANGLE)
    corner = {c: F.xxhash64(*[c + x for x in AXES]) for c in "pqr"}
    edge = lambda a, b: F.xxhash64(F.least(corner[a], corner[b]), F.greatest(corner[a], corner[b]))
    across = F.greatest(*[F.greatest(*[c + x for c in "pqr"]) - F.least(*[c + x for c in "pqr"]) for x in "xy"])
    rows = boxes(faces, F.count("*").alias("n"), F.avg(across * across).alias("square"), (F.bit_xor(edge("p", "q").bitwiseXOR(edge("q", "r")).bitwiseXOR(edge("r", "p"))) == 0).alias("shut"))
    # by the mean square, so that triangles lie in two or three cells on the average whatever their sizes
    cell = F.when(F.col("n") <= FEW, F.lit(0.0)).otherwise(F.greatest(F.sqrt("square") * 2, extent(("x", "y")) / 1024, F.lit(1e-9)))
    return rows.select("object_id", *BOX, "shut", cell.alias("cell"))


def _around(points: DataFrame, shapes: DataFrame, above: float) -> DataFrame:
    """``point_id, x, y, z, object_id, cell``: points in the boxes of shut objects, and in the columns under the tops of others.

    They meet in cells as large as the object; a point looks in one cell of every level in use.
    """
    shapes = shapes.withColumn("min_z", F.col("min_z") - above)
    level = F.when(F.col("shut"), level_of(extent())).otherwise(level_of(extent(("x", "y"))))
    used = sorted(tuple(r) for r in shapes.select("shut", level.alias("level")).distinct().collect()) or [(True, 0)]  # two for a level at most
    size = F.pow(F.lit(2.0), F.col("level"))
    span = lambda x: F.sequence(F.floor(F.col(f"min_{x}") / size), F.floor(F.col(f"max_{x}") / size))
    dealt = shapes.withColumn("level", level).withColumn("cell_x", F.explode(span("x"))).withColumn("cell_y", F.explode(span("y")))
    dealt = dealt.withColumn("cell_z", F.explode(F.when(F.col("shut"), span("z")).otherwise(F.array(F.lit(0).cast("long")))))
    at = lambda x, n: F.floor(F.col(x) / F.lit(2.0**n)).cast("long")
    seen = F.array(*[F.struct(F.lit(shut).alias("shut"), F.lit(n).alias("level"), at("x", n).alias("cell_x"), at("y", n).alias("cell_y"), (at("z", n) if shut else F.lit(0).cast("long")).alias("cell_z")) for shut, n in used])
    asked = usable(points.select("point_id", "x", "y", "z"), *AXES).select("*", F.explode(seen).alias("s")).select("point_id", "x", "y", "z", "s.*")
    inside = F.col("x").between(F.col("min_x"), F.col("max_x")) & F.col("y").between(F.col("min_y"), F.col("max_y")) & (F.col("z") <= F.col("max_z")) & (~F.col("shut") | (F.col("z") >= F.col("min_z")))
    return asked.join(dealt, ["shut", "level", "cell_x", "cell_y", "cell_z"]).where(inside).select("point_id", "x", "y", "z", "object_id", "cell")


def _crossed(pairs: DataFrame, faces: DataFrame, shapes: DataFrame, above: float, closed: bool, *more: str) -> DataFrame:
    """The hits of points on the triangles of the objects they are paired with."""
    at = lambda x: F.when(F.col("cell") > 0, F.floor(F.col(x) / F.nullif(F.col("cell"), F.lit(0.0)))).otherwise(F.lit(0).cast("long"))
    span = lambda x: F.explode(F.sequence(at(f"min_{x}"), at(f"max_{x}")))
    dealt = faces.join(shapes.select("object_id", "cell"), "object_id").select(*TESTED, "max_z", "min_y", "max_y", "cell", span("x").alias("cell_x"))
    dealt = dealt.select(*TESTED, "max_z", "cell_x", span("y").alias("cell_y"))
    asked = pairs.select("point_id", "x", "y", "z", "object_id", at("x").alias("cell_x"), at("y").alias("cell_y"))
    return _risen(asked.join(dealt, ["object_id", "cell_x", "cell_y"]), above, closed, *more)


def near_hits(points: DataFrame, triangles: DataFrame, above: float = 0.0, closed: bool = False, shapes: DataFrame | None = None, more: tuple = ()) -> DataFrame:
    """``point_hits`` without those of shut objects that lie wholly above the point, whose number is even.

    So it tells parities, and its rows grow with the objects around a point instead of with all that stand above it.
    """
    shapes = cut(outlines(triangles)) if shapes is None else shapes
    return _crossed(_around(points, shapes, above), _upward(triangles), shapes, above, closed, *more)


def point_in_mesh(points: DataFrame, triangles: DataFrame, parity: str = "global", **how) -> DataFrame:
    """``point_id, polygon_id`` of points inside.

    ``global``: all crossings of all objects count, the nearest crossed object is named.
    ``per_object``: a row for each object with an odd number of crossings.
    """
    if parity != "global":
        hits = near_hits(points, triangles, **how)
        return hits.groupBy("point_id", "object_id").agg(F.count("*").alias("n")).where("n % 2 = 1").select("point_id", F.col("object_id").alias("polygon_id"))
    shapes = cut(outlines(triangles))
    hits = near_hits(points, triangles, shapes=shapes, more=AXES, **how)
    order = F.struct("t", "tri_idx")
    odd = hits.groupBy("point_id").agg(F.count("*").alias("n"), F.min_by(F.struct(*AXES, "object_id", "tri_idx", "t"), order).alias("v")).where("n % 2 = 1")
    odd = cut(odd.select("point_id", "v.*"))
    # what is left out may be nearer: shut objects that begin between the point and its nearest crossing so far
    over = F.col("z") + F.col("t") + (F.abs("z") + F.col("t")) * 1e-9
    reach = odd.select("point_id", *[F.col(x).alias(f"{m}_{x}") for x in "xy" for m in ("min", "max")], F.col("z").alias("min_z"), over.alias("max_z"))
    begins = (F.col("b_min_z") > F.col("a_min_z")) & (F.col("b_min_z") <= F.col("a_max_z"))
    for x in "xy":
        begins = begins & F.col(f"a_min_{x}").between(F.col(f"b_min_{x}"), F.col(f"b_max_{x}"))
    later = box_join(reach, shapes.where("shut"), predicate=begins)
    later = later.select(F.col("a_point_id").alias("point_id"), *[F.col(f"a_min_{x}").alias(x) for x in AXES], F.col("b_object_id").alias("object_id"), F.col("b_cell").alias("cell"))
    found = _crossed(later, _upward(triangles), shapes, how.get("above", 0.0), how.get("closed", False))
    every = odd.select("point_id", "object_id", "tri_idx", "t").unionByName(found)
    return every.groupBy("point_id").agg(F.min_by("object_id", order).alias("polygon_id"))


def points_in_bounds(points: DataFrame, triangles: DataFrame) -> DataFrame:
    """The points within the dataset's box."""
    return points.join(F.broadcast(dataset_bounds(triangles)), g.box_contains_point("", (F.col("x"), F.col("y"), F.col("z")))).select(points["*"])  # one row


def filter_refine(points: DataFrame, triangles: DataFrame, **how) -> DataFrame:
    """The box filter, then the exact join on what is left; original ids."""
    bounds = dataset_bounds(triangles).first()
    if bounds["min_x"] is None:
        return point_in_mesh(points.where(F.lit(False)), triangles, **how)
    within = [F.col(a).between(bounds[f"min_{a}"], bounds[f"max_{a}"]) for a in AXES]
    return point_in_mesh(points.where(within[0] & within[1] & within[2]), triangles, **how)


def point_summary(points: DataFrame, triangles: DataFrame, **how) -> DataFrame:
    """One row: points in all, in the box, inside and outside, and the share inside in percent."""
    bounds = dataset_bounds(triangles)
    flagged = points.join(F.broadcast(bounds))  # one row
    candidate = flagged.withColumn("c", F.coalesce(g.box_contains_point("", (F.col("x"), F.col("y"), F.col("z"))), F.lit(False)))
    inside = filter_refine(points, triangles, **how).select("point_id", F.lit(1).alias("i"))
    rows = candidate.select("point_id", "c").join(inside, "point_id", "left")
    counted = rows.agg(F.count("*").alias("total"), F.count_if("c").alias("candidates"), F.count("i").alias("inside"))
    return counted.select("total", "candidates", (F.col("total") - F.col("candidates")).alias("filtered"), "inside", (F.col("total") - F.col("inside")).alias("outside"), F.coalesce(F.lit(100.0) * F.col("inside") / F.nullif(F.col("total"), F.lit(0)), F.lit(0.0)).alias("inside_percent"))


# --- overlap -------------------------------------------------------------------


#: Edges times triangles of a pair of objects up to which they all meet; beyond, in cells.
PAIRWISE = 20_000
#: Levels of cells, each four times as large as the one before; the smallest are twice the mean face.
CELL_LEVELS = 6


def faces_of(side) -> DataFrame:
    """The triangles of a frame of triangles or a dataset."""
    return side if isinstance(side, DataFrame) else side.triangles


def measured(side) -> DataFrame:
    """``object_id``, its box, number of triangles and their mean extent."""
    reach = F.greatest(*[F.greatest(*[c + x for c in "pqr"]) - F.least(*[c + x for c in "pqr"]) for x in AXES])
    return boxes(faces_of(side), F.count("*").alias("n"), F.avg(reach).alias("face"))


def owned_edges(side, unique: bool = True) -> DataFrame:
    """``object_id`` and both ends of every edge, once for each owner; all three per triangle if not ``unique``.

    The stored edges of a dataset are taken if it has them.
    """
    if not unique:
        return triangle_edges(faces_of(side))
    found = unique_edges(side) if isinstance(side, DataFrame) else side.edges
    return found.select(F.explode("source_objects").alias("object_id"), *SEGMENT)


def object_pairs(a, b) -> DataFrame:
    """Pairs of objects whose boxes strictly intersect, with their common box, and the least ``cell`` (0: all their parts meet)."""
    met = box_join(cut(measured(a)), cut(measured(b)))  # a few numbers an object, stored: levels and both directions read them
    low = [F.greatest(f"a_min_{x}", f"b_min_{x}").alias(f"min_{x}") for x in AXES]
    high = [F.least(f"a_max_{x}", f"b_max_{x}").alias(f"max_{x}") for x in AXES]
    cell = F.when(F.col("a_n") * F.col("b_n") <= PAIRWISE, F.lit(0.0)).otherwise(F.greatest((F.col("a_face") + F.col("b_face")), F.lit(1e-9)))
    return met.select("a_object_id", "b_object_id", *low, *high, cell.alias("cell"))


def _in_cells(rows: DataFrame, low: str, high: str) -> DataFrame:
    """Rows of pairs with ``own`` (their level) and a row for each cell of each level from there on, within the common box; one row if the pair has no cells."""
    reach = F.greatest(*[F.col(f"{high}_{x}") - F.col(f"{low}_{x}") for x in AXES])
    own = F.when(F.col("cell") == 0, 0).otherwise(F.least(F.greatest(F.ceil(F.log2(F.greatest(reach, F.lit(1e-300)) / F.col("cell")) / 2), F.lit(0)), F.lit(CELL_LEVELS - 1))).cast("int")

    def cells(level: Column) -> Column:
        size = F.col("cell") * F.pow(F.lit(4.0), level)
        span = lambda x: F.sequence(F.floor(F.greatest(f"{low}_{x}", f"min_{x}") / size), F.floor(F.least(f"{high}_{x}", f"max_{x}") / size))
        at = lambda i, j, k: F.struct(level.alias("level"), i.alias("cx"), j.alias("cy"), k.alias("cz"))
        return F.flatten(F.transform(span("x"), lambda i: F.flatten(F.transform(span("y"), lambda j: F.transform(span("z"), lambda k: at(i, j, k))))))

    none = F.array(F.struct(F.lit(0).alias("level"), *[F.lit(0).cast("long").alias(c) for c in ("cx", "cy", "cz")]))
    rows = rows.withColumn("own", own)
    dealt = F.when(F.col("cell") == 0, none).otherwise(F.flatten(F.transform(F.sequence(F.col("own"), F.lit(CELL_LEVELS - 1)), cells)))
    return rows.withColumn("at", F.explode(dealt)).select("*", "at.*").drop("at")


def edge_hits(edges: DataFrame, pairs: DataFrame, faces: DataFrame) -> DataFrame:
    """``a_object_id, b_object_id`` for each hit of an edge owned by an object of a on a triangle of b.

    ``pairs`` are those of ``object_pairs``, ``edges`` has ``object_id`` and both ends. Edges and triangles
    outside the pair's common box are left out. Those of large objects meet in cells: at the
    coarser of their levels, in the cell of the low corner of what their boxes have in common.
    """
    ids, box = ("a_object_id", "b_object_id"), [f"{m}_{x}" for m in ("min", "max") for x in AXES]
    inside = lambda low, high: reduce(Column.__and__, [(F.col(f"{low}_{x}") <= F.col(f"max_{x}")) & (F.col(f"{high}_{x}") >= F.col(f"min_{x}")) for x in AXES])
    ends = {f"{m}_{x}": getattr(F, how)("s" + x, "e" + x) for m, how in (("elow", "least"), ("ehigh", "greatest")) for x in AXES}
    sides = usable(edges.select(F.col("object_id").alias(ids[0]), *SEGMENT), *SEGMENT).withColumns(ends)
    some = _in_cells(pairs.join(sides, ids[0]).where(inside("elow", "ehigh")), "elow", "ehigh").withColumnRenamed("own", "e_own").drop(*box)
    corners = {f"{m}_{x}": getattr(F, how)(*[c + x for c in "pqr"]) for m, how in (("tlow", "least"), ("thigh", "greatest")) for x in AXES}
    p, q, r = g.vec("p"), g.vec("q"), g.vec("r")
    normal = {"n" + x: n for x, n in zip(AXES, g.triangle_normal(p, q, r))}
    flat = usable(faces.select(F.col("object_id").alias(ids[1]), *TRIANGLE), *TRIANGLE).withColumns(corners).withColumns(normal)
    others = _in_cells(pairs.join(flat, ids[1]).where(inside("tlow", "thigh")), "tlow", "thigh").withColumnRenamed("own", "t_own").drop(*box, "cell")
    met = some.join(others, [*ids, "level", "cx", "cy", "cz"])
    close = reduce(Column.__and__, [(F.col(f"elow_{x}") <= F.col(f"thigh_{x}")) & (F.col(f"ehigh_{x}") >= F.col(f"tlow_{x}")) for x in AXES])
    size = F.col("cell") * F.pow(F.lit(4.0), F.col("level"))
    corner = reduce(Column.__and__, [F.col("c" + x) == F.floor(F.greatest(f"elow_{x}", f"tlow_{x}") / size) for x in AXES])
    once = (F.col("cell") == 0) | ((F.col("level") == F.greatest("e_own", "t_own")) & corner)
    s, e = g.vec("s"), g.vec("e")
    return met.where(close & once).where(g.segment_hits_plane_triangle(s, e, p, q, r, g.vec("n"))).select(*ids)


def _hits_one_way(a, b, pairs: DataFrame, unique: bool) -> DataFrame:
    """The hits of edges of a on triangles of b, as pairs."""
    return edge_hits(owned_edges(a, unique), pairs, faces_of(b)).toDF(*PAIR)


def _hits_other_way(a, b, pairs: DataFrame, unique: bool) -> DataFrame:
    """The hits of edges of b on triangles of a, as pairs."""
    turned = pairs.select(F.col("b_object_id").alias("a_object_id"), F.col("a_object_id").alias("b_object_id"), *pairs.columns[2:])
    return edge_hits(owned_edges(b, unique), turned, faces_of(a)).toDF(*PAIR[::-1]).select(*PAIR)


WAYS = {"both": (_hits_one_way, _hits_other_way), "mesh1_to_mesh2": (_hits_one_way,), "mesh2_to_mesh1": (_hits_other_way,)}


def overlap_hits(a, b, direction: str = "both", unique: bool = True) -> DataFrame:
    """Pairs, once for each hit of an edge of one side on a triangle of the other. Both directions share their pairs of objects."""
    if direction not in WAYS:
        raise ValueError(f"direction {direction!r}")
    pairs = cut(object_pairs(a, b))
    return reduce(DataFrame.unionByName, [hits(a, b, pairs, unique) for hits in WAYS[direction]])


def overlap(a, b, direction: str = "both", unique: bool = True) -> DataFrame:
    """Distinct pairs of objects whose surfaces cross. The sides are frames of triangles, or datasets with stored edges.

    Of both directions the second has only the pairs left that the first has not found, and their objects.
    """
    if direction != "both":
        return overlap_hits(a, b, direction, unique).distinct()
    pairs = cut(object_pairs(a, b))
    found = cut(_hits_one_way(a, b, pairs, unique).distinct())
    left = cut(pairs.join(found.toDF("a_object_id", "b_object_id"), ["a_object_id", "b_object_id"], "left_anti"))
    few = lambda side, c: side.join(left.select(F.col(c).alias("object_id")).distinct(), "object_id", "left_semi") if isinstance(side, DataFrame) else side
    return found.unionByName(_hits_other_way(few(a, "a_object_id"), few(b, "b_object_id"), left, unique).distinct())


# --- containment and intersection --------------------------------------------------


def vertex_hits(inner: DataFrame, outer: DataFrame, hits=point_hits) -> DataFrame:
    """``source, target, tri_idx``: crossings above the first vertex of each object of ``inner``; ``near_hits`` leave out even ones."""
    points = first_vertices(inner).withColumnRenamed("object_id", "point_id")
    return hits(points, outer).select(F.col("point_id").alias("source"), F.col("object_id").alias("target"), "tri_idx")


def vertex_inside(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """``source, target``: objects of ``inner`` whose first vertex lies inside an object of ``outer``."""
    return vertex_hits(inner, outer, near_hits).groupBy("source", "target").agg(F.count("*").alias("n")).where("n % 2 = 1").select("source", "target")


def intersection(a, b, direction: str = "both") -> DataFrame:
    """Distinct pairs that overlap or have a first vertex inside the other."""
    found = overlap(a, b, direction)
    a, b = faces_of(a), faces_of(b)
    if direction in ("both", "mesh1_to_mesh2"):
        found = found.unionByName(vertex_inside(a, b).toDF(*PAIR))
    if direction in ("both", "mesh2_to_mesh1"):
        found = found.unionByName(vertex_inside(b, a).toDF(*PAIR[::-1]).select(*PAIR))
    return found.distinct()


def containment(a, b, include_overlap_pairs: bool = False) -> DataFrame:
    """``a_object_id, b_object_id`` with b inside a: its first vertex is, and no surfaces cross.

    With ``include_overlap_pairs`` the crossing pairs follow, told apart by ``pair_type``.
    """
    names = ("a_object_id", "b_object_id")
    crossing = overlap(a, b).toDF(*names)
    a, b = faces_of(a), faces_of(b)
    inside = vertex_inside(b, a).toDF(*names[::-1]).select(*names).join(crossing, [*names], "left_anti")
    if not include_overlap_pairs:
        return inside
    return inside.withColumn("pair_type", F.lit("containment")).unionByName(crossing.withColumn("pair_type", F.lit("overlap")))


def _directions(a: DataFrame, b: DataFrame) -> list[tuple[str, DataFrame, DataFrame]]:
    return [("mesh1_to_mesh2", a, b), ("mesh2_to_mesh1", b, a)]


def pair_hits(a: DataFrame, b: DataFrame) -> DataFrame:
    """``direction, source_object_id, target_object_id, target_ray_hits`` of odd pairs, both ways."""
    def one(name: str, inner: DataFrame, outer: DataFrame) -> DataFrame:
        hits = vertex_hits(inner, outer, near_hits).groupBy(F.col("source").alias("source_object_id"), F.col("target").alias("target_object_id"))
        return hits.agg(F.count("*").alias("target_ray_hits")).where("target_ray_hits % 2 = 1").select(F.lit(name).alias("direction"), "*")

    return one(*_directions(a, b)[0]).unionByName(one(*_directions(a, b)[1]))


def containment_tracking(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per direction and source object: hits + 1 as iterations, distinct candidates, and no overflow; every source has a row."""
    def one(name: str, inner: DataFrame, outer: DataFrame) -> DataFrame:
        hits = vertex_hits(inner, outer).groupBy(F.col("source").alias("source_object_id")).agg(F.count("*").alias("n"), F.count_distinct("target").alias("m"))
        every = inner.select(F.col("object_id").alias("source_object_id")).distinct().join(hits, "source_object_id", "left")
        n = F.coalesce("n", F.lit(0).cast("long"))
        return every.select(F.lit(name).alias("direction"), "source_object_id", (n + 1).alias("iterations"), F.coalesce("m", F.lit(0).cast("long")).alias("candidate_count"), F.lit(0).cast("long").alias("candidate_overflow_events"))

    return one(*_directions(a, b)[0]).unionByName(one(*_directions(a, b)[1]))


def profile(tracking: DataFrame) -> DataFrame:
    """One row: totals, maxima and averages times 1,000 of a containment tracking."""
    whole = lambda c: F.floor(F.sum(c) * 1000 / F.nullif(F.count("*"), F.lit(0))).cast("long")
    return tracking.agg(
        F.count("*").alias("sources"), F.sum("iterations").alias("iterations_total"), F.max("iterations").alias("iterations_max"), whole("iterations").alias("iterations_avg_x1000"),
        F.sum("candidate_count").alias("candidates_total"), F.max("candidate_count").alias("candidates_max"), whole("candidate_count").alias("candidates_avg_x1000"),
        F.sum("candidate_overflow_events").alias("overflow_total"),
    )


def running_offsets(counts: DataFrame, n: str, *order: str) -> DataFrame:
    """``offset``: the sum of ``n`` before each row in an order, from sums per range."""
    from pyspark.sql.window import Window

    dealt = cut(counts.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    per = dealt.groupBy("_part").agg(F.sum(n).alias("_n"))
    before = per.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")  # a row per partition
    inside = F.coalesce(F.sum(n).over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return dealt.join(F.broadcast(before), "_part").withColumn("offset", F.col("_before") + inside).drop("_part", "_before")


def packed(pairs: DataFrame) -> DataFrame:
    """Pairs with ``pair_key``, both ids in one long."""
    return pairs.withColumn("pair_key", g.pack_pair(F.col(PAIR[0]), F.col(PAIR[1])))
