"""Geometry as Column arithmetic: no divisions that a guard must protect, no UDFs.

A vector is a tuple of three Columns.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = tuple[Column, Column, Column]
EPS = 1e-6


def vec(prefix: str, of: str = "") -> Vec:
    """The columns ``{of}{prefix}x``, ``...y`` and ``...z``."""
    return tuple(F.col(f"{of}{prefix}{a}") for a in "xyz")


def sub(a: Vec, b: Vec) -> Vec:
    return tuple(x - y for x, y in zip(a, b))


def add(a: Vec, b: Vec) -> Vec:
    return tuple(x + y for x, y in zip(a, b))


def scale(a: Vec, k) -> Vec:
    return tuple(x * k for x in a)


def dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vec, b: Vec) -> Vec:
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def length(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def distance2(a: Vec, b: Vec) -> Column:
    """Squared distance."""
    return dot(sub(a, b), sub(a, b))


def normalise(a: Vec) -> Vec:
    """Unit vector; the zero vector if shorter than 1e-8."""
    n = length(a)
    return tuple(F.coalesce(F.when(n >= 1e-8, x / F.nullif(n, F.lit(0.0))), F.lit(0.0)) for x in a)


def signed_tetra(a: Vec, b: Vec, c: Vec) -> Column:
    """Six times the signed volume of the tetrahedron with the origin."""
    return dot(cross(a, b), c)


def triangle_normal(p: Vec, q: Vec, r: Vec) -> Vec:
    return cross(sub(q, p), sub(r, p))


def triangle_area(p: Vec, q: Vec, r: Vec) -> Column:
    return length(triangle_normal(p, q, r)) / 2


def segment_hits_triangle(s: Vec, e: Vec, p: Vec, q: Vec, r: Vec) -> Column:
    """Whether the segment meets the triangle at a distance in [1e-6, length + 1e-6] from its start.

    Both sides of the triangle count; parallel and coplanar segments, and segments
    shorter than 1e-6, do not. Numerators are compared with the determinant.
    """
    d, e1, e2 = sub(e, s), sub(q, p), sub(r, p)
    h = cross(d, e2)
    det = dot(e1, h)
    m = sub(s, p)
    g = cross(m, e1)
    w = F.signum(det)
    u, v, t = w * dot(m, h), w * dot(d, g), w * dot(e2, g)
    size, n = F.abs(det), length(d)
    return (det != 0) & (n >= EPS) & (u >= 0) & (v >= 0) & (u + v <= size) & (t * n >= F.lit(EPS) * size) & (t * n <= (n + EPS) * size)


def segment_hits_plane_triangle(s: Vec, e: Vec, p: Vec, q: Vec, r: Vec, normal: Vec) -> Column:
    """``segment_hits_triangle`` with the triangle's normal at hand: what the normal decides comes first.

    The determinant is ``-d . n`` and the place along the segment ``m . n`` over it, so segments
    that stay on one side of the plane are out after two dot products.
    """
    d, m, e1, e2 = sub(e, s), sub(s, p), sub(q, p), sub(r, p)
    det, t, n = -dot(d, normal), dot(m, normal), length(d)
    u, v = dot(m, cross(d, e2)) * det, dot(d, cross(m, e1)) * det
    reach = t * det * n
    plane = (det != 0) & (reach >= det * det * EPS) & (reach <= det * det * (n + EPS))
    return (n >= EPS) & plane & (u >= 0) & (v >= 0) & (u + v <= det * det)


def _crosses(x: Column, y: Column, a: Vec, b: Vec) -> Column:
    """Whether the edge crosses the ray from (x, y) towards +x; both directions of an edge compute alike."""
    up = (a[1] < b[1]) | ((a[1] == b[1]) & (a[0] <= b[0]))
    side = lambda lo, hi: (x - lo[0]) * (hi[1] - lo[1]) < (hi[0] - lo[0]) * (y - lo[1])
    return ((y < a[1]) != (y < b[1])) & F.when(up, side(a, b)).otherwise(side(b, a))


def zray_rise(point: Vec, p: Vec, q: Vec, r: Vec) -> Column:
    """How far above a point the plane of a triangle lies; null for a vertical triangle."""
    e1, e2, m = sub(q, p), sub(r, p), sub(point, p)
    det = e1[0] * e2[1] - e2[0] * e1[1]
    u = m[0] * e2[1] - e2[0] * m[1]
    v = e1[0] * m[1] - m[0] * e1[1]
    return (u * e1[2] + v * e2[2]) / F.nullif(det, F.lit(0.0)) - m[2]


def zray_covers(point: Vec, p: Vec, q: Vec, r: Vec) -> Column:
    """Whether the triangle covers the point seen along z; a shared edge belongs to one of its triangles."""
    x, y, _ = point
    return (_crosses(x, y, p, q) != _crosses(x, y, q, r)) != _crosses(x, y, r, p)


def boxes_intersect(a: str = "a_", b: str = "b_") -> Column:
    """Strictly, on every axis."""
    return reduce(Column.__and__, [(F.col(f"{a}min_{x}") < F.col(f"{b}max_{x}")) & (F.col(f"{b}min_{x}") < F.col(f"{a}max_{x}")) for x in "xyz"])


def box_contains_box(a: str = "a_", b: str = "b_") -> Column:
    """Closed: touching faces count."""
    return reduce(Column.__and__, [(F.col(f"{a}min_{x}") <= F.col(f"{b}min_{x}")) & (F.col(f"{b}max_{x}") <= F.col(f"{a}max_{x}")) for x in "xyz"])


def box_contains_point(box: str, point: Vec) -> Column:
    return reduce(Column.__and__, [(F.col(f"{box}min_{x}") <= c) & (c <= F.col(f"{box}max_{x}")) for x, c in zip("xyz", point)])


def box_gap(a: str = "a_", b: str = "b_") -> Column:
    """The distance between two boxes, 0 if they meet."""
    zero = F.lit(0.0)
    gaps = [F.greatest(F.col(f"{a}min_{x}") - F.col(f"{b}max_{x}"), F.col(f"{b}min_{x}") - F.col(f"{a}max_{x}"), zero) for x in "xyz"]
    return F.sqrt(gaps[0] * gaps[0] + gaps[1] * gaps[1] + gaps[2] * gaps[2])


def box_centre_distance(a: str = "a_", b: str = "b_") -> Column:
    """The distance between the centres of two boxes."""
    d = [(F.col(f"{a}min_{x}") + F.col(f"{a}max_{x}")) / 2 - (F.col(f"{b}min_{x}") + F.col(f"{b}max_{x}")) / 2 for x in "xyz"]
    return F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])


def box_volume(box: str = "") -> Column:
    return reduce(Column.__mul__, [F.col(f"{box}max_{x}") - F.col(f"{box}min_{x}") for x in "xyz"])


def box_diagonal(box: str = "") -> Column:
    d = [F.col(f"{box}max_{x}") - F.col(f"{box}min_{x}") for x in "xyz"]
    return F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])


def _clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(a / F.nullif(b, F.lit(0.0)), F.lit(0.0))


def point_segment_distance2(x: Vec, a: Vec, b: Vec) -> Column:
    d = sub(b, a)
    t = _clamp(_ratio(dot(sub(x, a), d), dot(d, d)))
    return distance2(x, add(a, scale(d, t)))


def point_triangle_distance2(x: Vec, p: Vec, q: Vec, r: Vec) -> Column:
    """Squared distance of a point to a triangle: its plane if above it, else the nearest edge."""
    n = triangle_normal(p, q, r)
    nn = dot(n, n)
    inside = reduce(Column.__and__, [dot(cross(sub(b, a), sub(x, a)), n) >= 0 for a, b in ((p, q), (q, r), (r, p))])
    h = dot(sub(x, p), n)
    edges = F.least(*[point_segment_distance2(x, a, b) for a, b in ((p, q), (q, r), (r, p))])
    return F.when((nn > 0) & inside, _ratio(h * h, nn)).otherwise(edges)


def segment_distance2(a: Vec, b: Vec, c: Vec, d: Vec) -> Column:
    """Squared distance of two segments."""
    u, v, w = sub(b, a), sub(d, c), sub(a, c)
    uu, uv, vv, uw, vw = dot(u, u), dot(u, v), dot(v, v), dot(u, w), dot(v, w)
    det = uu * vv - uv * uv
    s = _clamp(_ratio(uv * vw - vv * uw, det))
    t = _clamp(_ratio(uv * s + vw, vv))
    s = _clamp(_ratio(uv * t - uw, uu))
    inner = distance2(add(a, scale(u, s)), add(c, scale(v, t)))
    return F.least(inner, point_segment_distance2(a, c, d), point_segment_distance2(b, c, d), point_segment_distance2(c, a, b), point_segment_distance2(d, a, b))


def triangles_meet(t1: tuple[Vec, Vec, Vec], t2: tuple[Vec, Vec, Vec]) -> Column:
    """Whether an edge of one triangle meets the other; coplanar triangles do not count."""
    edges = lambda t: ((t[0], t[1]), (t[1], t[2]), (t[2], t[0]))
    return reduce(Column.__or__, [segment_hits_triangle(a, b, *other) for t, other in ((t1, t2), (t2, t1)) for a, b in edges(t)])


def triangle_distance(t1: tuple[Vec, Vec, Vec], t2: tuple[Vec, Vec, Vec]) -> Column:
    """Distance of two triangles, 0 if they meet."""
    edges = lambda t: ((t[0], t[1]), (t[1], t[2]), (t[2], t[0]))
    near = [segment_distance2(*e, *f) for e in edges(t1) for f in edges(t2)]
    near += [point_triangle_distance2(x, *other) for t, other in ((t1, t2), (t2, t1)) for x in t]
    return F.when(triangles_meet(t1, t2), F.lit(0.0)).otherwise(F.sqrt(F.least(*near)))


def in_triangle_cylinder(x: Vec, p: Vec, q: Vec, r: Vec) -> Column:
    """Whether a point projects into a triangle along its normal."""
    n = triangle_normal(p, q, r)
    return reduce(Column.__and__, [dot(cross(sub(b, a), sub(x, a)), n) >= 0 for a, b in ((p, q), (q, r), (r, p))])


def quantise(x: Column, scale_: float = 1e5) -> Column:
    """The nearest whole number of ``1 / scale_``, halves away from zero (``round`` would go through decimals)."""
    y = x * scale_
    return F.when(y < 0, -F.floor(F.lit(0.5) - y)).otherwise(F.floor(y + 0.5))


def cell_index(cx: Column, cy: Column, cz: Column, res: int) -> Column:
    return (cz * res + cy) * res + cx


def next_power_of_two(n: Column) -> Column:
    """The least power of two that is not below ``n`` (a long)."""
    m = n - 1
    for k in (1, 2, 4, 8, 16, 32):
        m = m.bitwiseOR(F.shiftright(m, k))
    return F.when(n <= 1, F.lit(1).cast("long")).otherwise(m + 1)


def pack_pair(a: Column, b: Column) -> Column:
    return F.shiftleft(a.cast("long"), 32).bitwiseOR(b.cast("long"))


def unpack_pair(key: Column) -> tuple[Column, Column]:
    return F.shiftrightunsigned(key, 32).cast("int"), key.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")
