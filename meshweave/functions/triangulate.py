"""Triangulation of planar polygons with holes by ear clipping.

Holes are bridged to the ring around them. Rings that cross themselves are first cut
into simple rings at their crossings, and the parts of odd nesting stay.
"""

from __future__ import annotations

Point = tuple[float, float]
STANDARD, REPAIRED, DECOMPOSED, FAILED = 0, 1, 2, 3


def area(ring: list[Point]) -> float:
    """Signed area, positive if counter-clockwise."""
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1])) / 2


def _turn(a: Point, b: Point, c: Point) -> float:
    return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])


def contains(ring: list[Point], p: Point) -> bool:
    """Even-odd test."""
    inside = False
    for a, b in zip(ring, ring[1:] + ring[:1]):
        if (a[1] > p[1]) != (b[1] > p[1]) and p[0] < (b[0] - a[0]) * (p[1] - a[1]) / (b[1] - a[1]) + a[0]:
            inside = not inside
    return inside


def _crossing(a: Point, b: Point, c: Point, d: Point) -> Point | None:
    """The point where two segments properly cross."""
    d1, d2, d3, d4 = _turn(a, b, c), _turn(a, b, d), _turn(c, d, a), _turn(c, d, b)
    if d1 * d2 < 0 and d3 * d4 < 0:
        t = d3 / (d3 - d4)
        return (a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1]))
    return None


def clean(ring: list[Point]) -> list[Point]:
    """Without repeated neighbours and without a closing vertex."""
    out = [p for i, p in enumerate(ring) if i == 0 or p != ring[i - 1]]
    return out[:-1] if len(out) > 1 and out[0] == out[-1] else out


def crosses_itself(ring: list[Point]) -> bool:
    n = len(ring)
    return any(_crossing(ring[i], ring[(i + 1) % n], ring[j], ring[(j + 1) % n]) for i in range(n) for j in range(i + 2, n) if (j + 1) % n != i)


def untangle(ring: list[Point]) -> list[list[Point]]:
    """Simple rings of a ring that crosses itself: it is cut in two at each crossing."""
    todo, out = [ring], []
    while todo:
        r = todo.pop()
        n = len(r)
        found = next(((i, j, x) for i in range(n) for j in range(i + 2, n) if (j + 1) % n != i and (x := _crossing(r[i], r[(i + 1) % n], r[j], r[(j + 1) % n]))), None)
        if found is None:
            if len(r) >= 3 and abs(area(r)) > 0:
                out.append(r)
            continue
        i, j, x = found
        todo += [clean([x, *r[i + 1 : j + 1]]), clean([*r[: i + 1], x, *r[j + 1 :]])]
    return out


def bridge(outer: list[Point], hole: list[Point]) -> list[Point]:
    """One ring of an outer ring and a hole, joined at the nearest pair of vertices that see each other."""
    edges = list(zip(outer, outer[1:] + outer[:1])) + list(zip(hole, hole[1:] + hole[:1]))
    pairs = sorted(((o[0] - h[0]) ** 2 + (o[1] - h[1]) ** 2, i, j) for i, o in enumerate(outer) for j, h in enumerate(hole))
    for _, i, j in pairs:
        if not any(_crossing(outer[i], hole[j], a, b) for a, b in edges):
            return outer[: i + 1] + hole[j:] + hole[: j + 1] + outer[i:]
    raise ValueError("no bridge to a hole")


def clip(ring: list[Point]) -> list[tuple[Point, Point, Point]]:
    """Ears of a simple counter-clockwise ring."""
    left, out = list(ring), []
    while len(left) > 3:
        n = len(left)
        for i in range(n):
            a, b, c = left[i - 1], left[i], left[(i + 1) % n]
            if _turn(a, b, c) > 0 and not any(p not in (a, b, c) and _turn(a, b, p) >= 0 and _turn(b, c, p) >= 0 and _turn(c, a, p) >= 0 for p in left):
                out.append((a, b, c))
                del left[i]
                break
        else:
            flat = next((i for i in range(n) if _turn(left[i - 1], left[i], left[(i + 1) % n]) == 0), None)
            if flat is None:
                raise ValueError("no ear is left")
            del left[flat]
    if _turn(*left) > 0:
        out.append(tuple(left))
    return out


def triangulate(outer: list[Point], holes: list[list[Point]]) -> tuple[int, list[tuple[Point, Point, Point]]]:
    """A method code and the triangles of a polygon; ``FAILED`` and none if nothing works."""
    rings = [r for r in map(clean, [outer, *holes]) if len(r) >= 3]
    if not rings:
        return FAILED, []
    code = STANDARD
    if any(crosses_itself(r) for r in rings):
        code, rings = REPAIRED, [part for r in rings for part in untangle(r)]
    depth = [sum(contains(o, r[0]) for o in rings if o is not r) for r in rings]
    out: list[tuple[Point, Point, Point]] = []
    for ring, d in zip(rings, depth):
        if d % 2:
            continue
        shell = ring if area(ring) > 0 else ring[::-1]
        inner = [r for r, e in zip(rings, depth) if e == d + 1 and contains(ring, r[0])]
        try:
            for hole in sorted(inner, key=lambda r: -max(p[0] for p in r)):
                shell = bridge(shell, hole if area(hole) < 0 else hole[::-1])
            out += clip(shell)
        except ValueError:
            if not inner:
                continue
            code = DECOMPOSED  # without its holes rather than not at all
    return (code, out) if out else (FAILED, [])
