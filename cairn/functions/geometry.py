"""Spatial predicates and measures as columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalar import _c


def in_box(x, y, z, low: Sequence, high: Sequence) -> Column:
    """Inclusive on all six faces."""
    return reduce(lambda a, b: a & b, [_c(v).between(_c(a), _c(b)) for v, a, b in zip((x, y, z), low, high, strict=True)])


def in_rect(x, y, x0, y0, x1, y1) -> Column:
    """Inclusive; NaN is never inside, whatever its order."""
    a, b = _c(x), _c(y)
    return ~F.isnan(a.cast("double")) & ~F.isnan(b.cast("double")) & a.between(_c(x0), _c(x1)) & b.between(_c(y0), _c(y1))


def in_polygon(x, y, ring: Sequence[tuple[float, float]]) -> Column:
    """Even-odd rule, unrolled over the edges behind the ring's bounding box."""
    px, py = _c(x).cast("double"), _c(y).cast("double")
    crossings = F.lit(0)
    for (xi, yi), (xj, yj) in zip(ring, [ring[-1], *ring[:-1]], strict=True):
        if yi == yj:
            continue
        at = F.lit(float(xj - xi)) * (py - float(yi)) / F.lit(float(yj - yi)) + float(xi)
        crossings = crossings + (((F.lit(float(yi)) > py) != (F.lit(float(yj)) > py)) & (px < at)).cast("int")
    xs, ys = [p[0] for p in ring], [p[1] for p in ring]
    return in_rect(px, py, float(min(xs)), float(min(ys)), float(max(xs)), float(max(ys))) & (crossings % 2 == 1)


def project(x, y, z, m: Sequence[float]) -> tuple[Column, Column, Column]:
    """Screen x, screen y and w of a row vector times a row-major 4x4 matrix; x and y are divided by w."""
    v = (_c(x), _c(y), _c(z))
    out = [v[0] * float(m[k]) + v[1] * float(m[4 + k]) + v[2] * float(m[8 + k]) + float(m[12 + k]) for k in range(4)]
    w = F.when(out[3] != 0, out[3])
    return out[0] / w, out[1] / w, out[3]


def in_region(x, y, kind: str, area: Sequence) -> Column:
    if kind == "rect":
        return in_rect(x, y, *area)
    return in_polygon(x, y, area)


def selected(x, y, regions: Sequence, deregions: Sequence = (), inverted: bool = False) -> Column:
    """In some region and in no de-selected one, inverted last."""
    some = lambda rs: reduce(lambda a, b: a | b, [in_region(x, y, *r) for r in rs], F.lit(False))
    inside = some(regions) & ~some(deregions)
    return ~inside if inverted else inside


def boxes_overlap(low_a: Sequence, high_a: Sequence, low_b: Sequence, high_b: Sequence) -> Column:
    return reduce(lambda a, b: a & b, [(_c(a0) <= _c(b1)) & (_c(b0) <= _c(a1)) for a0, a1, b0, b1 in zip(low_a, high_a, low_b, high_b, strict=True)])


def rect_may_hold_box(low: Sequence, high: Sequence, m: Sequence[float], rect: Sequence[float]) -> Column:
    """Whether a box can have a point in a screen rectangle; a corner behind the camera keeps it."""
    corners = [project(*[(high if k >> a & 1 else low)[a] for a in range(3)], m) for k in range(8)]
    behind = reduce(lambda a, b: a | b, [c[2] <= 0 for c in corners])
    xs, ys = [c[0] for c in corners], [c[1] for c in corners]
    apart = (F.greatest(*xs) < rect[0]) | (F.least(*xs) > rect[2]) | (F.greatest(*ys) < rect[1]) | (F.least(*ys) > rect[3])
    return behind | ~apart


def sphere_in_view(x, y, z, radius, planes: Sequence[Sequence[float]], eye: Sequence[float] | None = None) -> Column:
    """A sphere isn't wholly outside any plane ``(a, b, c, d)`` with unit normal pointing inwards; one that holds the eye is seen whatever the planes."""
    seen = reduce(lambda a, b: a & b, [_c(x) * float(p[0]) + _c(y) * float(p[1]) + _c(z) * float(p[2]) + float(p[3]) >= -_c(radius) for p in planes])
    if eye is None:
        return seen
    away = reduce(lambda a, b: a + b, [(_c(v) - float(e)) * (_c(v) - float(e)) for v, e in zip((x, y, z), eye, strict=True)])
    return seen | (away <= _c(radius) * _c(radius))


def distance(a: Sequence, b: Sequence) -> Column:
    return F.sqrt(reduce(lambda s, t: s + t, [(_c(p) - _c(q)) * (_c(p) - _c(q)) for p, q in zip(a, b, strict=True)]))


def cross(a: Sequence[Column], b: Sequence[Column]) -> tuple[Column, Column, Column]:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def triangle_area(v0: Sequence, v1: Sequence, v2: Sequence) -> Column:
    e1, e2 = ([_c(p) - _c(q) for p, q in zip(v, v0, strict=True)] for v in (v1, v2))
    n = cross(e1, e2)
    return 0.5 * F.sqrt(n[0] * n[0] + n[1] * n[1] + n[2] * n[2])


def polygon_area(ring) -> Column:
    """Area of a closed 3-D polygon given as an array of ``[x, y, z]``."""
    r = _c(ring)
    after = F.concat(F.slice(r, 2, F.greatest(F.size(r) - 1, F.lit(0))), F.slice(r, 1, 1))
    zero = F.array(*[F.lit(0.0)] * 3)
    parts = F.zip_with(r, after, lambda a, b: F.array(a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]))
    total = F.aggregate(parts, zero, lambda s, p: F.zip_with(s, p, lambda u, v: u + v))
    return 0.5 * F.sqrt(F.aggregate(total, F.lit(0.0), lambda s, v: s + v * v))
