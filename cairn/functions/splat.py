"""Quantisation and shading of Gaussian splats, and Morton codes, as columns."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalar import _c, clamp

SQRT2 = math.sqrt(2.0)


def quantise_linear(v, low, high, bits: int) -> Column:
    """Unsigned integer of a value in its range, rounded half to even; a zero range counts as one."""
    top = float((1 << bits) - 1)
    span = F.when(_c(high) - _c(low) == 0, F.lit(1.0)).otherwise(_c(high) - _c(low))
    return clamp(F.rint((_c(v) - _c(low)) / span * top), 0.0, top).cast("long")


def dequantise_linear(q, low, high, bits: int) -> Column:
    span = F.when(_c(high) - _c(low) == 0, F.lit(1.0)).otherwise(_c(high) - _c(low))
    return _c(low) + span * (_c(q).cast("double") / float((1 << bits) - 1))


def pack24(q) -> Column:
    """Three little-endian bytes of a 24-bit integer."""
    return F.array(*[F.shiftright(_c(q), s).bitwiseAND(F.lit(0xFF)).cast("int") for s in (0, 8, 16)])


def unpack24(b) -> Column:
    b = _c(b)
    return b[0].cast("long") + b[1] * 256 + b[2] * 65536


def normalise_quaternion(w, x, y, z) -> list[Column]:
    """Unit quaternion; the zero quaternion becomes the identity."""
    parts = [_c(v).cast("double") for v in (w, x, y, z)]
    norm = F.sqrt(sum((p * p for p in parts[1:]), parts[0] * parts[0]))
    return [F.when(norm > 0, p / norm).otherwise(F.lit(1.0 if k == 0 else 0.0)) for k, p in enumerate(parts)]


def largest_component(q: Sequence[Column]) -> Column:
    size = [F.abs(_c(v)) for v in q]
    top = F.greatest(*size)
    return F.when(size[0] == top, 0).when(size[1] == top, 1).when(size[2] == top, 2).otherwise(3)


def pack_quaternion(q: Sequence) -> list[Column]:
    """Smallest-three form: three 16-bit integers and the index of the component left out."""
    q = [_c(v) for v in q]
    m = largest_component(q)
    sign = F.signum(F.when(m == 0, q[0]).when(m == 1, q[1]).when(m == 2, q[2]).otherwise(q[3]))
    out = []
    for k in range(3):
        rest = [[v for j, v in enumerate(q) if j != i][k] for i in range(4)]
        value = F.when(m == 0, rest[0]).when(m == 1, rest[1]).when(m == 2, rest[2]).otherwise(rest[3]) * sign
        out.append(clamp(F.rint((value * SQRT2 + 1.0) / 2.0 * 65535.0), 0.0, 65535.0).cast("long"))
    return [*out, m.cast("long")]


def unpack_quaternion(p: Sequence) -> list[Column]:
    a = [(_c(v).cast("double") / 65535.0 * 2.0 - 1.0) / SQRT2 for v in p[:3]]
    m = _c(p[3])
    left = F.sqrt(F.greatest(F.lit(0.0), 1.0 - a[0] * a[0] - a[1] * a[1] - a[2] * a[2]))
    q = [F.when(m == k, left).when(m < k, a[max(k - 1, 0)]).otherwise(a[min(k, 2)]) for k in range(4)]
    norm = F.sqrt(q[0] * q[0] + q[1] * q[1] + q[2] * q[2] + q[3] * q[3])
    return [v / norm for v in q]


def rotation_angle(a: Sequence, b: Sequence) -> Column:
    """Angle between two unit quaternions, from the vector part of their relative rotation."""
    a, b = [_c(v) for v in a], [_c(v) for v in b]
    w = a[0] * b[0] + a[1] * b[1] + a[2] * b[2] + a[3] * b[3]
    x = b[0] * a[1] - a[0] * b[1] - (a[2] * b[3] - a[3] * b[2])
    y = b[0] * a[2] - a[0] * b[2] - (a[3] * b[1] - a[1] * b[3])
    z = b[0] * a[3] - a[0] * b[3] - (a[1] * b[2] - a[2] * b[1])
    return 2.0 * F.atan2(F.sqrt(x * x + y * y + z * z), F.abs(w))


def inverse_log(v) -> Column:
    return F.signum(_c(v)) * F.expm1(F.abs(_c(v)))


def logit(p, least: float = 1e-6) -> Column:
    x = clamp(_c(p).cast("double"), least, 1.0 - least)
    return F.log(x / (1.0 - x))


#: Factors of the real spherical harmonics of degrees 0 to 3 (fixed values).
SH0 = 0.28209479177387814
SH1 = 0.4886025119029199
SH2 = (1.0925484305920792, -1.0925484305920792, 0.31539156525252005, -1.0925484305920792, 0.5462742152960396)
SH3 = (-0.5900435899266435, 2.890611442640554, -0.4570457994644658, 0.3731763325901154, -0.4570457994644658, 1.445305721320277, -0.5900435899266435)


def sh_basis(x, y, z, degree: int) -> list[Column]:
    """Basis values beyond degree 0 in a unit direction."""
    x, y, z = _c(x), _c(y), _c(z)
    out: list[Column] = []
    if degree >= 1:
        out += [-SH1 * y, SH1 * z, -SH1 * x]
    if degree >= 2:
        xx, yy, zz = x * x, y * y, z * z
        out += [SH2[0] * x * y, SH2[1] * y * z, SH2[2] * (2.0 * zz - xx - yy), SH2[3] * x * z, SH2[4] * (xx - yy)]
        if degree >= 3:
            out += [
                SH3[0] * y * (3.0 * xx - yy), SH3[1] * x * y * z, SH3[2] * y * (4.0 * zz - xx - yy), SH3[3] * z * (2.0 * zz - 3.0 * xx - 3.0 * yy),
                SH3[4] * x * (4.0 * zz - xx - yy), SH3[5] * z * (xx - yy), SH3[6] * x * (xx - 3.0 * yy),
            ]
    return out


def sh_colour(dc, rest: Sequence, x, y, z, degree: int) -> Column:
    """One channel's colour in a unit direction, not below zero."""
    total = 0.5 + SH0 * _c(dc)
    for b, c in zip(sh_basis(x, y, z, degree), rest, strict=True):
        total = total + b * _c(c)
    return F.greatest(total, F.lit(0.0))


def keep_fraction(pixels, target: float = 1.5, least: float = 0.1) -> Column:
    """Share of a chunk's splats to draw, in steps of a quarter octave."""
    f = clamp(F.pow(_c(pixels) / target, F.lit(2.0)), least, 1.0)
    return clamp(F.pow(F.lit(2.0), F.floor(4.0 * F.log2(f) + 0.5) / 4.0), least, 1.0)


def keep_count(n, fraction) -> Column:
    return F.when(_c(fraction) >= 1, _c(n)).otherwise(F.greatest(F.lit(1), F.ceil(_c(n) * _c(fraction))))


#: Masks of the steps that spread 21 bits to every third bit (fixed values).
_SPREAD = ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249))


def spread_bits(v) -> Column:
    x = _c(v).cast("long").bitwiseAND(F.lit(0x1FFFFF))
    for shift, mask in _SPREAD:
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask))
    return x


def morton(x, y, z) -> Column:
    """63-bit code of three 21-bit integers."""
    return spread_bits(x).bitwiseOR(F.shiftleft(spread_bits(y), 1)).bitwiseOR(F.shiftleft(spread_bits(z), 2))
