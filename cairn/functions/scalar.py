"""Scalar expressions over point attributes: coordinates, packed bits, colours, names.

Every function returns a Column, so plans stay in generated code; rounding is ``floor(x + 0.5)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def half_up(x: Column) -> Column:
    return F.floor(x + F.lit(0.5)).cast("long")


def clamp(x: Column, low, high) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


# coordinates


def world(q, scale: float, offset: float = 0.0) -> Column:
    """World coordinate of a quantised one."""
    return _c(q).cast("double") * F.lit(float(scale)) + F.lit(float(offset))


def quantise(v, scale: float, offset: float = 0.0) -> Column:
    return half_up((_c(v).cast("double") - F.lit(float(offset))) / F.lit(float(scale)))


def tick_unit(least_scale: float, extent: float) -> float:
    """Unit of tile ticks: the finest scale, or a billionth of the extent where that is coarser."""
    return max(least_scale, extent / 1e9)


def tile_ticks(v, low, unit: float) -> Column:
    return half_up((_c(v).cast("double") - _c(low).cast("double")) / F.lit(float(unit)))


def rotate(x, y, z, cx, cy, cz, axis: str, degrees: float) -> tuple[Column, Column, Column]:
    """Coordinates turned about a centre around one axis."""
    a = F.radians(F.lit(float(degrees)))
    s, c = F.sin(a), F.cos(a)
    dx, dy, dz = _c(x) - _c(cx), _c(y) - _c(cy), _c(z) - _c(cz)
    turned = {"x": (dx, dy * c - dz * s, dy * s + dz * c), "y": (dx * c + dz * s, dy, dz * c - dx * s), "z": (dx * c - dy * s, dx * s + dy * c, dz)}[axis]
    return tuple(t + _c(m) for t, m in zip(turned, (cx, cy, cz), strict=True))


def transform_point(matrix: Sequence[float], x, y, z) -> tuple[Column, Column, Column]:
    """A column-major 4x4 transform of a point, as meshes' nodes have it."""
    m = [float(v) for v in matrix]
    return tuple(F.lit(m[r]) * _c(x) + F.lit(m[4 + r]) * _c(y) + F.lit(m[8 + r]) * _c(z) + F.lit(m[12 + r]) for r in range(3))


# packed bits and integers


def class_code(raw) -> Column:
    """Class of the legacy record formats: the low five bits."""
    return _c(raw).bitwiseAND(F.lit(0x1F))


def remap_label(code, missing: int = 255) -> Column:
    return F.when(_c(code) == 0, F.lit(missing)).otherwise(_c(code))


def segment_of_byte(stored) -> Column:
    """Stored segments are one more than their id; 0 is none."""
    return F.when(_c(stored) > 0, _c(stored) - 1)


def return_bits(number, count) -> Column:
    return _c(number).bitwiseAND(F.lit(7)).bitwiseOR(F.shiftleft(_c(count).bitwiseAND(F.lit(7)), 3))


def scan_angle(v) -> Column:
    return clamp(_c(v), -128, 127)


#: Divisors of normalised integers by kind (fixed values).
NORMALISED = {"u8": 255, "u16": 65535, "i8": 127, "i16": 32767}


def normalised_integer(v, kind: str) -> Column:
    out = _c(v).cast("double") / F.lit(float(NORMALISED[kind]))
    return F.greatest(out, F.lit(-1.0)) if kind[0] == "i" else out


# colours


def colour_16_to_8(v) -> Column:
    return F.shiftright(_c(v), 8)


def colour_8_to_16(v) -> Column:
    return _c(v) * 257


def colour_unit_to_16(v) -> Column:
    return clamp(half_up(_c(v).cast("double") * 65535.0), 0, 65535)


def colour_unit_to_8(v) -> Column:
    return half_up(_c(v).cast("double") * 255.0)


def display_colour(v, largest) -> Column:
    """Eight bits for display: shifted only if the cloud's largest colour needs it, white if there is none."""
    return F.coalesce(F.when(_c(largest) > 255, F.shiftright(_c(v), 8)).otherwise(_c(v)), F.lit(255))


def class_blend(class_colour, original) -> Column:
    return _c(class_colour) * 0.75 + _c(original) * 0.25


def texel_index(u, size: int, wrap: str = "repeat") -> Column:
    """Texel of a texture coordinate under a wrap mode: repeat, mirror or clamp."""
    u = _c(u).cast("double")
    if wrap == "repeat":
        t = u - F.floor(u)
    elif wrap == "mirror":
        m = u - 2 * F.floor(u / 2)
        t = F.when(m > 1, 2 - m).otherwise(m)
    else:
        t = clamp(u, 0.0, 1.0)
    return F.least(F.floor(t * size).cast("int"), F.lit(size - 1))


def texture_sample(texels, u, v, width: int, height: int, wrap: str = "repeat") -> Column:
    """Element of a row-major array of texels; null outside."""
    return F.get(_c(texels), texel_index(v, height, wrap) * width + texel_index(u, width, wrap))


# feature values

MISSING_GREY = 0.8


def normalise_feature(v, low, high) -> Column:
    span = _c(high) - _c(low)
    return F.when(span > 0, (_c(v) - _c(low)) / span).otherwise(F.lit(0.5))


def normalise_class(v, high) -> Column:
    return F.when(_c(high) > 0, clamp(half_up(_c(v)) / _c(high), 0.0, 1.0)).otherwise(F.lit(0.5))


#: Colours at equal steps of the piecewise linear maps (fixed values).
RAMPS = {
    "bgyr": [(0.0, 0.0, 1.0), (0.0, 1.0, 0.0), (1.0, 1.0, 0.0), (1.0, 0.0, 0.0)],
    "viridis": [(0.267, 0.005, 0.329), (0.283, 0.141, 0.458), (0.163, 0.471, 0.558), (0.134, 0.659, 0.518), (0.478, 0.821, 0.318), (0.993, 0.906, 0.144)],
    "diverging": [(0.129, 0.4, 0.675), (0.969, 0.969, 0.969), (0.839, 0.376, 0.302)],
    "gray": [(0.0, 0.0, 0.0), (1.0, 1.0, 1.0)],
    "hot": [(0.0, 0.0, 0.0), (1.0, 0.0, 0.0), (1.0, 1.0, 0.0), (1.0, 1.0, 1.0)],
}


def colormap(t, name: str = "bgyr", clamped: bool = True) -> Column:
    """``[r, g, b]`` of a value in 0 to 1; grey where it is missing.

    Values outside count as the nearer end. If not ``clamped``, the last piece of the ramp goes on above 1, where channels
    may leave 0 to 1, and a ramp has no colour below 0.
    """
    x = _c(t).cast("double")
    x = clamp(x, 0.0, 1.0) if clamped else x
    if name == "jet":
        rgb = F.array(*[clamp(F.lit(1.5) - F.abs(4 * x - k), 0.0, 1.0) for k in (3, 2, 1)])
    else:
        ramp = RAMPS[name]
        steps = len(ramp) - 1
        at = F.least(F.floor(x * steps).cast("int"), F.lit(steps - 1))
        part = x * steps - at

        def channel(k: int) -> Column:
            a, b = (F.get(F.array(*[F.lit(c[k]) for c in colours]), at) for colours in (ramp[:-1], ramp[1:]))
            return a + (b - a) * part if clamped else F.when(at >= 0, a + (b - a) * part)

        rgb = F.array(*[channel(k) for k in range(3)])
    return F.when(_c(t).isNull(), F.array(*[F.lit(MISSING_GREY)] * 3)).otherwise(rgb)


def is_value(v, k: int) -> Column:
    """Discrete filter: the rounded value is k."""
    return half_up(_c(v)) == k


def is_finite(v) -> Column:
    return _c(v).isNotNull() & ~F.isnan(_c(v)) & (F.abs(_c(v)) < float("inf"))


# names


def feature_name(feature, radius) -> Column:
    return F.concat(_c(feature), F.lit("_"), F.regexp_replace(F.format_string("%.1f", _c(radius).cast("double")), r"\.", "_"))


def feature_of_name(name) -> Column:
    return F.regexp_extract(_c(name), r"^(.+)_(\d+_\d+)$", 1)


def radius_of_name(name) -> Column:
    return F.regexp_replace(F.regexp_extract(_c(name), r"^(.+)_(\d+_\d+)$", 2), "_", ".").try_cast("double")


#: Attributes that are no features, lower case (fixed values).
STANDARD_ATTRIBUTES = (
    "position", "rgb", "intensity", "return number", "number of returns", "classification", "classification flags",
    "scan direction flag", "edge of flight line", "scan angle rank", "scan angle", "scanner channel", "user data",
    "point source id", "gps-time", "gps time", "nir", "point_id", "pointid",
)


def is_feature(name) -> Column:
    return ~F.lower(_c(name)).isin(*STANDARD_ATTRIBUTES)


def safe_name(name) -> Column:
    return F.regexp_replace(F.regexp_replace(_c(name), "[^A-Za-z0-9_-]", "_"), "^_+|_+$", "")


def label_name(name) -> Column:
    return F.translate(_c(name), " .", "__")


def size_label(metres) -> Column:
    m = _c(metres).cast("double")
    return F.when(m >= 0.01, F.concat(half_up(m * 100).cast("string"), F.lit("cm"))).otherwise(F.concat(half_up(m * 1000).cast("string"), F.lit("mm")))
