"""Colour spaces of 8-bit BGR pixels as column expressions, in 8-bit conventions: hue 0..179, L scaled to 255, a and b shifted by 128."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = ("bgr", "lab", "hsv", "luv", "hls", "yuv")
# sRGB to XYZ under D65, its white point, and the luma weights.
_XYZ = ((0.412453, 0.357580, 0.180423), (0.212671, 0.715160, 0.072169), (0.019334, 0.119193, 0.950227))
_WHITE = (0.950456, 1.0, 1.088754)
_LUMA = (0.299, 0.587, 0.114)


def _byte(v: Column) -> Column:
    return F.least(F.greatest(F.bround(v, 0), F.lit(0.0)), F.lit(255.0)).cast("int")


def _linear(c: Column) -> Column:
    s = c / F.lit(255.0)
    return F.when(s <= 0.04045, s / 12.92).otherwise(F.pow((s + 0.055) / 1.055, F.lit(2.4)))


def _xyz(b: Column, g: Column, r: Column) -> list[Column]:
    rgb = [_linear(c) for c in (r, g, b)]
    return [sum((F.lit(w) * c for w, c in zip(row[1:], rgb[1:])), F.lit(row[0]) * rgb[0]) for row in _XYZ]


def _lightness(y: Column) -> Column:
    return F.when(y > 0.008856, F.pow(y, F.lit(1 / 3)) * 116 - 16).otherwise(y * 903.3)


def lab(b: Column, g: Column, r: Column) -> list[Column]:
    x, y, z = (v / w for v, w in zip(_xyz(b, g, r), _WHITE))
    f = lambda v: F.when(v > 0.008856, F.pow(v, F.lit(1 / 3))).otherwise(v * 7.787 + 16 / 116)
    return [_byte(_lightness(y) * (255 / 100)), _byte((f(x) - f(y)) * 500 + 128), _byte((f(y) - f(z)) * 200 + 128)]


def luv(b: Column, g: Column, r: Column) -> list[Column]:
    x, y, z = _xyz(b, g, r)
    light = _lightness(y)
    sum_ = x + y * 15 + z * 3
    d = F.when(sum_ > 0, sum_)
    wx, wy, wz = _WHITE
    un, vn = 4 * wx / (wx + 15 * wy + 3 * wz), 9 * wy / (wx + 15 * wy + 3 * wz)
    u = F.coalesce(light * 13 * (x * 4 / d - un), F.lit(0.0))
    v = F.coalesce(light * 13 * (y * 9 / d - vn), F.lit(0.0))
    return [_byte(light * (255 / 100)), _byte((u + 134) * (255 / 354)), _byte((v + 140) * (255 / 262))]


def _hue(b: Column, g: Column, r: Column, top: Column, span: Column) -> Column:
    d = F.when(span > 0, span)
    h = F.when(top == r, (g - b) * 60.0 / d).when(top == g, (b - r) * 60.0 / d + 120).otherwise((r - g) * 60.0 / d + 240)
    h = F.coalesce(h, F.lit(0.0))
    return F.pmod(F.bround(F.when(h < 0, h + 360).otherwise(h) / 2, 0).cast("int"), F.lit(180))


def hsv(b: Column, g: Column, r: Column) -> list[Column]:
    top, low = F.greatest(b, g, r), F.least(b, g, r)
    return [_hue(b, g, r, top, top - low), _byte(F.coalesce((top - low) * 255.0 / F.when(top > 0, top), F.lit(0.0))), top.cast("int")]


def hls(b: Column, g: Column, r: Column) -> list[Column]:
    top, low = F.greatest(b, g, r), F.least(b, g, r)
    span, both = top - low, top + low
    sat = F.when(both < 255, span * 255.0 / F.when(both > 0, both)).otherwise(span * 255.0 / F.when(both < 510, F.lit(510) - both))
    return [_hue(b, g, r, top, span), _byte(both / 2), _byte(F.coalesce(sat, F.lit(0.0)))]


def yuv(b: Column, g: Column, r: Column) -> list[Column]:
    y = r * _LUMA[0] + g * _LUMA[1] + b * _LUMA[2]
    return [_byte(y), _byte((b - y) * 0.492 + 128), _byte((r - y) * 0.877 + 128)]


def spaces(b: Column, g: Column, r: Column) -> dict[str, list[Column]]:
    """Every space's three channels."""
    return {"bgr": [b.cast("int"), g.cast("int"), r.cast("int")], "lab": lab(b, g, r), "hsv": hsv(b, g, r), "luv": luv(b, g, r), "hls": hls(b, g, r), "yuv": yuv(b, g, r)}


def combine(weights: dict[str, list[float]], b: Column, g: Column, r: Column) -> Column:
    """Weighted sum of channels; all-zero weights are left out, a trailing 2 in a space's name is ignored here (see split_weights)."""
    have = spaces(b, g, r)
    terms = [have[s][i] * F.lit(float(w)) for s, ws in weights.items() for i, w in enumerate(ws) if w]
    if not terms:
        raise ValueError("no channel has a weight")
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total.cast("double")


def split_weights(weights: dict[str, list[float] | str]) -> tuple[dict[str, list[float]], dict[str, list[float]], list[str]]:
    """(first image's weights, second image's, spaces used); names that end with 2 belong to the second."""
    first: dict[str, list[float]] = {}
    second: dict[str, list[float]] = {}
    for name, w in weights.items():
        if isinstance(w, str) or not any(w):
            continue
        if name.endswith("2"):
            second[name[:-1]] = list(w)
        else:
            first[name] = list(w)
    return first, second, list(dict.fromkeys([*first, *second]))
