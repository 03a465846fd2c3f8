"""Colour spaces as column expressions, on 0..255 channels, with the 8-bit rounding of common image libraries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: sRGB to XYZ (D65), rows scaled by the white point, and the inverse of the unscaled matrix: fixed values.
WHITE = (0.950456, 1.0, 1.088754)
TO_XYZ = ((0.412453, 0.357580, 0.180423), (0.212671, 0.715160, 0.072169), (0.019334, 0.119193, 0.950227))
TO_RGB = ((3.240479, -1.537150, -0.498535), (-0.969256, 1.875991, 0.041556), (0.055648, -0.204043, 1.057311))


def gray(r: Column, g: Column, b: Column) -> Column:
    """Luma in 0..255 by 14-bit fixed-point weights."""
    return F.shiftright(r * 4899 + g * 9617 + b * 1868 + 8192, 14)


def hsv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Hue 0..179 (half degrees), saturation and value 0..255; hue 0 where there is none."""
    high, low = F.greatest(r, g, b), F.least(r, g, b)
    span = high - low
    turn = F.when(span == 0, 0.0).when(high == r, 60.0 * (g - b) / span).when(high == g, 120.0 + 60.0 * (b - r) / span).otherwise(240.0 + 60.0 * (r - g) / span)
    h = F.floor(F.when(turn < 0, turn + 360.0).otherwise(turn) / 2 + 0.5).cast("int") % 180
    s = F.when(high == 0, 0).otherwise(F.floor(255.0 * span / high + 0.5).cast("int"))
    return h, s, high


def _linear(c: Column) -> Column:
    u = c / 255.0
    return F.when(u > 0.04045, F.pow((u + 0.055) / 1.055, F.lit(2.4))).otherwise(u / 12.92)


def lab8(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """CIELAB quantised to 8 bits: L scaled by 255/100, a and b shifted by 128."""
    lin = [_linear(c) for c in (r, g, b)]
    f = []
    for row, white in zip(TO_XYZ, WHITE, strict=True):
        t = (row[0] * lin[0] + row[1] * lin[1] + row[2] * lin[2]) / white
        f.append((t, F.when(t > 0.008856, F.cbrt(t)).otherwise(7.787 * t + 16.0 / 116.0)))
    light = F.when(f[1][0] > 0.008856, 116.0 * f[1][1] - 16.0).otherwise(903.3 * f[1][0])
    clip = lambda v: F.least(F.greatest(F.floor(v + 0.5), F.lit(0)), F.lit(255)).cast("int")
    return clip(light * 2.55), clip(500.0 * (f[0][1] - f[1][1]) + 128.0), clip(200.0 * (f[1][1] - f[2][1]) + 128.0)


def lab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """CIELAB in its own units, from the quantised one."""
    light, a, bb = lab8(r, g, b)
    return light * (100.0 / 255.0), a - 128.0, bb - 128.0


def lab_to_rgb(light: Column, a: Column, b: Column) -> tuple[Column, Column, Column]:
    """8-bit RGB of a CIELAB colour that is quantised to 8 bits first."""
    q = [F.least(F.greatest(F.rint(v), F.lit(0.0)), F.lit(255.0)) for v in (light * 2.55, a + 128.0, b + 128.0)]
    fy = (q[0] / 2.55 + 16.0) / 116.0
    back = lambda t: F.when(t > 6.0 / 29.0, t * t * t).otherwise((t - 16.0 / 116.0) / 7.787)
    xyz = [back(fy + (q[1] - 128.0) / 500.0) * WHITE[0], back(fy), back(fy - (q[2] - 128.0) / 200.0) * WHITE[2]]
    out = []
    for row in TO_RGB:
        v = row[0] * xyz[0] + row[1] * xyz[1] + row[2] * xyz[2]
        c = F.when(v > 0.0031308, 1.055 * F.pow(F.greatest(v, F.lit(0.0)), F.lit(1 / 2.4)) - 0.055).otherwise(12.92 * v)
        out.append(F.least(F.greatest(F.floor(255.0 * c + 0.5), F.lit(0)), F.lit(255)).cast("int"))
    return out[0], out[1], out[2]


def delta_e(one: tuple[Column, Column, Column], two: tuple[Column, Column, Column]) -> Column:
    """CIE76 distance."""
    return F.sqrt(sum(((x - y) * (x - y) for x, y in zip(one, two, strict=True)), F.lit(0.0)))
