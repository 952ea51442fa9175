"""Pixel operators as column expressions; all stay in whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RGB = tuple[Column, Column, Column]


def clamp(v: Column, low: float, high: float | Column) -> Column:
    high = high if isinstance(high, Column) else F.lit(float(high))
    return F.greatest(F.lit(float(low)), F.least(v, high))


def black_subtract(v: Column, black: Column, white: Column) -> Column:
    return clamp(v - black, 0.0, F.least(white.cast("double"), F.lit(65535.0)))


def expose(v: Column, intensity: float, black: Column, white: Column) -> Column:
    return F.lit(float(intensity)) * v / (white - black)


def flip(y: Column, height: Column) -> Column:
    return height - 1 - y


def normalise(v: Column, bits: Column) -> Column:
    return v / F.pow(F.lit(2.0), bits)


def linearise(v: Column, table: list[float]) -> Column:
    """The table's entry for each sample; samples beyond it take the last one."""
    # one folded literal, not an expression for every entry
    entries = F.expr(f"array({', '.join(f'{float(t)!r}D' for t in table)})")
    return F.element_at(entries, clamp(v, 0.0, len(table) - 1.0).cast("int") + 1)


def display_gamma(v: Column, intensity: float = 1.0, gamma: float = 2.2) -> Column:
    return clamp(F.pow(F.greatest(v * F.lit(float(intensity)), F.lit(0.0)), F.lit(1.0 / gamma)), 0.0, 1.0)


def gamma8(v: Column) -> Column:
    return clamp(F.pow(v / 255.0, F.lit(1 / 2.2)), 0.0, 1.0)


def gamma16(v: Column) -> Column:
    return clamp(F.pow(v / 65536.0, F.lit(1 / 2.2)), 0.0, 1.0)


def to_rgb(samples: Column, spp: Column) -> Column:
    """One sample is repeated, of four the last is dropped."""
    one = F.element_at(samples, 1)
    return F.when(spp == 1, F.array(one, one, one)).when(spp.isin(3, 4), F.slice(samples, 1, 3))


def to_display(samples: Column, spp: Column, bits: Column, is_float: Column | None = None) -> Column:
    """``to_rgb`` with the gamma of the depth: 8 and 16 bits; 32-bit floats as they are; other depths are null."""
    rgb = to_rgb(samples, spp)
    plain = (bits == 32) & (is_float if is_float is not None else F.lit(False))
    return F.when(bits == 8, F.transform(rgb, gamma8)).when(bits == 16, F.transform(rgb, gamma16)).when(plain, rgb)


def matrix3(rgb: RGB, m: list[list[float]]) -> RGB:
    """Row vector times matrix."""
    return tuple(sum((rgb[i] * float(m[i][j]) for i in range(1, 3)), rgb[0] * float(m[0][j])) for j in range(3))


def invert3(m: list[list[float]]) -> list[list[float]]:
    (a, b, c), (d, e, f), (g, h, i) = m
    det = a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)
    if det == 0:
        raise ValueError("a singular matrix")
    return [[(e * i - f * h) / det, (c * h - b * i) / det, (b * f - c * e) / det], [(f * g - d * i) / det, (a * i - c * g) / det, (c * d - a * f) / det], [(d * h - e * g) / det, (b * g - a * h) / det, (a * e - b * d) / det]]


def multiply3(a: list[list[float]], b: list[list[float]]) -> list[list[float]]:
    return [[sum(a[i][k] * b[k][j] for k in range(3)) for j in range(3)] for i in range(3)]


#: XYZ (D65) to linear sRGB, and Bradford adaptation of D50 to D65.
XYZ_TO_SRGB = [[3.2404542, -1.5371385, -0.4985314], [-0.9692660, 1.8760108, 0.0415560], [0.0556434, -0.2040259, 1.0572252]]
D50_TO_D65 = [[0.9555766, -0.0230393, 0.0631636], [-0.0282895, 1.0099416, 0.0210077], [0.0122982, -0.0204830, 1.3299098]]


def camera_to_srgb(white_balance: list[float], color_matrix: list[list[float]]) -> list[list[float]]:
    """XYZ_TO_SRGB * D50_TO_D65 * inverse(diag(white_balance) * color_matrix)."""
    balanced = [[white_balance[i] * v for v in color_matrix[i]] for i in range(3)]
    return multiply3(multiply3(XYZ_TO_SRGB, D50_TO_D65), invert3(balanced))


#: A published camera pipeline's matrices for 3200 K and 7000 K; the fourth column is added.
WARM_3200 = [[2.2997, -0.4478, 0.1706, -39.0923], [-0.3826, 1.5906, -0.2080, -25.4311], [-0.0888, -0.7344, 2.2832, -20.0826]]
COOL_7000 = [[1.6697, -0.2693, -0.4004, -42.4346], [-0.3576, 1.0615, 1.5949, -37.1158], [-0.2175, -1.8751, 6.9640, -26.6970]]


def affine3(rgb: RGB, m: list[list[float]]) -> RGB:
    """3 x 4 matrix times column vector (r, g, b, 1)."""
    r, g, b = rgb
    return tuple(r * float(row[0]) + g * float(row[1]) + b * float(row[2]) + float(row[3]) for row in m)


def blend_by_temperature(kelvin: float, warm: list[list[float]] = WARM_3200, cool: list[list[float]] = COOL_7000, low: float = 3200.0, high: float = 7000.0, beyond: bool = False) -> list[list[float]]:
    """Linear in the inverse temperature between two matrices; ``beyond`` goes on outside of their temperatures."""
    t = (1 / (kelvin if beyond else min(max(kelvin, low), high)) - 1 / high) / (1 / low - 1 / high)
    return [[t * w + (1 - t) * c for w, c in zip(a, b)] for a, b in zip(warm, cool)]


def sepia(rgb: RGB, amount: float) -> RGB:
    r, g, b = rgb
    #: The common sepia weights.
    weights = ((0.393, 0.769, 0.189), (0.349, 0.686, 0.168), (0.272, 0.534, 0.131))
    out = []
    for k, row in enumerate(weights):
        own = [float(1 - amount * (1 - w)) if i == k else float(w * amount) for i, w in enumerate(row)]
        out.append(F.least(F.lit(1.0), r * own[0] + g * own[1] + b * own[2]))
    return tuple(out)


def hue_saturation(rgb: RGB, hue: float, saturation: float) -> RGB:
    """Rotation by ``hue`` times pi about the grey axis, then saturation in -1 to 1."""
    from math import cos, pi, sin, sqrt

    s, c = sin(hue * pi), cos(hue * pi)
    w = ((2 * c + 1) / 3, (-sqrt(3) * s - c + 1) / 3, (sqrt(3) * s - c + 1) / 3)
    r, g, b = rgb
    turned = (r * w[0] + g * w[1] + b * w[2], r * w[2] + g * w[0] + b * w[1], r * w[1] + g * w[2] + b * w[0])
    mean = (turned[0] + turned[1] + turned[2]) / 3.0
    factor = 1 - 1 / (1.001 - saturation) if saturation > 0 else -saturation
    return tuple(v + (mean - v) * float(factor) for v in turned)


def brightness_contrast(v: Column, brightness: float, contrast: float) -> Column:
    factor = 1 / (1 - contrast) if contrast > 0 else 1 + contrast
    return (v + float(brightness) - 0.5) * float(factor) + 0.5


def vibrance(rgb: RGB, amount: float) -> RGB:
    top, mean = F.greatest(*rgb), (rgb[0] + rgb[1] + rgb[2]) / 3.0
    amt = (top - mean) * float(-3 * amount)
    return tuple(v + (top - v) * amt for v in rgb)


def pseudo_color(v: Column) -> RGB:
    """Blue over cyan, green and yellow to red for 0 to 1."""
    t = clamp(v, 0.0, 1.0) * 4.0
    return F.when(t < 2, 0.0).otherwise(F.least(t - 2, F.lit(1.0))), F.when(t < 1, t).when(t < 3, 1.0).otherwise(4 - t), F.when(t < 1, 1.0).otherwise(F.greatest(2 - t, F.lit(0.0)))


def color_name(code: Column) -> Column:
    """Letters of the colour filter codes 0 to 6."""
    # no null index: element_at takes it for the last place
    return F.when(code.between(0, 6), F.element_at(F.array(*map(F.lit, "RGBCMYW")), code.cast("int") + 1)).otherwise("?")
