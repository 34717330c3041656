"""Column expressions: names, types, colours, boxes. All stay in the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File extensions by payload type (fixed values). A PNG is an image; label maps are declared, never inferred.
EXTENSIONS = {
    "image": ["png", "jpg", "jpeg", "bmp", "tif", "tiff", "webp"],
    "array": ["npy"],
    "attr": ["txt", "json"],
    "rle": ["rle"],
}


def extract_stem(name: Column, pattern: str) -> Column:
    """SRC-STEM: what the first ``*`` of the pattern matched; without one, the name less its extension.

    Null when the name doesn't fit the pattern's ends.
    """
    if "*" not in pattern:
        return F.regexp_replace(name, r"\.[^.]*$", "")
    head, _, tail = pattern.partition("*")
    tail = tail.replace("*", "")
    fits = name.startswith(head) & name.endswith(tail) & (F.length(name) >= len(head) + len(tail))
    return F.when(fits, F.substring(name, F.lit(len(head) + 1), F.length(name) - len(head) - len(tail)))


def file_extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))


def infer_type(ext: Column, strict: bool = False) -> Column:
    """SRC-TYPE: payload type of an extension (leading dots and case don't matter); null, or an error if strict."""
    plain = F.lower(F.regexp_replace(ext, r"^\.+", ""))
    out = F.when(plain.isin([]), F.lit(None).cast("string"))
    for kind, names in EXTENSIONS.items():
        out = out.when(plain.isin(names), kind)
    return F.coalesce(out, F.raise_error(F.concat(F.lit("unknown file extension: "), ext)).cast("string")) if strict else out


def rounded(c: Column, digits: int = 6) -> Column:
    """Rounded for comparison; never a negative zero."""
    return F.round(c, digits) + F.lit(0.0)


def clip(c: Column, low, high) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def channel_delta(v: Column, mu: Column, circular: bool, period: int) -> Column:
    """PX-DELTA: signed difference, or the shorter way round."""
    d = v - mu
    return F.least(F.abs(d), F.lit(period) - F.abs(d)) if circular else d


def bgr_to_hsv(b: Column, g: Column, r: Column) -> tuple[Column, Column, Column]:
    """PX-CHROMA: 8-bit hue 0..179, saturation and value 0..255."""
    top, low = F.greatest(b, g, r), F.least(b, g, r)
    d = (top - low).cast("double")
    safe = F.when(d == 0, 1.0).otherwise(d)
    h = F.when(d == 0, 0.0).when(top == r, 60 * (g - b) / safe).when(top == g, 120 + 60 * (b - r) / safe).otherwise(240 + 60 * (r - g) / safe)
    h = F.when(h < 0, h + 360).otherwise(h)
    s = F.when(top == 0, 0.0).otherwise(255 * d / F.greatest(top, F.lit(1)))
    return F.floor(h / 2 + 0.5).cast("int") % 180, F.floor(s + 0.5).cast("int"), top.cast("int")


def hsv_to_bgr(h: Column, s: Column, v: Column) -> tuple[Column, Column, Column]:
    """PX-CHROMA-INV for hsv."""
    c = v * s / 255.0
    h6 = h * 2 / 60.0
    x = c * (1 - F.abs(F.pmod(h6, F.lit(2.0)) - 1))
    m = v - c
    k = F.floor(h6).cast("int") % 6
    zero = F.lit(0.0)
    pick = lambda six: F.element_at(F.array(*six), k + 1)
    r, g, b = pick([c, x, zero, zero, x, c]), pick([x, c, c, x, zero, zero]), pick([zero, zero, x, c, c, x])
    out = lambda u: F.floor(u + m + 0.5).cast("int")
    return out(b), out(g), out(r)


def _linear(c: Column) -> Column:
    u = c / 255.0
    return F.when(u <= 0.04045, u / 12.92).otherwise(F.pow((u + 0.055) / 1.055, F.lit(2.4)))


def bgr_to_lab_ab(b: Column, g: Column, r: Column) -> tuple[Column, Column]:
    """PX-CHROMA for lab: the 8-bit a and b channels (sRGB, D65)."""
    bl, gl, rl = _linear(b), _linear(g), _linear(r)
    x = (0.412453 * rl + 0.357580 * gl + 0.180423 * bl) / 0.950456
    y = 0.212671 * rl + 0.715160 * gl + 0.072169 * bl
    z = (0.019334 * rl + 0.119193 * gl + 0.950227 * bl) / 1.088754
    f = lambda t: F.when(t > 0.008856, F.cbrt(t)).otherwise(7.787 * t + 16.0 / 116)
    out = lambda u: clip(F.floor(u + 128 + 0.5), 0, 255).cast("int")
    return out(500 * (f(x) - f(y))), out(200 * (f(y) - f(z)))


def lab_ab_to_bgr(a: Column, b: Column, light: int = 128) -> tuple[Column, Column, Column]:
    """PX-CHROMA-INV for lab: the colour of 8-bit a and b at a fixed brightness; what lies outside of the cube of colours is cut at its sides."""
    fy = F.lit((light * 100 / 255 + 16) / 116)
    t = [fy + (a - 128) / 500.0, fy, fy - (b - 128) / 200.0]
    x, y, z = (F.when(u * u * u > 0.008856, u * u * u).otherwise((u - 16.0 / 116) / 7.787) for u in t)
    x, z = x * 0.950456, z * 1.088754
    linear = [0.055648 * x - 0.204043 * y + 1.057311 * z, -0.969256 * x + 1.875991 * y + 0.041556 * z, 3.240479 * x - 1.537150 * y - 0.498535 * z]
    curve = lambda u: F.when(u <= 0.0031308, 12.92 * u).otherwise(1.055 * F.pow(F.greatest(u, F.lit(0.0)), F.lit(1 / 2.4)) - 0.055)
    return tuple(clip(F.floor(255 * curve(u) + 0.5), 0, 255).cast("int") for u in linear)


def normalize_color(b: Column, g: Column, r: Column, value: int = 255) -> tuple[Column, Column, Column]:
    """PX-NORM: the colour at a fixed brightness."""
    h, s, _ = bgr_to_hsv(b, g, r)
    return hsv_to_bgr(h, s, F.lit(value))


def palette_hue(idx: Column) -> Column:
    """PX-PALETTE: hues a golden ratio apart."""
    return F.floor(idx * 180 * F.lit((math.sqrt(5) - 1) / 2)).cast("int") % 180


def signed_log1p(c: Column) -> Column:
    return F.signum(c) * F.log1p(F.abs(c))


def scaled_box(x0: Column, y0: Column, x1: Column, y1: Column, gap: float, w: int, h: int) -> tuple[Column, ...]:
    """A box scaled by ``1 + gap`` about its centre, within the image: each side moves by half of the gap's extent."""
    dx, dy = (x1 - x0) * gap / 2, (y1 - y0) * gap / 2
    return F.greatest(x0 - dx, F.lit(0.0)), F.greatest(y0 - dy, F.lit(0.0)), F.least(x1 + dx, F.lit(float(w))), F.least(y1 + dy, F.lit(float(h)))


def hash_bucket(key: Column, total: int = 10_000) -> Column:
    """A portable bucket number: the first 8 hex digits of the md5 of the key as text, modulo ``total``."""
    return F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 8), 16, 10).cast("long") % total
