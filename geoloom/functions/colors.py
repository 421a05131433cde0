"""Colour arithmetic on byte bands as columns; every result is held to 0..255 and truncated."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_byte(v: Column) -> Column:
    return F.floor(F.least(F.greatest(v, F.lit(0.0)), F.lit(255.0))).cast("int")


def _extremes(r: Column, g: Column, b: Column) -> tuple[Column, ...]:
    r, g, b = (c.cast("double") / 255.0 for c in (r, g, b))
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    return r, g, b, top, low, top - low


def _hue(r: Column, g: Column, b: Column, top: Column, delta: Column) -> Column:
    """Degrees from red; 0 for greys.  Ties go to red, then green."""
    d = F.when(delta == 0, 1.0).otherwise(delta)
    turn = F.when(top == r, ((g - b) / d + 6.0) % 6.0).when(top == g, (b - r) / d + 2.0).otherwise((r - g) / d + 4.0)
    return F.when(delta == 0, 0.0).otherwise(turn * 60.0)


def rgb_to_hsl(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    r, g, b, top, low, delta = _extremes(r, g, b)
    light = (top + low) / 2.0
    spread = F.when(light > 0.5, 2.0 - top - low).otherwise(top + low)
    s = F.when(delta == 0, 0.0).otherwise(delta / F.when(delta == 0, 1.0).otherwise(spread))
    return _hue(r, g, b, top, delta), s, light


def rgb_to_hsv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    r, g, b, top, _, delta = _extremes(r, g, b)
    s = F.when(top == 0, 0.0).otherwise(delta / F.when(top == 0, 1.0).otherwise(top))
    return _hue(r, g, b, top, delta), s, top


def _from_chroma(h: Column, c: Column, m: Column) -> tuple[Column, Column, Column]:
    x = c * (1.0 - F.abs((h / 60.0) % 2.0 - 1.0))
    zero = F.lit(0.0)
    #: For each sixth of the circle, which of chroma, middle and zero goes to red, green and blue.
    wheel = ((c, x, zero), (x, c, zero), (zero, c, x), (zero, x, c), (x, zero, c), (c, zero, x))
    out = []
    for k in range(3):
        pick = F.when(h < 60, wheel[0][k])
        for n in range(1, 5):
            pick = pick.when(h < 60 * (n + 1), wheel[n][k])
        out.append((pick.otherwise(wheel[5][k]) + m) * 255.0)
    return tuple(out)


def hsl_to_rgb(h: Column, s: Column, light: Column) -> tuple[Column, Column, Column]:
    c = (1.0 - F.abs(2.0 * light - 1.0)) * s
    return _from_chroma(h, c, light - c / 2.0)


def hsv_to_rgb(h: Column, s: Column, v: Column) -> tuple[Column, Column, Column]:
    c = v * s
    return _from_chroma(h, c, v - c)


@dataclass(frozen=True)
class Adjust:
    """Brightness, contrast and saturation from -1 to 1, gamma above 0, hue in degrees."""

    brightness: float = 0.0
    contrast: float = 0.0
    saturation: float = 0.0
    gamma: float = 1.0
    hue: float = 0.0


#: The named looks.
PRESETS = {
    "vivid": [Adjust(0.05, 0.15, 0.3, 1.1, 0)],
    "soft": [Adjust(0.02, -0.1, -0.15, 1.05, 0)],
    "high_contrast": [Adjust(0, 0.4, 0.1, 1.0, 0)],
    "warm": [Adjust(0.03, 0.05, 0.1, 1.0, 15)],
    "cool": [Adjust(0, 0.05, 0.05, 1.0, -15)],
    "black_white": [Adjust(0, 0.1, -1.0, 1.0, 0)],
    "sepia": [Adjust(0, 0.1, -1.0, 1.0, 0), Adjust(0.05, 0, 0.3, 1.0, 30)],
}


def lookup(table: list[int], v: Column) -> Column:
    """A 256-entry table as an array literal, so that it folds into the plan."""
    return F.get(F.array(*[F.lit(int(x)) for x in table]), v.cast("int"))


def _clip(v: float) -> int:
    return int(min(max(v, 0.0), 255.0))


def gamma_table(gamma: float) -> list[int]:
    return [_clip((i / 255.0) ** (1.0 / gamma) * 255.0) for i in range(256)]


def levels_table(in_low=0.0, in_high=255.0, midtone=1.0, out_low=0.0, out_high=255.0) -> list[int]:
    out = []
    for i in range(256):
        share = 0.0 if i <= in_low else 1.0 if i >= in_high else (i - in_low) / (in_high - in_low)
        out.append(_clip(out_low + share ** (1.0 / midtone) * (out_high - out_low)))
    return out


def curve_table(points: list[tuple[float, float]]) -> list[int]:
    """Catmull-Rom through the control points, flat beyond them; fewer than two points change nothing."""
    if len(points) < 2:
        return list(range(256))
    xs, ys = zip(*sorted(points), strict=True)
    last = len(xs) - 1
    out = []
    for i in range(256):
        if i <= xs[0] or i >= xs[last]:
            out.append(_clip(ys[0] if i <= xs[0] else ys[last]))
            continue
        k = next(k for k in range(last) if xs[k] <= i <= xs[k + 1])
        p = [ys[max(k - 1, 0)], ys[k], ys[k + 1], ys[min(k + 2, last)]]
        t = (i - xs[k]) / (xs[k + 1] - xs[k])
        slope_in, slope_out = (p[2] - p[0]) / 2, (p[3] - p[1]) / 2
        # the cubic with these values and slopes at both ends
        rise = p[2] - p[1]
        cubic, square = slope_in + slope_out - 2 * rise, 3 * rise - 2 * slope_in - slope_out
        out.append(_clip(p[1] + t * (slope_in + t * (square + t * cubic))))
    return out


def s_curve_points(strength: float) -> list[tuple[float, float]]:
    hold = lambda v: min(max(v, 0.0), 255.0)
    return [(0, 0), (64, hold(64 - 32 * strength)), (128, 128), (192, hold(192 + 32 * strength)), (255, 255)]


def adjust(r: Column, g: Column, b: Column, p: Adjust) -> tuple[Column, Column, Column]:
    """Brightness, contrast, gamma, then saturation and hue; bytes in, bytes out."""
    gain = 1.0 + p.contrast * (2.0 if p.contrast >= 0 else 1.0)
    bands = [((c.cast("double") + p.brightness * 255.0) - 128.0) * gain + 128.0 for c in (r, g, b)]
    if p.gamma != 1.0 and p.gamma > 0:
        table = gamma_table(p.gamma)
        bands = [lookup(table, to_byte(c)).cast("double") for c in bands]
    if p.saturation or p.hue:
        h, s, light = rgb_to_hsl(*[F.least(F.greatest(c, F.lit(0.0)), F.lit(255.0)) for c in bands])
        s = s + (1.0 - s) * p.saturation if p.saturation >= 0 else s * (1.0 + p.saturation)
        s = F.least(F.greatest(s, F.lit(0.0)), F.lit(1.0))
        bands = hsl_to_rgb((h + p.hue + 360.0) % 360.0, s, light)
    return tuple(to_byte(c) for c in bands)


def preset(name: str, r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    for p in PRESETS[name]:
        r, g, b = adjust(r, g, b, p)
    return r, g, b


def unsharp(amount: float) -> Adjust:
    """Sharpening as contrast and a little saturation."""
    return Adjust(contrast=amount * 0.3, saturation=amount * 0.1)
