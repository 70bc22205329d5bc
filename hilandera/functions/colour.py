"""Colour arithmetic as column expressions: hex, RGB, HSL, brightness, interpolation, word colours."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hilandera import constants as C

BACKGROUND_LIGHTNESS = 6.7


def hex_to_rgb(colour: Column) -> Column:
    """struct(r, g, b) of #rgb or #rrggbb."""
    h = F.regexp_replace(colour, "#", "")
    h = F.when(F.length(h) == 3, F.regexp_replace(h, "(.)", "$1$1")).otherwise(h)
    part = lambda at: F.conv(F.substring(h, at, 2), 16, 10).cast("int")
    return F.struct(part(1).alias("r"), part(3).alias("g"), part(5).alias("b"))


def rgb_to_hsl(rgb: Column) -> Column:
    """struct(h in degrees, s and l in per cent)."""
    r, g, b = (rgb[k] / 255 for k in "rgb")
    high, low = F.greatest(r, g, b), F.least(r, g, b)
    d, light = high - low, (high + low) / 2
    hue = F.when(high == r, (g - b) / d + F.when(g < b, 6).otherwise(0)).when(high == g, (b - r) / d + 2).otherwise((r - g) / d + 4) / 6
    saturation = F.when(light > 0.5, d / (2 - high - low)).otherwise(d / (high + low))
    grey = d == 0
    zero = F.lit(0.0)
    return F.struct(F.when(grey, zero).otherwise(hue * 360).alias("h"), F.when(grey, zero).otherwise(saturation * 100).alias("s"), (light * 100).alias("l"))


def _channel(p: Column, q: Column, t: Column) -> Column:
    t = F.when(t < 0, t + 1).when(t > 1, t - 1).otherwise(t)
    return F.when(t < 1 / 6, p + (q - p) * 6 * t).when(t < 0.5, q).when(t < 2 / 3, p + (q - p) * (2 / 3 - t) * 6).otherwise(p)


def hsl_to_rgb(hsl: Column) -> Column:
    h, s, light = hsl["h"] / 360, hsl["s"] / 100, hsl["l"] / 100
    q = F.when(light < 0.5, light * (1 + s)).otherwise(light + s - light * s)
    p = 2 * light - q
    out = [F.floor(F.when(s == 0, light).otherwise(_channel(p, q, h + d)) * 255 + 0.5).cast("int") for d in (1 / 3, 0.0, -1 / 3)]
    return F.struct(*(c.alias(k) for c, k in zip(out, "rgb", strict=True)))


def at_brightness(hsl: Column, brightness: Column) -> Column:
    """RGB of a colour between the background (0) and itself (1)."""
    to = F.greatest(hsl["l"], F.lit(20.0))
    light = BACKGROUND_LIGHTNESS + (to - BACKGROUND_LIGHTNESS) * brightness
    return hsl_to_rgb(F.struct(hsl["h"].alias("h"), (hsl["s"] * (0.3 + brightness * 0.7)).alias("s"), light.alias("l")))


def between_hsl(a: Column, b: Column, t: Column) -> Column:
    """The colour at t between a and b, by the shorter way around the hues."""
    d = b["h"] - a["h"]
    h = a["h"] + F.when(d > 180, d - 360).when(d < -180, d + 360).otherwise(d) * t
    h = F.when(h < 0, h + 360).when(h >= 360, h - 360).otherwise(h)
    return F.struct(h.alias("h"), (a["s"] + (b["s"] - a["s"]) * t).alias("s"), (a["l"] + (b["l"] - a["l"]) * t).alias("l"))


def between_rgb(a: Column, b: Column, t: Column) -> Column:
    return F.struct(*(F.floor(a[k] + (b[k] - a[k]) * t + 0.5).cast("int").alias(k) for k in "rgb"))


def polarity_rgb(polarity: Column) -> Column:
    """From neutral to positive or negative, in full at a quarter of the scale."""
    neutral, up, down = (hex_to_rgb(F.lit(c)) for c in (C.NEUTRAL, C.POSITIVE, C.NEGATIVE))
    t = F.least(F.lit(1.0), F.abs(polarity) * 4)
    return F.when(polarity > 0.05, between_rgb(neutral, up, t)).when(polarity < -0.05, between_rgb(neutral, down, t)).otherwise(neutral)


def polarity_colour(polarity: Column) -> Column:
    return F.when(polarity > 0.05, C.POSITIVE).when(polarity < -0.05, C.NEGATIVE).otherwise(C.NEUTRAL)


def palette(number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, C.PALETTE)), (F.pmod(number, F.lit(len(C.PALETTE))) + 1).cast("int"))
