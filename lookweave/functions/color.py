"""Colour expressions: RGB similarity and colour naming."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import dims
from .text import let


def _palette() -> Column:
    return F.array(*[
        F.struct(F.lit(n).alias("name"), *[F.lit(float(v)).alias(k) for k, v in zip("rgb", rgb)])
        for n, rgb in dims.COLOR_RGB.items()
    ])


def palette_in(text: Column) -> Column:
    """Named colours in ``text`` with their RGB values."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    return F.filter(_palette(), lambda c: F.contains(lowered, c["name"]))


def palette_similarity(have: Column, want: Column) -> Column:
    """Best similarity over all pairs of two palettes; a low floor when either is empty."""
    def pair(a: Column, b: Column) -> Column:
        square = sum(((a[k] - b[k]) * (a[k] - b[k]) for k in "rgb"), F.lit(0.0))
        return F.when(a["name"] == b["name"], F.lit(1.0)).otherwise(F.exp(-square / F.lit(2 * dims.COLOR_SIGMA ** 2)))

    best = F.array_max(F.flatten(F.transform(have, lambda a: F.transform(want, lambda b: pair(a, b)))))
    return F.coalesce(best, F.lit(dims.SIM["unknown_color"]))


def color_similarity(left: Column, right: Column) -> Column:
    """Similarity of two colour names: 1 when equal, 0 when one has no RGB value."""
    def entry(c: Column) -> Column:
        return F.try_element_at(F.filter(_palette(), lambda p: p["name"] == c), F.lit(1))

    a, b = entry(left), entry(right)
    square = sum(((a[k] - b[k]) * (a[k] - b[k]) for k in "rgb"), F.lit(0.0))
    return F.when(left == right, F.lit(1.0)).otherwise(
        F.coalesce(F.exp(-square / F.lit(2 * dims.COLOR_SIGMA ** 2)), F.lit(0.0))
    )


def _hue(r: Column, g: Column, b: Column) -> Column:
    """Hue in degrees, 0 for greys."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    span = top - low
    sector = F.when(top == r, (g - b) / span).when(top == g, (b - r) / span + 2).otherwise((r - g) / span + 4)
    degrees = sector * 60
    return F.when(span == 0, F.lit(0.0)).otherwise(F.when(degrees < 0, degrees + 360).otherwise(degrees))


def hex_color_name(code: Column) -> Column:
    """Colour name of a #rrggbb code."""
    match = F.lower(F.regexp_extract(F.coalesce(code, F.lit("")), r"^#?([0-9a-fA-F]{6})$", 1))
    channel = lambda at: F.conv(F.substring(match, at, 2), 16, 10).cast("double")
    rgb = F.struct(*[channel(at).alias(k) for at, k in ((1, "r"), (3, "g"), (5, "b"))])

    def measures(c: Column) -> Column:
        top, low = F.greatest(c["r"], c["g"], c["b"]), F.least(c["r"], c["g"], c["b"])
        return F.struct((top - low).alias("span"), ((top + low) / 510).alias("light"), _hue(c["r"], c["g"], c["b"]).alias("hue"))

    def name(m: Column) -> Column:
        span, light, hue = m["span"], m["light"], m["hue"]
        grey = F.when(light < 0.18, "블랙").when(light > 0.82, "화이트").when(light > 0.58, "라이트 그레이").otherwise("그레이")
        return (
            F.when(span < 22, grey)
            .when(light < 0.24, F.when((hue >= 190) & (hue < 260), "네이비").otherwise("블랙"))
            .when((hue < 15) | (hue >= 345), "레드")
            .when(hue < 45, F.when(light < 0.45, "브라운").otherwise("베이지"))
            .when(hue < 75, "베이지").when(hue < 165, "그린").when(hue < 195, "민트")
            .when(hue < 255, F.when(light < 0.42, "네이비").otherwise("블루"))
            .when(hue < 300, "퍼플").otherwise("핑크")
        )

    return F.when(match == "", F.lit(dims.MULTICOLOR)).otherwise(let(let(rgb, measures), name))


def rgb_color_name(r: Column, g: Column, b: Column) -> Column:
    """Colour name of an RGB triple (0..255) through its hue, saturation and value."""
    def measures(c: Column) -> Column:
        top, low = F.greatest(c["r"], c["g"], c["b"]), F.least(c["r"], c["g"], c["b"])
        sat = F.when(top == 0, F.lit(0.0)).otherwise((top - low) / top)
        return F.struct((top / 255.0).alias("value"), sat.alias("sat"), _hue(c["r"], c["g"], c["b"]).alias("hue"))

    def name(m: Column) -> Column:
        value, sat, hue = m["value"], m["sat"], m["hue"]
        grey = F.when(value < 0.20, "블랙").when(value > 0.84, "화이트").when(value > 0.62, "라이트 그레이").otherwise("그레이")
        return (
            F.when(sat < 0.12, grey)
            .when(value < 0.22, F.when((hue >= 190) & (hue < 260), "네이비").otherwise("블랙"))
            .when((hue < 15) | (hue >= 345), F.when((value < 0.62) | (sat < 0.45), "브라운").otherwise("레드"))
            .when(hue < 45, F.when(value < 0.62, "브라운").otherwise("베이지"))
            .when(hue < 75, "베이지").when(hue < 165, "그린").when(hue < 195, "민트")
            .when(hue < 255, F.when(value < 0.48, "네이비").otherwise("블루"))
            .when(hue < 300, "퍼플").otherwise("핑크")
        )

    triple = F.struct(r.cast("double").alias("r"), g.cast("double").alias("g"), b.cast("double").alias("b"))
    return let(let(triple, measures), name)
