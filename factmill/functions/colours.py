"""Colour words for colours given as hexadecimal digits or as words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.evaluate import let
from .numbers import strip

#: Hue bands in degrees, and words that stand for each other.  Fixed values.
HUES = ((345, 360, "red"), (0, 12, "red"), (12, 40, "orange"), (40, 68, "yellow"), (68, 160, "green"), (160, 195, "teal"), (195, 255, "blue"), (255, 290, "purple"), (290, 345, "pink"))
SYNONYMS = {
    "dark blue": ["navy", "blue", "black"],
    "navy": ["dark blue", "blue", "black"],
    "light blue": ["blue", "sky blue"],
    "sky blue": ["light blue", "blue"],
    "grey": ["gray"],
    "gray": ["grey"],
    "dark grey": ["dark gray", "grey", "gray"],
    "dark gray": ["dark grey", "grey", "gray"],
    "light grey": ["light gray", "grey", "gray"],
    "light gray": ["light grey", "grey", "gray"],
    "dark red": ["maroon", "red"],
    "maroon": ["dark red", "red"],
    "dark green": ["green"],
    "light green": ["green"],
}
_HEX = r"^#?([0-9a-fA-F]{6})$"


def hue_saturation_lightness(colour: Column) -> Column:
    """Hue in degrees, saturation and lightness of six hexadecimal digits, else null."""
    def parts(c: Column) -> Column:
        high, low = F.array_max(c), F.array_min(c)
        return F.struct(c.alias("c"), high.alias("high"), (high - low).alias("spread"), ((high + low) / 2).alias("light"))

    def found(x: Column) -> Column:
        high, spread, light = x["high"], x["spread"], x["light"]
        away = [F.try_divide(high - F.get(x["c"], i), spread) for i in range(3)]
        saturation = F.when(spread == 0, 0.0).otherwise(F.try_divide(spread, F.when(light <= 0.5, 2 * light).otherwise(2 - 2 * light)))
        turn = F.when(F.get(x["c"], 0) == high, away[2] - away[1]).when(F.get(x["c"], 1) == high, 2 + away[0] - away[2]).otherwise(4 + away[1] - away[0]) / 6
        hue = F.when(spread == 0, 0.0).otherwise(turn - F.floor(turn)) * 360
        return F.struct(hue.alias("hue"), saturation.alias("saturation"), light.alias("lightness"))

    byte = lambda digits, i: F.conv(F.substring(digits, i, 2), 16, 10).cast("double") / 255
    return let(F.regexp_extract(strip(colour), _HEX, 1), lambda d: F.when(d != "", let(let(F.array(byte(d, 1), byte(d, 3), byte(d, 5)), parts), found)))


def _words(*words: str | Column) -> Column:
    return F.array(*[F.lit(w) if isinstance(w, str) else w for w in words])


def _of_shade(hsl: Column, base: Column) -> Column:
    """Words of a colour by its lightness and saturation; ``base`` is its hue's."""
    sat, light = hsl["saturation"], hsl["lightness"]
    if_base = lambda name, word: F.when(base == name, F.lit(word))
    dim = F.when(sat > 0.12, base).otherwise(F.lit("grey"))
    greyish = F.concat(_words("grey", "gray", "silver"), F.when(light < 0.4, _words("dark grey", "dark gray")).otherwise(_words("light grey", "light gray")))
    return (
        F.when(light <= 0.10, _words("black", "dark"))
        .when(light <= 0.22, let(dim, lambda d: _words("black", "dark", F.concat(F.lit("dark "), d), d, F.when(d == "blue", F.lit("navy")))))
        .when(light >= 0.92, _words("white", "light"))
        .when(sat <= 0.12, greyish)
        .when(light < 0.38, _words(base, F.concat(F.lit("dark "), base), if_base("blue", "navy"), if_base("red", "maroon")))
        .when(light > 0.62, _words(base, F.concat(F.lit("light "), base), if_base("blue", "sky blue")))
        .otherwise(_words(base))
    )


def names_for(colour: Column) -> Column:
    """The distinct words that may be said of a colour, sorted."""
    def worded(plain: Column) -> Column:
        known = F.create_map(*[x for word, others in SYNONYMS.items() for x in (F.lit(word), _words(*others))])
        shade = let(F.split(plain, r"(?U)\s+"), lambda p: F.when((F.size(p) == 2) & F.get(p, 0).isin("dark", "light", "deep", "pale"), F.get(p, 1)))
        return F.when(plain != "", F.concat(F.array(plain), F.coalesce(F.try_element_at(known, plain), F.array().cast("array<string>")), F.array(shade)))

    def hued(hsl: Column) -> Column:
        bands = F.array(*[F.struct(F.lit(float(low)).alias("low"), F.lit(float(high)).alias("high"), F.lit(name).alias("name")) for low, high, name in HUES])
        base = F.get(F.filter(bands, lambda b: (hsl["hue"] >= b["low"]) & (hsl["hue"] < b["high"])), 0)["name"]
        return F.when(hsl.isNotNull(), let(F.coalesce(base, F.lit("blue")), lambda b: _of_shade(hsl, b)))

    found = F.coalesce(let(hue_saturation_lightness(colour), hued), let(F.lower(strip(colour)), worded), F.array().cast("array<string>"))
    return F.array_sort(F.array_distinct(F.array_compact(found)))


def describe_colour(colour: Column) -> Column:
    """The word that says most: more words, then more letters, then the alphabet."""
    ranked = lambda names: F.transform(names, lambda n: F.struct((-F.size(F.split(n, " "))).alias("words"), (-F.length(n)).alias("letters"), n.alias("name")))
    return F.coalesce(let(names_for(colour), lambda names: F.array_min(ranked(names)))["name"], F.lit(""))
