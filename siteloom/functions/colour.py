"""Colour expressions on #rrggbb texts: WCAG luminance and contrast, hue, lightness, saturation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from siteloom.functions.once import let
from siteloom.functions.shades import readable


def channel(hexa: Column, i: int) -> Column:
    return F.conv(F.substring(hexa, 2 + 2 * i, 2), 16, 10).cast("int")


def to_hex(r: Column, g: Column, b: Column) -> Column:
    return F.concat(F.lit("#"), *[F.lower(F.lpad(F.hex(x.cast("bigint")), 2, "0")) for x in (r, g, b)])


#: Names of colours.
NAMES = {
    "black": "#000000", "white": "#ffffff", "red": "#ff0000", "green": "#008000", "blue": "#0000ff", "navy": "#000080", "teal": "#008080", "olive": "#808000", "maroon": "#800000", "purple": "#800080", "gray": "#808080", "grey": "#808080",
    "silver": "#c0c0c0", "orange": "#ffa500", "gold": "#ffd700", "yellow": "#ffff00", "lime": "#00ff00", "aqua": "#00ffff", "cyan": "#00ffff", "fuchsia": "#ff00ff", "magenta": "#ff00ff", "pink": "#ffc0cb", "brown": "#a52a2a",
    "beige": "#f5f5dc", "ivory": "#fffff0", "crimson": "#dc143c", "indigo": "#4b0082", "khaki": "#f0e68c", "salmon": "#fa8072", "tan": "#d2b48c", "turquoise": "#40e0d0", "violet": "#ee82ee", "wheat": "#f5deb3", "darkblue": "#00008b",
    "darkgreen": "#006400", "darkred": "#8b0000", "lightblue": "#add8e6", "lightgreen": "#90ee90",
}


def from_hsl(h: Column, s: Column, light: Column) -> Column:
    """#rrggbb from degrees and shares of 1."""
    def shade(x: Column) -> Column:
        def level(n: float) -> Column:
            k = F.pmod(F.lit(n) + x["turn"], F.lit(12.0))
            return F.round(255 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), x["light"] - x["half"] * F.greatest(F.lit(-1.0), F.least(k - 3, 9 - k, F.lit(1.0))))))

        return to_hex(level(0.0), level(8.0), level(4.0))

    half = lambda x: (1 - F.abs(2 * x["light"] - 1)) * x["s"] / 2
    return let(F.struct((h / 30).alias("turn"), s.alias("s"), light.alias("light")), lambda x: let(F.struct(x["turn"].alias("turn"), x["light"].alias("light"), half(x).alias("half")), shade))


def colour_parse(c: Column) -> Column:
    """Named colours, #rgb, #rgba, #rrggbb, #rrggbbaa, rgb() and hsl() texts as #rrggbb, without opacity; null for others."""
    return let(F.lower(F.trim(c)), _parsed)


def _parsed(t: Column) -> Column:
    short = F.concat(F.lit("#"), *[F.repeat(F.substring(t, i, 1), 2) for i in (2, 3, 4)])
    inner = F.filter(F.split(F.regexp_extract(t, r"^(?:rgb|hsl)a?\(\s*([^)]+)\)$", 1), r"[,/\s]+"), lambda x: x != "")
    named = F.str_to_map(F.lit(",".join(f"{name}:{shade}" for name, shade in NAMES.items())), F.lit(","), F.lit(":"))

    def rgb(parts: Column) -> Column:
        number = lambda i: F.get(parts, F.lit(i)).try_cast("double")
        whole = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.round(x)))
        return let(F.array(*[number(i) for i in range(3)]), lambda n: F.when(n[0].isNotNull() & n[1].isNotNull() & n[2].isNotNull(), to_hex(*[whole(n[i]) for i in range(3)])))

    def hsl_text(parts: Column) -> Column:
        number = lambda i: F.regexp_extract(F.get(parts, F.lit(i)), r"^([-+]?[0-9.]+)", 1).try_cast("double")
        return let(F.array(*[number(i) for i in range(3)]), lambda n: F.when(n[0].isNotNull() & n[1].isNotNull() & n[2].isNotNull(), from_hsl(n[0], n[1] / 100, n[2] / 100)))

    return (
        F.when(t.rlike("^#[0-9a-f]{3,4}$"), short).when(t.rlike("^#[0-9a-f]{6}([0-9a-f]{2})?$"), F.substring(t, 1, 7)).when(t.rlike(r"^rgba?\(\s*[^)]+\)$"), let(inner, rgb))
        .when(t.rlike(r"^hsla?\(\s*[^)]+\)$"), let(inner, hsl_text)).otherwise(F.try_element_at(named, t))
    )


def luminance(hexa: Column) -> Column:
    def linear(i: int) -> Column:
        s = channel(hexa, i) / 255.0
        return F.when(s <= 0.03928, s / 12.92).otherwise(F.pow((s + 0.055) / 1.055, F.lit(2.4)))

    return 0.2126 * linear(0) + 0.7152 * linear(1) + 0.0722 * linear(2)


def contrast(a: Column, b: Column) -> Column:
    one, two = luminance(a) + 0.05, luminance(b) + 0.05
    return F.greatest(one / two, two / one)


def hsl(hexa: Column) -> Column:
    """Struct of hue in degrees, saturation and lightness from 0 to 1."""
    def of(x: Column) -> Column:
        r, g, b, high, low = (x[n] for n in ("r", "g", "b", "high", "low"))
        d, light = high - low, (high + low) / 2
        sat = F.when(d == 0, 0.0).otherwise(d / (1 - F.abs(2 * light - 1)))
        hue = F.when(d == 0, 0.0).when(high == r, 60 * F.pmod((g - b) / d, F.lit(6.0))).when(high == g, 60 * ((b - r) / d + 2)).otherwise(60 * ((r - g) / d + 4))
        return F.struct(hue.alias("h"), sat.alias("s"), light.alias("l"))

    rgb = F.struct(*[(channel(hexa, i) / 255.0).alias(n) for i, n in enumerate("rgb")])
    return let(rgb, lambda c: let(F.struct(*[c[n].alias(n) for n in "rgb"], F.greatest(*[c[n] for n in "rgb"]).alias("high"), F.least(*[c[n] for n in "rgb"]).alias("low")), of))


def hue_distance(a: Column, b: Column) -> Column:
    d = F.abs(a - b) % 360
    return F.least(d, 360 - d)


def vibrancy(hexa: Column) -> Column:
    return let(hsl(hexa), lambda x: x["s"] * (1 - F.abs(x["l"] - 0.5) * 2))


#: Lightness of each tone of a brand colour.
TONES = ((50, 0.97), (100, 0.94), (200, 0.86), (300, 0.76), (400, 0.64), (500, 0.52), (600, 0.44), (700, 0.36), (800, 0.27), (900, 0.18))


def is_neutral(hexa: Column) -> Column:
    return vibrancy(hexa) < 0.08


def mix(a: Column, b: Column, weight: Column | float = 0.5) -> Column:
    """The colour that lies a share of the way from a to b, channel by channel."""
    w = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(weight) if isinstance(weight, (int, float)) else weight))
    return to_hex(*[F.round(channel(a, i) * (1 - w) + channel(b, i) * w) for i in range(3)])


def ramp(hexa: Column) -> Column:
    """Tones of a colour from 50 to 900, as an array of (tone, hex); the lightest and the darkest are less saturated. Null for none."""
    tones = F.array(*[F.struct(F.lit(tone).alias("tone"), F.lit(light).alias("light")) for tone, light in TONES])
    shade = lambda own, t: from_hsl(own["h"], own["s"] * F.when((t["light"] > 0.9) | (t["light"] < 0.22), 0.75).otherwise(1.0), t["light"])
    return F.when(hexa.isNotNull(), let(hsl(hexa), lambda own: F.transform(tones, lambda t: F.struct(t["tone"].alias("tone"), shade(own, t).alias("hex")))))


def best_foreground(background: Column, candidates: Sequence[str] = ("#ffffff", "#111111")) -> Column:
    """The candidate with the highest contrast, the first of equal ones."""
    return F.array_max(F.array(*[F.struct(contrast(F.lit(c), background).alias("r"), F.lit(-i).alias("first"), F.lit(c).alias("c")) for i, c in enumerate(candidates)]))["c"]


def ensure_contrast(hexa: Column, background: Column, least: float = 4.5) -> Column:
    """The colour, or the first of its hue that reaches the ratio as its lightness goes from the half away from the background's, by hundredths.

    It is worked out over whole columns, so it stands in a projection, not in a lambda function.
    """
    return readable(hexa, background, F.lit(float(least)))
