"""Palettes of the design themes with a site's brand colours in them, and the contrast of the texts they set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteloom.functions import colour as C

COLOURS = ("bg", "surface", "text", "text_muted", "border", "primary", "accent", "inverse_bg", "inverse_text")
#: The colours of each theme by mode, in the order of COLOURS.
PALETTES = (
    ("forge", "light", "#f4f5f7 #ffffff #14171c #4d5560 #cfd4dc #b3400a #1f2937 #14171c #f4f5f7"), ("forge", "dark", "#101317 #181c22 #f2f4f7 #a4adba #2c333d #ff8a1f #ffc400 #f2f4f7 #101317"),
    ("harvest", "light", "#fbf7f0 #ffffff #231a12 #6b5a48 #e4d7c4 #9a3412 #166534 #1c1611 #fbf7f0"), ("harvest", "dark", "#171310 #201a15 #f7efe4 #c0ab94 #362c23 #f0a04b #86c08a #f7efe4 #171310"),
    ("bloom", "light", "#fdfaf6 #ffffff #3a3128 #6e6154 #e8ded1 #7d6a52 #a8624f #3a3128 #fdfaf6"), ("bloom", "dark", "#211d1a #2a2522 #f5efe7 #bdb0a2 #3d3630 #d7bb95 #e0937c #f5efe7 #211d1a"),
    ("homestead", "light", "#fbfaf6 #ffffff #1f2921 #57614f #dfe3d6 #2f6b3f #b45309 #1f2921 #fbfaf6"), ("homestead", "dark", "#141812 #1c211a #eef1e9 #b0b8a6 #2f362b #86c08a #e6a34a #eef1e9 #141812"),
    ("beacon", "light", "#ffffff #f7f7fd #0d0b1f #565175 #e2e0f2 #5b34e8 #0891b2 #120f2e #f3f2ff"), ("beacon", "dark", "#0a0818 #121029 #f0eeff #a8a2cc #272248 #a78bfa #22d3ee #f0eeff #0a0818"),
    ("folio", "light", "#ffffff #f5f7fa #151a2e #4a5568 #e6ebf2 #2b6cb9 #3b82f6 #1b2145 #eef2f8"), ("folio", "dark", "#0e1230 #1b2145 #eef2f8 #a8b4cc #2c3463 #7fa9f5 #5b9bff #eef2f8 #151a2e"),
    ("meridian", "light", "#ffffff #f7f9fc #0f172a #516079 #dfe5ee #1d4ed8 #0d9488 #0f1b33 #eef2f8"), ("meridian", "dark", "#0b1220 #121b2d #eaf0fa #9fb0ca #25324a #7aa2ff #2dd4bf #eef2f8 #0f1b33"),
)
LABELS = ("#ffffff", "#0b0b0c")
#: Text and background of each pair that must be readable, and the ratio that it needs.
PAIRS = (
    ("body text", "text", "bg", 7.0), ("muted text", "text_muted", "bg", 4.5), ("card text", "text_on_surface", "surface", 7.0), ("button label", "on_primary", "primary", 4.5),
    ("accent label", "on_accent", "accent", 4.5), ("links", "link", "bg", 4.5), ("CTA band", "inverse_text", "inverse_bg", 7.0),
)


def theme_palettes(spark: SparkSession) -> DataFrame:
    """(theme, mode, the columns of COLOURS): fourteen rows."""
    return spark.createDataFrame([(theme, mode, *shades.split(" ")) for theme, mode, shades in PALETTES], ", ".join(f"{c} string" for c in ("theme", "mode", *COLOURS)))


def theme_tokens(brands: DataFrame, palettes: DataFrame) -> DataFrame:
    """(site, theme, mode, the colours that a theme sets for a site's brand): a row for each site and palette.

    brands: site, primary, accent, as any text; what is no colour counts as none. A brand's primary is made readable on the
    background (4.5) and its accent visible on it (3), if it differs from the primary (1.25). Texts and links are made
    readable, labels are black or white, tones are mixed. palettes is a dimension of a few rows.
    """
    if (many := palettes.count()) > 1000:
        raise ValueError(f"{many} palettes; a dimension of at most 1000 is paired with every site")
    once = lambda df, **made: df.withColumns(made)
    # What a brand doesn't touch is worked out once for each palette.
    readable = once(palettes, text=C.ensure_contrast(F.col("text"), F.col("bg"), 7.0))
    readable = once(readable, text_muted=C.ensure_contrast(F.col("text_muted"), F.col("bg")), text_on_surface=C.ensure_contrast(F.col("text"), F.col("surface"), 7.0), border_strong=C.mix(F.col("border"), F.col("text"), 0.35))
    rows = readable.agg(F.collect_list(F.struct(*readable.columns)).alias("p"))
    each = brands.select("site", C.colour_parse(F.col("primary")).alias("own"), C.colour_parse(F.col("accent")).alias("second")).withColumn("p", rows.scalar())
    each = each.select("site", "own", "second", F.explode("p").alias("p")).select("site", "own", "second", "p.*")
    light, ours = F.col("mode") == "light", F.col("own").isNotNull()
    each = once(each, primary=F.when(ours, C.ensure_contrast(F.col("own"), F.col("bg"))).otherwise(F.col("primary")), seen=F.when(F.col("second").isNotNull(), C.ensure_contrast(F.col("second"), F.col("bg"), 3.0)))
    each = once(each, accent=F.when(C.contrast(F.col("seen"), F.col("primary")) > 1.25, F.col("seen")).otherwise(F.col("accent")), tones=F.when(ours & light, C.ramp(F.col("primary"))))
    each = once(each, link=C.ensure_contrast(F.col("primary"), F.col("bg")), on_primary=C.best_foreground(F.col("primary"), LABELS), on_accent=C.best_foreground(F.col("accent"), LABELS))
    tone = lambda t: F.get(F.filter("tones", lambda x: x["tone"] == t), F.lit(0))["hex"]
    soft = lambda t, own, other: F.coalesce(tone(t), C.mix(F.col("primary"), F.col("bg"), F.when(ours, own).otherwise(other)))
    away: Column = F.when(light, "#000000").otherwise("#ffffff")
    return each.select(
        "site", "theme", "mode", *COLOURS, "text_on_surface", "border_strong", "link", "on_primary", "on_accent", C.mix(F.col("primary"), away, 0.16).alias("primary_hover"),
        soft(50, 0.82, 0.88).alias("primary_soft"), soft(200, 0.6, 0.7).alias("primary_border"), F.when(ours & (F.col("primary") != F.col("own")), F.col("own")).alias("adjusted_from"),
    )


def text_pairs(tokens: DataFrame) -> DataFrame:
    """(site, theme, mode, pair, text, background, ratio, least, passes): the seven pairs of every row of theme_tokens()."""
    rows = F.array(*[F.struct(F.lit(name).alias("pair"), F.col(fg).alias("text"), F.col(bg).alias("background"), F.lit(least).alias("least")) for name, fg, bg, least in PAIRS])
    each = tokens.select("site", "theme", "mode", F.explode(rows).alias("x")).select("site", "theme", "mode", "x.*").withColumn("ratio", C.contrast(F.col("text"), F.col("background")))
    return each.select("site", "theme", "mode", "pair", "text", "background", "ratio", "least", (F.col("ratio") >= F.col("least")).alias("passes"))
