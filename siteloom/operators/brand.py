"""Colours and fonts of a site's style sheets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteloom.functions import colour as C
from siteloom.functions import text as T
from siteloom.operators.pages import attr

#: How colours are written, and families that any page may name.
LITERAL = r"(?i)#[0-9a-f]{3,8}\b|rgba?\([^)]{5,40}\)|hsla?\([^)]{5,40}\)"
GENERIC = (
    "(?i)^(inherit|initial|unset|revert|sans-serif|serif|monospace|cursive|fantasy|system-ui|ui-sans-serif|ui-serif|ui-monospace|-apple-system|blinkmacsystemfont|segoe ui|roboto|helvetica neue|helvetica|arial"
    "|apple color emoji|segoe ui emoji|noto sans|noto color emoji|liberation sans|sans|emoji)$"
)
THEME_COLOUR, WEB_FONT = 20, 5
SHEETS, SHEET_CHARS = 6, 300_000
#: What a colour counts by the property it stands in.
WEIGHTS = (("background", 3), ("border-color", 1), ("fill", 1), ("color", 2))


def css_sources(nodes: DataFrame, stylesheets: DataFrame) -> DataFrame:
    """(site, css): bodies of style tags, style attributes as rules, and the site's first six sheets, each cut to 300,000 characters."""
    inline = nodes.where("tag = 'style' and text <> ''").select("site", F.col("text").alias("css"))
    styled = nodes.where(attr("style").isNotNull()).select("site", F.concat(F.lit("x{"), attr("style"), F.lit("}")).alias("css"))
    own = stylesheets.where(~F.col("url").rlike("(?i)font|icon|bootstrap")).groupBy("site", "url").agg(F.min("css").alias("css"))  # of differing bodies at one address the same one in every run
    first = own.withColumn("nth", F.row_number().over(Window.partitionBy("site").orderBy("url"))).where(F.col("nth") <= SHEETS)
    return inline.unionByName(styled).unionByName(first.select("site", F.substring("css", 1, SHEET_CHARS).alias("css")))


def declarations(css: DataFrame) -> DataFrame:
    """(site, property, value) of every declaration."""
    chunks = css.select("site", F.explode(F.split("css", "[{};]")).alias("d")).where(F.contains("d", F.lit(":")))
    return chunks.select("site", F.lower(F.trim(F.regexp_extract("d", r"^\s*([-a-zA-Z]+)\s*:", 1))).alias("property"), F.trim(F.regexp_extract("d", r":([\s\S]*)$", 1)).alias("value"))


def weight(prop: Column) -> Column:
    return F.greatest(F.lit(1), *[F.when(F.contains(prop, F.lit(p)), w) for p, w in WEIGHTS if p != "color"], F.when((prop == "color") | F.contains(prop, F.lit("color")) & ~F.contains(prop, F.lit("border")), 2))


def css_colours(css: DataFrame, themes: DataFrame | None = None) -> DataFrame:
    """(site, hex, score, uses): colours by the weight of the properties they stand in; black, white and transparent ones are left out.

    themes(site, theme_color): the home pages' theme colours, which count 20 each.
    """
    found = declarations(css).select("site", weight(F.col("property")).alias("w"), F.explode(F.regexp_extract_all("value", F.lit(LITERAL), F.lit(0))).alias("c"))
    if themes is not None:
        found = found.unionByName(themes.where("theme_color <> ''").select("site", F.lit(THEME_COLOUR).alias("w"), F.col("theme_color").alias("c")))
    clear = F.col("c").rlike(r"(?i)^(rgb|hsl)a?\([^)]*[,/]\s*0*(\.0*)?%?\s*\)$") & (F.size(F.split("c", r"[,/]|\s+(?=[\d.])")) > 3) | F.col("c").rlike("(?i)^#([0-9a-f]{3}0|[0-9a-f]{6}00)$")
    rows = found.where(~clear).select("site", C.colour_parse(F.col("c")).alias("hex"), "w")
    rows = rows.where("hex is not null and hex not in ('#000000', '#ffffff')")
    return rows.groupBy("site", "hex").agg(F.sum("w").cast("bigint").alias("score"), F.count("*").alias("uses"))


def brand_palette(colours: DataFrame) -> DataFrame:
    """(site, primary, secondary, accent, palette): vivid colours by score, told apart by hue; the twelve best."""
    rank = F.col("score") * (0.35 + C.vibrancy(F.col("hex")))
    shape = C.hsl(F.col("hex"))
    rows = colours.select("site", "hex", rank.alias("rank"), shape["h"].alias("h"), ((shape["s"] > 0.2) & shape["l"].between(0.1, 0.9)).alias("vivid"))
    order = Window.partitionBy("site").orderBy(F.desc("rank"), "hex")
    ranked = rows.withColumn("nth", F.row_number().over(order)).where("nth <= 12")  # 12 rows a site from here on
    sites = ranked.groupBy("site").agg(F.sort_array(F.collect_list(F.struct("nth", "hex", "h", "vivid"))).alias("p"))
    vivid = F.filter("p", lambda x: x["vivid"])
    far = lambda from_, least: F.filter("v", lambda x: C.hue_distance(x["h"], from_) > least)
    one = sites.withColumn("v", vivid).withColumn("first", F.get("v", F.lit(0)))
    two = one.withColumn("second", F.coalesce(F.get(far(F.col("first.h"), 25), F.lit(0)), F.get("v", F.lit(1))))
    rest = F.filter(far(F.col("first.h"), 60), lambda x: x["hex"] != F.col("second.hex"))
    none = lambda c: F.coalesce(c, F.lit(""))
    return two.select("site", none(F.col("first.hex")).alias("primary"), none(F.col("second.hex")).alias("secondary"), none(F.get(rest, F.lit(0))["hex"]).alias("accent"), F.transform("p", lambda x: x["hex"]).alias("palette"))


def css_fonts(css: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(site, font, n): families in font and font-family by use, generic ones left out; one that a page loads from Google Fonts counts five more."""
    lists = css.select("site", F.explode(F.regexp_extract_all("css", F.lit(r'(?i)font(?:-family)?\s*:\s*([^;}"]+)'), F.lit(1))).alias("v")).select("site", F.explode(F.split("v", ",")).alias("f"))
    names = lists.select("site", F.regexp_replace(T.squash(F.col("f")), "^[\"']|[\"']$", "").alias("font"), F.lit(1).alias("n"))
    names = names.where((F.col("font") != "") & ~F.col("font").rlike(GENERIC) & ~F.startswith("font", F.lit("var(")) & ~F.col("font").rlike(r"^\d"))
    if nodes is not None:
        loaded = nodes.where((F.col("tag") == "link") & F.contains(attr("href"), F.lit("fonts.googleapis.com"))).select("site", F.explode(F.regexp_extract_all(attr("href"), F.lit("family=([^&:]+)"), F.lit(1))).alias("f"))
        loaded = loaded.select("site", F.get(F.split(F.coalesce(F.try_url_decode("f"), "f"), ":"), F.lit(0)).alias("font"), F.lit(WEB_FONT).alias("n")).where("font <> ''")
        names = names.unionByName(loaded)
    return names.groupBy("site", "font").agg(F.sum("n").alias("n"))


def brand_fonts(used: DataFrame) -> DataFrame:
    """(site, heading, body, fonts) of css_fonts(): the most used family, the second or else the first, the eight most used."""
    ranked = used.withColumn("nth", F.row_number().over(Window.partitionBy("site").orderBy(F.desc("n"), "font"))).where("nth <= 8")
    best = ranked.groupBy("site").agg(F.transform(F.sort_array(F.collect_list(F.struct("nth", "font"))), lambda x: x["font"]).alias("fonts"))
    return best.select("site", F.col("fonts")[0].alias("heading"), F.coalesce(F.get("fonts", F.lit(1)), F.col("fonts")[0]).alias("body"), "fonts")
