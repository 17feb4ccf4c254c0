"""Postal addresses and opening hours in the text of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteloom.functions import text as T
from siteloom.operators.contacts import to_12h
from siteloom.operators.jsonld import DAYS
from siteloom.operators.pages import PAGE, attr

#: The words and shapes of addresses.
STREET_WORDS = (
    "street|st|avenue|ave|road|rd|boulevard|blvd|drive|dr|lane|ln|court|ct|circle|cir|highway|hwy|parkway|pkwy|place|pl|way|terrace|ter|trail|trl|route|rte|rt|square|sq|loop|run|pike|expressway|expy"
)
UNIT_WORDS = "suite|ste|unit|apt|apartment|bldg|building|floor|fl|room|rm|#"
DIRECTIONS = "north|south|east|west|northeast|northwest|southeast|southwest|n|s|e|w|ne|nw|se|sw"
US = (
    rf"(?i)(\d{{1,6}}[\w.'-]*(?:\s+[\w.'&-]+){{0,6}}?\s+(?:{STREET_WORDS})\.?(?:\s+(?:{DIRECTIONS})\.?)?)(?:\s*,?\s*((?:{UNIT_WORDS})\.?\s*[\w-]+))?"
    r"\s*,\s*([A-Za-z][A-Za-z .'-]{1,30}?)\s*,?\s+([A-Z]{2})\.?\s+(\d{5}(?:-\d{4})?)\b"
)
UK = r"((?:[A-Za-z0-9][^,\n]{1,58},\s*){1,4})([A-Za-z][A-Za-z .'-]{1,40}?)?\s*(?<![A-Z0-9])([A-Z]{1,2}[0-9][0-9A-Z]? ?[0-9][A-Z]{2})(?![A-Z0-9])"
LABEL = r"(?i)^[\s\S]*\b(?:address|location|find us|visit us|our office|head office|send message|message|contact(?: us)?|email|phone|tel)\b[\s:.,–-]*"
#: Days and times in text.
DAY = "(mon|tue|tues|wed|weds|thu|thur|thurs|fri|sat|sun|monday|tuesday|wednesday|thursday|friday|saturday|sunday)"
TIME = r"(\d{1,2}(?::\d{2})?\s*(?:am|pm|a\.m\.|p\.m\.)?|noon|midnight)"
HOURS = rf"(?i){DAY}\.?\s*(?:(?:-|–|—|to|thru|through)\s*{DAY}\.?)?\s*[:–—-]?\s*(?:(closed|by appointment[^,;\n]*)|{TIME}\s*(?:-|–|—|to)\s*{TIME})"
ADDRESS_ZONES = (("tag", "address"), ("class", "address"), ("id", "address"), ("class", "contact-info"), ("class", "vcard"), ("tag", "footer"))
HOURS_ZONES = (
    ("class", "hours"), ("id", "hours"), ("class", "opening-hours"), ("class", "business-hours"), ("class", "hours-of-operation"), ("tag", "footer"), ("tag", "aside"), ("class", "contact-info"),
)
ZONE_CHARS = 400


def zones(nodes: DataFrame, names: tuple[tuple[str, str], ...], most: int | None = None) -> DataFrame:
    """(site, page_id, rank, text, sure): texts of the named elements in their order, then of the body (or the first node) as the last.

    sure: whether an element other than the last has the text.
    """
    rules = {"tag": lambda v: F.col("tag") == v, "class": lambda v: F.array_contains("classes", v), "id": lambda v: attr("id") == v}
    named = F.coalesce(*[F.when(rules[kind](v), F.lit(True)) for kind, v in names])
    found = nodes.where(named & (F.col("text") != "") & (F.lit(True) if most is None else F.length("text") < most)).select(*PAGE, F.col("node_id").alias("rank"), "text")
    last = nodes.where("tag = 'body' or node_id = 0").groupBy(*PAGE).agg(F.min_by("text", F.struct(F.col("tag") != "body", "node_id")).alias("text")).select(*PAGE, F.lit(1 << 30).alias("rank"), "text")
    rows = found.unionByName(last).where("text is not null")
    first = rows.groupBy(*PAGE, "text").agg(F.min("rank").alias("rank"))  # equal texts need one look
    return first.select(*PAGE, "rank", "text", (F.col("rank") < (1 << 30)).alias("sure"))


def us_address(text: Column) -> Column:
    part = lambda i: T.squash(F.regexp_extract(text, US, i))
    return F.when(text.rlike(US), F.struct(part(1).alias("street"), part(2).alias("street2"), part(3).alias("city"), F.upper(part(4)).alias("region"), part(5).alias("postal_code"), F.lit("US").alias("country")))


def uk_address(text: Column) -> Column:
    """Town and postcode at the end; what labels precede the first line is cut. Null without a town or a street."""
    lines = F.filter(F.transform(F.split(F.regexp_extract(text, UK, 1), ","), T.squash), lambda x: x != "")
    first = T.squash(F.regexp_replace(F.get(lines, F.lit(0)), LABEL, ""))
    rest = F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0)))
    own = F.concat(F.when(first != "", F.array(first)).otherwise(F.array().cast("array<string>")), rest)
    tail = T.squash(F.regexp_extract(text, UK, 2))
    city = F.when(tail != "", tail).otherwise(F.coalesce(F.try_element_at(own, F.lit(-1)), F.lit("")))
    street = F.when(tail != "", own).otherwise(F.slice(own, F.lit(1), F.greatest(F.size(own) - 1, F.lit(0))))
    made = F.struct(F.array_join(street, ", ").alias("street"), F.lit("").alias("street2"), city.alias("city"), F.lit("").alias("region"), F.upper(T.squash(F.regexp_extract(text, UK, 3))).alias("postal_code"), F.lit("GB").alias("country"))
    return F.when(text.rlike(UK) & (city != "") & (F.size(street) > 0), made)


def page_address(nodes: DataFrame) -> DataFrame:
    """(site, page_id, street, street2, city, region, postal_code, country, confidence): at most one address per page.

    Marked-up properties first (high), then the first zone with an American or a British address: medium in an
    address element or the footer, low in the body.
    """
    props = ("streetAddress", "addressLocality", "addressRegion", "postalCode", "addressCountry")
    marked = nodes.where(attr("itemprop").isin(*props)).groupBy(*PAGE).agg(*[F.coalesce(T.squash(F.min_by("text", F.when(attr("itemprop") == p, F.col("node_id")))), F.lit("")).alias(p) for p in props])
    stated = marked.where("streetAddress <> ''").select(*PAGE, F.lit(-1).alias("rank"), F.lit("high").alias("confidence"), F.struct(
        F.col("streetAddress").alias("street"), F.lit("").alias("street2"), F.col("addressLocality").alias("city"), F.col("addressRegion").alias("region"), F.col("postalCode").alias("postal_code"), F.col("addressCountry").alias("country")).alias("a"))
    read = zones(nodes, ADDRESS_ZONES, ZONE_CHARS).select(*PAGE, "rank", F.when(F.col("sure"), "medium").otherwise("low").alias("confidence"), F.coalesce(us_address(F.col("text")), uk_address(F.col("text"))).alias("a"))
    best = stated.unionByName(read).where("a is not null").groupBy(*PAGE).agg(F.min_by(F.struct("a", "confidence"), "rank").alias("x"))
    return best.select(*PAGE, "x.a.*", "x.confidence")


def day_index(c: Column) -> Column:
    return F.coalesce(*[F.when(F.startswith(F.lit(d), F.substring(F.lower(c), 1, 3)), F.lit(i)) for i, d in enumerate(DAYS)])


def read_time(c: Column) -> Column:
    """A time in text as 12-hour text: 7 to 11 without am or pm are in the morning, 13 and more are 24-hour times."""
    t = F.lower(F.trim(c))
    shape = r"^(\d{1,2})(?::(\d{2}))?\s*(am|pm|a\.m\.|p\.m\.)?$"
    hour, minute = F.regexp_extract(t, shape, 1).try_cast("int"), F.when(F.regexp_extract(t, shape, 2) == "", "00").otherwise(F.regexp_extract(t, shape, 2))
    said = F.upper(F.replace(F.regexp_extract(t, shape, 3), F.lit("."), F.lit("")))
    half = F.when(hour == 0, "AM").when(said != "", said).when(hour.between(7, 11), "AM").otherwise("PM")
    late = to_12h(F.concat(hour.cast("string"), F.lit(":"), minute))
    shown = F.when(hour >= 13, late).otherwise(F.concat(F.when(hour == 0, "12").otherwise(hour.cast("string")), F.lit(":"), minute, F.lit(" "), half))
    return F.when(t == "noon", "12:00 PM").when(t == "midnight", "12:00 AM").when(t.rlike(shape), shown).otherwise(T.squash(c))


def page_hours(nodes: DataFrame) -> DataFrame:
    """(site, page_id, day, closed, opens, closes, note, confidence): hours of the first zone of a page that names two days or more.

    day counts from 0 for Monday. Ranges of days wrap the week; the first mention of a day counts.
    """
    texts = zones(nodes, HOURS_ZONES).where(F.col("text").rlike(r"(?i)\b(mon|tue|wed|thu|fri|sat|sun)"))
    found = texts.select(*PAGE, "rank", "sure", F.posexplode(F.regexp_extract_all("text", F.lit(HOURS), F.lit(0))).alias("pos", "m"))
    part = lambda i: F.regexp_extract("m", HOURS, i)
    first, last = day_index(part(1)), F.when(part(2) == "", day_index(part(1))).otherwise(F.coalesce(day_index(part(2)), day_index(part(1))))
    rows = found.select("*", first.alias("first"), last.alias("last"), part(3).alias("shut"), read_time(part(4)).alias("o"), read_time(part(5)).alias("c")).where("first is not null")
    days = F.transform(F.sequence(F.lit(0), F.pmod(F.col("last") - F.col("first"), F.lit(7))), lambda i: ((F.col("first") + i) % 7).cast("int"))
    entry = F.struct(
        (F.col("shut") != "").alias("closed"), F.when(F.col("shut") != "", "").otherwise(F.col("o")).alias("opens"), F.when(F.col("shut") != "", "").otherwise(F.col("c")).alias("closes"),
        F.when(F.col("shut").rlike("(?i)appointment"), T.squash(F.col("shut"))).otherwise("").alias("note"),
    )
    each = rows.select(*PAGE, "rank", "sure", "pos", F.explode(days).alias("day"), entry.alias("e")).groupBy(*PAGE, "rank", "sure", "day").agg(F.min_by("e", "pos").alias("e"))
    best = each.groupBy(*PAGE, "rank").agg(F.count("*").alias("days")).where("days >= 2").groupBy(*PAGE).agg(F.min("rank").alias("rank"))
    return each.join(best, [*PAGE, "rank"]).select(*PAGE, "day", "e.*", F.when(F.col("sure"), "medium").otherwise("low").alias("confidence"))


def first_by_kind(pages: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of found that belong to the first page of each site that has any: contact pages first, then home, then others. pages: site, page_id, kind."""
    rank = F.when(F.col("kind") == "contact", 0).when(F.col("kind") == "home", 1).otherwise(2)
    ranked = found.select(*PAGE).distinct().join(pages.select(*PAGE, rank.alias("rank")), PAGE)
    chosen = ranked.groupBy("site").agg(F.min_by("page_id", F.struct("rank", "page_id")).alias("page_id"))
    return found.join(chosen, PAGE, "left_semi")


def format_address(street: Column, street2: Column, city: Column, region: Column, postal_code: Column) -> Column:
    """An address on one line; what is empty is left out."""
    joined = lambda sep, *parts: F.array_join(F.filter(F.array(*parts), lambda x: T.squash(x) != ""), sep)
    return joined(", ", joined(", ", street, street2), joined(", ", city, joined(" ", region, postal_code)))
