"""Telephone numbers and mail addresses in texts and pages, and opening hours in clock text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteloom.functions import text as T
from siteloom.operators.pages import PAGE, attr

#: What looks like a number or an address.
PHONE = r"(?:\+?\d{1,3}[\s.\x{2010}-\x{2015}-]?)?\(?\d{3}\)?[\s.\x{2010}-\x{2015}-]?\d{3}[\s.\x{2010}-\x{2015}-]?\d{4}\b"
EMAIL = r"(?i)[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,63}"
EMAIL_NOISE = (
    r"(?i)@(example|sentry|wixpress|sentry\.io|googlemail\.test|domain|email|yourdomain|test)\.|@2x|\.png$|\.jpg$|\.gif$|\.webp$|@sentry|@wix|@squarespace|@shopify|@godaddy"
)
NUMBER_OF = r"(?i)\b(?:invoice|order|sku|isbn|ein|tax\s*id|account|license|lic)\s*#?\s*:?\s*$"
FAX = r"(?i)\bfax\b[\s:.#-]*$"


def matches(df: DataFrame, keys: list[str], text: Column, pattern: str) -> DataFrame:
    """(keys, pos, value, before): each match and the 40 characters between it and the match before."""
    hit = F.contains(text, F.lit("@")) if pattern == EMAIL else F.regexp_like(text, F.lit(r"\d{3}"))  # most texts need no search
    pattern = T.ascii_words(pattern)
    found = df.where(hit).select(*keys, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("p"))
    rows = found.select(*keys, F.posexplode(F.arrays_zip("m", F.slice("p", F.lit(1), F.size("m")).alias("b"))).alias("pos", "x"))
    return rows.select(*keys, "pos", F.col("x.m").alias("value"), F.right(F.col("x.b"), F.lit(40)).alias("before"))


def looks_like_phone(value: Column, before: Column) -> Column:
    digits = F.regexp_replace(value, r"\D", "")
    area = F.when((F.length(digits) == 11) & F.startswith(digits, F.lit("1")), F.substring(digits, 2, 3)).otherwise(F.substring(digits, 1, 3))
    bad = (
        ~F.length(digits).between(10, 15) | digits.rlike("^0+$") | F.trim(value).rlike(r"^(19|20)\d{2}[-/]") | before.rlike(T.ascii_words(NUMBER_OF))
        | (F.trim(value).rlike(r"^\d{10,}$") & ~value.rlike(r"[()\s.-]")) | F.substring(area, 1, 1).isin("0", "1")
    )
    return ~bad


def phone_key(value: Column) -> Column:
    digits = F.regexp_replace(value, r"\D", "")
    return F.when((F.length(digits) == 11) & F.startswith(digits, F.lit("1")), F.substring(digits, 2, 10)).otherwise(digits)


def _phones(rows: DataFrame, keys: list[str]) -> DataFrame:
    """First of equal numbers, then without fax numbers. rows: keys, rank, pos, value, fax."""
    first = rows.withColumn("nth", F.row_number().over(Window.partitionBy(*keys, phone_key(F.col("value"))).orderBy("rank", "pos"))).where("nth = 1 and not fax")
    ord_ = F.row_number().over(Window.partitionBy(*keys).orderBy("rank", "pos"))
    return first.select(*keys, ord_.alias("ord"), T.squash(F.col("value")).alias("value"), F.when(F.col("rank") == 0, "high").otherwise("medium").alias("confidence"))


def phones_text(df: DataFrame, keys: list[str], text: Column) -> DataFrame:
    """(keys, ord, value, confidence): telephone numbers in a text column."""
    rows = matches(df, keys, T.squash(text), PHONE).where(looks_like_phone(F.col("value"), F.col("before")))
    return _phones(rows.select(*keys, F.lit(1).alias("rank"), "pos", "value", F.col("before").rlike(T.ascii_words(FAX)).alias("fax")), keys)


def phones(nodes: DataFrame) -> DataFrame:
    """(site, page_id, ord, value, confidence): numbers of tel: links, then those in the text of the body."""
    href = F.trim(F.regexp_replace(attr("href"), "(?i)^tel:", ""))
    value = F.coalesce(F.nullif(href, F.lit("")), F.col("text"))
    links = nodes.where((F.col("tag") == "a") & F.startswith(attr("href"), F.lit("tel"))).where(looks_like_phone(value, F.lit("")))
    high = links.select(*PAGE, F.lit(0).alias("rank"), F.col("node_id").alias("pos"), F.coalesce(F.nullif("text", F.lit("")), href).alias("value"), F.lit(False).alias("fax"))
    body = matches(nodes.where("tag = 'body'"), PAGE, F.col("text"), PHONE).where(looks_like_phone(F.col("value"), F.col("before")))
    return _phones(high.unionByName(body.select(*PAGE, F.lit(1).alias("rank"), "pos", "value", F.col("before").rlike(T.ascii_words(FAX)).alias("fax"))), PAGE)


def _emails(rows: DataFrame, keys: list[str]) -> DataFrame:
    first = rows.where(~F.col("value").rlike(EMAIL_NOISE)).groupBy(*keys, "value").agg(F.min(F.struct("rank", "pos")).alias("at"))
    return first.select(*keys, F.row_number().over(Window.partitionBy(*keys).orderBy("at")).alias("ord"), "value", F.when(F.col("at.rank") == 0, "high").otherwise("medium").alias("confidence"))


def emails_text(df: DataFrame, keys: list[str], text: Column) -> DataFrame:
    """(keys, ord, value, confidence): mail addresses in a text column, lower case."""
    rows = matches(df, keys, T.squash(text), EMAIL)
    return _emails(rows.select(*keys, F.lit(1).alias("rank"), "pos", F.lower("value").alias("value")), keys)


def emails(nodes: DataFrame) -> DataFrame:
    links = nodes.where((F.col("tag") == "a") & F.startswith(attr("href"), F.lit("mailto")))
    address = F.lower(F.trim(F.split(F.regexp_replace(attr("href"), "(?i)^mailto:", ""), r"\?")[0]))
    high = links.select(*PAGE, F.lit(0).alias("rank"), F.col("node_id").alias("pos"), address.alias("value")).where(F.contains("value", F.lit("@")))
    body = matches(nodes.where("tag = 'body'"), PAGE, F.col("text"), EMAIL)
    return _emails(high.unionByName(body.select(*PAGE, F.lit(1).alias("rank"), "pos", F.lower("value").alias("value"))), PAGE)


def contact_merge(pages: DataFrame, found: DataFrame, key: Column) -> DataFrame:
    """(site, ord, value): contacts of a site, those of contact pages first, then home, then others; first of equal keys.

    pages: site, page_id, kind; found: site, page_id, ord, value.
    """
    rank = F.when(F.col("kind") == "contact", 0).when(F.col("kind") == "home", 1).otherwise(2)
    rows = found.join(pages.select(*PAGE, rank.alias("rank")), PAGE).withColumn("k", key)
    # A minimum per site and key is made before rows meet, so a large site's numbers don't.
    first = rows.groupBy("site", "k").agg(F.min(F.struct("rank", "page_id", "ord", "value")).alias("f"))
    return first.select("site", F.row_number().over(Window.partitionBy("site").orderBy("f")).alias("ord"), "f.value")


def minutes(clock: Column) -> Column:
    """Minutes after midnight of a 12-hour clock text; null for others."""
    shape = r"(?i)^\s*(\d{1,2}):(\d{2})\s*([ap])m\s*$"
    hour = F.regexp_extract(clock, shape, 1).try_cast("int") % 12 + F.when(F.lower(F.regexp_extract(clock, shape, 3)) == "p", 12).otherwise(0)
    return F.when(clock.rlike(shape), hour * 60 + F.regexp_extract(clock, shape, 2).try_cast("int"))


def to_12h(clock: Column) -> Column:
    """A 24-hour clock text as 12-hour text; other texts stay."""
    shape = r"^T?(\d{1,2}):?(\d{2})"
    hour = F.regexp_extract(clock, shape, 1).try_cast("int")
    shown = F.concat((F.when(hour % 12 == 0, 12).otherwise(hour % 12)).cast("string"), F.lit(":"), F.regexp_extract(clock, shape, 2), F.when(hour >= 12, " PM").otherwise(" AM"))
    return F.when(clock.rlike(shape) & (hour < 24), shown).otherwise(clock)


def to_24h(clock: Column) -> Column:
    m = minutes(clock)
    return F.when(m.isNull(), clock).otherwise(F.format_string("%02d:%02d", F.floor(m / 60).cast("int"), (m % 60).cast("int")))


def tel_href(c: Column) -> Column:
    """A number as a link has it: digits with a plus; ten digits are North American."""
    digits = F.regexp_replace(c, r"[^\d]", "")
    plus = F.startswith(F.trim(c), F.lit("+"))
    return F.when(digits == "", "").when(plus, F.concat(F.lit("+"), digits)).when(F.length(digits) == 10, F.concat(F.lit("+1"), digits)).when(
        (F.length(digits) == 11) & F.startswith(digits, F.lit("1")), F.concat(F.lit("+"), digits)).otherwise(digits)


def format_phone(c: Column) -> Column:
    """A number for display: (ddd) ddd-dddd for ten digits after a country code of 1; any other stays as it is, without blanks at its ends."""
    shown = F.regexp_replace(F.coalesce(c, F.lit("")), f"^{T.SPACE_CLASS}+|{T.SPACE_CLASS}+$", "")
    digits = F.regexp_replace(shown, r"[^\d+]", "")
    own = F.regexp_replace(digits, r"^\+?1", "")
    abroad = F.startswith(digits, F.lit("+")) & ~F.startswith(digits, F.lit("+1"))
    return F.when((F.length(own) == 10) & ~abroad, F.regexp_replace(own, "^(.{3})(.{3})", r"($1) $2-")).otherwise(shown)
