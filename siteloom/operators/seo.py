"""On-page findings of whole sites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteloom.functions import text as T
from siteloom.functions import url as U
from siteloom.operators.pages import PAGE, attr, count_of, first_of, page_links

TITLE_MOST, TITLE_LEAST, DESC_MOST, DESC_LEAST, THIN_WORDS = 60, 15, 160, 70, 150


def seo_facts(pages: DataFrame, nodes: DataFrame) -> DataFrame:
    """Title, description, canonical, headings, words and links of each page, and its text in lower case."""
    tag = F.col("tag")
    told = nodes.where(tag.isin("title", "meta", "link", "main", "body", "h1", "img", "script") | (F.col("node_id") == 0))  # each page has a first node
    firsts = told.groupBy(*PAGE).agg(
        F.coalesce(first_of(F.col("text"), tag == "title"), F.lit("")).alias("title"),
        F.coalesce(first_of(attr("content"), (tag == "meta") & (attr("name") == "description")), F.lit("")).alias("desc"),
        F.coalesce(first_of(attr("href"), (tag == "link") & (attr("rel") == "canonical")), F.lit("")).alias("canonical"),
        F.coalesce(first_of(F.col("text"), tag == "main"), first_of(F.col("text"), tag == "body"), first_of(F.col("text"), F.col("node_id") == 0), F.lit("")).alias("main"),
        F.transform(F.sort_array(F.collect_list(F.when((tag == "h1") & (F.col("text") != ""), F.struct("node_id", "text")))), lambda x: x["text"]).alias("h1s"),
        count_of(tag == "img").alias("images"), count_of((tag == "img") & attr("alt").isNull()).alias("no_alt"),
        F.collect_list(F.when((tag == "script") & (attr("type") == "application/ld+json"), F.coalesce("text", F.lit("")))).alias("ld"),
    )
    links = page_links(pages, nodes).join(pages.select(*PAGE, F.col("url").alias("own")), PAGE)
    links = links.where(F.startswith("url", U.origin(F.col("own"))) & (F.col("url") != F.col("own"))).groupBy(*PAGE).agg(F.sort_array(F.collect_set("url")).alias("links_out"))
    kinds = F.array_distinct(F.flatten(F.transform("ld", lambda s: F.regexp_extract_all(s, F.lit(r'"@type"\s*:\s*"([^"]+)"'), F.lit(1)))))
    none = F.array().cast("array<string>")
    out = pages.select(*PAGE, "url").join(firsts, PAGE, "left").join(links, PAGE, "left")
    return out.select(
        *PAGE, "url", "title", F.length("title").cast("bigint").alias("title_len"), "desc", F.length("desc").cast("bigint").alias("desc_len"), "canonical", F.coalesce("h1s", none).alias("h1s"),
        T.word_count(F.col("main")).alias("words"), "images", "no_alt", kinds.alias("schema"), F.coalesce("links_out", none).alias("links_out"), F.lower("main").alias("text"),
    )


def relative(url: Column, site: Column) -> Column:
    """Path and query."""
    return F.concat(U.path(url), U.query(url))


def shared_values(facts: DataFrame, column: str) -> DataFrame:
    """(site, value, pages, url): a row for each page whose non-empty value other pages of its site have, too."""
    own = facts.where(F.col(column) != "").select("site", F.col(column).alias("value"), "url")
    groups = own.groupBy("site", "value").agg(F.count("*").alias("pages")).where("pages > 1")
    return own.join(groups, ["site", "value"])


def orphans(facts: DataFrame) -> DataFrame:
    """(site, page_id, url): pages that no page of the site links to, with or without the trailing slash; the home page doesn't count."""
    linked = facts.select("site", F.explode("links_out").alias("target")).distinct()
    pages = facts.where(~((U.path(F.col("url")) == "/") & (U.query(F.col("url")) == ""))).select("site", "page_id", "url", F.regexp_replace("url", "/$", "").alias("bare"))
    one = pages.join(linked, [pages.site == linked.site, pages.url == linked.target], "left_anti")
    return one.join(linked, [one.site == linked.site, one.bare == linked.target], "left_anti").select("site", "page_id", "url")


def pages_without_place(facts: DataFrame, places: DataFrame) -> DataFrame:
    """(site, page_id, url): pages whose text has none of the site's places; sites without places are left out."""
    own = places.groupBy("site").agg(F.collect_set(F.lower("place")).alias("places"))
    return facts.join(own, "site").where(~F.exists("places", lambda p: F.contains(F.col("text"), p))).select("site", "page_id", "url")


def seo_findings(facts: DataFrame, places: DataFrame | None = None) -> DataFrame:
    """(site, level, code, what, url): rules for single pages, then shared titles and descriptions, orphans, pages without a place.

    url is path and query of a single page's finding, null for the others, whose pages finding_pages() lists.
    """
    n = lambda c: F.col(c).cast("string")
    t, d = F.col("title_len"), F.col("desc_len")
    elsewhere = F.regexp_replace(F.split("canonical", "#")[0], "/$", "") != F.regexp_replace("url", "/$", "")
    # Codes, levels and message texts, here and below.
    rules = [
        ("no_title", F.lit("high"), t == 0, F.lit("No page title")),
        ("long_title", F.when(t > 75, "medium").otherwise("low"), t > TITLE_MOST, F.concat(F.lit("Title is "), n("title_len"), F.lit(f" characters — Google shows about {TITLE_MOST}, so the end is cut off"))),
        ("short_title", F.lit("medium"), (t > 0) & (t < TITLE_LEAST), F.concat(F.lit("Title is only "), n("title_len"), F.lit(" characters — too little to rank on"))),
        ("no_description", F.lit("high"), d == 0, F.lit("No meta description — Google writes its own snippet")),
        ("long_description", F.lit("low"), d > DESC_MOST, F.concat(F.lit("Meta description is "), n("desc_len"), F.lit(" characters and gets truncated"))),
        ("short_description", F.lit("low"), (d > 0) & (d < DESC_LEAST), F.concat(F.lit("Meta description is only "), n("desc_len"), F.lit(" characters"))),
        ("no_h1", F.lit("high"), F.size("h1s") == 0, F.lit("No H1 heading")),
        ("many_h1", F.lit("medium"), F.size("h1s") > 1, F.concat(F.size("h1s").cast("string"), F.lit(" H1 headings on one page"))),
        ("no_canonical", F.lit("medium"), F.col("canonical") == "", F.lit("No canonical URL")),
        ("other_canonical", F.lit("high"), (F.col("canonical") != "") & elsewhere, F.concat(F.lit("Canonical points elsewhere: "), F.col("canonical"))),
        ("thin", F.lit("medium"), F.col("words") < THIN_WORDS, F.concat(F.lit("Only "), n("words"), F.lit(" words of copy — too thin to rank"))),
        ("no_alt", F.lit("medium"), F.col("no_alt") > 0, F.concat(n("no_alt"), F.lit(" of "), n("images"), F.lit(" images have no alt attribute at all"))),
        ("no_schema", F.lit("medium"), F.size("schema") == 0, F.lit("No structured data on the page")),
    ]
    each = F.array(*[F.when(rule, F.struct(level.alias("level"), F.lit(code).alias("code"), what.alias("what"))) for code, level, rule, what in rules])
    path = relative(F.col("url"), F.col("site"))
    single = facts.select("site", path.alias("url"), F.explode(F.filter(each, lambda x: x.isNotNull())).alias("f")).select("site", "f.*", "url")
    def gathered(rows: DataFrame, level: str, code: str, what: Column) -> DataFrame:
        """One finding per site and value with the number of its pages; the pages themselves are in finding_pages()."""
        return rows.groupBy("site", "value").agg(F.count("*").alias("pages")).select("site", F.lit(level).alias("level"), F.lit(code).alias("code"), what.alias("what"), F.lit(None).cast("string").alias("url"))

    many = F.col("pages").cast("string")
    parts = [
        (shared_values(facts, "title"), "high", "shared_title", F.concat(many, F.lit(' pages share the title "'), F.col("value"), F.lit('" — they compete with each other'))),
        (shared_values(facts, "desc"), "medium", "shared_description", F.concat(many, F.lit(" pages share one meta description"))),
        (orphans(facts).withColumn("value", F.lit("")), "high", "orphans", F.concat(many, F.lit(" pages are in the sitemap but linked from nowhere on the site"))),
    ]
    if places is not None:
        parts.append((pages_without_place(facts, places).withColumn("value", F.lit("")), "medium", "no_place", F.concat(many, F.lit(" pages never mention any town the business serves"))))
    out = single
    for rows, level, code, what in parts:
        out = out.unionByName(gathered(rows, level, code, what))
    return out


def finding_pages(facts: DataFrame, places: DataFrame | None = None) -> DataFrame:
    """(site, code, value, path): the pages behind the findings that several pages share, a row each."""
    parts = [(shared_values(facts, "title"), "shared_title", F.col("value")), (shared_values(facts, "desc"), "shared_description", F.col("value")), (orphans(facts), "orphans", F.lit(""))]
    if places is not None:
        parts.append((pages_without_place(facts, places), "no_place", F.lit("")))
    out = None
    for rows, code, value in parts:
        one = rows.select("site", F.lit(code).alias("code"), value.alias("value"), relative(F.col("url"), F.col("site")).alias("path"))
        out = one if out is None else out.unionByName(one)
    return out


def finding_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("site").pivot("level", ["high", "medium", "low"]).count().fillna(0, ["high", "medium", "low"])


def finding_groups(findings: DataFrame) -> DataFrame:
    """(site, level, n, label): findings that differ in numbers only; a number's place shows its range if all have it."""
    rows = findings.withColumn("shape", F.regexp_replace("what", r"\d+", "#")).withColumn("nums", F.regexp_extract_all("what", F.lit(r"(\d+)"), F.lit(1)))
    numbered = rows.select("site", "shape", "level", "what", F.posexplode_outer("nums").alias("at", "num"))
    ranges = numbered.where("at is not null").groupBy("site", "shape", "at").agg(F.min(F.col("num").cast("decimal(38,0)")).alias("lo"), F.max(F.col("num").cast("decimal(38,0)")).alias("hi"))
    shown = F.when(F.col("lo") == F.col("hi"), F.col("lo").cast("string")).otherwise(F.concat(F.col("lo").cast("string"), F.lit("–"), F.col("hi").cast("string")))
    shown = ranges.groupBy("site", "shape").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", shown.alias("t")))), lambda x: x["t"]).alias("spans"))
    groups = rows.groupBy("site", "shape").agg(F.count("*").alias("n"), F.min_by("level", F.struct("what", "level")).alias("level"))
    pieces = F.split("shape", "#")
    label = F.array_join(F.transform(pieces, lambda p, i: F.concat(p, F.coalesce(F.get("spans", i), F.lit("")))), "")
    return groups.join(shown, ["site", "shape"], "left").select("site", "level", "n", label.alias("label"))
