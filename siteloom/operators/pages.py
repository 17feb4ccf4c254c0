"""Facts of single pages from the node table, and what sites make of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteloom.functions import text as T
from siteloom.functions import url as U
from siteloom.functions.once import found, let
from siteloom.operators.intervals import PAGE, covered, enclosing

#: Words of menus, chrome and boilerplate.
NAV_WORDS = (
    "(?i)^(home|about|about us|contact|contact us|services|our services|gallery|blog|news|menu|search|login|log in|sign up|register|cart|checkout|privacy|terms"
    "|sitemap|faq|faqs|testimonials|reviews|careers|skip to content|read more|learn more|click here|back to top|next|previous)$"
)
BOILERPLATE = (
    "(?i)^(©|copyright|all rights reserved|powered by|designed by|website by|site by|privacy policy|terms of (use|service)|cookie|we use cookies|accept"
    "|subscribe|sign up for our newsletter)"
)
CHROME_TAGS = ("nav", "header", "footer", "aside")
CHROME_WORDS = r"\b(nav|navbar|menu|header|footer|sidebar|breadcrumb|cookie|banner|modal|popup)\b"
#: Builders of sites by what their pages or generators say, first match first: (name, page, generator).
PLATFORMS = (
    ("WordPress", "wp-content|wp-includes", "wordpress"),
    ("Wix", r"wix\.com|wixstatic|parastorage", None),
    ("Squarespace", "squarespace", None),
    ("Weebly", "weebly", None),
    ("GoDaddy Website Builder", r"godaddy|websitebuilder\.godaddy", None),
    ("Shopify", r"cdn\.shopify|shopify\.com", None),
    ("Joomla", "joomla", "joomla"),
    ("Drupal", "drupal", "drupal"),
    ("Duda", r"dudamobile|duda\.co", None),
    ("HubSpot CMS", "hs-sites|hubspot", None),
    ("Adobe Muse", None, r"muse\.adobe"),
    ("Microsoft FrontPage", None, "frontpage"),
    ("Dreamweaver", None, "dreamweaver"),
)


def attr(name: str) -> Column:
    return F.try_element_at("attrs", F.lit(name))


def has_word(c: Column, word: str) -> Column:
    return F.array_contains(F.split(F.lower(F.coalesce(c, F.lit(""))), r"\s+"), word)


def first_of(value: Column, rule: Column) -> Column:
    """The value at the first node that meets the rule, even if that value is null."""
    return F.min_by(F.when(rule, F.struct(value.alias("v"))), F.when(rule, F.col("node_id")))["v"]  # other nodes' values are never worked out


def count_of(rule: Column) -> Column:
    return F.count_if(F.coalesce(rule, F.lit(False))).cast("bigint")


def page_meta(nodes: DataFrame) -> DataFrame:
    """(site, page_id, meta): first non-empty content of each name, property or itemprop."""
    key = F.lower(F.coalesce(F.nullif(attr("name"), F.lit("")), F.nullif(attr("property"), F.lit("")), attr("itemprop")))
    tags = nodes.where("tag = 'meta'").select(*PAGE, "node_id", key.alias("key"), attr("content").alias("content")).where("key <> '' and content <> ''")
    first = tags.groupBy(*PAGE, "key").agg(F.min_by(T.squash(F.col("content")), "node_id").alias("value"))
    return first.groupBy(*PAGE).agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("meta"))


def page_heads(pages: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row per page: title, description, canonical, lang, robots, generator, viewport, theme_color, favicon, og, twitter and all meta."""
    rel = lambda w: has_word(attr("rel"), w)
    firsts = nodes.where(F.col("tag").isin("title", "link", "html")).groupBy(*PAGE).agg(
        first_of(F.col("text"), F.col("tag") == "title").alias("title"),
        first_of(attr("href"), (F.col("tag") == "link") & (attr("rel") == "canonical")).alias("canonical"),
        first_of(attr("lang"), F.col("tag") == "html").alias("lang"),
        first_of(attr("href"), (F.col("tag") == "link") & F.contains(attr("rel"), F.lit("icon"))).alias("icon"),
        F.bool_or((F.col("tag") == "link") & rel("stylesheet")).alias("styled"),
    )
    out = pages.select(*PAGE, "url").join(firsts, PAGE, "left").join(page_meta(nodes), PAGE, "left")
    of = lambda k: F.coalesce(F.try_element_at("meta", F.lit(k)), F.lit(""))
    address = lambda c: U.absolute(F.nullif(c, F.lit("")), F.col("url"))
    return out.select(
        *PAGE, "url", F.coalesce("title", F.lit("")).alias("title"), of("description").alias("description"),
        F.filter(F.transform(F.split(of("keywords"), ","), T.squash), lambda x: x != "").alias("keywords"),
        address(F.col("canonical")).alias("canonical"), F.substring(F.coalesce("lang", F.lit("")), 1, 5).alias("lang"),
        of("robots").alias("robots"), of("generator").alias("generator"), of("viewport").alias("viewport"), of("theme-color").alias("theme_color"),
        address(F.col("icon")).alias("favicon"),
        F.struct(of("og:title").alias("title"), of("og:description").alias("description"), address(of("og:image")).alias("image"),
                 of("og:site_name").alias("site_name"), of("og:type").alias("type"), of("og:url").alias("url")).alias("og"),
        F.struct(of("twitter:title").alias("title"), of("twitter:description").alias("description"), address(of("twitter:image")).alias("image"), of("twitter:site").alias("site")).alias("twitter"),
        F.coalesce("meta", F.create_map().cast("map<string,string>")).alias("meta"),
    )


def page_links(pages: DataFrame, nodes: DataFrame) -> DataFrame:
    """(site, page_id, node_id, url): absolute http addresses of links, without fragments."""
    links = nodes.where("tag = 'a'").select(*PAGE, "node_id", attr("href").alias("href")).where("href is not null")
    return links.join(pages.select(*PAGE, F.col("url").alias("base")), PAGE).select(*PAGE, "node_id", found(U.absolute(F.col("href"), F.col("base")), lambda u: u.isNotNull()).alias("url"))


def crawlable_links(links: DataFrame) -> DataFrame:
    """Canonical links that stay on the site and are worth a visit."""
    own = found(U.canonical(F.col("url")), lambda u: (U.site(u) == F.col("site")) & U.crawlable(u))
    return links.withColumn("_url", own).withColumn("url", F.col("_url")).drop("_url")


def main_node(nodes: DataFrame, **facts: Column) -> DataFrame:
    """(site, page_id, m_id, m_last, ...): the node of the main content, and facts of it. Its text is whole, however long."""
    classes = F.col("classes")
    rank = (
        F.when(F.col("tag") == "main", 0).when(attr("role") == "main", 1).when(attr("id") == "main", 2).when(attr("id") == "content", 3)
        .when(F.array_contains(classes, "main-content"), 4).when(F.array_contains(classes, "entry-content"), 5).when(F.col("tag") == "article", 6)
        .when(F.col("tag") == "body", 7).when(F.col("node_id") == 0, 8)
    )
    ranked = nodes.select(*PAGE, "node_id", "last_id", rank.alias("rank"), *[c.alias(name) for name, c in facts.items()]).where("rank is not null")
    return ranked.groupBy(*PAGE).agg(F.min(F.struct("rank", "node_id", "last_id", *facts)).alias("m")).select(*PAGE, F.col("m.node_id").alias("m_id"), F.col("m.last_id").alias("m_last"), *[f"m.{name}" for name in facts])


def content_nodes(nodes: DataFrame, rule: Column) -> DataFrame:
    """Nodes of the main content that meet the rule and lie in no navigation, header, footer or other chrome."""
    names = F.lower(F.concat_ws(" ", F.array_join("classes", " "), attr("id")))
    chrome = F.col("tag").isin(*CHROME_TAGS) | names.rlike(CHROME_WORDS)
    marks = nodes.withColumn("_wanted", F.coalesce(rule, F.lit(False))).withColumn("_chrome", F.coalesce(chrome, F.lit(False))).where("_wanted or _chrome")
    inside = marks.withColumn("_chrome", covered(F.col("_chrome"))).where("_wanted and not _chrome").drop("_wanted", "_chrome")
    return inside.join(main_node(nodes), PAGE).where(F.col("node_id").between(F.col("m_id"), F.col("m_last"))).drop("m_id", "m_last")


def page_headings(nodes: DataFrame) -> DataFrame:
    """(site, page_id, ord, level, text): headings of the content, by level, then place."""
    found = content_nodes(nodes, F.col("tag").isin("h1", "h2", "h3", "h4")).select(*PAGE, "node_id", F.substring("tag", 2, 1).cast("int").alias("level"), T.humanize_heading(F.col("text")).alias("text"))
    kept = found.where(let(F.col("text"), lambda t: (t != "") & ~t.rlike(NAV_WORDS) & (F.length(t) < 140)))
    return kept.select(*PAGE, F.row_number().over(Window.partitionBy(*PAGE).orderBy("level", "node_id")).alias("ord"), "level", "text")


def page_paragraphs(nodes: DataFrame, min_words: int = 8) -> DataFrame:
    """(site, page_id, ord, text): prose of the content, paragraphs before list items, first of equal starts."""
    found = content_nodes(nodes, F.col("tag").isin("p", "li")).select(*PAGE, "node_id", (F.col("tag") == "li").alias("item"), "text")
    kept = found.where((F.col("text") != "") & ~F.col("text").rlike(BOILERPLATE) & (T.word_count(F.col("text")) >= min_words) & (F.length("text") <= 1200))
    order = ["item", "node_id"]
    first = kept.withColumn("nth", F.row_number().over(Window.partitionBy(*PAGE, F.lower(F.substring("text", 1, 80))).orderBy(*order))).where("nth = 1")
    return first.select(*PAGE, F.row_number().over(Window.partitionBy(*PAGE).orderBy(*order)).alias("ord"), "text")


def page_nav(pages: DataFrame, nodes: DataFrame, most: int = 20) -> DataFrame:
    """(site, page_id, ord, label, url): links of the page's first menu."""
    classes = F.col("classes")
    rank = (
        F.when(F.col("tag") == "nav", 0).when(attr("role") == "navigation", 1).when(F.array_contains(classes, "nav"), 2).when(F.array_contains(classes, "navbar"), 3)
        .when(F.array_contains(classes, "menu"), 4).when(attr("id") == "menu", 5).when(F.array_contains(classes, "main-menu"), 6)
    )
    menu = nodes.select(*PAGE, "node_id", "last_id", rank.alias("rank")).where("rank is not null").groupBy(*PAGE).agg(F.min(F.struct("rank", "node_id", "last_id")).alias("m"))
    links = nodes.where("tag = 'a'").select(*PAGE, "node_id", F.col("text").alias("label"), attr("href").alias("href")).join(menu, PAGE)
    links = links.where(F.col("node_id").between(F.col("m.node_id"), F.col("m.last_id")) & (F.col("label") != "") & (F.col("href") != "") & (F.length("label") < 40))
    first = links.groupBy(*PAGE, F.lower("label").alias("key")).agg(F.min(F.struct("node_id", "label", "href")).alias("f"))
    ranked = first.select(*PAGE, F.row_number().over(Window.partitionBy(*PAGE).orderBy("f.node_id")).alias("ord"), "f.label", "f.href").where(F.col("ord") <= most)
    return ranked.join(pages.select(*PAGE, F.col("url").alias("base")), PAGE).select(*PAGE, "ord", "label", U.absolute(F.col("href"), F.col("base")).alias("url"))


def _platform(page: Column | None, generator: Column | None) -> Column:
    """The number of the first site builder that the page's text or its generator names, else that of none."""
    rules = [(i, c, words) for i, (_, *by) in enumerate(PLATFORMS) for c, words in zip((page, generator), by) if words and c is not None]
    return F.coalesce(*[F.when(c.rlike(f"(?i){words}"), F.lit(i)) for i, c, words in rules], F.lit(len(PLATFORMS)))


def page_audit(pages: DataFrame, nodes: DataFrame) -> DataFrame:
    """Counts and yes-or-no facts of each page, with its head. A layout table is one for presentation or without header cells."""
    tag = F.col("tag")
    tables = nodes.where((tag == "table") & ~F.coalesce(F.lower(attr("role")) == "presentation", F.lit(False))).select(*PAGE, F.col("node_id").alias("o_id"), F.col("last_id").alias("o_last"))
    headed = enclosing(nodes.where("tag = 'th'").select(*PAGE, "node_id"), tables).groupBy(*PAGE).agg(F.count_distinct("o_id").alias("headed"))
    counts = nodes.groupBy(*PAGE).agg(
        count_of(tag == "img").alias("images"), count_of((tag == "img") & (F.trim(F.coalesce(attr("alt"), F.lit(""))) == "")).alias("images_no_alt"),
        count_of(tag == "script").alias("scripts"), count_of((tag == "link") & (attr("rel") == "stylesheet")).alias("stylesheets"),
        count_of(attr("style").isNotNull()).alias("inline_styled"), count_of(tag == "table").alias("tables"),
        F.coalesce(first_of(T.word_count(F.col("text")), tag == "body"), first_of(T.word_count(F.col("text")), F.col("node_id") == 0), F.lit(0)).cast("bigint").alias("words"),
        count_of(tag == "h1").alias("h1"), count_of(tag.isin("font", "center", "marquee", "blink")).alias("dated"), count_of(tag.isin("frameset", "frame")).alias("frames"),
        count_of((tag == "meta") & (F.lower(attr("http-equiv")) == "refresh")).alias("refreshes"),
        count_of((tag == "script") & (attr("type") == "application/ld+json")).alias("json_ld"),
    )
    zero = ["images", "images_no_alt", "scripts", "stylesheets", "inline_styled", "tables", "words", "h1", "dated", "frames", "refreshes", "json_ld", "headed"]
    # What the text of a page tells is read before any shuffle, which then moves a few short columns.
    told = pages.select(*PAGE, F.length("html").cast("bigint").alias("bytes"), F.col("html").rlike(r"(?i)\.swf|shockwave-flash").alias("flash"), _platform(F.col("html"), None).alias("built"))
    out = page_heads(pages, nodes).join(counts, PAGE, "left").join(headed, PAGE, "left").fillna(0, zero).join(told, PAGE)
    names = F.array(*[F.lit(name) for name, *_ in PLATFORMS], F.lit(""))
    return out.select(
        "*", (F.col("tables") - F.col("headed")).alias("layout_tables"), (F.col("viewport") != "").alias("has_viewport"), (F.col("json_ld") > 0).alias("has_structured_data"),
        F.startswith("url", F.lit("https:")).alias("has_https"), F.get(names, F.least("built", _platform(None, F.coalesce("generator", F.lit(""))))).alias("platform"),
    ).drop("headed", "built")


def audit_flags(audit: DataFrame) -> DataFrame:
    """(site, page_id, code, text, n): one row per thing that is wrong with a page."""
    n = lambda c: F.col(c).cast("string")
    title = F.length("title")
    # Codes and message texts.
    rules = [
        ("no_viewport", ~F.col("has_viewport"), F.lit("No viewport meta tag — the page does not adapt to phones."), None),
        ("no_https", ~F.col("has_https"), F.lit('Served over HTTP, so browsers show a "Not secure" warning.'), None),
        ("no_description", F.col("description") == "", F.lit("No meta description — Google invents its own snippet."), None),
        ("no_title", title == 0, F.lit("No page title."), None),
        ("long_title", title > 65, F.concat(F.lit("Page title is "), title.cast("string"), F.lit(" characters and gets truncated in search results.")), title),
        ("no_h1", F.col("h1") == 0, F.lit("No `<h1>` heading — weakens search relevance."), None),
        ("many_h1", F.col("h1") > 1, F.concat(n("h1"), F.lit(" `<h1>` headings on one page.")), F.col("h1")),
        ("no_alt", F.col("images_no_alt") > 0, F.concat(n("images_no_alt"), F.lit(" of "), n("images"), F.lit(" images have no alt text (accessibility + SEO).")), F.col("images_no_alt")),
        ("layout_tables", F.col("layout_tables") > 0, F.concat(n("layout_tables"), F.lit(" table(s) used for page layout — a pre-2010 technique.")), F.col("layout_tables")),
        ("dated_tags", F.col("dated") > 0, F.lit("Uses deprecated `<font>` / `<center>` / `<marquee>` tags."), F.col("dated")),
        ("flash", F.col("flash"), F.lit("References Adobe Flash, which no browser has supported since 2020."), None),
        ("frames", F.col("frames") > 0, F.lit("Built with HTML frames."), F.col("frames")),
        ("inline_styles", F.col("inline_styled") > 30, F.concat(n("inline_styled"), F.lit(" elements carry inline styles, making restyling expensive.")), F.col("inline_styled")),
        ("refresh", F.col("refreshes") > 0, F.lit("Uses a meta-refresh redirect."), None),
        ("no_json_ld", ~F.col("has_structured_data"), F.lit("No structured data (schema.org) — no rich results in Google."), None),
        ("heavy", F.col("bytes") > 400_000, F.concat(F.lit("HTML document is "), F.round(F.col("bytes") / 1024).cast("bigint").cast("string"), F.lit(" KB before images load.")), F.col("bytes")),
    ]
    rows = F.array(*[F.when(rule, F.struct(F.lit(i).alias("rule"), F.lit(code).alias("code"), text.alias("text"), (F.lit(None) if k is None else k).cast("bigint").alias("n"))) for i, (code, rule, text, k) in enumerate(rules)])
    return audit.select(*PAGE, F.explode(F.filter(rows, lambda x: x.isNotNull())).alias("f")).select(*PAGE, "f.*")


def site_audit(audit: DataFrame) -> DataFrame:
    return audit.groupBy("site").agg(
        F.count("*").alias("pages"), F.coalesce(F.min_by("platform", F.when(F.col("platform") != "", F.col("page_id"))), F.lit("")).alias("platform"),
        F.bool_and("has_viewport").alias("mobile"), F.bool_and("has_https").alias("https"), F.bool_or("has_structured_data").alias("structured_data"),
        *[F.sum(c).alias(c) for c in ("images", "images_no_alt", "words", "bytes")],
    )


def audit_flag_counts(flags: DataFrame) -> DataFrame:
    """(site, ord, text, pages): flags that differ in numbers only, counted together, most frequent first."""
    key = F.regexp_replace("text", r"\b\d+\b", "N")
    groups = flags.groupBy("site", key.alias("key")).agg(F.count("*").alias("pages"), F.min(F.struct("page_id", "rule", "text")).alias("first"))
    return groups.select("site", F.row_number().over(Window.partitionBy("site").orderBy(F.desc("pages"), "first.page_id", "first.rule")).alias("ord"), F.col("first.text").alias("text"), "pages")


def content_duplicates(pages: DataFrame) -> DataFrame:
    """(site, page_id, url, reason): pages with the length and first 2000 characters of an earlier page of the site."""
    order = Window.partitionBy("site", "bytes", F.xxhash64(F.substring("html", 1, 2000)), F.substring("html", 1, 2000)).orderBy("page_id")
    return pages.select("site", "page_id", "url", F.row_number().over(order).alias("nth")).where("nth > 1").select("site", "page_id", "url", F.lit("duplicate of an already-crawled page").alias("reason"))


def home_page(pages: DataFrame) -> DataFrame:
    kind = U.page_kind(F.col("url"))["kind"]
    return pages.groupBy("site").agg(F.min(F.struct((kind != "home").alias("other"), "page_id", "url")).alias("h")).select("site", F.col("h.page_id").alias("page_id"), F.col("h.url").alias("url"))


def about_body(pages: DataFrame, paragraphs: DataFrame, most: int = 4) -> DataFrame:
    """(site, ord, text): the longest paragraphs of home and about pages."""
    own = pages.where(U.page_kind(F.col("url"))["kind"].isin("home", "about")).select(*PAGE)
    order = Window.partitionBy("site").orderBy(F.desc(F.length("text")), "page_id", "ord")
    ranked = paragraphs.join(own, PAGE).withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most)
    return ranked.select("site", F.col("nth").alias("ord"), "text")


def frontier_new(links: DataFrame, seen: DataFrame) -> DataFrame:
    """Links not seen yet, each once."""
    return links.select("site", "url").distinct().join(seen.select("site", "url"), ["site", "url"], "left_anti")


def frontier_topn(candidates: DataFrame, n: int = 20) -> DataFrame:
    """(site, ord, url, kind, score) of candidates(site, url, ord): best score first, then first discovered; n for each site."""
    scored = candidates.withColumn("_k", U.page_kind(F.col("url")))
    order = Window.partitionBy("site").orderBy(F.desc("_k.score"), "ord")
    return scored.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= n).select("site", F.col("nth").alias("ord"), "url", "_k.kind", "_k.score")


def crawl_reach(start: DataFrame, links: DataFrame, max_pages: int = 20) -> DataFrame:
    """(site, url, hops): pages reached from start(site, url) over links(site, url, target), at most so many a site.

    A round joins the last pages to their links; where the budget cuts a round, better kinds of pages go first. Rounds go on
    until one adds nothing: at most max_pages, since each adds a page to every site that goes on.
    """
    reached = start.select("site", "url").distinct().select("site", "url", F.lit(0).alias("hops"))
    last = reached
    for hop in range(1, max_pages + 1):
        found = last.select("site", "url").join(links, ["site", "url"]).select("site", F.col("target").alias("url")).distinct().join(reached, ["site", "url"], "left_anti")
        used = reached.groupBy("site").agg(F.count("*").alias("used"))
        order = Window.partitionBy("site").orderBy(F.desc(U.page_kind(F.col("url"))["score"]), "url")
        last = found.withColumn("nth", F.row_number().over(order)).join(used, "site").where(F.col("nth") + F.col("used") <= max_pages).select("site", "url", F.lit(hop).alias("hops")).checkpoint()
        if last.isEmpty():
            break
        reached = reached.union(last)
    return reached


def crawl_stats(pages: DataFrame, seen: DataFrame) -> DataFrame:
    """(site, pages, bytes, discovered)."""
    return pages.groupBy("site").agg(F.count("*").alias("pages"), F.sum("bytes").alias("bytes")).join(
        seen.groupBy("site").agg(F.countDistinct("url").alias("discovered")), "site", "left").fillna(0, ["discovered"])


def items_merge(items: DataFrame, group: list[str], key: Column, order: list[str]) -> DataFrame:
    """The first row of each group and key; rows with a null key go."""
    return items.withColumn("_key", key).where("_key is not null").withColumn("_nth", F.row_number().over(Window.partitionBy(*group, "_key").orderBy(*order))).where("_nth = 1").drop("_key", "_nth")
