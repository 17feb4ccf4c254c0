"""From the pages of sites to one row of facts a site.

Every extractor gives rows of one shape: the site, what kind of fact it is, a key, the place that decides which of equal keys stays,
a number to add up and the fact itself as JSON. Equal keys are combined before a site's facts meet, so a site of very many
pages sends what differs only. The table of facts is written in buckets by site with one exchange; whatever merges a
site's facts after that finds them in one place.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteloom.functions import text as T
from siteloom.functions import url as U
from siteloom.operators import brand as B
from siteloom.operators import contacts as K
from siteloom.operators import content as X
from siteloom.operators import harvest as H
from siteloom.operators import jsonld as J
from siteloom.operators import media as M
from siteloom.operators import pages as P
from siteloom.operators import places as A
from siteloom.operators import themes as N
from siteloom.operators.pages import PAGE, attr
from siteloom.operators.state import written, written_by
from siteloom.sources.social import social_gaps

ABOUT, PAGE_PARAGRAPHS = 4, 25
#: Field types of the facts that aren't texts only.
SHAPES = {
    "head": "url string, title string, description string, keywords array<string>, theme_color string, og struct<title:string,description:string,image:string,site_name:string>, h1 string, paragraph string, page_id bigint, kind string",
    "paragraph": "page_id bigint, kind string, text string", "leaf": "text string, number double, list array<string>", "hit": "page_id bigint", "phone": "value string", "email": "value string",
    "child": "page_id bigint, kind string, name string, text string, role string, image string, price string, rating double, date string",
    "address": "street string, street2 string, city string, region string, postal_code string, country string", "hours": "days array<struct<day:int,closed:boolean,opens:string,closes:string,note:string>>",
    "service": "name string, summary string, price string, image string, sourceUrl string", "quote": "quote string, author string, rating double, date string", "question": "question string, answer string", "person": "name string, role string, bio string",
    "image": "url string, alt string, title string, width int, height int, role string", "mark": "page_id bigint, step int, url string, alt string", "network": "network string, url string", "status": "label string, status string, ask string",
}
#: Columns of jsonld_profile() by the field of a leaf that holds them.
NUMBERS, LISTS = ("lat", "lng"), ("service_area",)


def fact(df: DataFrame, kind: str, key: Column | None, place: list[Column | str], value: Column, n: Column | None = None) -> DataFrame:
    """Rows of the fact table. place: numbers; of equal keys the row with the lowest stays."""
    return df.select("site", F.lit(kind).alias("fact"), (F.lit("") if key is None else key).alias("key"), F.array(*[(F.col(c) if isinstance(c, str) else c).cast("bigint") for c in place]).alias("place"), F.to_json(value).alias("v"), (F.lit(1) if n is None else n).cast("bigint").alias("n"))


def header_images(pages: DataFrame, nodes: DataFrame) -> DataFrame:
    """(site, page_id, step, node_id, url, alt): the first image in a page's header (step 1) and the first in a link home (step 2)."""
    has = lambda name: F.array_contains("classes", name)
    rank = F.when(F.col("tag") == "header", 0).when(has("header") | (attr("id") == "header") | has("site-header") | has("navbar"), 1)
    span = F.struct(F.col("node_id").alias("a"), F.col("last_id").alias("b"))
    header = nodes.select(*PAGE, "node_id", rank.alias("r"), span.alias("span")).where("r is not null").groupBy(*PAGE).agg(F.min_by("span", F.struct("r", "node_id")).alias("span")).withColumn("step", F.lit(1))
    home = nodes.where((F.col("tag") == "a") & ((attr("href") == "/") | (attr("rel") == "home"))).groupBy(*PAGE).agg(F.min_by(span, "node_id").alias("span")).withColumn("step", F.lit(2))
    imgs = nodes.where("tag = 'img'").select(*PAGE, "node_id", attr("src").alias("src"), attr("data-src").alias("later"), T.squash(attr("alt")).alias("alt")).join(header.unionByName(home), PAGE)
    imgs = imgs.where(F.col("node_id").between(F.col("span.a"), F.col("span.b"))).withColumn("src", F.coalesce(F.nullif("src", F.lit("")), F.when(F.col("step") == 1, F.col("later"))))
    first = imgs.groupBy(*PAGE, "step").agg(F.min_by(F.struct("node_id", "src", "alt"), "node_id").alias("i")).join(pages.select(*PAGE, F.col("url").alias("base")), PAGE)
    return first.select(*PAGE, "step", "i.node_id", U.absolute(F.col("i.src"), F.col("base")).alias("url"), "i.alt").where("url is not null")


def page_facts(pages: DataFrame, nodes: DataFrame, stylesheets: DataFrame | None = None, social: DataFrame | None = None) -> DataFrame:
    """(site, fact, key, place, v, n) of pages(site, page_id, url) and their node table; stylesheets(site, url, css); social as from social_status()."""
    kinds = pages.select(*PAGE, "url", U.page_kind(F.col("url"))["kind"].alias("kind"))
    turn = F.when(F.col("kind") == "contact", 0).when(F.col("kind") == "home", 1).otherwise(2)
    other = F.col("kind") != "home"
    of_page = lambda df, *columns: df.join(kinds.select(*PAGE, *columns), PAGE)
    whole = lambda df, drop=(): F.struct(*[c for c in df.columns if c not in ("site", *drop)])
    headings = P.page_headings(nodes).where("level = 1").groupBy(*PAGE).agg(F.min_by("text", "ord").alias("h1"))
    # What several facts are made of is worked out once.
    prose = written(P.page_paragraphs(nodes).where(F.col("ord") <= PAGE_PARAGRAPHS), "prose")
    firsts = prose.where("ord = 1").select(*PAGE, F.col("text").alias("paragraph"))
    heads = of_page(P.page_heads(pages, nodes).drop("url"), "url", "kind").join(headings, PAGE, "left").join(firsts, PAGE, "left")
    heads = heads.select("site", "url", "title", "description", "keywords", "theme_color", F.struct("og.title", "og.description", "og.image", "og.site_name").alias("og"), "h1", "paragraph", "page_id", "kind")
    objects = written(J.jsonld_nodes(nodes), "objects")
    business, children = J.jsonld_profile(objects), J.jsonld_children(objects)
    leaves = [F.struct(F.lit(c).alias("k"), F.to_json(F.struct(F.col(c).alias("number" if c in NUMBERS else "list" if c in LISTS else "text"))).alias("v"), F.col(c).isNotNull().alias("some")) for c in business.columns if c not in PAGE]
    leaf = business.select(*PAGE, F.explode(F.array(*leaves)).alias("x")).where("x.some").select("site", "page_id", "x.k", F.from_json("x.v", SHAPES["leaf"]).alias("x"))
    days = lambda df, note: df.groupBy(*PAGE).agg(F.sort_array(F.collect_list(F.struct(F.col("day").cast("int").alias("day"), "closed", "opens", "closes", note.alias("note")))).alias("days"))
    read, said = days(A.page_hours(nodes), F.col("note")), days(J.jsonld_hours(objects), F.lit(""))
    blocks = X.labelled_blocks(nodes)
    services, quotes, asked, people = X.page_services(nodes, blocks=blocks), X.page_testimonials(nodes), X.page_faqs(nodes), X.page_team(nodes, blocks=blocks)
    images = M.page_images(pages, nodes)
    css = written(B.css_sources(nodes, stylesheets if stylesheets is not None else nodes.sparkSession.createDataFrame([], "site string, url string, css string")), "css")
    longest = prose.withColumn("nth", F.row_number().over(P.Window.partitionBy(*PAGE).orderBy(F.desc(F.length("text")), "ord"))).where(F.col("nth") <= ABOUT)
    same = J.jsonld_social(objects).withColumn("network", N.network(F.col("url"))).where("network is not null")
    marks = header_images(pages, nodes)
    parts = [
        fact(kinds, "pages", None, [other.cast("int"), "page_id"], F.struct("url")), fact(heads, "head", None, [other.cast("int"), "page_id"], whole(heads)),
        fact(of_page(longest, "kind"), "paragraph", F.concat_ws(":", "page_id", "ord"), [-F.length("text"), other.cast("int"), "page_id", "ord"], F.struct("page_id", "kind", "text")),
        fact(leaf, "leaf", F.col("k"), [-F.col("page_id")], F.col("x")), fact(business.select(*PAGE).unionByName(children.select(*PAGE)), "hit", None, [-F.col("page_id")], F.struct("page_id")),
        fact(children, "child", F.concat_ws(":", "page_id", "kind", "ord"), ["page_id", "ord"], whole(children, ("ord",))),
        fact(of_page(K.phones(nodes), "kind"), "phone", F.right(F.regexp_replace("value", r"\D", ""), F.lit(10)), [turn, "page_id", "ord"], F.struct("value")), fact(of_page(K.emails(nodes), "kind"), "email", F.col("value"), [turn, "page_id", "ord"], F.struct("value")),
        fact(of_page(A.page_address(nodes), "kind"), "address", None, [turn, "page_id"], F.struct("street", "street2", "city", "region", "postal_code", "country")), fact(of_page(read, "kind"), "hours", None, [turn, "page_id"], F.struct("days")),
        fact(said, "stated_hours", None, [-F.col("page_id")], F.struct("days")), fact(N.social_links(P.page_links(pages, nodes)), "network", F.col("network"), [F.lit(0), -F.col("page_id")], F.struct("network", "url")),
        fact(same, "network", F.col("network"), [F.lit(1), -F.col("page_id")], F.struct("network", "url")),
        fact(of_page(services, "url"), "service", T.slug(F.col("name")), ["page_id", "ord"], F.struct("name", "summary", F.col("url").alias("sourceUrl"))), fact(quotes, "quote", F.lower(F.substring("quote", 1, 60)), ["page_id", "ord"], F.struct("quote", "author")),
        fact(asked, "question", F.lower("question"), ["page_id", "ord"], F.struct("question", "answer")), fact(people, "person", F.lower("name"), ["page_id", "ord"], F.struct("name", "role", "bio")),
        fact(images, "image", F.col("url"), ["page_id", "later", "node_id"], F.struct("url", "alt", "title", "width", "height", "role")), fact(marks, "mark", F.concat_ws(":", "page_id", "step"), ["page_id", "step"], F.struct("page_id", "step", "url", "alt")),
        fact(B.css_colours(css), "colour", F.col("hex"), [F.lit(0)], F.struct("hex"), F.col("score")), fact(B.css_fonts(css, nodes), "font", F.col("font"), [F.lit(0)], F.struct("font"), F.col("n")),
    ]
    if social is not None:
        asks = social_gaps(social).select("site", "url", "ask")
        known = social.join(asks, ["site", "url"], "left")
        parts.append(fact(known, "status", F.concat_ws(" ", "label", "url"), [F.lit(0)], F.struct("label", "status", "ask")))
    return reduce(DataFrame.unionByName, parts)


def site_facts(facts: DataFrame, buckets: int | None = None) -> DataFrame:
    """The facts of each site, equal keys combined, in a table of buckets by site."""
    combined = facts.groupBy("site", "fact", "key").agg(F.min_by("v", "place").alias("v"), F.min("place").alias("place"), F.sum("n").alias("n"))
    return written_by(combined, "site", "facts", buckets)


def site_harvest(facts: DataFrame) -> DataFrame:
    """A row per site of site_facts(), with the columns that draft_profiles() reads."""
    def rows(kind: str, shape: str | None = None) -> Column:
        """The facts of a kind in their order, as (place, key, v)."""
        own = F.struct("place", "key", F.from_json("v", SHAPES[shape or kind]).alias("v"))
        return F.sort_array(F.collect_list(F.when(F.col("fact") == kind, own))).alias(kind)

    kinds = [k for k in SHAPES] + ["stated_hours"]
    number = F.sum(F.when(F.col("fact") == "pages", F.col("n"))).alias("pages")
    start = F.min_by(F.from_json("v", "url string")["url"], F.when(F.col("fact") == "pages", F.col("place"))).alias("start")
    sites = facts.groupBy("site").agg(number, start, *[rows(k, "hours" if k == "stated_hours" else None) for k in kinds])
    # One scan gives the sheets' colours and the home page's own; a union of two would lose the buckets.
    own = F.col("fact") == "colour"
    shades = facts.where("fact in ('colour', 'head')").select(
        "site", F.when(own, F.col("key")).otherwise(B.C.colour_parse(F.from_json("v", SHAPES["head"])["theme_color"])).alias("hex"), F.when(own, F.col("n")).otherwise(B.THEME_COLOUR).alias("score"))
    palette = B.brand_palette(shades.where("hex is not null and hex not in ('#000000', '#ffffff')").groupBy("site", "hex").agg(F.sum("score").alias("score")))
    fonts = B.brand_fonts(facts.where("fact = 'font'").select("site", F.col("key").alias("font"), "n"))
    each = sites.join(palette, "site", "left").join(fonts, "site", "left")
    values = lambda kind: F.transform(kind, lambda r: r["v"])
    head = F.get("head", F.lit(0))["v"]
    hit = F.get("hit", F.lit(0))["v"]["page_id"]
    each = each.withColumn("h", head).withColumn("stated_rows", F.filter(values("child"), lambda c: c["page_id"] == hit)).withColumn("leaves", F.map_from_entries(F.transform("leaf", lambda r: F.struct(r["key"], r["v"]))))
    leaf = lambda name: F.try_element_at("leaves", F.lit(name))["number" if name in NUMBERS else "list" if name in LISTS else "text"].alias(name)
    stated = F.when(F.size("leaves") > 0, F.struct(*[leaf(c) for c in ("name", "category", "phone", "email", "street", "city", "region", "postal_code", "country", "lat", "lng", "legal_name", "price_range", "founded", "service_area")]))
    child = lambda kind, make: F.transform(F.filter("stated_rows", lambda c: c["kind"] == kind), make)
    text = lambda c, name: F.coalesce(c, F.lit("")).alias(name)
    none = F.lit(None).cast("string")
    service = lambda s: F.struct(s["name"].alias("name"), text(s["text"], "summary"), s["price"].alias("price"), s["image"].alias("image"), none.alias("sourceUrl"))
    merged = lambda first, rest, key: H.first_of_each(F.concat(first, rest), key)
    first_page = F.array_min(F.transform("mark", lambda r: r["v"]["page_id"]))
    pictures = values("image")
    alt_of = lambda url, other: F.coalesce(F.get(F.filter(pictures, lambda i: i["url"] == url), F.lit(0))["alt"], other)
    logo = F.coalesce(F.get(F.filter(pictures, lambda i: i["role"] == "logo"), F.lit(0))["url"], F.get(F.filter(values("mark"), lambda m: m["page_id"] == F.col("first_id")), F.lit(0))["url"], F.lit(""))
    usable = F.filter(pictures, lambda i: ~i["role"].isin("logo", "icon"))
    hero = F.coalesce(F.get(F.filter(pictures, lambda i: i["role"] == "hero"), F.lit(0))["url"], F.nullif(F.col("h.og.image"), F.lit("")), F.get(F.filter(usable, lambda i: i["width"] >= 600), F.lit(0))["url"], F.get(usable, F.lit(0))["url"], F.lit(""))
    each = each.withColumn("first_id", F.coalesce(first_page, F.lit(-1))).withColumn("logo", logo).withColumn("hero", hero)
    shown = F.slice(F.filter(pictures, lambda i: ~i["role"].isin("logo", "icon", "background") & F.coalesce(i["width"] >= 300, F.lit(True)) & (i["url"] != F.col("logo")) & (i["url"] != F.col("hero"))), 1, M.GALLERY_MOST)
    own_text = F.filter(values("paragraph"), lambda p: p["kind"].isin("home", "about") | (p["page_id"] == F.col("h.page_id")))
    hours = F.coalesce(F.get("hours", F.lit(0))["v"]["days"], F.get("stated_hours", F.lit(0))["v"]["days"])
    host = F.regexp_replace(U.site(F.col("start")), r"^www\.", "")
    return each.select(
        "site", F.col("start").alias("url"), "pages", T.slug(F.get(F.split(host, r"\."), F.lit(0)), "client").alias("slug"), "h.title", "h.description", "h.keywords", "h.og", "h.h1", F.filter(F.array("h.paragraph"), lambda x: x.isNotNull()).alias("paragraphs"),
        F.slice(F.transform(own_text, lambda p: p["text"]), 1, ABOUT).alias("about"), stated.alias("stated"), F.transform(values("phone"), lambda x: x["value"]).alias("phones"), F.transform(values("email"), lambda x: x["value"]).alias("emails"),
        F.get(values("address"), F.lit(0)).alias("address"), hours.alias("hours"), F.struct(text(F.col("primary"), "primary"), text(F.col("secondary"), "secondary"), text(F.col("accent"), "accent")).alias("colours"), F.struct(text(F.col("heading"), "heading"), text(F.col("body"), "body")).alias("fonts"),
        F.map_from_entries(F.transform(values("network"), lambda x: F.struct(x["network"], x["url"]))).alias("social"),
        merged(child("service", service), F.transform(values("service"), lambda s: s), lambda s: T.slug(s["name"])).alias("services"),
        merged(child("review", lambda c: F.struct(c["text"].alias("quote"), text(c["name"], "author"), c["rating"].alias("rating"), c["date"].alias("date"))), values("quote"), lambda q: F.lower(F.substring(q["quote"], 1, 60))).alias("testimonials"),
        merged(child("faq", lambda c: F.struct(c["name"].alias("question"), c["text"].alias("answer"))), values("question"), lambda q: F.lower(q["question"])).alias("faqs"),
        merged(child("person", lambda c: F.struct(c["name"].alias("name"), text(c["role"], "role"), text(c["text"], "bio"))), values("person"), lambda m: F.lower(m["name"])).alias("team"),
        F.transform(shown, lambda i: F.struct(i["url"].alias("src"), i["alt"].alias("alt"), i["title"].alias("caption"), F.when(i["role"] == "team", "team").otherwise("").alias("category"))).alias("gallery"), "logo", "hero", alt_of(F.col("logo"), F.lit("")).alias("logo_alt"),
        F.transform(values("status"), lambda s: F.concat(s["label"], F.lit(": "), s["status"])).alias("social_sources"), F.filter(F.transform(values("status"), lambda s: F.concat(s["label"], F.lit(": "), s["ask"])), lambda x: x.isNotNull()).alias("social_gaps"),
    )


def harvest_sites(pages: DataFrame, nodes: DataFrame, stylesheets: DataFrame | None = None, social: DataFrame | None = None, buckets: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(harvest, drafts): the facts of each site in a row, and the profile that they make, from crawled pages in one call.

    Sites without any page have no row; pages without text still count as pages. Of structured data the last page that has any counts
    for lists and the last that states a field for fields; contacts come from the contact page first, then home; images, services, quotes,
    questions and people in the order of pages.
    """
    harvest = written(site_harvest(site_facts(page_facts(pages, nodes, stylesheets, social), buckets)), "harvest")
    return harvest, H.draft_profiles(harvest)
