"""Registered queries on whole sites' profiles: messy and harvested ones written in Spark from the customer table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteloom.functions import colour as C
from siteloom.operators import harvest as V
from siteloom.operators import normalize as N
from siteloom.operators import palettes as L
from siteloom.operators import profiles as P
from siteloom.operators import site_harvest as S
from siteloom.operators.nodes import node_table
from siteloom.operators.state import spread, written


def _keys() -> tuple[Column, Column]:
    """The customer's key as text and as a number."""
    return F.col("c_custkey").cast("string"), F.col("c_custkey")


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _messy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles with parts missing, blanks, repeats, odd colours, days out of order and items without what they need."""
    k, i = _keys()
    c = spread(spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey"), "c_custkey")
    hour = lambda day, opens, closed: F.struct(F.lit(day).alias("day"), opens.alias("open"), F.lit(" 5:00 PM ").alias("close"), closed.alias("closed"))
    item = lambda name, title, price: F.struct(name.alias("name"), title.alias("title"), price.alias("price"))
    none = F.lit(None).cast("string")
    return c.select(
        _text("c", k).alias("site"),
        F.struct(_text("  Joe's   ", k, " "), F.array(F.lit("Springfield"), F.lit(" springfield"), F.lit(" "), _text("Town ", k)), F.when(i % 3 == 0, "Plumber").alias("c")).alias("b"),
        F.struct(
            F.when(i % 2 == 0, "555.867.5309").alias("phone"), F.array(F.lit("(555) 867-5309"), F.lit("+1 555 867 5309"), _text("+44 20 ", k), F.lit("")).alias("phones"),
            F.when(i % 4 == 0, _text("MAIN", k, "@B.com")).alias("email"), F.array(F.lit("A@B.com"), F.lit(" a@b.com"), F.lit("nobody")).alias("emails"),
            F.struct(F.when(i % 5 == 0, "  Sun  City ").alias("city")).alias("address"),
            F.array(hour("Sunday", F.lit("closed"), F.lit(False)), hour("tue", F.lit("9"), F.lit(None).cast("boolean")), hour("Monday", F.lit(" 8:00 AM"), F.lit(False)), hour("TUESDAY", F.lit("10:00 AM"), F.lit(False)), hour("someday", F.lit("1"), F.lit(True)), hour("", F.lit("1"), F.lit(True))).alias("hours"),
        ).alias("contact"),
        F.struct(F.struct(F.element_at(F.array(F.lit("rgb(37,99,235)"), F.lit("#ABC"), F.lit(" Navy "), F.lit("hsl(120, 100%, 25%)"), F.lit("#12345678"), F.lit("nocolour"), F.lit("#12345")), (i % 7 + 1).cast("int")).alias("primary")).alias("colors")).alias("brand"),
        F.create_map(F.lit("facebook"), _text("//fb.com/", k), F.lit("x"), F.lit(" "), F.lit("own"), F.lit("HTTP://own.example")).alias("social"),
        F.struct(F.struct(F.lit("BEST HVAC IN TOWN").alias("headline"), F.lit(" Sub ").alias("subhead")).alias("hero")).alias("content"),
        F.array(item(F.lit("AC REPAIR"), none, i.cast("string")), item(none, _text("furnace ", k), none), item(F.lit(" "), none, none), item(F.lit("ac repair!"), none, none)).alias("services"),
        F.array(F.struct(F.lit("a.jpg").alias("src")), F.struct(F.lit(" a.jpg ").alias("src")), F.struct(F.lit("").alias("src"))).alias("gallery"),
        F.array(*[F.struct(F.when(i % 2 == n, " Good  job ").alias("quote"), F.lit("Text").alias("text"), F.lit(r).alias("rating")) for n, r in enumerate(("9", "0", "x", "-2", "4.5"))]).alias("testimonials"),
        F.array(F.struct(F.lit("Q?").alias("q"), F.lit(" A ").alias("a")), F.struct(F.lit("Only").alias("q"), F.lit("").alias("a"))).alias("faqs"),
        F.array(F.struct(F.lit("Terms").alias("title"), F.array(F.struct(F.lit("").alias("heading"), F.array(F.lit(" x ")).alias("body")), F.struct(F.lit("").alias("heading"), F.array(F.lit(" ")).alias("body"))).alias("sections")), F.struct(F.lit("Bare").alias("title"), F.array().cast("array<struct<heading:string,body:array<string>>>").alias("sections"))).alias("legal"),
    ).withColumn("business", F.struct(F.col("b.col1").alias("name"), F.col("b.col2").alias("serviceArea"), F.col("b.c").alias("category"))).drop("b")


def normalize_profiles(spark, sf_dir):
    p = written(N.normalize_profiles(_messy(spark, sf_dir)), "profiles")
    joined = lambda c, field=None: F.array_join(c if field is None else F.transform(c, lambda x: F.coalesce(x[field].cast("string"), F.lit("-"))), "|")
    return p.select(
        "site", F.col("business.name").alias("name"), joined(F.col("business.serviceArea")).alias("area"), F.col("contact.phone").alias("phone"), joined(F.col("contact.phones")).alias("phones"), F.col("contact.email").alias("email"), joined(F.col("contact.emails")).alias("emails"),
        joined(F.transform("contact.hours", lambda h: F.concat_ws(" ", h["day"], h["closed"].cast("string"), h["open"], h["close"]))).alias("hours"), F.col("brand.colors.primary").alias("colour"), joined(F.array_sort(F.transform(F.map_entries("social"), lambda e: F.concat_ws("=", e["key"], e["value"])))).alias("social"),
        F.col("content.hero.headline").alias("headline"), joined(F.col("services"), "slug").alias("slugs"), joined(F.col("services"), "name").alias("services"), joined(F.col("gallery"), "src").alias("gallery"), joined(F.col("testimonials"), "quote").alias("quotes"), joined(F.col("testimonials"), "rating").alias("ratings"),
        joined(F.col("faqs"), "answer").alias("answers"), joined(F.col("legal"), "slug").alias("legal"), F.size("team").cast("bigint").alias("team"), F.col("seo.title").alias("title"), F.col("seo.description").alias("description"),
    )


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites' facts by key: some lack structured data, some a title, an address or numbers of their own."""
    k, i = _keys()
    c = spread(spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey"), "c_custkey")
    empty = F.lit("")
    stated = F.struct(_text("Stated ", k).alias("name"), F.lit("Dentist").alias("category"), _text("555", k).alias("phone"), F.lit("s@x.org").alias("email"), F.lit("9 Old St").alias("street"), F.lit("Oldtown").alias("city"), F.lit("IL").alias("region"), F.lit("62701").alias("postal_code"))
    strings = lambda *x: F.array(*[F.lit(v) if isinstance(v, str) else v for v in x])
    return c.select(
        _text("c", k).alias("site"), _text("https://www.shop", k, ".example/").alias("url"), F.when(i % 3 == 0, empty).otherwise(_text("ACME WORKS ", k, " | Home")).alias("title"), F.when(i % 4 == 0, _text("We fix it. All of it, ", k)).otherwise(empty).alias("description"), strings("a", " b").alias("keywords"),
        F.struct(F.when(i % 5 == 0, _text("Og ", k)).otherwise(empty).alias("site_name"), F.when(i % 5 == 1, "Og title").otherwise(empty).alias("title"), F.when(i % 6 == 0, "Og said! More").otherwise(empty).alias("description"), empty.alias("image")).alias("og"),
        F.when(i % 2 == 0, "WELCOME HOME").otherwise(empty).alias("h1"), strings("First paragraph of the page").alias("paragraphs"), strings("Longest", "Long").alias("about"), F.when(i % 7 == 0, stated).alias("stated"),
        F.when(i % 2 == 1, strings("(217) 555-0142", "217.555.0142")).otherwise(F.array().cast("array<string>")).alias("phones"), F.when(i % 3 == 1, strings("b@x.org")).otherwise(F.array().cast("array<string>")).alias("emails"),
        F.when(i % 4 == 1, F.struct(_text(k, " Main St").alias("street"), empty.alias("street2"), F.lit("Salem").alias("city"), F.lit("OR").alias("region"), F.lit("97301").alias("postal_code"), F.lit("US").alias("country"))).alias("address"),
        F.array(F.struct(F.lit(6).alias("day"), F.lit(True).alias("closed"), empty.alias("opens"), empty.alias("closes"), empty.alias("note")), F.struct(F.lit(0).alias("day"), F.lit(False).alias("closed"), F.lit("8:00 AM").alias("opens"), F.lit("5:00 PM").alias("closes"), empty.alias("note"))).alias("hours"),
        F.struct(F.lit("#1f3a93").alias("primary"), empty.alias("secondary"), empty.alias("accent")).alias("colours"), F.struct(F.lit("Georgia").alias("heading"), F.lit("Georgia").alias("body")).alias("fonts"), F.create_map(F.lit("x"), F.lit("x.com/a")).alias("social"),
        F.array(F.struct(_text("Job ", k).alias("name"), F.lit("Done").alias("summary")), F.struct(_text("JOB ", k).alias("name"), F.lit("again").alias("summary"))).alias("services"), F.array(F.struct(F.lit("Quote").alias("quote"), F.lit("Ann").alias("author"))).alias("testimonials"),
        F.array(F.struct(F.lit("Q?").alias("question"), F.lit("A").alias("answer"))).alias("faqs"), F.array(F.struct(F.lit("Bo").alias("name"), F.lit("Boss").alias("role"), empty.alias("bio"), F.lit("gone.jpg").alias("photo"))).alias("team"),
        F.array(F.struct(F.lit("g.jpg").alias("src"), empty.alias("alt"))).alias("gallery"), F.lit("logo.png").alias("logo"), F.when(i % 2 == 0, "hero.jpg").otherwise(empty).alias("hero"),
    )


def draft_profile(spark, sf_dir):
    a = [F.col(f"contact.address.{x}") for x in ("street", "street2", "city", "region", "postalCode")]
    return V.draft_profiles(_facts(spark, sf_dir), ("business", "contact", "content.hero", "content.about", "services.name", "team", "social", "seo.title")).select(
        "site", F.col("business.name").alias("name"), F.col("business.tagline").alias("tagline"), F.col("business.category").alias("category"), F.col("business.description").alias("about"), F.col("contact.phone").alias("phone"), F.size("contact.phones").cast("bigint").alias("phones"), F.col("contact.email").alias("email"),
        V.format_address(*a).alias("address"), F.array_join(F.transform("contact.hours", lambda h: h["day"]), "|").alias("days"), F.col("content.hero.headline").alias("headline"), F.col("content.hero.subhead").alias("subhead"), F.col("content.about.heading").alias("heading"), F.size("services").cast("bigint").alias("services"),
        F.col("team")[0]["photo"].alias("photo"), F.col("social")["x"].alias("x"), F.col("seo.title").alias("title"))


def _drafts(spark: SparkSession, sf_dir: str, parts: Sequence[str]) -> DataFrame:
    return written(V.draft_profiles(_facts(spark, sf_dir), parts), "drafts")


def harvest_report(spark, sf_dir):
    k, i = _keys()
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_custkey % 3 <> 2")
    audit = c.select(_text("c", k).alias("site"), F.lit("Wix").alias("platform"), (i % 2 == 0).alias("mobile"), F.lit(True).alias("https"), F.lit(False).alias("structured_data"), i.alias("images"), F.lit(1).cast("bigint").alias("images_no_alt"))
    flags = c.select(_text("c", k).alias("site"), F.explode(F.array(F.lit("no_h1"), F.lit("no_h1"), F.when(i % 2 == 0, "flash").otherwise("heavy"))).alias("code"))
    return V.harvest_report(_drafts(spark, sf_dir, V.REPORT_PARTS), audit, flags).select("site", "name", "percent", F.array_join("gaps", "|").alias("gaps"), "platform", "mobile", "images_no_alt", "flags", "hours", "services", "testimonials", "faqs", "team")


def brief_rows(spark, sf_dir):
    """Every site's copy, gaps and tasks; every tenth has pages of networks."""
    k, i = _keys()
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    paragraphs = c.select(_text("c", k).alias("site"), F.explode(F.array(F.lit(1), F.lit(2))).alias("page_id"), "c_custkey")
    paragraphs = paragraphs.select("site", "page_id", F.posexplode(F.expr("transform(sequence(1, 11 + c_custkey % 4), i -> concat('p', i))")).alias("pos", "text")).select("site", "page_id", (F.col("pos") + 1).alias("ord"), "text")
    social = c.where("c_custkey % 10 = 0").select(_text("c", k).alias("site"), F.lit("X").alias("label"), F.lit("https://x.com/a").alias("url"), F.when(i % 20 == 0, "ok").otherwise("login-walled").alias("status"), F.lit("A bio").alias("description"))
    return V.brief_rows(_drafts(spark, sf_dir, V.BRIEF_PARTS), paragraphs, social)


def normalize_dynamic(spark, sf_dir):
    """Profiles as JSON text, whose values are texts, lists, numbers or items by key; every eleventh is no JSON."""
    k, i = _keys()
    c = spread(spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey"), "c_custkey")
    some = lambda n, *choices: F.element_at(F.array(*[_text(x) if isinstance(x, str) else x for x in choices]), (i % n + 1).cast("int"))
    json = _text(
        '{"slug": "Firm ', k, '", "business": {"name": "Firm ', k, '", "founded": ', some(2, "1999", '" 2001 "'), ', "serviceArea": ', some(3, '"Town"', '["Town", " town", "Area"]', "null"), ', "licenses": [7, ""], "employees": 12}, "contact": {"phones": ', some(2, '"1555123456"', '["+65 6123 4567", "217.555.0142"]'),
        ', "geo": {"lat": 1.5, "lng": "2.5"}, "hours": ', some(3, '"Mon-Fri"', '[{"day": "Su", "open": "9", "closed": true}, null]', '{"day": "friday", "open": "9:00 AM", "close": "5:00 PM"}'), '}, "gallery": ', some(3, '"a.jpg"', '["a.jpg", {"src": "b.jpg", "alt": "B"}, "a.jpg"]', "[]"), ', "legal": [{"title": "Terms", "sections": ', some(2, '{"heading": "H", "body": " one text "}', '[{"body": ["a", "", "b"]}, {"heading": ""}]'),
        '}], "services": [{"name": "JOB ', k, '", "description": ', some(3, '"One  text"', '["Two", "", "texts"]', "null"), ', "strapline": " s ", "features": "f", "price": 25, "cta": ', some(2, '{"label": "Go"}', '{"href": "/x"}'), ', "plans": [{"name": "basic", "price": "POA"}, {"name": "none"}], "steps": {"title": "call"}, "outcomes": [{"title": "x"}, {"title": "less", "text": "noise"}], "featured": ', some(2, "true", '"true"'),
        '}], "caseStudies": {"client": "C", "before": "slow", "after": ["fast"], "metrics": [{"label": "Size", "after": 5}, {"label": "No"}], "quote": ', some(2, '{"text": "Nice", "author": "Ann"}', '{"author": "Ann"}'), '}, "testimonials": [{"quote": "Q", "rating": ', some(4, "0", '"0"', "7", '"4.5"'), '}], "site": {"form": {"provider": "netlify"}, "showPrices": false}, "_meta": {"todo": "ask"}, "content": {"closingCta": {"heading": "Now"}, "stats": [{"value": 9, "label": "Years"}]}}')
    p = written(N.normalize_profiles(c.select(_text("c", k).alias("site"), F.when(i % 11 == 0, "{no").otherwise(json).alias("profile"))), "profiles")
    s, study = F.get("services", F.lit(0)), F.get("caseStudies", F.lit(0))
    joined = lambda c: F.array_join(c, "|")
    return p.select(
        "site", "slug", "version", F.col("business.founded").alias("founded"), joined(F.col("business.serviceArea")).alias("area"), joined(F.col("business.licenses")).alias("licenses"), F.col("business.employees").alias("employees"), joined(F.col("contact.phones")).alias("phones"), F.col("contact.geo.lng").alias("lng"),
        joined(F.transform("contact.hours", lambda h: F.concat_ws(" ", h["day"], h["closed"].cast("string"), h["open"]))).alias("hours"), joined(F.transform("gallery", lambda g: F.concat(g["src"], F.lit("="), g["alt"]))).alias("gallery"), joined(F.flatten(F.transform("legal", lambda x: F.transform(x["sections"], lambda y: F.concat(y["heading"], F.lit(":"), joined(y["body"])))))).alias("legal"),
        s["name"].alias("service"), joined(s["description"]).alias("description"), joined(s["features"]).alias("features"), s["price"].alias("price"), s["cta"]["label"].alias("cta"), joined(F.transform(s["plans"], lambda x: x["name"])).alias("plans"), joined(F.transform(s["steps"], lambda x: x["title"])).alias("steps"), joined(F.transform(s["outcomes"], lambda x: x["text"])).alias("outcomes"), s["featured"].alias("featured"),
        joined(F.concat(study["before"], study["after"])).alias("study"), joined(F.transform(study["metrics"], lambda m: F.concat(m["label"], m["after"]))).alias("metrics"), study["quote"]["author"].alias("quoted"), F.get("testimonials", F.lit(0))["rating"].alias("rating"), F.col("settings.form.provider").alias("provider"), F.col("settings.form.method").alias("method"),
        F.col("settings.showPrices").alias("prices"), joined(F.col("meta.todo")).alias("todo"), F.col("content.closingCta.heading").alias("closing"), F.get("content.stats", F.lit(0))["value"].alias("stat"))


def brand_contrast_matrix(spark, sf_dir):
    """Brand colours of parts on the backgrounds of all themes: the ratio, whether it passes, and that the corrected colour passes."""
    p = spread(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_size"), "p_partkey")
    palettes = L.theme_palettes(spark).select("theme", "mode", F.col("bg").alias("background"))
    profiles = p.select(F.col("p_partkey").cast("string").alias("site"), F.struct(F.struct(_shade().alias("primary")).alias("colors")).alias("brand"))
    return P.brand_contrast(profiles, palettes).select("site", "theme", "mode", F.round("ratio", 6).alias("ratio"), "passes", (F.round(C.contrast(F.col("corrected"), F.col("background")), 6) >= 4.5).alias("fit"))


def _shade() -> Column:
    return F.concat(F.lit("#"), F.lpad(F.lower(F.hex((F.col("p_partkey") * 7919 % 16777216).cast("bigint"))), 6, "0"))


def text_pairs(spark, sf_dir):
    """The seven pairs of all themes for sites without a brand colour, with one, and with a second one: every pair is readable; the better of two labels reaches 4.4."""
    p = spread(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_size"), "p_partkey")
    brands = p.select(F.col("p_partkey").cast("string").alias("site"), F.when(F.col("p_partkey") % 3 > 0, _shade()).otherwise("none").alias("primary"), F.when(F.col("p_partkey") % 3 == 2, F.concat(F.lit("rgb(200,"), (F.col("p_size") * 4).cast("string"), F.lit(",0)"))).alias("accent"))
    shown = dict.fromkeys(c for _, *both, _ in L.PAIRS for c in both)  # tones and mixes stand in no pair
    pairs = L.text_pairs(written(L.theme_tokens(brands, L.theme_palettes(spark)).select("site", "theme", "mode", *shown), "tokens"))
    return pairs.groupBy("site", "theme", "mode").agg(*[F.max(F.when(F.col("pair") == name, F.when(F.col("ratio") < (4.4 if "label" in name else least), "low").when(F.lit(name).isin("muted text", "CTA band", "body text"), F.format_number("ratio", 3)).otherwise("fit"))).alias(name.lower().replace(" ", "_")) for name, _, _, least in L.PAIRS])


def colour_tones(spark, sf_dir):
    """Tones of greys, whose shades depend on the lightness alone, mixes of two colours, and whether parts' colours are neutral."""
    p = spread(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_size"), "p_partkey")
    grey = F.concat(F.lit("#"), F.repeat(F.lpad(F.lower(F.hex((F.col("p_partkey") % 256).cast("bigint"))), 2, "0"), 3))
    return p.select("p_partkey", F.array_join(F.transform(C.ramp(grey), lambda t: t["hex"]), " ").alias("tones"), C.mix(_shade(), F.lit("#ff8000"), (F.col("p_partkey") % 5) / 4.0).alias("mixed"), C.is_neutral(_shade()).alias("neutral"))


def _crawled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Three pages a supplier: its home, an about page and a contact page, each with parts that some lack, and facts that two pages tell apart."""
    c = spread(spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey"), "s_suppkey")
    i, k = F.col("s_suppkey"), F.col("s_suppkey").cast("string")
    some = lambda n, r, *parts: F.when(i % n == r, _text(*parts)).otherwise("")
    card = lambda name: _text(f"<div class=card><h3>{name} ", k, f"</h3><p>We do {name} in all of town.</p></div>")
    home = _text(
        "<html><head><title>Firm ", k, " | Home</title>", some(2, 0, "<meta name=description content='We fix it. All of ", k, "'>"), some(5, 0, "<meta property='og:site_name' content='Og ", k, "'>"), some(6, 0, "<meta property='og:image' content='/og.jpg'>"), "<style>h1{color:#c41e3a;background:#1f3a93;font-family:Lora}</style>",
        some(3, 0, '<script type="application/ld+json">{"@type": "Plumber", "name": "Stated ', k, '", "telephone": "555 1', k, '", "foundingDate": "1999-05-01", "areaServed": "Town", "geo": {"latitude": 1.5, "longitude": 2.5}, "sameAs": ["https://yelp.com/', k, '", "https://x.com/stated"]}</script>'), "</head><body><header><img src='/mark.png' alt='Mark'></header><main>",
        some(4, 1, "<h1>WELCOME HOME</h1>"), "<p>We have mended pipes in this town for very many years.</p><img src='/wide", k, ".jpg' width=700><img src='/p.jpg' alt=P><h2>Our services</h2><div class=grid>", card("Drains"), card("Pipes"), card("Boilers"), "</div><h3>Is it dear?</h3><p>No, it is not that dear.</p></main><a href='https://x.com/f", k, "'>x</a></body></html>")
    about = _text("<html><head><title>About</title></head><body><main><p>This is the longest of all paragraphs on the whole site, and it tells who firm ", k, " is.</p><blockquote>They came out the same day, all of them. <cite>Ann</cite></blockquote>", some(7, 2, "<img class=logo src='/real-logo.png'>"), "</main><a href='https://x.com/later'>x</a></body></html>")
    contact = _text("<html><head><title>Contact</title></head><body><main>", some(2, 1, "<a href='tel:2175550142'>(217) 555-0142</a><p>Or 217.555.0142 and 312 555 0", F.lpad((i % 1000).cast("string"), 3, "0"), " now</p>"), some(3, 1, "<a href='mailto:A@B.org'>m</a>"), some(4, 0, "<address>", k, " Main Street, Springfield, IL 62701</address>"), some(5, 1, "<div class=hours>Mon - Tue: 7:00am - 5:30pm<br>Sun Closed</div>"), "</main></body></html>")
    page = lambda n, path, html: F.struct((i * 3 + n).alias("page_id"), _text("https://www.f", k, ".example/", path).alias("url"), html.alias("html"))
    rows = c.select(_text("f", k, ".example").alias("site"), F.explode(F.array(page(0, "", home), page(1, "about", about), page(2, "contact", contact))).alias("p")).select("site", "p.*")
    pages = written(rows, "pages")
    return pages, node_table(pages)


def site_harvest(spark, sf_dir):
    """From markup to draft in one call."""
    drafts = written(S.harvest_sites(*_crawled(spark, sf_dir))[1], "drafts")
    a = [F.col(f"contact.address.{x}") for x in ("street", "street2", "city", "region", "postalCode")]
    joined = lambda c: F.array_join(c, "|")
    return drafts.select(
        "site", "slug", F.col("source.pagesCrawled").alias("pages"), F.col("business.name").alias("name"), F.col("business.tagline").alias("tagline"), F.col("business.category").alias("category"), F.col("business.founded").alias("founded"), joined(F.col("business.serviceArea")).alias("area"),
        F.col("contact.phone").alias("phone"), joined(F.col("contact.phones")).alias("phones"), F.col("contact.email").alias("email"), V.format_address(*a).alias("address"), F.col("contact.geo.lat").alias("lat"), joined(F.transform("contact.hours", lambda h: F.concat_ws(" ", h["day"], h["open"]))).alias("hours"),
        F.col("brand.logo").alias("logo"), F.col("brand.colors.primary").alias("primary_colour"), F.col("brand.colors.secondary").alias("secondary_colour"), F.col("brand.fonts.heading").alias("font"), joined(F.array_sort(F.transform(F.map_entries("social"), lambda e: F.concat_ws("=", e["key"], e["value"])))).alias("social"),
        F.col("content.hero.headline").alias("headline"), F.col("content.hero.subhead").alias("subhead"), F.col("content.hero.image").alias("hero"), joined(F.transform("content.about.body", lambda x: F.left(x, F.lit(12)))).alias("about"), joined(F.transform("services", lambda x: x["name"])).alias("services"),
        F.get("services", F.lit(0))["summary"].alias("summary"), joined(F.transform("testimonials", lambda x: x["author"])).alias("authors"), joined(F.transform("faqs", lambda x: x["question"])).alias("questions"), joined(F.transform("gallery", lambda x: x["src"])).alias("gallery"), F.col("seo.title").alias("title"))


QUERIES = [normalize_profiles, normalize_dynamic, draft_profile, harvest_report, brief_rows, brand_contrast_matrix, text_pairs, colour_tones, site_harvest]
_F = """f as (select c_custkey as i, c_custkey::varchar as k, 'c' || c_custkey as site from customer), g as (select *,
  case when i % 7 = 0 then 'Stated ' || k when i % 5 = 0 then 'Og ' || k when i % 3 <> 0 then 'ACME WORKS ' || k else 'shop' || k end as raw,
  case when i % 6 = 0 then 'Og said! More' when i % 4 = 0 then 'We fix it. All of it, ' || k else '' end as og_first, case when i % 4 = 0 then 'We fix it. All of it, ' || k when i % 6 = 0 then 'Og said! More' else '' end as own_first from f),
n as (select *, case when raw like 'ACME%' then 'Acme Works ' || k when raw like 'shop%' then 'S' || substr(raw, 2) else raw end as name,
  case when i % 4 = 1 then i || ' Main St, Salem, OR 97301' when i % 7 = 0 then '9 Old St, Oldtown, IL 62701' else '' end as address from g),
d as (select *, case when i % 6 = 0 then 'Og said' when i % 4 = 0 then 'We fix it' else '' end as tagline, case when i % 7 = 0 then 'Dentist' else '' end as category,
  case when i % 2 = 1 then '(217) 555-0142' when i % 7 = 0 then '555' || k else '' end as phone, case when i % 2 = 1 then 1 when i % 7 = 0 then 1 else 0 end::bigint as phones, case when i % 3 = 1 then 'b@x.org' when i % 7 = 0 then 's@x.org' else '' end as email,
  case when i % 2 = 0 then 'Welcome Home' when i % 5 = 1 then 'Og title' else name end as headline, case when og_first <> '' then og_first else 'First paragraph of the page' end as subhead from n),
e as (select *, case when i % 3 = 0 then array_to_string(list_filter([name, case when tagline <> '' then tagline else category end, case when i % 4 = 1 then 'Salem' when i % 7 = 0 then 'Oldtown' else '' end], lambda x: x <> ''), ' | ') else 'ACME WORKS ' || k || ' | Home' end as title from d),
m as (select site, name, i, [case when phone = '' then 'Phone|contact.phone|8|6' end, case when address = '' then 'City|contact.address.city|6|8' end, case when own_first = '' then 'Short description|business.description|6|3' end, case when email = '' then 'Email|contact.email|5|7' end,
  case when i % 2 = 1 then 'Hero image|content.hero.image|5|15' end, 'Value propositions|content.valueProps|5|17', case when tagline = '' then 'Tagline|business.tagline|4|1' end, 'Service area|business.serviceArea|4|4', case when category = '' then 'Category|business.category|3|2' end,
  case when address = '' then 'Street address|contact.address.street|3|9' end, 'Year founded|business.founded|2|5'] as miss from e),
gaps as (select site, label, path, weight, cast(row_number() over (partition by site order by weight desc, at_) as integer) as ord from (select site, split_part(x, '|', 1) as label, split_part(x, '|', 2) as path, split_part(x, '|', 3)::int as weight, split_part(x, '|', 4)::int as at_ from (select site, unnest(list_filter(miss, lambda x: x is not null)) as x from m)))"""
def _lum(value: str) -> str:
    """Luminance of a #rrggbb text by the standard's formula."""
    share = lambda at: f"(('0x' || substr({value}, {at}, 2))::int / 255.0)"
    line = lambda x: f"(case when {x} <= 0.03928 then {x} / 12.92 else pow(({x} + 0.055) / 1.055, 2.4) end)"
    return f"(0.2126 * {line(share(2))} + 0.7152 * {line(share(4))} + 0.0722 * {line(share(6))})"


def _ratio(one: str, two: str) -> str:
    return f"((greatest({_lum(one)}, {_lum(two)}) + 0.05) / (least({_lum(one)}, {_lum(two)}) + 0.05))"


#: The themes' palettes.
_PAL = "pal as (select * from (values " + ", ".join(f"('{t}', '{m}', " + ", ".join(f"'{x}'" for x in shades.split(" ")) + ")" for t, m, shades in L.PALETTES) + ") t(theme, mode, " + ", ".join(f'"{c}"' for c in L.COLOURS) + "))"
ORACLES = {
    "normalize_profiles": """with c as (select c_custkey as i, c_custkey::varchar as k from customer)
      select 'c' || k as site, 'Joe''s ' || k as name, 'Springfield|Town ' || k as area, case when i % 2 = 0 then '555.867.5309' else '(555) 867-5309' end as phone, '(555) 867-5309|+44 20 ' || k as phones,
        case when i % 4 = 0 then 'main' || k || '@b.com' else 'a@b.com' end as email, case when i % 4 = 0 then 'a@b.com|main' || k || '@b.com' else 'a@b.com' end as emails, 'monday false 8:00 AM 5:00 PM|tuesday false 10:00 AM 5:00 PM|sunday true  ' as hours,
        ['#2563eb', '#aabbcc', '#000080', '#008000', '#123456', '', ''][i % 7 + 1] as colour, 'facebook=https://fb.com/' || k || '|own=HTTP://own.example' as social, 'Best HVAC in Town' as headline, 'ac-repair|furnace-' || k as slugs, 'AC Repair|Furnace ' || k as services, 'a.jpg' as gallery,
        case when i % 2 = 0 then 'Good job|Text|Text|Text|Text' else 'Text|Good job|Text|Text|Text' end as quotes, '5.0|1.0|-|1.0|4.5' as ratings, 'A' as answers, 'terms' as legal, 0::bigint as team,
        'Joe''s ' || k || case when i % 3 = 0 then ' | Plumber' else '' end || ' | ' || case when i % 5 = 0 then 'Sun City' else 'Springfield' end as title, 'Sub' as description from c""",
    "draft_profile": f"""with {_F} select site, name, tagline, category, own_first as about, phone, phones, email, address, 'monday|sunday' as days, headline, subhead, 'About ' || name as heading, 1::bigint as services, '' as photo, 'https://x.com/a' as x, title from e""",
    "harvest_report": f"""with {_F}, s as (select site, cast(round(100 * (131 - coalesce(sum(weight), 0)) / 131) as bigint) as percent, coalesce(string_agg(label, '|' order by ord) filter (ord <= 10), '') as gaps from gaps group by site)
      select e.site, name, percent, gaps, case when i % 3 <> 2 then 'Wix' end as platform, case when i % 3 <> 2 then i % 2 = 0 end as mobile, case when i % 3 <> 2 then 1 end::bigint as images_no_alt, case when i % 3 <> 2 then 2 else 0 end::bigint as flags,
        2::bigint as hours, 1::bigint as services, 1::bigint as testimonials, 1::bigint as faqs, 1::bigint as team from e join s using (site)""",
    "brief_rows": f"""with {_F} select site, 'gap' as part, ord, path as text from gaps where ord <= 14
      union all select site, 'copy', cast(least(12, 11 + i % 4) * p + j as integer), 'p' || j from f, (select unnest([0, 1]) as p), (select unnest(range(1, 13)) as j) where j <= 11 + i % 4
      union all select site, 'social', 1, case when i % 20 = 0 then 'X: Readable — mine the bio for tone: "A bio"' else 'X: Blocked to anonymous requests. Add to `_meta.todo` and ask the client.' end from f where i % 10 = 0
      union all select site, 'question', ord, 'Ask for: ' || label from gaps where ord <= 14
      union all select site, 'todo', 1, 'Ask for the content of X (https://x.com/a).' from f where i % 20 = 10""",
    "normalize_dynamic": """with c as (select c_custkey as i, c_custkey::varchar as k, c_custkey % 11 <> 0 as ok from customer)
      select 'c' || k as site, case when ok then 'firm-' || k else 'client' end as slug, 'profile/1' as version, case when ok then ['1999', '2001'][i % 2 + 1] else '' end as founded, case when ok then ['Town', 'Town|Area', ''][i % 3 + 1] else '' end as area, case when ok then '7' else '' end as licenses, case when ok then '12' else '' end as employees,
        case when ok then ['1555123456', '+65 6123 4567|217.555.0142'][i % 2 + 1] else '' end as phones, case when ok then 2.5::double end as lng, case when ok then ['', 'sunday true ', 'friday false 9:00 AM'][i % 3 + 1] else '' end as hours, case when ok then ['a.jpg=', 'a.jpg=|b.jpg=B', ''][i % 3 + 1] else '' end as gallery,
        case when ok then ['H:one text', ':a|b'][i % 2 + 1] else '' end as legal, case when ok then 'JOB ' || k end as service, case when ok then ['One text', 'Two|texts', ''][i % 3 + 1] end as description, case when ok then 'f' end as features, case when ok then '25' end as price, case when ok and i % 2 = 0 then 'Go' end as cta, case when ok then 'Basic' end as plans,
        case when ok then 'Call' end as steps, case when ok then 'noise' end as outcomes, case when ok then i % 2 = 0 end as featured, case when ok then 'slow|fast' end as study, case when ok then 'Size5' end as metrics, case when ok and i % 2 = 0 then 'Ann' end as quoted, case when ok then ([null, 1, 5, 4.5]::double[])[i % 4 + 1] end as rating,
        case when ok then 'netlify' else 'none' end as provider, 'POST' as method, not ok as prices, case when ok then 'ask' else '' end as todo, case when ok then 'Now' else '' end as closing, case when ok then '9' end as stat from c""",
    "brand_contrast_matrix": f"""with {_PAL}, v as (select p_partkey::varchar as site, '#' || lower(printf('%06x', p_partkey * 7919 % 16777216)) as own from part), q as (select site, theme, mode, {_ratio('own', 'bg')} as ratio from v, pal)
      select site, theme, mode, round(ratio, 6) as ratio, ratio >= 4.5 as passes, true as fit from q""",
    "text_pairs": f"""with {_PAL}, r as (select theme, mode, {_ratio('text', 'bg')} as b, {_ratio('text_muted', 'bg')} as m, {_ratio('inverse_text', 'inverse_bg')} as v from pal)
      select p_partkey::varchar as site, theme, mode, printf('%.3f', b) as body_text, printf('%.3f', m) as muted_text, 'fit' as card_text, 'fit' as button_label, 'fit' as accent_label, 'fit' as links, printf('%.3f', v) as cta_band from part, r""",
    "colour_tones": """with p as (select p_partkey, p_partkey * 7919 % 16777216 as v, (p_partkey % 5) / 4.0 as w from part), c as (select *, [v // 65536, v // 256 % 256, v % 256] as x, list_max([v // 65536, v // 256 % 256, v % 256]) / 255.0 as hi, list_min([v // 65536, v // 256 % 256, v % 256]) / 255.0 as lo from p)
      select p_partkey, '#f7f7f7 #f0f0f0 #dbdbdb #c2c2c2 #a3a3a3 #858585 #707070 #5c5c5c #454545 #2e2e2e' as tones, '#' || array_to_string(list_transform(list_zip(x, [255, 128, 0]), lambda z: lower(printf('%02x', cast(floor(z[1] * (1 - w) + z[2] * w + 0.5) as bigint)))), '') as mixed,
        case when hi = lo then 0 else (hi - lo) / (1 - abs(hi + lo - 1)) end * (1 - abs((hi + lo) / 2 - 0.5) * 2) < 0.08 as neutral from c""",
    "site_harvest": """with f as (select s_suppkey as i, s_suppkey::varchar as k, 'f' || s_suppkey || '.example' as site, 'https://www.f' || s_suppkey || '.example' as o from supplier),
      g as (select *, i % 3 = 0 as said, case when i % 3 = 0 then 'Stated ' || k when i % 5 = 0 then 'Og ' || k else 'Firm ' || k end as name, case when i % 7 = 2 then o || '/real-logo.png' else o || '/mark.png' end as logo, case when i % 6 = 0 then o || '/og.jpg' else o || '/wide' || k || '.jpg' end as hero,
        'We have mended pipes in this town for very many years.' as lead, lpad((i % 1000)::varchar, 3, '0') as tail from f)
      select site, 'f' || k as slug, 3::bigint as pages, name, case when i % 2 = 0 then 'We fix it' else '' end as tagline, case when said then 'Plumber' else '' end as category, case when said then '1999' else '' end as founded, case when said then 'Town' else '' end as area,
        case when i % 2 = 1 then '(217) 555-0142' when said then '555 1' || k else '' end as phone, case when i % 2 = 1 then '(217) 555-0142|312 555 0' || tail when said then '555 1' || k else '' end as phones, case when i % 3 = 1 then 'a@b.org' else '' end as email,
        case when i % 4 = 0 then k || ' Main Street, Springfield, IL 62701' else '' end as address, case when said then 1.5::double end as lat, case when i % 5 = 1 then 'monday 7:00 AM|tuesday 7:00 AM|sunday ' else '' end as hours, logo, '#1f3a93' as primary_colour, '#c41e3a' as secondary_colour, 'Lora' as font,
        case when said then 'x=https://x.com/later|yelp=https://yelp.com/' || k else 'x=https://x.com/later' end as social, case when i % 4 = 1 then 'Welcome Home' else name end as headline,
        case when i % 2 = 0 then 'We fix it. All of ' || k else lead end as subhead, hero, 'This is the |We have mend' as about, 'Drains ' || k || '|Pipes ' || k || '|Boilers ' || k as services, 'We do Drains in all of town.' as summary, 'Ann' as authors, 'Is it dear?' as questions,
        array_to_string(list_filter([o || '/mark.png', o || '/wide' || k || '.jpg', o || '/p.jpg'], lambda x: x <> logo and x <> hero), '|') as gallery, 'Firm ' || k || ' | Home' as title from g""",
}
