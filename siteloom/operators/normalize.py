"""Profiles of any shape as complete, clean ones.

A profile comes as typed columns, as a VARIANT or as JSON text. It is read as a VARIANT, so a value may be text or a list,
a number or text, an item or its name alone; what comes out has the columns of every profile.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteloom.functions import colour as C
from siteloom.functions import text as T
from siteloom.functions.once import let
from siteloom.operators.contacts import tel_href
from siteloom.operators.jsonld import DAYS, items

VERSION = "profile/1"
#: Where the parts of a profile lie whose column has another name, since `site` is the key of every table.
RENAMED = {"site": "settings", "_meta": "meta", "$schema": "version"}
#: Fields that are kept as they are, by part.
KEPT = {
    "business": ("longDescription", "employees", "priceRange"), "contact": ("hoursNote", "bookingUrl", "mapsUrl", "emergency"), "brand": ("logo", "logoDark", "favicon", "voice"), "seo": ("ogImage", "canonical"),
}


def first_of_each(rows: Column, key: Callable[[Column], Column]) -> Column:
    """An array without items whose key an earlier one has."""
    return let(rows, lambda all_: let(F.transform(all_, key), lambda keys: F.filter(all_, lambda _, i: F.array_position(keys, F.get(keys, i)) == i + 1)))


def read(v: Column, shape: str) -> Column:
    """A VARIANT as a struct of typed fields, in one pass: null for fields that are missing or of no such type, and for what is no object.

    Getting fields one by one costs a walk from the root for each, and a thrown exception for each that is missing.
    """
    return F.try_variant_get(v, "$", f"struct<{shape}>")


def typed(names: str, kind: str = "string") -> str:
    """The fields of that type, as a part of a struct's type."""
    return ",".join(f"{n}:{kind}" for n in names.split())


BUTTON = f"struct<{typed('label href')}>"
#: What profiles and their items may hold. A list is a VARIANT, since it may be a single value.
SERVICE = f"{typed('slug name title summary excerpt strapline image icon price priceNote sourceUrl')},{typed('stats description features outcomes steps plans featured', 'variant')},cta:{BUTTON}"
CASE_STUDY = f"{typed('slug client name sector summary liveUrl archiveUrl image')},{typed('before after metrics', 'variant')},quote:struct<{typed('text author role')}>"
SHAPE = ",".join((
    "slug:string,social:map<string,string>", typed("services caseStudies gallery testimonials team legal faqs", "variant"),
    f"source:struct<{typed('url harvestedAt notes')},pagesCrawled:bigint,socialSources:variant>",
    f"business:struct<{typed('name legalName tagline category description founded')},{typed(' '.join(KEPT['business']))},{typed('licenses serviceArea languages', 'variant')}>",
    f"contact:struct<{typed('phone email', 'variant')},{typed('phones emails hours', 'variant')},address:struct<{typed('street street2 city region postalCode country')}>,geo:struct<lat:double,lng:double>,{typed(' '.join(KEPT['contact']))}>",
    f"brand:struct<{typed(' '.join(KEPT['brand']))},colors:struct<{typed('primary secondary accent')}>,fonts:struct<{typed('heading body')}>>",
    f"content:struct<hero:struct<{typed('headline subhead image')},primaryCta:{BUTTON},secondaryCta:{BUTTON},badges:variant>,about:struct<{typed('heading image')},{typed('body highlights', 'variant')}>,{typed('valueProps stats', 'variant')},closingCta:struct<{typed('heading text')},primaryCta:{BUTTON}>>",
    f"seo:struct<{typed('title description')},keywords:variant,{typed(' '.join(KEPT['seo']))}>",
    f"site:struct<{typed('theme mode domain')},form:struct<{typed('action method provider')}>,analytics:struct<{typed('plausible ga4')}>,consent:struct<enabled:boolean,policyUrl:string>,verification:struct<google:string>,showPrices:boolean>",
    f"_meta:struct<{typed('enriched gaps todo', 'variant')}>",
))


def whole(v: Column) -> Column:
    """A VARIANT as text."""
    return F.try_variant_get(v, "$", "string")


def plain(c: Column) -> Column:
    """A text as it is; empty for none."""
    return F.coalesce(c, F.lit(""))


def texts(v: Column) -> Column:
    """A list of texts, or a single one, without empty ones."""
    return F.filter(F.transform(items(v), lambda x: T.squash(whole(x))), lambda x: x != "")


def listed(v: Column, shape: str) -> Column:
    """The items of a list, or a single one, each read as a struct."""
    return F.transform(items(v), lambda x: read(x, shape))


def yes(v: Column) -> Column:
    """Whether a value is true itself, not a text that says so."""
    return F.coalesce((F.schema_of_variant(v) == "BOOLEAN") & F.try_variant_get(v, "$", "boolean"), F.lit(False))


def fields(s: Column, names: str, of: Callable[[Column], Column] = T.squash) -> list[Column]:
    return [of(s[n]).alias(n) for n in names.split()]


def shaped(rows: Column, make: Callable[..., Column], keep: Callable[[Column], Column]) -> Column:
    return F.filter(F.transform(rows, make), keep)


def numbered_slug(given: Column, name: Column, stem: str, i: Column) -> Column:
    """A slug of what is given, else of the name, else the stem with the item's number."""
    base = T.slug(let(given, lambda g: F.when(g != "", g).otherwise(name)), "")
    return let(base, lambda b: F.when(b != "", b).otherwise(F.concat(F.lit(f"{stem}-"), (i + 1).cast("string"))))


def button(s: Column) -> Column:
    """A label with its address; null without a label."""
    return let(T.squash(s["label"]), lambda label: F.when(label != "", F.struct(label.alias("label"), T.squash(s["href"]).alias("href"))))


def week(v: Column) -> Column:
    """One entry per day in the order of the week, the last one given for a day. A day is known by three letters of its start."""
    def entry(h: Column) -> Column:
        number = let(F.substring(F.lower(plain(h["day"])), 1, 3), lambda start: F.when(start != "", F.coalesce(*[F.when(F.startswith(F.lit(d), start), F.lit(i)) for i, d in enumerate(DAYS)])))
        return F.struct(number.alias("n"), (yes(h["closed"]) | plain(h["open"]).rlike("(?i)closed")).alias("closed"), *fields(h, "open close note"))

    def shown(h: Column, i: Column) -> Column:
        day = F.get(F.array(*[F.lit(d) for d in DAYS]), i)
        return F.when(h.isNotNull(), F.struct(day.alias("day"), h["closed"].alias("closed"), F.when(h["closed"], "").otherwise(h["open"]).alias("open"), F.when(h["closed"], "").otherwise(h["close"]).alias("close"), h["note"].alias("note")))

    entries = F.filter(listed(v, f"{typed('day open close note')},closed:variant"), lambda h: h.isNotNull())
    last = lambda rows, i: F.try_element_at(F.filter(rows, lambda h: h["n"] == i), F.lit(-1))
    return let(shaped(entries, entry, lambda h: h["n"].isNotNull()), lambda rows: F.filter(F.transform(F.sequence(F.lit(0), F.lit(6)), lambda i: let(last(rows, i), lambda h: shown(h, i))), lambda h: h.isNotNull()))


def service(s: Column, i: Column, only: Sequence[str] = ()) -> Column:
    """A service; only: the fields to give beside slug and name, all without any."""
    return let(T.humanize_heading(F.coalesce(s["name"], s["title"])), lambda name: _service(s, i, name, only))


def _service(s: Column, i: Column, name: Column, only: Sequence[str]) -> Column:
    titled = lambda x: T.humanize_heading(x["title"]).alias("title")
    stats = lambda: shaped(listed(s["stats"], typed("value label note")), lambda x: F.struct(*fields(x, "value label note")), lambda x: (x["value"] != "") & (x["label"] != ""))
    outcomes = lambda: shaped(listed(s["outcomes"], typed("icon title text")), lambda x: F.struct(*fields(x, "icon"), titled(x), *fields(x, "text")), lambda x: (x["title"] != "") & (x["text"] != ""))
    steps = lambda: shaped(listed(s["steps"], typed("title text")), lambda x: F.struct(titled(x), *fields(x, "text")), lambda x: x["title"] != "")
    plans = lambda: shaped(listed(s["plans"], f"{typed('name price period summary')},featured:variant"), lambda x: F.struct(T.humanize_heading(x["name"]).alias("name"), *fields(x, "price period summary"), yes(x["featured"]).alias("featured")), lambda x: (x["name"] != "") & (x["price"] != ""))
    own = lambda n: lambda: T.squash(s[n])
    made = {
        "slug": lambda: numbered_slug(T.squash(s["slug"]), name, "service", i), "name": lambda: name, "summary": lambda: T.squash(F.coalesce(s["summary"], s["excerpt"])), "strapline": own("strapline"), "stats": stats, "cta": lambda: button(s["cta"]),
        "description": lambda: texts(s["description"]), **{n: own(n) for n in ("image", "icon", "price", "priceNote")}, "features": lambda: texts(s["features"]), "outcomes": outcomes, "steps": steps, "plans": plans,
        "featured": lambda: yes(s["featured"]), "sourceUrl": own("sourceUrl"),
    }
    return F.struct(*[make().alias(n) for n, make in made.items() if not only or n in ("slug", "name", *only)])


def case_study(c: Column, i: Column) -> Column:
    return let(T.squash(F.coalesce(c["client"], c["name"])), lambda client: _case_study(c, i, client))


def _case_study(c: Column, i: Column, client: Column) -> Column:
    metrics = shaped(listed(c["metrics"], f"{typed('label before after change note icon')},highlight:variant"), lambda m: F.struct(*fields(m, "label before after change note icon"), yes(m["highlight"]).alias("highlight")), lambda m: (m["label"] != "") & ((m["before"] != "") | (m["after"] != "")))
    quote = c["quote"]
    return F.struct(
        numbered_slug(T.squash(c["slug"]), client, "case-study", i).alias("slug"), client.alias("client"), *fields(c, "sector summary"), texts(c["before"]).alias("before"), texts(c["after"]).alias("after"), metrics.alias("metrics"),
        F.when(T.squash(quote["text"]) != "", F.struct(*fields(quote, "text author role"))).alias("quote"), *fields(c, "liveUrl archiveUrl image"))


def legal_page(x: Column, i: Column) -> Column:
    section = lambda s: F.struct(*fields(s, "heading"), texts(s["body"]).alias("body"))
    return F.struct(
        numbered_slug(T.squash(x["slug"]), T.squash(x["title"]), "page", i).alias("slug"), *fields(x, "title updated"),
        shaped(listed(x["sections"], "heading:string,body:variant"), section, lambda s: (s["heading"] != "") | (F.size(s["body"]) > 0)).alias("sections"))


def as_variant(profiles: DataFrame) -> DataFrame:
    """(site, p): each profile as a VARIANT, from its columns or from a column `profile` of JSON text or VARIANT."""
    kind = dict(profiles.dtypes).get("profile")
    if kind is not None:
        return profiles.select("site", (F.try_parse_json("profile") if kind == "string" else F.col("profile")).alias("p"))
    back = {v: k for k, v in RENAMED.items()}
    own = [F.col(f"`{c}`").alias(back.get(c, c)) for c in profiles.columns if c != "site"]
    return profiles.select("site", F.parse_json(F.to_json(F.struct(*own)) if own else F.lit("{}")).alias("p"))


def normalize_profiles(profiles: DataFrame, parts: Sequence[str] = ()) -> DataFrame:
    """Profiles with clean values in every part: site, version, slug, source, business, contact, brand, social, content, services,
    caseStudies, gallery, testimonials, team, legal, faqs, seo, settings, meta.

    Texts are squashed; lists lose empty and repeated items (places ignoring case, numbers by their dialled form, mail addresses need an @,
    services and case studies by slug, images by source); a single value is a list of one; hours have one entry per day; colours are
    #rrggbb or empty; addresses of networks get a scheme; ratings lie from 1 to 5; items without what they need go. Titles and
    descriptions for search fall back to the business. Fields of KEPT, calls to action, geo, settings and meta stay as they are. Nulls, missing
    parts and texts that are no JSON count as empty; a row without a site is kept.

    parts: the columns to give beside site, or fields of them as contact.phone, all without any; what isn't asked for isn't worked out. Of services,
    slug and name are always there.
    """
    asked_for: dict[str, list[str]] = {}
    for name, _, field in (x.partition(".") for x in parts):
        asked_for.setdefault(name, []).append(field)
    needed = {*asked_for, *(("business", "contact", "content") if "seo" in asked_for else ())}
    only = [] if "" in asked_for.get("services", []) else asked_for.get("services", [])
    p = as_variant(profiles).select("site", read(F.col("p"), SHAPE).alias("p"))
    v, part = F.col("p"), lambda name: F.col(f"p.{name}")
    kept = lambda name: fields(part(name), " ".join(KEPT[name]), plain)
    # What several parts read has a column of its own.
    area = first_of_each(texts(part("business.serviceArea")), F.lower)
    phones = first_of_each(F.concat(texts(part("contact.phones")), texts(part("contact.phone"))), tel_href)
    mails = F.filter(F.transform(F.concat(texts(part("contact.emails")), texts(part("contact.email"))), F.lower), lambda e: F.contains(e, F.lit("@")))
    shade = lambda n: F.coalesce(C.colour_parse(plain(part(f"brand.colors.{n}"))), F.lit("")).alias(n)
    web = lambda u: F.when(u.rlike("(?i)^https?://"), u).otherwise(F.concat(F.lit("https://"), F.regexp_replace(u, "^/+", "")))
    networks = F.coalesce(v["social"], F.create_map().cast("map<string,string>"))
    social = F.transform_values(F.map_filter(networks, lambda k, u: T.squash(u) != ""), lambda k, u: web(T.squash(u)))

    def stars(rating: Column) -> Column:
        """A rating from 1 to 5; the number 0 is none, a text of it is the least."""
        said = whole(rating).try_cast("double")
        number = F.schema_of_variant(rating) != "STRING"
        return let(said, lambda x: F.when(x.isNotNull() & ~F.isnan(x) & ~(number & (x == 0)), F.least(F.lit(5.0), F.greatest(F.lit(1.0), x))))

    hero, about, closing, settings = part("content.hero"), part("content.about"), part("content.closingCta"), part("site")
    values = shaped(listed(part("content.valueProps"), typed("icon title text")), lambda x: F.struct(*fields(x, "icon"), T.humanize_heading(x["title"]).alias("title"), *fields(x, "text")), lambda x: (x["title"] != "") | (x["text"] != ""))
    stats = shaped(listed(part("content.stats"), typed("value label")), lambda x: F.struct(*fields(x, "value label")), lambda x: (x["value"] != "") & (x["label"] != ""))
    picture = lambda g: let(read(g, typed("src alt caption category")), lambda s: F.struct(T.squash(F.when(F.schema_of_variant(g) == "STRING", whole(g)).otherwise(s["src"])).alias("src"), *fields(s, "alt caption category")))
    quote = lambda t: F.struct(
        T.squash(F.coalesce(t["quote"], t["text"])).alias("quote"), T.squash(F.coalesce(t["author"], t["name"])).alias("author"), *fields(t, "role location"), stars(t["rating"]).alias("rating"), *fields(t, "source date"))
    asked = lambda f: F.struct(T.squash(F.coalesce(f["question"], f["q"])).alias("question"), T.squash(F.coalesce(f["answer"], f["a"])).alias("answer"))
    member = "name role bio photo email phone"
    # Of a number or an address that is no text, its own text is read.
    own = lambda name: whole(part(f"contact.{name}"))
    made = {
        "version": lambda: F.lit(VERSION), "slug": lambda: T.slug(F.coalesce(F.nullif(plain(v["slug"]), F.lit("")), F.lit("client")), "item"),
        "source": lambda: F.struct(*fields(part("source"), "url harvestedAt notes", plain), F.coalesce(part("source.pagesCrawled"), F.lit(0)).alias("pagesCrawled"), texts(part("source.socialSources")).alias("socialSources")),
        "business": lambda: F.struct(*fields(part("business"), "name legalName tagline category description founded"), *kept("business"), texts(part("business.licenses")).alias("licenses"), F.col("_area").alias("serviceArea"), texts(part("business.languages")).alias("languages")),
        "contact": lambda: F.struct(F.when(plain(own("phone")) != "", T.squash(own("phone"))).otherwise(F.coalesce(F.get("_phones", F.lit(0)), F.lit(""))).alias("phone"), F.col("_phones").alias("phones"),
                 F.when(plain(own("email")) != "", F.lower(T.squash(own("email")))).otherwise(F.coalesce(F.get("_mails", F.lit(0)), F.lit(""))).alias("email"), first_of_each(F.col("_mails"), lambda x: x).alias("emails"),
                 F.struct(*fields(part("contact.address"), "street street2 city region postalCode country")).alias("address"), F.struct(part("contact.geo.lat").alias("lat"), part("contact.geo.lng").alias("lng")).alias("geo"),
                 week(part("contact.hours")).alias("hours"), *kept("contact")),
        "brand": lambda: F.struct(*kept("brand"), F.struct(shade("primary"), shade("secondary"), shade("accent")).alias("colors"), F.struct(*fields(part("brand.fonts"), "heading body", plain)).alias("fonts")),
        "social": lambda: social,
        "content": lambda: F.struct(
            F.struct(T.humanize_heading(hero["headline"]).alias("headline"), *fields(hero, "subhead"), *fields(hero, "image", plain), button(hero["primaryCta"]).alias("primaryCta"), button(hero["secondaryCta"]).alias("secondaryCta"), texts(hero["badges"]).alias("badges")).alias("hero"),
            F.struct(*fields(about, "heading", plain), texts(about["body"]).alias("body"), *fields(about, "image", plain), texts(about["highlights"]).alias("highlights")).alias("about"),
            values.alias("valueProps"), stats.alias("stats"), F.struct(*fields(closing, "heading text", plain), button(closing["primaryCta"]).alias("primaryCta")).alias("closingCta")),
        "services": lambda: first_of_each(shaped(listed(v["services"], SERVICE), lambda s, i: service(s, i, only), lambda s: s["name"] != ""), lambda s: s["slug"]),
        "caseStudies": lambda: first_of_each(shaped(listed(v["caseStudies"], CASE_STUDY), case_study, lambda c: c["client"] != ""), lambda c: c["slug"]),
        "gallery": lambda: first_of_each(shaped(items(v["gallery"]), picture, lambda g: g["src"] != ""), lambda g: g["src"]),
        "testimonials": lambda: shaped(listed(v["testimonials"], f"{typed('quote text author name role location source date')},rating:variant"), quote, lambda t: t["quote"] != ""),
        "team": lambda: shaped(listed(v["team"], typed(member)), lambda m: F.struct(*fields(m, member)), lambda m: m["name"] != ""),
        "legal": lambda: shaped(listed(v["legal"], "slug:string,title:string,updated:string,sections:variant"), legal_page, lambda x: (x["title"] != "") & (F.size(x["sections"]) > 0)),
        "faqs": lambda: shaped(listed(v["faqs"], typed("question q answer a")), asked, lambda f: (f["question"] != "") & (f["answer"] != "")),
        "seo": lambda: F.struct(*fields(part("seo"), "title description"), texts(part("seo.keywords")).alias("keywords"), *kept("seo")),
        "settings": lambda: F.struct(*fields(settings, "theme mode domain", plain), F.struct(*fields(settings["form"], "action method provider", plain)).alias("form"), F.struct(*fields(settings["analytics"], "plausible ga4", plain)).alias("analytics"),
                 F.struct(F.coalesce(settings["consent"]["enabled"], F.lit(True)).alias("enabled"), *fields(settings["consent"], "policyUrl", plain)).alias("consent"),
                 F.struct(*fields(settings["verification"], "google", plain)).alias("verification"), F.coalesce(settings["showPrices"], F.lit(True)).alias("showPrices")),
        "meta": lambda: F.struct(yes(part("_meta.enriched")).alias("enriched"), texts(part("_meta.gaps")).alias("gaps"), texts(part("_meta.todo")).alias("todo")),
    }
    full = p.select("site", "p", phones.alias("_phones"), mails.alias("_mails"), area.alias("_area"))
    full = full.select("site", *[make().alias(n) for n, make in made.items() if not parts or n in needed])
    # What falls back to other parts reads those once they are clean.
    given = lambda own, other: F.when(own != "", own).otherwise(F.lit(other))
    if "settings" in full.columns:
        full = full.withColumn("settings", F.col("settings").withField("theme", given(F.col("settings.theme"), "meridian")).withField("mode", given(F.col("settings.mode"), "light")).withField(
            "form", F.col("settings.form").withField("method", given(F.col("settings.form.method"), "POST")).withField("provider", given(F.col("settings.form.provider"), "none"))))
    if "seo" in full.columns:
        pick = lambda *names: F.coalesce(*[F.nullif(F.col(x), F.lit("")) for x in names], F.lit(""))
        town = F.coalesce(F.nullif(F.col("contact.address.city"), F.lit("")), F.get("business.serviceArea", F.lit(0)), F.lit(""))
        joined = F.array_join(F.filter(F.array("business.name", pick("business.tagline", "business.category"), town), lambda x: x != ""), " | ")
        title = F.coalesce(F.nullif(F.col("seo.title"), F.lit("")), joined)
        full = full.withColumn("seo", F.col("seo").withField("title", T.truncate_words(title, 65, "")).withField("description", T.truncate_words(pick("seo.description", "business.description", "content.hero.subhead"), 158)))
    if not parts:
        return full
    return full.select("site", *[F.col(n) if "" in asked or n == "services" else F.struct(*[F.col(f"{n}.{x}") for x in asked]).alias(n) for n, asked in asked_for.items()])
