"""Business profiles: completeness, gaps, validation, schema.org types, structured data and page plans.

A profile is a row with the nested columns business, contact, brand, content, services, gallery, testimonials,
team, faqs, social, seo and settings, and the column site. Empty text stands for absent text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteloom.functions import colour as C
from siteloom.functions import text as T
from siteloom.functions import url as U
from siteloom.functions.once import let
from siteloom.operators.contacts import tel_href
from siteloom.operators.normalize import VERSION
from siteloom.operators.themes import NETWORKS

#: Fields of a profile that count: (path, label, weight, kind).
FIELDS = (
    ("business.name", "Business name", 10, "text"), ("business.tagline", "Tagline", 4, "text"), ("business.category", "Category", 3, "text"),
    ("business.description", "Short description", 6, "text"), ("business.serviceArea", "Service area", 4, "array"), ("business.founded", "Year founded", 2, "text"),
    ("contact.phone", "Phone", 8, "text"), ("contact.email", "Email", 5, "text"), ("contact.address.city", "City", 6, "text"),
    ("contact.address.street", "Street address", 3, "text"), ("contact.hours", "Opening hours", 5, "array"), ("brand.logo", "Logo", 5, "text"),
    ("brand.colors.primary", "Primary brand colour", 3, "text"), ("content.hero.headline", "Hero headline", 9, "text"), ("content.hero.subhead", "Hero subheadline", 5, "text"),
    ("content.hero.image", "Hero image", 5, "text"), ("content.about.body", "About copy", 6, "array"), ("content.valueProps", "Value propositions", 5, "array"),
    ("services", "Services", 10, "array"), ("gallery", "Gallery images", 4, "array"), ("testimonials", "Testimonials", 6, "array"), ("faqs", "FAQs", 4, "array"),
    ("team", "Team members", 2, "array"), ("social", "Social profiles", 3, "map"), ("seo.title", "SEO title", 4, "text"), ("seo.description", "SEO description", 4, "text"),
)
REQUIRED = ("business.name", "content.hero.headline")
#: Schema.org types by words of the category, first match first.
TYPES = (
    ("hvac|heating|air condition", "HVACBusiness"), ("plumb", "Plumber"), ("electric", "Electrician"), ("roof", "RoofingContractor"),
    ("contractor|construct|remodel|builder", "GeneralContractor"), ("landscap|lawn|garden", "Landscaper"), ("clean|maid|janitor", "HomeAndConstructionBusiness"),
    ("paint|decorat", "HousePainter"), ("pest|exterminat", "PestControlService"), ("lock", "Locksmith"), ("mov(ing|er)", "MovingCompany"),
    ("auto|mechanic|car repair|collision|tire", "AutoRepair"), ("dent(ist|al)", "Dentist"), ("doctor|physician|medical|clinic", "MedicalBusiness"),
    ("veterinar|animal hospital", "VeterinaryCare"), ("chiropract", "Chiropractic"), ("optometr|optician|eye", "Optician"), ("law|attorney|legal|solicitor", "Attorney"),
    ("account|cpa|bookkeep|tax", "AccountingService"), ("insurance", "InsuranceAgency"), ("real estate|realtor", "RealEstateAgent"), ("restaurant|bistro|diner|grill", "Restaurant"),
    ("cafe|coffee", "CafeOrCoffeeShop"), ("bakery|baker", "Bakery"), (r"bar\b|pub|brewery|taproom", "BarOrPub"), ("caterer|catering", "FoodEstablishment"),
    ("salon|hair|barber", "HairSalon"), ("nail", "NailSalon"), (r"\bspas?\b|massage", "DaySpa"), ("gym|fitness|crossfit|yoga|pilates", "ExerciseGym"), ("florist|flower", "Florist"),
    ("photograph", "ProfessionalService"), ("child care|childcare|daycare|nursery", "ChildCare"), ("storage", "SelfStorage"), ("travel", "TravelAgency"), ("pharmac", "Pharmacy"),
    ("store|shop|boutique|retail", "Store"),
)


def schema_type(category: Column) -> Column:
    c = F.lower(F.coalesce(category, F.lit("")))
    return F.coalesce(*[F.when(c.rlike(rule), F.lit(kind)) for rule, kind in TYPES], F.lit("LocalBusiness"))


def is_filled(c: Column, kind: str) -> Column:
    if kind == "array":
        return F.coalesce(F.size(c) > 0, F.lit(False))
    if kind == "map":
        return F.coalesce(F.exists(F.map_values(c), lambda v: T.squash(v) != ""), F.lit(False))
    return T.squash(c) != ""


def profile_fields(profiles: DataFrame) -> DataFrame:
    """(site, ord, path, label, weight, filled): a row for each field that counts."""
    rows = F.array(*[
        F.struct(F.lit(i).alias("ord"), F.lit(path).alias("path"), F.lit(label).alias("label"), F.lit(weight).cast("bigint").alias("weight"), is_filled(F.col(path), kind).alias("filled"))
        for i, (path, label, weight, kind) in enumerate(FIELDS)
    ])
    return profiles.select("site", F.explode(rows).alias("f")).select("site", "f.*")


def profile_score(profiles: DataFrame) -> DataFrame:
    """(site, percent, earned, total)."""
    sums = profile_fields(profiles).groupBy("site").agg(F.sum(F.when(F.col("filled"), F.col("weight")).otherwise(0)).alias("earned"), F.sum("weight").alias("total"))
    return sums.select("site", F.round(100 * F.col("earned") / F.col("total")).cast("bigint").alias("percent"), "earned", "total")


def profile_gaps(profiles: DataFrame) -> DataFrame:
    """(site, ord, path, label, weight): what is missing, heaviest first."""
    order = Window.partitionBy("site").orderBy(F.desc("weight"), "ord")
    return profile_fields(profiles).where("not filled").select("site", F.row_number().over(order).alias("ord"), "path", "label", "weight")


def profile_validate(profiles: DataFrame) -> DataFrame:
    """(site, level, code, what): errors, warnings and notes on profiles, as normalize_profiles() gives them or of fewer columns.

    Without a column `version` or `settings` nothing is said about the version, and there is no form.
    """
    profiles = profiles if "settings" in profiles.columns else profiles.withColumn("settings", F.struct(F.struct(F.lit("none").alias("provider"), F.lit("").alias("action")).alias("form")))
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    headline, description = T.squash(F.col("content.hero.headline")), F.coalesce("seo.description", F.lit(""))
    has = {path: is_filled(F.col(path), kind) for path, _, _, kind in FIELDS}
    words = T.word_count(headline)
    primary = F.col("brand.colors.primary")
    ratio = C.contrast(C.colour_parse(primary), F.lit("#ffffff"))
    provider, action = F.coalesce("settings.form.provider", F.lit("none")), F.coalesce("settings.form.action", F.lit(""))
    thin = F.filter("services", lambda s: T.squash(s["summary"]) == "")
    bare = F.size(F.filter("gallery", lambda g: T.squash(g["alt"]) == ""))
    rules = [("error", "required", ~has[p], F.lit(f"Missing required field: {p} ({label}).")) for p, label, _, _ in FIELDS if p in REQUIRED]
    if "version" in profiles.columns:
        rules.append(("warning", "version", F.coalesce("version", F.lit("")) != VERSION, text('Profile schema is "', F.coalesce("version", F.lit("missing")), f'", expected "{VERSION}".')))
    rules += [
        ("error", "no_contact", ~(has["contact.phone"] | has["contact.email"] | (action != "") | (provider == "netlify")),
         F.lit("No way for a customer to make contact: set contact.phone, contact.email, or site.form.action.")),
        ("error", "form", ~provider.isin("none", "netlify", "") & (action == ""), text('site.form.provider is "', provider, '" but site.form.action is empty.')),
        ("warning", "long_headline", words > 14, text("Hero headline is ", words.cast("string"), " words — aim for 10 or fewer so it reads at a glance.")),
        ("warning", "welcome", headline.rlike("(?i)^welcome to "), F.lit('Hero headline starts with "Welcome to" — replace it with a benefit-led line.')),
        ("warning", "description", (description != "") & ~F.length(description).between(70, 160), text("SEO description is ", F.length(description).cast("string"), " characters — target 140–160.")),
        ("warning", "title", F.length("seo.title") > 65, F.lit("SEO title is over 65 characters and will be truncated in search results.")),
        ("warning", "no_services", ~has["services"], F.lit("No services listed — the services section and per-service pages will be skipped.")),
        ("warning", "thin_services", F.size(thin) > 0, text("Services with no summary: ", F.array_join(F.transform(thin, lambda s: s["name"]), ", "), ".")),
        ("warning", "gallery_alt", bare > 0, text(bare.cast("string"), " gallery image(s) have no alt text (accessibility + SEO).")),
        ("warning", "no_place", ~has["contact.address.city"] & ~has["business.serviceArea"], F.lit("No city or service area — local SEO markup will be weak.")),
        ("warning", "contrast", ratio < 3, text("Brand primary ", primary, " has only ", F.format_number(ratio, 1), ":1 contrast on white; the theme will darken it for text use.")),
        ("note", "no_testimonials", ~has["testimonials"], F.lit("No testimonials. Ask the client for three — social proof is the single biggest conversion lift on these rebuilds.")),
        ("note", "no_logo", ~has["brand.logo"], F.lit("No logo. The header will fall back to a styled wordmark.")),
    ]
    rows = F.array(*[F.when(rule, F.struct(F.lit(level).alias("level"), F.lit(code).alias("code"), what.alias("what"))) for level, code, rule, what in rules])
    return profiles.select("site", F.explode(F.filter(rows, lambda x: x.isNotNull())).alias("r")).select("site", "r.*")


def brand_contrast(profiles: DataFrame, palettes: DataFrame) -> DataFrame:
    """(site, theme, mode, background, ratio, passes, corrected): a brand colour on each theme's background; 4.5 passes.

    corrected is the colour of the same hue whose lightness, in steps of a hundredth from the half, passes first.
    palettes(theme, mode, background) is a dimension of a few rows.
    """
    if (many := palettes.count()) > 1000:
        raise ValueError(f"{many} palettes; a dimension of at most 1000 is paired with every profile")
    pairs = palettes.agg(F.collect_list(F.struct("theme", "mode", "background")).alias("p"))
    rows = profiles.select("site", C.colour_parse(F.col("brand.colors.primary")).alias("colour")).where("colour is not null").withColumn("p", pairs.scalar())
    rows = rows.select("site", "colour", F.explode("p").alias("p")).select("site", "colour", "p.*")
    rows = rows.withColumn("ratio", C.contrast(F.col("colour"), F.col("background")))
    return rows.select("site", "theme", "mode", "background", "ratio", (F.col("ratio") >= 4.5).alias("passes"), C.ensure_contrast(F.col("colour"), F.col("background")).alias("corrected"))


SECTION = "array<struct<type:string,title:string,intro:string,max_items:int,preview:boolean,compact:boolean,heading:string,exclude:string>>"


def section(kind: str, title: Column | str | None = None, intro: Column | None = None, most: int | None = None, preview: bool = False, compact: bool = False, heading: str | None = None, exclude: Column | None = None) -> Column:
    """A part of a page. heading: null for the theme's own, empty for none."""
    c = lambda x, kind="string": (x if isinstance(x, Column) else F.lit(x)).cast(kind)
    return F.struct(F.lit(kind).alias("type"), c(title).alias("title"), c(intro).alias("intro"), c(most, "int").alias("max_items"), F.lit(preview).alias("preview"), F.lit(compact).alias("compact"), c(heading).alias("heading"), c(exclude).alias("exclude"))


#: What planned pages and their graphs read of a profile.
PLAN_PARTS = (
    "business.name", "business.tagline", "business.description", "contact.phone", "contact.address", "content.about", "content.valueProps", "content.stats", "content.closingCta", "services.slug", "services.name", "services.summary", "services.description",
    "caseStudies", "gallery", "testimonials", "team", "legal", "faqs", "seo.title", "seo.description",
)
GRAPH_PARTS = (*(x for x in PLAN_PARTS if not x.startswith("business.")), "business", "contact.email", "contact.hours", "contact.geo", "content.hero", "brand.logo", "social")


def planned_pages() -> Column:
    """An array of the pages that a profile supports, in order, from the columns of a normalised profile.

    Home, contact and the page for what isn't found are always there; about needs a text or a team, services any, a page each
    once two of them are described, work a case study, a gallery three images; legal pages follow the contact page.
    """
    has = {c: F.size(c) > 0 for c in ("services", "caseStudies", "testimonials", "team", "faqs", "content.about.body", "content.valueProps", "content.stats")}
    about, gallery = has["content.about.body"], F.size("gallery") >= 3
    described = F.size(F.filter("services", lambda s: (s["summary"] != "") | (F.size(s["description"]) > 0))) >= 2
    name, tagline = F.col("business.name"), F.col("business.tagline")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    none = F.lit(None).cast("string")
    cta = section("cta")

    def sections(*parts: Column | tuple[Column, Column]) -> Column:
        each = [F.when(p[0], p[1]) if isinstance(p, tuple) else p for p in parts]
        return F.filter(F.array(*each), lambda x: x.isNotNull()).cast(SECTION)

    def page(slug: Column | str, url: Column | str, title: Column, description: Column, label: Column | str | None, nav: bool, parts: Column, out: Column | str | None = None, noindex: bool = False, parent: str | None = None, service: Column = none) -> Column:
        c = lambda x: x if isinstance(x, Column) else F.lit(x)
        return F.struct(
            c(slug).alias("slug"), c(url).alias("url"), (c(out) if out is not None else text(c(url), "index.html")).alias("out_path"), title.alias("title"), description.alias("description"), c(label).cast("string").alias("nav_label"), F.lit(nav).alias("nav"),
            F.lit(noindex).alias("noindex"), F.lit(parent).cast("string").alias("parent"), service.alias("service"), parts.alias("sections"))

    or_else = lambda a, b: F.when(a != "", a).otherwise(b)
    home = page("home", "", or_else(F.col("seo.title"), name), F.col("seo.description"), "Home", True, sections(
        section("hero"), (has["content.valueProps"] | has["content.stats"], section("trustbar")), (has["services"], section("services", most=6, preview=True)), (about, section("about", preview=True)), (gallery, section("gallery", most=6, preview=True)),
        (has["caseStudies"], section("caseStudies", most=2, preview=True)), (has["testimonials"], section("testimonials", most=3)), (has["faqs"], section("faq", most=4, preview=True)), cta, section("contact", compact=True)))
    heading = or_else(F.col("content.about.heading"), text("About ", name))
    about_page = page("about", "about/", text("About ", name), or_else(F.col("business.description"), F.coalesce(F.get("content.about.body", F.lit(0)), F.lit(""))), "About", True, sections(
        section("pageHeader", heading, tagline), (about, section("about", heading="")), (has["content.stats"], section("trustbar")), (has["team"], section("team")), (has["testimonials"], section("testimonials", most=3)), cta))
    town = F.col("contact.address.city")
    services = page("services", "services/", text("Services | ", name), text("What ", name, " offers", F.when(town != "", text(" in ", town)).otherwise(""), "."), "Services", True, sections(
        section("pageHeader", "Our services", tagline), section("services", heading=""), (has["faqs"], section("faq")), cta))

    def each_service(s: Column) -> Column:
        slug = T.slug(or_else(s["slug"], s["name"]))
        return page(text("service-", slug), text("services/", slug, "/"), text(s["name"], " | ", name), or_else(s["summary"], text(s["name"], " from ", name, ".")), None, False, sections(
            section("pageHeader", s["name"], s["summary"]), section("serviceDetail"), section("services", most=4, heading="Other services", exclude=slug), cta), parent="services", service=s["slug"])

    work = page("work", "work/", text("Case studies | ", name), text("How ", name, " rebuilt these sites, and what changed."), "Case studies", True, sections(section("pageHeader", "Case studies"), section("caseStudies", heading=""), cta))
    shown = page("gallery", "gallery/", text("Gallery | ", name), text("Recent work from ", name, "."), "Gallery", True, sections(section("pageHeader", "Our work"), section("gallery", heading=""), cta))
    phone = F.col("contact.phone")
    contact = page("contact", "contact/", text("Contact | ", name), text("Get in touch with ", name, F.when(phone != "", text(" on ", phone)).otherwise(""), "."), "Contact", True, sections(section("pageHeader", "Get in touch", F.col("content.closingCta.text")), section("contact")))
    legal = F.transform("legal", lambda x: page(x["slug"], text(x["slug"], "/"), text(x["title"], " | ", name), text(x["title"], " for ", name, "."), x["title"], False, sections(section("pageHeader", x["title"]), section("legal", exclude=x["slug"]))))
    missing = page("404", "404.html", text("Page not found | ", name), F.lit(""), None, False, sections(section("notFound"), cta), out="404.html", noindex=True)
    given = lambda rule, p: F.when(rule, p)
    pages = F.concat(
        F.array(home, given(about | has["team"], about_page), given(has["services"], services)), F.transform(F.when(described, F.col("services")).otherwise(F.slice("services", 1, 0)), each_service),
        F.array(given(has["caseStudies"], work), given(gallery, shown), contact), legal, F.array(missing))
    return F.filter(pages, lambda x: x.isNotNull())


def page_plan(profiles: DataFrame) -> DataFrame:
    """(site, ord, path, slug, url, out_path, title, description, nav_label, nav, noindex, parent, service, sections): pages that a normalised profile supports.

    parent is the slug of the page above one, service the slug of the service that it describes.
    """
    planned = profiles.select("site", F.posexplode(planned_pages()).alias("ord", "p"))
    return planned.select("site", "ord", F.concat(F.lit("/"), "p.url").alias("path"), "p.*")


def plan_sections(plan: DataFrame) -> DataFrame:
    """(site, ord, slug, nth, type, title, intro, max_items, preview, compact, heading, exclude): the sections of planned pages as rows."""
    return plan.select("site", "ord", "slug", F.posexplode("sections").alias("nth", "s")).select("site", "ord", "slug", "nth", "s.*")


def sitemap_rows(plan: DataFrame) -> DataFrame:
    """(site, loc, changefreq, priority) of planned pages that may be indexed."""
    child = F.col("path").rlike("^/[^/]+/[^/]+/$")
    rows = plan.where("not noindex")
    return rows.select("site", F.concat(F.lit("https://"), "site", "path").alias("loc"), F.when(F.col("path") == "/", "weekly").otherwise("monthly").alias("changefreq"),
                       F.when(F.col("path") == "/", 1.0).when(child, 0.6).otherwise(0.8).alias("priority"))


def day_clock(c: Column) -> Column:
    """A clock text as hh:mm, empty for what is none. Without am or pm the hour stays."""
    shape = r"(?i)^(\d{1,2}):?(\d{2})?\s*(am|pm)?$"
    t = F.trim(c)
    hour, half = F.regexp_extract(t, shape, 1).try_cast("int"), F.lower(F.regexp_extract(t, shape, 3))
    full = F.when((half == "pm") & (hour != 12), hour + 12).when((half == "am") & (hour == 12), 0).otherwise(hour)
    minute = F.regexp_extract(t, shape, 2)
    return F.when(t.rlike(shape), F.concat(F.lpad(full.cast("string"), 2, "0"), F.lit(":"), F.when(minute == "", "00").otherwise(minute))).otherwise("")


def jsonld_export(profiles: DataFrame, site_url: Column | None = None) -> DataFrame:
    """(site, ord, path, jsonld): for every planned page of normalised profiles a schema.org graph as JSON text.

    The business with address, place, hours, networks, offers and rating; the site; but for the home page and pages that
    aren't indexed the way to the page by its parents; questions where the page shows them; the service that it describes. Empty
    values are left out at every depth. Keys stand in alphabetical order. site_url: the address of the site, https://site without one; empty for relative addresses.
    """
    base = F.concat(F.lit("https://"), "site") if site_url is None else site_url
    rows = profiles.withColumn("_base", F.regexp_replace(F.coalesce(base, F.lit("")), "/$", ""))
    top, some = F.col("_base"), lambda c: F.nullif(c, F.lit(""))
    absolute = lambda c: F.when(top == "", c).otherwise(F.concat(top, F.lit("/"), c))
    picture = lambda c: F.when(c != "", F.coalesce(F.when(top != "", U.absolute(c, F.concat(top, F.lit("/")))), c))
    node = lambda **parts: F.struct(*[parts[name].alias(name) for name in sorted(parts)])
    typed = lambda kind, **parts: node(**{"@type": F.lit(kind)}, **parts)
    known = lambda key: {"@id": key}
    filled = lambda rows: F.when(F.size(rows) > 0, rows)
    business_id = F.when(top == "", "#business").otherwise(F.concat(top, F.lit("/#business")))
    b, a, phone = F.col("business"), F.col("contact.address"), F.col("contact.phone")
    street = F.array_join(F.filter(F.array(a["street"], a["street2"]), lambda x: x != ""), ", ")
    address = typed("PostalAddress", streetAddress=some(street), addressLocality=some(a["city"]), addressRegion=some(a["region"]), postalCode=some(a["postalCode"]), addressCountry=some(a["country"]))
    geo = F.col("contact.geo")
    places = filled(F.transform(b["serviceArea"], lambda x: typed("Place", name=x)))
    hours = F.transform(F.filter("contact.hours", lambda h: ~h["closed"] & (day_clock(h["open"]) != "") & (day_clock(h["close"]) != "")), lambda h: typed(
        "OpeningHoursSpecification", dayOfWeek=F.concat(F.lit("https://schema.org/"), F.initcap(h["day"])), opens=day_clock(h["open"]), closes=day_clock(h["close"])))
    same = F.filter(F.array(*[F.try_element_at("social", F.lit(key)) for key, _ in NETWORKS]), lambda x: F.coalesce(x, F.lit("")) != "")
    offers = F.transform("services", lambda s: typed("Offer", itemOffered=typed("Service", name=some(s["name"]), description=some(s["summary"]))))
    rated = F.filter(F.transform("testimonials", lambda t: t["rating"]), lambda r: r.isNotNull())
    mean = F.aggregate(rated, F.lit(0.0), lambda x, r: x + r) / F.size(rated)
    business = F.to_json(node(
        **{"@type": schema_type(b["category"])}, **known(business_id), name=some(b["name"]), url=some(top), description=some(b["description"]), telephone=some(tel_href(phone)), email=some(F.col("contact.email")),
        priceRange=some(b["priceRange"]), foundingDate=some(b["founded"]), image=picture(F.col("content.hero.image")), logo=picture(F.col("brand.logo")), address=F.when((a["street"] != "") | (a["city"] != ""), address),
        geo=F.when((geo["lat"] != 0) & (geo["lng"] != 0), typed("GeoCoordinates", latitude=geo["lat"], longitude=geo["lng"])), areaServed=places, openingHoursSpecification=filled(hours), sameAs=filled(same),
        hasOfferCatalog=F.when(F.size("services") > 0, typed("OfferCatalog", name=F.lit("Services"), itemListElement=offers)),
        aggregateRating=F.when(F.size(rated) >= 2, typed("AggregateRating", ratingValue=F.format_string("%.1f", mean), reviewCount=F.size(rated)))))
    website = F.when(top != "", F.to_json(typed("WebSite", **known(F.concat(top, F.lit("/#website"))), url=top, name=some(b["name"]), publisher=node(**known(business_id)))))
    questions = F.to_json(typed("FAQPage", mainEntity=F.transform("faqs", lambda f: typed("Question", name=f["question"], acceptedAnswer=typed("Answer", text=f["answer"])))))
    # What all pages of a site share is made once, before the pages become rows.
    shared = rows.select("*", business.alias("_business"), website.alias("_website"), F.when(F.size("faqs") > 0, questions).alias("_questions"), places.alias("_places"), business_id.alias("_id"))
    # A page comes with the page above it and its service, so that a site's pages and services aren't sent along with each of them. The array is made
    # where it is taken apart: as a column, it would be worked out again for each condition that Spark puts before that.
    named = lambda rows, slug: F.get(F.filter(rows, lambda x: x["slug"] == slug), F.lit(0))
    planned = let(planned_pages(), lambda plan: F.transform(plan, lambda p: F.struct(p.alias("p"), named(plan, p["parent"]).alias("above"), named(F.col("services"), p["service"]).alias("own"))))
    each = shared.select("site", "_base", "_business", "_website", "_questions", "_places", "_id", F.posexplode(planned).alias("ord", "x")).select("*", "x.*")
    label = lambda p: F.coalesce(p["nav_label"], p["title"])
    above = F.col("above")
    step = lambda name, url: F.struct(name.alias("name"), absolute(url).alias("item"))
    way = F.filter(F.array(step(F.lit("Home"), F.lit("")), F.when(F.col("p.parent").isNotNull(), step(label(above), above["url"])), step(label(F.col("p")), F.col("p.url"))), lambda x: x.isNotNull())
    crumbs = F.to_json(typed("BreadcrumbList", itemListElement=F.transform(way, lambda x, i: typed("ListItem", position=i + 1, name=some(x["name"]), item=some(x["item"])))))
    own = F.col("own")
    service = F.to_json(typed("Service", name=some(own["name"]), description=some(own["summary"]), provider=node(**known(F.col("_id"))), areaServed=F.col("_places")))
    nodes = F.filter(F.array(
        "_business", "_website", F.when((F.col("p.slug") != "home") & ~F.col("p.noindex"), crumbs), F.when(F.exists("p.sections", lambda x: x["type"] == "faq"), F.col("_questions")), F.when(F.col("p.service").isNotNull(), service)), lambda x: x.isNotNull())
    graph = F.concat(F.lit('{"@context":"https://schema.org","@graph":['), F.array_join(nodes, ","), F.lit("]}"))
    return each.select("site", "ord", F.concat(F.lit("/"), "p.url").alias("path"), graph.alias("jsonld"))
