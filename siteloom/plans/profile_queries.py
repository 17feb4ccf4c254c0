"""Registered queries on profiles, written in Spark from the customer table: a profile per customer, filled by its key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteloom.operators import profiles as P
from siteloom.operators.normalize import normalize_profiles
from siteloom.operators.state import spread, written

#: A field is empty where the key modulo its number here is 0.
EMPTY = {path: 2 + i % 11 for i, (path, *_) in enumerate(P.FIELDS)}


def _profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    key = F.col("c_custkey")

    def text(path: str, value: Column | str) -> Column:
        v = F.lit(value) if isinstance(value, str) else value
        return F.when(key % EMPTY[path] == 0, F.lit(" ")).otherwise(v).alias(path.split(".")[-1]) if path in EMPTY else v.alias(path.split(".")[-1])

    def array(path: str, value: Column) -> Column:
        return F.when(key % EMPTY[path] == 0, F.slice(value, 1, 0)).otherwise(value).alias(path.split(".")[-1])

    item = F.struct(F.concat(F.lit("Item "), key.cast("string")).alias("name"), F.when(key % 5 == 0, "").otherwise("About it").alias("summary"))
    other = F.struct(F.lit("Second & last").alias("name"), F.lit("More").alias("summary"))
    photo = F.struct(F.when(key % 3 == 0, "").otherwise("A photo").alias("alt"))
    words = F.array(F.lit("one"))
    return c.select(
        F.concat(F.lit("c"), key.cast("string"), F.lit(".example")).alias("site"),
        F.struct(text("business.name", F.col("c_name")), text("business.tagline", "Fast"), text("business.category", F.element_at(F.array(*[F.lit(x) for x in CATEGORIES]), (key % len(CATEGORIES) + 1).cast("int"))),
                 text("business.description", "Heating"), array("business.serviceArea", words), text("business.founded", "1999")).alias("business"),
        F.struct(text("contact.phone", F.col("c_phone") if "c_phone" in c.columns else "217"), text("contact.email", "a@b.org"),
                 F.struct(text("contact.address.city", "Town"), text("contact.address.street", "1 Road")).alias("address"), array("contact.hours", words)).alias("contact"),
        F.struct(text("brand.logo", "logo.png"), F.struct(text("brand.colors.primary", F.when(key % 4 == 1, "#ffff00").otherwise("#1f3a93"))).alias("colors")).alias("brand"),
        F.struct(F.struct(text("content.hero.headline", F.when(key % 7 == 1, "Welcome to us").otherwise("Warm homes")), text("content.hero.subhead", "Sub"), text("content.hero.image", "h.png")).alias("hero"),
                 F.struct(array("content.about.body", words)).alias("about"), array("content.valueProps", words)).alias("content"),
        array("services", F.array(item, other)), array("gallery", F.array(photo, photo, photo)), array("testimonials", words), array("faqs", words), array("team", words),
        F.when(key % EMPTY["social"] == 0, F.create_map(F.lit("x"), F.lit(""))).otherwise(F.create_map(F.lit("x"), F.lit("https://x.com/a"))).alias("social"),
        F.struct(text("seo.title", "Title"), text("seo.description", F.when(key % 2 == 0, "Short").otherwise(F.repeat(F.lit("x"), 100)))).alias("seo"),
        F.struct(F.struct(F.when(key % 6 == 0, "other").otherwise("none").alias("provider"), F.lit("").alias("action")).alias("form")).alias("settings"),
    )


CATEGORIES = ("HVAC contractor", "family dentist", "spare parts", "day spa", "coffee bar", "book shop", "consulting")


def schema_type(spark, sf_dir):
    return _profiles(spark, sf_dir).select("site", P.schema_type(F.col("business.category")).alias("type"))


def profile_score(spark, sf_dir):
    return P.profile_score(_profiles(spark, sf_dir))


def profile_gaps(spark, sf_dir):
    return P.profile_gaps(_profiles(spark, sf_dir)).select("site", "ord", "path", "weight")


def profile_validate(spark, sf_dir):
    return P.profile_validate(_profiles(spark, sf_dir)).select("site", "level", "code")


def _firms(spark: SparkSession, sf_dir: str, parts: Sequence[str] = ()) -> DataFrame:
    """Normalised profiles of firms by key, with the parts that a query reads: any number of services of which some are described, a team alone, legal pages, case studies, or nothing at all."""
    c = spread(spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey"), "c_custkey")
    key, k = F.col("c_custkey"), F.col("c_custkey").cast("string")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    some = lambda n, r, value: F.when(key % n == r, F.lit(value) if isinstance(value, str) else value)
    item = lambda *f: F.struct(*[(F.lit(v) if isinstance(v, str) else v).alias(n) for n, v in f])
    listed = lambda *rows: F.filter(F.array(*rows), lambda x: x.isNotNull())
    service = lambda i: F.when(key % 4 >= i, item(("name", text(f"Job {i} of ", k)), ("summary", F.when(key % 3 >= i, f"Does {i}")), ("description", F.when((key % 2 == 1) & F.lit(i == 3), "Long"))))
    hour = lambda day, opens, closes: item(("day", day), ("open", opens), ("close", closes))
    quote = lambda i, rating: F.when(key % 3 >= i, item(("quote", f"Quote {i}"), ("rating", rating)))
    return written(normalize_profiles(c.select(
        text("c", k, ".example").alias("site"),
        item(("name", F.when(key % 13 != 0, text("Firm ", k))), ("tagline", some(3, 0, "Fast")), ("category", F.element_at(F.array(*[F.lit(x) for x in CATEGORIES]), (key % len(CATEGORIES) + 1).cast("int"))), ("description", F.when(key % 4 != 0, "We fix")),
             ("serviceArea", F.when(key % 5 != 0, F.array(F.lit("Town"), text("Area ", k)))), ("founded", some(6, 0, "1999")), ("priceRange", some(8, 0, "$$"))).alias("business"),
        item(("phone", F.when(key % 4 == 0, "217 555 0142").when(key % 4 > 1, "+44 20 7946 0000")), ("email", some(3, 1, "a@b.org")), ("address", F.when(key % 6 == 1, item(("street", F.lit(None).cast("string")), ("street2", F.lit(None).cast("string")), ("city", "Salem"))).when(key % 6 > 1, item(("street", text(k, " Road")), ("street2", "Unit 2"), ("city", "Salem")))),
             ("geo", some(5, 2, item(("lat", F.lit(1.5)), ("lng", F.lit(2.25))))), ("hours", some(4, 2, F.array(hour("Wednesday", "10", "by noon"), hour("Tuesday", "Closed", "5 PM"), hour("Monday", "8:00 AM", "5:30 PM"), hour("Friday", "12 AM", "12:15 pm"))))).alias("contact"),
        F.struct(some(7, 0, "/logo.png").alias("logo")).alias("brand"), some(3, 0, F.create_map(F.lit("x"), text("x.com/", k), F.lit("facebook"), text("http://fb.com/", k), F.lit("own"), F.lit("own.example"))).alias("social"),
        item(("hero", item(("headline", "Warm homes"), ("image", some(2, 0, "img/h.png")))), ("about", item(("body", some(5, 1, "About us")))), ("valueProps", some(7, 1, F.array(item(("title", "Fast"))))), ("stats", some(7, 2, F.array(item(("value", "9"), ("label", "Years"))))), ("closingCta", item(("text", some(3, 2, "Call now"))))).alias("content"),
        listed(service(1), service(2), service(3)).alias("services"), some(6, 3, F.array(item(("client", "Client")))).alias("caseStudies"), F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.when(key % 5 >= i, F.concat(F.lit("g"), i.cast("string"), F.lit(".jpg")))).alias("gallery"),
        listed(quote(1, "5"), quote(2, F.when(key % 2 == 1, "4"))).alias("testimonials"), some(5, 3, F.array(item(("name", "Bo")))).alias("team"), some(4, 3, F.array(item(("question", "Q?"), ("answer", "A")))).alias("faqs"),
        some(9, 0, F.array(item(("title", "Terms of use"), ("sections", item(("heading", "H"), ("body", "Text")))))).alias("legal"),
    ), parts), "profiles")


def page_plan(spark, sf_dir):
    kinds = F.array_join(F.transform("sections", lambda s: s["type"]), " ")
    return P.page_plan(_firms(spark, sf_dir, P.PLAN_PARTS)).select("site", "ord", "path", "out_path", "title", "description", "nav_label", "nav", "noindex", "parent", kinds.alias("sections"))


def plan_sections(spark, sf_dir):
    """The sections of all pages, those of single services too; equal ones are counted."""
    rows = P.plan_sections(P.page_plan(_firms(spark, sf_dir, P.PLAN_PARTS)))
    return rows.groupBy("slug", "type", "title", "intro", "max_items", "preview", "heading", "exclude").agg(F.count("*").alias("n"))


def sitemap_rows(spark, sf_dir):
    return P.sitemap_rows(P.page_plan(_firms(spark, sf_dir, P.PLAN_PARTS)))


def jsonld_export(spark, sf_dir):
    """Every node of every page's graph as JSON text."""
    made = P.jsonld_export(_firms(spark, sf_dir, P.GRAPH_PARTS))
    nodes = F.from_json("jsonld", "`@graph` array<string>")["@graph"]  # as texts: a VARIANT's to_json sets up a writer for each key and text
    return made.select("site", "path", F.posexplode(nodes).alias("nth", "node"))


def profile_validate_normalized(spark, sf_dir):
    return P.profile_validate(_firms(spark, sf_dir)).select("site", "level", "code")


QUERIES = [schema_type, profile_score, profile_gaps, profile_validate, profile_validate_normalized, page_plan, plan_sections, sitemap_rows, jsonld_export]

_C = "c as (select c_custkey as k, 'c' || c_custkey || '.example' as site, c_name from customer)"
_HAS = {path: f"(k % {n} <> 0)" for path, n in EMPTY.items()}
_FIELDS = " union all ".join(f"select k, site, {i} as i, '{p}' as path, {w}::bigint as weight, {_HAS[p]} as filled from c" for i, (p, _, w, _k) in enumerate(P.FIELDS))
_TYPES = ("HVACBusiness", "Dentist", "LocalBusiness", "DaySpa", "CafeOrCoffeeShop", "Store", "LocalBusiness")
_RULES = [
    ("error", "required", f"not {_HAS['business.name']}"), ("error", "required", f"not {_HAS['content.hero.headline']}"), ("error", "no_contact", f"not {_HAS['contact.phone']} and not {_HAS['contact.email']}"),
    ("error", "form", "k % 6 = 0"), ("warning", "welcome", f"{_HAS['content.hero.headline']} and k % 7 = 1"), ("warning", "description", f"not {_HAS['seo.description']} or k % 2 = 0"),
    ("warning", "no_services", f"not {_HAS['services']}"), ("warning", "thin_services", f"{_HAS['services']} and k % 5 = 0"), ("warning", "gallery_alt", f"{_HAS['gallery']} and k % 3 = 0"),
    ("warning", "no_place", f"not {_HAS['contact.address.city']} and not {_HAS['business.serviceArea']}"), ("warning", "contrast", f"{_HAS['brand.colors.primary']} and k % 4 = 1"),
    ("note", "no_testimonials", f"not {_HAS['testimonials']}"), ("note", "no_logo", f"not {_HAS['brand.logo']}"),
]
#: The firms and the pages that the rule gives them: at_ is the place among the pages of a site.
_PLAN = """f as (select c_custkey as k, 'c' || c_custkey || '.example' as site, case when c_custkey % 13 <> 0 then 'Firm ' || c_custkey else '' end as name, case when c_custkey % 3 = 0 then 'Fast' else '' end as tagline, case when c_custkey % 4 <> 0 then 'We fix' else '' end as about,
  (['HVAC contractor', 'family dentist', 'spare parts', 'day spa', 'coffee bar', 'book shop', 'consulting'])[c_custkey % 7 + 1] as category, case c_custkey % 4 when 0 then '217 555 0142' when 1 then '' else '+44 20 7946 0000' end as phone, case when c_custkey % 6 > 0 then 'Salem' else '' end as city from customer),
t as (select *, case when city <> '' then city when k % 5 <> 0 then 'Town' else '' end as town from f),
g as (select *, k % 4 as jobs, k % 5 = 1 as has_about, k % 5 = 3 as team, k % 5 >= 3 as gallery, k % 6 = 3 as work, k % 4 = 3 as faq, k % 3 > 0 as quotes, k % 7 = 1 as props, k % 7 = 2 as stats, k % 9 = 0 as legal,
  array_to_string(list_filter([name, case when tagline <> '' then tagline else category end, town], lambda x: x <> ''), ' | ') as seo_title, case when about <> '' then about else '' end as seo_description from t),
d as (select *, (case when jobs >= 1 and k % 3 >= 1 then 1 else 0 end) + (case when jobs >= 2 and k % 3 >= 2 then 1 else 0 end) + (case when jobs >= 3 and k % 2 = 1 then 1 else 0 end) >= 2 as described from g),
j as (select d.*, i, 'Job ' || i || ' of ' || k as job, case when k % 3 >= i then 'Does ' || i else '' end as does, 'job-' || i || '-of-' || k as slug from d, (select unnest([1, 2, 3]) as i) where i <= jobs),
p as (select site, k, 0.0 as at_, '' as url, case when seo_title <> '' then seo_title else name end as title, seo_description as description, 'Home' as nav_label, true as nav, null as parent, 'hero' || case when props or stats then ' trustbar' else '' end || case when jobs > 0 then ' services' else '' end || case when has_about then ' about' else '' end
    || case when gallery then ' gallery' else '' end || case when work then ' caseStudies' else '' end || case when quotes then ' testimonials' else '' end || case when faq then ' faq' else '' end || ' cta contact' as sections from d
  union all select site, k, 1, 'about/', 'About ' || name, case when about <> '' then about when has_about then 'About us' else '' end, 'About', true, null, 'pageHeader' || case when has_about then ' about' else '' end || case when stats then ' trustbar' else '' end || case when team then ' team' else '' end || case when quotes then ' testimonials' else '' end || ' cta' from d where has_about or team
  union all select site, k, 2, 'services/', 'Services | ' || name, 'What ' || name || ' offers' || case when city <> '' then ' in ' || city else '' end || '.', 'Services', true, null, 'pageHeader services' || case when faq then ' faq' else '' end || ' cta' from d where jobs > 0
  union all select site, k, 2 + i / 10, 'services/' || slug || '/', job || ' | ' || name, case when does <> '' then does else job || ' from ' || name || '.' end, null, false, 'services', 'pageHeader serviceDetail services cta' from j where described
  union all select site, k, 3, 'work/', 'Case studies | ' || name, 'How ' || name || ' rebuilt these sites, and what changed.', 'Case studies', true, null, 'pageHeader caseStudies cta' from d where work
  union all select site, k, 4, 'gallery/', 'Gallery | ' || name, 'Recent work from ' || name || '.', 'Gallery', true, null, 'pageHeader gallery cta' from d where gallery
  union all select site, k, 5, 'contact/', 'Contact | ' || name, 'Get in touch with ' || name || case when phone <> '' then ' on ' || phone else '' end || '.', 'Contact', true, null, 'pageHeader contact' from d
  union all select site, k, 6, 'terms-of-use/', 'Terms of use | ' || name, 'Terms of use for ' || name || '.', 'Terms of use', false, null, 'pageHeader legal' from d where legal
  union all select site, k, 7, '404.html', 'Page not found | ' || name, '', null, false, null, 'notFound cta' from d),
q as (select *, cast(row_number() over (partition by site order by at_) - 1 as integer) as ord from p)"""
_TYPE = "(['HVACBusiness', 'Dentist', 'LocalBusiness', 'DaySpa', 'CafeOrCoffeeShop', 'Store', 'LocalBusiness'])[k % 7 + 1]"
_PLACES = """[{"@type":"Place","name":"Town"},{"@type":"Place","name":"Area ' || k || '"}]"""
#: The nodes of a page's graph: keys in alphabetical order, as a VARIANT keeps them.
_NODES = f"""{_PLAN}, n as (select q.site, q.url, q.ord, q.nav_label, q.title as page_title, q.parent, q.sections, d.* exclude (site), 'https://' || d.site as base from q join d using (site)),
biz as (select site, k, '{{"@id":"' || base || '/#business","@type":"' || {_TYPE} || '"' || case when k % 6 = 1 then ',"address":{{"@type":"PostalAddress","addressLocality":"Salem"}}' when k % 6 > 1 then ',"address":{{"@type":"PostalAddress","addressLocality":"Salem","streetAddress":"' || k || ' Road, Unit 2"}}' else '' end
  || case when k % 3 = 2 and k % 2 = 1 then ',"aggregateRating":{{"@type":"AggregateRating","ratingValue":"4.5","reviewCount":2}}' else '' end || case when k % 5 <> 0 then ',"areaServed":{_PLACES}' else '' end || case when about <> '' then ',"description":"We fix"' else '' end
  || case when k % 3 = 1 then ',"email":"a@b.org"' else '' end || case when k % 6 = 0 then ',"foundingDate":"1999"' else '' end || case when k % 5 = 2 then ',"geo":{{"@type":"GeoCoordinates","latitude":1.5,"longitude":2.25}}' else '' end
  || case when jobs > 0 then ',"hasOfferCatalog":{{"@type":"OfferCatalog","itemListElement":[' || (select string_agg('{{"@type":"Offer","itemOffered":{{"@type":"Service"' || case when does <> '' then ',"description":"' || does || '"' else '' end || ',"name":"' || job || '"}}}}', ',' order by i) from j where j.site = n.site) || '],"name":"Services"}}' else '' end
  || case when k % 2 = 0 then ',"image":"' || base || '/img/h.png"' else '' end || case when k % 7 = 0 then ',"logo":"' || base || '/logo.png"' else '' end || case when name <> '' then ',"name":"' || name || '"' else '' end
  || case when k % 4 = 2 then ',"openingHoursSpecification":[{{"@type":"OpeningHoursSpecification","closes":"17:30","dayOfWeek":"https://schema.org/Monday","opens":"08:00"}},{{"@type":"OpeningHoursSpecification","closes":"12:15","dayOfWeek":"https://schema.org/Friday","opens":"00:00"}}]' else '' end
  || case when k % 8 = 0 then ',"priceRange":"$$"' else '' end || case when k % 3 = 0 then ',"sameAs":["http://fb.com/' || k || '","https://x.com/' || k || '"]' else '' end || case when phone = '' then '' else ',"telephone":"' || case when k % 4 = 0 then '+12175550142' else '+442079460000' end || '"' end || ',"url":"' || base || '"}}' as node from n where url = ''),
node as (select n.site, url, 1 as at_, biz.node from n join biz using (site)
  union all select site, url, 2, '{{"@id":"' || base || '/#website","@type":"WebSite"' || case when name <> '' then ',"name":"' || name || '"' else '' end || ',"publisher":{{"@id":"' || base || '/#business"}},"url":"' || base || '"}}' from n
  union all select site, url, 3, '{{"@type":"BreadcrumbList","itemListElement":[{{"@type":"ListItem","item":"' || base || '/","name":"Home","position":1}}' || case when parent is not null then ',{{"@type":"ListItem","item":"' || base || '/services/","name":"Services","position":2}}' else '' end
    || ',{{"@type":"ListItem","item":"' || base || '/' || url || '","name":"' || coalesce(nav_label, page_title) || '","position":' || case when parent is not null then 3 else 2 end || '}}]}}' from n where url not in ('', '404.html')
  union all select site, url, 4, '{{"@type":"FAQPage","mainEntity":[{{"@type":"Question","acceptedAnswer":{{"@type":"Answer","text":"A"}},"name":"Q?"}}]}}' from n where ' ' || sections || ' ' like '% faq %'
  union all select n.site, url, 5, '{{"@type":"Service"' || case when n.k % 5 <> 0 then ',"areaServed":{_PLACES.replace("' || k ||", "' || n.k ||")}' else '' end || case when does <> '' then ',"description":"' || does || '"' else '' end || ',"name":"' || job || '","provider":{{"@id":"' || base || '/#business"}}}}' from n join j on n.site = j.site and url = 'services/' || j.slug || '/')"""

ORACLES = {
    "schema_type": f"with {_C} select site, case when not {_HAS['business.category']} then 'LocalBusiness' else ({list(_TYPES)})[k % {len(_TYPES)} + 1] end as type from c",
    "profile_score": f"with {_C}, f as ({_FIELDS}) select site, cast(round(100.0 * coalesce(sum(weight) filter (filled), 0) / sum(weight)) as bigint) as percent, cast(coalesce(sum(weight) filter (filled), 0) as bigint) as earned, cast(sum(weight) as bigint) as total from f group by site",
    "profile_gaps": f"with {_C}, f as ({_FIELDS}) select site, cast(row_number() over (partition by site order by weight desc, i) as integer) as ord, path, weight from f where not filled",
    "profile_validate": f"with {_C} " + " union all ".join(f"select site, '{level}' as level, '{code}' as code from c where {rule}" for level, code, rule in _RULES),
    "page_plan": f"with {_PLAN} select site, ord, '/' || url as path, case when url = '404.html' then url else url || 'index.html' end as out_path, title, description, nav_label, nav, url = '404.html' as noindex, parent, sections from q",
    "plan_sections": f"""with {_PLAN}, s as (select case when url = '' then 'home' when url = '404.html' then '404' when parent is not null then 'service-' || j.slug else rtrim(url, '/') end as page, q.parent, unnest(string_split(q.sections, ' ')) as type, j.job, j.does, j.slug as own, d.*
        from q join d using (site) left join j on j.site = q.site and q.url = 'services/' || j.slug || '/'), z as (
      select page as slug, type, case when type = 'pageHeader' then case when parent is not null then job when page = 'about' then 'About ' || name when page = 'services' then 'Our services' when page = 'work' then 'Case studies' when page = 'gallery' then 'Our work' when page = 'contact' then 'Get in touch' else 'Terms of use' end end as title,
        case when type = 'pageHeader' then case when parent is not null then does when page in ('about', 'services') then tagline when page = 'contact' then case when k % 3 = 2 then 'Call now' else '' end end end as intro,
        (case when page = 'home' then case type when 'services' then 6 when 'gallery' then 6 when 'caseStudies' then 2 when 'testimonials' then 3 when 'faq' then 4 end when page = 'about' and type = 'testimonials' then 3 when parent is not null and type = 'services' then 4 end)::integer as max_items,
        page = 'home' and type in ('services', 'about', 'gallery', 'caseStudies', 'faq') as preview, case when (page, type) in (('about', 'about'), ('services', 'services'), ('work', 'caseStudies'), ('gallery', 'gallery')) then '' when parent is not null and type = 'services' then 'Other services' end as heading,
        case when type = 'legal' then page when parent is not null and type = 'services' then own end as exclude from s)
      select slug, type, title, intro, max_items, preview, heading, exclude, count(*) as n from z group by all""",
    "sitemap_rows": f"with {_PLAN} select site, 'https://' || site || '/' || url as loc, case when url = '' then 'weekly' else 'monthly' end as changefreq, case when url = '' then 1.0::double when url like '%/%/' then 0.6::double else 0.8::double end as priority from q where url <> '404.html'",
    "jsonld_export": f"with {_NODES} select site, '/' || url as path, cast(row_number() over (partition by site, url order by at_) - 1 as integer) as nth, node from node",
    "profile_validate_normalized": f"""with {_PLAN}, w as (select *, seo_title as st from d)
      select site, 'error' as level, 'required' as code from w where name = '' union all select site, 'error', 'no_contact' from w where phone = '' and k % 3 <> 1 union all select site, 'warning', 'description' from w where about <> '' union all select site, 'warning', 'no_services' from w where jobs = 0
      union all select site, 'warning', 'thin_services' from w where exists (select 1 from j where j.site = w.site and does = '') union all select site, 'warning', 'gallery_alt' from w where k % 5 > 0 union all select site, 'warning', 'no_place' from w where city = '' and k % 5 = 0
      union all select site, 'note', 'no_testimonials' from w where not quotes union all select site, 'note', 'no_logo' from w where k % 7 <> 0""",
}
