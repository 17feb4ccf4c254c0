"""Structured data in pages: JSON-LD objects, businesses and opening hours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteloom.functions import text as T
from siteloom.functions.once import let
from siteloom.operators.contacts import to_12h
from siteloom.operators.pages import PAGE, attr

#: Keys whose objects stand on their own, day names, types of businesses.
NESTED = ("review", "reviews", "makesOffer", "hasOfferCatalog", "itemListElement", "subOrganization", "employee", "member")
DAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
BUSINESS = (
    "(?i)^(LocalBusiness|Organization|Corporation|Store|Restaurant|Dentist|Physician|MedicalBusiness|HomeAndConstructionBusiness|Plumber|Electrician|HVACBusiness|RoofingContractor"
    "|GeneralContractor|Locksmith|MovingCompany|AutoRepair|AutomotiveBusiness|BeautySalon|HairSalon|DaySpa|HealthAndBeautyBusiness|ProfessionalService|LegalService|Attorney|AccountingService"
    "|InsuranceAgency|RealEstateAgent|ChildCare|Veterinary|VeterinaryCare|FoodEstablishment|Bakery|Cafe|BarOrPub|EntertainmentBusiness|SportsActivityLocation|ExerciseGym|Landscaper|PestControl"
    "|CleaningService|SelfStorage|FinancialService|TravelAgency|Florist|Photographer|PetStore|GardenStore|HardwareStore|FurnitureStore|ClothingStore|JewelryStore|ShoeStore|SportingGoodsStore"
    "|LiquorStore|GroceryStore|ConvenienceStore|Pharmacy|Optician|NailSalon|TattooParlor|Notary|EmploymentAgency)$"
)
LEVELS = 6


def member(node: Column, key: str) -> Column:
    """The value of a key as JSON text; null if there is none."""
    return F.try_variant_get(node, f"$['{key}']", "variant")


def text_of(node: Column, path: str) -> Column:
    return T.squash(F.try_variant_get(node, path, "string"))


def items(v: Column) -> Column:
    """A JSON array's items, or the value itself as the only one; none for null."""
    listed = lambda x: F.coalesce(F.try_variant_get(x, "$", "array<variant>"), F.array(x))
    return let(v, lambda x: F.when(x.isNull(), F.array().cast("array<variant>")).otherwise(listed(x)))


def jsonld_nodes(nodes: DataFrame) -> DataFrame:
    """(site, page_id, ord, types, node): typed objects of JSON-LD scripts, lists, graphs and nested objects flattened.

    Text that isn't JSON is tried again without comments and trailing commas, then dropped.
    """
    scripts = nodes.where((F.col("tag") == "script") & (attr("type") == "application/ld+json") & (F.trim("text") != ""))
    raw = F.col("text")
    mended = F.regexp_replace(F.regexp_replace(raw, r"<!--[\s\S]*?-->", ""), r",\s*([}\]])", "$1")
    level = scripts.select(*PAGE, F.lpad(F.col("node_id").cast("string"), 8, "0").alias("at"), F.coalesce(F.try_parse_json(raw), F.try_parse_json(mended)).alias("node")).where("node is not null")
    found = None
    for _ in range(LEVELS + 1):
        level = level.select(*PAGE, "at", F.posexplode(items(F.col("node"))).alias("i", "node")).select(
            *PAGE, F.concat_ws(".", "at", F.lpad(F.col("i").cast("string"), 6, "0")).alias("at"), "node")
        found = level if found is None else found.unionByName(level)
        inner = F.array(member(F.col("node"), "@graph"), *[member(F.col("node"), k) for k in NESTED])
        level = level.select(*PAGE, "at", F.posexplode(inner).alias("k", "node")).where("node is not null").select(
            *PAGE, F.concat_ws(".", "at", F.lpad(F.col("k").cast("string"), 2, "0")).alias("at"), "node")
    kinds = F.transform(items(member(F.col("node"), "@type")), lambda t: F.regexp_replace(F.try_variant_get(t, "$", "string"), r"^https?://schema\.org/", ""))
    typed = found.withColumn("types", F.filter(kinds, lambda t: t.isNotNull())).where(F.size("types") > 0)
    return typed.select(*PAGE, F.row_number().over(Window.partitionBy(*PAGE).orderBy("at")).alias("ord"), "types", "node")


def jsonld_business(jsonld: DataFrame) -> DataFrame:
    """(site, page_id, node): the first object of a page that is a business."""
    own = jsonld.where(F.exists("types", lambda t: t.rlike(BUSINESS)))
    first = own.withColumn("nth", F.row_number().over(Window.partitionBy(*PAGE).orderBy("ord"))).where("nth = 1")
    return first.select(*PAGE, "types", "node")


def jsonld_profile(jsonld: DataFrame) -> DataFrame:
    """(site, page_id, name, description, category, phone, email, street, city, region, postal_code, lat, lng, legal_name, country, price_range, founded, service_area).

    An address that is a text is a street; a founding date counts by its year.
    """
    n = F.col("node")
    areas = F.filter(F.transform(items(member(n, "areaServed")), said), lambda x: x != "")
    whole = F.when(F.schema_of_variant(member(n, "address")) == "STRING", text_of(n, "$.address"))
    other = F.get(F.filter("types", lambda t: ~t.rlike("(?i)^(LocalBusiness|Organization)$")), F.lit(0))
    return jsonld_business(jsonld).select(
        *PAGE, F.coalesce(F.nullif(text_of(n, "$.name"), F.lit("")), text_of(n, "$.legalName")).alias("name"), text_of(n, "$.description").alias("description"),
        F.coalesce(F.nullif(text_of(n, "$.additionalType"), F.lit("")), other, F.lit("")).alias("category"), text_of(n, "$.telephone").alias("phone"),
        F.regexp_replace(text_of(n, "$.email"), "(?i)^mailto:", "").alias("email"), F.coalesce(text_of(n, "$.address.streetAddress").cast("string"), F.lit("")).alias("street_"), F.coalesce(whole, F.lit("")).alias("whole_"), text_of(n, "$.address.addressLocality").alias("city"),
        text_of(n, "$.address.addressRegion").alias("region"), text_of(n, "$.address.postalCode").alias("postal_code"),
        F.try_variant_get(n, "$.geo.latitude", "double").alias("lat"), F.try_variant_get(n, "$.geo.longitude", "double").alias("lng"),
        text_of(n, "$.legalName").alias("legal_name"), text_of(n, "$.address.addressCountry").alias("country"), text_of(n, "$.priceRange").alias("price_range"), F.substring(text_of(n, "$.foundingDate"), 1, 4).alias("founded"), areas.alias("service_area"),
    ).withColumn("street_", F.when(F.col("street_") != "", F.col("street_")).otherwise(F.col("whole_"))).drop("whole_").withColumnRenamed("street_", "street")


def day_number(c: Column) -> Column:
    """0 for Monday to 6 for Sunday, from full names and their starts; null for others."""
    key = F.regexp_replace(F.lower(F.regexp_replace(c, r"^https?://schema\.org/", "")), "[^a-z]", "")
    return F.coalesce(*[F.when((F.length(key) >= 2) & F.startswith(F.lit(d), key), F.lit(i)) for i, d in enumerate(DAYS)])


def jsonld_hours(jsonld: DataFrame) -> DataFrame:
    """(site, page_id, day, opens, closes, closed): hours of the page's business, in 12-hour text; day ranges wrap the week."""
    business = jsonld_business(jsonld)
    spec = business.select(*PAGE, F.explode(items(member(F.col("node"), "openingHoursSpecification"))).alias("s"))
    spec = spec.select(*PAGE, F.explode(items(member(F.col("s"), "dayOfWeek"))).alias("d"), text_of(F.col("s"), "$.opens").alias("o"), text_of(F.col("s"), "$.closes").alias("c"))
    full = spec.select(*PAGE, day_number(F.try_variant_get("d", "$", "string")).alias("day"), to_12h(F.col("o")).alias("opens"), to_12h(F.col("c")).alias("closes"),
                       ((F.col("o") == "") | (F.col("o") == F.col("c"))).alias("closed")).where("day is not null")
    shape = r"^([A-Za-z]{2,9})\s*(?:-\s*([A-Za-z]{2,9}))?\s+(\d{1,2}:\d{2})\s*-\s*(\d{1,2}:\d{2})$"
    old = business.select(*PAGE, F.explode(items(member(F.col("node"), "openingHours"))).alias("v")).select(*PAGE, F.trim(F.try_variant_get("v", "$", "string")).alias("t")).where(F.col("t").rlike(shape))
    part = lambda i: F.regexp_extract("t", shape, i)
    first, last = day_number(part(1)), F.when(part(2) == "", day_number(part(1))).otherwise(F.coalesce(day_number(part(2)), day_number(part(1))))
    days = F.transform(F.sequence(F.lit(0), F.pmod(last - first, F.lit(7))), lambda i: ((first + i) % 7).cast("int"))
    ranged = old.where(first.isNotNull()).select(*PAGE, F.explode(days).alias("day"), to_12h(part(3)).alias("opens"), to_12h(part(4)).alias("closes"), F.lit(False).alias("closed"))
    return full.unionByName(ranged)


def said(v: Column) -> Column:
    """A value as text: of an array its first item, of an object its name, value, address or text."""
    one = F.coalesce(F.try_variant_get(v, "$[0]", "variant"), v)
    inner = F.coalesce(*[F.try_variant_get(one, f"$['{k}']", "string") for k in ("name", "@value", "url", "text")])
    return T.squash(F.when(F.schema_of_variant(one).startswith("OBJECT"), inner).otherwise(F.try_variant_get(one, "$", "string")))


def address_of(v: Column) -> Column:
    """A value as a web address: of an object its url, contentUrl or @id."""
    one = F.coalesce(F.try_variant_get(v, "$[0]", "variant"), v)
    inner = F.coalesce(*[F.try_variant_get(one, f"$['{k}']", "string") for k in ("url", "contentUrl", "@id")])
    return F.trim(F.coalesce(F.when(F.schema_of_variant(one).startswith("OBJECT"), inner).otherwise(F.try_variant_get(one, "$", "string")), F.lit("")))


def _bare(c: Column) -> Column:
    return T.squash(F.regexp_replace(c, "<[^>]+>", " "))


def jsonld_children(jsonld: DataFrame) -> DataFrame:
    """(site, page_id, kind, ord, name, text, role, image, price, rating, date): services, questions, reviews and people of a page's objects.

    kind: service (name, text, price, image), faq (question as name, answer as text), review (quote as text, author as name, rating,
    date) or person (name, role, text, image).
    """
    n = F.col("node")
    has = lambda rule: F.exists("types", lambda t: t.rlike(rule))
    at = lambda k: member(n, k)
    empty = F.lit("")

    def rows(df: DataFrame, kind: str, name: Column, text: Column, role: Column = empty, image: Column = empty, price: Column = empty, rating: Column | None = None, date: Column = empty, inner: Column | None = None) -> DataFrame:
        number = F.lit(None).cast("double") if rating is None else rating
        place = F.struct("ord", (F.lit(0) if inner is None else inner).cast("int").alias("inner"))
        return df.select(*PAGE, F.lit(kind).alias("kind"), place.alias("at"), name.alias("name"), text.alias("text"), role.alias("role"), image.alias("image"), price.alias("price"), number.alias("rating"), date.alias("date"))

    either = lambda *keys: F.coalesce(*[at(k) for k in keys])
    offers = rows(jsonld.where(has("(?i)^(Service|Product|Offer)$")), "service", said(either("name", "itemOffered")), said(at("description")), image=address_of(at("image")), price=said(either("price", "priceSpecification"))).where("name <> ''")
    item = member(n, "item")
    listed = jsonld.where(has("(?i)^ListItem$") & F.coalesce(F.try_variant_get(item, "$['@type']", "string"), empty).rlike("(?i)Service|Product"))
    listed = rows(listed, "service", said(item), said(member(item, "description")), image=address_of(member(item, "image"))).where("name <> ''")
    asked = jsonld.where(has("(?i)^FAQPage$")).select(*PAGE, "ord", F.posexplode(items(at("mainEntity"))).alias("i", "q"))
    q = F.col("q")
    answer = lambda v: _bare(said(F.coalesce(F.try_variant_get(member(v, "acceptedAnswer"), "$.text", "variant"), member(v, "acceptedAnswer"))))
    pages = rows(asked, "faq", said(F.coalesce(member(q, "name"), member(q, "question"))), answer(q), inner=F.col("i"))
    single = rows(jsonld.where(has("(?i)^Question$")).withColumn("ord", F.col("ord") + 1_000_000), "faq", said(at("name")), answer(n))
    faqs = pages.unionByName(single).where("name <> '' and text <> ''")
    stars = F.nullif(F.try_variant_get(n, "$.reviewRating.ratingValue", "double"), F.lit(0.0))
    reviews = rows(jsonld.where(has("(?i)^Review$")), "review", said(at("author")), _bare(said(either("reviewBody", "description"))), rating=stars, date=said(at("datePublished"))).where("text <> ''")
    people = rows(jsonld.where(has("(?i)^Person$")), "person", said(at("name")), said(at("description")), role=said(at("jobTitle")), image=address_of(at("image"))).where("name <> ''")
    each = offers.unionByName(listed).unionByName(faqs).unionByName(reviews).unionByName(people)
    order = Window.partitionBy(*PAGE, "kind").orderBy("at")
    return each.select(*PAGE, "kind", F.row_number().over(order).alias("ord"), "name", "text", "role", "image", "price", "rating", "date")


def jsonld_social(jsonld: DataFrame) -> DataFrame:
    """(site, page_id, url): the addresses that a page's business states as its own, and its logo in jsonld_logo()."""
    same = jsonld_business(jsonld).select(*PAGE, F.explode(items(member(F.col("node"), "sameAs"))).alias("u"))
    return same.select(*PAGE, address_of(F.col("u")).alias("url")).where("url <> ''")


def jsonld_logo(jsonld: DataFrame) -> DataFrame:
    """(site, page_id, logo)."""
    return jsonld_business(jsonld).select(*PAGE, address_of(member(F.col("node"), "logo")).alias("logo")).where("logo <> ''")


def patch_merge(profiles: DataFrame, children: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a site's pages state together: (leaves, lists).

    leaves: per site the last page's value of each column of jsonld_profile(); an empty text counts, null doesn't. lists: the
    rows of jsonld_children() of the last page with any hit, a business or a child of any kind but a ListItem alone: its lists replace those of
    earlier pages, even by none.
    """
    columns = [c for c in profiles.columns if c not in PAGE]
    leaves = profiles.groupBy("site").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("page_id"))).alias(c) for c in columns])
    hits = profiles.select(*PAGE).unionByName(children.select(*PAGE)).groupBy("site").agg(F.max("page_id").alias("page_id"))
    return leaves, children.join(hits, PAGE, "left_semi")
