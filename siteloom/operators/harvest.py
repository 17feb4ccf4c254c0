"""Profiles drafted from a site's facts, reported to its owner, briefed to a writer and stored."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siteloom.functions import text as T
from siteloom.functions import url as U
from siteloom.operators.jsonld import DAYS
from siteloom.operators.normalize import first_of_each, normalize_profiles
from siteloom.operators.places import format_address
from siteloom.operators.profiles import FIELDS, profile_gaps, profile_score
from siteloom.operators.state import written

GAPS_SHOWN, BRIEF_GAPS, BRIEF_PARAGRAPHS = 10, 14, 12
#: What a report and a brief read of a profile.
REPORT_PARTS = (*dict.fromkeys(path.split(".")[0] for path, *_ in FIELDS if "." in path and not path.startswith("brand")), "services.name", "gallery", "testimonials", "faqs", "team", "social", "brand.logo", "brand.colors")
BRIEF_PARTS = (*REPORT_PARTS, "meta")


def draft_profiles(harvest: DataFrame, parts: Sequence[str] = ()) -> DataFrame:
    """A normalised profile per site from its facts, without any invention. parts: as for normalize_profiles().

    harvest has site, url, title, description, keywords, og (site_name, title, description, image), h1, paragraphs (of the home page), about
    (the longest paragraphs), stated (a row of jsonld_profile() merged by patch_merge(), null for none), phones, emails, address, hours,
    colours (primary, secondary, accent), fonts (heading, body), social, services, testimonials, faqs, team, gallery, logo, hero; and, as
    site_harvest() gives them, pages (their number), slug, social_sources and social_gaps. Names come from structured data, then
    og:site_name, then the title before a separator, then the host.
    """
    pick = lambda *parts: F.coalesce(*[F.nullif(T.squash(x), F.lit("")) for x in parts], F.lit(""))
    og, stated, none = F.col("og"), F.col("stated"), F.lit(None).cast("string")
    known = set(harvest.schema["stated"].dataType.names)
    more = lambda name, kind="string": stated[name] if name in known else F.lit(None).cast(kind)
    extra = lambda name, kind: F.col(name) if name in harvest.columns else F.lit(None).cast(kind)
    before = T.squash(F.get(F.split(F.coalesce("title", F.lit("")), r"[|–—-]"), F.lit(0)))
    host = F.regexp_replace(U.site(F.col("url")), r"^www\.", "")
    name = pick(stated["name"], og["site_name"], before, F.get(F.split(host, r"\."), F.lit(0)))
    about = F.concat(F.lit("About "), T.humanize_heading(name))
    given = F.col("address")
    part = lambda own, other: F.when(given.isNotNull(), given[own]).otherwise(other)
    day = lambda h: F.struct(F.get(F.array(*[F.lit(d) for d in DAYS]), h["day"]).alias("day"), h["closed"].alias("closed"), h["opens"].alias("open"), h["closes"].alias("close"), h["note"].alias("note"))
    rows = harvest.select(
        "site", extra("slug", "string").alias("slug"), F.struct(F.col("url").alias("url"), extra("pages", "bigint").alias("pagesCrawled"), extra("social_sources", "array<string>").alias("socialSources")).alias("source"),
        F.struct(T.humanize_heading(name).alias("name"), more("legal_name").alias("legalName"), T.squash(F.get(F.split(pick(og["description"], F.col("description")), "[.!]"), F.lit(0))).alias("tagline"), F.coalesce(stated["category"], F.lit("")).alias("category"),
                 pick(F.col("description"), og["description"]).alias("description"), more("founded").alias("founded"), more("price_range").alias("priceRange"), more("service_area", "array<string>").alias("serviceArea")).alias("business"),
        F.struct(
            F.coalesce(F.get("phones", F.lit(0)), stated["phone"]).alias("phone"), F.col("phones"), F.coalesce(F.get("emails", F.lit(0)), stated["email"]).alias("email"), F.col("emails"),
            F.struct(part("street", stated["street"]).alias("street"), part("street2", none).alias("street2"), part("city", stated["city"]).alias("city"), part("region", stated["region"]).alias("region"), part("postal_code", stated["postal_code"]).alias("postalCode"), part("country", more("country")).alias("country")).alias("address"),
            F.struct(more("lat", "double").alias("lat"), more("lng", "double").alias("lng")).alias("geo"), F.transform("hours", day).alias("hours"),
        ).alias("contact"),
        F.struct(F.col("logo"), F.col("colours").alias("colors"), F.col("fonts")).alias("brand"), "social",
        F.struct(F.struct(T.humanize_heading(pick(F.col("h1"), og["title"], name)).alias("headline"), pick(og["description"], F.col("description"), F.get("paragraphs", F.lit(0))).alias("subhead"), F.col("hero").alias("image")).alias("hero"),
                 F.struct(about.alias("heading"), F.col("about").alias("body")).alias("about")).alias("content"),
        "services", "gallery", "testimonials", F.transform("team", lambda m: F.struct(m["name"].alias("name"), m["role"].alias("role"), m["bio"].alias("bio"))).alias("team"), "faqs",
        F.struct("title", "description", "keywords").alias("seo"), F.struct(extra("social_gaps", "array<string>").alias("gaps")).alias("meta"),
    )
    return normalize_profiles(rows, parts)


def harvest_report(profiles: DataFrame, site_audit: DataFrame, flags: DataFrame) -> DataFrame:
    """(site, name, phone, email, address, percent, gaps, platform, mobile, https, structured_data, images_no_alt, flags, hours, services, testimonials, faqs, team): what an owner is shown.

    gaps: the ten heaviest missing fields; flags: how many kinds of findings. profiles as from normalize_profiles().
    """
    gaps = profile_gaps(profiles).where(F.col("ord") <= GAPS_SHOWN).groupBy("site").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "label"))), lambda x: x["label"]).alias("gaps"))
    kinds = flags.groupBy("site").agg(F.countDistinct("code").alias("flags"))
    size = lambda c: F.size(c).cast("bigint").alias(c.split(".")[-1])
    a = [F.col(f"contact.address.{x}") for x in ("street", "street2", "city", "region", "postalCode")]
    own = profiles.select("site", F.col("business.name").alias("name"), "contact.phone", "contact.email", format_address(*a).alias("address"), size("contact.hours"), size("services"), size("testimonials"), size("faqs"), size("team"))
    audit = site_audit.select("site", "platform", "mobile", "https", "structured_data", "images", "images_no_alt")
    out = own.join(profile_score(profiles).select("site", "percent"), "site", "left").join(gaps, "site", "left").join(audit, "site", "left").join(kinds, "site", "left")
    return out.withColumn("gaps", F.coalesce("gaps", F.array().cast("array<string>"))).fillna(0, ["flags"])


def brief_rows(profiles: DataFrame, paragraphs: DataFrame, social: DataFrame) -> DataFrame:
    """(site, part, ord, text): what a writer needs.

    copy: source paragraphs, twelve a page; gap: the heaviest missing fields, fourteen; question: what to ask for each of them; social: what
    to do with each network; todo: what the profile says is to be done, then the networks that couldn't be read. paragraphs:
    site, page_id, ord, text; social: social_status().
    """
    order = lambda *c: F.row_number().over(Window.partitionBy("site").orderBy(*c))
    copy = paragraphs.where(F.col("ord") <= BRIEF_PARAGRAPHS).select("site", F.lit("copy").alias("part"), order("page_id", "ord").alias("ord"), "text")
    gaps = profile_gaps(profiles).where(F.col("ord") <= BRIEF_GAPS)
    asked = F.array(F.struct(F.lit("gap").alias("part"), F.col("path").alias("text")), F.struct(F.lit("question").alias("part"), F.concat(F.lit("Ask for: "), "label").alias("text")))
    gaps = gaps.select("site", "ord", F.explode(asked).alias("a")).select("site", "a.part", "ord", "a.text")
    readable = F.concat(F.lit('Readable — mine the bio for tone: "'), T.truncate_words(F.col("description"), 90), F.lit('"'))
    action = F.when(F.col("status") == "ok", readable).otherwise("Blocked to anonymous requests. Add to `_meta.todo` and ask the client.")
    network = social.select("site", F.lit("social").alias("part"), order("label", "url").alias("ord"), F.concat(F.col("label"), F.lit(": "), action).alias("text"))
    own = profiles.select("site", F.posexplode("meta.todo").alias("n", "text")).select("site", F.lit(0).alias("turn"), F.col("n").cast("string").alias("k"), "text")
    blocked = social.where("status <> 'ok'").select("site", F.lit(1).alias("turn"), F.concat("label", "url").alias("k"), F.concat(F.lit("Ask for the content of "), "label", F.lit(" ("), "url", F.lit(").")).alias("text"))
    todo = own.unionByName(blocked).select("site", F.lit("todo").alias("part"), order("turn", F.length("k"), "k").alias("ord"), "text")
    return copy.unionByName(gaps).unionByName(network).unionByName(todo)


def save_harvest(facts: DataFrame, drafts: DataFrame, folder: str, buckets: int = 256) -> None:
    """The harvest and the drafts as JSON, in at most so many folders by a hash of the site; a rerun replaces its own sites only.

    Buckets that the new sites fall into are written anew, with what the other sites in them had; all others stay as they are.
    """
    for df, name in ((facts, "raw"), (drafts, "draft")):
        path = f"{folder}/{name}"
        new = df.withColumn("bucket", F.pmod(F.xxhash64("site"), F.lit(buckets)).cast("int"))
        touched = [r.bucket for r in new.select("bucket").distinct().collect()]  # at most `buckets`
        if _exists(df.sparkSession, path):
            old = df.sparkSession.read.schema(new.schema).json(path).where(F.col("bucket").isin(touched))
            new = written(new.unionByName(old.join(df.select("site"), "site", "left_anti")), "harvest")  # what is read is about to be replaced
        new.repartition(min(buckets, max(1, len(touched))), "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").json(path)


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(place)
