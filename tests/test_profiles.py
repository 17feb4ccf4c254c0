"""Page plans, validation, display forms, robots groups and stored harvests: known cases."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from siteloom.functions import colour as C
from siteloom.operators import contacts as K
from siteloom.operators import harvest as V
from siteloom.operators import monitor as M
from siteloom.operators import normalize as N
from siteloom.operators import palettes as L
from siteloom.operators import profiles as P
from siteloom.plans import profile_queries as Q
from siteloom.sources import pages as G
from siteloom.streaming.jobs import stream_new_pages


def normalised(spark, **parts):
    return N.normalize_profiles(spark.createDataFrame([("s.org", json.dumps(parts))], "site string, profile string")).cache()


def test_plan_of_services_without_summary(spark):
    p = normalised(spark, business={"name": "Acme"}, services=[{"name": "A", "summary": "a"}, {"name": "B", "description": ["b"]}, {"name": "C"}])
    assert [r.url for r in P.page_plan(p).orderBy("ord").collect()] == ["", "services/", "services/a/", "services/b/", "services/c/", "contact/", "404.html"]
    one = normalised(spark, business={"name": "Acme"}, services=[{"name": "A", "summary": "a"}, {"name": "C"}])
    assert [r.url for r in P.page_plan(one).orderBy("ord").collect()] == ["", "services/", "contact/", "404.html"]


def test_plan_of_a_full_profile(spark):
    p = normalised(
        spark, business={"name": "Acme"}, services=[{"name": "A", "summary": "a"}, {"name": "B", "summary": "b"}], gallery=["1.jpg", "2.jpg", "3.jpg"], team={"name": "Bo"}, caseStudies=[{"client": "C"}], legal=[{"title": "Privacy", "sections": [{"body": "x"}]}], faqs=[{"q": "Q?", "a": "A"}])
    plan = {r.slug: r for r in P.page_plan(p).collect()}
    assert list(plan) == ["home", "about", "services", "service-a", "service-b", "work", "gallery", "contact", "privacy", "404"]
    assert plan["about"].path == "/about/" and [s.type for s in plan["about"].sections] == ["pageHeader", "team", "cta"]
    assert (plan["service-a"].parent, plan["service-a"].nav, plan["404"].noindex) == ("services", False, True)
    graphs = {r.path: {x["@type"]: x for x in json.loads(r.jsonld)["@graph"]} for r in P.jsonld_export(p).collect()}
    assert set(graphs["/"]) == {"LocalBusiness", "WebSite", "FAQPage"} and "FAQPage" in graphs["/services/"] and "FAQPage" not in graphs["/contact/"]
    assert [x["item"] for x in graphs["/services/a/"]["BreadcrumbList"]["itemListElement"]] == ["https://s.org/", "https://s.org/services/", "https://s.org/services/a/"]
    assert graphs["/services/a/"]["Service"]["provider"] == {"@id": "https://s.org/#business"} and "BreadcrumbList" not in graphs["/404.html"]


def test_validation_follows_normalisation(spark):
    codes = {r.code for r in P.profile_validate(normalised(spark, business={"name": "A"}, site={"form": {"provider": "other"}})).collect()}
    assert "form" in codes and "version" not in codes
    old = normalised(spark).withColumn("version", F.lit("profile/0"))
    assert [r.what for r in P.profile_validate(old).where("code = 'version'").collect()] == ['Profile schema is "profile/0", expected "profile/1".']


@pytest.mark.parametrize(("given", "want"), [
    ("+65 6123 4567", "+65 6123 4567"), ("1555123456", "1555123456"), ("217.555.0142", "(217) 555-0142"), ("+1 217 555 0142", "(217) 555-0142"), ("12175550142", "(217) 555-0142"), ("  ", ""), (None, ""),
])
def test_format_phone(spark, given, want):
    assert spark.range(1).select(K.format_phone(F.lit(given).cast("string"))).first()[0] == want


@pytest.mark.parametrize(("text", "want"), [
    ("User-agent: *\nCrawl-delay: 5\nUser-agent: badbot\nDisallow: /x", [(False, "/x", 5.0)]),
    ("User-agent: *\nCrawl-delay: 2\nCrawl-delay: 1", [(None, None, 1.0)]),
    ("Disallow: /early\nUser-agent: *\nDisallow: /a\nUser-agent: own\nAllow: /b", [(False, "/a", None)]),
    ("User-agent: other\nDisallow: /\nUser-agent: siteloom\nUser-agent: x\nDisallow: /s", [(False, "/s", None)]),
])
def test_robots_groups(spark, text, want):
    rules = G.robots_rules(spark.createDataFrame([("s", text)], "site string, text string"))
    assert [(r.allow, r.path, r.crawl_delay) for r in rules.collect()] == want
    urls = spark.createDataFrame([("s", "https://s/x"), ("s", "https://s/q")], "site string, url string")
    assert {r.url: r.allowed for r in G.robots_allowed(urls, rules).collect()}["https://s/q"]


def test_sample_median_counts_values_first(spark):
    rows = [("a", 1, 5, 1.5), ("a", 1, 5, None), ("a", 1, 9, 2.5), ("a", 1, 7, 0.5), ("b", 1, None, None), ("c", 1, 3, 1.0)]
    df = spark.createDataFrame(rows, "d string, run int, v int, w double")
    out = M.sample_median(df, ["v", "w"], ["d", "run"], "v")
    assert {r.d: (r.v, r.w, r.samples, r.spread) for r in out.collect()} == {"a": (7, 1.5, 4, 4), "b": (None, None, 0, None), "c": (3, 1.0, 1, 0)}
    assert "collect" not in out._jdf.queryExecution().optimizedPlan().toString().lower()


def test_new_pages_are_never_forgotten(spark, tmp_path):
    """A page that comes back days later, one that arrives late, and a run that stops and starts again."""
    day = lambda d: dt.datetime(2026, 1, d)
    lots = [[("https://a.org/x", day(1)), ("https://a.org/x#f", day(1))], [("https://a.org/y", day(2))], [("https://a.org/x?utm_source=1", day(9)), ("https://a.org/z", day(1)), ("https://a.org/y/", day(20))]]
    folders = [str(tmp_path / n) for n in ("in", "seen", "state")]
    for lot in lots:
        spark.createDataFrame(lot, "url string, ts timestamp").coalesce(1).write.mode("append").parquet(folders[0])
        feed = spark.readStream.schema("url string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(folders[0])
        stream_new_pages(feed, "ts", folders[1], folders[2]).awaitTermination()  # each start goes on from the stored state
    got = [(r.canonical, r.ts) for r in spark.read.parquet(folders[1]).orderBy("canonical").collect()]
    assert got == [("https://a.org/x", day(1)), ("https://a.org/y", day(2)), ("https://a.org/z", day(1))]


def test_saved_harvest_replaces_its_own_sites_only(spark, tmp_path):
    rows = spark.range(50).select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("site"), F.lit(1).alias("n"))
    V.save_harvest(rows, rows, str(tmp_path), buckets=8)
    again = rows.where("site in ('s1', 's7')").withColumn("n", F.lit(2)).unionByName(spark.createDataFrame([("new", 3)], "site string, n int"))
    V.save_harvest(again, again, str(tmp_path), buckets=8)
    got = {r.site: r.n for r in spark.read.json(f"{tmp_path}/raw").collect()}
    assert got == {f"s{i}": 2 if i in (1, 7) else 1 for i in range(50)} | {"new": 3}
    assert len(list((tmp_path / "raw").glob("bucket=*/part-*"))) <= 8


def test_tones_and_brand_tokens(spark):
    row = spark.range(1).select(C.ramp(F.lit("#1f3a93")).alias("r"), C.mix(F.lit("#000000"), F.lit("#ffffff"), 0.16).alias("m"), C.is_neutral(F.lit("#808080")).alias("n"), C.ramp(F.lit(None).cast("string")).alias("none")).first()
    assert [t.tone for t in row.r] == [50, 100, 200, 300, 400, 500, 600, 700, 800, 900] and row.m == "#292929" and row.n and row.none is None
    brands = spark.createDataFrame([("own", "#ffff00", None), ("none", "?", None)], "site string, primary string, accent string")
    tokens = {(r.site, r.theme, r["mode"]): r for r in L.theme_tokens(brands, L.theme_palettes(spark)).collect()}
    assert len(tokens) == 28 and tokens["own", "forge", "light"].adjusted_from == "#ffff00" and tokens["own", "forge", "dark"].primary == "#ffff00"
    assert tokens["none", "meridian", "light"].primary == "#1d4ed8" and tokens["none", "meridian", "light"].on_primary == "#ffffff"


def test_parts_are_those_of_the_whole(spark):
    """What a query doesn't ask for isn't worked out; what it asks for is the same."""
    one = spark.sql("select 's' as site, struct('A' as name, array('Town', 'town') as serviceArea) as business, struct('217 555 0142' as phone) as contact, array(struct('JOB ONE' as name, 'x' as icon, 'Text' as summary)) as services")
    whole = N.normalize_profiles(one)
    some = N.normalize_profiles(one, ["contact.phone", "services.summary", "seo.title", "team"])
    assert some.columns == ["site", "contact", "services", "seo", "team"]
    assert some.schema["services"].dataType.elementType.names == ["slug", "name", "summary"] and some.schema["seo"].dataType.names == ["title"]
    a, b = whole.first(), some.first()
    assert (b.contact.phone, b.seo.title, b.team) == (a.contact.phone, a.seo.title, a.team) == ("217 555 0142", "A | Town", [])
    assert [(x.slug, x.name, x.summary) for x in b.services] == [(x.slug, x.name, x.summary) for x in a.services]
    graphs = [json.loads(r.jsonld) for r in P.jsonld_export(N.normalize_profiles(one, P.GRAPH_PARTS)).collect()]
    assert graphs == [json.loads(r.jsonld) for r in P.jsonld_export(whole).collect()]
    ordered = lambda x: all(map(ordered, x.values())) and list(x) == sorted(x) if isinstance(x, dict) else all(map(ordered, x)) if isinstance(x, list) else True
    assert all(ordered(g["@graph"]) for g in graphs)


def test_sections_of_all_pages_are_counted(spark, tmp_path):
    """Firm 11 has pages of three services; sections without a title, a limit or an exclusion count too."""
    spark.range(11, 13).selectExpr("id as c_custkey").write.parquet(f"{tmp_path}/customer.parquet")
    rows = Q.plan_sections(spark, str(tmp_path)).collect()
    service = {(r.type, r.title, r.intro, r.max_items, r.heading, r.exclude, r.n) for r in rows if r.slug == "service-job-2-of-11"}
    assert service == {("pageHeader", "Job 2 of 11", "Does 2", None, None, None, 1), ("serviceDetail", None, None, None, None, None, 1), ("services", None, None, 4, "Other services", "job-2-of-11", 1), ("cta", None, None, None, None, None, 1)}
    assert {r.slug for r in rows if r.slug.startswith("service-")} == {f"service-job-{i}-of-11" for i in (1, 2, 3)}
    planned = Q.page_plan(spark, str(tmp_path)).agg(F.sum(F.size(F.split("sections", " "))).alias("n")).first()["n"]
    assert sum(r.n for r in rows) == planned and {(r.type, r.n) for r in rows if r.slug == "404"} == {("notFound", 2), ("cta", 2)}
