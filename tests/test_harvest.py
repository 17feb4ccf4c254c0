"""Addresses, hours, images, structured data, profiles, social pages and reach: known cases and brute force."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from siteloom.functions import colour as C
from siteloom.operators import contacts as K
from siteloom.operators import harvest as V
from siteloom.operators import jsonld as J
from siteloom.operators import media as M
from siteloom.operators import normalize as N
from siteloom.operators import pages as P
from siteloom.operators import places as A
from siteloom.operators.nodes import html_nodes
from siteloom.sources import social as S

PLACEHOLDER = "data:image/svg+xml,%3Csvg%20xmlns%3D%22http%3A%2F%2Fwww.w3.org%2F2000%2Fsvg%22%3E%3C%2Fsvg%3E"
HTML = {
    1: """<body><a href="tel:+12175550142">(217) 555-0142</a><a href="mailto:x@y.com">mail</a><p>Serving since 1987. Fax: 217 555 0143.</p>
        <div class="hours">Mon - Fri: 7:00am - 5:30pm<br>Saturday: 8am - 12pm<br>Sunday: Closed</div></body>""",
    2: "<body><footer>Call us Address Bourne Enterprise Centre, Wrotham Rd, Borough Green, Sevenoaks TN15 8DG</footer></body>",
    3: "<body><address>1 Main St, Springfield, IL 62701</address></body>",
    4: "<body><p>?ver=bd3d6ba style=e433be</p></body>",
    5: "<body><address>1425 North Grand Avenue East, Suite B, Springfield, IL 62702</address></body>",
    6: f"""<body><img class="lazy" src="{PLACEHOLDER}" data-src="/wp-content/uploads/logo.jpg" alt="Acme" id="logo" width="300" height="120">
        <img src="{PLACEHOLDER}" data-srcset="/uploads/wide-400.jpg 400w, /uploads/wide-1200.jpg 1200w" alt="Workshop"><img src="/uploads/plain.jpg" alt="Plain"></body>""",
    7: """<script type="application/ld+json">{"@type": "HVACBusiness", "name": "X", "telephone": "555", "address": {"@type": "PostalAddress", "addressLocality": "Springfield"},
        "openingHoursSpecification": [{"dayOfWeek": ["Monday"], "opens": "08:00", "closes": "17:00"}]}</script>""",
}


@pytest.fixture(scope="module")
def site(spark):
    pages = spark.createDataFrame([("e.com", i, "https://example.com/", h) for i, h in HTML.items()], "site string, page_id bigint, url string, html string")
    return pages, html_nodes(pages).cache()


def test_contacts_and_hours(site):
    nodes = site[1]
    phones = K.phones(nodes).where("page_id = 1").orderBy("ord").collect()
    assert phones[0].confidence == "high" and not any("0143" in p.value for p in phones)
    assert [r.value for r in K.emails(nodes).where("page_id = 1").collect()] == ["x@y.com"]
    hours = {r.day: r for r in A.page_hours(nodes).collect()}
    assert len(hours) == 7 and hours[6].closed and (hours[0].opens, hours[0].closes, hours[5].closes) == ("7:00 AM", "5:30 PM", "12:00 PM")
    assert {r.confidence for r in hours.values()} == {"medium"}


def test_addresses(site):
    got = {r.page_id: r for r in A.page_address(site[1]).collect()}
    assert set(got) == {2, 3, 5}
    assert (got[2].street, got[2].city, got[2].postal_code, got[2].country) == ("Bourne Enterprise Centre, Wrotham Rd, Borough Green", "Sevenoaks", "TN15 8DG", "GB")
    assert (got[3].country, got[3].region) == ("US", "IL")
    assert tuple(got[5])[2:] == ("1425 North Grand Avenue East", "Suite B", "Springfield", "IL", "62702", "US", "medium")


def test_lazy_images(site):
    images = {r.url: r.role for r in M.page_images(*site).where("page_id = 6").collect()}
    assert images == {"https://example.com/wp-content/uploads/logo.jpg": "logo", "https://example.com/uploads/wide-1200.jpg": "gallery", "https://example.com/uploads/plain.jpg": "content"}


def test_structured_business(site):
    found = J.jsonld_nodes(site[1])
    row = J.jsonld_profile(found).first()
    assert (row.name, row.city) == ("X", "Springfield") and J.jsonld_hours(found).first().opens == "8:00 AM"


def test_patches_of_two_pages(spark):
    """A later page's empty text overwrites, its missing fields don't, and its lists replace the others."""
    one = '<script type="application/ld+json">[{"@type": "Dentist", "name": "A", "email": "a@b.c", "telephone": "1"}, {"@type": "Service", "name": "S"}]</script>'
    two = '<script type="application/ld+json">{"@type": "Dentist", "name": "B", "email": ""}</script>'
    pages = spark.createDataFrame([("s", 1, one), ("s", 2, two), ("s", 3, "<p>none</p>")], "site string, page_id bigint, html string")
    found = J.jsonld_nodes(html_nodes(pages)).cache()
    leaves, lists = J.patch_merge(J.jsonld_profile(found), J.jsonld_children(found))
    row = leaves.first()
    assert (row.name, row.email) == ("B", "") and lists.count() == 0


def test_messy_profile(spark):
    row = spark.range(1).select(
        F.lit("s").alias("site"), F.struct(F.lit("  Joe's   HVAC ").alias("name"), F.array(F.lit("Springfield"), F.lit("springfield")).alias("serviceArea")).alias("business"),
        F.struct(F.lit("555.867.5309").alias("phone"), F.array(F.lit("A@B.com"), F.lit("a@b.com")).alias("emails")).alias("contact"),
        F.array(F.struct(F.lit("AC REPAIR").alias("name"), F.lit(None).cast("string").alias("title")), F.struct(F.lit(None).cast("string").alias("name"), F.lit("Furnace").alias("title"))).alias("services"),
        F.struct(F.struct(F.lit("rgb(37,99,235)").alias("primary")).alias("colors")).alias("brand"))
    p = N.normalize_profiles(row).first()
    assert (p.business.name, p.business.serviceArea, p.contact.emails) == ("Joe's HVAC", ["Springfield"], ["a@b.com"])
    assert [(s.slug, s.name) for s in p.services] == [("ac-repair", "AC Repair"), ("furnace", "Furnace")] and p.brand.colors.primary == "#2563eb"
    assert p.testimonials == [] and p.contact.hours == [] and p.social == {}
    empty = N.normalize_profiles(spark.createDataFrame([("s",)], "site string")).first()
    assert empty.business.name == "" and empty.services == [] and empty.seo.title == ""


@pytest.mark.parametrize(("given", "want"), [
    ("#abc", "#aabbcc"), ("#ABCD", "#aabbcc"), ("#12345678", "#123456"), ("Navy", "#000080"), ("hsl(0, 100%, 50%)", "#ff0000"), ("hsla(240,100%,50%,.5)", "#0000ff"), ("rgb(300 0 16 / 50%)", "#ff0010"), ("transparent", None), ("#12345", None), ("rgb(a,b,c)", None), (None, None),
])
def test_colours(spark, given, want):
    assert spark.range(1).select(C.colour_parse(F.lit(given).cast("string"))).first()[0] == want


def test_social_pages(spark):
    rows = [
        ("s", "facebook", "u1", None, "<meta property='og:title' content='Acme'><meta property='og:description' content='1.2K followers, rated 4.8'>"), ("s", "instagram", "u2", None, "<title>Log in</title>"), ("s", "x", "u3", "HTTP 500", None),
    ]
    got = {r.network: r for r in S.social_status(spark.createDataFrame(rows, "site string, network string, url string, error string, html string")).collect()}
    assert {n: r.status for n, r in got.items()} == {"facebook": "ok", "instagram": "login-walled", "x": "unreachable"}
    assert (got["facebook"].followers, got["facebook"].rating) == ("1.2K", "4.8")


def reach(start, links, budget):
    """Rounds over plain sets: all new targets of a round, by kind (all pages here score alike by depth), then address, while the budget lasts."""
    seen, last, hop = {start: 0}, {start}, 0
    while last:
        hop += 1
        found = sorted({t for a, t in links if a in last} - set(seen))
        last = set(found[: budget - len(seen)])
        seen |= dict.fromkeys(last, hop)
    return seen


def test_crawl_reach(spark):
    """A chain as long as the budget, a graph that is cut within a round, and one that ends early."""
    rng = random.Random(5)
    graphs = {
        "chain.org": [(f"https://chain.org/p{i:03}", f"https://chain.org/p{i + 1:03}") for i in range(60)],
        "wide.org": [(f"https://wide.org/p{rng.randrange(40):03}", f"https://wide.org/p{rng.randrange(40):03}") for _ in range(90)] + [("https://wide.org/p000", "https://wide.org/p001")],
        "small.org": [("https://small.org/p000", "https://small.org/p001"), ("https://small.org/p001", "https://small.org/p000")],
    }
    from siteloom.operators.state import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    links = spark.createDataFrame([(s, a, b) for s, pairs in graphs.items() for a, b in set(pairs)], "site string, url string, target string")
    start = spark.createDataFrame([(s, f"https://{s}/p000") for s in graphs], "site string, url string")
    got = collections.defaultdict(dict)
    for r in P.crawl_reach(start, links, 20).collect():
        got[r.site][r.url] = r.hops
    assert dict(got) == {s: reach(f"https://{s}/p000", pairs, 20) for s, pairs in graphs.items()}
    assert len(got["chain.org"]) == 20 and max(got["chain.org"].values()) == 19


def test_saved_harvest(spark, tmp_path):
    facts = spark.createDataFrame([("a", 1), ("b", 2)], "site string, n int")
    V.save_harvest(facts, facts, str(tmp_path))
    V.save_harvest(facts, facts, str(tmp_path))
    assert sorted((r.site, r.n) for r in spark.read.json(f"{tmp_path}/raw").collect()) == [("a", 1), ("b", 2)]
