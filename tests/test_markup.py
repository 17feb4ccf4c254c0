"""The node table and what is read from it, on small pages."""

import pytest
from pyspark.sql import functions as F

from siteloom.functions import colour as C
from siteloom.functions import text as T
from siteloom.functions import url as U
from siteloom.operators import contacts as K
from siteloom.operators import monitor as M
from siteloom.operators import pages as P
from siteloom.operators import seo as S
from siteloom.operators.nodes import html_nodes, parse
from siteloom.sources.pages import robots_allowed, robots_rules, with_site


def texts(html, tag):
    return [n[8] for n in parse(html) if n[5] == tag]


def test_malformed_markup():
    html = "<ul><li>One<li>Two</ul><p>First<p class=x>Second<script>var a='<p>';</script>"
    assert texts(html, "li") == ["One", "Two"]
    assert texts(html, "p") == ["First", "Second"]


def test_blocks_are_apart_and_breaks_are_not():
    assert texts("<body>a<div>b</div>c<br>d<i>e</i><div></div>f</body>", "body") == ["a b cdef"]


def test_entities_and_intervals():
    nodes = parse("<div title='&lt;x&gt;'>&#65;&copy;<span>&nbsp;y</span></div>")
    assert nodes[0][6] == {"title": "<x>"} and nodes[0][8] == "A© y" and nodes[0][2] == 1 and nodes[1][1] == 0


@pytest.mark.parametrize(("href", "want"), [
    ("/a b", "https://h.org/a%20b"), ("c?x=1#f", "https://h.org/d/c?x=1"), ("../e", "https://h.org/e"), ("//o.org/x", "https://o.org/x"), ("#top", None), ("mailto:a@b.c", None), ("HTTPS://O.org/P", "https://o.org/P"),
])
def test_absolute(spark, href, want):
    assert spark.range(1).select(U.absolute(F.lit(href), F.lit("https://h.org/d/page.html"))).first()[0] == want


@pytest.mark.parametrize(("given", "want"), [
    ("HVAC REPAIR AND INSTALL", "HVAC Repair and Install"), ("hvac repair", "HVAC repair"), ("O'BRIEN MCDONALD LLC", "O'Brien McDonald LLC"), ("About Us", "About Us"), ("", ""),
])
def test_headings(spark, given, want):
    assert spark.range(1).select(T.humanize_heading(F.lit(given))).first()[0] == want


def test_slug_and_colour(spark):
    row = spark.range(1).select(T.slug(F.lit("Crème & Brûlée!")), T.slug(F.lit("??")), F.round(C.contrast(F.lit("#000000"), F.lit("#ffffff")), 2), C.colour_parse(F.lit("rgb(255, 0 16)"))).first()
    assert list(row) == ["creme-and-brulee", "item", 21.0, "#ff0010"]


PAGES = [
    (0, "https://www.acme.org/", "<title>Acme</title><body><nav><a href='/about/'>About</a></nav><main><h1>WELCOME HOME</h1><p>Call us today for all of your heating and cooling needs.</p></main>"
        "<footer>Fax: (217) 555-0143 Tel (217) 555-0142, invoice 217-555-0199 mail@acme.org x@example.com</footer></body>"),
    (1, "https://acme.org/about", "<title>Acme</title><body><h1>About</h1><table><tr><td>x</td></tr></table><img src=a.png alt=''><img src=b.png></body>"),
    (2, "https://acme.org/old", None),
]


@pytest.fixture(scope="module")
def site(spark):
    pages = with_site(spark.createDataFrame(PAGES, "page_id bigint, url string, html string"))
    return pages, html_nodes(pages).cache()


def test_page_facts(site):
    pages, nodes = site
    assert [(r.page_id, r.text) for r in P.page_headings(nodes).collect()] == [(0, "Welcome Home")]
    audit = {r.page_id: r for r in P.page_audit(pages, nodes).collect()}
    assert (audit[1].images, audit[1].images_no_alt, audit[1].layout_tables) == (2, 2, 1)
    assert audit[2].words == 0 and not audit[2].has_viewport
    facts = S.seo_facts(pages, nodes).cache()
    assert {r.page_id: r.no_alt for r in facts.collect()}[1] == 1
    assert [r.pages for r in S.shared_values(facts, "title").collect()] == [2, 2]
    assert sorted(r.page_id for r in S.orphans(facts).collect()) == [1, 2]


def test_contacts(site):
    _, nodes = site
    assert [r.value for r in K.phones(nodes).collect()] == ["(217) 555-0142"]
    assert [r.value for r in K.emails(nodes).collect()] == ["mail@acme.org"]


def test_robots(spark):
    text = "User-agent: *\nDisallow: /private # no\nAllow: /private/open$\nDisallow: /*.pdf\n\nUser-agent: other\nDisallow: /"
    rules = robots_rules(spark.createDataFrame([("h.org", text)], "site string, text string"))
    urls = spark.createDataFrame([("h.org", f"https://h.org{p}") for p in ("/private/x", "/private/open", "/a.pdf", "/b")], "site string, url string")
    got = {r.url.removeprefix("https://h.org"): r.allowed for r in robots_allowed(urls, rules).collect()}
    assert got == {"/private/x": False, "/private/open": True, "/a.pdf": False, "/b": True}


def test_scan_golden(spark):
    """Two runs of three sites: pages up by one, a wide spread, two scores short of 100 and nothing else."""
    import datetime as dt

    one, two = dt.datetime(2026, 9, 15), dt.datetime(2026, 9, 22)
    base = dict(status=200, cert_days=60, cert_expires=dt.date(2026, 12, 1), dns=["1.2.3.4"], samples=5, runs=5, accessibility=100, best_practices=100, seo=100)
    rows = [dict(domain=d, run_ts=t, pages=10 + (d == "a" and t == two), performance=p, spread=s if t == two else 2, **base) for d, p, s in (("a", 97, 8), ("b", 99, 2), ("c", 100, 2)) for t in (one, two)]
    schema = "domain string, run_ts timestamp, pages int, performance int, spread int, status int, cert_days int, cert_expires date, dns array<string>, samples int, runs int, accessibility int, best_practices int, seo int"
    df = spark.createDataFrame([tuple(r[c.split()[0]] for c in schema.split(", ")) for r in rows], schema)
    found = M.scan_issues(df).where(F.col("run_ts") == F.lit(two)).collect()
    assert [r.level for r in found] == ["note"] * 4


def test_partitions_and_other_sites_change_nothing(spark, site):
    pages, _ = site
    more = pages.unionByName(pages.withColumn("site", F.lit("other.org")))
    alone = sorted(map(str, P.audit_flags(P.page_audit(pages, html_nodes(pages))).collect()))
    mixed = html_nodes(more.repartition(5))
    assert sorted(map(str, P.audit_flags(P.page_audit(more, mixed)).where("site = 'acme.org'").collect())) == alone
