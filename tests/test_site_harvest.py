"""From pages to drafts: a small site with known facts, the plan's exchanges, and sites without facts."""

import re

import pytest

from siteloom.operators import profiles as P
from siteloom.operators import site_harvest as S
from siteloom.operators.nodes import node_table
from siteloom.operators.state import written

HOME = """<html><head><title>Acme Works | Home</title><meta name=description content="We fix it. All of it."><meta name=theme-color content="#1f3a93"><style>h1{color:#c41e3a;font-family:Lora}</style>
<script type="application/ld+json">{"@type":"Plumber","name":"Acme Plumbing","telephone":"555","sameAs":["https://yelp.com/acme"],"geo":{"latitude":1.5,"longitude":2},"areaServed":["Town"],"openingHours":"Mo-Fr 09:00-17:00"}</script>
<script type="application/ld+json">{"@type":"Service","name":"Drains","description":"Stated drains"}</script></head><body><header><img src=/logo-x.png alt=Acme></header><main>
<h1>WELCOME HOME</h1><p>We have been fixing pipes in this town for many years now.</p><img src=/wide.jpg width=700><h2>Our services</h2><div class=grid><div class=card><h3>Drains</h3><p>We clean all drains in town.</p></div>
<div class=card><h3>Pipes</h3><p>We repair all the pipes there.</p></div><div class=card><h3>Boilers</h3><p>We service boilers every year.</p></div></div></main><a href="https://facebook.com/acme">f</a></body></html>"""
CONTACT = """<html><head><title>Contact</title></head><body><main><a href="tel:2175550142">(217) 555-0142</a> <a href="mailto:a@acme.org">m</a><address>12 Main Street, Springfield, IL 62701</address></main></body></html>"""


@pytest.fixture(scope="module")
def harvest(spark):
    rows = [("acme.org", 1, "https://www.acme.org/", HOME), ("acme.org", 2, "https://www.acme.org/contact", CONTACT), ("b.org", 3, "https://b.org/x", "<p>nothing</p>"), ("c.org", 4, "https://c.org/", None)]
    pages = spark.createDataFrame(rows, "site string, page_id bigint, url string, html string")
    social = spark.createDataFrame([("acme.org", "facebook", "Facebook", "https://facebook.com/acme", "login-walled")], "site string, network string, label string, url string, status string")
    return S.site_facts(written(S.page_facts(pages, node_table(pages), social=social), "page-facts"))


def test_facts_of_a_site(harvest):
    from siteloom.operators.harvest import draft_profiles

    rows = written(S.site_harvest(harvest), "harvest")
    got = {r.site: r for r in rows.collect()}
    a = got["acme.org"]
    assert (a.pages, a.slug, a.phones, a.emails, a.address.city, a.logo, a.hero) == (2, "acme", ["(217) 555-0142"], ["a@acme.org"], "Springfield", "https://www.acme.org/logo-x.png", "https://www.acme.org/wide.jpg")
    assert [(s.name, s.summary) for s in a.services] == [("Drains", "Stated drains"), ("Pipes", "We repair all the pipes there."), ("Boilers", "We service boilers every year.")]
    assert a.social == {"facebook": "https://facebook.com/acme", "yelp": "https://yelp.com/acme"} and [h.day for h in a.hours] == [0, 1, 2, 3, 4] and a.social_sources == ["Facebook: login-walled"]
    assert (a.colours.primary, a.colours.secondary, a.fonts.heading) == ("#1f3a93", "#c41e3a", "Lora")
    assert got["b.org"].pages == got["c.org"].pages == 1 and got["b.org"].services == [] and got["c.org"].phones == []
    drafts = written(draft_profiles(rows), "drafts")
    d = {r.site: r for r in drafts.collect()}
    assert (d["acme.org"].business.name, d["acme.org"].content.hero.headline, d["acme.org"].business.serviceArea, d["acme.org"].contact.geo.lat) == ("Acme Plumbing", "Welcome Home", ["Town"], 1.5)
    assert d["b.org"].business.name == "B" and len(d["acme.org"].meta.gaps) == 1
    assert {r.code for r in P.profile_validate(drafts).where("site = 'acme.org'").collect()} == {"description", "no_testimonials"}


def test_merging_needs_no_exchange(harvest):
    plan = S.site_harvest(harvest)._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and not re.search(r"\bExchange ", plan)


def test_no_pages(spark):
    pages = spark.createDataFrame([], "site string, page_id bigint, url string, html string")
    assert S.site_harvest(S.site_facts(written(S.page_facts(pages, node_table(pages)), "page-facts"))).count() == 0
