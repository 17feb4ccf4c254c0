"""Repeated blocks, services, testimonials, questions, people and images on a small page."""

import pytest

from pyspark.sql import functions as F

from siteloom.functions import text as T
from siteloom.operators import contacts as K
from siteloom.operators import content as X
from siteloom.operators import media as M
from siteloom.operators.nodes import html_nodes

HTML = """<body><main><h2>Our Services</h2><div class="grid">
<div class="card"><h3>Furnace repair</h3><p>We fix furnaces of all makes.</p></div><div class="card"><h3>AC tune-up</h3><p>Keep cool all summer long.</p></div>
<div class="card"><h3>Duct cleaning</h3><p>Clean air for the whole house.</p></div></div>
<h2>Meet the team</h2><ul><li><b>Ann Lee</b><p>Owner</p></li><li><b>Bob Ray</b><p>Technician</p></li><li><b>Cy Poe</b><p>Office manager here</p></li></ul>
<h3>Do you offer financing?</h3><p>Yes, on approved credit for larger jobs.</p>
<blockquote>They came out the same day and fixed everything. <cite>— Ann</cite></blockquote>
<dl><dt>Service area</dt><dd>Springfield and around.</dd></dl><img src="data:x" data-src="/a.jpg" alt="A"><a href="mailto:service@x.org">service</a></main></body>"""


@pytest.fixture(scope="module")
def site(spark):
    pages = spark.createDataFrame([("s", 1, "https://s.org/", HTML)], "site string, page_id bigint, url string, html string")
    return pages, html_nodes(pages).cache()


def test_services(site):
    got = X.page_services(site[1]).orderBy("ord").collect()
    assert [(r.name, r.summary) for r in got] == [("Furnace repair", "We fix furnaces of all makes."), ("AC tune-up", "Keep cool all summer long."), ("Duct cleaning", "Clean air for the whole house.")]


def test_team(site):
    assert [(r.name, r.role) for r in X.page_team(site[1]).orderBy("ord").collect()] == [("Ann Lee", "Owner"), ("Bob Ray", "Technician"), ("Cy Poe", "Office manager here")]


def test_questions_quotes_and_images(site):
    pages, nodes = site
    assert [r.question for r in X.page_faqs(nodes).orderBy("ord").collect()] == ["Service area", "Do you offer financing?"]
    assert [(r.quote, r.author) for r in X.page_testimonials(nodes).collect()] == [("They came out the same day and fixed everything.", "Ann")]
    assert [(r.url, r.alt) for r in M.page_images(pages, nodes).collect()] == [("https://s.org/a.jpg", "A")]


def test_words_end_at_letters_beyond_ascii(spark):
    """A letter beyond ASCII is no part of a word to browsers: what follows it can be the word that makes a number no phone, or end one."""
    rows = spark.createDataFrame([(1, "für äein +1 (685) 555-8379"), (2, "beein +1 (685) 555-8379"), (3, "ruf 685-555-8379ä an"), (4, "äfax 685-555-8379")], "doc_id bigint, text string")
    assert sorted((r.doc_id, r.value) for r in K.phones_text(rows, ["doc_id"], F.col("text")).collect()) == [(2, "+1 (685) 555-8379"), (3, "685-555-8379")]


def test_a_capital_is_one_letter(spark):
    rows = spark.createDataFrame([("ßieung und",), ("über uns",)], "t string")
    assert [r.h for r in rows.select(T.humanize_heading(F.col("t")).alias("h")).collect()] == ["ßieung und", "Über uns"]


def test_questions_of_long_pages(spark):
    """What tells a page of questions may stand after thousands of characters, in any element that holds the main content; a long sibling is no answer, and the one after it neither."""
    long, asked = "<p>" + "word " * 2000 + "</p>", "<h2>Why us?</h2><p>We are good at it.</p>"
    holds = ["<main>{}</main>", "<div id=content>{}</div>", "<div role=main>{}</div>", "<div class='x entry-content'>{}</div>", "<body>{}</body>"]
    pages = [h.format(asked + long + end) for h in holds for end in ("<p>See our FAQ</p>", "<p>No such page</p>")] + ["<div><i></i>" + asked + long + "<p>FAQs</p></div>"]
    pages += ["<main><h3>Is it long?</h3><div>" + "word " * 2000 + "</div><p>Not an answer.</p></main>", "<main><h3>Is it far?</h3><div>It is " + " \n" * 5000 + "not far.</div></main>", "<main><details><summary>Is it wide?</summary>No, " + "\t" * 9000 + "it is not.</details></main>"]
    nodes = html_nodes(spark.createDataFrame([("s", i, f"<html>{p}</html>") for i, p in enumerate(pages)], "site string, page_id bigint, html string"))
    got = {r.page_id: (r.question, r.answer) for r in X.page_faqs(nodes).collect()}
    why = ("Why us?", "We are good at it.")
    assert got == {i: why for i in range(0, 10, 2)} | {10: why, 12: ("Is it far?", "It is not far."), 13: ("Is it wide?", "No, it is not.")}
