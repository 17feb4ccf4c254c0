"""Joins on the structure of pages against plain loops, and pages of many nodes."""

import random
import time

import pytest
from pyspark.sql import functions as F

from siteloom.operators import content as X
from siteloom.operators import pages as P
from siteloom.operators.intervals import covered, enclosing
from siteloom.operators.nodes import html_nodes, node_table, parse

PAGE = "site string, page_id bigint"


def tree(rng, n):
    """(node_id, last_id, parent_id) of a random tree in document order."""
    parent, open_ = [-1], [0]
    for i in range(1, n):
        while len(open_) > 1 and rng.random() < 0.4:
            open_.pop()
        parent.append(open_[-1])
        open_.append(i)
    last = list(range(n))
    for i in range(n - 1, 0, -1):
        last[parent[i]] = max(last[parent[i]], last[i])
    return list(zip(range(n), last, parent))


@pytest.fixture(scope="module")
def trees():
    rng = random.Random(3)
    return [(f"s{i % 2}", i, *row, rng.random() < 0.3, rng.random() < 0.4) for i in range(12) for row in tree(rng, rng.randint(1, 60))]


@pytest.mark.parametrize("strict", [False, True])
def test_enclosing(spark, trees, strict):
    nodes = spark.createDataFrame(trees, f"{PAGE}, node_id int, last_id int, parent_id int, outer boolean, inner boolean")
    outer = nodes.where("outer").select("site", "page_id", F.col("node_id").alias("o_id"), F.col("last_id").alias("o_last"), F.lit("x").alias("name"))
    outer = outer.unionByName(outer.withColumn("name", F.lit("y")))  # two intervals in one place
    got = sorted((r.page_id, r.node_id, r.o_id, r.name, r.mark) for r in enclosing(nodes.where("inner").select("site", "page_id", "node_id", (F.col("node_id") * 2).alias("mark")), outer, strict).collect())
    want = sorted((p, n, o, name, 2 * n) for _, p, n, _, _, _, inner in trees if inner for _, q, o, last, _, is_outer, _ in trees if is_outer and p == q and o <= n <= last and not (strict and o == n) for name in "xy")
    assert got == want and got
    flags = {(r.page_id, r.node_id): r.c for r in nodes.select("page_id", "node_id", covered(F.col("outer"), strict).alias("c")).collect()}
    assert flags == {(p, n): any(is_outer and p == q and o <= n <= last and not (strict and o == n) for _, q, o, last, _, is_outer, _ in trees) for _, p, n, *_ in trees}


def label(rows, at):
    """The nearest heading before a node among its siblings: of the nearest one that is a heading or holds an h1, else an h2, else an h3."""
    by_id = {r.node_id: r for r in rows}
    for sib in sorted((r for r in rows if r.parent_id == by_id[at].parent_id and r.node_id < at), key=lambda r: -r.node_id):
        if sib.tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            return sib.text
        inner = [r for r in rows if sib.node_id < r.node_id <= sib.last_id and r.tag in ("h1", "h2", "h3")]
        if inner:
            return min(inner, key=lambda r: (r.tag, r.node_id)).text
    return None


def test_labels(spark):
    rng = random.Random(9)

    def part(depth):
        kids = "".join(part(depth - 1) for _ in range(rng.randint(0, 4))) if depth else "text of some length"
        tag = rng.choice(["div", "div", "ul", "h1", "h2", "h3", "h5", "p"]) if depth else rng.choice(["h2", "h4", "li", "p", "h3", "h1"])
        return f"<{tag} class=c{rng.randint(0, 2)}>{rng.random():.3f} {kids}</{tag}>" if tag not in ("p", "h1", "h2", "h3", "h4", "h5") else f"<{tag}>{rng.random():.6f} long enough</{tag}>"

    pages = spark.createDataFrame([("s", i, "<body>" + "".join(part(4) for _ in range(6)) + "</body>") for i in range(15)], f"{PAGE}, html string")
    nodes = html_nodes(pages).cache()
    blocks = nodes.where("tag in ('div', 'ul')").select("site", "page_id", F.col("node_id").alias("block_id"), "parent_id", F.lit(1).alias("kept"))
    rows = {}
    for r in nodes.collect():
        rows.setdefault(r.page_id, []).append(r)
    got = {(r.page_id, r.block_id): r.label for r in X.block_labels(blocks, nodes).collect()}
    want = {}
    for b in blocks.collect():
        page = rows[b.page_id]
        found = label(page, b.block_id)
        if found is None and b.parent_id is not None and b.parent_id >= 0:
            found = label(page, b.parent_id)
        want[b.page_id, b.block_id] = (found or "").lower()
    assert got == want and sum(x != "" for x in want.values()) > 20


def test_labels_need_no_join_of_siblings(spark):
    nodes = html_nodes(spark.createDataFrame([("s", 1, "<body><h2>x</h2><div>y</div></body>")], f"{PAGE}, html string"))
    blocks = nodes.select("site", "page_id", F.col("node_id").alias("block_id"), "parent_id")
    plan = X.block_labels(blocks, nodes)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert len(joins) == 2 and all("block_id" in j or "parent_id" in j for j in joins)


def test_page_of_many_nodes(spark):
    """Fifty thousand nodes: cards in nested boxes, questions, quotes and tables."""
    card = "<div class=card><h3>Repair {0}</h3><p>We repair all that breaks, number {0}.</p><blockquote>They came out the same day, all {0} of them. <cite>Ann {0}</cite></blockquote><h4>Is it {0}?</h4><p>Yes, it is that many.</p></div>"
    html = "<body><main><h2>Our services</h2><div class=grid>" + "".join(card.format(i) for i in range(7400)) + "</div><table><tr><td>x</td></tr></table></main></body>"
    pages = spark.createDataFrame([("s", 1, "https://s.org/", html)], f"{PAGE}, url string, html string")
    nodes = html_nodes(pages).cache()
    assert nodes.count() > 50_000
    began = time.monotonic()
    assert X.page_services(nodes).count() == 24 and X.page_testimonials(nodes).count() == 30 and X.page_faqs(nodes).count() == 25
    assert P.page_audit(pages, nodes).first().layout_tables == 1 and P.page_paragraphs(nodes, 3).count() > 10_000
    assert time.monotonic() - began < 240  # seconds on a machine of its own; loops over pairs would take hours


def test_services_and_team_keep_the_driver_small(spark):
    """Tables that are written compress so well that a plan would send them to all tasks by way of the driver; what is shared is planned once."""
    pages = spark.createDataFrame([("s", 1, "<body><main><h2>Our services</h2><div>" + "<p>All that we mend here</p>" * 3 + "</div></main></body>")], f"{PAGE}, html string")
    nodes = node_table(pages)
    for found in (X.page_services(nodes), X.page_team(nodes)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan and len(plan) < 100_000


def test_parser_streams_and_skips_runs_of_comments(spark):
    """Pages without markup between others, and a run of comments, which is one step."""
    html = "<body>" + "<!-- -->" * 60_000 + "".join(f"<i a={i}>x</i>" for i in range(3000)) + "</body>"
    began = time.monotonic()
    assert len(parse(html)) == 3001 and time.monotonic() - began < 5
    pages = spark.createDataFrame([("s", i, html if i % 2 else None) for i in range(6)], f"{PAGE}, html string").coalesce(1)
    got = html_nodes(pages).groupBy("page_id").agg(F.count("*").alias("n")).collect()
    assert {(r.page_id, r["n"]) for r in got} == {(1, 3001), (3, 3001), (5, 3001)}
