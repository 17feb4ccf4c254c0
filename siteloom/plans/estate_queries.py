"""Registered queries on contacts, scan runs and rules, over the driver's documents, events and star-schema tables.

Where the engine's input is markup or text of a kind that the tables don't hold, a query writes it from table
columns in Spark first, so that it grows with them; its SQL states what must come out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteloom.functions import colour as C
from siteloom.operators import contacts as K
from siteloom.operators import monitor as M
from siteloom.operators import themes as H
from siteloom.sources import pages as G


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def page_phones(spark, sf_dir):
    return K.phones_text(_table(spark, sf_dir, "documents"), ["doc_id"], F.col("text")).select("doc_id", "value")


def page_emails(spark, sf_dir):
    return K.emails_text(_table(spark, sf_dir, "documents"), ["doc_id"], F.col("text")).select("doc_id", "value")


def contact_merge(spark, sf_dir):
    """Numbers in documents, merged per source as if each document were a page of it."""
    docs = _table(spark, sf_dir, "documents").select(F.col("source").alias("site"), F.col("doc_id").alias("page_id"), "text", F.when(F.col("doc_id") % 7 == 0, "contact").when(F.col("doc_id") % 7 == 1, "home").otherwise("page").alias("kind"))
    found = K.phones_text(docs, ["site", "page_id"], F.col("text"))
    return K.contact_merge(docs, found, K.phone_key(F.col("value")))


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user on a day as samples of one scan run of one site."""
    events = _table(spark, sf_dir, "events")
    return events.select(F.concat(F.lit("site"), F.col("user_id") % 40).alias("domain"), F.to_date("ts").alias("day"), F.col("value").alias("v"), "event_type")


def sample_median(spark, sf_dir):
    out = M.sample_median(_runs(spark, sf_dir), ["v"], ["domain", "day"], "v")
    return out.select("domain", "day", F.round("v", 6).alias("v"), "samples", F.round("spread", 6).alias("spread"))


def run_compare(spark, sf_dir):
    daily = _runs(spark, sf_dir).groupBy("domain", "day").agg(F.count("*").alias("n"), F.countDistinct("event_type").alias("types"))
    return M.run_compare(daily, "domain", "day", ["n", "types"]).select("domain", "day", "n", F.col("before.n").alias("n_before"), F.col("before.types").alias("types_before"))


def _scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.floor(F.col("v")).cast("bigint")
    rows = _runs(spark, sf_dir).groupBy("domain", "day").agg(
        F.count("*").alias("samples"), F.sum(v).alias("total"), (F.max(v) - F.min(v)).alias("spread"), F.countDistinct("event_type").alias("types"))
    score = lambda k: (100 - (F.col("total") + k) % 17).cast("bigint")
    return rows.select(
        "domain", F.col("day").alias("run_ts"), F.when(F.col("total") % 11 == 0, 500).otherwise(200).alias("status"),
        F.when(F.col("total") % 13 != 0, F.col("total") % 60).alias("cert_days"), F.date_add("day", 30).alias("cert_expires"),
        F.array(F.concat(F.lit("10.0.0."), (F.col("total") % 3).cast("string"))).alias("dns"), F.when(F.col("total") % 19 != 0, F.col("samples")).alias("pages"),
        "samples", F.lit(5).alias("runs"), "spread", score(0).alias("performance"), score(5).alias("accessibility"), score(9).alias("best_practices"), score(13).alias("seo"),
    )


def scan_issues(spark, sf_dir):
    return M.scan_issues(_scans(spark, sf_dir)).select("domain", F.col("run_ts").alias("day"), "ord", "level")


def issue_verdict(spark, sf_dir):
    return M.issue_verdict(M.scan_issues(_scans(spark, sf_dir)), ["domain", "run_ts"]).withColumnRenamed("run_ts", "day")


def snapshot_upsert(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_orderdate").alias("ran_at"))
    new = orders.where("o_custkey % 3 = 0").select("o_custkey", (F.col("n") + 1000).alias("n"))
    return M.snapshot_upsert(new, orders.select("o_custkey", "n"), "o_custkey")


def open_now(spark, sf_dir):
    """Events held against hours: user u's site opens at 7:00 plus u mod 5 hours for 9 hours, not on day u mod 7."""
    events = _table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("site"), "ts")
    sites = events.select("site").distinct()
    hours = sites.select("site", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("day")).where("day <> site % 7")
    hours = hours.select("site", "day", ((7 + F.col("site") % 5) * 60).alias("opens"), ((16 + F.col("site") % 5) * 60).alias("closes"))
    return M.open_at(events, hours).select("event_id", "open")


def aggregate_rating(spark, sf_dir):
    rated = _table(spark, sf_dir, "labels").join(_table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id").withColumn("stars", F.col("quality") * 4 + 1)
    return M.aggregate_rating(rated, "source", "stars")


def usable_pages(spark, sf_dir):
    """Orders as fetches: status and type from the order's fields."""
    o = _table(spark, sf_dir, "orders")
    fetches = o.select("o_orderkey", F.when(F.col("o_orderkey") % 5 == 0, 404).when(F.col("o_orderkey") % 5 == 1, 301).otherwise(200).alias("status"),
                       F.when(F.col("o_custkey") % 4 == 0, "application/pdf").when(F.col("o_custkey") % 4 == 1, "").otherwise("text/html; charset=utf-8").alias("content_type"), F.lit("<p>").alias("html"))
    return G.usable_pages(fetches).select("o_orderkey", "reason")


def robots_rules(spark, sf_dir):
    """Robots texts written from suppliers, with a group for another agent and comments as near misses."""
    return G.robots_rules(_robots(spark, sf_dir)).select("site", "allow", "path", "crawl_delay")


def _robots(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _table(spark, sf_dir, "supplier")
    key = F.col("s_suppkey").cast("string")
    early = F.when(F.col("s_suppkey") % 3 == 0, "Crawl-delay: 70\n").otherwise("")  # a delay between two agents of a group
    text = F.concat(F.lit("User-agent: otherbot\nDisallow: /\n\nUser-agent: *\n"), early, F.lit("User-agent: thirdbot # both\nCrawl-delay: "), (F.col("s_suppkey") % 9).cast("string"),
                    F.lit("\nDisallow: /p"), (F.col("s_suppkey") % 10).cast("string"), F.lit("*/x # private\nAllow: /p"), (F.col("s_suppkey") % 10).cast("string"), F.lit("1/x$\nDisallow:\nSitemap: /s.xml\n"))
    return s.select(F.concat(F.lit("s"), key, F.lit(".example")).alias("site"), text.alias("text"))


def robots_allowed(spark, sf_dir):
    s = _table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string"), F.lit(".example")).alias("site"), "s_suppkey")
    urls = s.select("site", F.explode(F.array(*[F.concat(F.lit("https://"), F.col("site"), F.lit(f"/p{i}1/x{t}")) for i in range(10) for t in ("", "y")])).alias("url"))
    return G.robots_allowed(urls, G.robots_rules(_robots(spark, sf_dir))).select("site", "url", "allowed")


def _sitemaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of a nation as its pages: an index names two documents, of even and odd keys; each also names a foreign page."""
    c = _table(spark, sf_dir, "customer").select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string"), F.lit(".example")).alias("site"), "c_custkey")
    base = F.concat(F.lit("https://"), F.col("site"))
    part = F.concat(base, F.lit("/part"), (F.col("c_custkey") % 2).cast("string"), F.lit(".xml"))
    entry = F.concat(F.lit("<url><loc> "), base, F.lit("/c/"), F.col("c_custkey").cast("string"), F.lit(" </loc></url>"))
    docs = c.groupBy("site", part.alias("sitemap_url")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("c_custkey", entry.alias("e")))), lambda x: x["e"]), "").alias("body"))
    docs = docs.select("site", "sitemap_url", F.concat(F.lit("<urlset><url><loc>https://other.example/</loc></url>"), "body", F.lit("</urlset>")).alias("xml"))
    index = c.groupBy("site").agg(F.array_join(F.sort_array(F.collect_set(F.concat(F.lit("<sitemap><loc>"), part, F.lit("</loc></sitemap>")))), "").alias("body"))
    index = index.select("site", F.concat(base, F.lit("/sitemap.xml")).alias("sitemap_url"), F.concat(F.lit("<sitemapindex>"), "body", F.lit("</sitemapindex>")).alias("xml"))
    return docs.unionByName(index)


def sitemap_urls(spark, sf_dir):
    return G.sitemap_urls(_sitemaps(spark, sf_dir), limit=150)


def sitemap_counts(spark, sf_dir):
    sites = _table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string"), F.lit(".example")).alias("site"))
    maps = _sitemaps(spark, sf_dir).where("sitemap_url like '%/part1.xml' and site <> 'n3.example'")
    return G.sitemap_counts(sites, maps)


def redirect_check(spark, sf_dir):
    s = _table(spark, sf_dir, "supplier")
    host = F.concat(F.lit("old"), F.col("s_suppkey").cast("string"))
    to = F.concat(F.lit("new"), F.col("s_suppkey").cast("string"), F.lit(".example"))
    expected = s.select(host.alias("from_host"), to.alias("to_host"), F.lit("old address").alias("note"))
    k = F.col("s_suppkey") % 5
    observed = s.where(k < 4).select(host.alias("from_host"), F.when(k < 2, 301).otherwise(200).alias("status"),
        F.when(k == 0, F.concat(F.lit("https://"), to, F.lit("/"))).when(k == 1, F.lit("https://elsewhere.example/")).alias("location"),
        F.when(k == 2, F.concat(F.lit("<meta http-equiv='refresh' content='0;url=https://"), to, F.lit("'>"))).otherwise(F.lit("<p>gone</p>")).alias("body"))
    return M.redirect_check(expected, observed).select("from_host", "kind")


def visibility_ranks(spark, sf_dir):
    ranks = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_quantity") <= 20, F.col("l_quantity").cast("int")).alias("organic"))
    return M.rank_buckets(ranks, "organic")


def annotate_issues(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("site"), F.col("o_orderkey").alias("ord"), F.col("o_orderpriority").alias("what"))
    notes = orders.select("site").distinct().select(F.col("site").alias("at"), F.explode(F.array(F.lit("URGENT"), F.lit("LOW"))).alias("match")).withColumn("html", F.concat(F.lit("note on "), "match"))
    return M.annotate_issues(orders, notes).select("site", "ord", "detail")


def crawl_rollup(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders")
    issues = orders.where("o_orderkey % 2 = 0").select(F.col("o_custkey").alias("site"), F.lit("note").alias("level"), F.col("o_orderpriority").alias("what"))
    findings = orders.where("o_orderkey % 2 = 1").select(F.col("o_custkey").alias("site"), F.when(F.col("o_orderkey") % 3 == 0, "high").otherwise("low").alias("level"), F.col("o_orderpriority").alias("what"))
    out = M.crawl_rollup(issues, findings, F.to_timestamp(F.lit("2024-01-10 00:00:00")), F.to_timestamp(F.lit("2024-01-07 06:00:00")))
    return out.groupBy("site", "level", "crawl_age_days", "stale").agg(F.count("*").alias("n"))


#: Categories with the theme and score that the engine's own rules must give them, counted by hand.
THEMED = (
    ("HVAC contractor", "forge", 12), ("coffee bar", "harvest", 12), ("day spa", "bloom", 6), ("lawn and garden", "homestead", 12), ("marketing agency", "beacon", 12), ("saas platform", "folio", 12), ("family dentist", "meridian", 6), ("spare parts", "meridian", 0),
)


def profile_theme(spark, sf_dir):
    """The engine's own themes on categories and taglines by key."""
    c = _table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    category = F.element_at(F.array(*[F.lit(x) for x, *_ in THEMED]), (k % len(THEMED) + 1).cast("int"))
    profiles = c.select("c_custkey", category.alias("category"), F.when(k % 3 == 0, "Tax advice").otherwise("We care").alias("tagline"))
    return H.suggest_theme(profiles, [("category", 6), ("tagline", 2)]).select("c_custkey", "theme", "score", "confident")


def theme_suggest(spark, sf_dir):
    """The theme rule engine with rules on part names and types."""
    rules = (("metal", "steel|brass|copper|nickel|tin\\b"), ("finish", "polished|brushed|burnished|plated|anodized"), ("size", "small|medium|large|economy"))
    parts = _table(spark, sf_dir, "part")
    return H.suggest_theme(parts, [("p_type", 6), ("p_name", 1)], rules, "none").select("p_partkey", "theme", "score", "confident")


def colour_contrast(spark, sf_dir):
    """Contrast of two colours made from each part's key and size."""
    p = _table(spark, sf_dir, "part")
    one = F.concat(F.lit("#"), F.lower(F.lpad(F.hex((F.col("p_partkey") * 7919) % 16777216), 6, "0")))
    two = F.concat(F.lit("#"), F.lower(F.lpad(F.hex((F.col("p_size") * 104729).cast("bigint") % 16777216), 6, "0")))
    return p.select("p_partkey", one.alias("one"), two.alias("two")).select("p_partkey", "one", F.round(C.contrast(F.col("one"), F.col("two")), 6).alias("contrast"), F.round(C.hsl(F.col("one"))["l"], 6).alias("lightness"))


def clock_text(spark, sf_dir):
    """24-hour texts of events' times, to 12 hours and back."""
    e = _table(spark, sf_dir, "events").select("event_id", F.date_format("ts", "HH:mm").alias("clock"))
    twelve = K.to_12h(F.col("clock"))
    return e.select("event_id", twelve.alias("twelve"), K.to_24h(twelve).alias("again"), K.minutes(twelve).cast("bigint").alias("minutes"))


def phone_forms(spark, sf_dir):
    """Numbers in six forms by key: national, with a country code of one, of other countries, of nine digits after a one, short ones."""
    tail = F.lpad(F.col("c_custkey").cast("string"), 4, "0").substr(-4, 4)
    form = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    forms = F.array(form("217 555-", tail), form("+1 (217) 555.", tail, " "), form("+65 6123 ", tail), form("155512", tail), form(" 1-217-555-", tail), form("555  ", tail))
    c = _table(spark, sf_dir, "customer").select("c_custkey", F.element_at(forms, (F.col("c_custkey") % 6 + 1).cast("int")).alias("raw"))
    return c.select("c_custkey", K.format_phone(F.col("raw")).alias("shown"), K.tel_href(F.col("raw")).alias("href"))


QUERIES = [
    page_phones, page_emails, contact_merge, sample_median, run_compare, scan_issues, issue_verdict, snapshot_upsert, open_now, aggregate_rating, usable_pages, robots_rules, robots_allowed,
    sitemap_urls, sitemap_counts, redirect_check, visibility_ranks, annotate_issues, crawl_rollup, theme_suggest, profile_theme, colour_contrast, clock_text, phone_forms,
]

_SP = r"[\x09-\x0D\x20\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"
_SQ = f"trim(regexp_replace(coalesce(text, ''), '{_SP}', ' ', 'g'))"


def _found(pattern: str) -> str:
    """d: doc_id, source, i, m and the 40 characters before each match."""
    return f"""t as (select doc_id, source, {_SQ} as s from documents), g as (select *, regexp_extract_all(s, '{pattern}') as ms, string_split_regex(s, '{pattern}') as ps from t),
d as (select doc_id, source, unnest(range(1, len(ms) + 1)) as i, ms, ps from g), m as (select doc_id, source, i, ms[i] as v, right(ps[i], 40) as b, regexp_replace(ms[i], '\\D', '', 'g') as n from d)"""


_PHONES = f"""{_found(K.PHONE)}, ok as (select *, case when length(n) = 11 and n like '1%' then substr(n, 2) else n end as k, regexp_matches(b, '{K.FAX}') as fax from m
  where length(n) between 10 and 15 and not regexp_full_match(n, '0+') and not regexp_matches(trim(v), '^(19|20)\\d{{2}}[-/]') and not regexp_matches(b, '{K.NUMBER_OF}')
  and not (regexp_full_match(trim(v), '\\d{{10,}}') and not regexp_matches(v, '[()\\s.-]')) and substr(case when length(n) = 11 and n like '1%' then substr(n, 2) else n end, 1, 1) not in ('0', '1')),
ph as (select * from (select * from ok qualify row_number() over (partition by doc_id, k order by i) = 1) where not fax)"""
_RUNS = "r as (select 'site' || (user_id % 40) as domain, cast(ts as date) as day, value as v, event_type from events)"
_SCANS = f"""{_RUNS}, q as (select domain, day, count(*) as samples, cast(sum(cast(floor(v) as bigint)) as bigint) as total, cast(max(floor(v)) - min(floor(v)) as bigint) as spread from r group by all),
s as (select domain, day, case when total % 11 = 0 then 500 else 200 end as status, case when total % 13 <> 0 then total % 60 end as cert, total % 3 as dns, case when total % 19 <> 0 then samples end as pages, samples, spread,
  100 - total % 17 as c1, 100 - (total + 5) % 17 as c2, 100 - (total + 9) % 17 as c3, 100 - (total + 13) % 17 as c4 from q),
w as (select *, lag(dns) over o as dns0, lag(pages) over o as pages0, lag(c1) over o as p1, lag(c2) over o as p2, lag(c3) over o as p3, lag(c4) over o as p4 from s window o as (partition by domain order by day)),
i as (select domain, day, 0 as ord, 'urgent' as level from w where status <> 200 union all select domain, day, 1, 'urgent' from w where cert is null union all select domain, day, 2, 'urgent' from w where cert < 21
  union all select domain, day, 4, 'attention' from w where dns <> dns0 union all select domain, day, 5, 'attention' from w where pages is null
  union all select domain, day, 6, 'attention' from w where pages < pages0 union all select domain, day, 7, 'note' from w where pages > pages0
  union all select domain, day, 9, 'note' from w where samples < 3 union all select domain, day, 10, 'note' from w where samples >= 3 and spread >= 8
  {" ".join(f"union all select domain, day, {11 + 3 * k}, 'attention' from w where samples >= 3 and c{k + 1} < 90 union all select domain, day, {12 + 3 * k}, 'attention' from w where samples >= 3 and c{k + 1} >= 90 and p{k + 1} - c{k + 1} >= 8 union all select domain, day, {13 + 3 * k}, 'note' from w where samples >= 3 and c{k + 1} between 90 and 99 and not coalesce(p{k + 1} - c{k + 1} >= 8, false)" for k in range(4))})"""
_LIN = "(case when {0} <= 0.03928 then {0} / 12.92 else power(({0} + 0.055) / 1.055, 2.4) end)"


def _lum(n: str) -> str:
    part = lambda d: _LIN.format(f"((({n}) // {d} % 256) / 255.0)")
    return f"(0.2126 * {part(65536)} + 0.7152 * {part(256)} + 0.0722 * {part(1)})"


_A, _B = "(p_partkey * 7919 % 16777216)", "(p_size * 104729 % 16777216)"

ORACLES = {
    "page_phones": f"with {_PHONES} select doc_id, trim(v) as value from ph",
    "page_emails": f"with {_found(K.EMAIL)} select distinct doc_id, lower(v) as value from m where not regexp_matches(lower(v), '{K.EMAIL_NOISE}')",
    "contact_merge": f"""with {_PHONES}, x as (select source as site, doc_id, row_number() over (partition by doc_id order by i) as n, trim(v) as value, k, case when doc_id % 7 = 0 then 0 when doc_id % 7 = 1 then 1 else 2 end as rank from ph),
      y as (select * from x qualify row_number() over (partition by site, k order by rank, doc_id, n) = 1) select site, cast(row_number() over (partition by site order by rank, doc_id, n) as integer) as ord, value from y""",
    "sample_median": f"with {_RUNS} select domain, day, round(list_sort(list(v))[len(list(v)) // 2 + 1], 6) as v, count(v) as samples, round(max(v) - min(v), 6) as spread from r group by domain, day",
    "run_compare": f"with {_RUNS}, d as (select domain, day, count(*) as n, count(distinct event_type) as types from r group by all) select domain, day, n, lag(n) over w as n_before, lag(types) over w as types_before from d window w as (partition by domain order by day)",
    "scan_issues": f"with {_SCANS} select domain, day, ord, level from i",
    "issue_verdict": f"with {_SCANS}, c as (select domain, day, count(*) filter (level = 'urgent') as urgent, count(*) filter (level = 'attention') as attention, count(*) filter (level = 'note') as notes from i group by all) select *, case when urgent > 0 then 'bad' when attention > 0 then 'warn' else 'ok' end as verdict from c",
    "snapshot_upsert": "select o_custkey, count(*) + case when o_custkey % 3 = 0 then 1000 else 0 end as n from orders group by o_custkey",
    "open_now": "select event_id, (isodow(ts) - 1 <> user_id % 7) and hour(ts) * 60 + minute(ts) >= (7 + user_id % 5) * 60 and hour(ts) * 60 + minute(ts) < (16 + user_id % 5) * 60 as open from events",
    "aggregate_rating": "select source, printf('%.1f', round(avg(quality * 4 + 1), 1)) as rating, count(*) as reviews from labels join documents using (doc_id) group by source having count(*) >= 2",
    "usable_pages": "select o_orderkey, case when o_orderkey % 5 = 0 then 'HTTP 404' when o_orderkey % 5 = 1 then 'HTTP 301' when o_custkey % 4 = 0 then 'Not HTML (application/pdf)' end as reason from orders",
    "robots_rules": "select 's' || s_suppkey || '.example' as site, unnest([false, true]) as allow, unnest(['/p' || (s_suppkey % 10) || '*/x', '/p' || (s_suppkey % 10) || '1/x$']) as path, cast(s_suppkey % 9 as double) as crawl_delay from supplier",
    "robots_allowed": "select site, 'https://' || site || '/p' || i || '1/x' || t as url, not (i = s_suppkey % 10 and t = 'y') as allowed from (select 's' || s_suppkey || '.example' as site, s_suppkey from supplier), (select unnest(range(10)) as i), (select unnest(['', 'y']) as t)",
    "sitemap_urls": "select 'n' || c_nationkey || '.example' as site, cast(row_number() over (partition by c_nationkey order by c_custkey % 2, c_custkey) as integer) as ord, 'https://n' || c_nationkey || '.example/c/' || c_custkey as url from customer qualify ord <= 150",
    "sitemap_counts": "select 'n' || n_nationkey || '.example' as site, case when n_nationkey <> 3 then (select nullif(count(*), 0) + 1 from customer where c_nationkey = n_nationkey and c_custkey % 2 = 1) end as pages from nation",
    "redirect_check": "select 'old' || s_suppkey as from_host, case s_suppkey % 5 when 0 then 'server' when 2 then 'in-page' else 'none' end as kind from supplier",
    "visibility_ranks": "select l_orderkey, l_linenumber, organic, case when organic <= 3 then 'good' when organic <= 10 then 'mid' else 'none' end as bucket from (select l_orderkey, l_linenumber, case when l_quantity <= 20 then cast(l_quantity as integer) end as organic from lineitem)",
    "annotate_issues": "select o_custkey as site, o_orderkey as ord, case when p is not null and row_number() over (partition by o_custkey, p order by o_orderkey) = 1 then 'note on ' || p end as detail from (select *, case when o_orderpriority like '%URGENT%' then 'URGENT' when o_orderpriority like '%LOW%' then 'LOW' end as p from orders)",
    "crawl_rollup": "select o_custkey as site, case when o_orderkey % 2 = 0 then 'note' else 'attention' end as level, 3::bigint as crawl_age_days, true as stale, count(*) as n from orders where o_orderkey % 2 = 0 or o_orderkey % 3 = 0 group by all",
    "profile_theme": f"""with t as (select * from (values {', '.join(f"({i}, '{theme}', {score})" for i, (_, theme, score) in enumerate(THEMED))}) v(i, theme, score)),
      c as (select c_custkey, theme, score, c_custkey % 3 = 0 as tax from customer join t on c_custkey % {len(THEMED)} = i)
      select c_custkey, case when tax and score < 2 then 'meridian' else theme end as theme, cast(score + case when tax and theme = 'meridian' then 2 else 0 end as bigint) as score, score + case when tax and theme = 'meridian' then 2 else 0 end >= 3 as confident from c""",
    "theme_suggest": """with h as (select p_partkey, lower(p_type) as t, lower(p_name) as n from part), s as (select p_partkey,
      6 * len(regexp_extract_all(t, 'steel|brass|copper|nickel|tin\\b')) + len(regexp_extract_all(n, 'steel|brass|copper|nickel|tin\\b')) as a,
      6 * len(regexp_extract_all(t, 'polished|brushed|burnished|plated|anodized')) + len(regexp_extract_all(n, 'polished|brushed|burnished|plated|anodized')) as b,
      6 * len(regexp_extract_all(t, 'small|medium|large|economy')) + len(regexp_extract_all(n, 'small|medium|large|economy')) as c from h)
      select p_partkey, case when greatest(a, b, c) = 0 then 'none' when a >= b and a >= c then 'metal' when b >= c then 'finish' else 'size' end as theme, greatest(a, b, c) as score, greatest(a, b, c) >= 3 as confident from s""",
    "colour_contrast": f"""select p_partkey, '#' || lower(printf('%06x', {_A})) as one, round((greatest({_lum(_A)}, {_lum(_B)}) + 0.05) / (least({_lum(_A)}, {_lum(_B)}) + 0.05), 6) as contrast,
      round((greatest({_A} // 65536 % 256, {_A} // 256 % 256, {_A} % 256) + least({_A} // 65536 % 256, {_A} // 256 % 256, {_A} % 256)) / 510.0, 6) as lightness from part""",
    "clock_text": "select event_id, ltrim(strftime(ts, '%I:%M %p'), '0') as twelve, strftime(ts, '%H:%M') as again, cast(hour(ts) * 60 + minute(ts) as bigint) as minutes from events",
    "phone_forms": """with c as (select c_custkey, c_custkey % 6 as f, right(lpad(c_custkey::varchar, 4, '0'), 4) as t from customer)
      select c_custkey, case when f in (0, 1, 4) then '(217) 555-' || t when f = 2 then '+65 6123 ' || t when f = 3 then '155512' || t else '555  ' || t end as shown, case when f in (0, 1, 4) then '+1217555' || t when f = 2 then '+656123' || t when f = 3 then '+1155512' || t else '555' || t end as href from c""",
}
