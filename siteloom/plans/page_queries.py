"""Registered queries over the tables of pages and documents, with their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siteloom.functions import text as T
from siteloom.functions import url as U
from siteloom.operators import pages as P
from siteloom.operators import seo as S
from siteloom.operators import themes as H
from siteloom.operators.nodes import html_nodes, node_table
from siteloom.operators.state import ensure_checkpoint_dir, written
from siteloom.sources.pages import read_pages, with_site


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_pages(spark, f"{sf_dir}/pages.parquet")


def _both(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The pages and their nodes, parsed once."""
    pages = _pages(spark, sf_dir)
    return pages, node_table(pages)


MIDDLE = "A page about what we do, for whom we do it and where, in words that are neither few nor many for it"
LONG = "Long " * 40
#: What pages get into their heads and bodies: (divisor, remainder of page_id, markup); {i} is page_id, {url} the address.
HEAD = (
    (6, 1, '<meta name="description" content="Short {i}">'), (6, 2, f'<meta name="description" content="{MIDDLE}">'), (6, 3, f'<meta name="description" content="{LONG}">'), (6, 4, '<meta name="descriptions" content="no">'),
    (4, 1, '<meta name="viewport" content="width=device-width">'), (4, 2, '<meta name="viewport" content="width=device-width">'), (4, 3, '<meta name="viewport" content="width=1">'),
    (5, 1, '<link rel="canonical" href="{url}">'), (5, 2, '<link rel="canonical" href="https://other.example/">'), (5, 3, '<link rel="canonical" href="{url}#x">'), (2, 0, '<script type="application/ld+json">{"@type": "Store"}</script>'),
    (17, 3, '<meta http-equiv="Refresh" content="9">'), (8, 5, '<meta name="generator" content="WordPress 6">'), (8, 6, '<meta name="generator" content="Microsoft FrontPage 4.0">'), (8, 7, "<!-- static.wixstatic.example -->"),
)
BODY = (
    (3, 1, '<img src="/i.png">'), (3, 2, '<img src="/i.png"><img src="/j.png">'), (4, 1, '<img src="/a.png" alt=" ">'), (4, 2, '<img src="/b.png" alt="B">'),
    (6, 1, "<table><tr><td></td></tr></table>"), (6, 3, "<table><tr><th></th></tr></table>"), (6, 5, '<table role="Presentation"><tr><th></th></tr></table>'), (7, 0, "<h1>Extra {i}</h1>"),
    (13, 0, "<font></font><center></center>"), (19, 0, '<embed src="a.swf">'), (23, 0, '<i style="x"></i>' * 31), (23, 1, '<i style="x"></i>' * 30), (29, 0, "<!-- -->" * 60_000),
)


def _furnished(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages with heads and markup that they lack, by the remainders of page_id: what audits look for, and near misses."""
    i = F.col("page_id")

    def pieces(rows: tuple[tuple[int, int, str], ...]) -> Column:
        return F.concat(*[F.when(i % n == r, F.replace(F.replace(F.lit(text), F.lit("{i}"), i.cast("string")), F.lit("{url}"), F.col("url"))).otherwise("") for n, r, text in rows])

    bare = F.when(i % 11 == 0, F.replace(F.replace("html", F.lit("<h1>"), F.lit("<h2>")), F.lit("</h1>"), F.lit("</h2>"))).otherwise(F.col("html"))
    html = F.replace(F.replace(bare, F.lit("</title>"), F.concat(F.lit("</title>"), pieces(HEAD))), F.lit("<body>"), F.concat(F.lit("<body>"), pieces(BODY)))
    return with_site(spark.read.parquet(f"{sf_dir}/pages.parquet").withColumn("html", html))


def _audited(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    pages = written(_furnished(spark, sf_dir), "pages")
    return pages, node_table(pages)


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(S.seo_facts(*_audited(spark, sf_dir)), "facts")


def _domains(pages: DataFrame) -> DataFrame:
    """Pages grouped by the last two labels of their host."""
    return pages.withColumn("site", F.array_join(F.slice(F.split("site", r"\."), -2, 2), "."))


def _audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.page_audit(*_audited(spark, sf_dir))


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three words of the pages' invented language stand in for towns: each site gets the same short list."""
    sites = _pages(spark, sf_dir).select("site").distinct()
    return sites.select("site", F.explode(F.array(F.lit("Thatand"), F.lit("oued"), F.lit("queados"))).alias("place"))


def pages_scan(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", "url", "site", "bytes")


def url_canonical(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", U.canonical(F.col("url")).alias("canonical"))


def page_kind(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", U.page_kind(F.col("url")).alias("k")).select("page_id", "k.kind", "k.score")


def url_parts(spark, sf_dir):
    u = F.col("url")
    return _pages(spark, sf_dir).select("page_id", U.host(u).alias("host"), U.path(u).alias("path"), U.query(u).alias("query"), U.depth(u).alias("depth"), U.extension(u).alias("extension"), U.basename(u).alias("basename"))


def nodes(spark, sf_dir):
    return html_nodes(_pages(spark, sf_dir)).groupBy("page_id", "tag").agg(F.count("*").alias("n"))


def page_meta(spark, sf_dir):
    return P.page_heads(*_audited(spark, sf_dir)).select("page_id", "title", "lang", "description", "viewport", "generator", "canonical")


def page_links(spark, sf_dir):
    return P.page_links(*_both(spark, sf_dir)).groupBy("page_id", "url").agg(F.count("*").alias("n"))


def crawlable_links(spark, sf_dir):
    return P.crawlable_links(P.page_links(*_both(spark, sf_dir))).groupBy("page_id", "url").agg(F.count("*").alias("n"))


def page_headings(spark, sf_dir):
    return P.page_headings(_both(spark, sf_dir)[1]).select("page_id", "level", "ord", F.length("text").cast("bigint").alias("chars"))


def page_paragraphs(spark, sf_dir):
    return P.page_paragraphs(_both(spark, sf_dir)[1]).select("page_id", "text")


def page_nav(spark, sf_dir):
    return P.page_nav(*_both(spark, sf_dir)).select("page_id", "ord", "label")


def page_audit(spark, sf_dir):
    return _audit(spark, sf_dir).select("page_id", "words", "h1", "has_https", "bytes", "images", "images_no_alt", "scripts", "tables", "layout_tables", "has_viewport", "has_structured_data", "inline_styled", "dated", "refreshes", "flash")


def platform_detect(spark, sf_dir):
    return _audit(spark, sf_dir).select("page_id", "platform")


def audit_flags(spark, sf_dir):
    return P.audit_flags(_audit(spark, sf_dir)).select("page_id", "code", "n")


def site_audit(spark, sf_dir):
    return P.site_audit(_audit(spark, sf_dir))


def audit_flag_counts(spark, sf_dir):
    flags = P.audit_flags(_audit(spark, sf_dir))
    return P.audit_flag_counts(flags).select("site", F.regexp_replace("text", r"\d+", "N").alias("text"), "pages")


def content_duplicates(spark, sf_dir):
    """Every fifth page is there again under another number, changed at the end or in its length by some."""
    pages = _pages(spark, sf_dir)
    i = F.col("page_id")
    again = pages.where("page_id % 5 = 0").withColumn("html", F.when(i % 3 == 0, F.concat("html", F.lit(" "))).when((i % 3 == 1) & (F.length("html") > 2000), F.concat(F.expr("left(html, length(html) - 1)"), F.lit("#"))).otherwise(F.col("html")))
    both = pages.unionByName(again.withColumn("page_id", i + 1_000_000).withColumn("bytes", F.length("html").cast("bigint")))
    return P.content_duplicates(both).select("page_id", "site", "url")


def home_page(spark, sf_dir):
    return P.home_page(_pages(spark, sf_dir))


def frontier_new(spark, sf_dir):
    pages, found = _both(spark, sf_dir)
    links = P.crawlable_links(P.page_links(pages, found))
    seen = links.where("page_id % 2 = 0").select("site", "url")
    return P.frontier_new(links.where("page_id % 2 = 1"), seen)


def frontier_topn(spark, sf_dir):
    candidates = _pages(spark, sf_dir).select("site", U.canonical(F.col("url")).alias("url"), F.col("page_id").alias("ord"))
    return P.frontier_topn(candidates)


def crawl_reach(spark, sf_dir):
    """Links among the pages of a host, each also to the next three pages by number; a site starts at its first page."""
    ensure_checkpoint_dir(spark)
    pages = _pages(spark, sf_dir).select("site", "page_id", U.canonical(F.col("url")).alias("url"))
    ranked = written(pages.withColumn("nth", F.row_number().over(Window.partitionBy("site").orderBy("page_id"))), "ranked")
    links = ranked.alias("a").join(ranked.alias("b"), (F.col("a.site") == F.col("b.site")) & F.col("b.nth").isin([F.col("a.nth") + 1, F.col("a.nth") * 3])).select("a.site", "a.url", F.col("b.url").alias("target"))
    return P.crawl_reach(ranked.where("nth = 1").select("site", "url"), links.distinct())


def crawl_stats(spark, sf_dir):
    pages, found = _both(spark, sf_dir)
    return P.crawl_stats(pages, P.page_links(pages, found))


def about_body(spark, sf_dir):
    """A third of the pages are home pages and a third about pages; the rest is left out."""
    pages, found = _both(spark, sf_dir)
    i = F.col("page_id") % 3
    named = pages.withColumn("url", F.concat(U.origin(F.col("url")), F.when(i == 0, "/").when(i == 1, "/about-us").otherwise("/other")))
    return P.about_body(named, P.page_paragraphs(found)).select("site", "ord", "text")


def seo_page_facts(spark, sf_dir):
    return _facts(spark, sf_dir).select("page_id", "title", "title_len", F.size("h1s").cast("bigint").alias("h1"), "words", F.size("links_out").cast("bigint").alias("links"), "images", "no_alt", "desc_len", F.array_join("schema", " ").alias("schema"))


def duplicate_titles(spark, sf_dir):
    """Pages of one registered domain whose title others of it have, too, with how many these are."""
    pages = _domains(_pages(spark, sf_dir))
    titles = html_nodes(pages).where("tag = 'title'").groupBy("site", "page_id").agg(F.min_by("text", "node_id").alias("title"))
    return S.shared_values(titles.join(pages.select("page_id", "url"), "page_id"), "title").select("site", F.col("value").alias("title"), "pages", "url")


def duplicate_descriptions(spark, sf_dir):
    return S.shared_values(_facts(spark, sf_dir), "desc").select("site", F.col("value").alias("description"), "pages", "url")


def orphan_pages(spark, sf_dir):
    return S.orphans(_facts(spark, sf_dir)).select("page_id", "site", "url")


def pages_without_place(spark, sf_dir):
    return S.pages_without_place(_facts(spark, sf_dir), _places(spark, sf_dir)).select("page_id", "site")


def seo_findings(spark, sf_dir):
    return S.seo_findings(_facts(spark, sf_dir), _places(spark, sf_dir)).select("site", "level", "code", "what", "url")


def finding_pages(spark, sf_dir):
    return S.finding_pages(_facts(spark, sf_dir), _places(spark, sf_dir))


def finding_counts(spark, sf_dir):
    return S.finding_counts(S.seo_findings(_facts(spark, sf_dir), _places(spark, sf_dir)))


def finding_groups(spark, sf_dir):
    return S.finding_groups(S.seo_findings(_facts(spark, sf_dir), _places(spark, sf_dir)))


def page_social(spark, sf_dir):
    """Links written from the pages' numbers: profiles, longer addresses of the same network, and share widgets."""
    return H.social_links(_social(spark, sf_dir)).select("page_id", "network", "url")


def _social(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("page_id").cast("string")
    at = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    urls = F.array(at("https://facebook.com/longer-name-", i), at("https://fb.com/n", i), at("https://www.facebook.com/sharer?u=", i), at("https://x.com/a", i), at("https://fox.com/a", i), at("https://www.yelp.com/biz/", i), at("https://instagram.com/share/", i))
    return _pages(spark, sf_dir).select("site", "page_id", F.posexplode(urls).alias("node_id", "url")).where("(page_id + node_id) % 3 <> 0")


def social_merge(spark, sf_dir):
    stated = _pages(spark, sf_dir).select("site").distinct().select("site", F.explode(F.array(F.lit("facebook"), F.lit("tiktok"))).alias("network")).withColumn("url", F.concat(F.lit("https://stated.example/"), "network"))
    return H.social_merge(H.social_links(_social(spark, sf_dir)), stated)


def items_merge(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return P.items_merge(docs, ["lang"], F.lower(F.substring("text", 1, 60)), ["doc_id"]).select("lang", "doc_id")


def squash(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", F.md5(T.squash(F.col("text"))).alias("digest"), T.word_count(F.col("text")).alias("words"))


def slug(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", T.slug(F.split("text", "\n")[0]).alias("slug"))


def truncate_words(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", T.truncate_words(F.col("text"), 160).alias("short"))


QUERIES = [
    pages_scan, url_canonical, page_kind, url_parts, nodes, page_meta, page_links, crawlable_links, page_headings, page_paragraphs, page_nav, page_audit, platform_detect, audit_flags, site_audit,
    audit_flag_counts, content_duplicates, home_page, frontier_new, frontier_topn, crawl_reach, crawl_stats, about_body, seo_page_facts, duplicate_titles, duplicate_descriptions, orphan_pages, pages_without_place,
    seo_findings, finding_pages, finding_counts, finding_groups, page_social, social_merge, items_merge, squash, slug, truncate_words,
]

_SP = r"[\x09-\x0D\x20\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"
_HOST = "lower(regexp_extract(url, '^https?://([^/?#]*)', 1))"
_SITE = f"regexp_replace({_HOST}, '^www\\.', '')"
_PATH = "coalesce(nullif(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), ''), '/')"
_QUERY = "regexp_extract(url, '^[^?#]*(\\?[^#]*)', 1)"
_ORIGIN = "regexp_extract(url, '^(https?://[^/?#]*)', 1)"
_DEPTH = f"len(list_filter(string_split({_PATH}, '/'), lambda x: x <> ''))"


def _text(html: str) -> str:
    """Visible text of a piece of markup, for the tags that the test pages use."""
    t = f"regexp_replace(regexp_replace(regexp_replace({html}, '<!--.*?-->', '', 'gs'), '<script>.*?</script>', '', 'gs'), '<style>.*?</style>', '', 'gs')"
    t = f"regexp_replace(regexp_replace({t}, '</?(a|b|br|html|body|title)( [^>]*)?>', '', 'g'), '<[^>]*>', ' ', 'g')"
    t = f"replace(replace(replace(replace(replace(replace({t}, '&quot;', chr(34)), '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')"
    return f"trim(regexp_replace({t}, '{_SP}', ' ', 'g'))"


_BODY = "regexp_extract(html, '(?s)<body>(.*)$', 1)"
_TITLE = _text("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")
_WORDS = f"len(list_filter(string_split({_text(_BODY)}, ' '), lambda x: x <> ''))"
_ENC = "list_aggregate(list_transform(string_split(h, ''), lambda x: case when octet_length(encode(x)) > 1 then url_encode(x) when x = ' ' then '%20' else x end), 'string_agg', '')"
_PAGES = f"""p as (select page_id, url, html, {_SITE} as site, {_ORIGIN} as origin, {_TITLE} as title, {_WORDS} as words,
  array_to_string(list_slice(string_split({_SITE}, '.'), -2, -1), '.') as domain from pages)"""


def _pieces(rows: tuple[tuple[int, int, str], ...]) -> str:
    quoted = lambda t: "'" + t.replace("'", "''") + "'"
    return " || ".join(f"case when page_id % {n} = {r} then replace(replace({quoted(t)}, '{{i}}', page_id::varchar), '{{url}}', url) else '' end" for n, r, t in rows)


_BARE = "case when page_id % 11 = 0 then replace(replace(html, '<h1>', '<h2>'), '</h1>', '</h2>') else html end"
#: The furnished pages' facts by the remainders of page_id.
_AUD = f"""{_PAGES}, d as (select *, page_id as i, replace(replace({_BARE}, '</title>', '</title>' || {_pieces(HEAD)}), '<body>', '<body>' || {_pieces(BODY)}) as full_html from p),
a as (select i, page_id, site, url, title, words + case when i % 7 = 0 then 2 else 0 end as words, length(full_html) as bytes,
  case when i % 11 = 0 then 0 else 1 end + (i % 7 = 0)::bigint as h1, i % 3 as no_alt, i % 3 + (i % 4 in (1, 2))::bigint as images, i % 3 + (i % 4 = 1)::bigint as images_no_alt, 1 + (i % 2 = 0)::bigint as scripts,
  (i % 6 in (1, 3, 5))::bigint as tables, (i % 6 in (1, 5))::bigint as layout_tables, i % 4 <> 0 as has_viewport, i % 2 = 0 as has_structured_data, case i % 23 when 0 then 31 when 1 then 30 else 0 end::bigint as inline_styled,
  case when i % 13 = 0 then 2 else 0 end::bigint as dated, (i % 17 = 3)::bigint as refreshes, i % 19 = 0 as flash, url like 'https:%' as has_https,
  case i % 6 when 1 then 'Short ' || i when 2 then '{MIDDLE}' when 3 then '{LONG.strip()}' else '' end as description, case i % 8 when 5 then 'WordPress' when 6 then 'Microsoft FrontPage' when 7 then 'Wix' else '' end as platform from d),
flags as (
  select page_id, site, 'no_viewport' as code, 'No viewport meta tag — the page does not adapt to phones.' as text, null::bigint as n from a where not has_viewport
  union all select page_id, site, 'no_https', 'Served over HTTP, so browsers show a "Not secure" warning.', null from a where not has_https
  union all select page_id, site, 'no_description', 'No meta description — Google invents its own snippet.', null from a where description = ''
  union all select page_id, site, 'no_title', 'No page title.', null from a where title = ''
  union all select page_id, site, 'long_title', 'Page title is N characters and gets truncated in search results.', length(title) from a where length(title) > 65
  union all select page_id, site, 'no_h1', 'No `<h1>` heading — weakens search relevance.', null from a where h1 = 0
  union all select page_id, site, 'many_h1', 'N `<h1>` headings on one page.', h1 from a where h1 > 1
  union all select page_id, site, 'no_alt', 'N of N images have no alt text (accessibility + SEO).', images_no_alt from a where images_no_alt > 0
  union all select page_id, site, 'layout_tables', 'N table(s) used for page layout — a pre-N technique.', layout_tables from a where layout_tables > 0
  union all select page_id, site, 'dated_tags', 'Uses deprecated `<font>` / `<center>` / `<marquee>` tags.', dated from a where dated > 0
  union all select page_id, site, 'flash', 'References Adobe Flash, which no browser has supported since N.', null from a where flash
  union all select page_id, site, 'inline_styles', 'N elements carry inline styles, making restyling expensive.', inline_styled from a where inline_styled > 30
  union all select page_id, site, 'refresh', 'Uses a meta-refresh redirect.', null from a where refreshes > 0
  union all select page_id, site, 'no_json_ld', 'No structured data (schema.org) — no rich results in Google.', null from a where not has_structured_data
  union all select page_id, site, 'heavy', 'HTML document is N KB before images load.', bytes from a where bytes > 400000)"""
_LINKS = f"""{_PAGES}, h as (select page_id, site, url as base, origin, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) as h from p),
l as (select page_id, site, base, origin || {_ENC} as url from (select page_id, site, base, origin, regexp_replace(replace(h, '&amp;', '&'), '#.*', '') as h from h where h not like '#%'))"""
_CRAWL = f"""{_LINKS}, c as (select page_id, site, case when regexp_extract(url, '^https?://[^/]*(/.+)/$', 1) <> '' then regexp_replace(url, '/+$', '') else url end as url from l),
k as (select * from c where not regexp_matches(url, '(?i)/(wp-admin|wp-login|wp-json|xmlrpc|feed|rss|atom|comments|trackback|cart|checkout|my-account|login|register|signin|signup|search|tag|author|category/page|page/\\d+|\\d{{4}}/\\d{{2}}|wp-content/uploads)\\b|\\.(xml|json|txt|css|js)$')
  and not regexp_matches(url, '(?i)\\.(pdf|zip|docx?|xlsx?|pptx?|csv|mp4|mp3|avi|mov|wmv|dmg|exe|rar|gz|tgz|svgz)$'))"""
_CANON = f"""{_ORIGIN} || case when {_PATH} <> '/' then regexp_replace({_PATH}, '(.)/+$', '\\1') else '/' end ||
  case when len(list_filter(string_split(substr({_QUERY}, 2), '&'), lambda x: x <> '' and not regexp_matches(x, '(?i)^(utm_|fbclid|gclid|mc_|ref(=|$)|source(=|$))'))) > 0
  then '?' || array_to_string(list_filter(string_split(substr({_QUERY}, 2), '&'), lambda x: x <> '' and not regexp_matches(x, '(?i)^(utm_|fbclid|gclid|mc_|ref(=|$)|source(=|$))')), '&') else '' end"""


def _kind(url: str) -> str:
    path = _PATH.replace("url", url)
    cases = " ".join(f"when regexp_matches({path}, '(?i){rule}') then '{kind}:{score}'" for rule, score, kind in U.PAGE_KINDS)
    return f"case {cases} else 'page:' || (40 - 5 * {_DEPTH.replace('url', url)}) end"


_PARAS = f"""{_PAGES}, a as (select page_id, site, unnest(regexp_extract_all(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '<p>([^<]*)', 1)) as raw, generate_subscripts(regexp_extract_all(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '<p>([^<]*)', 1), 1) as i from p),
b as (select page_id, site, 2 * i as i, {_text("raw")} as text from a union all
  select page_id, site, i, {_text("raw")} from (select page_id, site, i, array_to_string(list_slice(parts, i, len(parts)), '<p>') as raw from
    (select page_id, site, parts, unnest(range(2, len(parts) + 1)) as i from (select page_id, site, string_split(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '<p><b>') as parts from p)))),
q as (select page_id, site, min(i) as i, min_by(text, i) as text from b where text <> '' and len(string_split(text, ' ')) >= 8 and length(text) <= 1200
  and not regexp_matches(text, '{P.BOILERPLATE}') group by page_id, site, lower(substr(text, 1, 80)))"""

_FACTS = f"""{_AUD.replace("p as (", "p as (", 1)}, {_LINKS.split(", h as (", 1)[1].join(["h as (", ""])},
f as (select a.*, length(title) as title_len, case when i % 6 = 3 then '{LONG}' else description end as descr, coalesce(o.links, 0) as links,
    case i % 5 when 1 then url when 2 then 'https://other.example/' when 3 then url || '#x' else '' end as canonical
  from a left join (select page_id, count(distinct url) as links from l where url <> base group by page_id) o using (page_id)),
o as (select f.page_id, f.site, f.url from f where not ({_PATH} = '/' and {_QUERY} = '') and not exists (select 1 from l where l.site = f.site and l.url <> l.base and (l.url = f.url or l.url = regexp_replace(f.url, '/$', '')))),
np as (select page_id, site, url from (select page_id, site, url, lower({_text(_BODY)}) as t from p) where t not like '%thatand%' and t not like '%oued%' and t not like '%queados%'),
st as (select site, title as value, count(*) as pages from f where title <> '' group by all having count(*) > 1), sd as (select site, descr as value, count(*) as pages from f where descr <> '' group by all having count(*) > 1)"""

_FIND = f"""{_FACTS}, r as (select site, level, code, what, {_PATH} || {_QUERY} as url from (
  select site, url, 'high' as level, 'no_title' as code, 'No page title' as what from f where title_len = 0
  union all select site, url, case when title_len > 75 then 'medium' else 'low' end, 'long_title', 'Title is ' || title_len || ' characters — Google shows about 60, so the end is cut off' from f where title_len > 60
  union all select site, url, 'medium', 'short_title', 'Title is only ' || title_len || ' characters — too little to rank on' from f where title_len between 1 and 14
  union all select site, url, 'high', 'no_description', 'No meta description — Google writes its own snippet' from f where descr = ''
  union all select site, url, 'low', 'long_description', 'Meta description is ' || length(descr) || ' characters and gets truncated' from f where length(descr) > 160
  union all select site, url, 'low', 'short_description', 'Meta description is only ' || length(descr) || ' characters' from f where length(descr) between 1 and 69
  union all select site, url, 'high', 'no_h1', 'No H1 heading' from f where h1 = 0
  union all select site, url, 'medium', 'many_h1', h1 || ' H1 headings on one page' from f where h1 > 1
  union all select site, url, 'medium', 'no_canonical', 'No canonical URL' from f where canonical = ''
  union all select site, url, 'high', 'other_canonical', 'Canonical points elsewhere: ' || canonical from f where canonical <> '' and regexp_replace(split_part(canonical, '#', 1), '/$', '') <> regexp_replace(url, '/$', '')
  union all select site, url, 'medium', 'thin', 'Only ' || words || ' words of copy — too thin to rank' from f where words < 150
  union all select site, url, 'medium', 'no_alt', no_alt || ' of ' || images || ' images have no alt attribute at all' from f where no_alt > 0
  union all select site, url, 'medium', 'no_schema', 'No structured data on the page' from f where i % 2 = 1)
  union all select site, 'high', 'shared_title', pages || ' pages share the title "' || value || '" — they compete with each other', null from st
  union all select site, 'medium', 'shared_description', pages || ' pages share one meta description', null from sd
  union all select site, 'high', 'orphans', count(*) || ' pages are in the sitemap but linked from nowhere on the site', null from o group by site
  union all select site, 'medium', 'no_place', count(*) || ' pages never mention any town the business serves', null from np group by site)"""
_GROUPED = f"""{_FIND}, w as (select *, regexp_replace(what, '\\d+', '#', 'g') as shape, regexp_extract_all(what, '\\d+') as nums from r),
sp as (select site, shape, list(case when lo = hi then lo::varchar else lo || '–' || hi end order by k) as spans from (select site, shape, k, min(num::hugeint) as lo, max(num::hugeint) as hi from (select site, shape, unnest(nums) as num, generate_subscripts(nums, 1) as k from w) group by all) group by all)"""

_SOC = f"""u as (select {_SITE} as site, page_id, unnest(['https://facebook.com/longer-name-' || page_id, 'https://fb.com/n' || page_id, 'https://www.facebook.com/sharer?u=' || page_id, 'https://x.com/a' || page_id, 'https://fox.com/a' || page_id, 'https://www.yelp.com/biz/' || page_id,
  'https://instagram.com/share/' || page_id]) as url, unnest([0, 1, 2, 3, 4, 5, 6]) as k, unnest(['facebook', 'facebook', '', 'x', '', 'yelp', '']) as network from pages),
v as (select site, page_id, network, min_by(url, length(url) * 10 + k) as url from u where network <> '' and (page_id + k) % 3 <> 0 group by all)"""

ORACLES = {
    "social_merge": f"""with {_SOC}, x as (select site, network, max_by(url, page_id) as url from v group by all), y as (select distinct {_SITE} as site, unnest(['facebook', 'tiktok']) as network from pages)
      select coalesce(x.site, y.site) as site, coalesce(x.network, y.network) as network, coalesce(x.url, 'https://stated.example/' || y.network) as url from x full join y on x.site = y.site and x.network = y.network""",
    "page_social": f"with {_SOC} select page_id, network, url from v",
    "finding_pages": f"""with {_FACTS}, all_pages as (select f.site, 'shared_title' as code, value, url from f join st on f.site = st.site and title = value union all select f.site, 'shared_description', value, url from f join sd on f.site = sd.site and descr = value
      union all select site, 'orphans', '', url from o union all select site, 'no_place', '', url from np) select site, code, value, {_PATH} || {_QUERY} as path from all_pages""",
    "duplicate_descriptions": f"with {_FACTS} select f.site, descr as description, pages, url from f join sd on f.site = sd.site and descr = value",
    "platform_detect": f"with {_AUD} select page_id, platform from a",
    "pages_scan": f"select page_id, url, {_SITE} as site, length(html) as bytes from pages",
    "url_canonical": f"select page_id, {_CANON} as canonical from pages",
    "page_kind": f"select page_id, split_part(k, ':', 1) as kind, cast(split_part(k, ':', 2) as bigint) as score from (select page_id, {_kind('url')} as k from pages)",
    "url_parts": f"select page_id, {_HOST} as host, {_PATH} as path, {_QUERY} as query, {_DEPTH} as depth, lower(regexp_extract({_PATH}, '(\\.[A-Za-z0-9]+)$', 1)) as extension, coalesce(list_filter(string_split({_PATH}, '/'), lambda x: x <> '')[-1], '') as basename from pages",
    "nodes": r"""with c as (select page_id, regexp_replace(regexp_replace(regexp_replace(html, '<!--.*?-->', '', 'gs'), '<(script|style)[^>]*>.*?</(script|style)>', '<\1>', 'gs'), '(<title>).*?(</title>)', '\1\2', 'gs') as h from pages)
      select page_id, tag, count(*) as n from (select page_id, lower(unnest(regexp_extract_all(h, '<([a-zA-Z][a-zA-Z0-9:-]*)', 1))) as tag from c) group by all""",
    "page_meta": f"""with {_AUD} select page_id, title, regexp_extract(full_html, '<html lang="([^"]*)"', 1) as lang, description, case when i % 4 = 0 then '' when i % 4 = 3 then 'width=1' else 'width=device-width' end as viewport,
      case i % 8 when 5 then 'WordPress 6' when 6 then 'Microsoft FrontPage 4.0' else '' end as generator, case when i % 5 in (1, 3) then regexp_replace(url, '#.*$', '') when i % 5 = 2 then 'https://other.example/' end as canonical from d join a using (page_id, i, title, url)""",
    "page_links": f"with {_LINKS} select page_id, url, count(*) as n from l group by all",
    "crawlable_links": f"with {_CRAWL} select page_id, url, count(*) as n from k group by all",
    "page_headings": f"""with {_PAGES}, h as (select page_id, {_text("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)")} as t from p) select page_id, 1::int as level, 1::int as ord, length(t) as chars from h where t <> '' and length(t) < 140 and not regexp_matches(t, '{P.NAV_WORDS}')""",
    "page_paragraphs": f"with {_PARAS} select page_id, text from q",
    "page_nav": f"""with {_PAGES}, a as (select page_id, unnest(regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '<a href="[^"]*">(.*?)</a>', 1)) as raw, generate_subscripts(regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '<a href="[^"]*">(.*?)</a>', 1), 1) as i from p),
      u as (select page_id, {_text("raw")} as label, i from a), t as (select page_id, arg_min(label, i) as label, min(i) as i from u where label <> '' and length(label) < 40 group by page_id, lower(label)) select page_id, cast(row_number() over (partition by page_id order by i) as integer) as ord, label from t where label <> '' and length(label) < 40 qualify ord <= 20""",
    "page_audit": f"with {_AUD} select page_id, words, h1, has_https, bytes, images, images_no_alt, scripts, tables, layout_tables, has_viewport, has_structured_data, inline_styled, dated, refreshes, flash from a",
    "audit_flags": f"with {_AUD} select page_id, code, n from flags",
    "site_audit": f"with {_AUD} select site, count(*) as pages, coalesce(min_by(platform, page_id) filter (platform <> ''), '') as platform, bool_and(has_viewport) as mobile, bool_and(has_https) as https, bool_or(has_structured_data) as structured_data, cast(sum(images) as bigint) as images, cast(sum(images_no_alt) as bigint) as images_no_alt, cast(sum(words) as bigint) as words, cast(sum(bytes) as bigint) as bytes from a group by site",
    "audit_flag_counts": f"with {_AUD} select site, regexp_replace(text, '[0-9]+', 'N', 'g') as text, count(*) as pages from flags group by all",
    "content_duplicates": f"""with {_PAGES}, b as (select page_id, site, url, html from p union all select page_id + 1000000, site, url, case when page_id % 3 = 0 then html || ' ' when page_id % 3 = 1 and length(html) > 2000 then substr(html, 1, length(html) - 1) || '#' else html end from p where page_id % 5 = 0)
      select page_id, site, url from b qualify row_number() over (partition by site, length(html), substr(html, 1, 2000) order by page_id) > 1""",
    "home_page": f"select site, page_id, url from (select {_SITE} as site, page_id, url, {_kind('url')} like 'home:%' as home from pages) qualify row_number() over (partition by site order by not home, page_id) = 1",
    "frontier_new": f"with {_CRAWL} select distinct site, url from k where page_id % 2 = 1 and (site, url) not in (select (site, url) from k where page_id % 2 = 0)",
    "frontier_topn": f"""with c as (select {_SITE} as site, {_CANON} as u, page_id from pages), k as (select site, u as url, page_id, {_kind('u')} as k from c),
      r as (select site, url, split_part(k, ':', 1) as kind, cast(split_part(k, ':', 2) as bigint) as score, cast(row_number() over (partition by site order by cast(split_part(k, ':', 2) as bigint) desc, page_id) as integer) as ord from k) select * from r where ord <= 20""",
    "crawl_stats": f"with {_LINKS} select site, count(*) as pages, cast(sum(length(html)) as bigint) as bytes, coalesce(any_value(d.n), 0) as discovered from p left join (select site, count(distinct url) as n from l group by site) d using (site) group by site",
    "about_body": f"with {_PARAS} select site, cast(row_number() over (partition by site order by length(text) desc, page_id, i) as integer) as ord, text from q where page_id % 3 in (0, 1) qualify ord <= 4",
    "seo_page_facts": f"with {_FACTS} select page_id, title, title_len, h1, words, links, images, no_alt, length(descr) as desc_len, case when i % 2 = 0 then 'Store' else '' end as schema from f",
    "duplicate_titles": f"with {_PAGES}, t as (select domain, title, count(*) as pages from p where title <> '' group by all having count(*) > 1) select domain as site, title, pages, url from p join t using (domain, title)",
    "orphan_pages": f"with {_FACTS} select page_id, site, url from o",
    "pages_without_place": f"with {_FACTS} select page_id, site from np",
    "seo_findings": f"with {_FIND} select site, level, code, what, url from r",
    "finding_counts": f"with {_FIND} select site, count(*) filter (level = 'high') as high, count(*) filter (level = 'medium') as medium, count(*) filter (level = 'low') as low from r group by site",
    "finding_groups": f"""with {_GROUPED}, g as (select site, shape, count(*) as n, min_by(level, (what, level)) as level from w group by all)
      select site, level, n, array_to_string(list_transform(string_split(shape, '#'), lambda x, k: x || coalesce(spans[k], '')), '') as label from g left join sp using (site, shape)""",
    "items_merge": "select lang, doc_id from documents where text is not null qualify row_number() over (partition by lang, lower(substr(text, 1, 60)) order by doc_id) = 1",
    "squash": f"select doc_id, md5(t) as digest, case when t = '' then 0 else len(string_split(t, ' ')) end as words from (select doc_id, trim(regexp_replace(coalesce(text, ''), '{_SP}', ' ', 'g')) as t from documents)",
    "slug": f"""select doc_id, coalesce(nullif(regexp_replace(substr(regexp_replace(regexp_replace(replace(lower(translate(split_part(coalesce(text, ''), chr(10), 1), '{T.MARKED}', '{T.BARE}')), '&', ' and '), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 60), '-+$', ''), ''), 'item') as slug from documents""",
    "truncate_words": f"""select doc_id, case when length(s) <= 160 then s else regexp_replace(case when length(regexp_extract(substr(s, 1, 159), '(?s)^(.*) ', 1)) > 96 then regexp_extract(substr(s, 1, 159), '(?s)^(.*) ', 1) else substr(s, 1, 159) end, '[,;:.\\-\\s]+$', '') || '…' end as short
      from (select doc_id, trim(regexp_replace(coalesce(text, ''), '{_SP}', ' ', 'g')) as s from documents)""",
}
