"""Registered queries on structured data: pages written in Spark from suppliers and their nations, read back through the node table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteloom.operators import brand as B
from siteloom.operators import content as X
from siteloom.operators import jsonld as J
from siteloom.operators import media as M
from siteloom.operators import places as A
from siteloom.operators.nodes import node_table
from siteloom.operators.state import spread, written
from siteloom.sources import social as O


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph with a business, a nested review and a trailing comma; every tenth page has broken JSON instead."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").join(spark.read.parquet(f"{sf_dir}/nation.parquet"), F.col("s_nationkey") == F.col("n_nationkey"))
    body = F.to_json(F.struct(
        F.lit("Plumber").alias("@type"), F.concat(F.lit("  "), "s_name").alias("name"), F.col("s_suppkey").cast("string").alias("telephone"),
        F.struct(F.col("n_name").alias("addressLocality")).alias("address"), F.array(F.lit("Fr-Mo 09:00-17:30"), F.lit("Tu noon")).alias("openingHours"),
        F.struct(F.lit("Review").alias("@type"), F.lit("Good").alias("reviewBody")).alias("review"),
    ))
    script = F.concat(F.lit('{"@graph": [{"@type": "WebSite", "name": "x"}, '), body, F.lit(",]}"))
    html = F.concat(F.lit("<html><head><script type='application/ld+json'>"), F.when(F.col("s_suppkey") % 10 == 0, "{broken").otherwise(script), F.lit("</script></head><body><p>x</p></body></html>"))
    return s.select(F.lower("n_name").alias("site"), F.col("s_suppkey").alias("page_id"), html.alias("html"))


def _objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(J.jsonld_nodes(node_table(_pages(spark, sf_dir))), "objects")


def jsonld_nodes(spark, sf_dir):
    return _objects(spark, sf_dir).groupBy("site", F.col("types")[0].alias("type")).agg(F.count("*").alias("n"))


def jsonld_profile(spark, sf_dir):
    return J.jsonld_profile(_objects(spark, sf_dir)).select("page_id", "name", "category", "phone", "city")


def jsonld_hours(spark, sf_dir):
    return J.jsonld_hours(_objects(spark, sf_dir)).select("page_id", "day", "opens", "closes", "closed")


def _css(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule per part in the sheet of its brand: background, text colour, a transparent and a black one, a font by size."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    shade = F.concat(F.lit("#"), F.lpad(F.lower(F.hex((F.col("p_size") * 5000 + 17).cast("bigint"))), 6, "0"))
    rule = F.concat(F.lit(".p{background:"), shade, F.lit(";color:#123abc;border-color:rgba(1,2,3,0);fill:#000;font-family:'F"), (F.col("p_size") % 7).cast("string"), F.lit("',serif}"))
    return p.select(F.col("p_brand").alias("site"), rule.alias("css"))


def css_colours(spark, sf_dir):
    return B.css_colours(_css(spark, sf_dir))


def brand_fonts(spark, sf_dir):
    return B.brand_fonts(B.css_fonts(_css(spark, sf_dir))).select("site", "heading", "body")


def css_fonts(spark, sf_dir):
    """Families by part: shorthands, quotes, generic names, and families that links load."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    k, site = F.col("p_partkey"), F.col("p_brand").alias("site")
    css = p.select(site, F.concat(F.lit("a{font: 12px/1.5 Own, 'K"), (k % 9).cast("string"), F.lit("' , Arial}b{font-family:var(--x),Georgia;}c{font-family:\"Lost\",x}")).alias("css"))
    pages = p.where("p_partkey % 10 = 3").select(site, k.alias("page_id"), F.lit("<link href='https://fonts.googleapis.com/css?family=Open+Sans:400&family=K1'><link href='https://x.example/?family=No'>").alias("html"))
    return B.css_fonts(css, node_table(pages))


def brand_palette(spark, sf_dir):
    return B.brand_palette(B.css_colours(_css(spark, sf_dir))).select("site", F.size("palette").cast("bigint").alias("colours"), "primary", "secondary", "accent")


def _content(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A page per supplier: a grid of three services (two for every fifth), a team list, a question, a quote, a lazy image, a mail link."""
    s = spread(spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey"), "s_suppkey")
    k = F.col("s_suppkey").cast("string")
    card = lambda n: F.concat(F.lit(f"<div class='card big x{n}'><h3>Repair {n} of "), k, F.lit("</h3><p>We repair all that breaks.</p></div>"))
    html = F.concat(
        F.lit("<html><body><main><h2>Our services</h2><div class='grid'>"), card(1), card(2), F.when(F.col("s_suppkey") % 5 == 0, "").otherwise(card(3)),
        F.lit("</div><h2>The team</h2><ul><li><b>Ann "), k, F.lit("</b><p>Owner of it all</p></li><li><b>Bob Ray</b><p>Technician here</p></li><li><b>Cy Poe</b><p>Office manager</p></li></ul><h3>Do you serve area "), k,
        F.lit("?</h3><p>Yes, every day of the week.</p><blockquote>They came out the same day, all of them. <cite>- Customer "), k,
        F.lit("</cite></blockquote><div class='my-testimonials'><p>Truly the best crew in town, twice.</p><strong>Mr "), k, F.lit("</strong></div><div class='review'><p>Too short.</p></div><details><summary>Is it dear "), k,
        F.lit("?</summary>No, it is not that dear.</details><h2>Why us "), k, F.lit("?</h2><p></p><p>Because we are good at it.</p><h4>No answer?</h4><h4>Next</h4><div class='accordion-x'><i class='subtitle'>Folded?</i><b>Unfolded at last</b></div>"),
        F.when(F.col("s_suppkey") % 4 == 0, "<p>FAQs page</p>").otherwise("<p>No page of them</p>"), F.lit("<img src='data:x' data-src='img/"), k, F.lit(".jpg'><a href='mailto:service@x.org'>service</a></main></body></html>"))
    pages = s.select(F.lit("s.example").alias("site"), F.col("s_suppkey").alias("page_id"), F.lit("https://s.example/d/p.html").alias("url"), html.alias("html"))
    return pages, node_table(pages)


def repeated_blocks(spark, sf_dir):
    nodes = _content(spark, sf_dir)[1]
    found = X.block_labels(X.repeated_blocks(nodes), nodes)
    return found.select("page_id", "signature", "items", "label")


def page_services(spark, sf_dir):
    return X.page_services(_content(spark, sf_dir)[1]).select("page_id", "ord", "name", "summary")


def page_team(spark, sf_dir):
    return X.page_team(_content(spark, sf_dir)[1]).select("page_id", "ord", "name", "role")


def page_faqs(spark, sf_dir):
    return X.page_faqs(_content(spark, sf_dir)[1]).select("page_id", "question", "answer")


def page_testimonials(spark, sf_dir):
    return X.page_testimonials(_content(spark, sf_dir)[1]).select("page_id", "quote", "author")


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five kinds of page by key: an American address element, a British footer, marked-up properties, an address in the text, near misses only."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    k, i = F.col("s_suppkey").cast("string"), F.col("s_suppkey") % 5
    kind = lambda n, *parts: F.when(i == n, F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]))
    html = F.coalesce(
        kind(0, "<body><p>Order 12 Main, Nowhere</p><address>Visit: ", k, " North Grand Avenue East, Suite B<br> , Springfield, IL 62702</address><div class='hours'>Mon - Fri: 7:00am - 5:30pm<br>Saturday: 8am - noon<br>Sun Closed</div></body>"),
        kind(1, "<body><footer>Call us Address Unit ", k, " Bourne Centre, Wrotham Rd, Borough Green, Sevenoaks TN15 8DG</footer><aside>Sat to Mon 10-16, Tuesday by appointment only</aside></body>"),
        kind(2, "<body><b itemprop=streetAddress>", k, " High St</b><i itemprop=addressLocality>Lon don</i><footer>1 Main St, Springfield, IL 62701</footer><p>Mon 9:30 - 5</p></body>"),
        kind(3, "<body><p>We are at ", k, " Oak Rd, Salem, or 97301-1234 now.</p><p>Open Mon-Wed 9 to 17; Monday 8-9; Thurs: 13:15 – 21</p></body>"),
        F.lit("<body><p>?ver=bd3d6ba style=e433be, 10 Main things, Il 627</p><footer>Monday to Friday</footer></body>"),
    )
    return node_table(s.select(F.lit("s.example").alias("site"), F.col("s_suppkey").alias("page_id"), html.alias("html")))


def page_address(spark, sf_dir):
    return A.page_address(_places(spark, sf_dir)).drop("site")


def page_hours(spark, sf_dir):
    return A.page_hours(_places(spark, sf_dir)).drop("site")


def _gallery_pages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A page per part in the site of its brand: lazy and sized images with roles by key, trackers, spacers, backgrounds."""
    p = spread(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_brand"), "p_partkey")
    k, i = F.col("p_partkey").cast("string"), F.col("p_partkey")
    some = lambda n, r, *parts: F.when(i % n == r, F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])).otherwise("")
    html = F.concat(
        F.lit("<body><header><img src='data:x' data-src='/head.jpg' alt='Head'></header><img src='https://pixel.example/t.gif'><img src='/spacer.gif'><img src='/tiny"), k, F.lit(".png' width=1><img src='/wide"), k,
        F.lit(".jpg' width=700 title='Big one'><img data-srcset='/s"), k, F.lit("-400.jpg 400w, /s"), k, F.lit("-1200.jpg 1200w' alt=' A  b '>"),
        some(3, 0, "<img src='/img/logo", k, ".png'>"), some(4, 1, "<img class=staff src='/p", k, ".jpg' width=200>"), some(5, 2, "<div class='Top banner' style='color:red;background: url(/bg", k, ".jpg)'></div>"), some(6, 1, "<p style=\"background-image:url('/b", k, ".webp')\"></p>"),
        some(7, 3, "<img src='/sq", k, ".png' width=64 height=64>"), some(8, 3, "<img src='/wide", k, ".jpg' alt=again>"), F.lit("</body>"))
    pages = p.select(F.lower(F.replace("p_brand", F.lit("#"), F.lit("-"))).alias("site"), F.col("p_partkey").alias("page_id"), F.lit("https://p.example/d/").alias("url"), html.alias("html"))
    pages = written(pages, "pages")
    return pages, node_table(pages)


def page_images(spark, sf_dir):
    return M.page_images(*_gallery_pages(spark, sf_dir)).select("page_id", "url", "alt", "title", "width", "height", "role")


def _picked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    pages, nodes = _gallery_pages(spark, sf_dir)
    images = written(M.site_images(M.page_images(pages, nodes)), "images")
    shared = pages.select("site").distinct().withColumn("image", F.when(F.length("site") % 2 == 0, "https://p.example/og.jpg"))
    return images, M.logo_pick(pages, nodes, images), M.hero_pick(images, shared)


def logo_pick(spark, sf_dir):
    return _picked(spark, sf_dir)[1]


def hero_pick(spark, sf_dir):
    return _picked(spark, sf_dir)[2]


def gallery_pick(spark, sf_dir):
    return M.gallery_pick(*_picked(spark, sf_dir))


def asset_list(spark, sf_dir):
    images, logos, heroes = _picked(spark, sf_dir)
    return M.asset_list(images, logos, heroes, M.gallery_pick(images, logos, heroes))


def _children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects of a site on several pages: offers by name or item, a list with and without services, questions, reviews, people, a business on some."""
    c = spread(spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_nationkey"), "c_custkey")
    k, i = F.col("c_custkey").cast("string"), F.col("c_custkey")
    some = lambda n, r, *parts: F.when(i % n == r, F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])).otherwise("")
    script = F.concat(
        F.lit('{"@graph": [{"@type": "WebSite"}'), some(2, 0, ', {"@type": "Offer", "itemOffered": {"name": "Job ', k, '"}, "price": ', k, ', "image": {"contentUrl": "/o.png"}}'), some(3, 0, ', {"@type": ["Service"], "name": ["S ', k, '"], "description": " d  e "}'),
        some(5, 0, ', {"@type": "ItemList", "itemListElement": [{"@type": "ListItem", "item": {"@type": "Product", "name": "P ', k, '"}}, {"@type": "ListItem", "item": "no"}]}'),
        some(4, 1, ', {"@type": "FAQPage", "mainEntity": [{"name": "Q ', k, '?", "acceptedAnswer": {"text": "<p>Yes &amp; no</p>"}}, {"name": "Empty?"}]}'), some(4, 2, ', {"@type": "Question", "name": "Alone ', k, '?", "acceptedAnswer": "So it is"}'),
        some(7, 0, ', {"@type": "Review", "reviewBody": "Good <b>job</b>", "author": {"name": "Ann ', k, '"}, "reviewRating": {"ratingValue": "', (i % 6).cast("string"), '"}, "datePublished": "2026-01-0', (i % 9 + 1).cast("string"), '"}, {"@type": "Review", "author": "none"}'),
        some(6, 5, ', {"@type": "https://schema.org/Person", "name": "Bo ', k, '", "jobTitle": "Boss", "image": "/bo.jpg"}'),
        some(8, 3, ', {"@type": "Dentist", "name": "D ', k, '", "telephone": "', (i % 16).cast("string"), '", "email": "", "logo": {"url": "/l', k, '.png"}, "sameAs": ["https://x.com/', k, '", {"@id": "https://yelp.com/', k, '"}]}'), F.lit("]}"))
    html = F.concat(F.lit('<script type="application/ld+json">'), script, F.lit("</script>"))
    pages = c.select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("site"), i.alias("page_id"), html.alias("html"))
    return written(J.jsonld_nodes(node_table(pages)), "objects")


def jsonld_children(spark, sf_dir):
    return J.jsonld_children(_children(spark, sf_dir)).drop("site", "ord")


def jsonld_stated(spark, sf_dir):
    """Addresses and logos that businesses state."""
    found = _children(spark, sf_dir)
    return J.jsonld_social(found).select("page_id", F.lit("sameAs").alias("kind"), F.col("url").alias("value")).unionByName(J.jsonld_logo(found).select("page_id", F.lit("logo").alias("kind"), F.col("logo").alias("value")))


def patch_merge(spark, sf_dir):
    """The merged leaves beside how many rows of each kind the last page's lists hold."""
    found = _children(spark, sf_dir)
    leaves, lists = J.patch_merge(J.jsonld_profile(found), J.jsonld_children(found))
    counts = lists.groupBy("site").agg(*[F.count_if(F.col("kind") == k).cast("bigint").alias(k) for k in ("service", "faq", "review", "person")])
    return leaves.select("site", "name", "phone", "email", "category").join(counts, "site", "full").fillna(0, ["service", "faq", "review", "person"])


def _fetched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' pages on three networks: failures, login walls, empty pages and readable ones with counts."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    k, i = F.col("c_custkey").cast("string"), F.col("c_custkey")
    html = F.when(i % 5 == 1, F.concat(F.lit("<title>Log in to Page "), k, F.lit("</title>"))).when(i % 5 == 2, F.lit("<p>nothing</p>")).when(
        i % 5 == 3, F.concat(F.lit("<title>T</title><meta property='og:title' content='Shop "), k, F.lit("'><meta name=description content='"), k, F.lit(",5K followers. Rated 4.5 by 1,2"), k, F.lit(" reviews'><meta property='og:image' content=/i.png>"))).when(
        i % 5 == 4, F.concat(F.lit("<title> Shop  "), k, F.lit(" </title><meta property=og:description content='4.8 out of 5 · 12 people like this'><meta name=description content=other>")))
    return c.select(F.concat(F.lit("c"), k).alias("site"), F.element_at(F.array(F.lit("facebook"), F.lit("x"), F.lit("other")), (i % 3 + 1).cast("int")).alias("network"), F.concat(F.lit("https://net.example/"), k).alias("url"),
                    F.when(i % 5 == 0, "HTTP 404").alias("error"), html.alias("html"))


def social_profile_status(spark, sf_dir):
    return O.social_status(_fetched(spark, sf_dir)).select("site", "label", "status", "title", "image", "followers", "rating", "review_count", F.length("note").cast("bigint").alias("note_chars"))


def social_gaps(spark, sf_dir):
    return O.social_gaps(O.social_status(_fetched(spark, sf_dir)))


def css_sources(spark, sf_dir):
    """Style tags, style attributes and sheets of pages by part: icon sheets and a site's seventh and later sheets are left out."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet").where("p_partkey <= 40 or p_partkey % 3 = 0")
    k, i = F.col("p_partkey").cast("string"), F.col("p_partkey")
    pages = p.select(F.concat(F.lit("s"), (i % 25).cast("string")).alias("site"), i.alias("page_id"), F.concat(F.lit("<style>p{top:"), k, F.lit("}</style><p style='left:"), k, F.lit("'>x</p><p style>")).alias("html"))
    sheets = p.select(F.concat(F.lit("s"), (i % 25).cast("string")).alias("site"), F.concat(F.when(i % 4 == 0, "/icons/").otherwise("/css/"), F.lpad(k, 9, "0"), F.lit(".css")).alias("url"), F.concat(F.lit("a{b:"), k, F.lit("}")).alias("css"))
    return B.css_sources(node_table(pages), sheets.unionByName(sheets))


QUERIES = [
    jsonld_nodes, jsonld_profile, jsonld_hours, css_colours, css_fonts, brand_fonts, brand_palette, repeated_blocks, page_services, page_team, page_faqs, page_testimonials, page_images, page_address, page_hours, logo_pick, hero_pick, gallery_pick,
    asset_list, jsonld_children, jsonld_stated, patch_merge, social_profile_status, social_gaps, css_sources,
]
_S = "s as (select * from supplier join nation on s_nationkey = n_nationkey where s_suppkey % 10 <> 0)"
_IMG = """b as (select p_partkey as i, p_partkey as page_id, lower(replace(p_brand, '#', '-')) as site, 'https://p.example' as o from part),
m as (select page_id, site, o || u as url, alt, title, width, height, role, later, nth from (
  select *, unnest(['/head.jpg', '/wide' || i || '.jpg', '/s' || i || '-1200.jpg', case when i % 3 = 0 then '/img/logo' || i || '.png' end, case when i % 4 = 1 then '/p' || i || '.jpg' end, case when i % 7 = 3 then '/sq' || i || '.png' end,
      case when i % 5 = 2 then '/bg' || i || '.jpg' end, case when i % 6 = 1 then '/b' || i || '.webp' end]) as u, unnest(['Head', '', 'A b', '', '', '', '', '']) as alt, unnest(['', 'Big one', '', '', '', '', '', '']) as title, unnest([null, 700, null, null, 200, 64, null, null]) as width,
    unnest([null, null, null, null, null, 64, null, null]) as height, unnest(['content', 'content', 'content', 'logo', 'team', 'icon', 'hero', 'background']) as role, unnest([0, 0, 0, 0, 0, 0, 1, 1]) as later, unnest([1, 2, 3, 4, 5, 6, 7, 8]) as nth from b) where u is not null)"""
_PICK = f"""{_IMG}, si as (select site, url, min_by(alt, (page_id, later, nth)) as alt, min_by(title, (page_id, later, nth)) as title, min_by(width, (page_id, later, nth)) as width, min_by(role, (page_id, later, nth)) as role, cast(row_number() over (partition by site order by min((page_id, later, nth))) as integer) as ord from m group by site, url),
logo as (select site, coalesce(min_by(url, ord) filter (role = 'logo'), 'https://p.example/head.jpg') as url, case when count(*) filter (role = 'logo') > 0 then min_by(alt, ord) filter (role = 'logo') else 'Head' end as alt from si group by site),
hero as (select site, coalesce(min_by(url, ord) filter (role = 'hero'), case when length(site) % 2 = 0 then 'https://p.example/og.jpg' end, min_by(url, ord) filter (width >= 600), min_by(url, ord) filter (role not in ('logo', 'icon'))) as url, '' as alt from si group by site),
gal as (select * from (select si.site, cast(row_number() over (partition by si.site order by si.ord) as integer) as ord, si.url as src, si.alt, title as caption, case when role = 'team' then 'team' else '' end as category from si where role not in ('logo', 'icon', 'background') and coalesce(width >= 300, true)
  and (si.site, si.url) not in (select (site, url) from logo) and (si.site, si.url) not in (select (site, url) from hero)) where ord <= 24)"""
_KID = """c as (select c_custkey as i, c_custkey as page_id, 'n' || c_nationkey as site from customer),
kid as (select site, page_id, 'service' as kind, 'Job ' || i as name, '' as text, '' as role, '/o.png' as image, i::varchar as price, null::double as rating, '' as date from c where i % 2 = 0
  union all select site, page_id, 'service', 'S ' || i, 'd e', '', '', '', null, '' from c where i % 3 = 0 union all select site, page_id, 'service', 'P ' || i, '', '', '', '', null, '' from c where i % 5 = 0
  union all select site, page_id, 'faq', 'Q ' || i || '?', 'Yes &amp; no', '', '', '', null, '' from c where i % 4 = 1 union all select site, page_id, 'faq', 'Alone ' || i || '?', 'So it is', '', '', '', null, '' from c where i % 4 = 2
  union all select site, page_id, 'review', 'Ann ' || i, 'Good job', '', '', '', nullif(i % 6, 0)::double, '2026-01-0' || (i % 9 + 1) from c where i % 7 = 0 union all select site, page_id, 'person', 'Bo ' || i, '', 'Boss', '/bo.jpg', '', null, '' from c where i % 6 = 5)"""
_SOCIAL = """n as (select c_custkey as i, c_custkey::varchar as k, 'c' || c_custkey as site, case c_custkey % 3 when 0 then 'Facebook' when 1 then 'X' else 'other' end as label, 'https://net.example/' || c_custkey as url,
  case c_custkey % 5 when 0 then 'unreachable' when 1 then 'login-walled' when 2 then 'login-walled' else 'ok' end as status, case c_custkey % 5 when 1 then 'Log in to Page ' || c_custkey when 3 then 'Shop ' || c_custkey when 4 then 'Shop ' || c_custkey else '' end as title from customer)"""
ORACLES = {
    "jsonld_nodes": f"with {_S} select lower(n_name) as site, type, count(*) as n from s, (select unnest(['WebSite', 'Plumber', 'Review']) as type) group by all",
    "jsonld_profile": f"with {_S} select s_suppkey as page_id, s_name as name, 'Plumber' as category, s_suppkey::varchar as phone, n_name as city from s",
    "jsonld_hours": f"with {_S} select s_suppkey as page_id, unnest([4, 5, 6, 0])::integer as day, '9:00 AM' as opens, '5:30 PM' as closes, false as closed from s",
    "css_colours": "select p_brand as site, '#' || lower(printf('%06x', p_size * 5000 + 17)) as hex, cast(3 * count(*) as bigint) as score, count(*) as uses from part group by all union all select p_brand, '#123abc', cast(2 * count(*) as bigint), count(*) from part group by p_brand",
    "brand_fonts": """with f as (select p_brand as site, 'F' || (p_size % 7) as font, count(*) as n from part group by all), r as (select site, font, row_number() over (partition by site order by n desc, font) as k from f)
      select site, max(font) filter (k = 1) as heading, coalesce(max(font) filter (k = 2), max(font) filter (k = 1)) as body from r group by site""",
    "brand_palette": """with c as (select p_brand as site, p_size * 5000 + 17 as v, 3.0 * count(*) as score from part group by all union all select p_brand, 1194684, 2.0 * count(*) from part group by p_brand),
      x as (select *, '#' || lower(printf('%06x', v)) as hex, (v // 65536) / 255.0 as r, (v // 256 % 256) / 255.0 as g, (v % 256) / 255.0 as b from c), y as (select *, greatest(r, g, b) as hi, least(r, g, b) as lo from x),
      z as (select *, (hi + lo) / 2 as l, hi - lo as d, case when hi = lo then 0 else (hi - lo) / (1 - abs(hi + lo - 1)) end as s, case when hi = lo then 0 when hi = r then 60 * (((g - b) / (hi - lo)) - 6 * floor((g - b) / (hi - lo) / 6)) when hi = g then 60 * ((b - r) / (hi - lo) + 2) else 60 * ((r - g) / (hi - lo) + 4) end as h from y),
      t as (select site, hex, h, s > 0.2 and l between 0.1 and 0.9 as vivid, row_number() over (partition by site order by score * (0.35 + s * (1 - abs(l - 0.5) * 2)) desc, hex) as nth from z qualify nth <= 12),
      w as (select *, row_number() over (partition by site order by nth) as k from t where vivid), one as (select site, hex, h from w where k = 1),
      far as (select w.*, least(abs(w.h - one.h), 360 - abs(w.h - one.h)) as gap from w join one using (site)), two as (select site, coalesce(min_by(hex, k) filter (gap > 25), min_by(hex, k) filter (k = 2)) as hex from far group by site),
      three as (select far.site, min_by(far.hex, k) as hex from far join two on far.site = two.site where gap > 60 and far.hex <> two.hex group by far.site)
      select n.site, n.colours, coalesce(one.hex, '') as primary, coalesce(two.hex, '') as secondary, coalesce(three.hex, '') as accent from (select site, count(*) as colours from t group by site) n left join one using (site) left join two using (site) left join three using (site)""",
    "repeated_blocks": "select s_suppkey as page_id, 'div.big.card' as signature, 3::bigint as items, 'our services' as label from supplier where s_suppkey % 5 <> 0 union all select s_suppkey, 'li.', 3, 'the team' from supplier",
    "page_services": "select s_suppkey as page_id, n::integer as ord, 'Repair ' || n || ' of ' || s_suppkey as name, 'We repair all that breaks.' as summary from supplier, (select unnest([1, 2, 3]) as n) where s_suppkey % 5 <> 0",
    "page_team": "select s_suppkey as page_id, unnest([1, 2, 3])::integer as ord, unnest(['Ann ' || s_suppkey, 'Bob Ray', 'Cy Poe']) as name, unnest(['Owner of it all', 'Technician here', 'Office manager']) as role from supplier",
    "page_faqs": """select s_suppkey as page_id, question, answer from (select s_suppkey, unnest(['Do you serve area ' || s_suppkey || '?', 'Is it dear ' || s_suppkey || '?', 'Folded?', case when s_suppkey % 4 = 0 then 'Why us ' || s_suppkey || '?' end]) as question,
      unnest(['Yes, every day of the week.', 'No, it is not that dear.', 'Unfolded at last', 'Because we are good at it.']) as answer from supplier) where question is not null""",
    "page_testimonials": "select s_suppkey as page_id, unnest(['They came out the same day, all of them.', 'Truly the best crew in town, twice.']) as quote, unnest(['Customer ' || s_suppkey, 'Mr ' || s_suppkey]) as author from supplier",
    "css_fonts": """with p as (select p_brand as site, p_partkey as k from part), f as (select site, 'K' || k % 9 as font, 1 as n from p union all select site, 'Georgia', 1 from p union all select site, unnest(['Open Sans', 'K1']), 5 from p where k % 10 = 3)
      select site, font, cast(sum(n) as bigint) as n from f group by all""",
    "page_address": """select s_suppkey as page_id, a[1] as street, a[2] as street2, a[3] as city, a[4] as region, a[5] as postal_code, a[6] as country, a[7] as confidence from (select s_suppkey, case s_suppkey % 5
        when 0 then [s_suppkey || ' North Grand Avenue East', 'Suite B', 'Springfield', 'IL', '62702', 'US', 'medium'] when 1 then ['Unit ' || s_suppkey || ' Bourne Centre, Wrotham Rd, Borough Green', '', 'Sevenoaks', '', 'TN15 8DG', 'GB', 'medium']
        when 2 then [s_suppkey || ' High St', '', 'Lon don', '', '', '', 'high'] when 3 then [s_suppkey || ' Oak Rd', '', 'Salem', 'OR', '97301-1234', 'US', 'low'] end as a from supplier) where a is not null""",
    "page_hours": """with h as (select * from (values (0, 0, false, '7:00 AM', '5:30 PM', '', 'medium'), (0, 1, false, '7:00 AM', '5:30 PM', '', 'medium'), (0, 2, false, '7:00 AM', '5:30 PM', '', 'medium'), (0, 3, false, '7:00 AM', '5:30 PM', '', 'medium'),
        (0, 4, false, '7:00 AM', '5:30 PM', '', 'medium'), (0, 5, false, '8:00 AM', '12:00 PM', '', 'medium'), (0, 6, true, '', '', '', 'medium'), (1, 5, false, '10:00 AM', '4:00 PM', '', 'medium'), (1, 6, false, '10:00 AM', '4:00 PM', '', 'medium'),
        (1, 0, false, '10:00 AM', '4:00 PM', '', 'medium'), (1, 1, true, '', '', 'by appointment only', 'medium'), (3, 0, false, '9:00 AM', '5:00 PM', '', 'low'), (3, 1, false, '9:00 AM', '5:00 PM', '', 'low'), (3, 2, false, '9:00 AM', '5:00 PM', '', 'low'),
        (3, 3, false, '1:15 PM', '9:00 PM', '', 'low')) t(i, day, closed, opens, closes, note, confidence))
      select s_suppkey as page_id, day, closed, opens, closes, note, confidence from supplier join h on s_suppkey % 5 = i""",
    "page_images": f"with {_IMG} select page_id, url, alt, title, width, height, role from m",
    "logo_pick": f"with {_PICK} select site, url, alt from logo",
    "hero_pick": f"with {_PICK} select site, url, alt from hero",
    "gallery_pick": f"with {_PICK} select site, ord, src, alt, caption, category from gal",
    "asset_list": f"""with {_PICK}, z as (select site, 0 as part, 0 as o, 'logo' as role, url, alt from logo union all select site, 1, 0, 'hero', url, alt from hero union all select site, 2, ord, 'gallery', src, alt from gal union all select site, 3, ord, 'team', url, alt from si where role = 'team'),
      y as (select site, url, min((part, o)) as place, min_by(role, (part, o)) as role, min_by(alt, (part, o)) as alt from z group by all), x as (select *, cast(row_number() over (partition by site order by place) as integer) as ord from y)
      select site, ord, role, url, alt, role || '-' || lpad(ord::varchar, 2, '0') || '-' || regexp_replace(regexp_extract(url, '([^/]*)\\.[a-z]+$', 1), '[^a-z0-9]+', '-', 'g') || regexp_extract(url, '\\.[a-z]+$') as file from x where ord <= 40""",
    "jsonld_children": f"with {_KID} select page_id, kind, name, text, role, image, price, rating, date from kid",
    "jsonld_stated": "select c_custkey as page_id, kind, value from (select c_custkey, unnest(['sameAs', 'sameAs', 'logo']) as kind, unnest(['https://x.com/' || c_custkey, 'https://yelp.com/' || c_custkey, '/l' || c_custkey || '.png']) as value from customer where c_custkey % 8 = 3)",
    "patch_merge": f"""with {_KID}, biz as (select 'n' || c_nationkey as site, c_custkey as page_id from customer where c_custkey % 8 = 3), hit as (select site, max(page_id) as page_id from (select site, page_id from kid union all select site, page_id from biz) group by site),
      b as (select site, max(page_id) as last from biz group by site)
      select h.site, case when last is not null then 'D ' || last end as name, (last % 16)::varchar as phone, case when last is not null then '' end as email, case when last is not null then 'Dentist' end as category,
        (select count(*) from kid where kid.page_id = h.page_id and kind = 'service') as service, (select count(*) from kid where kid.page_id = h.page_id and kind = 'faq') as faq, (select count(*) from kid where kid.page_id = h.page_id and kind = 'review') as review,
        (select count(*) from kid where kid.page_id = h.page_id and kind = 'person') as person from hit h left join b using (site)""",
    "social_profile_status": f"""with {_SOCIAL} select site, label, status, title, case i % 5 when 3 then '/i.png' else '' end as image, case i % 5 when 3 then k || ',5K' when 4 then '12' end as followers, case i % 5 when 3 then '4.5' when 4 then '4.8' end as rating,
      case i % 5 when 3 then '1,2' || k end as review_count, case status when 'unreachable' then 27 when 'login-walled' then length(label) + 125 else 0 end::bigint as note_chars from n""",
    "social_gaps": f"with {_SOCIAL} select site, label as network, url, 'Open ' || url || ' while signed in and copy: the bio/about text, the 6–10 best photos, any recent posts worth featuring, and the review score if there is one.' as ask from n where status <> 'ok'",
    "css_sources": """with p as (select p_partkey as k, 's' || p_partkey % 25 as site from part where p_partkey <= 40 or p_partkey % 3 = 0)
      select site, 'p{top:' || k || '}' as css from p union all select site, 'x{left:' || k || '}' from p union all select site, 'x{style}' from p union all select site, 'a{b:' || k || '}' from (select * from p where k % 4 <> 0 qualify row_number() over (partition by site order by k) <= 6)""",
}
