"""URL expressions. None of them fails: what isn't a URL gives null or the text itself."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siteloom.functions.once import let

#: Tracking parameters, files that are no pages, images.
TRACKING = "(?i)^(utm_|fbclid|gclid|mc_|ref(=|$)|source(=|$))"
ASSET = r"(?i)\.(pdf|zip|docx?|xlsx?|pptx?|csv|mp4|mp3|avi|mov|wmv|dmg|exe|rar|gz|tgz|svgz)$"
IMAGE = r"(?i)\.(png|jpe?g|gif|webp|avif|svg|ico|bmp)$"
#: Paths that are not worth a visit.
SKIP_PATH = (
    r"(?i)/(wp-admin|wp-login|wp-json|xmlrpc|feed|rss|atom|comments|trackback|cart|checkout|my-account|login|register|signin|signup|search|tag|author"
    r"|category/page|page/\d+|\d{4}/\d{2}|wp-content/uploads)\b|\.(xml|json|txt|css|js)$"
)
#: Queries that are not worth a visit.
SKIP_QUERY = "(?i)replytocom|add-to-cart|orderby|s=|paged="
#: Kind and score of a page by its path, first match first.
PAGE_KINDS = (
    ("^/?$", 100, "home"),
    ("about|our-story|who-we-are|history|company", 90, "about"),
    ("service|what-we-do|treatment|solutions|offerings", 88, "services"),
    ("contact|get-in-touch|locations?|directions", 86, "contact"),
    ("testimonial|review|feedback", 80, "testimonials"),
    ("gallery|portfolio|projects|our-work|photos", 78, "gallery"),
    ("faq|questions", 76, "faq"),
    ("team|staff|our-people|doctors|attorneys", 74, "team"),
    ("pricing|rates|packages|menu", 72, "pricing"),
    ("area|service-area|coverage|neighborhoods", 60, "area"),
)
_HEAD = r"^(?i)(https?)://([^/?#]*)"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _HEAD, 1))


def host(url: Column) -> Column:
    """Lower-case host without user and port; empty if there is none."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.regexp_extract(url, _HEAD, 2), "^.*@", ""), r":\d*$", ""))


def site(url: Column) -> Column:
    return F.regexp_replace(host(url), r"^www\.", "")


def origin(url: Column) -> Column:
    return F.concat(scheme(url), F.lit("://"), F.lower(F.regexp_extract(url, _HEAD, 2)))


def path(url: Column) -> Column:
    found = F.regexp_extract(url, r"^(?i)https?://[^/?#]*([^?#]*)", 1)
    return F.when(found == "", F.lit("/")).otherwise(found)


def query(url: Column) -> Column:
    """With its question mark; empty if there is none."""
    return F.regexp_extract(url, r"^[^?#]*(\?[^#]*)", 1)


def depth(url: Column) -> Column:
    return F.size(F.filter(F.split(path(url), "/"), lambda x: x != "")).cast("bigint")


def extension(url: Column) -> Column:
    return F.lower(F.regexp_extract(path(url), r"(?i)(\.[a-z0-9]+)$", 1))


def basename(url: Column) -> Column:
    last = F.element_at(F.concat(F.array(F.lit("")), F.filter(F.split(path(url), "/"), lambda x: x != "")), -1)
    return F.coalesce(F.try_url_decode(F.replace(last, F.lit("+"), F.lit("%2B"))), last)


def is_asset(url: Column) -> Column:
    return path(url).rlike(ASSET)


def is_image(url: Column) -> Column:
    return path(url).rlike(IMAGE)


def same_site(a: Column, b: Column) -> Column:
    return (site(a) != "") & (site(a) == site(b))


def _encoded(c: Column) -> Column:
    """Characters beyond ASCII and blanks percent-encoded."""
    each = F.transform(F.split(c, ""), lambda x: F.when((F.octet_length(x) > 1), F.url_encode(x)).when(x == " ", F.lit("%20")).otherwise(x))
    return F.when((F.octet_length(c) == F.length(c)) & ~F.contains(c, F.lit(" ")), c).otherwise(F.array_join(each, ""))


def without_dots(p: Column) -> Column:
    """A path without . and .. segments; up to ten levels up."""
    plain = F.regexp_replace(F.regexp_replace(p, r"/(\./)+", "/"), r"/\.$", "/")
    for _ in range(10):
        plain = F.regexp_replace(F.regexp_replace(plain, r"^/\.\.(/|$)", "/"), r"/(?!\.\.(?:/|$))[^/]+/\.\.(/|$)", "/")
    return F.when(F.contains(p, F.lit("/.")), plain).otherwise(p)  # most paths have none


def absolute(href: Column, base: Column) -> Column:
    """href resolved against base, without fragment; null for fragments, other protocols and blanks."""
    h = F.regexp_replace(F.trim(href), "#.*$", "")
    root = origin(base)
    folder = F.regexp_replace(path(base), "[^/]*$", "")
    target = (
        F.when(h.rlike("(?i)^https?://"), F.concat(F.lower(F.regexp_extract(h, "^([^/?]*//[^/?]*)", 1)), F.regexp_extract(h, "^[^/?]*//[^/?]*(.*)$", 1)))
        .when(h.startswith("//"), F.concat(scheme(base), F.lit(":"), h))
        .when(h.startswith("/"), F.concat(root, h))
        .when(h.startswith("?"), F.concat(root, path(base), h))
        .otherwise(F.concat(root, folder, h))
    )
    clean = let(target, lambda t: F.when(host(t) != "", F.concat(F.regexp_extract(t, "^([^/]*//[^/?]*)", 1), let(without_dots(path(t)), _encoded), query(t))))
    bad = F.trim(href).rlike(r"(?i)^(#|$)") | (F.trim(href).rlike(r"(?i)^[a-z][a-z0-9+.-]*:") & ~F.trim(href).rlike("(?i)^https?:"))
    return F.when(href.isNotNull() & ~bad, clean)


def canonical(url: Column) -> Column:
    """Without fragment, tracking parameters and trailing slashes."""
    return let(url, _canonical)


def _canonical(url: Column) -> Column:
    pairs = F.filter(F.split(F.regexp_replace(query(url), r"^\?", ""), "&"), lambda p: (p != "") & ~p.rlike(TRACKING.replace("$)", "(=|$))").replace("ref$", "ref(=|$)")))
    kept = F.array_join(pairs, "&")
    p = F.when(path(url) != "/", F.regexp_replace(path(url), "(?<=.)/+$", "")).otherwise(path(url))
    built = F.concat(origin(url), p, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit("")))
    return F.when(host(url) != "", built).otherwise(url)


def page_kind(url: Column) -> Column:
    """Struct of kind and score."""
    return let(url, _page_kind)


def _page_kind(url: Column) -> Column:
    p = path(url)
    cases = [F.when(p.rlike(f"(?i){rule}"), F.struct(F.lit(kind).alias("kind"), F.lit(score).cast("bigint").alias("score"))) for rule, score, kind in PAGE_KINDS]
    return F.coalesce(*cases, F.struct(F.lit("page").alias("kind"), (40 - 5 * depth(url)).alias("score")))


def crawlable(url: Column) -> Column:
    """Worth a visit: no asset, no skipped path or query, four levels deep at most."""
    return let(url, lambda u: ~is_asset(u) & ~u.rlike(SKIP_PATH) & ~query(u).rlike(SKIP_QUERY) & (depth(u) <= 4))
