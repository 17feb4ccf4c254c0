"""First-match and count-all rule lists: social networks, design themes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Networks by address, first match first.
NETWORKS = (
    ("facebook", r"facebook\.com|fb\.com|fb\.me"), ("instagram", r"instagram\.com|instagr\.am"), ("x", r"twitter\.com|(^|//)x\.com"), ("linkedin", r"linkedin\.com"),
    ("youtube", r"youtube\.com|youtu\.be"), ("tiktok", r"tiktok\.com"), ("pinterest", r"pinterest\."), ("yelp", r"yelp\.com"),
    ("google", r"google\.com/maps|g\.page|goo\.gl/maps"), ("nextdoor", r"nextdoor\."),
)
#: Fixed value: addresses of share widgets.
SHARE = r"(?i)/(sharer|share|intent|dialog|plugins|tr\?|widgets?)\b|[?&](u|url|text)="
#: Words that speak for a theme.
THEMES = (
    ("forge", r"hvac|heating|cooling|air condition|plumb|electric|roof|construct|contractor|excavat|concrete|paving|weld|auto repair|mechanic|towing|garage|tire|collision|septic|drain|gutter|siding|fence|masonry|demolition"),
    ("harvest", r"restaurant|cafe|coffee|bakery|bake|bar\b|brewery|pub\b|catering|caterer|deli\b|butcher|pizzeria|pizza|diner|bistro|food|grill|winery|taproom"),
    ("bloom", r"salon|spa\b|beauty|nail|hair|barber|massage|wellness|yoga|pilates|aesthetic|lash|brow|skincare|florist|flower|boutique|photograph|wedding|event planner|bridal"),
    ("homestead", r"landscap|lawn|garden|tree service|house cleaning|home cleaning|office cleaning|commercial cleaning|cleaning service|carpet clean|window clean|maid|janitor|pest|exterminat|pet care|grooming|kennel|veterinar|childcare|daycare|handyman|moving compan|mover|junk removal|pressure wash|snow removal|nursery"),
    ("beacon", r"technology|agency|marketing|digital|design studio|startup|web design|seo\b|recruit|staffing|coworking|cyber"),
    ("folio", r"software development|software consultancy|bespoke software|consultancy|systems integrat|platform|b2b\b|saas|api\b|data engineer|devops|\bit services\b|technical consult"),
    ("meridian", r"law\b|attorney|legal|account|cpa\b|tax\b|bookkeep|insurance|financial|advisor|wealth|dental|dentist|orthodont|medical|doctor|physician|clinic|chiropract|optometr|therapy|counsel|real estate|realtor|notary|architect|engineer|consult"),
)
DEFAULT_THEME, SURE = "meridian", 3


def network(url: Column) -> Column:
    """The social network of a profile address; null for share widgets and other addresses."""
    return F.when(~url.rlike(SHARE), F.coalesce(*[F.when(url.rlike(f"(?i){rule}"), F.lit(key)) for key, rule in NETWORKS]))


def social_links(links: DataFrame) -> DataFrame:
    """(site, page_id, network, url): the shortest address of each network on a page of links(site, page_id, node_id, url)."""
    known = links.withColumn("network", network(F.col("url"))).where("network is not null")
    return known.groupBy("site", "page_id", "network").agg(F.min_by("url", F.struct(F.length("url"), "node_id")).alias("url"))


def social_merge(pages: DataFrame, stated: DataFrame) -> DataFrame:
    """(site, network, url): the last page's address of each network; stated(site, network, url) fills what is missing."""
    last = pages.groupBy("site", "network").agg(F.max_by("url", "page_id").alias("page_url"))
    both = last.join(stated.groupBy("site", "network").agg(F.min("url").alias("stated_url")), ["site", "network"], "full")
    return both.select("site", "network", F.coalesce("page_url", "stated_url").alias("url"))


def suggest_theme(profiles: DataFrame, fields: list[tuple[str, int]], rules: tuple[tuple[str, str], ...] = THEMES, default: str = DEFAULT_THEME) -> DataFrame:
    """profiles with theme, score and confident: hits of each rule in each field times the field's weight; first best rule."""
    scores = [
        (sum((w * F.regexp_count(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(rule)) for c, w in fields), F.lit(0)).cast("bigint"), i, key) for i, (key, rule) in enumerate(rules)
    ]
    best = F.array_max(F.array(*[F.struct(s.alias("score"), F.lit(-i).alias("first"), F.lit(key).alias("key")) for s, i, key in scores]))
    out = profiles.withColumn("_best", best)
    return out.withColumn("theme", F.when(F.col("_best.score") > 0, F.col("_best.key")).otherwise(default)).withColumn("score", F.col("_best.score")).withColumn("confident", F.col("_best.score") >= SURE).drop("_best")
