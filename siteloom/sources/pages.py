"""Tables of crawled pages and what a crawler found around them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siteloom.functions import url as U

BODY_LIMIT = 5 * 1024 * 1024


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """The page table with its site and its length in characters."""
    return with_site(spark.read.parquet(path))


def with_site(pages: DataFrame) -> DataFrame:
    return pages.withColumn("site", U.site(F.col("url"))).withColumn("bytes", F.length("html").cast("bigint"))


def usable_pages(fetches: DataFrame) -> DataFrame:
    """fetches(url, status, content_type, html, ...) with `reason`: null for a page to keep."""
    kind = F.coalesce("content_type", F.lit(""))
    reason = (
        F.when(~F.col("status").between(200, 299), F.concat(F.lit("HTTP "), F.col("status").cast("string")))
        .when((kind != "") & ~kind.rlike("(?i)html|xhtml|plain|xml"), F.concat(F.lit("Not HTML ("), kind, F.lit(")")))
        .when(F.octet_length("html") > BODY_LIMIT, F.lit("Body too large"))
    )
    return fetches.withColumn("reason", reason)


def sitemap_locations(sitemaps: DataFrame) -> DataFrame:
    """(site, sitemap_url, is_index, ord, loc) from sitemaps(site, sitemap_url, xml)."""
    locations = F.regexp_extract_all("xml", F.lit(r"(?i)<loc>\s*([^<\s]+)\s*</loc>"), F.lit(1))
    return sitemaps.select("site", "sitemap_url", F.col("xml").rlike("(?i)<sitemapindex").alias("is_index"), F.posexplode(locations).alias("ord", "loc"))


def sitemap_urls(sitemaps: DataFrame, max_docs: int = 10, limit: int = 150) -> DataFrame:
    """(site, ord, url): pages of each site that its sitemaps name, indexes followed from /sitemap.xml by repeated joins."""
    found = sitemap_locations(sitemaps)
    order = Window.partitionBy("site")
    level = sitemaps.where(F.col("sitemap_url").endswith("/sitemap.xml")).select("site", "sitemap_url", F.lit("0").alias("at"))
    reached = level
    for _ in range(max_docs - 1):
        level = (
            found.where("is_index").join(level, ["site", "sitemap_url"])
            .select("site", F.col("loc").alias("sitemap_url"), F.concat_ws(".", "at", F.lpad(F.col("ord").cast("string"), 6, "0")).alias("at"))
            .join(reached.select("site", "sitemap_url"), ["site", "sitemap_url"], "left_anti")
        )
        reached = reached.union(level)
        if level.isEmpty():
            break
    ranked = reached.groupBy("site", "sitemap_url").agg(F.min("at").alias("at"))
    ranked = ranked.withColumn("doc", F.row_number().over(order.orderBy(F.length("at"), "at"))).where(F.col("doc") <= max_docs)
    urls = found.where("not is_index").join(ranked, ["site", "sitemap_url"]).where(U.site(F.col("loc")) == F.col("site"))
    first = urls.groupBy("site", F.col("loc").alias("url")).agg(F.min(F.struct("doc", "ord")).alias("at"))
    return first.withColumn("ord", F.row_number().over(order.orderBy("at"))).where(F.col("ord") <= limit).select("site", "ord", "url")


def sitemap_counts(sites: DataFrame, sitemaps: DataFrame) -> DataFrame:
    """(site, pages): number of locations, null where no sitemap could be read."""
    counts = sitemaps.select("site", F.regexp_count("xml", F.lit("(?i)<loc>")).cast("bigint").alias("pages"))
    return sites.select("site").join(counts, "site", "left")


def robots_rules(robots: DataFrame, agent: str = "siteloom") -> DataFrame:
    """(site, allow, path, crawl_delay): rules of the first group that names the agent, else of the first for all.

    An agent line opens a group if there is none yet or a rule stands after the agent line before it; delays don't count as rules.
    The group's last delay counts. A group with a delay and no rule has one row without a path; rules with an empty path allow
    all and are left out.
    """
    lines = robots.select("site", F.posexplode(F.split("text", "\r?\n")).alias("ln", "raw"))
    bare = F.trim(F.regexp_replace("raw", "#.*$", ""))
    parts = lines.select("site", "ln", F.lower(F.trim(F.regexp_extract(bare, "^([^:]+):", 1))).alias("key"), F.trim(F.regexp_extract(bare, "^[^:]+:(.*)$", 1)).alias("value"))
    parts = parts.where(F.col("key").isin("user-agent", "allow", "disallow", "crawl-delay"))
    by = Window.partitionBy("site").orderBy("ln")
    before = F.last(F.when(F.col("key") != "crawl-delay", F.col("key")), ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1))
    opens = (F.col("key") == "user-agent") & (F.coalesce(before, F.lit("")) != "user-agent")
    agents = F.sum(F.when(F.col("key") == "user-agent", 1)).over(by)  # rules before any agent line have no group
    grouped = parts.withColumn("opens", opens).withColumn("agents", agents).where("agents > 0").withColumn("grp", F.sum(F.col("opens").cast("int")).over(by))
    fit = F.when(F.col("key") != "user-agent", None).when((F.col("value") != "*") & F.contains(F.lit(agent.lower()), F.lower("value")), 0).when(F.col("value") == "*", 1)
    chosen = grouped.withColumn("fit", fit).where("fit is not null").groupBy("site").agg(F.min_by("grp", F.struct("fit", "grp")).alias("grp"))
    own = grouped.join(chosen, ["site", "grp"])
    delay = own.where("key = 'crawl-delay'").groupBy("site").agg(F.max_by(F.coalesce(F.col("value").try_cast("double"), F.lit(0.0)), "ln").alias("crawl_delay"))
    rules = own.where("key in ('allow', 'disallow') and value <> ''").select("site", (F.col("key") == "allow").alias("allow"), F.col("value").alias("path"))
    both = rules.join(delay, "site", "left").select("site", "allow", "path", "crawl_delay")
    alone = delay.join(rules.select("site"), "site", "left_anti").select("site", F.lit(None).cast("boolean").alias("allow"), F.lit(None).cast("string").alias("path"), "crawl_delay")
    return both.unionByName(alone)


def robots_allowed(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls(site, url) with `allowed`: the longest matching rule decides, a tie allows, no match allows."""
    target = F.concat(U.path(F.col("url")), U.query(F.col("url")))
    quoted = F.regexp_replace(F.regexp_replace("path", r"[.+?^${}()|\[\]\\]", r"\\$0"), r"\*", ".*")
    pattern = F.concat(F.lit("^"), F.regexp_replace(quoted, r"\\\$$", r"\$"))
    ready = rules.select("site", "allow", F.length(F.replace("path", F.lit("*"), F.lit(""))).alias("len"), pattern.alias("pattern"))
    hit = urls.select("site", "url", target.alias("target")).distinct().join(ready, "site").where("target rlike pattern")
    verdict = hit.groupBy("site", "url").agg(F.max_by("allow", F.struct("len", "allow")).alias("found"))
    return urls.join(verdict, ["site", "url"], "left").withColumn("allowed", F.coalesce("found", F.lit(True))).drop("found")
