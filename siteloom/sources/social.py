"""Fetched pages of social networks: what an anonymous request could read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteloom.functions import text as T
from siteloom.operators.nodes import html_nodes
from siteloom.operators.pages import attr

#: Names of the networks, words of login walls, counts in descriptions.
LABELS = {
    "facebook": "Facebook", "instagram": "Instagram", "x": "X", "linkedin": "LinkedIn", "youtube": "YouTube", "tiktok": "TikTok", "pinterest": "Pinterest", "yelp": "Yelp", "google": "Google Business", "nextdoor": "Nextdoor",
}
WALL = "(?i)log in|login|sign up to see|content isn't available|page isn't available|restricted"
FOLLOWERS = r"(?i)([\d,.]+[KMB]?)\s*(?:followers|likes|people like this)"
RATING = r"(?i)([\d.]+)\s*(?:out of|/)\s*5|rated\s*([\d.]+)"
REVIEWS = r"(?i)([\d,]+)\s*reviews?"


def read_social_pages(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table (site, network, url, error, html): html is null where the request failed, error says why."""
    return spark.read.parquet(path).select("site", "network", "url", "error", "html")


def social_status(fetched: DataFrame) -> DataFrame:
    """(site, network, label, url, status, title, description, image, followers, rating, review_count, note) of social pages.

    status: unreachable without a page; login-walled if title or description say so or both are empty; else ok.
    """
    labels = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    rows = fetched.withColumn("key", F.xxhash64("site", "network", "url"))
    nodes = html_nodes(rows.where("html is not null").select("site", F.col("key").alias("page_id"), "html").distinct())
    name = F.lower(F.coalesce(F.nullif(attr("property"), F.lit("")), attr("name"), F.lit("")))
    meta = nodes.where("tag in ('meta', 'title')").groupBy("page_id").agg(
        *[F.max_by(T.squash(attr("content")), F.when((F.col("tag") == "meta") & (name == k) & (attr("content") != ""), F.col("node_id"))).alias(a) for k, a in (("og:title", "og_title"), ("og:description", "og_description"), ("description", "plain"), ("og:image", "image"))],
        T.squash(F.min_by("text", F.when(F.col("tag") == "title", F.col("node_id")))).alias("own_title"),
    )
    read = rows.join(meta.withColumnRenamed("page_id", "key"), "key", "left")
    some = lambda *c: F.coalesce(*[F.nullif(F.col(x), F.lit("")) for x in c], F.lit(""))
    out = read.select("site", "network", F.coalesce(F.try_element_at(labels, F.col("network")), F.col("network")).alias("label"), "url", "error", F.col("html").isNotNull().alias("ok"),
                      some("og_title", "own_title").alias("title"), some("og_description", "plain").alias("description"), some("image").alias("image"))
    walled = F.concat_ws(" ", "title", "description").rlike(WALL) | ((F.col("title") == "") & (F.col("description") == ""))
    status = F.when(~F.col("ok"), "unreachable").when(walled, "login-walled").otherwise("ok")
    found = lambda p, i: F.nullif(F.regexp_extract("description", p, i), F.lit(""))
    note = F.when(F.col("status") == "unreachable", F.concat(F.lit("Could not fetch ("), F.coalesce("error", F.lit("")), F.lit(")."))).when(
        F.col("status") == "login-walled", F.concat(F.col("label"), F.lit(" returned a login wall to an anonymous request. Ask the client for access, or copy the bio, recent posts and photos manually."))).otherwise("")
    return out.withColumn("status", status).select(
        "site", "network", "label", "url", "status", "title", "description", "image", found(FOLLOWERS, 1).alias("followers"), F.coalesce(found(RATING, 1), found(RATING, 2)).alias("rating"), found(REVIEWS, 1).alias("review_count"), note.alias("note"))


def social_gaps(status: DataFrame) -> DataFrame:
    """(site, network, url, ask): what to ask for where a page couldn't be read."""
    ask = F.concat(F.lit("Open "), "url", F.lit(" while signed in and copy: the bio/about text, the 6–10 best photos, any recent posts worth featuring, and the review score if there is one."))
    return status.where("status <> 'ok'").select("site", F.col("label").alias("network"), "url", ask.alias("ask"))
