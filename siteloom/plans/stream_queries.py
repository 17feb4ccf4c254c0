"""The streaming jobs over tables as feeds: files of a table arrive one after the other, and what the jobs wrote is returned."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteloom.operators.state import ensure_checkpoint_dir
from siteloom.plans import estate_queries, page_queries
from siteloom.streaming import jobs


def _arrive(parts: list[DataFrame], folder: str) -> None:
    for df in parts:
        df.coalesce(1).write.mode("append").parquet(folder)


def stream_new_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages arrive in two lots; half of them come back five days later, and a quarter late, dated a month before. Each address of a site is reported once."""
    folder = f"{ensure_checkpoint_dir(spark)}/feed-{uuid.uuid4().hex}"
    at = lambda days: F.timestamp_seconds(F.lit(1_767_225_600 + days * 86_400) + F.col("page_id") % 3600).alias("seen_at")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    lot = lambda rule, days: pages.where(rule).select("page_id", "url", at(days))
    lots = [lot("page_id % 2 = 0", 0), lot("page_id % 4 = 1", 1), lot("page_id % 4 < 2", 6), lot("page_id % 4 = 3", -30)]
    _arrive(lots, f"{folder}/in")
    feed = spark.readStream.schema(lots[0].schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    jobs.stream_new_pages(feed, "seen_at", f"{folder}/seen", f"{folder}/state").awaitTermination()
    return spark.read.option("basePath", f"{folder}/seen").parquet(f"{folder}/seen").select("site", "canonical")


def stream_scan_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan runs arrive in lots of whole days, oldest first; the issues are those of all runs at once."""
    folder = f"{ensure_checkpoint_dir(spark)}/scans-{uuid.uuid4().hex}"
    runs = estate_queries._scans(spark, sf_dir)
    first, last = runs.agg(F.min("run_ts"), F.max("run_ts")).first()
    cuts = [first + (last - first) * k / 3 for k in (1, 2)]
    day = F.col("run_ts")
    _arrive([runs.where(day <= F.lit(cuts[0])), runs.where((day > F.lit(cuts[0])) & (day <= F.lit(cuts[1]))), runs.where(day > F.lit(cuts[1]))], f"{folder}/in")
    feed = spark.readStream.schema(runs.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    jobs.stream_scan_issues(feed, f"{folder}/baseline", f"{folder}/issues", f"{folder}/state").awaitTermination()
    return spark.read.option("basePath", f"{folder}/issues").parquet(f"{folder}/issues").select("domain", F.col("run_ts").alias("day"), "ord", "level")


QUERIES = [stream_new_pages, stream_scan_issues]
ORACLES = {
    "stream_new_pages": f"select distinct {page_queries._SITE} as site, {page_queries._CANON} as canonical from pages",
    "stream_scan_issues": estate_queries.ORACLES["scan_issues"],
}
