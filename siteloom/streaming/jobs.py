"""The two streaming jobs: new pages of an arriving feed, and issues of arriving scan runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siteloom.functions import url as U
from siteloom.operators.monitor import scan_issues


def stream_new_pages(feed: DataFrame, event_time: str, seen: str, checkpoint: str) -> StreamingQuery:
    """Each canonical address of a site once, however late it comes back or arrives; feed needs url and an event time.

    seen holds a folder per batch with the addresses that were new in it, which is both the result and what later batches
    are compared with. Only a batch's own addresses are looked up, so the stored ones are scanned, not shuffled, while
    the batch is small. A batch that is repeated after a failure sees the folders before it and overwrites its own.
    """
    keyed = feed.withColumn("site", U.site(F.col("url"))).withColumn("canonical", U.canonical(F.col("url"))).where("canonical is not null")
    schema = keyed.schema

    def batch(rows: DataFrame, number: int) -> None:
        spark, key = rows.sparkSession, ["site", "canonical"]
        first = rows.groupBy(*key).agg(F.min_by(F.struct(*rows.columns), F.struct(event_time, "url")).alias("r")).select("r.*")
        if number:
            known = spark.read.schema(schema).option("basePath", seen).parquet(*[f"{seen}/batch={n}" for n in range(number)]).select(*key)
            first = first.join(known.join(first.select(*key), key, "left_semi"), key, "left_anti")
        first.write.mode("overwrite").parquet(f"{seen}/batch={number}")

    return keyed.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_scan_issues(runs: DataFrame, baseline: str, issues: str, checkpoint: str) -> StreamingQuery:
    """Issues of arriving runs against the last run of their domain.

    baseline holds a folder per batch with the last run of every domain so far; issues one per batch. A batch that is
    repeated after a failure reads the same baseline and overwrites its own folders, so nothing is reported twice.
    """
    schema = runs.schema

    def batch(new: DataFrame, number: int) -> None:
        spark = new.sparkSession
        old = spark.createDataFrame([], schema) if number == 0 else spark.read.schema(schema).parquet(f"{baseline}/batch={number - 1}")
        both = new.unionByName(old)
        fresh = new.select("domain", "run_ts").distinct()
        scan_issues(both).join(fresh, ["domain", "run_ts"], "left_semi").write.mode("overwrite").parquet(f"{issues}/batch={number}")
        latest = both.groupBy("domain").agg(F.max_by(F.struct(*both.columns), "run_ts").alias("r")).select("r.*")
        latest.write.mode("overwrite").parquet(f"{baseline}/batch={number}")

    return runs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
