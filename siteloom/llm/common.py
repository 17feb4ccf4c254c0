"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections import Counter
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = "[\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOWEST = -(1 << 63)
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only for a local master that names none."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder.rstrip("/")
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="siteloom-"))
    return shared_dir(spark)


def work_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    path = work_path(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that materialize() wrote and that no later plan reads: what was made from them must be written by now."""
    for df in tables:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
        path = jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(conf).delete(path, True)


def small(table: DataFrame, rows: int = 200_000) -> DataFrame:
    """The written table, marked for broadcast if it has at most so many rows, which must be short; else joins shuffle."""
    return F.broadcast(table) if table.count() <= rows else table


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, even where body uses it inside other lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """Runs of other characters than SPACES; none for a null or blank text."""
    bare = F.trim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE_RUN))


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, other letters as they are."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def range_bounds(df: DataFrame, column: str, parts: int) -> list[tuple[int, int]]:
    """At most parts - 1 ascending bounds (value, hash) that cut an integer column into ranges of about equal row counts.

    A value with many rows gets several bounds, at even distances of a 64-bit hash; null counts as the lowest value.
    """
    if parts < 2:
        return []
    value = F.coalesce(F.col(column).cast("bigint"), F.lit(LOWEST))
    cuts = df.agg(F.percentile_approx(value, [i / parts for i in range(1, parts)], max(10_000, 20 * parts))).first()[0]
    many = Counter(cuts or [])
    return [(v, LOWEST + k * ((1 << 64) // n)) for v, n in sorted(many.items()) for k in range(n)]


def range_number(column: Column, tie: Column, bounds: list[tuple[int, int]]) -> Column:
    """How many bounds are at most (value, tie), by binary search. tie, a 64-bit hash, is computed only if a value has several bounds."""
    if not bounds:
        return F.lit(0)
    tied = any(h != LOWEST for _, h in bounds)
    values, hashes = (F.lit([x[i] for x in bounds]).cast("array<bigint>") for i in (0, 1))
    value = F.coalesce(column.cast("bigint"), F.lit(LOWEST))
    steps = len(bounds).bit_length() + 1

    def search(own: Column) -> Column:
        def halve(at: Column, _: Column) -> Column:
            mid = F.floor((at["lo"] + at["hi"]) / 2).cast("int")
            below = F.get(values, mid) < own["v"]
            go_up = below | ((F.get(values, mid) == own["v"]) & (F.get(hashes, mid) <= own["h"])) if tied else below | (F.get(values, mid) == own["v"])
            return F.when(at["lo"] >= at["hi"], at).otherwise(
                F.struct(F.when(go_up, mid + 1).otherwise(at["lo"]).alias("lo"), F.when(go_up, at["hi"]).otherwise(mid).alias("hi"))
            )

        start = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve)["lo"]

    return let(F.struct(value.alias("v"), (tie if tied else F.lit(LOWEST)).alias("h")), search)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one range after the other."""
    ends = np.cumsum(lengths)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def shuffle_parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node of the component of every node of the edges.

    Alternates large-star and small-star steps until no edge changes. A step groups with a minimum, which
    combines before the shuffle, and joins it back, which adaptive execution can split for a hub.
    """
    pairs = edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where("hi <> lo").distinct()
    pairs = materialize(pairs, "edges")
    seen = None
    while True:
        around = pairs.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(pairs.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = around.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct()
        root = large.groupBy("hi").agg(F.min("lo").alias("m"))
        joined = large.join(root, "hi")
        small = joined.select("hi", F.col("m").alias("lo")).union(joined.select(F.col("lo").alias("hi"), F.col("m").alias("lo"))).where("hi <> lo").distinct()
        before, pairs = pairs, materialize(small, "edges")
        discard(before)
        now = pairs.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("hi", "lo").cast("decimal(20,0)")), F.lit(0))).first()
        if now == seen:
            break
        seen = now
    return pairs.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(
        pairs.select(F.col("lo").alias("node"), F.col("lo").alias("root"))
    ).distinct()


def bounded_sample(docs: DataFrame, rows: int) -> DataFrame:
    """About so many rows of docs, chosen by a hash of id and text; all of them where there are no more."""
    total, slots = docs.count(), 1 << 20
    return docs if total <= rows else docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(slots)) < int(slots * rows / total))
