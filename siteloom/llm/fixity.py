"""Merkle fixity audit of WARC collections.

Records lie in archives at ordered offsets. The leaves of a tree are hashes of records; consecutive leaves of an
offset range are hashed together, ranges are hashed together by a fixed fan-out up to the archive, and archives up
to one root for the collection. Two replicas are compared from the root down: only the children of nodes that
differ are joined, so an intact replica costs one comparison and damage costs its path and its range.

Archives can be written as WARC files and read back: write_archives() and read_archives(). The audit itself needs places
and digests only.
"""

from __future__ import annotations

import gzip
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siteloom.llm.common import materialize

FANOUT = 64
#: Pages whose ids fall in one run of so many share archives; an archive holds about ARCHIVE_RECORDS of them.
ID_RUN = 1024
ARCHIVE_RECORDS = 4096


#: The pages have no time of capture; records need one.
DATE = "2026-01-01T00:00:00Z"
RECORD_END = "\r\n\r\n"
HEADER = re.compile(rb"WARC/1\.[01]\r\n(?:[^\r\n]+\r\n)*?Content-Length: (\d+)\r\n(?:[^\r\n]+\r\n)*\r\n", re.I)


def warc_record(url: Column, html: Column, date: str = DATE) -> Column:
    """A WARC resource record, without the two line ends after it. Its id follows from address and payload."""
    body, address = F.coalesce(html, F.lit("")), F.coalesce(url, F.lit(""))
    h = F.md5(F.concat(address, F.lit(" "), body))
    uuid = F.concat_ws("-", *[F.substring(h, i, n) for i, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:uuid:"), uuid, F.lit(f">\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), address,
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit(RECORD_END), body,
    )


def archive_layout(pages: DataFrame) -> DataFrame:
    """(page_id, digest, length, copies, archive, piece, offset): where each record of pages lies.

    Archives are runs of ids; one with many records is cut into pieces by digest, so a repeated id makes no large
    one. Equal records are stored once, with a count. A null page_id comes first in archive 0; offsets start at 0 in a piece.
    """
    record = warc_record(F.col("url"), F.col("html"))
    each = pages.select(F.col("page_id").cast("bigint"), F.sha2(record, 256).alias("digest"), (F.octet_length(record) + len(RECORD_END)).cast("bigint").alias("length"))
    distinct = each.groupBy("page_id", "digest", "length").agg(F.count("*").alias("copies"))
    rows = distinct.withColumn("archive", F.coalesce(F.floor(F.col("page_id") / ID_RUN), F.lit(0)).cast("bigint"))
    pieces = rows.groupBy("archive").agg(F.ceil(F.count("*") / ARCHIVE_RECORDS).alias("pieces"))
    rows = rows.join(pieces, "archive").withColumn("piece", F.pmod(F.conv(F.substring("digest", 1, 8), 16, 10).cast("bigint"), "pieces").cast("int"))
    before = Window.partitionBy("archive", "piece").orderBy(F.col("page_id").asc_nulls_first(), "digest").rowsBetween(Window.unboundedPreceding, -1)
    return rows.select("page_id", "digest", "length", "copies", "archive", "piece", F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset"))


def write_archives(pages: DataFrame, folder: str) -> None:
    """The archives of pages as gzipped WARC files, one for each piece of an archive, in the order of archive_layout()."""
    record = warc_record(F.col("url"), F.col("html"))
    each = pages.select(F.col("page_id").cast("bigint"), record.alias("record")).withColumn("digest", F.sha2("record", 256))
    once = each.groupBy("page_id", "digest").agg(F.any_value("record").alias("record"))  # equal records meet before the shuffle
    place = archive_layout(pages).select(F.col("page_id").alias("_id"), F.col("digest").alias("_digest"), "archive", "piece", "offset")
    placed = once.join(place, F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")))
    rows = placed.repartition("archive", "piece").sortWithinPartitions("archive", "piece", "offset").select("archive", "piece", "record")
    rows.write.partitionBy("archive", "piece").option("compression", "gzip").option("lineSep", RECORD_END).text(folder)


def records_in(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, record) of what can be read; after bytes that are no record it goes on at the next header."""
    at = 0
    while (m := HEADER.search(data, at)) is not None:
        end = m.end() + int(m[1])
        if end > len(data):  # cut short, or a length that is damaged itself
            at = m.start() + 1
            continue
        yield m.start(), end + len(RECORD_END) - m.start(), data[m.start() : end]
        at = end


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """(archive, piece, offset, length, digest) of every record that the WARC files under the folder hold; a task holds one file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, piece, content in zip(*(batch.column(i) for i in range(3))):
                found = [(archive.as_py(), piece.as_py(), at, n, hashlib.sha256(r).hexdigest()) for at, n, r in records_in(gzip.decompress(content.as_py()))]
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found) if found else [[]] * 5, types)], names=["archive", "piece", "offset", "length", "digest"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder)
    return files.select(F.col("archive").cast("bigint"), F.col("piece").cast("int"), "content").mapInArrow(run, "archive bigint, piece int, offset bigint, length bigint, digest string")


def parents(nodes: DataFrame, up: list[Column], order: list[str]) -> DataFrame:
    """One level up: the hashes of a parent's children in order. A parent has FANOUT children, or the records of a range."""
    ordered = F.array_sort(F.collect_list(F.struct(*order, "hash")))
    return nodes.groupBy(*up).agg(F.sha2(F.array_join(F.transform(ordered, lambda x: x["hash"]), ""), 256).alias("hash"))


def extent(records: DataFrame) -> tuple[int, int, int, int] | None:
    """Largest offset and piece, smallest and largest archive; None for an empty table."""
    far = records.agg(F.max("offset"), F.max("piece"), F.min("archive"), F.max("archive")).first()
    return None if far[0] is None else tuple(far)


def merkle_tree(records: DataFrame, far: tuple[int, int, int, int], range_bytes: int = 65_536, fanout: int = FANOUT) -> list[DataFrame]:
    """Levels from the records up to one root row.

    records: archive, piece, offset, digest. Level 0 has a hash per record, level 1 per offset range, then
    ranges are joined by fanout within a piece, pieces within an archive, archives by fanout. Each level is written,
    so a comparison reads the levels it needs. How many levels there are follows from `far`, the extent of both
    replicas, so that they have trees of one shape.
    """
    leaf = records.select("archive", "piece", F.floor(F.col("offset") / range_bytes).alias("n"), "offset", F.sha2("digest", 256).alias("hash"))
    levels = [materialize(leaf, "leaves")]
    node = parents(leaf, [F.col("archive"), F.col("piece"), F.col("n")], ["offset"])
    levels.append(materialize(node, "ranges"))
    height = far[0] // range_bytes
    while height > 0:
        node, height = parents(levels[-1], [F.col("archive"), F.col("piece"), F.floor(F.col("n") / fanout).alias("n")], ["n"]), height // fanout
        levels.append(materialize(node, "ranges"))
    width, node = far[1], levels[-1].select("archive", F.col("piece").cast("bigint").alias("n"), "hash")
    levels.append(materialize(node, "pieces"))
    while width > 0:
        node, width = parents(levels[-1], [F.col("archive"), F.floor(F.col("n") / fanout).alias("n")], ["n"]), width // fanout
        levels.append(materialize(node, "pieces"))
    width = far[3] - far[2]  # archives are numbered from the lowest from here up
    levels.append(materialize(levels[-1].select((F.col("archive") - far[2]).alias("n"), "hash"), "archives"))
    while width > 0:
        node, width = parents(levels[-1], [F.floor(F.col("n") / fanout).alias("n")], ["n"]), width // fanout
        levels.append(materialize(node, "archives"))
    return levels


def differing(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """The keys of nodes that one side lacks or that have other hashes, with both hashes."""
    keys = [c for c in ours.columns if c != "hash"]
    both = ours.withColumnRenamed("hash", "expected").join(theirs.withColumnRenamed("hash", "found"), keys, "full")
    return both.where(~F.col("expected").eqNullSafe(F.col("found")))


def audit(ours: list[DataFrame], theirs: list[DataFrame], lowest: int, fanout: int = FANOUT) -> DataFrame:
    """(archive, piece, n, offset, expected, found): the records that differ, reached through differing nodes only.

    lowest: the lowest archive. Both trees need the same number of levels: build both with one extent. expected is
    null for a record that only the replica has, found for one that it lacks.
    """
    bad = differing(ours[-1], theirs[-1]).drop("expected", "found")
    for i in range(len(ours) - 2, -1, -1):
        below = [c for c in ours[i].columns if c != "hash"]
        above = bad.columns
        if "archive" in below and "archive" not in above:  # an archive's number is its node's
            link = bad.select((F.col("n") + lowest).alias("archive")).distinct()
            on = ["archive"]
        elif "piece" in below and "piece" not in above:
            link, on = bad.select("archive", F.col("n").cast("int").alias("piece")).distinct(), ["archive", "piece"]
        elif "offset" in below:
            link, on = bad.select("archive", "piece", "n"), ["archive", "piece", "n"]
        else:
            link, on = bad.withColumnRenamed("n", "up"), [c for c in above if c != "n"] + ["up"]

        def part(level: DataFrame) -> DataFrame:
            up = level.withColumn("up", F.floor(F.col("n") / fanout)) if "up" in on else level
            return up.join(link, on, "left_semi").drop("up")  # noqa: B023

        bad = materialize(differing(part(ours[i]), part(theirs[i])), "differing")
        if i:
            bad = bad.drop("expected", "found")
    return bad


def fixity_audit(pages: DataFrame, replica: DataFrame, range_bytes: int = 65_536) -> DataFrame:
    """Per damaged record: archive, piece, offset, page_id, length, copies, damage, digest, found_digest.

    replica has what a read of the copy gave: archive, piece, offset, digest; no row where nothing could be read. damage is
    changed, missing, or extra for a record of the replica at a place where pages have none; then page_id, length, copies
    and digest are null. pages needs page_id, url and html; nulls are empty strings there, a null page_id lies
    in archive 0, extra columns are ignored, empty tables give no rows. Repeated rows of replica count once.
    """
    place = ["archive", "piece", "offset"]
    layout = materialize(archive_layout(pages), "layout")
    read = materialize(replica.groupBy(*[F.col(c).cast(t).alias(c) for c, t in zip(place, ("bigint", "int", "bigint"))]).agg(F.min("digest").alias("digest")), "replica")
    far = extent(layout.select(*place).unionByName(read.select(*place)))
    if far is None:
        bad = layout.select(*place).where("false")
    else:
        bad = audit(merkle_tree(layout, far, range_bytes), merkle_tree(read, far, range_bytes), far[2]).select(*place)
    both = bad.join(layout, place, "left").join(read.withColumnRenamed("digest", "found_digest"), place, "left")
    damage = F.when(F.col("digest").isNull(), "extra").when(F.col("found_digest").isNull(), "missing").otherwise("changed")
    return both.select(*place, "page_id", "length", "copies", damage.alias("damage"), "digest", "found_digest")
