"""Token ids of a corpus in ORC files that are in order of document id.

The files use what ORC has for this: run-length encoded integers, row indexes and Bloom filters on doc_id,
and stripes that are read by as many tasks. Files hold ascending ranges of document ids, so the statistics of
files, stripes and row groups leave out what a lookup by id doesn't need.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siteloom.llm.common import materialize, range_bounds, range_number, shuffle_parts
from siteloom.llm.tokens import each_text, encoder

FILE_SCHEMA = "doc_id bigint, part int, part_start bigint, ids array<int>"
ARROW = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("part_start", pa.int64()), ("ids", pa.list_(pa.int32()))])
BATCH_IDS = 4_000_000


def write_tokens(
    docs: DataFrame,
    path: str,
    tokenizer: str = "byte_bpe_50k.json",
    end_id: int = 0,
    parts: int | None = None,
    stripe_bytes: int = 16 << 20,
    index_rows: int = 1000,
    bloom_fpp: float = 0.01,
) -> None:
    """Encode every text, append end_id, write (doc_id, part, part_start, ids) as ORC.

    part numbers the ranges of document ids, null first; part_start counts the ids before a document in its
    part. Rows of one doc_id are ordered by a hash of the text, and an id with very many rows spans several parts.
    A null or empty text has the end id alone.
    The texts are dealt into ranges once; encoding streams through each sorted range and keeps one batch.
    """
    n = parts or shuffle_parts(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    part = range_number(F.col("doc_id"), F.xxhash64("text"), range_bounds(rows, "doc_id", n))
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, start, own = encoder(tokenizer).encode, 0, None
        out: list[tuple[int | None, int, int]] = []
        blobs: list[bytes] = []

        def flush() -> pa.RecordBatch:
            ends = [0]
            for b in blobs:
                ends.append(ends[-1] + len(b) // 4)
            ids = pa.Array.from_buffers(pa.int32(), ends[-1], [None, pa.py_buffer(b"".join(blobs))])
            columns = [pa.array([r[i] for r in out], ARROW.types[i]) for i in range(3)]
            batch = pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), ids)], schema=ARROW)
            out.clear()
            blobs.clear()
            return batch

        for batch in batches:
            held = 0
            for doc, p, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), each_text(encode, batch.column(2))):
                if p != own:
                    own, start = p, 0
                blobs.append(ids + end)
                out.append((doc, p, start))
                start += len(blobs[-1]) // 4
                held += len(blobs[-1]) // 4
                if held >= BATCH_IDS:
                    yield flush()
                    held = 0
            if out:
                yield flush()

    (
        rows.withColumn("part", part)
        .repartitionById(n, "part")
        .sortWithinPartitions("part", F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
        .select("doc_id", "part", "text")
        .mapInArrow(run, FILE_SCHEMA)
        .write.mode("error")
        .option("compression", "zstd")
        .option("orc.stripe.size", stripe_bytes)
        .option("orc.create.index", True)
        .option("orc.row.index.stride", index_rows)
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", bloom_fpp)
        .orc(path)
    )


def read_tokens(spark: SparkSession, path: str, doc_ids: Sequence[int] | None = None) -> DataFrame:
    """The rows of the files; doc_ids, if given, is pushed down to the indexes and Bloom filters."""
    rows = spark.read.schema(FILE_SCHEMA).orc(path)
    return rows if doc_ids is None else rows.where(F.col("doc_id").isin(list(doc_ids)))


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(3)
            flat, ends = memoryview(ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)).cast("B"), ids.offsets.to_pylist()
            crc = [zlib.crc32(flat[4 * i : 4 * j]) for i, j in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array([j - i for i, j in zip(ends, ends[1:])], pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "part", "part_start", "n_tokens", "ids_crc32"],
            )

    each = read_tokens(spark, path).mapInArrow(sums, "doc_id bigint, part int, part_start bigint, n_tokens bigint, ids_crc32 bigint")
    each = materialize(each, "token-index")  # the files are read once; what follows needs these few numbers only
    totals = each.groupBy("part").agg(F.sum("n_tokens").alias("ids_here"))
    # One row per part: the window runs over file ranges, not documents.
    before = totals.select("part", (F.sum("ids_here").over(Window.orderBy("part")) - F.col("ids_here")).alias("before"))
    return each.join(F.broadcast(before), "part").select("doc_id", (F.col("before") + F.col("part_start")).alias("start"), "n_tokens", "ids_crc32")
