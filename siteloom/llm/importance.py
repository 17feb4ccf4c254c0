"""Importance resampling of documents towards a target text, on hashed word features.

An untrained pre-tokeniser of the `tokenizers` library, a Split by a regular expression over ASCII-lowered text, returns
the words with their offsets. Runs of consecutive offset pairs are the features; the CRC-32 of a feature names its bucket.
The histograms of both corpora give each bucket a gain, the sum of a document's gains is its weight, and the highest
weights plus Gumbel noise are a sample without replacement.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siteloom.llm.common import materialize, range_bounds, range_number, shuffle_parts

#: What a word is, after A-Z are lowered.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BREAK = re.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]")
LOWERED = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
SLICE = 1 << 18
KEPT = 1 << 18
FEATURES = "doc_id bigint, n_words bigint, n_features bigint, buckets binary"
ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("buckets", pa.binary())])
HIGHEST = (1 << 63) - 1


@cache
def splitter() -> Callable[[str], list[tuple[str, tuple[int, int]]]]:
    from tokenizers import Regex, pre_tokenizers

    return pre_tokenizers.Split(Regex(WORD), "removed", invert=True).pre_tokenize_str


def slices(text: str) -> Iterator[str]:
    """The ASCII-lowered text in slices that begin at a break, of about SLICE bytes unless a single word is longer."""
    data = text.encode("utf-8", "surrogatepass").translate(LOWERED)
    at = 0
    while at < len(data):
        following = BREAK.search(data, at + SLICE)
        end = following.start() if following else len(data)
        yield data[at:end].decode("utf-8", "surrogatepass")
        at = end


class Buckets(dict[str, int]):
    """The bucket of each feature; keeps so many."""

    def __init__(self, buckets: int) -> None:
        self.n = buckets

    def __missing__(self, feature: str) -> int:
        if len(self) >= KEPT:
            self.clear()
        self[feature] = found = zlib.crc32(feature.encode("utf-8", "surrogatepass")) % self.n
        return found


def text_features(text: str | None, low: int, high: int, of: Buckets, kind: np.dtype) -> tuple[int, int, bytes]:
    """How many words and features a text has, and the bucket of each feature.

    A window of n offset pairs is n consecutive words; what stands between them counts as one space.
    """
    n_words, n_features, out = 0, 0, []
    tail: list[str] = []  # the last words before a slice, for windows across its start
    for piece in slices(text or ""):
        pairs = [pair for _, pair in splitter()(piece)]
        found = tail + [piece[a:b] for a, b in pairs]
        for n in range(low, high + 1):
            first = max(0, len(tail) - n + 1)  # windows that end in this slice
            run = found[first:] if n == 1 else [" ".join(found[i : i + n]) for i in range(first, len(found) - n + 1)]
            out.append(np.fromiter(map(of.__getitem__, run), kind, len(run)).tobytes())
            n_features += len(run)
        n_words += len(pairs)
        tail = found[len(found) - high + 1 :] if high > 1 else []
    return n_words, n_features, b"".join(out)


def hashed_features(texts: DataFrame, low: int = 1, high: int = 1, buckets: int = 10_000) -> DataFrame:
    """(doc_id, n_words, n_features, buckets) of each row of (doc_id, text): buckets are little-endian integers of the least width."""
    kind = np.dtype("<u2" if buckets <= 1 << 16 else "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Buckets(buckets)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                rows = [text_features(t.as_py(), low, high, of, kind) for t in part.column(1)]
                columns = [pa.array([r[i] for r in rows], ARROW.types[i + 1]) for i in range(3)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], schema=ARROW)

    return texts.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, FEATURES)


def histogram(features: DataFrame, buckets: int) -> np.ndarray:
    """How many features each bucket holds: each task sends a sum per bucket."""
    kind = np.dtype("<u2" if buckets <= 1 << 16 else "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for blob in batch.column(0):
                total += np.bincount(np.frombuffer(blob.as_buffer(), kind), minlength=buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["bucket", "n"])

    sums = features.select("buckets").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in sums.collect():  # one row per bucket
        out[r.bucket] = r.n
    return out


def bucket_gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of how much likelier a bucket is in the target), with one feature added to each bucket."""
    k, all_raw, all_target = len(raw), int(raw.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (all_raw + k) / ((s + 1) * (all_target + k)))) for s, t in zip(raw.tolist(), target.tolist())], np.int64)


def weighed(features: DataFrame, gains: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight): the sum of the gains of a document's features."""
    kind = np.dtype("<u2" if len(gains) <= 1 << 16 else "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weight = [int(gains[np.frombuffer(blob.as_buffer(), kind)].sum()) for blob in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(weight, pa.int64())], names=["doc_id", "n_words", "n_features", "weight"])

    return features.mapInArrow(run, "doc_id bigint, n_words bigint, n_features bigint, weight bigint")


def ranked(scored: DataFrame, may: str, percent: int) -> DataFrame:
    """scored with `rank`: 1, 2, 3... for the floor(percent / 100) highest scores of the rows that fulfil `may`, ties to the smaller doc_id.

    Rows are dealt into ranges of descending score; the counts of the ranges, a few numbers, make ranks within ranges
    global. Only ranges that reach into the draw are sorted. A null doc_id comes after all others of its score.
    """
    down, tie = -F.col("score"), F.coalesce("doc_id", F.lit(HIGHEST))
    able = scored.where(may).withColumn("_down", down)
    n = shuffle_parts(scored.sparkSession)
    number = range_number(F.col("_down"), tie, range_bounds(able, "_down", n))
    able = able.withColumn("_part", number)
    counts = {r._part: r.n for r in able.groupBy("_part").agg(F.count("*").alias("n")).collect()}  # one row per range
    draw = sum(counts.values()) * percent // 100
    before, at = {}, 0
    for part in sorted(counts):
        if at < draw:
            before[part] = at
        at += counts[part]
    last = max(before, default=-1)  # ranges up to this one hold what is drawn
    offset = F.get(F.lit([before.get(i, 0) for i in range(last + 1)] or [0]).cast("array<bigint>"), F.col("_part"))
    order = Window.partitionBy("_part").orderBy("_down", F.col("doc_id").asc_nulls_last(), "n_features")
    rank = offset + F.row_number().over(order)
    inside = able.where(F.col("_part") <= last).repartitionById(n, "_part").withColumn("rank", F.when(rank <= draw, rank))
    outside = able.where(F.col("_part") > last).withColumn("rank", F.lit(None).cast("bigint"))
    unable = scored.where(F.coalesce(~F.expr(may), F.lit(True))).withColumn("rank", F.lit(None).cast("bigint"))
    columns = [*scored.columns, "rank"]
    return inside.select(columns).unionByName(outside.select(columns)).unionByName(unable.select(columns))


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, buckets: int = 10_000, low: int = 1, high: int = 1, seed: int = 2024) -> DataFrame:
    """Per row of docs: doc_id, n_features, weight, score, rank (null: not drawn).

    docs needs doc_id and text, target a text. Null, empty and wordless texts have no features and a weight of 0, and
    are not drawn, for want of words. A null doc_id draws the noise of an empty one and comes last among equals. Repeated
    rows get ranks of their own, one after the other. Extra columns are ignored; an empty table gives no rows; an
    empty target leaves every bucket the same share. Long texts are split slice by slice.
    """
    features = materialize(hashed_features(docs.select("doc_id", "text"), low, high, buckets), "features")
    wanted = hashed_features(target.select(F.lit(None).cast("bigint").alias("doc_id"), "text"), low, high, buckets)
    gains = bucket_gains(histogram(features, buckets), histogram(wanted, buckets))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = materialize(weighed(features, gains).withColumn("score", F.col("weight") + noise), "scores")
    return ranked(scored, f"n_words >= {int(least_words)}", percent).select("doc_id", "n_features", "weight", "score", "rank")
