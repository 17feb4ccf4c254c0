"""Lempel-Ziv phrase fingerprints.

A text is parsed from left to right into dictionary phrases: each is the shortest run of characters that isn't a
phrase yet. The set of phrases says what a compressor would learn from the text. Its `k` smallest hashes are the
fingerprint; two fingerprints give an estimate of the Jaccard similarity of the phrase sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteloom.llm.common import range_bounds, range_number, shuffle_parts

K = 64
SCHEMA = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
NAMES = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
ARROW = pa.schema(list(zip(NAMES, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()))))
_UTF8 = partial(str.encode, errors="surrogatepass")


def parse(text: str, phrases: set[str] | None = None, phrase: str = "") -> tuple[set[str], str]:
    """The phrases of text after those given, and the last, unfinished phrase."""
    phrases = set() if phrases is None else phrases
    add = phrases.add
    for c in text:
        phrase += c
        if phrase not in phrases:
            add(phrase)
            phrase = ""
    return phrases, phrase


def hashes(phrases: list[str]) -> np.ndarray:
    """A 32-bit hash of each phrase, many at once: polynomial over its UTF-8 bytes, then mixed."""
    if not phrases:
        return np.zeros(0, np.uint32)
    data = list(map(_UTF8, phrases))
    sizes = np.fromiter(map(len, data), np.int64, len(data))
    flat = np.frombuffer(b"".join(data), np.uint8).astype(np.uint64)
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    place = np.arange(len(flat)) - np.repeat(starts, sizes)
    with np.errstate(over="ignore"):
        table = np.cumprod(np.full(int(sizes.max()), 0x9E3779B97F4A7C15, np.uint64))
        x = np.add.reduceat((flat + 1) * table[place], starts)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
    return x.astype(np.uint32)


def lowest(values: np.ndarray, k: int) -> np.ndarray:
    return np.unique(np.partition(values, k * 2)[: k * 2] if len(values) > 4 * k else values)[:k]


def fingerprint(phrases: set[str], rest: str, k: int) -> np.ndarray:
    return lowest(hashes([*phrases, rest] if rest and rest not in phrases else list(phrases)), k)


def likeness(a: np.ndarray, b: np.ndarray, k: int) -> float:
    """Jaccard similarity of two phrase sets by the k smallest hashes of their union; 1 for two empty ones."""
    union = np.union1d(a, b)[:k]
    return float(len(np.intersect1d(np.intersect1d(a, b), union)) / len(union)) if len(union) else 1.0


def shown(print_: np.ndarray) -> str:
    return print_.astype(">u4").tobytes().hex()


def with_next(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """(part, ahead, doc_id, text): ranges of ascending doc_id, each followed by a copy (ahead) of the first row of the next range.

    After the last range comes the table's first row. Rows of one doc_id are ordered by a hash of the text. Every
    text is moved once, and once more for one row of each range.
    """
    n = parts or shuffle_parts(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint"), F.coalesce(F.col("text"), F.lit("")).cast("string").alias("text"))
    tie = F.xxhash64("text")
    number = range_number(F.col("doc_id"), tie, range_bounds(rows, "doc_id", n))
    place = F.struct(F.col("doc_id").isNotNull().alias("known"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"), tie.alias("tie"))
    firsts = rows.select(number.alias("part"), place.alias("place")).groupBy("part").agg(F.min("place").alias("p")).orderBy("part").collect()
    heads = rows.sparkSession.createDataFrame(
        [(*r.p, firsts[i - 1].part) for i, r in enumerate(firsts)], "known boolean, first_id bigint, first_tie bigint, behind int"
    )  # a row for each range, as many as parts at most
    same = (F.col("doc_id").isNotNull() == F.col("known")) & (F.coalesce("doc_id", F.lit(0)) == F.col("first_id")) & (tie == F.col("first_tie"))
    first_texts = rows.join(F.broadcast(heads), same).groupBy("behind").agg(F.min_by(F.struct("doc_id", "text"), "text").alias("r")).select("behind", "r.*")
    own = rows.select(number.alias("part"), F.lit(False).alias("ahead"), "doc_id", "text")
    ahead = first_texts.select(F.col("behind").alias("part"), F.lit(True).alias("ahead"), "doc_id", "text")
    return own.unionByName(ahead).repartitionById(n, "part").sortWithinPartitions("part", "ahead", F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text")


def fingerprint_documents(docs: DataFrame, k: int = K, parts: int | None = None) -> DataFrame:
    """Per row of docs: fingerprint of the text and of its edited text, and how near those are; see SCHEMA.

    The edited text ends in the first characters of the next document instead of its own second half. docs needs
    doc_id and text. A null text counts as empty; empty texts have an empty fingerprint and a likeness of 1 to each
    other, 0 to others. Null doc_ids come first; rows of one doc_id follow each other by a hash of the text; the only
    row of a table is its own next one. Extra columns are ignored; an empty table gives no rows.
    A range of rows streams through its task; one text and its successor are held at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None  # (part, doc_id, text, its fingerprint, phrases and state at the cut)
        out: list[tuple] = []
        for batch in batches:
            for part, ahead, doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                text = text.as_py()
                cut = len(text) - len(text) // 2
                head, phrase = parse(text[:cut])
                whole, rest = parse(text[cut:], set(head), phrase)
                own = fingerprint(whole, rest, k)
                if before is not None and before[0] == part:
                    _, d, t, f, h, p = before
                    half = len(t) // 2
                    edited = t[: len(t) - half] + text[:half]
                    g = fingerprint(*parse(text[:half], h, p), k)
                    out.append((d, len(t), hashlib.sha256(_UTF8(edited)).hexdigest(), shown(f), shown(g), likeness(f, g, k), likeness(f, own, k)))
                    if len(out) >= 2000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, a) for c, a in zip(zip(*out), ARROW.types)], schema=ARROW)
                        out = []
                before = (part, doc, text, own, head, phrase) if not ahead else None
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, a) for c, a in zip(zip(*out), ARROW.types)], schema=ARROW)

    return with_next(docs, parts).mapInArrow(run, SCHEMA)
