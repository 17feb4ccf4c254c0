"""Repeated byte strings across a corpus, by interval expansion on Burrows-Wheeler transforms.

A window is a string of `length` bytes. The least hash of its `gram`-byte strings is its key, so equal windows have equal keys.
Consecutive windows of one key are a segment; segments are dealt by key, and all windows that may be equal meet.
Of equal segments only the first is looked at further: every window of the others starts earlier, too. The bytes of
segments whose key occurs again are joined into blocks of whole keys. On the Burrows-Wheeler transform of a block, intervals
of suffixes are extended to the left breadth first, which finds the lengths of common prefixes by increasing
value; it stops before `length`, and what no boundary parts by then are the equal windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siteloom.llm.common import discard, materialize, range_bounds, range_number, ranges, shuffle_parts

LENGTH, GRAM = 100, 40
CHUNK = 1 << 18
#: Windows of a segment at most; where a text repeats itself, the next segment goes on.
LONGEST = 512
AGAIN = 1 << 15
ROWS_AT_ONCE = 1_000_000
BLOCK_BYTES = 1 << 20
#: A key with more different segments is dealt anew, by whole windows.
HOT = 20_000
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX[0]
    x = (x ^ (x >> np.uint64(27))) * MIX[1]
    return x ^ (x >> np.uint64(31))


class Hasher:
    """64-bit hashes of substrings: polynomials with a random value per byte."""

    BASE = 0x9E3779B97F4A7C15

    def __init__(self, most: int) -> None:
        self.of_byte = np.random.default_rng(2024).integers(0, 1 << 64, 256, np.uint64)
        inverse = pow(self.BASE, -1, 1 << 64)
        one = np.ones(1, np.uint64)
        self.up, self.down = (np.concatenate((one, np.cumprod(np.full(most, b, np.uint64)))) for b in (self.BASE, inverse))

    def prefix(self, data: np.ndarray) -> np.ndarray:
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.of_byte[data] * self.up[: len(data)], out=out[1:])
        return out

    def of(self, prefix: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        return mixed((prefix[starts + lengths] - prefix[starts]) * self.down[starts] + lengths.astype(np.uint64))

    def all_of(self, prefix: np.ndarray, length: int) -> np.ndarray:
        """The hash of each substring of one length."""
        n = len(prefix) - length
        return mixed((prefix[length:] - prefix[:n]) * self.down[:n])


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while 2 * done <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    return np.minimum(x[: len(x) - (width - done)], x[width - done :]) if done < width else x


def segments(data: np.ndarray, ends: np.ndarray, length: int, gram: int, hasher: Hasher) -> tuple[np.ndarray, ...]:
    """(key, hash, start, windows) of the segments of texts that lie one after the other in data and end at `ends`.

    AGAIN is added to the windows of a segment in which equal windows may be.
    """
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none.astype(np.uint64), none.astype(np.uint64), none, none
    prefix, width = hasher.prefix(data), length - gram + 1
    grams = hasher.all_of(prefix, gram)
    key = sliding_minimum(grams, width)
    n = len(key)
    usable = np.ones(n + 1, bool)
    usable[n] = False
    for e in ends.tolist():  # windows across the end of a text
        usable[max(0, e - length + 1) : min(e, n)] = False
    change = np.ones(n + 1, bool)
    change[1:n] = (key[1:] != key[:-1]) | (usable[1:n] != usable[: n - 1])
    change[ends[ends < n]] = True
    bounds = np.flatnonzero(change)
    starts, sizes = bounds[:-1], np.diff(bounds)
    keep = usable[starts]
    starts, sizes = starts[keep], sizes[keep]
    if len(sizes) and sizes.max() > LONGEST:
        parts = -(-sizes // LONGEST)
        step = ranges(np.zeros(len(parts), np.int64), parts) * LONGEST
        starts, sizes = np.repeat(starts, parts) + step, np.minimum(np.repeat(sizes, parts) - step, LONGEST)
    # Two windows of one segment are equal only if what is between their starts is a period, so the key's gram stands again in the window it begins.
    lead = np.flatnonzero(usable[:n] & (key == grams[:n]))
    padded = np.concatenate((grams, np.zeros(1, np.uint64)))
    lead = lead[(np.lib.stride_tricks.sliding_window_view(padded, width + 1)[lead, 1:] == key[lead, None]).any(axis=1)]
    may = sizes > width
    may[np.searchsorted(starts, lead, side="right") - 1] = True
    return key[starts], hasher.of(prefix, starts, sizes + length - 1), starts, sizes | (may * AGAIN)


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes in the order of their first `depth` bytes at least, by doubling: ties are left as they are."""
    n = len(text)
    padded = np.concatenate((text, np.zeros(8, np.uint8))).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for i in range(8):
        key = (key << np.uint64(8)) | padded[i : i + n]
    order = np.argsort(key)
    met = key[order]
    head = np.concatenate(([True], met[1:] != met[:-1]))
    rank = np.zeros(n + 1, np.int64)
    rank[n] = -1
    rank[order] = np.flatnonzero(head)[np.cumsum(head) - 1]
    done = 8
    while done < depth:
        tied = np.flatnonzero(~(head & np.concatenate((head[1:], [True]))))  # places in groups of more than one
        if not len(tied):
            break
        which = order[tied]
        key = (rank[which] << 32) | (rank[np.minimum(which + done, n)] + 1)
        by = np.argsort(key)
        order[tied], key = which[by], key[by]
        head[tied[1:]] |= key[1:] != key[:-1]
        starts = np.maximum.accumulate(np.where(head[tied], tied, 0))
        rank[order[tied]] = starts
        done *= 2
    return order


def equal_windows(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, parted): suffixes in order, and whether the one at a place differs from the one before within `length` bytes.

    text holds strings of bytes over 0, each followed by a 0. For suffixes whose first `length` bytes hold a 0, parted
    means nothing. Level by level, each interval of suffixes that begin with w is extended to those that begin
    with cw, for every c but 0. An interval whose end is a boundary already isn't extended further: its extensions end at
    boundaries of shorter prefixes.
    """
    n = len(text)
    order = suffix_order(text, length)
    transform = text[order - 1]  # the byte before each suffix
    behind = np.argsort(transform, kind="stable")  # where the suffix after the first byte stands
    ahead = np.empty(n, np.int64)
    ahead[behind] = np.arange(n)  # where the suffix that begins a byte earlier stands
    counts = np.bincount(text, minlength=256)
    ends = np.cumsum(counts)
    parted = np.zeros(n + 1, bool)
    parted[0] = True
    low, high = (ends - counts)[counts > 0], ends[counts > 0]
    parted[high] = True
    owner = np.zeros(n, np.int64)
    for _ in range(1, length):
        if not len(low):
            break
        size = high - low
        places = ranges(low, size)
        owner[places] = np.repeat(np.arange(len(low)), size)
        places = places[transform[places] != 0]
        to = np.sort(ahead[places])
        back = behind[to]
        source, byte = owner[back], transform[back]
        first = np.concatenate(([True], (source[1:] != source[:-1]) | (byte[1:] != byte[:-1]))) if len(to) else np.zeros(0, bool)
        low = to[first]
        high = to[np.concatenate((first[1:], [True]))] + 1 if len(to) else low
        new = ~parted[high]
        low, high = low[new], high[new]
        parted[high] = True
    return order, parted[:n]


def repeated_windows(strings: list[bytes], length: int) -> list[np.ndarray]:
    """For each string the starts of its windows that start earlier, too: in a string before it or before in itself."""
    sizes = np.array([len(s) for s in strings])
    text = np.frombuffer(b"\xff".join(strings) + b"\xff", np.uint8) + np.uint8(1)  # the separator becomes 0; UTF-8 has no such byte
    starts = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    whole = np.zeros(len(text), bool)
    whole[ranges(starts, np.maximum(sizes - length + 1, 0))] = True
    order, parted = equal_windows(text, length)
    group = np.cumsum(parted)
    kept = whole[order]
    order, group = order[kept], group[kept]
    if not len(order):
        return [order] * len(strings)
    heads = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    earliest = np.repeat(np.minimum.reduceat(order, heads), np.diff(np.concatenate((heads, [len(order)]))))
    again = np.sort(order[order != earliest])
    return [x - s for x, s in zip(np.split(again, np.searchsorted(again, starts[1:])), starts.tolist())]


def runs(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """What windows at these ascending starts cover, as ranges of bytes."""
    if not len(starts):
        return []
    gap = np.flatnonzero(np.diff(starts) > length)
    return list(zip(starts[np.concatenate(([0], gap + 1))].tolist(), (starts[np.concatenate((gap, [len(starts) - 1]))] + length).tolist()))


def in_order(docs: DataFrame) -> DataFrame:
    """(doc, doc_id, text): doc numbers the rows by doc_id, nulls first; rows of one doc_id by a hash of their text. Unique doc_ids are numbers already."""
    rows = docs.select(F.col("doc_id").cast("bigint"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    many, different = rows.agg(F.count("*"), F.count_distinct("doc_id")).first()
    if many == different:
        return rows.select(F.col("doc_id").alias("doc"), "doc_id", "text")
    n, tie = shuffle_parts(docs.sparkSession), F.xxhash64("text")
    part = range_number(F.col("doc_id"), tie, range_bounds(rows, "doc_id", n))
    placed = materialize(rows.withColumn("part", part), "parts")
    counts = {r.part: r.n for r in placed.groupBy("part").agg(F.count("*").alias("n")).collect()}  # one row per range
    before = [sum(v for k, v in counts.items() if k < i) for i in range(max(counts) + 1)]
    order = Window.partitionBy("part").orderBy(F.col("doc_id").asc_nulls_first(), tie, "text")
    number = F.get(F.lit(before).cast("array<bigint>"), F.col("part")) + F.row_number().over(order)
    out = materialize(placed.repartitionById(n, "part").select(number.alias("doc"), "doc_id", "text"), "numbered")
    discard(placed)
    return out


def _utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column without nulls, and where each text begins and ends."""
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets


def _chunks(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(data, ends, doc, start): pieces of texts of about CHUNK bytes together; pieces of one text overlap, so that each window is in one."""
    step = CHUNK
    for batch in batches:
        data, offsets = _utf8(batch.column(1))
        docs = batch.column(0).to_numpy()
        sizes = np.diff(offsets)
        long = np.flatnonzero(sizes >= length)
        parts = -(-(sizes[long] - length + 1) // step)
        doc, at = np.repeat(long, parts), ranges(np.zeros(len(long), np.int64), parts) * step
        size = np.minimum(sizes[doc] - at, step + length - 1)
        begin, total = 0, np.cumsum(size)
        while begin < len(doc):
            end = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + step, side="right")))
            some = slice(begin, end)
            pieces = [data[b : b + s] for b, s in zip((offsets[doc[some]] + at[some]).tolist(), size[some].tolist())]
            yield np.concatenate(pieces), np.cumsum(size[some]), docs[doc[some]], at[some]
            begin = end


SEGMENTS = pa.schema([("r", pa.int64()), ("s", pa.int64()), ("doc", pa.int64()), ("place", pa.int64())])


def _combined(key: np.ndarray, own: np.ndarray, doc: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    """Of equal segments the first stays; the others are spans already: their place is below 0, and they are dealt evenly."""
    order = np.lexsort((place, doc, own, key))
    key, own, doc, place = key[order], own[order], doc[order], place[order]
    again = np.concatenate(([False], (key[1:] == key[:-1]) & (own[1:] == own[:-1])))
    key[again] = mixed(doc[again].astype(np.uint64) * MIX[0] + place[again].astype(np.uint64))
    place[again] = -1 - place[again]
    return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(own.view(np.int64)), pa.array(doc), pa.array(place)], schema=SEGMENTS)


def all_segments(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """(r, s, doc, place) of each segment of (doc, text): key, hash, and start * 2^16 + AGAIN + number of windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(2 * CHUNK + 2 * length)
        held: list[tuple[np.ndarray, ...]] = []
        for data, ends, doc, at in _chunks(batches, length):
            key, own, start, windows = segments(data, ends, length, gram, hasher)
            piece = np.searchsorted(ends, start, side="right")
            begin = np.concatenate(([0], ends[:-1]))
            held.append((key, own, doc[piece], ((start - begin[piece] + at[piece]) << 16) | windows))
            if sum(len(h[0]) for h in held) > ROWS_AT_ONCE:
                yield _combined(*map(np.concatenate, zip(*held)))
                held.clear()
        if held:
            yield _combined(*map(np.concatenate, zip(*held)))

    return rows.select("doc", "text").mapInArrow(run, "r bigint, s bigint, doc bigint, place bigint")


def met_again(found: DataFrame, hot: int) -> DataFrame:
    """(doc, start, windows, r, hot): segments that equal an earlier one, without r; and the first of equal ones whose key occurs again, or twice in it.

    hot: the key has more than so many different segments.
    """
    group = Window.partitionBy("r")
    before = F.lag("s").over(group.orderBy("s", "doc", "place"))
    again = found.withColumn("again", (F.col("place") < 0) | F.coalesce(before == F.col("s"), F.lit(False)))
    counted = again.withColumn("n", F.count("*").over(group)).withColumn("different", F.count_if(~F.col("again")).over(group))
    place = F.when(F.col("place") < 0, -1 - F.col("place")).otherwise(F.col("place"))
    itself = place.bitwiseAND(AGAIN) > 0
    return counted.where(F.col("again") | (F.col("n") > 1) | itself).select(
        "doc", F.shiftright(place, 16).alias("start"), place.bitwiseAND(AGAIN - 1).cast("int").alias("windows"), F.when(~F.col("again"), F.col("r")).alias("r"), (F.col("different") > hot).alias("hot")
    )


CUT = pa.schema([("r", pa.int64()), ("doc", pa.int64()), ("start", pa.int64()), ("string", pa.binary())])
SPANS = pa.schema([("doc", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])


def cut_out(rows: DataFrame, asked: DataFrame, length: int) -> DataFrame:
    """(r, doc, start, string) of the segments asked for; of those of a hot key each window, whose hash is its key then."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(LONGEST + 2 * length)
        for batch in batches:
            for doc, text, wanted in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                data, out = text.as_buffer().to_pybytes(), []
                for w in wanted.as_py():
                    string = data[w["start"] : w["start"] + w["windows"] + length - 1]
                    if not w["hot"]:
                        out.append((w["r"], doc, w["start"], string))
                        continue
                    key = hasher.all_of(hasher.prefix(np.frombuffer(string, np.uint8)), length).view(np.int64)
                    out += [(int(key[i]), doc, w["start"] + i, string[i : i + length]) for i in range(w["windows"])]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), CUT.types)], schema=CUT)

    of_doc = asked.groupBy("doc").agg(F.collect_list(F.struct("start", "windows", "r", "hot")).alias("wanted"))  # as many as a text has segments
    return rows.join(of_doc, "doc").select("doc", "text", "wanted").mapInArrow(run, "r bigint, doc bigint, start bigint, string binary")


def repeated_spans(strings: DataFrame, length: int) -> DataFrame:
    """(doc, start, end): what windows cover that start earlier, too, block by block of whole keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], bytes] = {}
        size, last = 0, None

        def block() -> pa.RecordBatch:
            places = sorted(held)
            found = repeated_windows([held[p] for p in places], length)
            out = [(doc, start + a, start + b) for (doc, start), windows in zip(places, found) for a, b in runs(windows, length)]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else ((), (), ()))], schema=SPANS)

        for batch in batches:
            for r, doc, start, string in zip(*(c.to_pylist() for c in batch.columns)):
                if r != last and size >= BLOCK_BYTES:
                    yield block()
                    held.clear()
                    size = 0
                last = r
                held[doc, start] = string
                size += len(string) + 1
        if held:
            yield block()

    return strings.repartition("r").sortWithinPartitions("r").mapInArrow(run, "doc bigint, start bigint, end bigint")


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """Per row of docs: doc_id, n_bytes, spans (array of start and end, in bytes), kept (the bytes outside the spans).

    A byte is in a span if a string of `length` bytes that covers it also starts earlier: in a smaller doc_id, or before in
    the same text. Strings are judged on the input, overlaps count, matches don't cross documents; spans that touch are one.
    Null texts count as empty. Null doc_ids come first; rows of one doc_id follow each other by a hash of their text, so
    of equal rows one keeps its bytes. Extra columns are ignored; an empty table gives no rows.
    `length` must be greater than `gram` and less than 2^15. Segments are told apart by two 64-bit hashes.
    """
    rows = in_order(docs)
    found = materialize(met_again(all_segments(rows, length, gram), hot), "segments")
    asked = found.where("r is not null")
    again = found.where("r is null").select("doc", "start", (F.col("start") + F.col("windows") + (length - 1)).alias("end"))
    spans = again.unionByName(repeated_spans(cut_out(rows, asked, length), length))
    of_doc = spans.groupBy("doc").agg(F.collect_list(F.struct("start", "end")).alias("spans"))  # as many as a text has segments

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                made = [_without(text.as_buffer().to_pybytes(), spans.as_py()) for text, spans in zip(part.column(1), part.column(2))]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([m[0] for m in made], pa.int64()), pa.array([m[1] for m in made], pa.list_(SPAN)), pa.array([m[2] for m in made], pa.binary())],
                    names=["doc_id", "n_bytes", "spans", "kept"],
                )

    return rows.join(of_doc, "doc", "left").select("doc_id", "text", "spans").mapInArrow(run, "doc_id bigint, n_bytes bigint, spans array<struct<start:bigint,end:bigint>>, kept binary")


SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])


def _without(data: bytes, spans: list[dict[str, int]] | None) -> tuple[int, list[dict[str, int]], bytes]:
    """Length, joined spans and what is left of a text."""
    joined: list[dict[str, int]] = []
    for s in sorted(spans or (), key=lambda s: s["start"]):
        if joined and s["start"] <= joined[-1]["end"]:
            joined[-1]["end"] = max(joined[-1]["end"], s["end"])
        else:
            joined.append(s)
    edges = [0, *(x for s in joined for x in (s["start"], s["end"])), len(data)]
    return len(data), joined, b"".join([data[a:b] for a, b in zip(edges[::2], edges[1::2])])
