"""Hierarchical multi-length packing into windows of power-of-two sizes.

Every document is tokenised and cut into full windows of the largest tier and a rest. The rest is routed to
the smallest tier that holds it. Windows of a tier open with its own rests; what a window has left is filled
with the best fitting rests of shorter tiers, and at last with a piece cut from a short rest, so that a window
stays open only when no rest is left. Windows of one tier form step groups of equal token counts.

Packing runs where the tokens are made: each input partition is packed by itself in one pass without a
shuffle, holding at most `pending` rests. A recomputed partition gives the same windows again.

Documents that have an order, as that of a mix, keep it in the numbers of sequences and step groups: partitions are
ascending ranges of the order, and each is packed in rounds that leave less than one window to the next round.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteloom.llm.tokens import each_text, encoder

SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, `offset` bigint, tier int, step_group bigint"
ARROW = pa.schema([(c, pa.int32() if c == "tier" else pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group")])


class Packer:
    """Packs one partition. A rest is (length, number, doc, start, doc tokens, ids as bytes)."""

    def __init__(self, part: int, tiers: tuple[int, ...], step_tokens: int, pending: int) -> None:
        self.tiers, self.step_tokens, self.pending = tuple(sorted(tiers)), step_tokens, pending
        self.rests: dict[int, list[tuple]] = {c: [] for c in self.tiers}
        self.held, self.number = 0, 0
        self.base = part << 36
        self.sequences, self.groups = 0, 0
        self.open_group: dict[int, tuple[int, int]] = {}
        self.rows: list[tuple] = []

    def add(self, doc, ids: bytes) -> None:
        total, most, start = len(ids) // 4, self.tiers[-1], 0
        while total - start >= most:
            self.emit(most, [(most, self.number, doc, start, total, ids[4 * start : 4 * (start + most)])])
            start += most
        if start < total:
            self.hold((total - start, self.number, doc, start, total, ids[4 * start :]))
        if self.held >= self.pending:
            self.pack(last=False)

    def hold(self, rest: tuple) -> None:
        self.number += 1
        self.held += 1
        insort(self.rests[next(c for c in self.tiers if c >= rest[0])], (rest[0], self.number, *rest[2:]))

    def take(self, most: int) -> tuple | None:
        """The longest held rest of at most so many tokens, from the longest tier that has one."""
        for c in reversed(self.tiers):
            rests = self.rests[c]
            if rests and rests[0][0] <= most:
                self.held -= 1
                return rests.pop(bisect_right(rests, (most, self.number + 1)) - 1)
        return None

    def cut(self, most: int) -> tuple | None:
        """So many tokens off the shortest held rest that has more."""
        for c in self.tiers:
            if self.rests[c]:
                length, number, doc, start, total, ids = self.rests[c].pop(0)
                self.held -= 1
                self.hold((length - most, number, doc, start + most, total, ids[4 * most :]))
                return (most, number, doc, start, total, ids[: 4 * most])
        return None

    def pack(self, last: bool) -> None:
        for tier in reversed(self.tiers):
            while self.rests[tier] and (last or self.held > self.pending // 4):
                first = self.rests[tier].pop()
                self.held -= 1
                window, gap = [first], tier - first[0]
                while gap and (piece := self.take(gap) or self.cut(gap)):
                    window.append(piece)
                    gap -= piece[0]
                if gap:
                    self.split(window)
                else:
                    self.emit(tier, window)

    def split(self, window: list[tuple]) -> None:
        """The last window of a partition: cut into full windows of shorter tiers, then one that is padded."""
        left = sum(x[0] for x in window)
        while left:
            tier = max((c for c in self.tiers if c <= left), default=self.tiers[0])
            room, own = min(tier, left), []
            left -= room
            while room:
                length, number, doc, start, total, ids = window.pop(0)
                if length > room:
                    window.insert(0, (length - room, number, doc, start + room, total, ids[4 * room :]))
                    length, ids = room, ids[: 4 * room]
                own.append((length, number, doc, start, total, ids))
                room -= length
            self.emit(tier, own)

    def emit(self, tier: int, window: list[tuple]) -> None:
        self.place(tier, [(doc, start, length, zlib.crc32(ids), total) for length, _, doc, start, total, ids in window])

    def place(self, tier: int, pieces: list[tuple]) -> None:
        group, used = self.open_group.get(tier, (None, self.step_tokens))
        if used + tier > self.step_tokens:
            group, used, self.groups = self.base + self.groups, 0, self.groups + 1
        self.open_group[tier] = (group, used + tier)
        offset, sequence, self.sequences = 0, self.base + self.sequences, self.sequences + 1
        for doc, start, length, crc, total in pieces:
            self.rows.append((doc, start, length, crc, total, sequence, offset, tier, group))
            offset += length

    def flush(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(ARROW), ARROW.types)], schema=ARROW)


class OrderedPacker(Packer):
    """Packs one partition in rounds. A rest keeps its document's number, and a round's windows go by their first document.

    A round packs all that it has but a window that stays open, whose rests begin the next round.
    """

    def __init__(self, part: int, tiers: tuple[int, ...], step_tokens: int, pending: int) -> None:
        super().__init__(part, tiers, step_tokens, pending)
        self.round: list[tuple] = []
        self.last, self.left = False, []

    def add(self, doc, ids: bytes) -> None:
        self.number += 1
        super().add(doc, ids)
        if len(self.round) >= self.pending:
            self.pack(last=False)

    def hold(self, rest: tuple) -> None:
        self.held += 1
        insort(self.rests[next(c for c in self.tiers if c >= rest[0])], rest)

    def pack(self, last: bool) -> None:
        self.last = last
        super().pack(last=True)
        for _, _, tier, pieces in sorted(self.round):
            self.place(tier, pieces)
        left, self.round, self.left = self.left, [], []
        for rest in left:
            self.hold(rest)

    def split(self, window: list[tuple]) -> None:
        if self.last:
            super().split(window)
        else:
            self.left += window

    def emit(self, tier: int, window: list[tuple]) -> None:
        pieces = [(doc, start, length, zlib.crc32(ids), total) for length, _, doc, start, total, ids in window]
        self.round.append((min(x[1] for x in window), len(self.round), tier, pieces))


def pack_documents(
    docs: DataFrame,
    tokenizer: str = "word_bpe_49k.json",
    end_id: int = 1,
    tiers: tuple[int, ...] = (64, 128, 256, 512, 1024, 2048),
    step_tokens: int = 16 * 2048,
    pending: int = 4096,
    order: tuple[str, ...] = (),
) -> DataFrame:
    """One row per piece: its place in the document and in its window, crc32 of its ids, window size, step group.

    docs needs doc_id and text; other columns are ignored. A null or empty text is the end id alone. A null
    doc_id stays null, repeated rows are packed each. An empty table gives no rows. Only the last window of an
    input partition may hold fewer tokens than its size, and then fewer than the smallest tier.

    order: columns that order docs, the first of them a number with many values. Then docs are shuffled into ranges
    of it, and a document's windows come at most about two times `pending` documents from its place in the order.
    """
    if order:
        docs = docs.repartitionByRange(order[0]).sortWithinPartitions(*order)
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        packer = (OrderedPacker if order else Packer)(TaskContext.get().partitionId(), tiers, step_tokens, pending)
        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), each_text(encode, batch.column(1))):
                packer.add(doc, ids + end)
                if len(packer.rows) >= 20_000:
                    yield packer.flush()
        packer.pack(last=True)
        yield packer.flush()

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)
