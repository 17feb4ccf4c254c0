"""Alignment of two tokenizers over the same bytes, by sparse incidence matrices.

Tokenizer A encodes a blank and the text, tokenizer B the text, before which it puts the blank itself; both then cover the
same bytes. The incidence matrices of tokens and bytes are kept in CSR form. The product of A's matrix and B's transposed one,
row by row as Gustavson does it, holds an entry for each two tokens that overlap, with the number of bytes they share.
Where tokens of both end, a group ends; the incidence matrices of groups and tokens give the tokens that share a group.

Neither tokenizer has a token that goes on from a printed character into a blank, so a text is the row of its words, each
with the blanks before it, and its matrices are block diagonal: a new word's block is multiplied once and kept.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siteloom.llm.common import materialize, ranges
from siteloom.llm.tokens import BYTE_PIECES, PLAIN, SPECIAL, byte_letters, encoder

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: A blank after one of these characters is a cut; elsewhere words stay together.
NO_CUT = re.compile("[^!-~\xc0-\xd6\xd8-\xf6\xf8-ž] ")
CUT = re.compile("(?<=[!-~\xc0-\xd6\xd8-\xf6\xf8-ž]) ")
#: Fixed by the file: how A cuts a text before it merges.
BYTE_RULE = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
KEPT_WORDS, KEPT_LINKS, LONG_WORD = 300_000, 6_000_000, 64
#: New words are encoded so many together, a tab after each: no token of either file goes on over a tab.
TOGETHER = 512
LAST_CHARACTER = re.compile("[!-~\xc0-\xd6\xd8-\xf6\xf8-ž]")
PAIRS_AT_ONCE = 1_000_000
#: So many pairs with their counts are sent to every task (17 bytes each); more are joined by shuffles.
SENT_PAIRS = 4_000_000
STATS = ("n_a", "n_b", "n_groups", "n_links")


@dataclass
class CSR:
    """A sparse matrix: row i has the columns indices[indptr[i]:indptr[i + 1]], with the values of data beside them."""

    indptr: np.ndarray
    indices: np.ndarray
    data: np.ndarray
    columns: int

    @staticmethod
    def blocks(lengths: np.ndarray) -> CSR:
        """Row i covers the next lengths[i] columns: the incidence of tokens and bytes, or of groups and tokens."""
        indptr = np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))
        n = int(indptr[-1])
        return CSR(indptr, np.arange(n), np.ones(n, np.int64), n)

    @property
    def rows(self) -> np.ndarray:
        """The row of each entry."""
        return np.repeat(np.arange(len(self.indptr) - 1), np.diff(self.indptr))

    def transposed(self) -> CSR:
        order = np.argsort(self.indices, kind="stable")
        indptr = np.concatenate(([0], np.cumsum(np.bincount(self.indices, minlength=self.columns))))
        return CSR(indptr, self.rows[order], self.data[order], len(self.indptr) - 1)

    def __matmul__(self, other: CSR) -> CSR:
        """Gustavson: row i of the product is the sum of the rows of `other` that row i names, times its values."""
        many = np.diff(other.indptr)[self.indices]  # entries that each entry of self brings
        ends = np.cumsum(many)
        at = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - many, many) + np.repeat(other.indptr[self.indices], many)
        row, column, value = np.repeat(self.rows, many), other.indices[at], np.repeat(self.data, many) * other.data[at]
        if len(row) and np.any((row[1:] == row[:-1]) & (column[1:] < column[:-1])):
            order = np.lexsort((column, row))
            row, column, value = row[order], column[order], value[order]
        first = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (column[1:] != column[:-1])))) if len(row) else np.zeros(0, np.int64)
        sums = np.add.reduceat(value, first) if len(first) else np.zeros(0, np.int64)
        indptr = np.searchsorted(row[first], np.arange(len(self.indptr)))
        return CSR(indptr, column[first], sums, other.columns)


def group_sizes(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many tokens of A and of B each group has; groups end where tokens of both do."""
    cuts = np.intersect1d(a_ends, b_ends, assume_unique=True)
    return (np.diff(np.searchsorted(x, cuts, side="right"), prepend=0) for x in (a_ends, b_ends))


def overlap_links(a_lengths: np.ndarray, b_lengths: np.ndarray) -> CSR:
    """Row i: the tokens of B that token i of A overlaps, and how many bytes they share."""
    return CSR.blocks(a_lengths) @ CSR.blocks(b_lengths).transposed()


def shared_group_links(a_sizes: np.ndarray, b_sizes: np.ndarray) -> CSR:
    """Row i: the tokens of B in the group of token i of A."""
    return CSR.blocks(a_sizes).transposed() @ CSR.blocks(b_sizes)


class Grown:
    """An array that grows at its end."""

    def __init__(self, kind: type) -> None:
        self.values, self.n = np.zeros(1024, kind), 0

    def add(self, more: np.ndarray) -> None:
        need = self.n + len(more)
        if need > len(self.values):
            self.values = np.concatenate((self.values[: self.n], np.zeros(max(need, 2 * self.n) - self.n, self.values.dtype)))
        self.values[self.n : need] = more
        self.n = need

    def all(self) -> np.ndarray:
        return self.values[: self.n]


class Words(dict[str, int]):
    """The place of each word; a new one gets the next place and waits in `fresh`."""

    def __init__(self) -> None:
        self.next, self.fresh = 0, []

    def __missing__(self, word: str) -> int:
        self[word] = at = self.next
        self.next += 1
        self.fresh.append(word)
        return at


class Aligner:
    """Words that were met, with the blocks of their products."""

    def __init__(self, a_file: str, b_file: str) -> None:
        import sentencepiece

        self.a = encoder(a_file, special_as_text=True)
        if "/" not in b_file:
            import public_tokenizers

            b_file = public_tokenizers.path(b_file)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_file)
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        vocabulary = {t: i for t, i in self.a.library.get_vocab(with_added_tokens=False).items() if all(c in byte_of for c in t)}
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for t, i in vocabulary.items():
            self.a_bytes[i] = bytes(byte_of[c] for c in t)
        n = self.b.get_piece_size()
        self.b_bytes = [bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode() for i in range(n)]
        self.a_size, self.b_size = (np.array(list(map(len, x))) for x in (self.a_bytes, self.b_bytes))
        self.blank = [self.b.piece_to_id("▁")]  # the library doesn't encode nothing, but a blank at the end of a text is a word
        self.b_count = n
        # An id with what follows it in the text of a group: the next id, the other tokenizer's, or the next group.
        self.shown = [f"{i}{c}".encode() for c, k in ((",", len(self.a_bytes)), ("|", len(self.a_bytes)), (",", n), (";", n)) for i in range(k)]
        self.merge = self._merger(a_file)
        self.age = 0
        self.clear()

    def clear(self) -> None:
        self.age += 1
        self.known = Words()
        self.ok, self.stats = Grown(bool), {k: Grown(np.int64) for k in (*STATS, "n_group_links")}
        self.groups: list[bytes] = []
        self.pairs, self.ends = Grown(np.int64), Grown(np.int64)  # the id pair of each link: A's id times b_count and B's id
        self.ends.add(np.zeros(1, np.int64))

    def words(self, text: str) -> list[str]:
        """The words of blank + text, without their first blank."""
        whole = " " + text
        return text.split(" ") if NO_CUT.search(whole) is None else CUT.split(text)

    def _merger(self, a_file: str) -> Callable[[str], list[int]] | None:
        """A's merges as byte pair ranks, where its ids are in the order of its merges; PLAIN texts are encoded so."""
        import public_tokenizers
        import tiktoken

        with open(a_file if "/" in a_file else public_tokenizers.path(a_file), encoding="utf-8") as file:
            merges = json.load(file)["model"]["merges"]
        joined = ["".join(m if isinstance(m, list) else m.split(" ")) for m in merges]
        ids = self.a.library.get_vocab()
        if self.a.pieces is not BYTE_PIECES or [ids.get(t) for t in joined] != list(range(256, 256 + len(joined))):
            return None
        ranks = {b: i for i, b in enumerate(self.a_bytes[: 256 + len(joined)])}
        return tiktoken.Encoding("a", pat_str=BYTE_RULE, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def encoded(self, word: str) -> tuple[np.ndarray, np.ndarray, bool]:
        """Ids of A and of B, and whether both stand for a blank and the word."""
        whole = " " + word
        a, b = np.frombuffer(self.a.encode(whole), "<u4").astype(np.int64), np.array(self.b.encode(word) or self.blank, np.int64)
        want = whole.encode("utf-8", "surrogatepass")
        same = b"".join(map(self.a_bytes.__getitem__, a.tolist())) == want and b"".join(map(self.b_bytes.__getitem__, b.tolist())) == want
        return a, b, same

    def encoded_together(self, words: list[str]) -> tuple[np.ndarray, ...] | None:
        """Ids of A and the word of each, ids of B and the word of each; None if the words must be encoded each."""
        whole = " " + "\t ".join(words) + "\t"
        data = whole.encode()
        plain = self.merge is not None and SPECIAL not in whole and PLAIN.fullmatch(whole)
        a = np.array(self.merge(whole), np.int64) if plain else np.frombuffer(self.a.encode(whole), "<u4").astype(np.int64)
        b = np.array(self.b.encode(whole[1:]), np.int64)
        sizes = np.array([len(w) for w in words]) if whole.isascii() else np.array([len(w.encode()) for w in words])
        tabs = np.cumsum(sizes + 2)
        out = []
        for ids, table, size in ((a, self.a_bytes, self.a_size), (b, self.b_bytes, self.b_size)):
            if b"".join(map(table.__getitem__, ids.tolist())) != data:
                return None
            ends = np.cumsum(size[ids])
            at = np.searchsorted(ends, tabs)
            if not np.array_equal(ends[at], tabs) or (size[ids[at]] != 1).any():
                return None
            own = np.ones(len(ids), bool)
            own[at] = False
            out += [ids[own], np.searchsorted(tabs, ends[own])]
        return tuple(out)

    def encoded_all(self, words: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of A and the word of each, ids of B and the word of each, in the order of words; whether each word comes back from both."""
        joint = [i for i, w in enumerate(words) if w and "\t" not in w and len(w) <= LONG_WORD and LAST_CHARACTER.fullmatch(w, len(w) - 1)]
        alone = sorted(set(range(len(words))) - set(joint))
        ok = np.ones(len(words), bool)
        parts: list[tuple[np.ndarray, ...]] = []
        for start in range(0, len(joint), TOGETHER):
            some = joint[start : start + TOGETHER]
            done = self.encoded_together([words[i] for i in some])
            if done is None:
                alone += some
                continue
            a, a_word, b, b_word = done
            which = np.array(some)
            parts.append((a, which[a_word], b, which[b_word]))
        for i in alone:
            a, b, ok[i] = self.encoded(words[i])
            if ok[i]:
                parts.append((a, np.full(len(a), i), b, np.full(len(b), i)))
        a, a_word, b, b_word = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*parts) if parts else [[]] * 4))
        by_a, by_b = np.argsort(a_word, kind="stable"), np.argsort(b_word, kind="stable")
        return a[by_a], a_word[by_a], b[by_b], b_word[by_b], ok

    def learn(self, words: Sequence[str]) -> None:
        """Adds words in their order: one product of the matrices of all of them."""
        a, a_word, b, b_word, ok = self.encoded_all(words)
        a_len, b_len = self.a_size[a], self.b_size[b]
        links = overlap_links(a_len, b_len)
        ga, gb = group_sizes(np.cumsum(a_len), np.cumsum(b_len))
        group_word = a_word[np.cumsum(ga) - 1] if len(ga) else a_word
        per_word = lambda w, v=None: np.bincount(w, v, minlength=len(words)).astype(np.int64)
        row = links.rows
        link_word = a_word[row]
        for name, counts in zip((*STATS, "n_group_links"), (per_word(a_word), per_word(b_word), per_word(group_word), per_word(link_word), per_word(group_word, (ga * gb).astype(float)))):
            self.stats[name].add(counts)
        self.ok.add(ok)
        self.ends.add(self.ends.all()[-1] + np.cumsum(per_word(link_word)))
        self.pairs.add(a[row] * self.b_count + b[links.indices])
        k, n = len(self.a_bytes), self.b_count
        last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        last_a[np.cumsum(ga) - 1], last_b[np.cumsum(gb) - 1] = 1, 1
        code = np.empty(len(a) + len(b), np.int64)
        code[np.arange(len(a)) + np.repeat(np.cumsum(gb) - gb, ga)] = a + k * last_a
        code[np.arange(len(b)) + np.repeat(np.cumsum(ga), gb)] = b + 2 * k + n * last_b
        shown = list(map(self.shown.__getitem__, code.tolist()))
        bounds = np.concatenate(([0], np.cumsum(per_word(a_word) + per_word(b_word)))).tolist()
        self.groups += [b"".join(shown[s:e])[:-1] for s, e in zip(bounds, bounds[1:])]

    def batch(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The place in this table of each word of each text, and where the words of each text begin; new words are learned."""
        if len(self.known) > KEPT_WORDS or self.pairs.n > KEPT_LINKS:
            self.clear()
        known, out, starts = self.known, [], [0]
        for text in texts:
            if text:
                out.extend(map(known.__getitem__, self.words(text)))
            starts.append(len(out))
        if fresh := known.fresh:
            self.learn(fresh)
            for w in fresh:
                if len(w) > LONG_WORD:
                    del known[w]
            known.fresh = []
        return np.array(out, np.int64), np.array(starts, np.int64)


@cache
def aligner(a_file: str, b_file: str) -> Aligner:
    return Aligner(a_file, b_file)


def sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The sum of values between each two starts."""
    return np.diff(np.concatenate(([0], np.cumsum(values)))[starts])


def some_texts(batches: Iterator[pa.RecordBatch], column: int, rows: int = 256, size: int = 1 << 21) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Slices of a few rows, of about `size` characters unless one text has more, with their texts."""
    for batch in batches:
        start = 0
        while start < batch.num_rows:
            held, texts = 0, []
            while start + len(texts) < batch.num_rows and len(texts) < rows and held < size:
                texts.append(batch.column(column)[start + len(texts)].as_py())
                held += len(texts[-1] or "")
            yield batch.slice(start, len(texts)), texts
            start += len(texts)


def usable(table: Aligner, at: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Whether a text has words, all of which both tokenizers give back."""
    return (np.diff(starts) > 0) & (sums(~table.ok.all()[at], starts) == 0)


def text_pairs(table: Aligner, at: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, pair, links) of each usable text: how many links each of its id pairs has."""
    text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    fit = usable(table, at, starts)[text]
    key, times = np.unique((text[fit] << 32) | at[fit], return_counts=True)
    word, ends = key & 0xFFFFFFFF, table.ends.all()
    many = ends[word + 1] - ends[word]
    pair = table.pairs.all()[ranges(ends[word], many)]
    text, times = np.repeat(key >> 32, many), np.repeat(times, many)
    order = np.lexsort((pair, text))
    text, pair, times = text[order], pair[order], times[order]
    first = np.flatnonzero(np.concatenate(([True], (text[1:] != text[:-1]) | (pair[1:] != pair[:-1])))) if len(text) else np.zeros(0, np.int64)
    return text[first], pair[first], np.add.reduceat(times, first) if len(first) else times[:0]


def pair_counts(docs: DataFrame, a_file: str = A_FILE, b_file: str = B_FILE) -> DataFrame:
    """(a, b, n, best): in how many rows of docs each id pair is linked, and whether no other B id has more with this A id.

    Each task adds up its rows first, so an id pair that all texts hold is sent a few times a task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = aligner(a_file, b_file)
        held: list[np.ndarray] = []
        pairs, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def merged() -> tuple[np.ndarray, np.ndarray]:
            met, n = np.unique(np.concatenate(held), return_counts=True) if held else (pairs[:0], counts[:0])
            held.clear()
            all_pairs, which = np.unique(np.concatenate((pairs, met)), return_inverse=True)
            total = np.zeros(len(all_pairs), np.int64)
            np.add.at(total, which, np.concatenate((counts, n)))
            return all_pairs, total

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(pairs // table.b_count), pa.array(pairs % table.b_count), pa.array(counts)], names=["a", "b", "n"])

        for _, texts in some_texts(batches, 0):
            held.append(text_pairs(table, *table.batch(texts))[1])
            if sum(map(len, held)) > 4 * PAIRS_AT_ONCE:
                pairs, counts = merged()
                if len(pairs) > PAIRS_AT_ONCE:
                    yield rows()
                    pairs, counts = pairs[:0], counts[:0]
        pairs, counts = merged()
        yield rows()

    counted = docs.select(F.col("text").cast("string")).mapInArrow(run, "a bigint, b bigint, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n"))
    return counted.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("a")))  # an A id has as many rows as B has ids at most


def sent(pairs: DataFrame, b_count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The written pair table as sorted arrays; its size is checked before."""
    got = pairs.select((F.col("a") * b_count + F.col("b")).alias("pair"), "n", "best").toArrow()
    order = np.argsort(got.column("pair").to_numpy())
    return tuple(got.column(c).to_numpy()[order] for c in ("pair", "n", "best"))


def align_documents(docs: DataFrame, a_file: str = A_FILE, b_file: str = B_FILE, sent_pairs: int = SENT_PAIRS) -> DataFrame:
    """Per row of docs: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, n_group_links.

    n_best counts the links whose pair has the highest count of its A id, count_sum adds the counts of all links, a
    count being the number of rows that hold the pair linked; n_group_links counts pairs of tokens that share a group.
    Null and empty texts, and texts that a tokenizer doesn't give back byte by byte, have zeros and an empty digest. Every
    row counts, repeated ones too; null doc_ids stay null; extra columns are ignored; an empty table gives no rows.
    Up to sent_pairs pairs the counts go to every task; beyond that the links are joined with them by shuffles.
    """
    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    pairs = materialize(pair_counts(rows, a_file, b_file), "pairs")
    if pairs.count() > sent_pairs:
        return _joined(rows, pairs, a_file, b_file)
    counts = rows.sparkSession.sparkContext.broadcast(sent(pairs, aligner(a_file, b_file).b_count))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, own, age = aligner(a_file, b_file), [np.zeros(0, np.int64)] * 2, 0
        keys, *values = counts.value
        for batch, texts in some_texts(batches, 1):
            at, starts = table.batch(texts)
            if age != table.age:  # the table began anew
                own, age = [x[:0] for x in own], table.age
            ends = table.ends.all()[len(own[0]) :]
            if len(ends) > 1:  # what the links of each new word add up to; words that only other tables hold are never read
                place = np.searchsorted(keys, table.pairs.all()[ends[0] :]).clip(max=max(0, len(keys) - 1))
                own = [np.concatenate((x, sums(v[place] if len(keys) else 0 * place, ends - ends[0]))) for x, v in zip(own, values[::-1])]
            yield _rows(batch.column(0), table, at, starts, own)

    return rows.mapInArrow(run, "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string, n_group_links bigint")


def _rows(doc_id: pa.Array, table: Aligner, at: np.ndarray, starts: np.ndarray, own: Sequence[np.ndarray]) -> pa.RecordBatch:
    fit = usable(table, at, starts)
    numbers = [sums(x[at], starts) * fit for x in (*(table.stats[k].all() for k in STATS), *own, table.stats["n_group_links"].all())]
    groups, where = table.groups, at.tolist()
    shown = [hashlib.sha256(b";".join([groups[i] for i in where[s:e]])).hexdigest() if ok else "" for s, e, ok in zip(starts.tolist(), starts.tolist()[1:], fit.tolist())]
    arrays = [doc_id, *map(pa.array, numbers[:-1]), pa.array(shown, pa.string()), pa.array(numbers[-1])]
    names = ["doc_id", *STATS, "n_best", "count_sum"][: len(arrays) - 2]
    return pa.RecordBatch.from_arrays(arrays, names=[*names, "groups_sha256", "n_group_links"])


def _joined(rows: DataFrame, pairs: DataFrame, a_file: str, b_file: str) -> DataFrame:
    """align_documents for any number of pairs: a row for each text and id pair meets the counts in a join."""
    numbered = materialize(rows.withColumn("rid", F.monotonically_increasing_id()), "numbered")

    def stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = aligner(a_file, b_file)
        for batch, texts in some_texts(batches, 1):
            done = _rows(batch.column(0), table, *table.batch(texts), ())
            yield pa.RecordBatch.from_arrays([*done.columns, batch.column(2)], names=[*done.schema.names, "rid"])

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = aligner(a_file, b_file)
        for batch, texts in some_texts(batches, 0):
            text, pair, n = text_pairs(table, *table.batch(texts))
            rid = batch.column(1).to_numpy()[text]
            yield pa.RecordBatch.from_arrays([pa.array(rid), pa.array(pair // table.b_count), pa.array(pair % table.b_count), pa.array(n)], names=["rid", "a", "b", "links"])

    each = numbered.mapInArrow(stats, "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, n_group_links bigint, rid bigint")
    linked = numbered.select("text", "rid").mapInArrow(links, "rid bigint, a bigint, b bigint, links bigint")
    met = linked.join(pairs, ["a", "b"]).groupBy("rid").agg(F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("n_best"), F.sum(F.col("links") * F.col("n")).alias("count_sum"))
    out = each.join(met, "rid", "left").fillna(0, ["n_best", "count_sum"])
    return out.select("doc_id", *STATS, "n_best", "count_sum", "groups_sha256", "n_group_links")


def token_links(docs: DataFrame, a_file: str = A_FILE, b_file: str = B_FILE, by_group: bool = False) -> DataFrame:
    """(doc_id, a_at, b_at, a, b, bytes): every link, with the places and ids of both tokens and the bytes they share.

    by_group: links are the pairs of tokens that share a group instead, and `bytes` is 1. The same texts as in
    align_documents have none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = aligner(a_file, b_file)
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = table.words(text.as_py()) if text.as_py() else []
                made = [table.encoded(w) for w in words]
                if not made or not all(ok for *_, ok in made):
                    continue
                a, b = (np.concatenate([x[i] for x in made]) for i in (0, 1))
                a_len, b_len = table.a_size[a], table.b_size[b]
                found = shared_group_links(*group_sizes(np.cumsum(a_len), np.cumsum(b_len))) if by_group else overlap_links(a_len, b_len)
                rows = found.rows
                yield pa.RecordBatch.from_arrays(
                    [pa.array([doc] * len(rows), pa.int64()), *map(pa.array, (rows, found.indices, a[rows], b[found.indices], found.data))],
                    names=["doc_id", "a_at", "b_at", "a", "b", "bytes"],
                )

    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id bigint, a_at bigint, b_at bigint, a bigint, b bigint, bytes bigint")
