"""Alignment of two tokenizers against brute force on bytes."""

import collections
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from siteloom.llm import alignment, queries
from siteloom.llm.tokens import byte_letters

SCHEMA = "doc_id bigint, text string"
NAMES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
TEXTS = [
    "", " ", "  ", "a", " a", "a ", "a  b", "   a   b   ", "\n", "a\nb", "a\n b", "a \n b", "\ta", "don't I'll we've", "émigré naïve Ünï", "日本語 です。", "😀 x 😀😀", "a▁b", "▁", "x <|endoftext|> y",
    "<s> </s> <unk> <0x41>", "１２ ﬁ Ａ é", "a b c", "a　 b", "\x00 a", "\x1c a", "a\u0085 b", "\r\n x\r y", "xx" * 300, "a" * 500, "12345678 3.14159", "....   !!!", "​ z‍", "ſtraße ſ ", "K Å",
    "tabs\t\tand  many    blanks \t end  ", "᠎ x", "a  b", "- - -", "q﻿ z",
]


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def plain(rows, libraries):
    a, b = libraries
    byte_of = {c: n for n, c in enumerate(byte_letters())}
    linked, holds = {}, collections.Counter()
    for k, (_, text) in enumerate(rows):
        if not text:
            continue
        x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        x_bytes = [bytes(byte_of[c] for c in a.id_to_token(i)) for i in x]
        y_bytes = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]
        if not b"".join(x_bytes) == b"".join(y_bytes) == (" " + text).encode():
            continue
        owner = [[j for j, t in enumerate(tokens) for _ in t] for tokens in (x_bytes, y_bytes)]
        links = sorted(set(zip(*owner)))
        ends = [set(np.cumsum([len(t) for t in tokens]).tolist()) for tokens in (x_bytes, y_bytes)]
        groups, i, j, at = [[[], []]], 0, 0, [0, 0]
        for cut in sorted(ends[0] & ends[1]):
            while i < len(x) and at[0] < cut:
                groups[-1][0].append(x[i])
                at[0] += len(x_bytes[i])
                i += 1
            while j < len(y) and at[1] < cut:
                groups[-1][1].append(y[j])
                at[1] += len(y_bytes[j])
                j += 1
            groups.append([[], []])
        groups.pop()
        pairs = [(x[p], y[q]) for p, q in links]
        linked[k] = (len(x), len(y), groups, pairs)
        holds.update(set(pairs))
    top = collections.defaultdict(int)
    for (p, _), n in holds.items():
        top[p] = max(top[p], n)
    out = []
    for k, (doc, _) in enumerate(rows):
        if k not in linked:
            out.append((doc, 0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, pairs = linked[k]
        shown = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        out.append((doc, n_a, n_b, len(groups), len(pairs), sum(holds[p] == top[p[0]] for p in pairs), sum(holds[p] for p in pairs), hashlib.sha256(shown.encode()).hexdigest()))
    return sorted(out, key=str)


def digests(df):
    return sorted(((r.doc_id, *(r[n] for n in NAMES)) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    out = list(enumerate(TEXTS))
    out += [(None, None), (7, None), (None, "twice twice"), (None, "twice twice")]
    alphabet = "aabbcdeé \n\t  .,'12ß漢😀-▁"
    out += [(100 + i, "".join(rng.choices(alphabet[: rng.choice([8, 14, len(alphabet) - 1, len(alphabet)])], k=rng.randint(1, 120)))) for i in range(250)]
    out += [(1000, " ".join("".join(rng.choices("abcdefgh", k=rng.randint(1, 9))) for _ in range(30_000)))]
    return out


def test_sparse_product_is_the_dense_one():
    rng = np.random.default_rng(1)

    def sparse(m):
        return alignment.CSR(np.concatenate(([0], np.cumsum((m != 0).sum(1)))), np.nonzero(m)[1], m[m != 0], m.shape[1])

    def dense(c):
        m = np.zeros((len(c.indptr) - 1, c.columns), int)
        m[c.rows, c.indices] = c.data
        return m

    for shape in ((4, 5, 6), (1, 1, 1), (30, 20, 10), (3, 0, 2), (0, 3, 2)):
        x, y = rng.integers(0, 3, shape[:2]), rng.integers(0, 2, shape[1:])
        assert (dense(sparse(x) @ sparse(y)) == x @ y).all() and (dense(sparse(x).transposed()) == x.T).all()


def test_against_brute_force(spark, rows, libraries):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = plain(rows, libraries)
    assert sum(r[1] == 0 for r in want) > 5 and sum(r[1] > 0 for r in want) > 150
    assert digests(alignment.align_documents(docs)) == want
    assert digests(alignment.align_documents(docs, sent_pairs=0)) == want  # the way beyond the bound


def test_words_are_kept_and_forgotten(rows, libraries, monkeypatch):
    monkeypatch.setattr(alignment, "KEPT_WORDS", 50)
    table = alignment.Aligner(alignment.A_FILE, alignment.B_FILE)
    for _, text in rows[:200]:
        at, starts = table.batch([text])
        alone = alignment.Aligner.batch(table, [text])
        assert len(at) == starts[-1] == len(alone[0])
    assert len(table.known) <= 51 + 60 and table.age > 1


def test_links_with_places(spark, libraries):
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, SCHEMA)
    counts = {r.doc_id: r.n for r in alignment.token_links(docs).groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    grouped = {r.doc_id: r.n for r in alignment.token_links(docs, by_group=True).groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    for r in alignment.align_documents(docs).collect():
        assert (counts.get(r.doc_id, 0), grouped.get(r.doc_id, 0)) == (r.n_links, r.n_group_links)
    one = sorted(map(tuple, alignment.token_links(spark.createDataFrame([(1, "don't")], SCHEMA)).select("a_at", "b_at", "bytes").collect()))
    assert sum(b for *_, b in one) == len(" don't")


def test_odd_tables(spark):
    odd = spark.createDataFrame([(None, None), (1, ""), (1, "x y"), (1, "x y")], SCHEMA)
    for c in ("n_a", "n", "pair", "best", "rid", "links", "a", "b"):
        odd = odd.withColumn(c, F.lit("7"))
    got = alignment.align_documents(odd).collect()
    assert len(got) == 4 and sum(r.n_links > 0 for r in got) == 2 and len({r.count_sum for r in got if r.n_links}) == 1
    assert alignment.align_documents(odd.where("false")).count() == 0


def test_registered_query_against_brute_force(spark, libraries):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    assert digests(queries.op11_token_alignment(spark, folder)) == plain(rows, libraries)
