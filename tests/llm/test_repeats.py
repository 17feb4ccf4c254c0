"""Repeated byte strings against brute force, and their results on odd tables."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siteloom.llm import queries, repeats

SCHEMA = "doc_id bigint, text string"


def plain(texts, length):
    """n_bytes, n_removed, n_spans and the digest of what is left, of texts in order."""
    seen, out = set(), []
    for text in texts:
        data = (text or "").encode()
        gone = np.zeros(len(data) + 1, bool)
        for i in range(len(data) - length + 1):
            window = data[i : i + length]
            if window in seen:
                gone[i : i + length] = True
            seen.add(window)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out.append((len(data), int(gone.sum()), int((gone[1:] < gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def digests(df):
    out = df.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("gone"), F.size("spans").alias("n"), F.sha2("kept", 256).alias("h"))
    return {r.doc_id: tuple(r)[1:] for r in out.collect()}


@pytest.mark.parametrize("letters,length", [("ab", 5), ("abcé", 8), ("a", 3), ("abcdefgh\x00", 12)])
def test_blocks_against_brute_force(letters, length):
    rng = random.Random(len(letters) + length)
    for _ in range(60):
        strings = ["".join(rng.choices(letters, k=rng.randint(0, 60))).encode() for _ in range(rng.randint(1, 12))]
        if rng.random() < 0.5:
            strings += [s[rng.randint(0, 3) :] for s in strings[:3]]
        seen, want = set(), []
        for s in strings:
            windows = [s[i : i + length] for i in range(len(s) - length + 1)]
            want.append([])
            for i, w in enumerate(windows):
                if w in seen:
                    want[-1].append(i)
                seen.add(w)
        assert [x.tolist() for x in repeats.repeated_windows(strings, length)] == want


def test_levels_give_the_common_prefixes():
    """What is parted before level m is what has a common prefix of less than m bytes."""
    rng = random.Random(4)
    text = np.frombuffer(b"\xff".join("".join(rng.choices("ab", k=40)).encode() for _ in range(8)) + b"\xff", np.uint8) + np.uint8(1)
    data = text.tobytes()
    for length in (1, 2, 5, 9, 17):
        order, parted = repeats.equal_windows(text, length)
        for j in range(1, len(order)):
            a, b = data[order[j - 1] :][:length], data[order[j] :][:length]
            if 0 not in a and 0 not in b and len(a) == len(b) == length:
                assert bool(parted[j]) == (a != b)


def test_segments_hold_every_window_once():
    rng = random.Random(8)
    texts = ["".join(rng.choices("abc", k=rng.choice([0, 5, 39, 40, 41, 90, 400]))).encode() for _ in range(40)] + [b"a" * 3000]
    data, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts])
    hasher = repeats.Hasher(len(data) + 1000)
    for length, gram in ((40, 12), (40, 39), (20, 1)):
        key, own, start, windows = repeats.segments(data, ends, length, gram, hasher)
        marked, windows = windows >= repeats.AGAIN, windows % repeats.AGAIN
        for s, w, m in zip(start.tolist(), windows.tolist(), marked.tolist()):
            assert m or len({data[i : i + length].tobytes() for i in range(s, s + w)}) == w
        covered = np.concatenate([np.arange(s, s + w) for s, w in zip(start, windows)])
        begins = np.concatenate(([0], ends[:-1]))
        want = [b + i for b, t in zip(begins, texts) for i in range(len(t) - length + 1)]
        assert sorted(covered.tolist()) == want
        keys = {}
        for k, s, w in zip(key.tolist(), start.tolist(), windows.tolist()):
            for i in range(s, s + w):
                assert keys.setdefault(data[i : i + length].tobytes(), k) == k


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choices(words, k=n))
    passages = [prose(14)[:99], prose(20)[:100], prose(20)[:101], prose(60), "é" * 80, "日本" + prose(30)]
    out = []
    for i in range(150):
        parts = [prose(rng.choice([1, 10, 60])) for _ in range(3)]
        for _ in range(rng.choice([0, 0, 1, 3])):
            parts.insert(rng.randrange(4), rng.choice(passages))
        out.append(rng.choice([" ", "\n"]).join(parts))
    out += out[:10] + [t[:-1] for t in out[10:15]] + ["x" + t for t in out[15:20]]
    out += ["a" * 5000, "ab" * 1000, "b" * 99, "b" * 100, "", None, "z" * 101, prose(3000) * 2, "\x00" * 250, passages[3] * 4]
    ids = rng.sample(range(-500, 5000), len(out))
    return sorted(zip(ids, out))


@pytest.mark.parametrize("length,gram,hot", [(100, 40, repeats.HOT), (100, 40, 0), (100, 40, 3), (60, 59, 5), (30, 8, 2)])
def test_against_brute_force(spark, rows, length, gram, hot):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = digests(repeats.remove_repeats(docs, length, gram, hot))
    assert [got[d] for d, _ in rows] == plain([t for _, t in rows], length) and len(got) == len(rows)


def test_texts_longer_than_a_piece(spark, monkeypatch):
    rng = random.Random(6)
    monkeypatch.setattr(repeats, "CHUNK", 1000)
    text = "".join(rng.choices("abcdefgh ", k=7000))
    rows = [(1, text), (2, text[500:6000] + "!" + text[:450]), (3, "q" * 4000)]
    data = [(d, t.encode()) for d, t in rows]
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([d for d, _ in data]), pa.array([t for _, t in rows])], names=["doc", "text"])
    pieces = list(repeats._chunks(iter([batch]), 100))
    windows = {d: 0 for d, _ in rows}
    for block, ends, doc, at in pieces:
        begin = np.concatenate(([0], ends[:-1]))
        for b, e, d, a in zip(begin.tolist(), ends.tolist(), doc.tolist(), at.tolist()):
            assert block[b:e].tobytes() == dict(data)[d][a : a + e - b]
            windows[d] += e - b - 99
    assert windows == {d: len(t) - 99 for d, t in rows}


def test_odd_rows(spark):
    long = "0123456789" * 30
    data = [(None, None), (1, None), (1, ""), (2, long), (2, long), (2, "x" + long), (None, long), (None, long), (-5, "émoji 😀" * 40)]
    odd = spark.createDataFrame(data, SCHEMA)
    for c in ("doc", "r", "s", "place", "start", "end", "spans", "part", "kept", "again", "n", "windows"):
        odd = odd.withColumn(c, F.lit("7"))
    got = repeats.remove_repeats(odd).collect()
    assert len(got) == len(data)
    first = [r for r in got if r.doc_id is None and r.n_bytes]
    assert sorted(len(r.kept) for r in first) == [0, 10]  # the text repeats itself after ten bytes
    assert sorted(len(r.kept) for r in got if r.doc_id == 2) == [0, 0, 1]
    assert all(not r.spans and r.kept == b"" for r in got if r.n_bytes == 0)
    assert repeats.remove_repeats(odd.where("false")).count() == 0


def test_registered_query_against_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    rows = sorted(tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect())
    got = {r.doc_id: tuple(r)[1:] for r in queries.op12_interval_expansion(spark, folder).collect()}
    assert [got[d] for d, _ in rows] == plain([t for _, t in rows], 100)
