"""Importance resampling against brute force, and its results on odd tables."""

import collections
import functools
import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from siteloom.llm import importance, queries

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
UPPER = {c: c + 32 for c in range(65, 91)}
SCHEMA = "doc_id bigint, text string"


def plain_features(text, low, high):
    words = WORD.findall((text or "").translate(UPPER))
    return words, [" ".join(words[i : i + n]) for n in range(low, high + 1) for i in range(len(words) - n + 1)]


def plain_resample(docs, target, percent=10, least=20, buckets=10_000, low=1, high=1):
    crc = lambda f: zlib.crc32(f.encode()) % buckets
    made = [(d, *plain_features(t, low, high)) for d, t in docs]
    s = collections.Counter(crc(f) for _, _, fs in made for f in fs)
    t = collections.Counter(crc(f) for x in target for f in plain_features(x, low, high)[1])
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = functools.cache(lambda b: math.floor(1000 * math.log((t[b] + 1) * (total_s + buckets) / ((s[b] + 1) * (total_t + buckets)))))
    out, able = {}, []
    for d, words, fs in made:
        weight = sum(gain(crc(f)) for f in fs)
        h = int(hashlib.sha256(f"2024:{d}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out[d] = [len(fs), weight, score, None]
        if len(words) >= least:
            able.append((-score, d))
    for i, (_, d) in enumerate(sorted(able)[: len(able) * percent // 100]):
        out[d][3] = i + 1
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    vocabulary = ["".join(rng.choices("abcdefé", k=rng.randint(1, 7))) for _ in range(300)]
    out = [(i, rng.choice([" ", ", ", "\n", " - "]).join(w.upper() if rng.random() < 0.2 else w for w in rng.choices(vocabulary, k=rng.choice([0, 5, 19, 20, 21, 80])))) for i in range(300)]
    out += [(300, " ".join(rng.choices(vocabulary, k=70_000))), (301, "É" * 600_000), (302, "x-" * 30), (303, "ÀÉ naïve Ünï 日本語 １２ K K ſ " * 5)]
    return out


@pytest.mark.parametrize("low,high,buckets", [(1, 1, 10_000), (1, 3, 500), (2, 2, 100_000)])
def test_against_brute_force(spark, rows, low, high, buckets):
    target = [t for _, t in rows[:30]]
    got = importance.resample(spark.createDataFrame(rows, SCHEMA).repartition(3), spark.createDataFrame([(t,) for t in target], "text string"), low=low, high=high, buckets=buckets)
    want = plain_resample(rows, target, low=low, high=high, buckets=buckets)
    assert {r.doc_id: [r.n_features, r.weight, r.score, r["rank"]] for r in got.collect()} == want


def test_registered_query_against_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    target = [r[0] for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("text").collect()]
    got = queries.op13_importance_resampling(spark, folder)
    assert {r.doc_id: [r.n_features, r.weight, r.score, r["rank"]] for r in got.collect()} == plain_resample(rows, target)
    assert {t for c, t in got.dtypes} == {"bigint"}


def test_odd_rows(spark):
    many = " ".join(map(str, range(30)))
    data = [(None, None), (1, None), (1, ""), (2, " .\n"), (3, many), (3, many), (4, many.upper()), (None, many), (None, many)]
    odd = spark.createDataFrame(data, SCHEMA)
    for c in ("_part", "_down", "rank", "score", "n_words", "buckets", "bucket", "n", "weight"):
        odd = odd.withColumn(c, F.lit("7"))
    target = spark.createDataFrame([(None,), (many,)], "text string").withColumn("doc_id", F.lit("x"))
    got = importance.resample(odd, target, percent=100).collect()
    assert len(got) == len(data)
    assert sorted(r["rank"] for r in got if r["rank"]) == [1, 2, 3, 4, 5]
    assert all((r.n_features, r.weight, r["rank"]) == (0, 0, None) for r in got if r.n_features == 0) and sum(r.n_features == 0 for r in got) == 4
    assert {r.weight for r in got if r.n_features} and len({r.weight for r in got if r.n_features}) == 1
    none = importance.resample(odd.where("false"), target)
    assert none.count() == 0 and none.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    level = importance.resample(odd, target.where("false")).collect()
    assert len(level) == len(data)


def test_ties_go_to_the_smaller_id(spark):
    scored = spark.createDataFrame([(i, 50, 5, 0, i % 7) for i in range(1000)] + [(None, 50, 5, 0, 6)], "doc_id bigint, n_words bigint, n_features bigint, weight bigint, score bigint")
    got = {r.doc_id: r["rank"] for r in importance.ranked(scored, "n_words >= 20", 40).collect()}
    want = sorted(((-(i % 7), i) for i in range(1000)))[:400]
    drawn = [d for _, d in sorted((r, d) for d, r in got.items() if r)]
    assert len(drawn) == 400 and drawn[142] is None and got[None] == 143
    assert drawn[:142] + drawn[143:] == [i for _, i in sorted((-(i % 7), i) for i in range(1000))][:399]
