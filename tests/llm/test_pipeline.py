"""The pipeline's stages against brute force, and what the mix does to its sequences."""

import collections
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from siteloom.llm import outliers, packing, pfair, secret_scan
from siteloom.llm.common import materialize, work_path
from siteloom.llm.tokens import encoder
from tests.llm.test_operators import SCHEMA, brute_components, words


def first_seen(packed):
    """Document ids in the order of the sequences that hold their first piece."""
    firsts = sorted((r.sequence_id, r.offset, r.doc_id) for r in packed if r.start == 0)
    return [d for _, _, d in firsts]


@pytest.fixture(scope="module")
def sources(spark):
    rng, data = random.Random(8), []
    for source, n in (("big", 900), ("mid", 225), ("low", 100)):
        for _ in range(n):
            text = words(rng, rng.choice([3, 20, 60, 150, 1500 if len(data) % 40 == 0 else 90]))
            data.append((len(data), text, "en", source, len(text)))
    return data


def test_mix_shows_in_prefixes_of_the_sequences(spark, sources):
    """Through files, as the pipeline goes: order and sources of documents follow the slots, source shares the weights."""
    docs, path = spark.createDataFrame(sources, SCHEMA).repartition(3), work_path(spark, "mixed")
    corpus_pipeline.mix(spark, docs, "").write.parquet(path)
    mixed = spark.read.parquet(path)
    order = [r.doc_id for r in sorted(mixed.select("doc_id", "slot", "place").collect(), key=lambda r: (r.slot, r.place))]
    assert sorted(order) == list(range(len(sources)))
    source = {r[0]: r[3] for r in sources}
    rank = {d: i for i, d in enumerate(order)}
    packed, earliest = corpus_pipeline.pack(spark, mixed, "").collect(), {}
    for r in packed:
        earliest[r.sequence_id] = min(earliest.get(r.sequence_id, len(order)), rank[r.doc_id])
    assert sorted(first_seen(packed)) == sorted(order)
    assert [earliest[s] for s in sorted(earliest)] == sorted(earliest.values())  # each partition is one round
    got = first_seen(packing.pack_documents(mixed, pending=32, order=("slot", "place")).collect())
    assert sorted(got) == sorted(order)
    moved = max(abs(rank[d] - i) for i, d in enumerate(got))
    assert moved <= 2 * 32, moved
    weights = {"big": 30 / 55, "mid": 15 / 55, "low": 10 / 55}
    done, worst = collections.Counter(), 0.0
    for i, d in enumerate(got[:450], 1):  # all sources last so long
        done[source[d]] += 1
        worst = max(worst, *(abs(done[s] - w * i) for s, w in weights.items()))
    assert worst <= 16 + 16 + 2 * 32  # a block of the schedule, one begun, and the rounds; input order has 205


def test_step_groups_and_sequences_ascend_with_the_mix(spark, sources):
    docs = pfair.placed_documents(spark.createDataFrame(sources, SCHEMA))
    rows = packing.pack_documents(docs, pending=32, step_tokens=4096, order=("slot", "place")).collect()
    first = {}
    for r in rows:
        first[r.step_group] = min(first.get(r.step_group, r.sequence_id), r.sequence_id)
    assert [first[g] for g in sorted(first)] == sorted(first.values())
    used, tier = collections.Counter(), {}
    for r in rows:
        used[r.sequence_id] += r.length
        tier[r.sequence_id] = r.tier
    short = [s for s in used if used[s] < tier[s]]
    assert len({s >> 36 for s in short}) == len(short) and all(used[s] < 64 for s in short)


def test_stages(spark, tmp_path):
    rng, data = random.Random(3), []
    base = words(rng, 150).split(" ")
    for i in range(60):
        copy = list(base)
        for _ in range(i % 6):
            copy[rng.randrange(150)] = f"other{rng.randrange(9)}"
        text = " ".join(copy) if i % 3 == 0 else words(rng, 80)
        data.append((i, text, "en", f"s{i % 2}", len(text)))
    spark.createDataFrame(data, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    want = brute_components({r[0]: r[1] for r in data}, 5, 80)
    near = corpus_pipeline.near_duplicates(spark, docs, "")
    assert {r.doc_id for r in near.collect()} == {d for d, (_, root) in want.items() if d == root}
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = materialize(stage(spark, before, str(tmp_path)), name)
    encode, pieces = encoder("word_bpe_49k.json").whole, collections.defaultdict(list)
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        pieces[r.doc_id].append(r)
    left = {r.doc_id: r.text for r in before.collect()}
    assert set(pieces) == set(left) and left
    for d, text in left.items():
        ids, at = encode(text) + b"\1\0\0\0", 0
        for r in sorted(pieces[d], key=lambda r: r.start):
            assert (r.start, r.ids_crc32) == (at, zlib.crc32(ids[4 * at : 4 * (at + r.length)]))
            at += r.length
        assert 4 * at == len(ids)


def test_quality_and_secrets_by_brute_force(spark):
    """What quality keeps is what base rules and distances of the fitted estimate keep, by numpy; secrets are cut where the spans are, in plain Python."""
    rng, data = random.Random(6), []
    for i in range(160):
        text = words(rng, rng.randint(5, 200)) if i % 8 else "### | ".join(words(rng, 60).split(" "))
        secret = "".join(rng.choices("0123456789abcdef", k=40))
        data.append((i, f"{text} token: {secret} end" if i % 5 == 0 else text, "en" if i % 2 else None, "s", len(text)))
    docs = spark.createDataFrame(data, SCHEMA)
    stats = outliers.quality_statistics(docs)
    params = {r.lang: r.params for r in outliers.fit(stats).collect()}
    cut = outliers.chi_square_quantile(outliers.TAIL, 4)
    want = set()
    for r in stats.collect():
        p = params[r.lang]
        lower = np.array([[p[f"l{i}{j}"] if j <= i else 0.0 for j in range(4)] for i in range(4)])
        z = np.linalg.solve(lower, np.array([r[d] for d in outliers.DIMENSIONS]) / outliers.SCALE - np.array([p[f"m{i}"] for i in range(4)]))
        if not r.base_failed and z @ z <= cut:
            want.add(r.doc_id)
    good = corpus_pipeline.quality(spark, docs, "")
    assert {r.doc_id for r in good.collect()} == want and good.columns == docs.columns
    spans = {r.doc_id: r.spans for r in secret_scan.find_secrets(docs).collect()}
    for r in corpus_pipeline.secrets(spark, docs, "").collect():
        clean, at = "", 0
        for i, j in sorted((int(x.split(":")[1]), int(x.split(":")[2])) for x in filter(None, spans[r.doc_id].split(","))):
            clean += (data[r.doc_id][1][at:i] + "[SECRET]") if i >= at else ""
            at = max(at, j)
        assert r.text == clean + data[r.doc_id][1][at:] and (r.doc_id % 5 or "token: " not in r.text)


def test_odd_rows_pass_every_stage(spark):
    """Nulls in every column, empty, long and repeated rows, clashing columns; then no rows at all."""
    rng = random.Random(2)
    long = words(rng, 30_000)
    data = [(None, None, None, None, None), (1, None, "en", "a", 0), (1, "", "en", None, 0), (2, " \n\t ", None, "a", 4), (3, "x y z w", "en", "a", 7), (3, "x y z w", "en", "a", 7), (None, long, "en", "a", 7), (4, long, "en", "a", 7), (5, long + " more", "en", None, 7), (-6, "émoji 😀 " * 30, "fr", "b", 9)]
    data += [(10 + i, words(rng, 60), "en", "a", 1) for i in range(50)]
    odd = spark.createDataFrame(data, SCHEMA)
    for c in ("_row", "slot", "place", "grp", "rid", "_spans", "n", "block"):
        odd = odd.withColumn(c, F.lit(7))
    ids = lambda df: sorted(((r.doc_id is None, r.doc_id or 0) for r in df.select("doc_id").collect()))
    good = materialize(corpus_pipeline.quality(spark, odd, ""), "good")
    assert good.columns == ["doc_id", "text", "lang", "source", "n_chars"] and {1, 2, 3} & {r.doc_id for r in good.collect()} == set()
    one = materialize(corpus_pipeline.near_duplicates(spark, odd, ""), "one")
    assert ids(one) == sorted([(True, 0), (True, 0)] + [(False, i) for i in (1, 2, 3, 4, -6, *range(10, 60))])
    clean = materialize(corpus_pipeline.secrets(spark, one, ""), "clean")
    mixed = materialize(corpus_pipeline.mix(spark, clean, ""), "mixed")
    assert ids(clean) == ids(mixed) == ids(one) and mixed.groupBy("slot", "place").count().where("count > 1").count() == 0
    packed = corpus_pipeline.pack(spark, mixed, "")
    assert ids(packed.where("start = 0")) == ids(one)
    none = odd.where("false")
    for _, stage in corpus_pipeline.STAGES:
        none = stage(spark, none, "")
        assert none.count() == 0
