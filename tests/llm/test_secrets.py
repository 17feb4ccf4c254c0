"""Keys that no rule names, near misses, overlaps and very long texts in secret scans."""

import random
import re
import string
import time

import pytest
from pyspark.sql import functions as F

from siteloom.llm import secret_scan

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
SYLLABLES = "ka to mi re lo sun ter ing ble the an er st ou".split()
LETTERS = string.ascii_letters + string.digits
KEYS = {
    "base62": lambda rng: "".join(rng.choices(LETTERS, k=24)),
    "base64": lambda rng: "".join(rng.choices(LETTERS + "+/", k=40)),
    "upper": lambda rng: "".join(rng.choices(string.ascii_uppercase + "234567", k=26)),
    "short": lambda rng: "".join(rng.choices(LETTERS, k=16)),
}
PLACES = ("see %s here", '"%s",', "http://a.example/v1/files/%s?x=1", "(?key=%s&b=2)")


def word(rng):
    return "".join(rng.choices(SYLLABLES, k=rng.randint(1, 5)))


def prose(rng, n):
    return " ".join(word(rng) for _ in range(n))


@pytest.fixture(scope="module")
def model(spark):
    """Trained on assigned hex values only: no form of KEYS is ever labelled."""
    rng = random.Random(8)
    data = [(i, f"{prose(rng, 700)} token: {''.join(rng.choices('0123456789abcdef', k=40))} {prose(rng, 200)}", "en", "s", 0) for i in range(120)]
    return secret_scan.train(spark.createDataFrame(data, SCHEMA)).cache()


def scanned(spark, model, texts):
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], SCHEMA)
    return {r.doc_id: r for r in secret_scan.find_secrets(df, model=model).collect()}


def test_unlabelled_keys_are_found_and_near_misses_stay(spark, model):
    rng = random.Random(9)
    planted = [(kind, make(rng), rng.choice(PLACES)) for kind, make in KEYS.items() for _ in range(50)]
    camel = lambda n: word(rng) + "".join(word(rng).capitalize() for _ in range(n))
    near = [f() for f in (
        lambda: camel(3), lambda: camel(3) + str(rng.randrange(100)), lambda: "_".join(word(rng) for _ in range(4)).upper(), lambda: f"INV-20{rng.randrange(10, 30)}-{rng.randrange(10**5):05d}",
        lambda: f"20{rng.randrange(10, 30)}-{rng.randrange(1, 13):02d}-17T{rng.randrange(24):02d}", lambda: "".join(rng.choices(string.digits, k=16)), lambda: "/".join(word(rng) for _ in range(5)),
    ) for _ in range(40)]
    got = scanned(spark, model, [place % key for _, key, place in planted] + [f"{prose(rng, 5)} {x} {prose(rng, 5)}" for x in near])
    found = {kind: 0 for kind in KEYS}
    for i, (kind, key, place) in enumerate(planted):
        at = (place % key).index(key)
        spans = [tuple(map(int, s.split(":")[1:])) for s in got[i].spans.split(",") if s.startswith("markov")]
        covered = sum(max(0, min(b, at + len(key)) - max(a, at)) for a, b in spans)
        found[kind] += covered >= 0.9 * len(key)
    assert all(n >= 45 for n in found.values()), found
    wrong = [x for i, x in enumerate(near, len(planted)) if got[i].n_markov]
    assert len(wrong) <= len(near) // 50, wrong


def test_ordinary_texts_stay(spark, model):
    rng = random.Random(10)
    got = scanned(spark, model, [prose(rng, 2000) for _ in range(20)])
    assert sum(r.n_markov for r in got.values()) <= 1


def test_spans_do_not_overlap_the_base(spark, model):
    rng = random.Random(11)
    texts = []
    for _ in range(60):
        parts = [rng.choice([KEYS["base62"](rng), f"token={KEYS['base62'](rng)}", "AKIA" + KEYS["upper"](rng), "".join(rng.choices("0123456789abcdef", k=40)), word(rng), "é😀"]) for _ in range(12)]
        texts.append("".join(p + rng.choice([" ", "/", "", "."]) for p in parts))
    for r in scanned(spark, model, texts).values():
        all_of = [(s.split(":")[0], *map(int, s.split(":")[1:])) for s in r.spans.split(",") if s]
        base, added = [s for s in all_of if s[0] != "markov"], [s for s in all_of if s[0] == "markov"]
        assert len(added) == r.n_markov and all(b[2] <= a[1] or a[2] <= b[1] for a in added for b in base)
        assert all(a[2] <= b[1] for a, b in zip(added, added[1:])) and all(a[2] - a[1] >= secret_scan.LEAST for a in added)


def test_running_values_and_halving(spark):
    rng = random.Random(12)
    rows = [(i, sorted(rng.choices(range(50), k=i)), rng.randrange(60)) for i in range(40)]
    df = spark.createDataFrame(rows, "n int, a array<int>, x int")
    total, most = secret_scan.running(F.col("a"), lambda a, b: a + b), secret_scan.running(F.reverse("a"), F.greatest)
    for r in df.select("a", "x", total.alias("t"), most.alias("m"), secret_scan.below(F.col("a"), F.col("x")).alias("k")).collect():
        assert r.t == [sum(r.a[: i + 1]) for i in range(len(r.a))] and r.m == [max(r.a, default=0)] * len(r.a) and r.k == sum(v < r.x for v in r.a)


def test_long_text_of_many_matches(spark, model):
    """A text of 5 MB with 100,000 matches: found and cut out in seconds, each where it is."""
    rng = random.Random(13)
    text = " ".join(f"{prose(rng, 3)} é token: {''.join(rng.choices('0123456789abcdef', k=20))}" for _ in range(100_000))
    one = spark.createDataFrame([(1, text, "en", "s", len(text))], SCHEMA)
    began = time.perf_counter()
    spans = [s for s in secret_scan.find_secrets(one, model=model).first().spans.split(",") if s.startswith("assign")]
    clean = secret_scan.redact(one, model=model).first().text
    assert time.perf_counter() - began < 90
    want = [m.span() for m in re.finditer("token: [0-9a-f]{20}", text)]
    assert spans == [f"assign:{i}:{j}" for i, j in want] and len(text) > 4_000_000
    assert clean == re.sub("token: [0-9a-f]{20}", "[SECRET]", text)
