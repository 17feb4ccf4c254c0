"""Secret scans with character Markov models, with DataFrame functions only.

Base rules find assigned secrets, access keys and hex strings. The method adds parts of tokens that look drawn at random.
Every token of twelve or more key characters that overlaps no base span is judged: the log-likelihood ratio of two first-order
Markov models, one of random strings and one of ordinary identifiers, is summed along it, and the stretch with the highest
sum, widened to the separators around it, is the candidate; so a key is found inside a path or a query string. A letter
is a step to the same letter in either case, times whether the case changes, so that constants and camel-case names are
judged by their letters.

The models are trained here on a bounded number of labelled documents: random strings are the values that the base rules
find, half and half with evenly drawn characters; ordinary identifiers are the other words, paths, names and numbers, and
joined names, dates and numbers made from them. One form in four is held out. A sum counts if it exceeds log(length / FALSE_RATE),
which bounds the chance that an ordinary token of that length reaches it if the model holds, by more than what all but one
in 1 / HELD_RATE of the held-out forms of its length class do. Only forms that recur in different texts calibrate, since a key that nothing labels seldom does.

Positions come from splitting: pieces between matches and matches alternate, and running sums of their lengths are places.
Running values take log(n) rounds over an array and never grow one match by match.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteloom.llm.common import DOCUMENT_COLUMNS, bounded_sample, discard, let, materialize

#: The base rules.
ASSIGN = "(?i:password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{12,}"
#: Not starting inside a run finds the same matches as trying each of its characters.
HEX = "(?<![0-9a-f])[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "markov")
#: Least length of what the models judge, and tokens of that length.
LEAST = 12
TOKEN = f"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{LEAST},}}"
#: Characters by place from 1: upper case to 26, lower case to 52, digits to 62, then +, and from SEPARATOR on what separates.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
SEPARATOR, WIDTH = 64, len(ALPHABET) + 1
#: Words to train the model of ordinary identifiers on.
WORD = "(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{6,}"
#: Chance that an ordinary token is taken, by the model and by held-out forms.
FALSE_RATE, HELD_RATE = 1e-4, 1e-3
#: Length classes of held-out forms, by least length; a class with fewer than 1 / HELD_RATE forms takes the figure of all forms.
CLASSES = (0, 12, 16, 24, 40)
#: One word form in so many is joined with others into names to train on.
JOINED = 32
#: Code points in a piece of a text that is cut up to be put together anew.
CHUNK = 256
SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"


def running(values: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """Running results of an associative merge over an array without nulls: in round k each place takes in that 2**k before it."""
    shifts = F.transform(F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(values), F.lit(1)))).cast("int")), lambda k: F.pow(F.lit(2.0), k).cast("int"))
    return F.aggregate(shifts, values, lambda a, d: F.transform(a, lambda x, i: F.coalesce(merge(x, F.get(a, i - d)), x)))


def below(ascending: Column, x: Column) -> Column:
    """How many elements of an ascending array are less than x, by halving."""

    def halve(at: Column, _: Column) -> Column:
        mid = F.floor((at["lo"] + at["hi"]) / 2).cast("int")
        less = F.get(ascending, mid) < x
        return F.when(at["lo"] >= at["hi"], at).otherwise(F.struct(F.when(less, mid + 1).otherwise(at["lo"]).alias("lo"), F.when(less, at["hi"]).otherwise(mid).alias("hi")))

    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.size(ascending) + 1)).cast("int"))
    return F.aggregate(rounds, F.struct(F.lit(0).alias("lo"), F.size(ascending).alias("hi")), halve)["lo"]


def spans(text: Column, pattern: str, kind: int, group: int = 0, least: int = 0) -> Column:
    """Array of (start, kind, end, value): the matches, leftmost and not overlapping, whose group has so many characters."""
    all_of = lambda g: F.regexp_extract_all(text, F.lit(pattern), F.lit(g))
    found = [F.split(text, pattern, -1).alias("p"), all_of(0).alias("m"), *([all_of(group).alias("v")] if group else [])]
    sizes = let(F.struct(*found), lambda x: F.transform(x["m"], lambda m, i: F.struct(
        F.length(m).alias("own"), (F.length(F.get(x["p"], i)) + F.length(m)).alias("step"), (F.get(x["v"], i) if group else m).alias("value"))))
    placed = let(sizes, lambda rows: let(
        running(F.transform(rows, lambda r: r["step"]), lambda a, b: a + b),
        lambda ends: F.transform(rows, lambda r, i: F.struct((F.get(ends, i) - r["own"]).alias("start"), F.lit(kind).alias("kind"), F.get(ends, i).alias("end"), r["value"].alias("value"))),
    ))
    kept = F.filter(placed, lambda s: F.length(s["value"]) >= least) if least else placed
    return F.when(F.regexp_like(text, F.lit(pattern)), kept).otherwise(F.array().cast(SPAN))


def base_spans(text: Column) -> Column:
    """The spans of the base rules, by start, then kind."""
    return F.array_sort(F.concat(spans(text, ASSIGN, 0, 1, 8), spans(text, ACCESS, 1), spans(text, HEX, 2)))


def pair_counts(strings: DataFrame, label: str) -> DataFrame:
    """(x, y, n): how often each two characters, by place in ALPHABET, follow each other in the column `s`, `w` times each."""
    pairs = let(places(F.col("s")), lambda c: F.transform(F.slice(c, 2, F.size(c)), lambda y, i: F.struct(F.get(c, i).alias("x"), y.alias("y"))))
    return strings.where(F.length("s") > 1).select(F.inline(pairs), "w").groupBy("x", "y").agg(F.sum("w").alias(label))


def places(token: Column) -> Column:
    """The characters of a token by their places in ALPHABET."""
    return F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c))


def ordinary_forms(docs: DataFrame) -> DataFrame:
    """(s, t): ordinary identifiers of the documents' columns w, other words, and t, a hash of the text: each word, and, of one form in JOINED by hash, names joined from it and the next such one."""
    pair = F.transform(F.filter("w", lambda x: (F.length(x) < 40) & (F.pmod(F.xxhash64(x), F.lit(JOINED)) == 1)), lambda x: F.lower(x))
    joined = let(pair, lambda p: F.flatten(F.transform(p, lambda a, i: let(F.struct(a.alias("a"), F.coalesce(F.get(p, i + 1), a).alias("b")), lambda x: F.array(
        F.concat_ws("_", x["a"], x["b"]), F.upper(F.concat_ws("_", x["a"], x["b"])), F.concat_ws("-", x["a"], x["b"]), F.concat(F.lit("/"), x["a"], F.lit("/"), x["b"]),
        F.concat(x["a"], F.initcap(x["b"])), F.concat(F.initcap(x["a"]), F.initcap(x["b"])), F.concat(x["a"], F.lit("="), (i % 10_000).cast("string")), F.concat(x["a"], (i % 100).cast("string")),
    )))))
    made = docs.select(F.explode(joined).alias("s"), "t", F.lit(1.0).alias("w"))
    day = F.date_add(F.lit("1980-01-01").cast("date"), (F.col("id") * 7).cast("int"))
    number = lambda i: F.pmod(F.xxhash64("id", F.lit(i)), F.lit(10**12))
    dates = docs.sparkSession.range(3000).select(F.explode(F.array(
        F.date_format(day, "yyyy-MM-dd"), F.date_format(day, "yyyyMMdd"), F.date_format(day, "yyyy/MM/dd"), F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T"), F.lpad((F.col("id") % 24).cast("string"), 2, "0")),
        F.lpad(number(1).cast("string"), 12, "0"), F.concat_ws("-", (number(2) % 1000).cast("string"), (number(3) % 100_000).cast("string"), (number(4) % 1000).cast("string")),
    )).alias("s"), F.col("id").alias("t"), F.lit(1.0).alias("w"))
    return docs.select(F.explode("w").alias("s"), "t", F.lit(1.0).alias("w")).unionByName(made).unionByName(dates)


def train(docs: DataFrame, rows: int = 20_000) -> DataFrame:
    """One row with `model`: `llr`, log-likelihood ratios by WIDTH * first + second place in ALPHABET, and `over`, what a sum must exceed besides, by length class.

    Trained on about `rows` documents, chosen by a hash. An unseen pair of ordinary characters backs off to its second
    character's share. Without labelled secrets random strings are evenly drawn ones.
    """
    some = bounded_sample(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), rows)
    values = lambda x: x["value"]
    some = materialize(some.select(F.xxhash64("text").alias("t"), F.transform(base_spans(F.col("text")), values).alias("b"), F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("w")), "labelled")
    secret = some.select(F.explode("b").alias("s"), F.lit(1.0).alias("w")).where(F.length("s") >= 16)
    known = F.concat_ws(" ", "b")
    forms = ordinary_forms(some.withColumn("w", F.when(F.size("b") > 0, F.filter("w", lambda x: ~F.contains(known, x))).otherwise(F.col("w"))))
    forms = materialize(forms.groupBy("s").agg(F.sum("w").alias("w"), (F.min("t") < F.max("t")).alias("recurs")).withColumn("held", F.pmod(F.xxhash64("s"), F.lit(4)) == 0), "forms")
    counts = pair_counts(secret, "r").join(pair_counts(forms.where("not held"), "o"), ["x", "y"], "full")
    k = len(ALPHABET)
    grid = docs.sparkSession.range(k * k).select((F.col("id") % k + 1).cast("int").alias("x"), (F.floor(F.col("id") / k) + 1).cast("int").alias("y"))
    fold = lambda c: F.when(F.col(c) <= 26, F.col(c) + 26).otherwise(F.col(c))
    n = grid.join(counts, ["x", "y"], "left").fillna(0, ["r", "o"]).select("x", "y", "r", "o", fold("x").alias("fx"), fold("y").alias("fy"))
    letters, changed = (F.col("fx") <= 52) & (F.col("fy") <= 52), (F.col("x") <= 26) != (F.col("y") <= 26)
    case = n.where(letters).agg(*[((F.sum(F.when(changed, F.col(c)).otherwise(0.0)) + 1) / (F.sum(c) + 2)).alias(f"q{c}") for c in "ro"])
    folded = n.groupBy("fx", "fy").agg(F.sum("r").alias("r"), F.sum("o").alias("o"))
    first, every = Window.partitionBy("fx"), Window.partitionBy()
    even = F.when(F.col("fy") < SEPARATOR - 1, 0.98 / 36).otherwise(0.02 / 5)
    drawn = (F.coalesce(F.try_divide("r", F.sum("r").over(first)), even) + even) / 2
    many, kinds = F.sum("o").over(first), F.count_if(F.col("o") > 0).over(first)
    new = F.greatest(F.lit(0.01), F.coalesce(F.try_divide(kinds, many + kinds), F.lit(1.0)))
    single = F.coalesce(F.try_divide(F.sum("o").over(Window.partitionBy("fy")), F.sum("o").over(every)), F.lit(1 / 41))
    usual = (1 - new) * F.coalesce(F.try_divide("o", many), F.lit(0.0)) + new * (0.99 * single + 0.01 / 41)
    steps = folded.select("fx", "fy", (F.log(drawn) - F.log(usual)).alias("l"))  # at most 41 * 41 rows
    turn = F.when(letters, F.when(changed, F.log((F.col("qr") + 0.5) / 2) - F.log("qo")).otherwise(F.log(1 - (F.col("qr") + 0.5) / 2) - F.log(1 - F.col("qo")))).otherwise(0.0)
    table = n.join(F.broadcast(steps), ["fx", "fy"]).join(F.broadcast(case)).select((F.col("x") * WIDTH + F.col("y")).alias("i"), F.greatest(F.lit(-4.0), F.least(F.lit(4.0), F.col("l") + turn)).alias("l"))
    filled = table.agg(F.map_from_entries(F.collect_list(F.struct("i", "l"))).alias("m"))  # 67 * 67 entries
    ratios = materialize(filled.select(F.transform(F.sequence(F.lit(0), F.lit(WIDTH * WIDTH)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0.0))).alias("llr")), "ratios")
    tested = forms.where("held and recurs").withColumn("llr", ratios.scalar()).select(length_class(F.length("s")).alias("c"), excess(F.col("s"), F.length("s"), F.col("llr")).alias("e"))
    high = lambda: F.greatest(F.lit(0.0), F.percentile("e", 1 - HELD_RATE))
    own = tested.groupBy("c").agg(high().alias("e"), F.count("*").alias("n")).where(F.col("n") >= 1 / HELD_RATE)
    found = own.agg(F.map_from_entries(F.collect_list(F.struct("c", "e"))).alias("own")).join(tested.agg(F.coalesce(high(), F.lit(0.0)).alias("all")))  # a row each
    over = F.transform(F.sequence(F.lit(0), F.lit(len(CLASSES) - 1)), lambda c: F.coalesce(F.try_element_at("own", c), F.col("all")))
    model = materialize(ratios.join(found.select(over.alias("over"))).select(F.struct("llr", "over").alias("model")), "markov")
    discard(some, forms, ratios)
    return model


def length_class(length: Column) -> Column:
    """Place of the last class that begins at or below a length."""
    return sum(((length >= n).cast("int") for n in CLASSES[1:]), F.lit(0))


def stretch(token: Column, llr: Column) -> Column:
    """(best, b, e): the highest sum of ratios along a token, and where it is, from 1, both ends included and widened to separators."""
    steps = let(places(token), lambda c: F.transform(c, lambda y, i: F.struct((y >= SEPARATOR).alias("cut"), F.coalesce(F.get(llr, F.get(c, i - 1) * WIDTH + y), F.lit(0.0)).alias("l"))))
    start = F.struct(F.lit(0).alias("i"), F.lit(1).alias("part"), F.lit(0.0).alias("run"), F.lit(1).alias("since"), F.lit(0.0).alias("best"), F.lit(1).alias("b"), F.lit(0).alias("e"))

    def step(a: Column, x: Column) -> Column:
        i, run, since = a["i"] + 1, F.greatest(a["run"], F.lit(0.0)) + x["l"], F.when(a["run"] > 0, a["since"]).otherwise(a["part"])
        better = run > a["best"]
        wider = better | ((a["e"] == a["i"]) & (a["e"] > 0) & ~x["cut"])
        return F.struct(
            i.alias("i"), F.when(x["cut"], i + 1).otherwise(a["part"]).alias("part"), run.alias("run"), since.alias("since"), F.greatest(a["best"], run).alias("best"),
            F.when(better, since).otherwise(a["b"]).alias("b"), F.when(wider, i).otherwise(a["e"]).alias("e"),
        )

    return F.aggregate(steps, start, step, lambda a: F.struct(a["best"], a["b"], a["e"]))


def excess(token: Column, length: Column, llr: Column) -> Column:
    """By how much the highest sum along a token exceeds what the false rate asks for."""
    return stretch(token, llr)["best"] - F.log(length / F.lit(FALSE_RATE))


def marked(docs: DataFrame, model: DataFrame, margin: float) -> DataFrame:
    """docs with `_spans`: the base spans and the model's, by start, then kind. A model span doesn't overlap a base span."""
    joined = docs.withColumn("_text", F.coalesce("text", F.lit(""))).withColumn("_model", model.scalar())
    with_base = joined.withColumn("_base", base_spans(F.col("_text")))
    bounds = F.struct(F.transform("_base", lambda b: b["start"]).alias("starts"), running(F.transform("_base", lambda b: b["end"]), F.greatest).alias("ends"))

    def free(tokens: Column) -> Column:
        """Tokens that overlap no base span: the furthest end of those that begin before a token's end lies before it."""
        return F.when(F.size("_base") == 0, tokens).otherwise(let(bounds, lambda k: F.filter(tokens, lambda s: F.coalesce(F.get(k["ends"], below(k["starts"], s["end"]) - 1) <= s["start"], F.lit(True)))))

    llr, over = F.col("_model")["llr"], F.col("_model")["over"]
    judged = F.transform(free(spans(F.col("_text"), TOKEN, 3)), lambda s: F.struct(s["start"].alias("at"), F.length(s["value"]).alias("n"), stretch(s["value"], llr).alias("s")))
    enough = lambda t: (t["s"]["e"] - t["s"]["b"] + 1 >= LEAST) & (t["s"]["best"] > F.log(t["n"] / F.lit(FALSE_RATE)) + F.get(over, length_class(t["n"])) + margin)
    added = F.transform(F.filter(judged, enough), lambda t: F.struct((t["at"] + t["s"]["b"] - 1).alias("start"), F.lit(3).alias("kind"), (t["at"] + t["s"]["e"]).alias("end"), F.lit("").alias("value")))
    return with_base.withColumn("_spans", F.array_sort(F.concat("_base", added))).select(*docs.columns, "_spans")


def joined_spans(found: Column) -> Column:
    name = lambda s: F.get(F.array(*[F.lit(k) for k in KINDS]), s["kind"])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_secrets(docs: DataFrame, margin: float = 0.0, rows: int = 20_000, model: DataFrame | None = None) -> DataFrame:
    """Per row of docs: doc_id, n_assign, n_access, n_hex, n_markov, base_sha256, spans.

    Spans are kind:start:end in code points, end exclusive, by start, then kind. A null text counts as empty.
    Repeated rows are scanned each, extra columns are ignored, an empty table gives no rows. A margin, in nats, asks
    for more than the calibrated sums.
    """
    found = marked(docs.select("doc_id", "text"), train(docs, rows) if model is None else model, margin)
    base = F.filter("_spans", lambda s: s["kind"] < 3)
    count = lambda k: F.size(F.filter("_spans", lambda s: s["kind"] == k)).cast("bigint")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{KINDS[k]}") for k in range(4)], F.sha2(joined_spans(base), 256).alias("base_sha256"), joined_spans(F.col("_spans")).alias("spans")
    )


def redact(docs: DataFrame, margin: float = 0.0, rows: int = 20_000, mark: str = "[SECRET]", model: DataFrame | None = None) -> DataFrame:
    """The rows of docs with every secret span, overlapping ones together, replaced by mark; n_chars follows the text."""
    own = [c for c in DOCUMENT_COLUMNS if c in docs.columns]
    found = marked(docs.select(*own), train(docs, rows) if model is None else model, margin)
    reach = running(F.transform("_spans", lambda s: s["end"]), F.greatest)
    groups = let(reach, lambda ends: F.filter(
        F.transform("_spans", lambda s, i: F.struct(s["start"].alias("start"), F.coalesce(F.get(ends, i - 1), F.lit(0)).alias("before"))), lambda s: s["start"] >= s["before"]))

    def between(pieces: Column) -> Column:
        """What lies before each group of overlapping spans and after the last, cut from pieces of CHUNK code points."""
        every = F.concat(groups, F.array(F.struct(F.length("text").alias("start"), F.array_max(F.transform("_spans", lambda s: s["end"])).alias("before"))))

        def own(g: Column) -> Column:
            first = F.floor(g["before"] / CHUNK).cast("int")
            some = F.transform(F.sequence(first, F.floor((g["start"] - 1) / CHUNK).cast("int")), lambda i: F.get(pieces, i))
            return F.when(g["before"] >= g["start"], "").otherwise(F.substring(F.array_join(some, ""), g["before"] % CHUNK + 1, g["start"] - g["before"]))

        return F.transform(every, own)

    clean = F.array_join(let(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0)), between), mark)
    text = F.when(F.size("_spans") > 0, clean).otherwise(F.col("text"))
    out = found.withColumn("_clean", text)
    changed = {"text": F.col("_clean")} | ({"n_chars": F.when(F.size("_spans") > 0, F.length("_clean").cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("n_chars"))} if "n_chars" in own else {})
    return out.select(*[changed.get(c, F.col(c)).alias(c) for c in own])
