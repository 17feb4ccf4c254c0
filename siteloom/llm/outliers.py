"""Quality rules: minimum-covariance-determinant outliers per language and source, with DataFrame functions only.

Each text gives a vector of four transformed statistics: word length, share of symbols, of repeated lines and of
words in repeated windows. Per language and source the `support` share of the texts whose covariance has the smallest
determinant is looked for: concentration steps begin at five starts (medians with fixed and with fitted scales, both
quartiles, all texts), two steps later the start with the lowest determinant stays, and steps go on until no group's
determinant falls. Texts beyond a Mahalanobis cutoff are rejected. FLOORS is added to the spread of each statistic, so
that a group of like texts doesn't reject what hardly differs.
Vectors are kept as integers of 1/1024, so that sums are exact and a recomputed task changes nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteloom.llm.common import DOCUMENT_COLUMNS, SPACES, discard, let, materialize, small, words

SYMBOLS = "#*$%&|<>"
SCALE = 1024
DIMENSIONS = ("z_length", "z_symbols", "z_lines", "z_repeats")
#: Added to each variance: the spread below which a statistic doesn't tell texts apart (regularised MCD).
FLOORS = (0.05, 0.5, 0.12, 0.08)
#: Distances are ranked in bins of this many to an e-fold.
DISTANCE_BINS = 256


def repeated_window_words(tokens: Column, window: int) -> Column:
    """How many words lie in windows of so many words that occur twice or more in the text.

    Windows are compared by a 64-bit hash. Only a text with an equal pair sorts its windows; the words are then
    the union of the windows' spans.
    """
    hashes = F.when(F.size(tokens) < window, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(F.size(tokens) - (window - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(tokens, i, window)))
    )

    def covered(found: Column) -> Column:
        def spans(ordered: Column) -> Column:
            at = lambda j: F.get(ordered, j)["h"]
            twice = F.filter(F.sequence(F.lit(0), F.size(ordered) - 1), lambda j: (at(j) == at(j - 1)) | (at(j) == at(j + 1)))
            places = F.sort_array(F.transform(twice, lambda j: F.get(ordered, j)["i"]))
            return let(
                places,
                lambda p: F.aggregate(
                    F.transform(p, lambda x, j: F.least(F.lit(window), F.coalesce(F.get(p, j + 1) - x, F.lit(window)))), F.lit(0), lambda a, x: a + x
                ),
            )

        pairs = F.sort_array(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(found)) < F.size(found), let(pairs, spans)).otherwise(F.lit(0))

    return let(hashes, covered)


def with_statistics(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and n_lines in a struct `_q`."""
    text = F.coalesce(F.col("text"), F.lit(""))
    bare = lambda t: F.translate(t, SPACES, "")
    tokens = let(
        words(F.col("text")),
        lambda w: F.struct(F.size(w).cast("bigint").alias("n_words"), repeated_window_words(w, 8).cast("bigint").alias("n_repeat_words")),
    )
    lines = let(
        F.filter(F.split(text, "\n"), lambda x: F.trim(x, F.lit(SPACES)) != ""),
        lambda x: F.struct(F.size(x).cast("bigint").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines")),
    )
    counts = docs.select(
        "*",
        F.struct(
            tokens.alias("w"), lines.alias("l"), F.length(bare(text)).cast("bigint").alias("word_chars"),
            (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        ).alias("_s"),
    )
    s = F.col("_s")
    return counts.select(
        *docs.columns,
        F.struct(
            s["w"]["n_words"].alias("n_words"), s["word_chars"].alias("word_chars"), s["n_symbols"].alias("n_symbols"),
            s["l"]["n_dup_lines"].alias("n_dup_lines"), s["w"]["n_repeat_words"].alias("n_repeat_words"), s["l"]["n_lines"].alias("n_lines"),
            ((s["w"]["n_words"] < 20) | (100 * s["w"]["n_repeat_words"] > 30 * s["w"]["n_words"])).alias("base_failed"),
        ).alias("_q"),
    )


def vector(q: Column) -> list[Column]:
    """The four transformed statistics as integers of 1/SCALE. Small counts are drawn to a fixed prior, so short texts don't scatter."""
    n = q["n_words"]
    return [
        F.round(F.least(F.lit(8.0), x) * SCALE).cast("bigint").alias(name)
        for name, x in zip(
            DIMENSIONS,
            (
                F.log((q["word_chars"] + 1000) / (n + 200)),
                F.log1p(100.0 * q["n_symbols"] / (q["word_chars"] + 40)),
                q["n_dup_lines"] / (q["n_lines"] + 4),
                q["n_repeat_words"] / (n + 40),
            ),
        )
    ]


def chi_square(x: float, dof: int) -> float:
    """Distribution function for an even number of degrees of freedom."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(dof // 2))


def chi_square_quantile(p: float, dof: int) -> float:
    low, high = 0.0, 1e3
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid, dof) < p else (low, mid)
    return high


def rank_cuts(binned: DataFrame, keys: list[str], bins: str, shares: tuple[float, ...]) -> DataFrame:
    """keys and cuts: per group and share the lowest bin by which so large a share of its rows is reached. Bins are few, rows are only counted."""
    counts = binned.groupBy(*keys, bins).agg(F.count("*").alias("n"))
    over = Window.partitionBy(*keys)
    ranked = counts.select(*keys, bins, F.sum("n").over(over.orderBy(bins)).alias("so_far"), F.sum("n").over(over).alias("total"))
    return ranked.groupBy(*keys).agg(F.array(*[F.min(F.when(F.col("so_far") >= F.ceil(F.lit(p) * F.col("total")), F.col(bins))) for p in shares]).alias("cuts"))


def distance(params: Column) -> Column:
    """Squared Mahalanobis distance of the row's vector: forward substitution with the Cholesky factor of params."""
    done: list[Column] = []
    for i, name in enumerate(DIMENSIONS):
        x = F.col(name) / SCALE - params[f"m{i}"]
        for j in range(i):
            x = x - params[f"l{i}{j}"] * done[j]
        done.append(x / params[f"l{i}{i}"])
    return sum((d * d for d in done[1:]), done[0] * done[0])


def estimate(chosen: DataFrame, spread: float) -> DataFrame:
    """(grp, start, params, det): mean and Cholesky factor of spread * covariance + FLOORS² over the chosen rows of each group and start."""
    p = len(DIMENSIONS)
    pairs = [(i, j) for i in range(p) for j in range(i + 1)]
    sums = chosen.groupBy("grp", "start").agg(
        F.count("*").alias("n"), *[F.sum(d).alias(f"s{i}") for i, d in enumerate(DIMENSIONS)],
        *[F.sum(F.col(DIMENSIONS[i]) * F.col(DIMENSIONS[j])).alias(f"p{i}{j}") for i, j in pairs],
    )
    means = [(F.col(f"s{i}") / F.col("n") / SCALE).alias(f"m{i}") for i in range(p)]
    out = sums.select("grp", "start", *means, *[(F.col(f"p{i}{j}") / F.col("n") / SCALE**2).alias(f"q{i}{j}") for i, j in pairs])
    for i, j in pairs:
        cov = spread * (F.col(f"q{i}{j}") - F.col(f"m{i}") * F.col(f"m{j}")) + (FLOORS[i] ** 2 if i == j else 0.0)
        for k in range(j):
            cov = cov - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
        out = out.withColumn(f"l{i}{j}", F.sqrt(F.greatest(cov, F.lit(FLOORS[i] ** 2))) if i == j else cov / F.col(f"l{j}{j}"))
    det = math.prod((F.col(f"l{i}{i}") for i in range(1, p)), start=F.col("l00"))
    return out.select("grp", "start", F.struct(*[f"m{i}" for i in range(p)], *[f"l{i}{j}" for i, j in pairs]).alias("params"), (det * det).alias("det"))


def group_names(stats: DataFrame, least_rows: int) -> DataFrame:
    """(lang, source, grp): each language and source, or the language's small sources together; null where even those are too few."""
    counts = stats.where("not base_failed").groupBy("lang", "source").agg(F.count("*").alias("n"))
    small = F.col("n") < least_rows
    pooled = F.sum(F.when(small, F.col("n"))).over(Window.partitionBy("lang"))
    name = F.when(~small, F.to_json(F.struct("lang", "source"))).when(pooled >= least_rows, F.to_json(F.struct("lang")))
    return counts.select("lang", "source", name.alias("grp"))


def starts(rows: DataFrame) -> DataFrame:
    """(grp, start, params): where concentration begins."""
    p = len(DIMENSIONS)
    each = rows.select("grp", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(d).alias("z")) for i, d in enumerate(DIMENSIONS)])).alias("x")).select("grp", "x.i", "x.z")
    cuts = rank_cuts(each, ["grp", "i"], "z", (0.25, 0.5, 0.75)).select("grp", "i", F.transform("cuts", lambda c: c / SCALE).alias("q"))
    wide = cuts.groupBy("grp").agg(*[F.max(F.when(F.col("i") == i, F.col("q"))).alias(f"q{i}") for i in range(p)])

    def at(quartile: int, fitted: bool) -> Column:
        means = [F.get(f"q{i}", F.lit(quartile)).alias(f"m{i}") for i in range(p)]
        spread = lambda i: (F.get(f"q{i}", F.lit(2)) - F.get(f"q{i}", F.lit(0))) / 1.349 if fitted else F.lit(0.0)
        factor = [(F.sqrt(spread(i) * spread(i) + FLOORS[i] ** 2) if i == j else F.lit(0.0)).alias(f"l{i}{j}") for i in range(p) for j in range(i + 1)]
        return F.struct(*means, *factor)

    made = wide.select("grp", F.posexplode(F.array(at(1, False), at(1, True), at(0, True), at(2, True))).alias("start", "params"))
    return made.unionByName(estimate(rows.withColumn("start", F.lit(4)), 1.0).select("grp", "start", "params"))


def concentrated(rows: DataFrame, params: DataFrame, support: float) -> DataFrame:
    """One concentration step of (grp, start, params) with det: the estimate of the rows that are nearest by the one before."""
    inside = chi_square_quantile(support, len(DIMENSIONS))
    spread = support / chi_square(inside, len(DIMENSIONS) + 2)
    near = rows.join(small(params.select("grp", "start", "params")), "grp").withColumn("bin", F.floor(F.log1p(distance(F.col("params"))) * DISTANCE_BINS).cast("int")).drop("params")
    cut = materialize(rank_cuts(near, ["grp", "start"], "bin", (support,)).select("grp", "start", F.col("cuts")[0].alias("cut")), "cuts")
    out = materialize(estimate(near.join(small(cut), ["grp", "start"]).where("bin <= cut"), spread), "mcd")
    discard(cut)
    return out


def fit(stats: DataFrame, support: float = 0.75, least_rows: int = 40, early: int = 2) -> DataFrame:
    """(lang, source, params) from rows with lang, source, base_failed and the vector; only rows that pass the base rules count."""
    names = materialize(group_names(stats, least_rows), "groups")
    same = [F.col("s.lang").eqNullSafe(F.col("g.lang")), F.col("s.source").eqNullSafe(F.col("g.source"))]
    rows = stats.where("not base_failed").alias("s").join(small(names.where("grp is not null")).alias("g"), same).select("grp", *DIMENSIONS)
    rows = materialize(rows, "vectors")
    params = materialize(starts(rows), "mcd")
    for _ in range(early):
        params = concentrated(rows, params, support)
    best = materialize(params.groupBy("grp").agg(F.min_by(F.struct("start", "params", "det"), F.struct("det", "start")).alias("b")).select("grp", "b.*"), "mcd")
    falling = best
    while True:
        new = concentrated(rows, falling, support).select("grp", F.col("start").alias("_start"), F.col("params").alias("_params"), F.col("det").alias("_det"))
        joined = materialize(best.join(new, "grp", "left").withColumn("fell", F.coalesce(F.col("_det") < F.col("det") * (1 - 1e-9), F.lit(False))), "mcd")
        better = joined.select("grp", "fell", *[F.when(F.col("fell"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in ("start", "params", "det")])
        best = materialize(better.drop("fell"), "mcd")
        falling = better.where("fell").drop("fell")
        if falling.isEmpty():
            break
    out = materialize(names.join(best, "grp").select("lang", "source", "params"), "mcd")
    discard(rows, names)
    return out


def judged(rows: DataFrame, model: DataFrame, cutoff: float) -> DataFrame:
    """rows with distance2 and kept. A group without an estimate keeps what passes the base rules."""
    r, m = rows.alias("r"), model.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), "params")
    joined = r.join(small(m), F.col("r.lang").eqNullSafe(F.col("_lang")) & F.col("r.source").eqNullSafe(F.col("_source")), "left")
    out = joined.withColumn("distance2", distance(F.col("params")))
    return out.withColumn("kept", ~F.col("base_failed") & (F.coalesce(F.col("distance2"), F.lit(0.0)) <= cutoff)).drop("params", "_lang", "_source")


#: Quantile of the chi-square distribution beyond which a text is rejected.
TAIL = 0.995


def quality_statistics(docs: DataFrame, *beside: str) -> DataFrame:
    """Per row: doc_id, lang, source, the base statistics, base_failed and the vector, written once; beside: columns of docs kept as a struct _row."""
    q = F.col("_q")
    own = [F.struct(*beside).alias("_row")] if beside else []
    stats = with_statistics(docs.select("doc_id", "lang", "source", "text", *own)).select("doc_id", "lang", "source", "_q", *(["_row"] if beside else []))
    return materialize(
        stats.select("doc_id", "lang", "source", *[q[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")], *vector(q), *(["_row"] if beside else [])), "stats"
    )


def quality_verdicts(docs: DataFrame, tail: float = TAIL) -> DataFrame:
    """Per row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance2.

    docs needs doc_id, text, lang and source; other columns are ignored. A null text counts as empty and fails the
    base rules. Null languages and sources are values of their own. Repeated rows are judged each; an empty table
    gives no rows. Languages and sources with fewer than 40 texts share an estimate per language.
    """
    stats = quality_statistics(docs)
    out = judged(stats, fit(stats), chi_square_quantile(tail, len(DIMENSIONS)))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance2")


def keep_good(docs: DataFrame, tail: float = TAIL) -> DataFrame:
    """The rows of docs that pass, with the columns of documents.

    Rows are written with their statistics once; what is judged is read from there. Nulls, small groups, repeated rows
    and empty tables as in quality_verdicts(); a null or empty text goes.
    """
    own = [c for c in DOCUMENT_COLUMNS if c in docs.columns]
    stats = quality_statistics(docs.select(*own), *own)
    return judged(stats, fit(stats), chi_square_quantile(tail, len(DIMENSIONS))).where("kept").select("_row.*")
