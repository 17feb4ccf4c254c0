"""Near duplicates by bottom-k sketches from one hash function.

A text's word shingles are hashed once; the k smallest hashes are its sketch. Texts with the same shingle set
are one class from the start. Two classes that are similar enough share so many sketch values that, with the
values of a sketch ordered from rare to frequent, they share one of the first few: only those values get an
inverted list. Short lists give pairs of classes. The bottom-k sketch of the union, which two sketches determine,
estimates a pair's similarity and drops pairs far below the threshold; the others are verified on full sets.

Long lists come from large groups of near copies. Each class of them is compared with a bounded number of others of its
longest list, twice, on full sets. That joins a group's classes to one component but for a few; these are then compared
with their whole lists, so that no two classes of a list in different components stay uncompared, while a group isn't
compared in all its pairs. Components of all verified links give the groups.

What can be lost: a pair at the threshold whose sketches share fewer values than all but a millionth of such pairs
do, or whose estimate falls as short (least_common); so at most 2 in 1,000,000 pairs at exactly the threshold, and the
share vanishes above it. Sets of at most SKETCH shingles are kept whole, and nothing of them is lost:
what such a set shares at least with its partner's sketch allows for the values that the sketch of a larger partner
leaves out. Shingles and sets are known by 64-bit hashes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteloom.llm.common import DOCUMENT_COLUMNS, ascii_lower, components, discard, let, materialize, small, words

SKETCH = 64
#: Share of pairs at exactly the threshold that a step on sketches may lose.
LOSS = 1e-6
SHORT_LIST = 32
BLOCK_CLASSES = 1024
BLOCK_VALUES = 4_000_000
#: In how many ways a long list is cut into blocks at first.
CUTS = 2


def shingle_set(text: Column, size: int) -> Column:
    """Sorted distinct 64-bit hashes of the runs of `size` words; a shorter text's whole sequence is one; none without words."""
    return let(
        words(ascii_lower(F.coalesce(text, F.lit("")))),
        lambda w: F.sort_array(
            F.array_distinct(
                F.when(F.size(w) == 0, F.array().cast("array<bigint>"))
                .when(F.size(w) < size, F.array(F.xxhash64(w)))
                .otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (size - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(w, i, size))))
            )
        ),
    )


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, row_hash, n, rid, sketch) per row: hash of id and text, set size, hash of the whole set (null for none), bottom-k values."""
    made = let(shingle_set(F.col("text"), size), lambda s: F.struct(
        F.size(s).cast("bigint").alias("n"), F.when(F.size(s) > 0, F.xxhash64(s)).alias("rid"), F.slice(s, 1, SKETCH).alias("sketch")))
    return docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row_hash"), made.alias("x")).select("doc_id", "row_hash", "x.*")


def least_common(k: int, percent: int) -> int:
    """The most values of k that all but LOSS of pairs at the threshold have in common.

    Each value of the union's sketch is common with a probability of the similarity; those are in both sketches, too.
    """
    share, total = percent / 100, 0.0
    for common in range(k + 1):
        total += math.comb(k, common) * share**common * (1 - share) ** (k - common)
        if total > LOSS:
            return common
    return k


def least_shared(n: int, percent: int) -> int:
    """How many values a whole set of n <= SKETCH shares at least with the sketch of any similar set.

    A partner of m > SKETCH has all but SKETCH of its values cut off, which may all be common ones.
    """
    cut = (-(-percent * (n + m) // (100 + percent)) - (m - SKETCH) for m in range(SKETCH + 1, 100 * n // percent + 1))
    return max(1, min([-(-percent * n // 100), *cut]))


def prefix_length(n: Column, percent: int) -> Column:
    """How many values of a sketch, rare ones first, must meet those of any similar set."""
    kept = F.least(n, F.lit(SKETCH))
    whole = F.lit([least_shared(k, percent) for k in range(1, SKETCH + 1)])
    shared = F.when(n <= SKETCH, F.get(whole, (n - 1).cast("int"))).otherwise(F.lit(least_common(SKETCH, percent)))
    return (kept - shared + 1).cast("int")


def inverted_lists(classes: DataFrame, percent: int) -> DataFrame:
    """(value, rid, n, listed): the values by which a class looks for partners, with the length of their lists."""
    each = classes.where("n > 0").select("rid", "n", F.explode("sketch").alias("value"))
    shared = each.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    own = each.join(shared, "value").groupBy("rid", "n").agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("v"))  # SKETCH values at most
    alone = F.least(F.col("n"), F.lit(SKETCH)) - F.size("v")  # values that no other class has are the rarest
    room = F.greatest(prefix_length(F.col("n"), percent) - alone, F.lit(0)).cast("int")
    entries = materialize(own.select("rid", "n", F.explode(F.slice("v", F.lit(1), room)).alias("v")).select("rid", "n", "v.value"), "lists")
    lengths = entries.groupBy("value").agg(F.count("*").alias("listed"), F.sum("n").alias("weight")).where("listed > 1")
    return materialize(entries.join(lengths, "value"), "lists")


def close_in_size(a: str, b: str, percent: int) -> Column:
    return (100 * F.col(a) >= percent * F.col(b)) & (100 * F.col(b) >= percent * F.col(a))


def listed_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """(a, b) with a < b: classes of fitting sizes that share a short list."""
    short = lists.where(F.col("listed") <= SHORT_LIST)
    left = short.select("value", F.col("rid").alias("a"), F.col("n").alias("n_a"))
    right = short.select("value", F.col("rid").alias("b"), F.col("n").alias("n_b"))
    return left.join(right, "value").where((F.col("a") < F.col("b")) & close_in_size("n_a", "n_b", percent)).select("a", "b").distinct()


def likely(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose union sketch doesn't rule them out."""
    of = lambda side: classes.select(F.col("rid").alias(side), F.col("sketch").alias(f"s_{side}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b")
    union = F.slice(F.sort_array(F.array_union("s_a", "s_b")), 1, SKETCH)
    common = F.array_intersect(F.array_intersect("s_a", "s_b"), union)
    least = F.lit([0, *(least_common(k, percent) for k in range(1, SKETCH + 1))])
    return both.where(F.size(common) >= F.get(least, F.size(union))).select("a", "b")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    of = lambda side: sets.select(F.col("rid").alias(side), F.col("shingles").alias(f"x_{side}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b")
    common = F.size(F.array_intersect("x_a", "x_b"))
    return both.where(100 * common >= percent * (F.size("x_a") + F.size("x_b") - common)).select("a", "b")


def block_links(rid: np.ndarray, sets: list[np.ndarray], left: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among the classes of a block; between its two sides only if it has two."""
    sizes = np.array([len(s) for s in sets], np.int64)
    rows = np.repeat(np.arange(len(sets)), sizes)
    values, codes, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = counts[codes] > 1
    rows, codes = rows[keep], codes[keep]
    order = np.argsort(codes, kind="stable")
    rows, codes = rows[order], codes[order]
    common = np.zeros((len(sets), len(sets)), np.float32)
    for start in range(0, len(values), 2048):
        i, j = np.searchsorted(codes, (start, start + 2048))
        if i < j:
            part = np.zeros((len(sets), 2048), np.float32)
            part[rows[i:j], codes[i:j] - start] = 1
            common += part @ part.T
    linked = 100 * common >= percent * (sizes[:, None] + sizes[None, :] - common)
    if left.any() and not left.all():
        linked &= left[:, None] != left[None, :]
    np.fill_diagonal(linked, True)
    label = np.arange(len(sets))
    while True:
        new = np.where(linked, label[None, :], len(sets)).min(axis=1)
        new = np.minimum(new, new[new])
        if (new == label).all():
            break
        label = new
    return [(int(rid[k]), int(rid[i])) for i, k in enumerate(label) if rid[i] != rid[k]]


def compared(blocks: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): links inside each (value, block) of blocks(value, block, side, rid); between its two sides only if it has two."""

    def run(table: pa.Table) -> pa.Table:
        rid, side, shingles = table.column("rid").to_numpy(), table.column("side").to_numpy(), table.column("shingles").combine_chunks()
        flat, ends = shingles.values.to_numpy(zero_copy_only=False), shingles.offsets.to_numpy()
        links = block_links(rid, [flat[i:j] for i, j in zip(ends, ends[1:])], side == 0, percent)
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([x for _, x in links], pa.int64())})

    return blocks.join(sets, "rid").select("value", "block", "side", "rid", "shingles").groupBy("value", "block").applyInArrow(run, "a bigint, b bigint")


def parts_of(rows: str, weight: str) -> Column:
    """In how many blocks of bounded size so many classes and values fit."""
    return F.greatest(F.lit(1), F.ceil(F.col(rows) / BLOCK_CLASSES), F.ceil(F.col(weight) / BLOCK_VALUES)).cast("int")


def first_links(long: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links inside blocks of bounded size; each class takes part with its longest list, which is cut in CUTS ways."""
    own = long.groupBy("rid", "n").agg(F.max_by("value", F.struct("listed", "value")).alias("value"))
    parts = own.groupBy("value").agg(F.count("*").alias("rows"), F.sum("n").alias("weight")).select("value", parts_of("rows", "weight").alias("parts"))
    cuts = own.join(parts, "value").withColumn("cut", F.explode(F.sequence(F.lit(0), F.when(F.col("parts") > 1, CUTS - 1).otherwise(0))))
    block = F.struct("cut", F.pmod(F.xxhash64("rid", "cut"), F.col("parts")).cast("int").alias("part"))
    return compared(cuts.select("value", block.alias("block"), F.lit(0).alias("side"), "rid"), sets, percent)


def other_links(long: DataFrame, found: DataFrame, sets: DataFrame, percent: int) -> DataFrame | None:
    """Links between the classes of a list that lie outside its largest component and all its classes; None if all are in one.

    found: (node, root) of the links so far. Blocks are pairs of parts of bounded size.
    """
    placed = long.join(found.withColumnRenamed("node", "rid"), "rid", "left").select("value", "rid", "n", F.coalesce("root", "rid").alias("root"))
    each = placed.groupBy("value", "root").agg(F.count("*").alias("rows"), F.sum("n").alias("weight"))
    lists = each.groupBy("value").agg(F.max_by("root", F.struct("rows", "root")).alias("largest"), F.count("*").alias("roots"), F.sum("rows").alias("rows"), F.sum("weight").alias("weight")).where("roots > 1")
    rest = each.join(lists.select("value", "largest"), "value").where("root <> largest").groupBy("value").agg(F.sum("rows").alias("rest_rows"), F.sum("weight").alias("rest_weight"))
    plan = lists.join(rest, "value").select("value", "largest", parts_of("rows", "weight").alias("parts"), parts_of("rest_rows", "rest_weight").alias("rest_parts"))
    plan = materialize(plan, "lists")
    if plan.isEmpty():
        return None
    rows = placed.join(plan, "value").withColumn("h", F.xxhash64("rid"))
    part = lambda n: F.pmod("h", F.col(n)).cast("int")
    left = rows.where("root <> largest").select("value", "rid", part("rest_parts").alias("i"), F.explode(F.expr("sequence(0, parts - 1)")).alias("j"), F.lit(0).alias("side"))
    right = rows.select("value", "rid", F.explode(F.expr("sequence(0, rest_parts - 1)")).alias("i"), part("parts").alias("j"), F.lit(1).alias("side"))
    both = left.unionByName(right).select("value", F.struct("i", "j").alias("block"), "side", "rid")
    return compared(both, sets, percent)


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id, kept.

    size: words in a shingle; percent: least Jaccard similarity of a link. component_id is the smallest doc_id
    that links reach, kept is whether it is the row's own. A null, empty or blank text has no shingle and no link.
    A row with a null doc_id gets no component and is kept; rows that share a doc_id count as one document, with the links
    of all its texts, and repeated rows are returned each. Extra columns are ignored; an empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("bigint"), "text")
    base = materialize(sketches(docs, size), "sketches")
    named = base.where("doc_id is not null")
    whole = named.where("rid is not null").groupBy("rid").agg(F.min(F.struct("doc_id", "row_hash")).alias("first"), F.min("n").alias("n"), F.min("sketch").alias("sketch"))
    classes = materialize(whole, "classes")
    lists = inverted_lists(classes, percent)
    pairs = materialize(likely(listed_pairs(lists, percent), classes, percent), "pairs")
    long = lists.where(F.col("listed") > SHORT_LIST)
    wanted = pairs.select(F.col("a").alias("rid")).union(pairs.select("b")).union(long.select("rid")).distinct()
    wanted = materialize(classes.join(wanted, "rid", "left_semi").select("rid", F.col("first.row_hash").alias("row_hash")), "wanted")
    # Broadcast up to a bound, so that only the texts that are compared move; beyond it all texts move once.
    texts = docs.withColumn("row_hash", F.xxhash64("doc_id", "text")).join(small(wanted, 2_000_000), "row_hash")
    sets = materialize(texts.select("rid", shingle_set(F.col("text"), size).alias("shingles")).dropDuplicates(["rid"]), "sets")
    # The texts of a document that has several are linked by it.
    several = materialize(named.groupBy("doc_id").agg(F.min("rid").alias("b"), F.max("rid").alias("m"), F.count("*").alias("all"), F.count("rid").alias("some")).where("b <> m or some < all").select("doc_id", "b"), "several")
    own = named.where("rid is not null").join(several.where("b is not null"), "doc_id").select(F.col("rid").alias("a"), "b").where("a <> b")
    links = materialize(verified(pairs, sets, percent).union(own).union(first_links(long, sets, percent)), "links")
    found = materialize(components(links), "components")
    if (more := other_links(long, found, sets, percent)) is not None:
        found = materialize(components(links.union(materialize(more, "links"))), "components")
    of_class = classes.select("rid", F.col("first.doc_id").alias("d")).join(found.withColumnRenamed("node", "rid"), "rid", "left").withColumn("root", F.coalesce("root", "rid"))
    lowest = of_class.groupBy("root").agg(F.min("d").alias("found"))
    of_class = materialize(of_class.join(lowest, "root").select("rid", "found"), "of-class")
    of_several = named.join(several.select("doc_id"), "doc_id", "left_semi").join(of_class, "rid").groupBy("doc_id").agg(F.min("found").alias("by_other"))
    of_several = materialize(of_several, "of-several")
    discard(lists, pairs, wanted, sets, links, classes)
    out = base.join(of_class, "rid", "left").join(of_several, "doc_id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.least("doc_id", "found", "by_other"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One row of docs for each group, with the columns of documents. Rows with a null doc_id all stay."""
    own = [c for c in DOCUMENT_COLUMNS if c in docs.columns]
    kept = materialize(near_duplicates(docs, size, percent).where("kept and doc_id is not null").select("doc_id").distinct(), "kept")
    rows = docs.select(*own).where("doc_id is not null").join(kept, "doc_id", "left_semi")
    one = rows.groupBy("doc_id").agg(F.min(F.struct(*own)).alias("r")).select("r.*")
    return one.unionByName(docs.select(*own).where("doc_id is null"))
