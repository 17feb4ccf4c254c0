"""Mixing sources to target weights by Pfair scheduling, with DataFrame functions only.

A source's documents, in hash order, form blocks of `block_docs`; each block gets one slot of the mix. Ideally sources
advance together, each by its weight, and one that runs out leaves its share to the others: after `v` units of virtual
time source i has had min(blocks_i, v * weight_i) blocks, and all of them T(v) slots, a function that is linear between the
points where a source runs out. So block j of source i is released at slot floor(T(j / w)) and due before ceil(T((j + 1) / w)),
and in each slot the released block with the earliest deadline goes. Then after any slot each source is less than one
block away from its ideal share, over the whole run. Weights are whole multiples of 1e-15 of their sum, and windows are
computed in whole numbers.

The schedule is that of one pass over all slots, but made in parallel: slots are cut into chunks, a chunk is scheduled
from the blocks that are released in it and those that wait at its start, and chunks whose guess of the waiting blocks
isn't what the chunk before leaves are scheduled again, until all agree. Where the first chunk starts is known, so this
ends, and with the same schedule.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteloom.llm.common import DOCUMENT_COLUMNS, let, materialize
from siteloom.llm.slots import COPY_RUN

KEY = ("source", "doc_id", "text_hash")
CELLS = 4096
#: Weights are whole numbers that sum to about this.
UNITS = 10**15
#: A source that the weights don't name weighs this share of the sum.
UNNAMED = 1e-6
LEAST_CHUNK = 256
#: A chunk has at least one slot for so many sources, so that waiting blocks are at most so many times the blocks.
SOURCES_PER_SLOT = 16
JOB = "struct<deadline:bigint,i:int,block:bigint,release:bigint>"


def numbered(docs: DataFrame) -> DataFrame:
    """(source, doc_id, text_hash, copy, number): number counts a source's rows from 0 in the order of a hash.

    Equal rows are counted before the shuffle and told apart by copy. Numbers come from the counts of hash cells
    and a count inside each cell, so no task sees a whole source.
    """
    each = docs.select("source", F.col("doc_id").cast("bigint"), F.xxhash64("text").alias("text_hash"))
    counted = each.groupBy(*KEY).agg(F.count("*").alias("copies"))
    runs = counted.withColumn("from_copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1, F.lit(COPY_RUN).cast("bigint"))))
    rows = runs.withColumn("copy", F.explode(F.sequence("from_copy", F.least(F.col("copies") - 1, F.col("from_copy") + COPY_RUN - 1))))
    rows = rows.select(*KEY, "copy", F.xxhash64("doc_id", "text_hash", "copy").alias("h")).withColumn("cell", F.pmod("h", F.lit(CELLS)))
    sizes = rows.groupBy("source", "cell").agg(F.count("*").alias("n"))
    before = sizes.select(
        F.col("source").alias("_source"), F.col("cell").alias("_cell"),
        F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
    )
    within = F.row_number().over(Window.partitionBy("source", "cell").orderBy("h", "doc_id", "text_hash", "copy")) - 1
    placed = rows.withColumn("at", within).join(before, F.col("source").eqNullSafe(F.col("_source")) & (F.col("cell") == F.col("_cell")))
    return placed.select(*KEY, "copy", (F.col("before") + F.col("at")).alias("number"))


def weighed_sources(docs: DataFrame, weights: Mapping[str | None, float] | None, power: float, block_docs: int) -> DataFrame:
    """One row with `s`: (v, source, blocks, q, before, rest) per source, by the virtual time v at which it runs out.

    q is its weight in whole UNITS, before the blocks of the sources that run out earlier, rest the weight of it and
    all later ones. Without weights a source weighs its row count to the given power.
    """
    counts = docs.groupBy("source").agg(F.count("*").alias("n"))
    if weights is None:
        weighed = counts.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(power)))
    else:
        named = [F.when(F.col("source").eqNullSafe(F.lit(s)), F.lit(float(w))) for s, w in weights.items()]
        least = UNNAMED * max(sum(weights.values()), 1e-300)
        weighed = counts.withColumn("w", F.greatest(F.coalesce(*named, F.lit(0.0)), F.lit(least)))
    total = F.sum("w").over(Window.partitionBy())  # one row per source
    q = F.greatest(F.lit(1), F.round(F.col("w") / total * UNITS)).cast("bigint")
    rows = weighed.select("source", F.ceil(F.col("n") / block_docs).cast("bigint").alias("blocks"), q.alias("q")).withColumn("v", F.col("blocks") / F.col("q"))
    order = Window.orderBy("v", F.col("source").asc_nulls_first())
    sums = rows.select(
        "v", "source", "blocks", "q", F.row_number().over(order).alias("nth"),
        F.coalesce(F.sum("blocks").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.sum("q").over(order.rowsBetween(0, Window.unboundedFollowing)).alias("rest"),
    )
    return sums.agg(F.sort_array(F.collect_list(F.struct("nth", "v", "source", "blocks", "q", "before", "rest"))).alias("s"))


def block_windows(sources: DataFrame) -> DataFrame:
    """(i, source, block, release, deadline) of every block of weighed_sources()."""
    table = F.col("table")
    each = sources.select(F.posexplode("s").alias("i", "x")).select("i", "x.source", "x.q", "x.blocks")
    runs = each.withColumn("from", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1, F.lit(COPY_RUN).cast("bigint"))))
    runs = runs.repartition("i", "from")
    rows = runs.select("i", "source", "q", F.explode(F.sequence("from", F.least(F.col("blocks") - 1, F.col("from") + COPY_RUN - 1))).alias("block")).withColumn("table", sources.scalar())

    def segment(v: Column) -> Column:
        """(before, rest) where virtual time v lies: after the sources that have run out by then."""

        def halve(at: Column, _: Column) -> Column:
            mid = F.floor((at["lo"] + at["hi"]) / 2).cast("int")
            up = F.get(table, mid)["v"] <= v
            return F.when(at["lo"] >= at["hi"], at).otherwise(
                F.struct(F.when(up, mid + 1).otherwise(at["lo"]).alias("lo"), F.when(up, at["hi"]).otherwise(mid).alias("hi"))
            )

        start = F.struct(F.lit(0).alias("lo"), F.size(table).alias("hi"))
        last = F.element_at(table, -1)
        place = F.aggregate(F.sequence(F.lit(0), F.ceil(F.log2(F.size(table) + 1)).cast("int")), start, halve)["lo"]
        return F.struct(
            F.when(place < F.size(table), F.get(table, place)["before"]).otherwise(last["before"] + last["blocks"]).alias("before"),
            F.coalesce(F.get(table, place)["rest"], F.lit(0)).alias("rest"),
        )

    rows = rows.withColumn("a", segment(F.col("block") / F.col("q"))).withColumn("b", segment((F.col("block") + 1) / F.col("q")))
    wide = "cast({} as decimal(19,0)) * cast({} as decimal(19,0))"
    release = F.expr(f"a.before + ({wide.format('block', 'a.rest')}) div q")
    deadline = F.expr(f"b.before + ({wide.format('block + 1', 'b.rest')} + q - 1) div q")
    return rows.select("i", "source", "block", release.cast("bigint").alias("release"), deadline.cast("bigint").alias("deadline"))


def in_chunk(new: Column, waiting: Column, first: Column, slots: Column) -> Column:
    """(placed, left): earliest-deadline-first over so many slots from the first; both inputs are arrays of JOB in order."""
    near = F.array_sort(F.concat(F.slice(waiting, F.lit(1), slots), new))  # others can't come in these slots

    def serve(state: Column, slot: Column) -> Column:
        return let(
            F.get(F.filter(state["left"], lambda x: x["release"] <= slot), F.lit(0)),
            lambda job: F.when(job.isNull(), state).otherwise(
                F.struct(F.array_remove(state["left"], job).alias("left"), F.concat(state["placed"], F.array(F.struct(slot.alias("slot"), job["i"].alias("i"), job["block"].alias("block")))).alias("placed"))
            ),
        )

    start = F.struct(near.alias("left"), F.array().cast("array<struct<slot:bigint,i:int,block:bigint>>").alias("placed"))
    over = F.slice(waiting, slots + 1, F.greatest(F.size(waiting) - slots, F.lit(0)))
    return let(
        F.aggregate(F.sequence(first, first + slots - 1), start, serve),
        lambda end: F.struct(end["placed"].alias("placed"), F.array_sort(F.concat(end["left"], over)).alias("left")),
    )


def block_slots(windows: DataFrame, chunk: int) -> DataFrame:
    """(i, block, slot) of every block, by earliest deadline first; chunk: slots that are scheduled in one go."""
    job = F.struct("deadline", "i", "block", "release").cast(JOB)
    new = windows.groupBy(F.floor(F.col("release") / chunk).alias("k")).agg(F.array_sort(F.collect_list(job)).alias("new"))  # a chunk's slots and sources at most
    slots = windows.groupBy(F.floor(F.col("release") / chunk).alias("k")).agg(F.count("*").alias("n"))
    # One row per chunk.
    so_far = Window.orderBy("k")
    chunks = windows.agg(F.count("*").alias("total")).where("total > 0").select("total", F.explode(F.expr(f"sequence(0L, (total - 1) div {chunk})")).alias("k"))
    size = chunks.join(slots, "k", "left").select("k", F.least(F.lit(chunk), F.col("total") - F.col("k") * chunk).cast("int").alias("slots"),
                                                  (F.coalesce(F.sum("n").over(so_far.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.col("k") * chunk).alias("wait"))
    # The guess: of the blocks whose windows cross the start of a chunk those with the latest deadlines wait.
    crossing = windows.select(job.alias("job"), F.expr(f"explode(sequence(release div {chunk} + 1, (deadline - 1) div {chunk}))").alias("k")).where(
        (F.col("k") * chunk > F.col("job.release")) & (F.col("k") * chunk < F.col("job.deadline")))
    late = crossing.withColumn("nth", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("job")))).join(size.select("k", "wait"), "k").where("nth <= wait")
    guess = late.groupBy("k").agg(F.array_sort(F.collect_list("job")).alias("waiting"))
    none = F.array().cast(f"array<{JOB}>")
    state = size.join(new, "k", "left").join(guess, "k", "left").select("k", "slots", F.coalesce("new", none).alias("new"), F.coalesce("waiting", none).alias("waiting"))

    def scheduled(rows: DataFrame) -> DataFrame:
        return rows.select("k", "slots", "new", "waiting", in_chunk(F.col("new"), F.col("waiting"), F.col("k") * chunk, F.col("slots")).alias("r")).select("k", "slots", "new", "waiting", "r.placed", "r.left")

    done = materialize(scheduled(materialize(state, "chunks").repartition("k")), "schedule")
    while True:
        given = done.select((F.col("k") + 1).alias("k"), F.col("left").alias("given"))
        wrong = materialize(done.join(given, "k").where("waiting <> given").select("k", "slots", "new", F.col("given").alias("waiting")), "wrong")
        if wrong.isEmpty():
            break
        done = materialize(done.join(wrong.select("k"), "k", "left_anti").unionByName(scheduled(wrong.repartition("k"))), "schedule")
    return done.select(F.explode("placed").alias("p")).select("p.i", "p.block", "p.slot")


def mix_schedule(
    docs: DataFrame, weights: Mapping[str | None, float] | None = None, power: float = 0.5, block_docs: int = 16, chunk: int | None = None
) -> DataFrame:
    """Per row of docs: source, doc_id, text_hash, copy, block, release, deadline, slot, place.

    slot is the block's place in the mix, from 0 without gaps; place is the row's place in its block; release and
    deadline bound the slot (release <= slot < deadline). docs needs doc_id, source and text. A null source is a
    source of its own, null ids and texts are values like others, repeated rows get a place each, extra columns
    are ignored, an empty table gives no rows. A source that weights doesn't name weighs a millionth of their sum.
    The table of sources, some 60 bytes each, is sent to every task. chunk: slots scheduled in one go.
    """
    sources = materialize(weighed_sources(docs, weights, power, block_docs), "sources")
    size = sources.select(F.size("s")).first()[0]
    windows = materialize(block_windows(sources), "windows")
    slots = block_slots(windows, chunk or max(LEAST_CHUNK, size // SOURCES_PER_SLOT))
    plan = windows.join(slots, ["i", "block"]).select(F.col("source").alias("_source"), F.col("block").alias("_block"), "release", "deadline", "slot")
    rows = numbered(docs)
    rows = rows.withColumn("block", F.floor(F.col("number") / block_docs)).withColumn("place", (F.col("number") % block_docs).cast("int"))
    out = rows.join(plan, F.col("source").eqNullSafe(F.col("_source")) & (F.col("block") == F.col("_block")))
    return out.select(*KEY, "copy", "block", "release", "deadline", "slot", "place")


def placed_documents(docs: DataFrame, weights: Mapping[str | None, float] | None = None, power: float = 0.5, block_docs: int = 16) -> DataFrame:
    """The rows of docs, with the columns of documents and their slot and place in the mix, in any order. Equal rows go where the first of them goes."""
    docs = docs.select(*[c for c in DOCUMENT_COLUMNS if c in docs.columns])
    plan = mix_schedule(docs, weights, power, block_docs).groupBy(*KEY).agg(F.min(F.struct("slot", "place")).alias("_at"))
    plan = materialize(plan.select(*[F.col(c).alias(f"_{c}") for c in KEY], "_at"), "mix")
    on = F.col("_row.source").eqNullSafe(F.col("_source")) & F.col("_row.doc_id").cast("bigint").eqNullSafe(F.col("_doc_id")) & (F.col("_hash") == F.col("_text_hash"))
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.xxhash64("text").alias("_hash"))
    return rows.join(plan, on).select("_row.*", "_at.slot", "_at.place")


def mix_documents(docs: DataFrame, weights: Mapping[str | None, float] | None = None, power: float = 0.5, block_docs: int = 16) -> DataFrame:
    """The rows of docs, with the columns of documents, in the order of the mix: partitions are ascending ranges of slots."""
    placed = placed_documents(docs, weights, power, block_docs)
    return placed.repartitionByRange("slot").sortWithinPartitions("slot", "place").drop("slot", "place")
