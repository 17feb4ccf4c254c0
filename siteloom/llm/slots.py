"""Shards through fixed virtual slots, with DataFrame functions only.

Records are hashed into a fixed number of slots, many more than shards. The bytes of each slot are summed, and
a map from slot to shard is made from those sums: the largest slot first, each to the shard with the least bytes so
far. Maps are stored as versions in one folder. Rebalancing loads the last version and edits it, never the slots:
the next version moves whole slots only, off shards that hold too much, and all others stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siteloom.llm.common import let, work_path

#: Copies of one record are numbered in runs of this length, so that no array grows with the copies.
COPY_RUN = 1 << 16


def record_size(text: Column) -> Column:
    return F.octet_length(F.coalesce(text, F.lit(""))).cast("bigint") + 16


def slotted_records(docs: DataFrame, n_slots: int) -> DataFrame:
    """(doc_id, size, text_crc32, copy, vslot) per row of docs.

    The slot is a hash of doc_id, the text's crc32 and, from the second on, the number among equal records. So
    neither a repeated id nor a repeated row makes a heavy slot. Equal records are counted before the shuffle.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    each = docs.select(F.col("doc_id").cast("bigint"), record_size(F.col("text")).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    counted = each.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("copies"))
    runs = counted.withColumn("from_copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1, F.lit(COPY_RUN).cast("bigint"))))
    last = F.least(F.col("copies") - 1, F.col("from_copy") + COPY_RUN - 1)
    rows = runs.withColumn("copy", F.explode(F.sequence("from_copy", last)))
    return rows.select("doc_id", "size", "text_crc32", "copy", F.pmod(F.xxhash64("doc_id", "text_crc32", "copy"), F.lit(n_slots)).cast("int").alias("vslot"))


def slot_sizes(records: DataFrame) -> DataFrame:
    return records.groupBy("vslot").agg(F.sum("size").alias("slot_bytes"), F.count("*").alias("slot_rows"))


def placed_slots(sizes: DataFrame, kept: DataFrame, n_shards: int) -> DataFrame:
    """(vslot, shard): the slots of sizes that kept(vslot, shard) lacks, by falling bytes, each to the lightest shard.

    Slots are a fixed number, n_slots at most; they are folded in one array.
    """
    free = sizes.join(kept, "vslot", "left_anti")
    loads = kept.join(sizes, "vslot").groupBy("shard").agg(F.sum("slot_bytes").alias("held"))
    held = loads.agg(F.map_from_entries(F.collect_list(F.struct("shard", "held"))).alias("m"))  # one entry per shard
    ordered = free.agg(F.sort_array(F.collect_list(F.struct((-F.col("slot_bytes")).alias("rank"), "vslot"))).alias("slots")).withColumn("m", held.scalar())

    def place(state: Column, slot: Column) -> Column:
        return let(
            F.array_position(state["load"], F.array_min(state["load"])).cast("int") - 1,
            lambda at: F.struct(
                F.transform(state["load"], lambda load, i: F.when(i == at, load - slot["rank"]).otherwise(load)).alias("load"),
                F.concat(state["map"], F.array(F.struct(slot["vslot"].alias("vslot"), at.alias("shard")))).alias("map"),
            ),
        )

    start = F.struct(
        F.transform(F.sequence(F.lit(0), F.lit(n_shards - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0).cast("bigint"))).alias("load"),
        F.array().cast("array<struct<vslot:int,shard:int>>").alias("map"),
    )
    return ordered.select(F.explode(F.aggregate("slots", start, place)["map"]).alias("m")).select("m.vslot", "m.shard")


def new_map(sizes: DataFrame, n_shards: int) -> DataFrame:
    """(vslot, shard, version): a first version."""
    none = sizes.where("false").select("vslot", F.lit(0).alias("shard"))
    return placed_slots(sizes, none, n_shards).withColumn("version", F.lit(1))


def rebalanced_map(slot_map: DataFrame, sizes: DataFrame, n_shards: int, slack: float = 0.01) -> DataFrame:
    """The next version after sizes have changed.

    A shard that holds more than its share and the slack gives up slots, in hash order, until it doesn't; those, and slots
    that had no rows before, go to the lightest shards. n_shards may be larger than before; other slots stay.
    """
    known = slot_map.join(sizes, "vslot", "left").fillna(0, ["slot_bytes"])
    share = sizes.agg(F.coalesce(F.sum("slot_bytes"), F.lit(0)) / n_shards * (1 + slack)).scalar()
    order = Window.partitionBy("shard").orderBy(F.xxhash64("vslot"), "vslot").rowsBetween(Window.unboundedPreceding, 0)
    kept = known.withColumn("so_far", F.sum("slot_bytes").over(order)).withColumn("share", share).where("so_far <= share or slot_bytes = 0").select("vslot", "shard")
    version = slot_map.agg(F.max("version") + 1).scalar()
    return kept.unionByName(placed_slots(sizes, kept, n_shards)).withColumn("version", version)


def store_map(slot_map: DataFrame, folder: str) -> int:
    """Add a version to the folder; the version's number. A version that is there already is an error."""
    version = slot_map.agg(F.max("version")).first()[0] or 1
    slot_map.select("vslot", "shard").coalesce(1).write.parquet(f"{folder}/version={version}")
    return version


def load_map(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """(vslot, shard, version) of a stored version, the last one by default."""
    stored = spark.read.schema("vslot int, shard int, version int").parquet(folder)
    return stored.where(F.col("version") == (stored.agg(F.max("version")).first()[0] if version is None else version))


def grow_map(slot_map: DataFrame, sizes: DataFrame, n_shards: int) -> DataFrame:
    """The next version for one more shard: each old shard hands over slots, in hash order, worth its share of the new one.

    Slots move only into the new shard; no other slot changes its shard.
    """
    known = slot_map.join(sizes, "vslot")
    order = Window.partitionBy("shard").orderBy(F.xxhash64("vslot"), "vslot")
    share = F.sum("slot_bytes").over(Window.partitionBy("shard")) / (n_shards + 1)
    so_far = F.sum("slot_bytes").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return known.select("vslot", F.when(so_far <= share, F.lit(n_shards)).otherwise(F.col("shard")).cast("int").alias("shard"), (F.col("version") + 1).alias("version"))


def shard_documents(docs: DataFrame, n_shards: int = 40, n_slots: int = 4096, folder: str | None = None) -> DataFrame:
    """Per row of docs: doc_id, size, text_crc32, law, shard, slot, grown_shard, vslot, version, next_shard.

    The law is `bytes`: shards have nearly equal sizes. folder holds the versions of the slot map: the last one is
    rebalanced where shards have become uneven, and the result stored as the next version; without a folder a first version is made and stored in
    a new one. slot numbers the rows of a shard without gaps: by virtual slot, then doc_id. next_shard is the shard
    after the map has grown by one more shard. A null text has size 16 and the crc of no bytes; a null doc_id is hashed
    like any value; extra columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    records = slotted_records(docs, n_slots)
    sizes = slot_sizes(records)
    if folder is None:
        folder = work_path(spark, "slot-map")
        version = store_map(new_map(sizes, n_shards), folder)
    else:
        version = store_map(rebalanced_map(load_map(spark, folder), sizes, n_shards), folder)
    used = load_map(spark, folder, version)
    grown = grow_map(used, sizes, n_shards).select("vslot", F.col("shard").alias("next_shard"))
    # n_slots rows at most from here to the join.
    ahead = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    plan = used.join(sizes, "vslot").select("vslot", "shard", "version", F.coalesce(F.sum("slot_rows").over(ahead), F.lit(0)).alias("before")).join(grown, "vslot")
    within = Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "copy")
    placed = records.withColumn("at", F.row_number().over(within) - 1).join(F.broadcast(plan), "vslot")
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("at")).cast("bigint").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "vslot", "version", "next_shard",
    )
