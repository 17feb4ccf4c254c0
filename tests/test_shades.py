"""Colours in batches against single steps."""

from pyspark.sql import functions as F

from siteloom.functions import colour as C
from siteloom.operators.palettes import PALETTES
from siteloom.plans.harvest_queries import brand_contrast_matrix


def test_readable_is_the_first_shade_that_passes(spark):
    backs = ("#f4f5f7", "#101317", "#808080")
    rows = spark.createDataFrame([(f"#{i * 7919 % 16777216:06x}", b) for i in range(300) for b in backs] + [(None, "#ffffff"), ("no", "#ffffff")], "c string, b string")
    got = rows.select("c", "b", C.ensure_contrast(F.col("c"), F.col("b")).alias("made"), C.contrast(F.col("c"), F.col("b")).alias("own"), C.luminance(F.col("b")).alias("lum"), C.hsl(F.col("c")).alias("x"))
    sign = F.when(F.col("lum") < 0.5, 1).otherwise(-1)
    steps = got.where("own < 4.5").select("c", "b", "made", F.posexplode(F.array(*[C.from_hsl(F.col("x.h"), F.col("x.s"), 0.5 + sign * i / 100.0) for i in range(51)])).alias("i", "shade"))
    first = steps.withColumn("r", C.contrast(F.col("shade"), F.col("b"))).groupBy("c", "b", "made").agg(F.min_by("shade", F.when(F.col("r") >= 4.5, F.col("i"))).alias("want"), F.max("r").alias("most")).collect()
    assert len(first) > 300 and all(r.made == r.want for r in first if r.most >= 4.5)
    assert all(r.made == (r.c if r.own is not None else None) for r in got.where("own is null or own >= 4.5").collect())


def test_tones_read_their_colour_once(spark):
    plan = spark.range(1).select(C.ramp(F.concat(F.lit("#1f3a9"), F.col("id").cast("string"))).alias("t"))
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("#1f3a9") < 8  # whether there is one, and three channels
    assert len(plan.first().t) == 10


def test_brand_contrast_sends_no_rows_through_the_driver(spark, tmp_path):
    """A row for each part and palette, from a file so small that a join would take the rows for a dimension."""
    spark.range(1, 4).selectExpr("id as p_partkey", "1 as p_size").write.parquet(f"{tmp_path}/part.parquet")
    found = brand_contrast_matrix(spark, str(tmp_path))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "BroadcastExchange" not in plan
    rows = found.collect()
    assert len(rows) == 3 * len(PALETTES) and len({(r.site, r.theme, r["mode"]) for r in rows}) == len(rows) and all(r.fit for r in rows)
