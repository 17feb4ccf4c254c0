"""Values that an expression reads several times are written into the plan once: plans stay small and rows cheap."""

import json
import time

from pyspark.sql import functions as F

from siteloom.functions import text as T
from siteloom.functions.once import let
from siteloom.operators import normalize as N
from siteloom.operators import state


def written_size(df):
    return len(df._jdf.queryExecution().optimizedPlan().toString())


def test_heading_is_read_once(spark):
    words = spark.createDataFrame([("BEST O'NEIL-MACDONALD (HVAC) OF THE TOWN",), ("hvac and more",), ("¡¡",), ("As It Is",), (None,)], "t string")
    assert [r.t for r in words.select(T.humanize_heading(F.col("t")).alias("t")).collect()] == ["Best O'Neil-MacDonald (HVAC) of the Town", "HVAC and more", "¡¡", "As It Is", ""]
    once = F.concat(F.lit("Read_once "), F.col("t"))
    plan = words.select(T.humanize_heading(once).alias("h"), T.slug(once).alias("s"), T.truncate_words(once, 20).alias("w"), T.word_count(once).alias("n"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Read_once") == 4


def test_slugs_fall_back_and_words_count(spark):
    rows = spark.createDataFrame([("a  b　c ",), (" -- ",), ("",), (None,)], "t string")
    assert [tuple(r) for r in rows.select(T.slug(F.col("t")), T.slug(F.col("t"), ""), T.word_count(F.col("t"))).collect()] == [("a-b-c", "a-b-c", 3), ("item", "", 1), ("item", "", 0), ("item", "", 0)]


def test_normalising_many_items_takes_time_in_proportion(spark):
    """A list of 400 services was worked out anew for every one of its items."""
    items = [{"name": f"JOB {i}", "summary": "s", "steps": [{"title": "CALL"}]} for i in range(400)]
    one = spark.createDataFrame([("s", json.dumps({"services": items + items}))], "site string, profile string")
    df = N.normalize_profiles(one).select("services")
    assert written_size(df) < 60_000
    began = time.monotonic()
    assert [s.slug for s in df.first().services] == [f"job-{i}" for i in range(400)]
    assert time.monotonic() - began < 60


def test_small_tables_are_spread(spark):
    assert state.spread(spark.range(100).coalesce(1), "id").rdd.getNumPartitions() >= 12


def test_profiles_are_read_in_one_pass(spark):
    """Every field had a walk of its own from the profile's root, with an exception where it was missing; there were more than 200."""
    rows = spark.createDataFrame([("s", '{"business": [], "contact": {"phone": 5, "geo": {"lat": "x"}}, "services": ["bare", {"title": "a", "cta": "no"}]}')], "site string, profile string")
    df = N.normalize_profiles(rows)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("variant_get(") < 120
    r = df.first()
    assert (r.business.name, r.contact.phone, r.contact.phones, r.contact.geo.lat, [(s.slug, s.cta) for s in r.services]) == ("", "5", ["5"], None, [("a", None)])


def test_shared_value_asks_for_no_type_per_row(spark):
    """An item of a transformed list works out the type of its whole expression with every row."""
    df = spark.range(3).select(let(F.col("id") * 2, lambda x: let(x + 1, lambda y: F.struct((x + y).alias("n"), y.alias("y")))).alias("v"))
    assert [tuple(r.v) for r in df.collect()] == [(1, 1), (5, 3), (9, 5)]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") == 2 and "transform(" not in plan
    assert spark.range(1).select(let(F.lit(None).cast("string"), lambda x: F.coalesce(x, F.lit("none")))).first()[0] == "none"
