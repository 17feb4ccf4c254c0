"""Joins on the structure of pages: a node's subtree is the interval from its id to its last id, and intervals nest.

All of them go through a page's nodes in document order once, by windows that share one exchange by page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGE = ["site", "page_id"]


def so_far(*by: str, order: str | Column = "node_id", own: bool = True) -> Window:
    """The rows of a page (and of what `by` names) up to a row, or before it."""
    return Window.partitionBy(*PAGE, *by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0 if own else -1)


def covered(rule: Column, strict: bool = False) -> Column:
    """Whether a node lies in the subtree of a node that meets the rule; strict: of another one. Needs node_id and last_id."""
    reach = F.max(F.when(F.coalesce(rule, F.lit(False)), F.col("last_id"))).over(so_far(own=not strict))
    return F.coalesce(reach >= F.col("node_id"), F.lit(False))


def enclosing(inner: DataFrame, outer: DataFrame, strict: bool = False) -> DataFrame:
    """Each row of inner (site, page_id, node_id, ...) beside each row of outer (site, page_id, o_id, o_last, ...) in whose subtree it lies.

    strict: a node isn't in its own subtree. Intervals open and close in document order; the number of open ones is the level of an
    interval, intervals of one level are apart, so the last that opened on a level is the one that is open there. The
    work grows with the nodes and with the rows that come out.
    """
    own, other = ([c for c in df.columns if c not in PAGE] for df in (inner, outer))
    place = lambda at, turn, tie, step: [at.cast("bigint").alias("_at"), F.lit(turn).alias("_turn"), tie.cast("bigint").alias("_tie"), F.lit(step).alias("_step")]
    opens = outer.select(*PAGE, *place(F.col("o_id"), 2 if strict else 1, -F.col("o_last"), 1), F.struct(*other).alias("_o"))
    closes = outer.select(*PAGE, *place(F.col("o_last") + 1, 0, F.lit(0), -1))
    points = inner.select(*PAGE, *place(F.col("node_id"), 1 if strict else 2, F.lit(0), 0), *[F.col(c).alias(f"_i_{c}") for c in own])
    order, up_to = ["_at", "_turn", "_tie"], (Window.unboundedPreceding, 0)
    events = opens.unionByName(closes, allowMissingColumns=True).unionByName(points, allowMissingColumns=True)
    rows = events.withColumn("_open", F.sum("_step").over(Window.partitionBy(*PAGE).orderBy(*order).rowsBetween(*up_to)))
    levels = F.when(F.col("_step") == 1, F.array("_open")).when((F.col("_step") == 0) & (F.col("_open") > 0), F.sequence(F.lit(1).cast("bigint"), "_open"))
    each = rows.withColumn("_level", F.explode(levels))
    last = F.last("_o", ignorenulls=True).over(Window.partitionBy(*PAGE, "_level").orderBy(*order).rowsBetween(*up_to))
    return each.withColumn("_o", last).where("_step = 0").select(*PAGE, *[F.col(f"_i_{c}").alias(c) for c in own], *[F.col(f"_o.{c}").alias(c) for c in other])
