"""Joins on order rather than equality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of_join(left: DataFrame, right: DataFrame, by: str, on: str, take: str) -> DataFrame:
    """left with, in ``take``, that column of the last row of right with the same ``by`` and a time ``on`` that isn't after it (null: none).

    Both sides are dealt out by key once and sorted; no pair is made. Rows of right at the same time as one of left count;
    of those at the same time the greatest value of ``take`` does. Rows with a null key or time meet none.
    """
    names = [c for c in left.columns if c != take]
    mine = left.select(F.col(by).alias("_by"), F.col(on).alias("_on"), F.lit(1).alias("_side"), F.lit(None).cast(right.schema[take].dataType).alias("_take"), F.struct(*names).alias("_row"))
    theirs = right.filter(F.col(by).isNotNull() & F.col(on).isNotNull()).select(F.col(by).alias("_by"), F.col(on).alias("_on"), F.lit(0).alias("_side"), F.col(take).alias("_take"))
    before = Window.partitionBy("_by").orderBy("_on", "_side", "_take").rowsBetween(Window.unboundedPreceding, 0)
    rows = mine.unionByName(theirs, allowMissingColumns=True).withColumn("_last", F.last("_take", ignorenulls=True).over(before))
    return rows.filter("_side = 1").select(*(F.col(f"_row.{c}") for c in names), F.when(F.col("_by").isNotNull() & F.col("_on").isNotNull(), F.col("_last")).alias(take))


def interval_join(points: DataFrame, intervals: DataFrame, by: str, at: Column, low: Column, high: Column, width: int) -> DataFrame:
    """Pairs of a point and an interval (low to high, both included) of the same key (``by``, a column of both) that holds it.

    at, low and high are integers. Intervals are filed under each stretch of ``width`` that they touch, points under their own, so
    that only points near an interval meet it and a key with many rows is spread over its stretches. Pick a width near
    the intervals' usual length.
    """
    stretch = lambda x: F.floor(x / width).cast("long")
    p = points.withColumn("_at", at.cast("long")).withColumn("_stretch", stretch(F.col("_at")))
    i = intervals.withColumn("_low", low.cast("long")).withColumn("_high", high.cast("long")).filter("_low <= _high")
    i = i.withColumn("_stretch", F.explode(F.sequence(stretch(F.col("_low")), stretch(F.col("_high")))))
    return p.join(i, [by, "_stretch"]).filter(F.col("_at").between(F.col("_low"), F.col("_high"))).drop("_at", "_low", "_high", "_stretch")
