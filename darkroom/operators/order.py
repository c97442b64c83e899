"""Places in an order, without gathering a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from darkroom.sources.scratch import materialize, owned


@owned
def placed(rows: DataFrame, group: list[str], order: list[Column], name: str) -> DataFrame:
    """``rows`` with their place from 0 in ``order`` within each ``group`` (none: of all rows) as ``name``.

    Rows are dealt to range partitions and numbered there, above the sizes of the partitions before,
    so that a group of any size is spread over tasks.  ``order`` should have no ties.
    """
    return summed(rows, group, order, F.lit(1).cast("long"), name)


@owned
def summed(rows: DataFrame, group: list[str], order: list[Column], weight: Column, name: str) -> DataFrame:
    """``rows`` with the sum of ``weight`` (whole numbers) over those before them, as :func:`placed` has their number."""
    keys = [F.col(c) for c in group]
    weighed = rows.withColumn("_weight", weight.cast("long"))
    ranged = materialize(weighed.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()))
    local = Window.partitionBy(*group, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sizes = ranged.groupBy(*group, "_part").agg(F.sum("_weight").alias("_size"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    offsets = materialize(sizes.withColumn("_offset", F.coalesce(F.sum("_size").over(before), F.lit(0))).drop("_size"))
    out = ranged.withColumn("_upto", F.sum("_weight").over(local)).join(offsets, [*group, "_part"])
    return out.withColumn(name, (F.col("_upto") - F.col("_weight") + F.col("_offset")).cast("long")).drop("_upto", "_weight", "_offset", "_part")


#: Bins into which a pass of :func:`values_at` divides what is left of a group's values.
BINS = 1024


@owned
def values_at(rows: DataFrame, group: list[str], value: str, places: DataFrame) -> DataFrame:
    """``places`` (the ``group`` columns, name, place from 0) with ``at``: the value at that place in ascending order.

    The values of a group are not sorted: each pass counts them in equal bins between the least and
    the greatest that are left, and goes on with the bin that holds the place, until its values are
    equal.  A pass is a partial aggregation of all rows; a group of any size is spread over tasks.
    Values are numbers without nulls; a place that a group does not have gives no row.
    """
    key = [*group, "name"]
    ends = materialize(rows.groupBy(*group).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(F.lit(1)).alias("n")))
    state = materialize(places.join(ends, group).filter("place < n").drop("n"))
    done = None
    values = rows.select(*group, F.col(value).cast("double").alias("_v"))
    while True:
        ready = state.filter("lo = hi").select(*key, "place", F.col("lo").alias("at"))
        done = ready if done is None else done.unionByName(ready)
        state = state.filter("lo < hi")
        if state.isEmpty():
            return done.drop("place")
        # halves, so that the width of a range does not overflow
        width = F.col("hi") / 2 - F.col("lo") / 2
        share = F.when(width > 0, (F.col("_v") / 2 - F.col("lo") / 2) / width).otherwise(F.when(F.col("_v") == F.col("hi"), 1.0).otherwise(0.0))
        inside = values.join(state, group).filter(F.col("_v").between(F.col("lo"), F.col("hi")))
        binned = inside.withColumn("bin", F.least(F.floor(share * BINS), F.lit(BINS - 1)))
        counts = binned.groupBy(*key, "place", "bin").agg(F.count(F.lit(1)).alias("c"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
        upto = Window.partitionBy(*key, "place").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # BINS rows at most
        counts = counts.withColumn("upto", F.sum("c").over(upto)).withColumn("left", F.col("place") - F.col("upto") + F.col("c"))
        state = materialize(counts.filter("place < upto AND left >= 0").select(*key, F.col("left").alias("place"), "lo", "hi"))
