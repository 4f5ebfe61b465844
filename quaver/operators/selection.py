"""Exact order statistics of large groups and deep pages, without a task that holds a group (A-18, O-17)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import stored

#: Rows of a group that one task may sort at the end, and relative accuracy of the quantile sketches before.
FEW, ACCURACY = 20_000, 1000


def medians(rows: DataFrame, key: str, value: str, few: int = FEW) -> DataFrame:
    """(key, median) of the values that are not null; the mean of the two middle ones of an even number.

    Mergeable quantile sketches bracket the middle of every group, exact counts confirm the bracket, and only what lies
    inside it goes on, until a bracket is one value, holds few rows, or cannot shrink as its ends are values that repeat;
    equal values are one in the last step.  Groups without values are left out.
    """
    values = rows.select(F.col(key).alias("k"), F.col(value).cast("double").alias("v")).filter("v is not null")
    same = F.col("a.k").eqNullSafe(F.col("b.k"))
    # ranks of the two middle values, how many lie below the bracket and inside it, and whether it may still shrink
    state = values.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    state = stored(state.select("k", F.expr("(n + 1) div 2").alias("r1"), F.expr("n div 2 + 1").alias("r2"), F.lit(0).cast("long").alias("below"), F.col("n").alias("inside"), "lo", "hi", F.lit(True).alias("loose")))
    wide = F.col("loose") & (F.col("lo") < F.col("hi")) & (F.col("inside") > few)
    while not state.filter(wide).isEmpty():
        held = values.alias("a").join(state.filter(wide).alias("b"), same).filter("v >= lo and v <= hi").select("b.*", "v")
        sketch = held.groupBy("k").agg(F.percentile_approx("v", [x / ACCURACY for x in range(ACCURACY + 1)], 4 * ACCURACY).alias("q"), *(F.first(c).alias(c) for c in ("r1", "r2", "below", "inside")))
        # two points of the sketch on both sides of the middle
        share = lambda r: F.least(F.lit(1.0), (F.col(r) - F.col("below")) / F.col("inside")) * ACCURACY
        low, high = F.greatest(F.floor(share("r1")) - 2, F.lit(0)), F.least(F.ceil(share("r2")) + 2, F.lit(ACCURACY))
        bracket = sketch.select("k", F.element_at("q", (low + 1).cast("int")).alias("low"), F.element_at("q", (high + 1).cast("int")).alias("high"))
        both = held.alias("a").join(bracket.alias("b"), same).select("a.*", "low", "high")
        counts = both.groupBy("k", "r1", "r2", "below", "inside", "lo", "hi", "low", "high").agg(F.count_if(F.col("v") < F.col("low")).alias("under"), F.count_if((F.col("v") >= F.col("low")) & (F.col("v") <= F.col("high"))).alias("within"))
        # a bracket that misses a middle value on one side keeps the old end there
        left = F.col("below") + F.col("under") < F.col("r1")
        right = F.col("below") + F.col("under") + F.col("within") >= F.col("r2")
        over = F.col("inside") - F.col("under") - F.col("within")
        left_in = F.col("within") + F.when(left, 0).otherwise(F.col("under")) + F.when(right, 0).otherwise(over)
        new = counts.select(
            "k", "r1", "r2", F.when(left, F.col("below") + F.col("under")).otherwise(F.col("below")).alias("below"), left_in.alias("inside"),
            F.when(left, F.col("low")).otherwise(F.col("lo")).alias("lo"), F.when(right, F.col("high")).otherwise(F.col("hi")).alias("hi"), (left_in < F.col("inside")).alias("loose"),
        )
        state = stored(state.filter(~wide).unionByName(new))
    one = state.filter("lo = hi").select("k", F.col("lo").alias("median"))
    rest = values.alias("a").join(state.filter("lo < hi").alias("b"), same).filter("v >= lo and v <= hi").select("b.k", "r1", "r2", "below", "v")
    counted = rest.groupBy("k", "r1", "r2", "below", "v").agg(F.count(F.lit(1)).alias("c"))
    to = F.col("below") + F.sum("c").over(Window.partitionBy("k").orderBy("v"))
    ranked = counted.withColumn("to", to).withColumn("from", F.col("to") - F.col("c"))
    hit = lambda r: F.max(F.when((F.col("from") < F.col(r)) & (F.col("to") >= F.col(r)), F.col("v")))
    middle = ranked.groupBy("k").agg(((hit("r1") + hit("r2")) / 2).alias("median"))
    return one.unionByName(middle).withColumnRenamed("k", key)


def ranked(rows: DataFrame, *order) -> DataFrame:
    """``rows`` with part and place, their position from 1 in the order, which must be total: sorted in ranges, each numbered by itself.

    Stored by part, a page is found by its places: the parts that hold them are known from their names, the rows from the files' statistics.
    """
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = stored(rows.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()))
    counts = ranges.groupBy("part").agg(F.count(F.lit(1)).alias("c"))
    before = stored(counts.select("part", (F.sum("c").over(Window.orderBy("part")) - F.col("c")).alias("before")))  # a row for each part
    own = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return ranges.withColumn("own", own).join(F.broadcast(before), "part").withColumn("place", F.col("before") + F.col("own")).drop("own", "before")
