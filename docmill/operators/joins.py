"""[extension] Joins by time and by range, as equi-joins: no nested loops, no task for a hot key; what ranges hold, counted without pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmill.tables import settled


def _slice(ts: Column, borders: list) -> Column:
    """How many borders lie at or below ts."""
    out = F.lit(0)
    for b in borders:
        out = out + F.when(ts >= F.lit(b), 1).otherwise(0)
    return out


def asof(left: DataFrame, right: DataFrame, key: list[str], ts: str, value: str, slices: int = 32) -> DataFrame:
    """left with the value of the last row of right with its key and no later ts, or null where there is none.

    Both have the key and ts; of right rows of one key and ts the greatest value counts, and a null key meets nothing.
    Rows of both sides are sorted together within a key and a slice of time (even shares of all rows),
    and the last value is carried on; what a slice hands to those after it is one row for each key, so a key
    with a third of all rows is cut into as many tasks as there are slices.
    """
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    shares = [i / slices for i in range(1, slices)]
    borders = sorted(set(left.select(micros.alias("_t")).union(right.select(micros.alias("_t"))).agg(F.percentile_approx("_t", shares, 1000)).first()[0] or []))
    offered = right.filter(F.col(ts).isNotNull()).groupBy(*key, micros.alias("_t")).agg(F.max(value).alias("_value"))
    rows = left.select(*key, F.struct(*left.columns).alias("_row"), micros.alias("_t"), F.lit(None).cast(right.schema[value].dataType).alias("_value"), F.lit(1).alias("_side"))
    both = rows.unionByName(offered.select(*key, F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"), "_t", "_value", F.lit(0).alias("_side")))
    both = both.withColumn("_slice", _slice(F.col("_t"), borders))
    handed = both.filter("_side = 0").groupBy(*key, "_slice").agg(F.max_by("_value", "_t").alias("_last"))
    slots = both.select(*key, "_slice").distinct().join(handed, [*key, "_slice"], "left")
    before = Window.partitionBy(*key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = slots.select(*key, "_slice", F.last("_last", ignorenulls=True).over(before).alias("_carried"))
    run = Window.partitionBy(*key, "_slice").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    own = both.withColumn("_own", F.last("_value", ignorenulls=True).over(run)).filter("_side = 1")
    found = own.join(carried, [*key, "_slice"], "left")
    known = F.when(F.col("_t").isNotNull(), F.coalesce("_own", "_carried"))
    for k in key:
        known = F.when(F.col(k).isNotNull(), known)
    return found.select("_row.*", known.alias(value))


def in_ranges(points: DataFrame, ranges: DataFrame, at: str, low: str, high: str, base: float | None = None, factor: int = 16) -> DataFrame:
    """Each pair of a point and a range that holds it (both ends included), once: all columns of both.

    Ranges are kept in bins as wide as they are long: a range of length up to base * factor^l lies in one or two bins of level
    l, and a point looks into one bin of each level that is in use. Ranges of very different
    lengths therefore cost two rows each, not one for every base unit that they cover. Empty ranges (high below low) and nulls hold nothing.
    base: the shortest bin; by default the tenth percentile of the lengths.
    """
    length = F.col(high).cast("double") - F.col(low).cast("double")
    sizes = ranges.filter(length >= 0).agg(F.percentile_approx(length, 0.1), F.max(length)).first()
    base = base or max(sizes[0] or 0.0, (sizes[1] or 0.0) / factor**8) or 1.0
    levels = 1
    while base * factor ** (levels - 1) < (sizes[1] or 0.0):
        levels += 1
    width = lambda level: F.lit(base) * F.pow(F.lit(float(factor)), level)
    level = sum((F.when(length > base * factor**i, 1).otherwise(0) for i in range(levels - 1)), F.lit(0))
    first, last = (F.floor(F.col(c).cast("double") / width(F.col("_level"))).cast("long") for c in (low, high))
    placed = ranges.filter(length >= 0).withColumn("_level", level).withColumn("_bin", F.explode(F.sequence(first, last)))
    looked = points.filter(F.col(at).isNotNull()).withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))))
    looked = looked.withColumn("_bin", F.floor(F.col(at).cast("double") / width(F.col("_level"))).cast("long"))
    met = looked.join(placed, ["_level", "_bin"]).filter((F.col(at) >= F.col(low)) & (F.col(at) <= F.col(high)))
    return met.drop("_level", "_bin")


def counted_ranges(points: DataFrame, ranges: DataFrame, at: str, low: str, high: str) -> DataFrame:
    """Each range that holds a point (both ends included), with n, the number of its points, and least and most, the first and last of them.

    No pair of a point and a range is made: the different values of points and ends are sorted once, by ranges that are counted by
    themselves and shifted by what lies before them. Every value then knows how many points lie up to it and the
    nearest ones, and a range looks up its two ends. Empty ranges (high below low) and nulls hold nothing.
    """
    kind = points.schema[at].dataType
    ends = ranges.select(F.col(low).alias("_v")).unionByName(ranges.select(F.col(high).alias("_v"))).withColumn("_n", F.lit(0))
    values = points.select(F.col(at).alias("_v"), F.lit(1).alias("_n")).unionByName(ends).filter("_v is not null")
    once = values.groupBy("_v").agg(F.sum("_n").alias("_n"))
    shares = max(1, int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # a second shuffle would draw other ranges
    held = settled(once.repartitionByRange(shares, "_v").withColumn("_share", F.spark_partition_id()))
    point = F.when(F.col("_n") > 0, F.col("_v"))
    sums = held.groupBy("_share").agg(F.sum("_n").alias("_sum"), F.min(point).alias("_first"), F.max(point).alias("_last"))
    before = Window.orderBy("_share").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy(F.desc("_share")).rowsBetween(Window.unboundedPreceding, -1)
    beside = sums.select("_share", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"), F.max("_last").over(before).alias("_last"), F.min("_first").over(after).alias("_first"))
    up = Window.partitionBy("_share").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    down = Window.partitionBy("_share").orderBy(F.desc("_v")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = held.select("_share", "_v", "_n", F.sum("_n").over(up).alias("_upto"), F.max(point).over(up).alias("_below"), F.min(point).over(down).alias("_above"))
    marks = run.join(beside, "_share").select(
        "_v",
        (F.col("_before") + F.col("_upto")).alias("_upto"),
        (F.col("_before") + F.col("_upto") - F.col("_n")).alias("_less"),
        F.coalesce("_below", "_last").cast(kind).alias("most"),
        F.coalesce("_above", "_first").cast(kind).alias("least"),
    )
    wide = once.schema["_v"].dataType
    begun = ranges.withColumn("_v", F.col(low).cast(wide)).join(marks.select("_v", "_less", "least"), "_v").drop("_v")
    ended = begun.withColumn("_v", F.col(high).cast(wide)).join(marks.select("_v", "_upto", "most"), "_v")
    return ended.select(*ranges.columns, (F.col("_upto") - F.col("_less")).alias("n"), "least", "most").filter("n > 0")
