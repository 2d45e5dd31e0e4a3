"""As-of joins by blocks of time: no key is sorted by one task, and no rows meet in pairs.

Each row takes the last row of the other side at or before it. Both sides are cut into blocks of time; of each block of a
key the last row is found by an aggregate, and carried into the next blocks over as many rows as the key has blocks. Within
a block, both sides are sorted together once and each row takes the last one passed, a frame that only grows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = 86_400_000_000


def micros(time: Column) -> Column:
    return F.unix_micros(time.cast("timestamp"))


def joined(left: DataFrame, right: DataFrame, keys: list[str], at: Column, right_at: Column, value: Column, rank: Column, span: int, inclusive: bool) -> DataFrame:
    """left's rows as _row with _found, the value (a struct) of the last row of right whose right_at is before at, or at it if
    inclusive. Rows of right at one time are ordered by rank. Times are longs, and span is a block's length. Null keys meet each
    other; a null time meets nothing."""
    block = lambda t: ((t - F.pmod(t, F.lit(span))) / span).cast("long")
    # columns are numbered, so that keys may be named as they like
    names = [f"_key{i}" for i in range(len(keys))]
    named = [F.col(k).alias(n) for k, n in zip(keys, names)]
    asks = left.select(*named, at.alias("_at"), F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("_row"))
    seen = right.select(*named, right_at.alias("_at"), rank.cast("long").alias("_rank"), value.alias("_value")).where(F.col("_at").isNotNull())
    asks, seen = (df.withColumn("_block", block(F.col("_at"))) for df in (asks, seen))
    order = F.struct("_at", "_rank")
    # the asks' blocks have no last row of their own, and may get one carried
    ends = seen.select(*names, "_block", order.alias("_order"), "_value").unionByName(asks.where("_block IS NOT NULL").select(*names, "_block"), allowMissingColumns=True)
    blocks = ends.groupBy(*names, "_block").agg(F.max_by("_value", "_order").alias("_value"))
    earlier = Window.partitionBy(*names).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.withColumn("_value", F.last("_value", ignorenulls=True).over(earlier)).where("_value IS NOT NULL")
    first = carried.select(*names, (F.col("_block") * span - 1).alias("_at"), F.lit(None).cast("long").alias("_rank"), "_value", "_block", F.lit(0).alias("_side"))
    both = seen.withColumn("_side", F.lit(0 if inclusive else 2)).unionByName(first).unionByName(asks.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    passed = Window.partitionBy(*names, "_block").orderBy("_at", "_side", "_rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("_found", F.last("_value", ignorenulls=True).over(passed)).where("_side = 1").select("_row", F.when(F.col("_at").isNotNull(), F.col("_found")).alias("_found"))


def prior(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, columns: list[str], span: int = DAY) -> DataFrame:
    """left with the columns of the last row of right that is strictly before it; null if there is none. Of several rows of
    right at one time, any is taken. A ticker of any number of ticks is spread over as many tasks as it has blocks."""
    value = F.struct(*columns)
    found = joined(left, right, [key], micros(F.col(left_time)), micros(F.col(right_time)), value, F.lit(0), span, False)
    return found.select("_row.*", *[F.col("_found")[c].alias(c) for c in columns])
