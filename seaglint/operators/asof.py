"""Newest earlier row per key (as-of join) without pairing rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seaglint.functions.clock import micros


def asof_latest(
    left: DataFrame,
    right: DataFrame,
    *,
    key: str,
    left_time: str,
    right_time: str,
    right_cols: list[str],
    tie: str,
    slice_s: int = 86_400,
) -> DataFrame:
    """Left rows plus the right row with the newest time at or before ``left_time``.

    Both sides are stacked and the last right row is carried forward inside (key, time slice),
    so one busy key spreads over its slices. A slice with no right row before the event takes the
    newest one of the earlier slices from a table with one row per key and slice. ``tie`` orders
    right rows of equal time (greatest wins).
    """
    payload = F.struct(F.col(right_time).alias(right_time), *[F.col(c) for c in right_cols])
    step = F.lit(slice_s * 1_000_000)
    lcols = left.columns
    stacked = left.select(
        F.col(key).alias("_k"),
        micros(F.col(left_time)).alias("_t"),
        F.lit(1).alias("_side"),
        F.lit(None).cast("string").alias("_tie"),
        F.struct(*lcols).alias("_left"),
    ).unionByName(
        right.select(
            F.col(key).alias("_k"),
            micros(F.col(right_time)).alias("_t"),
            F.lit(0).alias("_side"),
            F.col(tie).cast("string").alias("_tie"),
            payload.alias("_right"),
        ),
        allowMissingColumns=True,
    )
    carry = F.last("_right", ignorenulls=True)
    stacked = stacked.withColumn("_slice", F.floor(F.col("_t") / step))
    w = Window.partitionBy("_k", "_slice").orderBy("_t", "_side", "_tie")
    per_slice = stacked.groupBy("_k", "_slice").agg(
        F.max_by("_right", F.when(F.col("_side") == 0, F.struct("_t", "_tie"))).alias("_newest")
    )
    earlier = Window.partitionBy("_k").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    per_slice = per_slice.select(
        F.col("_k").alias("_pk"),
        F.col("_slice").alias("_ps"),
        F.last("_newest", ignorenulls=True).over(earlier).alias("_before"),
    )
    out = (
        stacked.withColumn("_hit", carry.over(w))
        .where("_side = 1")
        .join(per_slice, F.col("_k").eqNullSafe(F.col("_pk")) & F.col("_slice").eqNullSafe(F.col("_ps")))
        .withColumn("_hit", F.coalesce("_hit", "_before"))
    )
    return out.select("_left.*", *[F.col("_hit")[c].alias(c) for c in (right_time, *right_cols)])
