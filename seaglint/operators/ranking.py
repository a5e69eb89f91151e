"""Numbering, top-k and newest-per-key that hold when one key has a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seaglint.session import ensure_checkpoint_dir

def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


#: Rows of a group up to which a task numbers it alone.
CROWDED_ROWS = 500_000


def numbered(df: DataFrame, by: list, order: list, name: str = "rn") -> DataFrame:
    """Add a 1-based row number per group.

    Groups are counted first (a job when the plan is built). Those of up to ``CROWDED_ROWS`` rows go to one task
    each, so their rows are shuffled once and nothing is written; larger ones are cut into slices, so a group may
    have any share of all rows. ``order`` must be ascending and end in a unique column.
    """
    by_cols, order_cols = [_col(c) for c in by], [_col(c) for c in order]
    if not by:
        return _numbered_by_slices(df, by_cols, order_cols, name)
    groups = [f"_of{i}" for i in range(len(by_cols))]
    ensure_checkpoint_dir(df.sparkSession)
    sizes = df.groupBy(*[c.alias(g) for c, g in zip(by_cols, groups)]).agg(F.count("*").alias("_size"))
    crowded = sizes.where(F.col("_size") > CROWDED_ROWS).select(*groups).checkpoint()
    number = F.row_number().over(Window.partitionBy(*by_cols).orderBy(*order_cols))
    if crowded.isEmpty():
        return df.withColumn(name, number.cast("long"))
    same = F.lit(True)
    for c, g in zip(by_cols, groups):
        same = same & c.eqNullSafe(F.col(g))
    calm = df.join(crowded, same, "left_anti").withColumn(name, number.cast("long"))
    return calm.unionByName(_numbered_by_slices(df.join(crowded, same, "left_semi"), by_cols, order_cols, name))


def _numbered_by_slices(df: DataFrame, by_cols: list[Column], order_cols: list[Column], name: str) -> DataFrame:
    """``numbered`` for groups of any size.

    The rows are cut into slices of the global order (group, then ``order``), each slice is numbered
    by its own task, and the rows that earlier slices have of the group are added. Slices follow the
    data's size. They are written to the checkpoint folder once, so that all readers see the same ones.
    """
    groups = [f"_by{i}" for i in range(len(by_cols))]
    key = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order_cols)])
    keyed = df.select("*", key.alias("_key"), *[c.alias(g) for c, g in zip(by_cols, groups)])
    ensure_checkpoint_dir(df.sparkSession)
    cut = keyed.repartitionByRange(*groups, "_key").withColumn("_slice", F.spark_partition_id()).checkpoint()
    before = Window.partitionBy(*groups).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        cut.groupBy(*groups, "_slice")
        .count()
        .withColumn("_before", F.coalesce(F.sum("count").over(before), F.lit(0)))
        .drop("count")
    )
    inside = F.row_number().over(Window.partitionBy(*groups, "_slice").orderBy("_key"))
    joined = _null_safe_join(cut.withColumn("_inside", inside), offsets, [*groups, "_slice"])
    out = joined.withColumn(name, (F.col("_before") + F.col("_inside")).cast("long"))
    return out.select(*df.columns, name)


def _null_safe_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    right = right.select(*[F.col(k).alias(f"_r{k}") for k in keys], *[c for c in right.columns if c not in keys])
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_r{k}"))
    return left.join(right, cond).drop(*[f"_r{k}" for k in keys])


def with_group_size(df: DataFrame, by: list[str], name: str = "n") -> DataFrame:
    """Add the group's row count by aggregate and join, which never holds a group in memory."""
    sizes = df.groupBy(*by).agg(F.count("*").alias(name))
    return _null_safe_join(df, sizes, by)


def top_per_group(df: DataFrame, by: list, order: list, k: int) -> DataFrame:
    """First k rows of every group; Spark cuts each map task to k rows before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")


def newest_per_key(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """Whole row with the greatest ``order`` per key, as a map-side combined aggregate."""
    others = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*others), order).alias("_row"))
    return best.select(*keys, "_row.*").select(*df.columns)


def oldest_per_key(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    others = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*others), order).alias("_row"))
    return best.select(*keys, "_row.*").select(*df.columns)
