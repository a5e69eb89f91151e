"""Orbit element sets: valid records, newest per satellite, lookup by event time, health."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seaglint.functions.clock import micros
from seaglint.functions import orbit
from seaglint.operators.asof import asof_latest


def valid_tles(sets: DataFrame) -> DataFrame:
    """Sets with both lines of the right kind and with name and number."""
    ok = orbit.lines_ok(F.col("tle1"), F.col("tle2")) & F.col("norad_id").isNotNull() & F.col("name").isNotNull()
    return sets.where(ok)


def latest_tle(sets: DataFrame, as_of: str) -> DataFrame:
    """One set per satellite: fresh before stale, satnogs before celestrak, then newest."""
    fresh = orbit.tle_is_fresh(F.col("updated_at"), F.to_timestamp(F.lit(as_of)))
    place = F.when(F.col("source") == "satnogs", 2).when(F.col("source") == "celestrak", 1).otherwise(0)
    marked = sets.withColumn("fresh", fresh)
    order = F.struct(
        F.col("fresh").cast("int").alias("a"),
        F.when(F.col("fresh"), place).otherwise(0).alias("b"),
        micros("updated_at").alias("c"),
        place.alias("d"),
        F.col("tle1").alias("e"),
    )
    others = [c for c in marked.columns if c != "norad_id"]
    best = marked.groupBy("norad_id").agg(F.max_by(F.struct(*others), order).alias("r"))
    return best.select("norad_id", "r.*")


def satellite_asof(events: DataFrame, sets: DataFrame) -> DataFrame:
    """Newest element set at or before each event, by satellite number."""
    return asof_latest(
        events, sets, key="norad_id", left_time="ts", right_time="updated_at",
        right_cols=["source", "tle1", "tle2"], tie="source",
    )


def health_counts(sets: DataFrame, as_of: str) -> DataFrame:
    fresh = orbit.tle_is_fresh(F.col("updated_at"), F.to_timestamp(F.lit(as_of)))
    return sets.agg(F.count("*").alias("cached"), F.count_if(fresh).alias("fresh"))
