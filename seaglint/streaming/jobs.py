"""Continuous monitoring: landed events to checked, de-duplicated, counted tables."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from seaglint.functions import geo
from seaglint.functions.orbit import lines_ok as valid_lines
from seaglint.operators.events import enrich_zone, validate_events
from seaglint.operators.ranking import newest_per_key
from seaglint.operators.spatial import reach_degrees
from seaglint import config as C
from seaglint.schemas import DETECTION_EVENT
from seaglint.session import shared_folder
from seaglint.sources.event_store import KeyedStore


def work_folder(spark: SparkSession, name: str) -> str:
    """New folder under the cluster's shared one; a local one only in local mode, where none is set."""
    return f"{shared_folder(spark)}/seaglint-{name}-{uuid.uuid4().hex}"


def stream_checked(spark: SparkSession, landing: str, max_files: int = 1000) -> tuple[DataFrame, DataFrame]:
    """Streams of valid events with their zone, and of rejected ones with their reasons, from landed JSON files."""
    raw = spark.readStream.schema(DETECTION_EVENT).option("maxFilesPerTrigger", max_files).json(landing)
    valid, rejected = validate_events(raw)
    return enrich_zone(valid), rejected


def stream_events(spark: SparkSession, landing: str, max_files: int = 1000) -> DataFrame:
    """The valid events of ``stream_checked``."""
    return stream_checked(spark, landing, max_files)[0]


def run_to_end(writer, checkpoint: str) -> None:
    """Process everything that is available, then stop."""
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def appender(store: KeyedStore, checkpoint: str):
    """Writes batches under the stream's own run: batch numbers of another checkpoint are others."""
    run = hashlib.md5(checkpoint.encode()).hexdigest()
    return lambda rows, batch_id: store.append(rows, batch_id, run)


def stream_upsert(events: DataFrame, store: KeyedStore, checkpoint: str) -> None:
    """Last write per key across batches; a repeated batch of the same stream overwrites itself."""
    run_to_end(events.writeStream.foreachBatch(appender(store, checkpoint)), checkpoint)


def stream_stats(events: DataFrame, delay: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Counts per five-minute window, zone and priority."""
    return (
        events.withWatermark("timestamp", delay)
        .groupBy(F.window("timestamp", width).alias("w"), "zone", "priority_level")
        .agg(F.count("*").alias("n"))
        .select(F.col("w.start").alias("window_start"), "zone", "priority_level", "n")
    )


def run_stats(stats: DataFrame, root: str, checkpoint: str) -> KeyedStore:
    """Write changed counts per batch; the store's current rows are the final counts."""
    store = KeyedStore(root, ["window_start", "zone", "priority_level"], "n")
    run_to_end(stats.writeStream.outputMode("update").foreachBatch(appender(store, checkpoint)), checkpoint)
    return store


def stream_dedupe(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """First event per id inside the watermark."""
    return events.withWatermark("timestamp", delay).dropDuplicatesWithinWatermark(["event_id"])


def stream_dark_match(
    detections: DataFrame, positions: DataFrame, radius_m: float = 500.0, window_s: int = 1800, delay: str = "10 minutes"
) -> DataFrame:
    """Stream of (det_id, det_ts, n_near, dark): each detection once no position near it can come any more.

    A detection is listed under the grid cells that its reach touches, a position under its one cell, so a
    pair meets once. The outer join gives a listed detection without partner when the watermark has passed
    its window; the counts by detection follow when all its listings are through. Watermarks free the state
    of both. Rows that come later than ``delay`` are dropped. A heartbeat (a row far away with a later time)
    on both sides moves the watermark where no data follows.
    """
    cell = max(radius_m / C.METRES_PER_DEGREE * 2.0, 0.001)
    dlat, dlon = reach_degrees(F.col("lat"), radius_m)

    def steps(v, d):
        return F.explode(F.sequence(geo.cell_of(v - d, cell), geo.cell_of(v + d, cell)))

    d = (
        detections.select("det_id", F.col("ts").alias("det_ts"), "lat", "lon")
        .withWatermark("det_ts", delay)
        .withColumn("dcy", steps(F.col("lat"), dlat))
        .withColumn("dcx", steps(F.col("lon"), dlon))
    )
    p = positions.select(
        F.col("ts").alias("pos_ts"),
        F.col("lat").alias("plat"),
        F.col("lon").alias("plon"),
        geo.cell_of(F.col("lat"), cell).alias("pcy"),
        geo.cell_of(F.col("lon"), cell).alias("pcx"),
    ).withWatermark("pos_ts", delay)
    span = F.expr(f"interval {window_s} seconds")
    near = (
        (F.col("dcy") == F.col("pcy"))
        & (F.col("dcx") == F.col("pcx"))
        & F.col("pos_ts").between(F.col("det_ts") - span, F.col("det_ts") + span)
        & (geo.haversine_m(F.col("lat"), F.col("lon"), F.col("plat"), F.col("plon")) <= radius_m)
    )
    pairs = d.join(p, near, "left_outer")
    counted = pairs.groupBy("det_id", "det_ts").agg(F.count("pos_ts").alias("n_near"))
    return counted.withColumn("dark", F.col("n_near") == 0)


def run_dark_match(detections: DataFrame, positions: DataFrame, root: str, **reach) -> DataFrame:
    """The rows of ``stream_dark_match`` up to the end of the available data, from its files in ``root``."""
    found = stream_dark_match(detections, positions, **reach)
    writer = found.writeStream.outputMode("append").format("parquet").option("path", f"{root}/out")
    run_to_end(writer, f"{root}/state")
    return detections.sparkSession.read.schema(found.schema).parquet(f"{root}/out")


TLE_CHANGE = "norad_id bigint, at timestamp, status string, source string, tle1 string, tle2 string, updated_at timestamp"
_TLE_STATE = "updated_us bigint, source string, tle1 string, tle2 string, stale boolean"
TTL_US = C.TLE_TTL_HOURS * 3600 * 1_000_000


def _tle_changes(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """What happens to the set of one satellite: fresh when a newer set comes, stale when its time is over."""
    held = dict(zip(("us", "source", "tle1", "tle2", "stale"), state.get)) if state.exists else None
    out = []

    def told(at_us: int, status: str) -> None:
        stamps = (pd.Timestamp(us, unit="us") for us in (at_us, held["us"]))
        at, updated = stamps
        out.append((key[0], at, status, held["source"], held["tle1"], held["tle2"], updated))

    def expired(by_us: int) -> bool:
        return held is not None and not held["stale"] and by_us - held["us"] >= TTL_US

    if state.hasTimedOut:
        told(held["us"] + TTL_US, "stale")
        held["stale"] = True
    else:
        new = pd.concat(list(batches)).sort_values(["updated_us", "source", "tle1"], ascending=[True, False, True])
        for r in new.itertuples(index=False):
            if expired(r.updated_us):
                told(held["us"] + TTL_US, "stale")
                held["stale"] = True
            if r.ok and (held is None or (r.updated_us, r.source) > (held["us"], held["source"])):
                held = {"us": r.updated_us, "source": r.source, "tle1": r.tle1, "tle2": r.tle2, "stale": False}
                told(r.updated_us, "fresh")
    if held is not None:
        state.update((held["us"], held["source"], held["tle1"], held["tle2"], held["stale"]))
        if not held["stale"]:
            state.setTimeoutTimestamp(max((held["us"] + TTL_US) // 1000, state.getCurrentWatermarkMs() + 1))
    if out:
        yield pd.DataFrame(out, columns=[c.split()[0] for c in TLE_CHANGE.split(", ")])


def stream_tle_state(replies: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Stream of changes of the set of each satellite: ``fresh`` or ``stale`` at a time.

    ``replies`` are what the sources gave: norad_id, source, tle1, tle2, updated_at. A reply whose lines are
    no element set is a failed fetch and changes nothing. A set is fresh for its time to live; then it goes
    on as stale, until a newer one comes. The keyed state holds one set for each satellite, with an event-time
    timer at its end; a reply that comes after that end tells of it too, whichever is first. Replies later
    than ``delay`` are dropped.
    """
    ok = valid_lines(F.col("tle1"), F.col("tle2"))
    slim = replies.withWatermark("updated_at", delay).select(
        "norad_id", "updated_at", F.unix_micros("updated_at").alias("updated_us"), "source", "tle1", "tle2", ok.alias("ok")
    )
    return slim.groupBy("norad_id").applyInPandasWithState(_tle_changes, TLE_CHANGE, _TLE_STATE, "append", GroupStateTimeout.EventTimeTimeout)


def run_tle_state(replies: DataFrame, root: str) -> DataFrame:
    """All changes up to the end of the available data, from the stream's files in ``root``."""
    changes = stream_tle_state(replies)
    run_to_end(changes.writeStream.outputMode("append").format("parquet").option("path", f"{root}/out"), f"{root}/state")
    return replies.sparkSession.read.schema(changes.schema).parquet(f"{root}/out")


def current_tle(changes: DataFrame) -> DataFrame:
    """The set of each satellite after its last change; a stale one is still returned, with its status."""
    return newest_per_key(changes, ["norad_id"], F.struct("at", "status"))


def stream_latest_tle(sets: DataFrame, root: str, checkpoint: str) -> KeyedStore:
    """Newest element set per satellite; each batch is reduced before it is written."""
    store = KeyedStore(root, ["norad_id"], "updated_at")
    append = appender(store, checkpoint)

    def batch(rows: DataFrame, batch_id: int) -> None:
        newest = rows.groupBy("norad_id").agg(
            F.max_by(F.struct("tle1", "tle2", "source", "updated_at"), F.struct("updated_at", "source")).alias("r")
        )
        append(newest.select("norad_id", "r.*"), batch_id)

    run_to_end(sets.writeStream.foreachBatch(batch), checkpoint)
    return store
