"""Detection events: checks, zone, priority, upsert, filters and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seaglint import config as C
from seaglint.functions import geo
from seaglint.operators import ais, orbits
from seaglint.operators.ranking import newest_per_key, numbered
from seaglint.schemas import BOX


def decode_detections(text: Column) -> Column:
    """JSON text to an array of boxes; broken text becomes an empty list."""
    return F.coalesce(F.from_json(text, f"array<{BOX.simpleString()}>"), F.array().cast(f"array<{BOX.simpleString()}>"))


def validation_reasons(df: DataFrame) -> Column:
    """Names of the schema rules a row breaks, as an array."""
    rules = {
        "bbox_length": F.coalesce(F.size("tile_bbox_latlon") != 4, F.lit(True)),
        "vessel_count": F.coalesce(F.col("vessel_count") < 0, F.lit(True)),
        "dark_vessel_count": F.coalesce(F.col("dark_vessel_count") < 0, F.lit(True)),
        "processing_time_ms": F.coalesce(F.col("processing_time_ms") < 0, F.lit(True)),
        "confidence": F.exists(
            F.coalesce("detections", F.array().cast(f"array<{BOX.simpleString()}>")),
            lambda b: ~F.coalesce(b["confidence"].between(0, 1), F.lit(False)),
        ),
    }
    return F.array_compact(F.array(*[F.when(bad, F.lit(n)) for n, bad in rules.items()]))


def validate_events(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantined rows with ``reasons``)."""
    checked = df.withColumn("reasons", validation_reasons(df))
    return (
        checked.where(F.size("reasons") == 0).drop("reasons"),
        checked.where(F.size("reasons") > 0),
    )


def enrich_zone(df: DataFrame, bbox: str = "tile_bbox_latlon") -> DataFrame:
    """Fill the zone only where it is missing or empty."""
    empty = F.col("zone").isNull() | (F.col("zone") == "")
    return df.withColumn("zone", F.when(empty, geo.zone_of_array(F.col(bbox))).otherwise(F.col("zone")))


def with_priority(df: DataFrame) -> DataFrame:
    return df.withColumn("priority_level", geo.priority_level(F.col("vessel_count")))


def upsert_events(stored: DataFrame | None, arrived: DataFrame, arrival: str = "arrival") -> DataFrame:
    """Last write per event_id wins, over stored and newly arrived rows together."""
    rows = arrived if stored is None else stored.unionByName(arrived, allowMissingColumns=True)
    return newest_per_key(rows, ["event_id"], F.col(arrival))


def filter_events(
    df: DataFrame, since: str | None = None, zone: str | None = None, priority: str | None = None
) -> DataFrame:
    """Given conditions joined by AND. Times compare as timestamps, not as text."""
    if since:
        df = df.where(F.col("timestamp") >= F.to_timestamp(F.lit(since)))
    if zone:
        df = df.where(F.col("zone") == zone)
    if priority:
        df = df.where(F.col("priority_level") == priority)
    return df


def filter_events_bbox(df: DataFrame, bbox: tuple[float, float, float, float]) -> DataFrame:
    """Events whose tile centre lies in (lon_min, lat_min, lon_max, lat_max)."""
    lon = (F.col("lon_min") + F.col("lon_max")) / 2.0
    lat = (F.col("lat_min") + F.col("lat_max")) / 2.0
    return df.where(lon.between(bbox[0], bbox[2]) & lat.between(bbox[1], bbox[3]))


def recent_events(df: DataFrame, limit: int = C.EVENT_LIST_CAP) -> DataFrame:
    return df.orderBy(F.desc("timestamp"), "event_id").limit(limit)


def stats_by_zone_priority(df: DataFrame) -> DataFrame:
    """Counts by zone and counts by priority in one pass."""
    from pyspark.sql.functions import grouping

    return (
        df.groupingSets([["zone"], ["priority_level"]], "zone", "priority_level")
        .agg(
            F.when(grouping("zone") == 0, "zone").otherwise("priority").alias("kind"),
            F.count("*").alias("n"),
        )
        .select(
            "kind",
            F.coalesce(F.when(F.col("kind") == "zone", F.col("zone")).otherwise(F.col("priority_level")), F.lit("")).alias("name"),
            "n",
        )
    )


def event_table_view(df: DataFrame, limit: int = 100) -> DataFrame:
    """Short display rows, newest first."""
    return recent_events(df, limit).select(
        F.concat(F.substring("event_id", 1, 8), F.lit("...")).alias("event"),
        "zone",
        F.col("priority_level").alias("priority"),
        F.col("vessel_count").alias("vessels"),
        F.col("dark_vessel_count").alias("dark"),
        F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss").alias("time"),
    )


def running_event_counts(df: DataFrame) -> DataFrame:
    """Events so far per zone in time order."""
    return numbered(df, ["zone"], ["timestamp", "event_id"], "running_count")


def events_from_boxes(boxes: DataFrame, tiles: DataFrame, code: str) -> DataFrame:
    """One event per tile from its kept boxes; tiles without boxes give an empty event.

    ``boxes`` must be after suppression: kept boxes hardly overlap, which bounds the list a tile
    can hold.
    """
    per_tile = boxes.groupBy("tile_id").agg(
        F.sort_array(
            F.collect_list(F.struct(F.col("rank"), "x1", "y1", "x2", "y2", "confidence"))
        ).alias("_d"),
        F.count("*").alias("_n"),
    )
    out = tiles.join(per_tile, "tile_id", "left")
    count = F.coalesce(F.col("_n"), F.lit(0)).cast("int")
    boxes_only = F.transform(F.col("_d"), lambda d: d.dropFields("rank"))
    return (
        out.withColumn("detections", F.coalesce(boxes_only, F.array().cast(f"array<{BOX.simpleString()}>")))
        .withColumn("vessel_count", count)
        .withColumn("scene_id", F.coalesce("scene_id", F.lit("unknown")))
        .withColumn("priority_level", geo.priority_level(count))
        .withColumn("preprocessing_pipeline", F.lit(code))
        .drop("_d", "_n")
    )


def box_centres(boxes: DataFrame, tiles: DataFrame, size: int = C.TILE_SIZE) -> DataFrame:
    """det_id, tile_id, ts, lat and lon of the middle of each box, from the box of its tile."""
    x, y = (F.col("x1") + F.col("x2")) / (2.0 * size), (F.col("y1") + F.col("y2")) / (2.0 * size)
    # The middle is computed first, so that a join by shuffle moves two numbers and not four.
    middle = boxes.select(F.col("box_id").alias("det_id"), "tile_id", x.alias("_x"), y.alias("_y"))
    placed = middle.join(tiles.select("tile_id", "timestamp", "lat_min", "lon_min", "lat_max", "lon_max"), "tile_id")
    return placed.select(
        "det_id", "tile_id", F.col("timestamp").alias("ts"),
        (F.col("lat_max") - F.col("_y") * (F.col("lat_max") - F.col("lat_min"))).alias("lat"),
        (F.col("lon_min") + F.col("_x") * (F.col("lon_max") - F.col("lon_min"))).alias("lon"),
    )


def full_events(
    boxes: DataFrame, tiles: DataFrame, positions: DataFrame, sets: DataFrame, code: str, size: int = C.TILE_SIZE, radius_m: float = 500.0, window_s: int = 1800
) -> DataFrame:
    """Detection events with all fields of ``schemas.DETECTION_EVENT`` but the satellite's place and the run time.

    ``boxes``: kept boxes (tile_id, box_id, rank, corners, confidence). ``tiles``: tile_id, scene_id,
    timestamp, norad_id and the geographic box. A detection is dark if no position is near it in space and
    time; the satellite is the newest element set before the acquisition. The event id comes from tile, code
    and time, so a repeated run gives the same events.
    """
    dark = ais.dark_detections(box_centres(boxes, tiles, size), positions, radius_m=radius_m, window_s=window_s)
    n_dark = dark.groupBy("tile_id").agg(F.count("*").cast("int").alias("_dark"))
    corners = [F.col(c) for c in ("lat_min", "lon_min", "lat_max", "lon_max")]
    known = orbits.satellite_asof(tiles.select("tile_id", "norad_id", F.col("timestamp").alias("ts")), sets).select("tile_id", F.when(F.col("tle1").isNotNull(), F.col("norad_id").cast("string")).alias("satellite_id"))
    out = events_from_boxes(boxes, tiles, code).join(n_dark, "tile_id", "left").join(known, "tile_id", "left")
    digest = F.md5(F.concat_ws("|", "tile_id", F.lit(code), F.unix_micros("timestamp").cast("string")))
    part = lambda at, n: F.substring(digest, at, n)
    return out.select(
        F.concat_ws("-", part(1, 8), part(9, 4), part(13, 4), part(17, 4), part(21, 12)).alias("event_id"),
        "scene_id", "timestamp", "tile_id", F.array(*corners).alias("tile_bbox_latlon"), "detections", "vessel_count",
        F.coalesce("_dark", F.lit(0)).alias("dark_vessel_count"), "priority_level", geo.zone_of(*corners).alias("zone"),
        "satellite_id", "preprocessing_pipeline",
    )


def event_defaults(df: DataFrame) -> DataFrame:
    """Fill what a caller left out: scene, tile and event ids, box and zone."""
    return (
        df.withColumn("scene_id", F.coalesce("scene_id", F.lit("unknown")))
        .withColumn("tile_id", F.coalesce("tile_id", F.uuid()))
        .withColumn("event_id", F.coalesce("event_id", F.uuid()))
        .withColumn("tile_bbox_latlon", F.coalesce("tile_bbox_latlon", F.array(*[F.lit(0.0)] * 4)))
        .withColumn("zone", F.coalesce("zone", F.lit("Z3")))
    )
