"""Streams run to the end of the available data; the final state is returned."""

from pyspark.sql import functions as F

from seaglint import config as C
from seaglint.functions import geo
from seaglint.plans.filter_queries import STORED
from seaglint.plans.registry import query
from seaglint.plans.views import Tables
from seaglint.schemas import BOX
from seaglint.sources.event_store import KeyedStore
from seaglint.streaming import jobs


def _stream(t: Tables, name: str, split: str | None = None, per_batch: int = 1):
    """Stream over one given table; with ``split``, over a few range-cut files of it.

    Files arrive in no special order, so a query with a short watermark takes them in one batch.
    """
    spark = t.spark
    if split is None:
        table = t.base(name)
        folder, glob = t.folder, f"{name}.parquet"
    else:
        table = t.sql(f"select * from {name}")
        folder, glob = f"{jobs.work_folder(spark, 'landing')}/{name}", "*.parquet"
        table.repartitionByRange(4, split).write.mode("overwrite").parquet(folder)
    return (
        spark.readStream.schema(table.schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", per_batch).parquet(folder)
    )


def _event_stream(t, split="arrival"):
    zone = geo.zone_of(*map(F.col, ("lat_min", "lon_min", "lat_max", "lon_max")))
    s = _stream(t, "v_events", split).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    return s.withColumn("zone", zone).withColumn("priority_level", geo.priority_level(F.col("vessel_count")))


@query("stream_upsert", f"select event_id, arrival, zone, priority_level from ({STORED}) s")
def stream_upsert(t):
    work = jobs.work_folder(t.spark, "upsert")
    store = KeyedStore(f"{work}/store", ["event_id"], "arrival")
    jobs.stream_upsert(_event_stream(t), store, f"{work}/state")
    return store.current(t.spark).select("event_id", "arrival", "zone", "priority_level")


_ZONED = STORED.replace("where rn = 1", "")


#: Events of the first week that land last, when the watermark has long passed them.
LATE = "(arrival % 97 = 5 and timestamp < (select min(ts) from events) + interval '7' day)"


def _in_order(t):
    """Stream of the events that lands week by week, one file a batch, with the late ones at the end."""
    folder = f"{jobs.work_folder(t.spark, 'landing')}/events"
    weeks = [f"not {LATE} and timestamp >= (select min(ts) from events) + interval '{7 * k}' day and timestamp < (select min(ts) from events) + interval '{7 * k + 7 if k < 4 else 9999}' day" for k in range(5)]
    for part in (*weeks, LATE):
        t.sql(f"select * from v_events where {part}").coalesce(1).write.mode("append").parquet(folder)
    schema = t.v_events.schema
    s = t.spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    zone = geo.zone_of(*map(F.col, ("lat_min", "lon_min", "lat_max", "lon_max")))
    s = s.withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    return s.withColumn("zone", zone).withColumn("priority_level", geo.priority_level(F.col("vessel_count")))


@query(
    "stream_stats",
    f"select strftime(time_bucket(interval 5 minute, timestamp), '%Y-%m-%d %H:%M') as window_start, zone, priority_level, count(*) as n from ({_ZONED}) s where not {LATE} group by 1, 2, 3",
)
def stream_stats(t):
    """Counts with a watermark of ten minutes: rows of the first week that land at the end are too late."""
    work = jobs.work_folder(t.spark, "stats")
    stats = jobs.stream_stats(_in_order(t))
    out = jobs.run_stats(stats, f"{work}/store", f"{work}/state").current(t.spark)
    return out.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm"))


def _landed(t, name, parts, heartbeats):
    """Stream over files that land one after another, one a batch: the given parts of a view, then heartbeats."""
    folder = f"{jobs.work_folder(t.spark, 'landing')}/{name}"
    for part in parts:
        t.sql(part).coalesce(1).write.mode("append").parquet(folder)
    for beat in heartbeats:
        t.sql(beat).coalesce(1).write.mode("append").parquet(folder)
    schema = t.spark.read.parquet(folder).schema
    return t.spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


#: Events that are sent again: every third after 20 minutes, every fifth once more after 16 days.
SENT = """(select arrival, timestamp, 0 as again from v_events union all select arrival, timestamp + interval '20' minute, 1 from v_events where arrival % 3 = 0
  union all select arrival, timestamp + interval '16' day, 2 from v_events where arrival % 5 = 0)"""


@query("stream_dedupe", f"select arrival from {SENT} s where again <> 1")
def stream_dedupe(t):
    """Weeks land in order. What comes again within the hour goes; after 16 days the state knows nothing any more."""
    work = jobs.work_folder(t.spark, "dedupe")
    first = "(select min(ts) from events)"
    parts = [f"select * from {SENT} s where timestamp >= {first} + interval '{7 * k}' day and timestamp < {first} + interval '{7 * k + 7 if k < 7 else 9999}' day" for k in range(8)]
    sent = _landed(t, "sent", parts, []).select(F.col("arrival").cast("string").alias("event_id"), F.col("timestamp").cast("timestamp").alias("timestamp"))
    once = jobs.stream_dedupe(sent)
    jobs.run_to_end(once.writeStream.outputMode("append").format("parquet").option("path", f"{work}/out"), f"{work}/state")
    return t.spark.read.parquet(f"{work}/out").select(F.col("event_id").cast("bigint").alias("arrival"))


@query(
    "stream_events",
    f"select event_id, case when arrival % 50 = 7 then null else zone end as zone, vessel_count, case when arrival % 50 = 7 then 'processing_time_ms' end as reasons from ({_ZONED}) s",
)
def stream_events(t):
    """Landed JSON events, checked and zoned; each fiftieth has an impossible time and lands in the quarantine."""
    work = jobs.work_folder(t.spark, "events")
    box = F.struct(*[F.lit(0.5).alias(n) for n in BOX.fieldNames()])
    landed = t.v_events.select(
        "event_id", "scene_id", "timestamp", F.lit("t").alias("tile_id"),
        F.array("lat_min", "lon_min", "lat_max", "lon_max").alias("tile_bbox_latlon"),
        F.array(box).alias("detections"), "vessel_count", "dark_vessel_count",
        F.lit("").alias("zone"), F.lit("D").alias("preprocessing_pipeline"),
        F.when(F.col("arrival") % 50 == 7, -1.0).otherwise(F.abs("processing_time_ms")).alias("processing_time_ms"),
    )
    landed.write.mode("overwrite").json(f"{work}/landing")
    valid, rejected = jobs.stream_checked(t.spark, f"{work}/landing")
    parts = {"valid": valid.select("event_id", "zone", "vessel_count", F.lit(None).cast("string").alias("reasons"))}
    parts["rejected"] = rejected.select("event_id", F.lit(None).cast("string").alias("zone"), "vessel_count", F.array_join("reasons", ",").alias("reasons"))
    for name, rows in parts.items():
        jobs.run_to_end(rows.writeStream.outputMode("append").format("parquet").option("path", f"{work}/{name}"), f"{work}/state-{name}")
    return t.spark.read.parquet(f"{work}/valid", f"{work}/rejected")


#: Positions of the first ten days that land last, when the watermark has long passed them.
LATE_AIS = "(pos_id % 89 = 5 and ts < (select min(ts) from events) + interval '10' day)"
IN_TIME = f"(select * from v_ais where not {LATE_AIS})"

NEAR = f"""select d.pos_id as det_id, count(*) as n_near from (select pos_id, ts, lat + (mmsi % 7) * 0.002e0 as lat, lon from {IN_TIME} a) d
  join (select ts, lat, lon from {IN_TIME} b where source = 'ais_presence_amorce') p
  on p.ts between d.ts - interval 30 minute and d.ts + interval 30 minute and abs(p.lat - d.lat) < 0.01 and abs(p.lon - d.lon) < 0.01
  and 2 * 6371000e0 * asin(least(1e0, sqrt(power(sin(radians(p.lat - d.lat) / 2), 2) + cos(radians(d.lat)) * cos(radians(p.lat)) * power(sin(radians(p.lon - d.lon) / 2), 2)))) <= 500e0
  group by 1"""


@query("stream_dark_match", f"select pos_id as det_id, coalesce(n_near, 0) as n_near, coalesce(n_near, 0) = 0 as dark from {IN_TIME} v left join ({NEAR}) n on n.det_id = pos_id")
def stream_dark_match(t):
    """Positions land in three slices of time, then some late ones, then heartbeats that let the last detections go."""
    work = jobs.work_folder(t.spark, "dark")
    first = "(select min(ts) from events)"
    slices = [f"not {LATE_AIS} and ts >= {first} + interval '{10 * k}' day and ts < {first} + interval '{10 * k + 10 if k < 2 else 9999}' day" for k in range(3)]
    columns = "pos_id, ts, lat, lon, mmsi, source"
    parts = [f"select {columns} from v_ais where {w}" for w in (*slices, LATE_AIS)]
    beats = [f"select cast(-{k} as bigint) as pos_id, max(ts) + interval '{k}' day as ts, -80e0 as lat, 0e0 as lon, cast(0 as bigint) as mmsi, '{C.SEED_SOURCE}' as source from v_ais" for k in (1, 2)]
    ais = _landed(t, "ais", parts, beats).withColumn("ts", F.col("ts").cast("timestamp"))
    seen = ais.where(F.col("source") == C.SEED_SOURCE).select("ts", "lat", "lon")
    det = ais.select(F.col("pos_id").alias("det_id"), "ts", (F.col("lat") + (F.col("mmsi") % 7) * 0.002).alias("lat"), "lon")
    return jobs.run_dark_match(det, seen, work).where("det_id >= 0").select("det_id", "n_near", "dark")


#: Replies of the sources: one satellite after another, an hour apart; a bad one is a failed fetch.
REPLIES = "select norad_id, source, tle1, tle2, timestamp '2024-01-01 00:00:00' + cast(substr(tle1, 10) as int) * interval '1' hour as updated_at from v_tle"


@query(
    "stream_tle_state",
    f"""select norad_id, strftime(updated_at, '%Y-%m-%d %H:%M') as at, 'fresh' as status, tle1 from ({REPLIES}) r where tle2 like '2 %'
    union all select norad_id, strftime(updated_at + interval 24 hour, '%Y-%m-%d %H:%M'), 'stale', tle1 from (select *, lead(updated_at) over (partition by norad_id order by updated_at) as after from ({REPLIES}) r where tle2 like '2 %') z where after is null or after - updated_at >= interval 24 hour""",
)
def stream_tle_state(t):
    """Each satellite is asked for every 20 hours; a failed fetch lets its set go stale until the next reply."""
    work = jobs.work_folder(t.spark, "tle-state")
    hours = "cast(substr(tle1, 10) as int)"
    part = "floor({} * 3 / (select count(*) + 1 from supplier))"
    parts = [f"select * from ({REPLIES.replace('from v_tle', f'from v_tle where {part.format(hours)} = {k}')}) r" for k in range(3)]
    beats = [f"select cast(0 as bigint) as norad_id, '' as source, '' as tle1, '' as tle2, max(updated_at) + interval '{k}' day as updated_at from ({REPLIES}) r" for k in (3, 4)]
    replies = _landed(t, "tle", parts, beats).withColumn("updated_at", F.col("updated_at").cast("timestamp"))
    out = jobs.run_tle_state(replies, work)
    return out.select("norad_id", F.date_format("at", "yyyy-MM-dd HH:mm").alias("at"), "status", "tle1")


@query(
    "stream_latest_tle",
    "select norad_id, source, tle1 from (select *, row_number() over (partition by norad_id order by updated_at desc, source desc) as rn from v_tle) z where rn = 1",
)
def stream_latest_tle(t):
    work = jobs.work_folder(t.spark, "tle")
    sets = _stream(t, "v_tle", "updated_at").withColumn("updated_at", F.col("updated_at").cast("timestamp"))
    store = jobs.stream_latest_tle(sets, f"{work}/store", f"{work}/state")
    return store.current(t.spark).select("norad_id", "source", "tle1")
