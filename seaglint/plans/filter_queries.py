"""Filters, checks and the event table."""

from pyspark.sql import functions as F

from seaglint import config as C
from seaglint.functions import geo
from seaglint.operators import ais, catalogue, events, labels
from seaglint.plans import flows
from seaglint.plans.registry import query
from seaglint.plans.scalar_queries import DIST_SQL, ZONE_SQL
from seaglint.schemas import BOX
from seaglint.sources import layout
from seaglint.streaming.jobs import work_folder

_C_LAT, _C_LON = "((lat_min + lat_max) / 2e0)", "((lon_min + lon_max) / 2e0)"
STORED = f"""select event_id, arrival, timestamp, scene_id, lat_min, lon_min, lat_max, lon_max, vessel_count, dark_vessel_count, processing_time_ms,
  case when vessel_count >= 10 then 'CRITICAL' when vessel_count >= 5 then 'HIGH' when vessel_count >= 2 then 'MEDIUM' else 'LOW' end as priority_level,
  {ZONE_SQL} as zone
 from (select *, {DIST_SQL.format(lat=_C_LAT, lon=_C_LON)} as d, row_number() over (partition by event_id order by arrival desc) as rn from v_events) q where rn = 1"""


def stored(t):
    zone = geo.zone_of(*map(F.col, ("lat_min", "lon_min", "lat_max", "lon_max")))
    zoned = events.with_priority(t.v_events).withColumn("zone", zone)
    return events.upsert_events(None, zoned)


@query(
    "stats_by_zone_priority",
    f"""with e as ({STORED}) select 'zone' as kind, zone as name, count(*) as n from e group by zone
    union all select 'priority', priority_level, count(*) from e group by priority_level""",
)
def stats_by_zone_priority(t):
    return flows.events_to_stats(t.v_events)


@query("upsert_events", f"select event_id, arrival, zone, priority_level, scene_id, vessel_count from ({STORED}) s")
def upsert_events(t):
    return stored(t).select("event_id", "arrival", "zone", "priority_level", "scene_id", F.col("vessel_count"))


@query(
    "filter_events",
    f"select event_id, arrival from ({STORED}) s where timestamp >= timestamp '2024-01-10 12:00:00' and zone = 'Z2' and priority_level = 'HIGH'",
)
def filter_events(t):
    return events.filter_events(stored(t), "2024-01-10T12:00:00", "Z2", "HIGH").select("event_id", "arrival")


@query(
    "filter_events_bbox",
    f"select event_id, arrival from ({STORED}) s where {_C_LAT} between 28 and 33 and {_C_LON} between -15 and -9",
)
def filter_events_bbox(t):
    return events.filter_events_bbox(stored(t), (-15.0, 28.0, -9.0, 33.0)).select("event_id", "arrival")


@query(
    "clustered_events_bbox",
    f"select event_id, arrival from ({STORED}) s where {_C_LAT} between 28 and 33 and {_C_LON} between -15 and -9",
)
def clustered_events_bbox(t):
    """The stored events laid out by place, read back for one box."""
    path = f"{work_folder(t.spark, 'clustered')}/events"
    middle = [(F.col(f"{c}_min") + F.col(f"{c}_max")) / 2.0 for c in ("lat", "lon")]
    layout.write_clustered(stored(t), path, *middle)
    return layout.read_box(t.spark, path, (-15.0, 28.0, -9.0, 33.0)).select("event_id", "arrival")


@query("recent_events", f"select event_id, arrival from ({STORED}) s order by timestamp desc, event_id limit 1000")
def recent_events(t):
    return events.recent_events(stored(t)).select("event_id", "arrival")


@query(
    "event_table_view",
    f"""select concat(substr(event_id, 1, 8), '...') as event, zone, priority_level as priority, vessel_count as vessels, dark_vessel_count as dark,
    strftime(timestamp, '%Y-%m-%dT%H:%M:%S') as time from (select * from ({STORED}) s order by timestamp desc, event_id limit 100) v""",
)
def event_table_view(t):
    return events.event_table_view(stored(t))


@query(
    "running_event_counts",
    f"select event_id, zone, row_number() over (partition by zone order by timestamp, event_id) as running_count from ({STORED}) s",
)
def running_event_counts(t):
    return events.running_event_counts(stored(t)).select("event_id", "zone", F.col("running_count").cast("bigint").alias("running_count"))


LEGACY = """select box_id as event_id, tile_id, case when h > 45 then 'broken [' else concat('[{"x1":', cast(cast(w as int) as string), ',"y1":', cast(cast(h as int) as string), ',"x2":1,"y2":2,"confidence":0.5}]') end as detections from v_boxes"""


@query(
    "scan_event_table",
    "select box_id as event_id, case when h > 45 then 0 else 1 end as n_boxes, case when h > 45 then -1e0 else w end as x1 from v_boxes",
)
def scan_event_table(t):
    d = events.decode_detections(F.col("detections"))
    return t.sql(LEGACY).select(
        "event_id", F.size(d).alias("n_boxes"), F.coalesce(F.get(d, F.lit(0))["x1"], F.lit(-1.0)).alias("x1")
    )


@query(
    "validate_events",
    """select arrival, array_to_string(list_filter([case when arrival % 4 = 3 then 'bbox_length' end, case when vessel_count - 2 < 0 then 'vessel_count' end,
      case when dark_vessel_count - 1 < 0 then 'dark_vessel_count' end, case when processing_time_ms - 5e0 < 0 then 'processing_time_ms' end,
      case when processing_time_ms / 20e0 > 1 or processing_time_ms / 20e0 < 0 then 'confidence' end], lambda x: x is not null), ',') as reasons from v_events""",
)
def validate_events(t):
    box = F.struct(*[F.lit(0.0).alias(n) for n in ("x1", "y1", "x2", "y2")], (F.col("processing_time_ms") / 20.0).alias("confidence"))
    df = (
        t.v_events.withColumn("tile_bbox_latlon", F.when(F.col("arrival") % 4 == 3, F.array(F.lit(1.0))).otherwise(F.array(*[F.lit(0.0)] * 4)))
        .withColumn("detections", F.array(box).cast(f"array<{BOX.simpleString()}>"))
        .withColumn("processing_time_ms", F.col("processing_time_ms") - 5.0)
        .withColumn("vessel_count", F.col("vessel_count") - 2)
        .withColumn("dark_vessel_count", F.col("dark_vessel_count") - 1)
    )
    good, bad = events.validate_events(df)
    return good.withColumn("reasons", F.array().cast("array<string>")).unionByName(bad).select(
        "arrival", F.array_join("reasons", ",").alias("reasons")
    )


@query(
    "search_catalogue",
    """select id, name from v_products where name like '%IW_GRDH_1S%' and lon_min <= -8 and lon_max >= -12 and lat_min <= 34 and lat_max >= 30
    and date >= timestamp '1996-01-01' and date <= timestamp '1998-06-30 23:59:59' order by date desc, id limit 50""",
)
def search_catalogue(t):
    return catalogue.search_catalogue(t.v_products, (-12.0, 30.0, -8.0, 34.0), "1996-01-01", "1998-06-30", 50).select("id", "name")


@query(
    "search_catalogue_all",
    """select id, name from v_products where name like '%IW_GRDH_1S%' and lon_min <= -8 and lon_max >= -12 and lat_min <= 34 and lat_max >= 30
    and date >= timestamp '1996-01-01' and date <= timestamp '1998-06-30 23:59:59'""",
)
def search_catalogue_all(t):
    return catalogue.search_catalogue(t.v_products, (-12.0, 30.0, -8.0, 34.0), "1996-01-01", "1998-06-30").select("id", "name")


BOXES = "select o_orderkey, (o_custkey % 40) * 10e0 - 200e0 as a, (o_orderkey % 21) * 10e0 - 100e0 as b, (o_custkey % 37) * 10e0 - 180e0 as c, (o_orderkey % 19) * 10e0 - 90e0 as d from orders"


@query(
    "validate_bbox",
    f"select o_orderkey, a between -180 and 180 and c between -180 and 180 and b between -90 and 90 and d between -90 and 90 and a <= c and b <= d as valid from ({BOXES}) q",
)
def validate_bbox(t):
    return t.sql(BOXES).select("o_orderkey", geo.valid_bbox(*map(F.col, "abcd")).alias("valid"))


BBOX_TEXT = "select o_orderkey, case o_orderkey % 5 when 0 then concat(o_custkey, ',-1.5, 3 ,', o_orderkey) when 1 then '1,2,3' when 2 then '1,2,x,4' when 3 then concat('-17.0,27.0,-1.0,', o_custkey) else '' end as txt from orders"


@query(
    "parse_bbox_string",
    f"""select o_orderkey, case when ok then cast(p[1] as double) else -999e0 end as a, case when ok then cast(p[4] as double) else -999e0 end as d
    from (select o_orderkey, p, len(p) = 4 and len(list_filter(p, lambda v: try_cast(trim(v) as double) is null)) = 0 as ok from (select o_orderkey, string_split(txt, ',') as p from ({BBOX_TEXT}) q) s) z""",
)
def parse_bbox_string(t):
    b = geo.parse_bbox(F.col("txt"))
    none = F.lit(-999.0)
    return t.sql(BBOX_TEXT).select("o_orderkey", F.coalesce(b[0], none).alias("a"), F.coalesce(b[3], none).alias("d"))


@query(
    "filter_positions_bbox",
    "select pos_id from v_ais where source = 'ais_off_candidate' and lat between 28 and 34 and lon between -16 and -6 and mmsi % 9 <> 0",
)
def filter_positions_bbox(t):
    gaps = t.v_ais.where(F.col("source") == C.GAP_SOURCE).withColumn("lat", F.when(F.col("mmsi") % 9 != 0, F.col("lat")))
    return ais.filter_positions_bbox(gaps, (-16.0, 28.0, -6.0, 34.0)).select("pos_id")


@query("clustered_positions_bbox", "select pos_id from v_ais where lat between 28 and 34 and lon between -16 and -6 and mmsi % 9 <> 0")
def clustered_positions_bbox(t):
    """All positions laid out by place (some have none), read back for one box."""
    path = f"{work_folder(t.spark, 'clustered')}/positions"
    lat = F.when(F.col("mmsi") % 9 != 0, F.col("lat"))
    layout.write_clustered(t.v_ais, path, lat, F.col("lon"))
    return layout.read_box(t.spark, path, (-16.0, 28.0, -6.0, 34.0)).select("pos_id")


@query("drop_missing_coords", "select pos_id, lat, lon from v_ais where mmsi % 9 <> 0 and mmsi % 7 <> 0")
def drop_missing_coords(t):
    m = F.col("mmsi")
    holes = t.v_ais.withColumn("lat", F.when(m % 9 != 0, F.col("lat"))).withColumn("lon", F.when(m % 7 != 0, F.col("lon")))
    return ais.drop_missing_coords(holes).select("pos_id", "lat", "lon")


@query("tle_line_filter", "select norad_id, tle1 from v_tle where tle1 like '1 %' and tle2 like '2 %'")
def tle_line_filter(t):
    from seaglint.operators.orbits import valid_tles

    return valid_tles(t.v_tle).select("norad_id", "tle1")


@query("health_counts", "select count(*) as cached, count(*) filter (where timestamp '2024-01-20' - updated_at < interval 24 hour) as fresh from v_tle")
def health_counts(t):
    from seaglint.operators.orbits import health_counts as op

    return op(t.v_tle, "2024-01-20")


@query(
    "latest_tle",
    """select norad_id, tle1, source from (select *, row_number() over (partition by norad_id order by fresh desc, case when fresh then p else 0 end desc, updated_at desc, p desc, tle1 desc) as rn
    from (select *, timestamp '2024-01-29' - updated_at < interval 24 hour as fresh, case source when 'satnogs' then 2 else 1 end as p from v_tle where tle2 like '2 %') q) z where rn = 1""",
)
def latest_tle(t):
    from seaglint.operators.orbits import latest_tle as op, valid_tles

    return op(valid_tles(t.v_tle), "2024-01-29").select("norad_id", "tle1", "source")


@query(
    "satellite_asof",
    """select e.pos_id, coalesce(t.tle1, '?') as tle1, coalesce(strftime(t.updated_at, '%Y-%m-%d %H:%M:%S'), '?') as updated_at
    from (select pos_id, ts, 39000 + mmsi % 20 as norad_id from v_ais) e asof left join v_tle t on e.norad_id = t.norad_id and e.ts >= t.updated_at""",
)
def satellite_asof(t):
    from seaglint.operators.orbits import satellite_asof as op

    e = t.v_ais.select("pos_id", "ts", (F.col("mmsi") % 20 + 39000).alias("norad_id"))
    return op(e, t.v_tle).select(
        "pos_id",
        F.coalesce("tle1", F.lit("?")).alias("tle1"),
        F.coalesce(F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss"), F.lit("?")).alias("updated_at"),
    )


@query("confidence_filter_detector", "select box_id from v_boxes where score >= 0.25e0")
def confidence_filter_detector(t):
    return t.v_boxes.where(F.col("score") >= C.DETECTOR_CONFIDENCE).select("box_id")


@query("confidence_filter_benchmark", "select box_id from v_boxes where score > 0.25e0")
def confidence_filter_benchmark(t):
    return t.v_boxes.where(F.col("score") > C.BENCHMARK_CONFIDENCE).select("box_id")


@query(
    "list_processing_codes",
    """select tile_id, code, case code when 'A' then 'raw' when 'B' then 'sigma0' when 'C' then 'sigma0_lee' when 'D' then 'sigma0_lee_log' else 'sigma0_lee_log_mvssd' end as name
    from (select tile_id, substr('ABCDE', cast(1 + tile_no % 5 as int), 1) as code from v_tiles) q""",
)
def list_processing_codes(t):
    table = F.create_map(*[F.lit(x) for kv in C.PROCESSING_CODES.items() for x in kv])
    df = t.sql("select tile_id, substr('ABCDE', cast(1 + tile_no % 5 as int), 1) as code from v_tiles")
    return df.withColumn("name", table[F.col("code")])


@query(
    "min_scene_age",
    "select id from v_products where cast(date as date) <= date '1998-06-27' and cast(date as date) >= date '1998-06-27' - 90",
)
def min_scene_age(t):
    return catalogue.min_scene_age(t.v_products, "1998-06-30").select("id")


@query("filter_platform", "select tile_id from v_tiles where substr(tile_id, 1, 3) in ('S1C', 'S1D')")
def filter_platform(t):
    return labels.filter_platform(t.v_tiles, ["S1C", "S1D"]).select("tile_id")


@query(
    "filter_scene_prefix",
    "select tile_id, case when starts_with(scene_id, 'S1C_IW') then 0 else 1 end as prefix_order from v_tiles where starts_with(scene_id, 'S1C_IW') or starts_with(scene_id, 'S1A')",
)
def filter_scene_prefix(t):
    return catalogue.filter_scene_prefix(t.v_tiles, ["S1C_IW", "S1A"]).select("tile_id", "prefix_order")


LABELLED = "select id, case id % 3 when 0 then concat('Morocco_', id) when 1 then 'Gulf_1' end as label, case when id % 2 = 0 then concat('/d/', id) else '' end as path from v_products"


@query(
    "filter_label_prefix",
    f"select id, case when label like 'Morocco\\_%' escape '\\' then 'kept' else 'archived' end as fate from ({LABELLED}) q where label like 'Morocco\\_%' escape '\\' or path <> ''",
)
def filter_label_prefix(t):
    kept, archived = catalogue.split_by_label_prefix(t.sql(LABELLED), "Morocco_")
    return kept.select("id", F.lit("kept").alias("fate")).unionByName(archived.select("id", F.lit("archived").alias("fate")))


@query("schema_functions", f"select pos_id, {ZONE_SQL} as zone from (select pos_id, {DIST_SQL.format(lat='lat', lon='lon')} as d from v_ais) q")
def schema_functions(t):
    """Zones through the registered SQL function."""
    from seaglint.functions.sqlfuncs import register_sql_functions

    register_sql_functions(t.spark)
    return t.sql("select pos_id, zone_of(lat, lon, lat, lon) as zone from v_ais")


