"""Scalar functions over whole tables."""

from pyspark.sql import functions as F

from seaglint import config as C
from seaglint.functions import ais, boxes, draws, geo, names, orbit
from seaglint.operators import events as ev
from seaglint.plans.registry import query, r, rounded

ZONE_SQL = """case when d <= 12e0 / 60e0 then 'Z1' when d <= 200e0 / 60e0 then 'Z2' else 'Z3' end"""
DIST_SQL = """greatest(-17e0 - {lon}, {lon} - -1e0, 27e0 - {lat}, {lat} - 36e0, 0e0)"""


@query(
    "determine_zone",
    f"""select pos_id, {ZONE_SQL} as zone from (select pos_id, {DIST_SQL.format(lat='((lat + (lat + 0.5e0)) / 2e0)', lon='((lon + (lon + 0.5e0)) / 2e0)')} as d from v_ais) q""",
)
def determine_zone(t):
    lat, lon = F.col("lat"), F.col("lon")
    return t.v_ais.select("pos_id", geo.zone_of(lat, lon, lat + 0.5, lon + 0.5).alias("zone"))


@query(
    "enrich_zone",
    f"""select pos_id, case when z is null or z = '' then {ZONE_SQL} else z end as zone
    from (select pos_id, case when mmsi % 3 = 0 then '' when mmsi % 3 = 1 then 'Z9' end as z, {DIST_SQL.format(lat='lat', lon='lon')} as d from v_ais) q""",
)
def enrich_zone(t):
    zone = F.when(F.col("mmsi") % 3 == 0, "").when(F.col("mmsi") % 3 == 1, "Z9")
    df = t.v_ais.withColumn("zone", zone).withColumn("tile_bbox_latlon", F.array("lat", "lon", "lat", "lon"))
    return ev.enrich_zone(df).select("pos_id", "zone")


@query(
    "priority_level",
    """select arrival, case when vessel_count >= 10 then 'CRITICAL' when vessel_count >= 5 then 'HIGH' when vessel_count >= 2 then 'MEDIUM' else 'LOW' end as priority_level from v_events""",
)
def priority_level(t):
    return ev.with_priority(t.v_events).select("arrival", "priority_level")


LAT_TXT = "concat(cast(25 + cast(floor((event_id * 7919) % 13000 / 1000e0) as bigint) as string), '.', lpad(cast((event_id * 7919) % 1000 as string), 3, '0'))"
LON_TXT = "concat('-', cast(cast(floor((event_id * 104729) % 28000 / 1000e0) as bigint) as string), '.', lpad(cast((event_id * 104729) % 1000 as string), 3, '0'))"
RECORDS = f"""select event_id as pos_id, case event_id % 7
  when 0 then concat('{{"lat":', la, ',"lon":', lo, ',"timestamp":"","date":"2024-01-02","MMSI":"', user_id, '","name":"N', user_id, '","type":"', event_type, '"}}')
  when 1 then concat('{{"latitude":', la, ',"longitude":', lo, ',"timestamp":"2024-01-03","mmsi":"', user_id, '","vessel_name":"V","name":"N","vessel_type":"', event_type, '"}}')
  when 2 then concat('{{"geometry":{{"type":"Point","coordinates":[', lo, ',', la, ']}},"mmsi":"","MMSI":"', user_id, '"}}')
  when 3 then concat('{{"position":{{"lat":', la, ',"lon":', lo, '}}}}')
  when 4 then concat('{{"location":{{"latitude":', la, ',"longitude":', lo, '}}}}')
  when 5 then concat('{{"lat":', la, ',"mmsi":"', user_id, '"}}')
  else '{{"name":"x"}}' end as record
 from (select *, {LAT_TXT} as la, {LON_TXT} as lo from events) e"""


def _json(path):
    return f"(record->>'$.{path}')"


_DUCK_LAT = f"""case when {_json('lat')} is not null and {_json('lon')} is not null then {_json('lat')}
  when {_json('latitude')} is not null and {_json('longitude')} is not null then {_json('latitude')}
  when {_json('geometry.coordinates[1]')} is not null then {_json('geometry.coordinates[1]')}
  when {_json('position.lat')} is not null then {_json('position.lat')} else {_json('location.latitude')} end"""
_DUCK_LON = f"""case when {_json('lat')} is not null and {_json('lon')} is not null then {_json('lon')}
  when {_json('latitude')} is not null and {_json('longitude')} is not null then {_json('longitude')}
  when {_json('geometry.coordinates[1]')} is not null then {_json('geometry.coordinates[0]')}
  when {_json('position.lat')} is not null then {_json('position.lon')} else {_json('location.longitude')} end"""


@query(
    "extract_lat_lon",
    f"""select pos_id, coalesce(cast({_DUCK_LAT} as double), 999e0) as lat, coalesce(cast({_DUCK_LON} as double), 999e0) as lon from ({RECORDS}) q""",
)
def extract_lat_lon(t):
    lat, lon = ais.lat_lon_of(F.col("f"))
    none = F.lit(999.0)
    return t.sql(RECORDS).withColumn("f", ais.record_fields(F.col("record"))).select("pos_id", F.coalesce(lat, none).alias("lat"), F.coalesce(lon, none).alias("lon"))


@query(
    "normalize_ais_record",
    f"""select pos_id, lat, lon, coalesce(nullif({_json('timestamp')}, ''), nullif({_json('date')}, ''), '') as timestamp,
    coalesce(nullif({_json('mmsi')}, ''), nullif({_json('MMSI')}, ''), '?') as mmsi,
    coalesce(nullif({_json('vessel_name')}, ''), nullif({_json('name')}, ''), '?') as vessel_name,
    coalesce(nullif({_json('vessel_type')}, ''), nullif({_json('type')}, ''), '?') as vessel_type, 'ais_presence_amorce' as source
    from (select *, cast({_DUCK_LAT} as double) as lat, cast({_DUCK_LON} as double) as lon from ({RECORDS}) q) p where lat is not null and lon is not null""",
)
def normalize_ais_record(t):
    from seaglint.operators.ais import normalize_records

    out = normalize_records(t.sql(RECORDS))
    blank = F.lit("?")
    return out.select(
        "pos_id", "lat", "lon", "timestamp",
        *[F.coalesce(c, blank).alias(c) for c in ("mmsi", "vessel_name", "vessel_type")], "source",
    )


SAFE_NAME = "concat(name, case id % 3 when 0 then '' when 1 then '.SAFE' else '.SAFE/' end)"
NORM = f"replace(rtrim({SAFE_NAME}, '/'), '.SAFE', '')"


@query("scene_id_normalize", f"select id, {NORM} as scene_id from v_products")
def scene_id_normalize(t):
    return t.sql(f"select id, {SAFE_NAME} as name from v_products").select(
        "id", names.scene_id_normalize(F.col("name")).alias("scene_id")
    )


@query(
    "scene_base_id",
    f"""select id, case when len(p) < 7 then '?' when upper(p[-1]) = 'COG' then concat(p[-4], '_', p[-3], '_', p[-2]) else concat(p[-3], '_', p[-2], '_', p[-1]) end as base_id
    from (select id, string_split(case when b % 11 = 0 then 'short_name' else {NORM} end, '_') as p from v_products) q""",
)
def scene_base_id(t):
    df = t.sql(f"select id, case when b % 11 = 0 then 'short_name' else {SAFE_NAME} end as name from v_products")
    return df.select("id", F.coalesce(names.scene_base_id(F.col("name")), F.lit("?")).alias("base_id"))


@query(
    "cog_base7",
    """select id, case when len(p) >= 8 then array_to_string(p[1:7], '_') else name end as base7
    from (select id, name, string_split(name, '_') as p from (select id, case when b % 11 = 0 then 'short_name' else name end as name from v_products) n) q""",
)
def cog_base7(t):
    df = t.sql("select id, case when b % 11 = 0 then 'short_name' else name end as name from v_products")
    return df.select("id", names.cog_base7(F.col("name")).alias("base7"))


@query(
    "acquisition_time",
    """select tile_id, strftime(strptime(regexp_extract(tile_id, '_([0-9]{8}T[0-9]{6})_', 1), '%Y%m%dT%H%M%S'), '%Y-%m-%dT%H:%M:%SZ') as acquired from v_tiles""",
)
def acquisition_time(t):
    at = names.acquisition_time(F.col("tile_id"))
    return t.v_tiles.select("tile_id", F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("acquired"))


@query(
    "satellite_platform",
    """select tile_id, line_no, coalesce(list_filter(string_split(n, '_'), lambda p: starts_with(p, 'S1') and len(p) >= 3)[1][1:3], 'UNKNOWN') as platform
    from (select tile_id, line_no, case l_partkey % 3 when 0 then tile_id when 1 then concat('x_', tile_id) else concat('S1_', l_partkey) end as n from v_lines) q""",
)
def satellite_platform(t):
    df = t.sql("select tile_id, line_no, case l_partkey % 3 when 0 then tile_id when 1 then concat('x_', tile_id) else concat('S1_', l_partkey) end as n from v_lines")
    return df.select("tile_id", "line_no", names.satellite_platform(F.col("n")).alias("platform"))


@query("short_scene_id", "select tile_id, array_to_string(string_split(tile_id, '_')[1:3], '_') as short_id from v_tiles")
def short_scene_id(t):
    return t.v_tiles.select("tile_id", names.short_scene_id(F.col("tile_id")).alias("short_id"))


@query("tile_id_format", "select scene_id, tile_no, concat(scene_id, '_D_tile', lpad(cast(tile_no as varchar), 4, '0')) as formatted from v_tiles")
def tile_id_format(t):
    return t.v_tiles.select(
        "scene_id", "tile_no", names.tile_id_format(F.col("scene_id"), F.lit("D"), F.col("tile_no")).alias("formatted")
    )


@query(
    "derived_tile_id",
    "select tile_id, concat(array_to_string(p[1:-2], '_'), '_E_', p[-1]) as derived from (select tile_id, string_split(tile_id, '_') as p from v_tiles) q",
)
def derived_tile_id(t):
    return t.v_tiles.select("tile_id", names.derived_tile_id(F.col("tile_id"), "E").alias("derived"))


@query(
    "parse_tile_coords",
    "select tile_id, concat('r', lpad(cast(tile_no * 13 // 256 as varchar), 4, '0'), '_c', lpad(cast(tile_no * 7 // 256 as varchar), 4, '0')) as grid_id from v_tiles",
)
def parse_tile_coords(t):
    return t.v_tiles.select(
        "tile_id", names.grid_tile_id(F.col("tile_no") * 13, F.col("tile_no") * 7, 256).alias("grid_id")
    )


BOXED = """select pos_id, lat, lon, floor(lat * 5e0) / 5e0 as lat_min, floor(lon * 5e0) / 5e0 as lon_min,
 case when pos_id % 17 = 0 then floor(lat * 5e0) / 5e0 else floor(lat * 5e0) / 5e0 + 0.2e0 end as lat_max, floor(lon * 5e0) / 5e0 + 0.2e0 as lon_max from v_ais"""
_SIX = ("lat", "lon", "lat_min", "lon_min", "lat_max", "lon_max")


@query(
    "latlon_to_pixel",
    f"""select pos_id, {r('(lon - lon_min) / (lon_max - lon_min) * 512e0')} as px, {r('(lat_max - lat) / (lat_max - lat_min) * 512e0')} as py from ({BOXED}) q where lat_max <> lat_min and lon_max <> lon_min""",
)
def latlon_to_pixel(t):
    x, y = geo.tile_pixel(*[F.col(c) for c in _SIX])
    return t.sql(BOXED).select("pos_id", rounded(x).alias("px"), rounded(y).alias("py")).where("px is not null and py is not null")


@query(
    "latlon_to_pixel_safe",
    f"""select pos_id, {r('px', 3)} as px, {r('py', 3)} as py from (select pos_id, (lon - lon_min) / greatest(lon_max - lon_min, 1e-9) * 512e0 as px, (lat_max - lat) / greatest(lat_max - lat_min, 1e-9) * 512e0 as py from ({BOXED}) q) p
    where px between -5 and 517 and py between -5 and 517""",
)
def latlon_to_pixel_safe(t):
    x, y = geo.tile_pixel_safe(*[F.col(c) for c in _SIX])
    df = t.sql(BOXED).select("pos_id", x.alias("px"), y.alias("py")).where("px between -5 and 517 and py between -5 and 517")
    return df.select("pos_id", rounded(F.col("px"), 3).alias("px"), rounded(F.col("py"), 3).alias("py"))


@query(
    "haversine_m",
    f"""select pos_id, {r('2 * 6371000e0 * asin(sqrt(least(1e0, power(sin(radians(31e0 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(31e0)) * power(sin(radians(-9e0 - lon) / 2), 2))))', 2)} as metres from v_ais""",
)
def haversine_m(t):
    d = geo.haversine_m(F.col("lat"), F.col("lon"), F.lit(31.0), F.lit(-9.0))
    return t.v_ais.select("pos_id", rounded(d, 2).alias("metres"))


@query(
    "annotation_label",
    """select event_id, case when s = 'sar_detection' then (case when m then 'AIS_confirmed' else 'visual_only' end)
      when s in ('ais_presence', 'ais_presence_amorce') then 'AIS_confirmed' when s in ('ais_off', 'ais_off_candidate') then 'dark_vessel_candidate' else 'visual_only' end as label
    from (select event_id, user_id % 2 = 0 as m, case event_id % 6 when 0 then 'sar_detection' when 1 then 'ais_presence' when 2 then 'ais_presence_amorce' when 3 then 'ais_off' when 4 then 'ais_off_candidate' end as s from events) q""",
)
def annotation_label(t):
    df = t.sql("select event_id, user_id % 2 = 0 as m, case event_id % 6 when 0 then 'sar_detection' when 1 then 'ais_presence' when 2 then 'ais_presence_amorce' when 3 then 'ais_off' when 4 then 'ais_off_candidate' end as s from events")
    return df.select("event_id", ais.annotation_label(F.col("s"), F.col("m")).alias("label"))


@query(
    "annotation_timestamp",
    """select event_id, coalesce(nullif(case when event_id % 2 = 0 then '' else 'a' end, ''), nullif(case when event_id % 3 = 0 then 'b' end, ''), nullif(case when event_id % 5 = 0 then 'c' else '' end, ''), '') as at from events""",
)
def annotation_timestamp(t):
    a = F.when(F.col("event_id") % 2 == 0, "").otherwise("a")
    b = F.when(F.col("event_id") % 3 == 0, "b")
    c = F.when(F.col("event_id") % 5 == 0, "c").otherwise("")
    return t.events.select("event_id", ais.annotation_timestamp(a, b, c).alias("at"))


@query(
    "vessel_type_pick",
    """select event_id, coalesce(case when event_id % 4 = 0 then event_type end, nullif(case when event_id % 3 = 0 then 'fishing' else '' end, ''), case when event_id % 5 = 0 then 'tug' end, '?') as picked from events""",
)
def vessel_type_pick(t):
    e = F.col("event_id")
    picked = ais.vessel_type_pick(
        F.when(e % 4 == 0, F.col("event_type")), F.when(e % 3 == 0, "fishing").otherwise(""), F.when(e % 5 == 0, "tug")
    )
    return t.events.select("event_id", F.coalesce(picked, F.lit("?")).alias("picked"))


KINDS = "case p_partkey % 9 when 0 then 'Oil TANKER' when 1 then 'cargo ship' when 2 then 'container' when 3 then 'fishing trawler' when 4 then 'longliner' when 5 then 'Yacht' when 6 then 'offshore supply' when 7 then 'tug' else p_type end"


@query(
    "vessel_length_class",
    f"""select p_partkey, case when regexp_matches(k, 'tanker|cargo|container') then 100e0 when regexp_matches(k, 'fishing|trawler|longliner') then 10e0 when regexp_matches(k, 'passenger|pleasure|yacht') then 30e0 when regexp_matches(k, 'tug|supply|offshore') then 20e0 else 10e0 end as shortest,
    case when regexp_matches(k, 'tanker|cargo|container') then 350e0 when regexp_matches(k, 'fishing|trawler|longliner') then 40e0 when regexp_matches(k, 'passenger|pleasure|yacht') then 150e0 when regexp_matches(k, 'tug|supply|offshore') then 80e0 else 300e0 end as longest
    from (select p_partkey, lower({KINDS}) as k from part) q""",
)
def vessel_length_class(t):
    lo, hi = boxes.vessel_length_range(F.col("k"))
    return t.sql(f"select p_partkey, {KINDS} as k from part").select("p_partkey", lo.alias("shortest"), hi.alias("longest"))


def duck_uniform(key, draw):
    return f"(cast(concat('0x', substr(md5(concat({key}, '|', '{draw}')), 1, 8)) as bigint) / 4294967296e0)"


def duck_size(key, kind):
    """(w, h) expressions of the size model for DuckDB; ``kind`` may be null or empty."""
    typed = f"({kind} is not null and {kind} <> '')"
    k = f"lower({kind})"
    roll = duck_uniform(key, "mix")
    lo = f"case when {typed} then (case when regexp_matches({k}, 'tanker|cargo|container') then 100e0 when regexp_matches({k}, 'fishing|trawler|longliner') then 10e0 when regexp_matches({k}, 'passenger|pleasure|yacht') then 30e0 when regexp_matches({k}, 'tug|supply|offshore') then 20e0 else 10e0 end) else (case when {roll} < 0.6e0 then 10e0 when {roll} < 0.9e0 then 40e0 else 120e0 end) end"
    hi = f"case when {typed} then (case when regexp_matches({k}, 'tanker|cargo|container') then 350e0 when regexp_matches({k}, 'fishing|trawler|longliner') then 40e0 when regexp_matches({k}, 'passenger|pleasure|yacht') then 150e0 when regexp_matches({k}, 'tug|supply|offshore') then 80e0 else 300e0 end) else (case when {roll} < 0.6e0 then 40e0 when {roll} < 0.9e0 then 120e0 else 350e0 end) end"
    length = f"exp(ln({lo}) + (ln({hi}) - ln({lo})) * {duck_uniform(key, 'length')}) * (1.8e0 + 1.7e0 * {duck_uniform(key, 'bloom')}) * (0.8e0 + 0.4e0 * {duck_uniform(key, 'jitter')}) / 10e0"
    w = f"least(1e0, greatest(0.001e0, greatest(3e0, {length}) / 512e0))"
    h = f"least(1e0, greatest(0.001e0, greatest(1.5e0, ({length}) / (3e0 + 3e0 * {duck_uniform(key, 'aspect')})) / 512e0))"
    return w, h


_w, _h = duck_size("cast(pos_id as varchar)", "vessel_type")


@query(
    "estimate_bbox",
    f"""select pos_id, {r('greatest(0e0, least(1e0, (lat - 24e0) * 40e0 / 512e0))')} as cx, {r('greatest(0e0, least(1e0, (lon + 24e0) * 20e0 / 512e0))')} as cy, {r(_w)} as w, {r(_h)} as h from v_ais""",
)
def estimate_bbox(t):
    box = boxes.estimated_box(F.col("pos_id"), (F.col("lat") - 24.0) * 40.0, (F.col("lon") + 24.0) * 20.0, F.col("vessel_type"))
    return t.v_ais.select("pos_id", *[rounded(v).alias(n) for v, n in zip(box, ("cx", "cy", "w", "h"), strict=True)])


@query(
    "fixed_bbox",
    f"""select box_id, {r('least(1e0, greatest(0e0, (cx - 60e0) / 512e0))')} as fx, {r('least(1e0, greatest(0e0, (cy - 60e0) / 512e0))')} as fy, 8e0 / 512e0 as fw, 4e0 / 512e0 as fh from v_boxes""",
)
def fixed_bbox(t):
    x, y, w, h = boxes.fixed_box(F.col("cx") - 60.0, F.col("cy") - 60.0)
    return t.v_boxes.select("box_id", rounded(x).alias("fx"), rounded(y).alias("fy"), w.alias("fw"), h.alias("fh"))


@query("xywh_to_xyxy", "select box_id, cx - w / 2 as x1, cy - h / 2 as y1, cx + w / 2 as x2, cy + h / 2 as y2 from v_boxes")
def xywh_to_xyxy(t):
    c = boxes.corners(*[F.col(n) for n in ("cx", "cy", "w", "h")])
    return t.v_boxes.select("box_id", *[v.alias(n) for v, n in zip(c, ("x1", "y1", "x2", "y2"), strict=True)])


PAIRED = "select b.box_id, b.cx, b.cy, b.w, b.h, g.cx as gx, g.cy as gy, g.w as gw, g.h as gh from v_boxes b join v_truth g on b.box_id = g.box_id"
_INTER = "greatest(0e0, least(cx + w / 2, gx + gw / 2) - greatest(cx - w / 2, gx - gw / 2)) * greatest(0e0, least(cy + h / 2, gy + gh / 2) - greatest(cy - h / 2, gy - gh / 2))"


@query("iou_yolo", f"select box_id, case when u <= 0 then 0 else {r('i / u', 9)} end as iou from (select box_id, i, w * h + gw * gh - i as u from (select *, {_INTER} as i from ({PAIRED}) q) p) o")
def iou_yolo(t):
    v = boxes.iou_yolo(tuple(map(F.col, ("cx", "cy", "w", "h"))), tuple(map(F.col, ("gx", "gy", "gw", "gh"))))
    return t.sql(PAIRED).select("box_id", rounded(v, 9).alias("iou"))


@query("iou_xyxy", f"select box_id, {r('i / (w * h + gw * gh - i + 1e-6)', 9)} as iou from (select *, {_INTER} as i from ({PAIRED}) q) p")
def iou_xyxy(t):
    a = boxes.corners(*map(F.col, ("cx", "cy", "w", "h")))
    b = boxes.corners(*map(F.col, ("gx", "gy", "gw", "gh")))
    return t.sql(PAIRED).select("box_id", rounded(boxes.iou_xyxy(a, b), 9).alias("iou"))


@query(
    "rescale_clip_box",
    """select box_id, greatest(0e0, (cx - w / 2) * (512e0 / 640e0)) as x1, greatest(0e0, (cy - h / 2) * (400e0 / 640e0)) as y1,
    least(512e0, (cx + w / 2) * (512e0 / 640e0)) as x2, least(400e0, (cy + h / 2) * (400e0 / 640e0)) as y2 from v_boxes""",
)
def rescale_clip_box(t):
    c = boxes.rescale_clip(boxes.corners(*map(F.col, ("cx", "cy", "w", "h"))), F.lit(512.0), F.lit(400.0))
    return t.v_boxes.select("box_id", *[v.alias(n) for v, n in zip(c, ("x1", "y1", "x2", "y2"), strict=True)])


@query(
    "row_format_score",
    """select box_id, case when list_max([w / 100e0 - 0.3e0, h / 100e0 - 0.3e0]) > 0 then score * list_max([w / 100e0 - 0.3e0, h / 100e0 - 0.3e0]) else score end as row_score from v_boxes""",
)
def row_format_score(t):
    cls = F.array(F.col("w") / 100.0 - 0.3, F.col("h") / 100.0 - 0.3)
    return t.v_boxes.select("box_id", boxes.row_score(F.col("score"), cls).alias("row_score"))


@query(
    "tle_is_fresh",
    "select tle1, coalesce(timestamp '2024-01-20 00:00:00' - case when norad_id % 7 = 0 then null else updated_at end < interval 24 hour, false) as fresh from v_tle",
)
def tle_is_fresh(t):
    at = F.when(F.col("norad_id") % 7 != 0, F.col("updated_at"))
    return t.v_tle.select("tle1", orbit.tle_is_fresh(at, F.to_timestamp(F.lit("2024-01-20"))).alias("fresh"))


@query(
    "satnogs_name",
    """select c_custkey, case when t0 is null or t0 = '' then concat('NORAD-', c_custkey) when instr(t0, '0 ') > 0 then trim(concat(substr(t0, 1, instr(t0, '0 ') - 1), substr(t0, instr(t0, '0 ') + 2))) else trim(t0) end as title
    from (select c_custkey, case c_custkey % 4 when 0 then concat('0 ', c_name) when 1 then c_name when 2 then '' end as t0 from customer) q""",
)
def satnogs_name(t):
    df = t.sql("select c_custkey, case c_custkey % 4 when 0 then concat('0 ', c_name) when 1 then c_name when 2 then '' end as t0 from customer")
    return df.select("c_custkey", orbit.satnogs_name(F.col("t0"), F.col("c_custkey")).alias("title"))


IDS = "select c_custkey, case c_custkey % 8 when 0 then concat(' 00', c_custkey, ' ') when 1 then concat('+', c_custkey) when 2 then '' when 3 then '   ' when 4 then concat(c_custkey, ' OR 1=1') when 5 then concat('-', c_custkey) when 6 then '../etc' else cast(c_custkey as string) end as txt from customer"


@query(
    "parse_satellite_id",
    f"""select c_custkey, coalesce(case when regexp_full_match(trim(txt), '\\+?[0-9]+') and cast(replace(trim(txt), '+', '') as bigint) > 0 then cast(replace(trim(txt), '+', '') as bigint) end, -1) as norad_id from ({IDS}) q""",
)
def parse_satellite_id(t):
    return t.sql(IDS).select("c_custkey", F.coalesce(orbit.parse_satellite_id(F.col("txt")), F.lit(-1)).cast("bigint").alias("norad_id"))


@query(
    "position_rounding",
    "select pos_id, round(lat + 0.1234567e0, 6) as lat, round(lon + 0.1234564e0, 6) as lon, round(lat * 10e0 + 0.001e0, 2) as alt_m from v_ais",
)
def position_rounding(t):
    v = orbit.rounded_position(F.col("lat") + 0.1234567, F.col("lon") + 0.1234564, F.col("lat") * 10.0 + 0.001)
    return t.v_ais.select("pos_id", *[x.alias(n) for x, n in zip(v, ("lat", "lon", "alt_m"), strict=True)])


_P = "printf('%.6f %.6f', {x}, {y})"
_RING = ", ',', ".join(_P.format(x=x, y=y) for x, y in (("lon_min", "lat_min"), ("lon_max", "lat_min"), ("lon_max", "lat_max"), ("lon_min", "lat_max"), ("lon_min", "lat_min")))


@query("bbox_wkt", f"select tile_id, concat('POLYGON((', {_RING}, '))') as wkt from v_tiles")
def bbox_wkt(t):
    return t.v_tiles.select("tile_id", geo.bbox_wkt(*map(F.col, ("lon_min", "lat_min", "lon_max", "lat_max"))).alias("wkt"))


_PT = "'[', {0}, ',', {1}, ']'"


@query(
    "bbox_polygon",
    "select id, concat('{\"type\":\"Polygon\",\"coordinates\":[[', "
    + ", ',', ".join(_PT.format(x, y) for x, y in (("a", "b"), ("c", "b"), ("c", "d"), ("a", "d"), ("a", "b")))
    + ", ']]}') as polygon from (select id, cast(lon_min as bigint) as a, cast(lat_min as bigint) as b, cast(lon_min as bigint) + 2 as c, cast(lat_min as bigint) + 1 as d from v_products) q",
)
def bbox_polygon(t):
    a, b = F.col("lon_min").cast("bigint"), F.col("lat_min").cast("bigint")
    return t.v_products.select("id", geo.bbox_polygon(a, b, a + 2, b + 1).alias("polygon"))


@query(
    "date_windows",
    """select pos_id, cast(cast(ts as date) - 3 as varchar) as ais_from, cast(cast(ts as date) + 1 as varchar) as ais_to, cast(cast(ts as date) - 30 as varchar) as density_from,
    strftime(ts - interval 1 hour, '%Y-%m-%d %H:%M:%S') as hour_from, strftime(ts + interval 1 hour, '%Y-%m-%d %H:%M:%S') as hour_to from v_ais""",
)
def date_windows(t):
    day = F.col("ts").cast("date")
    hour = F.expr("interval 1 hour")
    return t.v_ais.select(
        "pos_id",
        F.date_sub(day, C.AIS_LOOKBACK_DAYS).cast("string").alias("ais_from"),
        F.date_add(day, 1).cast("string").alias("ais_to"),
        F.date_sub(day, C.DENSITY_LOOKBACK_DAYS).cast("string").alias("density_from"),
        F.date_format(F.col("ts") - hour, "yyyy-MM-dd HH:mm:ss").alias("hour_from"),
        F.date_format(F.col("ts") + hour, "yyyy-MM-dd HH:mm:ss").alias("hour_to"),
    )


@query("bytes_to_gb", "select id, size / 1073741824e0 as gb from v_products")
def bytes_to_gb(t):
    return t.v_products.select("id", (F.col("size") / F.lit(1024.0**3)).alias("gb"))


@query(
    "yolo_to_pixel_box",
    """select box_id, cast(trunc((cx / 640e0 - w / 640e0 / 2e0) * 512e0) as bigint) as x1, cast(trunc((cy / 640e0 - h / 640e0 / 2e0) * 512e0) as bigint) as y1,
    cast(trunc((cx / 640e0 + w / 640e0 / 2e0) * 512e0) as bigint) as x2, cast(trunc((cy / 640e0 + h / 640e0 / 2e0) * 512e0) as bigint) as y2 from v_boxes""",
)
def yolo_to_pixel_box(t):
    b = boxes.pixel_box(*[F.col(c) / 640.0 for c in ("cx", "cy", "w", "h")])
    return t.v_boxes.select("box_id", *[v.cast("bigint").alias(n) for v, n in zip(b, ("x1", "y1", "x2", "y2"), strict=True)])


@query(
    "detections_json",
    """select box_id, case when h > 30 then 0 else 1 end as n, case when h > 30 then -1e0 else score end as confidence from v_boxes""",
)
def detections_json(t):
    one = F.array(F.struct(F.col("cx").alias("x1"), F.col("cy").alias("y1"), F.col("w").alias("x2"), F.col("h").alias("y2"), F.col("score").alias("confidence")))
    text = F.when(F.col("h") > 30, "not json").otherwise(F.to_json(one))
    d = ev.decode_detections(text)
    return t.v_boxes.select(
        "box_id", F.size(d).alias("n"), F.coalesce(F.get(d, F.lit(0))["confidence"], F.lit(-1.0)).alias("confidence")
    )


@query(
    "trace_drop_nulls",
    """select s, concat('{"scene_id":"', scene_id, '","safe_dir":"', scene_id, '.SAFE","target_density_cell_index":', s, case when s % 2 = 0 then concat(',"ais_count":', s * 3) else '' end, ',"protocol":"PH0-CORR-002_density_targeted"}') as trace_json from v_scenes""",
)
def trace_drop_nulls(t):
    from seaglint.operators.catalogue import target_trace

    rows = t.v_scenes.select(
        "s",
        F.concat("scene_id", F.lit(".SAFE/")).alias("scene_name"),
        F.col("s").alias("cell_index"),
        F.lit(None).cast("array<double>").alias("target_cell_bbox"),
        F.lit(None).cast("bigint").alias("density_rank"),
        F.when(F.col("s") % 2 == 0, F.col("s") * 3).alias("ais_count"),
    )
    return target_trace(rows).select(F.col("target_density_cell_index").alias("s"), "trace_json")


@query(
    "tile_event_defaults",
    "select arrival, case when arrival % 2 = 0 then event_id end as event_id, case when arrival % 3 = 0 then scene_id else 'unknown' end as scene_id, 'Z3' as zone, 36 as tile_id_length, 4 as box_values, 0e0 as box_sum from v_events",
)
def tile_event_defaults(t):
    """Made-up ids are random: an event keeps its own id, the others count by their length."""
    df = t.v_events.select(
        "arrival",
        F.when(F.col("arrival") % 2 == 0, F.col("event_id")).alias("event_id"),
        F.when(F.col("arrival") % 3 == 0, F.col("scene_id")).alias("scene_id"),
        F.lit(None).cast("string").alias("tile_id"),
        F.lit(None).cast("array<double>").alias("tile_bbox_latlon"),
        F.lit(None).cast("string").alias("zone"),
    )
    out = ev.event_defaults(df)
    return out.select(
        "arrival", F.when(F.length("event_id") != 36, F.col("event_id")).alias("event_id"), "scene_id", "zone", F.length("tile_id").alias("tile_id_length"),
        F.size("tile_bbox_latlon").alias("box_values"), F.aggregate("tile_bbox_latlon", F.lit(0.0), lambda a, b: a + b).alias("box_sum"),
    )


@query("hash_draws", "select pos_id, " + duck_uniform("cast(pos_id as varchar)", "mix") + " as u from v_ais")
def hash_draws(t):
    return t.v_ais.select("pos_id", draws.uniform(F.col("pos_id"), "mix").alias("u"))
