"""Domain tables derived from the given tables.

Every view is one SQL text that Spark and DuckDB both run. Groups (tiles, scenes) get more numerous
with the data, they do not get larger.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

VIEWS = {
    # Ship positions and AIS-off events.
    "v_ais": """
select event_id as pos_id, cast(200000000 + user_id as bigint) as mmsi, ts,
 25e0 + ((event_id * 7919) % 13000) / 1000e0 as lat, -24e0 + ((event_id * 104729) % 28000) / 1000e0 as lon,
 case event_type when 'view' then 'cargo' when 'click' then 'fishing' when 'purchase' then 'tanker' when 'signup' then 'passenger' end as vessel_type,
 case when event_type = 'error' then 'ais_off_candidate' else 'ais_presence_amorce' end as source
from events""",
    # One scene per 256 parts.
    "v_scenes": """
select s, concat('S1', substr('ABCD', cast(1 + s % 4 as int), 1), '_IW_GRDH_1SDV_202401', lpad(cast(4 + s * 3 % 24 as string), 2, '0'),
  'T061903_202401', lpad(cast(4 + s * 3 % 24 as string), 2, '0'), 'T061928_', lpad(cast(3600 + s as string), 7, '0'), '_00673D_', lpad(cast(s as string), 7, '0')) as scene_id,
 timestamp '2024-01-04 06:19:03' + (s * 3 % 24) * interval '1' day as acquired,
 25e0 + (s * 5) % 11 as lat0, -24e0 + (s * 7) % 26 as lon0
from (select distinct cast(floor(p_partkey / 256e0) as bigint) as s from part) q""",
    # 256 tiles per scene with half overlap.
    "v_tiles": """
select c.scene_id, c.s, concat(c.scene_id, '_D_tile', lpad(cast(t.n as string), 4, '0')) as tile_id, t.n as tile_no,
 c.lat0 + floor(t.n / 16e0) * 0.1e0 as lat_min, c.lon0 + (t.n % 16) * 0.1e0 as lon_min,
 c.lat0 + floor(t.n / 16e0) * 0.1e0 + 0.2e0 as lat_max, c.lon0 + (t.n % 16) * 0.1e0 + 0.2e0 as lon_max
from (select cast(floor(p_partkey / 256e0) as bigint) as s, p_partkey % 256 as n from part) t join v_scenes c on c.s = t.s""",
    # Raw predictions; a tile takes the boxes of 32 orders.
    "v_boxes": """
select cast(floor(l_orderkey / 32e0) as bigint) as tile_no, concat('T', lpad(cast(cast(floor(l_orderkey / 32e0) as bigint) as string), 12, '0')) as tile_id,
 concat(lpad(cast(l_orderkey as string), 12, '0'), '-', cast(l_linenumber as string), '-', cast(l_partkey as string), '-', cast(l_suppkey as string), '-', cast(cast(floor(l_extendedprice * 100e0 + 0.5e0) as bigint) as string)) as box_id,
 cast((l_partkey * 37 + l_orderkey * 13) % 640 as double) as cx, cast((l_suppkey * 53 + l_linenumber * 11) % 640 as double) as cy,
 cast(20 + l_partkey % 60 as double) as w, cast(12 + l_suppkey % 40 as double) as h,
 ((l_orderkey * 31 + l_linenumber * 17) % 1000) / 1000e0 as score, l_quantity as qty
from lineitem""",
    # Labels: every box moved by a few pixels.
    "v_truth": """
select tile_no, tile_id, box_id, cx + qty % 7e0 - 3e0 as cx, cy + qty % 5e0 - 2e0 as cy, w, h from v_boxes""",
    # Catalogue with standard and COG variants; both variants of one product share a date.
    "v_products": """
select o_orderkey as id, concat('S1', substr('ABCD', cast(1 + b % 4 as int), 1), '_IW_GRDH_1SDV_', 'X', lpad(cast(b as string), 12, '0'), '_Y_', lpad(cast(b as string), 12, '0'), '_0000AA_', lpad(cast(b as string), 12, '0'), case when o_orderkey % 3 = 0 then '_COG' else '' end) as name,
 o_orderdate as date, cast(1000000000 + (o_orderkey * 7919) % 900000000 as bigint) as size,
 -24e0 + (b * 37) % 28 as lon_min, 25e0 + (b * 53) % 13 as lat_min, -24e0 + (b * 37) % 28 + 2e0 as lon_max, 25e0 + (b * 53) % 13 + 1.5e0 as lat_max, b
from (select *, cast(floor(o_orderkey / 4e0) as bigint) as b from orders) q""",
    # Ground control: one 5x5 grid per 25 parts, on an image of 100x100 pixels.
    "v_gcp": """
select concat('G', lpad(cast(g as string), 12, '0')) as scene_id, cast(floor(k / 5e0) as bigint) as gi, k % 5 as gj,
 floor(k / 5e0) * 99e0 / 4e0 as line, (k % 5) * 99e0 / 4e0 as pixel,
 30e0 + floor(k / 5e0) * 0.1e0 + (k % 5) * 0.01e0 + g % 7 as lat, -10e0 + (k % 5) * 0.1e0 - floor(k / 5e0) * 0.02e0 + g % 5 as lon
from (select cast(floor(p_partkey / 25e0) as bigint) as g, p_partkey % 25 as k from part) q""",
    # Orbit element sets of many satellites, some with a bad second line.
    "v_tle": """
select 39000 + s_suppkey % 20 as norad_id, concat('SAT ', cast(s_suppkey % 20 as string)) as name,
 timestamp '2024-01-01 00:00:00' + s_suppkey * interval '7' hour as updated_at,
 case when s_suppkey % 3 = 0 then 'satnogs' else 'celestrak' end as source,
 concat('1 ', lpad(cast(39000 + s_suppkey % 20 as string), 5, '0'), 'U ', cast(s_suppkey as string)) as tle1,
 case when s_suppkey % 17 = 0 then 'bad' else concat('2 ', lpad(cast(39000 + s_suppkey % 20 as string), 5, '0')) end as tle2
from supplier""",
    # Label lines; some malformed, some with zero height, some repeated.
    "v_lines": """
select concat('S1', case when l_orderkey % 3 = 0 then 'C' when l_orderkey % 3 = 1 then 'D' else 'A' end, '_scene', lpad(cast(cast(floor(l_orderkey / 256e0) as bigint) as string), 9, '0'), '_D_tile', lpad(cast(l_orderkey as string), 12, '0')) as tile_id,
 l_orderkey, l_linenumber, l_partkey, l_suppkey,
 row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as line_no,
 case when l_partkey % 97 = 0 then 'bad line' else concat(cast(l_suppkey % 3 as string), ' 0.', lpad(cast((l_partkey * 37) % 4 as string), 2, '0'), ' 0.', lpad(cast((l_suppkey * 53) % 3 as string), 2, '0'), ' 0.0', cast(1 + l_partkey % 2 as string), ' 0.0', cast(l_suppkey % 10 as string)) end as txt
from lineitem""",
    # Detection events as they arrive: the same id arrives more than once.
    "v_events": """
select concat('ev', lpad(cast(cast(floor(event_id / 3e0) as bigint) as string), 12, '0'), '-', event_type) as event_id, event_id as arrival, ts as timestamp,
 concat('scene', cast(user_id as string)) as scene_id,
 25e0 + ((event_id * 7919) % 13000) / 1000e0 as lat_min, -24e0 + ((event_id * 104729) % 28000) / 1000e0 as lon_min,
 25e0 + ((event_id * 7919) % 13000) / 1000e0 + 0.05e0 as lat_max, -24e0 + ((event_id * 104729) % 28000) / 1000e0 + 0.05e0 as lon_max,
 cast(user_id % 13 as int) as vessel_count, cast(user_id % 5 as int) as dark_vessel_count, value as processing_time_ms
from events""",
}

# Views whose two spellings differ.
SPARK_VIEWS = {
    "v_pixels": """
select cast(vec_id div 64 as bigint) as tile, vec_id % 64 as y, cast(x as bigint) as x, cast(floor((cast(e as double) + 1e0) * 1000e0) as int) as dn
from embeddings lateral view posexplode(embedding) p as x, e""",
}
DUCK_VIEWS = {
    "v_pixels": """
select vec_id // 64 as tile, vec_id % 64 as y, i - 1 as x, cast(floor((cast(embedding[i] as double) + 1e0) * 1000e0) as int) as dn
from embeddings, range(1, 65) r(i)""",
}

_NAME = re.compile(r"\bv_[a-z]+\b")


def _needed(text: str, views: dict[str, str]) -> list[str]:
    """Views a text uses, in definition order, with the views those use."""
    found: set[str] = set()
    todo = [text]
    while todo:
        for name in _NAME.findall(todo.pop()):
            if name in views and name not in found:
                found.add(name)
                todo.append(views[name])
    return sorted(found, key=lambda n: len(_needed_depth(n, views)))


def _needed_depth(name: str, views: dict[str, str]) -> set[str]:
    out = {name}
    for used in _NAME.findall(views[name]):
        if used in views and used != name:
            out |= _needed_depth(used, views)
    return out


def with_views(body: str, views: dict[str, str]) -> str:
    """Prefix a query with the views it needs."""
    used = _needed(body, views)
    if not used:
        return body
    ctes = ",\n".join(f"{n} as ({views[n].strip()})" for n in used)
    head = body.lstrip()
    if head.lower().startswith("with recursive "):
        return f"with recursive {ctes},\n{head[len('with recursive '):]}"
    if head.lower().startswith("with "):
        return f"with {ctes},\n{head[5:]}"
    return f"with {ctes}\n{head}"


def duck_sql(body: str) -> str:
    return with_views(body, {**VIEWS, **DUCK_VIEWS})


class Tables:
    """Access to base tables and views of one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def base(self, name: str) -> DataFrame:
        """A given table, as its files are; ``spark.sql.files.*`` settings decide how it is cut."""
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def sql(self, body: str) -> DataFrame:
        """Spark SQL over base tables and views; the names resolve when the call is made.

        Base tables get views of names of their own, so views of the caller stay.
        """
        text = with_views(body, {**VIEWS, **SPARK_VIEWS})
        for name in BASE_TABLES:
            own = f"seaglint_{name}"
            text, used = re.subn(rf"\b(from|join)\s+{name}\b", rf"\1 {own}", text)
            if used:
                self.base(name).createOrReplaceTempView(own)
        return self.spark.sql(text)

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("v_"):
            return self.sql(f"select * from {name}")
        if name in BASE_TABLES:
            return self.base(name)
        raise AttributeError(name)
