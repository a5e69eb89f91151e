"""Tile grids, control points, scene reports, tile sampling."""

from pyspark.sql import functions as F

from seaglint.operators import tiles
from seaglint.plans.registry import query, r, rounded

DIMS = "select concat('P', lpad(cast(s_suppkey as string), 9, '0')) as scene_id, cast(1 + (s_suppkey * 997) % 4000 as int) as height, cast(1 + (s_suppkey * 631) % 5000 as int) as width from supplier"


@query(
    "tile_grid",
    f"""select scene_id, cast(y // 256 * ceil(width / 256e0) + x // 256 as bigint) as tile_no, y as y0, x as x0, least(y + 512, height) as y1, least(x + 512, width) as x1 from (
      select *, unnest(range(0, width, 256)) as x from (select *, unnest(range(0, height, 256)) as y from ({DIMS}) d) q) z""",
)
def tile_grid(t):
    return tiles.tile_grid(t.sql(DIMS)).select("scene_id", "tile_no", *[F.col(c).cast("bigint").alias(c) for c in ("y0", "x0", "y1", "x1")])


SHAPES = "select distinct scene_id, 100 as height, 100 as width from v_gcp"
SHAPES_X = f"{SHAPES} union all select concat('X', lpad(cast(s_suppkey as string), 12, '0')) as scene_id, 90 as height, 70 as width from supplier"


@query("gcp_table", f"select scene_id, gi, gj, {r('lat')} as lat, {r('lon')} as lon from v_gcp")
def gcp_table(t):
    out = tiles.gcp_table(t.v_gcp.drop("gi", "gj"))
    return out.select("scene_id", "gi", "gj", rounded(F.col("lat")).alias("lat"), rounded(F.col("lon")).alias("lon"))


LOOSE = "select scene_id, line, pixel from v_gcp union all select scene_id, 5e-1 as line, 7e0 as pixel from v_gcp where gi = 0 and gj = 0 and substr(scene_id, 13, 1) = '3'"


@query("gcp_regularity", f"select scene_id, count(distinct line) as n_rows, count(distinct pixel) as n_cols, count(*) as n_points, count(distinct line) * count(distinct pixel) = count(*) as regular from ({LOOSE}) q group by scene_id")
def gcp_regularity(t):
    return tiles.gcp_regularity(t.sql(LOOSE))


PIXELS = "select l_orderkey, l_linenumber, concat('G', lpad(cast(cast(floor(l_partkey / 25e0) as bigint) as string), 12, '0')) as scene_id, (l_suppkey * 53) % 110 - 5e0 as line, (l_orderkey * 7) % 110 - 5e0 as pixel from lineitem"
_FY, _FX = "(p.line / 24.75e0 - gi0)", "(p.pixel / 24.75e0 - gj0)"


@query(
    "gcp_pixel_to_latlon",
    f"""select l_orderkey, l_linenumber, coalesce({r(f"a.lat * (1 - {_FY}) * (1 - {_FX}) + b.lat * (1 - {_FY}) * {_FX} + c.lat * {_FY} * (1 - {_FX}) + d.lat * {_FY} * {_FX}")}, 999e0) as lat,
      coalesce({r(f"a.lon * (1 - {_FY}) * (1 - {_FX}) + b.lon * (1 - {_FY}) * {_FX} + c.lon * {_FY} * (1 - {_FX}) + d.lon * {_FY} * {_FX}")}, 999e0) as lon
    from (select *, case when line between 0 and 99 and pixel between 0 and 99 then least(3, cast(floor(line / 24.75e0) as bigint)) end as gi0, least(3, cast(floor(pixel / 24.75e0) as bigint)) as gj0 from ({PIXELS}) q) p
    left join v_gcp a on a.scene_id = p.scene_id and a.gi = gi0 and a.gj = gj0 left join v_gcp b on b.scene_id = p.scene_id and b.gi = gi0 and b.gj = gj0 + 1
    left join v_gcp c on c.scene_id = p.scene_id and c.gi = gi0 + 1 and c.gj = gj0 left join v_gcp d on d.scene_id = p.scene_id and d.gi = gi0 + 1 and d.gj = gj0 + 1""",
)
def gcp_pixel_to_latlon(t):
    out = tiles.gcp_pixel_to_latlon(t.sql(PIXELS), t.v_gcp, t.sql(SHAPES))
    none = F.lit(999.0)
    return out.select(
        "l_orderkey", "l_linenumber",
        F.coalesce(rounded(F.col("lat")), none).alias("lat"), F.coalesce(rounded(F.col("lon")), none).alias("lon"),
    )


_G = "cast(substr(scene_id, 2) as bigint)"


def _plane(v, y, x):
    if v == "lat":
        return f"30e0 + {y} / 24.75e0 * 0.1e0 + {x} / 24.75e0 * 0.01e0 + {_G} % 7"
    return f"-10e0 + {x} / 24.75e0 * 0.1e0 - {y} / 24.75e0 * 0.02e0 + {_G} % 5"


def _side(v, s, y, x):
    half = "-0.025e0" if s == "min" else "0.025e0"
    return f"case when scene_id like 'G%' then {r(_plane(v, y, x), 5)} else {half} end as {v}_{s}"


@query(
    "tile_geo_bbox",
    f"""select scene_id, tile_no, {_side('lat', 'min', 'y', 'x')}, {_side('lon', 'min', '(y1 - 1)', 'x')}, {_side('lat', 'max', '(y1 - 1)', '(x1 - 1)')}, {_side('lon', 'max', 'y', '(x1 - 1)')} from (
      select *, cast(y // 16 * ceil(width / 16e0) + x // 16 as bigint) as tile_no, least(y + 32, height) as y1, least(x + 32, width) as x1 from (
      select *, unnest(range(0, width, 16)) as x from (select *, unnest(range(0, height, 16)) as y from ({SHAPES_X}) d) q) z) w""",
)
def tile_geo_bbox(t):
    shapes = t.sql(SHAPES_X)
    out = tiles.tile_geo_bbox(tiles.tile_grid(shapes, 32, 0.5), t.v_gcp, shapes)
    return out.select("scene_id", "tile_no", *[F.when(F.col("scene_id").startswith("G"), rounded(F.col(c), 5)).otherwise(F.col(c)).alias(c) for c in ("lat_min", "lon_min", "lat_max", "lon_max")])


@query(
    "gcp_affine_fit",
    f"""select scene_id, {r('avg(lat) - regr_slope(lat, line) * avg(line) - regr_slope(lat, pixel) * avg(pixel)')} as lat_0, {r('regr_slope(lat, line)', 9)} as lat_line, {r('regr_slope(lon, pixel)', 9)} as lon_pixel from v_gcp group by scene_id""",
)
def gcp_affine_fit(t):
    out = tiles.gcp_affine_fit(t.v_gcp)
    return out.select("scene_id", rounded(F.col("lat_0")).alias("lat_0"), rounded(F.col("lat_line"), 9).alias("lat_line"), rounded(F.col("lon_pixel"), 9).alias("lon_pixel"))


NOTED = "select *, case when tile_no % 5 = 0 and s % 3 <> 1 then tile_no % 11 else 0 end as n_annotations from v_tiles"


@query("manifest_totals", "select scene_id, count(*) as total_tiles, count(*) filter (where tile_no % 3 <> 0) as valid_tiles, count(*) filter (where tile_no % 3 = 0) as skipped_nodata from v_tiles group by scene_id")
def manifest_totals(t):
    return tiles.manifest_totals(t.v_tiles.withColumn("skipped", F.col("tile_no") % 3 == 0))


STATES = "select scene_id, s, case s % 5 when 0 then 'complete' when 1 then 'running' when 3 then 'complete' when 4 then 'complete' end as status from v_scenes"
SEEN = "select scene_id, tile_no, case when s % 5 = 4 then 120e0 else lat_min end as lat_min, n_annotations from (" + NOTED + ") n where s % 5 <> 3"


@query(
    "sanity_check",
    f"""select c.scene_id, case when status is null then 'MISSING' when status <> 'complete' then 'INCOMPLETE' when coalesce(n, 0) = 0 then 'EMPTY' when c.s % 5 = 4 then 'OUT OF BOUNDS' else 'OK' end as verdict,
    coalesce(n, 0) as n_tiles, coalesce(k, 0) as annotated from ({STATES}) c left join (select scene_id, count(*) as n, count(*) filter (where n_annotations > 0) as k from ({SEEN}) t group by scene_id) a on a.scene_id = c.scene_id""",
)
def sanity_check(t):
    return tiles.sanity_check(t.sql(STATES), t.sql(SEEN))


RESULTS = "select case user_id % 3 when 0 then 'ok' when 1 then 'skipped' else 'failed' end as status, user_id as tiles from events"


@query("batch_status_summary", f"select count(*) filter (where status = 'ok') as ok, count(*) filter (where status = 'skipped') as skipped, count(*) filter (where status = 'failed') as failed, sum(tiles) as total_tiles from ({RESULTS}) q")
def batch_status_summary(t):
    return tiles.batch_status_summary(t.sql(RESULTS))


@query("limit_tiles_per_scene", "select scene_id, tile_id from (select *, row_number() over (partition by scene_id order by tile_no, tile_id) as rn from v_tiles) z where rn <= 9")
def limit_tiles_per_scene(t):
    return tiles.limit_tiles_per_scene(t.v_tiles, 9).select("scene_id", "tile_id")


@query(
    "sample_tiles_per_scene",
    f"""select scene_id, tile_id from (select *, row_number() over (partition by scene_id order by turn, tile_no, tile_id) as place from (
      select *, case when rn <= 12 then 0 else 1 end as turn from (select *, row_number() over (partition by scene_id order by tile_no, tile_id) as rn from ({NOTED}) n) a where rn <= 12 or n_annotations > 0) b) z where place <= 24""",
)
def sample_tiles_per_scene(t):
    return tiles.sample_tiles_per_scene(t.sql(NOTED)).select("scene_id", "tile_id")


@query(
    "most_annotated_tile",
    f"""select scene_id, tile_id from (select *, max(n_annotations) over (partition by scene_id) as most, count(*) over (partition by scene_id) as n, row_number() over (partition by scene_id order by tile_no, tile_id) as rn,
      row_number() over (partition by scene_id order by n_annotations desc, tile_no) as best from ({NOTED}) q) z where (most > 0 and best = 1) or (most = 0 and rn = n // 2 + 1)""",
)
def most_annotated_tile(t):
    return tiles.most_annotated_tile(t.sql(NOTED)).select("scene_id", "tile_id")


@query(
    "sample_empty_tiles",
    f"""select scene_id, tile_id, selection_reason from (select *, row_number() over (partition by scene_id order by h, tile_id) as place from (
      select *, case when n_annotations > 0 then 'gfw_annotation' else 'empty_control_sample' end as selection_reason, row_number() over (partition by scene_id, n_annotations > 0 order by h, tile_id) as rn from (
      select *, md5(concat(tile_id, '|', 'tiles-1')) as h from ({NOTED}) n) a) b where n_annotations > 0 or rn <= 80) z where place <= 100""",
)
def sample_empty_tiles(t):
    return tiles.sample_empty_tiles(t.sql(NOTED), "tiles-1", cap=100).select("scene_id", "tile_id", "selection_reason")
