"""Catalogue: duplicates, selection, lookups, traces, regions."""

from pyspark.sql import functions as F

from seaglint.operators import ais, catalogue
from seaglint.operators.ranking import top_per_group
from seaglint.sources import files, sinks
from seaglint.streaming.jobs import work_folder
from seaglint.plans.registry import query, r, rounded

BASE = "case when upper(p[-1]) = 'COG' then concat(p[-4], '_', p[-3], '_', p[-2]) else concat(p[-3], '_', p[-2], '_', p[-1]) end"
WITH_BASE = f"select *, {BASE} as base_id from (select *, string_split(name, '_') as p from v_products) q"


@query("scan_catalogue", "select cast(id as varchar) as id, case when id % 5 = 0 then '' else name end as name, case when id % 7 = 0 then 0 else size end as size from v_products")
def scan_catalogue(t):
    """Answers of a hundred products each, landed as files; missing fields get defaults."""
    answers = """select concat('page', page, '.json') as path, concat('{"value":[', array_join(collect_list(p), ','), ']}') as content from (
      select cast(floor(id / 100e0) as bigint) as page, to_json(named_struct('Id', cast(id as string), 'Name', case when id % 5 <> 0 then name end, 'ContentLength', case when id % 7 <> 0 then size end)) as p from v_products) q group by page"""
    root = work_folder(t.spark, "catalogue")
    sinks.write_files(t.sql(answers), root)
    return files.scan_catalogue(t.spark, root).select("id", "name", "size")


@query(
    "cog_dedupe",
    """select id, name from (select *, max(case when name like '%\\_COG%' escape '\\' then 1 else 0 end) over (partition by b7) as any_cog, row_number() over (partition by b7 order by id) as rn
    from (select *, case when len(string_split(name, '_')) >= 8 then array_to_string(string_split(name, '_')[1:7], '_') else name end as b7 from v_products) q) z
    where (any_cog = 1 and name like '%\\_COG%' escape '\\') or (any_cog = 0 and rn = 1)""",
)
def cog_dedupe(t):
    return catalogue.cog_dedupe(t.v_products).select("id", "name")


@query("dedupe_scenes_keep_first", f"select id, name from (select id, name, row_number() over (partition by base_id order by id) as rn from ({WITH_BASE}) b) z where rn = 1")
def dedupe_scenes_keep_first(t):
    return catalogue.dedupe_scenes(t.v_products, F.col("id")).select("id", "name")


@query("unique_base_ids", f"select distinct base_id from ({WITH_BASE}) b")
def unique_base_ids(t):
    return catalogue.unique_base_ids(t.v_products)


HELD = "select distinct name from v_products where date < timestamp '1996-01-01 00:00:00'"


@query(
    "new_scenes_anti",
    f"select id from ({WITH_BASE}) b where base_id not in (select base_id from ({WITH_BASE}) h where date < timestamp '1996-01-01 00:00:00')",
)
def new_scenes_anti(t):
    return catalogue.new_scenes(t.v_products, t.sql(HELD)).select("id")


MANIFESTS = "select scene_id, case when tile_no < 128 then 'D' else 'C' end as pipeline, count(*) as n, sum(case when s % 2 = 0 then 1 else 0 end) as tiles from v_tiles group by 1, 2"


@query("unprocessed_scenes_anti", "select scene_id from v_scenes where s % 2 <> 0")
def unprocessed_scenes_anti(t):
    return catalogue.unprocessed_scenes(t.v_scenes, t.sql(MANIFESTS), "D").select("scene_id")


@query(
    "union_regions",
    f"""select id, region from (select *, row_number() over (partition by base_id order by region, id) as rn from (
      select id, base_id, 'atlantic' as region from ({WITH_BASE}) b where lon_max <= -8 union all select id, base_id, 'north' from ({WITH_BASE}) b where lat_min >= 30) u) z where rn = 1""",
)
def union_regions(t):
    p = t.v_products
    both = p.where("lon_max <= -8").withColumn("region", F.lit("atlantic")).unionByName(
        p.where("lat_min >= 30").withColumn("region", F.lit("north"))
    )
    return catalogue.dedupe_scenes(both, F.struct("region", "id")).select("id", "region")


SEASONS = """select * from (values ('winter', 'W95', date '1995-01-01', date '1995-03-31', 40), ('summer', 'S96', date '1996-06-01', date '1996-08-31', 25), ('late', 'L01', date '2001-07-15', date '2001-09-30', 500)) v(season, label, date_start, date_end, count)"""


@query(
    "sample_scenes_per_season",
    f"""select id, season, label, date_range from (select id, season, label, concat(cast(date_start as varchar), '/', cast(date_end as varchar)) as date_range, count,
      row_number() over (partition by season order by md5(concat(name, '|', 'seed-1')), name, id) as rn from v_products p join ({SEASONS}) s on cast(date as date) between date_start and date_end) z where rn <= count""",
)
def sample_scenes_per_season(t):
    return catalogue.sample_per_season(t.v_products, t.sql(SEASONS), "seed-1").select("id", "season", "label", "date_range")


@query("max_scenes_limit", f"select id from (select id, row_number() over (partition by base_id order by id) as rn from ({WITH_BASE}) b) z where rn = 1 order by id limit 20")
def max_scenes_limit(t):
    return catalogue.dedupe_scenes(t.v_products, F.col("id")).orderBy("id").limit(20).select("id")


@query("product_per_region", "select id, lon_min from (select id, lon_min, row_number() over (partition by lon_min order by date desc, id) as rn from v_products) z where rn <= 3")
def product_per_region(t):
    return top_per_group(t.v_products, ["lon_min"], [F.desc("date"), F.asc("id")], 3).select("id", "lon_min")


STATUS = "select cast(lon_min as string) as region, size, case b % 4 when 0 then 'downloaded' when 1 then 'already_downloaded' when 2 then 'failed' else 'skipped_no_ais' end as status from v_products"


@query(
    "region_summary",
    f"""select region, count(*) filter (where status in ('downloaded', 'already_downloaded')) as successful, count(*) filter (where status = 'failed') as failed, sum(size) / 1073741824e0 as total_size_gb from ({STATUS}) q group by region""",
)
def region_summary(t):
    return catalogue.region_summary(t.sql(STATUS))


@query(
    "resolve_scene",
    f"""with h as (select distinct name, base_id from ({WITH_BASE}) b where b.id % 3 = 0)
    select p.id, coalesce((select min(h.name) from h where h.name = p.name), m.least, '?') as held_scene from ({WITH_BASE}) p left join (select base_id, min(name) as least from h group by base_id) m on m.base_id = p.base_id""",
)
def resolve_scene(t):
    held = t.sql("select name from v_products where name like '%COG'")
    return catalogue.resolve_scene(t.v_products, held).select("id", F.coalesce("held_scene", F.lit("?")).alias("held_scene"))


TRACES = "select scene_id, arrival as written_at, arrival * 7 % 500 as target_density_cell_index, vessel_count as ais_count from v_events"


@query(
    "write_traces_index",
    f"select scene_id, target_density_cell_index, ais_count from (select *, row_number() over (partition by scene_id order by written_at desc) as rn from ({TRACES}) q) z where rn = 1",
)
def write_traces_index(t):
    rows = t.sql(TRACES)
    middle = F.lit(5000)
    stored, later = rows.where(F.col("written_at") < middle), rows.where(F.col("written_at") >= middle)
    return catalogue.write_traces_index(stored, later).select("scene_id", "target_density_cell_index", "ais_count")


# --- density map -------------------------------------------------------------------------

CELLS = """select cast(ci * 18 + cj as bigint) as cell_index, -17e0 + ci * 0.5e0 as lon_min, 27e0 + cj * 0.5e0 as lat_min, -17e0 + ci * 0.5e0 + 0.5e0 as lon_max, 27e0 + cj * 0.5e0 + 0.5e0 as lat_max, count(*) as ais_count
 from (select least(31, cast(trunc((lon - -17e0) / 0.5e0) as int)) as ci, least(17, cast(trunc((lat - 27e0) / 0.5e0) as int)) as cj from v_ais where lon between -17e0 and -1e0 and lat between 27e0 and 36e0) q group by ci, cj"""
RANKED = f"select *, row_number() over (order by ais_count desc, cell_index, lon_min) as density_rank from ({CELLS}) c"
SCENE_BOX = "select scene_id, min(lon_min) as lon_min, min(lat_min) as lat_min, max(lon_max) as lon_max, max(lat_max) as lat_max from v_tiles group by scene_id"
ROUND_CELL = "cell_index, {}".format(", ".join(f"{r(c)} as {c}" for c in ("lon_min", "lat_min", "lon_max", "lat_max")))


def _cells(t):
    return ais.density_map(t.v_ais)


def _ranked(t):
    return ais.density_rank(_cells(t))


@query("ais_density_map", f"select {ROUND_CELL}, ais_count from ({CELLS}) c")
def ais_density_map(t):
    return _cells(t).select("cell_index", *[rounded(F.col(c)).alias(c) for c in ("lon_min", "lat_min", "lon_max", "lat_max")], "ais_count")


@query("density_rank", f"select cell_index, density_rank from ({RANKED}) r")
def density_rank(t):
    return _ranked(t).select("cell_index", "density_rank")


@query("top_density_cells", f"select cell_index, ais_count from ({CELLS}) c order by ais_count desc, cell_index, lon_min limit 5")
def top_density_cells(t):
    return ais.top_density_cells(_cells(t)).select("cell_index", "ais_count")


@query(
    "nearest_cell",
    f"""select id, cell_index, density_rank from (select p.id, r.cell_index, r.density_rank, row_number() over (partition by p.id order by
      round(power((r.lon_min + r.lon_max) / 2 - (p.lon_min + p.lon_max) / 2, 2) + power((r.lat_min + r.lat_max) / 2 - (p.lat_min + p.lat_max) / 2, 2), 9), r.density_rank) as rn
      from v_products p, ({RANKED}) r) z where rn = 1""",
)
def nearest_cell(t):
    return ais.nearest_cell(t.v_products, _ranked(t)).select("id", "cell_index", "density_rank")


@query(
    "scene_cell_overlap",
    f"""select id, {r('case when dx > 0 and dy > 0 then dx * dy / ((lon_max - lon_min) * (lat_max - lat_min)) * 100e0 else 0 end')} as overlap_percent from (
      select p.*, least(p.lon_max, r.lon_max) - greatest(p.lon_min, r.lon_min) as dx, least(p.lat_max, r.lat_max) - greatest(p.lat_min, r.lat_min) as dy from v_products p, (select * from ({RANKED}) q where density_rank = 1) r) z""",
)
def scene_cell_overlap(t):
    return ais.scene_cell_overlap(t.v_products, _ranked(t)).select("id", rounded(F.col("overlap_percent")).alias("overlap_percent"))


@query(
    "cell_product_candidates",
    f"""select density_rank, cell_index, product_id from (select r.density_rank, r.cell_index, p.id as product_id, row_number() over (partition by r.density_rank order by p.date desc, p.id) as rn
      from (select * from ({RANKED}) q where density_rank <= 5) r, v_products p where p.lon_min <= r.lon_max and p.lon_max >= r.lon_min and p.lat_min <= r.lat_max and p.lat_max >= r.lat_min) z where rn <= 5""",
)
def cell_product_candidates(t):
    return catalogue.top_products_for_cells(_ranked(t), t.v_products).select("density_rank", "cell_index", "product_id")


def choice_sql(n, per_cell):
    """The choice as a recursive query: one cell a step, with the list of base ids taken so far."""
    return f"""with recursive cand as (select *, row_number() over (partition by density_rank order by date desc, id) as rn
      from (select r.density_rank, r.cell_index, p.id, p.name, p.date, p.base_id from (select * from ({RANKED}) q where density_rank <= {n}) r, ({WITH_BASE}) p where p.lon_min <= r.lon_max and p.lon_max >= r.lon_min and p.lat_min <= r.lat_max and p.lat_max >= r.lat_min) z),
    cells as (select density_rank, cell_index, row_number() over (order by density_rank) as pos, list({{'id': id, 'name': name, 'base': base_id}} order by rn) as cands from cand where rn <= {per_cell} group by density_rank, cell_index),
    pick as (select cast(0 as bigint) as pos, cast([] as varchar[]) as taken, cast(null as bigint) as density_rank, cast(null as bigint) as cell_index, cast(null as varchar) as product_id, cast(null as varchar) as name
      union all select pos, list_append(taken, p.base), density_rank, cell_index, cast(p.id as varchar), p.name from (select c.pos, t.taken, c.density_rank, c.cell_index, coalesce(list_filter(c.cands, lambda x: not list_contains(t.taken, x.base))[1], c.cands[1]) as p from pick t join cells c on c.pos = t.pos + 1) s)
    select density_rank, cell_index, product_id, name from pick where pos > 0"""


@query("cell_product_join", choice_sql(5, 5))
def cell_product_join(t):
    return catalogue.cell_product_join(_ranked(t), t.v_products).select("density_rank", "cell_index", "product_id", "name")


@query("cell_product_repeats", choice_sql(40, 2))
def cell_product_repeats(t):
    """Many cells with two candidates each: some find both taken and repeat their newest."""
    return catalogue.cell_product_join(_ranked(t), t.v_products, 40, 2).select("density_rank", "cell_index", "product_id", "name")
