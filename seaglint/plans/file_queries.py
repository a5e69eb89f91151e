"""File readers over files that tasks write from the given tables."""

from pyspark.sql import functions as F

from seaglint.plans.registry import query
from seaglint.sources import files, sinks
from seaglint.streaming.jobs import work_folder


def _landed(t, body: str, name: str) -> str:
    """Folder with the files (path, content) of a query."""
    root = work_folder(t.spark, name)
    sinks.write_files(t.sql(body), root)
    return root


# Label files of 256 orders each, eight to a scene; beside each fifth one an empty file. Scenes whose number
# divides by three have no images.
LINES = "select cast(floor(l_orderkey / 2048e0) as bigint) as s, cast(floor(l_orderkey / 256e0) as bigint) as k, l_orderkey, line_no as n, txt from v_lines"
LABELS = f"""select concat('scene', s, '/labels/tile', k, '.txt') as path, array_join(transform(array_sort(collect_list(struct(l_orderkey, n, txt))), x -> x.txt), '\n') as content from ({LINES}) q group by s, k
 union all select distinct concat('scene', s, '/labels/empty', k, '.txt'), '' from ({LINES}) q where k % 5 = 0"""
IMAGES = f"select distinct concat('scene', s, '/cvat_import/images/tile', k, '.png') as path, 'x' as content from ({LINES}) q where s % 3 <> 0"


@query("scan_label_files", f"select tile_id, line_no, txt from (select concat('tile', k) as tile_id, row_number() over (partition by k order by l_orderkey, n) - 1 as line_no, txt from ({LINES}) q) z where txt <> 'bad line'")
def scan_label_files(t):
    lines = files.scan_label_files(t.spark, _landed(t, LABELS, "labels"))
    return lines.withColumn("line_no", F.col("line_no").cast("bigint"))


@query(
    "list_label_files",
    f"""select concat('tile', k) as tile_id, concat('scene', s) as scene_id, cast(sum(length(txt) + 1) - 1 as bigint) as length from ({LINES}) q group by s, k
    union all select distinct concat('empty', k), concat('scene', s), 0 from ({LINES}) q where k % 5 = 0""",
)
def list_label_files(t):
    return files.list_label_files(t.spark, _landed(t, LABELS, "labels"))


@query("discover_scenes", f"select concat('scene', s) as scene_id, count(distinct k) + count(distinct case when k % 5 = 0 then k end) as n_labels, count(distinct k) as n_images, count(*) as total_boxes from ({LINES}) q where s % 3 <> 0 group by s")
def discover_scenes(t):
    root = _landed(t, f"{LABELS} union all {IMAGES}", "scenes")
    return files.discover_scenes(t.spark, root).select("scene_id", "n_labels", "n_images", "total_boxes")


# Ten lines of nodes for each scene; every other line lacks its last node.
NODES = """select cast(floor(p_partkey / 100e0) as bigint) as s, cast(floor((p_partkey % 100) / 10e0) as bigint) * 6 as line, (p_partkey % 10) * 6 as pixel, 3000 + (p_partkey % 100) * 10 as value from part
 where not (cast(floor((p_partkey % 100) / 10e0) as bigint) % 2 = 1 and p_partkey % 10 = 9)"""


def _vectors(tag: str, field: str, where: str) -> str:
    return f"""select concat('L', s, '.xml') as path, concat('<root>', array_join(collect_list(v), ''), '</root>') as content from (
      select s, concat('<{tag}><line>', line, '</line><pixel count="', count(*), '">', array_join(transform(array_sort(collect_list(struct(pixel, value))), x -> cast(x.pixel as string)), ' '), '</pixel><{field} count="', count(*), '">',
       array_join(transform(array_sort(collect_list(struct(pixel, value))), x -> cast(x.value as string)), ' '), '</{field}></{tag}>') as v from ({NODES}) q where {where} group by s, line) z group by s"""


def _exploded(vectors):
    return files.explode_vectors(vectors).select(files.stem(F.col("path")).alias("scene_id"), "line", "pixel", "value")


_NODE_ROWS = f"select concat('L', s) as scene_id, line, pixel, cast(value as double) as value from ({NODES}) q"


@query("scan_calibration_luts", _NODE_ROWS)
def scan_calibration_luts(t):
    return _exploded(files.calibration_vectors(t.spark, _landed(t, _vectors("calibrationVector", "sigmaNought", "true"), "calibration")))


@query("scan_noise_luts", _NODE_ROWS)
def scan_noise_luts(t):
    """Even scenes in the newer spelling, odd ones in the older."""
    both = f"{_vectors('noiseRangeVector', 'noiseRangeLut', 's % 2 = 0')} union all {_vectors('noiseVector', 'noiseLut', 's % 2 = 1')}"
    return _exploded(files.noise_vectors(t.spark, _landed(t, both, "noise")))


CORNERS = "concat_ws(' ', concat(lat0, ',', lon0), concat(lat0 + 2, ',', lon0 + 1), concat(lat0 - 1, ',', lon0 + 3))"


@query("scan_footprints", "select scene_id, lon0 as lon_min, lat0 - 1 as lat_min, lon0 + 3 as lon_max, lat0 + 2 as lat_max, strftime(acquired, '%Y-%m-%d') as date from v_scenes where s % 5 <> 4")
def scan_footprints(t):
    """Each fifth manifest has no coordinates and gives no row."""
    body = f"select concat(scene_id, '.SAFE/manifest.safe') as path, concat('<a><gml:coordinates>', case when s % 5 = 4 then '' else {CORNERS} end, '</gml:coordinates></a>') as content from v_scenes"
    return files.scan_footprints(t.spark, _landed(t, body, "safe")).withColumn("date", F.date_format("date", "yyyy-MM-dd"))


@query("scan_target_traces", "select scene_id, scene_id as folder, s % 7 as target_density_cell_index, s * 3 as ais_count from v_scenes")
def scan_target_traces(t):
    body = """select concat(scene_id, '.SAFE/target_trace.json') as path, to_json(struct(scene_id, s % 7 as target_density_cell_index, s * 3 as ais_count, 'p' as protocol)) as content from v_scenes
     union all select distinct 'target_trace.json', '{"scene_id": "beside"}' from v_scenes"""
    return files.scan_target_traces(t.spark, _landed(t, body, "traces")).select("scene_id", "folder", "target_density_cell_index", "ais_count")


SETS = "select 40000 + s_suppkey as norad, concat('SAT ', s_suppkey) as name, s_suppkey % 2 = 0 as listed, s_suppkey % 7 = 3 as broken from supplier"


@query("scan_tle_sets", f"select norad as norad_id, name, case when listed then 'satnogs' else 'celestrak' end as source from ({SETS}) q where not broken")
def scan_tle_sets(t):
    """Lists for even numbers, three-line files for odd ones; some second lines are broken."""
    body = f"""select concat(case when listed then 'lists/' else 'texts/' end, norad, case when listed then '.json' else '.txt' end) as path,
      case when listed then concat('[{{"tle0":"0 ', name, '","tle1":"1 ', norad, 'U","tle2":"', case when broken then 'X' else concat('2 ', norad) end, '"}}]')
       else concat(name, '\r\n1 ', norad, 'U\n', case when broken then 'X' else concat('2 ', norad) end, '\n') end as content from ({SETS}) q"""
    root = _landed(t, body, "tle")
    return files.scan_tle_sets(t.spark, f"{root}/lists", f"{root}/texts").select("norad_id", "name", "source")


@query("scan_tile_manifests", "select scene_id, 'D' as pipeline, tile_id, lat_min, lon_min, lat_max, lon_max from v_tiles")
def scan_tile_manifests(t):
    body = """select concat(scene_id, '/D/metadata.json') as path, to_json(struct(scene_id, 'D' as pipeline, 512 as tile_size,
      collect_list(struct(tile_id, scene_id, 'D' as pipeline, array(0, 0, 512, 512) as pixel_bbox, array(lat_min, lon_min, lat_max, lon_max) as geo_bbox, concat(tile_id, '.npy') as npy_path)) as tiles)) as content from v_tiles group by scene_id"""
    found = files.scan_tile_manifests(t.spark, _landed(t, body, "manifests"))
    return found.select("scene_id", "pipeline", "tile_id", "lat_min", "lon_min", "lat_max", "lon_max")


SPLIT = "select case when l_orderkey % 10 < 7 then 'train' when l_orderkey % 10 = 7 then 'val' else 'test' end as split, l_orderkey from lineitem"


@query(
    "dataset_yaml_summary",
    f"select count(distinct l_orderkey) as total_images, count(*) as total_boxes, count(distinct case when split = 'train' then l_orderkey end) as train, count(distinct case when split = 'val' then l_orderkey end) as val, count(distinct case when split = 'test' then l_orderkey end) as test from ({SPLIT}) q",
)
def dataset_yaml_summary(t):
    rows = t.sql(f"select coalesce(split, 'ALL') as split, 'ALL' as scene_id, count(distinct l_orderkey) as images, count(*) as boxes from ({SPLIT}) q group by rollup(split)")
    root = work_folder(t.spark, "dataset")
    sinks.dataset_yaml(rows, f"{root}/data.yaml", f"{root}/dataset_summary.json")
    back = t.spark.read.schema("total_images bigint, total_boxes bigint, split struct<train:bigint,val:bigint,test:bigint>").option("multiLine", True).json(f"{root}/dataset_summary.json")
    return back.select("total_images", "total_boxes", "split.*")
