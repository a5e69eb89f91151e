"""Radar tiles: long-form rules, array jobs, assembled windows."""

from pyspark.sql import functions as F

from seaglint.operators import detect, evaluate, labels, raster
from seaglint.plans import flows
from seaglint.plans.registry import query, r, rounded

# Ten by ten nodes, six pixels apart: the last rows and columns of a tile lie beyond them.
LUT = "select concat('L', cast(cast(floor(p_partkey / 100e0) as bigint) as string)) as scene_id, cast(floor((p_partkey % 100) / 10e0) as bigint) * 6 as line, (p_partkey % 10) * 6 as pixel, 3000e0 + (p_partkey % 100) * 10e0 as value from part"
POINTS = "select concat('L', cast(tile as string)) as scene_id, tile, y as line, x as pixel, dn from v_pixels"
PLANE = "(3000e0 + 100e0 * (y / 6e0) + 10e0 * (x / 6e0))"
HAS_LUT = "tile in (select cast(floor(p_partkey / 100e0) as bigint) from part)"
SIGMA = f"(dn * 1e0 * dn / ({PLANE} * {PLANE}))"
DB = "(10e0 * log10({} + 1e-10))"
BYTE = "cast(trunc((least(0e0, greatest(-30e0, {})) + 30e0) / 30e0 * 255e0) as bigint)"


def lee_sql(source):
    """Lee filter by direct neighbour look-up (``source``: tile, y, x, v)."""

    def mirror(c, d, n):
        return f"case when {c} + {d} < 0 then -({c} + {d}) - 1 when {c} + {d} >= {n} then 2 * {n} - 1 - ({c} + {d}) else {c} + {d} end"

    return f"""select tile, y, x, mean + case when greatest(var, nv) > 0 then greatest(var - nv, 0) / greatest(var, nv) else 0 end * (v - mean) as lee from (
      select *, avg(var) over (partition by tile) as nv from (select tile, y, x, any_value(v) as v, sum(n) / 25e0 as mean, greatest(sum(n * n) / 25e0 - (sum(n) / 25e0) * (sum(n) / 25e0), 0) as var from (
      select p.tile, p.y, p.x, p.v, q.v as n from (select *, {mirror('y', 'dy', 'h')} as yy, {mirror('x', 'dx', '64')} as xx from (select s.*, max(y) over (partition by tile) + 1 as h from ({source}) s) b, range(-2, 3) a(dy), range(-2, 3) c(dx)) p
      join ({source}) q on q.tile = p.tile and q.y = p.yy and q.x = p.xx) w group by tile, y, x) v) u"""


def _points(t):
    return t.sql(POINTS)


def _with_lut(t):
    return raster.lut_interpolate(_points(t), t.sql(LUT)).withColumnsRenamed({"line": "y", "pixel": "x"})


@query("lut_interpolate", f"select tile, y, x, case when {HAS_LUT} then {r(PLANE)} end as lut from v_pixels")
def lut_interpolate(t):
    return _with_lut(t).select("tile", "y", "x", rounded(F.col("lut")).alias("lut"))


@query("calibrate_sigma0", f"select tile, y, x, {r('log10(greatest(dn * 1e0 * dn - 5000e0 * (x % 3), 0) / power(case when y % 7 = 0 then 1e-10 else 3000e0 + x end, 2))')} as log_sigma0 from v_pixels")
def calibrate_sigma0(t):
    lut = F.when(F.col("y") % 7 == 0, F.lit(0.0)).otherwise(F.lit(3000.0) + F.col("x"))
    s = raster.calibrate_sigma0(F.col("dn"), lut, F.lit(5000.0) * (F.col("x") % 3))
    return t.v_pixels.select("tile", "y", "x", rounded(F.log10(s)).alias("log_sigma0"))


@query("to_db", f"select tile, y, x, {r(DB.format('dn / 1000e0'))} as db, {r('10e0 * log10(greatest(dn / 1000e0 - 0.9e0, 1e-10))')} as floored from v_pixels")
def to_db(t):
    v = F.col("dn") / 1000.0
    return t.v_pixels.select("tile", "y", "x", rounded(raster.to_db(v)).alias("db"), rounded(raster.to_db(v - 0.9, True)).alias("floored"))


@query("db_to_uint8", f"select tile, y, x, {BYTE.format('(dn / 30e0 - 40e0)')} as v from v_pixels")
def db_to_uint8(t):
    return t.v_pixels.select("tile", "y", "x", raster.db_to_uint8(F.col("dn") / 30.0 - 40.0).cast("bigint").alias("v"))


HOLED = "select tile, y, x, case when x < 10 * tile then 0 else dn end as v from v_pixels"


@query("nodata_filter", f"select tile, {r('avg(case when v = 0 then 1e0 else 0e0 end)')} as zero_share from ({HOLED}) q group by tile having avg(case when v = 0 then 1e0 else 0e0 end) <= 0.3e0")
def nodata_filter(t):
    return labels.nodata_filter(t.sql(HOLED), ["tile"]).withColumn("zero_share", rounded(F.col("zero_share")))


@query("image_nodata_filter", f"select tile, y from ({HOLED}) q group by tile, y having avg(case when v = 0 then 1e0 else 0e0 end) <= 0.3e0")
def image_nodata_filter(t):
    return labels.nodata_filter(t.sql(HOLED), ["tile", "y"]).select("tile", "y")


@query(
    "percentile_stretch",
    "select p.tile, y, x, cast(trunc((least(hi, greatest(lo, dn * 1e0)) - lo) / (hi - lo) * 255e0) as bigint) as stretched from v_pixels p join (select tile, quantile_cont(dn, 0.01) as lo, quantile_cont(dn, 0.99) as hi from v_pixels group by tile) b on b.tile = p.tile",
)
def percentile_stretch(t):
    return raster.percentile_stretch(t.v_pixels, ["tile"], "dn").select("tile", "y", "x", F.col("stretched").cast("bigint").alias("stretched"))


LEVELS = "select tile, y, x, dn % 256 as v from v_pixels"


@query("cdf_equalize", f"select q.tile, y, x, e as equalized from ({LEVELS}) q join (select tile, v, cast(trunc(sum(n) over (partition by tile order by v) * 255e0 / sum(n) over (partition by tile)) as bigint) as e from (select tile, v, count(*) as n from ({LEVELS}) a group by tile, v) b) h on h.tile = q.tile and h.v = q.v")
def cdf_equalize(t):
    out = raster.cdf_equalize(t.sql(LEVELS), ["tile"])
    return out.select("tile", "y", "x", F.col("equalized").cast("bigint").alias("equalized"))


LEE = f"select tile, y, x, {r('lee', 5)} as lee from ({lee_sql('select tile, y, x, dn as v from v_pixels')}) z"


@query("lee_long", LEE)
def lee_long(t):
    return raster.lee_long(t.v_pixels, value="dn").select("tile", "y", "x", rounded(F.col("lee"), 5).alias("lee"))


def packed(t):
    """Tile table of the pixel view, one row per tile."""
    rows = t.sql("select cast(vec_id div 64 as bigint) as tile, cast(vec_id % 64 as int) as y, transform(embedding, e -> cast(floor((cast(e as double) + 1e0) * 1000e0) as int)) as values from embeddings")
    return raster.pack_tiles(rows, ["tile"]).withColumn("tile_id", F.col("tile").cast("string"))


def windows(t):
    """The same with window columns: each tile is its own scene without a halo."""
    zero, w, h = F.lit(0), F.col("w"), F.col("h")
    return packed(t).select(
        F.concat(F.lit("L"), "tile_id").alias("scene_id"), "tile_id", F.col("tile").alias("tile_no"),
        *[v.alias(n) for v, n in ((zero, "y0"), (h, "y1"), (zero, "x0"), (w, "x1"), (zero, "py0"), (h, "py1"), (zero, "px0"), (w, "px1"))],
        "h", "w", "dtype", "data",
    )


def vectors(t):
    return t.sql(LUT).groupBy("scene_id", "line").agg(F.sort_array(F.collect_list(F.struct("pixel", "value"))).alias("n")).select(
        "scene_id", "line", F.transform("n", lambda s: s["pixel"]).alias("pixels"), F.transform("n", lambda s: s["value"]).alias("values")
    )


@query("lee_filter", LEE)
def lee_filter(t):
    """Array form; the filtered values travel as text-free bytes scaled to whole numbers."""
    import numpy as np

    scaled = raster.map_tiles(packed(t), lambda a: np.floor(raster.lee_filter(a.astype(float)) * 1e5 + 0.5).astype("int64"))
    return raster.unpack_tiles(scaled, ["tile_id"]).select(F.col("tile_id").cast("bigint").alias("tile"), "y", "x", (F.col("v") / 1e5).alias("lee"))


def _chain(t, code):
    out = raster.run_chains(windows(t), vectors(t), None, (code,))
    return raster.unpack_tiles(out, ["tile_no"]).select(F.col("tile_no").alias("tile"), "y", "x", "v")


@query("chain_a", "select p.tile, y, x, cast(trunc((least(hi, greatest(lo, dn * 1e0)) - lo) / (hi - lo) * 255e0) as bigint) as v from v_pixels p join (select tile, quantile_cont(dn, 0.01) as lo, quantile_cont(dn, 0.99) as hi from v_pixels group by tile) b on b.tile = p.tile")
def chain_a(t):
    return _chain(t, "A")


@query("uncalibrated_tiles", f"select distinct tile from v_pixels where not {HAS_LUT} or tile = 1")
def uncalibrated_tiles(t):
    """Tiles that chains B to E cannot process; the table of scene L1 is left out here."""
    return raster.uncalibrated(windows(t), vectors(t).where(F.col("scene_id") != "L1")).select(F.col("tile_no").alias("tile"))


@query("chain_b", f"select tile, y, x, {BYTE.format(DB.format(SIGMA))} as v from v_pixels where {HAS_LUT}")
def chain_b(t):
    return _chain(t, "B")


LEE_SIGMA = lee_sql(f"select tile, y, x, {SIGMA} as v from v_pixels where {HAS_LUT}")


@query("chain_c", f"select tile, y, x, {BYTE.format(DB.format('lee'))} as v from ({LEE_SIGMA}) z")
def chain_c(t):
    return _chain(t, "C")


@query(
    "chain_d",
    f"""with s as (select tile, y, x, cast(trunc((db - lo) / (hi - lo) * 255e0) as bigint) as v from (select *, min(db) over (partition by tile) as lo, max(db) over (partition by tile) as hi from (select tile, y, x, {DB.format('lee')} as db from ({LEE_SIGMA}) z) a) b)
    select s.tile, y, x, e as v from s join (select tile, v, cast(trunc(sum(n) over (partition by tile order by v) * 255e0 / sum(n) over (partition by tile)) as bigint) as e from (select tile, v, count(*) as n from s group by tile, v) c) h on h.tile = s.tile and h.v = s.v""",
)
def chain_d(t):
    return _chain(t, "D")


@query("chain_e")
def chain_e(t):
    return _chain(t, "E")


@query("enhance_tiles")
def enhance_tiles(t):
    """Named operations on finished D tiles, as a job of its own."""
    done = raster.run_chains(windows(t), vectors(t), None, ("D",))
    out = raster.enhance_tiles(done, ["clahe", "blur", "median"])
    return raster.unpack_tiles(out, ["tile_id"]).groupBy("tile_id").agg(F.count("*").alias("n"), F.avg("v").alias("mean"))


SCENE = "select concat('B', cast(cast(floor(vec_id / 256e0) as bigint) as string)) as scene_id, vec_id % 256 as y from embeddings"
SIZE, STRIDE, HALO, BLOCK = 64, 32, 4, 32


def blocks(t):
    return _cut_blocks(t.sql(
        "select concat('B', cast(vec_id div 256 as string)) as scene_id, cast(vec_id % 256 as int) as sy, transform(embedding, e -> cast(floor((cast(e as double) + 1e0) * 1000e0) as int)) as line from embeddings"
    ))


def _cut_blocks(rows):
    """Lines of scenes as square blocks."""
    shape = rows.groupBy("scene_id").agg((F.max("sy") + 1).alias("height")).withColumn("width", F.lit(64))
    cut = rows.withColumn("bx", F.explode(F.array(F.lit(0), F.lit(1)))).select(
        "scene_id", F.floor(F.col("sy") / BLOCK).cast("int").alias("by"), "bx", (F.col("sy") % BLOCK).alias("y"),
        F.slice("line", F.col("bx") * BLOCK + 1, BLOCK).alias("values"),
    )
    return raster.pack_tiles(cut, ["scene_id", "by", "bx"]).join(shape, "scene_id")


def assembled(t):
    return raster.assemble_windows(blocks(t), SIZE, STRIDE, HALO, BLOCK)


@query(
    "tile_window_assembly",
    f"""with shape as (select scene_id, max(y) + 1 as height from ({SCENE}) s group by scene_id),
    grid as (select *, greatest(0, y0 - {HALO}) as py0, least(height, least(y0 + {SIZE}, height) + {HALO}) as py1, greatest(0, x0 - {HALO}) as px0, least(64, least(x0 + {SIZE}, 64) + {HALO}) as px1, y0 // {STRIDE} * 2 + x0 // {STRIDE} as tile_no
      from (select *, unnest(range(0, 64, {STRIDE})) as x0 from (select *, unnest(range(0, height, {STRIDE})) as y0 from shape) a) b)
    select g.scene_id, tile_no, count(*) as n, cast(sum(dn) as bigint) as total, cast(sum(dn * ((p.y - py0) * 100 + p.x - px0)) as bigint) as placed
    from grid g join (select concat('B', cast(tile // 4 as varchar)) as scene_id, (tile % 4) * 64 + y as y, x, dn from v_pixels) p on p.scene_id = g.scene_id and p.y >= py0 and p.y < py1 and p.x >= px0 and p.x < px1 group by g.scene_id, tile_no""",
)
def tile_window_assembly(t):
    px = raster.unpack_tiles(assembled(t), ["scene_id", "tile_no"])
    return px.groupBy("scene_id", "tile_no").agg(
        F.count("*").alias("n"), F.sum("v").alias("total"), F.sum(F.col("v") * (F.col("y") * 100 + F.col("x"))).alias("placed")
    )


def scene_vectors(t):
    return vectors(t).withColumn("scene_id", F.regexp_replace("scene_id", "^L", "B"))


@query(
    "crop_halo",
    f"""with shape as (select scene_id, max(y) + 1 as height from ({SCENE}) s group by scene_id)
    select scene_id, y0 // {STRIDE} * 2 + x0 // {STRIDE} as tile_no, (least(y0 + {SIZE}, height) - y0) * (least(x0 + {SIZE}, 64) - x0) as n from (select *, unnest(range(0, 64, {STRIDE})) as x0 from (select *, unnest(range(0, height, {STRIDE})) as y0 from shape) a) b""",
)
def crop_halo(t):
    out = raster.run_chains(assembled(t), scene_vectors(t), None, ("C",))
    return out.select("scene_id", "tile_no", (F.col("h") * F.col("w")).cast("bigint").alias("n"))


_PARTS = f"""with shape as (select scene_id, max(y) + 1 as height from ({SCENE}) s group by scene_id)
    select scene_id, 'D' as code, count(*) as tiles from (select *, unnest(range(0, 64, {STRIDE})) as x0 from (select *, unnest(range(0, height, {STRIDE})) as y0 from shape) a) b"""


@query("process_scenes", f"{_PARTS} where scene_id <> 'B0' and scene_id in (select concat('B', cast(cast(floor(p_partkey / 100e0) as bigint) as varchar)) from part) group by scene_id")
def process_scenes(t):
    """Incremental batch: scenes with a manifest are skipped, the others run chain D."""
    b = blocks(t)
    scenes = b.select("scene_id").distinct()
    done = scenes.where(F.col("scene_id") == "B0").select("scene_id", F.lit("D").alias("pipeline"), F.lit(3).alias("tiles"))
    out = flows.process_scenes(scenes, done, b, scene_vectors(t), None, "D", size=SIZE, stride=STRIDE, halo=HALO, block=BLOCK)
    return out.groupBy("scene_id", "code").agg(F.count("*").alias("tiles"))


#: Every third scene has empty lines at its top; every second one a trace.
GAP = "(cast(floor({s}) as bigint) % 3 = 1 and {y} < 96)"
_HELD = "(select concat('B', cast(cast(floor(p_partkey / 100e0) as bigint) as varchar)) from part)"
_GRID = f"""(select scene_id, y0, x0, y0 // {STRIDE} * 2 + x0 // {STRIDE} as tile_no, greatest(0, y0 - {HALO}) as py0, least(height, least(y0 + {SIZE}, height) + {HALO}) as py1, greatest(0, x0 - {HALO}) as px0, least(64, least(x0 + {SIZE}, 64) + {HALO}) as px1
   from (select *, unnest(range(0, 64, {STRIDE})) as x0 from (select *, unnest(range(0, height, {STRIDE})) as y0 from (select scene_id, max(y) + 1 as height from ({SCENE}) s group by scene_id) s) a) b)"""


@query(
    "process_scenes_committed",
    f"""with empty as (select g.scene_id, tile_no, avg(case when dn = 0 or {GAP.format(s='tile // 4', y='(tile % 4) * 64 + y')} then 1e0 else 0e0 end) as share
      from {_GRID} g join (select *, concat('B', cast(tile // 4 as varchar)) as scene_id from v_pixels) p on p.scene_id = g.scene_id and (tile % 4) * 64 + p.y >= py0 and (tile % 4) * 64 + p.y < py1 and p.x >= px0 and p.x < px1 group by g.scene_id, tile_no),
    scenes as (select scene_id, cast(substr(scene_id, 2) as bigint) as s, count(*) as total, count(*) filter (where share <= 0.3e0) as valid from empty where scene_id in {_HELD} group by scene_id),
    runs as (select *, 'D' as pipeline from scenes union all select *, 'C' from scenes where s % 2 = 1)
    select scene_id, pipeline, total as total_tiles, valid as valid_tiles, total - valid as skipped_nodata, valid as listed, valid as stored, case when s % 2 = 0 then s end as target_density_cell_index, case when s % 2 = 0 then 'density' else 'seasonal_criteria_fallback' end as targeting_protocol,
      case when pipeline = 'C' then 'ok failed' when s < 2 then 'skipped' else 'ok' end as second from runs""",
)
def process_scenes_committed(t):
    """Two runs for code D (the second skips what the first did) and one for C, read back from the store."""
    from seaglint.sources.scene_store import SceneStore
    from seaglint.streaming.jobs import work_folder

    gap = GAP.format(s="vec_id / 256e0", y="cast(vec_id % 256 as int)")
    rows = t.sql(
        f"select concat('B', cast(vec_id div 256 as string)) as scene_id, cast(vec_id % 256 as int) as sy, transform(embedding, e -> case when {gap} then 0 else cast(floor((cast(e as double) + 1e0) * 1000e0) as int) end) as line from embeddings"
    )
    b, number = _cut_blocks(rows), F.substring("scene_id", 2, 12).cast("bigint")
    names = b.select("scene_id").distinct()
    traces = names.where(number % 2 == 0).select("scene_id", number.alias("target_density_cell_index"), F.array(F.lit(1.0)).alias("target_cell_bbox"), F.lit("density").alias("protocol"))
    store = SceneStore(f"{work_folder(t.spark, 'scenes')}/store")

    def go(some, code):
        return flows.process_scenes_to(store, some, b, scene_vectors(t), None, traces, code, size=SIZE, stride=STRIDE, halo=HALO, block=BLOCK)

    go(names.where(number < 2), "D")
    second = go(names, "D").select("scene_id", F.lit("D").alias("pipeline"), F.col("status").alias("second"))
    go(names.where(number % 2 == 1), "C")
    second = second.unionByName(names.select("scene_id", F.lit("C").alias("pipeline"), F.lit("ok failed").alias("second")))
    stored = store.read(t.spark, "tiles").groupBy("scene_id", "pipeline").agg(F.count("*").alias("stored"))
    manifests = store.read(t.spark, "manifests").join(stored, ["scene_id", "pipeline"], "left").join(second, ["scene_id", "pipeline"], "left")
    return manifests.select(
        "scene_id", "pipeline", "total_tiles", "valid_tiles", "skipped_nodata", F.size("tiles").cast("bigint").alias("listed"),
        F.coalesce("stored", F.lit(0)).alias("stored"), "target_density_cell_index", "targeting_protocol", "second",
    )


CODED = "select substr('ABCDE', cast(1 + tile % 5 as int), 1) as code, dn % 256 as v from v_pixels"


@query("intensity_histogram", f"select code, v, n, n / sum(n) over (partition by code) as share from (select code, v, count(*) as n from ({CODED}) q group by code, v) h")
def intensity_histogram(t):
    return evaluate.intensity_histogram(t.sql(CODED)).withColumn("v", F.col("v").cast("bigint"))


_KS = f"""with h as (select code, v, count(*) as n from ({CODED}) q group by code, v), f as (select c.code, l.v, sum(coalesce(h.n, 0)) over (partition by c.code order by l.v) / sum(coalesce(h.n, 0)) over (partition by c.code) as cdf
   from (select distinct code from h) c cross join (select distinct v from h) l left join h on h.code = c.code and h.v = l.v)"""


@query("ks_distances", _KS + f" select a.code as first, b.code as second, {r('max(abs(a.cdf - b.cdf))', 9)} as ks from f a join f b on a.v = b.v and a.code < b.code group by a.code, b.code")
def ks_distances(t):
    out = evaluate.ks_distances(evaluate.intensity_histogram(t.sql(CODED)))
    return out.withColumn("ks", rounded(F.col("ks"), 9))


@query("ks_max_distance", _KS + " select floor(max(abs(a.cdf - b.cdf)) * 1e4 + 0.5e0) / 1e4 as ks_max from f a join f b on a.v = b.v and a.code < b.code")
def ks_max_distance(t):
    return evaluate.ks_max_distance(evaluate.intensity_histogram(t.sql(CODED)))


@query(
    "score_tiles",
    f"""select tile, (y // 8) * 8 + 4e0 as cy, (x // 8) * 8 + 4e0 as cx, {r('sum(v) / 64e0 / 255e0')} as conf from ({LEVELS}) q where y // 8 * 8 + 8 <= (select max(y) + 1 from v_pixels m where m.tile = q.tile) group by tile, y // 8, x // 8 having sum(v) / 64e0 >= 140""",
)
def score_tiles(t):
    bytes_ = raster.map_tiles(packed(t), lambda a: (a % 256).astype("uint8"))
    out = detect.score_tiles(bytes_, lambda: detect.bright_block_model(8, 140))
    return out.select(F.col("tile_id").cast("bigint").alias("tile"), "cy", "cx", rounded(F.col("conf")).alias("conf"))


_WRITTEN = f"select tile, count(*) as n from v_pixels where {HAS_LUT} group by tile having avg(case when dn = 0 then 1e0 else 0e0 end) <= 0.3e0"


@query(
    "write_tiles",
    f"select concat('L', tile) as scene_id, code, 1 as valid_tiles, n as bytes, tile as last_tile from ({_WRITTEN}) w, (values ('B'), ('C')) c(code)",
)
def write_tiles(t):
    """Manifest totals of tiles written in three goes: two codes, then some scenes of the first again."""
    from seaglint.sources import sinks
    from seaglint.streaming.jobs import work_folder

    root = work_folder(t.spark, "tiles")
    for code, rows in (("B", windows(t)), ("C", windows(t)), ("B", windows(t).where("tile_no % 2 = 0"))):
        sinks.write_tiles(raster.run_chains(rows, vectors(t), None, (code,)), f"{root}/out")
    return sinks.tile_manifests(t.spark.read.parquet(f"{root}/out"))


