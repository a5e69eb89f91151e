"""Readers and writers over data that Spark derives from the given tables."""

from pyspark.sql import functions as F

from seaglint.operators import raster
from seaglint.plans.raster_queries import LEVELS, packed
from seaglint.plans.registry import query
from seaglint.sources import files, sinks
from seaglint.streaming.jobs import work_folder


@query("normalize_response_entries", "select event_id from events")
def normalize_response_entries(t):
    """Pages of twenty records in four answer shapes."""
    page = F.floor(F.col("event_id") / 20)
    one = F.to_json(F.struct("event_id", "event_type"))
    pages = t.events.groupBy(page.alias("page")).agg(F.concat(F.lit("["), F.array_join(F.collect_list(one), ","), F.lit("]")).alias("l"))
    shape = F.col("page") % 4
    text = (
        F.when(shape == 0, F.concat(F.lit('{"total":1,"entries":'), "l", F.lit("}")))
        .when(shape == 1, F.concat(F.lit('{"data":[{"set:v4":'), "l", F.lit("}]}")))
        .when(shape == 2, F.concat(F.lit('{"set:v4":'), "l", F.lit("}")))
        .otherwise(F.concat(F.lit('{"features":'), "l", F.lit("}")))
    )
    records = files.response_entries(pages.select(text.alias("value")))
    return records.select(F.get_json_object("record", "$.event_id").cast("bigint").alias("event_id"))


LISTING = """select concat('/d/', name, '-', o_orderkey, '.SAFE/', f) as path from (select concat('P', o_orderkey) as name, o_orderkey,
  explode(case o_orderkey % 4 when 0 then array('measurement/s1a-iw-grd-vv-1.tiff', 'measurement/s1a-iw-grd-vv-1-cog.tiff', 'annotation/calibration/calibration-s1a-vv.xml', 'annotation/calibration/noise-s1a-vv.xml')
    when 1 then array('measurement/x_vv.tiff', 'annotation/calibration/calibration-s1a-vv.xml') when 2 then array('measurement/s1a-iw-grd-vv-1.tiff') else array('measurement/s1a-iw-grd-vh-1.tiff', 'annotation/calibration/calibration-s1a-vv.xml') end) as f from orders) q"""


@query(
    "list_product_files",
    """select concat('P', o_orderkey, '-', o_orderkey) as product, case o_orderkey % 4 when 0 then 's1a-iw-grd-vv-1-cog.tiff' when 1 then 'x_vv.tiff' when 2 then 's1a-iw-grd-vv-1.tiff' else '?' end as measurement, o_orderkey % 4 = 0 as has_noise,
    case o_orderkey % 4 when 2 then 'calibration' when 3 then 'measurement' else '' end as missing from orders""",
)
def list_product_files(t):
    good, bad = files.pick_product_files(t.sql(LISTING))
    both = good.withColumn("missing", F.lit("")).unionByName(bad)
    return both.select(
        "product", F.coalesce(F.element_at(F.split("measurement", "/"), -1), F.lit("?")).alias("measurement"),
        F.col("noise").isNotNull().alias("has_noise"), "missing",
    )


@query("empty_label_filter", "select tile_id from (select tile_id, sum(case when txt = 'bad line' then 0 else length(txt) end) as n from v_lines group by tile_id) q where n > 0")
def empty_label_filter(t):
    size = F.when(F.col("txt") == "bad line", 0).otherwise(F.length("txt"))
    listing = t.v_lines.groupBy("tile_id").agg(F.sum(size).alias("length"))
    return files.non_empty_labels(listing).select("tile_id")


@query("export_csv", "select tile_id, tile_no from v_tiles")
def export_csv(t):
    out = f"{work_folder(t.spark, 'csv')}/out"
    sinks.export_csv(t.v_tiles, out, ["tile_id", "tile_no"])
    return t.spark.read.schema("tile_id string, tile_no bigint").option("header", True).csv(out)


@query("export_json", "select tile_id, lat_min, lon_min from v_tiles")
def export_json(t):
    out = f"{work_folder(t.spark, 'json')}/out"
    sinks.export_json(t.v_tiles, out)
    return t.spark.read.schema("tile_id string, lat_min double, lon_min double").json(out)


@query(
    "export_metrics",
    "select region, count(*) as n from (select cast(cast(lon_min as bigint) as varchar) as region from v_products) q group by region",
)
def export_metrics(t):
    out = f"{work_folder(t.spark, 'metrics')}/out"
    sinks.export_metrics(t.v_products.groupBy(F.col("lon_min").cast("bigint").cast("string").alias("region")).agg(F.count("*").alias("n")), out)
    back = t.spark.read.schema("region string, n bigint").option("header", True).csv(f"{out}/csv")
    return back.join(t.spark.read.schema("region string, n bigint").json(f"{out}/json"), ["region", "n"])


def _bytes(t):
    return raster.map_tiles(packed(t), lambda a: (a % 256).astype("uint8"))


def _around(body):
    """SQL over each pixel's mirrored 5 by 5 neighbourhood (``n``)."""

    def mirror(c, d, n):
        return f"case when {c} + {d} < 0 then -({c} + {d}) - 1 when {c} + {d} >= {n} then 2 * {n} - 1 - ({c} + {d}) else {c} + {d} end"

    return f"""select p.tile, p.y, p.x, {body} from (select *, {mirror('y', 'dy', 'h')} as yy, {mirror('x', 'dx', '64')} as xx from (select s.*, max(y) over (partition by tile) + 1 as h from ({LEVELS}) s) b, range(-2, 3) a(dy), range(-2, 3) c(dx)) p
      join ({LEVELS}) q on q.tile = p.tile and q.y = p.yy and q.x = p.xx group by p.tile, p.y, p.x"""


def _long(tiles):
    return raster.unpack_tiles(tiles, ["tile_id"]).select(F.col("tile_id").cast("bigint").alias("tile"), "y", "x", "v")


@query("median_blur", _around("cast(median(q.v) as bigint) as v"))
def median_blur(t):
    return _long(raster.map_tiles(_bytes(t), raster.median_blur))


@query("gaussian_blur")
def gaussian_blur(t):
    return _long(raster.map_tiles(_bytes(t), raster.gaussian_blur))


@query("clahe")
def clahe(t):
    return _long(raster.map_tiles(_bytes(t), raster.clahe))


@query(
    "pad_edge_tile",
    f"select h.tile, g.y, g.x, q.v from (select tile, max(y) as last from ({LEVELS}) m group by tile) h, (select a.y, b.x from range(0, 80) a(y), range(0, 80) b(x)) g join ({LEVELS}) q on q.tile = h.tile and q.y = least(g.y, h.last) and q.x = least(g.x, 63)",
)
def pad_edge_tile(t):
    return _long(raster.map_tiles(_bytes(t), lambda a: raster.pad_tile(a, 80)))


@query("model_tensor")
def model_tensor(t):
    """Input tensor of every tile, all channels at the model's own size, kept as whole thousandths."""
    from seaglint.operators.detect import model_tensor as tensor

    def lines(a):
        whole = tensor(a)[0]  # channels one below the other
        return (whole * 1000).astype("int16").reshape(-1, whole.shape[-1])

    # A tensor is hundreds of times as large as its tile, so small tiles are dealt to many tasks.
    tiles = _bytes(t).repartition(t.spark.sparkContext.defaultParallelism * 4, "tile_id")
    out = raster.map_tiles(tiles, lines)
    return _long(out).groupBy("tile").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))


@query("read_npy_tiles", f"select tile, y, x, v from ({LEVELS}) q")
def read_npy_tiles(t):
    """Tiles written as ``.npy`` files by tasks and read back."""
    folder = work_folder(t.spark, "npy")
    sinks.write_npy_tiles(_bytes(t), folder)
    return _long(files.read_npy_tiles(t.spark, folder))
