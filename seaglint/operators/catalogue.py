"""Product catalogue: search, duplicate removal, sampling, lookups, target traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seaglint.functions.clock import micros
from seaglint import config as C
from seaglint.functions import geo, names
from seaglint.functions.draws import draw_hash
from seaglint.operators.ranking import newest_per_key, oldest_per_key, top_per_group


def clean_catalogue(raw: DataFrame) -> DataFrame:
    """Defaults of the product columns: empty text and size 0."""
    return raw.select(
        F.coalesce(F.col("id").cast("string"), F.lit("")).alias("id"),
        F.coalesce("name", F.lit("")).alias("name"),
        "date",
        F.coalesce("size", F.lit(0)).cast("bigint").alias("size"),
        *[c for c in raw.columns if c not in ("id", "name", "date", "size")],
    )


def search_catalogue(
    products: DataFrame,
    bbox: tuple[float, float, float, float],
    date_start: str,
    date_end: str,
    limit: int | None = None,
) -> DataFrame:
    """Products of the right type whose box touches ``bbox``, newest first.

    ``date_end`` counts to 23:59:59. Column order of ``bbox``: lon_min, lat_min, lon_max, lat_max.
    """
    box = tuple(F.col(c) for c in ("lon_min", "lat_min", "lon_max", "lat_max"))
    want = tuple(F.lit(float(v)) for v in bbox)
    kind = F.contains(F.col("name"), F.lit(C.PRODUCT_TYPE))
    hits = products.where(
        kind
        & geo.overlaps(box, want)
        & (F.col("date") >= F.to_timestamp(F.lit(date_start)))
        & (F.col("date") <= F.to_timestamp(F.lit(f"{date_end} 23:59:59")))
    )
    if limit is None:
        return hits
    return hits.orderBy(F.desc("date"), "id").limit(limit)


def cog_dedupe(products: DataFrame, order: str = "id") -> DataFrame:
    """Per first seven name parts: all COG variants, or the first product where there is none.

    One map-side combined aggregate finds the first standard product per group; no group is held.
    """
    keyed = products.withColumn("_b7", names.cog_base7(F.col("name"))).withColumn(
        "_cog", names.is_cog(F.col("name"))
    )
    groups = keyed.groupBy("_b7").agg(
        F.bool_or("_cog").alias("_any_cog"), F.min(F.col(order)).alias("_first")
    )
    joined = keyed.join(groups, "_b7")
    keep = F.when(F.col("_any_cog"), F.col("_cog")).otherwise(F.col(order) == F.col("_first"))
    return joined.where(keep).drop("_b7", "_cog", "_any_cog", "_first")


def dedupe_scenes(records: DataFrame, order: Column) -> DataFrame:
    """First record per base id (else per name); records without any key all stay."""
    key = F.coalesce(names.scene_base_id(F.col("name")), F.col("name"), F.lit(""))
    keyed = records.withColumn("_key", key)
    named = oldest_per_key(keyed.where(F.col("_key") != ""), ["_key"], order)
    return named.unionByName(keyed.where(F.col("_key") == "")).drop("_key")


def unique_base_ids(names_df: DataFrame, name: str = "name") -> DataFrame:
    return (
        names_df.select(names.scene_base_id(F.col(name)).alias("base_id"))
        .where(F.col("base_id").isNotNull())
        .distinct()
    )


def new_scenes(products: DataFrame, held: DataFrame) -> DataFrame:
    """Products whose base id is not held; products without a base id compare by exact name."""
    keyed = products.withColumn("_k", F.coalesce(names.scene_base_id(F.col("name")), F.col("name")))
    have = held.select(F.coalesce(names.scene_base_id(F.col("name")), F.col("name")).alias("_k")).distinct()
    return keyed.join(have, "_k", "left_anti").drop("_k")


def unprocessed_scenes(scenes: DataFrame, manifests: DataFrame, code: str, force: bool = False) -> DataFrame:
    """Scenes that have no manifest with tiles for the given processing code."""
    if force:
        return scenes
    done = manifests.where((F.col("pipeline") == code) & (F.col("tiles") > 0)).select("scene_id")
    return scenes.join(done, "scene_id", "left_anti")


def sample_per_season(products: DataFrame, seasons: DataFrame, seed: str) -> DataFrame:
    """Up to ``count`` products per season, chosen by a hash order, with the season's tags.

    ``seasons`` is a small parameter table: season, label, date_start, date_end, count.
    """
    s = seasons.select(
        "season", "label", F.col("date_start").alias("_from"), F.col("date_end").alias("_to"), "count"
    )
    lasting = F.sequence(F.trunc("_from", "month"), F.trunc("_to", "month"), F.expr("interval 1 month"))
    by_month = s.withColumn("_month", F.explode(lasting))
    hits = products.withColumn("_month", F.trunc(F.col("date").cast("date"), "month")).join(by_month, "_month")
    day = F.col("date").cast("date")
    hits = hits.where((day >= F.col("_from")) & (day <= F.col("_to")))
    mixed = hits.withColumn("_h", draw_hash(F.col("name"), seed))
    most = seasons.agg(F.max("count")).first()[0] or 0
    best = top_per_group(mixed, ["season"], ["_h", "name"], most)
    from pyspark.sql import Window

    rn = F.row_number().over(Window.partitionBy("season").orderBy("_h", "name"))
    out = best.withColumn("_rn", rn).where(F.col("_rn") <= F.col("count"))
    return out.withColumn(
        "date_range", F.concat_ws("/", F.col("_from").cast("string"), F.col("_to").cast("string"))
    ).drop("_month", "_h", "_rn", "_from", "_to", "count")


def min_scene_age(products: DataFrame, as_of: str) -> DataFrame:
    """Acquired at least three days before ``as_of`` and at most ninety days before that."""
    end = F.date_sub(F.to_date(F.lit(as_of)), C.MIN_SCENE_AGE_DAYS)
    start = F.date_sub(end, C.SEARCH_WINDOW_DAYS)
    day = F.col("date").cast("date")
    return products.where((day <= end) & (day >= start))


def split_by_label_prefix(scenes: DataFrame, prefix: str) -> tuple[DataFrame, DataFrame]:
    """(kept, archived): other labels are archived if they have a path and dropped otherwise."""
    fits = F.coalesce(F.startswith(F.col("label"), F.lit(prefix)), F.lit(False))
    has_path = F.coalesce(F.col("path") != "", F.lit(False))
    return scenes.where(fits), scenes.where(~fits & has_path)


def filter_scene_prefix(scenes: DataFrame, prefixes: list[str]) -> DataFrame:
    """Scenes whose short id starts with a given prefix, with the prefix's position."""
    short = names.short_scene_id(F.col("scene_id"))
    place = F
    for i, p in enumerate(prefixes):
        place = place.when(short.startswith(p), i)
    return scenes.withColumn("prefix_order", place.otherwise(None)).where("prefix_order is not null")


def resolve_scene(wanted: DataFrame, held: DataFrame) -> DataFrame:
    """Held scene for each wanted name: exact id first, else the least name of the same base id.

    Held scenes are first reduced to one row per key, so a base id with many variants cannot
    multiply the wanted rows.
    """
    have = held.select(names.scene_id_normalize(F.col("name")).alias("held_scene")).distinct()
    by_base = (
        have.withColumn("_b", names.scene_base_id(F.col("held_scene")))
        .where(F.col("_b").isNotNull())
        .groupBy("_b")
        .agg(F.min("held_scene").alias("_by_base"))
    )
    w = wanted.withColumn("_id", names.scene_id_normalize(F.col("name"))).withColumn(
        "_b", names.scene_base_id(F.col("name"))
    )
    exact = have.select(F.col("held_scene").alias("_exact"))
    return (
        w.join(exact, F.col("_id") == F.col("_exact"), "left")
        .join(by_base, "_b", "left")
        .withColumn("held_scene", F.coalesce("_exact", "_by_base"))
        .drop("_id", "_b", "_exact", "_by_base")
    )


def top_products_for_cells(cells: DataFrame, products: DataFrame, per_cell: int = 5, n: int = C.TARGET_ZONES) -> DataFrame:
    """Newest ``per_cell`` products over each of the first ``n`` cells (a bounded parameter list)."""
    top = cells.orderBy("density_rank").limit(n)
    listed = top.agg(
        F.collect_list(
            F.struct("density_rank", "cell_index", "lon_min", "lat_min", "lon_max", "lat_max", "ais_count")
        ).alias("cells")
    )
    box = tuple(F.col(c) for c in ("lon_min", "lat_min", "lon_max", "lat_max"))
    wanted = products.withColumn("_cells", listed.scalar())
    hit = F.filter("_cells", lambda c: geo.overlaps(box, (c["lon_min"], c["lat_min"], c["lon_max"], c["lat_max"])))
    pairs = wanted.select(
        F.explode(hit).alias("_c"), F.col("id").alias("product_id"), "name", "date"
    ).select(
        F.col("_c.density_rank").alias("density_rank"),
        F.col("_c.cell_index").alias("cell_index"),
        F.col("_c.ais_count").alias("ais_count"),
        "product_id",
        "name",
        "date",
    )
    return top_per_group(pairs, ["density_rank"], [F.desc("date"), F.asc("product_id")], per_cell)


def cell_product_join(cells: DataFrame, products: DataFrame, n: int = C.TARGET_ZONES, per_cell: int = 5) -> DataFrame:
    """One product per target cell: the newest whose base id no denser cell has taken yet.

    If all candidates of a cell are taken, its newest is used again. The choice folds over at
    most ``n * per_cell`` rows.
    """
    short = top_products_for_cells(cells, products, per_cell, n)
    per = short.groupBy("density_rank", "cell_index", "ais_count").agg(
        F.sort_array(
            F.collect_list(
                F.struct(
                    (-micros("date")).alias("newest"),
                    "product_id",
                    "name",
                    F.coalesce(names.scene_base_id(F.col("name")), F.lit("")).alias("base"),
                )
            )
        ).alias("_cands")
    )
    ordered = per.agg(
        F.sort_array(F.collect_list(F.struct("density_rank", "cell_index", "ais_count", "_cands"))).alias("_all")
    )
    chosen = F.expr(
        """aggregate(_all,
             cast(array() as array<struct<density_rank:bigint,cell_index:bigint,ais_count:bigint,product_id:string,name:string,base:string>>),
             (acc, c) -> concat(acc, array(
               transform(
                 array(coalesce(
                   get(filter(c._cands, p -> p.base = '' or not exists(acc, a -> a.base = p.base)), 0),
                   get(c._cands, 0))),
                 p -> named_struct('density_rank', cast(c.density_rank as bigint), 'cell_index', cast(c.cell_index as bigint),
                       'ais_count', cast(c.ais_count as bigint), 'product_id', cast(p.product_id as string), 'name', p.name, 'base', p.base)
               )[0])))"""
    )
    return ordered.select(F.explode(chosen).alias("c")).select("c.*").drop("base")


def target_trace(rows: DataFrame) -> DataFrame:
    """Trace row per scene with its JSON text; null fields are left out of the text."""
    sid = names.scene_id_normalize(F.col("scene_name"))
    cols = rows.select(
        sid.alias("scene_id"),
        F.concat(sid, F.lit(".SAFE")).alias("safe_dir"),
        F.col("cell_index").alias("target_density_cell_index"),
        "target_cell_bbox",
        "density_rank",
        "ais_count",
        F.lit(C.DENSITY_PROTOCOL).alias("protocol"),
    )
    return cols.withColumn("trace_json", F.to_json(F.struct(*cols.columns)))


def write_traces_index(stored: DataFrame, written: DataFrame, order: str = "written_at") -> DataFrame:
    """Index of traces by scene_id; a later write replaces an earlier one."""
    return newest_per_key(stored.unionByName(written, allowMissingColumns=True), ["scene_id"], F.col(order))


def region_summary(scenes: DataFrame) -> DataFrame:
    """Per region: good and failed downloads and total size in GB."""
    return scenes.groupBy("region").agg(
        F.count_if(F.col("status").isin("downloaded", "already_downloaded")).alias("successful"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        (F.sum("size") / F.lit(1024.0**3)).alias("total_size_gb"),
    )
