"""Whole flows composed of the operators."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seaglint import config as C
from seaglint.functions import geo
from seaglint.operators import ais, catalogue, detect, evaluate, events, raster, tiles
from seaglint.session import ensure_checkpoint_dir, saved
from seaglint.sources.scene_store import SceneStore


def events_to_stats(raw: DataFrame, since: str | None = None) -> DataFrame:
    """Arrived events → zone → priority → newest per id → counts by zone and by priority."""
    zone = geo.zone_of(*[F.col(c) for c in ("lat_min", "lon_min", "lat_max", "lon_max")])
    zoned = raw.withColumn("zone", zone).withColumn("priority_level", geo.priority_level(F.col("vessel_count")))
    stored = events.upsert_events(None, zoned)
    return events.stats_by_zone_priority(events.filter_events(stored, since=since))


def annotate_scenes(positions: DataFrame, tile_table: DataFrame, scenes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(annotations, report): scene boxes, position windows, tile projection, labels, counts.

    The window join is made once and saved, as both results read it. The annotations are projected from it by
    whoever reads them: the report needs tile and label of each, not its box.
    """
    boxes = tiles.scene_bbox(tile_table).join(scenes.select("scene_id", "acquired"), "scene_id")
    found = ais.ais_in_scene_window(positions, boxes).drop("lat_min", "lon_min", "lat_max", "lon_max", "day")
    found = saved(found)
    pairs = ais.points_in_tiles(found, tile_table, on=("scene_id",))
    notes = ais.annotate_pairs(pairs, "pos_id")
    return notes, evaluate.annotation_report(tile_table, found, notes)


def benchmark_chains(preds: DataFrame, labels: DataFrame, hist: DataFrame | None = None) -> DataFrame:
    """Scores per processing code: labelled tiles only, suppression, matching, metrics.

    ``preds``: code, tile_key, box_id, score and a centre box. ``labels``: tile_key, box_id, box.
    All codes run in one pass: labels meet the predictions of all codes once, and the matching is by (code,
    tile). Every processing code has a row; one without predictions finds nothing, so its scores are 0 and
    all labels are missed.
    """
    labelled = preds.join(labels.select("tile_key").distinct(), "tile_key", "left_semi")
    p = labelled.where(F.col("score") > C.BENCHMARK_CONFIDENCE).withColumn("tile_id", F.concat_ws("#", "code", "tile_key"))
    code = F.substring_index("tile_id", "#", 1)
    key = F.substring("tile_id", F.length(code) + 2, F.length("tile_id"))
    kept = detect.nms_benchmark(p).select("*", code.alias("code"), key.alias("tile_key"))
    kept, keys = saved(kept), ["code", "tile_key"]  # read by the matching and by the counts
    found = detect.greedy_match(kept, labels, best=False, tile="tile_key", per=("code",))
    counted = lambda df, by, name: df.groupBy(*by).agg(F.count("*").alias(name))
    of_tile = counted(labels, ["tile_key"], "n_gt").withColumn("code", F.explode(F.array(*map(F.lit, C.PROCESSING_CODES))))
    scores = evaluate.joined_scores(counted(kept, keys, "n_pred"), of_tile, counted(found, keys, "tp"), keys)
    out = evaluate.detection_metrics(scores, ["code"])
    if hist is not None:
        out = out.withColumn("ks_max", evaluate.ks_max_distance(hist).scalar())
    return out


def process_scenes(
    scenes: DataFrame,
    done: DataFrame,
    blocks: DataFrame,
    sigma: DataFrame,
    noise: DataFrame | None,
    code: str,
    force: bool = False,
    **grid: int,
) -> DataFrame:
    """Tiles of all scenes that are not processed yet."""
    todo = catalogue.unprocessed_scenes(scenes, done, code, force).select("scene_id")
    windows = raster.assemble_windows(blocks.join(todo, "scene_id", "left_semi"), **grid)
    return raster.run_chains(windows, sigma, noise, (code,))


def scene_manifests(grid: DataFrame, tiles_done: DataFrame, traces: DataFrame, code: str, places: DataFrame | None = None, **fixed) -> DataFrame:
    """One manifest for each scene of the grid: settings, totals, trace fields and its tiles with their boxes.

    ``grid``: scene_id, tile_no and the pixel box; ``places``: scene_id, tile_no and the geographic box.
    ``fixed`` gives the columns that are the same for all scenes. A scene has as many tiles as its grid.
    """
    own = tiles_done.select("scene_id", "tile_no", "tile_id", F.lit(True).alias("_valid"))
    rows = grid.join(own, ["scene_id", "tile_no"], "left")
    box = F.lit(None).cast("array<double>")
    if places is not None:
        sides = ["lat_min", "lon_min", "lat_max", "lon_max"]
        rows = rows.join(places.select("scene_id", "tile_no", F.array(*sides).alias("_box")), ["scene_id", "tile_no"], "left")
        box = F.col("_box")
    entry = F.struct(
        "tile_no", "tile_id", "scene_id", F.lit(code).alias("pipeline"),
        F.array(*[F.col(c).cast("int") for c in ("x0", "y0", "x1", "y1")]).alias("pixel_bbox"),
        box.alias("geo_bbox"), F.concat(F.lit(f"{fixed['output_dir']}/scene_id="), "scene_id").alias("npy_path"),
    )
    totals = rows.groupBy("scene_id").agg(
        F.count("*").alias("total_tiles"),
        F.count("_valid").alias("valid_tiles"),
        (F.count("*") - F.count("_valid")).alias("skipped_nodata"),
        F.sort_array(F.collect_list(F.when(F.col("_valid"), entry))).alias("tiles"),
    )
    bare = F.transform("tiles", lambda t: t.dropFields("tile_no"))
    whole = totals.withColumn("tiles", bare).withColumn("pipeline", F.lit(code)).withColumns({k: F.lit(v) for k, v in fixed.items()})
    return tiles.trace_join(whole, traces)


def process_scenes_to(
    store: SceneStore,
    scenes: DataFrame,
    blocks: DataFrame,
    sigma: DataFrame,
    noise: DataFrame | None,
    traces: DataFrame,
    code: str,
    force: bool = False,
    places: DataFrame | None = None,
    polarization: str = "vv",
    **grid: int,
) -> DataFrame:
    """Process scenes into ``store`` and commit tiles, manifests and traces as one; scene_id, status and tiles.

    Scenes that the store has are ``skipped`` (unless ``force``), scenes without calibration vectors
    ``failed``, the others ``ok``. A run that dies before its commit leaves nothing that readers see.
    """
    spark = scenes.sparkSession
    names = scenes.select("scene_id").distinct()
    todo = catalogue.unprocessed_scenes(names, store.processed(spark), code, force)
    ready = todo if code == "A" else todo.join(sigma.select("scene_id").distinct(), "scene_id", "left_semi")
    ensure_checkpoint_dir(spark)
    ready, todo = ready.checkpoint(), todo.checkpoint()
    run, began = store.new_run(), time.time()
    own = blocks.join(ready, "scene_id", "left_semi")
    made = store.stage_tiles(raster.run_chains(raster.assemble_windows(own, **grid), sigma, noise, (code,)), run)
    size, stride = grid.get("size", C.TILE_SIZE), grid.get("stride", C.TILE_STRIDE)
    shape = own.groupBy("scene_id").agg(F.max("height").alias("height"), F.max("width").alias("width"))
    cells = tiles.tile_grid(shape, size, 1 - stride / size)
    manifests = scene_manifests(
        cells, made, traces, code, places, polarization=polarization, tile_size=size, overlap=1 - stride / size,
        output_dir=store.folder("tiles", run), processing_time_s=time.time() - began,
    )
    store.commit(manifests, run)
    done = store.read(spark, "manifests").where(F.col("run") == run).select("scene_id", F.col("valid_tiles").alias("_tiles"))
    status = F.when(F.col("_tiles").isNotNull(), "ok").when(F.col("_todo"), "failed").otherwise("skipped")
    told = names.join(done, "scene_id", "left").join(todo.withColumn("_todo", F.lit(True)), "scene_id", "left")
    return told.select("scene_id", status.alias("status"), F.coalesce("_tiles", F.lit(0)).alias("tiles"))
