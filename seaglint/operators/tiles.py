"""Tile grids, ground-control interpolation and tile/scene boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seaglint import config as C
from seaglint.functions.draws import draw_hash
from seaglint.operators.ranking import numbered, top_per_group


def tile_grid(scenes: DataFrame, size: int = C.TILE_SIZE, overlap: float = C.TILE_OVERLAP) -> DataFrame:
    """One row per tile of each scene (``height``, ``width``), numbered row by row."""
    stride = max(1, int(size * (1 - overlap)))
    per_row = F.ceil(F.col("width") / F.lit(stride))

    def starts(dim):
        return F.sequence(F.lit(0), (F.col(dim) - 1).cast("int"), F.lit(stride))

    rows = scenes.withColumn("y0", F.explode(starts("height"))).withColumn("x0", F.explode(starts("width")))
    return (
        rows.withColumn("y1", F.least(F.col("y0") + size, F.col("height")))
        .withColumn("x1", F.least(F.col("x0") + size, F.col("width")))
        .withColumn(
            "tile_no",
            (F.col("y0") / F.lit(stride) * per_row + F.col("x0") / F.lit(stride)).cast("bigint"),
        )
    )


def gcp_table(points: DataFrame) -> DataFrame:
    """Control points with grid row and column numbers; irregular scenes raise an error.

    Row and column values are ranked on their distinct values per scene, a small table.
    """
    out = points
    for value, name in (("line", "gi"), ("pixel", "gj")):
        w = Window.partitionBy("scene_id").orderBy(value)
        ranks = points.select("scene_id", value).distinct().withColumn(name, (F.row_number().over(w) - 1).cast("bigint"))
        out = out.join(ranks, ["scene_id", value])
    bad = gcp_regularity(points).where(~F.col("regular")).select("scene_id")
    checked = out.join(bad.withColumn("_bad", F.lit(True)), "scene_id", "left")
    ok = F.when(
        F.col("_bad"),
        F.raise_error(F.concat(F.lit("control points are not a grid: "), F.col("scene_id"))).cast("bigint"),
    ).otherwise(F.col("gi"))
    return checked.withColumn("gi", ok).drop("_bad")


def gcp_regularity(points: DataFrame) -> DataFrame:
    return (
        points.groupBy("scene_id")
        .agg(
            F.countDistinct("line").alias("n_rows"),
            F.countDistinct("pixel").alias("n_cols"),
            F.count("*").alias("n_points"),
        )
        .withColumn("regular", F.col("n_rows") * F.col("n_cols") == F.col("n_points"))
    )


def gcp_cells(gcps: DataFrame, shapes: DataFrame) -> DataFrame:
    """One row per grid cell with its four corner values and the scene's node spacing.

    Nodes are spread evenly over the image (0 .. size-1), whatever pixel the points name.
    """
    dims = gcps.groupBy("scene_id").agg(
        (F.max("gi") + 1).alias("n_rows"), (F.max("gj") + 1).alias("n_cols")
    )
    spacing = dims.join(shapes.select("scene_id", "height", "width"), "scene_id").select(
        "scene_id",
        "n_rows",
        "n_cols",
        "height",
        "width",
        ((F.col("height") - 1) / (F.col("n_rows") - 1)).alias("dy"),
        ((F.col("width") - 1) / (F.col("n_cols") - 1)).alias("dx"),
    )
    # Each point serves up to four cells as one of their corners.
    corner = F.explode(
        F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)])
    )
    spread = gcps.select("scene_id", "gi", "gj", "lat", "lon", corner.alias("k")).select(
        "scene_id",
        (F.col("gi") - F.col("k.a")).alias("gi"),
        (F.col("gj") - F.col("k.b")).alias("gj"),
        (F.col("k.a") * 2 + F.col("k.b")).alias("corner"),
        "lat",
        "lon",
    )
    aggs = []
    for n, tag in enumerate(("00", "01", "10", "11")):
        for v in ("lat", "lon"):
            aggs.append(F.max(F.when(F.col("corner") == n, F.col(v))).alias(f"{v}{tag}"))
    cells = spread.groupBy("scene_id", "gi", "gj").agg(F.count("*").alias("_n"), *aggs).where("_n = 4").drop("_n")
    return cells.join(spacing, "scene_id")


def gcp_pixel_to_latlon(pixels: DataFrame, gcps: DataFrame, shapes: DataFrame) -> DataFrame:
    """Bilinear position of (``line``, ``pixel``); null outside the grid."""
    cells = gcp_cells(gcps, shapes)
    grid = cells.select("scene_id", "dy", "dx", "n_rows", "n_cols", "height", "width").distinct()
    placed = pixels.join(grid, "scene_id", "left")
    inside = F.col("line").between(0, F.col("height") - 1) & F.col("pixel").between(0, F.col("width") - 1)
    gi = F.least(F.floor(F.col("line") / F.col("dy")), F.col("n_rows") - 2)
    gj = F.least(F.floor(F.col("pixel") / F.col("dx")), F.col("n_cols") - 2)
    placed = placed.withColumn("gi", F.when(inside, gi)).withColumn("gj", F.when(inside, gj))
    corners = cells.drop("dy", "dx", "n_rows", "n_cols", "height", "width")
    hit = placed.join(corners, ["scene_id", "gi", "gj"], "left")
    fy = F.col("line") / F.col("dy") - F.col("gi")
    fx = F.col("pixel") / F.col("dx") - F.col("gj")

    def mix(v):
        return (
            F.col(f"{v}00") * (1 - fy) * (1 - fx)
            + F.col(f"{v}01") * (1 - fy) * fx
            + F.col(f"{v}10") * fy * (1 - fx)
            + F.col(f"{v}11") * fy * fx
        )

    return hit.select(*pixels.columns, mix("lat").alias("lat"), mix("lon").alias("lon"))


def tile_geo_bbox(tiles: DataFrame, gcps: DataFrame, shapes: DataFrame) -> DataFrame:
    """Geographic box of each tile from its four corner pixels.

    If a corner is off the grid, the tile's centre ± 0.025 degrees; if that is off too, (0, 0).
    """
    last_y, last_x = F.col("y1") - 1, F.col("x1") - 1
    mid_y, mid_x = F.floor((F.col("y0") + F.col("y1")) / 2), F.floor((F.col("x0") + F.col("x1")) / 2)

    def spot(mid, line, pixel):
        return F.struct(
            F.lit(mid).alias("mid"), line.cast("double").alias("line"), pixel.cast("double").alias("pixel")
        )

    spots = F.explode(
        F.array(
            spot(False, F.col("y0"), F.col("x0")),
            spot(False, F.col("y0"), last_x),
            spot(False, last_y, F.col("x0")),
            spot(False, last_y, last_x),
            spot(True, mid_y, mid_x),
        )
    )
    pts = tiles.select("scene_id", "tile_no", spots.alias("p")).select("scene_id", "tile_no", "p.*")
    located = gcp_pixel_to_latlon(pts, gcps, shapes)
    corner = ~F.col("mid")
    agg = located.groupBy("scene_id", "tile_no").agg(
        F.count_if(corner & F.col("lat").isNotNull()).alias("_ok"),
        *[
            fn(F.when(corner, F.col(v))).alias(f"{v}_{side}")
            for v in ("lat", "lon")
            for side, fn in (("min", F.min), ("max", F.max))
        ],
        *[F.coalesce(F.max(F.when(F.col("mid"), F.col(v))), F.lit(0.0)).alias(f"_{v}") for v in ("lat", "lon")],
    )
    full = F.col("_ok") == 4
    half = {"min": -0.025, "max": 0.025}
    return agg.select(
        "scene_id",
        "tile_no",
        *[
            F.when(full, F.col(f"{v}_{s}")).otherwise(F.col(f"_{v}") + F.lit(half[s])).alias(f"{v}_{s}")
            for s in ("min", "max")
            for v in ("lat", "lon")
        ],
    )


def gcp_affine_fit(gcps: DataFrame) -> DataFrame:
    """Least-squares plane lat/lon = c0 + c1·line + c2·pixel per scene.

    Sums are taken about the scene's first control point, which keeps them well conditioned.
    """
    base = gcps.groupBy("scene_id").agg(
        F.min_by(F.struct("line", "pixel", "lat", "lon"), F.struct("line", "pixel")).alias("o")
    )
    d = gcps.join(base, "scene_id").select(
        "scene_id", "o", *[(F.col(c) - F.col(f"o.{c}")).alias(c) for c in ("line", "pixel", "lat", "lon")]
    )
    pairs = [("line", "line"), ("line", "pixel"), ("pixel", "pixel")]
    pairs += [(a, b) for b in ("lat", "lon") for a in ("line", "pixel")]
    m = d.groupBy("scene_id").agg(
        F.first("o").alias("o"),
        *[F.avg(c).alias(f"m_{c}") for c in ("line", "pixel", "lat", "lon")],
        *[F.covar_pop(a, b).alias(f"{a}_{b}") for a, b in pairs],
    )
    det = F.col("line_line") * F.col("pixel_pixel") - F.col("line_pixel") * F.col("line_pixel")
    out = [F.col("scene_id")]
    for v in ("lat", "lon"):
        by_line = F.try_divide(
            F.col(f"line_{v}") * F.col("pixel_pixel") - F.col(f"pixel_{v}") * F.col("line_pixel"), det
        )
        by_pixel = F.try_divide(
            F.col(f"pixel_{v}") * F.col("line_line") - F.col(f"line_{v}") * F.col("line_pixel"), det
        )
        at0 = F.col(f"o.{v}") + F.col(f"m_{v}") - by_line * (F.col("m_line") + F.col("o.line")) - by_pixel * (
            F.col("m_pixel") + F.col("o.pixel")
        )
        out += [at0.alias(f"{v}_0"), by_line.alias(f"{v}_line"), by_pixel.alias(f"{v}_pixel")]
    return m.select(*out)


def scene_bbox(tiles: DataFrame) -> DataFrame:
    """Hull of the tile boxes of each scene; the region where no tile has one."""
    lon_min, lat_min, lon_max, lat_max = C.REGION_BBOX
    whole = (
        F.col("lat_min").isNotNull()
        & F.col("lon_min").isNotNull()
        & F.col("lat_max").isNotNull()
        & F.col("lon_max").isNotNull()
    )

    def side(fn, c, fallback):
        return F.coalesce(fn(F.when(whole, F.col(c))), F.lit(fallback)).alias(c)

    return tiles.groupBy("scene_id").agg(
        side(F.min, "lon_min", lon_min),
        side(F.min, "lat_min", lat_min),
        side(F.max, "lon_max", lon_max),
        side(F.max, "lat_max", lat_max),
    )


def trace_join(manifests: DataFrame, traces: DataFrame) -> DataFrame:
    """Manifests with the trace fields of their scene; a default protocol where there is none.

    A trace really fills the manifest here: the stored field is ``protocol``, and an empty
    manifest value gives way to the trace.
    """
    t = traces.select(
        "scene_id",
        F.col("target_density_cell_index").alias("_cell"),
        F.col("target_cell_bbox").alias("_bbox"),
        F.col("protocol").alias("_protocol"),
    )
    return (
        manifests.join(t, "scene_id", "left")
        .withColumn("target_density_cell_index", F.col("_cell"))
        .withColumn("target_cell_bbox", F.col("_bbox"))
        .withColumn("targeting_protocol", F.coalesce("_protocol", F.lit(C.FALLBACK_PROTOCOL)))
        .drop("_cell", "_bbox", "_protocol")
    )


def trace_correspondence(manifests: DataFrame, traces: DataFrame) -> DataFrame:
    """Do trace and manifest agree? Nulls on both sides count as equal."""
    t = traces.select(
        F.col("folder").alias("scene_id"),
        F.col("scene_id").alias("_sid"),
        F.col("target_density_cell_index").alias("_cell"),
        F.col("target_cell_bbox").alias("_bbox"),
        F.col("protocol").alias("_protocol"),
    )
    j = manifests.join(t, "scene_id")
    return j.select(
        "scene_id",
        F.col("target_density_cell_index").eqNullSafe(F.col("_cell")).alias("same_index"),
        F.col("target_cell_bbox").eqNullSafe(F.col("_bbox")).alias("same_bbox"),
        F.col("targeting_protocol").eqNullSafe(F.col("_protocol")).alias("same_protocol"),
        (F.col("_sid").isNull() | (F.col("_sid") == F.col("scene_id"))).alias("same_scene"),
    )


def manifest_totals(tiles: DataFrame) -> DataFrame:
    return tiles.groupBy("scene_id").agg(
        F.count("*").alias("total_tiles"),
        F.count_if(~F.col("skipped")).alias("valid_tiles"),
        F.count_if(F.col("skipped")).alias("skipped_nodata"),
    )


def sanity_check(scenes: DataFrame, tiles: DataFrame) -> DataFrame:
    """Verdict per scene: MISSING, INCOMPLETE, EMPTY, OUT OF BOUNDS or OK."""
    agg = tiles.groupBy("scene_id").agg(
        F.count("*").alias("_n"),
        F.min_by("lat_min", "tile_no").alias("_lat"),
        F.count_if(F.col("n_annotations") > 0).alias("_annotated"),
    )
    n = F.coalesce("_n", F.lit(0))
    verdict = (
        F.when(F.col("status").isNull(), "MISSING")
        .when(F.col("status") != "complete", "INCOMPLETE")
        .when(n == 0, "EMPTY")
        .when(~F.coalesce(F.col("_lat").between(-90, 90), F.lit(False)), "OUT OF BOUNDS")
        .otherwise("OK")
    )
    return scenes.join(agg, "scene_id", "left").select(
        "scene_id",
        verdict.alias("verdict"),
        n.alias("n_tiles"),
        F.coalesce("_annotated", F.lit(0)).alias("annotated"),
    )


def batch_status_summary(results: DataFrame) -> DataFrame:
    return results.agg(
        F.count_if(F.col("status") == "ok").alias("ok"),
        F.count_if(F.col("status") == "skipped").alias("skipped"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.coalesce(F.sum("tiles"), F.lit(0)).alias("total_tiles"),
    )


def limit_tiles_per_scene(tiles: DataFrame, n: int) -> DataFrame:
    return top_per_group(tiles, ["scene_id"], ["tile_no", "tile_id"], n)


def sample_tiles_per_scene(tiles: DataFrame, first: int = 12, most: int = 24) -> DataFrame:
    """First 12 tiles of a scene, then annotated ones, 24 at most."""
    head = top_per_group(tiles, ["scene_id"], ["tile_no", "tile_id"], first).withColumn("_turn", F.lit(0))
    noted = top_per_group(
        tiles.where(F.col("n_annotations") > 0), ["scene_id"], ["tile_no", "tile_id"], most
    ).withColumn("_turn", F.lit(1))
    both = head.unionByName(noted)
    names_kept = [c for c in tiles.columns]
    w = Window.partitionBy("scene_id", "tile_id").orderBy("_turn")
    once = both.withColumn("_d", F.row_number().over(w)).where("_d = 1").drop("_d")
    return top_per_group(once, ["scene_id"], ["_turn", "tile_no", "tile_id"], most).select(*names_kept)


def most_annotated_tile(tiles: DataFrame) -> DataFrame:
    """Tile with most annotations per scene, else the one in the middle of the list."""
    best = tiles.groupBy("scene_id").agg(
        F.max("n_annotations").alias("_most"),
        F.count("*").alias("_n"),
        F.max_by("tile_id", F.struct("n_annotations", (-F.col("tile_no")).alias("_early"))).alias("_best"),
    )
    placed = numbered(tiles, ["scene_id"], ["tile_no", "tile_id"], "_rn")
    joined = placed.join(best, "scene_id")
    pick = F.when(F.col("_most") > 0, F.col("tile_id") == F.col("_best")).otherwise(
        F.col("_rn") == F.floor(F.col("_n") / F.lit(2)) + 1
    )
    return joined.where(pick).select(*tiles.columns)


def sample_empty_tiles(
    tiles: DataFrame,
    seed: str,
    empty: int = C.EMPTY_TILES_PER_SCENE,
    cap: int = C.TILES_PER_SCENE_CAP,
) -> DataFrame:
    """All annotated tiles and up to ``empty`` others per scene, ``cap`` in all, by hash order.

    Both numbers are the sampling feature itself.
    """
    mixed = tiles.withColumn("_h", draw_hash(F.col("tile_id"), seed))
    annotated = mixed.where(F.col("n_annotations") > 0).withColumn("selection_reason", F.lit("gfw_annotation"))
    blank = top_per_group(mixed.where(F.col("n_annotations") == 0), ["scene_id"], ["_h", "tile_id"], empty).withColumn(
        "selection_reason", F.lit("empty_control_sample")
    )
    chosen = annotated.unionByName(blank)
    return top_per_group(chosen, ["scene_id"], ["_h", "tile_id"], cap).drop("_h")

