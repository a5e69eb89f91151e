"""Label lines, dataset filters, splits and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seaglint import config as C
from seaglint.functions import boxes, names
from seaglint.functions.draws import draw_hash
from seaglint.operators.ranking import numbered, top_per_group
from seaglint.operators.selection import cut_groups


def parts_of(text: Column) -> Column:
    return F.split(F.trim(text), r"\s+")


def parse_lines(lines: DataFrame, text: str = "txt") -> DataFrame:
    """Add class_id, cx, cy, w, h of five-part lines (null elsewhere) and ``n_parts``."""
    # Out of a generator the words are a plain column, so the text is split once and not for each use.
    p = F.col("_words")
    out = lines.withColumn("_words", F.explode(F.array(parts_of(F.col(text)))))
    out = out.withColumn("n_parts", F.when(F.trim(text) == "", 0).otherwise(F.size(p)))
    five = F.col("n_parts") == 5
    out = out.withColumn("class_id", F.when(five, F.get(p, F.lit(0)).try_cast("int")))
    for i, n in enumerate(("cx", "cy", "w", "h"), start=1):
        out = out.withColumn(n, F.when(five, F.get(p, F.lit(i)).try_cast("double")))
    return out.drop("_words")


def line_reasons() -> Column:
    """Why a parsed line is structurally bad; a negative class is only a warning."""
    numbers = [F.col(n) for n in ("cx", "cy", "w", "h")]
    numeric = F.col("class_id").isNotNull()
    for n in numbers:
        numeric = numeric & n.isNotNull()
    five = F.col("n_parts") == 5
    outside = F.lit(False)
    for n in numbers:
        outside = outside | ~n.between(0, 1)
    checks = {
        "parts": ~five,
        "non_numeric": five & ~numeric,
        "outside": numeric & outside,
        "size": numeric & ((F.col("w") <= 0) | (F.col("h") <= 0)),
    }
    return F.array_compact(F.array(*[F.when(bad, F.lit(k)) for k, bad in checks.items()]))


def tile_validity(lines: DataFrame, tile: str = "tile_id", text: str = "txt") -> DataFrame:
    """Per tile: number of lines, bad lines, warnings, and whether the tile stays."""
    parsed = parse_lines(lines, text).withColumn("_why", line_reasons())
    return parsed.groupBy(tile).agg(
        F.count("*").alias("n_lines"),
        F.count_if(F.size("_why") > 0).alias("n_bad"),
        F.count_if(F.col("class_id") < 0).alias("n_warnings"),
        F.bool_and(F.size("_why") == 0).alias("valid"),
    )


def drop_duplicate_boxes(lines: DataFrame, tile: str = "tile_id", text: str = "txt", line: str = "line_no") -> DataFrame:
    """Keep the first line of each coordinate text per tile; malformed lines all stay."""
    p = parts_of(F.col(text))
    coords = F.when(F.size(p) == 5, F.array_join(F.slice(p, 2, 4), " "))
    keyed = lines.withColumn("_coords", coords)
    whole = top_per_group(keyed.where(F.col("_coords").isNotNull()), [tile, "_coords"], [line], 1)
    return whole.unionByName(keyed.where(F.col("_coords").isNull())).drop("_coords")


def nodata_share(pixels: DataFrame, keys: list[str], value: str = "v") -> DataFrame:
    """Share of zero pixels per tile of a long pixel table."""
    return pixels.groupBy(*keys).agg(F.avg(F.when(F.col(value) == 0, 1.0).otherwise(0.0)).alias("zero_share"))


def nodata_filter(pixels: DataFrame, keys: list[str], value: str = "v", limit: float = C.NODATA_LIMIT) -> DataFrame:
    """Tiles whose zero share does not exceed the limit."""
    return nodata_share(pixels, keys, value).where(F.col("zero_share") <= limit)


def filter_platform(scenes: DataFrame, allowed: list[str]) -> DataFrame:
    return scenes.where(names.satellite_platform(F.col("scene_id")).isin(*allowed))


def tile_label_join(images: DataFrame, labels: DataFrame, key: str = "tile_id") -> DataFrame:
    return images.join(labels, key)


def resample_box_sizes(lines: DataFrame, key: Column, text: str = "txt", size: int = C.TILE_SIZE) -> DataFrame:
    """New width and height for every well-formed line; other lines stay as they are."""
    parsed = parse_lines(lines, text)
    ok = F.col("class_id").isNotNull()
    for n in ("cx", "cy", "w", "h"):
        ok = ok & F.col(n).isNotNull()
    # The draws are columns, as both sides use them and each side is used twice.
    draws = boxes.size_draws(key)
    parsed = parsed.withColumns({f"_{d}": v for d, v in draws.items()})
    sides = boxes.size_of_draws({d: F.col(f"_{d}") for d in draws}, F.lit(None).cast("string"), size)
    parsed = parsed.withColumns({"_w": sides[0], "_h": sides[1]})
    w, h = F.col("_w"), F.col("_h")
    fresh = F.format_string("%d %.6f %.6f %.6f %.6f", "class_id", "cx", "cy", w, h)
    return (
        parsed.withColumn("resampled", ok)
        .withColumn("new_txt", F.when(ok, fresh).otherwise(F.col(text)))
        .withColumn("new_w", F.when(ok, w))
        .withColumn("new_h", F.when(ok, h))
        .drop("n_parts", "class_id", "cx", "cy", "w", "h", "_w", "_h", *[f"_{d}" for d in draws])
    )


# --- splits ------------------------------------------------------------------------------


SPLITS = ["train", "val", "test"]


def _places(ratios: tuple[float, float, float]) -> list[Column]:
    """Rows in train, and in train and val, of ``n`` ordered rows."""
    part = [F.floor(F.col("n") * F.lit(float(r)) / F.lit(float(sum(ratios)))) for r in ratios[:2]]
    return [part[0], part[0] + part[1]]


def chunk_split(
    tiles: DataFrame, by: list[str], ratios: tuple[float, float, float] = (70, 15, 15)) -> DataFrame:
    """Contiguous train/val/test chunks of the tile_id order inside each group.

    The cut keys are found by ``selection.cut_keys``; rows are neither sorted nor numbered, so a group may
    hold any share of them.
    """
    return cut_groups(tiles, by, F.col("tile_id"), _places(ratios), SPLITS, "split")


def geo_split(tiles: DataFrame, ratios: tuple[float, float, float] = (70, 15, 15)) -> DataFrame:
    return chunk_split(tiles, ["scene_id"], ratios)


def platform_stratified_split(tiles: DataFrame) -> DataFrame:
    keyed = tiles.withColumn("platform", names.satellite_platform(F.col("scene_id")))
    return chunk_split(keyed, ["platform"], (70, 15, 15))


def scene_plan_split(tiles: DataFrame, plan: DataFrame, geo: dict[str, tuple[float, float, float]] | None = None) -> DataFrame:
    """Split named by a plan table (scene_id, split); unknown names mean train.

    Scenes listed in ``geo`` are cut into chunks instead. A plan that does not name all scenes counts for
    nothing: then all scenes are split whole, in proportion (``proportional_scene_split``).
    """
    known = F.when(F.col("plan").isin(*SPLITS), F.col("plan")).otherwise("train")
    geo = geo or {}
    named = plan.select("scene_id", F.col("split").alias("plan"), F.lit(True).alias("_named"))
    scenes = tiles.select("scene_id").distinct().join(named, "scene_id", "left")
    complete = scenes.agg(F.coalesce(F.bool_and(F.coalesce("_named", F.lit(False))), F.lit(True)).alias("c")).scalar()
    plain = tiles.where(~F.col("scene_id").isin(*geo)) if geo else tiles
    out = plain.join(named, "scene_id").where(complete).select(*tiles.columns, known.alias("split"))
    for scene, ratios in geo.items():
        out = out.unionByName(geo_split(tiles.where(F.col("scene_id") == scene), ratios).where(complete))
    return out.unionByName(proportional_scene_split(tiles).where(~complete).select(*tiles.columns, "split"))


def proportional_scene_split(tiles: DataFrame) -> DataFrame:
    """Whole scenes to splits, in scene order: 60 % train, 20 % val, the rest test."""
    scenes = tiles.select("scene_id").distinct()
    placed = numbered(scenes, [], ["scene_id"], "_rn")
    n = scenes.agg(F.count("*").alias("n")).scalar()
    train0 = F.greatest(F.lit(1), F.floor(n * F.lit(0.6)))
    val0 = F.greatest(F.lit(1), F.floor(n * F.lit(0.2)))
    test = F.greatest(F.lit(1), n - train0 - val0)
    train = F.when(n >= 3, train0).otherwise(F.lit(1))
    val = F.when(n >= 3, F.when(n - train0 - val0 < 1, n - train0 - test).otherwise(val0)).otherwise(F.lit(0))
    split = (
        F.when(F.col("_rn") <= train, "train").when(F.col("_rn") <= train + val, "val").otherwise("test")
    )
    return tiles.join(placed.select("scene_id", split.alias("split")), "scene_id")


def random_split(
    tiles: DataFrame, seed: str, ratios: tuple[float, float, float] = (80, 10, 10)) -> DataFrame:
    """Seeded shuffle by hash order, then exact cuts."""
    mixed = F.concat(draw_hash(F.col("tile_id"), seed), F.col("tile_id"))
    return cut_groups(tiles, [], mixed, _places(ratios), SPLITS, "split")


def split_estimate(scenes: DataFrame) -> DataFrame:
    """Dry run: split sizes per platform and in total, from label counts per scene."""
    n = F.sum("n_labels")
    per = scenes.groupBy(names.satellite_platform(F.col("scene_id")).alias("platform")).agg(n.alias("n"))
    per = per.withColumn("n_train", F.floor(F.col("n") * 70 / F.lit(100))).withColumn(
        "n_val", F.floor(F.col("n") * 15 / F.lit(100))
    )
    per = per.withColumn("n_test", F.col("n") - F.col("n_train") - F.col("n_val"))
    out = per.rollup("platform").agg(*[F.sum(c).alias(c) for c in ("n", "n_train", "n_val", "n_test")])
    return out.withColumn("platform", F.coalesce("platform", F.lit("TOTAL"))).withColumn(
        "too_few", F.col("n_train") < 30
    )


# --- summaries ---------------------------------------------------------------------------


def class_counts(parsed: DataFrame) -> DataFrame:
    return parsed.agg(*[F.count_if(F.col("class_id") == i).alias(f"class_{i}") for i in sorted(C.LABEL_CLASSES.values())])


def dataset_summary(assigned: DataFrame) -> DataFrame:
    """Images and boxes per split and scene with totals: one row per (split, scene, both, none)."""
    return (
        assigned.rollup("split", "scene_id")
        .agg(F.count("*").alias("images"), F.sum("n_boxes").alias("boxes"))
        .select(
            F.coalesce("split", F.lit("ALL")).alias("split"),
            F.coalesce("scene_id", F.lit("ALL")).alias("scene_id"),
            "images",
            "boxes",
        )
    )


def split_platform_composition(assigned: DataFrame) -> DataFrame:
    """Platform shares per split, with an alert above 80 percent."""
    p = names.satellite_platform(F.col("tile_id"))
    counts = assigned.groupBy("split").agg(
        F.count_if(p == "S1C").alias("s1c"),
        F.count_if(p == "S1D").alias("s1d"),
        F.count_if(~p.isin("S1C", "S1D")).alias("other"),
        F.count("*").alias("total"),
    )
    pc = F.col("s1c") * 100.0 / F.col("total")
    pd_ = F.col("s1d") * 100.0 / F.col("total")
    alert = F.when(pc > 80, "S1C").when(pd_ > 80, "S1D").otherwise("")
    return counts.withColumn("pct_s1c", pc).withColumn("pct_s1d", pd_).withColumn("alert", alert)


def split_integrity(images: DataFrame, labels: DataFrame) -> DataFrame:
    a = images.groupBy("split").agg(F.count("*").alias("n_images"))
    b = labels.groupBy("split").agg(F.count("*").alias("n_labels"))
    zero = F.lit(0)
    out = a.join(b, "split", "full_outer")
    out = out.withColumn("n_images", F.coalesce("n_images", zero)).withColumn("n_labels", F.coalesce("n_labels", zero))
    return out.withColumn("mismatch", F.col("n_images") != F.col("n_labels"))


def box_size_distribution(parsed: DataFrame) -> DataFrame:
    """Count, sameness and spread of box sizes (population deviation)."""
    ok = parsed.where(F.col("w").isNotNull() & F.col("h").isNotNull())
    aggs = [
        F.count("*").alias("total_boxes"),
        ((F.min("w") == F.max("w")) & (F.min("h") == F.max("h"))).alias("all_fixed_size"),
        F.countDistinct(F.round("w", 6)).alias("unique_widths"),
        F.countDistinct(F.round("h", 6)).alias("unique_heights"),
    ]
    for c in ("w", "h"):
        aggs += [
            F.avg(c).alias(f"{c}_mean"),
            F.stddev_pop(c).alias(f"{c}_std"),
            F.min(c).alias(f"{c}_min"),
            F.max(c).alias(f"{c}_max"),
        ]
    return ok.agg(*aggs)


# --- text forms --------------------------------------------------------------------------


def yolo_line(class_id: Column, cx: Column, cy: Column, w: Column, h: Column) -> Column:
    return F.format_string("%d %.6f %.6f %.6f %.6f", class_id, cx, cy, w, h)


def cvat_boxes(annotations: DataFrame, order: list, size: int = C.TILE_SIZE) -> DataFrame:
    """Box rows of an annotation file: clamped corners with one decimal, place in the image."""
    s = F.lit(float(size))
    x1, y1, x2, y2 = boxes.corners(*[F.col(c) for c in ("cx", "cy", "w", "h")])
    zero = F.lit(0.0)
    one = lambda v: F.format_string("%.1f", v)
    rows = numbered(annotations, ["tile_id"], order, "_rn")
    return rows.select(
        "scene_id",
        F.concat("tile_id", F.lit(".npy")).alias("image"),
        F.concat(F.lit("vessel_"), "label").alias("label"),
        one(F.greatest(zero, x1 * s)).alias("xtl"),
        one(F.greatest(zero, y1 * s)).alias("ytl"),
        one(F.least(s, x2 * s)).alias("xbr"),
        one(F.least(s, y2 * s)).alias("ybr"),
        (F.col("_rn") - 1).cast("bigint").alias("z_order"),
    )
