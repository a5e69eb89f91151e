"""Training set in one go: checked tiles, cleaned label lines, splits, a quarantine and observed counts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from seaglint import config as C
from seaglint.operators import labels
from seaglint.session import ensure_checkpoint_dir

LINE_RULES = ("parts", "non_numeric", "outside", "size")
REASONS = ("empty", *LINE_RULES, "no_image", "nodata")


@dataclass
class DatasetBuild:
    """``tiles``: tile_id, scene_id, split, n_boxes, n_duplicates. ``lines``: tile_id, line_no, txt.

    ``quarantine``: tile_id, scene_id, reason, n_lines. ``counts``: tiles by reason, kept and in total, and the
    duplicate boxes that went.
    """

    tiles: DataFrame
    lines: DataFrame
    quarantine: DataFrame
    counts: dict[str, int]


def checked_boxes(lines: DataFrame) -> DataFrame:
    """One row for each tile and coordinate text: its first line, how many say it, and the rules that they break."""
    parsed = labels.parse_lines(lines).withColumn("_why", labels.line_reasons())
    words = labels.parts_of(F.col("txt"))
    coords = F.when(F.col("n_parts") == 5, F.array_join(F.slice(words, 2, 4), " ")).otherwise(F.concat(F.lit("#"), F.col("line_no")))
    broken = [F.bool_or(F.array_contains("_why", rule)).alias(rule) for rule in LINE_RULES]
    first = F.min(F.struct("line_no", "txt")).alias("first")
    return parsed.where("n_parts > 0").groupBy("tile_id", coords.alias("coords")).agg(first, F.count("*").alias("n"), *broken)


def build_dataset(
    files: DataFrame,
    lines: DataFrame,
    images: DataFrame,
    *,
    plan: DataFrame | None = None,
    geo: dict[str, tuple[float, float, float]] | None = None,
    stratify: bool = False,
    limit: float = C.NODATA_LIMIT,
) -> DatasetBuild:
    """Label files to a training set.

    ``files``: tile_id and scene_id of every label file, empty ones too. ``lines``: tile_id, line_no, txt.
    ``images``: tile_id and zero_share. A tile goes to the quarantine for the first reason that holds: no
    line, a line that breaks a rule, no image, too many empty pixels. Repeated boxes of a tile go, the first
    stays. Splits are by platform (``stratify``), by ``plan``, or whole scenes in proportion.

    The lines are read once: boxes are combined before the shuffle and written to the checkpoint folder, and
    the counts are observed while the verdicts are written.
    """
    ensure_checkpoint_dir(lines.sparkSession)
    boxes = checked_boxes(lines).checkpoint()
    per_tile = boxes.groupBy("tile_id").agg(F.sum("n").alias("n_lines"), F.count("*").alias("n_boxes"), *[F.bool_or(r).alias(r) for r in LINE_RULES])
    known = files.join(per_tile, "tile_id", "left").join(images.select("tile_id", "zero_share", F.lit(True).alias("_image")), "tile_id", "left")
    holds = {
        "empty": F.col("n_lines").isNull(),
        **{r: F.col(r) for r in LINE_RULES},
        "no_image": F.col("_image").isNull(),
        "nodata": F.col("zero_share") > limit,
    }
    reason = F.coalesce(*[F.when(holds[r], F.lit(r)) for r in REASONS])
    zero = F.lit(0).cast("bigint")
    judged = known.select(
        "tile_id", "scene_id", reason.alias("reason"), F.coalesce("n_lines", zero).alias("n_lines"), F.coalesce("n_boxes", zero).alias("n_boxes")
    ).withColumn("n_duplicates", F.col("n_lines") - F.col("n_boxes"))
    seen = Observation()
    kept = F.col("reason").isNull()
    verdicts = judged.observe(
        seen, F.count(F.lit(1)).alias("total"), F.count_if(kept).alias("kept"),
        F.coalesce(F.sum(F.when(kept, F.col("n_duplicates"))), F.lit(0)).alias("duplicates"),
        *[F.count_if(F.col("reason") == r).alias(r) for r in REASONS],
    ).checkpoint()
    good = verdicts.where(kept).drop("reason", "n_lines")
    if stratify:
        split = labels.platform_stratified_split(good).drop("platform")
    elif plan is not None:
        split = labels.scene_plan_split(good, plan, geo)
    else:
        split = labels.proportional_scene_split(good)
    own = boxes.join(good.select("tile_id"), "tile_id", "left_semi").select("tile_id", "first.line_no", "first.txt")
    return DatasetBuild(split, own, verdicts.where(~kept).select("tile_id", "scene_id", "reason", "n_lines"), seen.get)
