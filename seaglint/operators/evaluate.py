"""Detector scores, distribution distances, verdicts and annotation reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seaglint import config as C


def ratio(a: Column, b: Column, default: Column | None = None) -> Column:
    value = F.when(b > 0, F.try_divide(a, b))
    return value if default is None else F.coalesce(value, default)


def round4(v: Column) -> Column:
    """Round half up at four decimals, the same on every engine."""
    return F.floor(v * 10000.0 + 0.5) / 10000.0


def tile_scores(
    preds: DataFrame, labels: DataFrame, matches: DataFrame, tile: str = "tile_id"
) -> DataFrame:
    """Counts per tile over the union of tiles with predictions or labels."""
    counts = [d.groupBy(tile).agg(F.count("*").alias(n)) for d, n in ((preds, "n_pred"), (labels, "n_gt"), (matches, "tp"))]
    return joined_scores(*counts, [tile])


def joined_scores(n_pred: DataFrame, n_gt: DataFrame, tp: DataFrame, keys: list[str]) -> DataFrame:
    """Counts by the same keys side by side, 0 where there is none."""
    out = n_pred.join(n_gt, keys, "full_outer").join(tp, keys, "left")
    zero = F.lit(0)
    return out.select(
        *keys, *[F.coalesce(c, zero).cast("bigint").alias(c) for c in ("n_pred", "n_gt", "tp")]
    )


def detection_metrics(scores: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Precision, recall and counts over all tiles; 0 where undefined.

    ``map50_as_precision`` carries the value reported as mAP@0.5, which is the precision.
    """
    agg = scores.groupBy(*(by or [])).agg(
        F.coalesce(F.sum("tp"), F.lit(0)).alias("tp"),
        F.coalesce(F.sum(F.col("n_pred") - F.col("tp")), F.lit(0)).alias("fp"),
        F.coalesce(F.sum(F.col("n_gt") - F.col("tp")), F.lit(0)).alias("fn"),
    )
    zero = F.lit(0.0)
    p = ratio(F.col("tp"), F.col("tp") + F.col("fp"), zero)
    r = ratio(F.col("tp"), F.col("tp") + F.col("fn"), zero)
    return (
        agg.withColumn("precision", round4(p))
        .withColumn("recall", round4(r))
        .withColumn("map50_as_precision", round4(F.when(p + r > 0, p).otherwise(zero)))
    )


def detection_metrics_labelled(scores: DataFrame, by: list[str] | None = None) -> DataFrame:
    """As above over labelled tiles only; undefined values stay null."""
    agg = scores.groupBy(*(by or [])).agg(
        F.count("*").alias("tiles_eval"),
        F.coalesce(F.sum("n_gt"), F.lit(0)).alias("gt_boxes"),
        F.coalesce(F.sum(F.when(F.col("n_gt") > 0, F.col("tp"))), F.lit(0)).alias("tp"),
        F.coalesce(F.sum(F.when(F.col("n_gt") > 0, F.col("n_pred") - F.col("tp"))), F.lit(0)).alias("fp"),
        F.coalesce(F.sum(F.when(F.col("n_gt") > 0, F.col("n_gt") - F.col("tp"))), F.lit(0)).alias("fn"),
    )
    return agg.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn(
        "recall", ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    )


def f1_and_verdict(metrics: DataFrame, score: str = "map50_as_precision") -> DataFrame:
    p, r = F.col("precision"), F.col("recall")
    s = F.col(score)
    verdict = F.when(s > 0.70, "GO").when(s > 0.50, "MARGINAL").when(s > 0.30, "BELOW").otherwise("FAILED")
    return metrics.withColumn("f1", p * 2.0 * r / (p + r + F.lit(1e-10))).withColumn("verdict", verdict)


def quantisation_loss(df: DataFrame, full: str = "fp32", small: str = "int8") -> DataFrame:
    loss = F.when(F.col(full) == 0, 0.0).otherwise(F.try_divide((F.col(full) - F.col(small)), F.col(full)) * 100.0)
    return df.withColumn("loss_percent", loss).withColumn("passed", loss < 1.0)


def intensity_histogram(pixels: DataFrame, by: str = "code", value: str = "v") -> DataFrame:
    """Counts and shares of the 256 pixel levels per processing code."""
    n = pixels.groupBy(by, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(by)  # at most 256 levels per code
    return n.withColumn("share", F.col("n") / F.sum("n").over(w))


def ks_distances(hist: DataFrame, by: str = "code", value: str = "v") -> DataFrame:
    """Two-sample KS distance of every pair of codes, from level counts (bounded: 256 per code).

    Every code is filled up to all levels seen, so that the cumulative shares line up.
    """
    levels = hist.select(value).distinct().agg(F.array_sort(F.collect_list(value)).alias("l"))
    filled = (
        hist.select(by).distinct().withColumn(value, F.explode(levels.scalar())).join(hist, [by, value], "left")
    )
    n = F.coalesce("n", F.lit(0))
    run = F.sum(n).over(Window.partitionBy(by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    cdf = filled.select(by, value, (run / F.sum(n).over(Window.partitionBy(by))).alias("cdf"))
    a, b = cdf.alias("a"), cdf.alias("b")
    pair = a.join(b, (F.col(f"a.{value}") == F.col(f"b.{value}")) & (F.col(f"a.{by}") < F.col(f"b.{by}")))
    return pair.groupBy(F.col(f"a.{by}").alias("first"), F.col(f"b.{by}").alias("second")).agg(
        F.max(F.abs(F.col("a.cdf") - F.col("b.cdf"))).alias("ks")
    )


def ks_max_distance(hist: DataFrame, by: str = "code", value: str = "v") -> DataFrame:
    return ks_distances(hist, by, value).agg(round4(F.coalesce(F.max("ks"), F.lit(0.0))).alias("ks_max"))


def annotation_report(tiles: DataFrame, detections: DataFrame, annotations: DataFrame) -> DataFrame:
    """Per scene: tiles, annotated tiles, seeds, dark candidates, annotations and class counts."""
    t = tiles.groupBy("scene_id").agg(F.count("*").alias("tile_count"))
    d = detections.groupBy("scene_id").agg(
        F.count_if(F.col("source") == C.SEED_SOURCE).alias("ais_presence_seeds"),
        F.count_if(F.col("source") == C.GAP_SOURCE).alias("dark_vessel_candidates"),
    )
    a = annotations.groupBy("scene_id").agg(
        F.countDistinct("tile_id").alias("annotated_tiles"),
        F.count("*").alias("total_annotations"),
        *[F.count_if(F.col("label") == n).alias(n) for n in C.LABEL_CLASSES],
    )
    out = t.join(d, "scene_id", "left").join(a, "scene_id", "left")
    return out.select("scene_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in out.columns if c != "scene_id"])


def global_summary(report: DataFrame, traces: DataFrame) -> DataFrame:
    """Sums over all scenes and the trace of the first scene that has one."""
    j = report.join(traces.select("scene_id", "target_density_cell_index"), "scene_id", "left")
    has = F.col("target_density_cell_index").isNotNull()
    return j.agg(
        F.count("*").alias("scenes"),
        F.sum("total_annotations").alias("total_annotations"),
        *[F.sum(n).alias(n) for n in C.LABEL_CLASSES],
        F.coalesce(F.min_by("target_density_cell_index", F.when(has, F.col("scene_id"))), F.lit(-1)).alias("first_trace_cell"),
    )
