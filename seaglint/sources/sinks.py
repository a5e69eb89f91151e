"""Writers. Output is spread over tasks; a crowded tile or scene may have several part files."""

from __future__ import annotations

import io
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seaglint.functions import geo
from seaglint.operators.labels import yolo_line
from seaglint.session import qualified, ship_package


def write_tiles(tiles: DataFrame, path: str) -> None:
    """Tile table partitioned by scene and processing code; other scenes and codes in it stay."""
    writer = tiles.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("scene_id", "code").parquet(path)


def write_npy_tiles(tiles: DataFrame, folder: str) -> int:
    """One ``.npy`` file per tile, written by the tasks; a repeated task overwrites its files."""
    ship_package(tiles.sparkSession)
    uri = qualified(tiles.sparkSession, folder)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = pafs.FileSystem.from_uri(uri)
        fs.create_dir(base, recursive=True)
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                held = io.BytesIO()
                np.save(held, np.frombuffer(r.data, dtype=r.dtype).reshape(r.h, r.w))
                with fs.open_output_stream(f"{base}/{r.tile_id}.npy") as f:
                    f.write(held.getvalue())
            yield pd.DataFrame({"n": [len(pdf)]})

    done = tiles.select("tile_id", "h", "w", "dtype", "data").mapInPandas(run, "n bigint")
    return done.agg(F.sum("n")).first()[0] or 0


def write_files(rows: DataFrame, folder: str) -> int:
    """One file for each row, ``content`` (text) at ``path`` below the folder, written by the tasks."""
    ship_package(rows.sparkSession)
    uri = qualified(rows.sparkSession, folder)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = pafs.FileSystem.from_uri(uri)
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                fs.create_dir(f"{base}/{r.path}".rpartition("/")[0], recursive=True)
                with fs.open_output_stream(f"{base}/{r.path}") as f:
                    f.write(r.content.encode())
            yield pd.DataFrame({"n": [len(pdf)]})

    return rows.select("path", "content").mapInPandas(run, "n bigint").agg(F.sum("n")).first()[0] or 0


def tile_manifests(tiles: DataFrame) -> DataFrame:
    """One manifest row per scene and code: totals and sizes; tile rows stay in their table."""
    return tiles.groupBy("scene_id", "code").agg(
        F.count("*").alias("valid_tiles"), F.sum(F.length("data")).alias("bytes"), F.max("tile_no").alias("last_tile")
    )


def export_csv(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """CSV with a header; columns outside ``columns`` are ignored."""
    df.select(*(columns or df.columns)).write.mode("overwrite").option("header", True).csv(path)


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def geojson_features(df: DataFrame) -> DataFrame:
    """One feature per row with coordinates; the other columns become properties."""
    rest = F.struct(*[c for c in df.columns if c not in ("lat", "lon")])
    placed = df.where(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    return placed.select(geo.geojson_point(F.col("lat"), F.col("lon"), rest).alias("value"))


def export_geojson(df: DataFrame, path: str) -> None:
    geojson_features(df).write.mode("overwrite").text(path)


def export_yolo(annotations: DataFrame, path: str) -> None:
    """Label lines by scene, as Parquet with the tile as a column.

    A folder for each tile would be more folders than a file system bears. ``REBALANCE`` lets Spark cut
    the scenes to files of like size, so a scene with many lines has many writers.
    """
    lines = annotations.select("scene_id", "tile_id", yolo_line(*[F.col(c) for c in ("class_id", "cx", "cy", "w", "h")]).alias("line"))
    lines.hint("rebalance", F.col("scene_id")).write.mode("overwrite").partitionBy("scene_id").parquet(path)


#: Boxes in one XML file, about 25 MB; a reader cannot cut such a file.
BOXES_PER_FILE = 100_000


def export_cvat(box_rows: DataFrame, path: str, compression: str = "none") -> None:
    """Box rows as XML, one ``box`` element each, in folders by scene.

    A file holds ``BOXES_PER_FILE`` boxes at most, as it is read by one task. ``compression`` names a codec of
    Spark's text writers (``gzip``), which readers know by the end of the file name.
    """
    writer = box_rows.write.mode("overwrite").option("rowTag", "box").option("rootTag", "annotations").option("maxRecordsPerFile", BOXES_PER_FILE)
    writer.option("compression", compression).format("xml").partitionBy("scene_id").save(path)


def export_metrics(metrics: DataFrame, path: str) -> None:
    metrics.write.mode("overwrite").json(f"{path}/json")
    metrics.write.mode("overwrite").option("header", True).csv(f"{path}/csv")


def dataset_yaml(summary: DataFrame, yaml_path: str, summary_path: str) -> dict:
    """data.yaml and dataset_summary.json from a split summary (splits plus totals: few rows)."""
    rows = summary.where((F.col("scene_id") == "ALL")).select("split", "images", "boxes").collect()
    by = {r["split"]: r for r in rows}
    splits = ("train", "val", "test")
    text = ["path: ."] + [f"{s}: images/{s}" for s in splits] + ["", "nc: 1", "names: ['vessel']", ""]
    def put(path: str, content: str) -> None:
        fs, at = pafs.FileSystem.from_uri(qualified(summary.sparkSession, path))
        fs.create_dir(at.rpartition("/")[0], recursive=True)
        with fs.open_output_stream(at) as f:
            f.write(content.encode())

    put(yaml_path, "\n".join(text))
    total = by.get("ALL")
    out = {
        "total_images": total["images"] if total else 0,
        "total_boxes": total["boxes"] if total else 0,
        "classes": ["vessel"],
        "split": {s: (by[s]["images"] if s in by else 0) for s in splits},
    }
    put(summary_path, json.dumps(out, indent=1))
    return out
