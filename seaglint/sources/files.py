"""Readers for landed files. Each returns one row per record, spread by Spark over the files."""

from __future__ import annotations

import fnmatch
import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seaglint import schemas
from seaglint.functions import names, orbit
from seaglint.session import qualified, ship_package


def file_listing(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """(path, length) of matching files below ``root``, empty ones included.

    Spark's own sources leave empty files out. The driver lists the first folder level only;
    every folder is then listed by a task. Contents are never read.
    """
    ship_package(spark)
    uri = qualified(spark, root)
    fs, base = pafs.FileSystem.from_uri(uri)
    top = fs.get_file_info(pafs.FileSelector(base))
    folders = [(i.path, True) for i in top if i.type == pafs.FileType.Directory] + [(base, False)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task_fs, _ = pafs.FileSystem.from_uri(uri)
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                found = task_fs.get_file_info(pafs.FileSelector(row.folder, recursive=row.deep))
                keep = [
                    (i.path, i.size)
                    for i in found
                    if i.type == pafs.FileType.File and fnmatch.fnmatch(i.base_name, pattern)
                ]
                yield pd.DataFrame(keep, columns=["path", "length"])

    parts = min(len(folders), spark.sparkContext.defaultParallelism * 4)
    table = spark.createDataFrame(folders, "folder string, deep boolean").repartition(parts, "folder")
    return table.mapInPandas(run, "path string, length bigint")


def stem(path: Column) -> Column:
    # The name is taken off first: over the whole path the pattern is tried at each of its characters.
    return F.regexp_extract(F.substring_index(path, "/", -1), r"([^/]+?)(\.[^./]*)?$", 1)


def parent(path: Column, up: int = 1) -> Column:
    return F.element_at(F.split(path, "/"), -1 - up)


def scan_tile_manifests(spark: SparkSession, root: str) -> DataFrame:
    """One row per tile of every ``metadata.json`` under ``root``."""
    m = (
        spark.read.schema(schemas.TILE_MANIFEST)
        .option("multiLine", True)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "metadata.json")
        .json(root)
    )
    tiles = m.withColumn("t", F.explode("tiles"))
    geo = F.col("t.geo_bbox")
    return tiles.select(
        m["scene_id"],
        m["pipeline"],
        "tile_size",
        "target_density_cell_index",
        "target_cell_bbox",
        "targeting_protocol",
        F.col("t.tile_id").alias("tile_id"),
        F.col("t.pixel_bbox").alias("pixel_bbox"),
        *[geo[i].alias(n) for i, n in enumerate(("lat_min", "lon_min", "lat_max", "lon_max"))],
        F.col("t.npy_path").alias("npy_path"),
    )


def scan_label_files(spark: SparkSession, root: str, five_only: bool = True) -> DataFrame:
    """Label lines with tile id and line number; by default only lines of five parts."""
    raw = (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.txt")
        .text(root, wholetext=True)
        # Made below the generator, so once for each file and not for each line.
        .select(stem(F.col("_metadata.file_path")).alias("tile_id"), F.split("value", "\r?\n").alias("_lines"))
    )
    lines = raw.select("tile_id", F.posexplode("_lines").alias("line_no", "txt")).where(F.trim("txt") != "")
    if five_only:
        lines = lines.where(F.size(F.split(F.trim("txt"), r"\s+")) == 5)
    return lines


def list_label_files(spark: SparkSession, root: str) -> DataFrame:
    return file_listing(spark, root, "*.txt").select(
        stem(F.col("path")).alias("tile_id"), parent(F.col("path"), 2).alias("scene_id"), "length"
    )


def non_empty_labels(listing: DataFrame) -> DataFrame:
    return listing.where(F.col("length") > 0)


def discover_scenes(spark: SparkSession, root: str, allowed: list[str] | None = None) -> DataFrame:
    """Scenes laid out as ``<scene>/labels/*.txt`` and ``<scene>/cvat_import/images/*.png``.

    ``total_boxes`` counts the lines of the label files only.
    """

    def per_scene(pattern, folder, name, up=2):
        f = file_listing(spark, root, pattern).where(F.col("path").rlike(f"/[^/]+/{folder}/[^/]+$"))
        scene = parent(F.col("path"), up)
        return f.where(~scene.startswith(".")).groupBy(scene.alias("scene_id")).agg(F.count("*").alias(name))

    boxes = (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.txt")
        .text(root)
        .select(F.col("_metadata.file_path").alias("path"), "value")
        .where(parent(F.col("path"), 1) == "labels")
        .select(parent(F.col("path"), 2).alias("scene_id"), "value")
        .where(F.trim("value") != "")
        .groupBy("scene_id")
        .agg(F.count("*").alias("total_boxes"))
    )
    out = (
        per_scene("*.txt", "labels", "n_labels")
        .join(per_scene("*.png", "cvat_import/images", "n_images", 3), "scene_id")
        .join(boxes, "scene_id", "left")
        .fillna(0, ["total_boxes"])
        .withColumn("short_id", names.short_scene_id(F.col("scene_id")))
    )
    if allowed:
        out = out.where(names.satellite_platform(F.col("scene_id")).isin(*allowed))
    return out


def response_entries(raw: DataFrame, text: str = "value") -> DataFrame:
    """Flatten landed API answers to one JSON record per row.

    The first list among entries, results, data, rows, features counts; lists of wrappers
    (``{dataset: [...]}``) and the top-level grouped form are opened. Null answers give nothing.
    """
    fields = ("entries", "results", "data", "rows", "features")

    def as_list(v: Column) -> Column:
        return F.from_json(v, "array<string>")

    def json_list(name: str) -> Column:
        item = F.get_json_object(text, f"$.{name}")
        return F.when(item.startswith("["), as_list(item))

    listed = F.coalesce(*[json_list(n) for n in fields])
    whole = F.from_json(text, "map<string,string>")
    lists = F.filter(F.map_values(whole), lambda v: v.startswith("[{"))
    top_level = F.flatten(F.transform(lists, as_list))

    def opened(item: Column) -> Column:
        inner = F.filter(F.map_values(F.from_json(item, "map<string,string>")), lambda v: v.startswith("["))
        return F.flatten(F.transform(inner, as_list))

    wrapped = F.exists(
        F.map_values(F.from_json(F.get(listed, F.lit(0)), "map<string,string>")), lambda v: v.startswith("[")
    )
    unwrapped = F.flatten(F.transform(listed, opened))
    from_fields = F.when(F.coalesce(wrapped, F.lit(False)) & (F.size(unwrapped) > 0), unwrapped).otherwise(listed)
    entries = F.when(listed.isNotNull(), from_fields).otherwise(top_level)
    keep = [c for c in raw.columns if c != text]
    return raw.select(*keep, F.explode(entries).alias("record"))


def scan_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Products of landed catalogue answers (``value`` list); missing numbers and texts get defaults."""
    schema = "value array<struct<Id:string,Name:string,ContentDate:struct<Start:string>,ContentLength:bigint,Footprint:string>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("value").alias("p"))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return rows.select(
        text("p.Id").alias("id"),
        text("p.Name").alias("name"),
        F.try_to_timestamp(F.col("p.ContentDate.Start")).alias("date"),
        F.coalesce("p.ContentLength", F.lit(0)).cast("bigint").alias("size"),
        text("p.Footprint").alias("footprint"),
    )


def _vector(spark: SparkSession, path: str, tag: str, field: str) -> DataFrame:
    """LUT vectors of one XML tag as (path, line, pixels, values)."""
    schema = f"line bigint, pixel struct<_VALUE:string,_count:bigint>, {field} struct<_VALUE:string,_count:bigint>"
    raw = (
        spark.read.format("xml")
        .schema(schema)
        .option("rowTag", tag)
        .load(path)
        .withColumn("path", F.col("_metadata.file_path"))
    )

    def numbers(c, kind):
        return F.transform(F.split(F.trim(c), r"\s+"), lambda v: v.cast(kind))

    return raw.select(
        "path", "line",
        numbers(F.col("pixel._VALUE"), "bigint").alias("pixels"),
        numbers(F.col(f"{field}._VALUE"), "double").alias("values"),
    )


def calibration_vectors(spark: SparkSession, path: str) -> DataFrame:
    return _vector(spark, path, "calibrationVector", "sigmaNought")


def noise_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Range-noise vectors in the newer or the older spelling of the file."""
    new = _vector(spark, path, "noiseRangeVector", "noiseRangeLut")
    old = _vector(spark, path, "noiseVector", "noiseLut")
    return new.unionByName(old)


def explode_vectors(vectors: DataFrame) -> DataFrame:
    """LUT table (path, line, pixel, value)."""
    return vectors.select("path", "line", F.explode(F.arrays_zip("pixels", "values")).alias("n")).select(
        "path", "line", F.col("n.pixels").alias("pixel"), F.col("n.values").alias("value")
    )


def scan_footprints(spark: SparkSession, root: str) -> DataFrame:
    """Scene box from the coordinates of each ``manifest.safe``; date from the scene name."""
    raw = (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", "manifest.safe")
        .text(root, wholetext=True)
        .select(parent(F.col("_metadata.file_path"), 1).alias("folder"), "value")
    )
    text = F.regexp_extract("value", r"<gml:coordinates>([^<]*)</gml:coordinates>", 1)
    pairs = F.transform(F.split(F.trim(text), r"\s+"), lambda p: F.split(p, ","))
    lat = F.transform(pairs, lambda p: p[0].try_cast("double"))
    lon = F.transform(pairs, lambda p: p[1].try_cast("double"))
    sid = names.scene_id_normalize(F.col("folder"))
    return raw.where(text != "").select(
        sid.alias("scene_id"),
        F.array_min(lon).alias("lon_min"),
        F.array_min(lat).alias("lat_min"),
        F.array_max(lon).alias("lon_max"),
        F.array_max(lat).alias("lat_max"),
        F.to_date(F.substring(F.get(F.split(sid, "_"), F.lit(4)), 1, 8), "yyyyMMdd").alias("date"),
    )


def scan_target_traces(spark: SparkSession, root: str) -> DataFrame:
    """Traces that lie inside a scene folder; a trace beside the folders is ignored."""
    return (
        spark.read.schema(schemas.TARGET_TRACE)
        .option("multiLine", True)
        .json(f"{root.rstrip('/')}/*.SAFE/target_trace.json")
        .withColumn("folder", names.scene_id_normalize(parent(F.col("_metadata.file_path"), 1)))
    )


def scan_tle_sets(spark: SparkSession, json_path: str | None = None, text_path: str | None = None) -> DataFrame:
    """Element sets from JSON lists (first record) and three-line text files (file name = number)."""
    parts = []
    number = stem(F.col("_metadata.file_path")).try_cast("bigint")
    if json_path:
        raw = spark.read.text(json_path, wholetext=True).select(number.alias("norad_id"), "value")
        rec = F.get(F.from_json("value", "array<struct<tle0:string,tle1:string,tle2:string>>"), F.lit(0))
        parts.append(
            raw.select("norad_id", rec.alias("r")).select(
                "norad_id",
                orbit.satnogs_name(F.col("r.tle0"), F.col("norad_id")).alias("name"),
                F.col("r.tle1").alias("tle1"),
                F.col("r.tle2").alias("tle2"),
                F.lit("satnogs").alias("source"),
            )
        )
    if text_path:
        raw = spark.read.text(text_path, wholetext=True).select(number.alias("norad_id"), "value")
        lines = F.filter(F.transform(F.split("value", "\r?\n"), lambda v: F.trim(v)), lambda v: v != "")
        parts.append(
            raw.select(
                "norad_id",
                F.get(lines, F.lit(0)).alias("name"),
                F.get(lines, F.lit(1)).alias("tle1"),
                F.get(lines, F.lit(2)).alias("tle2"),
                F.lit("celestrak").alias("source"),
            )
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where(orbit.lines_ok(F.col("tle1"), F.col("tle2")))


def pick_product_files(listing: DataFrame, polarization: str = "vv") -> tuple[DataFrame, DataFrame]:
    """(complete, rejected) products with measurement, calibration and noise file.

    A COG measurement comes before a standard one; wider name patterns are a fallback.
    """
    pol = polarization.lower()
    path = F.col("path")
    base = F.lower(F.element_at(F.split(path, "/"), -1))
    tiff = path.rlike("/measurement/[^/]*\\.tiff?$")
    rank = (
        F.when(tiff & base.rlike(f"-{pol}-.*cog"), 0)
        .when(tiff & base.rlike(f"-{pol}-"), 1)
        .when(tiff & base.rlike(f"-{pol}"), 2)
        .when(tiff & F.contains(base, F.lit(pol)), 3)
    )
    cal = path.rlike("/calibration/") & base.rlike(f"^calibration-.*{pol}.*\\.xml$")
    noise = path.rlike("/calibration/") & base.rlike(f"^noise-.*{pol}.*\\.xml$")
    product = F.regexp_extract(path, r"([^/]+)\.SAFE/", 1)
    per = (
        listing.withColumn("product", product)
        .where(F.col("product") != "")
        .groupBy("product")
        .agg(
            F.min_by("path", F.when(rank.isNotNull(), F.struct(rank.alias("a"), path.alias("b")))).alias("measurement"),
            F.min(F.when(cal, path)).alias("calibration"),
            F.min(F.when(noise, path)).alias("noise"),
        )
    )
    good = F.col("measurement").isNotNull() & F.col("calibration").isNotNull()
    missing = F.concat_ws(
        ",",
        F.when(F.col("measurement").isNull(), F.lit("measurement")),
        F.when(F.col("calibration").isNull(), F.lit("calibration")),
    )
    return per.where(good), per.where(~good).withColumn("missing", missing)


def read_npy_tiles(spark: SparkSession, root: str) -> DataFrame:
    """``.npy`` files as a tile table; one file is decoded at a time."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.npy")
        .load(root)
        .select(stem(F.col("path")).alias("tile_id"), "content")
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                a = np.ascontiguousarray(np.load(io.BytesIO(row.content), allow_pickle=False))
                yield pd.DataFrame(
                    [(row.tile_id, a.shape[0], a.shape[1], str(a.dtype), a.tobytes())],
                    columns=["tile_id", "h", "w", "dtype", "data"],
                )

    return files.mapInPandas(run, schemas.RASTER)
