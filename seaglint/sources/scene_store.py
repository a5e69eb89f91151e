"""Processed scenes as one store: tiles and manifests that are visible together or not at all.

Each run writes its tiles and its manifests into folders of its own, and one small commit file last. Readers
take the runs that the commits name, the last one for each scene and processing code. What a run that died
has left behind is never read, and a later run does its scenes again.
"""

from __future__ import annotations

import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seaglint.operators.ranking import newest_per_key

KEYS = ["scene_id", "pipeline"]
TILES = "pipeline string, tile_id string, tile_no bigint, h int, w int, dtype string, data binary, run string, scene_id string"


class SceneStore:
    def __init__(self, root: str):
        self.root = root.rstrip("/")

    def new_run(self) -> str:
        return uuid.uuid4().hex

    def folder(self, kind: str, run: str) -> str:
        return f"{self.root}/{kind}/run={run}"

    def stage_tiles(self, tiles: DataFrame, run: str) -> DataFrame:
        """Write the tiles of a run; returns what was written, still invisible to readers."""
        tiles.withColumnRenamed("code", "pipeline").write.partitionBy("scene_id").parquet(self.folder("tiles", run))
        return self._tiles(tiles.sparkSession, self.folder("tiles", run))

    def _tiles(self, spark: SparkSession, path: str) -> DataFrame:
        # The schema is given, as a run without tiles has no file to tell it.
        return spark.read.schema(TILES).option("basePath", f"{self.root}/tiles").parquet(path)

    def commit(self, manifests: DataFrame, run: str) -> None:
        """Write the manifests of a run, then the record that makes them and their tiles visible."""
        manifests.write.parquet(self.folder("manifests", run))
        spark = manifests.sparkSession
        written = spark.read.parquet(self.folder("manifests", run))
        record = written.select(*KEYS, F.lit(run).alias("run"), F.lit(time.time_ns()).alias("at"), F.col("valid_tiles").alias("tiles"))
        record.coalesce(1).write.mode("append").parquet(f"{self.root}/commits")

    def processed(self, spark: SparkSession) -> DataFrame:
        """scene_id, pipeline, run, at and tiles of the last commit of each scene and code."""
        try:
            commits = spark.read.parquet(f"{self.root}/commits")
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return spark.createDataFrame([], "scene_id string, pipeline string, run string, at bigint, tiles bigint")
        return newest_per_key(commits, KEYS, F.struct("at", "run"))

    def read(self, spark: SparkSession, kind: str) -> DataFrame:
        """The committed ``tiles`` or ``manifests``."""
        if kind == "tiles":
            rows = self._tiles(spark, f"{self.root}/tiles")
        else:
            rows = spark.read.parquet(f"{self.root}/{kind}").withColumn("run", F.col("run").cast("string"))
        return rows.join(self.processed(spark).select(*KEYS, "run"), [*KEYS, "run"], "left_semi")
