"""Keyed table on plain Parquet folders: cheap appends, newest row per key on read.

A batch writes only its own rows into its own folder, named by the writer's run and the batch number,
so a repeated batch overwrites itself, batches of different writers do not meet, and the cost of a
write does not depend on the table. ``compact`` folds finished batches into a segment, and segments of a
level into one of the next, so a row is rewritten a logarithmic number of times and a read meets a bounded
number of segments. Segments lie in key order and all files carry bloom filters of the keys, so a read of
few keys skips most row groups. Pointer rows written last, in one file, make a new state visible.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seaglint.operators.ranking import newest_per_key


class KeyedStore:
    """Rows by key; the greatest ``order`` wins, and the later batch among equals."""

    def __init__(self, root: str, keys: list[str], order: str):
        self.root, self.keys, self.order = root.rstrip("/"), keys, order

    def append(self, rows: DataFrame, batch_id: int, run: str = "default") -> None:
        """Write one batch; safe to repeat with the same run and number."""
        self._write(rows.sortWithinPartitions(*self.keys), f"{self.root}/batches/run={run}/batch={batch_id}")

    def _write(self, rows: DataFrame, path: str) -> None:
        writer = rows.write.mode("overwrite")
        for key in self.keys:
            writer = writer.option(f"parquet.bloom.filter.enabled#{key}", "true")
        writer.parquet(path)

    def _read(self, spark: SparkSession, path: str) -> DataFrame | None:
        try:
            return spark.read.parquet(path)
        except AnalysisException as e:
            if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return None
            raise

    def _state(self, spark: SparkSession) -> tuple[int, list[tuple[int, str]], DataFrame | None]:
        """Version, live segments as (level, path), and the last folded batch of each run."""
        pointers = self._read(spark, f"{self.root}/pointers")
        if pointers is None:
            return 0, [], None
        version = pointers.agg(F.max("version").alias("v")).first()["v"]
        now = pointers.where(F.col("version") == version)
        # A few segments for each level.
        segments = [(r["level"], r["path"]) for r in now.where("path is not null").orderBy("level", "path").collect()]
        return version, segments, now.where("path is null").select("run", "upto")

    def _segments(self, spark: SparkSession, paths: list[str]) -> DataFrame | None:
        return spark.read.parquet(*[f"{self.root}/segments/{p}" for p in paths]) if paths else None

    def _batches(self, spark: SparkSession, folded: DataFrame | None) -> DataFrame | None:
        """The batches that no segment holds yet."""
        batches = self._read(spark, f"{self.root}/batches")
        if batches is None:
            return None
        batches = batches.withColumn("batch", F.col("batch").cast("bigint")).withColumn("run", F.col("run").cast("string"))
        if folded is None:
            return batches
        later = batches.join(F.broadcast(folded), "run", "left")  # one row for each run
        return later.where(F.col("upto").isNull() | (F.col("batch") > F.col("upto"))).drop("upto")

    def history(self, spark: SparkSession) -> DataFrame | None:
        """Segments and later batches, unmerged, with their run and batch number."""
        _, segments, folded = self._state(spark)
        held, batches = self._segments(spark, [p for _, p in segments]), self._batches(spark, folded)
        if held is None or batches is None:
            return batches if held is None else held
        return held.unionByName(batches, allowMissingColumns=True)

    def _newest(self, rows: DataFrame) -> DataFrame:
        return newest_per_key(rows, self.keys, F.struct(self.order, "batch", "run"))

    def current(self, spark: SparkSession) -> DataFrame | None:
        """The newest row of each key. A condition on keys reaches the files."""
        rows = self.history(spark)
        return None if rows is None else self._newest(rows).drop("batch", "run")

    def compact(self, spark: SparkSession, fan: int = 8) -> None:
        """Fold the batches that are there into a segment, and every ``fan`` segments of a level into one."""
        version, segments, folded = self._state(spark)
        batches = self._batches(spark, folded)
        if batches is None or batches.isEmpty():
            return
        # The batches of this state only: one that lands meanwhile is left to the next call.
        upto = batches.groupBy("run").agg(F.max("batch").alias("upto")).toPandas()
        taken = spark.createDataFrame(upto.astype({"run": str, "upto": "int64"}), "run string, upto bigint")
        now = batches.join(F.broadcast(taken), "run").where(F.col("batch") <= F.col("upto")).drop("upto")
        segments = [*segments, (0, self._segment(now, version + 1, 0))]
        level = 0
        while len(full := [p for at, p in segments if at == level]) >= fan:
            path = self._segment(self._segments(spark, full), version + 1, level + 1)
            segments = [(at, p) for at, p in segments if at != level] + [(level + 1, path)]
            level += 1
        marks = taken if folded is None else taken.unionByName(folded).groupBy("run").agg(F.max("upto").alias("upto"))
        kind = "version bigint, run string, upto bigint, level bigint, path string"
        rows = [(version + 1, r["run"], r["upto"], None, None) for r in marks.collect()] + [(version + 1, None, None, at, p) for at, p in segments]
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(f"{self.root}/pointers")

    def _segment(self, rows: DataFrame, version: int, level: int) -> str:
        """Write the newest rows in key order; returns the segment's folder."""
        path = f"v{version}-level{level}-{uuid4().hex}"
        self._write(self._newest(rows).repartitionByRange(*self.keys).sortWithinPartitions(*self.keys), f"{self.root}/segments/{path}")
        return path
