"""Tables laid out along a space-filling curve, so that a box reads few files and few row groups.

Rows are sorted by a Z-order value of latitude and longitude. Its first bits name the partition folder, so a
box opens the folders of the squares that it touches only; inside a file neighbours on the map stand
together, so the minima and maxima that Parquet keeps for each row group let the scan skip most of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of the curve for each direction, and those of them that name the folder: 32 x 32 squares of the world.
BITS, FOLDER_BITS = 16, 5
OUTSIDE = -1
HELPERS = ("_lat", "_lon", "_z", "_square")


def _spread(v: Column) -> Column:
    """The low 16 bits with a gap of one bit between them."""
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask).cast("bigint"))
    return v


def _step(value: Column, low: float, width: float, bits: int) -> Column:
    n = 1 << bits
    return F.least(F.greatest(F.floor((value - low) / width * n), F.lit(0)), F.lit(n - 1)).cast("bigint")


def z_value(lat: Column, lon: Column, bits: int = BITS) -> Column:
    """Place on the curve; null without a coordinate."""
    known = lat.isNotNull() & lon.isNotNull() & ~F.isnan(lat.cast("double")) & ~F.isnan(lon.cast("double"))
    x, y = (_step(F.when(known, v), low, width, bits) for v, low, width in ((lon, -180.0, 360.0), (lat, -90.0, 180.0)))
    return F.when(known, _spread(x).bitwiseOR(F.shiftleft(_spread(y), 1)))


def write_clustered(rows: DataFrame, path: str, lat: Column, lon: Column, group_bytes: int = 8 << 20, mode: str = "overwrite") -> None:
    """Write rows by the curve; rows without a place go to a folder of their own.

    The range shuffle follows the sampled rows, so a crowded sea has as many files as its rows need.
    """
    z = z_value(F.col("_lat"), F.col("_lon"))
    placed = rows.withColumns({"_lat": lat, "_lon": lon}).withColumn("_z", z)
    square = F.coalesce(F.shiftright("_z", 2 * (BITS - FOLDER_BITS)), F.lit(OUTSIDE))
    ordered = placed.withColumn("_square", square).repartitionByRange("_square", "_z").sortWithinPartitions("_square", "_z")
    ordered.write.mode(mode).option("parquet.block.size", group_bytes).partitionBy("_square").parquet(path)


def squares_of(bbox: tuple[float, float, float, float]) -> list[int]:
    """Folder numbers that (lon_min, lat_min, lon_max, lat_max) touches: 1,024 at most."""
    n = 1 << FOLDER_BITS

    def steps(low, high, start, width):
        # A little more than the box: a place at its border may be rounded into the next square.
        first, last = (min(max(int((v - start) // (width / n)), 0), n - 1) for v in (low - 1e-9, high + 1e-9))
        return range(first, last + 1)

    def curve(x, y):
        return sum(((x >> i) & 1) << (2 * i) | ((y >> i) & 1) << (2 * i + 1) for i in range(FOLDER_BITS))

    return sorted(curve(x, y) for x in steps(bbox[0], bbox[2], -180.0, 360.0) for y in steps(bbox[1], bbox[3], -90.0, 180.0))


def read_box(spark: SparkSession, path: str, bbox: tuple[float, float, float, float]) -> DataFrame:
    """The rows whose place lies in (lon_min, lat_min, lon_max, lat_max), bounds included."""
    rows = spark.read.parquet(path).where(F.col("_square").isin(squares_of(bbox)))
    inside = F.col("_lon").between(bbox[0], bbox[2]) & F.col("_lat").between(bbox[1], bbox[3])
    return rows.where(inside).drop(*HELPERS)
