"""Fixed schemas of the tables the operators exchange."""

from pyspark.sql import types as T

BOX = T.StructType(
    [T.StructField(n, T.DoubleType()) for n in ("x1", "y1", "x2", "y2", "confidence")]
)

DETECTION_EVENT = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("scene_id", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("tile_id", T.StringType()),
        T.StructField("tile_bbox_latlon", T.ArrayType(T.DoubleType())),
        T.StructField("detections", T.ArrayType(BOX)),
        T.StructField("vessel_count", T.IntegerType()),
        T.StructField("dark_vessel_count", T.IntegerType()),
        T.StructField("priority_level", T.StringType()),
        T.StructField("zone", T.StringType()),
        T.StructField("satellite_id", T.StringType()),
        T.StructField("satellite_position", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("preprocessing_pipeline", T.StringType()),
        T.StructField("processing_time_ms", T.DoubleType()),
    ]
)

TLE = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("norad_id", T.LongType()),
        T.StructField("tle1", T.StringType()),
        T.StructField("tle2", T.StringType()),
        T.StructField("updated_at", T.TimestampType()),
        T.StructField("source", T.StringType()),
    ]
)

PRODUCT = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("date", T.TimestampType()),
        T.StructField("size", T.LongType()),
        T.StructField("footprint", T.StringType()),
    ]
)

INGEST_REQUEST = T.StructType(
    [
        T.StructField("bbox", T.ArrayType(T.DoubleType())),
        T.StructField("date_start", T.StringType()),
        T.StructField("date_end", T.StringType()),
        T.StructField("satellite_id", T.StringType()),
        T.StructField("pipeline", T.StringType()),
    ]
)

TARGET_TRACE = T.StructType(
    [
        T.StructField("scene_id", T.StringType()),
        T.StructField("safe_dir", T.StringType()),
        T.StructField("target_density_cell_index", T.LongType()),
        T.StructField("target_cell_bbox", T.ArrayType(T.DoubleType())),
        T.StructField("density_rank", T.LongType()),
        T.StructField("ais_count", T.LongType()),
        T.StructField("protocol", T.StringType()),
    ]
)

TILE_MANIFEST = T.StructType(
    [
        T.StructField("scene_id", T.StringType()),
        T.StructField("pipeline", T.StringType()),
        T.StructField("polarization", T.StringType()),
        T.StructField("tile_size", T.IntegerType()),
        T.StructField("overlap", T.DoubleType()),
        T.StructField("total_tiles", T.LongType()),
        T.StructField("valid_tiles", T.LongType()),
        T.StructField("skipped_nodata", T.LongType()),
        T.StructField("target_density_cell_index", T.LongType()),
        T.StructField("target_cell_bbox", T.ArrayType(T.DoubleType())),
        T.StructField("targeting_protocol", T.StringType()),
        T.StructField(
            "tiles",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("tile_id", T.StringType()),
                        T.StructField("scene_id", T.StringType()),
                        T.StructField("pipeline", T.StringType()),
                        T.StructField("pixel_bbox", T.ArrayType(T.IntegerType())),
                        T.StructField("geo_bbox", T.ArrayType(T.DoubleType())),
                        T.StructField("npy_path", T.StringType()),
                    ]
                )
            ),
        ),
    ]
)

# One raster window per row: little-endian pixels in row-major order.
RASTER = "tile_id string, h int, w int, dtype string, data binary"
