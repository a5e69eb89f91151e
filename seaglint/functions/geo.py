"""Geographic scalars: zones, pixel positions, distances, box text forms."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from seaglint import config as C


def outside_degrees(lat: Column, lon: Column, bbox=C.REGION_BBOX) -> Column:
    """Chebyshev distance in degrees from a point to a box; 0 inside."""
    lon0, lat0, lon1, lat1 = bbox
    zero = F.lit(0.0)
    return F.greatest(F.lit(lon0) - lon, lon - F.lit(lon1), F.lit(lat0) - lat, lat - F.lit(lat1), zero)


def zone_of(lat_min: Column, lon_min: Column, lat_max: Column, lon_max: Column) -> Column:
    """Maritime zone of a box by its centre; a box with a missing side is Z3."""
    d = outside_degrees((lat_min + lat_max) / 2.0, (lon_min + lon_max) / 2.0)
    whole = lat_min.isNotNull() & lon_min.isNotNull() & lat_max.isNotNull() & lon_max.isNotNull()
    return (
        F.when(~whole, "Z3")
        .when(d <= C.ZONE_1_NM / C.NM_PER_DEGREE, "Z1")
        .when(d <= C.ZONE_2_NM / C.NM_PER_DEGREE, "Z2")
        .otherwise("Z3")
    )


def zone_of_array(bbox: Column) -> Column:
    """Zone of a ``[lat_min, lon_min, lat_max, lon_max]`` array of exactly four numbers."""
    side = [F.get(bbox, F.lit(i)) for i in range(4)]
    return F.when(F.size(bbox) == 4, zone_of(*side)).otherwise("Z3")


def priority_level(vessels: Column) -> Column:
    return (
        F.when(vessels >= 10, "CRITICAL")
        .when(vessels >= 5, "HIGH")
        .when(vessels >= 2, "MEDIUM")
        .otherwise("LOW")
    )


def tile_pixel(lat, lon, lat_min, lon_min, lat_max, lon_max, size: int = C.TILE_SIZE):
    """Pixel (x, y) of a point in a tile; null when the tile has no extent."""
    zero = F.lit(0.0)
    x = (lon - lon_min) / F.nullif(lon_max - lon_min, zero) * F.lit(float(size))
    y = (lat_max - lat) / F.nullif(lat_max - lat_min, zero) * F.lit(float(size))
    return x, y


def tile_pixel_safe(lat, lon, lat_min, lon_min, lat_max, lon_max, size: int = C.TILE_SIZE):
    """As ``tile_pixel`` with the extent floored at 1e-9 instead of null."""
    tiny = F.lit(1e-9)
    x = (lon - lon_min) / F.greatest(lon_max - lon_min, tiny) * F.lit(float(size))
    y = (lat_max - lat) / F.greatest(lat_max - lat_min, tiny) * F.lit(float(size))
    return x, y


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2.0), 2) + F.cos(F.radians(lat1)) * F.cos(
        F.radians(lat2)
    ) * F.pow(F.sin(F.radians(lon2 - lon1) / 2.0), 2)
    return F.lit(2.0 * C.EARTH_RADIUS_M) * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def valid_bbox(lon_min: Column, lat_min: Column, lon_max: Column, lat_max: Column) -> Column:
    ok = (
        lat_min.between(-90, 90)
        & lat_max.between(-90, 90)
        & lon_min.between(-180, 180)
        & lon_max.between(-180, 180)
        & (lat_min <= lat_max)
        & (lon_min <= lon_max)
    )
    return F.coalesce(ok, F.lit(False))


def parse_bbox(text: Column) -> Column:
    """``"a,b,c,d"`` as an array of four doubles; null for anything else."""
    parts = F.transform(F.split(text, ","), lambda p: F.trim(p).try_cast("double"))
    good = (F.size(parts) == 4) & F.forall(parts, lambda p: p.isNotNull())
    return F.when(good, parts)


def overlaps(a: tuple, b: tuple) -> Column:
    """Do two (lon_min, lat_min, lon_max, lat_max) boxes touch?"""
    return (a[0] <= b[2]) & (a[2] >= b[0]) & (a[1] <= b[3]) & (a[3] >= b[1])


def bbox_wkt(lon_min: Column, lat_min: Column, lon_max: Column, lat_max: Column) -> Column:
    """Closed polygon text, counter-clockwise from the lower left corner."""
    corner = "%.6f %.6f"
    ring = ",".join([corner] * 5)
    return F.format_string(
        f"POLYGON(({ring}))",
        lon_min, lat_min, lon_max, lat_min, lon_max, lat_max, lon_min, lat_max, lon_min, lat_min,
    )


def bbox_polygon(lon_min: Column, lat_min: Column, lon_max: Column, lat_max: Column) -> Column:
    """GeoJSON polygon of a box as text."""
    ring = F.array(
        F.array(lon_min, lat_min),
        F.array(lon_max, lat_min),
        F.array(lon_max, lat_max),
        F.array(lon_min, lat_max),
        F.array(lon_min, lat_min),
    )
    return F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")))


def geojson_point(lat: Column, lon: Column, properties: Column) -> Column:
    """One GeoJSON feature per row; pair with a filter on missing coordinates."""
    return F.to_json(
        F.struct(
            F.lit("Feature").alias("type"),
            F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates")).alias(
                "geometry"
            ),
            properties.alias("properties"),
        )
    )


def cell_of(value: Column, size: float) -> Column:
    """Index of the grid step a coordinate falls in."""
    return F.floor(value / F.lit(size))
