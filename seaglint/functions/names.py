"""Parsing of radar product, scene and tile names."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def scene_id_normalize(name: Column) -> Column:
    """Drop trailing slashes and every ``.SAFE``."""
    return F.replace(F.regexp_replace(name, "/+$", ""), F.lit(".SAFE"), F.lit(""))


def scene_base_id(name: Column) -> Column:
    """Last three name parts, or the three before a COG suffix; null below seven parts."""
    parts = F.split(scene_id_normalize(name), "_")
    is_cog = F.upper(F.element_at(parts, -1)) == "COG"
    three = F.when(is_cog, F.slice(parts, -4, 3)).otherwise(F.slice(parts, -3, 3))
    return F.when(F.size(parts) >= 7, F.array_join(three, "_"))


def cog_base7(name: Column) -> Column:
    """First seven parts when there are at least eight, else the whole name."""
    parts = F.split(name, "_")
    return F.when(F.size(parts) >= 8, F.array_join(F.slice(parts, 1, 7), "_")).otherwise(name)


def is_cog(name: Column) -> Column:
    return F.contains(name, F.lit("_COG"))


def acquisition_time(name: Column) -> Column:
    """First ``_yyyyMMddTHHmmss_`` stamp of the name as a UTC timestamp; null when absent."""
    stamp = F.regexp_extract(name, r"_(\d{8}T\d{6})_", 1)
    return F.try_to_timestamp(F.nullif(stamp, F.lit("")), F.lit("yyyyMMdd'T'HHmmss"))


def satellite_platform(name: Column) -> Column:
    """First part that starts with S1 and has three characters or more, cut to three."""
    fits = F.filter(
        F.split(name, "_"), lambda p: p.startswith("S1") & (F.length(p) >= F.lit(3))
    )
    return F.coalesce(F.substring(F.get(fits, F.lit(0)), 1, 3), F.lit("UNKNOWN"))


def short_scene_id(name: Column) -> Column:
    return F.array_join(F.slice(F.split(name, "_"), 1, 3), "_")


def tile_id_format(scene_id: Column, code: Column, index: Column) -> Column:
    return F.format_string("%s_%s_tile%04d", scene_id, code, index)


def derived_tile_id(tile_id: Column, code: str) -> Column:
    """Insert the output code before the last part: ``x_D_tile7`` gives ``x_D_E_tile7``."""
    return F.regexp_replace(tile_id, "_([^_]*)$", f"_{code}_$1")


def grid_tile_id(y: Column, x: Column, stride: int) -> Column:
    return F.format_string(
        "r%04d_c%04d", F.floor(y / F.lit(stride)), F.floor(x / F.lit(stride))
    )
