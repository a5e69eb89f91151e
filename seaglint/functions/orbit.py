"""Scalars on orbit records (two-line element sets)."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from seaglint.functions.clock import micros
from seaglint import config as C


def tle_is_fresh(updated_at: Column, now: Column) -> Column:
    """Younger than the time-to-live; a missing or unreadable stamp is not fresh."""
    age_s = micros(now) - micros(F.to_timestamp(updated_at))
    return F.coalesce(age_s < F.lit(C.TLE_TTL_HOURS * 3600 * 1_000_000), F.lit(False))


def lines_ok(tle1: Column, tle2: Column) -> Column:
    return F.coalesce(tle1.startswith("1 ") & tle2.startswith("2 "), F.lit(False))


def satnogs_name(tle0: Column, norad_id: Column) -> Column:
    """Title line without its first ``0 ``; NORAD-<id> when there is no title line."""
    has_title = tle0.isNotNull() & (tle0 != "")
    cut = F.trim(F.regexp_replace(tle0, r"^(.*?)0 ", "$1"))
    return F.when(has_title, cut).otherwise(F.concat(F.lit("NORAD-"), norad_id.cast("string")))


def parse_satellite_id(text: Column) -> Column:
    """Positive whole number after trimming, one leading plus allowed; null when refused."""
    t = F.trim(text)
    value = F.when(t.rlike(r"^\+?[0-9]+$"), F.replace(t, F.lit("+"), F.lit("")).try_cast("bigint"))
    return F.when(value > 0, value)


def rounded_position(lat: Column, lon: Column, alt_m: Column):
    return F.round(lat, 6), F.round(lon, 6), F.round(alt_m, 2)
