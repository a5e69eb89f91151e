"""The scalar rules as SQL functions, which Spark inlines into the plan."""

from pyspark.sql import SparkSession

from seaglint import config as C

_LON0, _LAT0, _LON1, _LAT1 = C.REGION_BBOX
_BOX = "{p}1 DOUBLE, {p}2 DOUBLE, {p}3 DOUBLE, {p}4 DOUBLE"

SQL_FUNCTIONS = {
    "zone_of": f"""(lat_min DOUBLE, lon_min DOUBLE, lat_max DOUBLE, lon_max DOUBLE) RETURNS STRING RETURN
        CASE WHEN lat_min IS NULL OR lon_min IS NULL OR lat_max IS NULL OR lon_max IS NULL THEN 'Z3'
             WHEN greatest({_LON0} - (lon_min + lon_max) / 2, (lon_min + lon_max) / 2 - {_LON1},
                           {_LAT0} - (lat_min + lat_max) / 2, (lat_min + lat_max) / 2 - {_LAT1}, 0)
                  <= {C.ZONE_1_NM / C.NM_PER_DEGREE}D THEN 'Z1'
             WHEN greatest({_LON0} - (lon_min + lon_max) / 2, (lon_min + lon_max) / 2 - {_LON1},
                           {_LAT0} - (lat_min + lat_max) / 2, (lat_min + lat_max) / 2 - {_LAT1}, 0)
                  <= {C.ZONE_2_NM / C.NM_PER_DEGREE}D THEN 'Z2'
             ELSE 'Z3' END""",
    "haversine_m": f"""(lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE) RETURNS DOUBLE RETURN
        2 * {C.EARTH_RADIUS_M}D * asin(sqrt(least(1D, power(sin(radians(lat2 - lat1) / 2), 2)
          + cos(radians(lat1)) * cos(radians(lat2)) * power(sin(radians(lon2 - lon1) / 2), 2))))""",
    "iou_xyxy": f"""({_BOX.format(p='a')}, {_BOX.format(p='b')}) RETURNS DOUBLE RETURN
        greatest(0D, least(a3, b3) - greatest(a1, b1)) * greatest(0D, least(a4, b4) - greatest(a2, b2))
        / ((a3 - a1) * (a4 - a2) + (b3 - b1) * (b4 - b2)
           - greatest(0D, least(a3, b3) - greatest(a1, b1)) * greatest(0D, least(a4, b4) - greatest(a2, b2)) + 1e-6D)""",
    "iou_yolo": f"""({_BOX.format(p='a')}, {_BOX.format(p='b')}) RETURNS DOUBLE RETURN
        coalesce(try_divide(
          greatest(0D, least(a1 + a3 / 2, b1 + b3 / 2) - greatest(a1 - a3 / 2, b1 - b3 / 2))
            * greatest(0D, least(a2 + a4 / 2, b2 + b4 / 2) - greatest(a2 - a4 / 2, b2 - b4 / 2)),
          greatest(0D, a3 * a4 + b3 * b4
            - greatest(0D, least(a1 + a3 / 2, b1 + b3 / 2) - greatest(a1 - a3 / 2, b1 - b3 / 2))
            * greatest(0D, least(a2 + a4 / 2, b2 + b4 / 2) - greatest(a2 - a4 / 2, b2 - b4 / 2)))), 0D)""",
    "scene_base_id": """(name STRING) RETURNS STRING RETURN
        CASE WHEN size(split(replace(rtrim('/', name), '.SAFE', ''), '_')) >= 7 THEN
          array_join(slice(split(regexp_replace(replace(rtrim('/', name), '.SAFE', ''), '_[Cc][Oo][Gg]$', ''), '_'), -3, 3), '_') END""",
}


def register_sql_functions(spark: SparkSession) -> list[str]:
    for name, body in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
    return list(SQL_FUNCTIONS)
