import math

import pytest
from conftest import rows
from pyspark.sql import functions as F

from seaglint.functions import ais, boxes, geo, names, orbit


@pytest.mark.parametrize(
    "box, allowed",
    [
        ((27, -17, 36, -1), {"Z1"}),
        ((35.9, -17, 36.1, -1), {"Z1"}),
        ((27, -17, 39, -1), {"Z1", "Z2"}),
        ((10, -40, 20, -30), {"Z3"}),
        ((27, 2, 36, 5), {"Z2", "Z3"}),
        ((27, -24, 36, -22), {"Z3"}),
        ((), {"Z3"}),
        ((1.0, 2.0), {"Z3"}),
    ],
)
def test_zone_boxes(spark, box, allowed):
    df = spark.createDataFrame([([float(v) for v in box],)], "b array<double>")
    assert df.select(geo.zone_of_array(F.col("b"))).first()[0] in allowed


def test_sql_functions_agree_with_columns(spark):
    from seaglint.functions.sqlfuncs import register_sql_functions

    assert len(register_sql_functions(spark)) == 5
    got = spark.sql(
        "select zone_of(27, -17, 36, -1) z, round(haversine_m(0, 0, 0, 1), 3) h, iou_xyxy(0, 0, 2, 2, 1, 0, 3, 2) a,"
        " iou_yolo(1, 1, 2, 2, 2, 1, 2, 2) b, scene_base_id('S1A_IW_GRDH_1SDV_a_b_051997_06488E_B2F9_COG.SAFE/') s"
    ).first()
    assert got.z == "Z1" and got.s == "051997_06488E_B2F9"
    assert got.h == pytest.approx(6371000 * math.pi / 180, abs=1e-3)
    assert got.a == pytest.approx(2 / 6, abs=1e-6) and got.b == pytest.approx(2 / 6)


def test_scene_names(spark):
    a = "S1A_IW_GRDH_1SDV_20240107T064657_20240107T064719_051997_06488E_B2F9"
    df = spark.createDataFrame([(a,), (a + "_COG.SAFE",), (a + ".SAFE/",), ("x_y",)], "n string")
    got = [r[0] for r in df.select(names.scene_base_id(F.col("n"))).collect()]
    assert got == ["051997_06488E_B2F9"] * 3 + [None]
    at = df.select(names.acquisition_time(F.col("n")).cast("string")).collect()
    assert at[0][0] == "2024-01-07 06:46:57" and at[3][0] is None
    one = df.limit(1).select(
        names.cog_base7(F.col("n")), names.short_scene_id(F.col("n")), names.satellite_platform(F.col("n")),
        names.derived_tile_id(F.lit("s_D_tile0007"), "E"), names.grid_tile_id(F.lit(512), F.lit(256), 256),
    ).first()
    assert one[1:] == ("S1A_IW_GRDH", "S1A", "s_D_E_tile0007", "r0002_c0001")
    assert one[0] == "S1A_IW_GRDH_1SDV_20240107T064657_20240107T064719_051997"


def test_satellite_ids(spark):
    cases = {"": None, "  ": None, "1 OR 1=1": None, "-5": None, "abc": None, "../x": None, "0": None, "007": 7, " +25544 ": 25544, "++5": None}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r[0]: r[1] for r in df.select("t", orbit.parse_satellite_id(F.col("t"))).collect()}
    assert got == cases


def test_freshness(spark):
    df = spark.createDataFrame([(None,), ("2024-01-02 11:00:00",), ("2023-12-01 00:00:00",)], "u string")
    now = F.to_timestamp(F.lit("2024-01-02 12:00:00"))
    assert [r[0] for r in df.select(orbit.tle_is_fresh(F.col("u"), now)).collect()] == [False, True, False]


def test_ui_boxes(spark):
    data = [(-17, 27, -1, 36, True), (0, 0, 0, 0, True), (-180, -90, 180, 90, True), (-181, 0, 0, 0, False), (0, 0, 0, 91, False), (5, 0, 1, 1, False), (0, 5, 1, 1, False)]
    df = spark.createDataFrame([tuple(map(float, d[:4])) + (d[4],) for d in data], "a double, b double, c double, d double, ok boolean")
    assert df.where(geo.valid_bbox(*map(F.col, "abcd")) != F.col("ok")).count() == 0


def test_corners_and_overlap(spark):
    df = spark.createDataFrame([(50.0, 50.0, 20.0, 40.0), (0.0, 0.0, 10.0, 10.0)], "x double, y double, w double, h double")
    assert rows(df.select(*boxes.corners(*map(F.col, "xywh")))) == [(-5, -5, 5, 5), (40, 30, 60, 70)]
    zero = tuple(F.lit(0.0) for _ in range(4))
    assert df.limit(1).select(boxes.iou_yolo(zero, zero)).first()[0] == 0.0


def test_lat_lon_spellings(spark):
    texts = ['{"lat":1,"lon":2}', '{"latitude":1,"longitude":2}', '{"geometry":{"coordinates":[2,1]}}', '{"position":{"lat":1,"lon":2}}', '{"location":{"latitude":1,"longitude":2}}', '{"lat":1}', "{}"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, r string")
    got = rows(df.select("i", *[F.coalesce(c, F.lit(-1.0)) for c in ais.lat_lon(F.col("r"))]))
    assert got == [(i, 1.0, 2.0) for i in range(5)] + [(5, -1.0, -1.0), (6, -1.0, -1.0)]


def test_box_model_ranges(spark):
    df = spark.range(4000).withColumn("k", F.when(F.col("id") % 2 == 0, "Fishing"))
    w, h = boxes.sampled_size(F.col("id"), F.col("k"))
    got = df.select("k", (w * 512).alias("w"), (h * 512).alias("h")).groupBy("k").agg(F.min("w"), F.max("w"), F.min("h"), F.avg("w")).collect()
    by = {r[0]: r for r in got}
    assert by["Fishing"][1] >= 3.0 and by["Fishing"][2] <= 4 * 3.5 * 1.2
    assert by[None][3] >= 1.5 and by[None][4] > by["Fishing"][4]


def test_satnogs_titles(spark):
    df = spark.createDataFrame([("0 ISS", 1), ("ISS", 2), (None, 3), ("", 4)], "t string, n int")
    got = [r[0] for r in df.select(orbit.satnogs_name(F.col("t"), F.col("n"))).collect()]
    assert got == ["ISS", "ISS", "NORAD-3", "NORAD-4"]


def test_lines_are_split_and_sizes_drawn_once(spark):
    from seaglint.operators import labels

    df = spark.createDataFrame([("t", 0, "0 0.1 0.2 0.3 0.4"), ("t", 1, "bad line"), ("t", 2, None), ("t", 3, " ")], "tile_id string, line_no int, txt string")
    out = labels.resample_box_sizes(df, F.concat_ws("#", "tile_id", "line_no"))
    assert [r.resampled for r in out.orderBy("line_no").collect()] == [True, False, False, False]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("md5(") == 5 and plan.count("split(") == 1


def test_drawn_sizes_are_generated_code(spark):
    df = spark.range(50).select("id", F.element_at(F.array(*map(F.lit, ("Oil TANKER", "fishing", "Tug", "raft", ""))), (F.col("id") % 5 + 1).cast("int")).alias("k"))
    df = df.unionByName(spark.range(50, 60).select("id", F.lit(None).cast("string").alias("k")))
    out = df.select("id", *[c.alias(n) for c, n in zip(boxes.estimated_box(F.col("id"), F.lit(5.0), F.lit(6.0), F.col("k")), ("cx", "cy", "w", "h"))])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan and "rlike" not in plan.lower()
    from hashlib import md5
    from math import exp, log

    def drawn(key, name):
        return int(md5(f"{key}|{name}".encode()).hexdigest()[:8], 16) / 2**32

    kinds = {0: (100, 350), 1: (10, 40), 2: (20, 80), 3: (10, 300)}
    for r in out.collect():
        mix = drawn(r.id, "mix")
        lo, hi = kinds.get(r.id % 5 if r.id < 50 else 4) or ((10, 40) if mix < 0.6 else (40, 120) if mix < 0.9 else (120, 350))
        px = exp(log(lo) + (log(hi) - log(lo)) * drawn(r.id, "length")) * (1.8 + 1.7 * drawn(r.id, "bloom")) * (0.8 + 0.4 * drawn(r.id, "jitter")) / 10
        assert abs(r.w - max(3.0, px) / 512) < 1e-9 and abs(r.h - max(1.5, px / (3 + 3 * drawn(r.id, "aspect"))) / 512) < 1e-9

