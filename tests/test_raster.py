import numpy as np
import pandas as pd
import pytest
from conftest import rows
from pyspark.sql import functions as F

from seaglint.operators import raster, tiles

RNG = np.random.default_rng(0)
DN = RNG.integers(50, 2000, (100, 100)).astype("uint16")


def test_calibration_and_decibel():
    assert raster.sigma0(np.full((2, 2), 100, "uint16"), np.ones((2, 2))).tolist() == [[1e4] * 2] * 2
    assert np.isfinite(raster.sigma0(np.full((2, 2), 100, "uint16"), np.zeros((2, 2)))).all()
    db = raster.decibel(np.array([1.0, 0.0]))
    assert abs(db[0]) < 1e-6 and np.isfinite(db[1])
    assert raster.db_bytes(np.array([-30.0, 0.0, -40.0, 10.0])).tolist() == [0, 255, 0, 255]


@pytest.mark.parametrize("code", list("ABCDE"))
def test_chain_keeps_shape_and_bytes(code):
    out = raster.run_chain(code, DN, np.full(DN.shape, 0.5))
    assert out.shape == DN.shape and out.dtype == np.uint8


def test_flat_windows_are_safe():
    flat = np.full((16, 16), 7, "uint16")
    for code in "ABCDE":
        assert raster.run_chain(code, flat, np.ones(flat.shape)).dtype == np.uint8
    assert (raster.lee_filter(flat.astype(float)) == 7).all()


def test_kernel_sizes_are_checked():
    for bad in (0, 4):
        with pytest.raises(ValueError):
            raster.lee_filter(np.ones((5, 5)), bad)
    with pytest.raises(ValueError):
        raster.median_blur(np.ones((5, 5), np.uint8), 4)
    with pytest.raises(ValueError):
        raster.run_chain("Z", DN, np.ones(DN.shape))


def test_lee_against_plain_loops():
    a = RNG.uniform(0, 9, (7, 9))
    p = np.pad(a, 2, mode="symmetric")
    mean = np.array([[p[i : i + 5, j : j + 5].mean() for j in range(9)] for i in range(7)])
    var = np.maximum(np.array([[(p[i : i + 5, j : j + 5] ** 2).mean() for j in range(9)] for i in range(7)]) - mean**2, 0)
    nv = var.mean()
    want = mean + np.maximum(var - nv, 0) / np.maximum(var, nv) * (a - mean)
    assert np.allclose(raster.lee_filter(a), want)


def test_equalise_and_stretch():
    out = raster.equalized_bytes(np.arange(256.0).reshape(16, 16))
    assert out.max() == 255 and out.min() == 0 and (np.diff(out.ravel().astype(int)) >= 0).all()
    s = raster.percentile_bytes(np.arange(100.0).reshape(10, 10))
    assert s.min() == 0 and s.max() == 255


def test_clahe_median_and_blur():
    flat = np.full((40, 44), 90, np.uint8)
    assert raster.clahe(flat).shape == flat.shape  # sides that are no multiple of eight
    assert (raster.median_blur(flat) == 90).all()
    spot = flat.copy()
    spot[20, 20] = 255
    assert (raster.median_blur(spot) == 90).all()
    dot = np.zeros((21, 21), np.uint8)
    dot[10, 10] = 250
    blurred = raster.gaussian_blur(dot)
    assert blurred[10, 10] == blurred.max() and blurred[10, 8] == blurred[8, 10] and blurred[0, 0] == 0
    ramp = np.tile(np.arange(64, dtype=np.uint8) * 4, (64, 1))
    assert (np.diff(raster.clahe(ramp).astype(int).mean(axis=0)) > -8).all()


def test_clahe_of_one_cell_pair_by_hand():
    # 16x16 with 8x8 cells of 2x2 pixels: clip = max(1, int(4*4/256)) = 1
    a = np.zeros((16, 16), np.uint8)
    out = raster.clahe(a)
    # histogram clipped at 1, excess 3 spread evenly: level 0 is the start of every curve
    assert (out == 0).all()


def test_padding():
    a = np.arange(6, dtype=np.uint8).reshape(2, 3)
    assert raster.pad_tile(a, 4)[3].tolist() == [3, 4, 5, 5]
    assert raster.pad_tile(a, 4, edge=False)[3].tolist() == [0, 0, 0, 0]


def test_grid_interpolation():
    v = np.arange(1.0, 17).reshape(4, 4)
    nodes = [0, 10, 20, 30]
    got = raster.interpolate_grid(nodes, [nodes] * len(nodes), v, np.array([0, 10, 15, 30, 33]), np.array([0, 5, 30, 33]))
    assert got[0, 0] == 1 and got[3, 2] == 16 and got[2, 1] == pytest.approx(7.5)
    assert got[4, 3] == pytest.approx(16 + 0.3 * 4 + 0.3 * 1)


def test_lines_of_differing_nodes():
    """Each line is interpolated along its own nodes, then between the lines."""
    got = raster.interpolate_grid([0, 10], [[0, 4, 8], [0, 8]], [np.array([0.0, 4.0, 16.0]), np.array([10.0, 18.0])], np.array([0, 5, 10]), np.array([0, 2, 6]))
    assert got.tolist() == [[0, 2, 10], [5, 7, 13], [10, 12, 16]]


def test_chain_a_needs_no_calibration(spark):
    a = np.arange(64, dtype="int32").reshape(8, 8) + 1
    cols = "scene_id string, tile_id string, tile_no bigint, y0 int, y1 int, x0 int, x1 int, py0 int, py1 int, px0 int, px1 int, h int, w int, dtype string, data binary"
    windows = spark.createDataFrame([("s", "s_1", 1, 0, 8, 0, 8, 0, 8, 0, 8, 8, 8, "int32", a.tobytes())], cols)
    none = spark.createDataFrame([], "scene_id string, line bigint, pixels array<bigint>, values array<double>")
    assert rows(raster.run_chains(windows, none, None, ("A", "B")), "code") == [("A",)]
    assert rows(raster.uncalibrated(windows, none), "scene_id", "tile_no") == [("s", 1)]


def gcp_points(spark, n, size, lat0, lon0):
    step = (size - 1) / (n - 1)
    data = [("s", i * step, j * step, lat0 + i, lon0 + j) for i in range(n) for j in range(n)]
    return spark.createDataFrame(data, "scene_id string, line double, pixel double, lat double, lon double")


def test_gcp_two_by_two(spark):
    g = tiles.gcp_table(gcp_points(spark, 2, 10, 36.0, -6.0).withColumn("lat", F.when(F.col("line") > 0, 37.0).otherwise(35.0)))
    shapes = spark.createDataFrame([("s", 10, 10)], "scene_id string, height int, width int")
    px = spark.createDataFrame([("s", 9.0, 9.0), ("s", 10.0, 5.0), ("s", 5.0, 10.0), ("s", -1.0, 5.0), ("s", 5.0, -1.0), ("s", 0.0, 0.0)], "scene_id string, line double, pixel double")
    got = {(r.line, r.pixel): (r.lat, r.lon) for r in tiles.gcp_pixel_to_latlon(px, g, shapes).collect()}
    assert got[(9.0, 9.0)] == pytest.approx((37.0, -5.0)) and got[(0.0, 0.0)] == pytest.approx((35.0, -6.0))
    assert all(got[k] == (None, None) for k in ((10.0, 5.0), (5.0, 10.0), (-1.0, 5.0), (5.0, -1.0)))
    whole = spark.createDataFrame([("s", 0, 0, 0, 10, 10)], "scene_id string, tile_no int, y0 int, x0 int, y1 int, x1 int")
    b = tiles.tile_geo_bbox(whole, g, shapes).first()
    assert (b.lat_min, b.lon_min, b.lat_max, b.lon_max) == pytest.approx((35, -6, 37, -5))


def test_gcp_exact_at_nodes_and_irregular_grids_fail(spark):
    pts = gcp_points(spark, 4, 30, 30.0, -10.0)
    g = tiles.gcp_table(pts)
    shapes = spark.createDataFrame([("s", 30, 30)], "scene_id string, height int, width int")
    got = tiles.gcp_pixel_to_latlon(pts.drop("lat", "lon"), g, shapes).join(pts.withColumnsRenamed({"lat": "a", "lon": "o"}), ["scene_id", "line", "pixel"])
    assert got.where("abs(lat - a) > 1e-10 or abs(lon - o) > 1e-10").count() == 0 and got.count() == 16
    with pytest.raises(Exception, match="not a grid"):
        tiles.gcp_table(pts.where("not (line = 0 and pixel = 0)")).collect()


def test_tile_table_round_trip_and_registered_op(spark):
    rows = spark.createDataFrame([("a", y, [y * 10 + x for x in range(4)]) for y in range(3)], "tile_id string, y int, values array<int>")
    packed = raster.pack_tiles(rows, ["tile_id"])
    long = raster.unpack_tiles(packed, ["tile_id"])
    assert long.where("v = y * 10 + x").count() == 12
    raster.register_raster_op("invert", lambda a: 255 - a)
    out = raster.enhance_tiles(packed.withColumn("tile_id", F.lit("s_D_tile0001")), ["invert"])
    assert out.first().tile_id == "s_D_E_tile0001"
    assert raster.unpack_tiles(out, ["tile_id"]).where("v = 255 - (y * 10 + x)").count() == 12


def test_noise_vectors_reach_the_chain(spark):
    lut = spark.createDataFrame([("s", ln, [0, 5, 10], [3000.0, 3100.0, 3200.0]) for ln in (0, 4, 8)], "scene_id string, line bigint, pixels array<bigint>, values array<double>")
    noise = lut.withColumn("values", F.transform("values", lambda v: v * 10.0))
    a = RNG.integers(300, 900, (9, 11)).astype("uint16")
    win = spark.createDataFrame(
        [("s", "t", 0, 0, 9, 0, 11, 0, 9, 0, 11, 9, 11, "uint16", bytearray(a.tobytes()))],
        "scene_id string, tile_id string, tile_no bigint, y0 int, y1 int, x0 int, x1 int, py0 int, py1 int, px0 int, px1 int, h int, w int, dtype string, data binary",
    )
    got = raster.run_chains(win, lut, noise, ("B",)).first()
    plane = np.broadcast_to(3000.0 + 20.0 * np.arange(11), (9, 11))
    want = raster.run_chain("B", a, plane, plane * 10.0)
    assert np.abs(np.frombuffer(got.data, "uint8").reshape(9, 11).astype(int) - want.astype(int)).max() <= 1
    empty = win.withColumn("data", F.lit(bytearray(np.zeros((9, 11), "uint16").tobytes())))
    assert raster.run_chains(empty, lut, None, ("B",)).count() == 0


def test_tile_jobs_take_few_tiles_at_a_time(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    tiles = spark.range(1300).coalesce(1).selectExpr("cast(id as string) as tile_id", "1 as h", "2 as w", "'uint8' as dtype", "unhex('0102') as data")
    lengths = lambda batches: (pd.DataFrame({"n": [len(b)]}) for b in batches)
    try:
        for job in (lambda: raster.map_tiles(tiles, lambda a: a + 1), lambda: raster.unpack_tiles(tiles, ["tile_id"])):
            spark.conf.set(key, "10000")
            made = job()
            assert rows(tiles.mapInPandas(lengths, "n long")) == [(276,), (512,), (512,)]
            assert made.count() in (1300, 2600)
        spark.conf.set(key, "100")
        raster.map_tiles(tiles, lambda a: a)
        assert spark.conf.get(key) == "100"
    finally:
        spark.conf.set(key, before)


def test_model_tensor_of_a_tile_is_whole(spark, tmp_path):
    from seaglint import config as C
    from seaglint.plans import registry

    registry.load()
    # Two tiles, the second of 6 lines; the brightest and the darkest pixel stand in corners.
    values = np.tile(np.linspace(-0.95, -0.8, 64, dtype="float32"), (70, 1))
    values[0, 0], values[63, 63] = -1.0, -0.75
    table = pd.DataFrame({"vec_id": range(70), "embedding": [v.tolist() for v in values]})
    spark.createDataFrame(table, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    made = rows(registry.QUERIES["model_tensor"](spark, str(tmp_path)), "tile", "n", "low", "high")
    assert made == [(t, 3 * C.MODEL_INPUT**2, 0, 1000) for t in (0, 1)]


def test_long_form_of_a_large_tile(spark, monkeypatch):
    a = np.arange(2 * 50 * 7, dtype="uint16").reshape(2, 50, 7)
    tiles = spark.createDataFrame([(f"t{i}", i or None, 50, 7, "uint16", bytearray(a[i].tobytes())) for i in range(2)], "tile_id string, k int, h int, w int, dtype string, data binary")
    monkeypatch.setattr(raster, "BATCH_PIXELS", 33)
    want = sorted((f"t{i}", i or None, y, x, int(a[i, y, x])) for i in range(2) for y in range(50) for x in range(7))
    assert rows(raster.unpack_tiles(tiles, ["tile_id", "k"]), "tile_id", "k", "y", "x", "v") == want
