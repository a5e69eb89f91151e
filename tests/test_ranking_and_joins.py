"""Paths for hot keys give the same rows as the plain ones."""

import numpy as np
import pandas as pd
from conftest import rows
from pyspark.sql import functions as F
from pyspark.sql import Window

from seaglint.operators import ais, asof, catalogue, labels, ranking, selection, spatial


def hot_table(spark, n=3000):
    key = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 50).cast("string")))
    return spark.range(n).select(key.alias("k"), F.concat(F.lit("t"), F.xxhash64("id").cast("string")).alias("o"), "id")


def test_numbered_with_a_hot_group(spark):
    df = hot_table(spark)
    plain = df.withColumn("rn", F.row_number().over(Window.partitionBy("k").orderBy("o", "id")))
    split = ranking.numbered(df, ["k"], ["o", "id"], "rn")
    assert rows(split, "id", "rn") == rows(plain, "id", "rn")


def test_small_groups_are_numbered_in_one_shuffle(spark, monkeypatch):
    df = hot_table(spark).withColumn("k", F.when(F.col("k") != "k7", F.col("k")))  # a group without a key
    want = rows(df.withColumn("rn", F.row_number().over(Window.partitionBy("k").orderBy("o", "id"))), "id", "rn")
    for most in (100, 20, 5000):
        monkeypatch.setattr(ranking, "CROWDED_ROWS", most, raising=False)
        made = ranking.numbered(df, ["k"], ["o", "id"], "rn")
        assert rows(made, "id", "rn") == want and made.columns == ["k", "o", "id", "rn"]
    plan = made._jdf.queryExecution().sparkPlan().toString()
    assert "RDD" not in plan and "Join" not in plan and "Range (0, 3000" in plan  # neither written nor joined


def test_numbered_without_groups(spark):
    df = hot_table(spark, 1000)
    got = rows(ranking.numbered(df, [], ["o", "id"]), "rn")
    assert got == [(i,) for i in range(1, 1001)]


def test_newest_and_group_size(spark):
    df = hot_table(spark, 600)
    newest = ranking.newest_per_key(df, ["k"], F.col("id"))
    assert rows(newest, "k", "id") == rows(df.groupBy("k").agg(F.max("id")))
    sized = ranking.with_group_size(df, ["k"])
    assert sized.where("k = 'hot'").first()["n"] == 200


def brute_points(points, boxes, m=0.0):
    out = []
    for p in points.itertuples():
        hit = boxes[(boxes.lat_min - m <= p.lat) & (p.lat <= boxes.lat_max + m) & (boxes.lon_min - m <= p.lon) & (p.lon <= boxes.lon_max + m)]
        out += [(p.pid, b) for b in hit.bid]
    return sorted(out)


def point_box_fixture(spark):
    rng = np.random.default_rng(3)
    pts = pd.DataFrame({"pid": range(600), "lat": rng.uniform(30, 31, 600), "lon": rng.uniform(-10, -9, 600)})
    pts.loc[:200, ["lat", "lon"]] = [30.5, -9.5]  # a third of all points in one place
    low = rng.uniform([30, -10], [31, -9], (80, 2))
    bx = pd.DataFrame({"bid": range(80), "lat_min": low[:, 0], "lon_min": low[:, 1]})
    bx["lat_max"], bx["lon_max"] = bx.lat_min + 0.2, bx.lon_min + 0.2
    bx.loc[len(bx)] = [80, 30.5, -9.5, 30.7, -9.3]  # a corner on the crowded point
    bx["bid"] = bx.bid.astype(int)
    return pts, bx, spark.createDataFrame(pts), spark.createDataFrame(bx)


def test_points_in_boxes_is_exact(spark):
    pts, bx, sp, sb = point_box_fixture(spark)
    want = brute_points(pts, bx)
    assert rows(spatial.points_in_boxes(sp, sb, cell=0.1), "pid", "bid") == want
    assert rows(spatial.points_in_boxes(sp, sb, cell=0.03, margin=0.01), "pid", "bid") == brute_points(pts, bx, 0.01)


def test_no_pair_join_is_planned_as_nested_loop(spark):
    _, _, sp, sb = point_box_fixture(spark)
    plan = spatial.points_in_boxes(sp, sb, cell=0.1)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_dark_detections_against_brute_force(spark):
    rng = np.random.default_rng(5)

    def table(n, name):
        return pd.DataFrame(
            {name: range(n), "lat": rng.uniform(30, 30.05, n), "lon": rng.uniform(-10, -9.95, n), "t": rng.integers(0, 20000, n)}
        )

    det, pos = table(200, "det_id"), table(300, "pos_id")
    want = []
    for d in det.itertuples():
        a = np.sin(np.radians(pos.lat - d.lat) / 2) ** 2 + np.cos(np.radians(d.lat)) * np.cos(np.radians(pos.lat)) * np.sin(np.radians(pos.lon - d.lon) / 2) ** 2
        near = (2 * 6371000 * np.arcsin(np.sqrt(a)) <= 500) & ((pos.t - d.t).abs() <= 1800)
        if not near.any():
            want.append((d.det_id,))
    sd, sp = (spark.createDataFrame(x).withColumn("ts", F.timestamp_seconds("t")) for x in (det, pos))
    assert rows(ais.dark_detections(sd, sp), "det_id") == want
    assert 0 < len(want) < 200


def test_asof_slices_of_any_length_agree(spark):
    left = spark.range(500).select((F.col("id") % 2).alias("k"), F.timestamp_seconds(F.col("id") * 7001 % 900000).alias("ts"), "id")
    right = spark.range(60).select(
        (F.col("id") % 3).alias("k"), F.timestamp_seconds(F.col("id") * 13007 % 800000 + 50000).alias("updated_at"), F.col("id").cast("string").alias("v")
    )
    args = dict(key="k", left_time="ts", right_time="updated_at", right_cols=["v"], tie="v")
    plain = rows(asof.asof_latest(left, right, **args).select("id", F.coalesce("v", F.lit("-"))))
    split = rows(asof.asof_latest(left, right, slice_s=40000, **args).select("id", F.coalesce("v", F.lit("-"))))
    assert plain == split and len(plain) == 500 and any(v == "-" for _, v in plain)


def test_nearest_cell_against_brute_force(spark):
    rng = np.random.default_rng(8)
    cells = pd.DataFrame([(int(i), -17 + 0.5 * i, 27 + 0.5 * j, int(rng.integers(1, 99))) for i in range(12) for j in range(8) if rng.random() < 0.4], columns=["ci", "lon_min", "lat_min", "ais_count"])
    cells["lon_max"], cells["lat_max"], cells["cell_index"] = cells.lon_min + 0.5, cells.lat_min + 0.5, range(len(cells))
    low = rng.uniform([-20, 25], [-9, 33], (60, 2))
    sc = pd.DataFrame({"scene_id": range(60), "lon_min": low[:, 0], "lat_min": low[:, 1]})
    sc["lon_max"], sc["lat_max"] = sc.lon_min + 1, sc.lat_min + 1
    got = {r.scene_id: r.distance_deg for r in ais.nearest_cell(spark.createDataFrame(sc), ais.density_rank(spark.createDataFrame(cells))).collect()}
    for s in sc.itertuples():
        d = np.hypot(cells.lon_min + 0.25 - s.lon_min - 0.5, cells.lat_min + 0.25 - s.lat_min - 0.5).min()
        assert abs(got[s.scene_id] - d) < 1e-4


def test_cell_product_choice_avoids_repeats(spark):
    cells = spark.createDataFrame(
        [(1, 10, 0.0, 0.0, 1.0, 1.0, 9), (2, 11, 0.5, 0.5, 1.5, 1.5, 8), (3, 12, 0.6, 0.6, 1.0, 1.0, 7), (4, 13, 9.0, 9.0, 10.0, 10.0, 6)],
        "density_rank bigint, cell_index bigint, lon_min double, lat_min double, lon_max double, lat_max double, ais_count bigint",
    )
    name = "S1A_IW_GRDH_1SDV_a_b_{0}_{0}_{0}"
    products = spark.createDataFrame(
        [(1, name.format("p"), "2024-01-03"), (2, name.format("p") + "_COG", "2024-01-02"), (3, name.format("q"), "2024-01-01")], "id bigint, name string, d string"
    ).select("id", "name", F.to_timestamp("d").alias("date"), F.lit(0.0).alias("lon_min"), F.lit(0.0).alias("lat_min"), F.lit(2.0).alias("lon_max"), F.lit(2.0).alias("lat_max"))
    got = rows(catalogue.cell_product_join(cells, products), "density_rank", "product_id")
    # cell 1 takes the newest, cell 2 the other base id, cell 3 has only taken ones and repeats the newest, cell 4 has none
    assert got == [(1, "1"), (2, "3"), (3, "1")]


def test_density_map_of_the_region(spark):
    pts = spark.createDataFrame([(27.1, -17.0), (27.1, -16.9), (36.0, -1.0), (27.1, -17.2), (35.99, -0.5), (None, 1.0)], "lat double, lon double")
    got = rows(ais.density_map(pts), "cell_index", "ais_count")
    assert got == [(0, 2), (31 * 18 + 17, 1)]


def test_cut_groups_as_row_numbers(spark):
    key = F.when(F.col("id") % 5 == 0, "scene_0001_same").otherwise(F.concat(F.lit("scene_000"), (F.col("id") * 7919 % 9973).cast("string"), F.lit("é_tile"), (F.col("id") % 3).cast("string")))
    df = hot_table(spark, 3000).withColumn("name", F.when(F.col("id") == 7, None).otherwise(key)).withColumn("k", F.when(F.col("id") % 41 == 0, None).otherwise(F.col("k"))).repartition(6)
    places = [F.floor(F.col("n") * 0.3), F.floor(F.col("n") * 0.7)]
    for by in (["k"], []):
        part = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
        placed = df.select("k", F.coalesce("name", F.lit("")).alias("key"), F.row_number().over(part.orderBy(F.coalesce("name", F.lit("")), "id")).alias("rn"), F.count("*").over(part).alias("n"))
        want = placed.groupBy("k", "key").agg(*[F.count_if(c).alias(n) for n, c in zip("abc", (F.col("rn") <= places[0], (F.col("rn") > places[0]) & (F.col("rn") <= places[1]), F.col("rn") > places[1]))])
        for small in (1, 40, 10_000):
            got = selection.cut_groups(df, by, F.col("name"), places, ["a", "b", "c"], "part", small)
            assert got.columns == [*df.columns, "part"] and got.count() == 3000
            sums = got.groupBy(*by, F.coalesce("name", F.lit("")).alias("key")).agg(*[F.count_if(F.col("part") == n).alias(n) for n in "abc"])
            if by:
                assert sorted(map(str, sums.select("k", "key", *"abc").collect())) == sorted(map(str, want.select("k", "key", *"abc").collect()))
            else:
                flat = want.groupBy("key").agg(*[F.sum(n).alias(n) for n in "abc"])
                assert rows(sums, "key", *"abc") == rows(flat, "key", *"abc")


def test_cut_groups_of_equal_rows_and_nothing(spark):
    same = spark.range(1000).select(F.lit("x").alias("tile_id"), F.lit("s").alias("scene_id"))
    got = {r["split"]: r["count"] for r in labels.geo_split(same, (70, 15, 15)).groupBy("split").count().collect()}
    assert got == {"train": 700, "val": 150, "test": 150}
    assert labels.geo_split(same.where("false")).count() == 0
    three = labels.random_split(same.limit(3), "s", (1, 1, 1)).groupBy("split").count().collect()
    assert sorted(r["count"] for r in three) == [1, 1, 1]


def test_cut_keys_never_sort_or_copy_the_rows(spark):
    df = hot_table(spark, 2000).withColumn("wide", F.lit("x" * 50)).withColumn("tile_id", F.col("o"))
    plan = labels.chunk_split(df, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "Window" not in plan


def test_a_plan_that_misses_a_scene_counts_for_nothing(spark):
    tiles = spark.range(60).select(F.concat(F.lit("s"), (F.col("id") % 6).cast("string")).alias("scene_id"), F.col("id").cast("string").alias("tile_id"))
    plan = spark.createDataFrame([(f"s{i}", "test" if i else "odd") for i in range(6)], "scene_id string, split string")
    whole = rows(labels.scene_plan_split(tiles, plan).select("scene_id", "split").distinct())
    assert whole == [("s0", "train"), *[(f"s{i}", "test") for i in range(1, 6)]]
    part = rows(labels.scene_plan_split(tiles, plan.where("scene_id <> 's3'"), {"s1": (1, 1, 1)}).select("scene_id", "split").distinct())
    assert part == rows(labels.proportional_scene_split(tiles).select("scene_id", "split").distinct())


def test_nearest_cell_on_a_large_map(spark):
    n = 1000  # a million cells of 0.01 degrees, a hole in the middle, scenes inside, beside and far away
    ids = spark.range(n * n).select("id", (F.col("id") % n).alias("i"), F.floor(F.col("id") / n).alias("j")).where("not (i between 300 and 640 and j between 200 and 700)")
    cells = ids.select(F.col("id").alias("cell_index"), (F.col("id") % 1013).alias("density_rank"), F.lit(1).alias("ais_count"), *[(F.lit(a) + F.col(c) * 0.01).alias(m) for m, a, c in (("lon_min", -17.0, "i"), ("lat_min", 27.0, "j"), ("lon_max", -16.99, "i"), ("lat_max", 27.01, "j"))])
    rng = np.random.default_rng(12)
    low = np.concatenate([rng.uniform([-17, 27], [-7, 37], (60, 2)), rng.uniform([-14, 29], [-10.6, 34], (30, 2)), rng.uniform([-180, -90], [179, 89], (30, 2))])
    sc = pd.DataFrame({"scene_id": range(len(low)), "lon_min": low[:, 0], "lat_min": low[:, 1]})
    sc["lon_max"], sc["lat_max"] = sc.lon_min + 0.3, sc.lat_min + 0.2
    made = ais.nearest_cell(spark.createDataFrame(sc), cells, 0.01)
    assert "NestedLoop" not in made._jdf.queryExecution().executedPlan().toString()
    got = {r.scene_id: r.distance_deg for r in made.collect()}
    place = cells.select(((F.col("lon_min") + F.col("lon_max")) / 2).alias("x"), ((F.col("lat_min") + F.col("lat_max")) / 2).alias("y")).toPandas()
    for s in sc.itertuples():
        d2 = ((place.x - s.lon_min - 0.15) ** 2 + (place.y - s.lat_min - 0.1) ** 2).min()
        assert abs(got[s.scene_id] - np.sqrt(round(d2, 9))) < 1e-4, s


def test_coverage_as_pairs(spark):
    rng = np.random.default_rng(6)
    n = 400
    pos = spark.createDataFrame(pd.DataFrame({"lat": np.round(rng.uniform(30, 34, n), 2), "lon": np.round(rng.uniform(-12, -8, n), 2), "t": rng.integers(0, 20, n) * 86400})).withColumn("ts", F.timestamp_seconds("t"))
    low = np.round(rng.uniform([-12, 30], [-8, 34], (300, 2)), 2)
    side = rng.choice([0.0, 0.02, 0.3, 1.25], (300, 2))
    sc = pd.DataFrame({"scene_id": range(300), "lon_min": low[:, 0], "lat_min": low[:, 1], "lon_max": low[:, 0] + side[:, 0], "lat_max": low[:, 1] + side[:, 1], "t": rng.integers(0, 20, 300) * 86400 + 5000})
    scenes = spark.createDataFrame(sc).withColumn("acquired", F.timestamp_seconds("t"))
    want = {r.scene_id for r in ais.ais_in_scene_window(pos, scenes).select("scene_id").distinct().collect()}
    for cell in (0.1, 0.25, 2.0):
        got = ais.ais_coverage(pos, scenes, cell)
        assert {r.scene_id for r in got.where("has_ais").collect()} == want and got.count() == 300
    assert 20 < len(want) < 280


def test_dataset_build_with_a_quarantine(spark):
    from seaglint.operators import dataset

    box = lambda c, x: f"{c} 0.{x} 0.5 0.1 0.1"
    texts = {
        "ok1": [box(0, 1), box(1, 1), box(0, 2), "  "], "ok2": ["0  0.1 0.5 0.1 0.1", box(0, 1)], "ok3": ["-1 0.3 0.5 0.1 0.1"], "blank": ["", "  "],
        "parts": [box(0, 1), "0 0.1"], "words": ["a 0.1 0.5 0.1 0.1"], "out": ["0 1.5 0.5 0.1 0.1"], "flat": ["0 0.1 0.5 0.0 0.1"], "alone": [box(0, 1)], "dark": [box(0, 1)],
    }
    lines = spark.createDataFrame([(t, i, x) for t, some in texts.items() for i, x in enumerate(some)], "tile_id string, line_no int, txt string")
    files = spark.createDataFrame([(t, f"S1C_{t[:2]}") for t in [*texts, "none"]], "tile_id string, scene_id string")
    images = spark.createDataFrame([(t, 0.31 if t == "dark" else 0.3) for t in texts if t != "alone"], "tile_id string, zero_share double")
    made = dataset.build_dataset(files, lines, images, stratify=True)
    assert rows(made.quarantine, "tile_id", "reason") == [("alone", "no_image"), ("blank", "empty"), ("dark", "nodata"), ("flat", "size"), ("none", "empty"), ("out", "outside"), ("parts", "parts"), ("words", "non_numeric")]
    assert rows(made.tiles, "tile_id", "split", "n_boxes", "n_duplicates") == [("ok1", "train", 2, 1), ("ok2", "train", 1, 1), ("ok3", "test", 1, 0)]
    assert rows(made.lines, "tile_id", "line_no", "txt") == [("ok1", 0, box(0, 1)), ("ok1", 2, box(0, 2)), ("ok2", 0, "0  0.1 0.5 0.1 0.1"), ("ok3", 0, "-1 0.3 0.5 0.1 0.1")]
    assert made.counts == {"total": 11, "kept": 3, "duplicates": 2, "empty": 2, "parts": 1, "non_numeric": 1, "outside": 1, "size": 1, "no_image": 1, "nodata": 1}
    plan = spark.createDataFrame([("S1C_ok", "val")], "scene_id string, split string")
    assert {r.split for r in dataset.build_dataset(files, lines, images, plan=plan).tiles.collect()} == {"val"}
    assert dataset.build_dataset(files.limit(0), lines.limit(0), images).tiles.count() == 0


def test_coverage_lists_a_scene_under_few_blocks(spark, monkeypatch):
    pos = spark.range(5000).select((30 + F.rand(1) * 8).alias("lat"), (-20 + F.rand(2) * 8).alias("lon"), F.timestamp_seconds(F.col("id") * 500).alias("ts"))
    low = spark.range(100).select(F.col("id").alias("scene_id"), (29 + F.rand(3) * 8).alias("lat_min"), (-21 + F.rand(4) * 8).alias("lon_min"), F.timestamp_seconds(F.col("id") * 26_000).alias("acquired"))
    scenes = low.withColumns({"lat_max": F.col("lat_min") + 1.5, "lon_max": F.col("lon_min") + 2}).checkpoint()
    listed, join = [], ais.join_listed
    monkeypatch.setattr(ais, "join_listed", lambda one, many, keys: listed.append(many) or join(one, many, keys))
    got = {r.scene_id for r in ais.ais_coverage(pos, scenes).where("has_ais").collect()}
    assert got == {r.scene_id for r in ais.ais_in_scene_window(pos, scenes).select("scene_id").distinct().collect()}
    assert listed[0].count() <= 8 * 100  # 315 days and cells each


def test_first_tile_without_a_shuffle_of_pairs(spark, monkeypatch):
    from pyspark.sql import Window

    rng = np.random.default_rng(8)
    n = 300
    pts = pd.DataFrame({"pid": [*range(n - 2), 0, 1], "lat": rng.uniform(30, 31, n), "lon": rng.uniform(-10, -9, n)})
    low = rng.uniform([30, -10], [31, -9], (400, 2))
    frames = pd.DataFrame({"scene_id": [f"s{i % 4}" for i in range(400)], "tile_id": [f"t{i:03d}" for i in range(400)], "tile_no": rng.integers(0, 60, 400), "lat_min": low[:, 0], "lon_min": low[:, 1]})
    frames["lat_max"], frames["lon_max"] = frames.lat_min + 0.2, frames.lon_min + 0.2
    sp, sf = spark.createDataFrame(pts), spark.createDataFrame(frames)
    pairs = spatial.points_in_boxes(sp, sf, margin=0.0005)
    for per in ((), ("scene_id",)):
        rank = F.row_number().over(Window.partitionBy("pid", *per).orderBy("tile_no", "tile_id"))
        want = rows(pairs.withColumn("rn", rank).where("rn = 1"), "pid", "lat", "scene_id", "tile_id", "lat_max")
        for run in (256, 5):
            monkeypatch.setattr(ais, "FIRST_TILES", run)
            got = ais.points_first_tile(sp, sf, point_id="pid", per=per)
            assert rows(got, "pid", "lat", "scene_id", "tile_id", "lat_max") == want
            assert set(got.columns) == set(pairs.columns)
    # The ranking gets what the runs could not settle: nothing where no id occurs twice and no run is cut.
    ranked, top = [], ais.top_per_group
    monkeypatch.setattr(ais, "FIRST_TILES", 256)
    monkeypatch.setattr(ais, "top_per_group", lambda df, *more: ranked.append(df) or top(df, *more))
    ais.points_first_tile(sp.where("pid > 1"), sf, point_id="pid", per=("scene_id",))
    assert ranked[0].isEmpty()


def test_annotations_are_not_written_for_the_report(spark):
    from seaglint.plans import flows

    pos = spark.range(200).select(F.col("id").alias("pos_id"), (30 + F.rand(1)).alias("lat"), (-10 + F.rand(2)).alias("lon"), F.lit("2024-01-05 01:00:00").cast("timestamp").alias("ts"), F.lit("cargo").alias("vessel_type"), F.lit("ais_presence_amorce").alias("source"))
    frames = spark.range(25).select(F.lit("s").alias("scene_id"), F.concat(F.lit("t"), "id").alias("tile_id"), (30 + F.floor(F.col("id") / 5) * 0.2).alias("lat_min"), (-10 + F.col("id") % 5 * 0.2).alias("lon_min"))
    frames = frames.withColumns({"lat_max": F.col("lat_min") + 0.2, "lon_max": F.col("lon_min") + 0.2})
    scenes = spark.createDataFrame([("s",)], "scene_id string").withColumn("acquired", F.lit("2024-01-05 06:00:00").cast("timestamp"))
    notes, report = flows.annotate_scenes(pos, frames, scenes)
    assert report.first().total_annotations == notes.count() == 200
    # The report is planned over the saved window join, without the boxes of the annotations.
    plan = report._jdf.queryExecution().optimizedPlan().toString()
    assert "pixel_x" not in plan and "md5" not in plan and "md5" in notes._jdf.queryExecution().optimizedPlan().toString()
    assert "seaglint-saved" in " ".join(notes.inputFiles())


def test_rows_of_few_groups_stay_where_they_are(spark, monkeypatch):
    df = spark.range(3000).select((F.col("id") % 3).alias("g"), F.format_string("t%06d", F.col("id") * 7919 % 3001).alias("tile_id"))
    got = {}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # so that no side is sent for its size alone
    for most in (10_000, 2):
        monkeypatch.setattr(selection, "FEW_GROUPS", most, raising=False)
        made = labels.chunk_split(df, ["g"])
        got[most] = rows(made, "tile_id", "split")
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert ("BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning" not in plan) == (most > 2)
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got[10_000] == got[2] and len(got[2]) == 3000


def test_near_rows_are_listed_under_few_places(spark):
    import re
    from datetime import datetime, timedelta
    from math import asin, cos, radians, sin, sqrt
    from random import Random

    from seaglint import config as C

    def metres(a, b):
        h = sin(radians(b[1] - a[1]) / 2) ** 2 + cos(radians(a[1])) * cos(radians(b[1])) * sin(radians(b[2] - a[2]) / 2) ** 2
        return 2 * C.EARTH_RADIUS_M * asin(sqrt(h))

    def points(n, seed):
        draw = Random(seed)
        return [(i, 59.9 + draw.random() / 10, -0.1 + draw.random() / 5, datetime(1969, 12, 31, 20) + timedelta(seconds=draw.randrange(28_800))) for i in range(n)]

    left, right = points(400, 0), points(900, 1)
    want = sorted({a[0] for a in left for b in right if abs((a[3] - b[3]).total_seconds()) <= 1800 and metres(a, b) <= 500})
    assert 50 < len(want) < 390
    a, b = (spark.createDataFrame(r, "id long, lat double, lon double, ts timestamp").coalesce(1) for r in (left, right))
    near = spatial.near_in_space_and_time(a, b, left_id="id", radius_m=500.0, window_s=1800)
    assert sorted(r["id"] for r in near.collect()) == want
    listed = []

    def walk(node):
        if node.getClass().getSimpleName() == "GenerateExec":
            listed.append(node.metrics().apply("numOutputRows").value())
        under = node.children() if node.getClass().getSimpleName() != "AdaptiveSparkPlanExec" else None
        if under is None:
            return walk(node.executedPlan())
        if re.search("QueryStage", node.getClass().getSimpleName()):
            return walk(node.plan())
        for i in range(under.size()):
            walk(under.apply(i))
    walk(near._jdf.queryExecution().executedPlan())
    assert len(listed) == 3 and max(listed) < 6 * 400


def test_pairs_by_blocks_are_the_pairs(spark, monkeypatch):
    pts, bx, _, _ = point_box_fixture(spark)
    pts, bx = pd.concat([pts, pts.head(3)]), pd.concat([bx, bx.tail(2)])  # some rows twice
    bx.loc[len(bx) + 9] = [99, 50.0, 50.0, 50.1, 50.1]  # without a point
    sp, sb = spark.createDataFrame(pts), spark.createDataFrame(bx)
    none = spark.createDataFrame([(-1, None, 1.0), (-2, float("nan"), -9.5)], "pid long, lat double, lon double")
    names = dict(BLOCK_BOXES=(4096, 7), BLOCK_POINTS=(65_536, 11), RUN_POINTS=(64, 3), FEW_CELLS=(100_000, 0))
    for small in (0, 1):
        for name, values in names.items():
            monkeypatch.setattr(spatial, name, values[small])
        for cell, margin in ((0.4, 0.0), (0.03, 0.01)):
            want = rows(spatial.points_in_boxes(sp, sb, cell=cell, margin=margin))
            made = spatial.pairs_by_blocks(sp.unionByName(none), sb, cell=cell, margin=margin)
            assert made.columns == ["pid", "lat", "lon", "bid", "lat_min", "lon_min", "lat_max", "lon_max"]
            assert rows(made, *spatial.points_in_boxes(sp, sb).columns) == want and len(want) > 100
            plan = made._jdf.queryExecution().executedPlan().toString()
            assert "NestedLoop" not in plan and "Cartesian" not in plan and ("Broadcast" in plan) == (not small)
    assert spatial.pairs_by_blocks(sp.where("false"), sb).isEmpty() and spatial.pairs_by_blocks(sp, sb.where("false")).isEmpty()


def test_a_crowded_cell_is_cut_into_blocks(spark, tmp_path, monkeypatch):
    n = 3000
    same = spark.createDataFrame(pd.DataFrame({"pid": range(n), "lat": 30.55, "lon": -9.45}))
    frames = spark.createDataFrame(pd.DataFrame({"bid": range(n), "lat_min": 30.5, "lon_min": -9.5, "lat_max": 30.6, "lon_max": -9.4}))
    monkeypatch.setattr(spatial, "BLOCK_BOXES", 100)
    monkeypatch.setattr(spatial, "BLOCK_POINTS", 500)
    spatial.pairs_by_blocks(same, frames).select("pid", "bid").write.parquet(f"{tmp_path}/out")
    per = [r["count"] for r in spark.read.parquet(f"{tmp_path}/out").groupBy(F.input_file_name()).count().collect()]
    assert sum(per) == n * n and max(per) < n * n / 10


def test_results_of_many_tiles_are_written_in_few_bytes(spark, tmp_path):
    import glob

    import pyarrow.parquet as pq
    from seaglint.plans import registry

    registry.load()
    # 80 scenes at one place and the positions there: more tile ids than one dictionary of a file holds.
    spark.range(80 * 256).select((F.floor(F.col("id") / 256) * 286 * 256 + F.col("id") % 256).alias("p_partkey")).write.parquet(f"{tmp_path}/part.parquet")
    ids = spark.range(1_000_000).where("id * 7919 % 13000 < 1700 and id * 104729 % 28000 < 1700 and id % 3 = 0")
    ids.select(F.col("id").alias("event_id"), F.lit(1).alias("user_id"), F.lit("view").alias("event_type"), F.timestamp_seconds("id").alias("ts")).write.parquet(f"{tmp_path}/events.parquet")
    for name in ("build_ground_truth", "points_in_tiles"):
        registry.QUERIES[name](spark, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        size = n = 0
        for part in glob.glob(f"{tmp_path}/{name}/*.parquet"):
            about = pq.ParquetFile(part).metadata
            n += about.num_rows
            for group in (about.row_group(g) for g in range(about.num_row_groups)):
                size += sum(c.total_compressed_size for c in map(group.column, range(group.num_columns)) if c.path_in_schema == "tile_id")
        assert n > 500_000 and size < 1.5 * n, (name, n, size / n)


def test_dark_rows_travel_once(spark):
    rng = np.random.default_rng(15)
    n = 300
    det = pd.DataFrame({"det_id": [i % 290 for i in range(n)], "lat": rng.uniform(59.9, 60.0, n), "lon": rng.uniform(-0.1, 0.1, n), "t": rng.integers(-9000, 9000, n)})
    pos = pd.DataFrame({"lat": rng.uniform(59.9, 60.0, 900), "lon": rng.uniform(-0.1, 0.1, 900), "t": rng.integers(-9000, 9000, 900)})
    sd, sp = (spark.createDataFrame(x).withColumn("ts", F.timestamp_seconds("t")) for x in (det, pos))
    odd = spark.createDataFrame([(900, None, 0.0, 1), (901, 60.0, None, 1), (None, 60.0, 0.0, 90_000)], "det_id long, lat double, lon double, t long")
    odd = odd.withColumn("ts", F.timestamp_seconds("t"))
    near = sd.crossJoin(sp.select(F.col("lat").alias("b"), F.col("lon").alias("a"), F.col("t").alias("u")))
    a = F.pow(F.sin(F.radians(F.col("b") - F.col("lat")) / 2), 2) + F.cos(F.radians("lat")) * F.cos(F.radians("b")) * F.pow(F.sin(F.radians(F.col("a") - F.col("lon")) / 2), 2)
    near = near.where((F.abs(F.col("t") - F.col("u")) <= 1800) & (2 * 6371000.0 * F.asin(F.sqrt(a)) <= 500)).select("det_id", "lat").distinct()
    want = rows(sd.join(near, ["det_id", "lat"], "left_anti"), "det_id", "lat")
    dark = ais.dark_detections(sd.unionByName(odd), sp)
    assert rows(dark.where("det_id < 900"), "det_id", "lat") == want and 20 < len(want) < 280
    assert dark.where("det_id >= 900 or det_id is null").count() == 3 and dark.columns == ["det_id", "lat", "lon", "t", "ts"]
    # One shuffle for each side; a row's id is not sent when nobody reads it.
    plan = ais.dark_detections(sd, sp).groupBy().count()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "LeftAnti" in plan and "det_id" not in plan.split("SortMergeJoin")[0]


def test_first_tile_by_pieces_of_odd_boxes(spark, monkeypatch):
    rng = np.random.default_rng(21)
    n = 160
    low = np.round(rng.uniform([29.7, -10.3], [30.9, -9.1], (n, 2)), 1)
    side = rng.choice([0.0, 0.1, 0.2, 0.9], (n, 2))
    f = pd.DataFrame({"scene_id": [f"s{i % 3}" for i in range(n)], "zone": [i % 2 for i in range(n)], "tile_id": [f"t{i:03d}" for i in range(n)], "tile_no": rng.integers(0, 40, n), "lat_min": low[:, 0], "lon_min": low[:, 1], "lat_max": low[:, 0] + side[:, 0], "lon_max": low[:, 1] + side[:, 1]})
    f.loc[5, "lat_max"] = f.lat_min[5] - 0.3  # no point lies in it
    f.loc[6, "lon_max"] = np.nan
    # Points on the borders of the widened boxes, beside them and on cell borders.
    m = 0.0005
    lat = np.concatenate([f.lat_min - m, f.lat_max + m, np.nextafter(f.lat_max + m, 99), np.nextafter(f.lat_min - m, -99), np.round(rng.uniform(29.6, 31, 200), 1)])
    lon = np.concatenate([f.lon_min - m, f.lon_max + m, f.lon_min - m, f.lon_max + m, np.round(rng.uniform(-10.4, -9, 200), 1)])
    pts = pd.DataFrame({"pid": range(len(lat)), "zone": [i % 2 for i in range(len(lat))], "lat": lat, "lon": lon}).dropna()
    want = {}
    for per in ((), ("scene_id",)):
        for on in ((), ("zone",)):
            got = []
            for q in pts.itertuples():
                hit = f[(q.lat >= f.lat_min - m) & (q.lat <= f.lat_max + m) & (q.lon >= f.lon_min - m) & (q.lon <= f.lon_max + m) & ((f.zone == q.zone) | (not on))]
                hit = hit.sort_values(["tile_no", "tile_id"])
                got += [(q.pid, t) for t in (hit.groupby("scene_id").tile_id.first() if per else hit.tile_id.head(1))]
            want[per, on] = sorted(got)
    assert min(map(len, want.values())) > 300
    sp, sf = spark.createDataFrame(pts), spark.createDataFrame(f)
    for most in (1024, 3):
        monkeypatch.setattr(ais, "FIRST_TILES", most)
        for (per, on), w in want.items():
            tiles, some = (sf, sp) if on else (sf.drop("zone"), sp.drop("zone"))
            made = ais.points_first_tile(some, tiles, point_id="pid", on=on, per=per)
            assert rows(made, "pid", "tile_id") == w, (most, per, on)
    # Points meet tiles once, and no tile of a list is looked at for each point.
    monkeypatch.setattr(ais, "FIRST_TILES", 1024)
    plan = ais.points_first_tile(sp, sf.drop("zone"), point_id="pid", per=("scene_id",))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 1 and "lambda" not in plan


def test_pieces_do_not_overlap():
    rng = np.random.default_rng(22)
    low = rng.integers(0, 12, (60, 2)).astype(float)
    sides = np.hstack([low, low + rng.integers(0, 5, (60, 2))])
    at, held = ais._first_owner(sides)
    for y, x in [(a / 2, b / 2) for a in range(-1, 36) for b in range(-1, 36)]:
        inside = lambda b: (b[:, 0] <= y) & (y <= b[:, 2]) & (b[:, 1] <= x) & (x <= b[:, 3])
        assert at[inside(held)].tolist() == np.flatnonzero(inside(sides))[:1].tolist()
    assert len(ais._first_owner(np.array([[0.0, 0.0, -1.0, 1.0], [np.nan] * 4]))[0]) == 0

