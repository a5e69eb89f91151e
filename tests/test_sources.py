import json
import os

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from seaglint.sources import files, sinks
from seaglint.sources.event_store import KeyedStore


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text) if isinstance(text, str) else path.write_bytes(text)


def test_manifests_one_row_per_tile(spark, tmp_path):
    for s in ("a", "b"):
        tile = {"tile_id": f"{s}_D_tile0000", "scene_id": s, "pipeline": "D", "pixel_bbox": [0, 0, 5, 5], "geo_bbox": [1.0, 2.0, 3.0, 4.0], "npy_path": "x"}
        put(tmp_path / s / "D" / "metadata.json", json.dumps({"scene_id": s, "pipeline": "D", "tile_size": 512, "tiles": [tile, tile]}, indent=1))
    put(tmp_path / "other.json", "{}")
    got = files.scan_tile_manifests(spark, str(tmp_path))
    assert got.count() == 4 and rows(got.distinct(), "scene_id", "lat_min", "lon_max") == [("a", 1.0, 4.0), ("b", 1.0, 4.0)]


def test_label_files_and_scene_discovery(spark, tmp_path):
    base = "S1A_IW_GRDH_x"
    put(tmp_path / base / "labels" / "t1.txt", "0 0.1 0.2 0.3 0.4\nbad line\n\n1 0.1 0.2 0.3 0.4")
    put(tmp_path / base / "labels" / "t2.txt", "")
    put(tmp_path / base / "cvat_import" / "images" / "t1.png", b"x")
    put(tmp_path / ".hidden" / "labels" / "t9.txt", "0 0 0 0 0")
    put(tmp_path / "S1C_no_images" / "labels" / "t5.txt", "0 0 0 0 0")
    root = str(tmp_path)
    assert rows(files.scan_label_files(spark, f"{root}/{base}"), "tile_id", "line_no") == [("t1", 0), ("t1", 3)]
    listing = files.list_label_files(spark, f"{root}/{base}")
    assert rows(listing, "tile_id", "scene_id") == [("t1", base), ("t2", base)]
    assert rows(files.non_empty_labels(listing), "tile_id") == [("t1",)]
    put(tmp_path / base / "notes.txt", "not a label")
    found = files.discover_scenes(spark, root)
    assert rows(found, "scene_id", "n_labels", "n_images", "total_boxes", "short_id") == [(base, 2, 1, 3, "S1A_IW_GRDH")]
    assert files.discover_scenes(spark, root, ["S1C"]).count() == 0


@pytest.mark.parametrize(
    "answer, n",
    [
        ('{"entries":[{"lat":1},{"lat":2},{"lat":3}]}', 3),
        ('{"results":[{"lat":1},{"lat":2}]}', 2),
        ('{"data":[{"lat":1}]}', 1),
        ('{"rows":[]}', 0),
        (None, 0),
        ('{"features":[{"lat":1},{"lat":2}]}', 2),
        ('{"entries":[{"public-set:v4":[{"lat":1},{"lat":2}]}]}', 2),
        ('{"public-set:v4":[{"lat":1},{"lat":2}]}', 2),
        ('{"total":2,"a":[{"lat":1}],"b":[{"lat":2}]}', 2),
        ('{"entries":[{"a":[{"lat":1}]},{"b":[{"lat":2}]}]}', 2),
    ],
)
def test_answer_shapes(spark, answer, n):
    df = spark.createDataFrame([(1, answer)], "page int, value string")
    got = files.response_entries(df)
    assert got.count() == n
    assert all(json.loads(r.record)["lat"] for r in got.collect())


def test_catalogue_defaults(spark, tmp_path):
    put(tmp_path / "c.json", json.dumps({"value": [{"Id": "1", "Name": "n", "ContentDate": {"Start": "2024-01-01T00:00:00Z"}, "ContentLength": 5}, {"Id": "2"}]}))
    got = {r.id: r for r in files.scan_catalogue(spark, str(tmp_path / "c.json")).collect()}
    assert got["1"].size == 5 and got["2"].size == 0 and got["2"].name == "" and got["2"].date is None


def test_lut_vectors(spark, tmp_path):
    cal = "<calibration><calibrationVectorList>" + "".join(
        f'<calibrationVector><line>{ln}</line><pixel count="3">0 40 80</pixel><sigmaNought count="3">1.5 2.5 {ln}</sigmaNought></calibrationVector>' for ln in (0, 10)
    ) + "</calibrationVectorList></calibration>"
    put(tmp_path / "cal.xml", cal)
    put(tmp_path / "new.xml", '<n><noiseRangeVector><line>5</line><pixel count="2">0 9</pixel><noiseRangeLut count="2">7 8</noiseRangeLut></noiseRangeVector></n>')
    put(tmp_path / "old.xml", '<n><noiseVector><line>6</line><pixel count="2">0 9</pixel><noiseLut count="2">3 4</noiseLut></noiseVector></n>')
    lut = files.explode_vectors(files.calibration_vectors(spark, str(tmp_path / "cal.xml")))
    assert rows(lut, "line", "pixel", "value") == [(0, 0, 1.5), (0, 40, 2.5), (0, 80, 0.0), (10, 0, 1.5), (10, 40, 2.5), (10, 80, 10.0)]
    noise = files.explode_vectors(files.noise_vectors(spark, f"{tmp_path}/[no]*.xml"))
    assert rows(noise, "line", "value") == [(5, 7.0), (5, 8.0), (6, 3.0), (6, 4.0)]


def test_footprints_and_traces(spark, tmp_path):
    name = "S1A_IW_GRDH_1SDV_20240107T064657_x_051997_06488E_B2F9"
    put(tmp_path / f"{name}.SAFE" / "manifest.safe", "<a><gml:coordinates>35.0,-9.5 36.0,-6.5 34.0,-6.0 33.5,-9.0</gml:coordinates></a>")
    put(tmp_path / f"{name}.SAFE" / "target_trace.json", json.dumps({"scene_id": name, "target_density_cell_index": 7, "protocol": "p"}))
    put(tmp_path / "target_trace.json", json.dumps({"scene_id": "beside"}))
    f = files.scan_footprints(spark, str(tmp_path)).first()
    assert (f.scene_id, f.lon_min, f.lat_min, f.lon_max, f.lat_max, str(f.date)) == (name, -9.5, 33.5, -6.0, 36.0, "2024-01-07")
    assert rows(files.scan_target_traces(spark, str(tmp_path)), "scene_id", "folder", "target_density_cell_index") == [(name, name, 7)]


def test_tle_files(spark, tmp_path):
    put(tmp_path / "j" / "25544.json", json.dumps([{"tle0": "0 ISS", "tle1": "1 25544U", "tle2": "2 25544"}, {"tle0": "0 OLD", "tle1": "1 x", "tle2": "2 x"}]))
    put(tmp_path / "j" / "39634.json", "[]")
    put(tmp_path / "t" / "39634.txt", "SENTINEL-1A\r\n1 39634U\r\n2 39634\r\n")
    put(tmp_path / "t" / "111.txt", "BAD\n1 111\nX\n")
    got = files.scan_tle_sets(spark, f"{tmp_path}/j", f"{tmp_path}/t")
    assert rows(got, "norad_id", "name", "source") == [(25544, "ISS", "satnogs"), (39634, "SENTINEL-1A", "celestrak")]


def test_product_files(spark):
    p = "/d/{}.SAFE/{}"
    paths = [
        p.format("A", "measurement/s1a-iw-grd-vv-1-001.tiff"), p.format("A", "measurement/s1a-iw-grd-vv-1-001-cog.tiff"),
        p.format("A", "annotation/calibration/calibration-s1a-vv.xml"), p.format("A", "annotation/calibration/noise-s1a-vv.xml"),
        p.format("B", "measurement/x_vv.tiff"), p.format("C", "measurement/s1a-iw-grd-vh-1.tiff"), p.format("C", "annotation/calibration/calibration-s1a-vv.xml"),
    ]
    good, bad = files.pick_product_files(spark.createDataFrame([(x,) for x in paths], "path string"))
    g = good.first()
    assert good.count() == 1 and g.measurement.endswith("cog.tiff") and g.noise.endswith("noise-s1a-vv.xml")
    assert rows(bad, "product", "missing") == [("B", "calibration"), ("C", "measurement")]


def test_npy_tiles(spark, tmp_path):
    from seaglint.operators import raster

    np.save(tmp_path / "a_tile.npy", np.arange(6, dtype="uint8").reshape(2, 3))
    got = files.read_npy_tiles(spark, str(tmp_path))
    assert rows(got, "tile_id", "h", "w", "dtype") == [("a_tile", 2, 3, "uint8")]
    assert rows(raster.unpack_tiles(got, ["tile_id"]), "v") == [(i,) for i in range(6)]


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([("t1", 0, 0.1, 0.2, 0.3, 0.4, 35.0, -9.0), ("t2", 2, 0.5, 0.5, 0.1, 0.1, None, 1.0)], "tile_id string, class_id int, cx double, cy double, w double, h double, lat double, lon double")
    out = str(tmp_path)
    sinks.export_csv(df, f"{out}/csv", ["tile_id", "cx"])
    assert rows(spark.read.option("header", True).csv(f"{out}/csv")) == [("t1", "0.1"), ("t2", "0.5")]
    sinks.export_json(df, f"{out}/json")
    assert spark.read.json(f"{out}/json").count() == 2
    sinks.export_geojson(df.select("tile_id", "lat", "lon"), f"{out}/geo")
    assert [json.loads(r.value) for r in spark.read.text(f"{out}/geo").collect()] == [
        {"type": "Feature", "geometry": {"type": "Point", "coordinates": [-9.0, 35.0]}, "properties": {"tile_id": "t1"}}
    ]
    sinks.export_yolo(df.withColumn("scene_id", F.lit("s")), f"{out}/yolo")
    assert rows(spark.read.parquet(f"{out}/yolo"), "tile_id", "line") == [("t1", "0 0.100000 0.200000 0.300000 0.400000"), ("t2", "2 0.500000 0.500000 0.100000 0.100000")]
    box = spark.createDataFrame([("s", "t1.npy", "vessel_x", "1.0", 0)], "scene_id string, image string, label string, xtl string, z_order bigint")
    sinks.export_cvat(box, f"{out}/cvat")
    assert spark.read.format("xml").option("rowTag", "box").load(f"{out}/cvat").count() == 1
    sinks.export_metrics(df.select("tile_id", "cx"), f"{out}/m")
    assert spark.read.json(f"{out}/m/json").count() == 2
    s = spark.createDataFrame([("ALL", "ALL", 5, 9), ("train", "ALL", 4, 7), ("val", "ALL", 1, 2), ("train", "s", 4, 7)], "split string, scene_id string, images bigint, boxes bigint")
    got = sinks.dataset_yaml(s, f"{out}/data.yaml", f"{out}/sum.json")
    assert got["split"] == {"train": 4, "val": 1, "test": 0} and got["total_boxes"] == 9
    assert "nc: 1" in open(f"{out}/data.yaml").read()


def test_event_store(spark, tmp_path):
    store = KeyedStore(str(tmp_path / "s"), ["event_id"], "arrival")
    assert store.current(spark) is None
    make = lambda data: spark.createDataFrame(data, "event_id string, arrival bigint, zone string")
    store.append(make([("a", 1, "Z1"), ("b", 2, "Z1")]), 0)
    store.append(make([("a", 3, "Z2")]), 1)
    store.append(make([("a", 3, "Z2")]), 1)  # the same batch again
    want = [("a", 3, "Z2"), ("b", 2, "Z1")]
    assert rows(store.current(spark), "event_id", "arrival", "zone") == want
    store.compact(spark)
    assert rows(store.current(spark), "event_id", "arrival", "zone") == want
    store.append(make([("b", 9, "Z3"), ("c", 1, "Z1")]), 2)
    assert rows(store.current(spark), "event_id", "zone") == [("a", "Z2"), ("b", "Z3"), ("c", "Z1")]
    store.compact(spark)
    assert store.current(spark).count() == 3
    store.append(make([("d", 1, "Z1")]), 0, "other")  # a second writer starts at batch 0 too
    store.append(make([("d", 2, "Z2"), ("a", 1, "Z9")]), 1, "other")
    want = [("a", "Z2"), ("b", "Z3"), ("c", "Z1"), ("d", "Z2")]
    assert rows(store.current(spark), "event_id", "zone") == want
    store.compact(spark)
    store.compact(spark)
    assert rows(store.current(spark), "event_id", "zone") == want


def test_event_store_in_levels(spark, tmp_path):
    store = KeyedStore(str(tmp_path / "s"), ["event_id"], "arrival")
    want = {}
    for batch in range(10):
        data = [(f"e{(batch * 37 + i * 11) % 300:05d}", batch * 100 + i, f"Z{batch}") for i in range(100)]
        want.update({e: (a, z) for e, a, z in sorted(data, key=lambda r: r[1])})
        store.append(spark.createDataFrame(data, "event_id string, arrival bigint, zone string"), batch)
        store.compact(spark, fan=3)
    _, segments, _ = store._state(spark)
    assert sorted(at for at, _ in segments) == [0, 2]  # nine batches in one, the tenth by itself
    assert {r.event_id: (r.arrival, r.zone) for r in store.current(spark).collect()} == want
    store.compact(spark, fan=3)
    assert store._state(spark)[1] == segments  # nothing new, nothing written


def test_a_few_keys_read_few_rows(spark, tmp_path):
    store = KeyedStore(str(tmp_path / "s"), ["event_id"], "arrival")
    n = 60_000
    for batch in range(3):
        rows_in = spark.range(n).select(F.md5(F.concat(F.col("id").cast("string"), F.lit(str(batch % 2)))).alias("event_id"), (F.col("id") + batch * n).alias("arrival"))
        store.append(rows_in.repartition(4), batch)
        if batch < 2:
            store.compact(spark)
    key = rows_in.where("id = 77" if "id" in rows_in.columns else F.col("arrival") == 77 + 2 * n).first()["event_id"]
    found = store.current(spark).where(F.col("event_id") == key)
    assert [(r.event_id, r.arrival) for r in found.collect()] == [(key, 77 + 2 * n)]
    leaves = found._jdf.queryExecution().executedPlan().finalPhysicalPlan().collectLeaves()

    def scans(node):
        kind = node.getClass().getSimpleName()
        if kind == "FileSourceScanExec":
            return [node.metrics().apply("numOutputRows").value()]
        if kind.endswith("QueryStageExec"):
            inner = node.plan().collectLeaves()
            return [x for i in range(inner.size()) for x in scans(inner.apply(i))]
        return []

    read = sum(x for i in range(leaves.size()) for x in scans(leaves.apply(i)))
    assert 0 < read < 3 * n / 3


def test_tiles_of_earlier_scenes_stay(spark, tmp_path):
    make = lambda s, n: spark.createDataFrame([(s, "D", i, n) for i in range(2)], "scene_id string, code string, tile_no int, v int")
    for scene, value in (("S1", 1), ("S2", 2), ("S1", 3)):
        sinks.write_tiles(make(scene, value), str(tmp_path / "t"))
    assert rows(spark.read.parquet(str(tmp_path / "t")), "scene_id", "tile_no", "v") == [("S1", 0, 3), ("S1", 1, 3), ("S2", 0, 2), ("S2", 1, 2)]


def test_a_box_of_a_clustered_table_reads_little(spark, tmp_path):
    from seaglint.sources import layout

    n = 200_000
    pts = spark.range(n).select("id", (F.rand(1) * 60 + 5).alias("lat"), (F.rand(2) * 100 - 60).alias("lon"), F.rand(3).alias("a"), F.rand(4).alias("b")).checkpoint()
    odd = spark.createDataFrame([(-1, None, 1.0), (-2, 30.0, None), (-3, float("nan"), 0.0), (-4, 30.0, -10.0), (-5, 30.0, -11.25), (-6, 95.0, 400.0)], "id bigint, lat double, lon double")
    rows_in = pts.unionByName(odd, allowMissingColumns=True)
    layout.write_clustered(rows_in, str(tmp_path / "t"), F.col("lat"), F.col("lon"), group_bytes=40_000)
    all_files = spark.read.parquet(str(tmp_path / "t")).select(F.input_file_name()).distinct().count()
    for box in ((-11.25, 30.0, -10.0, 31.0), (-12.0, 29.0, -9.5, 30.0), (-180.0, -90.0, 180.0, 90.0)):
        got = layout.read_box(spark, str(tmp_path / "t"), box)
        want = rows_in.where(F.col("lon").between(box[0], box[2]) & F.col("lat").between(box[1], box[3]))
        assert got.columns == rows_in.columns and rows(got, "id") == rows(want, "id")
        got.collect()
        scan = got._jdf.queryExecution().executedPlan().collectLeaves().apply(0).metrics()
        files_read, rows_read = (scan.apply(m).value() for m in ("numFiles", "numOutputRows"))
        if box[0] > -180:
            assert 0 < files_read <= all_files / 10 and rows_read < n / 20
    assert spark.read.parquet(str(tmp_path / "t")).where("_square = -1").count() == 3


def scene_input(spark, n=3):
    """Blocks of small scenes, their calibration vectors and traces; scene S2 has an empty top."""
    from seaglint.operators import raster

    rows = [(f"S{s}", by, bx, y, [0 if s == 2 and by < 2 else 100 + x + y for x in range(16)]) for s in range(n) for by in range(4) for bx in range(2) for y in range(16)]
    lines = spark.createDataFrame(rows, "scene_id string, by int, bx int, y int, values array<int>")
    blocks = raster.pack_tiles(lines, ["scene_id", "by", "bx"]).withColumns({"height": F.lit(64), "width": F.lit(32)})
    sigma = spark.createDataFrame([(f"S{s}", line, [0.0, 40.0], [300.0, 320.0]) for s in range(n) for line in (0, 70)], "scene_id string, line int, pixels array<double>, values array<double>")
    traces = spark.createDataFrame([("S1", 7, [1.0, 2.0], "density")], "scene_id string, target_density_cell_index bigint, target_cell_bbox array<double>, protocol string")
    return blocks.select("scene_id").distinct(), blocks, sigma, traces, dict(size=16, stride=8, halo=2, block=16)


def test_scenes_are_committed_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    from seaglint.plans import flows
    from seaglint.sources.scene_store import SceneStore

    scenes, blocks, sigma, traces, grid = scene_input(spark)
    store = SceneStore(str(tmp_path / "store"))
    go = lambda some=scenes, code="D", **more: rows(flows.process_scenes_to(store, some, blocks, sigma.where("scene_id <> 'S0'"), None, traces, code, **more, **grid))
    commit = SceneStore.commit
    monkeypatch.setattr(SceneStore, "commit", lambda self, manifests, run: (_ for _ in ()).throw(OSError("died")))
    try:
        go()
    except OSError:
        pass
    assert store.processed(spark).count() == 0  # its tiles lie there, and nobody sees them
    monkeypatch.setattr(SceneStore, "commit", commit)
    first = go(scenes.where("scene_id <> 'S2'"))
    assert first == [("S0", "failed", 0), ("S1", "ok", 32)]
    assert store.read(spark, "tiles").count() == 32
    m = store.read(spark, "manifests").first()
    assert (m.total_tiles, m.valid_tiles, m.skipped_nodata, m.targeting_protocol, m.target_density_cell_index, m.tile_size, m.overlap, m.polarization) == (32, 32, 0, "density", 7, 16, 0.5, "vv")
    assert len(m.tiles) == 32 and m.tiles[1].pixel_bbox == [8, 0, 24, 16] and m.tiles[1].tile_id == "S1_D_tile0001" and m.processing_time_s > 0
    again = dict((s, (status, n)) for s, status, n in go())
    assert again["S0"] == ("failed", 0) and again["S1"] == ("skipped", 0) and again["S2"][0] == "ok" and 0 < again["S2"][1] < 32
    s2 = store.read(spark, "manifests").where("scene_id = 'S2'").first()
    assert s2.valid_tiles + s2.skipped_nodata == 32 and s2.targeting_protocol == "seasonal_criteria_fallback"
    assert store.read(spark, "tiles").where("scene_id = 'S2'").count() == s2.valid_tiles
    forced = go(scenes.where("scene_id = 'S1'"), force=True)
    assert forced == [("S1", "ok", 32)] and store.read(spark, "tiles").where("scene_id = 'S1'").count() == 32
    assert store.read(spark, "manifests").count() == 2


def test_full_events_count_dark_vessels(spark):
    from seaglint.operators import events

    tile = spark.createDataFrame([("t1", "s", 39001, 30.0, -10.0, 30.1, -9.9), ("t2", None, 39002, 30.0, -10.0, 30.1, -9.9)], "tile_id string, scene_id string, norad_id bigint, lat_min double, lon_min double, lat_max double, lon_max double").withColumn("timestamp", F.timestamp_seconds(F.lit(1_700_000_000)))
    boxes = spark.createDataFrame([("t1", i, i + 1, float(100 * i), 0.0, float(100 * i + 20), 20.0, 0.5) for i in range(4)], "tile_id string, box_id bigint, rank bigint, x1 double, y1 double, x2 double, y2 double, confidence double")
    near = events.box_centres(boxes, tile, 512).where("det_id in (1, 3)")
    positions = near.select("lat", "lon", (F.col("ts") + F.expr("interval 10 minutes")).alias("ts")).unionByName(near.select("lat", F.col("lon"), (F.col("ts") + F.expr("interval 2 hours")).alias("ts")))
    sets = spark.createDataFrame([(39001, "satnogs", "1 a", "2 a", 1_699_999_000)], "norad_id bigint, source string, tle1 string, tle2 string, s bigint").select("norad_id", "source", "tle1", "tle2", F.timestamp_seconds("s").alias("updated_at"))
    got = {e.tile_id: e for e in events.full_events(boxes, tile, positions, sets, "D").collect()}
    one, two = got["t1"], got["t2"]
    assert (one.vessel_count, one.dark_vessel_count, one.satellite_id, one.priority_level, len(one.detections)) == (4, 2, "39001", "MEDIUM", 4)
    assert (two.vessel_count, two.dark_vessel_count, two.satellite_id, two.scene_id) == (0, 0, None, "unknown")
    assert one.tile_bbox_latlon == [30.0, -10.0, 30.1, -9.9] and one.event_id != two.event_id and len(one.event_id) == 36
    again = {e.tile_id: e.event_id for e in events.full_events(boxes, tile, positions, sets, "D").collect()}
    assert again == {t: e.event_id for t, e in got.items()}


def landed(spark, folder, tables):
    """Stream that takes one of the tables a batch."""
    for table in tables:
        table.coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(tables[0].schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_dark_detections_of_a_stream(spark, tmp_path):
    from seaglint.streaming import jobs

    times = lambda ids: F.timestamp_seconds(ids * 600 + 1_700_000_000).alias("ts")
    det = spark.range(50).select(F.col("id").alias("det_id"), times(F.col("id")), F.lit(30.0).alias("lat"), (F.col("id") * 0.1).alias("lon"))
    pos = det.where("det_id % 2 = 0").select((F.col("ts") + F.expr("interval 5 minutes")).alias("ts"), "lat", "lon")
    late = det.where("det_id in (3, 4)").withColumn("det_id", F.col("det_id") + 100)
    late_pos = det.where("det_id = 5").select("ts", "lat", "lon")
    beat = lambda day: spark.range(1).select((-F.col("id") - 1).alias("det_id"), F.timestamp_seconds(F.lit(1_700_000_000 + day * 86400)).alias("ts"), F.lit(-80.0).alias("lat"), F.lit(0.0).alias("lon"))
    d = landed(spark, str(tmp_path / "det"), [det.where("det_id < 20"), det.where("det_id >= 20"), late, beat(2), beat(3)])
    p = landed(spark, str(tmp_path / "pos"), [*[pos.where(f"{w} lon < 2.05") for w in ("", "not")], late_pos, *[beat(k).drop("det_id") for k in (2, 3)]])
    out = jobs.run_dark_match(d, p, str(tmp_path / "run")).where("det_id >= 0")
    assert rows(out, "det_id", "n_near", "dark") == [(i, (i + 1) % 2, i % 2 == 1) for i in range(50)]


def test_dark_stream_frees_its_state(spark, tmp_path):
    from seaglint.streaming import jobs

    day = lambda k, n: spark.range(n).select(F.col("id").alias("det_id"), F.timestamp_seconds(F.col("id") + 1_700_000_000 + k * 86400).alias("ts"), F.lit(30.0).alias("lat"), (F.col("id") * 0.1).alias("lon"))
    days = [day(k, 300 if k < 3 else 1) for k in range(5)]
    d, p = (landed(spark, str(tmp_path / n), days) for n in ("det", "pos"))
    found = jobs.stream_dark_match(d, p.select("ts", "lat", "lon"))
    q = found.writeStream.outputMode("append").format("noop").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    held = [sum(s["numRowsTotal"] for s in x["stateOperators"]) for x in q.recentProgress if x["stateOperators"]]
    assert max(held) >= 300 and held[-1] < 50


def test_tle_state_goes_stale_and_comes_back(spark, tmp_path):
    from seaglint.streaming import jobs

    def reply(sat, hour, source="satnogs", good=True):
        return (sat, source, f"1 {hour}", f"2 {sat}" if good else "no set", 1_700_000_000 + hour * 3600)

    def table(replies):
        return spark.createDataFrame(replies, "norad_id bigint, source string, tle1 string, tle2 string, s bigint").select("norad_id", "source", "tle1", "tle2", F.timestamp_seconds("s").alias("updated_at"))

    batches = [
        [reply(1, 0), reply(2, 0), reply(2, 0, "celestrak"), reply(3, 1, good=False)],
        [reply(1, 23), reply(2, 10, good=False)],
        [reply(2, 30, "celestrak"), reply(3, 31)],
        [reply(1, 20), reply(9, 60)],  # older than the held set; moves the watermark
        [reply(9, 61)],
        [reply(9, 62)],
    ]
    changes = jobs.run_tle_state(landed(spark, str(tmp_path / "in"), [table(b) for b in batches]), str(tmp_path / "run"))
    hour = ((F.unix_micros("at") / 1e6 - 1_700_000_000) / 3600).cast("int")
    got = rows(changes.where("norad_id < 9").select("norad_id", hour.alias("h"), "status", "tle1"))
    assert got == [
        (1, 0, "fresh", "1 0"), (1, 23, "fresh", "1 23"), (1, 47, "stale", "1 23"),
        (2, 0, "fresh", "1 0"), (2, 24, "stale", "1 0"), (2, 30, "fresh", "1 30"), (2, 54, "stale", "1 30"),
        (3, 31, "fresh", "1 31"), (3, 55, "stale", "1 31"),
    ]
    assert rows(jobs.current_tle(changes), "norad_id", "status")[:3] == [(1, "stale"), (2, "stale"), (3, "stale")]


def test_event_rules(spark):
    from seaglint.operators import events

    base = dict(event_id="e", bbox=[0.0] * 4, conf=[0.5], n=1, dark=0, ms=1.0)
    cases = {"ok": {}, "empty": {"conf": []}, "edge": {"conf": [0.0, 1.0]}, "low": {"conf": [-0.1]}, "high": {"conf": [1.1]}, "count": {"n": -1}, "time": {"ms": -1.0}, "bbox": {"bbox": [1.0] * 3}}
    data = []
    for name, change in cases.items():
        c = {**base, **change}
        data.append((name, c["bbox"], [(0.1, 0.2, 0.8, 0.9, v) for v in c["conf"]], c["n"], c["dark"], c["ms"]))
    df = spark.createDataFrame(data, "event_id string, tile_bbox_latlon array<double>, detections array<struct<x1:double,y1:double,x2:double,y2:double,confidence:double>>, vessel_count int, dark_vessel_count int, processing_time_ms double")
    good, bad = events.validate_events(df)
    assert rows(good, "event_id") == [("edge",), ("empty",), ("ok",)]
    assert {r.event_id: r.reasons for r in bad.collect()} == {"low": ["confidence"], "high": ["confidence"], "count": ["vessel_count"], "time": ["processing_time_ms"], "bbox": ["bbox_length"]}


def test_stream_upsert_equals_batch(spark, tmp_path):
    from seaglint.streaming import jobs

    data = spark.range(300).select((F.col("id") % 70).cast("string").alias("event_id"), F.col("id").alias("arrival"))
    data.repartitionByRange(3, "arrival").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(data.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    store = KeyedStore(str(tmp_path / "store"), ["event_id"], "arrival")
    jobs.stream_upsert(stream, store, str(tmp_path / "state"))
    assert rows(store.current(spark), "event_id", "arrival") == rows(data.groupBy("event_id").agg(F.max("arrival")))


def test_paths_of_label_files_are_parsed_once_a_file(spark, tmp_path):
    put(tmp_path / "a" / "labels" / "t1.x.txt", "0 0.1 0.2 0.3 0.4\r\n1 0.1 0.2 0.3 0.4\n")
    put(tmp_path / "a" / "labels" / ".t2.txt", "0 0.1 0.2 0.3 0.4")
    got = files.scan_label_files(spark, str(tmp_path))
    assert rows(got, "tile_id", "line_no") == [("t1.x", 0), ("t1.x", 1)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("regexp_extract")
    paths = ["s/t1.txt", "s.d/t1", "t.a.b", "/.txt", "s/", "", "s/.a.b", "s/a."]
    want = ["t1", "t1", "t.a", ".txt", "", "", ".a", "a"]
    named = spark.createDataFrame([(p,) for p in paths], "p string").select("p", files.stem(F.col("p")).alias("stem"))
    assert rows(named, "p", "stem") == sorted(zip(paths, want))


def test_xml_files_are_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "BOXES_PER_FILE", 10, raising=False)
    box = spark.range(0, 35, 1, 1).select(F.lit("s").alias("scene_id"), F.lit("t.npy").alias("image"), F.col("id").alias("z_order"))
    out = tmp_path / "cvat"
    sinks.export_cvat(box, str(out))
    sizes = [f.read_text().count("<box>") for f in out.rglob("*.xml")] or [f.read_text().count("<box>") for f in out.rglob("part-*")]
    assert sum(sizes) == 35 and max(sizes) == 10
    assert spark.read.format("xml").option("rowTag", "box").load(str(out)).count() == 35


def test_xml_export_is_small_on_disk(spark, tmp_path):
    from seaglint.plans import registry

    registry.load()
    box = spark.range(20_000).select(F.col("id").alias("l_orderkey"), F.lit(1).alias("l_linenumber"), (F.col("id") * 7 % 2000).alias("l_partkey"), (F.col("id") % 100).alias("l_suppkey"), (F.col("id") % 50).cast("double").alias("l_quantity"), (F.col("id") / 7).alias("l_extendedprice"))
    box.write.parquet(f"{tmp_path}/lineitem.parquet")
    made = registry.QUERIES["export_cvat_xml"](spark, str(tmp_path))
    assert made.count() == 20_000
    held = [f.removeprefix("file:") for f in made.inputFiles()]
    assert held and sum(map(os.path.getsize, held)) < 20_000 * 60  # about 250 bytes a box as text
