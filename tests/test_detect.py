import numpy as np
import pandas as pd
from conftest import rows
from pyspark.sql import functions as F

from seaglint.operators import detect, evaluate


def corner_frame(spark, boxes, scores):
    data = [("t", i, float(s), *map(float, b)) for i, (b, s) in enumerate(zip(boxes, scores, strict=True))]
    return spark.createDataFrame(data, "tile_id string, box_id bigint, score double, x1 double, y1 double, x2 double, y2 double")


def test_nms_fixtures(spark):
    near = [(0, 0, 10, 10), (1, 1, 11, 11), (50, 50, 60, 60)]
    assert [r[0] for r in rows(detect.nms_detector(corner_frame(spark, near, (0.9, 0.8, 0.7))), "box_id")] == [0, 2]
    apart = [(0, 0, 10, 10), (20, 20, 30, 30), (50, 50, 60, 60)]
    assert detect.nms_detector(corner_frame(spark, apart, (0.9, 0.8, 0.7))).count() == 3
    assert detect.nms_detector(corner_frame(spark, apart, (0.9, 0.8, 0.7)).where("false")).count() == 0
    nested = corner_frame(spark, [(0, 0, 10, 10), (2, 2, 8, 8)], (0.9, 0.8))
    assert detect.nms_detector(nested, limit=0.1).count() == 1
    assert detect.nms_detector(nested, limit=0.9).count() == 2


def random_boxes(spark, n, tiles, seed):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame(
        {
            "tile_id": ["hot" if i % 3 == 0 else f"t{i % tiles}" for i in range(n)], "box_id": range(n),
            "score": rng.integers(0, 50, n) / 50, "cx": rng.uniform(0, 200, n), "cy": rng.uniform(0, 200, n),
            "w": rng.uniform(5, 60, n), "h": rng.uniform(5, 60, n),
        }
    )
    return pdf, spark.createDataFrame(pdf)


def brute_nms(pdf, limit):
    kept = []
    for _, g in pdf.groupby("tile_id"):
        chosen = []
        for r in g.sort_values(["score", "box_id"], ascending=[False, True]).itertuples():
            if all(iou(r, k) < limit for k in chosen):
                chosen.append(r)
        kept += [(k.box_id, i + 1) for i, k in enumerate(chosen)]
    return sorted(kept)


def iou(a, b):
    iw = max(0, min(a.cx + a.w / 2, b.cx + b.w / 2) - max(a.cx - a.w / 2, b.cx - b.w / 2))
    ih = max(0, min(a.cy + a.h / 2, b.cy + b.h / 2) - max(a.cy - a.h / 2, b.cy - b.h / 2))
    return iw * ih / (a.w * a.h + b.w * b.h - iw * ih)


def test_suppression_is_the_same_for_any_block_and_batch(spark, monkeypatch):
    pdf, df = random_boxes(spark, 900, 7, 1)
    want = brute_nms(pdf, 0.5)
    assert rows(detect.nms_benchmark(df), "box_id", "rank") == want
    odd = spark.createDataFrame([("hot", 2000, None, 1.0, 1.0, 5.0, 5.0), ("hot", 2001, float("nan"), 1.0, 1.0, 5.0, 5.0), (None, 2002, 0.9, 1.0, 1.0, 5.0, 5.0), ("hot", 2003, 0.9, float("nan"), 1.0, 5.0, 5.0), ("hot", None, 0.9, 1.0, 1.0, 5.0, 5.0)], "tile_id string, box_id bigint, score double, cx double, cy double, w double, h double")
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        assert rows(detect.nms_benchmark(df.unionByName(odd)), "box_id", "rank") == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    monkeypatch.setattr(detect, "BLOCK", 5)
    monkeypatch.setattr(detect, "KEPT_BLOCK", 7)
    fold = detect._Fold(0.5, True)
    hot = pdf[pdf.tile_id == "hot"].sort_values(["score", "box_id"], ascending=[False, True])
    corner = np.column_stack([hot.cx - hot.w / 2, hot.cy - hot.h / 2, hot.cx + hot.w / 2, hot.cy + hot.h / 2])
    own = np.ones(len(hot), dtype=bool)
    got = np.concatenate([fold.take(corner[:100], own[:100]), fold.take(corner[100:], own[100:])])
    assert sorted(hot.box_id.to_numpy()[got == detect.KEPT].tolist()) == sorted(i for i, _ in want if i in set(hot.box_id))


def rounds_of(monkeypatch):
    """A list that gets an entry for each round of suppression."""
    seen, one = [], detect._suppression_round
    monkeypatch.setattr(detect, "_suppression_round", lambda *a: seen.append(1) or one(*a))
    return seen


def test_suppression_over_many_blocks_and_sizes(spark, monkeypatch):
    monkeypatch.setattr(detect, "CLASS_BASE", 1.0)
    monkeypatch.setattr(detect, "BLOCK_CELLS", 1)
    seen = rounds_of(monkeypatch)
    pdf, _ = random_boxes(spark, 700, 2, 9)
    pdf.loc[pdf.index % 5 == 0, ["w", "h"]] *= 40.0
    pdf.loc[pdf.index % 7 == 0, ["w", "h"]] *= 0.01
    pdf.loc[pdf.index % 11 == 0, "cx"] -= 300.0
    df = spark.createDataFrame(pdf)
    twice = df.unionByName(df.where("box_id % 10 = 0"))
    assert rows(detect.nms_benchmark(twice), "box_id", "rank") == brute_nms(pdf, 0.5)
    assert 2 <= len(seen) <= 8


def test_a_chain_over_blocks_ends(spark, monkeypatch):
    seen = rounds_of(monkeypatch)
    n = 400  # each box overlaps the next one by 0.6, scores fall along the line
    line = [("t", i, 1.0 - i / n, 25.0 * i, 10.0, 100.0, 100.0) for i in range(n)]
    df = spark.createDataFrame(line, "tile_id string, box_id bigint, score double, cx double, cy double, w double, h double")
    assert rows(detect.nms_benchmark(df), "box_id") == [(i,) for i in range(0, n, 2)]
    assert len(seen) <= 25.0 * n / (16**2 * 8) + 3


def test_one_large_tile_is_spread(spark, monkeypatch):
    seen = rounds_of(monkeypatch)
    n = 150_000
    big = spark.range(n).select(F.lit("t").alias("tile_id"), F.col("id").alias("box_id"), F.rand(1).alias("score"), *[(F.rand(s) * 30_000).alias(c) for s, c in ((2, "cx"), (3, "cy"))], *[(F.rand(s) * 40 + 30).alias(c) for s, c in ((4, "w"), (5, "h"))]).checkpoint()
    got = detect.nms_benchmark(big).cache()
    assert len(seen) <= 6
    assert got.agg(F.max("rank"), F.count("*"), F.countDistinct("rank")).first()[:] == (got.count(),) * 3
    placed = detect._own_place(big, detect.CLASS_BASE, detect.BLOCK_CELLS).groupBy("_size", "_gx", "_gy").count()
    assert placed.agg(F.max("count")).first()[0] < n / 50
    pairs = detect.iou_pairs(got, got, threshold=0.5).where("left_id <> right_id")
    assert pairs.isEmpty()
    lost = big.join(got, "box_id", "left_anti")
    reason = detect.iou_pairs(lost, got.select("tile_id", F.struct("score", "box_id").alias("box_id"), "cx", "cy", "w", "h"), keep=("score",)).where("right_id.score >= score")
    assert reason.select("left_id").distinct().count() == lost.count()


def test_no_job_starts_when_a_plan_is_built(spark):
    from seaglint.operators import ais, asof, spatial

    _, df = random_boxes(spark, 60, 3, 1)
    places = df.select("box_id", (F.col("cx") / 100).alias("lat"), (F.col("cy") / 100).alias("lon"), F.timestamp_seconds("box_id").alias("ts"), F.lit("k").alias("k"))
    frames = places.select(F.col("box_id").alias("bid"), F.col("lat").alias("lat_min"), (F.col("lat") + 1).alias("lat_max"), F.col("lon").alias("lon_min"), (F.col("lon") + 1).alias("lon_max"))
    other = places.select("k", F.col("ts").alias("u"), F.col("box_id").cast("string").alias("v"))
    group = "plans-only"
    spark.sparkContext.setJobGroup(group, group)
    spatial.points_in_boxes(places, frames)
    ais.dark_detections(places.withColumnRenamed("box_id", "det_id"), places)
    asof.asof_latest(places, other, key="k", left_time="ts", right_time="u", right_cols=["v"], tie="v")
    pairs = detect.iou_pairs(df, df)
    assert pairs.columns and not spark.sparkContext.statusTracker().getJobIdsForGroup(group)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_pairs_and_matching_against_brute_force(spark):
    preds, sp = random_boxes(spark, 400, 5, 2)
    labels, sl = random_boxes(spark, 400, 5, 4)
    labels[["cx", "cy"]] = preds[["cx", "cy"]] + 2.0
    labels[["w", "h"]] = preds[["w", "h"]] * 0.9
    labels["tile_id"] = preds["tile_id"]
    sl = spark.createDataFrame(labels)
    want = sorted((p.box_id, g.box_id) for p in preds.itertuples() for g in labels.itertuples() if p.tile_id == g.tile_id and iou(p, g) >= 0.5)
    lost = sp.withColumn("tile_id", F.lit(None).cast("string")).unionByName(sp.withColumn("w", F.lit(float("nan"))))
    assert rows(detect.iou_pairs(sp.unionByName(lost), sl.unionByName(lost)), "left_id", "right_id") == want
    ranked = detect.rank_by_score(sp)
    for best in (False, True):
        pairs = []
        for tile, g in preds.groupby("tile_id"):
            used = set()
            for p in g.sort_values(["score", "box_id"], ascending=[False, True]).itertuples():
                free = [(iou(p, q), -q.box_id) for q in labels[labels.tile_id == tile].itertuples() if q.box_id not in used and iou(p, q) >= 0.5]
                if free:
                    pick = -(max(free)[1] if best else max(f[1] for f in free))
                    used.add(pick)
                    pairs.append((p.box_id, pick))
        assert rows(detect.greedy_match(ranked, sl, best=best), "pred_id", "gt_id") == sorted(pairs)


def test_decode_both_shapes(spark):
    df = spark.createDataFrame(
        [(1, [[1.0, 2.0], [1.0, 2.0], [3.0, 3.0], [4.0, 4.0], [0.25, 0.2]]), (2, [[1.0, 1.0, 2.0, 2.0, 0.5, 0.4, 0.6], [1.0, 1.0, 2.0, 2.0, 0.1, 0.9, 0.9]])],
        "id int, output array<array<double>>",
    )
    assert rows(detect.decode_predictions(df), "id", "idx", "score") == [(1, 0, 0.25), (2, 0, 0.3)]


def test_metrics_are_zero_without_tiles(spark):
    empty = spark.createDataFrame([], "tile_id string, n_pred bigint, n_gt bigint, tp bigint")
    got = evaluate.detection_metrics(empty).first()
    assert (got.precision, got.recall, got.tp) == (0.0, 0.0, 0)
    one = spark.createDataFrame([("a", 4, 2, 1), ("b", 0, 2, 0)], empty.schema)
    got = evaluate.detection_metrics(one).first()
    assert (got.precision, got.recall, got.map50_as_precision) == (0.25, 0.25, 0.25)
    nb = evaluate.detection_metrics_labelled(one.where("false")).first()
    assert nb.precision is None


def test_model_tensor_shape_and_range():
    t = detect.model_tensor(np.arange(64 * 64).reshape(64, 64), 100)
    assert t.shape == (1, 3, 100, 100) and t.min() == 0.0 and abs(t.max() - 1.0) < 1e-5


def test_quantisation_and_verdict(spark):
    df = spark.createDataFrame([(0.8, 0.796), (0.0, 0.1), (0.8, 0.7)], "fp32 double, int8 double")
    assert [r.passed for r in evaluate.quantisation_loss(df).collect()] == [True, True, False]
    v = spark.createDataFrame([(0.71, 0.5), (0.6, 0.5), (0.4, 0.5), (0.1, 0.0)], "precision double, recall double")
    assert [r.verdict for r in evaluate.f1_and_verdict(v, "precision").collect()] == ["GO", "MARGINAL", "BELOW", "FAILED"]


def test_large_event(spark):
    from seaglint.operators import events

    boxes = spark.range(10000).select(F.lit("t").alias("tile_id"), F.col("id").alias("rank"), *[F.col("id").cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")], F.lit(0.5).alias("confidence"))
    tiles = spark.createDataFrame([("t", None), ("u", "s")], "tile_id string, scene_id string")
    got = {r.tile_id: r for r in events.events_from_boxes(boxes, tiles, "D").collect()}
    assert got["t"].vessel_count == 10000 and len(got["t"].detections) == 10000 and got["t"].priority_level == "CRITICAL"
    assert got["u"].vessel_count == 0 and got["u"].detections == [] and got["t"].scene_id == "unknown"


def test_matching_along_a_chain_and_in_a_crowd(spark):
    schema = "tile_id string, left_id bigint, rank bigint, right_id bigint, iou double"
    # Each prediction wants the label that the one before it takes: one more is decided in each round.
    chain = [("t", i, i, j, 0.9 if j == i else 0.8) for i in range(5) for j in (i - 1, i) if j >= 0]
    found = detect.match_pairs(spark.createDataFrame(chain, schema), ["tile_id"], best=False)
    assert rows(found, "pred_id", "gt_id") == [(i, i) for i in range(5)]
    crowd = spark.createDataFrame([("t", i, i, j, 0.5 + (i * j % 7) / 20) for i in range(20) for j in range(8)], schema)
    for best in (False, True):
        used, want = set(), []
        for i in range(20):
            free = [((0.5 + (i * j % 7) / 20) if best else 0, -j) for j in range(8) if j not in used]
            if free:
                used.add(-max(free)[1])
                want.append((i, -max(free)[1]))
        assert rows(detect.match_pairs(crowd, ["tile_id"], best=best), "pred_id", "gt_id") == want
    assert detect.match_pairs(crowd.where("false"), ["tile_id"], best=True).count() == 0


def test_listed_sides_are_not_broadcast(spark):
    from seaglint.operators import spatial

    _, df = random_boxes(spark, 60, 3, 1)
    places = df.select("box_id", (F.col("cx") / 100).alias("lat"), (F.col("cy") / 100).alias("lon"))
    frames = places.select(F.col("box_id").alias("bid"), F.col("lat").alias("lat_min"), (F.col("lat") + 1).alias("lat_max"), F.col("lon").alias("lon_min"), (F.col("lon") + 1).alias("lon_max"))
    for made in (detect.iou_pairs(df, df), spatial.points_in_boxes(places, frames)):
        made.collect()
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "Generate" in plan and "Broadcast" not in plan


def test_matching_tile_by_tile_equals_the_rounds(spark, monkeypatch):
    _, sp = random_boxes(spark, 500, 6, 3)
    some = sp.withColumn("code", F.substring(F.lit("AB"), (F.col("box_id") % 2 + 1).cast("int"), F.lit(1)))
    moved = sp.select("tile_id", (F.col("box_id") + 1000).alias("box_id"), (F.col("cx") + 1.5).alias("cx"), "cy", "w", "h")
    labels = moved.unionByName(moved.where("box_id % 3 = 0").withColumn("cx", F.col("cx") + 1))  # some ids twice
    ranked = detect.rank_by_score(some)
    for best in (False, True):
        want = rows(detect.match_pairs(detect.iou_pairs(ranked, labels, keep=("rank", "code")), ["code", "tile_id"], best=best))
        assert len({r[2] for r in want}) > 50
        for crowded, batch in ((2048, 10_000), (2048, 7), (180, 50), (1, 50)):
            monkeypatch.setattr(detect, "CROWDED", crowded)
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
            assert rows(detect.greedy_match(ranked, labels, best=best, per=("code",))) == want
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    # Tiles that fit a task are neither listed under places nor matched in rounds.
    monkeypatch.setattr(detect, "CROWDED", 2048)
    monkeypatch.setattr(detect, "match_pairs", None)
    plan = detect.greedy_match(ranked, labels, best=False)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1 + plan.count("ENSURE")


def test_saved_rows_take_less_than_a_checkpoint(spark):
    import os

    from seaglint.session import ensure_checkpoint_dir, saved

    ensure_checkpoint_dir(spark)
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    size = lambda: sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names)
    df = spark.range(60_000).select(F.format_string("T%012d", F.floor(F.col("id") / 100)).alias("tile_id"), F.col("id").alias("_nth"), (F.col("id") % 640).cast("double").alias("_b0"))
    sizes = [size()]
    for keep in (saved, lambda d: d.checkpoint()):
        assert keep(df).agg(F.count("*"), F.sum("_nth")).first()[:] == df.agg(F.count("*"), F.sum("_nth")).first()[:]
        sizes.append(size())
    assert sizes[1] - sizes[0] < (sizes[2] - sizes[1]) / 2, sizes


def test_partners_are_listed_under_few_places(spark, monkeypatch):
    from seaglint.operators import spatial

    seen = []

    def counted(one, listed, keys):
        seen.append((one.count(), listed.count()))
        return spatial.join_listed(one, listed, keys)

    monkeypatch.setattr(detect, "join_listed", counted)
    draw = lambda seed, low, high: F.rand(seed) * (high - low) + low
    sides = {"cx": (0, 640), "cy": (0, 640), "w": (20, 80), "h": (12, 52)}
    df = spark.range(0, 2000, 1, 1).select(F.lit("t").alias("tile_id"), F.col("id").alias("box_id"), *[draw(i, *b).alias(c) for i, (c, b) in enumerate(sides.items())])
    assert detect.iou_pairs(df, df).where("left_id = right_id").count() == 2000
    assert seen[0][0] == 2000 and seen[0][1] < 2 * seen[0][0]
