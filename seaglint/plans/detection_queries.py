"""Suppression, matching, metrics, events from detections."""

from pyspark.sql import functions as F

from seaglint import config as C
from seaglint.functions import boxes as B
from seaglint.operators import detect, evaluate, events
from seaglint.plans import flows
from seaglint.session import saved
from seaglint.plans.registry import query, r, rounded
from seaglint.plans.scalar_queries import DIST_SQL, ZONE_SQL

CONFIDENT = "select * from v_boxes where score >= 0.25e0"


def iou_sql(a, b, eps):
    """Overlap of two DuckDB structs with corners x1..y2."""
    i = f"(greatest(0e0, least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1)) * greatest(0e0, least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1)))"
    u = f"(({a}.x2 - {a}.x1) * ({a}.y2 - {a}.y1) + ({b}.x2 - {b}.x1) * ({b}.y2 - {b}.y1) - {i})"
    return f"({i} / ({u} + 1e-6))" if eps else f"({i} / {u})"


def nms_sql(source, eps, drop):
    """Greedy suppression as a fold over each tile's score-ordered list of boxes."""
    x = "{'x1': cx - w / 2, 'y1': cy - h / 2, 'x2': cx + w / 2, 'y2': cy + h / 2, 'id': box_id, 'score': score}"
    hit = f"{iou_sql('k', 'd[1]', eps)} {drop}"
    return f"""select tile_id, unnest(range(1, len(kept) + 1)) as rank, unnest(kept) as b from (
      select tile_id, list_reduce(list([{x}] order by score desc, box_id), lambda acc, d: case when len(list_filter(acc, lambda k: {hit})) > 0 then acc else list_concat(acc, d) end) as kept
      from ({source}) q group by tile_id) z"""


NMS_DET = nms_sql(CONFIDENT, True, "> 0.45e0")
NMS_BENCH = nms_sql("select * from v_boxes where score > 0.25e0", False, ">= 0.5e0")


def _corner_boxes(t):
    c = B.corners(*[F.col(n) for n in ("cx", "cy", "w", "h")])
    df = t.v_boxes.where(F.col("score") >= C.DETECTOR_CONFIDENCE)
    return df.select("tile_id", "box_id", "score", *[v.alias(n) for v, n in zip(c, detect.CORNERS, strict=True)])


def _bench(t):
    return detect.nms_benchmark(t.v_boxes.where(F.col("score") > C.BENCHMARK_CONFIDENCE))


@query("nms_detector", f"select tile_id, b.id as box_id, rank from ({NMS_DET}) n")
def nms_detector(t):
    return detect.nms_detector(_corner_boxes(t)).select("tile_id", "box_id", "rank")


@query("nms_benchmark", f"select tile_id, b.id as box_id, rank from ({NMS_BENCH}) n")
def nms_benchmark(t):
    return _bench(t).select("tile_id", "box_id", "rank")


TRUTH = "select tile_id, box_id, {'x1': cx - w / 2, 'y1': cy - h / 2, 'x2': cx + w / 2, 'y2': cy + h / 2} as b from v_truth"


@query("iou_pairs", f"select a.tile_id, a.box_id as left_id, g.box_id as right_id from (select tile_id, box_id, {{'x1': cx - w / 2, 'y1': cy - h / 2, 'x2': cx + w / 2, 'y2': cy + h / 2}} as b from v_boxes) a join ({TRUTH}) g on a.tile_id = g.tile_id and {iou_sql('a.b', 'g.b', False)} >= 0.5e0")
def iou_pairs(t):
    return detect.iou_pairs(t.v_boxes, t.v_truth).select("tile_id", "left_id", "right_id")


def match_sql(best):
    """Greedy matching as a fold over the overlapping pairs in order of choice."""
    order = "rank, iou desc, gt" if best else "rank, gt"
    return f"""select tile_id, unnest(m).p as pred_id, unnest(m).g as gt_id from (
      select tile_id, list_reduce(list([{{'p': pred, 'g': gt}}] order by {order}), lambda acc, d: case when len(list_filter(acc, lambda k: k.p = d[1].p or k.g = d[1].g)) > 0 then acc else list_concat(acc, d) end) as m
      from (select n.tile_id, n.rank, n.b.id as pred, g.box_id as gt, {iou_sql('n.b', 'g.b', False)} as iou from ({NMS_BENCH}) n join ({TRUTH}) g on n.tile_id = g.tile_id) e where iou >= 0.5e0 group by tile_id) z"""


def _match(t, best):
    return detect.greedy_match(_bench(t), t.v_truth, best=best)


def _scores(t, best):
    kept, labels = saved(_bench(t)), t.v_truth
    return evaluate.tile_scores(kept, labels, detect.greedy_match(kept, labels, best=best))


@query("greedy_match_first", match_sql(False))
def greedy_match_first(t):
    return _match(t, False).select("tile_id", "pred_id", "gt_id")


@query("greedy_match_best", match_sql(True))
def greedy_match_best(t):
    return _match(t, True).select("tile_id", "pred_id", "gt_id")


def scores_sql(best, truth="v_truth"):
    return f"""select coalesce(p.tile_id, g.tile_id) as tile_id, coalesce(n_pred, 0) as n_pred, coalesce(n_gt, 0) as n_gt, coalesce(tp, 0) as tp from (select tile_id, count(*) as n_pred from ({NMS_BENCH}) n group by tile_id) p
    full join (select tile_id, count(*) as n_gt from {truth} group by tile_id) g on g.tile_id = p.tile_id left join (select tile_id, count(*) as tp from ({match_sql(best)}) m group by tile_id) m on m.tile_id = coalesce(p.tile_id, g.tile_id)"""


@query("gt_pred_outer", scores_sql(False))
def gt_pred_outer(t):
    return _scores(t, False)


@query("tile_id_union", f"select tile_id from (select tile_id from ({CONFIDENT}) a union select tile_id from v_truth) z")
def tile_id_union(t):
    a = t.v_boxes.where(F.col("score") >= C.DETECTOR_CONFIDENCE)
    return a.select("tile_id").unionByName(t.v_truth.select("tile_id")).distinct()


_R4 = "floor({} * 1e4 + 0.5e0) / 1e4"


@query(
    "detection_metrics",
    f"""select tp, fp, fn, {_R4.format('tp * 1e0 / (tp + fp)')} as precision, {_R4.format('tp * 1e0 / (tp + fn)')} as recall, {_R4.format('tp * 1e0 / (tp + fp)')} as map50_as_precision
    from (select cast(sum(tp) as bigint) as tp, cast(sum(n_pred - tp) as bigint) as fp, cast(sum(n_gt - tp) as bigint) as fn from ({scores_sql(False)}) s) z""",
)
def detection_metrics(t):
    return evaluate.detection_metrics(_scores(t, False))


@query(
    "detection_metrics_nb",
    f"""select tiles_eval, gt_boxes, tp, fp, fn, {r('tp * 1e0 / (tp + fp)')} as precision, {r('tp * 1e0 / (tp + fn)')} as recall from (select count(*) as tiles_eval, cast(sum(n_gt) as bigint) as gt_boxes, cast(sum(tp) as bigint) as tp, cast(sum(n_pred - tp) as bigint) as fp, cast(sum(n_gt - tp) as bigint) as fn from ({scores_sql(True)}) s) z""",
)
def detection_metrics_nb(t):
    out = evaluate.detection_metrics_labelled(_scores(t, True))
    return out.withColumn("precision", rounded(F.col("precision"))).withColumn("recall", rounded(F.col("recall")))


@query("annotated_tile_restriction", "select box_id from v_boxes where tile_id in (select tile_id from v_truth where h >= 45)")
def annotated_tile_restriction(t):
    labelled = t.v_truth.where("h >= 45").select("tile_id")
    return t.v_boxes.join(labelled, "tile_id", "left_semi").select("box_id")


_PXY = "(lon - lon_min) / greatest(lon_max - lon_min, 1e-9) * 512e0 as px, (lat_max - lat) / greatest(lat_max - lat_min, 1e-9) * 512e0 as py"


@query(
    "build_ground_truth",
    f"""select pos_id, tile_id, {r('least(1e0, greatest(0e0, px / 512e0))')} as cx, {r('least(1e0, greatest(0e0, py / 512e0))')} as cy from (select pos_id, tile_id, {_PXY} from v_ais p join v_tiles t on lat >= lat_min - 0.01e0 and lat <= lat_max + 0.01e0 and lon >= lon_min - 0.01e0 and lon <= lon_max + 0.01e0) z
    where px between -5 and 517 and py between -5 and 517""",
)
def build_ground_truth(t):
    from seaglint.operators.spatial import pairs_by_blocks

    places = t.v_tiles.select("tile_id", "lat_min", "lon_min", "lat_max", "lon_max")
    near = pairs_by_blocks(t.v_ais.select("pos_id", "lat", "lon"), places, cell=0.4, margin=0.01)
    return detect.ground_truth(near).select("pos_id", "tile_id", rounded(F.col("cx")).alias("cx"), rounded(F.col("cy")).alias("cy"))


TENSORS = """select vec_id, case when vec_id % 2 = 0
   then array({cols}) else array({rows}) end as output from embeddings"""


def _tensor_sql():
    def at(i):
        return f"cast(embedding[{i}] as double)"

    cols = ", ".join("array(" + ", ".join(at(row * 12 + k) for k in range(12)) + ")" for row in range(5))
    rows = ", ".join("array(" + ", ".join(at(k * 7 + j) for j in range(7)) + ")" for k in range(9))
    return TENSORS.format(cols=cols, rows=rows)


@query(
    "decode_predictions",
    f"""select vec_id, idx, {r('cx')} as cx, {r('h')} as h, {r('score')} as score from (
      select vec_id, i as idx, cast(embedding[i + 1] as double) as cx, cast(embedding[36 + i + 1] as double) as h, cast(embedding[48 + i + 1] as double) as score, cast(embedding[48 + i + 1] as double) as conf from embeddings, range(0, 12) g(i) where vec_id % 2 = 0
      union all select vec_id, i, cast(embedding[i * 7 + 1] as double), cast(embedding[i * 7 + 4] as double), case when greatest(embedding[i * 7 + 6], embedding[i * 7 + 7]) > 0 then cast(embedding[i * 7 + 5] as double) * cast(greatest(embedding[i * 7 + 6], embedding[i * 7 + 7]) as double) else cast(embedding[i * 7 + 5] as double) end, cast(embedding[i * 7 + 5] as double) from embeddings, range(0, 9) g(i) where vec_id % 2 <> 0) z where conf >= 0.05e0""",
)
def decode_predictions(t):
    out = detect.decode_predictions(t.sql(_tensor_sql()), 0.05)
    return out.select("vec_id", F.col("idx").cast("bigint").alias("idx"), *[rounded(F.col(c)).alias(c) for c in ("cx", "h", "score")])


ALL_TILES = "select distinct tile_id from v_boxes"


@query(
    "events_from_detections",
    f"""select t.tile_id, coalesce(n, 0) as vessel_count, case when coalesce(n, 0) >= 10 then 'CRITICAL' when n >= 5 then 'HIGH' when n >= 2 then 'MEDIUM' else 'LOW' end as priority_level, coalesce(first, '?') as best_score, 'unknown' as scene_id
    from ({ALL_TILES}) t left join (select tile_id, count(*) as n, min(case when rank = 1 then cast(cast(floor(b.score * 1000 + 0.5) as bigint) as varchar) end) as first from ({NMS_DET}) k group by tile_id) a on a.tile_id = t.tile_id""",
)
def events_from_detections(t):
    kept = detect.nms_detector(_corner_boxes(t)).withColumnRenamed("score", "confidence")
    tiles = t.sql(ALL_TILES).withColumn("scene_id", F.lit(None).cast("string"))
    out = events.events_from_boxes(kept, tiles, "D")
    best = F.floor(F.get("detections", F.lit(0))["confidence"] * 1000 + 0.5).cast("bigint").cast("string")
    return out.select(
        "tile_id", F.col("vessel_count").cast("bigint").alias("vessel_count"), "priority_level",
        F.coalesce(best, F.lit("?")).alias("best_score"), "scene_id",
    )


#: Tiles an hour apart; a position at every second box five minutes after its tile.
SEEN_TILES = f"""select tile_id, tile_no, case when tile_no % 9 = 0 then null else concat('scene', cast(tile_no % 7 as string)) end as scene_id, timestamp '2024-01-02 00:00:00' + tile_no * interval '1' hour as timestamp, 39000 + tile_no % 20 as norad_id,
  25e0 + (tile_no * 7919 % 13000) / 1000e0 as lat_min, -24e0 + (tile_no * 104729 % 28000) / 1000e0 as lon_min, 25e0 + (tile_no * 7919 % 13000) / 1000e0 + 0.2e0 as lat_max, -24e0 + (tile_no * 104729 % 28000) / 1000e0 + 0.2e0 as lon_max from (select distinct tile_id, tile_no from v_boxes) q"""
NEAR_SHIPS = f"select t.tile_id, t.timestamp + interval '5' minute as ts, t.lat_max - (b.cy / 640e0) * (t.lat_max - t.lat_min) as lat, t.lon_min + (b.cx / 640e0) * (t.lon_max - t.lon_min) as lon from v_boxes b join ({SEEN_TILES}) t on t.tile_id = b.tile_id where cast(floor(b.qty) as bigint) % 8 = 0"
_METRES = "2 * 6371000e0 * asin(least(1e0, sqrt(power(sin(radians(p.lat - d.lat) / 2), 2) + cos(radians(d.lat)) * cos(radians(p.lat)) * power(sin(radians(p.lon - d.lon) / 2), 2))))"


@query(
    "detection_events_full",
    f"""with tiles as ({SEEN_TILES}), kept as ({NMS_DET}),
    det as (select t.tile_id, k.b.id as det_id, t.lat_max - (k.b.y1 + k.b.y2) / (2 * 640e0) * (t.lat_max - t.lat_min) as lat, t.lon_min + (k.b.x1 + k.b.x2) / (2 * 640e0) * (t.lon_max - t.lon_min) as lon from kept k join tiles t on t.tile_id = k.tile_id),
    lit as (select distinct d.tile_id, d.det_id from det d join ({NEAR_SHIPS}) p on p.tile_id = d.tile_id and {_METRES} <= 500e0),
    n as (select d.tile_id, count(*) as n, count(*) filter (where l.det_id is null) as dark from det d left join lit l on l.tile_id = d.tile_id and l.det_id = d.det_id group by d.tile_id),
    sat as (select e.tile_id, t.tle1 from tiles e asof left join v_tle t on e.norad_id = t.norad_id and e.timestamp >= t.updated_at)
    select concat(substr(h, 1, 8), '-', substr(h, 9, 4), '-', substr(h, 13, 4), '-', substr(h, 17, 4), '-', substr(h, 21, 12)) as event_id, coalesce(scene_id, 'unknown') as scene_id, strftime(timestamp, '%Y-%m-%d %H') as timestamp, tile_id, {r('lat_min + lon_max')} as box, vessel_count, dark_vessel_count,
      case when vessel_count >= 10 then 'CRITICAL' when vessel_count >= 5 then 'HIGH' when vessel_count >= 2 then 'MEDIUM' else 'LOW' end as priority_level, {ZONE_SQL} as zone, satellite_id
    from (select t.*, md5(concat(t.tile_id, '|D|', epoch_us(timestamp))) as h, coalesce(n.n, 0) as vessel_count, coalesce(n.dark, 0) as dark_vessel_count, case when s.tle1 is not null then cast(norad_id as varchar) else '-' end as satellite_id, {DIST_SQL.format(lat='((lat_min + lat_max) / 2e0)', lon='((lon_min + lon_max) / 2e0)')} as d
      from tiles t left join n on n.tile_id = t.tile_id left join sat s on s.tile_id = t.tile_id) z""",
)
def detection_events_full(t):
    """Kept boxes of all tiles, matched with positions, with zone, satellite and a repeatable id."""
    kept = detect.nms_detector(_corner_boxes(t)).withColumnRenamed("score", "confidence")
    seen = saved(t.sql(SEEN_TILES))  # read three times
    out = events.full_events(kept, seen, t.sql(NEAR_SHIPS), t.v_tle, "D", size=640)
    return out.select(
        "event_id", "scene_id", F.date_format("timestamp", "yyyy-MM-dd HH").alias("timestamp"), "tile_id", rounded(F.get("tile_bbox_latlon", F.lit(0)) + F.get("tile_bbox_latlon", F.lit(3))).alias("box"),
        F.col("vessel_count").cast("bigint").alias("vessel_count"), F.col("dark_vessel_count").cast("bigint").alias("dark_vessel_count"), "priority_level", "zone", F.coalesce("satellite_id", F.lit("-")).alias("satellite_id"),
    )


CODED = "select substr('ABCDE', cast(1 + l as int), 1) as code, tile_id as tile_key, box_id, cx + l as cx, cy, w, h, score from (select *, cast(floor(qty) as bigint) % 4 as l from v_boxes) q"
_CODED_DUCK = f"select concat(code, '#', tile_key) as tile_id, code, box_id, cx, cy, w, h, score from ({CODED}) c where score > 0.25e0"


def _benchmark_sql():
    nms = nms_sql(_CODED_DUCK, False, ">= 0.5e0")
    truth = f"select concat(c.code, '#', g.tile_id) as tile_id, g.box_id, g.b from ({TRUTH}) g, (values ('A'), ('B'), ('C'), ('D'), ('E')) c(code)"
    match = f"""select tile_id, len(m) as tp from (select tile_id, list_reduce(list([{{'p': pred, 'g': gt}}] order by rank, gt), lambda acc, d: case when len(list_filter(acc, lambda k: k.p = d[1].p or k.g = d[1].g)) > 0 then acc else list_concat(acc, d) end) as m
      from (select n.tile_id, n.rank, n.b.id as pred, g.box_id as gt, {iou_sql('n.b', 'g.b', False)} as iou from ({nms}) n join ({truth}) g on n.tile_id = g.tile_id) e where iou >= 0.5e0 group by tile_id) z"""
    return f"""select code, tp, fp, fn, {_R4.format('case when tp + fp > 0 then tp * 1e0 / (tp + fp) else 0e0 end')} as precision, {_R4.format('case when tp + fn > 0 then tp * 1e0 / (tp + fn) else 0e0 end')} as recall from (
      select code, cast(sum(tp) as bigint) as tp, cast(sum(n_pred - tp) as bigint) as fp, cast(sum(n_gt - tp) as bigint) as fn from (
      select substr(coalesce(p.tile_id, g.tile_id), 1, 1) as code, coalesce(n_pred, 0) as n_pred, coalesce(n_gt, 0) as n_gt, coalesce(tp, 0) as tp from (select tile_id, count(*) as n_pred from ({nms}) n group by tile_id) p
      full join (select tile_id, count(*) as n_gt from ({truth}) t group by tile_id) g on g.tile_id = p.tile_id left join ({match}) m on m.tile_id = coalesce(p.tile_id, g.tile_id)) s group by code) z"""


@query("benchmark_chains", _benchmark_sql())
def benchmark_chains(t):
    labels = t.v_truth.withColumnRenamed("tile_id", "tile_key").drop("tile_no")
    return flows.benchmark_chains(t.sql(CODED), labels).select("code", "tp", "fp", "fn", "precision", "recall")
