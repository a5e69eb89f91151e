"""Label lines, duplicates, splits, summaries, exports."""

from pyspark.sql import functions as F

from seaglint.operators import dataset, evaluate, labels
from seaglint.sources import sinks
from seaglint.streaming.jobs import work_folder
from seaglint.plans.registry import query, r, rounded
from seaglint.plans.scalar_queries import duck_size

# Parsed form for the SQL side.
PARSED = """select *, case when n_parts = 5 then try_cast(p[1] as int) end as class_id, case when n_parts = 5 then try_cast(p[2] as double) end as cx, case when n_parts = 5 then try_cast(p[3] as double) end as cy,
 case when n_parts = 5 then try_cast(p[4] as double) end as w, case when n_parts = 5 then try_cast(p[5] as double) end as h from (select *, string_split(txt, ' ') as p, len(string_split(txt, ' ')) as n_parts from v_lines) q"""
BAD = "(n_parts <> 5 or class_id is null or w <= 0 or h <= 0 or cx > 1 or cy > 1 or w > 1 or h > 1)"
TILES = "select distinct tile_id, substr(tile_id, 1, 18) as scene_id from v_lines"
VALID = f"select tile_id from ({PARSED}) x group by tile_id having not bool_or({BAD})"


@query("label_line_validity", f"select tile_id, count(*) as n_lines, count(*) filter (where {BAD}) as n_bad, count(*) filter (where class_id < 0) as n_warnings, not bool_or({BAD}) as valid from ({PARSED}) x group by tile_id")
def label_line_validity(t):
    return labels.tile_validity(t.v_lines)


@query(
    "duplicate_boxes",
    """select tile_id, line_no from (select *, row_number() over (partition by tile_id, coords order by line_no) as rn from (select *, case when len(string_split(txt, ' ')) = 5 then substr(txt, 3) end as coords from v_lines) q) z where rn = 1 or coords is null""",
)
def duplicate_boxes(t):
    return labels.drop_duplicate_boxes(t.v_lines).select("tile_id", F.col("line_no").cast("bigint").alias("line_no"))


@query("tile_label_join", f"select t.tile_id, l.txt from ({TILES}) t join v_lines l on l.tile_id = t.tile_id")
def tile_label_join(t):
    return labels.tile_label_join(t.sql(TILES), t.v_lines.select("tile_id", "txt")).select("tile_id", "txt")


def _chunk(by, ratios=(70, 15, 15), order="tile_id", source=TILES):
    total = sum(ratios)
    part = f"partition by {by} " if by else ""
    return f"""select tile_id, case when rn <= floor(n * {ratios[0]}e0 / {total}e0) then 'train' when rn <= floor(n * {ratios[0]}e0 / {total}e0) + floor(n * {ratios[1]}e0 / {total}e0) then 'val' else 'test' end as split
      from (select *, row_number() over ({part}order by {order}) as rn, count(*) over ({part.strip()}) as n from ({source}) t) z"""


@query("geo_split", _chunk("scene_id"))
def geo_split(t):
    return labels.geo_split(t.sql(TILES)).select("tile_id", "split")


@query("platform_stratified_split", _chunk("substr(scene_id, 1, 3)"))
def platform_stratified_split(t):
    return labels.platform_stratified_split(t.sql(TILES)).select("tile_id", "split")


PLAN = f"select distinct scene_id, case when substr(scene_id, 18, 1) = '1' then 'val' when substr(scene_id, 18, 1) = '2' then 'test' when substr(scene_id, 18, 1) = '3' then 'unknown' else 'train' end as split from ({TILES}) t"


@query(
    "scene_plan_split",
    f"select t.tile_id, case when p.split in ('train', 'val', 'test') then p.split else 'train' end as split from ({TILES}) t join ({PLAN}) p on p.scene_id = t.scene_id where t.scene_id <> 'S1C_scene000000000' union all {_chunk('scene_id', source=f'select * from ({TILES}) y where scene_id = ' + chr(39) + 'S1C_scene000000000' + chr(39))}",
)
def scene_plan_split(t):
    return labels.scene_plan_split(t.sql(TILES), t.sql(PLAN), {"S1C_scene000000000": (70, 15, 15)}).select("tile_id", "split")


@query(
    "proportional_scene_split",
    f"""select tile_id, case when rn <= greatest(1, floor(n * 0.6e0)) then 'train' when rn <= greatest(1, floor(n * 0.6e0)) + greatest(1, floor(n * 0.2e0)) then 'val' else 'test' end as split
    from ({TILES}) t join (select scene_id, row_number() over (order by scene_id) as rn, count(*) over () as n from (select distinct scene_id from ({TILES}) a) b) s on s.scene_id = t.scene_id""",
)
def proportional_scene_split(t):
    return labels.proportional_scene_split(t.sql(TILES)).select("tile_id", "split")


@query("random_split", _chunk("", (80, 10, 10), "md5(concat(tile_id, '|', 'mix-7')), tile_id"))
def random_split(t):
    return labels.random_split(t.sql(TILES), "mix-7").select("tile_id", "split")


# Label files (some empty), their lines and images (some missing, some mostly empty).
FILES = f"select tile_id, scene_id from ({TILES}) t union all select concat(tile_id, 'e') as tile_id, scene_id from ({TILES}) t where cast(right(tile_id, 12) as bigint) % 50 = 0"
IMAGES = f"select tile_id, (k % 10) / 20e0 as zero_share from (select tile_id, cast(right(tile_id, 12) as bigint) as k from ({TILES}) t) q where k % 13 <> 0"
OUTCOME = f"""with b as (select tile_id, coords, min(line_no) as line_no, count(*) as n, bool_or(n_parts <> 5) as parts, bool_or(n_parts = 5 and class_id is null) as non_numeric, bool_or(n_parts = 5 and (cx > 1 or cy > 1 or w > 1 or h > 1)) as outside, bool_or(n_parts = 5 and (w <= 0 or h <= 0)) as size
     from (select *, case when n_parts = 5 then substr(txt, 3) else concat('#', line_no) end as coords from ({PARSED}) x) y group by tile_id, coords),
   v as (select f.tile_id, f.scene_id, g.n_boxes, g.n_lines - g.n_boxes as n_duplicates, g.line_sum, case when g.n_lines is null then 'empty' when parts then 'parts' when non_numeric then 'non_numeric' when outside then 'outside' when size then 'size' when i.tile_id is null then 'no_image' when zero_share > 0.3e0 then 'nodata' end as reason
     from ({FILES}) f left join (select tile_id, cast(sum(n) as bigint) as n_lines, count(*) as n_boxes, cast(sum(line_no) as bigint) as line_sum, bool_or(parts) as parts, bool_or(non_numeric) as non_numeric, bool_or(outside) as outside, bool_or(size) as size from b group by tile_id) g on g.tile_id = f.tile_id left join ({IMAGES}) i on i.tile_id = f.tile_id)"""


def _built(t):
    return dataset.build_dataset(t.sql(FILES), t.v_lines.select("tile_id", "line_no", "txt"), t.sql(IMAGES), stratify=True)


@query(
    "build_dataset",
    f"""{OUTCOME} select v.tile_id, coalesce(reason, s.split) as outcome, case when reason is null then n_boxes end as n_boxes, case when reason is null then n_duplicates end as n_duplicates, case when reason is null then line_sum end as line_sum
    from v left join ({_chunk('substr(scene_id, 1, 3)', source='select tile_id, scene_id from v where reason is null')}) s on s.tile_id = v.tile_id""",
)
def build_dataset(t):
    """Every label file with its split or the reason why it went."""
    made = _built(t)
    sums = made.lines.groupBy("tile_id").agg(F.sum("line_no").cast("bigint").alias("line_sum"))
    kept = made.tiles.join(sums, "tile_id").select("tile_id", F.col("split").alias("outcome"), "n_boxes", "n_duplicates", "line_sum")
    return kept.unionByName(made.quarantine.select("tile_id", F.col("reason").alias("outcome")), allowMissingColumns=True)


@query(
    "build_dataset_counts",
    f"{OUTCOME} select coalesce(reason, 'kept') as name, count(*) as n from v group by 1 union all select 'total', count(*) from v union all select 'duplicates', cast(sum(n_duplicates) as bigint) from v where reason is null",
)
def build_dataset_counts(t):
    """What was observed while the verdicts were written; reasons that nobody has are left out."""
    counts = _built(t).counts
    return t.spark.createDataFrame([(k, int(n)) for k, n in counts.items() if n], "name string, n bigint")


COUNTED = "select substr(tile_id, 1, 18) as scene_id, count(distinct tile_id) as n_labels from v_lines group by 1"


@query(
    "split_estimate",
    f"""with p as (select platform, n, cast(floor(n * 70 / 100e0) as bigint) as n_train, cast(floor(n * 15 / 100e0) as bigint) as n_val from (select substr(scene_id, 1, 3) as platform, cast(sum(n_labels) as bigint) as n from ({COUNTED}) c group by 1) q)
    select platform, n, n_train, n_val, n - n_train - n_val as n_test, n_train < 30 as too_few from p
    union all select 'TOTAL', cast(sum(n) as bigint), cast(sum(n_train) as bigint), cast(sum(n_val) as bigint), cast(sum(n - n_train - n_val) as bigint), sum(n_train) < 30 from p""",
)
def split_estimate(t):
    return labels.split_estimate(t.sql(COUNTED))


@query("class_counts", f"select count(*) filter (where class_id = 0) as class_0, count(*) filter (where class_id = 1) as class_1, count(*) filter (where class_id = 2) as class_2 from ({PARSED}) x")
def class_counts(t):
    return labels.class_counts(labels.parse_lines(t.v_lines))


ASSIGNED = f"select a.tile_id, substr(a.tile_id, 1, 18) as scene_id, a.split, b.n_boxes from ({_chunk('scene_id')}) a join (select tile_id, count(*) as n_boxes from v_lines group by tile_id) b on b.tile_id = a.tile_id"


def _assigned(t):
    n = t.v_lines.groupBy("tile_id").agg(F.count("*").alias("n_boxes"))
    return labels.geo_split(t.sql(TILES)).join(n, "tile_id")


@query("dataset_summary", f"select coalesce(split, 'ALL') as split, coalesce(scene_id, 'ALL') as scene_id, count(*) as images, cast(sum(n_boxes) as bigint) as boxes from ({ASSIGNED}) a group by rollup (split, scene_id)")
def dataset_summary(t):
    return labels.dataset_summary(_assigned(t))


@query(
    "split_platform_composition",
    f"""select split, s1c, s1d, other, total, s1c * 100e0 / total as pct_s1c, s1d * 100e0 / total as pct_s1d, case when s1c * 100e0 / total > 80 then 'S1C' when s1d * 100e0 / total > 80 then 'S1D' else '' end as alert
    from (select split, count(*) filter (where tile_id like 'S1C%') as s1c, count(*) filter (where tile_id like 'S1D%') as s1d, count(*) filter (where tile_id like 'S1A%') as other, count(*) as total from ({ASSIGNED}) a group by split) z""",
)
def split_platform_composition(t):
    return labels.split_platform_composition(_assigned(t))


@query(
    "split_integrity",
    f"select split, cast(sum(a) as bigint) as n_images, cast(sum(b) as bigint) as n_labels, sum(a) <> sum(b) as mismatch from (select split, 1 as a, case when split = 'val' and n_boxes > 8 then 0 else 1 end as b from ({ASSIGNED}) q) z group by split",
)
def split_integrity(t):
    a = _assigned(t)
    return labels.split_integrity(a, a.where(~((F.col("split") == "val") & (F.col("n_boxes") > 8))))


@query(
    "bbox_size_distribution",
    f"""select count(*) as total_boxes, min(w) = max(w) and min(h) = max(h) as all_fixed_size, count(distinct floor(w * 1e6 + 0.5e0)) as unique_widths, count(distinct floor(h * 1e6 + 0.5e0)) as unique_heights,
    {r('avg(w)', 9)} as w_mean, {r('stddev_pop(w)', 9)} as w_std, min(w) as w_min, max(w) as w_max, {r('avg(h)', 9)} as h_mean, {r('stddev_pop(h)', 9)} as h_std, min(h) as h_min, max(h) as h_max from ({PARSED}) x where w is not null and h is not null""",
)
def bbox_size_distribution(t):
    out = labels.box_size_distribution(labels.parse_lines(t.v_lines))
    for c in ("w_mean", "w_std", "h_mean", "h_std"):
        out = out.withColumn(c, rounded(F.col(c), 9))
    return out


_rk = "concat(tile_id, '#', cast(line_no as varchar))"
_rw, _rh = duck_size(_rk, "cast(null as varchar)")


@query(
    "resample_bbox_sizes",
    f"select tile_id, line_no, n_parts = 5 as resampled, case when n_parts = 5 then {r(_rw, 5)} else -1e0 end as new_w, case when n_parts = 5 then {r(_rh, 5)} else -1e0 end as new_h, case when n_parts = 5 then '' else txt end as kept from ({PARSED}) x",
)
def resample_bbox_sizes(t):
    key = F.concat(F.col("tile_id"), F.lit("#"), F.col("line_no").cast("string"))
    out = labels.resample_box_sizes(t.v_lines, key)
    none = F.lit(-1.0)
    return out.select(
        "tile_id", F.col("line_no").cast("bigint").alias("line_no"), "resampled",
        F.coalesce(rounded(F.col("new_w"), 5), none).alias("new_w"), F.coalesce(rounded(F.col("new_h"), 5), none).alias("new_h"),
        F.when(F.col("resampled"), "").otherwise(F.col("new_txt")).alias("kept"),
    )


NOTES = f"select tile_id, box_id, 'sc' as scene_id, cast(floor(qty) as bigint) % 4 as class_id, {r('cx / 640e0')} as cx, {r('cy / 640e0')} as cy, {r('w / 640e0')} as w, {r('h / 640e0')} as h, case cast(floor(qty) as bigint) % 3 when 0 then 'AIS_confirmed' when 1 then 'visual_only' else 'odd' end as label from v_boxes"


@query("export_yolo", f"select tile_id, printf('%d %.6f %.6f %.6f %.6f', case label when 'AIS_confirmed' then 0 when 'dark_vessel_candidate' then 2 else 1 end, cx, cy, w, h) as line from ({NOTES}) n")
def export_yolo(t):
    from seaglint.functions.ais import label_class

    notes = t.sql(NOTES).withColumn("class_id", label_class(F.col("label")))
    out = f"{work_folder(t.spark, 'yolo')}/out"
    sinks.export_yolo(notes.withColumn("scene_id", F.substring("tile_id", 1, 6)), out)
    return t.spark.read.parquet(out).select("tile_id", "line")


CVAT = "select *, floor(cx * 16e0) / 16e0 as ax, floor(cy * 16e0) / 16e0 as ay, floor(w * 64e0) / 64e0 as aw, floor(h * 64e0) / 64e0 as ah from (" + NOTES + ") n"


@query(
    "export_cvat_xml",
    f"""select concat(tile_id, '.npy') as image, concat('vessel_', label) as label, printf('%.1f', greatest(0e0, (ax - aw / 2) * 512e0)) as xtl, printf('%.1f', greatest(0e0, (ay - ah / 2) * 512e0)) as ytl,
    printf('%.1f', least(512e0, (ax + aw / 2) * 512e0)) as xbr, printf('%.1f', least(512e0, (ay + ah / 2) * 512e0)) as ybr, row_number() over (partition by tile_id order by box_id) - 1 as z_order from ({CVAT}) c""",
)
def export_cvat_xml(t):
    snapped = t.sql(CVAT).drop("cx", "cy", "w", "h").withColumnsRenamed({"ax": "cx", "ay": "cy", "aw": "w", "ah": "h"})
    boxes = labels.cvat_boxes(snapped, ["box_id"])
    out = f"{work_folder(t.spark, 'cvat')}/out"
    sinks.export_cvat(boxes, out, compression="gzip")
    back = t.spark.read.format("xml").option("rowTag", "box").schema("image string, label string, xtl string, ytl string, xbr string, ybr string, z_order bigint").load(out)
    return back.select("image", "label", "xtl", "ytl", "xbr", "ybr", "z_order")


@query("z_order", "select tile_id, box_id, row_number() over (partition by tile_id order by box_id) - 1 as z_order from v_boxes")
def z_order(t):
    from seaglint.operators.ranking import numbered

    return numbered(t.v_boxes, ["tile_id"], ["box_id"]).select("tile_id", "box_id", (F.col("rn") - 1).cast("bigint").alias("z_order"))


@query("quantisation_loss", "select o_orderkey, case when f = 0 then 0e0 else (f - i) / f * 100e0 end as loss_percent, case when f = 0 then true else (f - i) / f * 100e0 < 1 end as passed from (select o_orderkey, (o_orderkey % 11) / 10e0 as f, (o_orderkey % 11) / 10e0 - (o_custkey % 5) / 200e0 as i from orders) q")
def quantisation_loss(t):
    df = t.sql("select o_orderkey, (o_orderkey % 11) / 10e0 as fp32, (o_orderkey % 11) / 10e0 - (o_custkey % 5) / 200e0 as int8 from orders")
    return evaluate.quantisation_loss(df).select("o_orderkey", "loss_percent", "passed")


@query(
    "f1_and_verdict",
    f"select o_orderkey, {r('p * 2e0 * q / (p + q + 1e-10)')} as f1, case when p > 0.7e0 then 'GO' when p > 0.5e0 then 'MARGINAL' when p > 0.3e0 then 'BELOW' else 'FAILED' end as verdict from (select o_orderkey, (o_orderkey % 101) / 100e0 as p, (o_custkey % 101) / 100e0 as q from orders) z",
)
def f1_and_verdict(t):
    df = t.sql("select o_orderkey, (o_orderkey % 101) / 100e0 as precision, (o_custkey % 101) / 100e0 as recall from orders")
    return evaluate.f1_and_verdict(df, "precision").select("o_orderkey", rounded(F.col("f1")).alias("f1"), "verdict")
