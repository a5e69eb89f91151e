"""Ship positions: clean-up, density map, time and space joins with scenes and tiles."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seaglint.functions.clock import micros
from seaglint import config as C
from seaglint.functions import ais, boxes, geo
from seaglint.operators.ranking import top_per_group
from seaglint.operators.spatial import (
    cell_steps,
    far_in_space_and_time,
    join_listed,
    pairs_by_blocks,
    pairs_of_listed,
    points_in_boxes,
    points_in_dated_boxes,
)
from seaglint.session import ensure_checkpoint_dir, saved, ship_package


def drop_missing_coords(df: DataFrame) -> DataFrame:
    return df.where(F.col("lat").isNotNull() & F.col("lon").isNotNull())


def normalize_records(raw: DataFrame, record: str = "record") -> DataFrame:
    """JSON records to position rows; records without coordinates are dropped."""
    # Out of a generator the parsed map is a plain column, so the later filter does not parse again.
    parsed = raw.withColumn("_f", F.explode(F.array(ais.record_fields(F.col(record)))))
    lat, lon = ais.lat_lon_of(F.col("_f"))

    def field(*names):
        return ais.first_text(*[ais.field(F.col("_f"), n) for n in names])

    rows = parsed.select(
        *[c for c in raw.columns if c != record],
        lat.alias("lat"),
        lon.alias("lon"),
        F.coalesce(field("timestamp", "date"), F.lit("")).alias("timestamp"),
        field("mmsi", "MMSI").alias("mmsi"),
        field("vessel_name", "name").alias("vessel_name"),
        field("vessel_type", "type").alias("vessel_type"),
        F.lit(C.SEED_SOURCE).alias("source"),
        F.lit(True).alias("requires_human_validation"),
    )
    return drop_missing_coords(rows)


def filter_positions_bbox(df: DataFrame, bbox: tuple[float, float, float, float]) -> DataFrame:
    """Positions inside (lon_min, lat_min, lon_max, lat_max), bounds included."""
    return df.where(F.col("lon").between(bbox[0], bbox[2]) & F.col("lat").between(bbox[1], bbox[3]))


def density_map(positions: DataFrame, bbox=C.REGION_BBOX, cell: float = C.DENSITY_CELL_DEG) -> DataFrame:
    """Positions of the region per grid cell. Offsets are cut toward zero and capped at the last cell."""
    lon_min, lat_min, lon_max, lat_max = bbox
    n_lon = max(1, int((lon_max - lon_min) / cell))
    n_lat = max(1, int((lat_max - lat_min) / cell))

    def step(v, low, n):
        return F.least(F.lit(n - 1), ((v - F.lit(low)) / F.lit(cell)).cast("int"))

    counted = (
        filter_positions_bbox(drop_missing_coords(positions), bbox)
        .groupBy(step(F.col("lon"), lon_min, n_lon).alias("ci"), step(F.col("lat"), lat_min, n_lat).alias("cj"))
        .agg(F.count("*").alias("ais_count"))
    )
    x0 = F.lit(lon_min) + F.col("ci") * F.lit(cell)
    y0 = F.lit(lat_min) + F.col("cj") * F.lit(cell)
    return counted.select(
        (F.col("ci") * n_lat + F.col("cj")).cast("bigint").alias("cell_index"),
        x0.alias("lon_min"),
        y0.alias("lat_min"),
        (x0 + F.lit(cell)).alias("lon_max"),
        (y0 + F.lit(cell)).alias("lat_max"),
        "ais_count",
    )


def density_rank(cells: DataFrame) -> DataFrame:
    """Rank of each cell by count. The grid bounds the number of rows, not the data."""
    w = Window.orderBy(F.desc("ais_count"), "cell_index", "lon_min")
    return cells.withColumn("density_rank", F.row_number().over(w).cast("bigint"))


def top_density_cells(cells: DataFrame, n: int = C.TARGET_ZONES) -> DataFrame:
    return cells.orderBy(F.desc("ais_count"), "cell_index", "lon_min").limit(n)


#: Squares of a level of the pyramid along one side of a square of the level above, and degrees that the top spans.
FAN, SPAN_DEG = 8, 360.0


def _gap2(low, high, square_low, square_high, worst: bool):
    """Squared distance in one direction between two intervals, nearest or farthest ends."""
    if worst:
        d = F.greatest(square_high - low, high - square_low)
    else:
        d = F.greatest(low - square_high, square_low - high, F.lit(0.0))
    return d * d


def _nearest_places(near: DataFrame, x: tuple, y: tuple, step: float) -> DataFrame:
    """Of the places beside each grid square ``_gx``, ``_gy`` those no farther at best than another one at worst."""
    least, most = F.lit(0.0), F.lit(0.0)
    for axis, (low, high) in (("_gx", x), ("_gy", y)):
        own = F.col(axis) * F.lit(step), (F.col(axis) + 1) * F.lit(step)
        least, most = least + _gap2(low, high, *own, False), most + _gap2(low, high, *own, True)
    bound = F.min("_most").over(Window.partitionBy("_gx", "_gy"))
    measured = near.withColumn("_least", least).withColumn("_most", most).withColumn("_bound", bound)
    return measured.where(F.col("_least") <= F.col("_bound") + F.lit(1e-8)).drop("_least", "_most", "_bound")


def nearest_cell(scenes: DataFrame, ranked_cells: DataFrame, step: float = C.DENSITY_CELL_DEG) -> DataFrame:
    """Closest density cell to each scene centre, by distance in degrees (ties: better rank).

    Scene centres are put on a grid, and cells in a pyramid of ever larger squares. Each grid square in use
    goes down the pyramid: an equi-join on the square above gives the squares below that hold cells, and
    those that are farther at best than another is at worst are dropped. So a grid square meets a few
    squares in each level and a few cells at the end, however many cells the map has; a scene then
    compares the cells of its own square.
    """
    levels = max(1, math.ceil(math.log(SPAN_DEG / step, FAN)))
    cells = ranked_cells.select(
        "cell_index", "density_rank", "ais_count",
        ((F.col("lon_min") + F.col("lon_max")) / 2).alias("cx"), ((F.col("lat_min") + F.col("lat_max")) / 2).alias("cy"),
    ).withColumn("_qx", geo.cell_of(F.col("cx"), step)).withColumn("_qy", geo.cell_of(F.col("cy"), step))
    centred = (
        scenes.withColumn("_lon", (F.col("lon_min") + F.col("lon_max")) / 2)
        .withColumn("_lat", (F.col("lat_min") + F.col("lat_max")) / 2)
        .withColumn("_gx", geo.cell_of(F.col("_lon"), step))
        .withColumn("_gy", geo.cell_of(F.col("_lat"), step))
    )
    ends = F.array(F.lit(-1).cast("bigint"), F.lit(0).cast("bigint"))
    near = centred.select("_gx", "_gy").distinct().withColumn("_qx", F.explode(ends)).withColumn("_qy", F.explode(ends))
    for level in reversed(range(levels)):
        above = lambda c: F.floor(F.col(c) / F.lit(FAN))
        held = lambda c, n=FAN**level: F.floor(F.col(c) / F.lit(n)).alias(c)
        squares = cells.select(held("_qx"), held("_qy")).distinct().withColumns({"_ux": above("_qx"), "_uy": above("_qy")})
        near = near.withColumnsRenamed({"_qx": "_ux", "_qy": "_uy"}).join(squares, ["_ux", "_uy"])
        size = F.lit(step * FAN**level)
        x, y = ((F.col(q) * size, (F.col(q) + 1) * size) for q in ("_qx", "_qy"))
        near = _nearest_places(near, x, y, step).select("_gx", "_gy", "_qx", "_qy")
    found = _nearest_places(near.join(cells, ["_qx", "_qy"]), (F.col("cx"),) * 2, (F.col("cy"),) * 2, step)
    squares = found.groupBy("_gx", "_gy").agg(F.collect_list(F.struct("cell_index", "density_rank", "ais_count", "cx", "cy")).alias("_near"))
    best = F.array_min(
        F.transform(
            F.col("_near"),
            lambda c: F.struct(
                F.round(F.pow(c["cx"] - F.col("_lon"), 2) + F.pow(c["cy"] - F.col("_lat"), 2), 9).alias("d2"),
                c["density_rank"].alias("density_rank"),
                c["cell_index"].alias("cell_index"),
                c["ais_count"].alias("ais_count"),
            ),
        )
    )
    out = centred.join(squares, ["_gx", "_gy"]).withColumn("_best", best)
    return out.select(
        *scenes.columns,
        F.col("_best.cell_index").alias("cell_index"),
        F.col("_best.density_rank").alias("density_rank"),
        F.col("_best.ais_count").alias("ais_count"),
        F.sqrt("_best.d2").alias("distance_deg"),
    )


def scene_cell_overlap(scenes: DataFrame, ranked_cells: DataFrame) -> DataFrame:
    """Share of each scene's box covered by the densest cell, in percent."""
    top = ranked_cells.where("density_rank = 1").select(F.struct("lon_min", "lat_min", "lon_max", "lat_max"))
    with_top = scenes.withColumn("_c", top.scalar())
    dx = F.least("lon_max", F.col("_c.lon_max")) - F.greatest("lon_min", F.col("_c.lon_min"))
    dy = F.least("lat_max", F.col("_c.lat_max")) - F.greatest("lat_min", F.col("_c.lat_min"))
    whole = (F.col("lon_max") - F.col("lon_min")) * (F.col("lat_max") - F.col("lat_min"))
    share = F.when((dx > 0) & (dy > 0), F.try_divide(dx * dy, whole) * 100.0).otherwise(0.0)
    return with_top.withColumn("overlap_percent", F.coalesce(share, F.lit(0.0))).drop("_c")


def with_ais_window(scenes: DataFrame) -> DataFrame:
    """Add the day range in which positions count for a scene."""
    day = F.col("acquired").cast("date")
    return scenes.withColumn("day_from", F.date_sub(day, C.AIS_LOOKBACK_DAYS)).withColumn(
        "day_to", F.date_add(day, 1)
    )


def ais_in_scene_window(positions: DataFrame, scenes: DataFrame) -> DataFrame:
    """(position, scene) pairs within the scene's box and day range."""
    pts = drop_missing_coords(positions).withColumn("day", F.col("ts").cast("date"))
    sc = with_ais_window(scenes).select(
        "scene_id", "lat_min", "lon_min", "lat_max", "lon_max", "day_from", "day_to"
    )
    return points_in_dated_boxes(pts, sc, cell=1.0)


def ais_hour_window(
    positions: DataFrame, scenes: DataFrame, hours: float = 1.0) -> DataFrame:
    """Pairs where the position is within ``hours`` of the acquisition and inside the box."""
    step = F.lit(3_600_000_000)
    reach = F.lit(int(hours * 3_600_000_000))
    acq = micros("acquired")
    sc = scenes.select("scene_id", "acquired", "lat_min", "lon_min", "lat_max", "lon_max").withColumn(
        "_hour", F.explode(F.sequence(F.floor((acq - reach) / step), F.floor((acq + reach) / step)))
    )
    pts = drop_missing_coords(positions).withColumn("_hour", F.floor(micros("ts") / step))
    pairs = points_in_boxes(pts, sc, on=("_hour",), cell=1.0)
    near = F.abs(micros("ts") - micros("acquired")) <= reach
    return pairs.where(near).drop("_hour")


#: Days and grid cells along the sides of a block of occupied places, which bound the places it can hold.
COVER_DAYS, COVER_CELLS = 8, 8


def ais_coverage(positions: DataFrame, scenes: DataFrame, cell: float = 0.25) -> DataFrame:
    """All scenes with ``has_ais``: is there a position in the box and day range?

    Occupied (day, cell) places, with the box around their positions, are combined before the shuffle and stand
    in blocks of ``COVER_DAYS`` days by ``COVER_CELLS`` cells by ``COVER_CELLS`` cells. A scene is listed under the
    few blocks that it touches. A place whose positions all lie in the scene settles it; only where places lie
    across its border and none settles it are the positions themselves looked at, as a semi-join.
    """
    wide = cell * COVER_CELLS
    block = ["_bd", "_by", "_bx"]
    day_no = lambda c: F.datediff(F.col(c), F.lit("1970-01-01").cast("date"))
    pts = drop_missing_coords(positions).select(
        "lat", "lon", F.col("ts").cast("date").alias("day"), geo.cell_of(F.col("lat"), cell).alias("_cy"), geo.cell_of(F.col("lon"), cell).alias("_cx")
    )
    place = ["day", "_cy", "_cx"]
    bounds = [f(c).alias(f"{n}_{c}") for c in ("lat", "lon") for f, n in ((F.min, "least"), (F.max, "most"))]
    held = F.struct(*place, "least_lat", "most_lat", "least_lon", "most_lon")
    blocks = (
        pts.where(F.col("day").isNotNull()).groupBy(*place).agg(*bounds)
        .withColumn("_bd", F.floor(day_no("day") / F.lit(COVER_DAYS)))
        .withColumn("_by", F.floor(F.col("_cy") / F.lit(COVER_CELLS)))
        .withColumn("_bx", F.floor(F.col("_cx") / F.lit(COVER_CELLS)))
        .groupBy(*block).agg(F.collect_list(held).alias("_held"))
    )
    box = ["lat_min", "lon_min", "lat_max", "lon_max"]
    dated = with_ais_window(scenes).select("scene_id", *box, "day_from", "day_to")
    days = F.sequence(F.floor(day_no("day_from") / F.lit(COVER_DAYS)), F.floor(day_no("day_to") / F.lit(COVER_DAYS)))
    listed = dated.withColumn("_bd", F.explode(days))
    for axis, low, high in (("_by", "lat_min", "lat_max"), ("_bx", "lon_min", "lon_max")):
        first, last = (F.floor(geo.cell_of(F.col(c), cell) / F.lit(COVER_CELLS)) for c in (low, high))
        listed = listed.withColumn(axis, F.explode(F.sequence(first, last)))

    def settles(p):
        inside = (p["least_lat"] >= F.col("lat_min")) & (p["most_lat"] <= F.col("lat_max"))
        inside = inside & (p["least_lon"] >= F.col("lon_min")) & (p["most_lon"] <= F.col("lon_max"))
        return p["day"].between(F.col("day_from"), F.col("day_to")) & inside

    def touches(p):
        near = (p["most_lat"] >= F.col("lat_min")) & (p["least_lat"] <= F.col("lat_max"))
        near = near & (p["most_lon"] >= F.col("lon_min")) & (p["least_lon"] <= F.col("lon_max"))
        return p["day"].between(F.col("day_from"), F.col("day_to")) & near

    met = join_listed(blocks, listed, block)
    covered = met.where(F.exists("_held", settles)).groupBy("scene_id").agg(F.count("*").alias("_hits"))
    asked = F.transform(F.filter("_held", touches), lambda p: F.struct(*[p[c].alias(c) for c in place]))
    border = met.where(~F.exists("_held", settles)).select("scene_id", *box, F.explode(asked).alias("_p")).select("scene_id", *box, "_p.*")
    border = border.join(covered, "scene_id", "left_anti")
    exact = F.col("lat").between(F.col("lat_min"), F.col("lat_max")) & F.col("lon").between(F.col("lon_min"), F.col("lon_max"))
    for c in place:
        exact = exact & (border[c] == pts[c])
    found = covered.unionByName(border.join(pts, exact, "left_semi").groupBy("scene_id").agg(F.count("*").alias("_hits")))
    return scenes.join(found, "scene_id", "left").withColumn("has_ais", F.col("_hits").isNotNull()).drop("_hits")


def union_detection_sources(seeds: DataFrame, gaps: DataFrame) -> DataFrame:
    """Presence seeds and AIS-off events in one table, each with its source as first label."""
    a = seeds.withColumn("source", F.lit(C.SEED_SOURCE)).withColumn("label", F.lit(C.SEED_SOURCE))
    b = gaps.withColumn("source", F.lit(C.GAP_SOURCE)).withColumn("label", F.lit(C.GAP_SOURCE))
    return a.unionByName(b, allowMissingColumns=True)


def points_in_tiles(
    points: DataFrame, tiles: DataFrame, *, on: tuple[str, ...] = ()) -> DataFrame:
    """Every (point, tile) pair with pixel position; tiles without extent give no row.

    Without columns ``on`` that points and tiles share, the pairs grow as the product of both tables and are made by blocks.
    """
    pairs = points_in_boxes(points, tiles, on=on, cell=0.2) if on else pairs_by_blocks(points, tiles, cell=0.4)
    px, py = geo.tile_pixel(*[F.col(c) for c in ("lat", "lon", "lat_min", "lon_min", "lat_max", "lon_max")])
    return (
        pairs.withColumn("pixel_x", px)
        .withColumn("pixel_y", py)
        .where(F.col("pixel_x").isNotNull() & F.col("pixel_y").isNotNull())
    )


def annotate_pairs(pairs: DataFrame, point_id: str) -> DataFrame:
    """Label, class and estimated box of each (point, tile) pair."""
    key = F.concat_ws("@", F.col(point_id).cast("string"), F.col("tile_id"))
    cx, cy, w, h = boxes.estimated_box(key, F.col("pixel_x"), F.col("pixel_y"), F.col("vessel_type"))
    label = ais.annotation_label(F.col("source"), F.lit(False))
    return (
        pairs.withColumn("label", label)
        .withColumn("class_id", ais.label_class(F.col("label")))
        .withColumn("cx", F.round(cx, 6))
        .withColumn("cy", F.round(cy, 6))
        .withColumn("w", F.round(w, 6))
        .withColumn("h", F.round(h, 6))
    )


#: Most tiles of a group in a grid cell that are cut into pieces at a time, and the side of the cell.
FIRST_TILES, FIRST_CELL = 1024, 0.4


def _first_owner(sides: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of a box and bounds of each piece of the plane that it holds and no box before it does.

    ``sides``: lat_min, lon_min, lat_max, lon_max of boxes with their bounds, in order. A closed interval of doubles
    is half open up to the next double, so the steps between all ends belong to the same boxes throughout.
    """
    least, most = sides[:, :2], np.nextafter(sides[:, 2:], np.inf)
    real = np.flatnonzero((least < most).all(axis=1))  # not the empty ones and those with NaN
    ends = [np.unique(np.concatenate([least[real, k], most[real, k]])) for k in (0, 1)]
    if not len(real):
        return np.zeros(0, dtype="int32"), np.zeros((0, 4))
    (y0, x0), (y1, x1) = ([np.searchsorted(ends[k], side[real, k]).tolist() for k in (0, 1)] for side in (least, most))
    owner = np.full((len(ends[0]) - 1, len(ends[1]) - 1), -1, dtype="int32")
    for i in range(len(real) - 1, -1, -1):
        owner[y0[i] : y1[i], x0[i] : x1[i]] = real[i]
    # Steps of a line with one owner make a run, and equal runs of lines that follow each other a piece.
    height, width = owner.shape
    changes = np.ones((height, width + 1), dtype=bool)
    changes[:, 1:-1] = owner[:, 1:] != owner[:, :-1]
    row, at = np.nonzero(changes)
    inner = at[:-1] < width
    row, first, last = row[:-1][inner], at[:-1][inner], at[1:][inner]
    own = owner[row, first]
    order = np.lexsort((row, last, first, own))
    order = order[own[order] >= 0]
    row, first, last, own = row[order], first[order], last[order], own[order]
    begins = np.ones(len(row), dtype=bool)
    begins[1:] = (own[1:] != own[:-1]) | (first[1:] != first[:-1]) | (last[1:] != last[:-1]) | (row[1:] != row[:-1] + 1)
    top = np.flatnonzero(begins)
    below = np.append(top[1:], len(row)) - 1
    low, high = (ends[0][row[top]], ends[1][first[top]]), (ends[0][row[below] + 1], ends[1][last[top]])
    return own[top], np.column_stack([*low, *[np.nextafter(v, -np.inf) for v in high]])


def _pieces(sides: Column) -> Column:
    """``at`` and bounds of the pieces of each row's boxes (``_first_owner``), as an array of structs.

    ``sides``: an array of four bounds for each box.
    """
    names = ["lat_min", "lon_min", "lat_max", "lon_max"]
    bounds = ", ".join(f"{n}: array<double>" for n in names)

    @F.arrow_udf(f"struct<at: array<int>, {bounds}>")
    def cut(lists: pa.Array) -> pa.Array:
        made = [_first_owner(row.values.flatten().to_numpy().reshape(-1, 4)) for row in lists]
        ends = pa.array(np.cumsum([0, *[len(at) for at, _ in made]]), pa.int32())
        held = np.concatenate([box for _, box in made])
        columns = [np.concatenate([at for at, _ in made]), *held.T]
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(ends, pa.array(c)) for c in columns], names=["at", *names])

    return cut(sides)


def points_first_tile(
    points: DataFrame,
    tiles: DataFrame,
    *,
    point_id: str,
    on: tuple[str, ...] = (),
    per: tuple[str, ...] = ()) -> DataFrame:
    """Each point with the first tile in grid order whose slightly widened box holds it.

    The tiles of a group under a grid cell, ``FIRST_TILES`` at a time, are cut into pieces that do not overlap, each
    held by the tile that comes first in it. So a point lies in one piece at most, and pairs of points and pieces
    (``spatial.pairs_of_listed``) are the result; they are not compared or shuffled. Only where a group has more tiles
    in a cell, or a point's id occurs twice, the picks are compared. Ids and cells are counted when the plan is built.
    ``per`` names tile columns (a scene) within which the first tile is wanted.
    """
    ship_package(points.sparkSession)
    ensure_checkpoint_dir(points.sparkSession)
    cell, m = FIRST_CELL, F.lit(C.FIRST_TILE_MARGIN_DEG)
    low, high = (lambda c: F.col(f"{c}_min") - m), (lambda c: F.col(f"{c}_max") + m)
    shared = [*dict.fromkeys([*on, *per])]
    place, point = [*shared, "_cy", "_cx"], [*on, *per, point_id]
    listed = tiles.withColumn("_cy", cell_steps(low("lat"), high("lat"), cell)).withColumn("_cx", cell_steps(low("lon"), high("lon"), cell))
    whole = Window.partitionBy(*place)
    dealt = listed.withColumn("_run", F.floor((F.row_number().over(whole.orderBy("tile_no", "tile_id")) - 1) / F.lit(FIRST_TILES)))
    dealt = dealt.withColumn("_cut", F.count("*").over(whole) > FIRST_TILES)
    rest = [c for c in tiles.columns if c not in (*shared, "tile_no", "tile_id")]

    def beside(value, axis, by):  # inside the cell and a little more: what lies farther away is not asked for
        edge = lambda n: (F.col(axis) + F.lit(n)) * F.lit(cell)
        return F.greatest(value, edge(0) - F.lit(1e-6)) if by == "low" else F.least(value, edge(1) + F.lit(1e-6))

    sides = F.array(beside(low("lat"), "_cy", "low"), beside(low("lon"), "_cx", "low"), beside(high("lat"), "_cy", "high"), beside(high("lon"), "_cx", "high"))
    order = F.sort_array(F.collect_list(F.struct("tile_no", "tile_id", *rest, sides.alias("_sides")))).alias("_tiles")
    runs = dealt.groupBy(*place, "_run", "_cut").agg(order)
    cut = runs.withColumn("_pieces", _pieces(F.transform("_tiles", lambda t: t["_sides"])))
    bounds = ["lat_min", "lon_min", "lat_max", "lon_max"]
    piece = F.explode(F.arrays_zip(*[F.col("_pieces")[c].alias(c) for c in ("at", *bounds)])).alias("_piece")
    first = F.struct(*[F.get("_tiles", F.col("_piece.at"))[c].alias(c) for c in ("tile_no", "tile_id", *rest)]).alias("_first")
    alone = [c for c in per if c not in on]
    grouped = F.struct(*alone) if alone else F.struct(F.lit(None).cast("int").alias("_none"))
    pieces = cut.select(*place, "_cut", "_tiles", piece).select(
        *on, "_cy", "_cx", "_cut", grouped.alias("_per"), first, *[F.col(f"_piece.{c}").alias(c) for c in bounds]
    )
    pieces = saved(pieces)
    twice = points.groupBy(F.col(point_id).alias("_id")).agg(F.count("*").alias("_n")).where("_n > 1").select("_id").checkpoint()
    many, several = not pieces.where("_cut").isEmpty(), not twice.isEmpty()
    pts = drop_missing_coords(points)
    again = F.col(point_id).eqNullSafe(F.col("_id"))
    of_tile = [c for c in tiles.columns if c not in on]
    made = [*on, *[c for c in points.columns if c not in on], *[F.col(f"_per.{c}" if c in alone else f"_first.{c}").alias(c) for c in of_tile]]

    def picks(some, of):
        return pairs_of_listed(some, of.drop("_cut"), on=on, cell=cell).select(*made)

    once = picks(pts.join(twice, again, "left_anti") if several else pts, pieces.where("not _cut"))
    more = picks(pts, pieces.where("_cut")) if many else once.where("false")
    if several:
        more = more.unionByName(picks(pts.join(twice, again, "left_semi"), pieces.where("not _cut")))
    return once.unionByName(top_per_group(more, point, [F.asc("tile_no"), F.asc("tile_id")], 1))


def dark_detections(
    detections: DataFrame,
    positions: DataFrame,
    *,
    det_id: str = "det_id",
    radius_m: float = 500.0,
    window_s: int = 1800) -> DataFrame:
    """Detections with no ship position close in space and time.

    Each row is judged by its own place and time, also where rows share their ``det_id``.
    """
    return far_in_space_and_time(detections, positions, radius_m=radius_m, window_s=window_s)
