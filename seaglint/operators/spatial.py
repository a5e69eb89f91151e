"""Range joins in space and time by grid cells; the adaptive skew join splits crowded ones."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seaglint.functions.clock import micros
from seaglint import config as C
from seaglint.functions import geo
from seaglint.session import saved


def cell_steps(low: Column, high: Column, size: float) -> Column:
    return F.explode(F.sequence(geo.cell_of(low, size), geo.cell_of(high, size)))


def join_listed(one: DataFrame, listed: DataFrame, keys: list[str]) -> DataFrame:
    """Equi-join of rows with rows that were listed under several keys.

    Spark knows the size of the listed side before the listing only, and would broadcast it by that; so
    both sides are shuffled, and the adaptive skew join cuts crowded keys on either side.
    """
    return one.join(listed.hint("merge"), keys)


def points_in_boxes(
    points: DataFrame,
    boxes: DataFrame,
    *,
    on: tuple[str, ...] = (),
    cell: float = 0.1,
    margin: float = 0.0,
) -> DataFrame:
    """All (point, box) pairs where ``lat``/``lon`` lies in the box, bounds included.

    A box is listed under each grid cell it touches and a point under its one cell, so the join
    is an equi-join and a pair meets once. Choose ``cell`` near the box size. Nothing is counted when
    the plan is built; the adaptive skew join cuts crowded cells on either side when they are read.
    """
    m = F.lit(margin)
    pts = points.withColumn("_cy", geo.cell_of(F.col("lat"), cell)).withColumn(
        "_cx", geo.cell_of(F.col("lon"), cell)
    )
    bx = boxes.withColumn("_cy", cell_steps(F.col("lat_min") - m, F.col("lat_max") + m, cell)).withColumn(
        "_cx", cell_steps(F.col("lon_min") - m, F.col("lon_max") + m, cell)
    )
    inside = (
        (F.col("lat") >= F.col("lat_min") - m)
        & (F.col("lat") <= F.col("lat_max") + m)
        & (F.col("lon") >= F.col("lon_min") - m)
        & (F.col("lon") <= F.col("lon_max") + m)
    )
    return join_listed(pts, bx, [*on, "_cy", "_cx"]).where(inside).drop("_cy", "_cx")


#: Most boxes and points of a grid cell that meet in one task, points of a run, and steps of a cell's side by which runs are ordered.
BLOCK_BOXES, BLOCK_POINTS, RUN_POINTS, RUN_STEPS = 4096, 65_536, 64, 16
#: Counts of so many cells at most are sent to the tasks; more are joined.
FEW_CELLS = 100_000


def pairs_by_blocks(points: DataFrame, boxes: DataFrame, *, cell: float = 0.1, margin: float = 0.0) -> DataFrame:
    """The pairs of ``points_in_boxes``, for results far larger than both tables: they are written in few bytes.

    Points and listed boxes of each cell are counted first (a job when the plan is built), and a cell with many of
    them is cut into blocks of about ``BLOCK_BOXES`` boxes by ``BLOCK_POINTS`` points, each pair in one of them. The
    blocks are dealt to partitions of about ``BLOCK_BOXES`` boxes. Neighbouring points stand in runs; a run meets
    the boxes that its own bounds touch, and its points come out box by box. So a file holds few boxes, the values
    of a box stand in a row, and those of a run recur: Parquet's dictionaries hold them and its runs are long.
    """
    m = F.lit(margin)
    listed = boxes.withColumn("_cy", cell_steps(F.col("lat_min") - m, F.col("lat_max") + m, cell)).withColumn(
        "_cx", cell_steps(F.col("lon_min") - m, F.col("lon_max") + m, cell)
    )
    return pairs_of_listed(points, listed, cell=cell, margin=margin)


def pairs_of_listed(points: DataFrame, listed: DataFrame, *, on: tuple[str, ...] = (), cell: float, margin: float = 0.0) -> DataFrame:
    """``pairs_by_blocks`` for boxes that carry the cell ``_cy``, ``_cx`` in which they meet points of equal ``on``."""
    m, place = F.lit(margin), [*on, "_cy", "_cx"]
    held = [c for c in listed.columns if c not in place]
    pts = points.withColumn("_cy", geo.cell_of(F.col("lat"), cell)).withColumn("_cx", geo.cell_of(F.col("lon"), cell))
    counted = lambda df, name: df.groupBy(*place).agg(F.count("*").alias(name))
    cuts = lambda n, most: F.ceil(F.col(n) / F.lit(most))
    cells = join_listed(counted(pts, "_points"), counted(listed, "_boxes"), place)
    cells = saved(cells.select(*place, "_points", "_boxes", cuts("_points", BLOCK_POINTS).alias("_np"), cuts("_boxes", BLOCK_BOXES).alias("_nb")))
    met = cells.agg(F.sum(F.col("_points") * F.col("_nb") / BLOCK_POINTS), F.sum(F.col("_boxes") * F.col("_np") / BLOCK_BOXES), F.count("*")).first()
    parts = max(1, math.ceil(max(met[0] or 0, met[1] or 0)))

    def dealt(df, of, own, cut, other, other_cut):
        drawn = F.xxhash64(*[F.col(c) for c, kind in df.dtypes if c in of and "map<" not in kind])
        each = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(other_cut) - 1))
        cut_rows = df.join(F.broadcast(cells), place) if met[2] <= FEW_CELLS else join_listed(cells, df, place)
        return cut_rows.withColumn(own, F.pmod(drawn, F.col(cut))).withColumn(other, each)

    block = [*place, "_bp", "_bb"]
    step = lambda c: geo.cell_of(F.col(c), cell / RUN_STEPS)
    near = Window.partitionBy(*block).orderBy(step("lat"), step("lon"))
    bounds = [f(c).alias(f"_{c}_{n}") for c in ("lat", "lon") for n, f in (("least", F.min), ("most", F.max))]
    runs = (
        dealt(pts, points.columns, "_bp", "_np", "_bb", "_nb").repartition(parts, *block)
        .withColumn("_run", F.floor((F.row_number().over(near) - 1) / F.lit(RUN_POINTS)))
        .groupBy(*block, "_run").agg(F.collect_list(F.struct(*points.columns)).alias("_held"), *bounds)
    )
    sides = dealt(listed, held, "_bb", "_nb", "_bp", "_np").select(*block, *held)
    sides = sides.repartition(parts, *block).sortWithinPartitions(*block, "lat_min", "lon_min")
    touch, inside = F.lit(True), F.lit(True)
    for c in ("lat", "lon"):
        low, high = F.col(f"{c}_min") - m, F.col(f"{c}_max") + m
        touch = touch & (F.col(f"_{c}_most") >= low) & (F.col(f"_{c}_least") <= high)
        inside = inside & (F.col(c) >= low) & (F.col(c) <= high)
    pairs = join_listed(runs, sides, block).where(touch).select(F.explode("_held").alias("_p"), *held)
    return pairs.select("_p.*", *held).where(inside)


def points_in_dated_boxes(
    points: DataFrame, boxes: DataFrame, *, cell: float = 1.0
) -> DataFrame:
    """Pairs in space and time: ``day`` of the point in [``day_from``, ``day_to``] of the box."""
    dated = boxes.withColumn("day", F.explode(F.sequence("day_from", "day_to")))
    return points_in_boxes(points, dated, on=("day",), cell=cell)


def reach_degrees(lat: Column, radius_m: float) -> tuple[Column, Column]:
    """Half height and half width in degrees of a box that holds the circle around a point."""
    dlat = F.lit(radius_m / C.METRES_PER_DEGREE * 1.001)
    widest = F.greatest(F.cos(F.radians(F.least(F.abs(lat) + dlat, F.lit(90.0)))), F.lit(1e-6))
    return dlat, dlat / widest


#: Sides of a cell in radii and of a time step in windows. A row is listed under about 1.5 of them in each direction.
CELL_RADII, STEP_WINDOWS = 4.0, 4


def near_in_space_and_time(
    left: DataFrame,
    right: DataFrame,
    *,
    left_id: str,
    radius_m: float,
    window_s: int,
) -> DataFrame:
    """Distinct ``left_id`` with a right row within ``radius_m`` metres and ``window_s`` seconds.

    Both sides carry ``lat``, ``lon``, ``ts``. The left rows are listed under the cells and time
    steps their reach touches; a semi-join stops at the first partner. Cells and steps are wider than
    the reach, so that a row is listed under few of them.
    """
    cell = max(radius_m / C.METRES_PER_DEGREE * CELL_RADII, 0.001)
    reach, step = F.lit(max(window_s, 1) * 1_000_000), F.lit(max(window_s, 1) * STEP_WINDOWS * 1_000_000)
    dlat, dlon = reach_degrees(F.col("lat"), radius_m)
    at = micros("ts")
    lo = (
        left.select(left_id, "lat", "lon", at.alias("_t"))
        .withColumn("_cy", cell_steps(F.col("lat") - dlat, F.col("lat") + dlat, cell))
        .withColumn("_cx", cell_steps(F.col("lon") - dlon, F.col("lon") + dlon, cell))
        .withColumn(
            "_ct",
            F.explode(
                F.sequence(F.floor((F.col("_t") - reach) / step), F.floor((F.col("_t") + reach) / step))
            ),
        )
    )
    ro = right.select(
        F.col("lat").alias("_rlat"),
        F.col("lon").alias("_rlon"),
        at.alias("_rt"),
        geo.cell_of(F.col("lat"), cell).alias("_cy"),
        geo.cell_of(F.col("lon"), cell).alias("_cx"),
        F.floor(at / step).alias("_ct"),
    )
    keys = ["_cy", "_cx", "_ct"]
    close = (
        F.abs(F.col("_t") - F.col("_rt")) <= F.lit(window_s * 1_000_000)
    ) & (geo.haversine_m(F.col("lat"), F.col("lon"), F.col("_rlat"), F.col("_rlon")) <= radius_m)
    cond = close
    for k in keys:
        cond = cond & (lo[k] == ro[k])
    return lo.join(ro.hint("merge"), cond, "left_semi").select(left_id).distinct()


def far_in_space_and_time(left: DataFrame, right: DataFrame, *, radius_m: float, window_s: int) -> DataFrame:
    """Left rows without a right row within ``radius_m`` metres and ``window_s`` seconds.

    Both sides carry ``lat``, ``lon``, ``ts``; left rows that lack one are far from all. Here the right rows are listed
    under the cells and time steps that they can be reached from, as they travel without their other columns. A left
    row has one place and is shuffled once, with the columns that the caller reads. The hash of a place is
    the key: what else meets there by chance is not close.
    """
    cell = max(radius_m / C.METRES_PER_DEGREE * CELL_RADII, 0.001)
    reach, step = F.lit(max(window_s, 1) * 1_000_000), F.lit(max(window_s, 1) * STEP_WINDOWS * 1_000_000)
    place = F.xxhash64("_cy", "_cx", "_ct").alias("_place")
    at = micros("ts")
    dlat, dlon = reach_degrees(F.col("_rlat"), radius_m)
    ro = (
        right.select(F.col("lat").alias("_rlat"), F.col("lon").alias("_rlon"), at.alias("_rt"))
        .withColumn("_cy", cell_steps(F.col("_rlat") - dlat, F.col("_rlat") + dlat, cell))
        .withColumn("_cx", cell_steps(F.col("_rlon") - dlon, F.col("_rlon") + dlon, cell))
        .withColumn("_ct", F.explode(F.sequence(F.floor((F.col("_rt") - reach) / step), F.floor((F.col("_rt") + reach) / step))))
        .select(place, "_rlat", "_rlon", "_rt")
    )
    own = F.xxhash64(geo.cell_of(F.col("lat"), cell), geo.cell_of(F.col("lon"), cell), F.floor(at / step))
    lo = left.withColumn("_own", own)
    close = (F.abs(at - F.col("_rt")) <= F.lit(window_s * 1_000_000)) & (
        geo.haversine_m(F.col("lat"), F.col("lon"), F.col("_rlat"), F.col("_rlon")) <= radius_m
    )
    return lo.join(ro.hint("merge"), (F.col("_own") == F.col("_place")) & close, "left_anti").drop("_own")
