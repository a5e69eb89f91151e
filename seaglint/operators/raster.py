"""Radar tiles: long-form SQL operators and array jobs over tile tables.

A tile table has one row per window (``tile_id, h, w, dtype, data``), so Spark spreads tiles over
tasks and each task works on one window at a time. The long form (``tile, y, x, v``) expresses
the same rules as joins, aggregates and windows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seaglint import config as C
from seaglint.session import ship_package
from seaglint.schemas import RASTER

# --- scalars on pixel columns ------------------------------------------------------------


def calibrate_sigma0(dn: Column, lut: Column, noise: Column | None = None) -> Column:
    """max(DN² - noise, 0) / LUT², with 1e-10 in place of a zero LUT value."""
    power = dn.cast("double") * dn.cast("double")
    if noise is not None:
        power = F.greatest(power - F.coalesce(noise, F.lit(0.0)), F.lit(0.0))
    safe = F.when(lut == 0, F.lit(1e-10)).otherwise(lut)
    return power / (safe * safe)


def to_db(value: Column, floor_only: bool = False) -> Column:
    """10·log10; the small term is added, or is a floor in the second form."""
    tiny = F.lit(1e-10)
    return F.lit(10.0) * F.log10(F.greatest(value, tiny) if floor_only else value + tiny)


def db_to_uint8(db: Column) -> Column:
    cut = F.least(F.lit(C.DB_MAX), F.greatest(F.lit(C.DB_MIN), db))
    return ((cut - C.DB_MIN) / (C.DB_MAX - C.DB_MIN) * 255.0).cast("int")


# --- long form ---------------------------------------------------------------------------


def percentile_stretch(pixels: DataFrame, keys: list[str], value: str = "v") -> DataFrame:
    """Clip to the 1st and 99th percentile of the tile and scale to 0..255; flat tiles give 0."""
    p = F.percentile(value, F.array(F.lit(0.01), F.lit(0.99)))
    bounds = pixels.groupBy(*keys).agg(p.alias("_p"))
    lo, hi = F.col("_p")[0], F.col("_p")[1]
    cut = F.least(hi, F.greatest(lo, F.col(value).cast("double")))
    out = F.coalesce(F.try_divide(cut - lo, hi - lo) * 255.0, F.lit(0.0)).cast("int")
    return pixels.join(bounds, keys).withColumn("stretched", out).drop("_p")


def minmax_stretch(pixels: DataFrame, keys: list[str], value: str = "v") -> DataFrame:
    ends = pixels.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    out = F.try_divide(F.col(value) - F.col("_lo"), F.col("_hi") - F.col("_lo")) * 255.0
    return (
        pixels.join(ends, keys)
        .withColumn("stretched", F.coalesce(out, F.lit(0.0)).cast("int"))
        .drop("_lo", "_hi")
    )


def cdf_equalize(pixels: DataFrame, keys: list[str], value: str = "v") -> DataFrame:
    """Histogram equalisation: running share of each level times 255 (256 levels per tile)."""
    hist = pixels.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    run = F.sum("_n").over(Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("_n").over(Window.partitionBy(*keys))
    table = hist.withColumn("equalized", (run * 255.0 / total).cast("int")).drop("_n")
    return pixels.join(table, [*keys, value])


def lee_long(pixels: DataFrame, tile: str = "tile", value: str = "v", k: int = C.LEE_KERNEL) -> DataFrame:
    """Lee filter on the long form: box means as two one-dimensional windows.

    Edge rows and columns are mirrored first. Frames hold k rows; a tile line bounds a window.
    """
    if k < 1 or k % 2 == 0:
        raise ValueError("kernel size must be odd")
    r = k // 2
    size = pixels.groupBy(tile).agg((F.max("y") + 1).alias("_h"), (F.max("x") + 1).alias("_w"))
    base = pixels.join(size, tile).select(tile, "y", "x", F.col(value).cast("double").alias("_v"), "_h", "_w")

    def mirrored(df, axis, dim):
        c, n = F.col(axis), F.col(dim)
        places = F.filter(F.array(c, -c - 1, 2 * n - 1 - c), lambda p: (p >= -r) & (p < n + r))
        return df.withColumn(axis, F.explode(F.array_distinct(places)))

    wide = mirrored(base, "x", "_w")
    wx = Window.partitionBy(tile, "y").orderBy("x").rowsBetween(-r, r)
    rows = wide.select(
        tile, "y", "x", "_h", "_w", "_v",
        F.sum("_v").over(wx).alias("_s"), F.sum(F.col("_v") * F.col("_v")).over(wx).alias("_q"),
    ).where((F.col("x") >= 0) & (F.col("x") < F.col("_w")))
    tall = mirrored(rows, "y", "_h")
    wy = Window.partitionBy(tile, "x").orderBy("y").rowsBetween(-r, r)
    n = float(k * k)
    stats = tall.select(
        tile, "y", "x", "_h", "_v",
        (F.sum("_s").over(wy) / n).alias("_mean"), (F.sum("_q").over(wy) / n).alias("_sq"),
    ).where((F.col("y") >= 0) & (F.col("y") < F.col("_h")))
    stats = stats.withColumn("_var", F.greatest(F.col("_sq") - F.col("_mean") * F.col("_mean"), F.lit(0.0)))
    noise = stats.groupBy(tile).agg(F.avg("_var").alias("_noise"))
    weight = F.coalesce(
        F.try_divide(
            F.greatest(F.col("_var") - F.col("_noise"), F.lit(0.0)), F.greatest(F.col("_var"), F.col("_noise"))
        ),
        F.lit(0.0),
    )
    out = F.col("_mean") + weight * (F.col("_v") - F.col("_mean"))
    return stats.join(noise, tile).select(tile, "y", "x", out.alias("lee"))


def lut_interpolate(points: DataFrame, lut: DataFrame) -> DataFrame:
    """Bilinear LUT value at (``line``, ``pixel``) of a scene, linear beyond the outer nodes.

    Points of a scene without a table have a null value.
    The node positions of a scene are a short list; the four corner values come by equi-join.
    """
    axes = lut.groupBy("scene_id").agg(
        F.array_sort(F.collect_set("line")).alias("_ls"), F.array_sort(F.collect_set("pixel")).alias("_ps")
    )
    place = lut.join(axes, "scene_id").select(
        "scene_id",
        (F.array_position("_ls", F.col("line")) - 1).alias("i"),
        (F.array_position("_ps", F.col("pixel")) - 1).alias("j"),
        "line",
        "pixel",
        F.col("value").cast("double").alias("value"),
    )
    corner = F.explode(
        F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)])
    )
    spread = place.withColumn("k", corner).select(
        "scene_id",
        (F.col("i") - F.col("k.a")).alias("i"),
        (F.col("j") - F.col("k.b")).alias("j"),
        "k", "line", "pixel", "value",
    )

    def at(col, a, b):
        return F.max(F.when((F.col("k.a") == a) & (F.col("k.b") == b), F.col(col)))

    cells = spread.groupBy("scene_id", "i", "j").agg(
        F.count("*").alias("_n"),
        at("line", 0, 0).alias("y0"), at("line", 1, 0).alias("y1"),
        at("pixel", 0, 0).alias("x0"), at("pixel", 0, 1).alias("x1"),
        at("value", 0, 0).alias("v00"), at("value", 0, 1).alias("v01"),
        at("value", 1, 0).alias("v10"), at("value", 1, 1).alias("v11"),
    ).where("_n = 4").drop("_n")

    def step(nodes, v):
        below = F.size(F.filter(F.col(nodes), lambda n: n <= F.col(v))) - 1
        return F.greatest(F.lit(0), F.least(below, F.size(nodes) - 2)).cast("bigint")

    hit = (
        points.join(axes, "scene_id", "left")
        .withColumn("i", step("_ls", "line"))
        .withColumn("j", step("_ps", "pixel"))
        .join(cells, ["scene_id", "i", "j"], "left")
    )
    fy = (F.col("line") - F.col("y0")) / (F.col("y1") - F.col("y0"))
    fx = (F.col("pixel") - F.col("x0")) / (F.col("x1") - F.col("x0"))
    value = (
        F.col("v00") * (1 - fy) * (1 - fx)
        + F.col("v01") * (1 - fy) * fx
        + F.col("v10") * fy * (1 - fx)
        + F.col("v11") * fy * fx
    )
    return hit.select(*points.columns, value.alias("lut"))


# --- array kernels (one window each) -----------------------------------------------------


def _mirror(a: np.ndarray, r: int) -> np.ndarray:
    return np.pad(a, r, mode="symmetric")


def box_mean(a: np.ndarray, k: int) -> np.ndarray:
    r = k // 2
    p = _mirror(np.asarray(a, dtype=float), r)
    rows = sum(p[:, i : i + a.shape[1]] for i in range(k))
    return sum(rows[i : i + a.shape[0]] for i in range(k)) / float(k * k)


def lee_filter(a: np.ndarray, k: int = C.LEE_KERNEL, eps: float = 0.0) -> np.ndarray:
    """Speckle filter; ``eps`` is added to the noise floor in the divisor."""
    if k < 1 or k % 2 == 0:
        raise ValueError("kernel size must be odd")
    mean = box_mean(a, k)
    var = np.maximum(box_mean(np.square(a, dtype=float), k) - mean * mean, 0.0)
    noise = var.mean()
    base = np.maximum(var, noise + eps)
    weight = np.divide(np.maximum(var - noise, 0.0), base, out=np.zeros_like(var), where=base > 0)
    return mean + weight * (a - mean)


def sigma0(dn: np.ndarray, lut: np.ndarray, noise: np.ndarray | None = None) -> np.ndarray:
    power = np.square(dn.astype(float))
    if noise is not None:
        power = np.maximum(power - noise, 0.0)
    return power / np.square(np.where(lut == 0, 1e-10, lut))


def decibel(a: np.ndarray) -> np.ndarray:
    return 10.0 * np.log10(a + 1e-10)


def db_bytes(db: np.ndarray) -> np.ndarray:
    return ((db.clip(C.DB_MIN, C.DB_MAX) - C.DB_MIN) / (C.DB_MAX - C.DB_MIN) * 255.0).astype(np.uint8)


def percentile_bytes(a: np.ndarray) -> np.ndarray:
    lo, hi = np.percentile(a, [1, 99])
    if hi <= lo:
        return np.zeros(a.shape, dtype=np.uint8)
    return ((a.clip(lo, hi) - lo) / (hi - lo) * 255.0).astype(np.uint8)


def equalized_bytes(a: np.ndarray) -> np.ndarray:
    """Min-max stretch to 256 levels, then map every level to its running share."""
    lo, hi = a.min(), a.max()
    level = ((a - lo) / (hi - lo) * 255.0).astype(np.uint8) if hi > lo else np.zeros(a.shape, np.uint8)
    run = np.bincount(level.ravel(), minlength=256).cumsum()
    return (run * 255 / run[-1]).astype(np.uint8)[level]


def clahe(a: np.ndarray, clip: float = 4.0, grid: int = 8) -> np.ndarray:
    """Contrast-limited equalisation on a grid of cells, blended between cell centres.

    Sides that are no multiple of the grid are padded with edge pixels and cut back.
    """
    h, w = a.shape
    ch, cw = -(-h // grid), -(-w // grid)
    p = np.pad(a, ((0, ch * grid - h), (0, cw * grid - w)), mode="edge")
    cell_id = (np.arange(ch * grid) // ch)[:, None] * grid + (np.arange(cw * grid) // cw)[None, :]
    hist = np.bincount((cell_id * 256 + p).ravel(), minlength=grid * grid * 256).astype(float).reshape(-1, 256)
    ceiling = max(1, int(clip * ch * cw / 256.0))
    excess = np.maximum(hist - ceiling, 0.0).sum(axis=1, keepdims=True)
    run = np.cumsum(np.minimum(hist, ceiling) + excess / 256.0, axis=1)
    span = run[:, -1:] - run[:, :1]
    scaled = np.where(span > 0, (run - run[:, :1]) / np.where(span > 0, span, 1.0) * 255.0, run)
    table = scaled.reshape(grid, grid, 256)

    def axis(n, step):
        pos = np.arange(n) / step - 0.5
        low = np.clip(np.floor(pos).astype(int), 0, grid - 2)
        return low, np.clip(pos - low, 0.0, 1.0)

    (iy, fy), (ix, fx) = axis(ch * grid, ch), axis(cw * grid, cw)
    total = np.zeros(p.shape)
    for dy, wy in ((0, 1 - fy), (1, fy)):
        for dx, wx in ((0, 1 - fx), (1, fx)):
            total += wy[:, None] * wx[None, :] * table[(iy + dy)[:, None], (ix + dx)[None, :], p]
    return total.clip(0, 255).astype(np.uint8)[:h, :w]


def gaussian_blur(a: np.ndarray, sigma: float = 1.1, truncate: float = 4.0) -> np.ndarray:
    """Two one-dimensional passes on bytes; each pass is cut back to bytes."""
    r = int(truncate * sigma + 0.5)
    x = np.arange(-r, r + 1)
    kernel = np.exp(-0.5 * (x / sigma) ** 2)
    kernel /= kernel.sum()
    out = a
    for axis in (0, 1):
        pad = [(r, r) if i == axis else (0, 0) for i in (0, 1)]
        p = np.pad(out.astype(float), pad, mode="symmetric")
        n = out.shape[axis]
        out = sum(k * np.take(p, range(i, i + n), axis=axis) for i, k in enumerate(kernel)).astype(np.uint8)
    return out


def median_blur(a: np.ndarray, k: int = 5) -> np.ndarray:
    if k < 3 or k % 2 == 0:
        raise ValueError("kernel size must be odd and at least 3")
    views = np.lib.stride_tricks.sliding_window_view(_mirror(a, k // 2), (k, k))
    return np.median(views, axis=(2, 3)).astype(np.uint8)


def pad_tile(a: np.ndarray, size: int = C.TILE_SIZE, edge: bool = True) -> np.ndarray:
    """Fill a smaller tile up to ``size`` with its edge values or with zeros."""
    pad = [(0, max(0, size - n)) for n in a.shape]
    return np.pad(a, pad, mode="edge") if edge else np.pad(a, pad)


# Operations that can be named in a job.
RASTER_OPS: dict[str, Callable[[np.ndarray], np.ndarray]] = {
    "clahe": clahe,
    "blur": gaussian_blur,
    "median": median_blur,
}


def register_raster_op(name: str, fn: Callable[[np.ndarray], np.ndarray]) -> None:
    RASTER_OPS[name] = fn


def run_chain(code: str, dn: np.ndarray, lut: np.ndarray, noise: np.ndarray | None = None) -> np.ndarray:
    """Processing chain A..E on one window."""
    if code == "A":
        return percentile_bytes(dn.astype(float))
    s = sigma0(dn, lut, noise)
    if code == "B":
        return db_bytes(decibel(s))
    s = decibel(lee_filter(s))
    if code == "C":
        return db_bytes(s)
    out = equalized_bytes(s)
    if code == "E":
        for op in ("clahe", "blur", "median"):
            out = RASTER_OPS[op](out)
    elif code != "D":
        raise ValueError(f"unknown processing code {code}")
    return out


def interpolate_grid(lines, pixels, values, rows, cols) -> np.ndarray:
    """Bilinear values on a window, linear beyond the outer nodes.

    Each line has its own ``pixels`` and ``values``: it is interpolated along its own nodes first.
    """

    def place(nodes, want):
        nodes = np.asarray(nodes, dtype=float)
        i = np.clip(np.searchsorted(nodes, want, side="right") - 1, 0, len(nodes) - 2)
        return i, (want - nodes[i]) / (nodes[i + 1] - nodes[i])

    along = []
    for nodes, held in zip(pixels, values, strict=True):
        v = np.asarray(held, dtype=float)
        j, fx = place(nodes, cols)
        along.append(v[j] * (1 - fx) + v[j + 1] * fx)
    i, fy = place(lines, rows)
    along, fy = np.stack(along), fy[:, None]
    return along[i] * (1 - fy) + along[i + 1] * fy


# --- tile-table jobs ---------------------------------------------------------------------


def _pixels(row) -> np.ndarray:
    return np.frombuffer(row.data, dtype=row.dtype).reshape(row.h, row.w)


#: Most tiles in an Arrow batch. Each Python worker of a chain of jobs holds a batch and its copy in pandas.
BATCH_TILES = 512


def in_batches(tiles: DataFrame) -> DataFrame:
    """The tiles, of which Python workers of the session get ``BATCH_TILES`` at a time at most."""
    key, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", tiles.sparkSession.conf
    if not 0 < int(conf.get(key)) <= BATCH_TILES:
        conf.set(key, str(BATCH_TILES))
    return tiles


def map_tiles(tiles: DataFrame, fn: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Apply a window function to every tile."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                out = np.ascontiguousarray(fn(_pixels(row)))
                yield pd.DataFrame(
                    [(row.tile_id, out.shape[0], out.shape[1], str(out.dtype), out.tobytes())],
                    columns=["tile_id", "h", "w", "dtype", "data"],
                )

    return in_batches(tiles).select("tile_id", "h", "w", "dtype", "data").mapInPandas(run, RASTER)


def pack_tiles(rows: DataFrame, keys: list[str], dtype: str = "uint16") -> DataFrame:
    """Tile table from pixel lines (``keys``, ``y``, ``values`` array): lines are stacked by y.

    A tile's height bounds the group.
    """
    lines = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("y", "values"))).alias("_l"))
    flat = F.flatten(F.transform("_l", lambda s: s["values"]))
    cols = lines.select(*keys, F.size("_l").alias("h"), F.size(F.col("_l")[0]["values"]).alias("w"), flat.alias("_v"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["dtype"] = dtype
            pdf["data"] = [np.asarray(v, dtype=dtype).tobytes() for v in pdf.pop("_v")]
            yield pdf

    kinds = dict(cols.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in (*keys, "h", "w")) + ", dtype string, data binary"
    return in_batches(cols).mapInPandas(run, schema)


#: Pixels of a batch that ``unpack_tiles`` gives back.
BATCH_PIXELS = 65_536


def unpack_tiles(tiles: DataFrame, keys: list[str]) -> DataFrame:
    """Long form (``keys``, y, x, v) of a tile table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, w, dtype = (batch.column(c).to_pylist() for c in ("h", "w", "dtype"))
            for i, data in enumerate(batch.column("data")):
                v = np.frombuffer(data.as_buffer(), dtype=dtype[i]).reshape(h[i] * w[i])
                for lo in range(0, len(v), BATCH_PIXELS):
                    some = v[lo : lo + BATCH_PIXELS].astype("int64")
                    y, x = np.divmod(np.arange(lo, lo + len(some), dtype="int64"), w[i])
                    same = [pa.repeat(batch.column(k)[i], len(some)) for k in keys]
                    yield pa.RecordBatch.from_arrays([*same, pa.array(y), pa.array(x), pa.array(some)], names=[*keys, "y", "x", "v"])

    kinds = dict(tiles.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", y bigint, x bigint, v bigint"
    return in_batches(tiles).select(*keys, "h", "w", "dtype", "data").mapInArrow(run, schema)


def lut_windows(tiles: DataFrame, vectors: DataFrame, prefix: str) -> DataFrame:
    """Attach to each tile just the LUT nodes its window needs.

    ``vectors``: scene_id, line, pixels array, values array. A tile row carries a few short
    lists instead of the scene's whole table.
    """
    axis = vectors.groupBy("scene_id").agg(F.array_sort(F.collect_set("line")).alias("_ls"))
    t = tiles.select("scene_id", "tile_id", "py0", "py1", "px0", "px1").join(axis, "scene_id")

    def bracket(nodes, low, high):
        n = F.size(nodes)
        first = F.greatest(F.lit(0), F.least(F.size(F.filter(nodes, lambda v: v <= low)) - 1, n - 2))
        last = F.greatest(F.size(F.filter(nodes, lambda v: v < high)), first + 1)
        return first, F.least(last, n - 1)

    i0, i1 = bracket(F.col("_ls"), F.col("py0"), F.col("py1") - 1)
    needed = t.withColumn("line", F.explode(F.slice("_ls", i0 + 1, i1 - i0 + 1))).drop("_ls")
    v = needed.join(vectors, ["scene_id", "line"])
    j0, j1 = bracket(F.col("pixels"), F.col("px0"), F.col("px1") - 1)
    v = v.select(
        "tile_id", "line",
        F.slice("pixels", j0 + 1, j1 - j0 + 1).alias("_p"), F.slice("values", j0 + 1, j1 - j0 + 1).alias("_v"),
    )
    return v.groupBy("tile_id").agg(
        F.sort_array(F.collect_list(F.struct("line", "_p", "_v"))).alias("_all")
    ).select(
        "tile_id",
        F.transform("_all", lambda s: s["line"].cast("double")).alias(f"{prefix}_lines"),
        F.transform("_all", lambda s: F.transform(s["_p"], lambda p: p.cast("double"))).alias(f"{prefix}_pixels"),
        F.transform("_all", lambda s: s["_v"]).alias(f"{prefix}_values"),
    )


def run_chains(
    windows: DataFrame, sigma: DataFrame, noise: DataFrame | None = None, codes: tuple[str, ...] = tuple(C.PROCESSING_CODES)
) -> DataFrame:
    """All named chains in one pass over padded windows, cut back to the tile.

    Chain A needs no calibration. The others have no row for a tile whose scene has no calibration
    vectors; ``uncalibrated`` lists those tiles. ``windows``: tile table plus scene_id, tile_no, the padded window (py0, py1, px0, px1) and the
    tile itself (y0, y1, x0, x1). Windows with too many empty pixels are dropped first.
    """
    ship_package(windows.sparkSession)
    if set(codes) == {"A"}:
        joined = windows.withColumn("s_lines", F.lit(None).cast("array<double>"))
    else:
        joined = windows.join(lut_windows(windows, sigma, "s"), "tile_id", "left")
    if noise is not None:
        joined = joined.join(lut_windows(windows, noise, "n"), "tile_id", "left")
    has_noise = noise is not None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                dn = _pixels(r)
                if (dn == 0).mean() > C.NODATA_LIMIT:
                    continue
                rows, cols = np.arange(r.py0, r.py1), np.arange(r.px0, r.px1)
                lut = extra = None
                if r.s_lines is not None:
                    lut = interpolate_grid(r.s_lines, r.s_pixels, r.s_values, rows, cols)
                if has_noise and r.n_lines is not None:
                    extra = interpolate_grid(r.n_lines, r.n_pixels, r.n_values, rows, cols)
                for code in codes:
                    if lut is None and code != "A":
                        continue
                    out = run_chain(code, dn, lut, extra)
                    out = np.ascontiguousarray(out[r.y0 - r.py0 : r.y1 - r.py0, r.x0 - r.px0 : r.x1 - r.px0])
                    yield pd.DataFrame(
                        [(r.scene_id, code, f"{r.scene_id}_{code}_tile{r.tile_no:04d}", r.tile_no, *out.shape, "uint8", out.tobytes())],
                        columns=["scene_id", "code", "tile_id", "tile_no", "h", "w", "dtype", "data"],
                    )

    return joined.mapInPandas(
        run, "scene_id string, code string, tile_id string, tile_no bigint, h int, w int, dtype string, data binary"
    )


def uncalibrated(windows: DataFrame, sigma: DataFrame) -> DataFrame:
    """Tiles (scene_id, tile_id, tile_no) whose scene has no calibration vectors."""
    return windows.select("scene_id", "tile_id", "tile_no").join(sigma.select("scene_id").distinct(), "scene_id", "left_anti")


def assemble_windows(
    blocks: DataFrame, size: int = C.TILE_SIZE, stride: int = C.TILE_STRIDE, halo: int = C.HALO, block: int = 256
) -> DataFrame:
    """Cut padded tile windows from scene blocks in one shuffle.

    ``blocks``: scene_id, height, width (of the scene), by, bx, h, w, dtype, data. Each block is
    sent to the tiles whose window it touches; a window holds a fixed number of blocks.
    """
    s = F.lit(stride)

    def touched(index, length, dim):
        top = F.col(index) * block
        first = F.greatest(F.lit(0), F.floor((top - F.lit(size + halo)) / s) + 1)
        last = F.least(F.ceil(F.col(dim) / s) - 1, F.ceil((top + F.col(length) + halo) / s) - 1)
        return F.explode(F.when(first <= last, F.sequence(first, last)))

    spread = blocks.withColumn("tr", touched("by", "h", "height")).withColumn("tc", touched("bx", "w", "width"))

    def stitch(pdf: pd.DataFrame) -> pd.DataFrame:
        one = pdf.iloc[0]
        y0, x0 = int(one.tr) * stride, int(one.tc) * stride
        y1, x1 = min(y0 + size, int(one.height)), min(x0 + size, int(one.width))
        py0, px0 = max(0, y0 - halo), max(0, x0 - halo)
        py1, px1 = min(int(one.height), y1 + halo), min(int(one.width), x1 + halo)
        out = np.zeros((py1 - py0, px1 - px0), dtype=one["dtype"])
        for r in pdf.itertuples(index=False):
            a = _pixels(r)
            top, left = r.by * block, r.bx * block
            t0, t1 = max(py0, top), min(py1, top + r.h)
            l0, l1 = max(px0, left), min(px1, left + r.w)
            if t0 < t1 and l0 < l1:
                out[t0 - py0 : t1 - py0, l0 - px0 : l1 - px0] = a[t0 - top : t1 - top, l0 - left : l1 - left]
        tile_no = int(one.tr) * -(-int(one.width) // stride) + int(one.tc)
        return pd.DataFrame(
            [(one.scene_id, f"{one.scene_id}_{tile_no:06d}", tile_no, y0, y1, x0, x1, py0, py1, px0, px1, *out.shape, one["dtype"], out.tobytes())],
            columns=["scene_id", "tile_id", "tile_no", "y0", "y1", "x0", "x1", "py0", "py1", "px0", "px1", "h", "w", "dtype", "data"],
        )

    return spread.groupBy("scene_id", "tr", "tc").applyInPandas(
        stitch,
        "scene_id string, tile_id string, tile_no bigint, y0 int, y1 int, x0 int, x1 int, "
        "py0 int, py1 int, px0 int, px1 int, h int, w int, dtype string, data binary",
    )


def enhance_tiles(tiles: DataFrame, ops: list[str], code: str = "E") -> DataFrame:
    """Named operations in the given order on every tile; ids get the output code."""
    from seaglint.functions.names import derived_tile_id

    chosen = [RASTER_OPS[o] for o in ops]

    def run(a: np.ndarray) -> np.ndarray:
        out = a if a.dtype == np.uint8 else a.clip(0, 255).astype(np.uint8)
        for op in chosen:
            out = op(out)
        return out

    return map_tiles(tiles, run).withColumn("tile_id", derived_tile_id(F.col("tile_id"), code))
