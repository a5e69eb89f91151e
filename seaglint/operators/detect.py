"""Predictions per tile: decoding, overlap suppression, label matching, scoring with a model."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seaglint import config as C
from seaglint.functions import boxes as B
from seaglint.operators.ranking import numbered
from seaglint.operators.spatial import join_listed
from seaglint.session import ensure_checkpoint_dir, saved, ship_package

CORNERS = ("x1", "y1", "x2", "y2")
CENTRE = ("cx", "cy", "w", "h")


def decode_predictions(raw: DataFrame, min_confidence: float = C.DETECTOR_CONFIDENCE) -> DataFrame:
    """Raw model output to one row per candidate.

    ``output`` is ``array<array<double>>``: five rows (cx, cy, w, h, confidence) of N columns, or
    N rows of 5 + classes. In row form the confidence test comes before the class factor.
    """
    o = F.col("output")
    by_column = F.size(o) == 5
    keep = [c for c in raw.columns if c != "output"]
    cols = raw.where(by_column).select(
        *keep, F.posexplode(F.arrays_zip(*[o[i].alias(n) for i, n in enumerate(["cx", "cy", "w", "h", "conf"])]))
    )
    cols = cols.select(*keep, F.col("pos").alias("idx"), *[F.col("col")[n].alias(n) for n in ("cx", "cy", "w", "h", "conf")])
    cols = cols.withColumn("score", F.col("conf"))
    rows = raw.where(~by_column).select(*keep, F.posexplode(o).alias("idx", "r"))
    r = F.col("r")
    rows = rows.select(
        *keep,
        "idx",
        *[r[i].alias(n) for i, n in enumerate(["cx", "cy", "w", "h", "conf"])],
        B.row_score(r[4], F.slice(r, 6, F.greatest(F.size(r) - 5, F.lit(0)))).alias("score"),
    )
    return cols.unionByName(rows).where(F.col("conf") >= min_confidence).drop("conf")


# --- suppression -------------------------------------------------------------------------


def usable(df: DataFrame, *names: str, tile: str = "tile_id") -> Column:
    """Whether a box takes part: tile, box_id and the named numbers are there, and no number is NaN.

    Suppression and matching leave all other rows out, whatever the size of the tile.
    """
    kind = dict(df.dtypes)
    ok = F.col(tile).isNotNull() & F.col("box_id").isNotNull()
    for n in names:
        ok = ok & F.col(n).isNotNull()
        if kind[n] in ("double", "float"):
            ok = ok & ~F.isnan(n)
    return ok


def runs_of(columns: list[pa.Array]) -> Iterator[tuple[int, int]]:
    """Borders [lo, hi) of rows that stand together and have equal values."""
    n = len(columns[0])
    differ = np.zeros(max(n - 1, 0), dtype=bool)
    for c in columns:
        differ |= pc.not_equal(c.slice(1), c.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    cuts = (np.flatnonzero(differ) + 1).tolist()
    return zip([0, *cuts], [*cuts, n], strict=True)


def _overlaps(a: np.ndarray, b: np.ndarray, centre: bool) -> np.ndarray:
    """Overlap of corner boxes, in the form the caller's rule uses; arrays broadcast."""
    iw = np.maximum(0.0, np.minimum(a[..., 2], b[..., 2]) - np.maximum(a[..., 0], b[..., 0]))
    ih = np.maximum(0.0, np.minimum(a[..., 3], b[..., 3]) - np.maximum(a[..., 1], b[..., 1]))
    inter = iw * ih
    area_a = (a[..., 2] - a[..., 0]) * (a[..., 3] - a[..., 1])
    area_b = (b[..., 2] - b[..., 0]) * (b[..., 3] - b[..., 1])
    union = area_a + area_b - inter
    if not centre:
        return inter / (union + 1e-6)
    return np.divide(inter, union, out=np.zeros_like(inter), where=union > 0)


#: Boxes that are compared at a time, and held boxes that they meet at a time.
BLOCK, KEPT_BLOCK = 256, 4096
#: Longest over shortest side in a size class, and cells of a block in each direction.
CLASS_BASE, BLOCK_CELLS = 16.0, 8
OPEN, KEPT, DROPPED = 0, 1, 2


class _Held:
    """Boxes in arrays of bounded size."""

    def __init__(self):
        self.parts: list[np.ndarray] = []

    def add(self, boxes: np.ndarray) -> None:
        if self.parts and len(self.parts[-1]) + len(boxes) <= KEPT_BLOCK:
            self.parts[-1] = np.concatenate([self.parts[-1], boxes])
        elif len(boxes):
            self.parts.append(boxes)


class _Fold:
    """Suppression in one block, whose boxes arrive in rank order: what can be told from here.

    An own box is kept if no box before it that overlaps it may be kept, and dropped if one is kept. Of a
    box from another block only the second can be told, as not all of its neighbours are here.
    """

    def __init__(self, limit: float, centre: bool):
        self.limit, self.centre, self.kept, self.open = limit, centre, _Held(), _Held()

    @property
    def idle(self) -> bool:
        """Whether no box was given yet."""
        return not (self.kept.parts or self.open.parts)

    def clash(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        o = _overlaps(a[:, None, :], b[None, :, :], self.centre)
        return o >= self.limit if self.centre else o > self.limit

    def take(self, corner: np.ndarray, own: np.ndarray) -> np.ndarray:
        """KEPT, DROPPED or OPEN for some boxes that follow those given before."""
        out = np.empty(len(corner), dtype=np.int8)
        for lo in range(0, len(corner), BLOCK):
            block, mine = corner[lo : lo + BLOCK], own[lo : lo + BLOCK]
            dropped = np.zeros(len(block), dtype=bool)
            for kept in self.kept.parts:
                dropped[~dropped] = self.clash(kept, block[~dropped]).any(axis=0)
            unsure = ~mine
            for held in self.open.parts:
                left = ~dropped & ~unsure
                unsure[left] = self.clash(held, block[left]).any(axis=0)
            at = np.flatnonzero(~dropped)
            table = np.triu(self.clash(block[at], block[at]), 1)
            gone, doubt = np.zeros(len(at), dtype=bool), unsure[at]
            for i in np.flatnonzero(table.any(axis=1)):
                if not gone[i]:
                    if doubt[i]:
                        doubt |= table[i]
                    else:
                        gone |= table[i]
            state = np.where(gone, DROPPED, np.where(doubt, OPEN, KEPT))
            self.kept.add(block[at[state == KEPT]])
            self.open.add(block[at[state == OPEN]])
            out[lo : lo + BLOCK] = DROPPED
            out[lo + at] = state
        return out


def _suppression_round(boxes: DataFrame, tile: str, limit: float, centre: bool) -> DataFrame:
    """What each block can tell of its boxes: columns of ``boxes``, ``state``, ``_own``, ``_block`` and ``_nth``.

    A box belongs to the block of its size class and centre, and is listed under all blocks that a box it
    overlaps can belong to. So the own block of a box sees all of its neighbours. Rows are the own boxes of
    each block and the dropped ones of others; ``_nth`` numbers the kept ones of a block.
    """
    base = max(CLASS_BASE, 1.01 / (limit * limit))
    around = (F.col("_b2") - F.col("_b0")).alias("w"), (F.col("_b3") - F.col("_b1")).alias("h")
    middle = ((F.col("_b0") + F.col("_b2")) / 2).alias("cx"), ((F.col("_b1") + F.col("_b3")) / 2).alias("cy")
    placed = _own_place(boxes.select("*", *middle, *around), base, BLOCK_CELLS)
    placed = placed.withColumnsRenamed({"_size": "_hs", "_gx": "_hx", "_gy": "_hy"})
    listed = _partner_places(placed, base, limit, BLOCK_CELLS)
    own = (F.col("_size") == F.col("_hs")) & (F.col("_gx") == F.col("_hx")) & (F.col("_gy") == F.col("_hy"))
    block, columns = [tile, "_size", "_gx", "_gy"], boxes.columns
    # The hash stands first, so that most comparisons of the sort end there.
    listed = listed.select(F.xxhash64(*block).alias("_block"), *columns, "_size", "_gx", "_gy", own.alias("_own"))
    corners = ["_b0", "_b1", "_b2", "_b3"]
    added = {"state": T.ByteType(), "_own": T.BooleanType(), "_block": T.LongType(), "_nth": T.LongType()}
    schema = T.StructType([*boxes.schema.fields, *[T.StructField(n, k) for n, k in added.items()]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, fold, count = None, None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(c) for c in block]
            corner = np.column_stack([batch.column(c).to_numpy() for c in corners])
            mine = batch.column("_own").to_numpy(zero_copy_only=False)
            state, nth = np.empty(len(mine), dtype=np.int8), np.zeros(len(mine), dtype=np.int64)
            for lo, hi in runs_of(keys):
                key = tuple(k[lo].as_py() for k in keys)
                if key != now:
                    now, fold, count = key, _Fold(limit, centre), 0
                if fold.idle and hi < len(mine) and not mine[lo:hi].any():
                    state[lo:hi] = OPEN  # a block of boxes from elsewhere only: it ends here and tells nothing
                    continue
                state[lo:hi] = fold.take(corner[lo:hi], mine[lo:hi])
                kept = state[lo:hi] == KEPT
                nth[lo:hi] = count + np.cumsum(kept)
                count += int(kept.sum())
            told = pa.array(mine | (state == DROPPED))
            out = [*[batch.column(c) for c in columns], pa.array(state), batch.column("_own"), batch.column("_block"), pa.array(nth)]
            yield pa.RecordBatch.from_arrays(out, names=[*columns, *added]).filter(told)

    ordered = listed.repartition("_block", *block).sortWithinPartitions("_block", *block, F.desc("score"), "box_id")
    return ordered.mapInArrow(run, schema)


def _suppress(boxes: DataFrame, tile: str, limit: float, centre: bool) -> DataFrame:
    """Suppression as a fixed point over the overlaps, the same for tiles of any size.

    Each round decides, block by block, all boxes whose verdict no other block can change; the others go to
    the next round without the kept and dropped ones. The first of the open boxes of a tile is decided in
    each round, and a tile that lies in one block needs one round. What a round tells is saved (``session.saved``).
    A tile whose kept boxes all lie in one block has its ranks from there; the others are numbered.
    """
    if limit <= 0:
        raise ValueError("the overlap limit must be above 0")
    ship_package(boxes.sparkSession)
    ensure_checkpoint_dir(boxes.sparkSession)
    c = B.corners(*[F.col(n) for n in CENTRE]) if centre else tuple(F.col(n) for n in CORNERS)
    slim = boxes.select(tile, "box_id", F.col("score").cast("double").alias("score"), *[c[i].cast("double").alias(f"_b{i}") for i in range(4)])
    slim = slim.where(usable(slim, "score", "_b0", "_b1", "_b2", "_b3", tile=tile))
    # Rows with equal values share their verdict but for the first, and meet in the same block.
    todo, kept = slim, None
    while True:
        told = saved(_suppression_round(todo, tile, limit, centre))
        own = told.where("_own")
        found = own.where(F.col("state") == KEPT).select(*slim.columns, "_block", "_nth")
        kept = found if kept is None else kept.unionByName(found)
        left = own.where(F.col("state") == OPEN).select(*slim.columns)
        if left.isEmpty():
            break
        dropped = told.where(~F.col("_own")).select(*slim.columns).distinct()
        todo = saved(left.join(dropped, slim.columns, "left_anti"))
    wide = kept.groupBy(tile).agg(F.min("_block").alias("lo"), F.max("_block").alias("hi")).where("lo <> hi").select(tile).checkpoint()
    narrow = kept.select(*slim.columns, F.col("_nth").alias("rank"))
    if wide.isEmpty():
        return narrow
    spread = kept.select(*slim.columns).join(wide, tile, "left_semi")
    ranked = numbered(spread, [tile], [-F.col("score"), "box_id", F.struct("_b0", "_b1", "_b2", "_b3")], "rank")
    return narrow.join(wide, tile, "left_anti").unionByName(ranked)


def nms_detector(
    boxes: DataFrame, tile: str = "tile_id", limit: float = C.DETECTOR_NMS_IOU
) -> DataFrame:
    """Greedy suppression of corner boxes: drop a box whose overlap with a kept one exceeds ``limit``.

    Boxes rank by score, then ``box_id``; ``rank`` numbers the kept ones per tile. Boxes without a
    tile, an id, a score or a corner, null or NaN, are left out (``usable``).
    """
    kept = _suppress(boxes, tile, limit, False)
    return kept.select(tile, "box_id", "score", *[F.col(f"_b{i}").alias(n) for i, n in enumerate(CORNERS)], "rank")


def nms_benchmark(
    boxes: DataFrame, tile: str = "tile_id", limit: float = C.BENCHMARK_NMS_IOU
) -> DataFrame:
    """Greedy suppression of centre boxes: keep a box while its overlap stays below ``limit``."""
    kept = _suppress(boxes, tile, limit, True)
    cx, cy = (F.col("_b0") + F.col("_b2")) / 2.0, (F.col("_b1") + F.col("_b3")) / 2.0
    return kept.select(
        tile, "box_id", "score", cx.alias("cx"), cy.alias("cy"),
        (F.col("_b2") - F.col("_b0")).alias("w"), (F.col("_b3") - F.col("_b1")).alias("h"), "rank",
    )


# --- overlap pairs -----------------------------------------------------------------------


def _size_class(side: Column, base: float) -> Column:
    return F.floor(F.log(F.greatest(side, F.lit(1e-6))) / F.lit(math.log(base)))


def _own_place(df: DataFrame, base: float, cells: int = 1) -> DataFrame:
    """Add the size class of the longer side and the grid place of the centre, ``cells`` longest sides wide.

    Places are moved by half their width, so that few boxes of a small tile stand at a border.
    """
    cell = F.pow(F.lit(base), F.col("_size") + 1) * F.lit(float(cells))
    return (
        df.withColumn("_size", _size_class(F.greatest("w", "h"), base))
        .withColumn("_gx", F.floor(F.col("cx") / cell + 0.5))
        .withColumn("_gy", F.floor(F.col("cy") / cell + 0.5))
    )


def _partner_places(df: DataFrame, base: float, t: float, cells: int = 1) -> DataFrame:
    """One row per place where a partner of overlap >= t can lie.

    Overlap t forces both sides within a factor t and the centres within (1 - t) of the longer
    side. Classes are a little wider than 1/t², so two of them hold all partners.
    """
    slack = 1 - 1e-9
    longer = F.greatest("w", "h", F.lit(1e-6))
    classes = F.array_distinct(
        F.array(_size_class(longer * F.lit(t * slack), base), _size_class(longer / F.lit(t * slack), base))
    )
    out = df.withColumn("_size", F.explode(classes))
    longest = F.pow(F.lit(base), F.col("_size") + 1)
    cell = longest * F.lit(float(cells))
    for centre, side, place in (("cx", "w", "_gx"), ("cy", "h", "_gy")):
        own = F.greatest(side, F.lit(1e-6))
        reach = F.greatest(own, F.least(longest, own / F.lit(t))) * F.lit((1 - t) / slack) + F.lit(1e-9)
        first, last = F.floor((F.col(centre) - reach) / cell + 0.5), F.floor((F.col(centre) + reach) / cell + 0.5)
        out = out.withColumn(place, F.explode(F.sequence(first, last)))
    return out


def iou_pairs(
    left: DataFrame,
    right: DataFrame,
    tile: str = "tile_id",
    threshold: float = C.MATCH_IOU,
    *,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """(left, right) box pairs of one tile with overlap >= ``threshold``.

    Both sides: ``tile``, ``box_id`` and a centre box; unusable boxes (``usable``) pair with nothing.
    The join is on size class and grid place inside the tile, so only boxes of like size and place
    meet, and a crowded tile spreads over many tasks. ``keep`` lists left columns to carry along.
    """
    # A wide class: most boxes find their partners in one, so that few places are listed, with more boxes in each.
    cells = 2
    left = left.where(usable(left, *CENTRE, tile=tile))
    right = right.where(usable(right, *CENTRE, tile=tile))
    base = (1.01 / (threshold * threshold)) ** 2
    places = ["_size", "_gx", "_gy"]

    def renamed(df, id_name, tag, extra=()):
        boxes = [F.col(c).alias(f"{tag}{c}") for c in CENTRE]
        return df.select(F.hash(tile, *places).alias("_place"), tile, F.col("box_id").alias(id_name), *extra, *boxes, *places)

    a = renamed(_own_place(left.select(tile, "box_id", *keep, *CENTRE), base, cells), "left_id", "_a_", keep)
    b = renamed(_partner_places(right.select(tile, "box_id", *CENTRE), base, threshold, cells), "right_id", "_b_")
    iou = B.iou_yolo(
        tuple(F.col(f"_a_{c}") for c in CENTRE), tuple(F.col(f"_b_{c}") for c in CENTRE)
    )
    return (
        join_listed(a, b, ["_place", tile, *places])  # the hash decides most comparisons of the sort
        .withColumn("iou", iou)
        .where(F.col("iou") >= threshold)
        .select(tile, "left_id", *keep, "right_id", "iou")
    )


# --- matching ----------------------------------------------------------------------------


def match_pairs(pairs: DataFrame, keys: list[str], *, best: bool) -> DataFrame:
    """One-to-one matching of overlapping pairs: ``keys``, rank, left_id, right_id, iou.

    Inside a key, predictions (``left_id``) in ``rank`` order each take one free label (``right_id``): the
    first by id, or with ``best`` the one with most overlap.

    In each round a prediction and a label take each other if the label is the prediction's first choice
    and no earlier prediction overlaps the label: at its turn the prediction would find it free. Pairs that
    lose a side go. Minima by prediction and by label are combined before the shuffle, so no key meets in
    one task; rounds are cut by reliable checkpoints.
    """
    ensure_checkpoint_dir(pairs.sparkSession)
    choice = F.struct(*([-F.col("iou")] if best else []), F.col("right_id"), F.col("iou"))
    pairs = pairs.select(*keys, F.struct("rank", "left_id").alias("turn"), "right_id", choice.alias("choice"))
    taken = None
    while True:
        pairs = pairs.checkpoint()
        if taken is not None and pairs.isEmpty():
            break
        first = pairs.groupBy(*keys, "turn").agg(F.min("choice").alias("choice"))
        wanted = first.select(*keys, "turn", F.col("choice.right_id").alias("right_id"), F.col("choice.iou").alias("iou"))
        earliest = pairs.groupBy(*keys, "right_id").agg(F.min("turn").alias("turn"))
        agreed = wanted.join(earliest, [*keys, "turn", "right_id"]).select(*keys, "turn", "right_id", "iou").checkpoint()
        taken = agreed if taken is None else taken.unionByName(agreed)
        pairs = pairs.join(agreed.select(*keys, "turn"), [*keys, "turn"], "left_anti")
        pairs = pairs.join(agreed.select(*keys, "right_id"), [*keys, "right_id"], "left_anti")
    return taken.select(*keys, F.col("turn.left_id").alias("pred_id"), F.col("right_id").alias("gt_id"), "iou")


#: Boxes of a tile, predictions and labels together, up to which a task matches the tile alone.
CROWDED = 2048


def _match_in_tiles(preds: DataFrame, labels: DataFrame, tile: str, per: list[str], threshold: float, best: bool) -> DataFrame:
    """The matching of ``match_pairs`` for tiles of at most ``CROWDED`` boxes: each box is shuffled once.

    A task gets tile after tile, labels by id and then predictions by ``per``, rank and id, so that positions
    stand for the order of choice.
    """
    ship_package(preds.sparkSession)
    kind, ids = {f.name: f.dataType for f in preds.schema.fields}, {f.name: f.dataType for f in labels.schema.fields}
    none = lambda name, t: F.lit(None).cast(t).alias(name)
    box = [F.col(c).cast("double").alias(c) for c in CENTRE]
    p = preds.select(
        F.xxhash64(tile).alias("_tile"), tile, F.lit(True).alias("_pred"), *per, "rank",
        F.col("box_id").alias("pred_id"), none("gt_id", ids["box_id"]), *box,
    )
    g = labels.select(
        F.xxhash64(tile).alias("_tile"), tile, F.lit(False).alias("_pred"), *[none(c, kind[c]) for c in per], none("rank", kind["rank"]),
        none("pred_id", kind["box_id"]), F.col("box_id").alias("gt_id"), *box,
    )
    out = [*per, tile, "pred_id", "gt_id"]
    both = p.unionByName(g)
    schema = T.StructType([*[both.schema[c] for c in out], T.StructField("iou", T.DoubleType())])

    def matched(rows: pa.Table) -> pa.RecordBatch | None:
        rows = rows.combine_chunks()
        column = lambda c: rows.column(c).chunk(0)
        cx, cy, w, h = (column(c).to_numpy() for c in CENTRE)
        corner = np.column_stack([cx - w / 2.0, cy - h / 2.0, cx + w / 2.0, cy + h / 2.0])
        is_pred = column("_pred").to_numpy(zero_copy_only=False)
        group, turn, label = (_numbered_runs([column(c) for c in names]) for names in ([tile, *per], [tile, *per, "rank", "pred_id"], [tile, "gt_id"]))
        found = [], [], []
        for lo, hi in runs_of([column("_tile"), column(tile)]):
            mid = lo + int(np.count_nonzero(~is_pred[lo:hi]))
            if mid in (lo, hi):
                continue
            overlap = _overlaps(corner[mid:hi, None, :], corner[None, lo:mid, :], True)
            i, j = np.nonzero(overlap >= threshold)
            o, i, j = overlap[i, j], i + mid, j + lo
            order = np.lexsort((label[j], -o, turn[i]) if best else (o, label[j], turn[i]))
            i, j, o = i[order], j[order], o[order]
            last, taken = None, set()
            for n, (t, k, g) in enumerate(zip(turn[i].tolist(), group[i].tolist(), label[j].tolist(), strict=True)):
                if t != last and (k, g) not in taken:
                    last = t
                    taken.add((k, g))
                    for f, v in zip(found, (i, j, o), strict=True):
                        f.append(v[n])
        if not found[0]:
            return None
        at, to = pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64())
        columns = [*[column(c).take(at) for c in out[:-1]], column("gt_id").take(to), pa.array(found[2], pa.float64())]
        return pa.RecordBatch.from_arrays(columns, names=[*out, "iou"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            rows = rows if rest is None else pa.concat_tables([rest, rows]).combine_chunks()
            *_, (cut, _) = runs_of([rows.column(c).chunk(0) for c in ("_tile", tile)])
            rest = rows.slice(cut)
            made = matched(rows.slice(0, cut)) if cut else None
            if made is not None:
                yield made
        made = matched(rest) if rest is not None else None
        if made is not None:
            yield made

    order = ["_tile", tile, "_pred", *per, "rank", "pred_id", "gt_id"]
    return both.repartition("_tile").sortWithinPartitions(*order).mapInArrow(run, schema)


def _numbered_runs(columns: list[pa.Array]) -> np.ndarray:
    """The number of the run of equal values (null equals null) that each row stands in."""
    n = len(columns[0])
    differ = np.zeros(n, dtype=np.int64)
    for c in columns:
        a, b = c.slice(1), c.slice(0, n - 1)
        unlike = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(a.is_null(), b.is_null()))
        differ[1:] |= unlike.to_numpy(zero_copy_only=False)
    return np.cumsum(differ)


def greedy_match(
    preds: DataFrame,
    labels: DataFrame,
    *,
    best: bool,
    tile: str = "tile_id",
    threshold: float = C.MATCH_IOU,
    per: tuple[str, ...] = (),
) -> DataFrame:
    """Predictions in ``rank`` order each take one free label with enough overlap, see ``match_pairs``.

    ``best=False`` takes the first such label by ``box_id``, ``best=True`` the one with most overlap.
    ``per`` names columns of the predictions (a processing code) that each have all labels to themselves.
    Tiles are matched by a task each; those of more than ``CROWDED`` boxes are cut into places and matched in
    rounds.
    """
    per = list(per)
    ranked = preds if "rank" in preds.columns else preds.withColumn("rank", F.lit(0))
    ranked = ranked.where(usable(ranked, *CENTRE, tile=tile)).select(*per, tile, "box_id", "rank", *CENTRE)
    labels = labels.where(usable(labels, *CENTRE, tile=tile)).select(tile, "box_id", *CENTRE)
    ensure_checkpoint_dir(preds.sparkSession)
    key = F.xxhash64(tile).alias("_tile")
    sizes = ranked.select(key).unionByName(labels.select(key)).groupBy("_tile").agg(F.count("*").alias("n"))
    crowded = sizes.where(F.col("n") > CROWDED).select(F.col("_tile").alias("_full")).checkpoint()
    if crowded.isEmpty():
        return _match_in_tiles(ranked, labels, tile, per, threshold, best)
    part = lambda df, how: df.join(crowded, F.xxhash64(tile) == F.col("_full"), how)
    calm = _match_in_tiles(part(ranked, "left_anti"), part(labels, "left_anti"), tile, per, threshold, best)
    pairs = iou_pairs(part(ranked, "left_semi"), part(labels, "left_semi"), tile, threshold, keep=("rank", *per))
    return calm.unionByName(match_pairs(pairs, [*per, tile], best=best))


# --- scoring -----------------------------------------------------------------------------


def model_tensor(tile: np.ndarray, target: int = C.MODEL_INPUT) -> np.ndarray:
    """(1, 3, target, target) input in 0..1: whole-number upscale, centre cut, min-max."""
    grey = np.asarray(tile, dtype=np.float32)
    h, w = grey.shape
    if (h, w) != (target, target):
        up = grey.repeat(max(1, -(-target // h)), axis=0).repeat(max(1, -(-target // w)), axis=1)
        top, left = (max(0, (n - target) // 2) for n in up.shape)
        cut = up[top : top + target, left : left + target]
        grey = np.zeros((target, target), dtype=np.float32)
        grey[: cut.shape[0], : cut.shape[1]] = cut
    low, high = grey.min(), grey.max()
    return np.broadcast_to((grey - low) / (high - low + 1e-6), (1, 3, target, target))


def score_tiles(tiles: DataFrame, load_model: Callable[[], Callable[[np.ndarray], np.ndarray]]) -> DataFrame:
    """Raw predictions of every tile.

    ``load_model`` runs once per task and returns a function from a 2-D tile to an (N, 5) array
    of cx, cy, w, h, confidence.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load_model()
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                pixels = np.frombuffer(row.data, dtype=row.dtype).reshape(row.h, row.w)
                found = np.asarray(model(pixels), dtype=float).reshape(-1, 5)
                if len(found):
                    out = pd.DataFrame(found, columns=["cx", "cy", "w", "h", "conf"])
                    out.insert(0, "tile_id", row.tile_id)
                    out.insert(1, "idx", np.arange(len(found), dtype="int64"))
                    yield out

    return tiles.select("tile_id", "h", "w", "dtype", "data").mapInPandas(
        run, "tile_id string, idx bigint, cx double, cy double, w double, h double, conf double"
    )


def bright_block_model(block: int = 8, level: int = 200) -> Callable[[np.ndarray], np.ndarray]:
    """Stand-in detector for tests: every bright block is a box, its mean the confidence."""

    def run(tile: np.ndarray) -> np.ndarray:
        h, w = (n // block * block for n in tile.shape)
        means = tile[:h, :w].reshape(h // block, block, w // block, block).mean(axis=(1, 3))
        ys, xs = np.nonzero(means >= level)
        half = block / 2
        side = np.full(len(ys), float(block))
        return np.column_stack([xs * block + half, ys * block + half, side, side, means[ys, xs] / 255.0])

    return run


def rank_by_score(boxes: DataFrame, tile: str = "tile_id") -> DataFrame:
    """Rank of each box in its tile without suppression (bounded tiles only)."""
    w = Window.partitionBy(tile).orderBy(F.desc("score"), "box_id")
    return boxes.withColumn("rank", F.row_number().over(w))


def ground_truth(annotations: DataFrame, size: int = C.TILE_SIZE) -> DataFrame:
    """Fixed boxes around annotated positions, with a five-pixel margin around the tile."""
    from seaglint.functions.geo import tile_pixel_safe

    px, py = tile_pixel_safe(
        *[F.col(c) for c in ("lat", "lon", "lat_min", "lon_min", "lat_max", "lon_max")], size
    )
    m = C.GROUND_TRUTH_MARGIN_PX
    rows = annotations.withColumn("pixel_x", px).withColumn("pixel_y", py)
    rows = rows.where(F.col("pixel_x").between(-m, size + m) & F.col("pixel_y").between(-m, size + m))
    cx, cy, w, h = B.fixed_box(F.col("pixel_x"), F.col("pixel_y"), size)
    return rows.withColumn("cx", cx).withColumn("cy", cy).withColumn("w", w).withColumn("h", h)
