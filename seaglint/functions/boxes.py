"""Box arithmetic on columns: corners, overlap, rescaling, size model."""

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from seaglint import config as C
from seaglint.functions.draws import uniform


def corners(cx: Column, cy: Column, w: Column, h: Column):
    """Centre form to (x1, y1, x2, y2)."""
    return cx - w / 2.0, cy - h / 2.0, cx + w / 2.0, cy + h / 2.0


def shared_area(a: tuple, b: tuple) -> Column:
    zero = F.lit(0.0)
    return F.greatest(zero, F.least(a[2], b[2]) - F.greatest(a[0], b[0])) * F.greatest(
        zero, F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    )


def area(a: tuple) -> Column:
    return (a[2] - a[0]) * (a[3] - a[1])


def iou_xyxy(a: tuple, b: tuple) -> Column:
    """Overlap of two corner boxes with the 1e-6 term in the union."""
    inter = shared_area(a, b)
    return inter / (area(a) + area(b) - inter + F.lit(1e-6))


def iou_yolo(a: tuple, b: tuple) -> Column:
    """Overlap of two centre boxes; 0 when the union is not positive."""
    ca, cb = corners(*a), corners(*b)
    inter = shared_area(ca, cb)
    union = area(ca) + area(cb) - inter
    return F.when(union <= 0, F.lit(0.0)).otherwise(F.try_divide(inter, union))


def rescale_clip(box: tuple, width: Column, height: Column, model_size: int = C.MODEL_INPUT):
    """Model pixels to tile pixels: low corner floored at 0, high corner capped at the size."""
    sx, sy = width / F.lit(float(model_size)), height / F.lit(float(model_size))
    zero = F.lit(0.0)
    return (
        F.greatest(zero, box[0] * sx),
        F.greatest(zero, box[1] * sy),
        F.least(width, box[2] * sx),
        F.least(height, box[3] * sy),
    )


def row_score(conf: Column, class_scores: Column) -> Column:
    """Confidence times the best class score when that is positive."""
    best = F.array_max(class_scores)
    return F.when(best > 0, conf * best).otherwise(conf)


def fixed_box(px: Column, py: Column, size: int = C.TILE_SIZE, box_px: float = 8.0):
    """Constant-size box around a pixel, normalised and clamped to 0..1."""

    def unit(v):
        return F.least(F.lit(1.0), F.greatest(F.lit(0.0), v))

    s = float(size)
    return unit(px / s), unit(py / s), unit(F.lit(box_px / s)), unit(F.lit(box_px * 0.5 / s))


def pixel_box(cx: Column, cy: Column, w: Column, h: Column, size: int = C.TILE_SIZE):
    """Normalised centre box to whole-pixel corners, cut toward zero."""
    return tuple((v * F.lit(size)).cast("int") for v in corners(cx, cy, w, h))


def vessel_length_range(vessel_type: Column):
    """(min, max) length in metres of a typed vessel."""
    low = F.lower(vessel_type)
    lo, hi = F, F
    for words, shortest, longest in C.VESSEL_LENGTHS:
        test = reduce(Column.__or__, [F.contains(low, F.lit(w)) for w in words])  # a pattern takes several times as long
        lo, hi = lo.when(test, F.lit(shortest)), hi.when(test, F.lit(longest))
    return lo.otherwise(C.OTHER_VESSEL_LENGTH[0]), hi.otherwise(C.OTHER_VESSEL_LENGTH[1])


def _untyped_length_range(roll: Column):
    (p1, a1, b1), (p2, a2, b2), (_, a3, b3) = C.UNTYPED_LENGTHS
    lo = F.when(roll < p1, a1).when(roll < p2, a2).otherwise(a3)
    hi = F.when(roll < p1, b1).when(roll < p2, b2).otherwise(b3)
    return lo, hi


def size_draws(key: Column) -> dict[str, Column]:
    """The draws of the vessel size model.

    Draws come from a hash of ``key``, so a row always gets the same box no matter how the
    table is partitioned.
    """
    return {d: uniform(key, d) for d in ("mix", "length", "bloom", "jitter", "aspect")}


def size_of_draws(draws: dict[str, Column], vessel_type: Column, size: int = C.TILE_SIZE):
    """Normalised (width, height) of the vessel size model."""
    typed = vessel_type.isNotNull() & (vessel_type != "")
    t_lo, t_hi = vessel_length_range(vessel_type)
    u_lo, u_hi = _untyped_length_range(draws["mix"])
    lo = F.when(typed, t_lo).otherwise(u_lo)
    hi = F.when(typed, t_hi).otherwise(u_hi)

    def between(draw, low, high):
        return F.lit(low) + F.lit(high - low) * draws[draw]

    def norm(px, floor_px):
        share = F.greatest(F.lit(floor_px), px) / float(size)
        return F.least(F.lit(1.0), F.greatest(F.lit(0.001), share))

    length = F.exp(F.log(lo) + (F.log(hi) - F.log(lo)) * draws["length"])
    longer = length * between("bloom", *C.BLOOM_RANGE) * between("jitter", *C.JITTER_RANGE) / C.PIXEL_METRES
    return norm(longer, 3.0), norm(longer / between("aspect", *C.ASPECT_RANGE), 1.5)


def sampled_size(key: Column, vessel_type: Column, size: int = C.TILE_SIZE):
    """Normalised (width, height) drawn by ``key``.

    Both sides are of one length; in one projection Spark's generated code computes what they share once.
    In a lambda function it would be interpreted, which takes several times as long.
    """
    return size_of_draws(size_draws(key), vessel_type, size)


def estimated_box(key: Column, px: Column, py: Column, vessel_type: Column, size: int = C.TILE_SIZE):
    """Normalised (cx, cy, w, h) around a pixel position."""
    w, h = sampled_size(key, vessel_type, size)
    cx = F.greatest(F.lit(0.0), F.least(F.lit(1.0), px / float(size)))
    cy = F.greatest(F.lit(0.0), F.least(F.lit(1.0), py / float(size)))
    return cx, cy, w, h


def size_level(value: Column, ratio: float) -> Column:
    """Geometric size class: sides within a factor ``ratio`` are at most one class apart."""
    step = -math.log(ratio)
    return F.floor(F.log(F.greatest(value, F.lit(1e-9))) / F.lit(step)).cast("int")
