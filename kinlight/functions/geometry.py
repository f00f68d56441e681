"""Boxes, points, image sizes and the transforms between them, as column expressions.

A box is a struct (x, y, w, h[, score]); a point a struct (x, y); landmarks are ten floats in the order left
eye, right eye, nose, left and right end of the mouth.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Where the five landmarks go in an aligned crop of 112 x 112 (fixed values of that model family).
ALIGNED_112 = [(38.2946, 51.6963), (73.5318, 51.5014), (56.0252, 71.7366), (41.5493, 92.3655), (70.7299, 92.2041)]

#: Least detector score and box side, and least sharpness of a face that is worth keeping.
MIN_SCORE, MIN_SIDE, MIN_SHARPNESS = 0.6, 40.0, 0.0


def box(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.struct(*[c.cast("double").alias(n) for c, n in ((x, "x"), (y, "y"), (w, "w"), (h, "h"))])


def right(b: Column) -> Column:
    return b["x"] + b["w"]


def bottom(b: Column) -> Column:
    return b["y"] + b["h"]


def centre(b: Column) -> Column:
    return F.struct((b["x"] + b["w"] / 2).alias("x"), (b["y"] + b["h"] / 2).alias("y"))


def area(b: Column) -> Column:
    return F.greatest(F.lit(0.0), b["w"]) * F.greatest(F.lit(0.0), b["h"])


def min_side(b: Column) -> Column:
    return F.least(b["w"], b["h"])


def face_px(b: Column) -> Column:
    """The shorter side in whole pixels, halves to even."""
    return F.bround(min_side(b), 0).cast("int")


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 for boxes that only touch and where the union has no area."""
    w = F.least(right(a), right(b)) - F.greatest(a["x"], b["x"])
    h = F.least(bottom(a), bottom(b)) - F.greatest(a["y"], b["y"])
    shared = F.when((w > 0) & (h > 0), w * h).otherwise(0.0)
    union = area(a) + area(b) - shared
    return F.when((shared <= 0) | (union <= 0), 0.0).otherwise(shared / union)


def expand(b: Column, share: float, width: Column, height: Column) -> Column:
    """The box grown on each side by ``share`` of its size, inside the image."""
    dx, dy = b["w"] * share, b["h"] * share
    x, y = F.greatest(F.lit(0.0), b["x"] - dx), F.greatest(F.lit(0.0), b["y"] - dy)
    x2, y2 = F.least(width.cast("double"), right(b) + dx), F.least(height.cast("double"), bottom(b) + dy)
    return box(x, y, F.greatest(F.lit(0.0), x2 - x), F.greatest(F.lit(0.0), y2 - y))


def rescale(b: Column, scale: Column) -> Column:
    """Undo a downscale: coordinates divided by ``scale``, unless it is 1 or more."""
    return F.when(scale >= 1, b).otherwise(box(b["x"] / scale, b["y"] / scale, b["w"] / scale, b["h"] / scale))


def crop_region(b: Column, scale_x: Column, scale_y: Column, width: Column, height: Column) -> Column:
    """Whole-pixel crop of a scaled box inside an image; null if nothing is left."""
    x, y = F.greatest(F.lit(0), F.floor(b["x"] * scale_x)), F.greatest(F.lit(0), F.floor(b["y"] * scale_y))
    x2 = F.least(width.cast("bigint"), F.ceil(right(b) * scale_x))
    y2 = F.least(height.cast("bigint"), F.ceil(bottom(b) * scale_y))
    crop = F.struct(x.alias("x"), y.alias("y"), (x2 - x).alias("w"), (y2 - y).alias("h"))
    return F.when((x2 > x) & (y2 > y), crop)


def distance(a: Column, b: Column) -> Column:
    return F.hypot(a["x"] - b["x"], a["y"] - b["y"])


def translate(p: Column, dx: Column, dy: Column) -> Column:
    return F.struct((p["x"] + dx).alias("x"), (p["y"] + dy).alias("y"))


def scale_point(p: Column, by: Column) -> Column:
    return F.struct((p["x"] * by).alias("x"), (p["y"] * by).alias("y"))


def landmark(marks: Column, i: int) -> Column:
    """The i-th point of ten floats."""
    return F.struct(F.get(marks, F.lit(2 * i)).alias("x"), F.get(marks, F.lit(2 * i + 1)).alias("y"))


def flatten_landmarks(points: list[Column]) -> Column:
    return F.array(*[p[c].cast("float") for p in points for c in ("x", "y")])


def interocular(marks: Column) -> Column:
    return distance(landmark(marks, 0), landmark(marks, 1))


def plausibly_ordered(marks: Column) -> Column:
    """Left eye left of the right one, likewise the mouth, and the mouth below the eyes."""
    le, re, ml, mr = (landmark(marks, i) for i in (0, 1, 3, 4))
    return (le["x"] < re["x"]) & (ml["x"] < mr["x"]) & ((le["y"] + re["y"]) / 2 < (ml["y"] + mr["y"]) / 2)


def acceptable(score: Column, w: Column, h: Column, sharpness: Column) -> Column:
    """The quality gate: score, shorter side, and sharpness where it is known."""
    return (score >= MIN_SCORE) & (F.least(w, h) >= MIN_SIDE) & (sharpness.isNull() | (sharpness >= MIN_SHARPNESS))


def rejection(score: Column, w: Column, h: Column, sharpness: Column) -> Column:
    """The first reason for which :func:`acceptable` fails; null if it passes."""
    return (
        F.when(score < MIN_SCORE, F.format_string("score %.2f below %.2f", score, F.lit(MIN_SCORE)))
        .when(F.least(w, h) < MIN_SIDE, F.format_string("side %.0f px below %.0f", F.least(w, h), F.lit(MIN_SIDE)))
        .when(sharpness < MIN_SHARPNESS, F.format_string("sharpness %.1f below %.1f", sharpness, F.lit(MIN_SHARPNESS)))
    )


def downscale(width: Column, height: Column, limit: int | None) -> Column:
    """The factor that brings the longer side down to ``limit``; 1 if it is within, or without a limit."""
    if not limit or limit <= 0:
        return F.lit(1.0)
    longer = F.greatest(width, height)
    return F.when(longer <= limit, 1.0).otherwise(F.lit(float(limit)) / longer)


def swaps_sides(orientation: Column) -> Column:
    """Whether an orientation tag exchanges width and height."""
    return F.coalesce(orientation.isin(5, 6, 7, 8), F.lit(False))


def upright_size(width: Column, height: Column, orientation: Column) -> Column:
    turned = swaps_sides(orientation)
    return F.struct(F.when(turned, height).otherwise(width).alias("width"), F.when(turned, width).otherwise(height).alias("height"))


def letterbox(width: Column, height: Column, size: int) -> Column:
    """Scale and right and bottom padding that fit an image into a square."""
    scale = F.least(F.lit(float(size)) / width, F.lit(float(size)) / height)
    pads = [(F.lit(size) - F.least(F.lit(size), F.bround(side * scale, 0).cast("int"))).alias(n) for side, n in ((width, "pad_x"), (height, "pad_y"))]
    return F.struct(scale.alias("scale"), *pads)


def unletterbox(b: Column, scale: Column, width: Column, height: Column) -> Column:
    """A box of the square in the image's own pixels, clamped to the image."""

    def clamp(v: Column, most: Column) -> Column:
        return F.least(F.greatest(v, F.lit(0.0)), most.cast("double"))

    x, y = clamp(b["x"] / scale, width), clamp(b["y"] / scale, height)
    x2, y2 = clamp(right(b) / scale, width), clamp(bottom(b) / scale, height)
    return box(x, y, F.greatest(F.lit(0.0), x2 - x), F.greatest(F.lit(0.0), y2 - y))


def distance_box(cx: Column, cy: Column, left: Column, top: Column, r: Column, b: Column) -> Column:
    """The box whose sides lie at the given distances from an anchor's centre."""
    return box(cx - left, cy - top, left + r, top + b)


def offset_landmarks(cx: Column, cy: Column, offsets: Column) -> Column:
    """Ten offsets from an anchor's centre as points."""
    return F.transform(offsets, lambda v, i: F.when(i % 2 == 0, cx).otherwise(cy) + v)
