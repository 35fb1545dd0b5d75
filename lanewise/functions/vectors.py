"""Vectors, boxes and other model outputs, as column expressions in double precision."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Signs that a plate reader's slot can hold, and the index that stands for none.
PLATE_SIGNS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
PAD = len(PLATE_SIGNS)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0).cast("double"), lambda s, v: s + v)


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(_sum(F.transform(doubles(v), lambda x: x * x)))


def cosine(a: Column, b: Column) -> Column:
    """Null if a side is a zero vector."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0).cast("double"))


def unit(v: Column) -> Column:
    """The vector of length one; null if it is zero or not finite."""
    length = norm(v)
    return F.when((length > 0) & (length < float("inf")), F.transform(doubles(v), lambda x: x / length))


def softmax_at(logits: Column, index: Column) -> Column:
    """The share of one class; an index counts from 0."""
    top = F.array_max(logits)
    parts = F.transform(logits, lambda x: F.exp(x - top))
    return F.get(parts, index) / _sum(parts)


def argmax(values: Column) -> Column:
    """The first place (from 0) of the largest value."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def decode_slots(slots: Column) -> Column:
    """struct<text, confidence> of a plate reader's slots: the best sign of each, and the least of the best shares, empty slots included."""
    best = F.transform(slots, argmax)
    signs = F.transform(F.filter(best, lambda i: i != PAD), lambda i: F.substr(F.lit(PLATE_SIGNS), i + 1, F.lit(1)))
    return F.struct(F.array_join(signs, "").alias("text"), F.array_min(F.transform(slots, lambda s: F.array_max(s))).alias("confidence"))


def overlap(a: Column, b: Column) -> Column:
    """Intersection over union of boxes struct<x, y, w, h>."""
    side = lambda p, s: F.greatest(F.lit(0.0), F.least(a[p] + a[s], b[p] + b[s]) - F.greatest(a[p], b[p]))
    both = side("x", "w") * side("y", "h")
    return both / (a["w"] * a["h"] + b["w"] * b["h"] - both)


def letterbox(width: Column, height: Column, side: int) -> Column:
    """struct<scale, w, h, pad_x, pad_y> that fits a picture into a square."""
    scale = F.least(F.lit(side) / width, F.lit(side) / height)
    w, h = F.bround(width * scale).cast("int"), F.bround(height * scale).cast("int")
    half = lambda x: F.floor((side - x) / 2).cast("int")
    return F.struct(scale.alias("scale"), w.alias("w"), h.alias("h"), half(w).alias("pad_x"), half(h).alias("pad_y"))


def decoded_boxes(rows: Column, scale: Column, pad_x: Column, pad_y: Column, width: Column, height: Column, least: float) -> Column:
    """Detections [batch, x1, y1, x2, y2, class, score] of a letterboxed picture as boxes in it: sure enough, cut to the picture, and at least 4 pixels wide and high."""
    sure = F.filter(rows, lambda r: F.get(r, 6) >= least)
    whole = lambda r, i, pad, most: F.greatest(F.lit(0), F.least(most, ((F.get(r, i) - pad) / scale).cast("int")))
    boxes = F.transform(
        sure,
        lambda r: F.struct(whole(r, 1, pad_x, width).alias("x1"), whole(r, 2, pad_y, height).alias("y1"), whole(r, 3, pad_x, width).alias("x2"), whole(r, 4, pad_y, height).alias("y2"), F.get(r, 6).alias("score")),
    )
    return F.filter(boxes, lambda b: (b["x2"] - b["x1"] >= 4) & (b["y2"] - b["y1"] >= 4))


def best_box(boxes: Column) -> Column:
    """The first box of the highest score; null if there is none."""
    top = F.array_max(F.transform(boxes, lambda b: b["score"]))
    return F.get(F.filter(boxes, lambda b: b["score"] == top), 0)


def with_margin(box: Column, width: Column, height: Column, share: float = 0.08) -> Column:
    """The box widened by a share of its sides, cut to the picture."""
    w, h = box["x2"] - box["x1"], box["y2"] - box["y1"]
    cut = lambda x, most: F.greatest(F.lit(0), F.least(most, x.cast("int")))
    return F.struct(cut(box["x1"] - w * share, width).alias("x1"), cut(box["y1"] - h * share, height).alias("y1"), cut(box["x2"] + w * share, width).alias("x2"), cut(box["y2"] + h * share, height).alias("y2"))


def patches(box: Column, width: Column, height: Column) -> Column:
    """The areas above, below, left and right of a plate from which a car's colour is taken; empty ones are left out."""
    x, y, w, h = box["x1"], box["y1"], box["x2"] - box["x1"], box["y2"] - box["y1"]
    below, right = box["y2"] + 0.05 * h, box["x2"] + 0.05 * w
    areas = [(x, y - 0.40 * h, w, 0.35 * h), (x, below, w, 0.35 * h), (x - 0.35 * w, y, 0.30 * w, h), (right, y, 0.30 * w, h)]
    made = [
        F.struct(
            F.greatest(F.lit(0), a.cast("int")).alias("x0"), F.greatest(F.lit(0), b.cast("int")).alias("y0"),
            F.least(width, (a + c).cast("int")).alias("x1"), F.least(height, (b + d).cast("int")).alias("y1"),
        )
        for a, b, c, d in areas
    ]
    return F.filter(F.array(*made), lambda p: (p["x1"] > p["x0"]) & (p["y1"] > p["y0"]))


def usable_pixels(lab: Column, least: int = 200) -> Column:
    """Lab pixels that are neither shadow nor glare; null if too few are left."""
    kept = F.filter(lab, lambda p: (F.get(p, 0) > 5.0) & (F.get(p, 0) < 99.0))
    return F.when(F.size(kept) >= least, kept)


def selected_barcode(texts: Column) -> Column:
    """Of the texts that decoding attempts gave, in order: the first that begins like a licence, else the first at all."""
    some = F.filter(texts, lambda t: t.isNotNull() & (t != ""))
    return F.coalesce(F.get(F.filter(some, lambda t: t.startswith("@")), 0), F.get(some, 0))


def face_square(x: Column, y: Column, w: Column, h: Column, scale: float = 2.7) -> Column:
    """struct<x1, y1, x2, y2>: the square around a face for the live-person model; it may reach beyond the picture."""
    half = F.greatest(w, h) * scale / 2
    cx, cy = x + w / 2, y + h / 2
    whole = lambda v: F.bround(v).cast("int")
    return F.struct(whole(cx - half).alias("x1"), whole(cy - half).alias("y1"), whole(cx + half).alias("x2"), whole(cy + half).alias("y2"))


def shrunk(width: Column, height: Column, side: int) -> Column:
    """struct<w, h> of a picture whose longer side is at most side."""
    scale = F.least(F.lit(1.0), F.lit(float(side)) / F.greatest(width, height))
    return F.struct(F.greatest(F.lit(1), F.bround(width * scale).cast("int")).alias("w"), F.greatest(F.lit(1), F.bround(height * scale).cast("int")).alias("h"))


def mean_of_flips(a: Column, b: Column) -> Column:
    """The unit vector of a face and its mirror image together."""
    return unit(F.zip_with(doubles(a), doubles(b), lambda x, y: x + y))


def margin_logit(cos: Column, own: Column, margin: float = 0.5, scale: float = 64.0) -> Column:
    """The scaled logit of a class: that of the own class has an angular margin taken off."""
    c = F.greatest(F.lit(-1 + 1e-7), F.least(F.lit(1 - 1e-7), cos))
    moved = F.when(c > math.cos(math.pi - margin), c * math.cos(margin) - F.sqrt(1 - c * c) * math.sin(margin)).otherwise(c - math.sin(math.pi - margin) * margin)
    return scale * F.when(own, moved).otherwise(c)
