"""Box and polygon arithmetic as Column expressions. A box is a struct of x0, y0, x1, y1 (doubles).

``area``, ``overlap``, ``iou``, ``distance`` and the centres also take a ``Box`` of arrays, in which a null is no number.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

SIDES = ("x0", "y0", "x1", "y1")


class Box(NamedTuple):
    """The sides of many boxes, as arrays or as columns."""

    x0: np.ndarray | Column
    y0: np.ndarray | Column
    x1: np.ndarray | Column
    y1: np.ndarray | Column


def _least(a, b):
    return F.least(a, b) if isinstance(a, Column) else np.fmin(a, b)


def _greatest(a, b):
    if isinstance(a, Column):
        return F.greatest(a, b if isinstance(b, Column) else F.lit(b))
    return np.fmax(a, b)


def area(b: Column) -> Column:
    return _greatest(b.x1 - b.x0, 0.0) * _greatest(b.y1 - b.y0, 0.0)


def overlap(a: Column, b: Column) -> Column:
    """Area of the intersection, 0 for boxes apart."""
    w = _least(a.x1, b.x1) - _greatest(a.x0, b.x0)
    h = _least(a.y1, b.y1) - _greatest(a.y0, b.y0)
    return _greatest(w, 0.0) * _greatest(h, 0.0)


def iou(a: Column, b: Column) -> Column:
    """Intersection over union, 0 where both are empty."""
    both = overlap(a, b)
    union = area(a) + area(b) - both
    if isinstance(union, np.ndarray):
        return np.divide(both, union, out=np.zeros(len(union)), where=union > 0)
    return F.when(union > 0, both / union).otherwise(F.lit(0.0))


def over_smaller(a: Column, b: Column) -> Column:
    """Intersection over the smaller area."""
    least = F.least(area(a), area(b))
    return F.when(least > 0, overlap(a, b) / least).otherwise(F.lit(0.0))


def covered(a: Column, by: Column) -> Column:
    """Share of ``a`` that ``by`` covers."""
    return F.when(area(a) > 0, overlap(a, by) / area(a)).otherwise(F.lit(0.0))


def gap(a: Column, b: Column) -> Column:
    """Distance between two boxes, 0 when they touch."""
    dx = F.greatest(a.x0 - b.x1, b.x0 - a.x1, F.lit(0.0))
    dy = F.greatest(a.y0 - b.y1, b.y0 - a.y1, F.lit(0.0))
    return F.sqrt(dx * dx + dy * dy)


def centre_x(b: Column) -> Column:
    return (b.x0 + b.x1) / 2


def centre_y(b: Column) -> Column:
    return (b.y0 + b.y1) / 2


def distance(a: Column, b: Column) -> Column:
    dx, dy = centre_x(a) - centre_x(b), centre_y(a) - centre_y(b)
    square = dx * dx + dy * dy
    return F.sqrt(square) if isinstance(square, Column) else np.sqrt(square)


def association_radius(b: Column) -> Column:
    """0.6 times the box's mean side, between 8 and 32."""
    return F.greatest(F.lit(8.0), F.least(F.lit(32.0), 0.6 * F.sqrt((b.x1 - b.x0) * (b.y1 - b.y0))))


def diagonal(b: Column) -> Column:
    w, h = b.x1 - b.x0, b.y1 - b.y0
    return F.sqrt(w * w + h * h)


def short_side(b: Column) -> Column:
    return F.least(F.abs(b.x1 - b.x0), F.abs(b.y1 - b.y0))


def own_size_distance(a: Column, b: Column) -> Column:
    """Distance of the centres, each axis in units of the smaller of the two sides."""
    dx = (centre_x(a) - centre_x(b)) / F.least(a.x1 - a.x0, b.x1 - b.x0)
    dy = (centre_y(a) - centre_y(b)) / F.least(a.y1 - a.y0, b.y1 - b.y0)
    return F.sqrt(dx * dx + dy * dy)


def extent() -> list[Column]:
    """Aggregates: the union box of a group of rows with columns x0, y0, x1, y1, and the mean of their centres."""
    return [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.avg((F.col("x0") + F.col("x1")) / 2).alias("cx"), F.avg((F.col("y0") + F.col("y1")) / 2).alias("cy")]


def scaled(b: Column, ratio: float) -> Column:
    """The box with its sides ``ratio`` times as long around its centre."""
    return expanded(b, (ratio - 1) / 2)


def clamped(b: Column, width: float, height: float) -> Column:
    """The part of the box that lies in the canvas."""
    side = lambda c, most: F.greatest(F.lit(0.0), F.least(F.lit(float(most)), c))
    return F.struct(side(b.x0, width).alias("x0"), side(b.y0, height).alias("y0"), side(b.x1, width).alias("x1"), side(b.y1, height).alias("y1"))


def contains(b: Column, x: Column, y: Column) -> Column:
    return (x >= b.x0) & (x <= b.x1) & (y >= b.y0) & (y <= b.y1)


def same_target(a: Column, b: Column, most_distance: float = 30.0, most_ratio: float = 5.0) -> Column:
    """One physical target: centres and short sides not too different."""
    tiny = F.lit(1e-6)
    return (distance(a, b) <= most_distance) & (F.greatest(short_side(a), short_side(b), tiny) / F.greatest(F.least(short_side(a), short_side(b)), tiny) <= most_ratio)


def channels_match(a: Column, b: Column, least_iou: float = 0.10, expand: float = 1.25, near: float = 24.0, most_ratio: float = 8.0) -> Column:
    """Boxes of two channels: they overlap, or a's centre lies in b expanded, or both distance and area ratio are bounded."""
    tiny = F.lit(1e-6)
    close = distance(a, b) <= F.greatest(F.lit(near), 0.5 * F.greatest(short_side(a), short_side(b)))
    ratio = F.greatest(area(a), area(b), tiny) / F.greatest(F.least(area(a), area(b)), tiny)
    return (iou(a, b) >= least_iou) | contains(scaled(b, expand), centre_x(a), centre_y(a)) | (close & (ratio <= most_ratio))


def to_tile(b: Column, x: Column, y: Column) -> Column:
    """The box in the coordinates of a tile whose origin is (x, y)."""
    return F.struct((b.x0 - x).alias("x0"), (b.y0 - y).alias("y0"), (b.x1 - x).alias("x1"), (b.y1 - y).alias("y1"))


def from_tile(b: Column, x: Column, y: Column) -> Column:
    return to_tile(b, -x, -y)


def normalised(b: Column, width: Column, height: Column) -> Column:
    return F.struct((b.x0 / width).alias("x0"), (b.y0 / height).alias("y0"), (b.x1 / width).alias("x1"), (b.y1 / height).alias("y1"))


def edge_margin(b: Column, width: float, height: float) -> Column:
    """Least distance of the box from the edge of its tile; below 0 it is truncated."""
    return F.least(b.x0, b.y0, width - b.x1, height - b.y1)


def crop_window(b: Column, side: float, width: float, height: float, margin: float = 0.0) -> Column:
    """A square window of the canvas around the box: struct of status, x, y. Without status 'ok' there is no window."""
    place = lambda c, most: F.greatest(F.lit(0.0), F.least(F.lit(float(most - side)), c - side / 2))
    status = F.when((b.x0 < 0) | (b.y0 < 0) | (b.x1 > width) | (b.y1 > height), "outside canvas").when(F.greatest(b.x1 - b.x0, b.y1 - b.y0) + 2 * margin > side, "target too large").otherwise("ok")
    ok = status == "ok"
    return F.struct(status.alias("status"), F.when(ok, place(centre_x(b), width)).alias("x"), F.when(ok, place(centre_y(b), height)).alias("y"))


def sizes_agree(a: Column, b: Column, most: float = 3.0) -> Column:
    """Both sides' ratios within [1/most, most]."""
    w, h = (a.x1 - a.x0) / (b.x1 - b.x0), (a.y1 - a.y0) / (b.y1 - b.y0)
    return w.between(1 / most, most) & h.between(1 / most, most)


def expanded(b: Column, ratio: float) -> Column:
    """The box with ``ratio`` of its side added on each side."""
    w, h = (b.x1 - b.x0) * ratio, (b.y1 - b.y0) * ratio
    return F.struct((b.x0 - w).alias("x0"), (b.y0 - h).alias("y0"), (b.x1 + w).alias("x1"), (b.y1 + h).alias("y1"))


def in_polygon(x: Column, y: Column, polygon: Column, edge_inside: bool = True) -> Column:
    """Whether a point lies in a polygon (array of structs x, y). Points on an edge are in, or out if strict.

    A fold over the edges: the parity of those crossed to the right, unless one runs through the point.
    """
    n = F.size(polygon)
    edges = F.transform(polygon, lambda p, i: F.struct(p.alias("a"), F.element_at(polygon, (i + 1) % n + 1).alias("b")))

    def crosses(e: Column) -> Column:
        at = e.a.x + (y - e.a.y) * (e.b.x - e.a.x) / (e.b.y - e.a.y)
        return F.when((e.a.y > y) != (e.b.y > y), x < at).otherwise(F.lit(False))

    def touches(e: Column) -> Column:
        turn = (e.b.x - e.a.x) * (y - e.a.y) - (e.b.y - e.a.y) * (x - e.a.x)
        return (F.abs(turn) <= 1e-9) & x.between(F.least(e.a.x, e.b.x) - 1e-9, F.greatest(e.a.x, e.b.x) + 1e-9) & y.between(F.least(e.a.y, e.b.y) - 1e-9, F.greatest(e.a.y, e.b.y) + 1e-9)

    odd = F.size(F.filter(edges, crosses)) % 2 == 1
    on = F.exists(edges, touches)
    return (on | odd) if edge_inside else (odd & ~on)


def overrides(event: Column, b: Column) -> Column:
    """Whether a confirmed event's box stands for a detected one: they overlap, or one holds the other's centre."""
    return (overlap(event, b) > 0) | contains(event, centre_x(b), centre_y(b)) | contains(b, centre_x(event), centre_y(event))
