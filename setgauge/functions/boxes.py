"""Box columns: structs of x1, y1, x2, y2."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x1, y1, x2, y2) -> Column:
    return F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))


def corners(values: Column) -> Column:
    """[x1,y1,x2,y2] or [x,y,w,h] to a box; fewer than four numbers give null.

    Read as corners when the third exceeds the first and the fourth the second.
    """
    a, b, c, d = (F.get(values, F.lit(i)) for i in range(4))
    as_is = (c > a) & (d > b)
    return F.when(
        (F.size(values) >= 4) & a.isNotNull() & b.isNotNull() & c.isNotNull() & d.isNotNull(),
        F.when(as_is, box(a, b, c, d)).otherwise(box(a, b, a + c, b + d)),
    )


def _side(low: Column, high: Column) -> Column:
    return F.greatest(F.lit(0.0), high - low)


def area(b: Column) -> Column:
    return _side(b["x1"], b["x2"]) * _side(b["y1"], b["y2"])


def overlap(p: Column, q: Column) -> Column:
    wide = _side(F.greatest(p["x1"], q["x1"]), F.least(p["x2"], q["x2"]))
    tall = _side(F.greatest(p["y1"], q["y1"]), F.least(p["y2"], q["y2"]))
    return wide * tall


def iou(p: Column, q: Column) -> Column:
    """Intersection over union; 0 when a box is missing or nothing is covered."""
    inter = overlap(p, q)
    union = area(p) + area(q) - inter
    return F.coalesce(F.when(union > 0, inter / union), F.lit(0.0))


def iou_floored(p: Column, q: Column) -> Column:
    """IoU of a box batch, the union held at 1e-6 or more; areas keep their sign."""
    inter = overlap(p, q)
    signed = [(b["x2"] - b["x1"]) * (b["y2"] - b["y1"]) for b in (p, q)]
    return inter / F.greatest(signed[0] + signed[1] - inter, F.lit(1e-6))
