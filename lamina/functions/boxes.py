"""Geometry of bounding boxes in the columns page, x0, y0, x1, y1 (y grows downward)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _of(prefix: str, name: str) -> Column:
    return F.col(f"{prefix}{name}")


def width(p: str = "") -> Column:
    return _of(p, "x1") - _of(p, "x0")


def height(p: str = "") -> Column:
    return _of(p, "y1") - _of(p, "y0")


def center_x(p: str = "") -> Column:
    return (_of(p, "x0") + _of(p, "x1")) / 2


def center_y(p: str = "") -> Column:
    return (_of(p, "y0") + _of(p, "y1")) / 2


def overlaps(a: str, b: str) -> Column:
    """Boxes share a point, edges included."""
    return (_of(a, "x0") <= _of(b, "x1")) & (_of(b, "x0") <= _of(a, "x1")) & (_of(a, "y0") <= _of(b, "y1")) & (_of(b, "y0") <= _of(a, "y1"))


def contains(a: str, b: str) -> Column:
    """Box a holds box b, edges included."""
    return (_of(a, "x0") <= _of(b, "x0")) & (_of(a, "y0") <= _of(b, "y0")) & (_of(a, "x1") >= _of(b, "x1")) & (_of(a, "y1") >= _of(b, "y1"))


def adjacent(a: str, b: str, threshold: float = 10.0) -> Column:
    """A small gap on one axis, and a common range on the other."""

    def gap(lo: str, hi: str) -> Column:
        return (F.abs(_of(a, hi) - _of(b, lo)) <= threshold) | (F.abs(_of(b, hi) - _of(a, lo)) <= threshold)

    def common(lo: str, hi: str) -> Column:
        return (_of(a, hi) >= _of(b, lo)) & (_of(b, hi) >= _of(a, lo))

    return (gap("x0", "x1") & common("y0", "y1")) | (gap("y0", "y1") & common("x0", "x1"))


def adjacency_type(a: str, b: str) -> Column:
    """'horizontal' where a's right edge is no farther from b than its lower edge; depends on the order."""
    sideways = F.abs(_of(a, "x1") - _of(b, "x0")) <= F.abs(_of(a, "y1") - _of(b, "y0"))
    return F.when(sideways, "horizontal").otherwise("vertical")


def distance(a: str, b: str) -> Column:
    """Between the boxes' centres."""
    return F.sqrt(F.pow(center_x(a) - center_x(b), F.lit(2)) + F.pow(center_y(a) - center_y(b), F.lit(2)))


def snapped(center: Column, step: int = 5) -> Column:
    """The centre to the nearest ``step``, halves to even."""
    return F.bround(center / step) * step
