"""How ranges lie to each other, as Column expressions. Half-open ranges are ``[lo, hi)``, extents ``[lo, hi]``."""

from __future__ import annotations

from pyspark.sql import Column

Range = tuple[Column, Column]


def overlaps(a: Range, b: Range) -> Column:
    """Whether two half-open ranges share a point (an empty one inside another counts, as bounds alone tell)."""
    return (a[0] < b[1]) & (b[0] < a[1])


def contains(a: Range, b: Range) -> Column:
    """Whether half-open a holds all of half-open b."""
    return (a[0] <= b[0]) & (b[1] <= a[1])


def extents_overlap(a: Range, b: Range) -> Column:
    """Whether two extents share a point."""
    return (a[0] <= b[1]) & (b[0] <= a[1])


def extent_contains(a: Range, b: Range) -> Column:
    """Whether extent a holds all of extent b."""
    return (a[0] <= b[0]) & (b[1] <= a[1])


def extent_overlaps_range(a: Range, b: Range) -> Column:
    """Whether extent a and half-open b share a point."""
    return (a[0] < b[1]) & (b[0] <= a[1])


def extent_contains_range(a: Range, b: Range) -> Column:
    """Whether extent a holds all of half-open b."""
    return (a[0] <= b[0]) & (b[1] <= a[1] + 1)
