"""Angles, tiles and screen geometry as Column functions. Degrees throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEGMENTS, SLICE_WIDTH, PANORAMA_WIDTH = 32, 2048, 65536


def normalize_angle(angle: Column) -> Column:
    """Any angle to [0, 360)."""
    return F.pmod(angle, F.lit(360.0))


def relative_angle(raw: Column, zero: Column) -> Column:
    """Angle from a zero direction; the normalised raw angle where the zero is unknown."""
    return F.coalesce(F.pmod(normalize_angle(raw) - zero, F.lit(360.0)), raw)


def circular_distance(a: Column, b: Column) -> Column:
    """Shorter way round between two angles, 0 to 180."""
    d = F.abs(a - b)
    return F.least(d, F.lit(360.0) - d)


def angle_to_tile(angle: Column, segments: int = SEGMENTS) -> Column:
    at = (angle / F.lit(360.0) * segments).cast("int")
    return F.greatest(F.lit(0), F.least(F.lit(segments - 1), at))


def half_turn_shift(tile: Column, segments: int = SEGMENTS) -> Column:
    """Tile of a camera that looks the other way."""
    return (tile + segments // 2) % segments


def tile_angle(tile: Column, segments: int = SEGMENTS) -> Column:
    return tile * 360 / F.lit(float(segments))


def pixel_to_angle(x: Column, width: int) -> Column:
    """Angle of a click in the panorama; clicks right of its edge count as 359.9."""
    a = x / F.lit(float(width)) * 360
    return F.when(a < 0, 0.0).when(a >= 360, 359.9).otherwise(a)


def bearing(dx: Column, dy: Column) -> Column:
    """Compass bearing of an offset, in whole degrees, cut off."""
    d = F.degrees(F.atan2(dx, dy))
    return F.when(d < 0, d + 360).otherwise(d).cast("int")


def polar_x(angle: Column, radius: Column) -> Column:
    return radius * F.sin(F.radians(angle))


def polar_y(angle: Column, radius: Column) -> Column:
    """Screen y grows downwards, so north is negative."""
    return -radius * F.cos(F.radians(angle))
