"""Latitude and longitude boxes around points, and the grid cells they touch, as column arithmetic."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from roostline import config


class Box(NamedTuple):
    """Bounds of a box; the longitude bounds are NULL where every longitude qualifies."""

    south: Column
    north: Column
    west: Column
    east: Column


def box_around(latitude: Column, longitude: Column, radius_km: Column) -> Box:
    """The smallest expressible box that holds the whole circle.

    Degrees of longitude shrink towards the poles, so the box is measured at the edge
    of the circle farthest from the equator. A circle that touches a pole or crosses
    the date line has no single longitude range and gets none.
    """
    reach = radius_km / F.lit(config.KM_PER_DEGREE_LATITUDE)
    south = F.greatest(latitude - reach, F.lit(-90.0))
    north = F.least(latitude + reach, F.lit(90.0))
    shrink = F.cos(F.radians(F.greatest(F.abs(south), F.abs(north))))
    safe = F.when(shrink > config.MIN_COS_LATITUDE, shrink)
    width = radius_km / (F.lit(config.KM_PER_DEGREE_LATITUDE) * safe)
    west, east = longitude - width, longitude + width
    bounded = (south > -90.0) & (north < 90.0) & (west >= -180.0) & (east <= 180.0)
    return Box(south, north, F.when(bounded, west), F.when(bounded, east))


def within_box(latitude: Column, longitude: Column, box: Box) -> Column:
    lon = box.west.isNull() | longitude.between(box.west, box.east)
    return latitude.between(box.south, box.north) & lon


# --- Grid cells ---------------------------------------------------------------------
# A grid of level n has cells of 180 / 2^n degrees. Level 2 is the coarsest that is used,
# level 12 (about five kilometres) the finest.
LEVELS = (2, 12)
# A box touches at most one row or column of cells more than these; one of all longitudes
# touches nine columns of the coarsest grid.
_ROWS, _COLUMNS = 2, 4


def _size(level: Column) -> Column:
    return F.lit(180.0) / F.pow(F.lit(2.0), level)


def _row_and_column(latitude: Column, longitude: Column, level: Column) -> tuple[Column, Column]:
    size = _size(level)
    inside = lambda x, edge: F.least(F.greatest(x, F.lit(-edge)), F.lit(edge))
    return F.floor((inside(latitude, 90.0) + 90.0) / size), F.floor((inside(longitude, 180.0) + 180.0) / size)


def _numbered(level: Column, row: Column, column: Column) -> Column:
    return (level.cast("long") * (1 << 40) + row * (1 << 20) + column).cast("long")


def grid_level(south: Column, north: Column, west: Column, east: Column) -> Column:
    """The finest level at which the box touches few cells; all longitudes where they are NULL."""
    tall, wide = (north - south) / _ROWS, F.coalesce(east - west, F.lit(360.0)) / _COLUMNS
    finest = F.floor(F.log2(F.lit(180.0) / F.greatest(tall, wide, F.lit(1e-9))))
    return F.least(F.greatest(finest, F.lit(LEVELS[0])), F.lit(LEVELS[1])).cast("int")


def grid_cell(latitude: Column, longitude: Column, level: Column) -> Column:
    """The cell of a point; places beyond the poles or the date line count as on them."""
    return _numbered(level, *_row_and_column(latitude, longitude, level))


def grid_cells_of_box(south: Column, north: Column, west: Column, east: Column, level: Column) -> Column:
    """Every cell the box touches, as an array."""
    low = _row_and_column(south, F.coalesce(west, F.lit(-180.0)), level)
    high = _row_and_column(north, F.coalesce(east, F.lit(180.0)), level)
    rows, columns = (F.sequence(a, b) for a, b in zip(low, high))
    return F.flatten(F.transform(rows, lambda r: F.transform(columns, lambda c: _numbered(level, r, c))))
