"""Text, band and key expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What may stand between a plate's characters, and a whole plate.
PLATE_GAPS = r"[\s·•._-]+"
PLATE = "^[一-鿿][A-HJ-NP-Z][A-HJ-NP-Z0-9]{5,6}$"


def plate(text: Column) -> Column:
    """The plate in upper case without separators; null if what is left is none."""
    bare = F.upper(F.regexp_replace(text, PLATE_GAPS, ""))
    return F.when(bare.rlike(PLATE), bare)


def redacted(text: Column) -> Column:
    """User names and passwords of stream addresses become ``***``."""
    return F.regexp_replace(text, r"(rtsps?://)[^/\s@]+@", "$1***@")


def band(value: Column, bands: list[tuple[str, float, float]], other: str) -> Column:
    """Name of the first band [low, high) that holds the value."""
    out = F
    for name, low, high in bands:
        out = out.when((value >= low) & (value < high), name)
    return out.otherwise(other)


def grid_cell(x: Column, y: Column, columns: int = 4, rows: int = 3) -> Column:
    """Row and column of a normalised point, as two digits."""
    place = lambda v, n: F.floor(F.greatest(F.lit(0.0), F.least(F.lit(0.999), v)) * n).cast("string")
    return F.concat(place(y, rows), place(x, columns))


def turn_degrees(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Angle between two motions, 0 where one has no length."""
    length = F.sqrt(ax * ax + ay * ay) * F.sqrt(bx * bx + by * by)
    cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (ax * bx + ay * by) / length))
    return F.when(length <= 1e-12, 0.0).otherwise(F.degrees(F.acos(cosine)))


def canonical(options: Column) -> Column:
    """A struct as JSON text: fields in the struct's order, nulls kept."""
    return F.to_json(options, {"ignoreNullFields": "false"})


def at_offset(start: Column, seconds: Column) -> Column:
    """The instant ``seconds`` after ``start``; null where either is unknown."""
    return F.timestamp_micros(F.unix_micros(start) + (seconds * 1000000).cast("long"))
