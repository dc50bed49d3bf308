"""Scalar functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hex_rgb(code: Column) -> tuple[Column, Column, Column]:
    """The three parts of a colour as rrggbb, with or without #."""
    bare = F.replace(code, F.lit("#"), F.lit(""))
    return tuple(F.conv(F.substring(bare, i, 2), 16, 10).cast("int") for i in (1, 3, 5))


def parse_percent(text: Column) -> Column:
    return F.regexp_extract(text, r"^([\d.]+)%", 1).try_cast("double")


#: Fixed value: how an interval stands in published tables, as in [54.4, 60.9].
INTERVAL = r"\[([\d.]+),\s*([\d.]+)\]"


def parse_interval(text: Column) -> tuple[Column, Column]:
    return tuple(F.regexp_extract(text, INTERVAL, i).try_cast("double") for i in (1, 2))


def tile_origin(x: Column, size: int) -> Column:
    """Left edge of a tile of the given size around x, 0 at least."""
    return F.greatest(F.lit(0).cast("long"), x - size // 2)


def cell_index(x: Column, x0: float, step: float) -> Column:
    """Index of the cell, truncated toward zero."""
    return ((x - x0) / step).cast("long")


def below(p: Column, draws: int) -> Column:
    """A p-value as text: less than one draw's share if it is 0."""
    return F.when(p == 0, F.lit(f"< {1 / draws:g}")).otherwise(F.format_string("%.4f", p))


def thousands(x: Column, digits: int = 1) -> Column:
    """A number as text, with separators."""
    return F.format_number(x, digits)
