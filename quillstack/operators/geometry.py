"""Geometry of pages as numbers: votes of straight lines, corners of a sheet, names of what is written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstack.operators.corpus import padded

# Degrees up to which a line counts as level, and between which as upright.
LEVEL, UPRIGHT = 20, (70, 110)


def orientation_votes(segments: DataFrame, page: str = "page_id") -> DataFrame:
    """segments (page, x1, y1, x2, y2) -> page, horizontal, vertical: how many are nearly level or upright."""
    angle = F.abs(F.degrees(F.atan2(F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1")))) % 180
    level = (angle < LEVEL) | (angle > 180 - LEVEL)
    upright = (angle > UPRIGHT[0]) & (angle < UPRIGHT[1])
    return segments.groupBy(page).agg(F.count_if(level).alias("horizontal"), F.count_if(upright).alias("vertical"))


def ordered_corners(points: DataFrame, sheet: str = "sheet_id") -> DataFrame:
    """points (sheet, place, x, y) -> sheet, corners: array of four structs from the upper left one clockwise.
    Of points that tie, the one of the least place counts, then the least point."""
    point = F.struct("x", "y")
    total, rise = F.col("x") + F.col("y"), F.col("y") - F.col("x")
    first = lambda by: F.min_by(point, F.struct(by, F.col("place"), F.col("x"), F.col("y")))
    corners = F.array(first(total), first(rise), first(-total), first(-rise))
    return points.groupBy(sheet).agg(corners.alias("corners"))


def output_names(stem: Column, line: Column) -> dict[str, Column]:
    """Names of a source's document, its text as written, and the image of one of its lines."""
    return {
        "document": F.concat(stem, F.lit("_transcribed.docx")),
        "diplomatic": F.concat(stem, F.lit("_diplomatic.txt")),
        "line_image": F.concat(stem, F.lit("_line"), padded(line, 3), F.lit(".png")),
    }
