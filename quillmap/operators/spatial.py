"""Spatial operators over tables of rectangles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import SIDES, GeoConstraint, enclosing, overlap


def find_in(items: DataFrame, geo: GeoConstraint) -> DataFrame:
    """Distinct ids of items whose rectangle satisfies the constraint: filters only, pushed into the scan."""
    return items.where(geo.column()).select("item_id").distinct()


def bounding_boxes(rows: DataFrame, *keys: str) -> DataFrame:
    """Smallest rectangle around each group's."""
    return rows.groupBy(*keys).agg(*enclosing())


def _sides(df: DataFrame, prefix: str) -> DataFrame:
    """The rectangles, and the longer side of each."""
    df = df.withColumns({prefix + s: F.col(s).cast("double") for s in SIDES})
    return df.withColumn(f"{prefix}side", F.greatest(F.col(f"{prefix}lat_max") - F.col(f"{prefix}lat_min"), F.col(f"{prefix}lon_max") - F.col(f"{prefix}lon_min")))


def _grid(df: DataFrame, prefix: str, levels: list[int]) -> DataFrame:
    """A row for each grid cell that the rectangle touches, on its own level and each coarser one of ``levels``."""
    df = df.withColumn("level", F.explode(F.filter(F.array(*map(F.lit, levels)), lambda x: x >= F.col(f"{prefix}level"))))
    cells = lambda axis: F.explode(F.sequence(F.floor(F.col(f"{prefix}{axis}_min") / F.pow(F.lit(2.0), "level")), F.floor(F.col(f"{prefix}{axis}_max") / F.pow(F.lit(2.0), "level"))))
    return df.withColumn("grid_y", cells("lat")).withColumn("grid_x", cells("lon"))


def overlapping_pairs(items: DataFrame, rects: DataFrame) -> DataFrame:
    """``item_id, rect_id`` of all overlaps: an equi-join on the grid cells both touch, then the exact test.

    A rectangle's level is that of the grid whose cells, a power of two wide, are just larger than it, so it
    touches four cells at most, in any unit and however large it is; rectangles smaller than the mean are of the mean's level. Two rectangles meet
    on the coarser one's level, in the cell in which the overlap's lower corner lies, so no pair comes
    twice and nothing has to be made distinct.
    """
    left, right = _sides(items, "i_"), _sides(rects, "r_")
    mean = left.select(F.col("i_side").alias("side")).unionByName(right.select(F.col("r_side").alias("side"))).agg(F.avg("side")).first()[0]
    level = lambda side: F.ceil(F.log2(F.greatest(side, F.lit(float(mean or 1.0))))).cast("int")
    left, right = left.withColumn("i_level", level("i_side")), right.withColumn("r_level", level("r_side"))
    # a few dozen levels at most
    levels = sorted({r[0] for r in left.select("i_level").unionByName(right.select(F.col("r_level").alias("i_level"))).distinct().collect() if r[0] is not None})
    if not levels:
        return items.crossJoin(rects.limit(0)).select("item_id", "rect_id")  # nothing to join
    left = _grid(left.select("item_id", "i_level", *(f"i_{s}" for s in SIDES)), "i_", levels)
    right = _grid(right.select("rect_id", "r_level", *(f"r_{s}" for s in SIDES)), "r_", levels)
    corner = lambda axis: F.floor(F.greatest(f"i_{axis}_min", f"r_{axis}_min") / F.pow(F.lit(2.0), "level"))
    both = left.join(right, ["level", "grid_y", "grid_x"]).where(overlap("i_", "r_") & (F.col("level") == F.greatest("i_level", "r_level")))
    return both.where((F.col("grid_y") == corner("lat")) & (F.col("grid_x") == corner("lon"))).select("item_id", "rect_id")


def semi_join(items: DataFrame, rects: DataFrame) -> DataFrame:
    """Distinct ids of items that overlap any of the rectangles in a table."""
    return overlapping_pairs(items, rects).select("item_id").distinct()
