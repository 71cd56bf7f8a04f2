"""Set algebra over tables of item ids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame


def unite(*sets: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, (s.select("item_id") for s in sets)).distinct()


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("item_id").intersect(b.select("item_id"))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("item_id").distinct().join(b, "item_id", "left_anti")


def flatten(cells: DataFrame) -> DataFrame:
    """Items of a result that is split by cell, each once."""
    return cells.select("item_id").distinct()
