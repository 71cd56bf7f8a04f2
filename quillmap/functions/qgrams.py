"""q-grams of strings: growing at the start, shrinking at the end.

``abcd`` has for q = 3 the grams a, ab, abc, bcd, cd, d. Lengths and positions count code points, or
bytes with ``unit="bytes"``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _checked(q: int) -> int:
    if q < 1:
        raise ValueError("q must be at least 1")
    return q


def qgram_count(s: Column, q: int, unit: str = "chars") -> Column:
    return (F.octet_length(s) if unit == "bytes" else F.char_length(s)) + F.lit(_checked(q) - 1)


def qgrams(s: Column, q: int, unit: str = "chars") -> Column:
    """All grams in order, with repeats."""
    n, source = qgram_count(s, q, unit), F.encode(s, "UTF-8") if unit == "bytes" else s

    def at(i: Column) -> Column:
        return F.when(i + 1 < q, F.substring(source, F.lit(1), i + 1)).otherwise(F.substring(source, i - (q - 2), F.lit(q)))

    none = F.array().cast("array<binary>" if unit == "bytes" else "array<string>")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), at)).otherwise(none)


def positional_qgrams(s: Column, q: int) -> Column:
    """Sorted (gram, pos) structs."""
    return F.array_sort(F.transform(qgrams(s, q), lambda g, i: F.struct(g.alias("gram"), i.alias("pos"))))


def base_length(n_grams: Column, q: int) -> Column:
    """Length of the string that has so many grams."""
    return n_grams + 1 - q


def grams_of(s: str, q: int) -> list[str]:
    """The same on the driver, for the strings of a query."""
    return [s[: i + 1] if i + 1 < q else s[i - q + 1 : i + 1] for i in range(len(s) + _checked(q) - 1)]


def overlap_counts(pairs: DataFrame, q: int, a: str = "a", b: str = "b", keys: tuple[str, ...] = ("pair_id",)) -> DataFrame:
    """``keys, overlap``: grams that the two strings of a row share, each as often as in both."""
    def counted(side: str, name: str) -> DataFrame:
        return pairs.select(*keys, F.explode(qgrams(F.col(side), q)).alias("gram")).groupBy(*keys, "gram").agg(F.count("*").alias(name))

    shared = counted(a, "ca").join(counted(b, "cb"), [*keys, "gram"]).groupBy(*keys).agg(F.sum(F.least("ca", "cb")).alias("shared"))
    return pairs.select(*keys).join(shared, list(keys), "left").select(*keys, F.coalesce("shared", F.lit(0)).alias("overlap"))
