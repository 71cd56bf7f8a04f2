"""Tokens of key/value tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def token(key: Column, value: Column) -> Column:
    """``@key:value`` in lower case."""
    return F.lower(F.concat(F.lit("@"), key, F.lit(":"), value))


def token_of(key: str, value: str) -> str:
    return f"@{key}:{value}".lower()
