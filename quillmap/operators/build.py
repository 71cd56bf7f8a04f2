"""Index building: tokens, inheritance along item -> cell -> region, and signatures of all schemes.

Signatures are computed once for each distinct token and then combined, since the signature of a
union of sets is the combination of their signatures.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import minwise
from ..functions.qgrams import positional_qgrams, qgrams
from ..functions.tokens import token


def own_tokens(kvs: DataFrame, key: str = "item_id") -> DataFrame:
    """Distinct tokens of each owner's tags."""
    return kvs.select(key, token(F.col("k"), F.col("v")).alias("token")).distinct()


def cell_tokens(cell_parents: DataFrame, region_kvs: DataFrame) -> DataFrame:
    """Distinct tokens of all regions above each cell."""
    return cell_parents.join(own_tokens(region_kvs, "region_id"), "region_id").select("cell_id", "token").distinct()


def inherited_tokens(item_kvs: DataFrame, item_cells: DataFrame, cell_parents: DataFrame, region_kvs: DataFrame) -> DataFrame:
    """``item_id, token``: own tokens and those of every region above any of the item's cells."""
    above = item_cells.join(cell_tokens(cell_parents, region_kvs), "cell_id").select("item_id", "token")
    return own_tokens(item_kvs).unionByName(above).distinct()


def region_tokens(item_cells: DataFrame, cell_parents: DataFrame, region_kvs: DataFrame) -> DataFrame:
    """``item_id, token`` of every region above any of the item's cells, whether or not the item has the token itself."""
    return item_cells.join(cell_tokens(cell_parents, region_kvs), "cell_id").select("item_id", "token").distinct()


def exactly_once(item_cells: DataFrame) -> DataFrame:
    """Items in the order-free sense: each once, however many cells hold it."""
    return item_cells.select("item_id").distinct()


def gram_numbers(tokens: DataFrame, family, q: int = minwise.Q) -> DataFrame:
    """``token, x``: the distinct grams of each distinct non-empty token, as numbers to hash."""
    grams = tokens.select("token").where(F.length("token") > 0).distinct().select("token", F.explode(F.array_distinct(qgrams(F.col("token"), q))).alias("gram"))
    return grams.select("token", family.number(F.col("gram")).alias("x"))


def token_signatures(tokens: DataFrame, family, q: int = minwise.Q) -> DataFrame:
    """``token, h0, h1, ...`` of each distinct token."""
    return gram_numbers(tokens, family, q).groupBy("token").agg(*minwise.slot_minima(family))


def minwise_signatures(owned: DataFrame, key: str, family, q: int = minwise.Q, signatures: DataFrame | None = None) -> DataFrame:
    """``key, h0, h1, ...``: combination of the signatures of each owner's tokens."""
    signatures = token_signatures(owned, family, q) if signatures is None else signatures
    return owned.join(signatures, "token").groupBy(key).agg(*minwise.combined(family))


def combine_above(links: DataFrame, signatures: DataFrame, via: str, key: str, family) -> DataFrame:
    """Signatures one level down: of cells from their regions, of blocks from their items."""
    return links.select(key, via).join(signatures, via).groupBy(key).agg(*minwise.combined(family))


def pqgram_signatures(owned: DataFrame, key: str, q: int = minwise.Q) -> DataFrame:
    """``key, grams, min_len, max_len``: the union of positional grams and the range of lengths."""
    per_token = owned.select("token").distinct().withColumn("grams", positional_qgrams(F.col("token"), q))
    each = owned.join(per_token, "token")
    union = each.select(key, F.explode("grams").alias("g")).distinct().groupBy(key).agg(F.collect_list("g").alias("grams"))
    lengths = owned.groupBy(key).agg(F.min(F.char_length("token")).alias("min_len"), F.max(F.char_length("token")).alias("max_len"))
    return union.join(lengths, key).select(key, F.array_sort("grams").alias("grams"), "min_len", "max_len")


def string_sets(owned: DataFrame, key: str) -> DataFrame:
    """``key, tokens``: sorted distinct tokens."""
    return owned.groupBy(key).agg(F.array_sort(F.collect_set("token")).alias("tokens"))


def long_form(signatures: DataFrame, key: str, family) -> DataFrame:
    """``key, slot, value`` rows."""
    return signatures.select(key, F.posexplode(minwise.packed(family)).alias("slot", "value"))


def dedup_encode(signatures: DataFrame, key: str, sig: Column) -> tuple[DataFrame, DataFrame]:
    """Dictionary encoding: ``key, sig_id`` and ``sig_id, sig``. Ids are 128-bit digests, so nothing is gathered to number them and none coincide."""
    keyed = signatures.select(key, sig.alias("sig")).withColumn("sig_id", F.md5(F.to_json(F.struct("sig"))))
    return keyed.select(key, "sig_id"), keyed.select("sig_id", "sig").dropDuplicates(["sig_id"])


def dedup_decode(encoded: DataFrame, dictionary: DataFrame) -> DataFrame:
    return encoded.join(dictionary, "sig_id").drop("sig_id")
