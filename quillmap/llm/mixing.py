"""Mixing sources to target weights by repetition rates and one seeded Bernoulli copy.

Documents differ much in size, so a small source's draws can miss its target by a good part. Every source
therefore has ``DRAWS`` seeds to choose from, each an own set of Bernoulli draws with the same probability,
and takes the one whose words come nearest to its target.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import stash

#: Weights of the sources in order, repeating.
WEIGHTS = (3, 1, 2)
#: Words the mix takes in all, in percent of the words there are, and the most a source may repeat.
SHARE_PERCENT, CAP = 150, 2
WORD = r"[^\x20\x09-\x0D]+"
DRAWS = 16


def sizes(docs: DataFrame) -> DataFrame:
    """Words of each text, null having none."""
    return docs.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))


def source_targets(sized: DataFrame) -> DataFrame:
    """``source, source_size, target`` from rows of (source, size).

    Sources weigh 3, 1, 2, repeating, by code point with null last. Targets share 150% of all words
    by weight; none is above twice its source, and what that leaves over is shared again by weight
    until none is above. With sources by rising size/weight the full ones come first, so running sums
    give the level at which the rest share. One row for each source is all that is gathered.
    """
    per = stash(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*(F.lit(w).cast("long") for w in WEIGHTS)), (place % len(WEIGHTS) + 1).cast("int"))
    ranked = per.withColumn("weight", weight)
    by_fill = Window.orderBy((F.col("source_size") / F.col("weight")), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    # 200 times the words left for this source and those after it, once all before it are full
    left = SHARE_PERCENT * F.sum("source_size").over(everything) - 100 * CAP * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    fills = ranked.withColumns({"left": left, "rest": F.sum("weight").over(onward)})
    fills = fills.withColumn("full", F.col("left") * F.col("weight") >= 100 * CAP * F.col("source_size") * F.col("rest"))
    # the first source that is not full sets the level for itself and all after it
    level = F.struct("left", "rest")
    first = F.first(F.when(~F.col("full"), level), ignorenulls=True).over(by_fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    fills = fills.withColumn("level", first)
    shared = (F.col("level.left") * F.col("weight")).cast("double") / (100 * F.col("level.rest")).cast("double")
    capped = (CAP * F.col("source_size")).cast("double")
    return fills.select("source", "source_size", F.when(F.col("full"), capped).otherwise(shared).alias("target"))


def _key() -> F.Column:
    """What a row's draws depend on: doc_id, or the text where that is null."""
    return F.coalesce(F.col("doc_id").cast("string"), F.md5("text"), F.lit(""))


def _draw(seed: int, key: F.Column, k: F.Column) -> F.Column:
    """The k-th draw of a key, uniform in [0, 1): 32 bits of an MD5 digest, which holds four of them."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.floor(k / 4).cast("string"), F.lit(":"), key))
    return F.conv(F.substring(digest, (k % 4 * 8 + 1).cast("int"), F.lit(8)), 16, 10).cast("double") / F.lit(float(1 << 32))


def _rate() -> F.Column:
    return F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)


def source_draws(slim: DataFrame, seed: int) -> DataFrame:
    """``of_source, source_size, target, k``: each source's target, and the draw that comes nearest to it, the first of equals.

    From rows of (source, size, key); one aggregation with a sum for each draw.
    """
    targets = stash(source_targets(slim.select("source", "size")), "targets")
    targets = targets.select(F.col("source").alias("of_source"), "source_size", "target")
    joined = slim.join(targets, slim.source.eqNullSafe(targets.of_source))
    rate = _rate()
    sums = [F.sum(F.when(_draw(seed, F.col("key"), F.lit(k)) < rate - F.floor(rate), F.col("size")).otherwise(0)) for k in range(DRAWS)]
    each = joined.groupBy("of_source", "source_size", "target").agg(F.array(*sums).alias("extra"))
    miss = F.transform("extra", lambda x: F.abs(F.floor(rate) * F.col("source_size") + x - F.col("target")))
    return stash(each.select("of_source", "source_size", "target", (F.array_position(miss, F.array_min(miss)) - 1).cast("long").alias("k")), "draws")


def copies(docs: DataFrame, seed: int = 20240229) -> DataFrame:
    """``docs`` with ``size, source_size, target`` of its source and ``copies`` to emit.

    rate = target / source_size; a row is emitted floor(rate) times, and once more where a draw from a hash of ``seed``
    and doc_id (of the text where that is null) is below rate - floor(rate); reruns and any
    partitioning agree, and repeated rows draw alike. Every one of a source's DRAWS sets of draws has
    that probability; the set taken is the one whose words come nearest to the target, so given the
    others a row's copy depends a little on its size. Texts count whole, however long, and no rows give no rows. A null text has size 0 and its row is mixed like
    the rest of its source; a source without words has target 0 and none of its rows is emitted.
    Columns of ``docs`` by these names are replaced.
    """
    sized = sizes(docs.drop("size", "source_size", "target", "copies"))
    draws = source_draws(stash(sized.select("source", "size", _key().alias("key")), "slim"), seed)
    found = sized.join(draws, sized.source.eqNullSafe(draws.of_source), "left")
    rate = _rate()
    extra = (_draw(seed, _key(), F.col("k")) < rate - F.floor(rate)).cast("long")
    return found.withColumn("copies", (F.floor(rate) + extra).cast("long")).drop("of_source", "k")


def mix(docs: DataFrame, seed: int = 20240229) -> DataFrame:
    """Each row of ``docs`` as often as ``copies`` says, with the columns of ``docs``."""
    rows = copies(docs.select("doc_id", "text", "source", F.struct("*").alias("row")), seed)
    return rows.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def op4_mixing_sources(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return copies(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
