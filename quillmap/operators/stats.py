"""Tag statistics, generated workloads, and measurements of searches."""

from __future__ import annotations

import random
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import minwise
from ..functions.geo import GeoConstraint, Rect
from ..functions.tokens import token_of
from ..plans.schemes import Predicate, all_of
from .build import gram_numbers
from .index import Index


def kv_stats(kvs: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """``k, v, n_items``: items with each tag, all or those of a set."""
    rows = kvs if items is None else kvs.join(items.select("item_id").distinct(), "item_id", "left_semi")
    return rows.select("item_id", "k", "v").distinct().groupBy("k", "v").agg(F.count("*").alias("n_items"))


def kv_topk(stats: DataFrame, k: int) -> DataFrame:
    """The ``k`` most frequent tags; ties by key and value."""
    return stats.orderBy(F.desc("n_items"), "k", "v").limit(k)


def regions_of(item_cells: DataFrame, cell_parents: DataFrame, items: DataFrame) -> DataFrame:
    """All regions above the cells of a set of items."""
    cells = item_cells.join(items, "item_id", "left_semi").select("cell_id").distinct()
    return cell_parents.join(cells, "cell_id").select("region_id").distinct()


@dataclass(frozen=True)
class Query:
    strings: tuple[str, ...]
    rects: tuple[Rect, ...] = ()

    def predicate(self) -> Predicate:
        return all_of(self.strings)

    def geo(self) -> GeoConstraint:
        return GeoConstraint(*self.rects)


def workload(kvs: DataFrame, tokens: DataFrame, count: int, initial: int = 100, branch: int = 10) -> list[Query]:
    """``count`` conjunctive queries, breadth first: the top tags, then each query with the top tags of its own answers."""
    from ..plans.schemes import StringSets

    top = [token_of(r.k, r.v) for r in kv_topk(kv_stats(kvs), initial).collect()]
    queue, at = [Query((t,)) for t in top][:count], 0
    known = {frozenset(q.strings) for q in queue}
    while at < len(queue) < count:
        q = queue[at]
        at += 1
        answers = StringSets().search(tokens, "item_id", q.predicate())
        for r in kv_topk(kv_stats(kvs, answers), branch + len(q.strings)).collect():
            t = token_of(r.k, r.v)
            key = frozenset((*q.strings, t))
            if t not in q.strings and key not in known and len(queue) < count:
                known.add(key)
                queue.append(Query((*q.strings, t)))
    return queue


def with_regions(queries: list[Query], bounds: list[Rect], most: int = 5, seed: int = 0) -> list[Query]:
    """Each query with 1..``most`` of the regions' rectangles, at offsets that favour the first ones."""
    rng, out, n = random.Random(seed), [], len(bounds)
    for q in queries:
        rects = []
        for _ in range(rng.randint(1, most) if n else 0):
            skips = 0
            while rng.random() >= 0.2:
                skips += 1
            rects.append(bounds[(skips * 10 + rng.randint(0, n // 10)) % n])
        out.append(Query(q.strings, tuple(rects)))
    return out


def timed(run) -> tuple[int, float]:
    """Rows and microseconds of one search."""
    began = time.perf_counter()
    return run().count(), (time.perf_counter() - began) * 1e6


def prune_overhead(index: Index, geo: GeoConstraint, predicate: Predicate) -> DataFrame:
    """``visited_blocks, needed_blocks, visited_items``: what a search looks into, and the blocks that hold answers."""
    visits = index.visit(geo, predicate)
    seen = visits.agg(F.count(F.when(F.col("node_type") == "block", 1)).alias("visited_blocks"), F.count(F.when(F.col("node_type") == "item", 1)).alias("visited_items"))
    needed = index.items.join(index.find(geo, predicate), "item_id", "left_semi").agg(F.countDistinct("block_id").alias("needed_blocks"))
    return seen.crossJoin(needed).select("visited_blocks", "needed_blocks", "visited_items")  # one row each


def accuracy_probe(tokens: DataFrame, sizes: list[int], family_of=lambda n: minwise.PolynomialFamily(slots=n), q: int = minwise.Q) -> DataFrame:
    """``slots, matches``: for signatures of each size, how many (item, own token) pairs match; all of them, without edits.

    Token signatures hold the longest family's slots as arrays; a shorter signature is its start.
    """
    family = family_of(max(sizes))
    signed = gram_numbers(tokens, family, q).groupBy("token").agg(*minwise.slot_minima(family)).select("token", minwise.packed(family).alias("t"))
    owned = tokens.join(signed, "token")
    items = owned.groupBy("item_id").agg(*(F.min(F.col("t")[i]).alias(h) for i, h in enumerate(minwise.slot_names(family)))).select("item_id", minwise.packed(family).alias("s"))
    fits = F.array_position(F.zip_with("s", "t", lambda a, b: a <= b), False)
    pairs = owned.join(items, "item_id").select(F.when(fits == 0, family.slots).otherwise(fits - 1).alias("first_miss"))
    each = pairs.groupBy("first_miss").count()
    wanted = F.explode(F.array(*(F.lit(n) for n in sizes)))
    return each.withColumn("slots", wanted).groupBy("slots").agg(F.sum(F.when(F.col("first_miss") >= F.col("slots"), F.col("count")).otherwise(0)).alias("matches"))
