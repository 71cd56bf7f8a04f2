"""Searching without an index, textual queries, and the cell-wise baseline."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame

from ..functions.geo import GeoConstraint
from ..plans.schemes import Has, Predicate, StringSets
from ..plans.textquery import Area, Both, Either, Text, parse
from . import idsets
from .build import own_tokens


def find(items: DataFrame, tokens: DataFrame, geo: GeoConstraint, predicate: Predicate, scheme) -> DataFrame:
    """Distinct ids of items in ``geo`` whose tokens may satisfy ``predicate``.

    Items are filtered by geometry before their tokens are looked at.
    """
    inside = items.where(geo.column()).select("item_id")
    matching = scheme.search(tokens.join(inside, "item_id", "left_semi"), "item_id", predicate)
    return matching.select("item_id").distinct()


def missed(exact: DataFrame, candidates: DataFrame) -> DataFrame:
    """Exact answers that a candidate set lacks."""
    return idsets.difference(exact, candidates)


def _area(node) -> GeoConstraint | None:
    """The constraint of a part of a query that has areas only: ``/`` is where they meet, ``+`` either."""
    if isinstance(node, Area):
        return node.geo
    if isinstance(node, Text) or (left := _area(node.left)) is None or (right := _area(node.right)) is None:
        return None
    return left / right if isinstance(node, Both) else left + right


def _conjuncts(node) -> list:
    return [*_conjuncts(node.left), *_conjuncts(node.right)] if isinstance(node, Both) else [node]


def run_text(query: str, items: DataFrame, tokens: DataFrame | None, scheme=None, item_kvs: DataFrame | None = None, region_tokens: DataFrame | None = None, matching=None) -> DataFrame:
    """Distinct ids of items that satisfy a textual query, see ``plans.textquery``.

    ``item_kvs`` serves ``#word`` (own tags), ``region_tokens`` (item_id, token of the regions above it) ``!word``. What
    stands together with areas is looked for only among the items in the place where these meet. ``matching``, if given,
    takes an unscoped string's predicate to the items that may have it, in place of ``tokens``.
    """
    scheme = scheme or StringSets()

    def owned(scope: str) -> DataFrame:
        if scope == "any":
            return tokens
        if (item_kvs if scope == "item" else region_tokens) is None:
            raise ValueError("scoped strings need the items' own tags, or their regions' tokens")
        return own_tokens(item_kvs) if scope == "item" else region_tokens

    def answer(node, inside: DataFrame | None) -> DataFrame:
        """Ids among ``inside``, or among all where that is None."""
        among = lambda df: df if inside is None else df.join(inside, "item_id", "left_semi")
        if isinstance(node, Text) and node.scope == "any" and matching is not None:
            return among(matching(Has(node.value, node.ed))).select("item_id")
        if isinstance(node, Text):
            return scheme.search(among(owned(node.scope)), "item_id", Has(node.value, node.ed)).select("item_id").distinct()
        if (geo := _area(node)) is not None:
            return among(items.where(geo.column())).select("item_id").distinct()
        if isinstance(node, Either):
            return idsets.unite(answer(node.left, inside), answer(node.right, inside))
        parts = _conjuncts(node)
        areas = [geo for part in parts if (geo := _area(part)) is not None]
        if areas:
            inside = among(items.where(reduce(GeoConstraint.__truediv__, areas).column())).select("item_id").distinct()
        return reduce(idsets.intersect, (answer(part, inside) for part in parts if _area(part) is None))

    return answer(parse(query), None)


def two_stage(items: DataFrame, tokens: DataFrame, item_cells: DataFrame, cells: DataFrame, geo: GeoConstraint, predicate: Predicate, scheme=None) -> DataFrame:
    """The baseline: string filter, then cells by their rectangle, then the items of those by their own."""
    matching = (scheme or StringSets()).search(tokens, "item_id", predicate)
    near = cells.where(geo.column()).select("cell_id")
    in_cells = item_cells.join(near, "cell_id", "left_semi").join(matching, "item_id", "left_semi")
    return items.where(geo.column()).join(idsets.flatten(in_cells), "item_id", "left_semi").select("item_id")
