"""String predicates as trees, and the three signature schemes that evaluate them.

A predicate is a tree of strings with AND (``a / b``) and OR (``a + b``). A scheme turns a leaf into a
Column over its own stored signature, and evaluates whole trees over token tables without one.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import minwise
from ..functions.qgrams import grams_of, positional_qgrams
from ..operators import build


class Predicate:
    def __truediv__(self, other: Predicate) -> Predicate:
        return And(self, other)

    def __add__(self, other: Predicate) -> Predicate:
        return Or(self, other)


@dataclass(frozen=True)
class Has(Predicate):
    """The string itself, or one within ``ed`` edits, or with ``prefix`` one that starts with it."""

    text: str
    ed: int = 0
    prefix: bool = False


@dataclass(frozen=True)
class And(Predicate):
    left: Predicate
    right: Predicate


@dataclass(frozen=True)
class Or(Predicate):
    left: Predicate
    right: Predicate


@dataclass(frozen=True)
class Everything(Predicate):
    """No string constraint."""


def all_of(strings, ed: int = 0) -> Predicate:
    """AND of strings; none constrain nothing."""
    leaves = [Has(s, ed) for s in strings]
    return reduce(And, leaves) if leaves else Everything()


def leaves(p: Predicate) -> list[Has]:
    if isinstance(p, Has):
        return [p]
    return [] if isinstance(p, Everything) else [*leaves(p.left), *leaves(p.right)]


def fold(p: Predicate, leaf) -> Column:
    """The tree as one Column."""
    if isinstance(p, Has):
        return leaf(p)
    if isinstance(p, Everything):
        return F.lit(True)
    a, b = fold(p.left, leaf), fold(p.right, leaf)
    return a & b if isinstance(p, And) else a | b


class SignatureScheme(Protocol):
    def build(self, owned: DataFrame, key: str) -> DataFrame: ...

    def combine(self, signatures: DataFrame, *keys: str) -> DataFrame: ...

    def may_match(self, leaf: Has) -> Column: ...


def _no_prefix(leaf: Has) -> None:
    if leaf.prefix:
        raise NotImplementedError("only string sets answer prefixes")


@dataclass(frozen=True)
class MinWise:
    """Signatures in columns h0, h1, ..."""

    family: object = minwise.PolynomialFamily()
    q: int = minwise.Q

    def build(self, owned: DataFrame, key: str) -> DataFrame:
        return build.minwise_signatures(owned, key, self.family, self.q)

    def combine(self, signatures: DataFrame, *keys: str) -> DataFrame:
        return signatures.groupBy(*keys).agg(*minwise.combined(self.family))

    def may_match(self, leaf: Has) -> Column:
        _no_prefix(leaf)
        if leaf.ed:
            return minwise.may_match(minwise.packed(self.family), self.family, leaf.text, leaf.ed, self.q)
        ref = minwise.signature_of(self.family, [leaf.text], self.q)
        return reduce(Column.__and__, (F.col(h) <= F.lit(r) for h, r in zip(minwise.slot_names(self.family), ref)))

    def search(self, owned: DataFrame, key: str, p: Predicate) -> DataFrame:
        """Owners whose tokens satisfy the tree, without stored signatures: two longs for each leaf and owner."""
        found = list(dict.fromkeys(leaves(p)))
        if not found:
            return owned.select(key).distinct()
        bits, names = [], {}
        for i, leaf in enumerate(found):
            _no_prefix(leaf)
            names[leaf] = f"below{i}", f"within{i}"
            bits += [m.alias(n) for m, n in zip(minwise.slot_masks(self.family, leaf.text, "x", self.q), names[leaf])]
        columns = [n for pair in names.values() for n in pair]
        either = [F.bit_or(n).alias(n) for n in columns]
        masks = build.gram_numbers(owned, self.family, self.q).select("token", *bits).groupBy("token").agg(*either)
        owners = owned.join(masks, "token").groupBy(key).agg(*either)
        test = lambda leaf: minwise.masks_match(*map(F.col, names[leaf]), self.family, leaf.text, leaf.ed, self.q)
        return owners.where(fold(p, test)).select(key)


@dataclass(frozen=True)
class PositionalQGrams:
    """Signatures in columns grams (sorted gram, pos structs), min_len and max_len; lossless at any edit distance."""

    q: int = minwise.Q

    def build(self, owned: DataFrame, key: str) -> DataFrame:
        return build.pqgram_signatures(owned, key, self.q)

    def combine(self, signatures: DataFrame, *keys: str) -> DataFrame:
        grams = signatures.select(*keys, F.explode("grams").alias("g")).distinct().groupBy(*keys).agg(F.array_sort(F.collect_list("g")).alias("grams"))
        return grams.join(signatures.groupBy(*keys).agg(F.min("min_len").alias("min_len"), F.max("max_len").alias("max_len")), list(keys))

    def may_match(self, leaf: Has) -> Column:
        """Length filter, then count filter over gram ids with positions ignored, each occurrence used once."""
        _no_prefix(leaf)
        n, counts = len(leaf.text), {}
        if not n:
            return F.lit(False)
        for g in grams_of(leaf.text, self.q):
            counts[g] = counts.get(g, 0) + 1
        wanted = F.array(*(F.struct(F.lit(g).alias("gram"), F.lit(c).alias("n")) for g, c in counts.items()))
        names = F.transform("grams", lambda x: x["gram"])
        shared = F.aggregate(wanted, F.lit(0), lambda s, w: s + F.least(w["n"], F.size(F.filter(names, lambda g: g == w["gram"]))))
        return self._passes(leaf, shared)

    def _passes(self, leaf: Has, shared: Column) -> Column:
        n = len(leaf.text)
        lengths = (F.lit(n) <= F.col("max_len") + leaf.ed) & (F.lit(n + leaf.ed) >= F.col("min_len"))
        return lengths & (shared >= n - 1 - (leaf.ed - 1) * self.q)

    def search(self, owned: DataFrame, key: str, p: Predicate) -> DataFrame:
        """Owners whose tokens satisfy the tree, without stored signatures: only grams of the query leave the tokens."""
        found = list(dict.fromkeys(leaves(p)))
        if not found:
            return owned.select(key).distinct()
        counts: dict[Has, dict[str, int]] = {}
        for leaf in found:
            _no_prefix(leaf)
            counts[leaf] = {}
            for g in grams_of(leaf.text, self.q):
                counts[leaf][g] = counts[leaf].get(g, 0) + 1
        asked = sorted(set().union(*counts.values()))
        wanted = F.filter(positional_qgrams(F.col("token"), self.q), lambda x: x["gram"].isin(asked))
        tokens = owned.select("token").distinct().select("token", F.char_length("token").alias("len"), wanted.alias("grams"))
        each = owned.join(tokens, "token")
        lengths = each.groupBy(key).agg(F.min("len").alias("min_len"), F.max("len").alias("max_len"))
        grams = each.select(key, F.explode("grams").alias("g")).distinct().groupBy(key, F.col("g.gram").alias("gram")).agg(F.count("*").alias("n"))

        def share(leaf: Has) -> Column:
            if not counts[leaf]:
                return F.sum(F.lit(0))
            ref = F.create_map(*(F.lit(x) for pair in counts[leaf].items() for x in pair))
            return F.sum(F.least("n", F.coalesce(F.element_at(ref, F.col("gram")), F.lit(0))))

        shared = grams.groupBy(key).agg(*(share(leaf).alias(f"leaf{i}") for i, leaf in enumerate(found)))
        both = lengths.join(shared, key, "left")
        test = lambda leaf: self._passes(leaf, F.coalesce(f"leaf{found.index(leaf)}", F.lit(0))) if leaf.text else F.lit(False)
        return both.where(fold(p, test)).select(key)


@dataclass(frozen=True)
class StringSets:
    """Signatures in column tokens; exact, without edits."""

    def build(self, owned: DataFrame, key: str) -> DataFrame:
        return build.string_sets(owned, key)

    def combine(self, signatures: DataFrame, *keys: str) -> DataFrame:
        each = signatures.select(*keys, F.explode("tokens").alias("token"))
        return each.groupBy(*keys).agg(F.array_sort(F.collect_set("token")).alias("tokens"))

    def may_match(self, leaf: Has) -> Column:
        if leaf.ed:
            raise NotImplementedError("string sets know no edit distance; use positional q-grams, or verify")
        return F.exists("tokens", lambda t: t.startswith(leaf.text)) if leaf.prefix else F.array_contains("tokens", leaf.text)

    def search(self, owned: DataFrame, key: str, p: Predicate) -> DataFrame:
        """Owners whose tokens satisfy the tree, from the token table alone: one flag for each leaf and owner."""
        found = list(dict.fromkeys(leaves(p)))
        if not found:
            return owned.select(key).distinct()
        hit = lambda leaf: F.col("token").startswith(leaf.text) if leaf.prefix else F.col("token") == leaf.text
        for leaf in found:
            self.may_match(leaf)
        relevant = owned.where(reduce(Column.__or__, map(hit, found)))
        flags = relevant.groupBy(key).agg(*(F.max(hit(leaf)).alias(f"leaf{i}") for i, leaf in enumerate(found)))
        return flags.where(fold(p, lambda leaf: F.col(f"leaf{found.index(leaf)}"))).select(key)


SCHEMES = {"minwise": MinWise, "qgram": PositionalQGrams, "stringset": StringSets}


def verified(owned: DataFrame, key: str, p: Predicate) -> DataFrame:
    """Owners that truly satisfy the tree: token equality, or Levenshtein distance within the leaf's edits."""
    found = list(dict.fromkeys(leaves(p)))
    if not found:
        return owned.select(key).distinct()

    def hit(leaf: Has) -> Column:
        if leaf.prefix:
            return F.col("token").startswith(leaf.text)
        return F.levenshtein("token", F.lit(leaf.text), leaf.ed) >= 0 if leaf.ed else F.col("token") == leaf.text

    relevant = owned.where(reduce(Column.__or__, map(hit, found)))
    flags = relevant.groupBy(key).agg(*(F.max(hit(leaf)).alias(f"leaf{i}") for i, leaf in enumerate(found)))
    return flags.where(fold(p, lambda leaf: F.col(f"leaf{found.index(leaf)}"))).select(key)
