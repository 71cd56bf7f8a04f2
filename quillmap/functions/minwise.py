"""Min-wise hashing of gram sets.

Slot i of a signature is the least value of hash function i over the grams. Hash functions are
polynomials over a prime field with coefficients from a seed, so that any engine can repeat them.
"""

from __future__ import annotations

import random
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .qgrams import grams_of

SLOTS, Q = 56, 3
PRIME_31, PRIME_61 = 2**31 - 1, 2**61 - 1


def byte_number(g: Column, prime: int = PRIME_31) -> Column:
    """A string's bytes as a little-endian number modulo ``prime``.

    Up to three ASCII bytes are plain arithmetic, anything else folds over the bytes; 256 times a
    residue stays within a long for either prime.
    """
    n = F.octet_length(g)
    at = lambda i: F.when(n > i, F.ascii(F.substring(g, i + 1, 1))).otherwise(0).cast("long")
    short = at(0) + 256 * at(1) + 65536 * at(2)
    raw = F.encode(g, "UTF-8")
    byte = lambda i: F.conv(F.hex(F.substring(raw, i, F.lit(1))), 16, 10).cast("decimal(38,0)")
    fold = F.aggregate(F.reverse(F.sequence(F.lit(1), n)), F.lit(0).cast("decimal(38,0)"), lambda s, i: ((s * 256 + byte(i)) % F.lit(prime)).cast("decimal(38,0)")).cast("long")
    plain = (F.char_length(g) == n) & (n <= 3)
    return F.when(n == 0, F.lit(0).cast("long")).when(plain, short % F.lit(prime)).otherwise(fold)


def byte_number_of(g: str, prime: int = PRIME_31) -> int:
    return int.from_bytes(g.encode(), "little") % prime


@dataclass(frozen=True)
class PolynomialFamily:
    """Hash functions c0*x^(d-1) + ... + c(d-1) mod prime; 31-bit arithmetic in longs, 61-bit in decimals."""

    slots: int = SLOTS
    degree: int = 2
    prime: int = PRIME_31
    seed: int = 42
    coefficients: tuple[tuple[int, ...], ...] = field(init=False)

    def __post_init__(self):
        rng = random.Random(self.seed)
        rows = tuple((rng.randrange(1, self.prime), *(rng.randrange(self.prime) for _ in range(self.degree - 1))) for _ in range(self.slots))
        object.__setattr__(self, "coefficients", rows)

    def number(self, gram: Column) -> Column:
        return byte_number(gram, self.prime)

    def hash(self, i: int, x: Column) -> Column:
        kind = "long" if self.prime < 1 << 32 else "decimal(19,0)"
        c = [F.lit(v).cast(kind) for v in self.coefficients[i]]
        x = x.cast(kind)
        step = lambda acc, v: ((acc * x + v) % F.lit(self.prime).cast(kind)).cast(kind)
        return reduce(step, c[1:], c[0]).cast("long")

    def hash_of(self, i: int, gram: str) -> int:
        x = byte_number_of(gram, self.prime)
        return reduce(lambda acc, v: (acc * x + v) % self.prime, self.coefficients[i][1:], self.coefficients[i][0])


@dataclass(frozen=True)
class ShaFamily:
    """Hash functions of 60 bits from a keyed SHA-256 digest."""

    slots: int = SLOTS
    seed: int = 42

    def number(self, gram: Column) -> Column:
        return gram

    def hash(self, i: int, x: Column) -> Column:
        return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{self.seed}:{i}:"), x), 256), 1, 15), 16, 10).cast("long")

    def hash_of(self, i: int, gram: str) -> int:
        import hashlib

        return int(hashlib.sha256(f"{self.seed}:{i}:{gram}".encode()).hexdigest()[:15], 16)


def slot_names(family) -> list[str]:
    return [f"h{i}" for i in range(family.slots)]


def slot_minima(family, number: str = "x") -> list[Column]:
    """Aggregates h0, h1, ... over rows of grams."""
    return [F.min(family.hash(i, F.col(number))).alias(h) for i, h in enumerate(slot_names(family))]


def combined(family) -> list[Column]:
    """Aggregates that combine signatures: the least value in each slot."""
    return [F.min(h).alias(h) for h in slot_names(family)]


def packed(family) -> Column:
    return F.array(*slot_names(family)).alias("sig")


def combine(a: Column, b: Column) -> Column:
    """Signature of the union of two gram sets, from packed signatures."""
    return F.zip_with(a, b, F.least)


def agreement(a: Column, b: Column) -> Column:
    """Slots in which two packed signatures agree."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda z: z))


def resemblance(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of the gram sets."""
    return agreement(a, b) / F.size(a).cast("double")


def signature_of(family, strings: list[str], q: int = Q) -> list[int]:
    """Signature of the query's own strings, on the driver; an empty string or set has none."""
    if not strings or "" in strings:
        raise ValueError("a signature needs strings, and none of them empty")
    grams = {g for s in strings for g in grams_of(s, q)}
    return [min(family.hash_of(i, g) for g in grams) for i in range(family.slots)]


def threshold(s: str, ed: int, q: int = Q) -> tuple[int, int]:
    """Grams of the query string, and those that ``ed`` edits leave at least."""
    n = len(s) + q - 1
    return n, n - ed * q


def may_match(sig: Column, family, s: str, ed: int = 0, q: int = Q) -> Column:
    """Whether a set with packed signature ``sig`` may hold a string within ``ed`` edits of ``s``.

    Without edits no slot may exceed the query's. With edits the share of equal slots among those not
    below it has to reach the share of grams that edits leave; that estimate can miss matches.
    """
    n, least = threshold(s, ed, q)
    ref = F.array(*(F.lit(v).cast("long") for v in signature_of(family, [s], q)))
    if ed == 0:
        return F.forall(F.zip_with(sig, ref, lambda a, b: a <= b), lambda z: z)
    above = F.size(F.filter(F.zip_with(sig, ref, lambda a, b: b <= a), lambda z: z))
    return (above == 0) | (agreement(sig, ref) * n >= least * above)


def slot_masks(family, s: str, number: str = "x", q: int = Q) -> tuple[Column, Column]:
    """Of a gram, the slots in which it hashes below the query string's signature, and at or below it, as bits.

    Over a set of grams ``bit_or`` of these tells what comparing the set's signature would, in two longs
    instead of one aggregate for each slot; so a query needs no stored signatures. Up to 63 slots.
    """
    if family.slots > 63:
        raise ValueError("masks hold 63 slots at most")
    ref = signature_of(family, [s], q)
    below, within = [], []
    for i, r in enumerate(ref):
        h, bit = family.hash(i, F.col(number)), F.lit(1 << i).cast("long")
        below.append(F.when(h < r, bit).otherwise(F.lit(0).cast("long")))
        within.append(F.when(h <= r, bit).otherwise(F.lit(0).cast("long")))
    total = lambda bits: reduce(Column.bitwiseOR, bits)
    return total(below), total(within)


def masks_match(below: Column, within: Column, family, s: str, ed: int = 0, q: int = Q) -> Column:
    """The predicate of ``may_match`` from a set's masks."""
    if ed == 0:
        return within == F.lit((1 << family.slots) - 1)
    n, least = threshold(s, ed, q)
    equal, above = F.bit_count(within.bitwiseAND(F.bitwise_not(below))), family.slots - F.bit_count(below)
    return (above == 0) | (equal * n >= least * above)
