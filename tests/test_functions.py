"""Properties of q-grams, geometry and min-wise hashing."""

import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmap.functions import minwise
from quillmap.functions.geo import GeoConstraint, Rect
from quillmap.functions.qgrams import grams_of, qgrams
from quillmap.plans.schemes import And, Everything, Has, Or, all_of
from quillmap.plans.textquery import Both, Either, QuerySyntaxError, Text, parse, render


def test_grams_by_hand():
    assert grams_of("abcd", 3) == ["a", "ab", "abc", "bcd", "cd", "d"]
    assert grams_of("ab", 3) == ["a", "ab", "ab", "b"]
    assert grams_of("", 3) == ["", ""]
    assert grams_of("", 1) == []
    with pytest.raises(ValueError):
        grams_of("a", 0)


def test_columns_agree_with_driver(spark):
    words = ["", "a", "ab", "aaaa", "abcd", "@region:europe", "crème brûlée", "日本語の文字"]
    df = spark.createDataFrame([(w,) for w in words], "s string")
    for q in (1, 2, 3, 4):
        for r in df.select("s", qgrams(F.col("s"), q).alias("g"), qgrams(F.col("s"), q, "bytes").alias("b")).collect():
            assert r.g == grams_of(r.s, q)
            raw = r.s.encode()
            assert [bytes(x) for x in r.b] == [raw[: i + 1] if i + 1 < q else raw[i - q + 1 : i + 1] for i in range(len(raw) + q - 1)]


def test_overlap_survives_spaced_edits():
    """A string shares len + q - 1 - e*q grams at least with one that e edits, q apart, have changed."""
    rng = random.Random(0)
    for _ in range(2000):
        s = "".join(rng.choice("123456789") for _ in range(rng.randint(5, 10)))
        q = rng.randint(1, 4)
        start = rng.randrange(len(s))
        changed, e = list(s), 0
        for i in range(start, len(s), q):
            changed[i] = chr(ord(changed[i]) + 1)
            e += 1
        shared = sum((Counter(grams_of(s, q)) & Counter(grams_of("".join(changed), q))).values())
        assert shared >= len(s) + q - 1 - e * q


@pytest.mark.parametrize("family", [minwise.PolynomialFamily(slots=6), minwise.PolynomialFamily(slots=4, degree=3), minwise.PolynomialFamily(slots=4, prime=minwise.PRIME_61), minwise.ShaFamily(slots=4)])
def test_hash_columns_agree_with_driver(spark, family):
    grams = ["", "a", "@r", "abc", "zz", "é", "日本", "longer gram"]
    df = spark.createDataFrame([(g,) for g in grams], "g string").withColumn("x", family.number(F.col("g")))
    for r in df.select("g", *(family.hash(i, F.col("x")).alias(f"h{i}") for i in range(family.slots))).collect():
        assert [r[f"h{i}"] for i in range(family.slots)] == [family.hash_of(i, r.g) for i in range(family.slots)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abcd", min_size=1, max_size=8), min_size=1, max_size=4), st.lists(st.text("abcd", min_size=1, max_size=8), min_size=1, max_size=4))
def test_signature_of_union_is_combination(a, b):
    family = minwise.PolynomialFamily(slots=8)
    sa, sb = minwise.signature_of(family, a), minwise.signature_of(family, b)
    union = minwise.signature_of(family, a + b)
    assert union == [min(x, y) for x, y in zip(sa, sb)]
    assert all(u <= x for u, x in zip(union, sa))  # no string of the set is ever missed without edits


def test_signature_needs_strings():
    for bad in ([], [""], ["a", ""]):
        with pytest.raises(ValueError):
            minwise.signature_of(minwise.PolynomialFamily(slots=2), bad)


def test_packed_and_mask_forms_agree(spark):
    family = minwise.PolynomialFamily(slots=16)
    rng = random.Random(1)
    sets = [(i, ["".join(rng.choice("abc") for _ in range(rng.randint(1, 6))) for _ in range(3)]) for i in range(60)]
    df = spark.createDataFrame([(i, minwise.signature_of(family, s), g) for i, s in sets for x in s for g in grams_of(x, 3)], "i int, sig array<long>, g string").withColumn("x", family.number(F.col("g")))
    for ed in (0, 1, 2, 9):
        below, within = minwise.slot_masks(family, "abcab")
        masks = df.select("i", "sig", below.alias("b"), within.alias("w")).groupBy("i").agg(F.bit_or("b").alias("b"), F.bit_or("w").alias("w"), F.first("sig").alias("sig"))
        for r in masks.select(minwise.may_match(F.col("sig"), family, "abcab", ed).alias("p"), minwise.masks_match(F.col("b"), F.col("w"), family, "abcab", ed).alias("m")).collect():
            assert r.p == r.m
            assert r.p or ed < 9  # a threshold of nothing lets all pass


def test_geometry():
    a, b, c = Rect(0, 10, 0, 10), Rect(10, 20, 10, 20), Rect(11, 12, 0, 1)
    assert a.overlaps(b) and not a.overlaps(c)
    assert (GeoConstraint(a) / GeoConstraint(b)).rects == (Rect(10, 10, 10, 10),)
    assert (GeoConstraint(a) / GeoConstraint(c)).empty()
    assert not GeoConstraint().intersects(a)
    both = GeoConstraint(a, c) / GeoConstraint(b)
    assert not both.intersects(Rect(0, 5, 0, 5)) and (GeoConstraint(a) + GeoConstraint(c)).intersects(Rect(0, 5, 0, 5))


def test_predicates_and_text():
    assert all_of([]) == Everything()
    assert all_of(["a", "b"]) == And(Has("a"), Has("b"))
    assert (Has("a") + Has("b")) == Or(Has("a"), Has("b"))
    assert parse('A "b c"~1 + !d') == Either(Both(Text("a"), Text("b c", 1)), Text("d", 0, "region"))
    assert parse("(a + b) / c") == Both(Either(Text("a"), Text("b")), Text("c"))
    area = parse(render(["x"], [Rect(1, 2, 3, 4)]))
    assert area.right.geo.rects == (Rect(1.0, 2.0, 3.0, 4.0),)
    for bad in ("(a", "a )", "+", "", 'a "b'):
        with pytest.raises(QuerySyntaxError):
            parse(bad)
