"""Blocks, pruning, round trips and edge cases of the index."""

import pytest
from pyspark.sql import functions as F

from quillmap.functions.geo import GeoConstraint, Rect
from quillmap.operators import search, spatial, stats
from quillmap.operators.index import append, build_index
from quillmap.plans.schemes import SCHEMES, Has, MinWise, PositionalQGrams, StringSets, verified
from quillmap.sources.fixtures import Fixtures
from quillmap.sources.store import read_index, read_store, write_bench_csv, write_index, write_store

GEO = GeoConstraint(Rect(-3000, 3000, -9000, 9000))


def ids(df):
    rows = [r.item_id for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.fixture(scope="module")
def fixtures(spark, sf_dir):
    return Fixtures(spark, sf_dir)


@pytest.mark.parametrize("method", sorted(SCHEMES))
def test_pruned_is_flat_and_survives_storage(method, fixtures, spark, tmp_path):
    index = build_index(fixtures.items, fixtures.item_tokens, method)
    p = Has("@nation:nation_3") + Has("@segment:machinery")
    want = ids(index.find(GEO, p))
    assert ids(index.find_pruned(GEO, p)) == want
    exact = ids(search.find(fixtures.items, fixtures.item_tokens, GEO, p, StringSets()))
    assert exact <= want
    assert index.inconsistencies().count() == 0
    for dedup in (False, True):
        path = str(tmp_path / f"{method}{dedup}")
        write_index(index, path, dedup=dedup)
        back = read_index(spark, path)
        assert back.differences(index).count() == 0
        assert ids(back.find(GEO, p)) == want
    visits = index.visit(GEO, p)
    assert ids(visits.where("node_type = 'item'").select(F.col("node_id").alias("item_id"))) == want


def test_verified_answers(fixtures):
    tokens = fixtures.item_tokens
    p = Has("@segment:machinary", 1)
    exact = ids(verified(tokens, "item_id", p))
    grams = PositionalQGrams()
    assert exact and exact <= ids(grams.build(tokens, "item_id").where(grams.may_match(p)))
    assert ids(verified(tokens, "item_id", Has("@segment:machinery"))) <= ids(MinWise().search(tokens, "item_id", Has("@segment:machinery")))
    with pytest.raises(NotImplementedError):
        StringSets().may_match(p)


def test_blocks_are_full(fixtures):
    sizes = sorted(r["count"] for r in build_index(fixtures.items, fixtures.item_tokens, "stringset", block_size=32).items.groupBy("block_id").count().collect())
    assert sizes[1:] == [32] * (len(sizes) - 1)


def test_items_without_tokens_and_touching_rectangles(spark):
    items = spark.createDataFrame([(1, 0, 10, 0, 10), (2, 20, 30, 20, 30), (2, 20, 30, 20, 30)], "item_id long, lat_min long, lat_max long, lon_min long, lon_max long")
    tokens = spark.createDataFrame([(1, "@a:b")], "item_id long, token string")
    for method in SCHEMES:
        index = build_index(items, tokens, method)
        assert ids(index.find(GeoConstraint(Rect(10, 20, 10, 20)))) == {1, 2}
        assert ids(index.find(GeoConstraint(Rect(10, 20, 10, 20)), Has("@a:b"))) == {1}
        assert ids(index.find(GeoConstraint())) == set()
    more = append(build_index(items, tokens, "stringset"), items.selectExpr("item_id + 5 as item_id", "lat_min", "lat_max", "lon_min", "lon_max"), tokens.selectExpr("item_id + 5 as item_id", "token"))
    assert ids(more.find(GeoConstraint(Rect(0, 99, 0, 99)), Has("@a:b"))) == {1, 6}


def test_grid_join_is_the_nested_loop(fixtures):
    rects = fixtures.items.where("item_id % 37 = 0").select(F.col("item_id").alias("rect_id"), *[(F.col(c) + d).alias(c) for c, d in (("lat_min", -700), ("lat_max", 700), ("lon_min", -700), ("lon_max", 700))])
    got = sorted(map(tuple, spatial.overlapping_pairs(fixtures.items, rects).collect()))
    box = lambda r: Rect(r.lat_min, r.lat_max, r.lon_min, r.lon_max)
    want = sorted((i.item_id, r.rect_id) for r in rects.collect() for i in fixtures.items.collect() if box(i).overlaps(box(r)))
    assert got == want


def test_stores_workloads_and_csv(fixtures, spark, tmp_path):
    tables = {t: getattr(fixtures, t) for t in ("items", "item_kvs", "item_cells", "cell_parents", "region_kvs")}
    write_store(tables, str(tmp_path / "store"))
    assert read_store(spark, str(tmp_path / "store"))["items"].count() == fixtures.items.count()
    made = stats.workload(fixtures.item_kvs, fixtures.item_tokens, 4, initial=2, branch=2)
    assert len(made) == 4 and len({frozenset(q.strings) for q in made}) == 4 and max(len(q.strings) for q in made) == 2
    bounded = stats.with_regions(made, [Rect(0, 1, 0, 1), Rect(2, 3, 2, 3)])
    assert bounded == stats.with_regions(made, [Rect(0, 1, 0, 1), Rect(2, 3, 2, 3)]) and all(1 <= len(q.rects) <= 5 for q in bounded)
    rows, us = stats.timed(lambda: fixtures.items)
    assert rows == fixtures.items.count() and us > 0
    write_bench_csv(spark.createDataFrame([("q", 1, 2.0)], "query string, size long, us double"), str(tmp_path / "csv"))
    assert spark.read.option("sep", ";").option("header", True).csv(str(tmp_path / "csv")).first().query == "q"
