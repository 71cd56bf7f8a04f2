"""Command line: ``python -m quillmap create|query|test|bench|prune-bench``.

``create -i STORE -o INDEX -t minwise|minwise-61|minwise-sha|qgram|stringset[-dedup] [--check]`` builds an
index from an item store; ``query -i STORE -x INDEX -m QUERY...`` runs textual queries and prints how many
items each finds; ``test`` compares indexed and brute-force answers of the top tags; ``bench`` and
``prune-bench`` write semicolon-separated figures of generated queries.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .functions import minwise
from .functions.geo import Rect
from .operators import search, spatial, stats
from .operators.build import inherited_tokens, region_tokens
from .operators.index import build_index
from .plans.schemes import MinWise, PositionalQGrams, StringSets
from .sources.store import read_index, read_store, write_bench_csv, write_index


def _scheme(name: str, q: int, degree: int):
    families = {"minwise": minwise.PolynomialFamily(degree=degree), "minwise-61": minwise.PolynomialFamily(degree=degree, prime=minwise.PRIME_61), "minwise-sha": minwise.ShaFamily()}
    if name in families:
        return MinWise(families[name], q)
    return {"qgram": PositionalQGrams(q), "stringset": StringSets()}[name]


def _tokens(store):
    return inherited_tokens(store["item_kvs"], store["item_cells"], store["cell_parents"], store["region_kvs"])


def _workload(args, store, tokens):
    boxes = spatial.bounding_boxes(store["item_cells"].join(store["items"], "item_id"), "cell_id").orderBy("cell_id")
    bounds = [Rect(r.lat_min, r.lat_max, r.lon_min, r.lon_max) for r in boxes.collect()]
    return stats.with_regions(stats.workload(store["item_kvs"], tokens, args.count, args.initial, args.branch), bounds, args.bounds)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quillmap", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("create", "query", "test", "bench", "prune-bench"):
        c = commands.add_parser(name)
        c.add_argument("-i", "--store", required=True)
        c.add_argument("-o" if name == "create" else "-x", "--index", required=True)
        if name == "create":
            c.add_argument("-t", "--type", default="minwise")
            c.add_argument("-q", type=int, default=minwise.Q)
            c.add_argument("--degree", type=int, default=2, help="coefficients of a hash function")
            c.add_argument("--check", action="store_true", help="verify consistency, and equality after a round trip")
        else:
            c.add_argument("--preload", action="store_true")
        if name == "query":
            c.add_argument("-m", "--match", nargs="+", required=True)
        if name in ("bench", "prune-bench", "test"):
            for option, default in (("count", 10), ("initial", 100), ("branch", 10), ("bounds", 5)):
                c.add_argument(f"--{option}", type=int, default=default)
            c.add_argument("--out")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("quillmap").getOrCreate()
    store = read_store(spark, args.store)
    tokens = _tokens(store)
    if args.command == "create":
        index = build_index(store["items"], tokens, scheme=_scheme(args.type.removesuffix("-dedup"), args.q, args.degree))
        write_index(index, args.index, dedup=args.type.endswith("-dedup"))
        if args.check:
            bad, changed = index.inconsistencies().count(), read_index(spark, args.index).differences(index).count()
            print(f"{bad} inconsistent items, {changed} rows that differ after the round trip")
            return int(bad + changed > 0)
        return 0
    index = read_index(spark, args.index, args.preload)
    if args.command == "query":
        above = region_tokens(store["item_cells"], store["cell_parents"], store["region_kvs"])
        for text in args.match:
            print(f"{text}: {index.find_text(text, store['item_kvs'], above).count()} items")
        return 0
    rows, failed = [], 0
    for q in _workload(args, store, tokens):
        geo, predicate = q.geo(), q.predicate()
        name = search_text(q)
        exact = search.find(store["items"], tokens, geo, predicate, StringSets())
        if args.command == "test":
            lost = search.missed(exact, index.find_pruned(geo, predicate)).count()
            failed += lost > 0
            print(f"{name}: {lost} missed")
        elif args.command == "bench":
            flat, pruned, two = (stats.timed(f) for f in (lambda: index.find(geo, predicate), lambda: index.find_pruned(geo, predicate), lambda: search.two_stage(store["items"], tokens, store["item_cells"], spatial.bounding_boxes(store["item_cells"].join(store["items"], "item_id"), "cell_id"), geo, predicate)))
            rows.append((name, *flat, *pruned, *two))
        else:
            r = stats.prune_overhead(index, geo, predicate).first()
            rows.append((name, r.visited_blocks, r.needed_blocks, r.visited_items))
    if rows:
        names = "query string, flat_size long, flat_us double, pruned_size long, pruned_us double, two_stage_size long, two_stage_us double" if args.command == "bench" else "query string, visited_blocks long, needed_blocks long, visited_items long"
        table = spark.createDataFrame(rows, names)
        write_bench_csv(table.coalesce(1), args.out) if args.out else table.show(truncate=False)
    return int(failed > 0)


def search_text(q: stats.Query) -> str:
    from .plans.textquery import render

    return render(list(q.strings), list(q.rects))


if __name__ == "__main__":
    raise SystemExit(main())
