"""Registered queries of the search engine, each with the SQL that states the same over the raw tables."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import minwise
from .functions.geo import GeoConstraint, Rect
from .functions.qgrams import base_length, overlap_counts, positional_qgrams, qgram_count, qgrams
from .operators import build, idsets, search, spatial, stats
from .operators.index import Index, build_index
from .plans.schemes import Has, MinWise, PositionalQGrams, StringSets, verified
from .sources.fixtures import PRELUDE, Fixtures
from .sources.shared import run_folder
from .sources.store import read_index, write_index

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

WIDE, EAST, NORTH = Rect(-3000, 3000, -9000, 9000), Rect(-2000, 6000, 2000, 15000), Rect(1000, 8000, -12000, 4000)
EUROPE, MACHINERY, NATION = "@region:europe", "@segment:machinery", "@nation:nation_3"
FAMILY = minwise.PolynomialFamily()
SLOTS = range(FAMILY.slots)
P = FAMILY.prime


def query(sql: str):
    """Register a function of Fixtures under its name, with its SQL below the shared views."""

    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Fixtures(spark, sf_dir))
        ORACLES[f.__name__] = f"WITH {PRELUDE}{sql}"
        return f

    return register


def _in(r: Rect, alias: str = "") -> str:
    return f"({alias}lat_min<={r.lat_max} AND {alias}lat_max>={r.lat_min} AND {alias}lon_min<={r.lon_max} AND {alias}lon_max>={r.lon_min})"


def _ids(condition: str) -> str:
    return f"SELECT item_id FROM items WHERE {condition}"


def _grams(source: str, q: int = 3) -> str:
    """SQL view body: token, i, g of all grams of source(token)."""
    return f"SELECT token, i, CASE WHEN i+1<{q} THEN substring(token,1,CAST(i+1 AS BIGINT)) ELSE substring(token,CAST(i-{q}+2 AS BIGINT),{q}) END AS g FROM (SELECT token, unnest(range(0,length(token)+{q}-1)) AS i FROM {source})"


def _byte(k: int) -> str:
    return f"CASE WHEN length(g)>={k} THEN ascii(substring(g,{k},1)) ELSE 0 END"


def _hash(i: int) -> str:
    a, c = FAMILY.coefficients[i]
    return f"(CAST({a} AS BIGINT)*x+{c})%{P}"


NUMBER = f"CAST({_byte(1)} + 256*{_byte(2)} + 65536*{_byte(3)} AS BIGINT)"
TOKEN_SIGS = f", toks AS (SELECT DISTINCT token FROM item_tokens), gr AS (SELECT DISTINCT token, g FROM ({_grams('toks')}) a), ts AS (SELECT token, {', '.join(f'min({_hash(i)}) AS h{i}' for i in SLOTS)} FROM (SELECT token, {NUMBER} AS x FROM gr) b GROUP BY token)"
MINIMA = ", ".join(f"min(h{i}) AS h{i}" for i in SLOTS)
ITEM_SIGS = f"{TOKEN_SIGS}, sig AS (SELECT item_id, {MINIMA} FROM item_tokens JOIN ts USING (token) GROUP BY item_id)"


def _unpivot(key: str, source: str) -> str:
    return " UNION ALL ".join(f"SELECT {key}, {i} AS slot, h{i} AS value FROM {source}" for i in SLOTS)


def _below(text: str, alias: str = "s.") -> str:
    return "(" + " AND ".join(f"{alias}h{i}<={r}" for i, r in enumerate(minwise.signature_of(FAMILY, [text]))) + ")"


def _may(text: str, ed: int) -> str:
    ref = minwise.signature_of(FAMILY, [text])
    n, least = minwise.threshold(text, ed)
    equal = "+".join(f"CAST(s.h{i}={r} AS INT)" for i, r in enumerate(ref))
    above = "+".join(f"CAST(s.h{i}>={r} AS INT)" for i, r in enumerate(ref))
    return f"(({above})=0 OR ({equal})*{n}>={least}*({above}))"


def _pq(text: str, ed: int) -> str:
    """SQL: items that pass the length and the count filter."""
    n = len(text)
    return f"""(SELECT l.item_id FROM (SELECT item_id, min(length(token)) AS lo, max(length(token)) AS hi FROM item_tokens GROUP BY item_id) l
  LEFT JOIN (SELECT c.item_id, sum(least(c.n, r.n)) AS shared FROM (SELECT item_id, g, count(*) AS n FROM (SELECT DISTINCT item_id, g, i FROM item_tokens JOIN ({_grams("(SELECT DISTINCT token FROM item_tokens)")}) t USING (token)) d GROUP BY item_id, g) c
  JOIN (SELECT g, count(*) AS n FROM ({_grams(f"(SELECT '{text}' AS token)")}) q GROUP BY g) r USING (g) GROUP BY c.item_id) m USING (item_id)
  WHERE {n}<=hi+{ed} AND {n + ed}>=lo AND coalesce(shared,0) >= {n - 1 - (ed - 1) * 3})"""


def _with(text: str) -> str:
    return f"(SELECT item_id FROM item_tokens WHERE token='{text}')"


# geometry


@query(_ids(_in(WIDE)))
def geo_overlap(f: Fixtures) -> DataFrame:
    return spatial.find_in(f.items, GeoConstraint(WIDE))


@query(_ids(f"{_in(WIDE)} OR {_in(NORTH)}"))
def geo_union(f: Fixtures) -> DataFrame:
    return spatial.find_in(f.items, GeoConstraint(WIDE) + GeoConstraint(NORTH))


@query(_ids(f"{_in(WIDE.intersection(NORTH))} OR {_in(EAST.intersection(NORTH))}"))
def geo_intersection(f: Fixtures) -> DataFrame:
    return spatial.find_in(f.items, GeoConstraint(WIDE, EAST) / GeoConstraint(NORTH))


@query(_ids("false"))
def geo_empty(f: Fixtures) -> DataFrame:
    return spatial.find_in(f.items, GeoConstraint())


@query("SELECT item_id FROM items a WHERE EXISTS (SELECT 1 FROM items b WHERE b.item_id>=10000000 AND b.item_id<20000000 AND a.lat_min<=b.lat_max+100 AND a.lat_max>=b.lat_min-100 AND a.lon_min<=b.lon_max+100 AND a.lon_max>=b.lon_min-100)")
def geo_multi_rect_semijoin(f: Fixtures) -> DataFrame:
    around = {"min": -100, "max": 100}
    sides = [(F.col(s) + around[s[-3:]]).alias(s) for s in ("lat_min", "lat_max", "lon_min", "lon_max")]
    rects = f.items.where("item_id >= 10000000 AND item_id < 20000000").select(F.col("item_id").alias("rect_id"), *sides)
    return spatial.semi_join(f.items, rects)


@query("SELECT cell_id, min(lat_min) AS lat_min, max(lat_max) AS lat_max, min(lon_min) AS lon_min, max(lon_max) AS lon_max FROM item_cells JOIN items USING (item_id) GROUP BY cell_id")
def bbox_by_cell(f: Fixtures) -> DataFrame:
    return f.cells


@query("SELECT item_id, (lat_max-lat_min)*(lon_max-lon_min) AS area, 2*((lat_max-lat_min)+(lon_max-lon_min)) AS margin, (lat_min+lat_max)/2.0::DOUBLE AS mid_lat, (lon_min+lon_max)/2.0::DOUBLE AS mid_lon FROM items")
def geo_measures(f: Fixtures) -> DataFrame:
    from .functions.geo import area, margin, midpoint

    lat, lon = midpoint()
    return f.items.select("item_id", area().alias("area"), margin().alias("margin"), lat.alias("mid_lat"), lon.alias("mid_lon"))


# building


@query("SELECT DISTINCT item_id, lower(concat('@',k,':',v)) AS token FROM item_kvs")
def token_build(f: Fixtures) -> DataFrame:
    return build.own_tokens(f.item_kvs)


@query("SELECT item_id, token FROM item_tokens")
def inherited_tokens(f: Fixtures) -> DataFrame:
    return f.item_tokens


@query("SELECT DISTINCT item_id FROM item_cells")
def item_cells_dedup(f: Fixtures) -> DataFrame:
    return build.exactly_once(f.item_cells)


# q-grams


@query(f"SELECT token AS p_name, g AS gram, count(*) AS n FROM ({_grams('(SELECT DISTINCT p_name AS token FROM part)')}) t GROUP BY token, g")
def qgrams_of_names(f: Fixtures) -> DataFrame:
    names = f.table("part").select("p_name").distinct()
    return names.select("p_name", F.explode(qgrams(F.col("p_name"), 3)).alias("gram")).groupBy("p_name", "gram").agg(F.count("*").alias("n"))


@query(f"SELECT DISTINCT token AS p_name, g AS gram, CAST(i AS INT) AS pos FROM ({_grams('(SELECT p_name AS token FROM part)')}) t")
def pqgrams(f: Fixtures) -> DataFrame:
    names = f.table("part").select("p_name").distinct()
    return names.select("p_name", F.explode(positional_qgrams(F.col("p_name"), 3)).alias("g")).select("p_name", "g.gram", "g.pos")


@query("SELECT p_partkey, length(p_name)+2 AS n_grams, length(p_name) AS base_length FROM part")
def qgram_counts(f: Fixtures) -> DataFrame:
    n = qgram_count(F.col("p_name"), 3).cast("long")
    return f.table("part").select("p_partkey", n.alias("n_grams"), base_length(n, 3).alias("base_length"))


@query(f"""SELECT p.p_partkey AS pair_id, coalesce(sum(CASE WHEN b.n IS NULL THEN 0 ELSE least(a.n, b.n) END), 0)::BIGINT AS overlap FROM part p
  LEFT JOIN (SELECT token, g, count(*) AS n FROM ({_grams("(SELECT DISTINCT p_name AS token FROM part)", 2)}) x GROUP BY token, g) a ON a.token=p.p_name
  LEFT JOIN (SELECT token, g, count(*) AS n FROM ({_grams("(SELECT DISTINCT p_type AS token FROM part)", 2)}) y GROUP BY token, g) b ON b.token=p.p_type AND b.g=a.g GROUP BY p.p_partkey""")
def qgram_overlap(f: Fixtures) -> DataFrame:
    pairs = f.table("part").select(F.col("p_partkey").alias("pair_id"), F.col("p_name").alias("a"), F.col("p_type").alias("b"))
    return overlap_counts(pairs, 2)


@query(f"""SELECT l.item_id, n_grams, min_len, max_len FROM (SELECT item_id, min(length(token)) AS min_len, max(length(token)) AS max_len FROM item_tokens GROUP BY item_id) l
  JOIN (SELECT item_id, count(*) AS n_grams FROM (SELECT DISTINCT item_id, g, i FROM item_tokens JOIN ({_grams("(SELECT DISTINCT token FROM item_tokens)")}) t USING (token)) d GROUP BY item_id) c USING (item_id)""")
def pqgram_union_len(f: Fixtures) -> DataFrame:
    sigs = build.pqgram_signatures(f.item_tokens, "item_id")
    return sigs.select("item_id", F.size("grams").cast("long").alias("n_grams"), F.col("min_len").cast("long").alias("min_len"), F.col("max_len").cast("long").alias("max_len"))


def _pqgram_find(f: Fixtures, predicate) -> DataFrame:
    return search.find(f.items, f.item_tokens, GeoConstraint(WIDE), predicate, PositionalQGrams())


@query(_ids(f"{_in(WIDE)} AND item_id IN {_pq(NATION, 0)}"))
def pqgram_match_ed0(f: Fixtures) -> DataFrame:
    return _pqgram_find(f, Has(NATION))


@query(_ids(f"{_in(WIDE)} AND item_id IN {_pq('@segment:machinary', 1)}"))
def pqgram_match_ed1(f: Fixtures) -> DataFrame:
    return _pqgram_find(f, Has("@segment:machinary", 1))


@query(_ids(f"{_in(WIDE)} AND item_id IN {_pq('@region:eurpoe', 2)}"))
def pqgram_match_ed2(f: Fixtures) -> DataFrame:
    return _pqgram_find(f, Has("@region:eurpoe", 2))


@query(_ids(f"{_in(WIDE)} AND item_id IN {_pq(EUROPE, 0)} AND item_id IN {_pq('@segment:machinary', 1)}"))
def pqgram_and(f: Fixtures) -> DataFrame:
    return _pqgram_find(f, Has(EUROPE) / Has("@segment:machinary", 1))


@query(_ids(f"{_in(WIDE)} AND (item_id IN {_pq(NATION, 0)} OR item_id IN {_pq(MACHINERY, 0)})"))
def pqgram_or(f: Fixtures) -> DataFrame:
    return _pqgram_find(f, Has(NATION) + Has(MACHINERY))


# min-wise


@query(f", toks AS (SELECT DISTINCT token FROM item_tokens), gr AS (SELECT DISTINCT g FROM ({_grams('toks')}) a) SELECT g AS gram, x, {_hash(0)} AS h0, {_hash(1)} AS h1 FROM (SELECT g, {NUMBER} AS x FROM gr) b")
def gram_hash(f: Fixtures) -> DataFrame:
    grams = f.item_tokens.select("token").distinct().select(F.explode(qgrams(F.col("token"), 3)).alias("gram")).distinct()
    grams = grams.withColumn("x", FAMILY.number(F.col("gram")))
    return grams.select("gram", "x", *(FAMILY.hash(i, F.col("x")).alias(f"h{i}") for i in (0, 1)))


GRAM_VIEW = f", toks AS (SELECT DISTINCT token FROM item_tokens), gr AS (SELECT DISTINCT g FROM ({_grams('toks')}) a)"
FAMILY_61 = minwise.PolynomialFamily(slots=2, prime=minwise.PRIME_61)
SHA = minwise.ShaFamily(slots=2)


def _hash_61(i: int) -> str:
    a, c = FAMILY_61.coefficients[i]
    return f"CAST((CAST({a} AS HUGEINT)*x+{c})%{FAMILY_61.prime} AS BIGINT)"


@query(f"{GRAM_VIEW} SELECT g AS gram, {_hash_61(0)} AS h0, {_hash_61(1)} AS h1 FROM (SELECT g, {NUMBER} AS x FROM gr) b")
def gram_hash_61(f: Fixtures) -> DataFrame:
    """Hashes of 61 bits."""
    return _hashed_grams(f, FAMILY_61)


def _sha(i: int) -> str:
    return f"CAST('0x'||substr(sha256('{SHA.seed}:{i}:'||g),1,15) AS BIGINT) AS h{i}"


@query(f"{GRAM_VIEW} SELECT g AS gram, {_sha(0)}, {_sha(1)} FROM gr")
def gram_hash_sha(f: Fixtures) -> DataFrame:
    """Hashes from keyed digests."""
    return _hashed_grams(f, SHA)


def _hashed_grams(f: Fixtures, family) -> DataFrame:
    grams = f.item_tokens.select("token").distinct().select(F.explode(qgrams(F.col("token"), 3)).alias("gram")).distinct()
    return grams.select("gram", *(family.hash(i, family.number(F.col("gram"))).alias(f"h{i}") for i in (0, 1)))


@query(f"{TOKEN_SIGS} {_unpivot('token', 'ts')}")
def minwise_token_sig(f: Fixtures) -> DataFrame:
    return build.long_form(build.token_signatures(f.item_tokens, FAMILY), "token", FAMILY)


@query(f"{ITEM_SIGS} {_unpivot('item_id', 'sig')}")
def minwise_item_sig(f: Fixtures) -> DataFrame:
    return build.long_form(MinWise().build(f.item_tokens, "item_id"), "item_id", FAMILY)


REGION_TOKENS = "(SELECT region_id, lower(concat('@',k,':',v)) AS token FROM region_kvs) t"


@query(f"{TOKEN_SIGS}, rs AS (SELECT region_id, {MINIMA} FROM {REGION_TOKENS} JOIN ts USING (token) GROUP BY region_id), cs AS (SELECT cell_id, {MINIMA} FROM cell_parents JOIN rs USING (region_id) GROUP BY cell_id) {_unpivot('cell_id', 'cs')}")
def minwise_cell_sig(f: Fixtures) -> DataFrame:
    regions = build.minwise_signatures(build.own_tokens(f.region_kvs, "region_id"), "region_id", FAMILY)
    used = f.cell_parents.join(f.item_cells.select("cell_id").distinct(), "cell_id", "left_semi").select("region_id").distinct()
    regions = regions.join(used, "region_id", "left_semi")
    return build.long_form(build.combine_above(f.cell_parents, regions, "region_id", "cell_id", FAMILY), "cell_id", FAMILY)


@query(f"{ITEM_SIGS}, bs AS (SELECT item_id % 97 AS block_id, {MINIMA} FROM sig GROUP BY item_id % 97) {_unpivot('block_id', 'bs')}")
def minwise_block_sig(f: Fixtures) -> DataFrame:
    blocks = MinWise().build(f.item_tokens, "item_id").withColumn("block_id", F.col("item_id") % 97)
    return build.long_form(MinWise().combine(blocks, "block_id"), "block_id", FAMILY)


AGREE = "+".join(f"CAST(a.h{i}=b.h{i} AS INT)" for i in SLOTS)
OWN_TOKENS = "FROM item_tokens o JOIN sig a USING (item_id) JOIN ts b USING (token)"


def _own_signatures(f: Fixtures) -> DataFrame:
    """Each item's signature beside that of each of its tokens."""
    signed = build.token_signatures(f.item_tokens, FAMILY)
    items = build.minwise_signatures(f.item_tokens, "item_id", FAMILY, signatures=signed)
    pack = lambda df, key, name: df.select(key, minwise.packed(FAMILY)).withColumnRenamed("sig", name)
    return f.item_tokens.join(pack(items, "item_id", "a"), "item_id").join(pack(signed, "token", "b"), "token")


@query(f"{ITEM_SIGS} SELECT item_id, o.token AS token, CAST({AGREE} AS BIGINT) AS agreement {OWN_TOKENS}")
def minwise_agreement(f: Fixtures) -> DataFrame:
    return _own_signatures(f).select("item_id", "token", minwise.agreement(F.col("a"), F.col("b")).cast("long").alias("agreement"))


@query(f"{ITEM_SIGS} SELECT item_id, o.token AS token, CAST({AGREE} AS DOUBLE)/CAST(56 AS DOUBLE) AS resemblance {OWN_TOKENS}")
def minwise_resemblance(f: Fixtures) -> DataFrame:
    return _own_signatures(f).select("item_id", "token", minwise.resemblance(F.col("a"), F.col("b")).alias("resemblance"))


def _minwise_find(f: Fixtures, predicate, geo: GeoConstraint | None = None) -> DataFrame:
    return search.find(f.items, f.item_tokens, geo or GeoConstraint(WIDE), predicate, MinWise())


def _minwise_sql(condition: str) -> str:
    return f"{ITEM_SIGS} SELECT i.item_id FROM items i JOIN sig s USING (item_id) WHERE {_in(WIDE, 'i.')} AND {condition}"


@query(_minwise_sql(_below(NATION)))
def minwise_match_ed0(f: Fixtures) -> DataFrame:
    return _minwise_find(f, Has(NATION))


@query(_minwise_sql(_may("@segment:machinary", 1)))
def minwise_match_ed1(f: Fixtures) -> DataFrame:
    return _minwise_find(f, Has("@segment:machinary", 1))


@query(_minwise_sql(f"{_below(EUROPE)} AND {_below(MACHINERY)}"))
def minwise_and(f: Fixtures) -> DataFrame:
    return _minwise_find(f, Has(EUROPE) / Has(MACHINERY))


@query(_minwise_sql(f"({_below(NATION)} OR {_below(MACHINERY)})"))
def minwise_or(f: Fixtures) -> DataFrame:
    return _minwise_find(f, Has(NATION) + Has(MACHINERY))


@query(_minwise_sql(_below(EUROPE)))
def find_geo_minwise(f: Fixtures) -> DataFrame:
    return _minwise_find(f, Has(EUROPE))


_STORED: set[str] = set()


def _stored(f: Fixtures, method: str, dedup: bool = False) -> Index:
    """An index of the tables' items, written to the shared folder once for an application and read from there."""
    path = f"{run_folder(f.spark)}/index-{method}-{int(dedup)}-{hashlib.md5(f.sf_dir.encode()).hexdigest()}"
    if path not in _STORED:
        write_index(build_index(f.items, f.item_tokens, method), path, mode="overwrite", dedup=dedup)
        _STORED.add(path)
    return read_index(f.spark, path)


@query(_minwise_sql(f"{_below(EUROPE)} AND {_below(MACHINERY)}"))
def find_geo_minwise_index(f: Fixtures) -> DataFrame:
    """The same from stored signatures, looking only into stored blocks that pass."""
    return _stored(f, "minwise").find_pruned(GeoConstraint(WIDE), Has(EUROPE) / Has(MACHINERY))


@query(_minwise_sql(f"({_below(NATION)} OR {_may('@segment:machinary', 1)})"))
def find_stored_minwise(f: Fixtures) -> DataFrame:
    """From a stored index with deduplicated signatures, edits included."""
    return _stored(f, "minwise", dedup=True).find(GeoConstraint(WIDE), Has(NATION) + Has("@segment:machinary", 1))


@query(_ids(f"{_in(WIDE)} AND item_id IN {_pq(EUROPE, 0)} AND item_id IN {_pq('@segment:machinary', 1)}"))
def find_stored_qgram(f: Fixtures) -> DataFrame:
    return _stored(f, "qgram", dedup=True).find_pruned(GeoConstraint(WIDE), Has(EUROPE) / Has("@segment:machinary", 1))


@query(_ids(f"{_in(WIDE)} AND (item_id IN {_with(EUROPE)} OR item_id IN {_with(NATION)})"))
def find_stored_text(f: Fixtures) -> DataFrame:
    """A textual query on a stored index."""
    return _stored(f, "stringset").find_text(f'("{EUROPE}" + "{NATION}") / $geo:-9000,-3000,9000,3000')


@query("SELECT item_id, lat_min, lat_max, lon_min, lon_max, array_to_string(list_sort(list(token)), '|') AS tokens FROM items LEFT JOIN item_tokens USING (item_id) GROUP BY ALL")
def store_round_trip(f: Fixtures) -> DataFrame:
    """What a stored, deduplicated index of string sets holds."""
    return _stored(f, "stringset", dedup=True).items.select("item_id", "lat_min", "lat_max", "lon_min", "lon_max", F.array_join("tokens", "|").alias("tokens"))


@query(_ids(f"{_in(WIDE)} AND item_id IN {_with(EUROPE)}"))
def find_geo_stringset(f: Fixtures) -> DataFrame:
    return search.find(f.items, f.item_tokens, GeoConstraint(WIDE), Has(EUROPE), StringSets())


@query(_ids(f"({_in(WIDE)} OR {_in(EAST)}) AND item_id IN {_pq('@region:europa', 1)}"))
def find_geo_pqgram(f: Fixtures) -> DataFrame:
    return _stored(f, "qgram").find_pruned(GeoConstraint(WIDE, EAST), Has("@region:europa", 1))


# string sets


def _strings(f: Fixtures, predicate) -> DataFrame:
    return StringSets().search(f.item_tokens, "item_id", predicate)


@query(f"SELECT DISTINCT item_id FROM item_tokens WHERE token IN ('{NATION}', '{MACHINERY}')")
def stringset_any(f: Fixtures) -> DataFrame:
    return _strings(f, Has(NATION) + Has(MACHINERY))


@query(f"SELECT item_id FROM item_tokens WHERE token IN ('{EUROPE}', '{MACHINERY}') GROUP BY item_id HAVING count(DISTINCT token)=2")
def stringset_all(f: Fixtures) -> DataFrame:
    return _strings(f, Has(EUROPE) / Has(MACHINERY))


@query("SELECT DISTINCT item_id FROM item_tokens WHERE token LIKE '@name:cold%'")
def stringset_prefix(f: Fixtures) -> DataFrame:
    return _strings(f, Has("@name:cold", prefix=True))


@query("SELECT item_id FROM item_tokens WHERE token='@region:atlantis'")
def stringset_unknown(f: Fixtures) -> DataFrame:
    return _strings(f, Has("@region:atlantis"))


@query("SELECT item_id, count(DISTINCT token) AS n_tokens FROM item_tokens GROUP BY item_id")
def stringset_sizes(f: Fixtures) -> DataFrame:
    return build.string_sets(f.item_tokens, "item_id").select("item_id", F.size("tokens").cast("long").alias("n_tokens"))


@query("SELECT DISTINCT item_id FROM item_tokens WHERE levenshtein(token, '@segment:machinary')<=1")
def verify_levenshtein(f: Fixtures) -> DataFrame:
    return verified(f.item_tokens, "item_id", Has("@segment:machinary", 1))


# combination, sets, statistics


@query(_ids(f"(item_id IN {_with(EUROPE)} AND item_id IN {_with(MACHINERY)} OR item_id IN {_with(NATION)}) AND {_in(WIDE)}"))
def adhoc_query(f: Fixtures) -> DataFrame:
    return search.run_text(f'("{EUROPE}" "{MACHINERY}" + "{NATION}") / $geo:-9000,-3000,9000,3000', f.items, f.item_tokens)


@query(f"SELECT item_id FROM item_kvs WHERE lower(concat('@',k,':',v))='{MACHINERY}' INTERSECT {_with(EUROPE)[1:-1]}")
def adhoc_scoped(f: Fixtures) -> DataFrame:
    return search.run_text(f'#"{MACHINERY}" !"{EUROPE}"', f.items, f.item_tokens, item_kvs=f.item_kvs, region_tokens=_above(f))


def _above(f: Fixtures) -> DataFrame:
    return build.region_tokens(f.item_cells, f.cell_parents, f.region_kvs)


@query(f"SELECT DISTINCT item_id FROM item_cells JOIN cell_parents USING (cell_id) JOIN region_kvs USING (region_id) WHERE lower(concat('@',k,':',v)) IN ('{EUROPE}', '{NATION}')")
def adhoc_region_scope(f: Fixtures) -> DataFrame:
    """Strings of regions, whether or not the items have them too."""
    kvs = f.item_kvs.unionByName(f.items.select("item_id", F.lit("region").alias("k"), F.lit("EUROPE").alias("v")))
    return search.run_text(f'!"{EUROPE}" + !"{NATION}"', f.items, f.item_tokens, item_kvs=kvs, region_tokens=_above(f))


@query(_ids(f"{_in(WIDE.intersection(NORTH))} AND item_id IN {_with(EUROPE)}"))
def adhoc_area_meet(f: Fixtures) -> DataFrame:
    """Areas joined by / are the place where they meet."""
    return search.run_text(f'$geo:-9000,-3000,9000,3000 "{EUROPE}" / $geo:-12000,1000,4000,8000', f.items, f.item_tokens)


@query(f"{_with(NATION)[1:-1]} UNION {_with(MACHINERY)[1:-1]}")
def idset_union(f: Fixtures) -> DataFrame:
    return idsets.unite(_strings(f, Has(NATION)), _strings(f, Has(MACHINERY)))


@query(f"{_with(NATION)[1:-1]} INTERSECT {_with(MACHINERY)[1:-1]}")
def idset_intersect(f: Fixtures) -> DataFrame:
    return idsets.intersect(_strings(f, Has(NATION)), _strings(f, Has(MACHINERY)))


@query(f"{_with(MACHINERY)[1:-1]} EXCEPT {_with(NATION)[1:-1]}")
def idset_difference(f: Fixtures) -> DataFrame:
    return idsets.difference(_strings(f, Has(MACHINERY)), _strings(f, Has(NATION)))


@query("SELECT k, v, count(DISTINCT item_id) AS n_items FROM item_kvs GROUP BY k, v")
def kv_stats(f: Fixtures) -> DataFrame:
    return stats.kv_stats(f.item_kvs)


@query("SELECT k, v, count(DISTINCT item_id) AS n_items FROM item_kvs GROUP BY k, v ORDER BY n_items DESC, k, v LIMIT 20")
def kv_topk(f: Fixtures) -> DataFrame:
    return stats.kv_topk(stats.kv_stats(f.item_kvs), 20)


@query(f"SELECT k, v, count(DISTINCT item_id) AS n_items FROM item_kvs WHERE item_id IN {_with(EUROPE)} GROUP BY k, v")
def kv_stats_filtered(f: Fixtures) -> DataFrame:
    return stats.kv_stats(f.item_kvs, _strings(f, Has(EUROPE)))


@query(f"SELECT DISTINCT region_id FROM cell_parents WHERE cell_id IN (SELECT cell_id FROM item_cells WHERE item_id IN {_with(NATION)})")
def cells_to_regions(f: Fixtures) -> DataFrame:
    return stats.regions_of(f.item_cells, f.cell_parents, _strings(f, Has(NATION)))


@query(_ids(f"{_in(WIDE)} AND item_id IN {_with(EUROPE)}"))
def two_stage_filter(f: Fixtures) -> DataFrame:
    return search.two_stage(f.items, f.item_tokens, f.item_cells, f.cells, GeoConstraint(WIDE), Has(EUROPE))


@query(f"{ITEM_SIGS}, ex AS (SELECT item_id FROM items WHERE {_in(WIDE)} AND item_id IN {_with(EUROPE)}) SELECT count(*) FILTER (WHERE item_id NOT IN (SELECT item_id FROM sig s WHERE {_below(EUROPE)})) AS missed, count(*) AS exact FROM ex")
def missed_answers(f: Fixtures) -> DataFrame:
    exact = search.find(f.items, f.item_tokens, GeoConstraint(WIDE), Has(EUROPE), StringSets())
    lost = search.missed(exact, _minwise_find(f, Has(EUROPE))).agg(F.count("*").alias("missed"))
    return lost.crossJoin(exact.agg(F.count("*").alias("exact")))  # one row each


PROBED = (8, 16, 32)


@query(f"{ITEM_SIGS} " + " UNION ALL ".join(f"SELECT {n} AS slots, count(*) FILTER (WHERE {' AND '.join(f'a.h{i}<=b.h{i}' for i in range(n))}) AS matches {OWN_TOKENS}" for n in PROBED))
def accuracy_probe(f: Fixtures) -> DataFrame:
    return stats.accuracy_probe(f.item_tokens, list(PROBED))


@query("SELECT item_id, array_to_string(list_sort(list(token)), '|') AS tokens FROM item_tokens GROUP BY item_id")
def sig_dedup(f: Fixtures) -> DataFrame:
    encoded, dictionary = build.dedup_encode(build.string_sets(f.item_tokens, "item_id"), "item_id", F.col("tokens"))
    return build.dedup_decode(encoded, dictionary).select("item_id", F.array_join("sig", "|").alias("tokens"))


def _axis(a: str, b: str, low: str, high: str) -> str:
    return f"least(greatest(CAST(floor((({a}+{b})/2.0::DOUBLE-{low})/({high}-{low})*65536) AS BIGINT),0),65535)"


def _spread(x: str) -> str:
    """The bits of x at every second place."""
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        x = f"list_transform([{x}], lambda v{shift}: (v{shift} | (v{shift} << {shift})) & {mask})[1]"
    return x


#: Items in blocks of 32 by the interleaved bits of their midpoints.
PACKED = f""", ext AS (SELECT min(lat_min)::DOUBLE AS la, max(lat_max)::DOUBLE AS lb, min(lon_min)::DOUBLE AS oa, max(lon_max)::DOUBLE AS ob FROM items),
axes AS (SELECT items.*, {_axis('lat_min', 'lat_max', 'la', 'lb')} AS y, {_axis('lon_min', 'lon_max', 'oa', 'ob')} AS x FROM items, ext),
packed AS (SELECT *, (row_number() OVER (ORDER BY ({_spread('y')} << 1) | {_spread('x')}, item_id)-1)//32 AS block_id FROM axes),
blocks AS (SELECT block_id, min(lat_min) AS lat_min, max(lat_max) AS lat_max, min(lon_min) AS lon_min, max(lon_max) AS lon_max FROM packed GROUP BY block_id),
passing AS (SELECT block_id FROM blocks WHERE {_in(WIDE)} AND block_id IN (SELECT block_id FROM packed WHERE item_id IN {_with(NATION)})),
inside AS (SELECT item_id, block_id FROM packed JOIN passing USING (block_id) WHERE {_in(WIDE)} AND item_id IN {_with(NATION)})"""


@query(f"""{ITEM_SIGS}{PACKED}, signed AS (SELECT block_id, {MINIMA} FROM packed JOIN sig USING (item_id) GROUP BY block_id)
SELECT count(*) AS items, count(*) FILTER (WHERE b.lat_min>p.lat_min OR b.lat_max<p.lat_max OR b.lon_min>p.lon_min OR b.lon_max<p.lon_max OR {' OR '.join(f'g.h{i}>s.h{i}' for i in SLOTS)}) AS inconsistent
FROM packed p JOIN blocks b USING (block_id) LEFT JOIN signed g USING (block_id) LEFT JOIN sig s USING (item_id)""")
def index_consistency(f: Fixtures) -> DataFrame:
    index = _stored(f, "minwise")
    bad = index.inconsistencies().agg(F.count("*").alias("inconsistent"))
    return index.items.agg(F.count("*").alias("items")).crossJoin(bad)  # one row each


@query(f"{PACKED} SELECT (SELECT count(*) FROM passing) AS visited_blocks, count(DISTINCT block_id) AS needed_blocks, count(*) AS visited_items FROM inside")
def prune_overhead(f: Fixtures) -> DataFrame:
    """Visited and needed blocks."""
    return stats.prune_overhead(_stored(f, "stringset"), GeoConstraint(WIDE), Has(NATION))


@query(f"{PACKED} SELECT 'root' AS node_type, 0::BIGINT AS node_id UNION ALL SELECT 'block', block_id FROM passing UNION ALL SELECT 'item', item_id FROM inside")
def visit_nodes(f: Fixtures) -> DataFrame:
    return _stored(f, "stringset").visit(GeoConstraint(WIDE), Has(NATION))


@query(f"{PACKED} SELECT 2 AS depth, 1::BIGINT AS n_internal, (SELECT count(*) FROM blocks) AS n_blocks, count(*) AS n_items FROM packed")
def index_metadata(f: Fixtures) -> DataFrame:
    return _stored(f, "stringset").metadata()


def generated_workload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text and answers of generated queries."""
    from .plans.textquery import render

    f = Fixtures(spark, sf_dir)
    bounds = [Rect(r.lat_min, r.lat_max, r.lon_min, r.lon_max) for r in f.cells.orderBy("cell_id").collect()]
    made = stats.with_regions(stats.workload(f.item_kvs, f.item_tokens, 8, initial=5, branch=2), bounds)
    answers = [search.find(f.items, f.item_tokens, q.geo(), q.predicate(), StringSets()).agg(F.lit(render(list(q.strings), list(q.rects))).alias("query"), F.count("*").alias("n_items")) for q in made]
    return idsets.reduce(DataFrame.unionByName, answers)


QUERIES["generated_workload"] = generated_workload
