"""N-gram Jaccard self-join by grouped prefixes.

Documents with the same shingle set collapse first, then sets with the same prefix and size form
one group. Prefixes are rarest first by counts over all documents. Groups that share a prefix shingle are
candidates, if their sizes and the shingle's places leave room for the threshold; they are expanded to their
members and verified exactly on whole sets. Posting lists are short or long. Of short ones groups are paired
as they are, so that a shingle shared by chance moves a few numbers and no sketch. Every long list is
verified against one hub before, the group whose prefix is most frequent: edits are rare shingles, so that
is what the others were copied from. Groups that this joins into one component are not paired again, so a large
group of near copies costs its size and not its square. A parity sketch of each set bounds the symmetric
difference from below, so that most pairs that must fail never leave the join.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .store import broadcast_if, drop, small_batches, stash
from .words import mix, shingle_sets

#: Cells of the frequency sketch that orders shingles, and of the blocks that its counts are added in; its size does not depend on the input.
CELLS, BLOCK = 1 << 24, 1 << 14
#: Groups of a posting list that is short.
SHORT = 8
#: Longs of a parity sketch: bit b tells whether an odd number of shingles fall into cell b.
LANES = 16
SKETCH = [f"s{i}" for i in range(LANES)]
#: Ids that are broadcast to pick texts, 8 bytes each; more are joined by shuffling.
BROADCAST_IDS = 500_000


def prefix_length(n: int, percent: int) -> int:
    """Shingles of a set of ``n`` of which one at least is shared at ``percent`` Jaccard or more."""
    return n - -(-n * percent // 100) + 1 if n else 0


def frequency_ranks(docs: DataFrame, k: int) -> np.ndarray:
    """For each sketch cell a rank that grows with its count over all documents: eight times the binary logarithm."""

    def packed(cells):
        blocks = cells.reshape(-1, BLOCK)
        for lo in range(0, len(blocks), 64):
            hit = lo + np.flatnonzero(blocks[lo : lo + 64].any(axis=1))
            # low bytes, then high bytes, which are mostly zero
            counts = [zlib.compress(blocks[i].view(np.uint8).reshape(-1, 2).T.tobytes(), 1) for i in hit]
            yield pa.RecordBatch.from_arrays([pa.array(hit.astype(np.int32)), pa.array(counts, pa.binary())], ["block", "counts"])

    def count(batches):
        cells, rows, pending, size = np.zeros(CELLS, np.uint16), 0, [], 0
        for batch in batches:
            for _, s in shingle_sets(batch.column(0), k):
                pending.append(s)
                rows, size = rows + 1, size + len(s)
                if size > 1 << 20 or rows == 65535:
                    np.add.at(cells, (np.concatenate(pending) % np.uint64(CELLS)).astype(np.int64), np.uint16(1))
                    pending, size = [], 0
                if rows == 65535:  # what a cell can count
                    yield from packed(cells)
                    cells[:], rows = 0, 0
        if pending:
            np.add.at(cells, (np.concatenate(pending) % np.uint64(CELLS)).astype(np.int64), np.uint16(1))
        yield from packed(cells)

    def ranked(table: pa.Table) -> pa.Table:
        total = np.zeros(BLOCK, np.int64)
        for part in table.column("counts"):
            low, high = np.frombuffer(zlib.decompress(part.as_py()), np.uint8).reshape(2, BLOCK)
            total += low
            total += high.astype(np.int64) << 8
        ranks = np.minimum(np.round(8 * np.log2(total + 1)), 255).astype(np.uint8)
        return pa.table([table.column("block")[:1], pa.array([ranks.tobytes()], pa.binary())], ["block", "ranks"])

    counts = docs.select("text").mapInArrow(count, "block int, counts binary")
    table = counts.groupBy("block").applyInArrow(ranked, "block int, ranks binary").toArrow()  # CELLS bytes at most
    ranks = np.zeros((CELLS // BLOCK, BLOCK), np.uint8)
    for block, row in zip(table.column("block").to_pylist(), table.column("ranks")):
        ranks[block] = np.frombuffer(row.as_py(), np.uint8)
    return ranks.ravel()


def fingerprint(s: np.ndarray) -> int:
    return int((mix(s ^ np.uint64(0xA0761D6478BD642F)).sum() + np.uint64(len(s))).astype(np.int64))


def parity_sketch(s: np.ndarray, lanes: int = LANES) -> np.ndarray:
    """Bits set in the exclusive or of two sketches never exceed the sets' symmetric difference.

    The two halves of a sketch give, by exclusive or, the sketch with half the lanes.
    """
    cells = (mix(s) % np.uint64(lanes * 64)).astype(np.int64)
    return np.packbits((np.bincount(cells, minlength=lanes * 64) & 1).astype(np.uint8)).view(np.int64)


def _wide_lanes(n: int) -> int:
    """Lanes of a large set's second sketch, a power of two with about a bit for two shingles; 0 for small sets."""
    return 1 << (n // 128).bit_length() if n >= 256 * LANES else 0


def _may_link(n: tuple[str, str], ends: tuple[str, str], percent: int, slack: str = "0") -> str:
    """SQL: sizes and sketches allow the threshold. ends: what the sketch columns start with."""
    odd = " + ".join(f"bit_count({ends[0]}{x} ^ {ends[1]}{x})" for x in SKETCH)
    a, b = n
    return f"100 * least({a}, {b}) >= {percent} * greatest({a}, {b}) AND (100 + {percent}) * ({odd} - ({slack})) <= (100 - {percent}) * ({a} + {b})"


def shingle_table(docs: DataFrame, k: int, percent: int, ranks: np.ndarray) -> DataFrame:
    """doc_id, text_hash, n, set_key, prefix_key, prefix (rarest first), weight (mean rank of the prefix) and sketches of each document.

    Prefix shingles keep 32 bits: a collision there is one more candidate and changes no result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(ranks)  # CELLS bytes

    def run(batches):
        rank = shared.value
        for batch in batches:
            ns, keys, prefix_keys, prefixes, weights, sketches, wide = [], [], [], [], [], [], []
            for _, s in shingle_sets(batch.column(1), k):
                n = len(s)
                p = prefix_length(n, percent)
                r = rank[(s % np.uint64(CELLS)).astype(np.int64)]
                order = np.argsort(r, kind="stable")[:p]
                prefix = s[order]
                ns.append(n)
                keys.append(fingerprint(s) if n else None)
                prefix_keys.append(fingerprint(prefix) if n else None)
                prefixes.append(prefix.astype(np.uint32).view(np.int32))
                weights.append(int(1000 * r[order].mean()) if n else 0)
                sketches.append(parity_sketch(s))
                wide.append(parity_sketch(s, lanes) if (lanes := _wide_lanes(n)) else None)
            offsets = np.concatenate([[0], np.cumsum([len(p) for p in prefixes])]).astype(np.int32)
            flat = np.concatenate(prefixes) if prefixes else np.empty(0, np.int32)
            lanes = np.stack(sketches).T if sketches else np.empty((LANES, 0), np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(ns, pa.int64()), pa.array(keys, pa.int64()), pa.array(prefix_keys, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array(weights, pa.int32()), pa.array(wide, pa.list_(pa.int64())), *(pa.array(x.copy()) for x in lanes)],
                ["doc_id", "text_hash", "n", "set_key", "prefix_key", "prefix", "weight", "wide", *SKETCH],
            )

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(run, "doc_id long, text_hash long, n long, set_key long, prefix_key long, prefix array<int>, weight int, wide array<long>, " + ", ".join(f"{x} long" for x in SKETCH))


def _sets(docs: DataFrame, active: DataFrame, k: int) -> DataFrame:
    """set_key, shingles of the sets in ``active`` (set_key, doc_id), from their whole texts."""

    def run(batches):
        for batch in batches:
            keys, sets = [], []
            for _, s in shingle_sets(batch.column(0), k):
                keys.append(fingerprint(s) if len(s) else None)
                sets.append(s.view(np.int64))
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            flat = np.concatenate(sets) if sets else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["set_key", "shingles"])

    # an id that is null joins nothing, so texts without one are all looked at
    ids = broadcast_if(active.select("doc_id"), BROADCAST_IDS)
    texts = docs.join(ids, "doc_id", "left_semi").unionByName(docs.where("doc_id IS NULL")).select("text")
    found = texts.mapInArrow(run, "set_key long, shingles array<long>")
    return found.join(broadcast_if(active.select("set_key"), BROADCAST_IDS), "set_key", "left_semi").dropDuplicates(["set_key"])


def _may_link_wide(a: str, b: str, percent: int) -> str:
    """SQL: the wide sketches, where both sets have one, allow the threshold; the longer is folded once."""
    fold = "if(size({0}) > size({1}), zip_with(slice({0}, 1, size({1})), slice({0}, size({1}) + 1, size({1})), (x, y) -> x ^ y), {0})"
    odd = f"aggregate(zip_with({fold.format(f'{a}wide', f'{b}wide')}, {fold.format(f'{b}wide', f'{a}wide')}, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)"
    return f"coalesce((100 + {percent}) * {odd} <= (100 - {percent}) * ({a}n + {b}n), true)"


def _active(pairs: DataFrame, members: DataFrame) -> DataFrame:
    ends = pairs.select(F.col("a").alias("set_key")).unionByName(pairs.select(F.col("b").alias("set_key"))).distinct()
    return stash(members.select("set_key", "doc_id").join(ends, "set_key", "left_semi"), "active")


def _verified(pairs: DataFrame, docs: DataFrame, table: DataFrame, members: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets reach the threshold."""
    active = _active(pairs, members)
    wide = table.where("wide IS NOT NULL").select("set_key", "n", "wide").join(broadcast_if(active.select("set_key"), BROADCAST_IDS), "set_key", "left_semi")
    wide = stash(wide.dropDuplicates(["set_key"]), "wide")
    one, two = _prefixed(wide, "x_"), _prefixed(wide, "y_")
    fit = pairs.join(one, pairs.a == one.x_set_key, "left").join(two, pairs.b == two.y_set_key, "left").where(_may_link_wide("x_", "y_", percent))
    pairs = stash(fit.select("a", "b"), "fit")
    drop(active)
    active = _active(pairs, members)
    sets = stash(_sets(docs, active, k), "sets")
    one = sets.select(F.col("set_key").alias("a"), F.col("shingles").alias("sa"))
    two = sets.select(F.col("set_key").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    joined = pairs.join(one, "a").join(two, "b")
    links = stash(joined.where(100 * both >= percent * (F.size("sa") + F.size("sb") - both)).select("a", "b"), "links")
    drop(active, sets, wide, pairs)
    return links


def _prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*(F.col(c).alias(f"{prefix}{c}") for c in df.columns))


def _classes(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """``doc_id, text_hash, n, set_key`` of each document (among others), and ``set_key, doc_id, part`` of each set: its least doc_id and its class."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    table = stash(shingle_table(docs, k, percent, frequency_ranks(docs, k)), "shingles")

    # one row for each set, one group for each prefix and size
    firsts = [F.max(c).alias(c) for c in ("n", "prefix_key", "weight")] + [F.first(c).alias(c) for c in SKETCH]
    reps = table.where("n > 0").groupBy("set_key").agg(F.min("doc_id").alias("doc_id"), *firsts)
    reps = stash(reps, "reps")
    keyed = reps.groupBy("prefix_key", "n").agg(F.min("set_key").alias("gid"), F.count("*").alias("sets"))
    members = stash(reps.join(keyed, ["prefix_key", "n"]).drop("prefix_key"), "members")
    leaders = members.where("gid = set_key").drop("set_key")
    wanted = leaders.select(F.col("gid").alias("set_key"), "doc_id")
    prefixes = table.join(wanted, table.doc_id.eqNullSafe(wanted.doc_id) & (table.set_key == wanted.set_key), "left_semi")
    groups = stash(prefixes.dropDuplicates(["set_key"]).select(F.col("set_key").alias("gid"), F.col("n").cast("int").alias("n"), "prefix"), "groups")

    # a linked pair's first common shingle is in the prefix of both, and of the smaller set where an equal one can still link
    posting = groups.select("gid", "n", F.posexplode("prefix").alias("place", "token"))
    early = f"{100 + percent}L * (n - place) >= {2 * percent}L * n"
    lists = posting.groupBy("token").agg(F.sum(F.expr(f"if({early}, 4294967297L, 1L)")).alias("both"))
    lists = lists.select("token", F.expr("both & 4294967295L").alias("groups")).where("both >= 4294967296L AND groups > 1")
    listed = stash(posting.join(lists, "token"), "postings")
    long = listed.where(F.col("groups") > SHORT)
    top = long.join(leaders.select("gid", "weight"), "gid").groupBy("token").agg(F.max(F.struct("weight", "gid")).alias("top"))
    hubs = top.select("token", F.col("top.gid").alias("hub"))

    # one hub for each long posting list, and for each group its own leader
    hub = _prefixed(leaders.select("gid", "n", *SKETCH), "h_")
    to_hub = long.join(hubs, "token").select("gid", "hub").where("gid <> hub").distinct().join(members, "gid")
    fit = F.expr(_may_link(("n", "h_n"), ("", "h_"), percent))
    stars = to_hub.join(hub, (to_hub.hub == hub.h_gid) & fit).select(F.col("hub").alias("a"), F.col("set_key").alias("b"))
    own = members.where("gid <> set_key").select(F.col("gid").alias("a"), F.col("set_key").alias("b"))
    first = stash(stars.unionByName(own).distinct(), "first")
    linked = _verified(first, docs, table, members, k, percent)

    # what the hubs have not joined is paired, group with group, and expanded
    parts = components(linked, "a", "b")
    labelled = members.join(parts, members.set_key == parts.node, "left").withColumn("part", F.coalesce("component", "set_key"))
    labelled = stash(labelled.drop("node", "component", "doc_id"), "labelled")
    spans = stash(labelled.groupBy("gid").agg(F.min("part").alias("low"), F.max("part").alias("high")), "spans")
    room = f"{100 + percent}L * least(l_n - l_place, r_n - r_place) >= {percent}L * (l_n + r_n) AND (l_n < r_n OR l_n = r_n AND l_gid < r_gid)"
    short = listed.where(F.col("groups") <= SHORT).drop("groups")
    left, right = _prefixed(short.where(early), "l_"), _prefixed(short, "r_")
    few = left.join(right, F.expr(f"l_token = r_token AND 100L * l_n >= {percent}L * r_n AND {room}")).select("l_gid", "r_gid")
    # of long lists groups meet under a token and a size class, of which only neighbours can reach the threshold
    size_class = F.floor(F.log(F.col("n").cast("double")) / float(max(np.log(100 / percent), 1e-6) * 1.0001)).cast("int")
    lead = labelled.where("gid = set_key").select("gid", size_class.alias("size"), F.when(F.col("sets") > 1, 2 * F.col("n")).otherwise(0).alias("wide"), *SKETCH)
    spread = long.drop("groups").join(spans, "gid")
    many = spread.groupBy("token").agg(F.min("low").alias("p"), F.max("high").alias("q")).where("p < q").select("token")
    spread = stash(spread.join(many, "token").join(lead, "gid"), "spread")
    left, right = _prefixed(spread.where(early), "l_"), _prefixed(spread, "r_")
    fit = F.expr(_may_link(("l_n", "r_n"), ("l_", "r_"), percent, "l_wide + r_wide"))
    right = right.withColumn("near", F.explode(F.array(F.col("r_size") - 1, F.col("r_size"))))
    met = F.expr(f"l_token = r_token AND l_size = near AND least(l_low, r_low) < greatest(l_high, r_high) AND {room}")
    crowd = left.join(right, met & fit).select("l_gid", "r_gid")
    inside = spans.where("low < high").select(F.col("gid").alias("l_gid"), F.col("gid").alias("r_gid"))
    pairs = stash(few.unionByName(crowd).unionByName(inside).distinct(), "pairs")
    sets = labelled.select("gid", "part", "set_key", "n", *SKETCH)
    ends = pairs.join(_prefixed(sets, "l_"), "l_gid")
    far = _prefixed(sets, "x_")
    fit = F.expr("r_gid = x_gid AND l_part <> x_part AND (l_gid <> r_gid OR l_set_key < x_set_key) AND " + _may_link(("l_n", "x_n"), ("l_", "x_"), percent))
    ends = ends.join(far, fit).select(F.col("l_set_key").alias("a"), F.col("x_set_key").alias("b"))
    done = first.unionByName(first.select(F.col("b").alias("a"), F.col("a").alias("b")))
    second = stash(ends.join(done, ["a", "b"], "left_anti"), "second")
    more = _verified(second, docs, table, members, k, percent)

    final = components(linked.unionByName(more), "a", "b")
    named = reps.join(final, reps.set_key == final.node, "left").select("set_key", "doc_id", F.coalesce("component", "set_key").alias("part"))
    named = stash(named, "named")
    drop(reps, groups, listed, first, linked, labelled, spans, spread, pairs, second, more, members)
    return table, named


def jaccard_classes(docs: DataFrame, k: int = 3, percent: int = 90) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for each row of ``docs`` (doc_id, text; others ignored).

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, a set holds the distinct ``k``-word
    shingles, and two documents link when 100 * intersection >= percent * union. component_id is the
    smallest doc_id that links reach. A null text and one without words have n_shingles 0 and link
    with nothing. A null doc_id keeps its row and links as any other, but names no component unless
    all of its members have none (then null). Repeated rows link with each other, each keeps its
    row, texts are taken whole, however long, and no rows give no rows.
    """
    table, named = _classes(docs, k, percent)
    lowest = stash(named.groupBy("part").agg(F.min("doc_id").alias("component_id")), "lowest")
    by_set = stash(named.join(lowest, "part").select("set_key", "component_id"), "by_set")
    drop(named, lowest)
    out = table.select("doc_id", "n", "set_key").join(by_set, "set_key", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, k: int = 3, percent: int = 90) -> DataFrame:
    """One row of ``docs`` from each class of near copies; all other rows go.

    The row of least doc_id stays, nulls last, and of several such the one whose text's hash is least; so what
    stays of a class depends on its own rows alone. Of rows alike in both, any one stays. Rows without words all stay.
    """
    columns = docs.columns
    table, named = _classes(docs, k, percent)
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")
    rows = table.where("n > 0").select("set_key", "doc_id", "text_hash").join(named.select("set_key", "part"), "set_key")
    rows = stash(rows.groupBy("part", "doc_id", "text_hash").agg(F.count("*").alias("times")), "alike")
    first = rows.groupBy("part").agg(F.min(order).alias("least")).select("part", F.col("least.doc_id").alias("kept_id"), F.col("least.text_hash").alias("kept_hash"))
    judged = rows.join(first, "part").withColumn("stays", F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("text_hash") == F.col("kept_hash")))
    judged = stash(judged.where("NOT stays OR times > 1").select("doc_id", "text_hash", "stays"), "judged")
    drop(table, named, rows)
    whole = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("hash"))
    same = F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("text_hash"))
    kept = whole.join(broadcast_if(judged, BROADCAST_IDS), same, "left_anti").select("row")
    if judged.where("stays").limit(1).count():
        repeated = whole.join(broadcast_if(judged.where("stays"), BROADCAST_IDS), same, "left_semi")
        kept = kept.unionByName(repeated.dropDuplicates(["id", "hash"]).select("row"))
    return kept.select("row.*").select(*(F.col(f"`{c}`") for c in columns))


def op5_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
