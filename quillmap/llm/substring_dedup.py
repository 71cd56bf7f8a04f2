"""Repeated passages by MinHash banding over paragraphs and over overlapping word windows.

Two kinds of units are looked at. Whole paragraphs have a MinHash signature over five-word shingles, cut
into bands; colliding paragraphs are joined and verified by exact Jaccard. Passages that start or end
inside paragraphs are found through the windows of ``LEAST_WORDS`` words that begin at every word: a window's
one band is its MinHash over ``BLOCK``-word shingles, and neighbouring windows with the same least shingle
are one row. Two equal windows always collide, wherever paragraphs end; colliding shingles are
equal in 128 bits, and a match is extended, word by word in 64 bits each, to where the two texts stop agreeing.

Matches become links and links become classes by connected components. Every shared shingle is kept by the least
document that holds it. A document loses only what that keeper has word for word, and never words
that it keeps for another one, so no repeated passage vanishes.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .ngram_join import BROADCAST_IDS, fingerprint, parity_sketch
from .store import broadcast_if, drop, small_batches, stash
from .words import NOT_SPACE, Words, gram, mix, rolling, slices

#: Words of a paragraph's shingle, and least Jaccard similarity of paragraphs in percent.
SHINGLE, PERCENT = 5, 80
#: Words of the shortest passage that counts, and so of a window.
LEAST_WORDS = 50
#: Words of a window's shingle. A window's chosen shingles are at most LEAST_WORDS - BLOCK + 1 words apart, so
#: that neighbours overlap by 7 words and any 8 words of a passage lie in one of them.
BLOCK = 29
#: Words that a passage can reach beyond its first and last chosen shingle.
MARGIN = LEAST_WORDS - BLOCK
#: Two documents that share LEAST_WORDS words across a point share CORE words across it, with these parts to its right or left.
CORE, PARTS = LEAST_WORDS - 6, tuple(range(1, MARGIN + 1, 7))
#: Rows of a band; the number of bands follows from the recall wanted at the threshold.
ROWS, RECALL = 4, 0.98
LANES = 8
SKETCH = [f"s{i}" for i in range(LANES)]
_OTHER = np.uint64(0x5851F42D4C957F2D)


def bands_for(percent: int = PERCENT, rows: int = ROWS, recall: float = RECALL) -> int:
    """Fewest bands whose chance to collide at the threshold is ``recall``."""
    miss = 1 - (percent / 100) ** rows
    return int(np.ceil(np.log(1 - recall) / np.log(miss)))


_SEEDS = np.random.default_rng(77).integers(1, 2**63, 64, dtype=np.int64).astype(np.uint64) | np.uint64(1)


def _paragraphs(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """First and end word of each paragraph of LEAST_WORDS or more; paragraphs end at newlines and at rows' ends."""
    breaks = np.flatnonzero(w.data == 10)
    edges = np.unique(np.concatenate([w.first, np.searchsorted(w.start, breaks)]))
    long = edges[1:] - edges[:-1] >= LEAST_WORDS
    return edges[:-1][long], edges[1:][long]


def _shingle_sets(h: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """All shingles, and each paragraph's set of them."""
    g = gram(h, SHINGLE)
    return g, [np.unique(g[a : b - SHINGLE + 1]) for a, b in zip(first, end)]


def _band_keys(g: np.ndarray, first: np.ndarray, end: np.ndarray, bands: int) -> np.ndarray:
    """Band keys of each paragraph."""
    cuts = np.column_stack([first, end - SHINGLE + 1]).ravel()
    if cuts[-1] == len(g):
        cuts = cuts[:-1]
    keys = np.zeros((len(first), bands), np.uint64)
    for i in range(bands * ROWS):
        low = np.minimum.reduceat(g * _SEEDS[i], cuts)[::2]  # shingles are mixed already
        keys[:, i // ROWS] = mix(keys[:, i // ROWS] * np.uint64(0x9E3779B97F4A7C15) + low + np.uint64(i + 1))
    return keys.view(np.int64)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` consecutive values."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x = np.minimum(x[:-step], x[step:])
        done += step
    return x


def _blocks(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First words and two hashes of the least shingles of each row's windows; of a shorter row, of all its shingles."""
    out, codes, checks = [], [], []
    g, other = rolling(h, BLOCK), rolling(mix(h ^ _OTHER), BLOCK)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        n = b - a - BLOCK + 1
        if n <= 0:
            continue
        x = g[a : a + n]
        low = _sliding_min(x, min(n, MARGIN + 1))
        padded = np.concatenate([np.zeros(n - len(low), np.uint64), low, np.zeros(n - len(low), np.uint64)])
        high = ~_sliding_min(~padded, n - len(low) + 1)
        at = np.flatnonzero(high == x)
        out.append(at + a)
        codes.append(x[at])
        checks.append(other[a : a + n][at])
    join = lambda parts, kind: np.concatenate(parts) if parts else np.empty(0, kind)
    return join(out, np.int64), join(codes, np.uint64), join(checks, np.uint64)


def _block_table(docs: DataFrame) -> DataFrame:
    """doc_id, start, code, tail of all windows' shingles; code and tail are 128 bits together."""

    def run(batches):
        for batch in batches:
            for lo, hi in slices(batch.column(1)):
                w = Words(batch.column(1).slice(lo, hi - lo), NOT_SPACE)
                at, code, check = _blocks(w.hashes(), w.first)
                row = np.searchsorted(w.first, at, side="right") - 1
                columns = [batch.column(0).take(pa.array(row + lo)), pa.array((at - w.first[row]).astype(np.int32)), pa.array(code.view(np.int64)), pa.array(check.view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "code", "tail"])

    return docs.mapInArrow(run, "doc_id long, start int, code long, tail long")


def _paragraph_table(docs: DataFrame, bands: int) -> DataFrame:
    """doc_id, start, n_words, set_key, n, sketch, keys of all paragraphs that count."""

    def run(batches):
        for batch in batches:
            for lo, hi in slices(batch.column(1)):
                w = Words(batch.column(1).slice(lo, hi - lo), NOT_SPACE)
                first, end = _paragraphs(w)
                if not len(first):
                    continue
                g, sets = _shingle_sets(w.hashes(), first, end)
                sketch, keys = np.stack([parity_sketch(s, LANES) for s in sets]), _band_keys(g, first, end, bands)
                row = np.searchsorted(w.first, first, side="right") - 1
                offsets = np.arange(len(first) + 1, dtype=np.int32) * bands
                columns = [batch.column(0).take(pa.array(row + lo)), pa.array((first - w.first[row]).astype(np.int32)), pa.array((end - first).astype(np.int32)), pa.array([fingerprint(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64())]
                columns += [*(pa.array(x.copy()) for x in sketch.T), pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel()))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_words", "set_key", "n", *SKETCH, "keys"])

    return docs.mapInArrow(run, "doc_id long, start int, n_words int, set_key long, n long, " + ", ".join(f"{s} long" for s in SKETCH) + ", keys array<long>")


def _fits(percent: int) -> str:
    odd = " + ".join(f"bit_count(a_{s} ^ b_{s})" for s in SKETCH)
    return f"100 * least(a_n, b_n) >= {percent} * greatest(a_n, b_n) AND (100 + {percent}) * ({odd}) <= (100 - {percent}) * (a_n + b_n)"


def _named(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*(F.col(c).alias(prefix + c) for c in df.columns))


def _verified(pairs: DataFrame, sets: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of set keys whose whole shingle sets reach the threshold."""
    ends = pairs.select(F.col("a").alias("set_key")).unionByName(pairs.select(F.col("b").alias("set_key"))).distinct()
    active = stash(sets.select("set_key", "doc_id").join(ends, "set_key", "left_semi"), "active")

    def run(batches):
        for batch in batches:
            for lo, hi in slices(batch.column(0)):
                w = Words(batch.column(0).slice(lo, hi - lo), NOT_SPACE)
                found = _shingle_sets(w.hashes(), *_paragraphs(w))[1]
                yield pa.RecordBatch.from_arrays([pa.array([fingerprint(s) for s in found], pa.int64()), pa.array([s.view(np.int64) for s in found], pa.list_(pa.int64()))], ["set_key", "shingles"])

    texts = docs.join(broadcast_if(active.select("doc_id").distinct(), BROADCAST_IDS), "doc_id", "left_semi").select("text")
    shingles = texts.mapInArrow(run, "set_key long, shingles array<long>").join(broadcast_if(active.select("set_key"), BROADCAST_IDS), "set_key", "left_semi")
    shingles = stash(shingles.dropDuplicates(["set_key"]), "shingles")
    one, two = shingles.select(F.col("set_key").alias("a"), F.col("shingles").alias("sa")), shingles.select(F.col("set_key").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    joined = pairs.join(one, "a").join(two, "b")
    links = stash(joined.where(100 * both >= percent * (F.size("sa") + F.size("sb") - both)).select("a", "b"), "links")
    drop(active, shingles)
    return links


def paragraph_classes(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``doc_id, start, n_words, class, source_doc_id`` of paragraphs that are alike with one of another document.

    Colliding bands are verified against two hubs first; what that leaves in different classes is
    paired under the sketches' bound and verified too, so no link between different sets is given up.
    A pair meets under its band and size class, of which only neighbours can reach the threshold.
    """
    bands = bands_for(percent)
    table = stash(_paragraph_table(docs, bands), "paragraphs")
    sets = stash(table.groupBy("set_key").agg(F.min("doc_id").alias("doc_id"), F.max("doc_id").alias("last"), F.max("n").alias("n"), *(F.first(s).alias(s) for s in SKETCH), F.first("keys").alias("keys")), "sets")
    keyed = sets.select("set_key", F.posexplode("keys").alias("band", "key"))
    hubs = stash(keyed.groupBy("key").agg(F.min("set_key").alias("hub"), F.max("set_key").alias("top")).where("hub < top"), "hubs")
    listed = stash(keyed.join(hubs, "key"), "bands")
    facts = sets.select("set_key", "n", "keys", *SKETCH)
    stars = listed.select(F.col("set_key").alias("b"), F.explode(F.array("hub", "top")).alias("a")).where("a <> b")
    stars = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    stars = stars.join(_named(facts, "a_"), F.col("a") == F.col("a_set_key")).join(_named(facts, "b_"), (F.col("b") == F.col("b_set_key")) & F.expr(_fits(percent)))
    first = stash(stars.select("a", "b"), "first")
    linked = _verified(first, sets, docs, percent)
    parts = components(linked, "a", "b")
    spread = listed.select("key", "band", "set_key").join(parts, F.col("set_key") == F.col("node"), "left").withColumn("part", F.coalesce("component", "set_key")).select("key", "band", "set_key", "part")
    spread = stash(spread, "spread")
    many = spread.groupBy("key").agg(F.min("part").alias("p"), F.max("part").alias("q")).where("p < q").select("key")
    size_class = F.floor(F.log(F.col("n").cast("double")) / float(max(np.log(100 / percent), 1e-6) * 1.0001)).cast("int")
    rest = stash(spread.join(stash(many, "many"), "key").join(facts, "set_key").withColumn("size", size_class), "rest")
    # a pair comes from the first band in which it collides
    earlier = " AND ".join(f"NOT (a_band > {j} AND a_keys[{j}] = b_keys[{j}])" for j in range(bands))
    near = _named(rest, "b_").withColumn("near", F.explode(F.array(F.col("b_size") - 1, F.col("b_size"), F.col("b_size") + 1)))
    pairs = _named(rest, "a_").join(near, F.expr("a_key = b_key AND a_size = near AND a_part < b_part") & F.expr(_fits(percent)) & F.expr(earlier))
    pairs = pairs.select(F.col("a_set_key").alias("a"), F.col("b_set_key").alias("b")).distinct()
    done = first.unionByName(first.select(F.col("b").alias("a"), F.col("a").alias("b")))
    second = stash(pairs.join(done, ["a", "b"], "left_anti"), "second")
    more = _verified(second, sets, docs, percent)
    final = components(linked.unionByName(more), "a", "b")
    classes = sets.join(final, sets.set_key == final.node, "left").select("set_key", "doc_id", "last", F.coalesce("component", "set_key").alias("class"))
    classes = stash(classes, "classes")
    shared = classes.groupBy("class").agg(F.min("doc_id").alias("source_doc_id"), F.max("last").alias("last")).where("source_doc_id < last").select("class", "source_doc_id")
    shared = stash(shared, "shared")
    by_set = stash(classes.join(shared, "class").select("set_key", "class", "source_doc_id"), "by_set")
    drop(sets, hubs, listed, first, linked, spread, rest, second, more, classes, shared)
    return table.join(by_set, "set_key").select("doc_id", "start", "n_words", "class", "source_doc_id")


_RUN = "doc_id long, start int, n_words int, source_doc_id long, source_start int, codes array<long>"


def _runs(batches):
    """A document's shared shingles, joined where neighbours overlap and have one source and one shift against it."""
    for batch in batches:
        out = {k: [] for k in ("doc_id", "start", "n_words", "source_doc_id", "source_start", "codes")}
        for doc_id, blocks in zip(batch.column(0).to_pylist(), batch.column(1)):
            start, code, low, there = (blocks.values.field(i).to_numpy(zero_copy_only=False) for i in range(4))
            cut = np.flatnonzero(np.concatenate([[True], (start[1:] >= start[:-1] + BLOCK) | (low[1:] != low[:-1]) | (start[1:] - there[1:] != start[:-1] - there[:-1])]))
            for a, b in zip(cut, [*cut[1:], len(start)]):
                for k, v in zip(out, (doc_id, int(start[a]), int(start[b - 1] - start[a]) + BLOCK, int(low[a]), int(there[a]), code[a:b])):
                    out[k].append(v)
        types = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types)], list(out))


def _around(w: Words, h: np.ndarray, row: np.ndarray, at: np.ndarray, missing: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the MARGIN words to the left of word ``at`` of each row, the nearest first, and of those from it on."""
    begin, end, step = w.first[:-1][row], w.first[1:][row], np.arange(MARGIN)
    out = []
    for place in ((begin + at)[:, None] - 1 - step, (begin + at)[:, None] + step):
        there = (place >= begin[:, None]) & (place < end[:, None])
        out.append(np.where(there, h[np.where(there, place, 0)] if len(h) else np.uint64(0), np.uint64(missing)).view(np.int64))
    return out[0], out[1]


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values))


def _surroundings(batches):
    """The words on both sides of each of a document's places, which are in front of a word or at the text's end."""
    for batch in batches:
        for lo, hi in slices(batch.column(1)):
            w = Words(batch.column(1).slice(lo, hi - lo), NOT_SPACE)
            places = batch.column(2).slice(lo, hi - lo)
            row, at = np.repeat(np.arange(hi - lo), places.value_lengths().to_numpy()), places.flatten().to_numpy().astype(np.int64)
            left, right = _around(w, w.hashes(), row, at, 0)
            columns = [batch.column(0).slice(lo, hi - lo).take(pa.array(row)), pa.array(at.astype(np.int32)), *(_lists(x.ravel(), np.full(len(row), MARGIN)) for x in (left, right))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "place", "left", "right"])


_SPAN = "doc_id long, start long, n_words long, class long, source_doc_id long, source_start long, before array<long>, after array<long>, lacks_left boolean, lacks_right boolean, cores_left array<long>, cores_right array<long>"


def _cores(core: np.ndarray, begin: np.ndarray, end: np.ndarray, first: np.ndarray) -> pa.ListArray:
    """Hashes of the CORE words from each of ``first`` (n, len(PARTS)) on; null where the text, ``begin`` to ``end``, has not so many."""
    inside = (first >= begin[:, None]) & (first + CORE <= end[:, None])
    values = core[np.where(inside, first, 0)] if len(core) else np.zeros(first.shape, np.uint64)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(first) + 1, dtype=np.int32) * len(PARTS)), pa.array(values.ravel().view(np.int64), mask=~inside.ravel()))


def _extended(batches):
    """Each document's runs to where the texts stop agreeing, and the words after that which a window could still hold.

    lacks_left and lacks_right tell that no other run, sharing 7 words, goes on there.
    """
    names = [f.split()[0] for f in _SPAN.split(", ")]
    for batch in batches:
        for lo, hi in slices(batch.column(1)):
            w = Words(batch.column(1).slice(lo, hi - lo), NOT_SPACE)
            lists = batch.column(2).slice(lo, hi - lo)
            row, runs = np.repeat(np.arange(hi - lo), lists.value_lengths().to_numpy()), lists.flatten()
            fits = runs.field("start").to_numpy() + runs.field("n_words").to_numpy() <= w.counts()[row]  # else of another text under the same id
            row, runs = row[fits], runs.filter(pa.array(fits))
            doc_id = batch.column(0).slice(lo, hi - lo).take(pa.array(row))
            start, size, kind, source, there = (runs.field(k).to_numpy().astype(np.int64) for k in ("start", "n_words", "class", "source_doc_id", "source_start"))
            h = w.hashes()
            own_left, own_right = _around(w, h, row, start, 1)[0], _around(w, h, row, start + size, 1)[1]
            left, right = (np.cumprod(own == runs.field(k).flatten().to_numpy().reshape(-1, MARGIN), axis=1).sum(axis=1) if len(row) else np.empty(0, np.int64) for own, k in ((own_left, "left"), (own_right, "right")))
            a, b = start - left, start + size + right
            more = []
            for own, n, room in ((own_left, left, start), (own_right, right, w.counts()[row] - start - size)):
                take = (np.arange(MARGIN) >= n[:, None]) & (np.arange(MARGIN) < room[:, None])
                more.append(_lists(own[take], take.sum(axis=1)))
            # other sources' runs that go on where this one ends
            others, base = np.flatnonzero(source != doc_id.to_numpy()), row * np.int64(1 << 40)
            first = np.sort((base + a)[others])
            reach = np.concatenate([[-1], np.maximum.accumulate((base + b)[others][np.argsort((base + a)[others], kind="stable")])]) if len(others) else np.array([-1])
            lacks_right = reach[np.searchsorted(first, base + b - 7, side="right")] <= base + b
            last = np.sort(-(base + b)[others])
            back = np.concatenate([[1], np.minimum.accumulate((base + a)[others][np.argsort(-(base + b)[others], kind="stable")])]) if len(others) else np.array([1])
            count = np.searchsorted(last, -(base + a + 7), side="right")
            lacks_left = (count == 0) | (back[count] >= base + a)
            core, begin, end, parts = rolling(h, CORE), w.first[:-1][row], w.first[1:][row], np.array(PARTS)
            cores = [_cores(core, begin, end, (begin + a)[:, None] - parts), _cores(core, begin, end, (begin + b)[:, None] + parts - CORE)]
            lacks = [pa.array(x & (source != doc_id.to_numpy())) for x in (lacks_left, lacks_right)]
            columns = [doc_id, *(pa.array(x) for x in (a, b - a, kind, source, there - left)), *more, *lacks, *cores]
            yield pa.RecordBatch.from_arrays(columns, names)


def _tails(spans: DataFrame) -> DataFrame:
    """Rows like ``spans`` of what documents share beyond the point where their common source stops agreeing.

    Documents that leave one source at one point are compared by the words that follow there, in reading
    order to the right and against it to the left; one that no other run of its own covers there takes the longest
    run of them that a lesser one has. A row begins BLOCK words before that point, where all of them agree with the source.
    Only documents that share CORE words across that point with another one are compared, as all do that share a window there.
    """
    key = ["source_doc_id", "stop", "right"]
    end, there = F.col("start") + F.col("n_words"), F.col("source_start") + F.col("n_words")
    right = spans.select("doc_id", "class", "source_doc_id", there.alias("stop"), F.lit(True).alias("right"), end.alias("at"), F.col("after").alias("more"), F.col("lacks_right").alias("lacks"), F.col("cores_right").alias("cores"))
    left = spans.select("doc_id", "class", "source_doc_id", F.col("source_start").alias("stop"), F.lit(False).alias("right"), F.col("start").alias("at"), F.col("before").alias("more"), F.col("lacks_left").alias("lacks"), F.col("cores_left").alias("cores"))
    ends = right.unionByName(left).where("size(more) > 0")
    cores = reduce(DataFrame.unionByName, (ends.select(*key, "doc_id", "at", "lacks", F.lit(i).alias("part"), F.col("cores")[i].alias("core")).where("core IS NOT NULL") for i in range(len(PARTS))))
    met = cores.groupBy(*key, "part", "core").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.max("lacks").alias("lacking")).where("low < high AND lacking")
    met = stash(met.select(*key, "part", "core"), "met")
    needy = cores.where("lacks").join(met, [*key, "part", "core"]).select(*key, "doc_id", "at").distinct()
    needy = stash(ends.where("lacks").join(needy, [*key, "doc_id", "at"]), "needy")
    # the least document with each run of words, whatever its length, at the points of those that lack; only they are joined to it
    points = broadcast_if(stash(needy.select(*key).distinct(), "points"), BROADCAST_IDS)
    ends = stash(ends.select(*key, "doc_id", "at", "more", "lacks").join(points, key, "left_semi"), "ends")
    cut = lambda n: F.xxhash64(F.slice("more", 1, n)).alias("prefix")
    every = reduce(DataFrame.unionByName, (ends.where(F.size("more") >= n).select(*key, F.lit(n).alias("n"), cut(n), "doc_id", "lacks") for n in range(1, MARGIN + 1)))
    least = every.groupBy(*key, "n", "prefix").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.max("lacks").alias("lacking")).where("low < high AND lacking")
    least = stash(least.select(*key, "n", "prefix", "low"), "least")
    prefixes = needy.select(*key, "doc_id", "class", "at", F.posexplode(F.expr("transform(sequence(1, size(more)), n -> xxhash64(slice(more, 1, n)))")).alias("n", "prefix")).withColumn("n", F.col("n") + 1)
    longest = prefixes.join(least, [*key, "n", "prefix"]).where("low < doc_id").groupBy(*key, "doc_id", "class", "at").agg(F.max(F.struct("n", "prefix", "low")).alias("x"))
    longest = stash(longest.select(*key, "doc_id", "class", "at", "x.n", "x.prefix", "x.low"), "longest")
    lows = ends.select(*key, F.col("doc_id").alias("low"), F.col("at").alias("low_at"), "more").join(longest.select(*key, "low").distinct(), [*key, "low"])
    found = longest.join(lows, [*key, "low"]).where(F.xxhash64(F.expr("slice(more, 1, n)")) == F.col("prefix")).groupBy(*key, "doc_id", "class", "at", "n", "low").agg(F.min("low_at").alias("low_at"))
    back = F.when(F.col("right"), F.lit(BLOCK)).otherwise(F.col("n"))
    tails = found.select("doc_id", (F.col("at") - back).alias("start"), (F.col("n") + BLOCK).cast("long").alias("n_words"), "class", F.col("low").alias("source_doc_id"), (F.col("low_at") - back).alias("source_start"))
    tails = stash(tails, "tails")
    drop(met, needy, points, ends, least, longest)
    return tails


def _cover(batches):
    """Of each document's rows those in stretches of LEAST_WORDS or more, and of these as few as cover the same words.

    Rows that overlap or adjoin are a stretch. Each row taken is the one that goes farthest of those that
    share 7 words with what is covered, so that any 8 words of a stretch lie in one row.
    """
    for batch in batches:
        doc_ids, taken = batch.column(0).to_pylist(), []
        flat = batch.column(1).flatten()
        start, size = flat.field(0).to_numpy(), flat.field(1).to_numpy()
        ends, offsets = (start + size).tolist(), batch.column(1).offsets.to_numpy() - batch.column(1).offsets[0].as_py()
        starts, owner = start.tolist(), []
        for i in range(len(doc_ids)):
            at, stop = int(offsets[i]), int(offsets[i + 1])
            while at < stop:
                chosen, first, covered = [at], starts[at], ends[at]
                at += 1
                while at < stop and starts[at] <= covered:
                    best, reach, j = -1, covered, at
                    while j < stop and starts[j] <= covered - 7:
                        if ends[j] > reach:
                            best, reach = j, ends[j]
                        j += 1
                    if best < 0 and j < stop and starts[j] <= covered:  # rows that share fewer words
                        best, reach, j = j, max(covered, ends[j]), j + 1
                    at = j
                    if best >= 0:
                        if starts[best] == first and len(chosen) == 1:
                            chosen = []
                        chosen.append(best)
                        covered = reach
                if covered - first >= LEAST_WORDS:
                    taken += chosen
                    owner += [doc_ids[i]] * len(chosen)
        rows = flat.take(pa.array(taken, pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(owner, pa.int64()), *(rows.field(k) for k in range(5))], ["doc_id", "start", "n_words", "source_doc_id", "source_start", "class"])


def window_matches(docs: DataFrame) -> DataFrame:
    """``doc_id, start, n_words, class, source_doc_id, source_start``: what a document has word for word in a lesser one.

    Whatever LEAST_WORDS words a lesser document has are under these rows to the last word. The parts of a
    stretch can have different sources: a part's source is the least document with its shingles, or
    beyond the point where that stops agreeing, the least that goes on alike. Parts are of one class
    where shingles follow on each other in some document.
    """
    table = stash(_block_table(docs), "blocks")
    shared = table.groupBy("code", "tail").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("code", "tail", "low")
    hits = stash(table.join(stash(shared, "codes"), ["code", "tail"]), "hits")
    drop(table)
    heads = stash(hits.where("doc_id = low").groupBy("code", "tail").agg(F.min("start").alias("there")), "heads")
    order = F.array_sort(F.collect_set(F.struct("start", "code", "low", "there")))  # one document's
    # a source's other places for a shingle are looked at too: what follows there can be what a document has
    by_doc = hits.join(heads, ["code", "tail"]).where("doc_id <> low OR start <> there").groupBy("doc_id").agg(order.alias("blocks"))
    found = stash(by_doc.mapInArrow(_runs, _RUN), "runs")
    drop(hits, heads)
    steps = found.select(F.explode(F.arrays_zip(F.slice("codes", F.lit(1), F.size("codes") - 1).alias("u"), F.slice("codes", F.lit(2), F.size("codes")).alias("v"))).alias("e")).select("e.u", "e.v").distinct()
    parts = components(steps)
    runs = found.withColumn("head", F.col("codes")[0]).drop("codes").join(parts, F.col("head") == F.col("node"), "left")
    runs = stash(runs.select("doc_id", "start", "n_words", "source_doc_id", "source_start", F.coalesce("component", "head").alias("class")), "classed")
    drop(found)
    # the words around the source's first and last shingle, of each place once
    end = (F.col("source_start") + F.col("n_words")).alias("place")
    places = runs.select(F.col("source_doc_id").alias("doc_id"), F.col("source_start").alias("place")).unionByName(runs.select(F.col("source_doc_id").alias("doc_id"), end)).distinct()
    places = broadcast_if(stash(places.groupBy("doc_id").agg(F.collect_list("place").alias("places")), "places"), BROADCAST_IDS // 16)
    around = docs.join(places, "doc_id").select("doc_id", "text", "places").mapInArrow(_surroundings, "doc_id long, place int, left array<long>, right array<long>")
    around = stash(around.dropDuplicates(["doc_id", "place"]), "around")
    left = around.select(F.col("doc_id").alias("source_doc_id"), F.col("place").alias("source_start"), "left")
    right = around.select(F.col("doc_id").alias("right_doc_id"), F.col("place").alias("right_place"), "right")
    joined = runs.join(left, ["source_doc_id", "source_start"])
    joined = joined.join(right, (F.col("source_doc_id") == F.col("right_doc_id")) & (F.col("source_start") + F.col("n_words") == F.col("right_place")))
    joined = joined.groupBy("doc_id").agg(F.collect_list(F.struct("start", "n_words", "class", "source_doc_id", "source_start", "left", "right")).alias("runs"))
    spans = stash(docs.join(joined, "doc_id").select("doc_id", "text", "runs").mapInArrow(_extended, _SPAN), "spans")
    drop(runs, places, around)
    tails = _tails(spans)
    rows = spans.where("doc_id <> source_doc_id").select(*tails.columns).unionByName(tails)
    rows = rows.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("start", "n_words", "source_doc_id", "source_start", "class"))).alias("rows"))  # one document's
    matches = stash(rows.mapInArrow(_cover, "doc_id long, start long, n_words long, source_doc_id long, source_start long, class long"), "matches")
    drop(spans, tails)
    return matches


def repeated_passages(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``doc_id, kind, start, n_words, class, source_doc_id, source_start, removed``: passages that documents of ``docs`` share.

    start and n_words count ``[^\\x20\\x09-\\x0D]+`` words of the text with A-Z lower-cased. Kind is
    ``paragraph`` (LEAST_WORDS or more, alike to ``percent``; no source_start) or ``window`` (the same words as the
    source from its source_start on, wherever paragraphs end). A removed row goes, for its source has or resembles it; other
    rows are what a source keeps for them, whole, even where it overlaps a removed row of its own.
    The least doc_id keeps a class of paragraphs, and each shingle of a window is kept by the least that holds it.
    Texts are looked at whole, however long. Texts that share nothing give no row, and so do null and empty texts and rows without doc_id; repetition within
    one document does not count, and rows that repeat are one document. Ties do not occur, since ids differ. No rows give no rows.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL")
    alike = paragraph_classes(docs, percent).select("doc_id", F.lit("paragraph").alias("kind"), *(F.col(c).cast("long").alias(c) for c in ("start", "n_words", "class", "source_doc_id")), F.lit(None).cast("long").alias("source_start"))
    same = window_matches(docs)
    kept = same.select(F.col("source_doc_id").alias("doc_id"), F.col("source_start").alias("start"), "n_words", "class", "source_doc_id", "source_start").distinct()
    found = alike.unionByName(same.unionByName(kept).withColumn("kind", F.lit("window")).select(*alike.columns))
    return found.withColumn("removed", F.col("doc_id") != F.col("source_doc_id"))


def remove_passages(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """``docs`` without the removed ones of ``passages``: their words and the space between them are cut from ``text``.

    Words of rows that the document keeps for others are not cut, since the others lose them. Rows without a removed passage, null texts and rows without doc_id stay as they are.
    """
    cuts = passages.groupBy("doc_id").agg(F.collect_set(F.struct("start", "n_words", "removed")).alias("cuts"), F.max("removed").alias("any")).where("any").drop("any")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), "text")
    joined = rows.join(cuts, rows.id == cuts.doc_id, "left").select("row", "text", "cuts")

    def run(batches):
        for batch in batches:
            texts, out = batch.column(1), []
            for i, cut in enumerate(batch.column(2).to_pylist()):
                text = texts[i].as_py()
                if cut and text is not None:
                    w, raw = Words(texts.slice(i, 1), NOT_SPACE), text.encode()
                    keep = np.ones(len(raw), bool)
                    for c in sorted(cut, key=lambda c: not c["removed"]):  # what is kept comes last
                        a, b = c["start"], min(c["start"] + c["n_words"], len(w.start))
                        if a < b:
                            keep[w.start[a] : w.end[b - 1]] = not c["removed"]
                    text = np.frombuffer(raw, np.uint8)[keep].tobytes().decode()
                out.append(text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["row", "kept"])

    schema = joined.select("row").schema.add("kept", "string")
    return joined.mapInArrow(run, schema).select(F.col("row").withField("text", F.col("kept")).alias("row")).select("row.*")


def op7_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
