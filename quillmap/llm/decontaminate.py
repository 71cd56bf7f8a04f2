"""Benchmark decontamination with suffix arrays over the training text.

Each task builds suffix arrays over the words of its documents, one for each slice of whole
documents, and binary-searches every benchmark suffix in it. A suffix array lists only positions
whose leading words occur somewhere in the benchmark, since no other position can start a match;
so it stays small however common the training words are. Documents never cross a slice, slices
never cross a task, and nothing is shuffled.
"""

from __future__ import annotations

from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Shipped, small_batches, stash
from .words import ALNUM, Words, gram, slices

#: Benchmark words that one pass holds; a larger benchmark takes more passes over the documents.
BLOCK_WORDS = 2_000_000
_LEAD = 3
SPANS = "array<struct<item_id:bigint,start:bigint,item_start:bigint,n_words:bigint>>"


class Windows:
    """Benchmark windows as rows of word hashes, with the keys that can start one.

    Occurrence i is window ``rows[of[i]]`` at word ``place[i]`` of ``item[i]``; occurrences are sorted by window and begin at ``first``.
    """

    def __init__(self, items: list[tuple[int | None, str | None]], window: int):
        w = Words(pa.array([t for _, t in items], pa.string()), ALNUM)
        hashes, counts = w.hashes(), w.counts()
        size = np.minimum(window, counts)
        many = np.where(counts > 0, counts - size + 1, 0)
        row = np.repeat(np.arange(len(items)), many)
        place = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
        at = (w.first[:-1][row] + place)[:, None] + np.arange(window)
        table = np.where(np.arange(window) < size[row][:, None], hashes[np.minimum(at, len(hashes) - 1)] if len(hashes) else np.uint64(0), np.uint64(0))
        self.window = window
        self.rows, which = np.unique(np.column_stack([table, size[row].astype(np.uint64)]), axis=0, return_inverse=True)
        order = np.argsort(which := which.ravel(), kind="stable")
        ids = [i for i, _ in items]
        self.item, self.place = [ids[r] for r in row[order]], place[order]
        self.first = np.searchsorted(which[order], np.arange(len(self.rows) + 1))
        self.sizes, self.rows = self.rows[:, -1].astype(np.int64), self.rows[:, :-1]
        self.leads = {m: np.unique(gram(self.rows[take, :m].ravel(), m)[::m]) for m in range(1, _LEAD + 1) if len(take := np.flatnonzero(np.minimum(self.sizes, _LEAD) == m))}


def _before(rows: np.ndarray, keys: np.ndarray, sizes: np.ndarray, equal: bool) -> np.ndarray:
    """rows < keys on each key's first ``sizes`` words; where those are all the same, ``equal``."""
    differ = (rows != keys) & (np.arange(keys.shape[1]) < sizes[:, None])
    at = differ.argmax(axis=1)
    each = np.arange(len(keys))
    return np.where(differ[each, at], rows[each, at] < keys[each, at], equal)


def _bound(table: np.ndarray, keys: np.ndarray, sizes: np.ndarray, upper: bool) -> np.ndarray:
    """Binary search of every key at once in the lexicographically sorted ``table``."""
    lo, hi = np.zeros(len(keys), np.int64), np.full(len(keys), len(table), np.int64)
    while (open_ := lo < hi).any():
        mid = np.where(open_, (lo + hi) // 2, 0)
        right = open_ & _before(table[mid], keys, sizes, upper)
        lo, hi = np.where(right, mid + 1, lo), np.where(open_ & ~right, mid, hi)
    return lo


def find_windows(texts: pa.Array, tests: Windows):
    """Word counts of the rows, and (row, word, window) arrays of every occurrence of a window."""
    w = Words(texts, ALNUM)
    hashes, counts = w.hashes(), w.counts()
    row_of = w.rows()
    starts = np.zeros(len(hashes), bool)
    for m, keys in tests.leads.items():
        g = gram(hashes, m)
        slot = np.searchsorted(keys, g)
        starts[: len(g)] |= keys[np.minimum(slot, len(keys) - 1)] == g
    at = np.flatnonzero(starts)
    if not len(at) or not len(tests.rows):
        none = np.empty(0, np.int64)
        return counts, none, none, none
    last = w.first[1:][row_of[at]]
    steps = at[:, None] + np.arange(tests.window)
    suffixes = np.where(steps < last[:, None], hashes[np.minimum(steps, len(hashes) - 1)], np.uint64(0))
    order = np.lexsort(suffixes.T[::-1])
    table, places = suffixes[order], at[order]
    lo, hi = (_bound(table, tests.rows, tests.sizes, side) for side in (False, True))
    n = hi - lo
    found = np.repeat(np.arange(len(n)), n)
    pos = places[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
    inside = pos + tests.sizes[found] <= w.first[1:][row_of[pos]]
    found, pos = found[inside], pos[inside]
    return counts, row_of[pos], pos - w.first[:-1][row_of[pos]], found


def _spans(words: np.ndarray, found: np.ndarray, tests: Windows) -> list[dict]:
    """Longest verbatim matches of one document: windows of an item that overlap or adjoin there as they do here, joined."""
    runs: dict = {}
    for p, k in sorted(zip(words.tolist(), found.tolist())):
        end = p + int(tests.sizes[k])
        for i in range(tests.first[k], tests.first[k + 1]):
            own = runs.setdefault((tests.item[i], p - int(tests.place[i])), [])
            if own and p <= own[-1][1]:
                own[-1][1] = max(own[-1][1], end)
            else:
                own.append([p, end])
    return [{"item_id": item, "start": a, "item_start": a - shift, "n_words": b - a} for (item, shift), own in runs.items() for a, b in own]


def _blocks(benchmark: DataFrame):
    """Benchmark rows, a bounded number of words at a time."""
    block, words = [], 0
    for r in benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").toLocalIterator():
        block.append((r.item_id, r.text))
        words += len(r.text or "") // 2
        if words >= BLOCK_WORDS:
            yield block
            block, words = [], 0
    yield block


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, keep_text: bool = True) -> DataFrame:
    """``docs`` with ``n_words`` and ``spans``, the benchmark's verbatim matches in each row.

    A window is ``window`` consecutive words of an item; an item of fewer, but not none, is one
    window. A span (item_id, start, item_start, n_words) is the same n_words words from word start of the text and from
    word item_start of the item; it cannot be longer on either side. Texts are searched whole, however long. Null and
    empty texts have no words and no spans, items without words match nothing, an item with a null
    id is matched under that null, repeated items and repeated rows are reported alike, and columns
    of ``docs`` by these two names are replaced. An empty benchmark gives empty spans.
    """
    spark = docs.sparkSession
    small_batches(spark)
    # a null span with the word count keeps one schema over any number of passes
    out = docs.drop("n_words", "spans").withColumns({"n_words": F.lit(0).cast("long"), "spans": F.array().cast(SPANS)})
    blocks = _blocks(benchmark)
    block = next(blocks)
    for i in count():
        following = next(blocks, None)
        kept = [c for c in out.columns if keep_text or following is not None or c != "text"]
        tests = Shipped(spark, Windows(block, window))

        def run(batches, tests=tests, kept=kept):
            t = tests.value
            for batch in batches:
                texts = batch.column(batch.schema.get_field_index("text"))
                n_words, spans = np.zeros(len(texts), np.int64), batch.column(batch.schema.get_field_index("spans")).to_pylist()
                for lo, hi in slices(texts):
                    counts, rows, words, found = find_windows(texts.slice(lo, hi - lo), t)
                    n_words[lo:hi] = counts
                    order = np.argsort(rows, kind="stable")
                    rows, words, found = rows[order], words[order], found[order]
                    for r in np.unique(rows):
                        a, b = np.searchsorted(rows, [r, r + 1])
                        spans[lo + r] = spans[lo + r] + _spans(words[a:b], found[a:b], t)
                kind = pa.list_(pa.struct([(k, pa.int64()) for k in ("item_id", "start", "item_start", "n_words")]))
                replaced = {"n_words": pa.array(n_words), "spans": pa.array(spans, kind)}
                yield pa.RecordBatch.from_arrays([replaced[c] if c in replaced else batch.column(batch.schema.get_field_index(c)) for c in kept], kept)

        out = out.mapInArrow(run, out.select(kept).schema)
        if following is None:
            return out
        if i % 4 == 3:
            out = stash(out, "contaminated")
        block = following


def hit_words(spans: str) -> F.Column:
    """Words under any of the spans, each counted once."""
    start = "named_struct('end', 0L, 'hit', 0L)"
    step = "(s, x) -> named_struct('end', greatest(s.end, x.start + x.n_words), 'hit', s.hit + greatest(0L, x.start + x.n_words - greatest(s.end, x.start)))"
    ordered = f"array_sort(transform({spans}, x -> named_struct('start', x.start, 'n_words', x.n_words)))"
    return F.expr(f"aggregate({ordered}, {start}, {step}, s -> s.hit)")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark window, with their own columns; see find_contamination."""
    rows = docs.select(F.struct("*").alias("row"), "text")
    return find_contamination(rows, benchmark, window).where("size(spans) = 0").select("row.*")


def op9_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    found = find_contamination(docs.select("doc_id", "text"), items, keep_text=False)
    ids = "array_distinct(filter(transform(spans, x -> x.item_id), x -> x IS NOT NULL))"
    found = found.select("doc_id", "n_words", hit_words("spans").alias("n_hit"), F.expr(ids).alias("ids"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("ids").cast("long").alias("n_items"),
        F.expr("sha2(array_join(array_sort(transform(ids, x -> cast(x AS string))), ','), 256)").alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
