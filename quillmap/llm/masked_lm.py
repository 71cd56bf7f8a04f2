"""Masked pseudo-likelihood of documents under a bidirectional window network over the whole vocabulary.

Every word has a class: the most frequent words one of their own, the others one by their last letters and
length. A network predicts a word's class from the classes of two words on either side; the word itself
follows from its share of its class. So the softmax is factored, and its vocabulary is all words of
the corpus, in a table that grows with it.

Words are counted over all documents. The network is trained in numpy on all windows: from one starting point,
every task goes once through the windows of its own documents, and the tasks' parameters are averaged
by windows. Frequent words' shares travel with the network, and the others are joined.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Shipped, drop, small_batches, stash
from .words import ALNUM, Words, mix, slices

#: Classes in all, and those for several words; 0 is the edge of a document.
CLASSES, SHARED = 128, 64
#: Words on either side, and hidden units.
SIDE, HIDDEN = 2, 32
OFFSETS = tuple(o for o in range(-SIDE, SIDE + 1) if o)
#: Windows of a step, and of its matrices; windows that the starting point is trained on, and its steps.
BATCH, BLOCK, START_WINDOWS, START_STEPS = 4096, 1024, 60_000, 150
#: Logits up to which no exponential, nor a sum of them, leaves single precision.
SAFE = 60.0
#: Rates of the start and of the pass over all windows.
RATES = 0.02, 0.004
#: Words with this share of all words, so 100,000 at most, are sent to all tasks; others are joined.
HEAD_SHARE = 1e-5
#: Occurrences that a word has besides those seen, so that unseen words have a probability.
EXTRA = 0.5
#: Distinct words that a task counts before it passes its counts on.
FLUSH = 1_000_000
#: Tasks that add up parameters.
AVERAGERS = 16


def shared_classes(w: Words) -> np.ndarray:
    """Class of each word by its last three bytes and its length."""
    code = np.minimum(w.end - w.start, 24).astype(np.uint64) // np.uint64(3)
    for back in (1, 2, 3):
        at = w.end - back
        code = code * np.uint64(257) + np.where(at >= w.start, w.data[np.maximum(at, 0)], 0).astype(np.uint64) if len(at) else code
    return (CLASSES - SHARED + (mix(code) % np.uint64(SHARED)).astype(np.int64)).astype(np.int64)


def _slots(keys: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``h`` in the sorted ``keys``, and which are there."""
    if not len(keys):
        return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
    slot = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return slot, keys[slot] == h


def contexts(w: Words, classes: np.ndarray) -> np.ndarray:
    """Classes of the words around each word, (n, 2 * SIDE), 0 beyond its row."""
    n, first, row = len(classes), w.first, w.rows()
    out = np.zeros((n, len(OFFSETS)), np.int64)
    at = np.arange(n)
    for k, o in enumerate(OFFSETS):
        there = at + o
        ok = (there >= first[:-1][row]) & (there < first[1:][row])
        out[ok, k] = classes[there[ok]]
    return out


class WindowNetwork:
    """softmax(tanh(sum of a row of each offset's table + b) W + c) over classes."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        shape = {"around": (len(OFFSETS), CLASSES, HIDDEN), "hidden": (HIDDEN,), "out": (HIDDEN, CLASSES), "bias": (CLASSES,)}
        self.p = {k: (rng.normal(0, 0.1, s) if len(s) > 1 else np.zeros(s)).astype(np.float32) for k, s in shape.items()}
        self.moments: dict = {}
        self.steps = 0

    def hidden(self, x: np.ndarray) -> np.ndarray:
        h = self.p["around"][0].take(x[:, 0], axis=0)
        for k in range(1, len(OFFSETS)):
            h += self.p["around"][k].take(x[:, k], axis=0)
        h += self.p["hidden"]
        return np.tanh(h, out=h)

    def weights(self, h: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each window the log-probability of its class y, all classes' weights, which are as their probabilities, and their sum."""
        z = h @ self.p["out"]
        z += self.p["bias"]
        if (np.abs(self.p["out"]).sum(axis=0) + np.abs(self.p["bias"])).max() > SAFE:  # hidden units are within 1
            z -= z.max(axis=1, keepdims=True)
        own = z[np.arange(len(y)), y]
        np.exp(z, out=z)
        total = z @ np.ones(z.shape[1], z.dtype)
        return own - np.log(total), z, total

    def log_probability(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Of each class y in its context x."""
        out = np.empty(len(y))
        for i in range(0, len(y), BLOCK):
            out[i : i + BLOCK] = self.weights(self.hidden(x[i : i + BLOCK]), y[i : i + BLOCK])[0]
        return out

    def step(self, x: np.ndarray, y: np.ndarray, rate: float) -> float:
        """One step of Adam on the mean log-loss of the windows, which is returned."""
        g, loss, n = {k: np.zeros_like(v) for k, v in self.p.items()}, 0.0, len(y)
        for i in range(0, n, BLOCK):  # small enough for the processor's cache
            u, v = x[i : i + BLOCK], y[i : i + BLOCK]
            h, each = self.hidden(u), np.arange(len(v))
            logs, d, total = self.weights(h, v)
            loss -= float(logs.sum()) / n
            d *= (1 / (total * n))[:, None]
            d[each, v] -= d.dtype.type(1 / n)
            back = (d @ self.p["out"].T) * (1 - h * h)
            ones = np.ones(len(v), d.dtype)
            g["out"] += h.T @ d
            g["bias"] += ones @ d
            g["hidden"] += ones @ back
            for k in range(len(OFFSETS)):
                near = u[:, k].astype(np.uint8)  # bytes sort in linear time
                order = np.argsort(near, kind="stable")
                near = near[order]
                first = np.flatnonzero(np.concatenate([[True], near[1:] != near[:-1]]))
                g["around"][k, near[first]] += np.add.reduceat(back[order], first, axis=0)
        self.steps += 1
        for k, v in g.items():
            m, s = self.moments.setdefault(k, [np.zeros_like(v), np.zeros_like(v)])
            m += 0.1 * (v - m)
            s += 0.01 * (v * v - s)
            self.p[k] -= (rate * (m / (1 - 0.9**self.steps)) / (np.sqrt(s / (1 - 0.99**self.steps)) + 1e-8)).astype(np.float32)
        return loss


class Model:
    """Network, words with a class of their own, and shares of words within their classes."""

    def __init__(self, own: np.ndarray, sizes: np.ndarray, kinds: np.ndarray):
        """own: sorted hashes; sizes and kinds: occurrences and words of each class."""
        self.own, self.net = own, WindowNetwork()
        self.base = np.log(np.maximum(sizes + EXTRA * (kinds + 1), 1.0))
        self.head, self.head_share = np.empty(0, np.uint64), np.empty(0)
        total = max(sizes.sum(), 1.0)
        self.net.p["bias"] = np.log(sizes / total + 1e-6).astype(np.float32)

    def read(self, texts: pa.Array):
        """Words, their hashes and classes."""
        w = Words(texts, ALNUM)
        h = w.hashes()
        slot, own = _slots(self.own, h)
        return w, h, np.where(own, slot + 1, shared_classes(w)), own


def word_counts(docs: DataFrame) -> DataFrame:
    """``word, class, n`` of every word over all documents: hash, shared class and occurrences."""

    def count(batches):
        held = [np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)]
        fresh: list[list[np.ndarray]] = []

        def merged():
            parts = [held, *fresh]
            keys, where, back = np.unique(np.concatenate([p[0] for p in parts]), return_index=True, return_inverse=True)
            n = np.bincount(back.ravel(), weights=np.concatenate([p[2] for p in parts]), minlength=len(keys)).astype(np.int64)
            return [keys, np.concatenate([p[1] for p in parts])[where], n]

        def out():
            for i in range(0, len(held[0]), 100_000):
                part = slice(i, i + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(held[0][part].view(np.int64)), pa.array(held[1][part].astype(np.int16)), pa.array(held[2][part])], ["word", "class", "n"])

        for batch in batches:
            for lo, hi in slices(batch.column(0)):
                w = Words(batch.column(0).slice(lo, hi - lo), ALNUM)
                h, first, n = np.unique(w.hashes(), return_index=True, return_counts=True)
                fresh.append([h, shared_classes(w)[first], n])
            if sum(len(f[0]) for f in fresh) >= FLUSH:
                held, fresh = merged(), []
                if len(held[0]) >= FLUSH:
                    yield from out()
                    held = [x[:0] for x in held]
        held = merged()
        yield from out()

    return docs.select("text").mapInArrow(count, "word long, class smallint, n long").groupBy("word").agg(F.first("class").alias("class"), F.sum("n").alias("n"))


def _start(model: Model, docs: DataFrame, batch: int) -> None:
    """The starting point, from some START_WINDOWS windows of documents of least hash."""
    shared = Shipped(docs.sparkSession, model)
    per = 256

    def sample(batches):
        m = shared.value
        for b in batches:
            for lo, hi in slices(b.column(0)):
                w, _, y, _ = m.read(b.column(0).slice(lo, hi - lo))
                seen = np.column_stack([contexts(w, y), y]).astype(np.uint8)
                # whole stretches of windows spread over the document
                for a, z in zip(w.first[:-1], w.first[1:]):
                    take = np.unique(np.linspace(a, z - 1, min(per, z - a)).astype(np.int64)) if z > a else []
                    if len(take):
                        yield pa.RecordBatch.from_arrays([pa.array([seen[take].tobytes()], pa.binary())], ["windows"])

    least = docs.select(F.xxhash64("text").alias("h"), "text").where("text IS NOT NULL")
    last = least.select("h").orderBy("h").limit(START_WINDOWS // per * 2).agg(F.max("h")).first()[0]
    rows = least.where(F.col("h") <= last).select("text").mapInArrow(sample, "windows binary").orderBy("windows").limit(START_WINDOWS // per * 2).collect() if last is not None else []
    x = np.frombuffer(b"".join(r.windows for r in rows), np.uint8).reshape(-1, len(OFFSETS) + 1).astype(np.int64)
    rng = np.random.default_rng(5)
    for t in range(START_STEPS if len(x) else 0):
        part = x[rng.integers(0, len(x), min(batch, len(x)))]
        model.net.step(part[:, :-1], part[:, -1], RATES[0] * (1 - t / START_STEPS) + RATES[1])


def _pass(model: Model, docs: DataFrame, batch: int) -> None:
    """One pass over all windows, in every task over its own; the parameters become the mean by windows."""
    shared = Shipped(docs.sparkSession, model)
    names = list(model.net.p)

    def learn(batches):
        m, pending, held, total = shared.value, [], 0, 0
        m.net.moments, m.net.steps, rng = {}, 0, np.random.default_rng(9)

        def steps():
            x = np.concatenate(pending)
            x = x[rng.permutation(len(x))].astype(np.int64)
            for i in range(0, len(x), batch):
                m.net.step(x[i : i + batch, :-1], x[i : i + batch, -1], RATES[1])

        for b in batches:
            for lo, hi in slices(b.column(0)):
                w, _, y, _ = m.read(b.column(0).slice(lo, hi - lo))
                pending.append(np.column_stack([contexts(w, y), y]).astype(np.uint8))
                held += len(y)
                total += len(y)
                if held >= 64 * BATCH:
                    steps()
                    pending, held = [], 0
        if held:
            steps()
        if total:
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.int64()), pa.array([b"".join(m.net.p[k].tobytes() for k in names)], pa.binary())], ["n", "parameters"])

    def add(batches):
        n, sums = 0, 0.0
        for b in batches:
            for count, parameters in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                n += count
                sums = sums + np.frombuffer(parameters, np.float32).astype(np.float64) * count
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([sums.tobytes()], pa.binary())], ["n", "parameters"])

    parts = docs.select("text").mapInArrow(learn, "n long, parameters binary")
    rows = parts.repartition(AVERAGERS).mapInArrow(add, "n long, parameters binary").collect()  # AVERAGERS rows at most
    if rows:
        flat = sum(np.frombuffer(r.parameters, np.float64) for r in rows) / sum(r.n for r in rows)
        at = 0
        for k in names:
            size = model.net.p[k].size
            model.net.p[k] = flat[at : at + size].reshape(model.net.p[k].shape).astype(np.float32)
            at += size


def train(docs: DataFrame, batch: int = BATCH) -> tuple[Model, DataFrame]:
    """The model of all of ``docs`` (text), and ``word, share`` of the words that it does not hold itself."""
    small_batches(docs.sparkSession)
    counts = stash(word_counts(docs), "words")
    own = np.sort(np.array([r.word for r in counts.orderBy(F.desc("n"), "word").limit(CLASSES - SHARED - 1).collect()], np.int64).view(np.uint64))
    rest = counts.where(~F.col("word").isin([int(x) for x in own.view(np.int64)])) if len(own) else counts
    sizes, kinds = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in rest.groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).collect():
        sizes[r["class"]], kinds[r["class"]] = r.n, r.kinds
    slots = {int(x): i + 1 for i, x in enumerate(own.view(np.int64))}
    for r in counts.where(F.col("word").isin(list(slots))).collect() if slots else []:
        sizes[slots[r.word]] = r.n
    model = Model(own, sizes, kinds)
    base = F.element_at(F.array(*(F.lit(float(x)) for x in model.base)), F.col("class") + 1)
    shares = rest.withColumn("share", F.log(F.col("n") + EXTRA) - base)
    least = max(HEAD_SHARE * sizes.sum(), 1.0)
    head = shares.where(F.col("n") >= least).select("word", "share").toArrow().sort_by("word")  # 1 / HEAD_SHARE words at most
    order = np.argsort(h := head.column("word").to_numpy().view(np.uint64))
    model.head, model.head_share = h[order], head.column("share").to_numpy()[order]
    _start(model, docs, batch)
    _pass(model, docs, batch)
    return model, shares.where(F.col("n") < least).select("word", "share")


def score(docs: DataFrame, model: Model, shares: DataFrame) -> DataFrame:
    """``doc_id, n_tokens, log_likelihood, mean_log_likelihood, pseudo_perplexity`` for each row of ``docs`` (doc_id, text).

    log_likelihood sums every word's log-probability given its neighbours: that of its class, and its
    share of the class. A null text and one without words have 0 tokens, log_likelihood 0 and null
    means. Texts are scored whole, however long. Repeated rows are scored alike, a null
    doc_id keeps its row, other columns are ignored, and no rows give no rows.
    """
    small_batches(docs.sparkSession)
    shared = Shipped(docs.sparkSession, model)

    def run(batches):
        m = shared.value
        for batch in batches:
            for lo, hi in slices(batch.column(1)):
                w, h, y, own = m.read(batch.column(1).slice(lo, hi - lo))
                logs = m.net.log_probability(contexts(w, y), y)
                slot, known = _slots(m.head, h)
                logs[known] += m.head_share[slot[known]]
                sums = np.concatenate([[0.0], np.cumsum(logs)])
                # the other words of each row, once each
                at = np.flatnonzero(~own & ~known)
                row = w.rows()[at]
                order = np.lexsort((h[at], row))
                at, row = at[order], row[order]
                new = np.flatnonzero(np.concatenate([[True], (h[at][1:] != h[at][:-1]) | (row[1:] != row[:-1])])) if len(at) else at
                offsets = np.searchsorted(row[new], np.arange(hi - lo + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(x)) for x in (h[at[new]].view(np.int64), np.diff(np.append(new, len(at))).astype(np.int32), y[at[new]].astype(np.int16))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(w.counts().astype(np.int64)), pa.array(sums[w.first[1:]] - sums[w.first[:-1]]), *lists], ["doc_id", "n_tokens", "logs", "words", "times", "classes"])

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, logs double, words array<long>, times array<int>, classes array<smallint>")
    found = stash(found.withColumn("row", F.monotonically_increasing_id()), "scored")
    words = found.select("row", F.explode(F.arrays_zip("words", "times", "classes")).alias("x")).select("row", F.col("x.words").alias("word"), F.col("x.times").alias("times"), F.col("x.classes").alias("class"))
    unseen = F.element_at(F.array(*(F.lit(float(np.log(EXTRA) - x)) for x in model.base)), F.col("class") + 1)
    rest = words.join(shares, "word", "left").groupBy("row").agg(F.sum(F.col("times") * F.coalesce("share", unseen)).alias("rest"))
    out = found.select("row", "doc_id", "n_tokens", "logs").join(rest, "row", "left").select("doc_id", "n_tokens", (F.col("logs") + F.coalesce("rest", F.lit(0.0))).alias("log_likelihood"))
    mean = F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens"))
    return out.select("*", mean.alias("mean_log_likelihood"), F.exp(-mean).alias("pseudo_perplexity"))


def op2_lm_scoring(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score(docs, *train(docs))
