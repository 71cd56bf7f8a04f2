"""Language identification by a byte-level convolutional network, trained in numpy.

Bytes fall into 64 classes; filters of widths 2, 3 and 4 run over their embeddings in windows of
fixed length, are max-pooled over the window and feed a softmax. For prediction every filter bank is
folded into tables over byte-class pairs, so that a batch of windows costs a few table look-ups a
byte. A text's windows cover all of it and their probabilities are averaged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import Shipped, broadcast_if, small_batches, stash
from .words import slices, text_bytes

WINDOW, WIDTHS, FILTERS, EMBED, CLASSES = 256, (2, 3, 4), 16, 12, 64
#: Labelled documents that training reads, in equal parts by label, and of each label at least if it has them; windows of each document at most.
TRAIN_DOCS, TRAIN_EACH, TRAIN_WINDOWS = 4000, 50, 6
#: Labels whose bounds are broadcast; more are joined by shuffling.
BROADCAST_LABELS = 10_000


def _byte_classes() -> np.ndarray:
    """Letters alike in either case, one class each for space, digits and other ASCII, the rest by remainder."""
    table = np.full(256, 28, np.uint8)
    table[[32, 9, 10, 11, 12, 13]] = 26
    table[48:58] = 27
    table[65:91] = table[97:123] = np.arange(26)
    table[128:] = 29 + np.arange(128) % 35
    return table


BYTE_CLASS = _byte_classes()
PAD = 26


def windows_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Byte classes of all windows, (n, WINDOW), and the windows of each row; padded at each row's end."""
    data, offsets = text_bytes(texts)
    per = -(-np.diff(offsets) // WINDOW)
    first = np.cumsum(per) - per
    row = np.repeat(np.arange(len(per)), per)
    begin = offsets[:-1][row] + (np.arange(len(row)) - first[row]) * WINDOW
    out = np.full((len(row), WINDOW), PAD, np.uint8)
    size = np.minimum(WINDOW, offsets[1:][row] - begin)
    whole = size == WINDOW
    classes = BYTE_CLASS[data]
    if whole.any():
        out[whole] = np.lib.stride_tricks.sliding_window_view(classes, WINDOW)[begin[whole]]
    for i in np.flatnonzero(~whole):
        out[i, : size[i]] = classes[begin[i] : begin[i] + size[i]]
    return out, per


class ByteConvNet:
    """Parameters, training and prediction."""

    def __init__(self, labels: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.labels = labels
        self.p = {"embed": rng.normal(0, 0.5, (CLASSES, EMBED)), "out": rng.normal(0, 0.3, (len(WIDTHS) * FILTERS, len(labels))), "bias": np.zeros(len(labels))}
        for w in WIDTHS:
            self.p[f"conv{w}"] = rng.normal(0, (w * EMBED) ** -0.5, (w, EMBED, FILTERS))
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.fold()

    def fold(self) -> None:
        """One table over class pairs, or two, for each filter width."""
        taps = {w: [self.p["embed"] @ self.p[f"conv{w}"][j] for j in range(w)] for w in WIDTHS}
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(CLASSES * CLASSES, FILTERS)
        self.tables = {w: [pair(*t[i : i + 2]) if i + 1 < w else t[i] for i in range(0, w, 2)] for w, t in taps.items()}

    def pooled(self, x: np.ndarray, where: bool = False):
        """Largest filter responses of each window (n, filters), and the places of those if asked for."""
        pairs = x[:, :-1].astype(np.uint16) * CLASSES + x[:, 1:]
        best, places = [], []
        for w in WIDTHS:
            z = 0
            for i, table in enumerate(self.tables[w]):
                source = pairs if 2 * i + 1 < w else x
                z = z + np.take(table, source[:, 2 * i : 2 * i + WINDOW - w + 1], axis=0)
            if where:
                at = z.argmax(axis=1)
                places.append(at)
                best.append(np.take_along_axis(z, at[:, None, :], axis=1)[:, 0])
            else:
                best.append(z.max(axis=1))
        return (np.concatenate(best, 1), places) if where else np.concatenate(best, 1)

    def softmax(self, pooled: np.ndarray) -> np.ndarray:
        z = np.maximum(pooled, 0) @ self.p["out"] + self.p["bias"]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def probabilities(self, x: np.ndarray, step: int = 256) -> np.ndarray:
        return np.concatenate([self.softmax(self.pooled(x[i : i + step])) for i in range(0, len(x), step)] or [np.empty((0, len(self.labels)), np.float32)])

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 500, batch: int = 128, rate: float = 0.01, seed: int = 11) -> None:
        """Adam on the cross-entropy of windows drawn by weight; a max-pooled filter learns from the place it took."""
        rng, m, v, share = np.random.default_rng(seed), {}, {}, np.cumsum(weight.astype(np.float64))
        for t in range(1, steps + 1):
            take = np.searchsorted(share, rng.random(batch) * share[-1], side="right")
            xb, yb, wb = x[take], y[take], np.ones(batch, np.float32)
            pooled, places = self.pooled(xb, True)
            active = np.maximum(pooled, 0)
            d = self.softmax(pooled)
            d[np.arange(batch), yb] -= 1
            d *= wb[:, None] / wb.sum()
            grads = {"out": active.T @ d, "bias": d.sum(0), "embed": np.zeros_like(self.p["embed"])}
            back = (d @ self.p["out"].T) * (pooled > 0)
            for j, w in enumerate(WIDTHS):
                g, conv = back[:, j * FILTERS : (j + 1) * FILTERS], self.p[f"conv{w}"]
                grads[f"conv{w}"] = np.zeros_like(conv)
                for tap in range(w):
                    seen = np.take_along_axis(xb, places[j] + tap, axis=1)
                    hot = np.zeros((CLASSES, FILTERS), np.float32)
                    np.add.at(hot, (seen.ravel(), np.tile(np.arange(FILTERS), batch)), g.ravel())
                    grads[f"conv{w}"][tap] = self.p["embed"].T @ hot
                    grads["embed"] += hot @ conv[tap].T
            for k, g in grads.items():
                m[k] = 0.9 * m.get(k, 0) + 0.1 * g
                v[k] = 0.99 * v.get(k, 0) + 0.01 * g * g
                self.p[k] -= (rate * (0.5 if t > steps * 0.7 else 1) * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
            self.fold()


def train(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", train_docs: int = TRAIN_DOCS) -> ByteConvNet | None:
    """A network from labelled ``docs``. None without labels.

    It reads train_docs of them at most, in equal parts by label and TRAIN_EACH of a label that has them: those of
    least hash; and of each at most TRAIN_WINDOWS windows, spread over the text. Labels weigh alike, so a rare one is learnt too.
    """
    small_batches(docs.sparkSession)
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.xxhash64(key).alias("h"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    labels = rows.select("lang").distinct().count()
    if not labels:
        return None
    each = max(TRAIN_EACH, train_docs // labels)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    bounds = rows.select("lang", "h").withColumn("rank", rank).where(F.col("rank") <= each).groupBy(F.col("lang").alias("label")).agg(F.max("h").alias("last"))
    bounds = broadcast_if(stash(bounds, "bounds"), BROADCAST_LABELS)

    def sample(batches):
        for batch in batches:
            for lo, hi in slices(batch.column(2)):
                x, per = windows_of(batch.column(2).slice(lo, hi - lo))
                first = np.cumsum(per) - per
                take = [np.unique(np.linspace(0, n - 1, min(n, TRAIN_WINDOWS)).astype(int)) + f for f, n in zip(first, per) if n]
                row = np.repeat(np.flatnonzero(per), [len(t) for t in take]) + lo
                take = np.concatenate(take) if take else np.empty(0, int)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array([w.tobytes() for w in x[take]], pa.binary())], ["h", "lang", "window"])

    some = rows.join(bounds, (rows.lang == bounds.label) & (rows.h <= bounds["last"])).select("h", "lang", "text")
    seen = some.mapInArrow(sample, "h long, lang string, window binary")
    seen = seen.orderBy("h", "window").limit(each * labels * TRAIN_WINDOWS).toPandas()
    if not len(seen):
        return None
    labels = sorted(set(seen["lang"]))
    y = np.searchsorted(labels, seen["lang"])
    x = np.frombuffer(b"".join(seen["window"]), np.uint8).reshape(-1, WINDOW)
    weight = (len(y) / (len(labels) * np.bincount(y, minlength=len(labels))))[y].astype(np.float32)
    net = ByteConvNet(labels)
    if len(labels) > 1:
        net.fit(x, y, weight)
    return net


def _has_letter(texts: pa.Array) -> np.ndarray:
    """Whether each row holds a letter of any script."""
    data, offsets = text_bytes(texts)
    known = np.concatenate([[0], np.cumsum(BYTE_CLASS[data] < 26)])
    out = known[offsets[1:]] > known[offsets[:-1]]
    for i in np.flatnonzero(~out & (np.diff(offsets) > 0)):
        out[i] = any(c.isalpha() for c in data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace"))
    return out


def identify(docs: DataFrame, net: ByteConvNet | None, text: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, the mean probability of that language over the text's windows.

    ``und`` with score 0 where the text is null, empty or holds no letter, and for every row if there
    is no network. All windows of a text count alike, so no part of a long text is left out. Columns
    of ``docs`` by these two names are replaced; ties go to the first label in order, repeated rows are
    judged alike, and no rows give no rows.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop("lang_pred", "score")
    shared = Shipped(docs.sparkSession, net)
    kept = [c for c in docs.columns if keep_text or c != text]

    def run(batches):
        model = shared.value
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text))
            langs, scores = [], []
            for lo, hi in slices(texts, 1 << 20):
                part = texts.slice(lo, hi - lo)
                letters = _has_letter(part) & (model is not None)
                if not letters.any():
                    langs += ["und"] * (hi - lo)
                    scores += [0.0] * (hi - lo)
                    continue
                x, per = windows_of(part)
                sums = np.zeros((len(per), len(model.labels)))
                np.add.at(sums, np.repeat(np.arange(len(per)), per), model.probabilities(x))
                mean = sums / np.maximum(per, 1)[:, None]
                best = mean.argmax(axis=1)
                langs += [model.labels[b] if ok else "und" for b, ok in zip(best, letters)]
                scores += np.where(letters, np.clip(mean[np.arange(len(per)), best], 0, 1), 0).tolist()
            columns = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*kept, "lang_pred", "score"])

    fields = docs.select(kept).schema.add("lang_pred", "string").add("score", "double")
    return docs.mapInArrow(run, fields)


def _held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", _held_out().alias("held_out"))
    net = train(docs.where(F.col("doc_id").isNotNull() & ~F.col("held_out")))
    return identify(docs.select("doc_id", "held_out", "text"), net, keep_text=False)
