"""Masked pseudo-likelihood against a plain computation of single documents."""

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quillmap.llm import masked_lm
from quillmap.llm.queries import QUERIES
from quillmap.llm.words import ALNUM, Words

from .helpers import alnum_words, no_documents, odd_documents


def class_of(word):
    return int(masked_lm.shared_classes(Words(pa.array([word]), ALNUM))[0])


def brute(texts, model):
    """log-likelihood of each text, word by word."""
    counts = Counter(w for t in texts for w in alnum_words(t))
    hashes = {w: int(Words(pa.array([w]), ALNUM).hashes()[0]) for w in counts}
    own = {int(h): i + 1 for i, h in enumerate(model.own)}
    kind = {w: own.get(hashes[w], class_of(w)) for w in counts}
    size, kinds = Counter(), Counter()
    for w, n in counts.items():
        if hashes[w] not in own:
            size[kind[w]] += n
            kinds[kind[w]] += 1
    p, out = {k: v.astype(float) for k, v in model.net.p.items()}, []
    for t in texts:
        w, total = alnum_words(t), 0.0
        y = [kind[x] for x in w]
        for i, x in enumerate(w):
            around = [y[i + o] if 0 <= i + o < len(w) else 0 for o in (-2, -1, 1, 2)]
            h = np.tanh(sum(p["around"][k][c] for k, c in enumerate(around)) + p["hidden"])
            z = h @ p["out"] + p["bias"]
            total += z[y[i]] - z.max() - math.log(np.exp(z - z.max()).sum())
            if hashes[x] not in own:
                c = y[i]
                total += math.log((counts[x] + 0.5) / (size[c] + 0.5 * (kinds[c] + 1)))
        out.append((len(w), total))
    return out


@pytest.mark.parametrize("share", [masked_lm.HEAD_SHARE, 0.002])
def test_each_document(spark, monkeypatch, share):
    """Also where few words travel with the network and most are joined."""
    monkeypatch.setattr(masked_lm, "HEAD_SHARE", share)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs = docs.where("doc_id < 50") if share == 0.002 else docs
    model, shares = masked_lm.train(docs)
    assert (shares.count() > 0) == (share > 0.001)
    rows = {r.doc_id: r.text for r in docs.collect()}
    want = dict(zip(rows, brute(list(rows.values()), model)))
    got = masked_lm.score(docs, model, shares).collect()
    assert len(got) == len(rows)
    for r in got:
        n, total = want[r.doc_id]
        assert r.n_tokens == n and math.isclose(r.log_likelihood, total, rel_tol=1e-4, abs_tol=1e-3)
        assert not n or math.isclose(r.pseudo_perplexity, math.exp(-total / n), rel_tol=1e-3)


def test_gradient():
    rng, net = np.random.default_rng(2), masked_lm.WindowNetwork()
    x, y = rng.integers(0, masked_lm.CLASSES, (40, 4)), rng.integers(0, masked_lm.CLASSES, 40)
    net.p = {k: rng.normal(0, 0.3, v.shape) for k, v in net.p.items()}
    before = {k: v.copy() for k, v in net.p.items()}
    net.step(x, y, 0.0)
    loss = lambda: -net.log_probability(x, y).mean()
    for k, where in (("out", (3, y[0])), ("bias", (y[1],)), ("hidden", (4,)), ("around", (2, x[5, 2], 7))):
        grad = net.moments[k][0][where] / 0.1
        sides = []
        for by in (1e-5, -1e-5):
            net.p[k] = before[k].copy()
            net.p[k][where] += by
            sides.append(loss())
        net.p[k] = before[k]
        assert math.isclose((sides[0] - sides[1]) / 2e-5, grad, rel_tol=1e-3, abs_tol=1e-7), k


def test_learns_from_both_sides(spark):
    """A word that its neighbours determine scores better in order than shuffled, and text that the corpus has twice better than once."""
    rng = np.random.default_rng(4)
    rows, order = [], [f"w{i}" for i in range(12)]
    for i in range(300):
        at = rng.integers(0, 12)
        rows.append((i, " ".join(order[(at + j) % 12] for j in range(60))))
    rows += [(1000, " ".join(rng.permutation(rows[0][1].split())))]
    rows += [(3000 + i, " ".join([f"filler{i}"] * 9)) for i in range(200)]
    odd = [" ".join(f"odd{x}" for x in rng.integers(0, 10**8, 50)) for _ in range(3)]
    rows += [(2001, odd[0]), (2002, odd[1]), (2003, odd[1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.log_likelihood for r in masked_lm.score(docs, *masked_lm.train(docs)).collect()}
    assert min(got[i] for i in range(300)) > got[1000] + 20
    assert abs(got[2002] - got[2003]) < 1e-6 and got[2002] > got[2001] + 50 * math.log(1.4)


def test_odd_documents(spark):
    docs = odd_documents(spark)
    rows = masked_lm.score(docs, *masked_lm.train(docs)).collect()
    assert len(rows) == docs.count()
    for r in rows:
        if r.doc_id in (5, 6, 7):
            assert (r.n_tokens, r.log_likelihood, r.mean_log_likelihood, r.pseudo_perplexity) == (0, 0.0, None, None)
        elif r.n_tokens:
            assert r.log_likelihood < 0 < r.pseudo_perplexity
    assert masked_lm.score(no_documents(spark), *masked_lm.train(no_documents(spark))).count() == 0


def test_unseen_words(spark):
    docs = spark.createDataFrame([(1, "one two three one two three")], "doc_id long, text string")
    model = masked_lm.train(docs)
    new = spark.createDataFrame([(1, "one two unseen"), (2, "one two three")], "doc_id long, text string")
    got = {r.doc_id: r.log_likelihood for r in masked_lm.score(new, *model).collect()}
    assert math.isfinite(got[1]) and got[1] < got[2]


def test_query(spark):
    assert QUERIES["op2_lm_scoring"](spark, "/root/testdata/sf0.01").count() == 1000


class Counting:
    """numpy, counting the values whose exponential is taken."""

    def __init__(self):
        self.exps = 0

    def __getattr__(self, name):
        return getattr(np, name)

    def exp(self, x, **more):
        self.exps += x.size
        return np.exp(x, **more)


@pytest.mark.parametrize("scale", [0.3, 40.0])
def test_a_step_takes_each_exponential_once(monkeypatch, scale):
    """Also in blocks, and with logits whose exponentials single precision cannot hold, results are those of a plain computation."""
    rng, net = np.random.default_rng(3), masked_lm.WindowNetwork()
    n = 2 * masked_lm.BATCH // 3
    x, y = rng.integers(0, masked_lm.CLASSES, (n, 4)), rng.integers(0, masked_lm.CLASSES, n)
    net.p = {k: rng.normal(0, scale if k == "out" else 0.3, v.shape).astype(np.float32) for k, v in net.p.items()}
    p = {k: v.astype(float) for k, v in net.p.items()}
    h = np.tanh(sum(p["around"][k][x[:, k]] for k in range(4)) + p["hidden"])
    z = h @ p["out"] + p["bias"]
    z -= z.max(1, keepdims=True)
    z -= np.log(np.exp(z).sum(1, keepdims=True))
    assert np.allclose(net.log_probability(x, y), z[np.arange(n), y], rtol=1e-4, atol=1e-3)
    d = np.exp(z)
    d[np.arange(n), y] -= 1
    d /= n
    back = (d @ p["out"].T) * (1 - h * h)
    around = np.zeros_like(p["around"])
    for k in range(4):
        np.add.at(around[k], x[:, k], back)
    counting = Counting()
    monkeypatch.setattr(masked_lm, "np", counting)
    loss = net.step(x, y, 0.0)
    assert counting.exps == n * masked_lm.CLASSES
    assert math.isclose(loss, -z[np.arange(n), y].mean(), rel_tol=1e-4)
    for k, want in (("out", h.T @ d), ("bias", d.sum(0)), ("hidden", back.sum(0)), ("around", around)):
        assert np.allclose(net.moments[k][0] / 0.1, want, rtol=1e-3, atol=1e-5 * max(1.0, scale)), k
