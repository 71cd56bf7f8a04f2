"""n-gram join and embeddings against brute force."""

import numpy as np
import pyarrow as pa
import pytest

from quillmap.llm import hnsw, ngram_join
from quillmap.llm.queries import QUERIES
from quillmap.llm.words import shingle_sets

from .helpers import LONG, classes, no_documents, odd_documents, shingles, words


def brute_jaccard(rows, k=3, percent=90):
    sets = [(i, shingles(t, k)) for i, t in rows]
    links = []
    for x, (a, sa) in enumerate(sets):
        for b, sb in sets[x + 1 :]:
            if sa and sb and 100 * len(sa & sb) >= percent * len(sa | sb):
                links.append((a, b))
    label = classes({i for i, _ in sets}, links)
    return sorted((i, len(s), label[i]) for i, s in sets)


@pytest.mark.parametrize("percent", [90, 70])
def test_join_on_documents(spark, sf_dir, percent):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = sorted(map(tuple, ngram_join.jaccard_classes(docs, 3, percent).collect()))
    assert got == brute_jaccard([(r.doc_id, r.text) for r in docs.collect()], 3, percent)


def test_join_of_close_relatives(spark):
    """A chain of edits: neighbours link, the ends do not, and one hub cannot see all links."""
    rng = np.random.default_rng(2)
    base = [f"t{x}" for x in rng.integers(0, 10**6, 120)]
    rows = []
    for i in range(40):
        base = list(base)
        base[int(rng.integers(0, 120))] = f"e{i}"
        rows.append((100 - i, " ".join(base)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for percent in (90, 95):
        assert sorted(map(tuple, ngram_join.jaccard_classes(docs, 3, percent).collect())) == brute_jaccard(rows, 3, percent)


def test_join_of_odd_rows(spark):
    docs = odd_documents(spark)
    got = {(r.doc_id, r.n_shingles): r.component_id for r in ngram_join.jaccard_classes(docs).collect()}
    assert got[1, 18] == got[2, 18] == got[3, 18] == got[None, 18] == 1
    assert got[4, 18] == 4 and got[5, 0] == 5 and got[6, 0] == 6 and got[7, 0] == 7 and got[None, 0] is None
    assert got[8, 1] == got[9, 1] == 8 and got[11, len(shingles(LONG, 3))] == 11 == got[12, len(shingles(LONG + " tail", 3))]
    assert ngram_join.jaccard_classes(docs).count() == docs.count()
    assert ngram_join.jaccard_classes(no_documents(spark)).count() == 0


def test_keep_one(spark):
    docs = odd_documents(spark)
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    texts = [r.text for r in kept.collect()]
    assert len(texts) == 11  # of five copies one, of SOLO one, of the long ones one; the rows without words stay
    assert {r.doc_id for r in ngram_join.keep_one(docs.where("doc_id in (8, 9, 10)")).collect()} == {8, 10}
    assert ngram_join.keep_one(no_documents(spark)).count() == 0


def test_one_repeated_id_changes_no_other_class(spark):
    text = lambda i: " ".join(f"c{i}w{j}" for j in range(40))
    rows = [(10 * i + j, text(i) + (" tail" if j == 1 else "")) for i in range(6) for j in (2, 1, 5)]
    plain = {r.doc_id for r in ngram_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    odd = [*rows, (1, text(0) + " tail"), (None, text(1)), (None, text(7)), (None, text(7)), (12, text(9))]
    for order in (odd, odd[::-1]):
        kept = [(r.doc_id, r.text) for r in ngram_join.keep_one(spark.createDataFrame(order, "doc_id long, text string").repartition(3)).collect()]
        assert sorted(i for i, _ in kept if i is not None) == sorted(plain | {12}) == [1, 11, 12, 21, 31, 41, 51]
        assert [t for i, t in kept if i is None] == [text(7)]


def test_common_shingle_grows_linearly(spark):
    """Rows of a shingle that one document in twenty has, and of one in all, meet in their size class only."""
    rng = np.random.default_rng(3)
    rows = [(i, " ".join([*("all of us " if i % 2 else "one in twenty ").split(), *(f"r{x}" for x in rng.integers(0, 10**6, int(rng.integers(5, 60))))])) for i in range(400)]
    rows += [(1000 + i, rows[i][1]) for i in range(30)] + [(2000 + i, rows[i][1] + " end") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, ngram_join.jaccard_classes(docs, 3, 90).collect())) == brute_jaccard(rows, 3, 90)


def test_shingles_are_counted_over_all_partitions(spark):
    """A shingle that two documents of each partition have ranks as common, above those of one document."""
    rows = [(i, "all of us " + " ".join(f"d{i}w{j}" for j in range(20))) for i in range(30)]
    ranks = ngram_join.frequency_ranks(spark.createDataFrame(rows, "doc_id long, text string").repartition(15), 3)
    (_, common), (_, own) = shingle_sets(pa.array(["all of us", rows[0][1].split(" ", 3)[3]]), 3)
    rank = lambda s: ranks[(s % np.uint64(ngram_join.CELLS)).astype(np.int64)]
    assert rank(common)[0] > rank(own).max() > 0


def joined(spark, monkeypatch, rows, k, percent):
    """Rows of the join's tables of sketches and of pairs; its result is held against brute force."""
    made, keep = {}, ngram_join.stash

    def counted(df, name="table"):
        out = keep(df, name)
        if name in ("spread", "pairs"):
            made[name] = out.count()
        return out

    monkeypatch.setattr(ngram_join, "stash", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, ngram_join.jaccard_classes(docs, k, percent).collect())) == brute_jaccard(rows, k, percent)
    return made


def test_chance_shingles_move_no_sketches(spark, monkeypatch):
    """Shingles that a few groups share by chance, as in any large corpus, cost no row with a sketch."""
    rng = np.random.default_rng(12)
    rows = [(i, " ".join(f"v{x}" for x in rng.integers(0, 30, int(rng.integers(20, 60))))) for i in range(300)]
    assert joined(spark, monkeypatch, rows, 3, 80)["spread"] == 0


def test_copies_of_one_text_meet_at_it(spark, monkeypatch):
    """Copies with edits of their own link with what they were copied from, wherever its hash falls, and are not paired."""
    rng, rows = np.random.default_rng(13), []
    for group in range(4):
        base = [f"g{group}t{x}" for x in rng.integers(0, 10**6, 150)]
        rows.append((100 * group, " ".join(base)))
        for i in range(1, 41):
            copy = list(base)
            for at in rng.choice(150, int(rng.integers(1, 4)), replace=False):
                copy[at] = f"e{group}x{i}x{at}"
            rows.append((100 * group + i, " ".join(copy)))
    assert joined(spark, monkeypatch, rows, 5, 80)["pairs"] <= len(rows)


def brute_cosine(vectors, least=0.95):
    fine = {i: np.array(v, float) for i, v in vectors if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    fine = {i: v / np.abs(v).max() for i, v in fine.items()}
    fine = {i: v / np.linalg.norm(v) for i, v in fine.items()}
    links = [(a, b) for a in fine for b in fine if a < b and len(fine[a]) == len(fine[b]) and fine[a] @ fine[b] >= least]
    label = classes({i for i, _ in vectors}, links)
    count = {i: sum(i in e for e in links) for i, _ in vectors}
    return sorted((i, count[i], label[i], label[i] == i) for i, _ in vectors)


def compare(got, rows):
    got, want = sorted(tuple(r)[:4] for r in got), brute_cosine(rows)
    assert [g[0] for g in got] == [w[0] for w in want]
    assert all(g[1] <= w[1] for g, w in zip(got, want))
    assert sum(g[1] for g in got) >= 0.99 * sum(w[1] for w in want)
    assert sum(g[2:] == w[2:] for g, w in zip(got, want)) >= 0.99 * len(want)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_embeddings(spark, kind):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(30, 16))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 30] + rng.normal(size=16) * (0.05 if i % 3 else 1.5)]) for i in range(900)]
    rows += [(1000 + i, rows[1][1]) for i in range(40)] + [(1100 + i, [(2.0 + i) * x for x in rows[4][1]]) for i in range(9)]  # exact and scaled copies
    rows += [(2000, None), (2001, []), (2002, [0.0] * 16), (2003, [float("nan")] + [1.0] * 15), (2004, [float("inf")] * 16), (2005, [None] * 16), (2006, [1.0, 2.0]), (2007, [1.0, 2.01])]
    rows += [(2008, [1e200] * 16), (2009, [1e-200] * 16)] if kind == "double" else []
    rows = [(i, v and [x and float(np.float32(x)) for x in v]) if kind == "float" else (i, v) for i, v in rows]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], f"vec_id long, embedding array<{kind}>, vector string")
    got = hnsw.near_duplicates(df).collect()
    compare(got, rows)
    assert all(r.audited_recall >= 0.99 for r in got)


def test_odd_embeddings(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<double>, unit string")
    assert hnsw.near_duplicates(empty).count() == 0
    nameless = hnsw.near_duplicates(spark.createDataFrame([(None, [1.0]), (3, [2.0])], "vec_id long, embedding array<float>")).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component_id) for r in nameless) == [(0, 0, None), (3, 0, 3)]
    # different vectors under one id are one node and not linked with each other; 
    rows = [(1, [1.0, 0.0]), (1, [0.96, 0.28]), (2, [0.0, 1.0]), (3, [0.6, 0.8]), (4, [-0.0, 3.0]), (4, [0.0, 3.0])]
    got = hnsw.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), least=0.79).collect()
    assert sorted((r.vec_id, r.component_id) for r in got) == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 1), (4, 1)]
    assert {r.n_links for r in got if r.vec_id == 1} == {1} and {r.n_links for r in got if r.vec_id == 2} == {3}


@pytest.mark.parametrize("size", [60, 400])
def test_query_on_planted_pairs(spark, tmp_path, size):
    """The registered query, on pairs, groups and a hot group of near copies among vectors that link with nothing."""
    rng = np.random.default_rng(size)
    x = rng.normal(size=(3 * size, 64))
    x = np.concatenate([x, x[:size] + rng.normal(size=(size, 64)) * 0.12, np.repeat(x[:1], size, 0) + rng.normal(size=(size, 64)) * 0.15, np.repeat(x[5:8], 8, 0) + rng.normal(size=(24, 64)) * 0.3]).astype(np.float32)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x[rng.permutation(len(x))])]
    spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    compare(QUERIES["op3_embedding_near_dedup"](spark, str(tmp_path)).collect(), rows)


def _unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _shard(x):
    return hnsw.Shard(np.arange(len(x)), np.ones(len(x), np.int64), _unit(x), 0.95)


def test_shard_counts_links():
    """Bounds count what comparing would, also where balls overlap and queries come from elsewhere."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(1500, 24))
    x = np.concatenate([x, x[:300] + rng.normal(size=(300, 24)) * 0.2, np.repeat(x[:1], 600, 0) + rng.normal(size=(600, 24)) * 0.1, np.repeat(x[7:8], 80, 0) + rng.normal(size=(80, 24)) * 0.2])
    s, other = _shard(x), _unit(x[::3] + rng.normal(size=(len(x[::3]), 24)) * 0.1)
    assert len(s.hubs) < len(x) - 500
    for ids, q in ((s.ids, s.x), (np.arange(10**6, 10**6 + len(other)), other)):
        want = (q @ s.x.T >= 0.95) & (ids[:, None] != s.ids[None, :])
        n, heads = s.ask(ids, q)
        assert (n <= want.sum(1)).all() and n.sum() >= 0.995 * want.sum()
        assert {(a, s.label[b]) for a, b in np.argwhere(want)} - set(map(tuple, heads)) == set() or n.sum() < want.sum()
    assert s.audit(np.arange(10**6, 10**6 + len(other)), other) >= hnsw.AUDIT_RECALL


def test_audit_sees_small_groups_beside_a_hot_one(monkeypatch):
    """A search that finds the hot group and few other links must not pass: the audit ends in comparing with all hubs."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(1600, 24))
    s = _shard(np.concatenate([x, x[:800] + rng.normal(size=(800, 24)) * 0.02, np.repeat(x[:1], 700, 0) + rng.normal(size=(700, 24)) * 0.02]))
    hot, near = (s.x[s.hubs] @ s.x[0]) >= 0.9, hnsw.Graph.near

    def blind(self, q, least, beam=None):
        a, b = near(self, q, least, hnsw.FIRST_BEAM)
        if self.dense:
            return a, b
        ok = hot[b] | (rng.random(len(b)) < share)
        return a[ok], b[ok]

    monkeypatch.setattr(hnsw.Graph, "near", blind)
    q = _unit(s.x + rng.normal(size=s.x.shape) * 0.002)
    for share in (0, 0.95):
        s.graph.beam, s.graph.dense = hnsw.FIRST_BEAM, False
        assert s.audit(np.arange(len(q)) + 10**6, q) == 1.0 and s.graph.dense


@pytest.mark.parametrize("flat", [hnsw.FLAT, 20])
@pytest.mark.parametrize("rank", [48, 3])
def test_vectors_ask_few_homes(spark, monkeypatch, rank, flat):
    """Vectors are sent to the shards around them and not to all; where links lie in few directions, to more of them."""
    rng, sent, keep = np.random.default_rng(rank), [], hnsw.stash

    def counted(df, name="table"):
        out = keep(df, name)
        if name == "routed":
            sent.append([len(r.homes) for r in out.select("homes").collect()])
        return out

    monkeypatch.setattr(hnsw, "stash", counted)
    monkeypatch.setattr(hnsw, "HOME_ROWS", 16)
    monkeypatch.setattr(hnsw, "LEAST_SENT", 2000)
    monkeypatch.setattr(hnsw, "FLAT", flat)
    x = rng.normal(size=(1000, rank))
    near = x[:300] / np.linalg.norm(x[:300], axis=1, keepdims=True)
    x = np.concatenate([x, near + rng.normal(size=near.shape) * 0.25 / np.sqrt(rank), np.repeat(near[:1], 200, 0) + rng.normal(size=(200, rank)) * 0.02])
    if rank < 48:
        x = np.concatenate([x, np.zeros((len(x), 48 - rank))], axis=1) @ np.linalg.qr(rng.normal(size=(48, 48)))[0]
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(x[rng.permutation(len(x))])]
    got = hnsw.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    compare(got, rows)
    assert got[0].audited_recall >= 0.99
    assert len(sent[0]) == len(rows) and np.mean(sent[0]) < 20  # of 34 pivots


def test_pairs_at_the_angle_share_a_home():
    """Without a link in the sample, two vectors at the linking angle still meet; pivots calibrate nothing on themselves."""
    rng = np.random.default_rng(14)
    x = _unit(rng.normal(size=(900, 32)))
    router = hnsw.Router(x[:400], 200, x[400:], 0.95)
    q = _unit(rng.normal(size=(2000, 32)))
    turn = rng.normal(size=q.shape)
    turn = _unit(turn - (turn * q).sum(1, keepdims=True) * q)
    ids, asked = router.asks(q)
    home = router.homes(0.95 * q + np.sqrt(1 - 0.95**2) * turn)
    assert ((ids == home[:, None]) & asked).any(1).mean() >= 0.98 and asked.mean() * asked.shape[1] < 80


def test_low_recall_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(hnsw, "LEAST_RECALL", 1.1)
    with pytest.raises(RuntimeError, match="recall"):
        hnsw.near_duplicates(spark.createDataFrame([(1, [1.0]), (2, [1.0])], "vec_id long, embedding array<double>"))


def test_near_copy_stage_against_brute_force(spark, sf_dir):
    """Five words, 80 percent: also what 3 words and 90 percent do not link."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    kept = sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, sf_dir).collect())
    assert kept == sorted(i for i, _, c in brute_jaccard(rows, 5, 80) if i == c)
    assert len(kept) < sum(i == c for i, _, c in brute_jaccard(rows, 3, 90))
