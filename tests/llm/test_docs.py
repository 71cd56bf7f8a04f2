"""Per-document operators against brute force, round trips and held-out accuracy."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillmap.llm import decontaminate, language_id, mixing, packing
from quillmap.llm.queries import QUERIES

from .helpers import alnum_words, no_documents, odd_documents, words


# decontamination


def brute_hits(docs, items, window=10):
    wins = {}
    for i, t in items:
        w = alnum_words(t)
        m = min(window, len(w))
        for j in range(len(w) - m + 1 if m else 0):
            wins.setdefault(tuple(w[j : j + m]), set()).add(i)
    out = []
    for i, t in docs:
        w, hit, seen = alnum_words(t), set(), set()
        for m in {len(k) for k in wins}:
            for j in range(len(w) - m + 1):
                if found := wins.get(tuple(w[j : j + m])):
                    seen |= found
                    hit |= set(range(j, j + m))
        ids = sorted(str(x) for x in seen if x is not None)
        out.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def test_contamination_query(spark, sf_dir):
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet").collect() for t in ("documents", "benchmark"))
    got = sorted(map(tuple, QUERIES["op9_benchmark_decontamination"](spark, sf_dir).collect()), key=str)
    assert got == brute_hits([(r.doc_id, r.text) for r in docs], [(r.item_id, r.text) for r in items])
    assert any(r[-1] for r in got)


@pytest.mark.parametrize("block_words", [2_000_000, 3])
def test_contamination_of_odd_rows(spark, monkeypatch, block_words, tmp_path):
    """Repeats, short items, null ids and texts; with tiny blocks the benchmark takes many passes."""
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block_words)
    w = [f"k{i}" for i in range(30)]
    items = [(1, " ".join(w[:12])), (2, " ".join(w[5:25])), (3, "k1 k2"), (4, ""), (5, None), (None, "zz"), (6, " ".join(w[:12])), (7, "a A a"), (1, "k29")]
    docs = [(1, " ".join(w)), (2, "K1, K2! zz"), (3, "a a a a a"), (4, None), (5, ""), (None, "k29"), (6, " ".join(w[:9])), (6, " ".join(w[:9])), (7, " ".join(w[3:14] * 40))]
    d = spark.createDataFrame([(*r, "x", 3) for r in docs], "doc_id long, text string, spans string, n_words int")
    for name, df in (("documents", d), ("benchmark", spark.createDataFrame(items, "item_id long, text string"))):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    got = sorted(map(tuple, QUERIES["op9_benchmark_decontamination"](spark, str(tmp_path)).collect()), key=str)
    assert got == brute_hits(docs, items)
    bench = spark.read.parquet(f"{tmp_path}/benchmark.parquet")
    spans = {(s.item_id, s.start, s.n_words) for s in decontaminate.find_contamination(d.where("doc_id = 1"), bench).first().spans}
    assert {(1, 0, 12), (2, 5, 20), (6, 0, 12), (3, 1, 2), (1, 29, 1)} == spans
    clean = decontaminate.remove_contaminated(d, bench)
    assert clean.columns == d.columns and sorted(r.doc_id for r in clean.collect()) == [4, 5, 7]
    assert decontaminate.remove_contaminated(d, bench.limit(0)).count() == len(docs)
    assert decontaminate.find_contamination(no_documents(spark), bench).count() == 0


def test_matches_are_verbatim(spark):
    """Item words 0-9 followed by 20-29 are two matches; each is maximal and the same words on both sides."""
    w = [f"b{i}" for i in range(40)]
    item, text = " ".join(w), " ".join(["x", *w[:10], *w[20:30], "y", *w[5:33]])
    d, bench = spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([(7, item)], "item_id long, text string")
    spans = decontaminate.find_contamination(d, bench).first().spans
    assert {(s.start, s.item_start, s.n_words) for s in spans} == {(1, 0, 10), (11, 20, 10), (22, 5, 28)}
    assert all(text.split()[s.start : s.start + s.n_words] == w[s.item_start : s.item_start + s.n_words] for s in spans)


def test_rare_languages_are_learnt(spark):
    rows = [(i, "the quick and the dead of it all " * 3, "en") for i in range(3000)] + [(9000 + i, "der schnelle und die müden äpfel " * 3, "de") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language_id.identify(docs.where("doc_id > 2990"), language_id.train(docs)).collect()
    assert all(r.lang_pred == r.lang for r in got)



# language


def test_language_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = {r.doc_id: r for r in QUERIES["op10_language_id"](spark, "/root/testdata/sf0.01").collect()}
    truth = {r.doc_id: r.lang for r in docs.collect()}
    held = [i for i, r in rows.items() if r.held_out]
    assert len(rows) == len(truth) and 0.15 < len(held) / len(rows) < 0.35
    assert sum(rows[i].lang_pred == truth[i] for i in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows.values())


def test_language_of_odd_rows(spark):
    docs = odd_documents(spark)
    net = language_id.train(docs)
    assert net.labels == ["en", "es", "fr"]
    found = language_id.identify(docs, net)
    assert found.columns == [*docs.columns, "lang_pred", "score"]
    for r in found.collect():
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred in net.labels) == letters and (r.score > 0) == letters
    assert language_id.train(no_documents(spark)) is None
    assert {r.lang_pred for r in language_id.identify(docs, None).collect()} == {"und"}
    assert language_id.identify(no_documents(spark), net).count() == 0


def test_tables_are_the_convolution():
    net = language_id.ByteConvNet(["a", "b"])
    x = np.random.default_rng(1).integers(0, language_id.CLASSES, (5, language_id.WINDOW)).astype(np.uint8)
    e, pooled = net.p["embed"][x], []
    for w in language_id.WIDTHS:
        z = sum(e[:, j : e.shape[1] - w + j + 1] @ net.p[f"conv{w}"][j] for j in range(w))
        pooled.append(z.max(axis=1))
    assert np.allclose(np.concatenate(pooled, 1), net.pooled(x), atol=1e-4)


# mixing


def water(sizes, percent=150, cap=2):
    """Targets by reshaping step by step."""
    keys = sorted((k for k in sizes if k is not None), key=lambda k: [ord(c) for c in k]) + [k for k in sizes if k is None]
    weight = {k: (3, 1, 2)[i % 3] for i, k in enumerate(keys)}
    full, total = set(), percent / 100 * sum(sizes.values())
    while True:
        rest = total - sum(cap * sizes[k] for k in full)
        share = sum(weight[k] for k in keys if k not in full)
        target = {k: cap * sizes[k] if k in full else rest * weight[k] / share for k in keys}
        over = {k for k in keys if k not in full and target[k] > cap * sizes[k]}
        if not over:
            return target
        full |= over


@settings(max_examples=8, deadline=None)
@given(st.dictionaries(st.one_of(st.none(), st.text("aBé𝄞", max_size=2)), st.integers(0, 40), min_size=1, max_size=9))
def test_targets(spark, sizes):
    df = spark.createDataFrame([(k, 1) for k, n in sizes.items() for _ in range(n)] + [(k, 0) for k in sizes], "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(df).collect()}
    want = water(sizes)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_mixing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = QUERIES["op4_mixing_sources"](spark, sf_dir).collect()
    texts = {r.doc_id: r for r in docs.collect()}
    assert all(r.size == len(words(texts[r.doc_id].text)) for r in rows)
    per = Counter()
    for r in rows:
        per[texts[r.doc_id].source] += r.size
    assert all(r.source_size == per[texts[r.doc_id].source] and r.taken in (0, r.size, 2 * r.size) for r in rows)
    assert abs(sum(r.taken for r in rows) / sum(per.values()) - 1.5) < 0.1
    assert rows == QUERIES["op4_mixing_sources"](spark, sf_dir).collect()
    mixed = Counter(r.doc_id for r in mixing.mix(docs).collect())
    assert all(mixed[r.doc_id] * r.size == r.taken for r in rows)
    odd = odd_documents(spark)
    assert mixing.mix(odd).columns == odd.columns and mixing.copies(odd).count() == odd.count()
    assert all(r.copies <= 2 and r.size == len(words(r.text)) for r in mixing.copies(odd).collect())
    assert mixing.mix(no_documents(spark)).count() == 0


# packing


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60))
def test_best_fit_decreasing(lengths):
    got = packing.best_fit_decreasing(np.array(lengths, np.int64), 50)
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    rooms, want = [], []
    for i in order:
        fits = [(room, -r) for r, room in enumerate(rooms) if room >= lengths[i]]
        if fits:
            assert min(fits)[0] >= lengths[i]
        room = min(fits)[0] if fits else 50
        row = next((r for r, x in enumerate(rooms) if x == room), None) if fits else len(rooms)
        if not fits:
            rooms.append(50)
        rooms[row] -= lengths[i]
        want.append(room - lengths[i])
    assert sorted(i for row in got for i in row) == list(range(len(lengths)))
    assert all(sum(lengths[i] for i in row) <= 50 for row in got)
    assert sorted(50 - sum(lengths[i] for i in row) for row in got) == sorted(rooms)


@pytest.mark.parametrize("row_tokens,shard", [(64, 4_000_000), (2048, 1000)])
def test_packing_is_lossless(spark, sf_dir, row_tokens, shard):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").unionByName(odd_documents(spark).where("doc_id is not null").selectExpr("doc_id + 100000 as doc_id", "text")).dropDuplicates(["doc_id"])
    rows = packing.pack(docs, row_tokens=row_tokens, shard_tokens=shard).collect()
    ids, positions = packing.matrices(rows, row_tokens)
    with open(packing.VOCABULARY, "rb") as f:
        encode = packing.byte_pair_encoder(f.read())
    got = {}
    for k, r in enumerate(rows):
        assert r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens <= row_tokens
        assert (ids[k, r.n_tokens :] == packing.END_OF_TEXT).all() and not positions[k, r.n_tokens :].any()
        for a, b, doc, start in zip(r.cu_seqlens, r.cu_seqlens[1:], r.doc_ids, r.doc_starts):
            got.setdefault(doc, {})[start] = ids[k, a:b].tolist()
            assert positions[k, a:b].tolist() == list(range(b - a))
    want = {r.doc_id: encode(r.text) + [packing.END_OF_TEXT] for r in docs.collect() if r.text is not None}
    assert {d: sum((p[s] for s in sorted(p)), []) for d, p in got.items()} == want
    assert packing.pack(no_documents(spark)).count() == 0
    assert len({(r.shard, r.row) for r in rows}) == len(rows)


def test_long_texts_encode_alike():
    with open(packing.VOCABULARY, "rb") as f:
        encode = packing.byte_pair_encoder(f.read())
    text = "Some words, 12 numbers\n  and   spaces. Ünïcode " * 9000
    import base64

    import tiktoken

    with open(packing.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    assert encode(text) == tiktoken.Encoding("t", pat_str=packing.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary(text)


# language model


# registry and pipeline


def test_registry_is_complete():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))


def test_pipeline(spark, sf_dir):
    """Each stage against a brute-force version on its own input."""
    import corpus_pipeline

    from .test_pairs import brute_jaccard

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "ngram_jaccard_join", "benchmark_decontamination", "mixing_sources", "token_packing"]
    columns, stages = docs.columns, [f for _, f in corpus_pipeline.STAGES]
    one = stages[0](spark, docs, sf_dir)
    assert one.columns == columns and {r.doc_id for r in one.collect()} >= {r.doc_id for r in docs.collect() if any(c.isalpha() for c in r.text) and len(r.text) > 200}
    two = stages[1](spark, one, sf_dir)
    label = {i: c for i, _, c in brute_jaccard([(r.doc_id, r.text) for r in one.collect()], 5, 80)}
    assert two.columns == columns and sorted(r.doc_id for r in two.collect()) == sorted(i for i, c in label.items() if i == c)
    three = stages[2](spark, two, sf_dir)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    clean = {h[0] for h in brute_hits([(r.doc_id, r.text) for r in two.collect()], items) if not h[-1]}
    assert three.columns == columns and {r.doc_id for r in three.collect()} == clean
    four = stages[3](spark, three, sf_dir)
    assert four.columns == columns and {r.doc_id for r in four.collect()} <= clean
    packed = corpus_pipeline.run(spark, sf_dir).collect()
    encode = packing.byte_pair_encoder(open(packing.VOCABULARY, "rb").read())
    assert sum(r.n_tokens for r in packed) == sum(len(encode(r.text)) + 1 for r in four.collect())
    for stage in stages:
        assert stage(spark, no_documents(spark).select(columns), sf_dir).count() == 0


def test_stages_on_odd_rows(spark, sf_dir):
    """Nulls, empty and long texts, repeats and clashing columns: each stage keeps or drops whole rows."""
    import corpus_pipeline

    odd = odd_documents(spark)
    rows = {tuple(r) for r in odd.collect()}
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, sf_dir)
        assert out.columns == odd.columns
        found = out.collect()
        assert {tuple(r) for r in found} <= rows
        kept[name] = sorted((r.doc_id or 0, r.text or "") for r in found)
    assert not {5, 6, 7, 13} & {i for i, _ in kept["language_id"]}
    near = [i for i, _ in kept["ngram_jaccard_join"]]
    assert near.count(1) == near.count(5) == near.count(8) == near.count(11) == 1 and not {2, 3, 9, 12} & set(near)
    assert len(kept["benchmark_decontamination"]) == odd.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, odd, sf_dir).collect()
    assert {i for r in packed for i in r.doc_ids} == {i for i, t in ((r.doc_id, r.text) for r in odd.collect()) if t is not None}
