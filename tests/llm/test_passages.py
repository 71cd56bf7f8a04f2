"""Repeated passages against brute force: what is found, to which word, and that nothing vanishes."""

import numpy as np
import pytest

from quillmap.llm import substring_dedup
from quillmap.llm.queries import QUERIES

from .helpers import classes, no_documents, odd_documents, words

LEAST = substring_dedup.LEAST_WORDS


def _maker(seed):
    rng = np.random.default_rng(seed)
    return lambda n: [f"v{x}" for x in rng.integers(0, 10**7, n)]


def _texts(rows):
    return {i: words(t) for i, t in rows if i is not None}


def shared_grams(texts, n):
    at = {}
    for i, w in texts.items():
        for j in range(len(w) - n + 1):
            at.setdefault(tuple(w[j : j + n]), set()).add(i)
    return {g: min(ids) for g, ids in at.items() if len(ids) > 1}


def check(rows, found, left):
    """Every window of LEAST words that a lesser document has is under removed rows; these equal their sources; shared 8-grams survive."""
    texts, under = _texts(rows), {i: set() for i, _ in rows}
    for r in found:
        assert r.removed == (r.doc_id != r.source_doc_id)
        if r.kind == "window":
            if r.removed:
                under[r.doc_id].update(range(r.start, r.start + r.n_words))
            assert texts[r.doc_id][r.start : r.start + r.n_words] == texts[r.source_doc_id][r.source_start : r.source_start + r.n_words]
            assert r.source_doc_id <= r.doc_id and r.n_words >= substring_dedup.BLOCK
    long = shared_grams(texts, LEAST)
    for i, w in texts.items():
        for j in range(len(w) - LEAST + 1):
            if long.get(tuple(w[j : j + LEAST]), i) < i:
                assert set(range(j, j + LEAST)) <= under[i], (i, j)
    if left is not None:
        alive = {tuple(w[j : j + 8]) for w in left.values() for j in range(len(w) - 7)}
        assert {g[k : k + 8] for g in long for k in range(LEAST - 7)} <= alive


def test_bands_follow_recall():
    b = substring_dedup.bands_for()
    miss = 1 - 0.8**substring_dedup.ROWS
    assert 1 - miss**b >= 0.98 > 1 - miss ** (b - 1)


def test_windows_overlap_enough():
    assert substring_dedup.MARGIN + 1 <= substring_dedup.BLOCK - 7


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_query_on_documents(spark, size):
    docs = spark.read.parquet(f"/root/testdata/{size}/documents.parquet")
    found = QUERIES["op7_substring_dedup"](spark, f"/root/testdata/{size}").collect()
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    exact = spark.createDataFrame([r for r in found if r.kind == "window"], "doc_id long, kind string, start long, n_words long, class long, source_doc_id long, source_start long, removed boolean")
    left = {r.doc_id: words(r.text) for r in substring_dedup.remove_passages(docs, exact).collect()}
    check(rows, found, left)
    if size == "sf0.001":
        brute_paragraphs(rows, found)


def brute_paragraphs(rows, found):
    sets, places = {}, []
    for i, t in rows:
        at = 0
        for line in (t or "").split("\n"):
            w = words(line)
            if len(w) >= LEAST:
                places.append((i, at, len(w)))
                sets[i, at] = frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4))
            at += len(w)
    keys = list(sets)
    links = [(a, b) for x, a in enumerate(keys) for b in keys[x + 1 :] if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    label = classes(keys, links)
    docs = {}
    for (i, _), c in label.items():
        docs.setdefault(c, set()).add(i)
    wanted = {(i, at, n): min(docs[label[i, at]]) for i, at, n in places if len(docs[label[i, at]]) > 1}
    got = {(r.doc_id, r.start, r.n_words): r.source_doc_id for r in found if r.kind == "paragraph"}
    assert got == wanted and len(wanted) > 3


def test_near_alike_paragraphs(spark):
    """Paragraphs that are edited step by step link with their neighbours and make one class."""
    text = _maker(4)
    base, rows = text(90), []
    for i in range(12):
        rows.append((i, "\n".join(" ".join(x) for x in (text(60), base, text(70)))))
        base = [*base]
        base[(7 * i) % 88] = f"edit{i}"
    rows += [(20 + i, " ".join(text(55)) + "\n" + " ".join(base[:30] + text(60))) for i in range(3)]
    found = substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    brute_paragraphs(rows, found)


def test_part_of_a_passage_in_the_least_document(spark):
    w = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(x)) for i, x in ((1, w[:100]), (2, w), (3, w[60:]), (4, w[:40]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = substring_dedup.repeated_passages(df)
    left = {r.doc_id: words(r.text) for r in substring_dedup.remove_passages(df, found).collect()}
    check(rows, found.collect(), left)
    assert left[1] == w[:100] and left[3] == [] and left[4] == w[:40] and len(left[2]) < 300


def test_planted_and_clean_passages(spark):
    text = _maker(9)
    passage, near = text(51), text(60)
    changed = list(near)
    changed[30] = "other"
    rows = [(1, text(80) + passage + text(70)), (2, text(33) + passage), (3, passage + text(40)), (4, text(300)), (10, text(20) + passage[:49] + text(20))]
    rows = [(i, " ".join(w)) for i, w in rows] + [(5, " ".join(near) + "\n" + " ".join(text(30))), (6, " ".join(text(30)) + "\n" + " ".join(changed)), (7, None), (8, ""), (None, " ".join(passage))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = substring_dedup.repeated_passages(df)
    spans = {(r.doc_id, r.start, r.n_words, r.removed) for r in found.collect() if r.kind == "window" and r.doc_id < 5}
    assert spans == {(1, 80, 51, False), (2, 33, 51, True), (3, 0, 51, True)}
    assert {r.doc_id for r in found.collect()} == {1, 2, 3, 5, 6}
    cut = substring_dedup.remove_passages(df, found)
    left = {r.doc_id: r.text for r in cut.collect()}
    assert cut.columns == df.columns and all(left[i] == t for i, t in rows if i not in (2, 3, 6))
    assert left[2].split() == rows[1][1].split()[:33] and left[3].split() == rows[2][1].split()[51:] and left[6].split() == rows[6][1].split("\n")[0].split()
    assert substring_dedup.repeated_passages(no_documents(spark)).count() == 0
    odd = {r.doc_id for r in substring_dedup.repeated_passages(odd_documents(spark)).collect()}
    assert {11, 12} <= odd and not odd & {5, 6, 7, 8, 9, 10, 13, 14, None}


def test_overlapping_passages_survive(spark):
    """Random excerpts of a few long texts, in random order, some twice in one document."""
    text, rng = _maker(21), np.random.default_rng(5)
    sources, rows = [text(400) for _ in range(3)], []
    for i in rng.permutation(60):
        parts = []
        for _ in range(rng.integers(1, 5)):
            s = sources[rng.integers(0, 3)]
            a, n = rng.integers(0, 380), rng.integers(10, 260)
            parts += s[a : a + n] + (text(rng.integers(0, 40)) if rng.random() < 0.6 else [])
        rows.append((int(i), " ".join(parts)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = substring_dedup.repeated_passages(df)
    exact = found.where("kind = 'window'")
    left = {r.doc_id: words(r.text) for r in substring_dedup.remove_passages(df, exact).collect()}
    check(rows, found.collect(), left)
    assert sum(map(len, left.values())) < 0.6 * sum(len(w) for w in _texts(rows).values())


def test_points_that_no_document_needs_are_left_out(spark, monkeypatch):
    """Words behind a point are hashed only where documents that lack a run there share enough words across it."""
    new, rows, made, keep = _maker(23), [], [], substring_dedup.stash

    def counted(df, name="table"):
        out = keep(df, name)
        if name == "least":
            made.append(out.count())
        return out

    monkeypatch.setattr(substring_dedup, "stash", counted)
    for i in range(60):
        body, after = new(40), new(3)
        rows += [(10 * i, " ".join(new(9) + body + new(9)))] + [(10 * i + j, " ".join(new(9) + body + after + new(9))) for j in (1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = substring_dedup.repeated_passages(docs)
    check(rows, found.collect(), None)
    assert made == [0]
    shared = [*new(60), *new(12)]
    rows += [(1000, " ".join(new(9) + shared[:60] + new(20))), (1001, " ".join(new(9) + shared + new(9))), (1002, " ".join(new(9) + shared + new(9)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    check(rows, substring_dedup.repeated_passages(docs).collect(), None)
    assert 0 < made[1] <= 21
