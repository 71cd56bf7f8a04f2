import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from quillmap.llm.components import components
from quillmap.llm.words import ALNUM, NOT_SPACE, Words, gram, slices

from .helpers import alnum_words, classes, words


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(st.sampled_from("aZ9 \t\n\x0b\x0c\r.éß日\x1f\x00-")))))
def test_words_are_the_patterns(texts):
    for flags, want in ((NOT_SPACE, words), (ALNUM, alnum_words)):
        w = Words(pa.array(texts, pa.string()), flags)
        got = [[w.word(i).decode() for i in range(a, b)] for a, b in zip(w.first[:-1], w.first[1:])]
        assert got == [want(t) for t in texts]
        flat = [x for row in got for x in row]
        h = w.hashes()
        assert len({*zip(flat, h.tolist())}) == len(set(flat)) == len(set(h.tolist()))


def test_hash_does_not_depend_on_place():
    many = Words(pa.array(["x " * 700_000 + "needle", "needle"]), NOT_SPACE)
    h = many.hashes()
    assert h[-1] == h[-2] and h[0] == h[1] != h[-1]
    assert gram(h[:3], 3)[0] == gram(h[1:4], 3)[0] and len(gram(h[:2], 3)) == 0


def test_slices_cover_all_rows():
    texts = pa.array(["a" * 10, None, "", "b" * 100, "c"])
    parts = list(slices(texts, 20))
    assert [i for a, b in parts for i in range(a, b)] == [0, 1, 2, 3, 4]


def test_components(spark):
    rng = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (180, 2))] + [(i, i + 1) for i in range(1000, 1100)] + [(5000, i) for i in range(4000, 4300)] + [(7, 7)]
    df = spark.createDataFrame([*edges, (None, 3)], "u long, v long")
    nodes = {n for e in edges for n in e if e[0] != e[1]}
    want = classes(nodes, [e for e in edges if e[0] != e[1]])
    assert {r.node: r.component for r in components(df).collect()} == want
    assert components(df.where("u is null and u is not null")).count() == 0
