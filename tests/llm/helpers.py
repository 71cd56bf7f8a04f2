"""Brute-force versions and odd inputs."""

import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n long, size string, spans string, set_key long, row string, id string"
LONG = " ".join(f"w{i % 977} x{i % 31}" for i in range(120_000))


def fold(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", fold(text))


def alnum_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(text))


def odd_documents(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, and extra columns with clashing names."""
    base = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
    rows = [
        (1, base, "en", "a"), (2, base, "en", "a"), (2, base, "en", "a"), (3, base.upper(), None, None), (4, base.replace("ten", "TEN,"), "en", "b"),
        (5, None, "en", "b"), (6, "", "fr", "b"), (7, " \t\n ", "fr", ""), (8, "solo", None, "a"), (9, "SOLO", "fr", "a"), (10, "two words", "fr", None),
        (None, base, "en", "a"), (None, None, None, None), (11, LONG, "en", "c"), (12, LONG + " tail", "en", "c"), (13, "123 456 !!! ???", "en", "c"), (14, "日本語 テキスト ñandú", "es", "c"),
    ]
    return spark.createDataFrame([(i, t, lang, s, None if t is None else len(t), 1, "s", "x", 7, "r", "z") for i, t, lang, s in rows], DOCS)


def no_documents(spark):
    return spark.createDataFrame([], DOCS)


def classes(nodes, links):
    """Smallest node of each node's class."""
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def shingles(text, k):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
