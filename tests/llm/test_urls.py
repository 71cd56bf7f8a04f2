"""URL filter against brute force."""

import math
import random
import time
from collections import Counter, defaultdict

import duckdb
import pytest

from quillmap.llm import url_filter
from quillmap.llm.queries import QUERIES


def split_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, rest = rest[:cut], rest[cut:]
    end = min([rest.find(c) for c in "?#" if c in rest], default=len(rest))
    return "".join(c.lower() if c.isascii() else c for c in host), rest[:end]


def fitting_rule(host, path):
    fit = [(len(h + p), len(h), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[2:] if fit else (None, None)


SEEDS = {v: text.split() for v, text in url_filter.LABELLED.items()}
SEED_WORDS = {w for text in SEEDS.values() for w in text}


def every_split(name, counts):
    """All ways to write a name as known words and rests of three letters or more, no two rests side by side."""

    def walk(at, after_rest):
        if at == len(name):
            yield []
        for end in range(at + 3, len(name) + 1):
            part = name[at:end]
            if part != name and end - at <= 24 and (part in counts or part in SEED_WORDS):
                yield from ([(part, True), *more] for more in walk(end, False))
            if not after_rest:
                yield from ([(part, False), *more] for more in walk(end, True))

    return walk(0, False)


def brute_split(name, n, counts, total):
    if len(name) < 6 or name in SEED_WORDS or name[0].isdigit():
        return [name]

    def cost(word, m):
        p = 0.9 * m / total + (0.1 / len(SEED_WORDS) if word in SEED_WORDS else 0)
        return -math.log(p)

    ways = [(sum(cost(w, counts.get(w, 0)) if known else math.log(total + 1) + len(w) * math.log(27) / n for w, known in way), [w for w, _ in way], way) for way in every_split(name, counts)]
    pure = [x for x in ways if all(known and w in SEED_WORDS for w, known in x[2])]
    ways = pure or ways
    best = min(c for c, _, _ in ways)
    whole = cost(name, n) + len(name) * math.log(27) / n
    if whole <= best + 1e-12 and not pure:
        return [name]
    return [parts for c, parts, _ in ways if c <= best + 1e-9]


def brute(urls):
    """words and odds by url."""
    split = {u: split_url(u) for u in urls}
    names = {u: url_filter.names_of(*split[u]) for u in urls}
    n = Counter(name for _, name in {(split[u][0], name) for u in urls for name in names[u]})
    total = sum(n.values())
    first = {x: brute_split(x, m, n, total) for x, m in n.items()}
    first = {x: w[0] for x, w in first.items() if not isinstance(w[0], str)}
    second = Counter({x: m for x, m in n.items() if x not in first})
    for x, parts in first.items():
        for w in parts:
            if w not in first:
                second[w] += n[x]
    final = {x: w for x, m in n.items() if not isinstance((w := brute_split(x, m, second, total))[0], str)}
    ways = {u: [final.get(x, [[x]]) for x in names[u]] for u in urls}
    words = {u: [w for options in ways[u] for w in options[0]] for u in urls}
    rule_names = {x for _, h, p in url_filter.RULES for x in url_filter.names_of(h, p)}
    seen = defaultdict(set)
    for u in urls:
        verdict = fitting_rule(*split[u])[1]
        if verdict:
            seen[verdict] |= {(split[u][0], w) for w in words[u] if w not in rule_names}
    count = {v: Counter(w for _, w in seen[v]) for v in ("block", "allow")}

    def odds(w):
        p = [count[v][w] / (sum(count[v].values()) + 1000) + (1 / len(SEEDS[v]) if w in SEEDS[v] else 0) + url_filter.SMOOTHING for v in ("block", "allow")]
        return math.log(p[0] / p[1])

    return ways, {u: math.log(0.2 / 0.8) + sum(map(odds, words[u])) for u in urls}


URLS = [
    "http://WWW.Example.com/en/x?y=1", "https://example.com/en/", "http://a.b.example.com/en/1#z", "http://notexample.com/en/", "http://net/es/", "http://x.NET/fr/a", "http://x.net/ES/a", "http://x.org", "http://x.org?q=/a",
    "http://a.com#f", "x.com/en", "", None, "://h/p", "a://b://c/d", "http:///p", "http://com/", "http://com", "http://É.com/ü", "\nhttp://new.com/line\nbreak", "http://free-casino.org/win", "http://essex-history.org/max/",
    "http://freecasinonews.org/", "http://y.org/freecasinonews/", "http://köln-museum.org/stadt9plan", "http://xn--kln-sna.org/%C3%BCber%20uns", "http://xn--!.org/100%", "http://free-casino.org/win", "http://loansharkforum.net/x", "http://a.sportcasino.com/", "http://sport.com/news", "http://sportnews.org/casinosport",
]


def check(got, urls):
    ways, odds = brute(urls)
    for r, u in got:
        host, path = split_url(u)
        rule, verdict = fitting_rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule), u
        at = 0
        for options in ways[u]:
            assert any(r.words[at : at + len(o)] == o for o in options), (u, r.words, options)
            at += len(next(o for o in options if r.words[at : at + len(o)] == o))
        assert at == len(r.words)
        if all(len(o) == 1 for o in ways[u]):
            assert math.isclose(r.block_odds, odds[u], abs_tol=1e-9), u
        assert r.verdict == (verdict or ("block" if r.block_odds > 0 else "allow"))


def test_urls(spark):
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)] + [(None, URLS[0], "x")], "page_id long, url string, rule string")
    got = url_filter.judge_urls(df).collect()
    assert len(got) == len(URLS) + 1
    check([(r, URLS[r.page_id or 0]) for r in got], URLS)
    by_url = {URLS[r.page_id]: r for r in got if r.page_id is not None}
    assert by_url["http://freecasinonews.org/"].words[:3] == by_url["http://y.org/freecasinonews/"].words[2:] == ["free", "casino", "news"]
    assert by_url["http://freecasinonews.org/"].verdict == by_url["http://free-casino.org/win"].verdict == "block"
    assert by_url["http://x.org"].verdict == by_url["http://essex-history.org/max/"].verdict == by_url[None].verdict == "allow"
    assert by_url["http://köln-museum.org/stadt9plan"].words == ["köln", "museum", "org", "stadt", "9", "plan"]
    assert by_url["http://xn--kln-sna.org/%C3%BCber%20uns"].words == ["köln", "org", "über", "uns"]
    assert url_filter.judge_urls(df.limit(0)).count() == 0


def test_random_names(spark):
    """Concatenations of words that the corpus also has alone, and of words it has not."""
    rng = random.Random(3)
    stock = ["red", "blue", "wood", "house", "casino", "free", "museum", "sex", "middle", "tion", "ring", "the", "her", "ingot"]
    urls = [f"http://{''.join(rng.choices(stock, k=rng.randint(1, 3)))}{rng.choice(['', '', 'qzk'])}.{rng.choice(['org', 'com', 'net'])}/{rng.choice(['en', 'fr', 'es'])}/{rng.choice(stock)}" for _ in range(150)]
    got = url_filter.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()
    check([(r, urls[r.page_id]) for r in got], urls)


def test_frequent_names_are_words():
    s = url_filter.Segmenter(url_filter.LABELLED, 10_000)
    assert s.split("middlesex", 40, {"middle": 60}) == ["middlesex"]
    assert s.split("middlesex", 1, {"middle": 60}) == ["middle", "sex"]
    assert s.split("freecasinonews", 500, {}) == ["free", "casino", "news"]
    assert s.split("essex", 1, {}) == ["essex"] and s.split("qqqcasinozzz", 1, {}) == ["qqq", "casino", "zzz"]


def test_long_names(spark):
    began = time.time()
    s = url_filter.Segmenter(url_filter.LABELLED, 1000)
    assert "".join(s.split("casinonewsxq" * 20_000, 1, {})) == "casinonewsxq" * 20_000
    assert time.time() - began < 30
    df = spark.createDataFrame([(1, "http://h.org/" + "ab" * 3000), (2, "http://" + "a." * 3000 + "org/"), (1, "http://h.org/" + "ab" * 3000)], "page_id long, url string")
    assert [len("".join(r.words)) for r in url_filter.judge_urls(df).orderBy("page_id").collect()] == [6004, 6004, 3003]


@pytest.mark.parametrize("size", ["sf0.001", "sf0.1"])
def test_query_on_pages(spark, size):
    folder = f"/root/testdata/{size}"
    got = QUERIES["op1_url_filters"](spark, folder).collect()
    rows = {r.page_id: r.url for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    assert len(got) == len(rows)
    if size == "sf0.001":
        check([(r, rows[r.page_id]) for r in got], list(rows.values()))
    plain = duckdb.sql(rf"SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^(?:[^:]|:[^/]|:/[^/])*://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(url, ''), '^(?:[^:]|:[^/]|:/[^/])*://([^/?#]*)([^?#]*)', 2) AS path FROM '{folder}/pages.parquet'").fetchall()
    assert {(r.page_id, r.host, r.path) for r in got} == set(plain)
    assert all((r.rule, r.verdict) == fitting_rule(r.host, r.path) for r in got if r.rule)
    assert len({r.verdict for r in got if r.rule is None}) >= 1
