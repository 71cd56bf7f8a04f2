"""URL filtering: allow and block rules, then naive Bayes over segmented host and path words.

Names of hosts and paths are runs of letters of any script, or of digits. A concatenated name is split by Viterbi
under a unigram model, whose words are the names of the corpus that are not compounds themselves,
counted by the hosts that have them, and a fixed list of labelled words. Multinomial naive Bayes, fitted on
the urls that rules decide and on the labelled words, scores the words of the others.
"""

from __future__ import annotations

import math
import re
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Shipped, broadcast_if, drop, small_batches, stash

#: (verdict, host, path); a rule fits its host and all subdomains where the path starts with its own.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Words that teach the models, by verdict.
LABELLED = {
    "block": "adult ads adserver affiliate bet bets betting bingo cams cashback casino cheap clickbait counterfeit crack cracked cheats dating deals download escort farm fake free gambling hack hentai hookup jackpot keygen loan loans lottery lucky malware naked nude payday phishing pharma pills piracy poker popups porn promo replica roulette scam sex sexy slots spam sponsor sportsbook torrent track tracker tracking viagra virus warez win winner xxx",
    "allow": "about academy archive article articles author blog book books city college community culture data docs education encyclopedia events faq forum garden gov guide health help history home house index journal kitchen law learn library magazine math medical museum music nature news notes page paper people photo physics press project read recipes reference report research review school science society story student study support teach technology theory travel tutorial university weather wiki world writing",
}
#: Names that say nothing about a site.
PLUMBING = frozenset("www m http https html htm php".split())
#: Letters of the shortest and the longest word that a name is split into, and of the shortest rest between such words.
SHORTEST, LONGEST = 3, 24
#: Share of the unigram model that labelled words have in all, and nats that a new word's letter costs once.
LABELLED_SHARE, LETTER = 0.1, math.log(27)
#: Probability that smooths a word under either verdict, and prior probability of block.
SMOOTHING, PRIOR_BLOCK = 0.002, 0.2
#: Counted words of a verdict that weigh half as much as its labelled ones, so that few urls teach little.
HALF_WEIGHT = 1000
#: Rows of words or split names, about 50 bytes each, that are broadcast; more are joined by shuffling.
BROADCAST_WORDS = 200_000
_NAME = re.compile(r"[^\W\d_]+|\d+")


def host_and_path(url: F.Column) -> tuple[F.Column, F.Column]:
    """Host (A-Z lower-cased) and path of a url; empty for null and where there is no ``://``."""
    parts = r"^(?s)(?:(?!://).)*://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(url, parts, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, parts, 2), F.lit(""))


def names_of(host: str, path: str) -> list[str]:
    """Names of a url in order, lower-cased; ``%`` escapes and ``xn--`` labels are decoded."""
    labels = []
    for label in host.split("."):
        if label.startswith("xn--"):
            try:
                label = label.encode("ascii").decode("idna")
            except UnicodeError:
                pass
        labels.append(label)
    text = ".".join(labels) + " " + (unquote(path) if "%" in path else path)
    return [n for n in _NAME.findall(text.lower()) if n not in PLUMBING]


class Rules:
    """Rules by host."""

    def __init__(self, rules):
        self.by_host: dict[str, list[tuple[str, str]]] = {}
        for verdict, host, path in rules:
            self.by_host.setdefault(host, []).append((path, verdict))
        self.names = sorted({n for _, host, path in rules for n in names_of(host, path)})

    def judge(self, host: str, path: str) -> tuple[str | None, str | None]:
        """The longest rule that fits, as text, and its verdict; of equal length the one with the longer host, then the first given."""
        best: tuple[int, int, str, str] | None = None
        at = 0
        while at >= 0:
            name = host[at:]
            for start, verdict in self.by_host.get(name, ()):
                if path.startswith(start) and (best is None or (len(name) + len(start), len(name)) > best[:2]):
                    best = len(name) + len(start), len(name), name + start, verdict
            at = host.find(".", at) + 1 or -1
        return best[2:] if best else (None, None)


class Segmenter:
    """Unigram Viterbi under a two-part code: a word costs -log of its probability, a new one its letters too, once."""

    def __init__(self, labelled: dict[str, str], total: int):
        self.total, self.labelled = max(total, 1), {w for text in labelled.values() for w in text.split()}
        self.floor = LABELLED_SHARE / max(1, len(self.labelled))

    def cost(self, word: str, n: int) -> float:
        p = (1 - LABELLED_SHARE) * n / self.total + (self.floor if word in self.labelled else 0.0)
        return -math.log(p) if p else math.inf

    def split(self, name: str, n: int, counts: dict[str, int]) -> list[str]:
        """Cheapest split of a name that ``n`` hosts have, under ``counts`` of its parts.

        Parts are known words of SHORTEST to LONGEST letters and unknown rests of SHORTEST or more. The
        name stays whole if that costs no more; one that labelled words alone can make up is always split into such.
        Time grows with the name's length. Of equally cheap splits the one with the earlier longer last part is taken.
        """
        length = len(name)
        if length < 2 * SHORTEST or name in self.labelled:
            return [name]
        known = [math.inf] * (length + 1)  # cheapest ways whose last part is a known word, or an unknown rest
        rest = [math.inf] * (length + 1)
        pure = [math.inf] * (length + 1)  # of labelled words alone
        known[0] = pure[0] = 0.0
        from_known, from_rest, from_pure = [0] * (length + 1), [0] * (length + 1), [0] * (length + 1)
        letter, new = LETTER / n, math.log(self.total + 1)
        for end in range(SHORTEST, length + 1):
            begun, longer = known[end - SHORTEST] + new + SHORTEST * letter, rest[end - 1] + letter
            rest[end], from_rest[end] = (begun, end - SHORTEST) if begun <= longer else (longer, from_rest[end - 1])
            for start in range(max(0, end - LONGEST), end - SHORTEST + 1):
                part, taught = name[start:end], name[start:end] in self.labelled
                if min(known[start], rest[start]) < math.inf and part != name and (taught or part in counts):
                    own = self.cost(part, counts.get(part, 0))
                    if (c := min(known[start], rest[start]) + own) < known[end]:
                        known[end], from_known[end] = c, start
                    if taught and pure[start] + own < pure[end]:
                        pure[end], from_pure[end] = pure[start] + own, start
        if pure[-1] == math.inf and self.cost(name, n) + letter * length <= min(known[-1], rest[-1]):
            return [name]
        parts, end = [], length
        while end:
            start = from_pure[end] if pure[-1] < math.inf else from_known[end] if known[end] <= rest[end] else from_rest[end]
            parts.append(name[start:end])
            end = start
        return parts[::-1]


def _splits(names: DataFrame, segmenter: Segmenter) -> DataFrame:
    """``name, n, parts`` of the compounds among ``names`` (name, n).

    A name meets only the counts of its own substrings, so no table of words is held anywhere. The
    words are first all names; those that this splits are no words any more, and give their
    count to their parts.
    """
    shipped = Shipped(names.sparkSession, segmenter)

    def pieces(batches):
        for batch in batches:
            name, n, piece = [], [], []

            def out():
                return pa.RecordBatch.from_arrays([pa.array(name, pa.string()), pa.array(n, pa.int64()), pa.array(piece, pa.string())], ["name", "n", "word"])

            for x, count in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for i in range(len(x) - SHORTEST + 1):
                    own = [x[i:j] for j in range(i + SHORTEST, min(len(x), i + LONGEST) + 1) if j - i < len(x)]
                    name += [x] * len(own)
                    n += [count] * len(own)
                    piece += own
                    if len(piece) > 50_000:
                        yield out()
                        name, n, piece = [], [], []
            yield out()

    def split(batches):
        segment = shipped.value.split
        for batch in batches:
            parts = [segment(x, n, {k["word"]: k["m"] for k in known}) for x, n, known in zip(*(c.to_pylist() for c in batch.columns))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(parts, pa.list_(pa.string()))], ["name", "n", "parts"])

    long = names.where((F.length("name") >= 2 * SHORTEST) & ~F.col("name").rlike(r"^\p{Nd}"))
    substrings = stash(long.mapInArrow(pieces, "name string, n long, word string").distinct(), "pieces")

    def compounds(words: DataFrame) -> DataFrame:
        known = substrings.join(words.select(F.col("name").alias("word"), F.col("n").alias("m")), "word", "left")
        known = known.groupBy("name", "n").agg(F.collect_list(F.when(F.col("m").isNotNull(), F.struct("word", "m"))).alias("known"))
        return stash(known.mapInArrow(split, "name string, n long, parts array<string>").where("size(parts) > 1"), "compounds")

    first = compounds(names)
    given = first.select(F.explode("parts").alias("name"), "n")
    simple = names.join(first.select("name"), "name", "left_anti").unionByName(given).groupBy("name").agg(F.sum("n").alias("n"))
    simple = simple.join(first.select("name"), "name", "left_anti")
    out = compounds(simple)
    drop(first, substrings)
    return out


def _odds(words: DataFrame, labelled: dict[str, str], rule_names: list[str]) -> DataFrame:
    """``word, odds``: log odds of block, from ``words`` (host, rule_verdict, word) that rules decide and the labelled words.

    A host counts a word once for a verdict. Names of the rules themselves are left out, since they
    would teach the rules over again.
    """
    spark = words.sparkSession
    seen = words.where(F.col("rule_verdict").isNotNull() & ~F.col("word").isin(rule_names)).select("host", "rule_verdict", "word").distinct()
    each = stash(seen.groupBy("word").agg(*(F.sum((F.col("rule_verdict") == v).cast("long")).alias(v) for v in ("block", "allow"))), "seen")
    total = each.agg(*(F.coalesce(F.sum(v), F.lit(0)) for v in ("block", "allow"))).first()
    taught = [(w, v, 1.0 / len(text.split())) for v, text in labelled.items() for w in text.split()]
    prior = spark.createDataFrame(taught, "word string, verdict string, p double").groupBy("word").agg(*(F.sum(F.when(F.col("verdict") == v, F.col("p")).otherwise(0.0)).alias(f"taught_{v}") for v in ("block", "allow")))
    both = each.join(F.broadcast(prior), "word", "full")
    p = {v: F.coalesce(F.col(v) / (n + HALF_WEIGHT), F.lit(0.0)) + F.coalesce(f"taught_{v}", F.lit(0.0)) + SMOOTHING for v, n in zip(("block", "allow"), total)}
    return both.select("word", F.log(p["block"] / p["allow"]).alias("odds")).where("odds <> 0")


def judge_urls(pages: DataFrame, rules=RULES, labelled=LABELLED) -> DataFrame:
    """``page_id, host, path, rule, verdict, words, block_odds`` for each row of ``pages`` (page_id, url; others ignored).

    The verdict is the longest fitting rule's; without one, ``block`` where the log odds of naive
    Bayes over the segmented words are above 0, else ``allow`` (so at a tie). Words that nothing taught say
    nothing, so a null, empty or malformed url gets the prior's verdict, ``allow``. Repeated rows
    are judged alike and each keeps its row; names, however long, are split whole in time that grows with
    their length. No rows give no rows.
    """
    spark = pages.sparkSession
    small_batches(spark)
    host, path = host_and_path(F.col("url"))
    urls = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    judge = Rules(rules)
    shipped = Shipped(spark, judge)

    def read(batches):
        fits = shipped.value.judge
        for batch in batches:
            hosts, paths = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            found = [fits(h, p) for h, p in zip(hosts, paths)]
            names = [names_of(h, p) for h, p in zip(hosts, paths)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([r for r, _ in found], pa.string()), pa.array([v for _, v in found], pa.string()), pa.array(names, pa.list_(pa.string()))], ["page_id", "host", "path", "rule", "rule_verdict", "names"])

    base = urls.mapInArrow(read, "page_id long, host string, path string, rule string, rule_verdict string, names array<string>")
    base = stash(base.withColumn("row", F.monotonically_increasing_id()), "urls")
    named = base.select("host", F.explode("names").alias("name")).distinct()
    counts = stash(named.groupBy("name").agg(F.count("*").alias("n")), "names")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    splits = broadcast_if(_splits(counts, Segmenter(labelled, total)).select("name", "parts"), BROADCAST_WORDS)
    # the words of every url in order; a part's place follows its name's
    placed = base.select("row", "host", "rule_verdict", F.posexplode("names").alias("at", "name")).join(splits, "name", "left")
    placed = placed.select("row", "host", "rule_verdict", "at", F.posexplode(F.coalesce("parts", F.array("name"))).alias("part", "word"))
    placed = stash(placed, "words")
    odds = broadcast_if(stash(_odds(placed, labelled, judge.names), "odds"), BROADCAST_WORDS)
    scored = placed.join(odds, "word", "left").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("at", "part", "word", F.coalesce("odds", F.lit(0.0)).alias("odds")))).alias("found"))
    joined = base.join(scored, "row", "left")
    found = F.coalesce("found", F.array().cast("array<struct<at:int,part:int,word:string,odds:double>>"))
    sums = F.aggregate(found, F.lit(math.log(PRIOR_BLOCK / (1 - PRIOR_BLOCK))), lambda s, x: s + x["odds"])
    out = joined.select("page_id", "host", "path", "rule", "rule_verdict", F.transform(found, lambda x: x["word"]).alias("words"), sums.alias("block_odds"))
    verdict = F.coalesce("rule_verdict", F.when(F.col("block_odds") > 0, "block").otherwise("allow"))
    drop(counts)
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "words", "block_odds")


def op1_url_filters(spark, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))
