"""Main text of web pages by consensus of their hosts.

Every page's containers are scored and the page votes for those that hold its main text; hosts count votes
by generalised tag-class paths in Spark, and every page is extracted again from all of its containers
whose paths its host has chosen. Pages are read in one pass that never looks at a character again,
so time grows with a page's length, whatever its marks.
"""

from __future__ import annotations

import html
import re
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import broadcast_if, small_batches, stash
from .url_filter import host_and_path

#: Elements that nest and name a path.
CONTAINERS = frozenset("html body main article section div td th tr tbody table ul ol dl blockquote figure details center fieldset".split())
#: Elements whose text is never main text.
DROPPED = frozenset("nav footer aside form button select option label noscript svg canvas object video audio iframe menu dialog template head".split())
#: Elements whose content is not markup.
RAW = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I) for name in ("script", "style", "textarea", "title", "xmp", "noembed", "noframes")}
#: Elements that end a block of text.
BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre br hr address caption figcaption summary header hgroup".split())
HEADINGS = frozenset("h1 h2 h3".split())
VOID = frozenset("br hr img input meta link area base col embed source track wbr".split())
#: Words of class, id and role that mark menus, headers, footers, sidebars, notices, adverts, forms and comments.
MARKED = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promoted cookie cookies consent notice notices alert popup modal overlay newsletter subscribe sidebar widget menu nav navbar navigation breadcrumb breadcrumbs masthead footer comment comments disqus respond reply replies share sharing social related recommended login signup complementary contentinfo search toolbar topbar menubar rail toc pagination pager gdpr copyright colophon hidden".split()
)
#: Words that tell of a layout around such elements; what bears one is not itself marked.
LAYOUT = frozenset("has with without no layout".split())
#: A header of the site and not of an article bears no other words than these.
SITE_HEADER = frozenset("header site page main global top sticky fixed inner wrap wrapper container".split())
#: Words of a header that belongs to an article.
ARTICLE_HEADER = frozenset("entry post article story title".split())
PAGE_LEVEL = frozenset(("", "html", "body"))
#: Share of a page's unlinked text that a container must hold to stand for it, and share that articles must hold.
NEARLY_ALL, ARTICLES = 0.9, 0.5
#: Hosts whose chosen paths are broadcast, some 100 bytes each; more are joined by shuffling.
BROADCAST_HOSTS = 100_000
#: Paths that a task counts before it passes its counts on.
FLUSH = 100_000

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_STOP = re.compile(r"""[>"']""")
_ATTRIBUTE = re.compile(r"""([^\s=>"'/]+)(?:\s*=\s*("[^"]*"|'[^']*'|\S+))?""")
_LETTERS = re.compile(r"[a-z]+")


def _attributes(text: str) -> tuple[str, bool, list[str]]:
    """Generalised class (letters only, sorted), whether the element is marked as not main text, and its words."""
    name, marked, all_words = "", False, []
    if not text or text.isspace():
        return name, marked, all_words
    for key, value in _ATTRIBUTE.findall(text):
        key, value = key.lower(), value.strip("\"'").lower()
        if key in ("class", "id", "role"):
            words = _LETTERS.findall(value)
            all_words += words
            marked = marked or (not MARKED.isdisjoint(words) and LAYOUT.isdisjoint(words)) or ("header" in words and SITE_HEADER.issuperset(words))
            if key == "class":
                name = ".".join(sorted(set(words)))
        elif key == "style":
            marked = marked or "display:none" in value.replace(" ", "")
        elif key == "hidden" or (key == "aria-hidden" and value == "true"):
            marked = True
    return name, marked, all_words


def tokens(page: str):
    """(text before, closing, element, attributes) of each tag in order, and at last (text, False, "", ""); comments and raw content go."""
    at, last_end, last = 0, page.rfind(">"), {q: page.rfind(q) for q in "\"'"}
    pending = []
    while True:
        start = page.find("<", at)
        if start < 0 or start > last_end:
            if start >= 0 and page.startswith("<!--", start):
                pending.append(page[at:start])
                at = len(page)
            break
        if page.startswith("<!--", start):
            pending.append(page[at:start])
            if page.startswith((">", "->"), start + 4):  # an empty comment
                at = page.index(">", start) + 1
                continue
            end = _COMMENT_END.search(page, start + 4)
            at = end.end() if end else len(page)
            continue
        closing = page.startswith("/", start + 1)
        m = _NAME.match(page, start + 1 + closing)
        if m is None:
            if page.startswith(("!", "?", "/"), start + 1):
                pending.append(page[at:start])
                at = page.index(">", start) + 1
            else:
                pending.append(page[at : start + 1])
                at = start + 1
            continue
        end = m.end()
        while (stop := _STOP.search(page, end)) is not None and stop[0] != ">":
            end = stop.end()
            if end <= last[stop[0]] and page[max(m.end(), end - 64) : end - 1].rstrip().endswith("="):
                end = page.index(stop[0], end) + 1  # of a quoted value
        if stop is None:
            # the last > of the page lies in a quoted value
            pending.append(page[at:start])
            at = len(page)
            break
        pending.append(page[at:start])
        name, at = m[0].lower(), stop.end()
        yield "".join(pending), closing, name, page[m.end() : stop.start()]
        pending = []
        if name in RAW and not closing:
            raw_end = RAW[name].search(page, at)
            at = raw_end.end() if raw_end else len(page)
    pending.append(page[at:])
    yield "".join(pending), False, "", ""


_COMMENT_END = re.compile(r"--!?>")


class Page:
    """Blocks of text, and the tree of generalised paths that they are in.

    ``blocks`` has (path, text, characters in links) in page order; path i is ``label[i]`` below path
    ``up[i] < i``, and ``key[i]`` names it, 64 bits that depend on its labels from the root. A page of which marks leave nothing
    is read without regard to them.
    """

    def __init__(self, page: str):
        self._read(page, True)
        if not self.blocks:
            self._read(page, False)

    def _child(self, path: int, label: str) -> int:
        found = self._ids.get((path, label))
        if found is None:
            found = self._ids[path, label] = len(self.up)
            self.up.append(path)
            self.label.append(label)
            self.key.append(_key(self.key[path], label))
        return found

    def _read(self, page: str, heed: bool) -> None:
        self.up, self.label, self.key, self._ids = [0], [""], [0], {}
        self.blocks: list[tuple[int, str, int]] = []
        self.headed: set[int] = set()  # paths with a heading
        # element, path, dropped, inside an article, elements of that name within an inline one
        stack: list[list] = [["", 0, False, False, 0]]
        open_: dict[str, int] = {}
        parts: list[str] = []  # of the present block, without what is dropped
        links, link, heading, off = 0, False, False, False

        def flush():
            nonlocal links
            if parts:
                text = " ".join("".join(parts).split())
                if text:
                    self.blocks.append((stack[-1][1], text, min(links, len(text))))
                    if heading:
                        self.headed.add(stack[-1][1])
                parts.clear()
                links = 0

        def close(name: str):
            while True:
                gone = stack.pop()[0]
                open_[gone] -= 1
                if gone == name:
                    break

        def push(name: str, path: int, dropped: bool, inside: bool):
            stack.append([name, path, dropped, inside, 0])
            open_[name] = open_.get(name, 0) + 1

        for raw, closing, name, rest in tokens(page):
            if raw and not stack[-1][2] and not off:
                decoded = html.unescape(raw) if "&" in raw else raw
                parts.append(decoded)
                if link:
                    links += len(decoded.strip())
            tracked = name in CONTAINERS or name in DROPPED or name == "header"
            if tracked or name in BLOCKS or not name:
                flush()
                heading = not closing and name in HEADINGS
                off = off and name in ("br", "hr")
                if open_.get("head") and not closing and name in CONTAINERS | BLOCKS:
                    close("head")
            if name == "a":
                link = not closing
            top = stack[-1]
            if closing:
                if top[0] == name and top[4]:
                    top[4] -= 1
                elif open_.get(name):
                    close(name)
                    link = link and not tracked
            elif name and name not in VOID and not (name == "svg" and rest.endswith("/")):
                label, marked, words = _attributes(rest)
                marked, inside = marked and heed, top[3]
                if tracked:
                    site = name == "header" and not inside and ARTICLE_HEADER.isdisjoint(words)
                    dropped = top[2] or name in DROPPED or site or (marked and name not in ("html", "body", "article", "main"))
                    path = top[1] if name == "header" or dropped else self._child(top[1], name + (f".{label}" if label else ""))
                    push(name, path, dropped, inside or name in ("article", "main"))
                elif marked and name in BLOCKS:
                    off = True
                elif marked:  # inline: what follows goes, up to its end tag or its container's
                    push(name, top[1], True, inside)
                elif top[0] == name:
                    top[4] += 1

    def totals(self) -> list[int]:
        """Unlinked characters below each path; all characters where the page has links only."""
        for weight in (2, 0):
            out = [0] * len(self.up)
            for path, text, linked in self.blocks:
                out[path] += max(0, len(text) - weight * linked)
            for i in range(len(out) - 1, 0, -1):
                out[self.up[i]] += out[i]
            if out[0]:
                break
        return out

    def elected(self) -> set[int]:
        """Keys of the paths that the page votes for.

        The topmost articles, where they hold ARTICLES of the unlinked text. Else the lowest container that holds NEARLY_ALL
        of it and leaves out no heading; where that is the page itself, all containers right below it, and its own text.
        """
        total = self.totals()
        if not total[0]:
            return set()
        articles = [False] * len(self.up)
        top = []
        for i in range(1, len(self.up)):
            articles[i] = articles[self.up[i]] or self.label[i].partition(".")[0] in ("article", "main")
            if articles[i] and not articles[self.up[i]] and total[i]:
                top.append(i)
        if sum(total[i] for i in top) >= ARTICLES * total[0]:
            return {self.key[i] for i in top}
        headings, heaviest = [0] * len(self.up), [0] * len(self.up)
        for i in range(len(self.up) - 1, -1, -1):
            headings[i] += i in self.headed
            if i:
                headings[self.up[i]] += headings[i]
                if not heaviest[self.up[i]] or total[i] >= total[heaviest[self.up[i]]]:
                    heaviest[self.up[i]] = i
        at = 0
        while (down := heaviest[at]) and total[down] >= NEARLY_ALL * total[0] and headings[down] == headings[0]:
            at = down
        if self.label[at].partition(".")[0] not in PAGE_LEVEL:
            return {self.key[at]}
        own = {_key(self.key[at], "#")} if any(path == at for path, _, _ in self.blocks) else set()
        return own | {self.key[i] for i in range(1, len(self.up)) if self.up[i] == at and total[i]}

    def seen(self) -> set[int]:
        """Keys of all paths with text, and of paths with text of their own."""
        full = [False] * len(self.up)
        for path, _, _ in self.blocks:
            full[path] = True
        own = {_key(self.key[i], "#") for i, x in enumerate(full) if x}
        for i in range(len(full) - 1, 0, -1):
            full[self.up[i]] |= full[i]
        return own | {self.key[i] for i, x in enumerate(full) if x}

    def take(self, chosen: set[int]) -> tuple[str, str | None]:
        """Text of all blocks below a chosen path, and the first such path in page order."""
        taken, first = [False] * len(self.up), None
        for i in range(len(self.up)):
            taken[i] = self.key[i] in chosen or (i > 0 and taken[self.up[i]])
        out = []
        for path, text, _ in self.blocks:
            if taken[path] or _key(self.key[path], "#") in chosen:
                out.append(text)
                first = path if first is None else first
        while first and taken[self.up[first]]:
            first = self.up[first]
        return " ".join(out), None if first is None else self.path(first)

    def path(self, i: int) -> str:
        labels = []
        while i:
            labels.append(self.label[i])
            i = self.up[i]
        return "".join(f">{x}" for x in reversed(labels))


def _key(above: int, label: str) -> int:
    """64 bits that name a path by the key above it and its own label."""
    return int.from_bytes(blake2b(above.to_bytes(8, "little", signed=True) + label.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def main_text(page: str | None, chosen: list[int] | None = None) -> tuple[str, str | None]:
    """Text and its first path: from the containers that the host has chosen, or else from those that the page elects."""
    read = Page(page or "")
    found = read.take(set(chosen)) if chosen else ("", None)
    return found if found[0] else read.take(read.elected())


def host_paths(pages: DataFrame) -> DataFrame:
    """``host, chosen``: keys of the paths that two pages or more vote for and half of the pages that have them, of (host, html)."""

    def vote(batches):
        counts: dict[tuple, list[int]] = {}

        def out():
            keys = list(counts)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64()), pa.array([counts[k][0] for k in keys], pa.int64()), pa.array([counts[k][1] for k in keys], pa.int64())], ["host", "key", "votes", "seen"])
            counts.clear()

        for batch in batches:
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1)):
                read = Page(page.as_py() or "")
                elected = read.elected()
                for key in read.seen():
                    x = counts.setdefault((host, key), [0, 0])
                    x[0] += key in elected
                    x[1] += 1
                if len(counts) > FLUSH:
                    yield from out()
        yield from out()

    votes = pages.select("host", "html").mapInArrow(vote, "host string, key long, votes long, seen long")
    votes = votes.groupBy("host", "key").agg(F.sum("votes").alias("votes"), F.sum("seen").alias("seen"))
    return votes.where("votes > 1 AND 2 * votes >= seen").groupBy("host").agg(F.collect_list("key").alias("chosen"))


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars, path`` for each row of ``pages`` (page_id, url, html; others ignored).

    A null or empty html, and one without main text, give an empty text, n_chars 0 and a null path. A
    null or malformed url counts as the host ''. A page that has none of its host's chosen paths is
    extracted from the containers that it elects itself; path is the first container that was taken. Repeated rows vote and are extracted each; a tied vote
    is for the path. Pages are read whole, in time that grows with their length, and no rows give no rows.
    """
    small_batches(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host_and_path(F.col("url"))[0].alias("host"), "html")
    chosen = broadcast_if(stash(host_paths(rows), "chosen"), BROADCAST_HOSTS)

    def run(batches):
        for batch in batches:
            found = [main_text(page.as_py(), keys.as_py()) for page, keys in zip(batch.column(2), batch.column(3))]
            texts = [t for t, _ in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array([p for _, p in found], pa.string())], ["page_id", "url", "text", "n_chars", "path"])

    joined = rows.join(chosen, "host", "left").select("page_id", "url", "html", "chosen")
    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long, path string")


def op6_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
