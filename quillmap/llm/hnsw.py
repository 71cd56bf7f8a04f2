"""Embedding near-duplicates through a hierarchical navigable small-world graph of pivots, and one per large shard.

Exact copies collapse first. A bounded sample of vectors are pivots, and their graph leads every vector to the
pivot nearest to it, its home, and to the others that are nearer than a margin allows. The vectors of one home are a shard, or
several of bounded bytes, and every vector queries its home's and those of the others. The margin is widened until sampled
queries, compared with all vectors, and pairs drawn at the linking angle itself have enough of their links in what they query.

In a shard vectors gather in balls of half the linking angle around hubs, so that all of a ball are linked.
A graph leads to the hubs; in a shard of up to FLAT vectors its lowest level holds them all. The angle to a hub bounds
those to its ball, and only members that the bounds leave open are compared; so a group of near copies costs its size
and not its square. A query's answer is the number of vectors that it links with and one edge for each class of the shard's own.

Every task with a graph audits itself: some of its own queries are compared with the whole shard, and the beam is widened until
enough of their links are found; if no beam does it, the task compares its queries with all hubs. In the end the links found
of the sampled queries are held against all that they have.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .store import Shipped, drop, small_batches, stash

#: Neighbours of a vector on each upper level; twice as many on the lowest.
LINKS = 12
#: Bytes of a shard's vectors and links and of a task's queries at most; vectors up to which a shard needs no graph.
SHARD_BYTES, QUERY_BYTES, FLAT = 96 << 20, 48 << 20, 1 << 15
#: Vectors of a home on average at least; bytes of the sample that pivots come from, and of the queries compared with all vectors, at most.
HOME_ROWS, PIVOT_BYTES, SAMPLE_BYTES = 2048, 16 << 20, 4 << 20
#: Pivots that a vector's search holds at first; rows that are sent to shards at a time, for each vector and at least.
PIVOT_BEAM, SENT, LEAST_SENT = 32, 1.5, 1_000_000
#: Beam at first; mean recall over the audited queries with links to others that ends its widening, with few links and with many apart.
FIRST_BEAM, AUDIT_RECALL, LEAST_RECALL = 24, 0.995, 0.9
#: Links up to which a query has few; queries of either kind that an audit looks for, and queries that it compares at most.
FEW_LINKS, AUDITS, MOST_AUDITED = 64, 64, 1024
#: Angles in radians that rounding can hide.
_EPS = 1e-6
_BLOCK = 512


class Graph:
    """Unit vectors ``x``, their level-wise neighbours (-1: none), entry point and beam."""

    def __init__(self, x: np.ndarray, seed: int = 5, flat: bool = False):
        self.x = np.ascontiguousarray(x, np.float32)
        self.beam, self.entry, n = FIRST_BEAM, -1, len(x)
        self.dense = flat  # compare with everything
        if flat:
            return
        draws = np.random.default_rng(seed).random(n)
        self.level = np.minimum((-np.log(np.maximum(draws, 1e-12)) / math.log(LINKS)).astype(np.int64), 6)
        top = int(self.level.max(initial=0))
        self.links = [np.full((n, LINKS * (2 if lv == 0 else 1)), -1, np.int32) for lv in range(top + 1)]
        order = np.argsort(-self.level, kind="stable")
        at = 0
        while at < n:
            batch = order[at : at + max(32, min(at // 2, _BLOCK))]
            self._insert(batch)
            at += len(batch)

    def _insert(self, batch: np.ndarray) -> None:
        x = self.x[batch]
        mutual = x @ x.T
        np.fill_diagonal(mutual, -2)
        found = [(np.empty((len(batch), 0), np.int32), np.empty((len(batch), 0), np.float32))] * len(self.links)
        if self.entry >= 0:
            start = np.full(len(batch), self.entry)
            for lv in range(len(self.links) - 1, -1, -1):
                ids, sims = self._search(x, start, lv, 2 * LINKS if lv else 3 * LINKS)
                found[lv] = ids, sims
                start = ids[:, 0]
        else:
            self.entry = int(batch[0])
        for lv in range(len(self.links)):
            here = np.flatnonzero(self.level[batch] >= lv)
            if not len(here):
                continue
            ids, sims = found[lv][0][here], found[lv][1][here]
            near = mutual[np.ix_(here, here)]
            keep = min(2 * LINKS, len(here))
            peers = np.argpartition(-near, keep - 1, axis=1)[:, :keep]
            ids = np.concatenate([ids, batch[here][peers].astype(np.int32)], 1)
            sims = np.concatenate([sims, np.take_along_axis(near, peers, 1)], 1)
            chosen = self._diverse(ids, sims, LINKS)
            self.links[lv][batch[here], :LINKS] = chosen
            self._link_back(batch[here], chosen, lv)

    def _diverse(self, ids: np.ndarray, sims: np.ndarray, keep: int) -> np.ndarray:
        """Nearest candidates that are nearer to their vector than to one chosen before; then the nearest others."""
        sims = np.where(ids >= 0, sims, -2)
        order = np.argsort(-sims, axis=1, kind="stable")[:, : 3 * keep]
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        v = self.x[ids]
        cross = np.einsum("aid,ajd->aij", v, v, optimize=True)
        n, m = ids.shape
        taken, count = np.zeros((n, m), bool), np.zeros(n, np.int64)
        for j in range(m):
            blocked = (taken[:, :j] & (cross[:, j, :j] > sims[:, j, None])).any(axis=1) if j else np.zeros(n, bool)
            ok = ~blocked & (count < keep) & (sims[:, j] > -2)
            taken[:, j] = ok
            count += ok
        rank = np.where(taken, 0, 1) * 10.0 - sims + np.where(sims > -2, 0, 100)
        best = np.argsort(rank, axis=1, kind="stable")[:, :keep]
        out = np.where(np.take_along_axis(sims, best, 1) > -2, np.take_along_axis(ids, best, 1), -1)
        if out.shape[1] < keep:
            out = np.pad(out, ((0, 0), (0, keep - out.shape[1])), constant_values=-1)
        return out

    def _link_back(self, nodes: np.ndarray, chosen: np.ndarray, lv: int) -> None:
        """Reverse links; a vector with too many keeps a diverse choice."""
        table = self.links[lv]
        source, target = np.repeat(nodes, chosen.shape[1]), chosen.ravel()
        ok = target >= 0
        source, target = source[ok].astype(np.int32), target[ok]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        hit, first, size = np.unique(target, return_index=True, return_counts=True)
        most = int(size.max(initial=0))
        if not most:
            return
        new = np.full((len(hit), most), -1, np.int32)
        new[np.repeat(np.arange(len(hit)), size), np.arange(len(target)) - np.repeat(first, size)] = source
        both = np.concatenate([table[hit], new], 1)
        both = np.sort(both, axis=1)[:, ::-1]
        both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
        full = (both >= 0).sum(1) > table.shape[1]
        simple = np.sort(both[~full], axis=1)[:, ::-1][:, : table.shape[1]]
        table[hit[~full], : simple.shape[1]] = simple
        for i in range(0, int(full.sum()), _BLOCK):
            part = np.flatnonzero(full)[i : i + _BLOCK]
            ids = both[part]
            sims = np.einsum("aid,ad->ai", self.x[ids], self.x[hit[part]], optimize=True)
            if ids.shape[1] > 4 * table.shape[1]:  # nearest first; the rest could not be chosen
                near = np.argsort(-np.where(ids >= 0, sims, -2), axis=1, kind="stable")[:, : 4 * table.shape[1]]
                ids, sims = np.take_along_axis(ids, near, 1), np.take_along_axis(sims, near, 1)
            table[hit[part]] = self._diverse(ids, sims, table.shape[1])

    def _search(self, q: np.ndarray, start: np.ndarray, lv: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Best-first search of all queries in step: ids and similarities, best first, -1 where there are fewer."""
        table, n, k = self.links[lv], len(q), min(4, beam)
        seen = np.zeros((n, len(self.x)), bool)
        rows = np.arange(n)
        seen[rows, start] = True
        ids = np.full((n, beam), -1, np.int32)
        sims = np.full((n, beam), -2, np.float32)
        open_ = np.zeros((n, beam), bool)
        ids[:, 0], sims[:, 0], open_[:, 0] = start, np.einsum("ad,ad->a", self.x[start], q), True
        live = rows
        while len(live):
            s = np.where(open_[live], sims[live], -3)
            pick = np.argsort(-s, axis=1)[:, :k]
            go = np.take_along_axis(s, pick, 1) > -3
            open_[live[:, None], pick] &= ~go
            near = np.where(go[:, :, None], table[np.take_along_axis(ids[live], pick, 1)], -1).reshape(len(live), -1)
            fresh = (near >= 0) & ~seen[live[:, None], near]
            r, c = np.nonzero(fresh)
            node = near[r, c]
            code = np.unique(r * np.int64(len(self.x)) + node)
            r, node = code // len(self.x), code % len(self.x)
            seen[live[r], node] = True
            value = np.einsum("ad,ad->a", self.x[node], q[live[r]])
            width = np.bincount(r, minlength=len(live))
            place = np.arange(len(r)) - np.repeat(np.cumsum(width) - width, width)
            w = int(width.max(initial=0))
            more_ids = np.full((len(live), w), -1, np.int32)
            more_sims = np.full((len(live), w), -2, np.float32)
            more_ids[r, place], more_sims[r, place] = node, value
            all_ids, all_sims = np.concatenate([ids[live], more_ids], 1), np.concatenate([sims[live], more_sims], 1)
            all_open = np.concatenate([open_[live], more_sims > -2], 1)
            best = np.argsort(-all_sims, axis=1, kind="stable")[:, :beam]
            ids[live], sims[live] = np.take_along_axis(all_ids, best, 1), np.take_along_axis(all_sims, best, 1)
            open_[live] = np.take_along_axis(all_open, best, 1)
            live = live[open_[live].any(axis=1)]
        return ids, sims

    def nearest(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and similarities of the ``beam`` nearest that the graph leads to, best first, -1 where there are fewer."""
        ids, sims = [np.empty((0, beam), np.int32)], [np.empty((0, beam), np.float32)]
        for a in range(0, len(q), block := _step(len(self.x))):
            part = np.ascontiguousarray(q[a : a + block], np.float32)
            start = np.full(len(part), self.entry)
            for lv in range(len(self.links) - 1, 0, -1):
                start = self._search(part, start, lv, 4)[0][:, 0]
            for out, found in zip((ids, sims), self._search(part, start, 0, beam)):
                out.append(found)
        return np.concatenate(ids), np.concatenate(sims)

    def near(self, q: np.ndarray, least: float, beam: int | None = None):
        """(query, vector) arrays of all similarities of ``least`` or more that the graph leads to.

        A beam search on each level, then everything near enough is followed until it leads to no more.
        """
        beam = beam or self.beam
        rows, nodes = [], []
        block = _step(len(self.x))
        for a in range(0, len(q), block):
            part = np.ascontiguousarray(q[a : a + block], np.float32)
            if self.dense:
                r, node = np.nonzero(part @ self.x.T >= least)
                rows.append(r + a)
                nodes.append(node)
                continue
            start = np.full(len(part), self.entry)
            for lv in range(len(self.links) - 1, 0, -1):
                start = self._search(part, start, lv, 4)[0][:, 0]
            ids, sims = self._search(part, start, 0, min(beam, len(self.x)))
            seen = np.zeros((len(part), len(self.x)), bool)
            r, c = np.nonzero(sims >= least)
            r, node = r, ids[r, c]
            seen[r, node] = True
            while len(r):
                rows.append(r + a)
                nodes.append(node)
                near = self.links[0][node]
                back = np.repeat(r, near.shape[1])
                near = near.ravel()
                ok = (near >= 0) & ~seen[back, near]
                code = np.unique(back[ok] * np.int64(len(self.x)) + near[ok])
                r, node = code // len(self.x), code % len(self.x)
                seen[r, node] = True
                ok = np.einsum("ad,ad->a", self.x[node], part[r]) >= least
                r, node = r[ok], node[ok]
        if not rows:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate(rows).astype(np.int64), np.concatenate(nodes).astype(np.int64)


def _classes(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest member of each of n nodes' classes under edges (a, b)."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _units(raw: np.ndarray) -> np.ndarray:
    """Rows as unit vectors in double precision; scaled first, so that squares neither overflow nor vanish."""
    x = raw.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 1), np.float32)


FOUND = "vec_id long, other long, n long, recall double"


def _step(n: int) -> int:
    """Queries at a time against n vectors, so that what they mark and find is bounded."""
    return max(16, min(_BLOCK, (1 << 24) // max(1, n)))


class Shard:
    """Vectors in balls around hubs, and a graph of the hubs.

    ``x`` are unit vectors in double precision, ``hubs`` the places of the hubs in it and ``hub_of`` each vector's
    hub by its place in ``hubs``.
    """

    def __init__(self, ids: np.ndarray, copies: np.ndarray, x: np.ndarray, least: float, flat: bool = False):
        self.ids, self.copies, self.x = ids, copies, x
        everything = Graph(x, flat=flat)
        self.hub_of, hubs = np.full(len(x), -1), []
        ball = math.cos(math.acos(least) / 2 - _EPS)
        order, at, size = np.random.default_rng(11).permutation(len(x)), 0, 32
        while at < len(order):
            block = order[at : at + size]
            at += len(block)
            block = block[self.hub_of[block] < 0]
            a, b = everything.near(x[block], ball)
            first = np.searchsorted(a := a[by := np.argsort(a, kind="stable")], np.arange(len(block) + 1))
            b = b[by]
            for k, i in enumerate(block):
                if self.hub_of[i] < 0:
                    near = b[first[k] : first[k + 1]]
                    near = near[self.hub_of[near] < 0]
                    near = near[x[near] @ x[i] >= ball]
                    self.hub_of[near] = self.hub_of[i] = len(hubs)
                    hubs.append(i)
            size = min(512, 2 * size) if len(a) <= 8 * len(block) else 32
        self.hubs = np.array(hubs, np.int64)
        self.graph = everything if len(hubs) == len(x) and (self.hubs == np.arange(len(x))).all() else Graph(x[self.hubs], flat=flat)
        self._arrange(least)
        self.label = np.empty(0, np.int64)
        label = self.hubs[self.hub_of]
        for i in range(0, len(x), step := _step(len(self.hubs))):
            q, balls, _, linked = self._reach(x[i : i + step])
            pairs = np.unique(np.column_stack([label[q[linked] + i], label[self.hubs[balls[linked]]]]), axis=0)
            if len(pairs):
                label = _classes(pairs[:, 0], pairs[:, 1], len(x))[label]
        self.label = label

    def _arrange(self, least: float) -> None:
        """Members by hub and angle to it; the copies up to each."""
        self.least, self.angle = least, math.acos(least)
        theta = np.arccos(np.clip(np.einsum("ad,ad->a", self.x, self.x[self.hubs[self.hub_of]]), -1, 1))
        self.member = np.lexsort((theta, self.hub_of))
        # an angle is below 4, so that one sorted array serves all balls
        self.place = self.hub_of[self.member] * 8.0 + theta[self.member]
        self.first = np.searchsorted(self.hub_of[self.member], np.arange(len(self.hubs) + 1))
        self.upto = np.concatenate([[0], np.cumsum(self.copies[self.member])])

    def _reach(self, q: np.ndarray):
        """(query, ball, copies linked, whether any member is) of each ball that a query may link into."""
        a, h = self.graph.near(q, math.cos(min(math.pi, 1.5 * self.angle)) - 1e-4)
        ang = np.empty(len(a))
        for i in range(0, len(a), 1 << 15):
            part = slice(i, i + (1 << 15))
            ang[part] = np.arccos(np.clip(np.einsum("ad,ad->a", q[a[part]], self.x[self.hubs[h[part]]]), -1, 1))
        sure = np.searchsorted(self.place, h * 8.0 + np.clip(self.angle - ang - _EPS, -1, 4), side="right")
        sure = np.maximum(sure, self.first[h])
        open_ = np.maximum(np.searchsorted(self.place, h * 8.0 + np.clip(ang - self.angle - _EPS, -1, 4)), sure)
        end = self.first[h + 1]
        n = (self.upto[sure] - self.upto[self.first[h]]).astype(np.int64)
        some = sure > self.first[h]
        width = np.maximum(end - open_, 0)
        upto, lo = np.cumsum(width), 0
        while lo < len(a):
            hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + (1 << 17), side="right")))
            w = width[lo:hi]
            pair = np.repeat(np.arange(lo, hi), w)
            m = self.member[open_[pair] + np.arange(len(pair)) - np.repeat(np.cumsum(w) - w, w)]
            ok = np.empty(len(pair), bool)
            for i in range(0, len(pair), 1 << 15):
                part = slice(i, i + (1 << 15))
                ok[part] = np.einsum("ad,ad->a", q[a[pair[part]]], self.x[m[part]]) >= self.least
            n[lo:hi] += np.bincount(pair[ok] - lo, weights=self.copies[m[ok]], minlength=hi - lo).astype(np.int64)
            some[pair[ok]] = True
            lo = hi
        return a, h, n, some

    def ask(self, ids: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Copies that each query links with, without itself, and (query, class) of its links."""
        low, high = (np.searchsorted(self.ids, ids, side=x) for x in ("left", "right"))
        n, heads = np.zeros(len(q), np.int64), []
        for i in range(0, len(q), step := _step(len(self.hubs))):
            part = slice(i, i + step)
            a, h, many, some = self._reach(q[part])
            np.add.at(n, a[some] + i, many[some])
            # vectors of a query's own id, where they were reached
            w = high[part] - low[part]
            mine = np.repeat(np.arange(len(w)), w)
            there = low[part][mine] + np.arange(len(mine)) - np.repeat(np.cumsum(w) - w, w)
            met = np.isin(mine * len(self.hubs) + self.hub_of[there], a * len(self.hubs) + h) & (np.einsum("ad,ad->a", q[part][mine], self.x[there]) >= self.least)
            np.subtract.at(n, mine[met] + i, self.copies[there[met]])
            heads.append(np.unique(np.column_stack([a[some] + i, self.label[self.hubs[h[some]]]]), axis=0))
        return n, np.concatenate(heads) if heads else np.empty((0, 2), np.int64)

    def audit(self, ids: np.ndarray, q: np.ndarray) -> float:
        """Widen the beam until sampled queries find AUDIT_RECALL of their links to others; the recall in the end.

        Recall is the mean over queries with links, the lesser of that of queries with few and of those
        with many. The sample is as large as it takes to have AUDITS of each, if MOST_AUDITED hold them.
        """
        order, found = np.random.default_rng(7).permutation(len(q))[:MOST_AUDITED], []
        for i in range(0, len(order), 64):
            part = order[i : i + 64]
            hit = q[part] @ self.x.T >= self.least
            hit &= ids[part][:, None] != self.ids[None, :]
            found.append(np.column_stack([part, hit @ self.copies]))
            links = np.concatenate(found)[:, 1]
            if min(((links > 0) & (links <= FEW_LINKS)).sum(), (links > FEW_LINKS).sum()) >= AUDITS:
                break
        found = np.concatenate(found) if found else np.empty((0, 2), np.int64)
        found = found[found[:, 1] > 0]
        while True:
            recall = _recalls(self.ask(ids[found[:, 0]], q[found[:, 0]])[0], found[:, 1])
            if recall >= AUDIT_RECALL or self.graph.dense:
                return recall
            self.graph.beam *= 2
            self.graph.dense = self.graph.beam >= len(self.hubs)


def _recalls(found: np.ndarray, links: np.ndarray) -> float:
    """Mean share of ``links`` found, of queries that have any; the lesser of that of queries with few and of those with many."""
    strata = [x for x in ((links > 0) & (links <= FEW_LINKS), links > FEW_LINKS) if x.any()]
    return min((float(np.minimum(found[x] / links[x], 1.0).mean()) for x in strata), default=1.0)


class Router:
    """A graph of ``pivots`` that no angle up to the linking one joins.

    A vector's home is the pivot nearest to it, and it asks those that are less near by ``margin`` at most, of the
    ``beam`` nearest. Both start so that ``q``, none of them a pivot, meet vectors at the linking angle in random directions.
    """

    def __init__(self, sample: np.ndarray, pivots: int, q: np.ndarray, least: float):
        x, chosen = sample.astype(np.float32), []
        free = np.ones(len(x), bool)
        for i in range(len(x)):
            if free[i] and len(chosen) < pivots:
                chosen.append(i)
                free &= x @ x[i] < least
        self.graph, self.beam, self.margin = Graph(sample[chosen]), min(PIVOT_BEAM, len(chosen)), 0.0
        turn = np.random.default_rng(13).normal(size=q.shape)
        turn -= np.einsum("ad,ad->a", q, turn)[:, None] * q
        turn /= np.maximum(np.sqrt((turn * turn).sum(axis=1, keepdims=True)), 1e-9)
        one = np.ones(len(q))
        self.widen(q, np.arange(len(q)), self.homes(least * q + math.sqrt(max(0.0, 1 - least * least)) * turn), one, one)

    def homes(self, x: np.ndarray) -> np.ndarray:
        return self.graph.nearest(x, self.beam)[0][:, 0]

    def asks(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pivots (n, beam) near each query, its home first, and which of them it asks."""
        ids, sims = self.graph.nearest(q, self.beam)
        return ids, (ids >= 0) & (sims >= sims[:, :1] - self.margin)

    def widen(self, q: np.ndarray, of: np.ndarray, homes: np.ndarray, copies: np.ndarray, links: np.ndarray) -> None:
        """Widen margin and beam until queries ask the homes of AUDIT_RECALL of their ``links``: ``copies`` of query ``of`` at ``homes``."""
        while len(of):
            ids, asked = self.asks(q)
            met = ((ids[of] == homes[:, None]) & asked[of]).any(axis=1)
            if _recalls(np.bincount(of, weights=copies * met, minlength=len(q)), links) >= AUDIT_RECALL or (self.margin > 2 and self.beam == len(self.graph.x)):
                return
            if self.margin > 2 or asked[:, -1].mean() > 0.02:  # the beam ends before the margin does
                self.beam = min(2 * self.beam, len(self.graph.x))
            self.margin = max(0.01, 1.15 * self.margin)


def _fine(batches, kind: str):
    """``vec_id, vector``: vectors that can link, without negative zeros, and null for the others."""
    for batch in batches:
        v = batch.column(1)
        size = np.where(v.is_valid().to_numpy(zero_copy_only=False), v.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), 0)
        x = v.flatten().cast(pa.float32() if kind == "float" else pa.float64()).to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(size)])
        odd, some = (np.concatenate([[0], np.cumsum(flag)])[ends] for flag in (~np.isfinite(x), x != 0))
        fine = (size > 0) & (np.diff(odd) == 0) & (np.diff(some) > 0) & batch.column(0).is_valid().to_numpy(zero_copy_only=False)
        kept = pa.array(x[np.repeat(fine, size)] + x.dtype.type(0))
        offsets = np.concatenate([[0], np.cumsum(size * fine)]).astype(np.int32)
        # a null's offset is its row's
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets, mask=np.append(~fine, False)), kept)], ["vec_id", "vector"])


def _ask(queries: pa.Table, members: pa.Table, least: float) -> pa.Table:
    """Of each query, an edge to each class of the shard that it links into, and its number of links there; and the audit's recall."""
    vec, other, many, recall = [], [], [], []
    if members.num_rows and queries.num_rows:
        order = np.argsort(members.column("vec_id").to_numpy(), kind="stable")
        ids, copies, x = members.column("vec_id").to_numpy()[order], members.column("copies").to_numpy()[order], _units(_matrix(members.column("vector"))[order])
        s, mine, q = Shard(ids, copies, x, least, len(ids) <= FLAT), queries.column("vec_id").to_numpy(), _units(_matrix(queries.column("vector")))
        if not s.graph.dense:
            recall.append(s.audit(mine, q))
        n, heads = s.ask(mine, q)
        hit = np.flatnonzero(n)
        vec, many = [mine[heads[:, 0]], mine[hit]], [np.zeros(len(heads), np.int64), n[hit]]
        other = [pa.array(s.ids[heads[:, 1]]), pa.nulls(len(hit), pa.int64())]
    join = lambda x: np.concatenate(x) if x else np.empty(0, np.int64)
    rows = pa.table([pa.array(join(vec)), pa.chunked_array(other, pa.int64()), pa.array(join(many)), pa.nulls(sum(map(len, vec)), pa.float64())], ["vec_id", "other", "n", "recall"])
    audits = pa.table([pa.nulls(len(recall), pa.int64()), pa.nulls(len(recall), pa.int64()), pa.array([0] * len(recall), pa.int64()), pa.array(recall, pa.float64())], rows.column_names)
    return pa.concat_tables([rows, audits])


def _route(part: DataFrame, n: int, width: int, least: float) -> tuple[Router, np.ndarray, np.ndarray]:
    """A router for the ``n`` rows of ``part``; ids of queries compared with all of them, and their numbers of links."""
    spark = part.sparkSession
    pivots = max(1, min(int(3 * math.cbrt(n)), n // HOME_ROWS, PIVOT_BYTES // (2 * width)))
    most = max(1, min(MOST_AUDITED // 2, SAMPLE_BYTES // width, n // 2))
    sample = part.select("vec_id", "vector", F.xxhash64("vec_id", F.lit(7)).alias("order")).orderBy("order", "vec_id").limit(2 * pivots + most).toArrow()
    x = _units(_matrix(sample.column("vector")))
    ids, q = sample.column("vec_id").to_numpy()[-most:], x[-most:]
    router = Router(x[:-most] if len(x) > most else x, pivots, q, least)
    shared = Shipped(spark, (router, ids, q))

    def true_links(batches):
        router, ids, q = shared.value
        sums = np.zeros((len(q), len(router.graph.x)), np.int64)
        for batch in batches:
            vec, copies, x = batch.column(0).to_numpy(), batch.column(2).to_numpy(), _units(_matrix(batch.column(1)))
            for i in range(0, len(x), 4 * _BLOCK):
                b, a = np.nonzero(x[i : i + 4 * _BLOCK] @ q.T >= least)
                ok = vec[b + i] != ids[a]
                a, b = a[ok], b[ok] + i
                if len(a):
                    hit, back = np.unique(b, return_inverse=True)
                    np.add.at(sums, (a, router.homes(x[hit])[back]), copies[b])
        a, h = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int32)), pa.array(h.astype(np.int32)), pa.array(sums[a, h])], ["query", "home", "n"])

    found = part.select("vec_id", "vector", "copies").mapInArrow(true_links, "query int, home int, n long").groupBy("query", "home").agg(F.sum("n").alias("n")).toArrow()
    of, homes, copies = (found.column(k).to_numpy() for k in ("query", "home", "n"))
    links = np.bincount(of, weights=copies, minlength=len(q))
    router.widen(q, of, homes, copies, links)
    return router, ids, links


def _routed(part: DataFrame, router: Router) -> DataFrame:
    """``vec_id, vector, copies, homes``: the pivots that each vector asks, its own first."""
    shared = Shipped(part.sparkSession, router)

    def run(batches):
        router = shared.value
        for batch in batches:
            ids, asked = router.asks(_units(_matrix(batch.column(1))))
            offsets = np.concatenate([[0], np.cumsum(asked.sum(axis=1))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids[asked]))], ["vec_id", "vector", "copies", "homes"])

    kind = dict(part.dtypes)["vector"]
    return stash(part.select("vec_id", "vector", "copies").mapInArrow(run, f"vec_id long, vector {kind}, copies long, homes array<int>"), "routed")


def _answers(routed: DataFrame, n: int, width: int, least: float) -> list[DataFrame]:
    """What every vector's homes answer to it, in tables of a bounded number of queries."""
    members = routed.withColumn("home", F.col("homes")[0]).drop("homes")
    asked = routed.select("vec_id", "vector", F.explode("homes").alias("home"))
    sizes = {r.home: r["count"] for r in members.groupBy("home").count().collect()}  # as many rows as pivots
    asks = {r.home: r["count"] for r in asked.groupBy("home").count().collect()}
    shards = {h: -(-k * (width + 40 + 12 * LINKS) // SHARD_BYTES) for h, k in sizes.items()}
    chunks = {h: -(-k * width // QUERY_BYTES) for h, k in asks.items()}

    def of(counts):
        large = [F.lit(int(y)) for h, k in counts.items() if k > 1 for y in (h, k)]
        return F.coalesce(F.create_map(*large)[F.col("home")], F.lit(1)) if large else F.lit(1)

    upto = lambda counts: F.explode(F.sequence(F.lit(0), of(counts) - 1))
    some = lambda counts, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), of(counts)).cast("int")
    asked = asked.withColumn("shard", upto(shards)).withColumn("chunk", some(chunks, 1))
    members = members.withColumn("shard", some(shards, 2)).withColumn("chunk", upto(chunks))
    rounds = max(1, math.ceil(sum(k * shards.get(h, 1) for h, k in asks.items()) / max(SENT * n, LEAST_SENT)))
    out, key = [], ["home", "shard", "chunk"]
    for i in range(rounds):
        now = F.pmod(F.xxhash64("home"), F.lit(rounds)) == i
        out.append(stash(asked.where(now).groupBy(*key).cogroup(members.where(now).groupBy(*key)).applyInArrow(lambda q, m: _ask(q, m, least), FOUND), "answers"))
    return out


def near_duplicates(embeddings: DataFrame, least: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, n_links, component_id, kept, audited_recall`` for each row of ``embeddings``; other columns are ignored.

    Two vectors link when their cosine, in double precision, is ``least`` or more (so at a tie); links are those that the
    graphs lead to, and every one counted is verified, by its cosine or by angles that bound it. audited_recall is the least of
    all tasks' audits and of the share of their links that sampled queries found; below LEAST_RECALL it is an error. Vectors that are null, empty,
    zero or hold a null or non-finite component link with nothing; vectors of different lengths never
    link. Rows with equal vectors link with each other. A null id keeps its row, links with nothing
    and has a null component and kept. Different vectors under one id are one node and are not linked
    with each other. Vectors have no length limit but that QUERY_BYTES must hold one. No rows give no rows.
    """
    spark = embeddings.sparkSession
    small_batches(spark)
    kind = "float" if dict(embeddings.dtypes)[vector_col] == "array<float>" else "double"
    rows = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(f"array<{kind}>").alias("v"))
    rows = stash(rows.mapInArrow(lambda b: _fine(b, kind), f"vec_id long, vector array<{kind}>").withColumn("hash", F.xxhash64("vector")), "vectors")
    reps = stash(rows.where("vector IS NOT NULL").groupBy("hash", "vector").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")), "distinct")
    found, recall = spark.createDataFrame([], FOUND), 1.0
    used = []
    for dim, n in [(r.dim, r["count"]) for r in reps.groupBy(F.size("vector").alias("dim")).count().collect()]:
        width = dim * (4 if kind == "float" else 8)
        part = reps.where(F.size("vector") == dim).select(F.col("rep").alias("vec_id"), "vector", "copies")
        router, ids, links = _route(part, n, width, least)
        routed = _routed(part, router)
        answers = _answers(routed, n, width, least)
        drop(routed)
        used += answers
        answers = reduce(DataFrame.unionByName, answers)
        audited = dict(answers.where(F.col("vec_id").isin(ids.tolist()) & F.col("other").isNull()).groupBy("vec_id").agg(F.sum("n")).collect())
        recall = min(recall, _recalls(np.array([audited.get(i, 0) for i in ids.tolist()]), links), answers.agg(F.coalesce(F.min("recall"), F.lit(1.0))).first()[0])
        found = found.unionByName(answers)
    if recall < LEAST_RECALL:
        raise RuntimeError(f"audited recall {recall:.3f} is below {LEAST_RECALL}")
    parts = components(found.where("other IS NOT NULL"), "vec_id", "other")
    links = found.where("other IS NULL AND recall IS NULL").groupBy(F.col("vec_id").alias("rep")).agg(F.sum("n").alias("n"))
    named = reps.join(links, "rep", "left").join(parts, reps.rep == parts.node, "left")
    named = stash(named.select("hash", "vector", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")), "named")
    drop(reps, *used)
    out = rows.join(named, ["hash", "vector"], "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id")).withColumn("audited_recall", F.lit(recall))


def op3_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
