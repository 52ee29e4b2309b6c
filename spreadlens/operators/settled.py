"""The modularity communities of ``communities`` for a graph that one task can hold: the same rounds and levels on arrays.

A graph is its symmetric entries in order of their start, ``w`` None where every
weight is one.  Vertices are numbered in order of their ids, so ties fall as there;
sums are exact for whole weights and gamma = 1 below 2^53.
"""
from __future__ import annotations

import numpy as np

from .intask import codes

#: Pairs that a graph may have for that: some 450 MB of a Python worker.
PAIRS = 4_000_000

_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turned(x, n):
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def _mixed(h):
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


def drawn(ids: np.ndarray, number: int) -> np.ndarray:
    """Where Spark's ``pmod(xxhash64(id, number), 2)`` is 0, for long ids and an int number."""
    h = np.uint64(42) + _P5 + np.uint64(8)
    h = h ^ (_turned(ids.astype(np.int64).view(np.uint64) * _P2, 31) * _P1)
    h = _mixed(_turned(h, 27) * _P1 + _P4)
    h = (h + _P5 + np.uint64(4)) ^ (np.array([number & 0xFFFFFFFF], np.uint64) * _P1)
    return _mixed(_turned(h, 23) * _P2 + _P3) & np.uint64(1) == 0


def _sums(a, to, w, n: int):
    """(a, to, w) of entries added up by a and to, in this order; ``n`` bounds to."""
    key = a.astype(np.int64)
    key *= n
    key += to
    if w is None:
        key.sort()
    else:
        order = np.argsort(key, kind="stable")
        key, w = key[order], w[order]
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])[:len(key)])
    total = np.diff(np.append(starts, len(key))).astype(np.float64) if w is None else (np.add.reduceat(w, starts) if len(starts) else np.zeros(0))
    return *np.divmod(key[starts], n), total


class _Graph:
    """Entries (a, b, w) in order of (a, b), the ids of the vertices, their strengths ``k``, the weight of the loops."""

    def __init__(self, a, b, w, ids):
        self.a, self.b, self.w, self.ids, self.n = a, b, w, ids, len(ids)
        self.k = np.bincount(a, w, self.n).astype(np.float64)
        self.two_m = float(self.k.sum())
        loop = a == b
        self.loops = float(np.count_nonzero(loop) if w is None else w[loop].sum())
        # the entries to others
        self.away = ~loop if loop.any() else slice(None)



class _State:
    """Communities ``c`` of the vertices with every vertex's best move ``to``, what it gains, and the quality of the whole."""

    def __init__(self, g: _Graph, c: np.ndarray, gamma: float):
        self.g, self.c, self.gamma = g, c, gamma
        big = np.bincount(c, g.k, g.n).astype(np.float64)
        a, to, w = _sums(g.a[g.away], c[g.b[g.away]], None if g.w is None else g.w[g.away], g.n)
        stays = to == c[a]
        w_cur = np.zeros(g.n)
        w_cur[a[stays]] = w[stays]
        score = g.two_m * w - gamma * g.k[a] * big[to]
        score[stays] = -np.inf
        starts = np.flatnonzero(np.append(True, a[1:] != a[:-1])[:len(a)])
        top = np.repeat(np.maximum.reduceat(score, starts), np.diff(np.append(starts, len(a)))) if len(a) else score
        best = np.flatnonzero(score == top)  # the smallest community of those that tie comes first
        best = best[np.append(True, a[best][1:] != a[best][:-1])[:len(best)]]
        self.to, self.delta = c.copy(), np.zeros(g.n)
        v = a[best]
        self.to[v] = to[best]
        self.delta[v] = g.two_m * (w[best] - w_cur[v]) - gamma * g.k[v] * (big[to[best]] - big[c[v]] + g.k[v])
        self.gains = (self.to != c) & (self.delta > 0)
        self.open = bool(self.gains.any())
        self.quality = g.two_m * (w_cur.sum() + g.loops) - gamma * (g.k * big[c]).sum()

    def moved(self, which: np.ndarray) -> _State:
        return _State(self.g, np.where(which, self.to, self.c), self.gamma)

    def above(self, x, y):
        """Where the move of x gains more than that of y (ties: the smaller vertex)."""
        return (self.delta[x] > self.delta[y]) | ((self.delta[x] == self.delta[y]) & (x < y))

    def apart(self) -> np.ndarray:
        a, b = self.g.a, self.g.b
        both = np.flatnonzero(self.gains[a] & self.gains[b] & (a != b))
        out = self.gains.copy()
        out[a[both][self.above(b[both], a[both])]] = False
        return out

    def one_each(self) -> np.ndarray:
        v = np.flatnonzero(self.gains)
        v = v[np.lexsort((v, -self.delta[v]))]
        ends, mover = np.concatenate([self.c[v], self.to[v]]), np.tile(np.arange(len(v)), 2)
        first = np.full(self.g.n, len(v))
        np.minimum.at(first, ends, mover)
        at = np.arange(len(v))
        out = np.zeros(self.g.n, bool)
        out[v[(first[self.c[v]] == at) & (first[self.to[v]] == at)]] = True
        return out


def settle(g: _Graph, c: np.ndarray, gamma: float) -> tuple[np.ndarray, bool]:
    """``communities.settle`` on arrays."""
    state, rounds = _State(g, c, gamma), 0
    while state.open:
        for pick in (lambda s: s.gains & drawn(g.ids, rounds), _State.apart, _State.one_each):  # noqa: B023
            after = state.moved(pick(state))
            if after.quality > state.quality:
                break
        else:
            break
        state, rounds = after, rounds + 1
    return state.c, rounds > 0


def connected_parts(g: _Graph, c: np.ndarray) -> np.ndarray:
    """The smallest vertex of each vertex's connected part of its community."""
    inside = c[g.a] == c[g.b]
    a, b = g.a[inside], g.b[inside]
    part = np.arange(g.n)
    while True:
        least = part.copy()
        np.minimum.at(least, part[a], part[b])  # both ways, since the entries are symmetric
        least = np.minimum(least, least[part])
        while not np.array_equal(least, least[least]):
            least = least[least]
        if np.array_equal(least, part):
            return part
        part = least


def contracted(g: _Graph, c: np.ndarray) -> tuple[_Graph, np.ndarray]:
    """The communities as vertices, and the number of each vertex's."""
    kept, at = np.unique(c, return_inverse=True)
    return _Graph(*_sums(at[g.a], at[g.b], g.w, len(kept)), g.ids[kept]), at


def communities(g: _Graph, gamma: float) -> np.ndarray:
    """``communities.louvain`` on arrays: the community of each vertex, the number of its smallest member."""
    part, first = np.arange(g.n), True
    while True:
        c, moved = settle(g, part, gamma)
        if not moved and not first:
            return part
        first = False
        part = connected_parts(g, c)
        names = np.unique(part)
        up, at = contracted(g, part)
        while True:
            c, moved = settle(up, np.arange(up.n), gamma)
            if not moved:
                break
            c = connected_parts(up, c)
            part = names[c[at]]
            kept = np.unique(c)
            up, higher = contracted(up, c)
            names, at = names[kept], higher[at]


def graph_of(u, v, w=None) -> _Graph:
    """The graph of pairs u <= v of long ids, as Arrow columns; a self-loop is one entry that counts twice."""
    found, (u, v) = codes(u, v)
    ids = found.to_numpy(zero_copy_only=False)
    by_id = np.argsort(ids)
    rank = np.empty(len(ids), np.int32)
    rank[by_id] = np.arange(len(ids), dtype=np.int32)
    loop = u == v
    if w is None and loop.any():
        w = np.ones(len(u))
    away = ~loop
    a, b = rank[u], rank[v]
    if w is not None:
        w = np.concatenate([np.where(loop, 2.0 * w, w), w[away]])
    a, b = np.concatenate([a, b[away]]), np.concatenate([b, a[away]])
    if w is not None and (w == 1.0).all():
        w = None
    order = np.argsort(a, kind="stable")
    return _Graph(a[order], b[order], None if w is None else w[order], ids[by_id])


def in_task(gamma: float):
    """Arrow function of a graph's pairs (u, v[, w]): rows (graph, a, c)."""
    def run(key, table):
        import pyarrow as pa
        w = table.column("w").cast(pa.float64()).to_numpy() if "w" in table.column_names else None
        g = graph_of(table.column("u"), table.column("v"), w)
        part = communities(g, gamma)
        return pa.table({"graph": pa.array([key[0].as_py()] * g.n, pa.string()), "a": pa.array(g.ids, pa.int64()), "c": pa.array(g.ids[part], pa.int64())})
    return run
