"""Merge-type sentencepiece models as arrays, and ids of many texts at once.

Characters merge pairwise, the best-scored piece first and the leftmost of
equals, so a text's encoding has two properties: any stretch of its tokens is
the encoding of that stretch, and a sequence whose neighbours are each the
encoding of their own joined text is the encoding of the whole. Hence every
prefix of a text has exactly one last token: the piece that ends there and fits
the last token of what is before it. A table of these is filled from left to
right, from the matches of an automaton of all pieces; ids come back from its
end.

Whether two tokens fit is decided by their own merges, in order of score, and by
what their touching edges would merge to meanwhile. A text is cut first where no
piece holds the two characters around, and each distinct unit between such cuts
is encoded once.
"""

from __future__ import annotations

import struct
from array import array
from functools import lru_cache

import numpy as np

from equiloom.llm import common as C

SPACE = "▁"
LONG = 48  # characters of a unit from which it is walked by itself
NEVER = np.int32(2**31 - 1)
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6  # types of pieces in the file


def _fields(data: bytes):
    """(number, value) of a message in the model file's format."""
    at = 0

    def number():
        nonlocal at
        got = shift = 0
        while True:
            b = data[at]
            at, got, shift = at + 1, got | (b & 127) << shift, shift + 7
            if b < 128:
                return got

    while at < len(data):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
            continue
        size = {1: 8, 5: 4}.get(key & 7) or number()
        yield key >> 3, data[at : at + size]
        at += size


def _flat(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Indices of the stretches (start, n), one after another."""
    ends = np.cumsum(n)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - (ends - n), n)


class Lookup:
    """Numbers by key, both of zero and more; -1 for any other key."""

    def __init__(self, keys, values):
        keys, values = np.asarray(keys, np.int64), np.asarray(values, np.int32)
        bits = max(8, (4 * len(keys)).bit_length())
        self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[slot[left]] < 0]
            at, one = np.unique(slot[free], return_index=True)
            self.keys[at], self.values[at] = keys[free[one]], values[free[one]]
            left = np.setdiff1d(left, free[one])
            slot[left] = slot[left] + 1 & self.last

    def _slot(self, keys):
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).view(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        found, out = self.keys.take(slot), self.values.take(slot)
        more = np.flatnonzero((found != keys) & (found >= 0))
        while len(more):
            slot[more] = slot[more] + 1 & self.last
            found[more], out[more] = self.keys[slot[more]], self.values[slot[more]]
            more = more[(found[more] != keys[more]) & (found[more] >= 0)]
        return out


class PieceModel:
    """The model file at `path`. It must merge (BPE), fall back to bytes, keep
    texts as they are but for spaces, and have no user-defined or unused piece;
    else ValueError."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            data = f.read()
        pieces, trainer, normalizer = [], {}, {}
        for number, value in _fields(data):
            if number == 1:
                x = dict(_fields(value))
                pieces.append((x[1].decode(), struct.unpack("<f", x.get(2, bytes(4)))[0], x.get(3, _NORMAL)))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normalizer = dict(_fields(value))
        plain = not normalizer.get(2) and normalizer.get(3, 1) and not normalizer.get(4, 1) and normalizer.get(5, 1)
        if trainer.get(3, 1) != 2 or not trainer.get(35, 0) or trainer.get(24, 0) or not plain or {k for _, _, k in pieces} - {_NORMAL, _UNKNOWN, _CONTROL, _BYTE}:
            raise ValueError("not a merge-type model with byte fallback and plain texts")
        self.size = len(pieces)
        at = {p: i for i, (p, _, k) in enumerate(pieces) if k == _CONTROL}
        self.begin, self.end = at["<s>"], at["</s>"]
        self.byte = np.zeros(256, np.int32)
        for i, (p, _, k) in enumerate(pieces):
            if k == _BYTE:
                self.byte[int(p[3:5], 16)] = i
        self._merges(pieces)
        self._automaton()
        self._surfaces(pieces)
        self.memo = np.full(1 << 21, -1, np.int64)
        self._kept: dict[int, bool] = {}

    def _merges(self, pieces) -> None:
        """By token and number of its merges done: the next merge's rank and the
        symbols at its edges; ranks of pairs of symbols."""
        ids = {p: i for i, (p, _, k) in enumerate(pieces) if k == _NORMAL}
        order = {s: r for r, s in enumerate(sorted({pieces[i][1] for i in ids.values()}, reverse=True))}
        rank = {p: order[pieces[i][1]] for p, i in ids.items()}
        chars = sorted(set("".join(ids)))
        bare = [c for c in chars if c not in ids]  # within pieces but none itself: in bytes
        symbol = ids | {c: self.size + i for i, c in enumerate(bare)}
        self.base = self.size + len(bare)  # from here on: a character that no piece has
        self.bare = np.array([ord(c) for c in bare], np.int64)
        longest = max(map(len, symbol))
        self.rank = np.full((self.base, longest), NEVER, np.int32)
        self.left = np.zeros((self.base, longest), np.int32)
        self.right = np.zeros((self.base, longest), np.int32)
        self.length = np.ones(self.base, np.int32)
        self.tokens: dict[str, int] = {}
        pairs = {}
        for p, i in symbol.items():
            now, step = list(p), 0
            while True:
                self.left[i, step], self.right[i, step] = symbol[now[0]], symbol[now[-1]]
                best, where = min(((rank.get(a + b, NEVER), n) for n, (a, b) in enumerate(zip(now, now[1:]))), default=(NEVER, 0))
                if best == NEVER:
                    break
                self.rank[i, step] = best
                now[where : where + 2] = [now[where] + now[where + 1]]
                step += 1
            if len(now) == 1:  # any other piece ends no encoding
                self.tokens[p] = i
                self.length[i] = len(p)
            for n in range(1, len(p)):
                if p[:n] in symbol and p[n:] in symbol:
                    pairs[symbol[p[:n]] * self.base + symbol[p[n:]]] = rank[p]
        self.pairs = Lookup(list(pairs), list(pairs.values()))
        # Classes of characters, and of those within longer pieces.
        self.kind = np.zeros(0x110000, np.uint16)
        self.kind[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        within = sorted(set("".join(p for p in ids if len(p) > 1)))
        self.inner = np.zeros(0x110000, np.uint16)
        self.inner[[ord(c) for c in within]] = np.arange(1, len(within) + 1)
        self.touch = np.zeros((len(within) + 1, len(within) + 1), bool)
        for p in ids:
            x = self.inner[[ord(c) for c in p]]
            self.touch[x[:-1], x[1:]] = True

    def _automaton(self) -> None:
        """Children of the tokens' prefixes by class, and the token at each."""
        node, edges, token = {"": 0}, {}, [-1]
        self.classes = int(self.kind.max()) + 1
        for p, i in self.tokens.items():
            for n in range(1, len(p) + 1):
                if p[:n] not in node:
                    node[p[:n]] = len(token)
                    edges[node[p[: n - 1]] * self.classes + int(self.kind[ord(p[n - 1])])] = len(token)
                    token.append(-1)
            token[node[p]] = i
        self.edges, self.child, self.token = edges, Lookup(list(edges), list(edges.values())), np.array(token, np.int32)
        self.longest = max(map(len, self.tokens))

    def _surfaces(self, pieces) -> None:
        """Decoded bytes of each id."""
        seen = [b"" if k == _CONTROL else bytes([int(p[3:5], 16)]) if k == _BYTE else " ⁇ ".encode() if k == _UNKNOWN else p.replace(SPACE, " ").encode() for p, _, k in pieces]
        self.shown = np.frombuffer(b"".join(seen), np.uint8)
        self.shown_ends = np.concatenate(([0], np.cumsum([len(x) for x in seen])))

    def fits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the tokens a and b stay apart when their texts are joined."""
        out, live = np.ones(len(a), bool), np.arange(len(a))
        i, j = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
        last = self.rank.shape[1] - 1
        while len(live):
            pair = self.right[a, i].astype(np.int64) * self.base + self.left[b, j]
            cross = self.pairs(pair)
            cross[cross < 0] = NEVER
            p, q = self.rank[a, i], self.rank[b, j]
            # Of equal ranks the leftmost goes first: within a, across, within b.
            joined = (cross < p) & (cross <= q)
            out[live[joined]] = False
            go = ~joined & ((p < NEVER) | (q < NEVER))
            first = p <= q
            i, j = np.minimum(i + first, last), np.minimum(j + ~first, last)
            live, a, b, i, j = live[go], a[go], b[go], i[go], j[go]
        return out

    def _fits_kept(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """`fits`, with what a worker process has found before."""
        key = a.astype(np.int64) * self.base + b
        slot = (C.mix(key.view(np.uint64)) & np.uint64(len(self.memo) - 1)).view(np.int64)
        had = self.memo.take(slot)
        out = had & 1 == 1
        new = np.flatnonzero(had >> 1 != key)
        if len(new):
            out[new] = self.fits(a[new], b[new])
            self.memo[slot[new]] = key[new] << 1 | out[new]
        return out

    def _walk(self, kinds: np.ndarray) -> np.ndarray:
        """Last token by prefix of one long unit."""
        text, n = array("H", kinds.astype(np.uint16).tobytes()), len(kinds)
        last = array("i", [-1]) * n
        edges, token, classes, kept, base = self.edges, self.token.tolist(), self.classes, self._kept, self.base
        if len(kept) > 1 << 20:
            kept.clear()
        for at in range(n):
            before = last[at - 1] if at else -1
            node = 0
            for end in range(at, min(n, at + self.longest)):
                node = edges.get(node * classes + text[end], -1)
                if node < 0:
                    break
                t = token[node]
                if t >= 0 and last[end] < 0:
                    ok = at == 0
                    if not ok:
                        key = before * base + t
                        ok = kept.get(key)
                        if ok is None:
                            ok = kept[key] = bool(self.fits(np.array([before]), np.array([t]))[0])
                    if ok:
                        last[end] = t
        return np.frombuffer(last, np.int32)

    def _last(self, kinds: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Last token by prefix, for units one after another."""
        last = np.full(len(kinds), -1, np.int32)
        long = np.flatnonzero(size > LONG)
        for u in long.tolist():
            last[start[u] : start[u] + size[u]] = self._walk(kinds[start[u] : start[u] + size[u]])
        within = np.arange(len(kinds)) - np.repeat(start, size)
        at = np.flatnonzero(np.repeat(size <= LONG, size))
        room = np.repeat(size, size)[at] - within[at]  # characters from here to the unit's end
        node = np.zeros(len(at), np.int64)
        begins, ends, tokens = [], [], []
        for n in range(self.longest):
            node = self.child(node * self.classes + kinds[at + n]).astype(np.int64)
            alive = node >= 0
            node, here = node[alive], at[alive]
            hit = self.token[node]
            is_token = hit >= 0
            begins.append(here[is_token])
            ends.append(begins[-1] + n)
            tokens.append(hit[is_token])
            more = room[alive] > n + 1
            at, node, room = here[more], node[more], room[alive][more]
        begins, ends, tokens = np.concatenate(begins), np.concatenate(ends), np.concatenate(tokens)
        by = within[ends].astype(np.uint16)
        order = np.argsort(by, kind="stable")
        begins, ends, tokens = begins[order], ends[order], tokens[order]
        cuts = np.searchsorted(by[order], np.arange(min(LONG, int(size.max(initial=0))) + 1))
        whole = within[begins] == 0
        for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            t, e = tokens[a:z], ends[a:z]
            ok = whole[a:z].copy()
            rest = np.flatnonzero(~ok)
            ok[rest] = self._fits_kept(last[begins[a:z][rest] - 1], t[rest])
            last[e[ok]] = t[ok]
        return last

    def _unit_ids(self, points: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units of code points, one after another, and their number."""
        kinds = self.kind[points]
        unknown = kinds == 0  # alone in their units
        last = self._last(kinds, start, size)
        last[unknown] = self.base + points[unknown].astype(np.int64)
        ends = np.zeros(len(points), bool)
        at, first = start + size - 1, start
        while len(at):
            ends[at] = True
            t = last[at]
            at = at - np.where(t < self.base, self.length[np.minimum(t, self.base - 1)], 1)
            go = at >= first
            at, first = at[go], first[go]
        where = np.flatnonzero(ends)
        got = last[where].astype(np.int64)
        n = np.add.reduceat(ends.astype(np.int64), start) if len(start) else np.zeros(0, np.int64)
        raw = np.flatnonzero(got >= self.size)
        if not len(raw):
            return got.astype(np.int32), n
        # Characters that are no piece, in their bytes.
        code = np.where(got[raw] >= self.base, got[raw] - self.base, self.bare[np.minimum(got[raw] - self.size, max(0, len(self.bare) - 1))] if len(self.bare) else 0)
        text = np.frombuffer(code.astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)
        wide = 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)
        each = np.ones(len(got), np.int64)
        each[raw] = wide
        out = np.repeat(got, each)
        out[_flat((np.cumsum(each) - each)[raw], wide)] = self.byte[text]
        unit = np.repeat(np.arange(len(start)), n)
        return out.astype(np.int32), np.bincount(unit, each, len(start)).astype(np.int64)

    def borders(self, points: np.ndarray) -> np.ndarray:
        """Where a unit begins: no piece holds this and the character before."""
        x = self.inner[points]
        out = np.ones(len(points), bool)
        out[1:] = ~self.touch[x[:-1], x[1:]]
        return out

    def encode(self, points: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of stretches of code points (spaces as SPACE), of which each is
        encoded by itself; offsets of the stretches, in points and in ids."""
        if not len(points):
            return np.zeros(0, np.int32), np.zeros(len(offs), np.int64)
        border = self.borders(points)
        border[offs[:-1][offs[:-1] < len(points)]] = True
        start = np.flatnonzero(border)
        size = np.diff(np.append(start, len(points)))
        h = C.word_hashes(points, start, start + size)
        _, one, back = np.unique(h, return_index=True, return_inverse=True)
        same = (size == size[one][back]).all() and (points == points[_flat(start[one][back], size)]).all()
        if not same:  # two units of one hash: each for itself
            one, back = np.arange(len(start)), np.arange(len(start))
        ids, n = self._unit_ids(points[_flat(start[one], size[one])], np.cumsum(size[one]) - size[one], size[one])
        first = (np.cumsum(n) - n)[back]
        ends = np.concatenate(([0], np.cumsum(n[back])))
        return ids[_flat(first, n[back])], ends[np.searchsorted(start, offs)]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of ids that `encode` gave, the leading space included."""
        return self.shown[_flat(self.shown_ends[ids], np.diff(self.shown_ends)[ids])].tobytes()


@lru_cache(2)
def model(path: str) -> PieceModel:
    """One for a worker process."""
    return PieceModel(path)
