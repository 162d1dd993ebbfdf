"""Suffix array by induced sorting and permuted common prefixes, on numpy.

The scans of induced sorting advance a block of entries at a time, as far as
nothing that the block itself induces falls inside it. A reduced string of at
most BASE names, where such blocks get short, ends the recursion: its suffixes
are ranked by doubling.
"""

from __future__ import annotations

import numpy as np

BASE = 1 << 17
_FIRST = np.ones(1, bool)


def _by(char: np.ndarray, letters: int) -> np.ndarray:
    """Stable order by letter; 16-bit letters sort by radix."""
    return np.argsort(char.astype(np.uint16) if letters <= 65536 else char, kind="stable")


def _scan(code: np.ndarray, sa: np.ndarray, kind: int, heads: np.ndarray) -> None:
    """Induce the suffixes of one type from left to right: each entry of `sa`
    puts its predecessor, if of type `kind`, at its bucket's head. `code` holds
    twice the letter plus the type. The S-type scan is the same on a mirrored
    array."""
    n, at, block = len(sa), 0, 4096
    while at < n:
        part = sa[at : at + block]
        source = np.flatnonzero(part > 0)
        before = part[source] - 1
        char = code[before]
        ok = (char & 1) == kind
        source, before, char = source[ok], before[ok], char[ok] >> 1
        if not len(source):
            at += len(part)
            continue
        order = _by(char, len(heads))
        source, before, char = source[order], before[order], char[order]
        first = np.flatnonzero(np.concatenate((_FIRST, char[1:] != char[:-1])))
        per = np.diff(np.append(first, len(char)))
        place = np.arange(len(char)) + np.repeat(heads[char[first]] - first, per)
        stop = int(place.min()) - at
        if stop < len(part):
            keep = source < stop
            before, char, place = before[keep], char[keep], place[keep]
            at, block = at + stop, max(64, 2 * stop)
            np.add.at(heads, char, 1)
        else:
            at, block = at + len(part), min(2 * block, 1 << 16)
            heads[char[first]] += per
        sa[place] = before


def _induce(code: np.ndarray, lms: np.ndarray, count: np.ndarray) -> np.ndarray:
    """All suffixes in the order that the given order of LMS positions implies."""
    n = len(code)
    ends = np.cumsum(count)
    sa = np.full(n + 1, -1, code.dtype)  # sa[0] is the empty suffix
    # LMS suffixes at the ends of their buckets, in the order given.
    char = code[lms] >> 1
    order = _by(char, len(count))
    cs = char[order]
    per = np.bincount(cs, minlength=len(count))
    first = np.cumsum(per) - per
    sa[1 + ends[cs] - per[cs] + np.arange(len(cs)) - first[cs]] = lms[order]
    sa[0] = n
    _scan(code, sa, 0, 1 + ends - count)
    # Now S-type from right to left; the LMS ones are placed anew.
    mirror = sa[:0:-1].copy()
    mirror[(code[np.maximum(mirror, 0)] & 1).astype(bool)] = -1
    _scan(code, mirror, 1, n - ends)
    return mirror[::-1]


def _doubled(names: np.ndarray) -> np.ndarray:
    """Order of all suffixes, by their first 1, 2, 4, ... letters."""
    n, width = len(names), 1
    rank = names.astype(np.int64)
    while True:
        after = np.zeros(n, np.int64)
        after[:-width] = rank[width:] + 1
        key = rank * (int(rank.max()) + 2) + after
        order = np.argsort(key, kind="stable")
        new = np.diff(key[order], prepend=-1) != 0
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new) - 1
        width *= 2
        if new.all() or width >= n:
            return order


def suffix_array(text: np.ndarray, letters: int) -> np.ndarray:
    """Order of all suffixes of `text`, integers in [0, letters)."""
    n = len(text)
    if n < 2:
        return np.arange(n)
    text = text.astype(np.int32 if max(n, 2 * letters) < 2**31 - 1 else np.int64)
    count = np.bincount(text, minlength=letters)
    # A suffix is S-type if smaller than the next one: its run of equal letters
    # ends at a larger letter.
    turn = np.flatnonzero(text[1:] != text[:-1])
    small = np.zeros(n, bool)
    lengths = np.diff(np.concatenate(([-1], turn, [n - 1])))
    small[:] = np.repeat(np.append(text[turn] < text[turn + 1], False), lengths)
    code = 2 * text + small
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    if len(lms) < 2:
        return _induce(code, lms, count)
    rough = _induce(code, lms, count)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    order = rough[is_lms[rough]]
    # Names: equal LMS substrings get the same one. The last runs to the end.
    length = np.zeros(n, np.int64)
    length[lms] = np.diff(np.append(lms, n))
    a, b = order[:-1], order[1:]
    same = (length[a] == length[b]) & (a != lms[-1]) & (b != lms[-1])
    left = np.flatnonzero(same)
    k = 0
    while len(left):
        equal = text[a[left] + k] == text[b[left] + k]
        same[left[~equal]] = False
        left = left[equal & (length[a[left]] > k)]
        k += 1
    name = np.concatenate(([0], np.cumsum(~same)))
    names = np.empty(n, np.int64)
    names[order] = name
    if name[-1] + 1 < len(lms):
        order = lms[(_doubled if len(lms) <= BASE else lambda x: suffix_array(x, int(name[-1]) + 1))(names[lms])]
    return _induce(code, order, count)


def common_prefixes(text: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each position, the length it shares with its predecessor in `sa`,
    in text order. Only irreducible ones, whose preceding letters differ, are
    compared; each other one is its left neighbour's less one. No shared run
    may reach the end of the text unless letters end it first."""
    n = len(text)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    at = np.arange(n)
    back = np.maximum(phi, 0)
    free = (phi < 0) | (at == 0) | (back == 0)
    free |= text[at - 1] != text[back - 1]
    heads = np.flatnonzero(free)
    size = np.zeros(len(heads), np.int64)
    live = np.flatnonzero(phi[heads] >= 0)
    width = 16
    padded = np.concatenate((text, np.full(width, -1, text.dtype)))
    padded2 = np.concatenate((text, np.full(width, -2, text.dtype)))
    lane = np.arange(width)
    while len(live):
        i, j = heads[live] + size[live], phi[heads[live]] + size[live]
        ok = (i < n) & (j < n)
        live, i, j = live[ok], i[ok], j[ok]
        differ = padded[i[:, None] + lane] != padded2[j[:, None] + lane]
        more = np.where(differ.any(1), differ.argmax(1), width)
        size[live] += more
        live = live[more == width]
    root = np.cumsum(free) - 1
    return size[root] - (at - heads[root])
