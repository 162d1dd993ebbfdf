"""Token ids of many texts at once, by the tokenizers library.

A byte-level vocabulary's own pattern cuts a text into pieces that are encoded
by themselves. A slice of texts is cut at those borders that two neighbouring
bytes prove; each distinct unit between them is encoded once, and a worker
process keeps some CACHE units. Units are found by hash and compared byte by
byte. Units of one piece go to the library together, some thousands a call. A
vocabulary with any other pattern, and a text that holds a special token's
string, is encoded whole.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa

from equiloom.llm import common as C

CACHE = 1_500_000
GROUP = 2048
_WIDE_SPACE = re.compile(r"\s|[\x00-\x1f]")
_LETTER, _DIGIT, _MARK, _QUOTE, _SPACE, _OTHER, _LINE = range(7)
_CLASS = np.full(256, _OTHER, np.uint8)  # control bytes and bytes of wider characters prove no border, but see _kinds
_CLASS[33:127] = _MARK
_CLASS[[*range(65, 91), *range(97, 123)]] = _LETTER
_CLASS[48:58] = _DIGIT
_CLASS[39] = _QUOTE
_CLASS[[32, 11, 12]] = _SPACE
_CLASS[[9, 10, 13]] = _LINE
#: Whether a border lies between bytes of two classes: before white space, where
#: letters, digits and marks meet, before a quote that may begin a suffix, and
#: after a line's end or tab, which no word takes along as it takes a space: it
#: is a piece by itself there.
_BORDER = np.zeros((7, 7), bool)
_BORDER[:4, [_SPACE, _LINE]] = True
_BORDER[_LINE, :4] = True
_BORDER[:3, :3] = ~np.eye(3, dtype=bool)
_BORDER[[_LETTER, _DIGIT], _QUOTE] = True
#: First bytes of U+00C0 to U+023F and U+0400 to U+047F: letters, but for the
#: signs of multiplication and division.
_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(0xC3, 0xC9), 0xD0, 0xD1]] = True


def _kinds(buf: np.ndarray) -> np.ndarray:
    """The class of each byte; both of a two-byte letter are letters."""
    kind = _CLASS[buf]
    at = np.flatnonzero(_LETTERS[buf[:-1]])
    at = at[(buf[at] != 0xC3) | (buf[at + 1] & 0xDF != 0x97)]
    kind[at] = kind[at + 1] = _LETTER
    return kind


def _flat(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Indices of the stretches (start, n), one after another."""
    ends = np.cumsum(n)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - (ends - n), n)


class _Kept:
    """An array that grows at its end."""

    def __init__(self, *first: int, kind):
        self.room, self.size = np.array(first, kind), len(first)

    @property
    def all(self) -> np.ndarray:
        return self.room[: self.size]

    def add(self, more: np.ndarray) -> None:
        size = self.size + len(more)
        if size > len(self.room):
            room = np.empty(size + size // 4, self.room.dtype)
            room[: self.size] = self.all
            self.room = room
        self.room[self.size : size] = more
        self.size = size


class Encoder:
    """Ids below 65536 of the tokenizer file at `path`."""

    def __init__(self, path: str):
        # Spark's tasks take the cores; the library's threads would contend for them.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        form = json.loads(self.tokenizer.to_str())
        pre = form["pre_tokenizer"] or {}
        self.cuts = pre.get("type") == "ByteLevel" and pre.get("use_regex") is True and not pre.get("add_prefix_space") and form["normalizer"] is None
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.special = [t.content for t in added]
        self.cuts &= not any(t.single_word or t.lstrip or t.rstrip for t in added)
        size = self.tokenizer.get_vocab_size()
        if size > 65536:
            raise ValueError("ids must be below 65536")
        self.opens = np.array([(self.tokenizer.id_to_token(i) or "").startswith("Ġ") for i in range(size)], bool)
        line = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.line = line[0] if len(line) == 1 else -1
        self._clear()

    def _clear(self):
        self.hash = np.empty(0, np.uint64)
        self.at = np.empty(0, np.int32)  # the unit's number
        self.text, self.text_ends = _Kept(kind=np.uint8), _Kept(0, kind=np.int32)
        self.ids, self.ids_ends = _Kept(kind=np.uint16), _Kept(0, kind=np.int32)

    def _each(self, texts: list[str]):
        """Ids of each text, in batches of texts."""
        for a in range(0, len(texts), 1024):
            yield from (np.array(e.ids, np.uint16) for e in self.tokenizer.encode_batch_fast(texts[a : a + 1024], add_special_tokens=False))

    def _encode(self, buf, start, size, whole) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """An order of the units, their ids and the number of ids by unit.
        Units of a space and a word go together: each opens with the only token
        that has the space. So do words, with a line's end after each."""
        kind = _kinds(buf)
        turns = np.zeros(len(buf), np.int32)
        np.cumsum(kind[1:] != kind[:-1], out=turns[1:])
        spaced = (buf[start] == 32) & (size > 1)
        word = start + spaced
        plain = (kind[word] <= _MARK) & (turns[word] == turns[start + size - 1]) & ~whole
        left = np.flatnonzero(~plain)
        units = [buf[a : a + m].tobytes() for a, m in zip(start[left].tolist(), size[left].tolist(), strict=True)]
        wide = np.array([u[:1] == b" " and len(u) > 1 and b"'" not in u and u[1] != 32 and (u.isascii() and _CLASS[u[1]] <= _MARK or not _WIDE_SPACE.search(u[1:].decode())) for u in units], bool)
        ids, n, order, rest = [], [], [], [left[~wide]]
        for units, after in ((np.concatenate([np.flatnonzero(plain & spaced), left[wide]]), 0), (np.flatnonzero(plain & ~spaced), 1)):
            groups = [units[a : a + GROUP] for a in range(0, len(units), GROUP)]
            for group, got in zip(groups, self._each([self._joined(buf, start[g], size[g], after) for g in groups]), strict=True):
                if after:
                    ends = got == self.line
                    count = np.diff(np.flatnonzero(ends), prepend=-1) - 1
                    got = got[~ends]
                else:
                    count = np.diff(np.append(np.flatnonzero(self.opens[got]), len(got)))
                if len(count) == len(group) and count.sum() == len(got):
                    order.append(group)
                    ids.append(got)
                    n.append(count)
                else:
                    rest.append(group)
        rest = np.concatenate(rest)
        alone = list(self._each([buf[a : a + m].tobytes().decode() for a, m in zip(start[rest].tolist(), size[rest].tolist(), strict=True)]))
        none = [np.empty(0, np.int64)]
        return np.concatenate([*order, rest]).astype(np.int64), np.concatenate([*ids, *alone, np.empty(0, np.uint16)]), np.concatenate([*n, [len(x) for x in alone], *none]).astype(np.int64)

    @staticmethod
    def _joined(buf, start, size, after: int) -> str:
        """The units in a row, with `after` line ends behind each."""
        if not after:
            return buf[_flat(start, size)].tobytes().decode()
        out = np.full(int(size.sum()) + len(size), 10, np.uint8)
        out[_flat(np.cumsum(size + 1) - size - 1, size)] = buf[_flat(start, size)]
        return out.tobytes().decode()

    def _learn(self, buf, start, size, whole) -> np.ndarray:
        """The kept units' numbers of distinct strings, new ones encoded."""
        h = C.word_hashes(buf, start, start + size)
        by = np.argsort(h)
        h, start, size = h[by], start[by], size[by]
        if (h[1:] == h[:-1]).any():
            raise _Collision
        where = np.searchsorted(self.hash, h)
        known = self.hash[np.minimum(where, len(self.hash) - 1)] == h if len(self.hash) else np.zeros(len(h), bool)
        old = self.at[where[known]]
        begin = self.text_ends.all[old].astype(np.int64)
        if (self.text_ends.all[old + 1] - begin != size[known]).any() or (buf[_flat(start[known], size[known])] != self.text.all[_flat(begin, size[known])]).any():
            raise _Collision
        number = np.empty(len(h), np.int64)
        number[known] = old
        new = np.flatnonzero(~known)
        if len(new):
            order, ids, n = self._encode(buf, start[new], size[new], whole[by][new])
            number[new[order]] = self.text_ends.size - 1 + np.arange(len(new))
            self.hash, self.at = np.insert(self.hash, where[new], h[new]), np.insert(self.at, where[new], number[new])
            new = new[order]
            self.text.add(buf[_flat(start[new], size[new])])
            self.text_ends.add(self.text_ends.all[-1] + np.cumsum(size[new]))
            self.ids.add(ids)
            self.ids_ends.add(self.ids_ends.all[-1] + np.cumsum(n))
        out = np.empty(len(h), np.int64)
        out[by] = number
        return out

    def __call__(self, buf: np.ndarray, offs: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (UTF-8 bytes and offsets), each with `end` after
        them, and their number by text."""
        rows, data = len(offs) - 1, buf.tobytes()
        whole = [i for i in range(rows) if not self.cuts or any(data.find(s.encode(), offs[i], offs[i + 1]) >= 0 for s in self.special)]
        if self.hash.size > CACHE:
            self._clear()
        try:
            number, first = self._units(buf, offs, whole)
            begin = self.ids_ends.all[number].astype(np.int64)
            count = self.ids_ends.all[number + 1] - begin
            ids = self.ids.all[_flat(begin, count)]
        except _Collision:
            self._clear()
            each = list(self._each([data[a:z].decode() for a, z in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]))
            count, first = np.array([len(x) for x in each], np.int64), np.arange(rows + 1)
            ids = np.concatenate([*each, np.empty(0, np.uint16)])
        total = np.concatenate(([0], np.cumsum(count)))[first]
        per = np.diff(total)
        out = np.full(len(ids) + rows, end, np.uint16)
        out[np.arange(len(ids)) + np.repeat(np.arange(rows), per)] = ids
        return out, per + 1

    def _units(self, buf, offs, whole):
        """Kept units' numbers in order, and the texts' offsets in them."""
        if not len(buf):
            return np.empty(0, np.int64), np.zeros(len(offs), np.int64)
        kind = _kinds(buf)
        border = np.ones(len(buf), bool)
        border[1:] = _BORDER.ravel().take(kind[:-1] * np.uint8(7) + kind[1:])
        line = (kind[:-1] == _LINE) & (kind[1:] <= _QUOTE)
        line[offs[(offs > 0) & (offs < len(buf))] - 1] = False  # the next text's
        border[:-1] |= line
        for i in whole:
            border[offs[i] : offs[i + 1]] = False
        border[offs[:-1][offs[:-1] < len(buf)]] = True
        start = np.flatnonzero(border)
        places = np.append(start, len(buf))
        units = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(places), pa.py_buffer(buf)]).dictionary_encode()
        back = units.indices.to_numpy()
        first = np.searchsorted(start, offs)
        alone = np.zeros(len(units.dictionary), bool)
        alone[back[first[[i for i in whole if offs[i] < offs[i + 1]]]]] = True
        data, ends = C.utf8(units.dictionary)
        return self._learn(data, ends[:-1], np.diff(ends), alone)[back], first


class _Collision(Exception):
    """Two units of one hash: the slice is encoded text by text."""
