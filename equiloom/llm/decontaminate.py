"""Benchmark decontamination by SimHash of item-sized windows.

For every item, the windows of its number of words are fingerprinted over all
documents; a multi-index of eight 8-bit blocks finds every fingerprint within
``RADIUS`` bits of an item's (a pair within 23 bits is within 2 in some block);
the exact weighted similarity of the word shingles, the sum of least counts over
the sum of greatest, then decides. A window that shares no shingle with an item
of its size has similarity 0, so only windows around shared shingles are
fingerprinted.

Items are taken in blocks of bounded size against all documents, so the
benchmark may grow. Words are compared in lower case (A-Z).

Cases: a null or empty text matches nothing; a very long text is compared in
blocks of windows; a text shorter than an item is one
window; an item under five words is one shingle; equal items are reported each;
repeated rows are reported each; an empty table on either side gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equiloom.llm import common as C

WIDTH, SIMILAR, RADIUS = 5, 0.8, 20
#: Items and bytes of items that one pass over the documents takes, about.
ITEMS, ITEM_BYTES = 5000, 16 << 20
#: Windows times items that are compared at once.
CELLS = 1 << 20
_NEAR = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8)) <= 2


def _shingles(buf, offs, width):
    buf = C.lower(buf)
    starts, ends, first = C.words(buf, offs)
    return C.mix(C.ngrams(C.word_hashes(buf, starts, ends), width)), first


def _prints(h: np.ndarray, size: int) -> np.ndarray:
    """SimHash of every window of `size` shingles."""
    bits = np.zeros((len(h) + 1, 64), np.int32)
    np.cumsum(np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), axis=0, out=bits[1:])
    return np.packbits(2 * (bits[size:] - bits[:-size]) > size, axis=1, bitorder="little").view(np.uint64).ravel()


@dataclass
class _Size:
    """The items of one number of words: their fingerprints by block value."""

    ids: list = field(default_factory=list)
    prints: list = field(default_factory=list)
    counts: list = field(default_factory=list)

    def close(self):
        self.prints = np.array(self.prints, np.uint64)
        self.near = _NEAR[self.prints.view(np.uint8).reshape(-1, 8).T].transpose(0, 2, 1)  # block, value, item


@dataclass
class Index:
    """Item shingles by width, with the sizes of the items that hold them."""

    sizes: dict[int, _Size] = field(default_factory=dict)
    shingles: dict[int, np.ndarray] = field(default_factory=dict)
    owners: dict[int, list] = field(default_factory=dict)


def index(rows) -> Index:
    out = Index()
    held: dict[int, dict[int, set]] = {}
    for item_id, text in rows:
        data = np.frombuffer((text or "").encode(), np.uint8)
        n = len(C.words(data, np.array([0, len(data)]))[0])
        if not n:
            continue
        width = min(WIDTH, n)
        h, _ = _shingles(data, np.array([0, len(data)]), width)
        size = out.sizes.setdefault(n, _Size())
        size.ids.append(item_id)
        size.prints.append(_prints(h, len(h))[0])
        size.counts.append(Counter(h.tolist()))
        for x in h.tolist():
            held.setdefault(width, {}).setdefault(x, set()).add(n)
    for size in out.sizes.values():
        size.close()
    for width, by in held.items():
        out.shingles[width] = np.array(sorted(by), np.uint64)
        out.owners[width] = [sorted(by[x]) for x in sorted(by)]
    return out


def _similar(h: np.ndarray, item: Counter, total: int, window: int) -> tuple[float, int]:
    """Greatest weighted similarity of the windows of h to an item, and where."""
    have: Counter = Counter()
    shared, best, place = 0, 0.0, 0
    values = h.tolist()
    for i, x in enumerate(values):
        have[x] += 1
        shared += have[x] <= item.get(x, 0)
        if i >= window:
            y = values[i - window]
            shared -= have[y] <= item.get(y, 0)
            have[y] -= 1
        if i >= window - 1:
            got = shared / (total + window - shared)
            if got > best:
                best, place = got, i - window + 1
    return best, place


def _near(size: _Size, prints: np.ndarray):
    """(item, first, last window) of the items that have a window within RADIUS,
    by the multi-index of blocks."""
    found = np.zeros((len(prints), len(size.ids)), bool)
    for b in range(8):
        found |= size.near[b][prints.view(np.uint8).reshape(-1, 8)[:, b]]
    found &= np.bitwise_count(prints[:, None] ^ size.prints[None]) <= RADIUS
    for j in np.flatnonzero(found.any(0)):
        w = np.flatnonzero(found[:, j])
        yield j, int(w[0]), int(w[-1])


def _matches(ix: Index, part) -> list[tuple[int, object, float, int]]:
    """(row, item_id, similarity, first word) of all matches in a batch."""
    buf, offs = C.utf8(part.column("text"))
    out = []
    for width, known in ix.shingles.items():
        h, first = _shingles(buf, offs, width)
        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
        hits = np.flatnonzero(known[at] == h)
        row = np.searchsorted(first, hits, "right") - 1
        ok = hits + width <= first[row + 1]
        near: dict[tuple[int, int], list[int]] = {}
        for i, r in zip(hits[ok].tolist(), row[ok].tolist(), strict=True):
            for n in ix.owners[width][at[i]]:
                near.setdefault((r, n), []).append(i)
        for (r, n), places in sorted(near.items()):
            a, z = int(first[r]), int(first[r + 1])
            window = min(n, z - a) - width + 1
            lo, hi = np.array(places) - window + 1, np.array(places) + 1
            # Stretches of window starts that hold a shared shingle.
            new = np.flatnonzero(np.concatenate(([True], lo[1:] > np.maximum.accumulate(hi)[:-1])))
            for s, e in zip(new, np.append(new[1:], len(lo)), strict=True):
                left, right = max(a, int(lo[s])), min(z - width + 1 - window, int(hi[e - 1]) - 1)
                if right < left:
                    continue
                size = ix.sizes[n]
                step = max(1, CELLS // len(size.ids))
                for at_ in range(left, right + 1, step):  # windows in blocks of bounded size
                    piece = h[at_ : min(right, at_ + step - 1) + window]
                    for j, lo_, hi_ in _near(size, _prints(piece, window)):
                        best, place = _similar(piece[lo_ : hi_ + window], size.counts[j], n - width + 1, window)
                        if best >= SIMILAR:
                            out.append((r, size.ids[j], best, at_ + lo_ + place - a))
    best: dict[tuple, tuple] = {}
    for r, i, s, p in out:
        if (r, i) not in best or (s, -p) > (best[r, i][0], -best[r, i][1]):
            best[r, i] = (s, p)
    return [(r, i, s, p) for (r, i), (s, p) in sorted(best.items(), key=str)]


def _indices(items: DataFrame):
    """Indices of the items, block by block."""
    n, size = items.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    blocks = max(1, -(-n // ITEMS), -(-(size or 0) // ITEM_BYTES))
    for b in range(blocks if n else 0):
        some = items.select("item_id", "text").where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        yield index(some.orderBy("item_id", "text").collect())


def matches(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, similarity, first_word of each document and item alike
    at SIMILAR or more in some window."""
    kinds = (docs.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString())
    form = f"doc_id {kinds[0]}, item_id {kinds[1]}, similarity double, first_word long"

    def over(ix: Index):
        def run(batches):
            for part in C.slices(batches):
                found = _matches(ix, part)
                if found:
                    r, i, s, p = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(r)), pa.array(i), pa.array(s), pa.array(p, pa.int64())], ["doc_id", "item_id", "similarity", "first_word"])

        return docs.select("doc_id", "text").mapInArrow(run, form)

    out = docs.sparkSession.createDataFrame([], form)
    for ix in _indices(items):
        out = out.unionByName(over(ix))
    return out


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that match no item, as they are."""

    def over(frame: DataFrame, ix: Index) -> DataFrame:
        def run(batches):
            for part in C.slices(batches):
                clean = np.ones(part.num_rows, bool)
                clean[[m[0] for m in _matches(ix, part)]] = False
                yield part.filter(pa.array(clean))
            C.give_back()

        return frame.mapInArrow(run, docs.schema)

    for ix in _indices(items):
        docs = over(docs, ix)
    return docs
