"""Substring dedup over bytes with sharded suffix arrays.

A window is ``size`` consecutive bytes of one document. Each window is routed by
the least hash among its ``GRAM``-byte strings (leftmost on ties), so equal
windows meet in one shard wherever they lie. Consecutive windows with the same
least place form a region, which is sent once as text.

1. Places whose hash occurs once are settled without sending any text.
2. The regions at the others go to shards. A task sends equal regions once and
   settles them; a shard grown too large is dealt anew by a second hash order.
3. A shard's distinct regions, each ended by its own separator, are sorted by
   induced sorting; permuted common prefixes of at least ``size`` mark the
   windows that occur elsewhere.
4. Bytes under a marked window go.

Cases: null or empty text has no bytes; documents under ``size`` bytes lose
none; a text over ``STRETCH`` bytes is read in overlapping stretches; equal rows
are repeats of each other; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equiloom.llm import common as C
from equiloom.llm import substring_dedup as S
from equiloom.llm.suffix_sort import common_prefixes, suffix_array

GRAM = 32
FLUSH = 16 << 20
SHARD = 1 << 20
#: Window starts that one pass over a text takes; places fit in _BITS bits.
STRETCH, _BITS = 4 << 20, np.uint64(24)
#: Buckets to be dealt anew whose list may be broadcast: a few megabytes.
FEW = 100_000
_TABLE = C.mix(np.arange(1, 257, dtype=np.uint64) * C._K1)
_BASE = 0x2545F4914F6CDD1D
_SECOND = np.uint64(0x9FB21C651E98DF25)
REGIONS = "bucket int, sub int, kind int, text binary, h binary, n binary, many binary, k binary, t binary, at binary"
_FIELDS = [("bucket", pa.int32()), ("sub", pa.int32()), ("kind", pa.int32()), *((c, pa.binary()) for c in ("text", "h", "n", "many", "k", "t", "at"))]
_SCHEMA = pa.schema(_FIELDS)
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of _BASE and of its inverse, modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        _POWERS.clear()
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            each = np.full(n, base, np.uint64)
            each[0] = 1
            _POWERS.append(np.multiply.accumulate(each))
    return _POWERS[0][:n], _POWERS[1][:n]


def _grams(buf: np.ndarray, gram: int) -> np.ndarray:
    """A hash of every string of `gram` bytes, from sums of byte times power."""
    n = len(buf)
    if n < gram:
        return np.empty(0, np.uint64)
    up, down = _powers(max(n, 1 << 16))
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_TABLE[buf] * up[:n], out=total[1:])
    out = total[gram:] - total[:-gram]
    out *= down[: n - gram + 1]
    return C.mix(out)


def _least(key: np.ndarray, width: int) -> np.ndarray:
    """Place of the least key in every stretch of `width`, leftmost on ties."""
    low = key >> _BITS << _BITS
    low |= np.arange(len(key), dtype=np.uint64)
    have = 1
    while have * 2 <= width:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < width:
        low = np.minimum(low[: len(low) - (width - have)], low[width - have :])
    return (low & ((np.uint64(1) << _BITS) - np.uint64(1))).astype(np.int64)


def _regions_of(buf: np.ndarray, offs: np.ndarray, size: int, second: bool):
    gram = min(GRAM, size)
    empty = np.empty(0, np.int64)
    if len(buf) < size:
        return empty, empty, empty, np.empty(0, np.uint64)
    key = _grams(buf, gram)
    least = _least(key, size - gram + 1)
    row = np.repeat(np.arange(len(offs) - 1), np.diff(offs))[: len(least)]
    ok = np.arange(size, size + len(least)) <= offs[row + 1]
    new = np.ones(len(least), bool)
    new[1:] = (least[1:] != least[:-1]) | (row[1:] != row[:-1])
    if second:
        key = C.mix(key ^ _SECOND)
        least = _least(key, size - gram + 1)
        new[1:] |= least[1:] != least[:-1]
    heads = np.flatnonzero(new & ok)
    total = np.concatenate(([0], np.cumsum(ok)))
    ends = np.append(np.flatnonzero(new), len(least))
    stop = ends[np.searchsorted(ends, heads, "right")]
    return row[heads], heads, total[stop] - total[heads], key[least[heads]]


def _regions(buf: np.ndarray, offs: np.ndarray, size: int, second: bool = False):
    """Row, first window, number of windows and hash of the least place of each
    region; with `second`, regions are cut by a second order as well and have
    its hash. Stretches of STRETCH window starts are taken one after another."""
    found = []
    for a in range(0, max(1, len(buf)), STRETCH):
        z = min(len(buf), a + STRETCH + size - 1)
        cut = np.unique(np.clip(offs, a, z))
        first = int(np.searchsorted(offs, a, "right")) - 1
        row, at, n, h = _regions_of(buf[a:z], cut - a, size, second)
        # Rows without bytes are no rows of the stretch: count them back in.
        rows = np.searchsorted(offs, at + a, "right") - 1 if len(at) else row + first
        found.append((rows, at + a, n, h))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _mark(size: int):
    def fill(pile, part):
        k, t = part.column("k").to_numpy(), part.column("t").to_numpy()
        buf, offs = C.utf8(part.column("text"))
        row, first, _, h = _regions(buf, offs, size)
        pile.add(k, t, row, first - offs[row], h, np.zeros(len(h), np.uint32), np.ones(len(h), bool))

    return fill


def _taken(buf: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The bytes of the strings (start, n), one after another."""
    ends = np.cumsum(n)
    return buf[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - (ends - n), n)]


def _alike(text: np.ndarray, n: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each string of `text` (of lengths n), the same for equal
    ones, and how often each number occurs. Strings with equal hashes and
    lengths are compared byte by byte with their predecessor in hash order."""
    if not len(n):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    ends = np.cumsum(n)
    start = ends - n
    up, _ = _powers(max(int(n.max()), 1 << 16))
    whole = np.add.reduceat(_TABLE[text] * up[np.arange(len(text)) - np.repeat(start, n)], start)
    order = np.lexsort((whole, n, h))
    same = np.zeros(len(n), bool)
    a, b = order[:-1], order[1:]
    same[1:] = (h[a] == h[b]) & (n[a] == n[b]) & (whole[a] == whole[b])
    check = np.flatnonzero(same)
    for part in range(0, len(check), 4096):
        i = check[part : part + 4096]
        left, right = order[i - 1], order[i]
        differ = _taken(text, start[left], n[left]) != _taken(text, start[right], n[right])
        head = np.cumsum(n[left]) - n[left]
        same[i] = ~np.logical_or.reduceat(differ, head)
    number = np.empty(len(n), np.int64)
    number[order] = np.cumsum(~same) - 1
    return number, np.bincount(number)


class _Held:
    """Regions of a task: their text, and columns n, h, many, k, t, at."""

    def __init__(self):
        self.texts, self.columns, self.bytes = [], [], 0

    def add(self, text, *columns):
        self.texts.append(text)
        self.columns.append(columns)
        self.bytes += len(text) + 60 * len(columns[0])

    def all(self):
        return np.concatenate(self.texts), *(np.concatenate(x) for x in zip(*self.columns, strict=True))


def _send(size: int, buckets: int):
    """Regions of the marked places, by bucket; kind 0 with text, kind 1 settled."""

    def run(batches):
        held = _Held()
        for part in C.unsqueezed(batches):
            k, t = part.column("k").to_numpy(), part.column("t").to_numpy()
            buf, offs = C.utf8(part.column("text"))
            row, first, n, h = _regions(buf, offs, size)
            hit = np.zeros(len(buf) + 1, bool)
            for i, at in enumerate(part.column("at").to_pylist()):
                hit[offs[i] + C.places_of(at)] = True
            some = np.flatnonzero(hit[first])
            row, first, n, h = row[some], first[some], n[some] + size - 1, h[some]
            if len(some):
                held.add(_taken(buf, first, n), n, h, np.zeros(len(n), np.int64), k[row], t[row], first - offs[row])
            if held.bytes >= FLUSH:
                yield from _flush(held)
                held = _Held()
        if held.bytes:
            yield from _flush(held)
        C.give_back()

    def _flush(held):
        text, n, h, _, k, t, at = held.all()
        number, times = _alike(text, n, h)
        one = np.empty(len(times), np.int64)
        one[number] = np.arange(len(n))
        bucket = (h[one] % np.uint64(buckets)).astype(np.int64)
        for b, pick in _groups(bucket):
            i = one[pick]
            yield _row(b, 0, 0, _taken(text, (np.cumsum(n) - n)[i], n[i]), n[i], h[i], times[pick] > 1, k[i], t[i], at[i])
        i = np.flatnonzero(times[number] > 1)
        for b, pick in _groups(C.slot_of(k[i], t[i], buckets)):
            j = i[pick]
            yield _row(b, 0, 1, text[:0], n[j] - size + 1, h[j], np.ones(len(j)), k[j], t[j], at[j])

    return run


def _groups(key: np.ndarray):
    order = np.argsort(key, kind="stable")
    cuts = np.append(np.flatnonzero(np.diff(key[order], prepend=-1)), len(order))
    for a, z in zip(cuts[:-1], cuts[1:], strict=True):
        yield int(key[order[a]]), order[a:z]


def _row(bucket: int, sub: int, kind: int, text, n, h, many, k, t, at) -> pa.RecordBatch:
    """`many`: whether a region was seen more than once. Settled places have no
    text, and in n the number of their windows."""
    row = {
        "bucket": bucket, "sub": sub, "kind": kind,
        "text": C.zstandard.compress(text.tobytes(), 1),
        "h": C.spread((h >> np.uint64(32)).astype(np.uint32)),
        "n": C.spread(n.astype(np.uint32)),
        "many": C.spread(many.astype(np.uint8)),
        "k": C.spread(k), "t": C.spread(t), "at": C.spread(at.astype(np.uint32)),
    }
    return pa.RecordBatch.from_pylist([row], _SCHEMA)


def _unpack(row: dict):
    text = np.frombuffer(C.zstandard.decompress(row["text"]), np.uint8)
    kinds = {"n": np.uint32, "h": np.uint32, "many": np.uint8, "k": np.int64, "t": np.int64, "at": np.uint32}
    n, h, many, k, t, at = (C.gather(row[c], kind) for c, kind in kinds.items())
    return text, n.astype(np.int64), h.astype(np.uint64), many.astype(np.int64), k, t, at.astype(np.int64)


def _split(size: int):
    """Deal the regions of a large bucket over `parts` by the second order."""

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                if r["parts"] < 2 or r["kind"]:
                    yield pa.RecordBatch.from_pylist([{f: r[f] for f, _ in _FIELDS}], _SCHEMA)
                    continue
                text, n, _, many, k, t, at = _unpack(r)
                offs = np.concatenate(([0], np.cumsum(n)))
                row, first, windows, h = _regions(text, offs, size, True)
                length = windows + size - 1
                for sub, i in _groups((h % np.uint64(r["parts"])).astype(np.int64)):
                    j = row[i]
                    yield _row(r["bucket"], sub, 0, _taken(text, first[i], length[i]), length[i], h[i], many[j], k[j], t[j], at[j] + first[i] - offs[j])

    return run


def _shard(size: int, slots: int):
    """Places and lengths of the runs of windows that occur elsewhere."""

    def run(table: pa.Table) -> pa.Table:
        held, out = _Held(), []
        for r in table.to_pylist():
            text, n, h, many, k, t, at = _unpack(r)
            if r["kind"]:
                out.append((k, t, at, n))
            else:
                held.add(text, n, h, many, k, t, at)
        if held.texts:
            text, n, h, many, k, t, at = held.all()
            number, times = _alike(text, n, h)
            times = times + np.bincount(number, many).astype(np.int64)
            one = np.empty(len(times), np.int64)
            one[number] = np.arange(len(n))
            # As in step 1, a region alone with its hash repeats no other.
            _, back, shared = np.unique(h[one], return_inverse=True, return_counts=True)
            some = np.flatnonzero(shared[back] > 1)
            which, first, length = _repeats(_taken(text, (np.cumsum(n) - n)[one[some]], n[one[some]]), n[one[some]], size)
            whole = np.flatnonzero(times > 1)  # all windows of these
            keep = times[some[which]] < 2
            which = np.concatenate([some[which][keep], whole])
            first = np.concatenate([first[keep], np.zeros(len(whole), np.int64)])
            length = np.concatenate([length[keep], n[one[whole]] - size + 1])
            order = np.argsort(which, kind="stable")
            which, first, length = which[order], first[order], length[order]
            open_ = np.flatnonzero(many == 0)  # places of the others are settled
            lo, hi = np.searchsorted(which, number[open_]), np.searchsorted(which, number[open_], "right")
            ref = np.repeat(open_, hi - lo)
            run_ = np.arange(len(ref)) + np.repeat(lo - (np.cumsum(hi - lo) - (hi - lo)), hi - lo)
            out.append((k[ref], t[ref], at[ref] + first[run_], length[run_]))
        columns = zip(*out, strict=True) if out else ((), (), (), ())
        kinds = (np.int64, np.int64, np.uint32, np.uint32)
        return C.by_slot(*(np.concatenate(x).astype(d) if len(x) else np.empty(0, d) for x, d in zip(columns, kinds, strict=True)), slots)

    return run


def _repeats(flat: np.ndarray, n: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, first, number) of the runs of windows found at two places of the
    given strings, from their suffix array."""
    if not len(n):
        return (np.empty(0, np.int64),) * 3
    ends = np.cumsum(n + 1)
    text = np.zeros(int(ends[-1]), np.int32)
    inside = np.ones(len(text), bool)
    inside[ends - 1] = False
    text[inside] = flat.astype(np.int32) + len(n)
    text[ends - 1] = np.arange(len(n))
    sa = suffix_array(text, len(n) + 256)
    long = common_prefixes(text, sa) >= size
    back = np.full(len(text), -1, np.int64)
    back[sa[1:]] = sa[:-1]
    long[back[long]] = True  # a repeat's predecessor in the order is one as well
    lo, hi = C.runs_of(long)
    row = np.searchsorted(ends, lo, "right")
    return row, lo - (ends - n - 1)[row], hi - lo


def _remove(size: int):
    def run(batches):
        for part in C.unsqueezed(batches):
            buf, offs = C.utf8(part.column("text"))
            out = []
            for i, (at, m) in enumerate(zip(part.column("at").to_pylist(), part.column("m").to_pylist(), strict=True)):
                data = buf[offs[i] : offs[i + 1]]
                cover = np.zeros(len(data) + 1, np.int64)
                first = C.places_of(at)
                np.add.at(cover, first, 1)
                np.add.at(cover, first + C.places_of(m) + size - 1, -1)
                gone = np.cumsum(cover)[:-1] > 0
                lo, hi = C.runs_of(gone)
                kept = data[~gone].tobytes()
                out.append((len(data), int(gone.sum()), len(lo), hashlib.sha256(kept).hexdigest(), kept, [[int(a), int(z)] for a, z in zip(lo, hi, strict=True)]))
            n, gone, spans, sha, kept, at = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha), pa.array(kept, pa.binary()), pa.array(at, pa.list_(pa.list_(pa.int32())))],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"],
            )

    return run


def dedup_suffixes(docs: DataFrame, size: int = 200, shard: int = SHARD) -> DataFrame:
    """Documents without repeated strings of `size` bytes or more: doc_id,
    n_bytes, n_removed, n_spans, kept_sha256, kept (bytes; a cut may fall
    within a character) and the removed byte spans. `shard` is about the
    number of text bytes behind one suffix array."""
    keyed = C.keyed(docs)
    total = C.text_bytes(keyed)
    marks = max(8, total // (1 << 25))
    buckets = max(8, total // (2 * shard))
    texts = C.squeezed(keyed)  # texts travel compressed
    hits = C.per_document(keyed.select("k", "t", "text").mapInArrow(S._send(_mark(size), marks, True), S.PACK).groupBy("bucket").applyInArrow(S._answer(True, marks), C.PLACES))
    regions = C.checkpoint(texts.join(hits, ["k", "t"]).select("k", "t", "z", "at").mapInArrow(_send(size, buckets), REGIONS))
    load = regions.groupBy("bucket").agg(F.ceil(F.sum(F.when(F.col("kind") == 0, F.octet_length("text"))) / F.lit(2 * shard)).cast("int").alias("parts"))
    heavy = C.checkpoint(load.where("parts > 1"))
    few = heavy.count() <= FEW
    dealt = regions.join(F.broadcast(heavy) if few else heavy, "bucket", "left").select(*[f for f, _ in _FIELDS], F.coalesce("parts", F.lit(1)).alias("parts")).mapInArrow(_split(size), REGIONS)
    repeats = C.per_document(dealt.groupBy("bucket", "sub").applyInArrow(_shard(size, marks), C.PLACES))
    return (
        texts.join(repeats, ["k", "t"], "left").select("doc_id", "z", "at", "m")
        .mapInArrow(_remove(size), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, spans array<array<int>>")
    )
