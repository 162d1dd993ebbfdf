"""Substring dedup over words with fixed-block anchors.

Any window of ``size`` words holds a whole block of ``(size + 1) // 2`` words
that starts at a multiple of that length. So:

1. *Index and probe.* Every document's aligned blocks are indexed and every
   rolling window of block length probes them. Both travel as sorted 32-bit keys
   within hash buckets (about two bytes a probe), each task sending a key once.
   A block is hit if its key was probed from anywhere else.
2. *Extend.* Each hit block is extended to all windows of ``size`` words around
   it, whose 96-bit hashes meet in buckets again; windows met twice are exact
   repeats, and consecutive ones join into maximal repeats.
3. *Remove.* Words covered by a repeated window go.

A key seen twice in one task is settled there, so a passage that a third of all
documents share reaches a bucket once per task. Bucket counts follow the bytes
of the input. Nothing is paired within a group.

Cases: null or empty text has no words; a document under ``size`` words loses
none; equal rows are repeats of each other and both lose their words; an empty
table gives an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equiloom.llm import common as C

FLUSH = 1 << 21
PACK = "bucket int, kind int, k binary, t binary, n binary, at binary, m binary, h binary, l binary"


class _Pile:
    """Hashed places of a task's documents, sent on by bucket.

    `spot` places need an answer (their count elsewhere); others only answer.
    """

    def __init__(self, buckets: int, exact: bool):
        self.buckets, self.exact, self.parts, self.n = buckets, exact, [], 0

    def add(self, k, t, row, at, h, low, spot):
        if len(h):
            self.parts.append((k[row], t[row], at.astype(np.uint32), h, low, spot))
            self.n += len(h)

    def flush(self):
        if not self.n:
            return
        k, t, at, h, low, spot = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.parts, self.n = [], 0
        order = np.lexsort((low, h)) if self.exact else np.argsort(h, kind="stable")
        hs, ls = h[order], low[order]
        new = np.ones(len(hs), bool)
        new[1:] = (hs[1:] != hs[:-1]) | (ls[1:] != ls[:-1]) if self.exact else hs[1:] != hs[:-1]
        group = np.cumsum(new) - 1
        many = np.bincount(group) > 1
        heads = np.flatnonzero(new)
        twice = np.empty(len(hs), bool)
        twice[order] = many[group]
        # 0: keys that answer, 1: those seen twice here; 2: places to answer, 3: places settled here.
        for kind, pick in ((0, order[heads[~many]]), (1, order[heads[many]])):
            if self.exact and kind == 0:
                continue
            yield from self._rows(kind, np.sort(pick) if self.exact else pick, k, t, at, h, low)
        for kind, pick in ((2, np.flatnonzero(spot & ~twice)), (3, np.flatnonzero(spot & twice))):
            yield from self._rows(kind, pick, k, t, at, h, low)

    def _rows(self, kind, pick, k, t, at, h, low):
        """Kind 3 needs no hash and goes by its document, so that a passage which
        many documents share fills no bucket; kinds 0 and 1 need no place."""
        bucket = C.slot_of(k[pick], t[pick], self.buckets) if kind == 3 else (h[pick] % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        pick, bucket = pick[order], bucket[order]
        cuts = np.searchsorted(bucket, np.arange(self.buckets + 1))
        for b in np.flatnonzero(np.diff(cuts)):
            p = pick[cuts[b] : cuts[b + 1]]
            row = {"bucket": int(b), "kind": kind, "k": None, "t": None, "n": None, "at": None, "m": None, "h": None, "l": None}
            if kind >= 2:
                row |= C.pack_places(k[p], t[p], at[p], np.zeros(len(p), np.uint32))
            if kind != 3:
                key = (h[p] >> np.uint64(32)).astype(np.uint32)
                row["h"] = C.spread(h[p]) if self.exact else C.spread(C.steps(key) if kind < 2 else key)
                row["l"] = C.spread(low[p]) if self.exact else None
            yield row


def _keys(row, exact: bool):
    if exact:
        h = C.gather(row["h"], np.uint64)
        out = np.empty(len(h), [("h", np.uint64), ("l", np.uint32)])
        out["h"], out["l"] = h, C.gather(row["l"], np.uint32)
        return out
    key = C.gather(row["h"], np.uint32)
    return np.cumsum(key, dtype=np.uint32) if row["kind"] < 2 else key


def _answer(exact: bool, slots: int):
    """Per bucket: the places whose key came from anywhere else too."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        seen, once, spots, out = [], [], [], []
        for r in rows:
            if r["kind"] < 2:
                (seen if r["kind"] else once).append(_keys(r, exact))
            elif r["kind"] == 2:
                spots.append((C.unpack_places(r), _keys(r, exact)))
            else:
                out.append((C.unpack_places(r), None))
        if spots:
            keys = [*(s[1] for s in spots)] if exact else once
            every = np.concatenate([*keys, *seen, *seen])  # those seen twice count twice
            if exact:
                order = np.lexsort((every["l"], every["h"]))
                s = every[order]
                new = np.ones(len(s), bool)
                new[1:] = (s["h"][1:] != s["h"][:-1]) | (s["l"][1:] != s["l"][:-1])
                group = np.cumsum(new) - 1
                hit = np.empty(len(s), bool)
                hit[order] = (np.bincount(group) > 1)[group]
                at = 0
                for i, (place, key) in enumerate(spots):
                    spots[i] = (place, hit[at : at + len(key)])
                    at += len(key)
            else:
                every.sort()
                many = np.unique(every[1:][every[1:] == every[:-1]])
                for i, (place, key) in enumerate(spots):
                    j = np.minimum(np.searchsorted(many, key), max(len(many) - 1, 0))
                    spots[i] = (place, many[j] == key if len(many) else np.zeros(len(key), bool))
            out += spots
        kept = [[x if hit is None else x[hit] for x in place] for place, hit in out]
        if not kept:
            return C.by_slot(*(np.empty(0, d) for d in (np.int64, np.int64, np.uint32, np.uint32)), slots)
        return C.by_slot(*(np.concatenate(x) for x in zip(*kept, strict=True)), slots)

    return run


_SCHEMA = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), *((c, pa.binary()) for c in ("k", "t", "n", "at", "m", "h", "l"))])


def _send(fill, buckets: int, exact: bool, cut=C.slices):
    """A map over batches: `fill(pile, slice)` adds places; rows go out as piles fill."""

    def run(batches):
        pile = _Pile(buckets, exact)
        for part in cut(batches):
            fill(pile, part)
            if pile.n >= FLUSH:
                yield from _batches(pile)
        yield from _batches(pile)
        C.give_back()

    def _batches(pile):
        for row in pile.flush():
            yield pa.RecordBatch.from_pylist([row], _SCHEMA)

    return run


def _columns(part):
    return part.column("k").to_numpy(), part.column("t").to_numpy()


def _probe(size: int, block: int):
    def fill(pile, part):
        k, t = _columns(part)
        buf, offs = C.utf8(part.column("text"))
        starts, ends, first = C.words(buf, offs)
        gram = C.mix(C.ngrams(C.word_hashes(buf, starts, ends), block))
        row, rank = C.inside_rows(first, len(starts))
        row, rank = row[: len(gram)], rank[: len(gram)]
        n = np.diff(first)[row]
        ok = (rank + block <= n) & (n >= size)
        row, rank = row[ok], rank[ok]
        pile.add(k, t, row, rank // block, gram[ok], np.zeros(len(row), np.uint32), rank % block == 0)

    return fill


def _extend(size: int, block: int):
    def fill(pile, part):
        k, t = _columns(part)
        buf, offs = C.utf8(part.column("text"))
        starts, ends, first = C.words(buf, offs)
        hashes = C.word_hashes(buf, starts, ends)
        gram = C.ngrams(hashes, size)
        hit = np.zeros(len(starts) + block + 1, bool)
        for i, at in enumerate(part.column("at").to_pylist()):
            hit[first[i] + C.places_of(at) * block] = True
        row, rank = C.inside_rows(first, len(starts))
        row, rank = row[: len(gram)], rank[: len(gram)]
        at = np.arange(len(gram))
        ok = (rank + size <= np.diff(first)[row]) & hit[at - rank + -(-rank // block) * block]
        low = (C.mix(gram[ok] ^ C._K2 * C.mix(hashes[at[ok]] + C._K1) ^ C.mix(C.ngrams(C.mix(hashes ^ C._K1), size)[ok])) >> np.uint64(32)).astype(np.uint32)
        pile.add(k, t, row[ok], rank[ok], C.mix(gram[ok]), low, np.ones(len(low), bool))

    return fill


def _remove(size: int):
    def run(batches):
        for part in C.unsqueezed(batches):
            buf, offs = C.utf8(part.column("text"))
            starts, ends, first = C.words(buf, offs)
            out = []
            places = part.column("at").to_pylist()
            for i in range(part.num_rows):
                a, z = int(first[i]), int(first[i + 1])
                cover = np.zeros(z - a + 1, np.int64)
                at = C.places_of(places[i])
                np.add.at(cover, at, 1)
                np.add.at(cover, at + size, -1)
                gone = np.cumsum(cover)[:-1] > 0
                keep = np.flatnonzero(~gone) + a
                kept = b" ".join([buf[s:e].tobytes() for s, e in zip(starts[keep], ends[keep], strict=True)])
                lo, hi = C.runs_of(gone)
                out.append((z - a, int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode(), [[int(x), int(y)] for x, y in zip(lo, hi, strict=True)]))
            n, gone, sha, text, spans = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha), pa.array(text), pa.array(spans, pa.list_(pa.list_(pa.int32())))],
                ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text", "spans"],
            )

    return run


def dedup_substrings(docs: DataFrame, size: int = 35) -> DataFrame:
    """Documents without repeated passages of `size` words or more: doc_id,
    n_words, n_removed, kept_sha256, kept_text and the removed word spans."""
    if size < 2:
        raise ValueError("size must be at least 2")
    block = (size + 1) // 2
    keyed = C.keyed(docs)
    total = C.text_bytes(keyed)
    buckets = max(8, total // (6 << 21))
    texts = C.squeezed(keyed)  # texts travel compressed
    hits = C.per_document(keyed.select("k", "t", "text").mapInArrow(_send(_probe(size, block), buckets, False), PACK).groupBy("bucket").applyInArrow(_answer(False, buckets), C.PLACES))
    windows = texts.join(hits, ["k", "t"]).select("k", "t", "z", "at").mapInArrow(_send(_extend(size, block), buckets, True, C.unsqueezed), PACK)
    repeats = C.per_document(windows.groupBy("bucket").applyInArrow(_answer(True, buckets), C.PLACES))
    return (
        texts.join(repeats, ["k", "t"], "left").select("doc_id", "z", "at")
        .mapInArrow(_remove(size), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string, spans array<array<int>>")
    )


def oracle(size: int = 35) -> str:
    """The digest columns in DuckDB SQL, by counting every window."""
    return f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
p AS (SELECT r, i, md5(array_to_string(w[i:i + {size - 1}], ' ')) AS g FROM (SELECT r, w, unnest(range(1, len(w) - {size - 2})) AS i FROM d)),
hit AS (SELECT r, i FROM p WHERE g IN (SELECT g FROM p GROUP BY g HAVING count(*) > 1)),
gone AS (SELECT DISTINCT r, unnest(range(i, i + {size})) AS j FROM hit),
each AS (SELECT r, w[j] AS word, j FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS j FROM d)),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY j) AS text FROM each ANTI JOIN gone USING (r, j) GROUP BY r),
n AS (SELECT r, count(*) AS n FROM gone GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n.n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r) LEFT JOIN n USING (r)"""
