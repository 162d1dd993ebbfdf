"""SimHash near-dedup by anchor-point covering.

A fingerprint pair within ``bits`` differing bits is within ``bits // 2`` in one
of its 32-bit halves. The 31 low bits of a half are covered by the perfect
Hamming [31, 26] code: each value has one codeword, its home, within the
covering radius 1, and every value within r of it has that codeword within
r + 1. So a fingerprint is replicated to all anchors within r + 1 in either
half; at each anchor those at home are compared on all 64 bits with all that
came. Equal fingerprints go as one, a crowded anchor is dealt over a grid of
groups, and an anchor reports a spanning set of its links, not all pairs.

Cases: a null or empty text has fingerprint zero and links like any other; a
very long text is fingerprinted whole, in stretches of shingles; a
text under ``width`` words is one shingle; a null doc_id is a row like any other
and no component's id unless all its ids are null; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equiloom.llm import common as C
from equiloom.llm.components import components

#: Fingerprints at one anchor that one group compares.
CROWD = 1 << 14
_STEP = 1 << 10


def _print(text: bytes, width: int) -> int:
    word = text.lower().split()
    if not word:
        return 0
    line = b" ".join(word)
    ends = np.cumsum([len(w) + 1 for w in word]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(word) - width + 1)
    digest = xxhash.xxh64_intdigest
    total = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 15):
        to = min(n, at + (1 << 15))
        last = ends[min(width, len(word)) - 1 :][at:to].tolist()
        h = np.array([digest(line[a:z], 42) for a, z in zip(starts[at:to].tolist(), last, strict=True)], np.uint64)
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, k, t, fp): 64-bit SimHash of the word shingles of whole texts."""

    def run(batches):
        for batch in batches:
            fp = pa.array([_print(x.encode(), width) for x in batch.column("text").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "k", "t")] + [fp], ["doc_id", "k", "t", "fp"])

    return C.keyed(docs).mapInArrow(run, "doc_id long, k long, t long, fp long")


def _syndrome(mask: int) -> int:
    out = 0
    for bit in range(31):
        if mask >> bit & 1:
            out ^= bit + 1
    return out


def _anchors(value: Column, radius: int) -> Column:
    """Array of (anchor, at home) for the 31 low bits of a long."""
    by: list[list[tuple[int, int]]] = [[] for _ in range(32)]
    for weight in range(radius + 1):
        for places in combinations(range(31), weight):
            mask = sum(1 << p for p in places)
            by[_syndrome(mask)].append((mask, weight))
    table = F.array(*[F.array(*[F.struct(F.lit(m).cast("long").alias("mask"), F.lit(w <= 1).alias("home")) for m, w in row]) for row in by])
    low = value.bitwiseAND(F.lit(0x7FFFFFFF))
    code = sum(
        (F.bit_count(low.bitwiseAND(F.lit(sum(1 << b for b in range(31) if (b + 1) >> i & 1)))) % 2) * F.lit(1 << i) for i in range(5)
    )
    return F.transform(F.element_at(table, code + 1), lambda x: F.struct(low.bitwiseXOR(x["mask"]).alias("anchor"), x["home"].alias("home")))


def _compare(bits: int):
    """Over rows ordered by group and home first: a spanning set of the links
    of each group, streaming over its visitors."""

    def links(home: np.ndarray, others) -> list:
        root = np.arange(len(home))

        def find(i):
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        out = []
        for visitor in others:
            for a in range(0, len(visitor), _STEP):
                block = visitor[a : a + _STEP]
                first = np.full(len(block), -1)
                for b in range(0, len(home), _STEP):
                    near = np.bitwise_count(block[:, None] ^ home[None, b : b + _STEP]) <= bits
                    v, h = np.nonzero(near)
                    if not len(v):
                        continue
                    new = np.ones(len(v), bool)
                    new[1:] = v[1:] != v[:-1]
                    lead = np.where(first[v] >= 0, first[v], (h[np.flatnonzero(new)][np.cumsum(new) - 1]) + b)
                    first[v[new]] = lead[new]
                    pairs = np.unique(lead * len(home) + h + b)
                    for p in pairs[pairs // len(home) != pairs % len(home)]:
                        x, y = find(p // len(home)), find(p % len(home))
                        root[max(x, y)] = min(x, y)
                got = first >= 0
                out += zip(block[got].tolist(), home[first[got]].tolist(), strict=True)
        out += [(int(home[i]), int(home[find(i)])) for i in range(len(home)) if root[i] != i]
        return [(u, v) for u, v in out if u != v]

    def run(batches):
        key, home, open_, visitors, out = None, [], False, [], []
        for batch in batches:
            g = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("band", "salt", "anchor")]
            fp = batch.column("fp").to_numpy().view(np.uint64)
            at_home = batch.column("home").to_numpy(zero_copy_only=False)
            new = np.ones(len(fp), bool)
            new[1:] = (g[0][1:] != g[0][:-1]) | (g[1][1:] != g[1][:-1]) | (g[2][1:] != g[2][:-1])
            cuts = np.append(np.flatnonzero(new), len(fp))
            for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                now = (g[0][a], g[1][a], g[2][a])
                if now != key:
                    if home and len(visitors):
                        out += links(np.concatenate(home), visitors)
                    key, home, visitors = now, [], []
                h = at_home[a:z]
                if h.any():
                    home.append(fp[a:z][h])
                if home and not h.all():
                    visitors.append(fp[a:z][~h])
            if len(out):
                yield _pairs(out)
                out = []
        if home:
            out += links(np.concatenate(home), visitors)
        yield _pairs(out)

    def _pairs(out):
        u, v = (np.array(x, np.uint64).view(np.int64) for x in (zip(*out, strict=True) if out else ((), ())))
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    return run


def near_links(prints: DataFrame, bits: int = 3) -> DataFrame:
    """From distinct fingerprints (fp) to links (u, v) that span exactly the
    components of the pairs within `bits`."""
    radius = bits // 2
    if radius > 2:
        raise ValueError("bits must be at most 5: beyond, anchors no longer separate")
    half = [F.col("fp"), F.shiftrightunsigned("fp", 32)]
    # The bit that a half has besides its 31 is left out of the anchor only.
    sent = prints.select(
        "fp", F.explode(F.array(*[F.struct(F.lit(i).alias("band"), _anchors(h, radius + 1).alias("to")) for i, h in enumerate(half)])).alias("b")
    ).select("fp", "b.band", F.explode("b.to").alias("a")).select("fp", "band", "a.anchor", "a.home")
    crowded = sent.groupBy("band", "anchor").count().where(F.col("count") > CROWD).select("band", "anchor", F.ceil(F.col("count") / CROWD).cast("int").alias("parts"))
    # A crowded anchor is a grid: those at home in one of its rows, all in one of
    # its columns; who is at home visits as well.
    parts = F.coalesce("parts", F.lit(1))
    mine = F.pmod(F.xxhash64("fp"), parts).cast("int")
    line = F.sequence(F.lit(0), parts - 1)
    as_home = F.transform(line, lambda i: F.struct((mine * parts + i).alias("salt"), F.lit(True).alias("home")))
    as_guest = F.transform(line, lambda i: F.struct((i * parts + mine).alias("salt"), F.lit(False).alias("home")))
    cells = F.when(F.col("home"), F.concat(as_home, as_guest)).otherwise(as_guest)
    dealt = sent.join(crowded, ["band", "anchor"], "left").select("band", "anchor", "fp", F.explode(cells).alias("to")).select("band", "anchor", "fp", "to.salt", "to.home")
    return dealt.repartition("band", "anchor", "salt").sortWithinPartitions("band", "salt", "anchor", F.desc("home")).mapInArrow(_compare(bits), "u long, v long")


def near_components(docs: DataFrame, bits: int = 3, width: int = 3) -> DataFrame:
    """One row per document: doc_id, k, t, fp, fingerprint (hex), component_id,
    the smallest doc_id reachable over links of `bits` bits, and component, its
    smallest fingerprint, which tells components apart where doc_ids repeat."""
    prints = C.checkpoint(fingerprints(docs, width))
    nodes = C.checkpoint(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    # Each fingerprint becomes 28 rows: dealt out first, so that no task makes them all.
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, nodes.count() // 200_000)
    label = components(near_links(nodes.select("fp").repartition(int(tasks)), bits)).select(F.col("u").alias("fp"), "m")
    named = C.checkpoint(nodes.join(label, "fp", "left").select("fp", "least", F.coalesce("m", "fp").alias("m")))
    ids = named.groupBy("m").agg(F.min("least").alias("component_id"))
    return prints.join(named.join(ids, "m").select("fp", "component_id", F.col("m").alias("component")), "fp").select(
        "doc_id", "k", "t", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "component"
    )


def keep_one(docs: DataFrame, bits: int = 3, width: int = 3) -> DataFrame:
    """The document with the smallest doc_id of each component, as it was;
    repeated rows of it go."""
    groups = near_components(docs, bits, width)
    first = F.min(F.struct("k", "t")).alias("s")
    stay = groups.where(F.col("k") == F.coalesce("component_id", F.lit(C.NULL_KEY))).groupBy("component").agg(first)
    return C.only(docs, stay.select("s.k", "s.t"))
