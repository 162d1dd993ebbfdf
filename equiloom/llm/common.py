"""Shared pieces of the training-data operators: document keys, vectorised text
views over Arrow batches, n-gram hashing and compact array packing.

Rows of a document table are addressed by ``(k, t)``: ``k`` is the doc_id (null
becomes the smallest long) and ``t`` a 64-bit hash of the text, so repeated
doc_ids with different texts do not share positions, and repeated equal rows
share them rightly. The doc_id itself travels beside the key.
"""

from __future__ import annotations

import ctypes
import re
import tempfile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Whitespace that ends a word: space and U+0009..U+000D.
WORD = r"[^\x20\x09-\x0D]+"
NULL_KEY = -(2**63)
CHUNK = 2 << 20
_WS = np.zeros(256, bool)
_WS[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_C1, _C2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_POS = np.random.Generator(np.random.PCG64(20240607)).integers(0, 2**63, 2048, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

_POS[1024] = 1  # a word's first 1024 bytes hash alike whether longer words are near or not


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def shared_folder(spark) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Only a session
    within one machine, as in tests, may go without and gets one of its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="ckpt"))
    return sc.getCheckpointDir()


def give_back() -> None:
    """Return a finished task's free memory to the machine: Python workers live
    on and would hold it through the next stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: it keeps what it has
        return


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, k, t, text) with a null text as the empty text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_KEY)).alias("k"),
        F.xxhash64(text).alias("t"),
        text.alias("text"),
    )


def own_columns(docs: DataFrame, *wanted: str) -> list[str]:
    """Names for working columns, unlike any that the table has."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def only(docs: DataFrame, stay: DataFrame) -> DataFrame:
    """The rows of docs at the keys (k, t) of `stay`, as they were, one of each."""
    k, t = own_columns(docs, "k", "t")
    text = F.coalesce(F.col("text"), F.lit(""))
    tagged = docs.withColumns({k: F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_KEY)), t: F.xxhash64(text)})
    return tagged.join(stay.select(F.col("k").alias(k), F.col("t").alias(t)), [k, t], "left_semi").dropDuplicates([k, t]).drop(k, t)


def squeezed(keyed: DataFrame) -> DataFrame:
    """(doc_id, k, t, z): each text compressed by itself, for an exchange."""

    def run(batches):
        pack = zstandard.ZstdCompressor(level=1).compress
        for part in slices(batches):
            z = pa.array([pack(x.as_buffer() or b"") for x in part.column("text").cast(pa.large_binary())], pa.binary())
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "k", "t")), z], ["doc_id", "k", "t", "z"])

    return keyed.mapInArrow(run, "doc_id long, k long, t long, z binary")


def unsqueezed(batches, size: int = CHUNK):
    """Record batches with column 'text' in place of 'z', each with about
    `size` bytes of text or one longer document."""
    unpack = zstandard.ZstdDecompressor().decompress

    def cut(batch, rows, texts):
        part = batch.take(pa.array(rows)) if len(rows) != batch.num_rows else batch
        names = [c for c in part.schema.names if c != "z"]
        return pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(texts, pa.large_binary())], [*names, "text"])

    for batch in batches:
        rows, texts, held = [], [], 0
        for i, z in enumerate(batch.column("z")):
            text = unpack(z.as_buffer())
            if held and held + len(text) > size:
                yield cut(batch, rows, texts)
                rows, texts, held = [], [], 0
            rows.append(i)
            texts.append(text)
            held += len(text) + 1
        if rows:
            yield cut(batch, rows, texts)


def text_bytes(docs: DataFrame) -> int:
    """Total UTF-8 bytes: sizes the hash buckets, so that their number grows
    with the data and each stays bounded."""
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def lower(buf: np.ndarray) -> np.ndarray:
    """A-Z in lower case, other bytes unchanged."""
    return _LOWER[buf]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x *= _C1
    x ^= x >> np.uint64(33)
    x *= _C2
    x ^= x >> np.uint64(33)
    return x


def join2(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    c = a * _K1
    c += (b ^ (b >> np.uint64(31))) * _K2
    c ^= c >> np.uint64(32)
    return c


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n items; shorter than the input by n - 1."""
    if len(h) < n:
        return h[:0]
    out, have, power, size = None, 0, h, 1
    while True:
        if n & size:
            out, have = (power, size) if out is None else (join2(out[: len(h) - have - size + 1], power[have : have + len(h) - have - size + 1]), have + size)
        if have == n:
            return out
        power = join2(power[:-size], power[size:])
        size *= 2


def slices(batches, size: int = CHUNK):
    """Record batches cut so that each holds about `size` bytes of text (column
    'text'), or one longer document."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + size, "right")))
            yield batch.slice(at, to - at)
            at = to


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offsets of its rows in them."""
    col = pc.fill_null(col, b"" if pa.types.is_large_binary(col.type) else "").cast(pa.large_binary())
    _, off, data = col.buffers()
    offs = np.frombuffer(off, np.int64)[col.offset : col.offset + len(col) + 1]
    buf = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.empty(0, np.uint8)
    return buf, offs - offs[0]


def words(buf: np.ndarray, offs: np.ndarray, space: np.ndarray = _WS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the words' offsets by row."""
    n = len(buf)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offs), np.int64)
    inside = ~space[buf]
    first = np.zeros(n + 1, bool)
    first[offs] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | first[1:n]
    end = inside
    end[:-1] &= ~inside[1:] | first[1:n]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: bytes times multipliers drawn per position."""
    if not len(starts):
        return np.empty(0, np.uint64)
    size = ends - starts
    total = int(size.sum())
    at = np.zeros(len(starts), np.int64)
    np.cumsum(size[:-1], out=at[1:])
    rank = np.arange(total) - np.repeat(at, size)
    byte = buf[np.repeat(starts, size) + rank].astype(np.uint64) + np.uint64(1)
    byte *= _POS[rank & 1023]
    if size.max() > 1024:
        byte *= _POS[1024 + ((rank >> 10) & 1023)]
    return mix(np.add.reduceat(byte, at) + size.astype(np.uint64) * _K1)


def inside_rows(starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For items laid out by row offsets: the row of each item and its rank."""
    row = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    return row, np.arange(n) - starts[row]


def spread(a: np.ndarray) -> bytes:
    """An array's bytes by plane, compressed."""
    a = np.ascontiguousarray(a)
    return zstandard.compress(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() if len(a) else b"", 1)


def gather(b: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(b), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).ravel()


def steps(a: np.ndarray) -> np.ndarray:
    """First differences, for ascending arrays."""
    return np.diff(a, prepend=a.dtype.type(0))


def runs_of(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.diff(np.concatenate(([0], flags.view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


#: Places (document key, position and a number beside it) packed by `slot`.
PLACES = "slot int, k binary, t binary, n binary, at binary, m binary"
PER_DOC = "k long, t long, at binary, m binary"


def pack_places(k: np.ndarray, t: np.ndarray, at: np.ndarray, m: np.ndarray) -> dict[str, bytes]:
    """Arrays ordered by document and ascending `at` within each, compressed."""
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (t[1:] != t[:-1])
    heads = np.flatnonzero(new)
    at = at.astype(np.uint32)
    step = steps(at)
    step[heads] = at[heads]
    n = np.diff(np.append(heads, len(k))).astype(np.uint32)
    return {"k": spread(k[heads]), "t": spread(t[heads]), "n": spread(n), "at": spread(step), "m": spread(m.astype(np.uint32))}


def unpack_places(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n = gather(row["n"], np.uint32).astype(np.int64)
    step = gather(row["at"], np.uint32).astype(np.int64)
    total = np.cumsum(step)
    heads = np.cumsum(n) - n
    at = (total - np.repeat(total[heads] - step[heads], n)).astype(np.uint32)
    return np.repeat(gather(row["k"], np.int64), n), np.repeat(gather(row["t"], np.int64), n), at, gather(row["m"], np.uint32)


def slot_of(k: np.ndarray, t: np.ndarray, slots: int) -> np.ndarray:
    """The slot of a document."""
    return (mix(k.view(np.uint64) ^ (t.view(np.uint64) * _K1)) % np.uint64(slots)).astype(np.int64)


def by_slot(k: np.ndarray, t: np.ndarray, at: np.ndarray, m: np.ndarray, slots: int) -> pa.Table:
    """Rows of PLACES, so that all places of a document share a slot."""
    slot = slot_of(k, t, slots)
    order = np.lexsort((at, t, k, slot))
    slot, k, t, at, m = slot[order], k[order], t[order], at[order], m[order]
    cuts = np.append(np.flatnonzero(np.diff(slot, prepend=-1)), len(slot))
    rows = [{"slot": int(slot[a])} | pack_places(k[a:z], t[a:z], at[a:z], m[a:z]) for a, z in zip(cuts[:-1], cuts[1:], strict=True)]
    return pa.Table.from_pylist(rows, pa.schema([("slot", pa.int32()), *((c, pa.binary()) for c in ("k", "t", "n", "at", "m"))]))


def _per_doc(table: pa.Table) -> pa.Table:
    k, t, at, m = (np.concatenate(x) for x in zip(*map(unpack_places, table.to_pylist()), strict=True))
    order = np.lexsort((at, t, k))
    k, t, at, m = k[order], t[order], at[order], m[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (t[1:] != t[:-1])
    cuts = np.append(np.flatnonzero(new), len(k))
    pairs = list(zip(cuts[:-1], cuts[1:], strict=True))
    return pa.table({"k": k[cuts[:-1]], "t": t[cuts[:-1]], "at": pa.array([spread(at[a:z]) for a, z in pairs], pa.binary()), "m": pa.array([spread(m[a:z]) for a, z in pairs], pa.binary())})


def per_document(places: DataFrame) -> DataFrame:
    """One row (k, t, at, m) for each document that has places."""
    return places.groupBy("slot").applyInArrow(_per_doc, PER_DOC)


def places_of(at: bytes | None) -> np.ndarray:
    return gather(at, np.uint32).astype(np.int64) if at else np.empty(0, np.int64)
