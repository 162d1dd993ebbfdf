"""Token ids in compressed binary files, and back.

Documents go in ascending doc_id order over range partitions. A partition's ids
are cut into chunks of about CHUNK_IDS, whole documents each; a chunk is one
container of blocks of up to 4096 ids that the context-mixing range coder codes
side by side, each with a checksum. A file set is a table of containers with
their place (part, chunk), written and read by Spark, so that any store works,
parts are retried and committed as a whole, and every chunk decodes by itself.

Cases: a null or empty text holds only the end id; a very long text is one
document of one chunk; equal doc_ids follow each other by a hash of the text,
null doc_ids come first; the string of a special token in a text is that token,
as the tokenizers library has it; an empty table gives an empty file set; other
columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from equiloom.llm import common as C
from equiloom.llm.mixing_coder import BLOCK, decode, encode, prior
from equiloom.llm.piece_encoder import Encoder

CHUNK_IDS = 4 << 20
LANES = 4096
MAGIC = b"CMR4"
_HEAD = "<5Q7I"
_SUM = "<I"
FORM = "part int, chunk int, n_docs long, n_ids long, data binary"


@lru_cache(1)
def _encoder(path: str) -> Encoder:
    """One for a worker process, whose tasks share its units."""
    return Encoder(path)


def pack(keys: np.ndarray, nulls: int, counts: np.ndarray, ids: np.ndarray) -> bytes:
    """A container: a checksum of header and tables; header; documents' keys
    (the first `nulls` are null) and counts, order 0, block sizes and checksums
    of the blocks' ids and codes; then the codes. Blocks are shorter where there
    are few ids, so that many move at once; the last is filled up with the
    commonest id."""
    block = int(min(BLOCK, max(64, -(-len(ids) // LANES))))
    n = -(-len(ids) // block)
    known, share = prior(ids) if n else (ids, ids.astype(np.uint32))
    rows = np.full(n * block, known[share.argmax()] if n else 0, np.uint16)
    rows[: len(ids)] = ids
    rows = rows.reshape(n, block)
    codes = encode(rows, known, share) if n else []
    tables = [C.spread(keys.astype(np.int64)), C.spread(counts.astype(np.uint32)), C.spread(C.steps(known)), C.spread(share), C.spread(np.array([len(c) for c in codes], np.uint32)), _sums(rows).tobytes(), np.array([zlib.crc32(c) for c in codes], np.uint32).tobytes()]
    head = struct.pack(_HEAD, len(keys), nulls, len(ids), n, block, *map(len, tables)) + b"".join(tables)
    return MAGIC + struct.pack(_SUM, zlib.crc32(head)) + head + b"".join(codes)


def _sums(rows: np.ndarray) -> np.ndarray:
    return np.array([zlib.crc32(r) for r in np.ascontiguousarray(rows, "<u2")], np.uint32)


def unpack(data: bytes) -> tuple[np.ndarray, int, np.ndarray, np.ndarray]:
    """What `pack` was given; a damaged container raises ValueError. Header and
    tables are believed once their checksum holds, a code once its own does, and
    its block once the ids' does."""
    at = len(MAGIC) + struct.calcsize(_SUM)
    begin = at + struct.calcsize(_HEAD)
    if data[: len(MAGIC)] != MAGIC or len(data) < begin:
        raise ValueError("not a token container")
    _, nulls, n_ids, n, block, *lengths = struct.unpack_from(_HEAD, data, at)
    codes_at = begin + sum(lengths)
    if struct.unpack_from(_SUM, data, len(MAGIC))[0] != zlib.crc32(memoryview(data)[at:codes_at]):
        raise ValueError("the header's checksum differs")
    tables, at = [], begin
    for size in lengths:
        tables.append(data[at : at + size])
        at += size
    keys, counts = C.gather(tables[0], np.int64), C.gather(tables[1], np.uint32)
    known, share = np.cumsum(C.gather(tables[2], np.uint16), dtype=np.uint16), C.gather(tables[3], np.uint32)
    ends = codes_at + np.cumsum(C.gather(tables[4], np.uint32).astype(np.int64))
    if len(data) != (ends[-1] if n else codes_at):
        raise ValueError("the container's length differs")
    if not n:
        return keys, nulls, counts, np.empty(0, np.uint16)
    codes = [data[a:z] for a, z in zip(np.append(codes_at, ends[:-1]).tolist(), ends.tolist(), strict=True)]
    if any(zlib.crc32(c) != x for c, x in zip(codes, np.frombuffer(tables[6], np.uint32).tolist(), strict=True)):
        raise ValueError("a code's checksum differs")
    rows = decode(codes, block, known, share)
    if (_sums(rows) != np.frombuffer(tables[5], np.uint32)).any():
        raise ValueError("a block's checksum differs")
    return keys, nulls, counts, rows.ravel()[:n_ids]


def write_tokens(docs: DataFrame, vocabulary: str, folder: str, end: int = 2) -> None:
    """Encode whole texts with the tokenizer file `vocabulary` (ids below
    65536) and write them to `folder`."""

    def run(batches):
        encoder = _encoder(vocabulary)
        part, chunk, held, keys, counts, size, nulls = TaskContext.get().partitionId(), 0, [], [], [], 0, 0

        def row():
            ids = np.concatenate(held)
            data = pack(np.concatenate(keys), nulls, np.concatenate(counts), ids)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([chunk], pa.int32()), pa.array([sum(map(len, keys))], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([data], pa.binary())],
                ["part", "chunk", "n_docs", "n_ids", "data"],
            )

        for piece in C.slices(batches):
            ids, n = encoder(*C.utf8(piece.column("text")), end)
            held.append(ids)
            keys.append(piece.column("k").to_numpy())
            counts.append(n)
            size, nulls = size + len(ids), nulls + piece.column("doc_id").null_count
            if size >= CHUNK_IDS:
                yield row()
                chunk, held, keys, counts, size, nulls = chunk + 1, [], [], [], 0, 0
        if held:
            yield row()
        held, keys, counts = [], [], []
        C.give_back()

    keyed = C.keyed(docs)
    parts = max(8, C.text_bytes(keyed) // (24 << 20))
    order = [F.col("doc_id").asc_nulls_first(), F.col("t")]
    # Texts go as they are: sampling for the ranges reads them all as well, and
    # compressing them there and here took longer than it saved.
    keyed.repartitionByRange(int(parts), *order).sortWithinPartitions(*order).mapInArrow(run, FORM).write.parquet(folder)


def read_tokens(spark, folder: str, with_ids: bool = True) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32 and, if
    asked for, the ids. `start` adds up the containers before, by their counts."""
    tail = ", ids array<int>" if with_ids else ""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                keys, nulls, counts, ids = unpack(batch.column("data")[i].as_py())
                ends = np.cumsum(counts.astype(np.int64))
                wide = ids.astype("<u4")
                crc = [zlib.crc32(wide[z - n : z]) for n, z in zip(counts.tolist(), ends.tolist(), strict=True)]
                lists = [pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(ids.astype(np.int32)))] if with_ids else []
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(keys), batch.column("part")[i].as_py()), pa.int32()), pa.array(np.full(len(keys), batch.column("chunk")[i].as_py()), pa.int32()),
                     pa.array(keys, mask=np.arange(len(keys)) < nulls), pa.array(ends - counts), pa.array(counts, pa.int64()), pa.array(crc, pa.int64()), *lists],
                    ["part", "chunk", "doc_id", "inside", "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])],
                )
        C.give_back()

    files = spark.read.schema(FORM).parquet(folder)
    place = files.select("part", "chunk", "n_ids")
    back = Window.unboundedPreceding
    before = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(back, -1)), F.lit(0))
    # One narrow row a part, which is 24 MB of text or more: these fit one task.
    parts = place.groupBy("part").agg(F.sum("n_ids").alias("n_ids")).select("part", before(Window.orderBy("part")).alias("a"))
    base = place.select("part", "chunk", before(Window.partitionBy("part").orderBy("chunk")).alias("b")).join(parts, "part").select("part", "chunk", (F.col("a") + F.col("b")).alias("base"))
    rows = files.select("part", "chunk", "data").mapInArrow(run, f"part int, chunk int, doc_id long, inside long, n_tokens long, ids_crc32 long{tail}")
    return rows.join(base, ["part", "chunk"]).select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def round_trip(docs: DataFrame, vocabulary: str, end: int = 2, with_ids: bool = False) -> DataFrame:
    """Write the documents' ids below the shared checkpoint folder; what the
    files hold."""
    spark = docs.sparkSession
    folder = f"{C.shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, vocabulary, folder, end)
    return read_tokens(spark, folder, with_ids)
