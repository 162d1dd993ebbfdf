"""Filter interaction audit over a packed bitmap index.

Each document gets one bit a filter (set if it fails) and one a mark (good,
toxic). Within a task the rows of a part lie in a run of whole 64-bit words, one
bitset for each filter, each mark and the rows themselves. For each subset of
filters applied before, and each other filter, AND-NOT and popcount give what
that filter removes; the counts of all tasks are added up, and every order of
the filters is put together from them. Rows never meet by part or by copy.

Cases: a null text is the empty text, a null source the empty part; an empty
table gives no row; a null doc_id is neither smaller nor larger than another, so
its text is no earlier copy and it is none; equal doc_ids are not smaller than
each other; each repeated row counts. A very long text is one row's work.
Several labels of one doc_id count together (marked if any marks it); other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from equiloom.llm import common as C

FILTERS = "ABCDE"
MARKS = ("good", "toxic")
COPY = 4  # the filter that looks at the whole table, by its place in FILTERS
MIN_WORDS, DISTINCT_SHARE, UPPER_SHARE = 200, 50, 2
ROWS = 1 << 19  # rows of one bitmap index within a task
_UPPER, _SIGNS = bytes(range(65, 91)), b"#$%&*|"
_FOLLOW = bytes(range(128, 192))  # bytes of a character after its first
COUNTS = "part string, seen int, filter int, n long, gone long, removed long, " + ", ".join(f"{m}_lost long" for m in MARKS)


def text_bits(text: bytes) -> int:
    """The filters that look at one text, a bit each."""
    words = text.split()  # of bytes: at space and U+0009..U+000D
    bits = len(words) < MIN_WORDS
    bits |= (100 * len(set(words)) < DISTINCT_SHARE * len(words)) << 1
    bits |= (100 * (len(text) - len(text.translate(None, _UPPER))) > UPPER_SHARE * len(text.translate(None, _FOLLOW))) << 2
    return bits | any(c in text for c in _SIGNS) << 3


def _read(batches):
    for batch in batches:
        for part in C.slices([batch]):
            texts = [x.as_buffer().to_pybytes() for x in pc.fill_null(part.column("text").cast(pa.large_binary()), b"")]
            key = pa.array([hashlib.blake2b(x, digest_size=16).digest() for x in texts], pa.binary())
            bits = pa.array([text_bits(x) for x in texts], pa.int32())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("part"), key, bits], ["doc_id", "part", "h", "bits"])
    C.give_back()


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, part, bits, marks) of every row of `docs`. The least doc_id of
    each text is found by hash; a document then asks for its own (text, doc_id),
    a key that copies do not share."""
    flags = C.checkpoint(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), "text").mapInArrow(_read, "doc_id long, part string, h binary, bits int")
    )
    first = C.checkpoint(flags.groupBy("h").agg(F.min("doc_id").alias("doc_id")).where("doc_id is not null")).withColumn("first", F.lit(True))
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 2).otherwise(0)).alias("toxic"))
    copy = F.col("doc_id").isNotNull() & F.col("first").isNull()
    return (
        flags.join(first, ["h", "doc_id"], "left")
        .join(marks, "doc_id", "left")
        .select("doc_id", "part", F.col("bits").bitwiseOR(F.when(copy, 1 << COPY).otherwise(0)).alias("bits"), F.coalesce(F.col("good") + F.col("toxic"), F.lit(0)).alias("marks"))
    )


def bitmap_counts(part: np.ndarray, bits: np.ndarray, marks: np.ndarray, filters: int, n_marks: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts of rows whose parts are numbered from 0 without a gap: by subset
    of filters seen, filter and part, what is (gone before, removed, removed of
    each mark); and the rows by part."""
    size = np.bincount(part)
    words = -(-size // 64)
    first = np.cumsum(words) - words
    order = np.argsort(part, kind="stable")
    at = np.arange(len(part)) + np.repeat(first * 64 - (np.cumsum(size) - size), size)
    bools = np.zeros((filters + n_marks, int(words.sum()) * 64), bool)
    for i in range(filters):
        bools[i, at] = bits[order] >> i & 1
    for i in range(n_marks):
        bools[filters + i, at] = marks[order] >> i & 1
    sets = np.packbits(bools, axis=1, bitorder="little").view(np.uint64)
    count = lambda x: np.add.reduceat(np.bitwise_count(x).astype(np.int64), first)
    union = np.zeros((1 << filters, sets.shape[1]), np.uint64)
    out = np.zeros((1 << filters, filters, 2 + n_marks, len(size)), np.int64)
    for seen in range(1 << filters):
        if seen:
            last = seen.bit_length() - 1
            union[seen] = union[seen ^ 1 << last] | sets[last]
        gone = count(union[seen])
        for f in range(filters):
            if not seen >> f & 1:
                lost = sets[f] & ~union[seen]
                out[seen, f] = [gone, count(lost), *(count(lost & sets[filters + i]) for i in range(n_marks))]
    return out, size


def bitmap_index(flags: DataFrame, filters: int, n_marks: int = len(MARKS)) -> DataFrame:
    """COUNTS of (part, bits, marks) rows, added up over all tasks."""
    seen, which = (x.ravel() for x in np.meshgrid(np.arange(1 << filters), np.arange(filters), indexing="ij"))
    free = (seen >> which & 1) == 0
    seen, which = seen[free], which[free]
    names = [x.split()[0] for x in COUNTS.split(", ")]

    def emit(held):
        table = pa.Table.from_batches(held).combine_chunks()
        coded = table.column("part").combine_chunks().dictionary_encode()
        found, n = bitmap_counts(coded.indices.to_numpy().astype(np.int64), table.column("bits").to_numpy(), table.column("marks").to_numpy(), filters, n_marks)
        found = found[seen, which]
        for p, name in enumerate(coded.dictionary):
            columns = [pa.array([name] * len(seen), pa.string()), pa.array(seen, pa.int32()), pa.array(which, pa.int32()), pa.array(np.full(len(seen), n[p])), *(pa.array(found[:, i, p]) for i in range(2 + n_marks))]
            yield pa.RecordBatch.from_arrays(columns, names)

    def run(batches):
        held, rows = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
            if rows >= ROWS:
                yield from emit(held)
                held, rows = [], 0
        if held:
            yield from emit(held)

    return flags.select("part", "bits", "marks").mapInArrow(run, COUNTS).groupBy("part", "seen", "filter").agg(*(F.sum(c).alias(c) for c in names[3:]))


def orders(counts: DataFrame, names: str = FILTERS) -> DataFrame:
    """Every order of the filters, step by step, from the counts by subset."""
    k = len(names)
    # k! * k narrow rows, fixed by the number of filters.
    steps = [("".join(names[i] for i in p), s + 1, sum(1 << i for i in p[:s]), f) for p in permutations(range(k)) for s, f in enumerate(p)]
    plan = F.broadcast(counts.sparkSession.createDataFrame(steps, "filter_order string, step int, seen int, filter int"))
    one = Window.partitionBy("part", "filter")
    size = F.bit_count("seen")
    ways = F.element_at(F.array(*(F.lit(factorial(s) * factorial(k - 1 - s)) for s in range(k))), size + 1)
    whole = counts.select(
        "*",
        F.sum(F.when(size == 0, F.col("removed"))).over(one).alias("fails"),
        F.sum(F.when(size == k - 1, F.col("removed"))).over(one).alias("unique_fails"),
        F.sum(ways * F.col("removed")).over(one).alias("shapley"),
    )
    return whole.join(plan, ["seen", "filter"]).select(
        "part", "filter_order", "step", (F.col("n") - F.col("gone") - F.col("removed")).alias("kept"), "removed",
        (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", *(f"{m}_lost" for m in MARKS), "shapley",
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five filters over all documents."""
    return orders(bitmap_index(failures(docs, labels), len(FILTERS)))


def oracle() -> str:
    word = r"[^\x20\x09-\x0D]+"
    bit = lambda i, x: f"(CASE WHEN {x} THEN {1 << i} ELSE 0 END)"
    tests = [f"len(w) < {MIN_WORDS}", f"100 * len(list_distinct(w)) < {DISTINCT_SHARE} * len(w)", f"100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > {UPPER_SHARE} * length(t)", "regexp_matches(t, '[#$%&*|]')", "doc_id > least"]
    letters = "(VALUES " + ", ".join(f"({i}, '{c}')" for i, c in enumerate(FILTERS)) + ")"
    return f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{word}') AS w FROM documents),
m AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
e AS (SELECT *, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
b AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, {" + ".join(bit(i, x) for i, x in enumerate(tests))} AS bits FROM e LEFT JOIN m USING (doc_id)),
u AS (SELECT range::INTEGER AS seen FROM range(32)),
f AS (SELECT * FROM {letters} AS x(i, letter)),
c AS (SELECT part, seen, i, letter, bit_count(seen) AS size, count(*) FILTER (WHERE bits & (seen | (1 << i)) = 0) AS kept,
  count(*) FILTER (WHERE bits & seen = 0 AND bits & (1 << i) <> 0) AS removed,
  count(*) FILTER (WHERE bits & seen = 0 AND bits & (1 << i) <> 0 AND good = 1) AS good_lost,
  count(*) FILTER (WHERE bits & seen = 0 AND bits & (1 << i) <> 0 AND toxic = 1) AS toxic_lost,
  count(*) FILTER (WHERE bits & (1 << i) <> 0) AS fails FROM b, u, f WHERE seen & (1 << i) = 0 GROUP BY ALL),
s AS (SELECT *, sum(removed * CASE WHEN size IN (0, 4) THEN 24 WHEN size IN (1, 3) THEN 6 ELSE 4 END) OVER w AS shapley, max(CASE WHEN size = 4 THEN removed ELSE 0 END) OVER w AS unique_fails FROM c WINDOW w AS (PARTITION BY part, i)),
o AS (SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.i, b.i, c.i, d.i, e.i] AS places FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
p AS (SELECT filter_order, step::INTEGER AS step, places[step] AS i, list_sum(list_transform(places[1:step - 1], lambda x: 1 << x)) AS seen FROM o, range(1, 6) AS r(step))
SELECT part, filter_order, step, kept, removed, fails - removed AS redundant, unique_fails::BIGINT AS unique_fails, good_lost, toxic_lost, shapley::BIGINT AS shapley
FROM s JOIN p ON s.i = p.i AND s.seen = coalesce(p.seen, 0)"""
