"""Hard negatives by a pivot table.

Integer vectors x get one more component, sqrt(M - |x|^2) with M the largest
squared length, and an anchor q gets 0 there; then |q - x|^2 = |q|^2 + M - 2 q.x,
so a larger inner product is a smaller distance. Every row is stored with its
distances to PIVOTS pivots. By the triangle inequality these bracket the
distance, and so the score, between an anchor and a block, then a row; what the
bracket cannot decide is scored exactly.

Rows lie in shelves of blocks, in order of their nearest pivot and the distance
to it. The anchors, a stated query set, go in chunks to every shelf, and a shelf
gives back its K best of each anchor and range of scores. One shelf in FIRST is
searched before the others: its K-th best raise the floors that the others have
to reach, so that what they send back does not grow with their number. Where
vectors are spread evenly in many dimensions the brackets are wide and most rows
are scored; floors and results hold all the same.

Cases: rows with a null label, a null vector or a component that is null or not
finite take no part; equal rows (vec_id, label and vector) count once; a null
vec_id comes last among ties and is no anchor; components are held to +-2**26
after scaling; a shorter vector counts as filled up with zeros; an anchor
without positives or negatives has no rows; an empty table gives none. Very long
vectors have fewer rows in a block; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from equiloom.llm import common as C

K = 5
PIVOTS, SAMPLE = 8, 1024  # pivots, and the bounded sample of rows they are chosen from
SHELF_ROWS, FIRST = 1 << 18, 16
CELLS = 1 << 16  # components in a block or a chunk
HELD = float(1 << 26)
LAST, NONE = np.int64(2**63 - 1), np.int64(-(2**63) + 1)
FOUND = "akey long, anchor_id long, slot int, top long, score long, id long"
_PACKED = "kind int, n int, ids binary, labels binary, vecs binary, more binary, lo binary, hi binary"


def vectors(embeddings: DataFrame, relabel_every: int = 0) -> DataFrame:
    """Distinct (id, label, v): whole components floor(256 x), null ids last.
    Labels of ids divisible by `relabel_every` become (label + 1) % 10."""
    finite = lambda x: F.coalesce((F.abs(x.cast("double")) < float("inf")) & ~F.isnan(x.cast("double")), F.lit(False))
    scaled = lambda x: F.floor(F.greatest(F.lit(-HELD), F.least(F.lit(HELD), 256 * x.cast("double")))).cast("int")
    label = F.col("label").cast("long")
    if relabel_every:
        label = F.when(F.col("vec_id") % relabel_every == 0, (label + 1) % 10).otherwise(label)
    return (
        embeddings.where("label is not null and embedding is not null")
        .where(F.forall("embedding", finite))
        .select(F.coalesce(F.col("vec_id").cast("long"), F.lit(int(LAST))).alias("id"), label.alias("label"), F.transform("embedding", scaled).alias("v"))
        .dropDuplicates()
    )


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists as rows, filled up with zeros."""
    n = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width), np.int64)
    out[np.repeat(np.arange(len(column)), n), np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)] = column.flatten().to_numpy()
    return out


class Space:
    """The added component and the pivots; small, sent with the tasks."""

    def __init__(self, width: int, most: int, large: int, sample: np.ndarray):
        self.width, self.most = width, float(large)
        self.wide = np.int16 if most < 1 << 15 else np.int32
        self.exact = np.float64 if width * most * most < 1 << 53 else np.int64
        self.block = max(1, CELLS // max(1, width))
        full = self._full(sample)
        chosen = [0]
        far = np.full(len(full), np.inf)
        for _ in range(min(PIVOTS, len(full)) - 1):
            far = np.minimum(far, ((full - full[chosen[-1]]) ** 2).sum(1))
            chosen.append(int(far.argmax()))
        self.pivots = full[chosen]

    def _full(self, v):
        v = v.astype(np.float64)
        return np.hstack([v, np.sqrt(np.maximum(0, self.most - (v * v).sum(1)))[:, None]])

    def distances(self, v: np.ndarray, anchors: bool = False) -> np.ndarray:
        """To each pivot, by row."""
        full = self._full(v)
        if anchors:
            full[:, -1] = 0
        gaps = (full * full).sum(1)[:, None] + (self.pivots**2).sum(1) - 2 * full @ self.pivots.T
        return np.sqrt(np.maximum(0, gaps))


def space(rows: DataFrame) -> Space | None:
    whole = rows.agg(
        F.max(F.size("v")).alias("width"), F.max(F.aggregate("v", F.lit(0), lambda a, x: F.greatest(a, F.abs(x)))).alias("most"),
        F.max(F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x.cast("long") * x)).alias("large"),
    ).first()
    if whole.width is None:
        return None
    sample = pa.Table.from_pylist([{"v": r.v} for r in rows.orderBy(F.xxhash64("id", "label", "v")).limit(SAMPLE).select("v").collect()], pa.schema([("v", pa.list_(pa.int32()))]))
    return Space(whole.width, whole.most, whole.large, _matrix(sample.column("v").combine_chunks(), whole.width))


def _pack(table: pa.Table, sp: Space, kind: int) -> dict:
    v = _matrix(table.column("v").combine_chunks(), sp.width)
    wide = lambda c: np.array(table.column(c).to_pylist(), np.int64).tobytes() if kind else b""
    more = table.column("akey").to_numpy().astype(np.int64) if kind else sp.distances(v).T
    return {"kind": kind, "n": len(v), "ids": table.column("id").to_numpy().tobytes(), "labels": table.column("label").to_numpy().tobytes(), "vecs": v.astype(sp.wide).tobytes(), "more": np.ascontiguousarray(more).tobytes(), "lo": wide("lo"), "hi": wide("hi")}


def _packed(rows: DataFrame, sp: Space, kind: int, shelves: int = 0) -> DataFrame:
    """Rows of _PACKED, each a block of rows (kind 0) or a chunk of anchors (1);
    blocks with the number of their shelf."""
    schema = pa.schema([("kind", pa.int32()), ("n", pa.int32()), *((c, pa.binary()) for c in ("ids", "labels", "vecs", "more", "lo", "hi")), ("shelf", pa.int32())][: None if shelves else -1])

    def run(batches):
        held, n = [], 0
        shelf = {"shelf": TaskContext.get().partitionId() % shelves} if shelves else {}

        def out(least):
            nonlocal held, n
            table = pa.Table.from_batches(held)
            at = 0
            while n - at >= least:
                yield pa.RecordBatch.from_pylist([_pack(table.slice(at, sp.block), sp, kind) | shelf], schema)
                at += sp.block
            n = max(0, n - at)
            held = table.slice(at).to_batches() if n else []

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
            if n >= sp.block:
                yield from out(sp.block)
        if n:
            yield from out(1)

    return rows.mapInArrow(run, _PACKED + (", shelf int" if shelves else ""))


def pivot_table(rows: DataFrame, sp: Space) -> tuple[DataFrame, int]:
    """Blocks of all rows, and the number of shelves."""
    n = rows.count()
    shelves = max(-(-n // SHELF_ROWS), min(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // 1024)))

    def near(batches):
        for batch in batches:
            d = sp.distances(_matrix(batch.column("v"), sp.width))
            cell = d.argmin(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(d[np.arange(len(d)), cell])], [*batch.schema.names, "cell", "d"])

    placed = rows.mapInArrow(near, "id long, label long, v array<int>, cell int, d double")
    ordered = placed.repartitionByRange(shelves, "cell", "d", "id").sortWithinPartitions("cell", "d", "id").drop("cell", "d")
    return C.checkpoint(_packed(ordered, sp, 0, shelves)), shelves


class _Block:
    def __init__(self, row: dict, sp: Space):
        self.ids, self.labels = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64)
        self.v = np.frombuffer(row["vecs"], sp.wide).reshape(len(self.ids), sp.width)
        self.d = np.frombuffer(row["more"], np.float64).reshape(-1, len(self.ids))
        self.low, self.high = self.d.min(1), self.d.max(1)


class _Chunk:
    """Anchors with their ranges of scores (slots), and the best of each."""

    def __init__(self, row: dict, sp: Space, same: bool):
        self.sp, self.same = sp, same
        self.ids, self.labels, self.keys = (np.frombuffer(row[c], np.int64) for c in ("ids", "labels", "more"))
        n = len(self.ids)
        self.v = np.frombuffer(row["vecs"], sp.wide).reshape(n, sp.width).astype(np.int64)
        self.lo, self.hi = (np.frombuffer(row[c], np.int64).reshape(n, -1) for c in ("lo", "hi"))
        self.lo = self.lo.copy()
        self.top = self.lo.shape[1]
        self.half = (self.v.astype(np.float64) ** 2).sum(1) + sp.most
        self.slack = 1 + 1e-9 * self.half
        self.d = sp.distances(self.v, anchors=True)
        none = np.empty(0, np.int64)
        self.best = (none, none, none)  # slot of an anchor, score, id

    def scan(self, block: _Block) -> None:
        # Scores that the block may hold, from its least and largest distances.
        gap = np.maximum(0, np.maximum(block.low - self.d, self.d - block.high)).max(1)
        floor, ceiling = self.lo.min(1), self.hi.max(1)
        go = np.flatnonzero(((self.half - gap * gap) / 2 + self.slack >= floor) & (floor <= ceiling))
        if not len(go):
            return
        label = self.labels[go, None] == block.labels if self.same else self.labels[go, None] != block.labels
        near, far = np.zeros(label.shape), np.full(label.shape, np.inf)
        for p in range(len(block.d)):
            ours = self.d[go, p, None]
            np.maximum(near, np.abs(ours - block.d[p]), out=near)
            np.minimum(far, ours + block.d[p], out=far)
        half, slack = self.half[go, None], self.slack[go, None]
        open_ = label & ((half - near * near) / 2 + slack >= floor[go, None]) & ((half - far * far) / 2 - slack <= ceiling[go, None])
        at = np.flatnonzero(open_.any(0))
        if not len(at):
            return
        open_ = open_[:, at]
        x = block.v[at]
        score = (self.v[go].astype(self.sp.exact) @ x.T.astype(self.sp.exact)).astype(np.int64)
        if self.same:  # an anchor is not its own positive
            a, b = np.nonzero((self.ids[go, None] == block.ids[at]) & open_)
            own = (self.v[go[a]] == x[b]).all(1)
            open_[a[own], b[own]] = False
        slots, scores, ids = ([y] for y in self.best)
        for s in range(self.top):
            fit = open_ & (score >= self.lo[go, s, None]) & (score <= self.hi[go, s, None])
            if fit.shape[1] > K:
                kept = np.where(fit, score, NONE)
                fit &= score >= -np.partition(-kept, K - 1, axis=1)[:, K - 1, None]
            a, b = np.nonzero(fit)
            slots.append(go[a] * self.top + s)
            scores.append(score[a, b])
            ids.append(block.ids[at[b]])
        self._keep(np.concatenate(slots), np.concatenate(scores), np.concatenate(ids))

    def _keep(self, slot, score, id_):
        order = np.lexsort((id_, -score, slot))
        slot, score, id_ = slot[order], score[order], id_[order]
        rank = np.arange(len(slot)) - np.searchsorted(slot, slot)
        keep = rank < K
        self.best = slot[keep], score[keep], id_[keep]
        full = rank == K - 1
        self.lo.ravel()[slot[full]] = np.maximum(self.lo.ravel()[slot[full]], score[full])

    def found(self) -> pa.RecordBatch:
        slot, score, id_ = self.best
        a, s = slot // self.top, slot % self.top
        return pa.RecordBatch.from_arrays([pa.array(self.keys[a]), pa.array(self.ids[a]), pa.array(s, pa.int32()), pa.array(self.hi[a, s]), pa.array(score), pa.array(id_)], [x.split()[0] for x in FOUND.split(", ")])


def _search(table: DataFrame, shelves: int, first: bool, anchors: DataFrame, sp: Space, same: bool) -> DataFrame:
    """FOUND: the K best of each anchor and slot, by shelf."""

    def run(batches):
        shelf, blocks = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if row["shelf"] != shelf:
                    shelf, blocks = row["shelf"], []
                if row["kind"] == 0:
                    blocks.append(_Block(row, sp))
                    continue
                chunk = _Chunk(row, sp, same)
                for block in blocks:
                    chunk.scan(block)
                yield chunk.found()
        C.give_back()

    here = lambda shelf: (shelf % FIRST == 0) == F.lit(first)
    chunks = _packed(anchors, sp, 1).withColumn("shelf", F.explode(F.filter(F.sequence(F.lit(0), F.lit(shelves - 1)), here)))
    both = table.where(here(F.col("shelf"))).unionByName(chunks)
    return both.repartition(shelves, "shelf").sortWithinPartitions("shelf", "kind").mapInArrow(run, FOUND)


def _best(found: DataFrame) -> DataFrame:
    order = Window.partitionBy("akey", "slot").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= K)


def search(table: DataFrame, shelves: int, anchors: DataFrame, sp: Space, same: bool) -> DataFrame:
    """FOUND with rank: the K best rows of each anchor (akey, id, label, v) in
    each of its slots (lo and hi, arrays of longs: least and largest score; hi
    comes back as `top`), among rows of its label or of the others; ties by id."""
    best = C.checkpoint(_best(_search(table, shelves, True, anchors, sp, same)))
    if shelves == 1:
        return best
    floors = best.where(F.col("rank") == K).groupBy("akey").agg(F.map_from_entries(F.collect_list(F.struct("slot", "score"))).alias("floor"))
    floor = F.transform("lo", lambda x, i: F.greatest(x, F.coalesce(F.try_element_at("floor", i), x)))
    raised = anchors.join(floors, "akey", "left").withColumn("lo", floor).drop("floor")
    return _best(best.drop("rank").unionByName(_search(table, shelves, False, raised, sp, same)))


def mine(embeddings: DataFrame, anchor_every: int = 100, relabel_every: int = 0, share: int = 80) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score): of anchors, whose ids `anchor_every` divides, the K best
    positives (of the same label), and of each the K best rows of other labels
    whose score is from `share` percent of the positive's to all of it."""
    form = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    rows = C.checkpoint(vectors(embeddings, relabel_every))
    sp = space(rows)
    if sp is None:
        return embeddings.sparkSession.createDataFrame([], form)
    table, shelves = pivot_table(rows, sp)
    anchors = C.checkpoint(rows.where((F.col("id") != int(LAST)) & (F.col("id") % anchor_every == 0)).withColumn("akey", F.monotonically_increasing_id()))
    lowest, highest = (F.array(F.lit(int(x))) for x in (NONE, LAST))
    positives = C.checkpoint(search(table, shelves, anchors.withColumns({"lo": lowest, "hi": highest}), sp, True).select("akey", F.col("id").alias("positive_id"), "score", (F.col("rank") - 1).alias("slot")))
    # K entries a key at most; no product leaves a long.
    least = F.expr(f"{share} * (score div 100) + cast(ceil({share} * (score % 100) / 100D) as bigint)")
    ranges = positives.groupBy("akey").agg(F.sort_array(F.collect_list(F.struct("slot", least.alias("lo"), "score"))).alias("r")).select("akey", F.col("r.lo").alias("lo"), F.col("r.score").alias("hi"))
    padded = {c: F.concat(c, F.array_repeat(F.lit(int(x)), K - F.size(c))) for c, x in (("lo", LAST), ("hi", NONE))}  # slots without a positive: nothing fits
    negatives = search(table, shelves, anchors.join(ranges.withColumns(padded), "akey"), sp, False)
    known = lambda c: F.when(F.col(c) != int(LAST), F.col(c))
    return negatives.join(positives.select("akey", "slot", "positive_id"), ["akey", "slot"]).select(
        "anchor_id", known("positive_id").alias("positive_id"), "rank", known("id").alias("negative_id"), F.col("top").alias("positive_score"), F.col("score").alias("negative_score")
    )


def oracle() -> str:
    """For vectors of one length."""
    return f"""
WITH r AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label = b.label AS same, a.vec_id = b.vec_id AS self, b.vec_id AS id, list_dot_product(a.v, b.v)::BIGINT AS score FROM r a, r b WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM s WHERE same AND NOT self QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= {K})
SELECT p.anchor_id, p.id AS positive_id, (row_number() OVER w)::INTEGER AS rank, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON p.anchor_id = n.anchor_id AND NOT n.same AND 80 * p.score <= 100 * n.score AND n.score <= p.score
WINDOW w AS (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id) QUALIFY row_number() OVER w <= {K}"""
