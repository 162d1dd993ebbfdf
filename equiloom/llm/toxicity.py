"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

Features are the words of a whole text, in lower case, and their first 4, 5 and
6 bytes, each by the logarithm of one more than its occurrences. P(grade > k) is
the logistic of one shared score less threshold k; the expected severity is the
sum of these over k.

The model is fitted on ``sample`` labelled documents of either class at most,
those with the least hash of doc_id; only equal texts count once. Labels tell
toxic or not; the grades within toxic are the terciles of how many associated
features a document holds. A labels table with a column ``severity`` gives the
grades itself.

Cases: a null or empty text has no features and grade 0's severity; a very long
text is graded whole, in one piece of a batch; with no
labelled document of a class, every severity is 0; a doc_id labelled twice is
toxic if any label says so; equal texts get equal results; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equiloom.llm import common as C

#: Labelled documents of either class that the model is fitted on, at most.
SAMPLE = 1500
#: The rule for features: distinct toxic texts that one must occur in, so many
#: and such a share of the sample's (what few copies of one text share is no
#: sign of toxicity), and the log odds for toxic that it must have. All that
#: meet it are kept.
SUPPORT, SHARE, ODDS = 5, 0.02, 3.0
GRADES = 4
_SPACE = np.ones(256, bool)
_SPACE[65:91] = _SPACE[97:123] = _SPACE[128:] = False


@dataclass
class Model:
    """Sorted feature hashes, their weights and the ascending thresholds."""

    features: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def above(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) by row and k."""
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.thresholds, -60, 60)))


@dataclass
class Sparse:
    """A matrix by its (row, column, value) triples."""

    row: np.ndarray
    column: np.ndarray
    value: np.ndarray
    rows: int
    width: int

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.column], self.rows)

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, self.value * g[self.row], self.width)


def text_features(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every feature occurrence."""
    buf = C.lower(buf)
    starts, ends, first = C.words(buf, offs, _SPACE)
    row = np.repeat(np.arange(len(offs) - 1), np.diff(first))
    rows, hashes = [row], [C.word_hashes(buf, starts, ends)]
    for size in (4, 5, 6):
        long = ends - starts > size
        rows.append(row[long])
        hashes.append(C.mix(C.word_hashes(buf, starts[long], starts[long] + size) + np.uint64(size)))
    return np.concatenate(rows), np.concatenate(hashes)


def _known(row: np.ndarray, h: np.ndarray, features: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, index in features) pairs and their values."""
    if not len(features):
        return row[:0], row[:0], np.empty(0)
    sieve = np.zeros(1 << 18, bool)
    sieve[(features & np.uint64((1 << 18) - 1)).astype(np.int64)] = True
    maybe = sieve[(h & np.uint64((1 << 18) - 1)).astype(np.int64)]
    row, h = row[maybe], h[maybe]
    at = np.minimum(np.searchsorted(features, h), len(features) - 1)
    ok = features[at] == h
    pair, times = np.unique(row[ok] * len(features) + at[ok], return_counts=True)
    return pair // len(features), pair % len(features), np.log2(1.0 + times)


def _sample(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """(t, mark, text) of the sampled documents, equal texts once."""
    grade = F.col("severity").cast("int") if "severity" in labels.columns else F.col("toxic").cast("int")
    marks = labels.where(F.col("doc_id").isNotNull() & grade.isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(grade).alias("mark"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    some = marks.where("mark > 0").orderBy(*order).limit(sample).unionByName(marks.where("mark <= 0").orderBy(*order).limit(sample))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")
    chosen = texts.join(F.broadcast(some), "doc_id")  # at most two samples of narrow rows
    return chosen.groupBy(F.xxhash64("text").alias("t")).agg(F.max("mark").alias("mark"), F.first("text").alias("text"))


def _listed(features: np.ndarray | None):
    """Per document the hashes of its distinct features, or the indices and
    values of known ones."""

    def run(batches):
        for part in C.slices(batches):
            row, h = text_features(*C.utf8(part.column("text")))
            if features is None:
                order = np.lexsort((h, row))
                row, h = row[order], h[order]
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
                row, got = row[new], h[new].view(np.int64)
                value = np.ones(len(row))
            else:
                row, got, value = _known(row, h, features)
            cuts = np.searchsorted(row, np.arange(part.num_rows + 1))
            lists = [pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), x) for x in (pa.array(got, pa.int64()), pa.array(value, pa.float64()))]
            yield pa.RecordBatch.from_arrays([part.column("mark"), part.column("t"), *lists], ["mark", "t", "f", "v"])
        C.give_back()

    return run


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from labels (doc_id, toxic). Features are counted by class in
    Spark; the driver gets the frequent ones of toxic texts with their counts,
    and of each sampled document the kept ones."""
    chosen = C.checkpoint(_sample(docs, labels, sample))
    form = "mark int, t long, f array<long>, v array<double>"
    size = {r.bad: r.n for r in chosen.groupBy((F.col("mark") > 0).alias("bad")).agg(F.count("*").alias("n")).collect()}
    bad, good = size.get(True, 0), size.get(False, 0)
    if not bad or not good:
        return _none()
    least = max(SUPPORT, SHARE * bad)
    seen = chosen.where("mark > 0").mapInArrow(_listed(None), form).select(F.explode("f").alias("f")).groupBy("f").count().where(F.col("count") >= least)
    pos = {int(np.int64(r.f).view(np.uint64)): r["count"] for r in seen.toLocalIterator()}
    features = np.array(sorted(pos), np.uint64)
    other = chosen.where("mark <= 0").mapInArrow(_listed(features), form).select(F.explode("f").alias("f")).groupBy("f").count()
    neg = np.zeros(len(features))
    for r in other.toLocalIterator():
        neg[r.f] = r["count"]
    held = np.array([pos[int(f)] for f in features], float)
    kept = features[np.log((held + 0.5) / (bad + 1)) - np.log((neg + 0.5) / (good + 1)) > ODDS]
    if not len(kept):
        return _none()
    rows = sorted(chosen.mapInArrow(_listed(kept), form).toLocalIterator(), key=lambda r: r.t)
    x = Sparse(np.repeat(np.arange(len(rows)), [len(r.f) for r in rows]), np.array([i for r in rows for i in r.f], np.int64), np.array([v for r in rows for v in r.v]), len(rows), len(kept))
    weights, thresholds = cumulative_link(x, _grades(x, np.array([r.mark for r in rows])), GRADES)
    return Model(kept, weights, thresholds)


def _none() -> Model:
    return Model(np.empty(0, np.uint64), np.empty(0), np.full(GRADES - 1, 60.0))


def _grades(x: Sparse, marks: np.ndarray) -> np.ndarray:
    """Marks as grades; where they only tell toxic, its terciles by the sum of
    a document's values."""
    if marks.max() > 1:
        return np.minimum(marks, GRADES - 1).clip(0)
    strong = x.times(np.ones(x.width))
    return np.where(marks > 0, 1 + np.searchsorted(np.quantile(strong[marks > 0], [1 / 3, 2 / 3]), strong, "left"), 0)


def cumulative_link(x: Sparse, grade: np.ndarray, grades: int, penalty: float = 0.02, rounds: int = 400, rate: float = 0.05):
    """Weights and ascending thresholds by Adam on the penalised likelihood,
    both classes of grade 0 and above weighing the same."""
    n, width = x.rows, x.width
    mass = np.where(grade > 0, 0.5 / max(1, (grade > 0).sum()), 0.5 / max(1, (grade == 0).sum()))
    w, base, gaps = np.zeros(width), 1.0, np.zeros(grades - 2)
    state = [np.zeros(width + grades - 1), np.zeros(width + grades - 1)]
    for step in range(1, rounds + 1):
        theta = base + np.concatenate(([0.0], np.cumsum(np.log1p(np.exp(gaps)))))
        score = x.times(w)
        s = np.hstack([np.ones((n, 1)), 1 / (1 + np.exp(-np.clip(score[:, None] - theta, -60, 60))), np.zeros((n, 1))])
        at = np.arange(n)
        up, down = s[at, grade], s[at, grade + 1]
        p = np.maximum(up - down, 1e-12)
        du, dd = up * (1 - up) / p * mass, down * (1 - down) / p * mass
        g_theta = np.array([du[grade == k + 1].sum() - dd[grade == k].sum() for k in range(grades - 1)])
        slope = 1 / (1 + np.exp(-gaps))
        tail = np.cumsum(g_theta[::-1])[::-1]
        grad = np.concatenate((-x.back(du - dd) + penalty * w / np.sqrt(width), [tail[0]], tail[1:] * slope))
        for i, power in ((0, 1), (1, 2)):
            beta = (0.9, 0.999)[i]
            state[i] = beta * state[i] + (1 - beta) * grad**power
        move = rate * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.999**step)) + 1e-8)
        w, base, gaps = w - move[:width], base - move[width], gaps - move[width + 1 :]
    return w, base + np.concatenate(([0.0], np.cumsum(np.log1p(np.exp(gaps)))))


def _above(model: Model, part) -> np.ndarray:
    row, at, value = _known(*text_features(*C.utf8(part.column("text"))), model.features)
    return model.above(np.bincount(row, model.weights[at] * value, part.num_rows) if len(row) else np.zeros(part.num_rows))


def grade(docs: DataFrame, model: Model, limit: float = 0.5) -> DataFrame:
    """Per document: doc_id, severity (expected grade), p_toxic and toxic."""

    def run(batches):
        for part in C.slices(batches):
            above = _above(model, part)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(above.sum(1)), pa.array(above[:, 0]), pa.array(above[:, 0] >= limit)],
                ["doc_id", "severity", "p_toxic", "toxic"],
            )
        C.give_back()

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, severity double, p_toxic double, toxic boolean")


def drop_toxic(docs: DataFrame, model: Model, limit: float = 0.5) -> DataFrame:
    """The documents that are not toxic, as they are."""

    def run(batches):
        for part in C.slices(batches):
            yield part.filter(pa.array(_above(model, part)[:, 0] < limit))
        C.give_back()

    return docs.mapInArrow(run, docs.schema)
