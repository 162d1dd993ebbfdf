"""Operators against independent computations, and cases of the dealt ones."""

from __future__ import annotations

import re
from collections import Counter
from itertools import product

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from equiloom.llm import chat_format, common, decontaminate, license_scan, near_copies, simhash_dedup, source_mix, suffix_dedup, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"


# --- decontamination: all windows of all documents with all items ---


def shingles(words, width):
    return Counter(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def best_window(text, item):
    w, x = (WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for t in (text, item))
    if not x or not w:
        return 0.0
    width = min(5, len(x))
    n, want, best = min(len(x), len(w)), shingles(x, width), 0.0
    for i in range(len(w) - n + 1):
        have = shingles(w[i : i + n], width)
        shared = (have & want).total()
        best = max(best, shared / max(1, have.total() + want.total() - shared))
    return best


def test_decontaminate_all_windows(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "CELLS", 64)  # windows in several blocks
    rng = np.random.default_rng(8)
    vocabulary = [f"v{i}" for i in range(400)]
    draw = lambda n: [vocabulary[i] for i in rng.integers(0, 400, n)]
    items = [draw(int(rng.integers(12, 45))) for _ in range(14)] + [["one", "two"], ["solo"], []]
    docs = []
    for d in range(60):
        w = draw(int(rng.integers(0, 160)))
        if d % 2:
            x = list(items[int(rng.integers(0, 14))])
            for _ in range(int(rng.integers(0, 4))):
                x[int(rng.integers(0, len(x)))] = "edited"
            at = int(rng.integers(0, len(w) + 1))
            w[at:at] = x
        docs.append((d, " ".join(w)))
    docs += [(100, None), (101, "ONE two"), (102, "x " * 3000 + " ".join(items[0])), (102, "x"), (103, "solo")]
    want = {(d, i) for d, t in docs for i, x in enumerate(items) if best_window(t, " ".join(x)) >= 0.8}
    assert len(want) > 10
    got = decontaminate.matches(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want


# --- chat: every way to turn the given roles into a legal sequence ---


def legal(roles):
    body = roles[1:] if roles[:1] == (0,) else roles
    return len(body) > 0 and len(body) % 2 == 0 and all(r == 1 + i % 2 for i, r in enumerate(body))


def cheapest(given, gaps):
    """Over all labels, merges and inserted turns before each turn and last."""
    ways = []
    for g in given:
        label = lambda r, g=g: 1 if g is None else 0 if r == g else 3
        ways.append([(label(r) + 1, None, r) for r in range(3)] + [(label(r) + 2 * len(x), x, r) for r in range(3) for x in gaps])
    best = 10**9
    for choice in product(*ways):
        out: tuple = ()
        cost = 0
        for c, x, r in choice:
            if x is None:
                if not out or out[-1] != r:
                    break
            else:
                out += (*x, r)
            cost += c
        else:
            best = min([best, *(cost + 2 * len(x) for x in [(), (1,), (2,), (1, 2), (2, 1)] if legal(out + x))])
    return best


def test_chat_enumerated(spark):
    names = {0: "system", 1: "human", 2: "Assistant", None: "tool"}
    sequences = [s for n in (1, 2, 3) for s in product((0, 1, 2, None), repeat=n)]
    rows = [(i, t, names[g], f"text {t}") for i, s in enumerate(sequences) for t, g in enumerate(s)]
    got = Counter()
    for r in chat_format.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect():
        got[r.conv_id] += {"merge": 1, "relabel": 3, "relabel+merge": 4, "insert": 2, "keep": 0}[r.action]
    for i, s in enumerate(sequences):
        # A role that is unknown is named at a cost of 1, not 3.
        cost = got[i] - 2 * sum(g is None for g in s)
        assert cost == cheapest(s, [(), (1,), (2,)]), s


# --- toxicity: the likelihood written out ---


def loss(w, theta, rows, grade, penalty):
    weight = {True: 0.5 / sum(g > 0 for g in grade), False: 0.5 / sum(g == 0 for g in grade)}
    total = 0.0
    for x, g in zip(rows, grade, strict=True):
        score = sum(w[j] * v for j, v in x)
        above = [1.0, *(1 / (1 + np.exp(t - score)) for t in theta), 0.0]
        total -= weight[g > 0] * np.log(max(above[g] - above[g + 1], 1e-12))
    return total + penalty / 2 * float(np.dot(w, w)) / np.sqrt(len(w))


def test_ordinal_fit():
    rng = np.random.default_rng(3)
    truth = np.array([2.0, 1.0, 0.0, -1.0])
    rows, grade = [], []
    for _ in range(400):
        x = [(j, float(rng.integers(1, 4))) for j in range(4) if rng.random() < 0.5]
        noisy = sum(truth[j] * v for j, v in x) + rng.logistic()
        rows.append(x)
        grade.append(int(np.searchsorted([1.0, 3.0, 5.0], noisy)))
    sparse = toxicity.Sparse(np.array([i for i, x in enumerate(rows) for _ in x]), np.array([j for x in rows for j, _ in x]), np.array([v for x in rows for _, v in x]), len(rows), 4)
    w, theta = toxicity.cumulative_link(sparse, np.array(grade), 4)
    assert (np.diff(theta) > 0).all() and w[0] > w[1] > w[2] > w[3]
    at = loss(w, theta, rows, grade, 0.02)
    for _ in range(40):
        moved = loss(w + rng.normal(0, 0.1, 4), theta + rng.normal(0, 0.05, 3), rows, grade, 0.02)
        assert at <= moved + 1e-4


def test_toxicity_empty(none, spark):
    labels = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    model = toxicity.fit(none, labels)
    assert toxicity.grade(none, model).count() == 0 and toxicity.drop_toxic(none, model).columns == none.columns


# --- repeated ids, clashing columns, hot passages ---


@pytest.mark.parametrize("turned", [False, True])
def test_license_repeated_id(spark, turned):
    notice = license_scan.TEMPLATES["BSD"]
    rows = [(1, notice), (1, " ".join(notice.split()[:12])), (2, license_scan.TEMPLATES["MIT-text"])]
    frame = spark.createDataFrame(rows[::-1] if turned else rows, "doc_id long, text string").coalesce(1)
    got = {(r.doc_id, r.license): r.containment for r in license_scan.scan_licenses(frame).collect()}
    assert got[1, "BSD"] == 1.0 and got[2, "MIT-text"] == 1.0 and got[2, "MIT-permission"] == 1.0


def test_clashing_columns(spark):
    names = "o p s class bin row copy k t mix_size hash".split()
    rows = [(d, f"word {'x ' * (d % 4)}", "ab"[d % 2]) for d in range(20)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)])
    for out in (source_mix.emit(frame), simhash_dedup.keep_one(frame), near_copies.keep_one(frame)):
        assert out.columns == frame.columns
        assert {tuple(r[n] for n in names) for r in out.collect()} == {tuple(range(len(names)))}


def test_null_ids_by_text(spark):
    """Rows without an id are ordered by their texts: reruns agree."""
    rows = [(None, f"w{i} " * (1 + i % 5), "a" if i % 3 else None) for i in range(300)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    takes = [Counter((r.source, r.size, r.taken) for r in source_mix.mix_sizes(frame.repartition(n)).collect()) for n in (2, 5)]
    assert takes[0] == takes[1]


def test_settled_places_spread(spark):
    """A passage that all documents share does not fill one bucket."""
    from equiloom.llm import substring_dedup as S

    passage = " ".join(f"p{i}" for i in range(60))
    frame = spark.createDataFrame([(d, f"{passage} own{d}") for d in range(2000)], "doc_id long, text string").coalesce(1)
    sent = common.keyed(frame).select("k", "t", "text").mapInArrow(S._send(S._probe(35, 18), 8, False), S.PACK)
    places = {r.bucket: len(common.unpack_places(r.asDict())[0]) for r in sent.where("kind = 3").collect()}
    assert len(places) == 8 and max(places.values()) < 2 * min(places.values())


def test_equal_ids_other_texts(spark):
    """Places of one text are never used on another of the same id."""
    shared = "s" * 250
    rows = [(None, f"{i} {shared if i % 2 else 'none ' * 60}{i}") for i in range(40)]
    got = Counter((r.n_bytes, r.n_removed > 0) for r in suffix_dedup.dedup_suffixes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    assert sum(n for (_, gone), n in got.items() if gone) == 40


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stage_cases(spark, odd, none, stage):
    """Nulls, blanks, ties, repeated rows, other columns, and no rows at all."""
    run = dict(corpus_pipeline.STAGES)[stage]
    out = run(spark, odd, SF)
    if stage != "token_binary":
        assert out.columns == odd.columns
    assert out.count() > 0
    assert run(spark, none, SF).count() == 0
