"""Hard negatives against all scores, computed one by one."""

from __future__ import annotations

import math

import numpy as np
import pytest

from equiloom.llm import hard_negatives as H
from equiloom.llm.queries import op12_hard_negatives

FORM = "vec_id long, embedding array<float>, label int, id string, slot string, shelf int"
LAST = int(H.LAST)


def by_hand(rows):
    """Rows (vec_id, embedding, label); pairs of every anchor, by Python's integers."""
    kept = set()
    for i, v, label, *_ in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if i is not None and i % 7 == 0 else label
        kept.add((LAST if i is None else i, label, tuple(math.floor(max(-H.HELD, min(H.HELD, 256 * float(np.float32(x))))) for x in v)))
    out = []
    for a in kept:
        if a[0] == LAST or a[0] % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(a[2], b[2])), b[0], b) for b in kept if b != a)
        for s, p, _ in [x for x in scored if x[2][1] == a[1]][:5]:
            fit = [x for x in scored if x[2][1] != a[1] and 80 * -s <= 100 * -x[0] <= 100 * -s][:5]
            out += [(a[0], p, n, q, -s, -t) for n, (t, q, _) in enumerate(fit, 1)]
    return sorted((tuple(None if x == LAST else x for x in r) for r in out), key=str)


def mined(spark, rows):
    got = H.mine(spark.createDataFrame([(*r, "z", "y", 3) for r in rows], FORM).repartition(3), relabel_every=7)
    return sorted(((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in got.collect()), key=str)


def drawn(rng, n, width, clusters=0):
    middle = rng.normal(0, 1, (max(1, clusters), width))
    for i in range(n):
        v = rng.normal(0, 1, width) if not clusters else middle[int(rng.integers(0, clusters))] + rng.normal(0, 0.05, width)
        yield (i, [float(x) for x in np.round(v / np.linalg.norm(v), 2 if i % 2 else 7)], int(rng.integers(0, 4)))


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(H, "CELLS", 200)
    monkeypatch.setattr(H, "SHELF_ROWS", 60)
    monkeypatch.setattr(H, "FIRST", 3)


@pytest.mark.parametrize("clusters", [0, 6])
def test_all_scores(spark, small, clusters):
    rows = list(drawn(np.random.default_rng(clusters), 700, 12, clusters))
    want = by_hand(rows)
    assert len(want) > 50
    assert mined(spark, rows) == want


def test_odd_rows(spark, small):
    rng = np.random.default_rng(3)
    rows = list(drawn(rng, 220, 6, 3))
    same = [0.5, 0.25, 0.0, 0.0, 0.125, 0.5]
    rows += [(1000 + i, same, i % 3) for i in range(120)]  # a vector that many rows share
    rows += [rows[5], rows[100], rows[100], (100, same, 1), (100, same, 2), (None, same, 1), (None, same, 2), (None, rows[0][1], 0)]
    rows += [(300, None, 1), (400, same, None), (500, [1.0, None], 1), (600, [float("nan")] * 6, 1), (700, [float("inf")] + same[1:], 1), (800, [], 1), (900, [0.5, 0.5], 2), (901, [1e30, 0.5], 2), (-100, same[:3], -4), (902, same * 3, 0)]
    want = by_hand(rows)
    assert {r[0] for r in want} >= {0, 100, 200, 1000, 1100}
    assert mined(spark, rows) == want


@pytest.mark.parametrize("rows", [[], [(1, None, 1)], [(100, [1.0], 1)], [(100, [1.0], 1), (101, [1.0], 2)], [(100, [], 1), (101, [], 1), (103, [], 2)]])
def test_few_rows(spark, rows):
    assert mined(spark, rows) == by_hand(rows)


def test_brackets_hold_and_leave_rows_unscored(monkeypatch):
    rng = np.random.default_rng(9)
    v = np.floor(256 * np.array([r[1] for r in drawn(rng, 400, 8, 8)])).astype(np.int64)
    sp = H.Space(8, int(abs(v).max()), int((v * v).sum(1).max()), v[:50])
    own, anchor = sp.distances(v), sp.distances(v, anchors=True)
    half = (v * v).sum(1) + sp.most
    for a in range(0, 400, 40):
        near, far = abs(anchor[a] - own).max(1), (anchor[a] + own).min(1)
        score = v @ v[a]
        assert ((half[a] - far**2) / 2 <= score + 1e-3).all()
        assert (score <= (half[a] - near**2) / 2 + 1e-3).all()
        best = np.sort(score)[-H.K]
        assert ((half[a] - near**2) / 2 < best).mean() > 0.5  # so many need no exact score


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got = sorted(((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in op12_hard_negatives(spark, sf).collect()), key=str)
    assert got == by_hand(rows)
