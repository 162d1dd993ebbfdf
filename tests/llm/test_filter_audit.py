"""The filter audit against filters applied one after another."""

from __future__ import annotations

import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest

from equiloom.llm import filter_audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOC, LABEL = "doc_id long, text string, source string, part string, h string", "doc_id long, quality int, toxic int"


def fails(rows, i):
    doc, text, *_ = rows[i]
    text = text or ""
    words = WORD.findall(text)
    return {
        "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), "D": bool(re.search(r"[#$%&*|]", text)),
        "E": doc is not None and any(r[0] is not None and r[0] < doc and (r[1] or "") == text for r in rows),
    }


def by_hand(rows, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    bits = [fails(rows, i) for i in range(len(rows))]
    out, total = {}, Counter()
    for part in {r[2] or "" for r in rows}:
        inside = [i for i, r in enumerate(rows) if (r[2] or "") == part]
        for order in permutations("ABCDE"):
            left = inside
            for step, f in enumerate(order, 1):
                lost = [i for i in left if bits[i][f]]
                left = [i for i in left if not bits[i][f]]
                alone = sum(bits[i][f] and not any(bits[i][g] for g in order if g != f) for i in inside)
                total[part, f] += len(lost)
                out[part, "".join(order), step] = (len(left), len(lost), sum(bits[i][f] for i in inside) - len(lost), alone, sum(rows[i][0] in good for i in lost), sum(rows[i][0] in toxic for i in lost))
    return {k: (*v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audited(spark, rows, labels):
    got = filter_audit.audit(spark.createDataFrame(rows, DOC).repartition(3), spark.createDataFrame(labels, LABEL)).collect()
    names = "kept removed redundant unique_fails good_lost toxic_lost shapley".split()
    found = {(r.part, r.filter_order, r.step): tuple(r[n] for n in names) for r in got}
    assert len(found) == len(got)
    return found


@pytest.fixture
def rows():
    rng = np.random.default_rng(4)
    out = []
    for d in range(150):
        words = [f"w{i}" for i in rng.integers(0, int(rng.choice([40, 4000])), int(rng.choice([5, 150, 260])))]
        text = " ".join(words)
        text = text.upper() if rng.random() < 0.3 else text
        text += " #é" if rng.random() < 0.3 else ""
        out.append((int(rng.integers(0, 120)), out[-1][1] if out and rng.random() < 0.4 else text, [None, "", "a", "b"][int(rng.integers(0, 4))], "x", "y"))
    return [*out, out[0], out[0], (None, out[0][1], "a", None, None), (None, out[0][1], "a", None, None), (-5, None, None, None, None), (7, "", "a", None, None), (8, " \x0b\x0c\t", "z", None, None), (9, "x " * 60000, "z", None, None)]


def test_every_order(spark, rows, monkeypatch):
    monkeypatch.setattr(filter_audit, "ROWS", 40)
    labels = [(d, d % 2, d % 3 == 0 and 1 or 0) for d in range(90)] + [(3, None, 1), (3, 1, None), (None, 1, 1)]
    want = by_hand(rows, labels)
    assert audited(spark, rows, labels) == want
    assert {k[0] for k in want} == {"", "a", "b", "z"} and any(v[3] for v in want.values())


def test_without_rows(spark, rows):
    assert audited(spark, [], []) == {}
    assert audited(spark, rows[:3], []) == by_hand(rows[:3], [])


@pytest.mark.parametrize("n", [1, 63, 64, 65, 500])
def test_bitmap_words(n):
    rng = np.random.default_rng(n)
    part, bits, marks = rng.permutation(np.arange(n) % min(n, 3)), rng.integers(0, 8, n), rng.integers(0, 4, n)
    found, size = filter_audit.bitmap_counts(part, bits, marks, 3, 2)
    for seen in range(8):
        for f in range(3):
            if not seen >> f & 1:
                for p in range(len(size)):
                    lost = (part == p) & (bits & seen == 0) & (bits >> f & 1 == 1)
                    want = [((part == p) & (bits & seen != 0)).sum(), lost.sum(), (lost & (marks & 1 == 1)).sum(), (lost & (marks & 2 == 2)).sum()]
                    assert found[seen, f, :, p].tolist() == want
