"""Ids of whole documents under a merge-type sentencepiece model, and back.

Every row is encoded where it is read; texts are taken in slices of about CHUNK
characters, a longer text in several, cut where no piece holds the characters
around, so a task's memory does not follow the longest text (only a stretch
without any such place is held whole).

Cases: a null or empty text has the begin and end ids alone and decodes to the
empty text; characters that the model lacks become bytes and come back; the
string of a control piece in a text is text; repeated rows and doc_ids each give
a row; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from equiloom.llm import common as C
from equiloom.llm.piece_model import SPACE, PieceModel, model

CHUNK = 1 << 20


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _stretches(text: str, pieces: PieceModel):
    """The text as the model sees it, in stretches of CHUNK characters or to
    the next place where it may be cut."""
    if not text:
        return
    at = 0
    while at < len(text):
        to = at + CHUNK
        while to < len(text):
            cut = np.flatnonzero(pieces.borders(_points(text[to - 1 : to + 4096].replace(" ", SPACE)))[1:])
            if len(cut):
                to += int(cut[0])
                break
            to += 4095
        yield ("" if at else SPACE) + text[at:to].replace(" ", SPACE)
        at = to


def _batches(texts, pieces: PieceModel):
    """(row, ids) of all stretches in order, several encoded together."""
    rows, held, size = [], [], 0

    def out():
        offs = np.concatenate(([0], np.cumsum([len(x) for x in held])))
        ids, ends = pieces.encode(_points("".join(held)), offs)
        for row, a, z in zip(rows, ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            yield row, ids[a:z]

    for row, text in enumerate(texts):
        for part in _stretches(text, pieces):
            if held and size + len(part) > 2 * CHUNK:
                yield from out()
                rows, held, size = [], [], 0
            rows.append(row)
            held.append(part)
            size += len(part)
    if held:
        yield from out()


class _Row:
    """What is gathered of a row's stretches."""

    def __init__(self, keep: bool):
        self.n, self.sums, self.keep = 0, (hashlib.sha256(), hashlib.sha256()), keep
        self.ids: list[np.ndarray] = []
        self.shown: list[bytes] = []
        self.opened = False

    def add(self, ids: np.ndarray, shown: bytes):
        self.n += len(ids)
        self.sums[0].update(ids.astype("<u4"))
        self.sums[1].update(shown)
        if self.keep:
            self.ids.append(ids)
            self.shown.append(shown)


def tokenize(docs: DataFrame, path: str, keep: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row and, if they
    are to be kept, ids and the text they decode to."""

    def run(batches):
        pieces = model(path)
        begin, end = np.array([pieces.begin], np.int32), np.array([pieces.end], np.int32)
        for batch in batches:
            for part in C.slices([batch]):
                rows = [_Row(keep) for _ in range(part.num_rows)]
                for r in rows:
                    r.add(begin, b"")
                for row, ids in _batches(pc.fill_null(part.column("text"), "").to_pylist(), pieces):
                    r = rows[row]
                    shown = pieces.decode(ids)
                    r.add(ids, shown if r.opened else shown[1:])  # without the space put before the text
                    r.opened = True
                for r in rows:
                    r.add(end, b"")
                more = []
                if keep:
                    ends = np.cumsum([0, *(r.n for r in rows)])
                    more = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([x for r in rows for x in r.ids]))), pa.array([b"".join(r.shown).decode() for r in rows], pa.string())]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([r.n for r in rows], pa.int64()), pa.array([r.sums[0].hexdigest() for r in rows]), pa.array([r.sums[1].hexdigest() for r in rows]), *more],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "text"] if keep else [])],
                )
        C.give_back()

    form = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, text string" if keep else "")
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, form)
