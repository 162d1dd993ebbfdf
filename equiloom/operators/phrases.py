"""All phrases of many patterns in one pass over each text.

The patterns' phrases become one automaton, so a text is read once however many
there are; a batch of texts at a time goes through Arrow, and what comes back is
a few numbers a row, which SQL expressions take from there. Rows stay where
they are.

Cases: a null text is the empty text and holds nothing; white space within a
phrase stands for any run of it; a text of any length is read whole; equal
phrases of several patterns are one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from equiloom.functions import text
from equiloom.functions.memory import each_text, give_back

_WORD = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_")
_SPACES = "\t\n\x0b\f\r\xa0"
_RUN = re.compile("  +")
_FINANCE = re.compile(rf"\b(?:{text.FINANCE_NOISE})\b", re.ASCII)
_MEDICAL = re.compile(rf"\b(?:{text.MEDICAL_NOISE})\b", re.ASCII)
FOUND = ("terms", "clauses", "loose")


def _low(x: str) -> str:
    """Lower case, character by character, so that places stay."""
    low = x.lower()
    return low if len(low) == len(x) else "".join(c.lower() if len(c.lower()) == 1 else c for c in x)


def _spaced(x: str) -> str:
    """White space as spaces, one for one."""
    for c in _SPACES:
        if c in x:
            x = x.replace(c, " ")
    return x


class Phrases:
    """The phrases and clauses of patterns, each numbered once."""

    def __init__(self, patterns: list[str], loose_over: int = 140):
        self.loose_over = loose_over
        self.terms: list[str] = []
        self.clauses: list[tuple[int, ...]] = []
        self.of: dict[str, list[int]] = {}
        number: dict[str, int] = {}
        clause_number: dict[tuple[int, ...], int] = {}
        for p in patterns:
            got = []
            for c in text.parse_pattern(p):
                ids = tuple(number.setdefault(t, len(number)) for t in c)
                got.append(clause_number.setdefault(ids, len(clause_number)))
            self.of[p] = got
        self.terms, self.clauses = list(number), list(clause_number)

    def names(self) -> list[str]:
        """Each clause as `a + b`."""
        return [" + ".join(self.terms[t] for t in c) for c in self.clauses]

    def reader(self):
        """A function from a text to its terms, clauses and loose clauses."""
        import ahocorasick

        spelled: dict[str, list[int]] = {}
        for i, t in enumerate(self.terms):
            spelled.setdefault(_RUN.sub(" ", _spaced(_low(t))), []).append(i)
        automaton = ahocorasick.Automaton()
        for s, ids in spelled.items():
            automaton.add_word(s, (len(s), ids))
        if spelled:
            automaton.make_automaton()
        exact = [text.is_acronym(t) for t in self.terms]
        medical = [t.lower() in text.MEDICAL_TERMS for t in self.terms]
        size = [len(t) for t in self.terms]
        far = {t for c in self.clauses if len(c) > 1 for t in c}

        def void(low: str, at: int, t: int) -> bool:
            end = at + size[t]
            if _FINANCE.search(low[max(0, at - 16) : end + 120]):
                return True
            return medical[t] and _MEDICAL.search(low[max(0, at - 24) : end + 64]) is not None

        def read(x: str | None) -> tuple[list[int], list[int], list[int]]:
            if not x or not spelled:
                return [], [], []
            low, n = _low(x), len(x)
            flat, place = _spaced(low), None
            if "  " in flat:  # where each character of the shorter text is in the text
                gone = np.zeros(n, bool)
                for m in _RUN.finditer(flat):
                    gone[m.start() + 1 : m.end()] = True
                flat, place = _RUN.sub(" ", flat), np.flatnonzero(~gone)
            held, clear, places = set(), set(), {}
            for last, (length, ids) in automaton.iter(flat):
                if place is None:
                    at, end = last - length + 1, last + 1
                else:
                    at, end = int(place[last - length + 1]), int(place[last]) + 1
                if all(t in clear and t not in far for t in ids):
                    continue
                # A border lies where a word character meets another kind.
                if ((at > 0 and x[at - 1] in _WORD) == (x[at] in _WORD)) or ((x[end - 1] in _WORD) == (end < n and x[end] in _WORD)):
                    continue
                for t in ids:
                    if t in far:
                        places.setdefault(t, []).append(at)
                    if t in clear or (at > 0 and x[at - 1] == "-") or (exact[t] and x[at:end] != self.terms[t]):
                        continue
                    held.add(t)
                    if not void(low, at, t):
                        clear.add(t)
            clauses = [i for i, c in enumerate(self.clauses) if clear.issuperset(c)]
            return sorted(held), clauses, [i for i in clauses if len(self.clauses[i]) > 1 and self._apart(self.clauses[i], places)]

        return read

    def _apart(self, clause: tuple[int, ...], places: dict[int, list[int]]) -> bool:
        """Whether places of different phrases all lie further apart; the least
        distance is between neighbours."""
        tagged = sorted((at, i) for i, t in enumerate(clause) for at in places.get(t, ()))
        return all(b - a > self.loose_over for (a, i), (b, j) in zip(tagged, tagged[1:]) if i != j)


def scan(df: DataFrame, column: str, phrases: Phrases, *keep: str | Column) -> DataFrame:
    """The columns to keep with `terms`, `clauses` and `loose`: numbers of the
    phrases that a row's text holds, of the clauses that match, and of those
    whose phrases lie further apart than phrases.loose_over."""
    kept = df.select(*keep)
    schema = T.StructType([*kept.schema.fields, *(T.StructField(c, T.ArrayType(T.IntegerType())) for c in FOUND)])
    n = len(kept.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = phrases.reader()
        for batch in batches:
            found = list(zip(*(read(x) for x in each_text(batch.column(n))), strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *(pa.array(x, pa.list_(pa.int32())) for x in found)], names=[*batch.schema.names[:n], *FOUND])
            del batch, found
            give_back()

    return df.select(*keep, F.col(column).alias(f"__{column}")).mapInArrow(run, schema)


def holds(phrases: Phrases, pattern: str) -> Column:
    """Whether some clause of a pattern is among a row's `clauses`."""
    return reduce(lambda a, b: a | b, [F.array_contains("clauses", i) for i in phrases.of[pattern]], F.lit(False))
