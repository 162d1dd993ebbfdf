"""A context-mixing range coder for blocks of 16-bit ids.

All blocks of a container move in lockstep, one lane and one code each. Three
orders predict an id:

* order 2: the id that last followed the same two ids in this block;
* order 1: the id that last followed the same one in any block, as all blocks
  teach it after each step;
* order 0: how often each id occurs in the container, told in its header.

Of orders 2 and 1 the model learns from all blocks how often a prediction of
such confidence holds.

Their mixture is p2 on the first id, (1 - p2) p1 on the second and the rest by
order 0; where the two predict the same id it gets both shares. One interval of
a range of 2**30 is coded an id: the predicted ids first, in units of 2**18,
then order 0 in 2**18 parts of what is left.
"""

from __future__ import annotations

import numpy as np

BLOCK = 4096
PARTS = 1 << 18
_FULL = 4096
_RANGE = 30  # bits
#: A code's window has 48 bits and moves on by 16 when the span is below this.
_THIN = 1 << 32
_PAIRS = 512  # slots of order 2 by lane; they follow the 65536 of order 1
_CONFIDENT = 8
#: The state of a slot is its confidence, and _CONFIDENT more in order 1. By
#: twice the state and one for a hit: the next state, and whether the id that
#: came takes the slot, which a guess without confidence leaves to it.
_NEXT = np.array([[max(0, c - 1) + o, min(_CONFIDENT - 1, c + 1) + o] for o in (0, _CONFIDENT) for c in range(_CONFIDENT)], np.int64).ravel() << 16
_TAKES = np.array([[0xFFFF * (c == 0)] * 2 for _ in range(2) for c in range(_CONFIDENT)], np.int64).ravel()
#: Least and most that a guess is trusted, of _FULL: the second keeps a share.
_LEAST, _MOST = 16, 3840
_FIRST = np.array([60, 500, 1000, 1500, 2000, 2400, 2800, 3200] * 2, np.int64)


def prior(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids that occur and their shares of PARTS, one at least."""
    count = np.bincount(ids, minlength=1)
    known = np.flatnonzero(count)
    share = 1 + count[known] * (PARTS - len(known)) // max(1, len(ids))
    share[np.argmax(share)] += PARTS - share.sum()
    return known.astype(np.uint16), share.astype(np.uint32)


class _Model:
    """Two rows of slots, states and guesses: order 2, then order 1."""

    def __init__(self, lanes: int, known: np.ndarray, share: np.ndarray):
        self.slots = np.zeros(65536 + lanes * _PAIRS, np.int32)  # id, and state above it
        self.slots[:65536] = _CONFIDENT << 16
        self.base = 65536 + np.arange(lanes) * _PAIRS
        self.held = _FIRST.copy()
        self.hits, self.seen = _FIRST >> 6, np.full(2 * _CONFIDENT, _FULL >> 6, np.int64)
        self.at = np.empty((2, lanes), np.int64)
        self.last, self.before = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
        self.step = 0
        self.share = np.zeros(65536, np.int64)
        self.share[known] = share
        self.begin = np.zeros(65536, np.int64)
        self.begin[known] = np.cumsum(share.astype(np.int64)) - share
        self.of = np.repeat(known.astype(np.int64), share)  # part to id

    def predict(self):
        pair = self.last * 40503
        pair += self.before
        pair &= _PAIRS - 1
        np.add(pair, self.base, out=self.at[0])
        self.at[1] = self.last
        slot = self.slots.take(self.at).astype(np.int64)
        self.state = slot >> 16
        slot &= 0xFFFF
        self.id = slot
        q2, q1 = self.held.take(self.state)
        p1 = _FULL - q2
        p1 *= q1
        p1 >>= 12
        top = q2 + p1
        self.rest = _FULL - top
        p1 *= slot[0] == slot[1]
        p1 += q2
        p1 <<= _RANGE - 12
        top <<= _RANGE - 12
        self.p2, self.top = p1, top

    def interval(self, ids, other2, other1):
        """Start and width of each id, of 2**30; whether (1 or 0) it is another
        than the first guess, and than the second."""
        p2, top, rest = self.p2, self.top, self.rest
        start = self.begin.take(ids)
        start *= rest
        start += top
        start -= p2
        start *= other1
        start += p2
        start *= other2
        second = top - p2
        width = self.share.take(ids)
        width *= rest
        width -= second
        width *= other1
        width += second
        width -= p2
        width *= other2
        width += p2
        return start, width

    def find(self, value):
        """The ids whose intervals hold the values below 2**30, and whether
        they are other than the guesses."""
        other2, other1 = (value >= self.p2).astype(np.int64), (value >= self.top).astype(np.int64)
        part = value - self.top
        part *= other1
        ids = self.of.take((part / self.rest).astype(np.int64))
        ids -= self.id[1]
        ids *= other1
        ids += self.id[1]
        ids -= self.id[0]
        ids *= other2
        ids += self.id[0]
        return ids, other2, other1

    def update(self, ids):
        """Where lanes meet in a slot, the last lane's id stays."""
        differ = self.id ^ ids
        self.state <<= 1
        self.state += differ == 0
        differ &= _TAKES.take(self.state)
        differ ^= self.id
        differ |= _NEXT.take(self.state)
        self.slots[self.at.ravel()] = differ.ravel()
        if self.step < 32 or self.step % 8 == 0:
            missed, hit = np.bincount(self.state.ravel(), minlength=4 * _CONFIDENT).reshape(-1, 2).T
            self.hits += hit
            self.seen += missed + hit
            self.held = _LEAST + self.hits * (_MOST - _LEAST) // self.seen
            old = self.seen > 1 << 18
            self.hits >>= old
            self.seen >>= old
        self.step += 1
        self.before = ids * 30011
        self.last = ids


def encode(ids: np.ndarray, known: np.ndarray, share: np.ndarray) -> list[bytes]:
    """The codes of the blocks, the rows of `ids`, under the prior given."""
    lanes, steps = ids.shape
    model = _Model(lanes, known, share)
    low, span = np.zeros(lanes, np.int64), np.full(lanes, 1 << 48, np.int64)
    wide = 2 * steps + 8
    out = np.zeros(lanes * wide, np.int32)  # words, and carries above them
    first = np.arange(lanes) * wide
    at = first.copy()
    for now in np.ascontiguousarray(ids.T):
        now = now.astype(np.int64)
        model.predict()
        start, width = model.interval(now, *(model.id != now).astype(np.int64))
        span >>= _RANGE
        start *= span
        low += start
        span *= width
        thin = np.flatnonzero(span < _THIN)
        while len(thin):
            head, narrow, place = low[thin], span[thin] << 16, at[thin]
            out[place] = head >> 32
            at[thin] = place + 1
            low[thin] = (head & _THIN - 1) << 16
            span[thin] = narrow
            thin = thin[narrow < _THIN]
        model.update(now)
    # A word and the zeros that are read after it lie within the last span.
    out[at] = low + _THIN - 1 >> 32
    size = at + 1 - first
    out = out.reshape(lanes, wide)[:, : size.max()]
    while (carry := out >> 16).any():
        out &= 0xFFFF
        out[:, :-1] += carry[:, 1:]
    data = out.astype(np.uint16)
    return [data[i, :n].tobytes() for i, n in enumerate(size.tolist())]


def decode(codes: list[bytes], steps: int, known: np.ndarray, share: np.ndarray) -> np.ndarray:
    """The rows of ids, `steps` each, that `encode` was given."""
    lanes = len(codes)
    wide = max(map(len, codes), default=0) // 2 + 8
    words = np.frombuffer(b"".join(code.ljust(2 * wide, b"\0") for code in codes), np.uint16)
    model = _Model(lanes, known, share)
    at = np.arange(lanes) * wide
    value, span = np.zeros(lanes, np.int64), np.full(lanes, 1 << 48, np.int64)
    for _ in range(3):
        value = value << 16 | words[at]
        at += 1
    out = np.zeros((steps, lanes), np.uint16)
    most = (1 << _RANGE) - 1
    for row in out:
        model.predict()
        span >>= _RANGE
        # Both are below 2**48, and the quotient is rounded to no other integer.
        now, other2, other1 = model.find(np.minimum((value / span).astype(np.int64), most))
        start, width = model.interval(now, other2, other1)
        start *= span
        value -= start
        span *= width
        thin = np.flatnonzero(span < _THIN)
        while len(thin):
            place, narrow = at[thin], span[thin] << 16
            value[thin] = value[thin] << 16 | words[place]
            span[thin] = narrow
            at[thin] = place + 1
            thin = thin[narrow < _THIN]
        row[:] = now
        model.update(now)
    return out.T
