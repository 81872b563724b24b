"""Adaptive context-mixing range coder for blocks of token ids, many blocks in step.

Each id of a block has three predictions: order 0 is the block's own adaptive distribution over the ids that occur in it; orders 1 and 2 name the
id that last followed the same one or two ids, with a confidence that grows with its hits. They are mixed linearly: P(id) = f2 [named by order 2]
+ f1 [named by order 1] + f0 P0(id), with weights chosen by both confidences and adapted after each id. The mixture drives a carryless range coder
with 64-bit bounds that hands out 32-bit words. Every block begins with a fresh model, so it can be read alone.

What is sequential is the id in a block; blocks are not, so one numpy step codes one id of all the blocks of a wave. All model arithmetic is on integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Ids in a block and blocks in a wave: together they bound what a wave holds (some 30 KB a block).
BLOCK = 2048
WAVE = 4096

_U = np.uint64
#: The mixture's weights are parts of 2^12, order 0's chances of 2^11; an order's weight lies between the least and the most.
_BITS, _PART_BITS = 12, 11
_ALL, _PARTS = 1 << _BITS, 1 << _PART_BITS
_LEAST, _MOST = 16, 3968
#: Weights move by 1/2^4 of the way.
_RATE = 4
#: What an occurrence adds to an id's order-0 count, which begins at 1.
_GAIN = np.float32(2)
#: Blocks whose parts are made up at once, so that they stay in a core's cache.
_ROWS = 64
#: First weight of a prediction by its confidence (0: none yet).
_FIRST = np.array([16, 1700, 2600, 3100, 3400, 3600, 3750, 3900])
_SURE = len(_FIRST) - 1
#: Contexts of order 2 in a block: hashed, without a check, as the decoder meets the same ones.
_SLOTS = 1 << 11
# Fixed numbers of the steps, as arrays of no dimension: numpy is slower to take Python's numbers or its own scalars.
_1, _3, _SURE16, _NAME, _SLOT, _MIX, _MIX2 = (np.array(x, np.uint16) for x in (1, 3, _SURE, 0xFFFF ^ _SURE, _SLOTS - 1, 40503, 9973))
_0, _HALF, _LOWER_HALF, _PART, _SHIFT, _WIDTH, _WHOLE = (np.array(x, np.int32) for x in (0, 16, 0xFFFF, _PART_BITS, 12, 4095, _ALL))
_32, _LOW, _ONE, _LAST, _TOTAL = (np.array(x, _U) for x in (32, 1 << 32, 1, _ALL * _PARTS - 1, _BITS + _PART_BITS))
_RATE16 = np.array(_RATE, np.int16)
#: What a weight moves between, in the two halves of 32 bits.
_LEAST_BOTH, _STEP, _STEP1 = (np.array(x, np.int32) for x in (_LEAST | _LEAST << 16, _MOST - _LEAST, (_MOST - _LEAST) << 16))


def _first_weights() -> np.ndarray:
    """First weights of orders 2 (lower half) and 1 (upper half) at agree * 64 + confidence 2 * 8 + confidence 1."""
    sure2, sure1 = np.meshgrid(_FIRST, _FIRST, indexing="ij")
    free = _MOST + _LEAST - sure2
    apart = sure2 | np.maximum(_LEAST, sure1 * free >> _BITS) << 16
    agreed = np.minimum(_MOST, sure2 + (sure1 * free >> _BITS)) | _LEAST << 16
    return np.concatenate([apart.reshape(64), agreed.reshape(64)]).astype(np.int32)


_WEIGHTS = _first_weights()


class _Wave:
    """The models and bounds of blocks that go in step. Their lengths fall, so the ones still open are the first m.

    Choices are made by masks (all bits set, or none): numpy's where() takes many times as long. Symbols are 16-bit numbers of 11 bits; what a context
    names is kept as symbol * 8 + confidence.
    """

    def __init__(self, lengths: np.ndarray, alphabets: np.ndarray) -> None:
        n = self.n = len(lengths)
        self.lengths, self.stride = lengths, int(alphabets.max(initial=0)) + 1
        self.low, self.range = np.zeros(n, _U), np.full(n, 0xFFFFFFFFFFFFFFFF, _U)
        self.row = np.arange(n, dtype=np.int64) * self.stride
        self.row2 = n * self.stride + np.arange(n, dtype=np.int64) * _SLOTS
        self.named = np.zeros(n * (self.stride + _SLOTS), np.uint16)
        self.weights = np.tile(_WEIGHTS, n)
        self.weight_row = np.arange(n, dtype=np.int64) * len(_WEIGHTS)
        self.last, self.last2, self.place = np.zeros(n, np.uint16), np.zeros(n, np.uint16), self.row
        self.alphabets = alphabets
        self.occurs = (np.arange(self.stride)[None, :] < alphabets[:, None]).astype(np.float32)
        self.counts = self.occurs.copy()  # whole numbers below 2^24
        self.spread = np.zeros((n, self.stride), np.int32)
        self.owner: np.ndarray | None = None  # a reader's: the symbol, times 8, of each of a block's 2^11 parts

    def spans(self) -> Iterator[tuple[int, int, int]]:
        """(from, to, m): runs of steps with the same m open blocks and the same order-0 parts, which are made up here.

        parts[i, s] of the 2^11 parts are symbol s's: one, and its share of the rest; what rounding leaves is the first one's.
        """
        t, again, end = 0, 0, int(self.lengths.max(initial=0))
        closing = np.unique(self.lengths)
        while t < end:
            m = int(np.count_nonzero(self.lengths > t))
            if t == again:
                for at in range(0, m, _ROWS):
                    self._share(slice(at, min(at + _ROWS, m)))
                again = t + max(8, min(256, t // 4))
            to = min(again, int(closing[np.searchsorted(closing, t, "right")]))
            yield t, to, m
            t = to

    def _share(self, rows: slice) -> None:
        """Order 0's parts of some blocks. Single precision is the same everywhere; what it rounds up is less than a part in all, so none is lacking."""
        alphabets = self.alphabets[rows]
        most = int(alphabets.max())
        counts, spread = self.counts[rows, :most], self.spread[rows, :most]
        free = (_PARTS - alphabets).astype(np.float32) / counts.sum(axis=1)
        shares = counts * free[:, None]
        shares += self.occurs[rows, :most]
        parts = shares.astype(np.int32)
        parts[:, 0] += _PARTS - parts.sum(axis=1, dtype=np.int32)
        if self.owner is not None:
            each = np.tile(np.arange(0, 8 * most, 8, dtype=np.uint16), len(parts))
            self.owner[rows] = np.repeat(each, parts.reshape(-1)).reshape(-1, _PARTS)
        np.cumsum(parts, axis=1, out=spread)
        spread -= parts
        spread <<= 12
        spread |= parts

    def count(self, symbols: np.ndarray, m: int) -> None:
        """Add a span's symbols (steps, m) to order 0."""
        np.add.at(self.counts.reshape(-1), (symbols + self.row[:m]).reshape(-1), _GAIN)

    def predict(self, m: int) -> tuple[np.ndarray, np.ndarray]:
        """Look up what orders 2 and 1 name after the last symbols: where their weights end, order 2's and both weights' sum."""
        mixed = self.last[:m] * _MIX
        mixed += self.last2[:m] * _MIX2
        mixed &= _SLOT
        self.at = np.empty((2, m), np.int64)
        np.add(self.row2[:m], mixed, out=self.at[0])
        self.at[1] = self.place[:m]
        self.entry = self.named.take(self.at)
        self.sure = self.entry & _SURE16
        joint = ((self.entry[0] ^ self.entry[1]) <= _SURE16).astype(np.uint16)
        joint <<= _3
        joint |= self.sure[0]
        joint <<= _3
        joint |= self.sure[1]
        self.weight_at = self.weight_row[:m] + joint
        self.weight = self.weights.take(self.weight_at)
        two = self.weight & _LOWER_HALF
        return two, (self.weight >> _HALF) + two

    def narrow(self, by: np.ndarray, r: np.ndarray, two: np.ndarray, both: np.ndarray, spread: np.ndarray, m: int) -> None:
        """Take the id's part of 2^23: the weight of the order that names it (by: (2, m)), else its order-0 start and width out of what both leave."""
        self.by = by2, by1 = np.negative(by.view(np.int8)).astype(np.int32)
        other, left = ~(by2 | by1), _WHOLE - both
        start, width = spread >> _SHIFT, spread & _WIDTH
        start *= left
        start += both << _PART
        start &= other
        width *= left
        width &= other
        of2, of1 = two << _PART, (both - two) << _PART
        start |= of2 & by1
        width |= of2 & by2
        width |= of1 & by1
        self.low[:m] += r * start.view(np.uint32)
        np.multiply(r, width.view(np.uint32), out=self.range[:m])

    def short(self, m: int) -> np.ndarray:
        """Blocks whose range is short, brought under one upper word; the caller hands that word out and calls shift()."""
        short = (self.range[:m] < _LOW).nonzero()[0]
        low, width = self.low.take(short), self.range.take(short)
        split = (((low + (width - _ONE)) ^ low) >= _LOW).nonzero()[0]
        if len(split):
            at, low, width = short[split], low[split], width[split]
            lower = (((low >> _32) + _ONE) << _32) - low
            keep = lower >= width - lower
            self.low[at] = np.where(keep, low, low + lower)
            self.range[at] = np.where(keep, lower, width - lower)
        return short

    def shift(self, short: np.ndarray) -> None:
        self.low[short] <<= _32
        self.range[short] <<= _32

    def learn(self, x: np.ndarray, times8: np.ndarray, hit: np.ndarray, place: np.ndarray) -> None:
        """x: the symbols; hit: which orders named them; place: their places in tables of order 0.

        A name that was right is surer by one; a wrong one is half as sure, or gives way to the symbol. The order whose part was taken gets more weight, others less.
        """
        more = self.sure + _1
        less = more >> _1
        entry = self.entry - less
        more >>= _3
        less += _1
        less -= more
        less &= np.negative(hit.astype(np.uint16))
        entry += less
        hit |= self.sure > _1
        fresh = times8 | _1
        entry ^= fresh
        entry &= np.negative(hit.astype(np.uint16))
        entry ^= fresh
        self.named[self.at] = entry
        goal = self.by[0] & _STEP
        goal |= self.by[1] & _STEP1
        goal += _LEAST_BOTH
        halves, weight = goal.view(np.int16), self.weight.view(np.int16)
        halves -= weight
        halves >>= _RATE16
        halves += weight
        self.weights[self.weight_at] = goal
        self.last, self.last2, self.place = x, self.last, place


def _numbered(ids: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct ids, each id's number among them). numbers: room for a number of each small id, whatever it holds."""
    if not len(ids) or ids.max() >= len(numbers):
        return np.unique(ids, return_inverse=True)
    ordered = np.sort(ids.astype(np.uint16), kind="stable")  # by radix
    first = np.ones(len(ids), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=first[1:])
    distinct = ordered[first]
    numbers[distinct] = np.arange(len(distinct), dtype=np.uint16)
    return distinct.astype(ids.dtype), numbers.take(ids)


def encoded(blocks: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(sorted distinct ids, 32-bit words) of each block; a block has 1 to BLOCK ids."""
    room = np.zeros(1 << 16, np.uint16)
    numbered = [_numbered(b, room) for b in blocks]
    order = sorted(range(len(blocks)), key=lambda i: (-len(blocks[i]), len(numbered[i][0])))
    lengths, n = np.array([len(blocks[i]) for i in order], np.int64), len(order)
    own = np.zeros((n, int(lengths.max(initial=0))), np.uint16)
    for k, i in enumerate(order):
        own[k, : lengths[k]] = numbered[i][1]
    wave = _Wave(lengths, np.array([len(numbered[i][0]) for i in order], np.int64))
    flat = wave.spread.reshape(-1)
    words = np.zeros((n, own.shape[1] + 4), np.uint32)
    row = np.arange(n, dtype=np.int64) * words.shape[1]
    next_word, out_words = row.copy(), words.reshape(-1)
    for t, to, m in wave.spans():
        symbols = np.ascontiguousarray(own[:m, t:to].T)
        for x in symbols:
            two, both = wave.predict(m)
            times8 = x << _3
            hit = (wave.entry ^ times8) <= _SURE16
            by = hit.copy()
            np.greater(hit[1], hit[0], out=by[1])
            place = wave.row[:m] + x
            wave.narrow(by, wave.range[:m] >> _TOTAL, two, both, flat.take(place), m)
            short = wave.short(m)
            at = next_word.take(short)
            out_words[at] = wave.low.take(short) >> _32
            next_word[short] = at + 1
            wave.shift(short)
            wave.learn(x, times8, hit, place)
        wave.count(symbols, m)
    out_words[next_word] = wave.low >> _32
    out_words[next_word + 1] = wave.low & _U(0xFFFFFFFF)
    filled = next_word - row
    out: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0), np.zeros(0))] * n
    for k, i in enumerate(order):
        out[i] = numbered[i][0], words[k, : filled[k] + 2].copy()
    return out


def decoded(blocks: list[tuple[np.ndarray, np.ndarray, int]]) -> list[np.ndarray]:
    """The ids of blocks given as (sorted distinct ids, words, number of ids)."""
    order = sorted(range(len(blocks)), key=lambda i: (-blocks[i][2], len(blocks[i][0])))
    lengths, n = np.array([blocks[i][2] for i in order], np.int64), len(order)
    wave = _Wave(lengths, np.array([len(blocks[i][0]) for i in order], np.int64))
    wave.owner = np.zeros((n, _PARTS), np.uint16)
    words = np.zeros((n, max((len(b[1]) for b in blocks), default=0) + 2), np.uint32)
    for k, i in enumerate(order):
        words[k, : len(blocks[i][1])] = blocks[i][1]
    code = (words[:, 0].astype(_U) << _32) | words[:, 1]
    next_word, in_words = np.arange(n, dtype=np.int64) * words.shape[1] + 2, words.reshape(-1)
    own = np.zeros((n, int(lengths.max(initial=0))), np.uint16)
    part_row = np.arange(n, dtype=np.int64) << _PART_BITS
    flat, owner = wave.spread.reshape(-1), wave.owner.reshape(-1)
    for t, to, m in wave.spans():
        symbols = np.empty((to - t, m), np.uint16)
        for x in symbols:
            two, both = wave.predict(m)
            r = wave.range[:m] >> _TOTAL
            v = code[:m] - wave.low[:m]
            v //= r
            v = np.minimum(v, _LAST).astype(np.int32)
            slot = v >> _PART
            by = np.empty((2, m), bool)
            np.less(slot, two, out=by[0])
            np.less(slot, both, out=by[1])
            by[1] ^= by[0]
            v -= both << _PART
            part = np.maximum(v, _0).astype(np.float32)  # whole numbers below 2^23, by ones up to 2^12: single precision's quotients are cut off rightly
            part /= (_WHOLE - both).astype(np.float32)
            mask2, mask1 = np.negative(by.astype(np.uint16))
            times8 = owner.take(part_row[:m] + part.astype(np.int32))
            times8 &= ~(mask2 | mask1)
            mask2 &= wave.entry[0]
            mask1 &= wave.entry[1]
            times8 |= mask2
            times8 |= mask1
            np.right_shift(times8, _3, out=x)
            times8 &= _NAME
            place = wave.row[:m] + x
            wave.narrow(by, r, two, both, flat.take(place), m)
            short = wave.short(m)
            at = next_word.take(short)
            code[short] = (code.take(short) << _32) | in_words.take(at)
            next_word[short] = at + 1
            wave.shift(short)
            wave.learn(x, times8, (wave.entry ^ times8) <= _SURE16, place)
        wave.count(symbols, m)
        own[:m, t:to] = symbols.T
    out = [np.zeros(0, np.uint32)] * n
    for k, i in enumerate(order):
        out[i] = blocks[i][0].take(own[k, : lengths[k]])
    return out
