"""Signatures of texts for substring search: sampled grams of eight bytes that any long enough common substring shares.

Of each five grams in a row the one with the smallest scrambled value is taken (all of them, if several have it). Two texts that share twelve bytes share
such a run of grams, and so a taken one.

Grams that are taken one after the other in a text are so in any text that holds it: a gram between them that only a window over the border takes would lie
in the first one's own window too. So runs of them can be looked for, which say more than one gram.
"""

from __future__ import annotations

import numpy as np

#: Bytes in a gram, grams in a window, and bytes that a string needs to have a whole window.
GRAM, WINDOW = 8, 5
LEAST_BYTES = GRAM + WINDOW - 1
#: Lengths of runs of taken grams; each is made up of two of the lengths before it.
RUNS = (1, 2, 3, 4, 8)
#: Grams are taken by the upper half of their product with it, so that common letters don't decide what is taken.
_ODD = np.uint64(0x9E3779B97F4A7C15)


def scrambled(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _of_five(best: np.ufunc, x: np.ndarray) -> np.ndarray:
    """The least or greatest of each five values in a row (WINDOW)."""
    two = best(x[:-1], x[1:])
    return best(best(two[:-2], two[2:])[:-1], x[WINDOW - 1 :])


def _grams(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each byte on as a number; one view of the bytes gives every eighth."""
    out = np.empty(len(data) - GRAM + 1, np.uint64)
    for i in range(GRAM):
        out[i::GRAM] = data[i : len(data) - (len(data) - i) % GRAM].view("<u8")
    return out


def signatures(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, gram) of the taken grams of texts, a text being its number and a gram its eight bytes read as a signed integer."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    if len(data) < LEAST_BYTES:
        return (np.zeros(0, np.int64),) * 3
    ends = np.cumsum([len(t) for t in texts])
    grams = _grams(data)
    order = ((grams * _ODD) >> np.uint64(32)).astype(np.uint32)
    np.maximum(order, np.uint32(1), out=order)
    least = _of_five(np.minimum, order)
    over = (ends[:, None] - np.arange(1, LEAST_BYTES)).reshape(-1)  # windows that reach over a text's end take nothing
    least[over[(over >= 0) & (over < len(least))]] = 0
    place = np.flatnonzero(order == _of_five(np.maximum, np.pad(least, WINDOW - 1)))  # it is the smallest of a window that it lies in
    sizes = np.diff(np.searchsorted(place, ends), prepend=0)
    return np.repeat(np.arange(len(texts)), sizes), place - np.repeat(np.concatenate([[0], ends[:-1]]), sizes), grams[place].view(np.int64)


def signature(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(places, grams) of one text."""
    return signatures([text])[1:]


def runs(of: np.ndarray, places: np.ndarray, grams: np.ndarray) -> list[np.ndarray]:
    """Keys of the runs of taken grams from each one on, for each length of RUNS: scrambled, and by the distances too. The last n - 1 of all have no key of n, and one that reaches over a text's end is of no use."""
    out = {1: scrambled(grams.view(np.uint64))}
    for length in RUNS[1:]:
        head = max(n for n in out if length - n in out)
        n, tail = max(0, len(of) - length + 1), out[length - head]
        out[length] = scrambled(out[head][:n] * _ODD + tail[head : head + n] + (places[head : head + n] - places[:n]).astype(np.uint64))
    return [out[n] for n in RUNS]


def around(texts: list[bytes], of: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The four bytes before a place of a text in the lower half of a number, and the four after another place; where there are none, one that no text has."""
    pad = b"\xff" * 4
    data = np.frombuffer(pad + pad.join(texts) + pad, np.uint8)
    shift = np.cumsum([4, *(len(t) + 4 for t in texts[:-1])])[of]
    near = np.concatenate([(begin + shift)[:, None] + np.arange(-4, 0), (end + shift)[:, None] + np.arange(4)], axis=1)
    return np.ascontiguousarray(data[near]).view("<u8").reshape(-1)


def edges(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """The bits of around() that stand for so many bytes before and after."""
    one, eight = np.uint64(1), np.uint64(8)
    low = ((one << eight * before.astype(np.uint64)) - one) << eight * (4 - before).astype(np.uint64)
    return low | ((one << eight * after.astype(np.uint64)) - one) << np.uint64(32)
