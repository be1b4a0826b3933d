"""Suffix arrays by induced sorting in numpy.

Suffixes are classified as larger (L) or smaller (S) than their right neighbour. The leftmost S
suffixes (LMS) are sorted, by name where their substrings differ and by recursion on the names
where some agree, and all others are induced from them: L suffixes from the LMS ones, then S suffixes
from the L ones. A suffix is ordered by the symbols of its run (up to the next suffix of the other
type) and then by the place of that suffix; so stable counting passes over the runs, from their
ends to their starts, induce all suffixes of a type, whatever the number of symbols.
"""

from __future__ import annotations

import numpy as np

from .common import mix64, powers


def classify(text: np.ndarray) -> np.ndarray:
    """True where the suffix is S; the last symbol, the least of all, is S."""
    n = len(text)
    at = np.arange(n, dtype=np.int32)
    at[:-1][text[:-1] == text[1:]] = n - 1
    nearest = np.minimum.accumulate(at[::-1])[::-1]  # the first place from here on that isn't level with its neighbour
    rises = np.ones(n, bool)
    rises[:-1] = text[:-1] < text[1:]
    return rises[nearest]


def _stable(keys: np.ndarray) -> np.ndarray:
    """Stable order of numbers from 0, by counting passes of 16 bits."""
    most = int(keys.max()) if len(keys) else 0
    order = np.argsort(keys.astype(np.uint16), kind="stable")
    shift = 16
    while most >> shift:
        order = order[np.argsort((keys[order] >> shift).astype(np.uint16), kind="stable")]
        shift += 16
    return order


def _by_runs(digits: np.ndarray, places: np.ndarray, run: np.ndarray) -> np.ndarray:
    """Suffixes of one type in order; places: theirs, by the rank of what their runs end in, run: how far that is."""
    by = _stable(run)
    places, run = places[by], run[by]
    edge = np.searchsorted(run, np.arange(1, int(run[-1]) + 2)) if len(run) else np.zeros(1, np.int64)
    here = places[:0]
    for k in range(len(edge) - 1, 0, -1):
        # those whose runs end k places on join in, in the order of what they end in
        here = np.concatenate([places[edge[k - 1] : edge[k]], here])
        here = here[_stable(digits[here + k])]
    return here[_stable(digits[here])]


def _induce(text: np.ndarray, small: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """All suffixes in order, given the LMS ones in order (of suffixes, or of first symbols for a sorting of substrings)."""
    n = len(text)
    digits = text * np.int32(2) + small  # of equal symbols, L comes before S
    digits = digits.astype(np.uint16) if int(text.max()) < 1 << 15 else digits
    rank = np.zeros(n, np.int32)

    def of(kind: np.ndarray, ends: np.ndarray, others: np.ndarray) -> np.ndarray:
        """Suffixes of a kind, induced from those at `ends`, in order, of which each run ends in the next of the others."""
        rank[ends] = np.arange(len(ends), dtype=np.int32)
        stop = np.where(others, np.arange(n, dtype=np.int32), np.int32(n))
        stop = np.minimum.accumulate(stop[::-1])[::-1]
        places = np.flatnonzero(kind).astype(np.int32)
        stop = stop[places]
        by = _stable(rank[stop])
        return _by_runs(digits, places[by], (stop - places)[by])

    larger = of(~small, lms, small)
    rest = small.copy()
    rest[-1] = False  # the end, the first of all, is induced by none
    smaller = np.r_[np.int32(n - 1), of(rest, larger, ~small)]
    both = np.concatenate([larger, smaller])
    return both[_stable(digits[both])]


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Start places of the suffixes of a string of small integers from 0, in order; a prefix comes before what it begins."""
    return _sorted(np.r_[text.astype(np.int32) + 1, np.int32(0)])[1:]


def _sorted(text: np.ndarray) -> np.ndarray:
    """The same of a string that ends in its one least symbol."""
    n = len(text)
    if n == 1:
        return np.zeros(1, np.int32)
    small = classify(text)
    lms = (np.flatnonzero(small[1:] & ~small[:-1]) + 1).astype(np.int32)
    order = _induce(text, small, lms[_stable(text[lms])])
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    order = order[is_lms[order]]
    # names: equal for equal substrings up to the next LMS place, compared by hash and length
    end = np.r_[lms[1:], n - 1] + 1
    wide = np.zeros(n + 1, np.uint64)
    np.cumsum(mix64(text.astype(np.uint64) + np.uint64(1)) * powers(n), out=wide[1:])
    mark = mix64((wide[end] - wide[lms]) * powers(n, inverse=True)[lms] + (end - lms).astype(np.uint64))
    del wide
    at = np.empty(n, np.int32)
    at[lms] = np.arange(len(lms), dtype=np.int32)
    seq = at[order]
    new = np.r_[0, np.cumsum(mark[seq][1:] != mark[seq][:-1])].astype(np.int32)
    if new[-1] + 1 < len(lms):
        names = np.empty(len(lms), np.int32)
        names[seq] = new
        order = lms[_sorted(names)]
    return _induce(text, small, order)


def permuted_common_prefixes(data: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """plcp[i]: common prefix of the suffix at i and the one before it in `order`, at most `most`; 0 for the first.

    Words of eight bytes are compared for all places that still agree. Places that `order` leaves out stay 0.
    """
    padded = np.r_[data, np.zeros(most + 8, np.uint8)]
    words = np.zeros(len(data) + most, np.uint64)
    for k in range(8):
        words |= padded[k : k + len(words)].astype(np.uint64) << np.uint64(8 * k)
    plcp = np.zeros(len(data), np.int64)
    here, before = order[1:], order[:-1]
    done = 0
    while len(here) and done < most:
        x = words[here + done] ^ words[before + done]
        low = x & (~x + np.uint64(1))
        same = np.where(x == 0, 8, np.log2(np.maximum(low, np.uint64(1)).astype(np.float64)).astype(np.int64) // 8)
        plcp[here] = np.minimum(done + same, most)
        go = x == 0
        here, before = here[go], before[go]
        done += 8
    return plcp
