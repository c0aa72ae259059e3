"""Suffix arrays by induced sorting, and permuted common prefixes, on numpy arrays.

The text ends with a sentinel 0 that occurs nowhere else.  A bucket (all suffixes of one first
symbol) is induced as a whole: its entries push the suffixes before them to the ends of their
buckets, keeping order.  Only entries that stay in the bucket need another turn.
"""

from __future__ import annotations

import numpy as np

# larger alphabets (names of substrings in the recursion) are induced entry by entry
SMALL_ALPHABET = 1024


def suffix_array(text: np.ndarray, symbols: int) -> np.ndarray:
    """Start positions of all suffixes in order; ``text`` holds 0..symbols-1 and ends with its only 0."""
    n = len(text)
    if n == 1:
        return np.zeros(1, dtype=np.int64)
    smaller = suffix_types(text)
    leftmost = np.flatnonzero(smaller & np.concatenate([[False], ~smaller[:-1]]))
    # sort leftmost-smaller substrings: any order of equal first symbols will do to begin with
    order = induce(text, smaller, symbols, leftmost)
    is_leftmost = np.zeros(n, dtype=bool)
    is_leftmost[leftmost] = True
    by_substring = order[is_leftmost[order]]
    names, count = name_substrings(text, leftmost, by_substring)
    if count < len(leftmost):
        reduced = names[leftmost]
        by_suffix = leftmost[suffix_array(reduced, count)]
    else:
        by_suffix = by_substring
    return induce(text, smaller, symbols, by_suffix)


def suffix_types(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the one after it (the sentinel counts as smaller)."""
    n = len(text)
    differs = np.append(text[:-1] != text[1:], True)
    at = np.where(differs, np.arange(n), n - 1)
    last = np.minimum.accumulate(at[::-1])[::-1]  # end of the run of equal symbols
    following = text[np.minimum(last + 1, n - 1)]
    smaller = text < following
    smaller[last == n - 1] = True
    return smaller


def name_substrings(text: np.ndarray, leftmost: np.ndarray, by_substring: np.ndarray) -> tuple[np.ndarray, int]:
    """Numbers of the leftmost-smaller substrings in order, equal ones alike; by text position."""
    ends = np.append(leftmost[1:], len(text) - 1)
    size = np.zeros(len(text), dtype=np.int64)
    size[leftmost] = ends - leftmost + 1
    a, b = by_substring[:-1], by_substring[1:]
    same = size[a] == size[b]
    live = np.flatnonzero(same)
    k = 0
    while len(live):
        equal = text[a[live] + k] == text[b[live] + k]
        same[live[~equal]] = False
        k += 1
        live = live[equal & (size[a[live]] > k)]
    name = np.concatenate([[0], np.cumsum(~same)])
    names = np.zeros(len(text), dtype=np.int64)
    names[by_substring] = name
    return names, int(name[-1]) + 1


def induce(text: np.ndarray, smaller: np.ndarray, symbols: int, leftmost: np.ndarray) -> np.ndarray:
    """All suffixes from the sorted (or, at first, unsorted) leftmost-smaller ones."""
    counts = np.bincount(text, minlength=symbols)
    ends = np.cumsum(counts)
    if symbols > SMALL_ALPHABET:
        return _induce_entries(text, smaller, counts, ends, leftmost)
    starts = ends - counts
    order = np.full(len(text), -1, dtype=np.int64)
    by = np.argsort(text[leftmost], kind="stable")
    seeds = leftmost[by]
    seed_counts = np.bincount(text[leftmost], minlength=symbols)
    seed_ends = np.cumsum(seed_counts)
    heads = starts.copy()
    for c in range(symbols):
        now = order[starts[c] : heads[c]]
        while len(now):  # larger ones, as far as they stay in this bucket
            before = now[now > 0] - 1
            before = before[~smaller[before]]
            at = heads[c]
            _append(order, heads, text, before)
            now = order[at : heads[c]]
        before = seeds[seed_ends[c] - seed_counts[c] : seed_ends[c]]
        before = before[before > 0] - 1
        _append(order, heads, text, before[~smaller[before]])
    tails = ends.copy()
    for c in range(symbols - 1, -1, -1):
        now = order[tails[c] : ends[c]][::-1]
        while len(now):
            before = now[now > 0] - 1
            before = before[smaller[before]]
            at = tails[c]
            _prepend(order, tails, text, before)
            now = order[tails[c] : at][::-1]
        before = order[starts[c] : heads[c]][::-1]
        before = before[before > 0] - 1
        _prepend(order, tails, text, before[smaller[before]])
    order[0] = len(text) - 1
    return order


def _append(order: np.ndarray, heads: np.ndarray, text: np.ndarray, found: np.ndarray) -> None:
    if not len(found):
        return
    symbol = text[found]
    by = np.argsort(symbol, kind="stable")
    symbol, found = symbol[by], found[by]
    first = np.searchsorted(symbol, symbol, side="left")
    order[heads[symbol] + np.arange(len(found)) - first] = found
    heads += np.bincount(symbol, minlength=len(heads))


def _prepend(order: np.ndarray, tails: np.ndarray, text: np.ndarray, found: np.ndarray) -> None:
    if not len(found):
        return
    symbol = text[found]
    by = np.argsort(symbol, kind="stable")
    symbol, found = symbol[by], found[by]
    first = np.searchsorted(symbol, symbol, side="left")
    order[tails[symbol] - 1 - (np.arange(len(found)) - first)] = found
    tails -= np.bincount(symbol, minlength=len(tails))


def _induce_entries(text: np.ndarray, smaller: np.ndarray, counts: np.ndarray, ends: np.ndarray, leftmost: np.ndarray) -> np.ndarray:
    """The same step one entry at a time, for alphabets with few suffixes per symbol."""
    n = len(text)
    t, s = text.tolist(), smaller.tolist()
    order = [-1] * n
    tail = ends.tolist()
    for i in leftmost[::-1].tolist():
        tail[t[i]] -= 1
        order[tail[t[i]]] = i
    head = (ends - counts).tolist()
    for i in order:  # the list grows ahead of the loop
        j = i - 1
        if j >= 0 and not s[j]:
            c = t[j]
            order[head[c]] = j
            head[c] += 1
    tail = ends.tolist()
    for r in range(n - 1, -1, -1):
        j = order[r] - 1
        if j >= 0 and s[j]:
            c = t[j]
            tail[c] -= 1
            order[tail[c]] = j
    order[0] = n - 1
    return np.array(order, dtype=np.int64)


def common_prefixes(data: np.ndarray, order: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Permuted common prefixes: for each position the one before it in order, and how long they agree.

    ``room`` is how far each position may be read (0: not at all), so prefixes never leave their
    piece.  Where the symbols before both positions agree too, the prefix is one shorter than that
    of the position before; only the others are compared, eight bytes at a time.
    """
    n = len(data)
    before = np.full(n, -1, dtype=np.int64)
    before[order[1:]] = order[:-1]
    here = np.arange(n)
    prior = np.maximum(before, 0)
    carried = (before > 0) & (here > 0) & (room[here - 1] > 0) & (room[prior - 1] > 0) & (data[here - 1] == data[prior - 1])
    lead = np.flatnonzero(~carried & (before >= 0))
    limit = np.minimum(room[lead], room[prior[lead]])
    padded = np.concatenate([data.astype(np.uint8), np.zeros(8, dtype=np.uint8)])
    eight = np.zeros(n, dtype=np.uint64)
    for k in range(8):
        eight |= padded[k : k + n].astype(np.uint64) << np.uint64(8 * k)
    size = np.zeros(len(lead), dtype=np.int64)
    live = np.flatnonzero(limit > 0)
    while len(live):
        a, b = lead[live] + size[live], prior[lead[live]] + size[live]
        differ = eight[a] ^ eight[b]
        low = differ & (~differ + np.uint64(1))  # lowest differing bit
        same = np.where(differ == 0, 8, np.bitwise_count(low - np.uint64(1)) >> 3).astype(np.int64)
        size[live] += same
        live = live[(same == 8) & (size[live] < limit[live])]
    found = np.zeros(n, dtype=np.int64)
    found[lead] = np.minimum(size, limit)
    source = np.maximum.accumulate(np.where(carried, 0, here))
    return before, np.where(before < 0, 0, np.maximum(found[source] - (here - source), 0))
