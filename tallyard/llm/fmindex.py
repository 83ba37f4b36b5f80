"""A compressed full-text index for backward search, over strings of integer symbols.

The Burrows-Wheeler transform is held as the sorted numbers symbol * n + place, cut into their low 16 bits and a sampled
rank for each value of the bits above (about two bytes a symbol of text, where a plain array takes eight). One step of a
backward search is a rank for each end of the interval, done for many patterns at once. Beside it lies the suffix array,
four bytes a symbol, which tells where a match lies.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; distinct end marks keep it at log2(longest string) rounds."""
    n = len(text)
    _, rank = np.unique(text, return_inverse=True)
    rank = rank.ravel().astype(np.int64)
    k = 1
    while True:
        behind = np.zeros(n, np.int64)
        behind[: n - k] = rank[k:] + 1 if k < n else 0
        key = rank * (n + 1) + behind
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        rank = new
        if rank.max(initial=0) == n - 1 or k >= n:
            return order
        k *= 2


class FMIndex:
    """Index of strings; symbols are positive, and a symbol that is in no string may be asked for."""

    def __init__(self, symbols: np.ndarray, lengths: np.ndarray):
        """``symbols``: all strings, one after another; ``lengths``: of each string."""
        lengths = np.asarray(lengths, np.int64)
        m, size = len(lengths), len(symbols) + len(lengths)
        mark = np.cumsum(lengths) + np.arange(m)  # each string's own end mark sorts below all symbols
        body = np.ones(size, bool)
        body[mark] = False
        self.known, dense = np.unique(symbols, return_inverse=True)
        self.text = np.zeros(size, np.int32)  # symbols from 0 on, end marks below
        self.text[body] = dense.ravel()
        self.text[mark] = np.arange(-m, 0)
        self.starts, self.n = np.concatenate([[0], mark + 1])[:-1], size
        order = suffix_array(self.text.astype(np.int64) + m) if size else np.empty(0, np.int64)
        before = self.text[order - 1].astype(np.int64)
        self.sa = order.astype(np.uint32)
        place = np.flatnonzero(before >= 0)
        key = np.sort(before[place] * (size + 1) + place)
        self.low = (key & 0xFFFF).astype(np.uint16)
        top = len(self.known) * (size + 1) >> 16
        self.sampled = np.searchsorted(key >> 16, np.arange(top + 2)).astype(np.int64 if size >> 31 else np.int32)
        self.depth = int(np.diff(self.sampled).max(initial=0)).bit_length()
        self.first = m + np.searchsorted(key, np.arange(len(self.known) + 1) * (size + 1))  # suffixes that begin with a symbol

    def numbers(self, symbols: np.ndarray) -> np.ndarray:
        """The index's own numbers of symbols, -1 for one that is in no string."""
        if not len(self.known):
            return np.full(len(symbols), -1)
        at = np.minimum(np.searchsorted(self.known, symbols), len(self.known) - 1)
        return np.where(self.known[at] == symbols, at, -1)

    def _rank(self, key: np.ndarray) -> np.ndarray:
        """How many of the sorted numbers lie below ``key``."""
        high = key >> 16
        a, b = self.sampled[high], self.sampled[high + 1]
        low = (key & 0xFFFF).astype(np.uint16)
        for _ in range(self.depth):
            mid = (a + b) >> 1
            below = self.low[np.minimum(mid, len(self.low) - 1)] < low
            open_ = a < b
            a, b = np.where(open_ & below, mid + 1, a), np.where(open_ & ~below, mid, b)
        return a

    def step(self, number: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Put a symbol, by its number, before the pattern whose suffixes are [lo, hi)."""
        base, shift = number.astype(np.int64) * (self.n + 1), len(self.starts)
        return self._rank(base + lo) + shift, self._rank(base + hi) + shift

    def search(self, numbers: np.ndarray, ends: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(which, lo, hi) of the runs ``numbers[end - length : end]`` that occur: backward search of all of them at
        once, from their last symbol to their first."""
        if not len(self.known) or not len(ends):
            return (np.empty(0, np.int64),) * 3
        c = numbers[ends - 1]
        live = np.flatnonzero((c >= 0) & (lengths > 0))
        lo, hi = self.first[c[live]].astype(np.int64), self.first[c[live] + 1].astype(np.int64)
        back, done = 1, []
        while live.size:
            whole = lengths[live] == back
            done.append((live[whole], lo[whole], hi[whole]))
            live, lo, hi = live[~whole], lo[~whole], hi[~whole]
            back += 1
            c = numbers[ends[live] - back]
            ok = c >= 0
            live, c, lo, hi = live[ok], c[ok], lo[ok], hi[ok]
            lo, hi = self.step(c, lo, hi)
            ok = hi > lo
            live, lo, hi = live[ok], lo[ok], hi[ok]
        return tuple(np.concatenate(x) for x in zip(*done)) if done else (np.empty(0, np.int64),) * 3

    def places(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which interval, place in the text) of each suffix of the intervals."""
        n = hi - lo
        at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.repeat(np.arange(len(n)), n), self.sa[at].astype(np.int64)


def runs(pair: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Numbers that tell which of the spans, sorted by (pair, start), lie in one piece with those before."""
    first = np.ones(len(pair), bool)
    wide = int(end.max(initial=0)) + 1
    reach = np.maximum.accumulate(pair * wide + end) if len(pair) else end
    first[1:] = (pair[1:] != pair[:-1]) | (start[1:] > reach[:-1] - pair[1:] * wide)
    return np.cumsum(first) - 1


def covered(pair: np.ndarray, start: np.ndarray, end: np.ndarray, n_pairs: int) -> np.ndarray:
    """Symbols that the spans of each pair cover together."""
    order = np.lexsort((start, pair))
    pair, start, end = pair[order], start[order], end[order]
    piece = runs(pair, start, end)
    lo = np.unique(piece, return_index=True)[1]
    if not len(lo):
        return np.zeros(n_pairs, np.int64)
    return np.bincount(pair[lo], np.maximum.reduceat(end, lo) - start[lo], minlength=n_pairs).astype(np.int64)


def place_matches(index: FMIndex, patterns: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(pattern, string, maximal matches, symbols in them) of every pair with a maximal match of ``least`` symbols or
    more, for patterns and strings of one length whose symbols tell their place.

    Backward search gives the interval of each run of ``least`` symbols, and with it every string that has the run;
    runs of one pair that follow upon each other are merged into the maximal match that they lie in.
    """
    m, t = patterns.shape
    none = np.empty(0, np.int64)
    if not m or not index.n or t < least:
        return none, none, none, none
    width = t - least + 1
    ends = (np.arange(m)[:, None] * t + np.arange(least, t + 1)).ravel()
    which, lo, hi = index.search(index.numbers(patterns.ravel()), ends, np.full(len(ends), least))
    at, place = index.places(lo, hi)
    which = which[at]
    string = place // (t + 1)
    key = np.sort((which // width * len(index.starts) + string) * (width + 1) + which % width)
    pair, change = key // (width + 1), np.diff(key) != 1
    match = np.flatnonzero(np.concatenate([[True], change]) if len(key) else np.empty(0, bool))
    pairs, first = np.unique(pair[match], return_index=True)
    if not len(pairs):
        return none, none, none, none
    size = np.diff(np.append(match, len(key))) + least - 1
    return pairs // len(index.starts), pairs % len(index.starts), np.diff(np.append(first, len(match))), np.add.reduceat(size, first)


def text_matches(index: FMIndex, symbols: np.ndarray, lengths: np.ndarray, window: int, share: float) -> dict[str, np.ndarray]:
    """Pairs of a pattern and a string that maximal matches cover to ``share`` of the longer one:
    ``pattern, string, spans, matched, lo, hi``: number of merged spans, symbols in them, the first and last place in the
    pattern.

    Every maximal match of 2 ``window`` - 1 symbols is found: it holds one of the windows that a pattern is cut into
    (a pattern shorter than a window is one). Backward search gives a window's interval and all its occurrences; each is
    extended to its maximal match, and the matches of a pair are merged. Of several occurrences of a window in one string, the
    nearest to the same place counts, so long repetitions give one match and not their product.
    """
    names = ["pattern", "string", "spans", "matched", "lo", "hi"]
    empty = dict.fromkeys(names, np.empty(0, np.int64))
    lengths = np.asarray(lengths, np.int64)
    if not len(symbols) or not index.n:
        return empty
    begin = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    n_windows = -(-lengths // window)
    who = np.repeat(np.arange(len(lengths)), n_windows)
    tile = (np.arange(n_windows.sum()) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)) * window
    tile = np.maximum(0, np.minimum(tile, lengths[who] - window))  # the last window ends where the pattern ends
    numbers, size = index.numbers(symbols), np.minimum(window, lengths[who])
    which, lo, hi = index.search(numbers, begin[who] + tile + size, size)
    if not len(which):
        return empty
    # occurrences once for each different window, in order of place
    same, of = np.unique(lo * (index.n + 1) + hi, return_inverse=True)
    of = of.ravel()
    at, place = index.places(same // (index.n + 1), same % (index.n + 1))
    order = np.lexsort((place, at))
    at, place = at[order], place[order]
    string = np.searchsorted(index.starts, place, side="right") - 1
    doc = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 0) | (np.diff(string) != 0)]))  # first of each (window, string)
    doc_end = np.append(doc[1:], len(at))
    doc_from = np.searchsorted(at[doc], np.arange(len(same) + 1))
    n = np.diff(doc_from)[of]
    w = np.repeat(which, n)
    d = np.repeat(doc_from[of] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    held = np.diff(np.append(index.starts, index.n)) - 1
    s, p = string[doc[d]], who[w]
    ok = np.minimum(held[s], lengths[p]) >= share * np.maximum(held[s], lengths[p])  # else no match could cover enough
    w, d, s, p = w[ok], d[ok], s[ok], p[ok]
    if not len(w):
        return empty
    wanted = np.minimum(tile[w], held[s]) + index.starts[s]
    wide = index.n + 1
    near = np.searchsorted(at * wide + place, at[doc[d]] * wide + wanted)
    left, right = np.clip(near - 1, doc[d], doc_end[d] - 1), np.clip(near, doc[d], doc_end[d] - 1)
    hit = np.where(np.abs(place[left] - wanted) <= np.abs(place[right] - wanted), left, right)
    a, b = tile[w], place[hit] - index.starts[s]
    # windows of a pair on one diagonal that follow upon each other belong to one match
    pair, order = p * len(held) + s, None
    order = np.lexsort((a, b - a, pair))
    pair, a, b, end = pair[order], a[order], b[order], (a + size[w])[order]
    line = np.unique(np.stack([pair, b - a], 1), axis=0, return_inverse=True)[1].ravel()
    piece = np.unique(runs(line, a, end), return_index=True)[1]
    end = np.maximum.reduceat(end, piece)
    pair, a, b = pair[piece], a[piece], b[piece]
    p, s = pair // len(held), pair % len(held)
    for back in (True, False):  # to both sides, as far as the symbols agree
        live = np.arange(len(pair))
        while live.size:
            x = a[live] - 1 if back else end[live]
            y = x + b[live] - a[live]
            ok = (x >= 0) & (y >= 0) & (x < lengths[p[live]]) & (y < held[s[live]])
            live, x, y = live[ok], x[ok], y[ok]
            live = live[numbers[begin[p[live]] + x] == index.text[index.starts[s[live]] + y]]
            if back:
                a[live] -= 1
                b[live] -= 1
            else:
                end[live] += 1
    pairs, i = np.unique(pair, return_inverse=True)
    i = i.ravel()
    matched = np.minimum(covered(i, a, end, len(pairs)), covered(i, b, b + end - a, len(pairs)))
    order = np.lexsort((a, i))
    merged = np.unique(np.stack([i[order], runs(i[order], a[order], end[order])], 1), axis=0)
    p, s = pairs // len(held), pairs % len(held)
    lo, hi = np.full(len(pairs), np.iinfo(np.int64).max), np.zeros(len(pairs), np.int64)
    np.minimum.at(lo, i, a)
    np.maximum.at(hi, i, end)
    ok = matched >= share * np.maximum(lengths[p], held[s])
    return dict(zip(names, (p[ok], s[ok], np.bincount(merged[:, 0], minlength=len(pairs))[ok], matched[ok], lo[ok], hi[ok])))
