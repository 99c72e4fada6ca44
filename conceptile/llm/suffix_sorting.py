"""Suffix arrays by induced sorting, and permuted common prefixes, over numpy arrays.

The scans that induce one type of suffix from the other read the array in order, each place once. With few symbols, as bytes, they run
in blocks: a block ends before the first place that it fills itself, so that all it reads is final.
"""

from __future__ import annotations

import numpy as np

LEAST_BLOCK, MOST_BLOCK, FEW = 64, 1 << 16, 64


def rising(text: np.ndarray) -> np.ndarray:
    """Whether a suffix is smaller than the next one (type S); the last is larger than the empty one (type L)."""
    n = len(text)
    s = np.zeros(n, dtype=bool)
    differs = np.flatnonzero(text[:-1] != text[1:])
    if len(differs):
        up = text[differs] < text[differs + 1]
        lengths = np.diff(np.append(-1, differs))
        s[: differs[-1] + 1] = np.repeat(up, lengths)
    return s


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal values begin, and how long they are."""
    first = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, dtype=np.int64)
    return first, np.diff(np.append(first, len(values)))


def scanned(text: np.ndarray, s: np.ndarray, starts: np.ndarray, ends: np.ndarray, sa: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The two scans of ``induced``, place by place: the faster way where symbols are many and each has few suffixes."""
    n, symbol, small, out, head, tail = len(text), text.tolist(), s.tolist(), sa.tolist(), starts.tolist(), ends.tolist()
    out[head[symbol[-1]]] = n - 1
    head[symbol[-1]] += 1
    for i in range(n):
        j = out[i] - 1
        if j >= 0 and not small[j]:
            c = symbol[j]
            out[head[c]] = j
            head[c] += 1
    for i in own.tolist():
        out[i] = -1
    for i in range(n - 1, -1, -1):
        j = out[i] - 1
        if j >= 0 and small[j]:
            c = symbol[j]
            tail[c] -= 1
            out[tail[c]] = j
    return np.array(out, dtype=np.int32)


def induced(text: np.ndarray, s: np.ndarray, starts: np.ndarray, ends: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """The array that sorted leftmost-smaller suffixes induce; they come in an order that is right by first symbols at least."""
    n = len(text)
    sa = np.full(n, -1, dtype=np.int32)
    c = text[lms]
    first, many = runs(c)
    own = np.repeat(ends[c[first]] - many - first, many) + np.arange(len(lms)) if len(lms) else first
    sa[own] = lms
    if n < FEW * len(starts):
        return scanned(text, s, starts, ends, sa, own)
    falling = ~s
    head = starts.copy()  # larger suffixes, from the left
    sa[head[text[-1]]] = n - 1
    head[text[-1]] += 1
    i, m = 0, LEAST_BLOCK
    while i < n:
        block = sa[i : i + m]
        at = np.flatnonzero(block > 0)
        j = block[at] - 1
        some = falling[j]
        at, j = at[some], j[some]
        step = len(block)
        if len(j):
            order = np.argsort(text[j], kind="stable")
            c = text[j[order]]
            first, many = runs(c)
            place = head[c] + np.arange(len(c)) - np.repeat(first, many)
            low = place.min() - i
            if low < step:
                step = int(low)
                some = at[order] < step
                order, place, c = order[some], place[some], c[some]
                first, many = runs(c)
            sa[place] = j[order]
            head[c[first]] += many
        i += step
        m = min(MOST_BLOCK, max(LEAST_BLOCK, 2 * step))
    sa[own] = -1
    tail = ends.copy()  # smaller ones, from the right
    i, m = n, LEAST_BLOCK
    while i > 0:
        block = sa[max(0, i - m) : i][::-1]
        at = np.flatnonzero(block > 0)
        j = block[at] - 1
        some = s[j]
        at, j = at[some], j[some]
        step = len(block)
        if len(j):
            order = np.argsort(text[j], kind="stable")
            c = text[j[order]]
            first, many = runs(c)
            place = tail[c] - 1 - np.arange(len(c)) + np.repeat(first, many)
            low = i - 1 - place.max()
            if low < step:
                step = int(low)
                some = at[order] < step
                order, place, c = order[some], place[some], c[some]
                first, many = runs(c)
            sa[place] = j[order]
            tail[c[first]] -= many
        i -= step
        m = min(MOST_BLOCK, max(LEAST_BLOCK, 2 * step))
    return sa


def named(text: np.ndarray, ordered: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Numbers for the sorted leftmost-smaller substrings, equal for equal ones. ``length`` is how far each reaches, itself included."""
    a, b, size = ordered[:-1], ordered[1:], length[1:]
    differs = length[:-1] != size
    alive, t = np.flatnonzero(~differs), 0
    while len(alive):
        x = text[a[alive] + t] != text[b[alive] + t]
        differs[alive[x]] = True
        t += 1
        alive = alive[~x & (size[alive] > t)]
    return np.append(0, np.cumsum(differs))


def suffix_array(text: np.ndarray, symbols: int) -> np.ndarray:
    """The suffixes of a text of symbols 0 to ``symbols`` - 1 in order; a suffix that is a prefix of another comes first."""
    n = len(text)
    if n < 2:
        return np.arange(n, dtype=np.int32)
    s = rising(text)
    ends = np.cumsum(np.bincount(text, minlength=symbols))
    starts = np.append(0, ends[:-1])
    lms = np.flatnonzero(s[1:] & ~s[:-1]) + 1
    sa = induced(text, s, starts, ends, lms[np.argsort(text[lms], kind="stable")])
    if len(lms) < 2:
        return sa
    rank = np.full(n, -1, dtype=np.int32)
    rank[lms] = np.arange(len(lms))
    ordered = sa[rank[sa] >= 0]
    reach = np.append(np.diff(lms) + 1, 0)  # the last one ends with the text, as no other does
    names = named(text, ordered, reach[rank[ordered]])
    if names[-1] + 1 < len(lms):
        reduced = np.empty(len(lms), dtype=np.int32)
        reduced[rank[ordered]] = names
        ordered = lms[suffix_array(reduced, int(names[-1]) + 1)]
    return induced(text, s, starts, ends, ordered)


def common_prefixes(text: np.ndarray, sa: np.ndarray, bits: int = 9) -> np.ndarray:
    """By place in the text: how many symbols the suffix there shares with the one before it in the array.

    Only where the symbol before differs from the other's (irreducible places) are symbols compared, some at a time; everywhere
    else a prefix is the one of the place before without its first symbol."""
    n, wide = len(text), 63 // bits
    before = np.full(n, -1, dtype=np.int64)
    before[sa[1:]] = sa[:-1]
    padded = np.concatenate([text.astype(np.int64) + 1, np.zeros(wide, dtype=np.int64)])  # 0 is beyond the end
    packed = np.zeros(n + 1, dtype=np.int64)
    for d in range(wide):
        packed = packed << bits | padded[d : d + n + 1]
    place = np.arange(n)
    same = (place > 0) & (before > 0)
    same[same] = text[place[same] - 1] == text[before[same] - 1]
    hard = np.flatnonzero(~same)
    out = np.zeros(n, dtype=np.int64)
    alive, t = hard[before[hard] >= 0], 0
    while len(alive):
        a, b = alive + t, before[alive] + t
        inside = np.maximum(a, b) <= n
        x = packed[np.minimum(a, n)] ^ packed[np.minimum(b, n)]
        x[~inside] = -1
        ended = x != 0
        y, few = x[ended], np.full(ended.sum(), t)
        for k in range(wide):
            few += (y >= 0) & (y >> (bits * k) == 0)
        out[alive[ended]] = few
        alive, t = alive[~ended], t + wide
    reach = np.zeros(n, dtype=np.int64)
    reach[hard] = out[hard] + hard
    last = np.zeros(n, dtype=np.int64)
    last[hard] = hard
    return np.maximum(reach[np.maximum.accumulate(last)] - place, 0)
