"""Suffix arrays by induced sorting, with array operations over whole runs of buckets, and permuted common prefixes."""

from __future__ import annotations

import numpy as np


_ZERO = np.zeros(1, np.int64)
_PLACES = np.arange(1 << 16)


def rising(t: np.ndarray) -> np.ndarray:
    """Whether the suffix at each place is smaller than the one after it; the end of the text is the least character."""
    out = np.zeros(len(t), bool)
    steps = np.flatnonzero(t[:-1] != t[1:])
    if len(steps):
        out[: steps[-1] + 1] = np.repeat(t[steps] < t[steps + 1], np.diff(steps, prepend=-1))
    return out


def _stretches(t: np.ndarray, chosen: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Consecutive ranges of characters such that no chosen suffix begins in the range of its successor, unless both begin alike."""
    if size <= 256:
        return [(c, c) for c in np.flatnonzero(np.bincount(t, minlength=size)).tolist()]
    j = np.flatnonzero(chosen[:-1] & (t[:-1] > t[1:]))
    nearest = np.full(size, size)
    np.minimum.at(nearest, t[j + 1], t[j])
    nearest = np.minimum.accumulate(nearest[::-1])[::-1].tolist()
    found, c = [], 0
    while c < size:
        last = nearest[c] - 1
        found.append((c, last))
        c = last + 1
    return found


def _induce(t: np.ndarray, sa: np.ndarray, heads: np.ndarray, starts: np.ndarray, ends: np.ndarray, chosen: np.ndarray, stretches: list[tuple[int, int]]) -> None:
    """From the suffixes in `sa`, front to back, put the chosen predecessors at the heads of their buckets."""

    def put(j: np.ndarray, c: np.ndarray) -> None:
        if c[0] == c[-1] and (c == c[0]).all():
            at = heads[c[0]]
            sa[at : at + len(j)] = j
            heads[c[0]] += len(j)
            return
        order = c.argsort(kind="stable")
        c, j = c[order], j[order]
        first = np.concatenate([_ZERO, (c[1:] != c[:-1]).nonzero()[0] + 1])
        of = c[first]
        if len(first) == len(c):
            sa[heads[of]] = j
            heads[of] += 1
            return
        counts = np.empty_like(first)
        counts[:-1] = first[1:] - first[:-1]
        counts[-1] = len(c) - first[-1]
        sa[(heads[of] - first).repeat(counts) + _PLACES[: len(c)] if len(c) <= len(_PLACES) else (heads[of] - first).repeat(counts) + np.arange(len(c))] = j
        heads[of] += counts

    for low, high in stretches:
        a, b = starts[low], ends[high]
        if a == b:
            continue
        part = sa[a:b]
        sources = part[part > 0]
        if not len(sources):
            continue
        j = sources - 1
        j = j[chosen[j]]
        c = t[j]
        alike = c <= high  # the character that follows is the same
        if alike.any():
            same, of = j[alike], c[alike]
            while len(same):  # runs of one character: the predecessors of what was just put are the next to put
                put(same, of)
                same = same[same > 0] - 1
                same = same[chosen[same] & (t[same] == t[same + 1])]
                of = t[same]
            part = sa[a:b]
            j = part[part > 0] - 1
            j = j[chosen[j]]
            c = t[j]
            further = c > high
            j, c = j[further], c[further]
        if len(j):
            put(j, c)


class _Text:
    """What both inductions over a text share."""

    def __init__(self, t: np.ndarray, size: int, up: np.ndarray) -> None:
        self.mirrored = (size - 1 - t.astype(np.int32)).astype(t.dtype)
        self.forth, self.back = _stretches(t, ~up, size), _stretches(self.mirrored, up, size)


def _from_leftmost(t: np.ndarray, size: int, up: np.ndarray, leftmost: np.ndarray, known: _Text) -> np.ndarray:
    """All suffixes in order, induced from the leftmost-smaller ones in theirs."""
    n = len(t)
    counts = np.bincount(t, minlength=size)
    ends = np.cumsum(counts)
    starts = ends - counts
    sa = np.full(n, -1, np.int32)
    c = t[leftmost]
    own = np.bincount(c, minlength=size)
    places = np.repeat(ends - np.cumsum(own), own) + np.arange(len(c))
    sa[places] = leftmost
    heads = starts.copy()
    sa[heads[t[n - 1]]] = n - 1
    heads[t[n - 1]] += 1
    _induce(t, sa, heads, starts, ends, ~up, known.forth)
    sa[places] = -1
    _induce(known.mirrored, sa[::-1], (n - ends)[::-1].copy(), (n - ends)[::-1], (n - starts)[::-1], up, known.back)
    return sa


#: Names of names are few, in as many buckets: from this depth on ranks are doubled instead of induced.
DEEPEST = 2


def _by_doubling(t: np.ndarray) -> np.ndarray:
    """The suffixes of a short text in order: ranks of twice as long parts from ranks of their halves."""
    n = len(t)
    rank, step = t.astype(np.int64) + 1, 1
    while True:
        key = rank * (max(n, int(rank.max())) + 1)
        key[: n - step] += rank[step:] if step < n else 0
        order = key.argsort(kind="stable")
        new = np.ones(n, np.int64)
        new[1:] += np.cumsum(key[order[1:]] != key[order[:-1]])
        if new[-1] == n:
            return order.astype(np.int32)
        rank = np.empty(n, np.int64)
        rank[order] = new
        step *= 2


def suffix_array(t: np.ndarray, size: int, depth: int = 0) -> np.ndarray:
    """Starts of the suffixes of `t` (whole numbers below `size`) in lexicographic order."""
    n = len(t)
    if n < 2:
        return np.arange(n, dtype=np.int32)
    if depth >= DEEPEST:
        return _by_doubling(t)
    up = rising(t)
    is_leftmost = up.copy()
    is_leftmost[0] = False
    is_leftmost[1:] &= ~up[:-1]
    leftmost = np.flatnonzero(is_leftmost).astype(np.int32)
    known = _Text(t, size, up)
    rough = _from_leftmost(t, size, up, leftmost[np.argsort(t[leftmost], kind="stable")], known)
    if len(leftmost) < 2:
        return rough
    order = rough[is_leftmost[rough]]
    number = np.empty(n, np.int32)
    number[leftmost] = np.arange(len(leftmost), dtype=np.int32)
    lengths = np.diff(leftmost, append=leftmost[-1] - 1) + 1  # the last one ends with the text and is like no other: 0
    differs = lengths[number[order[1:]]] != lengths[number[order[:-1]]]
    left = np.flatnonzero(~differs)
    a, b, most = order[left], order[left + 1], lengths[number[order[left]]]
    d = 0
    while len(left):
        unlike = t[a + d] != t[b + d]
        differs[left[unlike]] = True
        d += 1
        still = ~unlike & (most > d)
        left, a, b, most = left[still], a[still], b[still], most[still]
    names = np.concatenate([[0], np.cumsum(differs)]).astype(np.int32)
    if names[-1] + 1 < len(order):
        reduced = np.empty(len(order), np.int32)
        reduced[number[order]] = names
        order = leftmost[suffix_array(reduced, int(names[-1]) + 1, depth + 1)]
    return _from_leftmost(t, size, up, order, known)


def permuted_prefixes(text: np.ndarray, sa: np.ndarray, begins: np.ndarray, cap: int) -> np.ndarray:
    """For each place, how many bytes its suffix shares with the one before it in `sa`, up to `cap`.

    Where the bytes before both suffixes agree, the number is one less than at the place before, so only the other places are
    compared. Places `begins` are compared too; between two of them lie fewer than `cap` places, which keeps capped numbers
    right up to the cap less that distance.
    """
    n = len(text)
    before = np.empty(n, np.int32)
    before[sa[1:]] = sa[:-1]
    before[sa[0]] = -1
    compared = np.ones(n, bool)
    compared[1:] = (before[1:] < 1) | (text[:-1] != text[before[1:] - 1])
    compared[begins] = True
    at = np.flatnonzero(compared & (before >= 0))
    padded = np.concatenate([text, np.zeros(cap + 16, np.uint8)])
    words = np.ndarray(len(padded) - 7, dtype="<u8", buffer=padded.data, strides=(1,))
    shared = np.zeros(n, np.int32)
    a, b, left, d = at, before[at], at, 0
    while len(left) and d < cap:
        unlike = words[a + d] ^ words[b + d]
        ended = unlike != 0
        bits = unlike[ended] & (~unlike[ended] + np.uint64(1))
        shared[left[ended]] = d + (np.log2(bits.astype(np.float64)) // 8).astype(np.int32)
        a, b, left = a[~ended], b[~ended], left[~ended]
        d += 8
    shared[left] = cap
    shared = np.minimum(shared, n - np.arange(n, dtype=np.int32))
    shared = np.minimum(shared, np.where(before >= 0, n - before, 0))
    last = np.maximum.accumulate(np.where(compared, np.arange(n, dtype=np.int32), 0))
    return np.maximum(np.minimum(shared[last], cap) - (np.arange(n, dtype=np.int32) - last), 0)
