"""Suffix arrays of byte segments by induced sorting, and permuted common prefixes, in numpy.

A text is a row of segments, each closed by a separator. Separators are below
every byte and differ from each other (the earlier is the smaller), so no common
prefix runs past a segment's end. Symbols are 0 for a separator and 1 + byte.

The steps are those of induced sorting: every suffix is of the smaller or the
larger kind (S: below its right neighbour, L: above it); the leftmost-smaller
ones (an S after an L) cut the text into substrings, which are sorted and named;
the string of names gives the order of the leftmost-smaller suffixes, and two
passes over the symbols' buckets induce all others from it, first L, then S. The
string of names has an alphabet as large as itself, over which passes by bucket
can't be done as array operations; its suffixes are therefore ordered by
doubling, on those that aren't told apart yet. Prefixes are short, as segments are.
"""

from __future__ import annotations

import numpy as np

_PACK = 6        # symbols of 9 bits and a kind bit in one 64-bit key
_SYMBOLS = 257


def join_segments(segments: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all segments, and where each begins."""
    lengths = np.array([len(s) for s in segments], np.int64)
    data = np.frombuffer(b"\0".join(segments) + b"\0", np.uint8)
    starts = np.concatenate(([0], np.cumsum(lengths + 1)))[:-1]
    symbols = data.astype(np.int16) + 1
    symbols[starts + lengths] = 0
    return symbols, starts


def smaller_kind(t: np.ndarray) -> np.ndarray:
    """True for suffixes below their right neighbour; separators are."""
    n = len(t)
    change = np.flatnonzero(t[:-1] != t[1:])  # last place of each run of equal symbols but the last
    # within a run, all suffixes compare as the one at its end does
    ends = np.append(change, n - 1)
    run_kind = np.append(t[change] < t[change + 1], True)
    kind = np.repeat(run_kind, np.diff(np.concatenate(([-1], ends))))
    return kind | (t == 0)


def _ranks(order: np.ndarray, differs: np.ndarray) -> np.ndarray:
    """For sorted items, the number of items before the first of their equals, by item."""
    out = np.empty(len(order), np.int64)
    place = np.arange(len(order))
    out[order] = np.maximum.accumulate(np.where(differs, place, 0))
    return out


def _names(t: np.ndarray, kind: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """Ranks of the leftmost-smaller substrings, both end symbols included; separators are unique."""
    length = np.append(np.diff(lms), 0) + 1
    code = (t.astype(np.uint64) << np.uint64(1)) | kind.astype(np.uint64)
    code = np.concatenate((code, np.zeros(_PACK, np.uint64)))
    m = len(lms)

    def chunk(which: np.ndarray, k: int) -> np.ndarray:
        key = np.zeros(len(which), np.uint64)
        for i in range(k * _PACK, (k + 1) * _PACK):
            inside = i < length[which]
            key = (key << np.uint64(10)) | np.where(inside, code[np.where(inside, lms[which] + i, 0)], np.uint64(0))
        return key

    everything = np.arange(m)
    first = chunk(everything, 0)
    separator = t[lms] == 0
    order = np.argsort(first)
    key = first[order]
    rank = _ranks(order, np.append(True, key[1:] != key[:-1]))
    rank[separator] = np.arange(int(separator.sum()))
    k = 1
    open_ = np.flatnonzero((length > _PACK) & ~separator)
    while len(open_):
        # of those that are equal so far, tell longer ones apart by their next symbols
        key = chunk(open_, k)
        rank[open_] = _refined(rank[open_], np.unique(key, return_inverse=True)[1])
        k += 1
        open_ = open_[length[open_] > k * _PACK]
    return rank


def _refined(rank: np.ndarray, key: np.ndarray) -> np.ndarray:
    """New ranks of items by (rank, key), both below 2^31: the items of one rank fan out from it."""
    both = (rank << 32) | key
    order = np.argsort(both)
    both = both[order]
    r = both >> 32
    place = np.arange(len(order))
    group = np.maximum.accumulate(np.where(np.append(True, r[1:] != r[:-1]), place, 0))
    part = np.maximum.accumulate(np.where(np.append(True, both[1:] != both[:-1]), place, 0))
    out = np.empty(len(order), np.int64)
    out[order] = r + (part - group)
    return out


def _order_names(rank: np.ndarray) -> np.ndarray:
    """Suffixes of the string of names, sorted. Its last name is unique, as a separator's."""
    m, step = len(rank), 1
    count = np.bincount(rank, minlength=m)
    open_ = np.flatnonzero(count[rank] > 1)
    while len(open_):
        # all keys are read before any rank moves
        rank[open_] = _refined(rank[open_], rank[open_ + step])
        count = np.bincount(rank[open_], minlength=m)
        open_ = open_[count[rank[open_]] > 1]
        step *= 2
    out = np.empty(m, np.int64)
    out[rank] = np.arange(m)
    return out


def _push(lists: list[list[np.ndarray]], symbols: np.ndarray, places: np.ndarray) -> None:
    order = np.argsort(symbols, kind="stable")
    symbols, places = symbols[order], places[order]
    cuts = np.flatnonzero(np.append(True, symbols[1:] != symbols[:-1])) if len(symbols) else []
    for a, b in zip(cuts, [*cuts[1:], len(symbols)]):
        lists[symbols[a]].append(places[a:b])


def _run(first: np.ndarray, c: int, t: np.ndarray, kind: np.ndarray, smaller: bool) -> np.ndarray:
    """`first`, and what it induces in its own bucket, step by step to the left."""
    out, front = [first], first
    while len(front):
        front = front[front > 0] - 1
        front = front[(t[front] == c) & (kind[front] == smaller)]
        if len(front):
            out.append(front)
    return np.concatenate(out)


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Places of all suffixes in ascending order; `t` ends with a separator."""
    n = len(t)
    kind = smaller_kind(t)
    lms = np.flatnonzero(kind & ~np.append(True, kind[:-1]))
    if t[0] == 0 and n:
        lms = np.append(0, lms)  # an empty first segment
    empty = np.flatnonzero((t[1:] == 0) & (t[:-1] == 0)) + 1  # separators of empty segments count as well
    if len(empty):
        lms = np.union1d(lms, empty)
    ordered = lms[_order_names(_names(t, kind, lms))]
    separators = np.flatnonzero(t == 0)
    none = np.zeros(0, np.int64)

    starts: list[list[np.ndarray]] = [[] for _ in range(_SYMBOLS)]
    _push(starts, t[ordered], ordered)
    larger: list[list[np.ndarray]] = [[] for _ in range(_SYMBOLS)]
    done_larger: list[np.ndarray] = [none] * _SYMBOLS
    for c in range(_SYMBOLS):
        if not larger[c] and not starts[c]:
            continue
        own = _run(np.concatenate(larger[c]) if larger[c] else none, c, t, kind, False)
        done_larger[c] = own
        every = np.concatenate([own, *starts[c]]) if c else separators
        before = every[every > 0] - 1
        before = before[~kind[before] & (t[before] > c)]
        _push(larger, t[before], before)

    smaller: list[list[np.ndarray]] = [[] for _ in range(_SYMBOLS)]
    done_smaller: list[np.ndarray] = [none] * _SYMBOLS
    for c in range(_SYMBOLS - 1, 0, -1):
        own = _run(np.concatenate(smaller[c]) if smaller[c] else none, c, t, kind, True)
        done_smaller[c] = own[::-1]
        every = np.concatenate([own, done_larger[c][::-1]])
        before = every[every > 0] - 1
        before = before[kind[before] & (t[before] < c)]
        _push(smaller, t[before], before)
    parts = [separators]
    for c in range(1, _SYMBOLS):
        parts += [done_larger[c], done_smaller[c]]
    return np.concatenate(parts)


def permuted_lcp(t: np.ndarray, sa: np.ndarray, remaining: np.ndarray) -> np.ndarray:
    """For each place, the common prefix of its suffix with the one before it in order.

    Only irreducible values are compared symbol by symbol, those whose suffix is
    preceded by another symbol than its neighbour in order is; any other value is
    one less than that of the place to its left. `remaining`: symbols from each
    place to its separator.
    """
    n = len(t)
    phi = np.empty(n, np.int64)
    phi[sa[0]] = -1
    phi[sa[1:]] = sa[:-1]
    left = np.append(np.int16(-1), t[:-1])
    irreducible = (phi < 0) | (left <= 0) | (left != left[np.maximum(phi, 0)])
    places = np.flatnonzero(irreducible & (phi >= 0))
    raw = np.concatenate(((t - 1).astype(np.uint8), np.zeros(16, np.uint8))).astype(np.uint64)
    for shift in (1, 2, 4):  # eight bytes from each place on, lowest first
        raw = raw[:len(raw) - shift] | (raw[shift:] << np.uint64(8 * shift))
    most = np.minimum(remaining[places], remaining[phi[places]])
    found = np.zeros(len(places), np.int64)
    open_ = np.flatnonzero(most > 0)
    while len(open_):
        at = found[open_]
        differ = raw[places[open_] + at] ^ raw[phi[places[open_]] + at]
        low = differ & (~differ + np.uint64(1))
        same = np.where(differ == 0, 8, np.log2(np.maximum(low, np.uint64(1)).astype(np.float64)).astype(np.int64) >> 3)
        found[open_] = at + same
        open_ = open_[(differ == 0) & (found[open_] < most[open_])]
    value = np.zeros(n, np.int64)
    value[places] = np.minimum(found, most)
    place = np.arange(n)
    last = np.maximum.accumulate(np.where(irreducible, place, 0))
    return value[last] - (place - last)


def repeated_starts(segments: list[bytes], key: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Segment and offset of every start of `length` bytes that equal those of a start with a smaller key.

    The key of a start is its segment's `key` plus its offset; starts with equal
    keys are one and the same place, met in two segments.
    """
    t, starts = join_segments(segments)
    owner = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(t))))
    offset = np.arange(len(t)) - starts[owner]
    remaining = np.diff(np.append(starts, len(t)))[owner] - 1 - offset
    sa = suffix_array(t)
    common = permuted_lcp(t, sa, remaining)[sa] >= length
    run = np.cumsum(~common) - 1
    global_key = (key[owner] + offset)[sa]
    least = np.minimum.reduceat(global_key, np.flatnonzero(~common))
    repeated = np.sort(sa[(remaining[sa] >= length) & (global_key > least[run])])
    return owner[repeated], offset[repeated]
