"""Suffix arrays by induced sorting, and their permuted common prefixes, for one shard of bytes.

Suffixes are classified as smaller or larger than their right neighbour. The leftmost smaller ones are sorted by their
substrings, by an induced pass, then named; where names repeat, the string of names is sorted in the same way. Their order
induces the whole array in two linear scans. A scan goes bucket by bucket: what a bucket induces into itself is taken in rounds,
so all work of a bucket is done on whole arrays. Strings of names have buckets of a few entries each; they are scanned entry by
entry.
"""

from __future__ import annotations

import numpy as np

#: Alphabets up to this size are scanned bucket by bucket.
WIDE = 512


def _types(s: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than its right neighbour; the last one, larger than nothing, is the sentinel's."""
    n = len(s)
    smaller = np.zeros(n, dtype=bool)
    if n == 1:
        smaller[0] = True
        return smaller
    change = np.flatnonzero(s[1:] != s[:-1])  # the last position of each run of equal characters but the final one
    rises = s[change + 1] > s[change]
    starts = np.concatenate(([0], change + 1))
    lengths = np.diff(np.append(starts, n))
    smaller[:] = np.repeat(np.append(rises, False), lengths)
    smaller[-1] = True  # the sentinel
    return smaller


def _induce_wide(s: np.ndarray, smaller: np.ndarray, seeds: np.ndarray, k: int) -> np.ndarray:
    """The array that ``seeds``, leftmost smaller suffixes in order, induce; alphabet 0..k-1."""
    n = len(s)
    count = np.bincount(s, minlength=k)
    ends = np.cumsum(count)
    starts = ends - count
    sa = np.full(n, -1, dtype=np.int64)
    own = np.bincount(s[seeds], minlength=k)
    stops = np.cumsum(own)

    def place(at: np.ndarray, head: np.ndarray, forward: bool) -> None:
        """Appends suffixes to their buckets, in order, at the heads (or, backwards, before the tails)."""
        letters = s[at].astype(np.uint16)
        order = np.argsort(letters, kind="stable")
        letters, at = letters[order], at[order]
        each = np.bincount(letters, minlength=k)
        rank = np.arange(len(at)) - (np.cumsum(each) - each)[letters]
        if forward:
            sa[head[letters] + rank] = at
            head += each
        else:
            sa[head[letters] - 1 - rank] = at
            head -= each

    head = starts.copy()
    for c in range(k):
        if not count[c]:
            continue
        done = starts[c]
        while True:  # what this bucket induces into itself is scanned in further rounds
            now = sa[done : head[c]]
            done = head[c]
            before = now[now > 0] - 1
            before = before[~smaller[before]]
            if not len(before):
                break
            place(before, head, True)
        first = seeds[stops[c] - own[c] : stops[c]]
        before = first[first > 0] - 1
        if len(before):
            place(before, head, True)
    tail = ends.copy()
    larger_ends = head  # larger suffixes fill the front of each bucket
    for c in range(k - 1, -1, -1):
        if not count[c]:
            continue
        done = ends[c]
        while True:
            now = sa[tail[c] : done][::-1]
            done = tail[c]
            before = now[now > 0] - 1
            before = before[smaller[before]]
            if not len(before):
                break
            place(before, tail, False)
        now = sa[starts[c] : larger_ends[c]][::-1]
        before = now[now > 0] - 1
        before = before[smaller[before]]
        if len(before):
            place(before, tail, False)
    sa[0] = n - 1  # the sentinel, which nothing induces
    return sa


def _induce_narrow(s: np.ndarray, smaller: np.ndarray, seeds: np.ndarray, k: int) -> np.ndarray:
    """The same, entry by entry, for alphabets that are large against the string."""
    n = len(s)
    count = np.bincount(s, minlength=k)
    ends = np.cumsum(count)
    letters = s[seeds]
    own = np.bincount(letters, minlength=k)
    seeded = np.full(n, n, dtype=np.int64)  # n: not there yet
    seeded[(ends - own)[letters] + np.arange(len(seeds)) - (np.cumsum(own) - own)[letters]] = seeds
    # what each suffix induces: the bucket of the one before it, if that one is of the scan's kind
    larger, lower = np.full(n + 1, -1, dtype=np.int64), np.full(n + 1, -1, dtype=np.int64)
    larger[1:n] = np.where(smaller[:-1], -1, s[:-1])
    lower[1:n] = np.where(smaller[:-1], s[:-1], -1)
    sa, bucket, head = seeded.tolist(), larger.tolist(), (ends - count).tolist()
    for at in sa:  # a list is read on while it is filled
        c = bucket[at]
        if c >= 0:
            sa[head[c]] = at - 1
            head[c] += 1
    bucket, tail = lower.tolist(), ends.tolist()
    for at in reversed(sa):
        c = bucket[at]
        if c >= 0:
            tail[c] -= 1
            sa[tail[c]] = at - 1
    sa[0] = n - 1
    return np.array(sa, dtype=np.int64)


def _named(s: np.ndarray, leftmost: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """A number for each leftmost smaller substring, in text order, equal for equal substrings; ``ordered``: sorted by them."""
    ends = np.append(leftmost[1:], leftmost[-1])  # a substring reaches to the next one's first character
    length = np.zeros(len(s), dtype=np.int64)
    length[leftmost] = ends - leftmost
    a, b = ordered[:-1], ordered[1:]
    same = length[a] == length[b]
    left = np.flatnonzero(same)
    k = 0
    while len(left):
        inside = length[a[left]] >= k
        left = left[inside]
        if not len(left):
            break
        differs = s[a[left] + k] != s[b[left] + k]
        same[left[differs]] = False
        left = left[~differs]
        k += 1
    names = np.concatenate(([0], np.cumsum(~same)))
    out = np.zeros(len(s), dtype=np.int64)
    out[ordered] = names
    return out[leftmost]


def suffix_array(s: np.ndarray, k: int) -> np.ndarray:
    """The suffixes of ``s`` in order; its last character is 0 and stands nowhere else, the others are in 1..k-1."""
    n = len(s)
    if n == 1:
        return np.zeros(1, dtype=np.int64)
    smaller = _types(s)
    leftmost = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    induce = _induce_wide if k <= WIDE else _induce_narrow
    # any order within a bucket sorts the substrings; the induced pass puts them in the order of their characters
    seeds = leftmost[np.argsort(s[leftmost], kind="stable")]
    sa = induce(s, smaller, seeds, k)
    is_left = np.zeros(n, dtype=bool)
    is_left[leftmost] = True
    ordered = sa[is_left[sa]]
    names = _named(s, leftmost, ordered)
    if names.max() + 1 < len(leftmost):
        ordered = leftmost[suffix_array(names, int(names.max()) + 1)]
    return induce(s, smaller, ordered, k)


def permuted_prefixes(
    s: np.ndarray, sa: np.ndarray, starts: np.ndarray, stops: np.ndarray, asked: np.ndarray | None = None, enough: int | None = None
) -> np.ndarray:
    """For every position, how much its suffix shares with the one before it in ``sa``, up to the end of either's segment.

    The segments start and stop at the given positions. Going through a segment, a position shares at least one less than the
    position before it did; all segments go in step. Only true prefixes inside segments count, so separators share nothing.
    ``asked``: so many first positions of each segment are wanted; the others stay 0. ``enough``: more than this need not be told.
    """
    n = len(s)
    before = np.full(n, -1, dtype=np.int64)
    before[sa[1:]] = sa[:-1]
    room = np.zeros(n + 1, dtype=np.int64)
    for at in (starts, stops):
        if len(at) and at.max() > n:
            raise ValueError("segments lie inside the text")
    row = np.repeat(np.arange(len(starts)), stops - starts)
    inside = np.arange(len(row)) - (np.cumsum(stops - starts) - (stops - starts))[row]
    room[starts[row] + inside] = stops[row] - starts[row] - inside
    out = np.zeros(n, dtype=np.int64)
    live, shared = np.arange(len(starts)), np.zeros(len(starts), dtype=np.int64)
    ends = stops if asked is None else starts + asked
    enough = n if enough is None else enough
    step = 0
    while len(live):
        at = starts[live] + step
        going = at < ends[live]
        live, at, shared = live[going], at[going], shared[going]
        if not len(live):
            break
        other = before[at]
        most = np.where(other >= 0, np.minimum(np.minimum(room[at], room[np.maximum(other, 0)]), enough), 0)
        shared = np.minimum(np.maximum(shared - 1, 0), most)
        open_ = np.flatnonzero(shared < most)
        while len(open_):
            equal = s[at[open_] + shared[open_]] == s[other[open_] + shared[open_]]
            open_ = open_[equal]
            shared[open_] += 1
            open_ = open_[shared[open_] < most[open_]]
        out[at] = shared
        step += 1
    return out
