"""Suffix sorting of a text on disk by induced sorting, with common-prefix values.

Suffixes are L (greater than the next suffix) or S; an LMS suffix is an S with an L before it.

* LMS substrings are put in order by two induction passes and named; if two have one name, the
  string of names is sorted (recursion) to order the LMS suffixes.
* A pass moves through the buckets of first characters.  Each bucket is a first-in-first-out
  queue; since items leave in sorted order, what is pushed into a bucket arrives in sorted order,
  so the buckets together are a monotone priority queue.  A queue whose items exceed its memory
  goes to a file and is read back in blocks when its bucket comes up.
* In the last passes items are tuples (suffix, common prefix with the item before).  A pushed
  item's value is one more than the least value between its source and the source of the item
  pushed before it into the same bucket; values are kept up to ``cap``.

The passes take whole frontiers of a bucket at a time, as arrays.  Text is a memory-mapped file.
A string of names that exceeds ``memory`` goes to a file as digits of a bounded alphabet, most
significant first (fixed width keeps the order), and is sorted by the same induction; one that fits
ends the recursion and is sorted by doubling.  The positions of LMS suffixes are held as arrays.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np


ITEM = [("at", "<i8"), ("prefix", "u1")]


class Buckets:
    """One queue for each character: (suffix, prefix) arrays, beyond ``memory`` items on disk."""

    def __init__(self, folder: str, n: int, memory: int):
        self.folder, self.memory, self.held, self.made = folder, memory, 0, 0
        self.parts: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(n)]
        self.files: dict[int, str] = {}

    def push(self, c: int, at: np.ndarray, prefix: np.ndarray) -> None:
        self.parts[c].append((at, prefix))
        self.held += len(at)
        if self.held > self.memory:
            big = max(range(len(self.parts)), key=lambda k: sum(len(a) for a, _ in self.parts[k]))
            self._spill(big)

    def _spill(self, c: int) -> None:
        at, prefix = self._join(c)
        if c not in self.files:
            self.made += 1
            self.files[c] = os.path.join(self.folder, f"queue-{id(self):x}-{self.made}")
        with open(self.files[c], "ab") as f:
            rows = np.empty(len(at), ITEM)
            rows["at"], rows["prefix"] = at, prefix
            rows.tofile(f)

    def _join(self, c: int) -> tuple[np.ndarray, np.ndarray]:
        parts, self.parts[c] = self.parts[c], []
        if not parts:
            return np.zeros(0, np.int64), np.zeros(0, np.uint8)
        self.held -= sum(len(a) for a, _ in parts)
        return np.concatenate([a for a, _ in parts]), np.concatenate([p for _, p in parts])

    def pop(self, c: int, block: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """What the queue holds now, in order, in blocks; what is pushed meanwhile comes next time."""
        name, (at, prefix) = self.files.pop(c, None), self._join(c)
        if name:
            with open(name, "rb") as f:
                while len(rows := np.fromfile(f, ITEM, block)):
                    yield rows["at"].copy(), rows["prefix"].copy()
            os.unlink(name)
        for i in range(0, len(at), block):
            yield at[i : i + block], prefix[i : i + block]


def _least(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """min(values[low..high]) for each pair, low <= high."""
    table = [values]
    step = 1
    while 2 * step <= len(values):
        table.append(np.minimum(table[-1][:-step], table[-1][step:]))
        step *= 2
    level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
    out = np.empty(len(low), values.dtype)
    for k in np.unique(level):
        here = level == k
        row = table[k]
        out[here] = np.minimum(row[low[here]], row[high[here] - (1 << int(k)) + 1])
    return out


class Pusher:
    """Distributes the predecessors of extracted items to buckets, with their prefix values."""

    def __init__(self, text, buckets: Buckets, n: int, cap: int, carry: bool, rising: bool):
        self.text, self.buckets, self.cap, self.carry, self.rising = text, buckets, cap, carry, rising
        self.since = np.zeros(n, np.uint8)  # least value since the last push into each bucket

    def extracted(self, at: np.ndarray, prefix: np.ndarray, c: int, own: bool = True) -> None:
        """Push the predecessors of items of bucket ``c`` that the pass is after.

        With ``own`` false the items' predecessors in ``c`` are of the other type and left out.
        """
        index = np.flatnonzero(at > 0)
        before = self.text[at[index] - 1]
        if own:
            fits = before >= c if self.rising else before <= c
        else:
            fits = before > c if self.rising else before < c
        index, before = index[fits], before[fits].astype(np.int64)
        order = np.argsort(before, kind="stable")
        index, before = index[order], before[order]
        values = np.zeros(len(index), np.uint8)
        if self.carry and len(at):
            running = np.minimum.accumulate(prefix)
            first = np.ones(len(index), bool)
            first[1:] = before[1:] != before[:-1]
            heads = np.flatnonzero(first)
            values[heads] = np.minimum(self.since[before[heads]], running[index[heads]])
            rest = np.flatnonzero(~first)
            if len(rest):
                values[rest] = _least(prefix, index[rest - 1] + 1, index[rest])
            values = np.minimum(values, self.cap - 1) + 1
            tail = np.minimum.accumulate(prefix[::-1])[::-1]
            self.since = np.minimum(self.since, running[-1])
            last = np.append(heads[1:], len(index)) - 1 if len(heads) else heads
            after = index[last] + 1
            self.since[before[last]] = np.where(after < len(at), tail[np.minimum(after, len(at) - 1)], self.cap)
        edges = np.flatnonzero(np.append(True, before[1:] != before[:-1])) if len(before) else before
        for a, b in zip(edges, np.append(edges[1:], len(before))[: len(edges)], strict=True):
            self.buckets.push(int(before[a]), at[index[a:b]] - 1, values[a:b])


def _runs(text: np.ndarray, at: int, cap: int) -> int:
    """Length of the run of equal characters that begins at ``at``, up to ``cap``."""
    piece = np.asarray(text[at : at + cap])
    other = np.flatnonzero(piece != piece[0])
    return int(other[0]) if len(other) else len(piece)


def induce(text, lms: np.ndarray, prefix: np.ndarray | None, sigma: int, folder: str, cap: int, memory: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All suffixes in DESCENDING order as blocks (suffix, common prefix with the next greater one),
    from LMS suffixes in order and, if given, their common prefixes with the one before."""
    carry = prefix is not None
    ends = np.searchsorted(text[lms], np.arange(sigma + 1)) if len(lms) else np.zeros(sigma + 1, np.int64)
    values = prefix if carry else np.zeros(len(lms), np.uint8)
    rising = Buckets(folder, sigma, memory)
    kept = Buckets(folder, sigma, memory)  # L suffixes of each bucket, for the second pass
    push = Pusher(text, rising, sigma, cap, carry, True)
    for c in range(sigma):
        last = -1
        while True:
            before = last
            for at, lcp in rising.pop(c):
                if last < 0:
                    lcp = np.append(np.uint8(0), lcp[1:])
                last = int(at[-1])
                kept.push(c, at, lcp)
                push.extracted(at, lcp, c)
            if last == before:
                break
        at = lms[ends[c] : ends[c + 1]]
        if len(at):
            lcp = values[ends[c] : ends[c + 1]].copy()
            lcp[0] = 0 if last < 0 or not carry else min(_runs(text, last, cap), _runs(text, int(at[0]), cap))
            push.extracted(at, lcp, c, own=False)  # what stands before an LMS suffix is greater
    falling = Buckets(folder, sigma, memory)
    push = Pusher(text, falling, sigma, cap, carry, False)
    for c in reversed(range(sigma)):
        last = -1
        while True:
            before = last
            for at, lcp in falling.pop(c):
                if last < 0:
                    lcp = np.append(np.uint8(0), lcp[1:])
                last = int(at[-1])
                yield at, lcp
                push.extracted(at, lcp, c)
            if last == before:
                break
        # L suffixes from the greatest; their values turn to the neighbour above.
        blocks = list(kept.pop(c))
        above = None
        for at, lcp in reversed(blocks):
            at, lcp = at[::-1], lcp[::-1]
            turned = np.empty_like(lcp)
            turned[1:] = lcp[:-1]
            if above is None:
                turned[0] = 0 if last < 0 or not carry else min(_runs(text, int(at[0]), cap), _runs(text, last, cap))
            else:
                turned[0] = above
            above = lcp[-1]
            last = int(at[-1])
            yield at, turned
            push.extracted(at, turned, c, own=False)  # what an S suffix before an L begins with is less
    yield np.array([len(text) - 1]), np.zeros(1, np.uint8)  # the end, which precedes no S suffix's bucket


def lms_positions(text) -> np.ndarray:
    """Positions of LMS suffixes; the text ends with its one least character."""
    t = np.asarray(text)
    n = len(t)
    differ = np.flatnonzero(t[1:] != t[:-1])  # the last of each run but the final one
    s = np.zeros(n, bool)
    run_end = np.append(differ, n - 1)
    rises = np.append(t[differ + 1] > t[differ], True)
    s[:] = np.repeat(rises, np.diff(np.concatenate(([-1], run_end))))
    return np.flatnonzero(s[1:] & ~s[:-1]) + 1


def _name(text, order: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """Names of the LMS substrings in text order, from the induced order."""
    t = np.asarray(text)
    length = np.diff(np.append(lms, len(t) - 1)) + 1
    which = np.searchsorted(lms, order)
    size = length[which]
    same = np.zeros(len(order), bool)
    same[1:] = size[1:] == size[:-1]
    active = np.flatnonzero(same)
    d = 0
    while len(active):
        active = active[size[active] > d]
        equal = t[order[active] + d] == t[order[active - 1] + d]
        same[active[~equal]] = False
        active = active[equal]
        d += 1
    names = np.empty(len(lms), np.int64)
    names[which] = np.cumsum(~same) - 1
    return names


def _by_doubling(names: np.ndarray) -> np.ndarray:
    """Suffix array of a string of numbers."""
    rank, step = names.copy(), 1
    while True:
        second = np.zeros(len(rank), np.int64)
        second[: len(rank) - step if step < len(rank) else 0] = rank[step:] + 1
        key = rank * (int(rank.max()) + 2) + second
        order = np.argsort(key, kind="stable")
        rank = np.empty(len(key), np.int64)
        rank[order] = np.concatenate(([0], np.cumsum(key[order][1:] != key[order][:-1])))
        if rank[order[-1]] == len(rank) - 1:
            return order
        step *= 2


def _by_induction(names: np.ndarray, folder: str, memory: int, digit_bits: int) -> np.ndarray:
    """Suffix array of a string of numbers through a file of digits."""
    digits = max(1, -(-int(names.max()).bit_length() // digit_bits))
    path = os.path.join(folder, f"names-{len(names)}-{uuid.uuid4().hex}")
    with open(path, "wb") as f:
        for at in range(0, len(names), 1 << 18):
            shifts = digit_bits * np.arange(digits - 1, -1, -1)
            ((names[at : at + (1 << 18), None] >> shifts & ((1 << digit_bits) - 1)) + 1).astype("<u4").tofile(f)
        np.zeros(1, "<u4").tofile(f)
    text = np.memmap(path, "<u4", "r")
    parts = [at[at % digits == 0] // digits for at, _ in descending(text, (1 << digit_bits) + 1, folder, 1, memory, digit_bits)]
    del text
    os.unlink(path)
    order = np.concatenate(parts)[::-1]
    return order[order < len(names)]


def _prefixes(text, order: np.ndarray, cap: int) -> np.ndarray:
    """Common prefixes of neighbours, by comparing characters of those still equal."""
    t, n = np.asarray(text), len(text)
    out = np.zeros(len(order), np.uint8)
    active, d = np.arange(1, len(order)), 0
    while len(active) and d < cap:
        a, b = order[active] + d, order[active - 1] + d
        inside = (a < n) & (b < n)
        active, a, b = active[inside], a[inside], b[inside]
        active = active[t[a] == t[b]]
        d += 1
        out[active] = d
    return out


def descending(text, sigma: int, folder: str, cap: int, memory: int = 4_000_000, digit_bits: int = 10) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Suffixes of ``text`` from the greatest, with common prefixes (up to ``cap``) with the one above.

    ``text``: array of small integers below ``sigma``; the last is the least and stands nowhere else.
    """
    lms = lms_positions(text)
    by_first = lms[np.argsort(np.asarray(text[lms]), kind="stable")]
    chosen = np.zeros(len(text), bool)
    chosen[lms] = True
    rough = [at[chosen[at]] for at, _ in induce(text, by_first, None, sigma, folder, cap, memory)]
    order = np.concatenate(rough)[::-1]
    names = _name(text, order, lms)
    if len(lms) and int(names.max()) + 1 < len(lms):
        # Digits may be as many as the text has characters; then the names are sorted here.
        shorter = len(names) * max(1, -(-int(names.max()).bit_length() // digit_bits)) < 0.9 * len(text)
        order = lms[_by_induction(names, folder, memory, digit_bits) if len(names) > memory and shorter else _by_doubling(names)]
    yield from induce(text, order, _prefixes(text, order, cap), sigma, folder, cap, memory)
