"""Operator 7, packing: hierarchical multi-length packing.

Sequence lengths are powers of two up to ``longest``; the tiers are the longest and the ones
below it down to ``shortest``.  Within a lot of a partition's documents:

1. a document is cut into full windows of the longest tier and a remainder,
2. the remainder is routed to the smallest tier that holds it,
3. each tier is packed on its own into windows of its own width, the longest first: a window opens
   with the largest remainder of its tier and its gap is filled by the best-fitting remainders of
   shorter tiers,
4. what gap no whole remainder fits is filled by cutting one, so that windows end full; the lot's
   last window alone can stay short and is cut into tiers by powers of two, the last of which is
   padded,
5. windows go to step groups of about equal numbers of tokens: largest first, each to the group
   with the fewest so far.

A lot has at most ``lot_tokens`` tokens and never crosses a partition, so memory is bounded, and
no shuffle is needed: the layout depends on a partition's own rows alone and comes out the same
when a task is run again.  sequence_id is the partition's number times 2^33 plus a counter.

Defined results: a null or empty text is the end id alone; repeated rows and null ids are packed
like any other; of remainders of one size the last read goes first; a very long text is one lot by
itself and its windows are cut from it in order; an empty table gives no pieces.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, longs
from .tokens import encoder

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier long, step_group long"


class Remainders:
    """Pieces by length; takes the largest that fits in O(log n)."""

    def __init__(self):
        self.sizes: list[int] = []
        self.by_size: dict[int, list[tuple[int, int]]] = {}

    def add(self, size: int, doc: int, start: int) -> None:
        if size not in self.by_size:
            insort(self.sizes, size)
            self.by_size[size] = []
        self.by_size[size].append((doc, start))

    def take(self, most: int) -> tuple[int, int, int] | None:
        """(size, doc, start) of the largest piece of at most ``most`` tokens."""
        k = bisect_right(self.sizes, most)
        if not k:
            return None
        size = self.sizes[k - 1]
        doc, start = self.by_size[size].pop()
        if not self.by_size[size]:
            del self.by_size[size], self.sizes[k - 1]
        return size, doc, start


def plan(lengths: list[int], longest: int = 1024, shortest: int = 64, group: int = 32) -> list[tuple[int, int, list[tuple[int, int, int]]]]:
    """Windows of a lot: (tier, step group, [(doc, start, size)]); every token is in one piece."""
    tiers = [shortest]
    while tiers[-1] < longest:
        tiers.append(tiers[-1] * 2)
    windows: list[list[tuple[int, int, int]]] = []
    routed = {t: Remainders() for t in tiers}
    for doc, n in enumerate(lengths):
        for start in range(0, n - n % longest, longest):
            windows.append([(doc, start, longest)])
        if rest := n % longest:
            routed[next(t for t in tiers if t >= rest)].add(rest, doc, n - rest)
    for k in reversed(range(len(tiers))):
        while opened := routed[tiers[k]].take(tiers[k]):
            size, doc, start = opened
            window, gap = [(doc, start, size)], tiers[k] - size
            while gap:
                # The own tier and shorter ones, the one with the best fit first.
                fit = next((p for t in reversed(tiers[: k + 1]) if (p := routed[t].take(gap))), None)
                if fit is None:
                    cut = next((p for t in tiers[: k + 1] if (p := routed[t].take(longest))), None)
                    if cut is None:
                        break
                    size, doc, start = cut
                    window.append((doc, start, gap))
                    left = size - gap
                    routed[next(t for t in tiers if t >= left)].add(left, doc, start + gap)
                    gap = 0
                else:
                    size, doc, start = fit
                    window.append((doc, start, size))
                    gap -= size
            windows.append(window)
    shaped: list[tuple[int, list[tuple[int, int, int]]]] = []
    for window in windows:
        total = sum(p[2] for p in window)
        if total in tiers:
            shaped.append((total, window))
            continue
        while window:  # the short one: powers of two from the largest, the last one padded
            total = sum(p[2] for p in window)
            tier = next((t for t in reversed(tiers) if t <= total), shortest)
            room, head, tail = tier, [], []
            for doc, start, size in window:
                here = min(room, size)
                if here:
                    head.append((doc, start, here))
                if size > here:
                    tail.append((doc, start + here, size - here))
                room -= here
            shaped.append((tier, head))
            window = tail
    n_groups = max(1, -(-sum(t for t, _ in shaped) // (group * longest)))
    load = [(0, g) for g in range(n_groups)]
    out = []
    for tier, window in sorted(shaped, key=lambda x: -x[0]):
        tokens, g = heapq.heappop(load)
        heapq.heappush(load, (tokens + tier, g))
        out.append((tier, g, window))
    return out


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, longest: int = 1024, shortest: int = 64, lot_tokens: int = 4_000_000, group: int = 32) -> DataFrame:
    """One row for each piece; see the module's text.  ``tier`` is the window's padded length."""

    def lot(ids: list[np.ndarray], names: list, base: int, group_base: int) -> tuple[pd.DataFrame, int, int]:
        windows = plan([len(x) for x in ids], longest, shortest, group)
        data = [memoryview(x.tobytes()) for x in ids]
        rows = []
        for k, (tier, g, window) in enumerate(windows):
            offset = 0
            for doc, start, size in window:
                rows.append((doc, start, size, zlib.crc32(data[doc][4 * start : 4 * (start + size)]), len(ids[doc]), base + k, offset, tier, group_base + g))
                offset += size
        out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group"])
        out["doc_id"] = longs(names[d] for d in out["doc_id"])
        return out, base + len(windows), group_base + 1 + max(g for _, g, _ in windows)

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(tokenizer)
        base = group_base = TaskContext.get().partitionId() << 33
        ids, names, held = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids.append(np.append(enc.encode(text or ""), np.uint32(end_id)).astype("<u4"))
                names.append(doc_id)
                held += len(ids[-1])
                if held >= lot_tokens:
                    out, base, group_base = lot(ids, names, base, group_base)
                    yield out
                    ids, names, held = [], [], 0
        if ids:
            yield lot(ids, names, base, group_base)[0]

    return docs.select(id_text(), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInPandas(task, SCHEMA)
