"""Operator 5, token counts: edit-aware counting over segment trees.

A document's text is cut into leaves of about ``leaf`` characters, only where the tokenizer's
pre-tokens must end: between a character that is no white space and a single space before
another such character.  Leaves are encoded on their own, so counts add up.  A complete binary
tree holds the characters and tokens of each subtree.

An edit replaces characters [start, end).  The tree is descended by subtree lengths to the
touched leaves; these and, as boundary context, the nearest leaves of two or more characters on
either side are re-cut and re-encoded, since an edit can make or break a boundary.  Sums change
along the paths to the root only.  Everything else keeps its count.

Trees are per row: no shuffle, and a task holds one document's tree at a time.

Defined results: null or empty text has no tokens.  Edits must not overlap; they are given in
characters of the original text, and bounds beyond it are cut.  Null edits are none; edits that
start at one place are applied in the order given.  A text of any length is one row and one tree.
Repeated rows are counted each.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_text, longs
from .positions import positions
from .tokens import encoder

SCHEMA = "doc_id long, n_tokens long, n_edits long, n_tokens_after long, n_chars_after long, n_reencoded long, n_leaves long"
#: Personal data and keys that the query's edits replace: a pattern and its placeholder.
REDACTIONS = (
    (r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,4}", "<email>"),
    (r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9.])", "<address>"),
    (r"(?<![0-9a-f])[0-9a-f]{32,}(?![0-9a-f])", "<key>"),
    (r"(?<![0-9A-Za-z])\+?[0-9][0-9 ()-]{7,17}[0-9](?![0-9A-Za-z])", "<number>"),
)


def cuts(text: str, leaf: int) -> list[int]:
    """Where leaves end, the text's end included."""
    out, at, n = [], leaf, len(text)
    while at < n:
        k = text.find(" ", at)
        while 0 < k < n - 1 and (text[k - 1].isspace() or text[k + 1].isspace()):
            k = text.find(" ", k + 1)
        if not 0 < k < n - 1:
            break
        out.append(k)
        at = k + leaf
    return [*out, n]


class CountTree:
    """Characters and tokens of a text's leaves, with sums over a complete binary tree."""

    def __init__(self, text: str, count, leaf: int = 256):
        self.count, self.leaf, self.reencoded = count, leaf, 0
        ends = cuts(text, leaf)
        self.leaves = [text[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        self.size = 1 << max(0, (len(self.leaves) - 1).bit_length())
        self.sums = np.zeros((2 * self.size, 2), np.int64)
        for k, part in enumerate(self.leaves):
            self.sums[self.size + k] = len(part), count(part)
        for k in range(self.size - 1, 0, -1):
            self.sums[k] = self.sums[2 * k] + self.sums[2 * k + 1]

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    @property
    def chars(self) -> int:
        return int(self.sums[1, 0])

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds character ``at`` (the last one at the end) and where it begins."""
        if not self.chars:
            return 0, 0
        at, node, begin = min(at, self.chars - 1), 1, 0
        while node < self.size:
            left = int(self.sums[2 * node, 0])
            if at - begin < left:
                node = 2 * node
            else:
                node, begin = 2 * node + 1, begin + left
        return node - self.size, begin

    def _set(self, k: int, text: str) -> None:
        new = np.array((len(text), self.count(text)), np.int64)
        node = self.size + k
        change = new - self.sums[node]
        self.leaves[k] = text
        while node:
            self.sums[node] += change
            node //= 2

    def edit(self, start: int, end: int, replacement: str) -> None:
        start, end = min(max(0, start), self.chars), min(max(0, start, end), self.chars)
        first, begin = self.find(start)
        last, _ = self.find(max(start, end - 1))
        while first > 0:
            first -= 1
            begin -= len(self.leaves[first])
            if len(self.leaves[first]) > 1:
                break
        while last < len(self.leaves) - 1:
            last += 1
            if len(self.leaves[last]) > 1:
                break
        region = "".join(self.leaves[first : last + 1])
        region = region[: start - begin] + replacement + region[end - begin :]
        ends = cuts(region, max(self.leaf, len(region) // (last - first + 1)))
        parts = [region[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        parts[last - first :] = ["".join(parts[last - first :])]
        for k in range(first, last + 1):
            self._set(k, parts[k - first] if k - first < len(parts) else "")
        self.reencoded += len(region)

    def text(self) -> str:
        return "".join(self.leaves)


def redactions(text: Column) -> Column:
    """array<struct<s, e, r>>: non-overlapping edits of personal data in ``text``."""
    whole = "|".join(f"({p})" for p, _ in REDACTIONS)
    hits = F.regexp_extract_all(text, F.lit(whole), F.lit(0))
    gaps = F.transform(F.split(text, whole, -1), lambda g: F.length(g))
    email, address, key, number = (F.lit(word) for _, word in REDACTIONS)

    def kind(m: Column) -> Column:
        """What a match is, without a second search: the patterns' alphabets tell."""
        return F.when(m.contains("@"), email).when(m.contains("."), address).when(F.length(m) >= 32, key).otherwise(number)

    lengths, words = F.transform(hits, lambda m: F.length(m)), F.transform(hits, kind)
    found = F.transform(positions(gaps, lengths, words, "string"), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["v"].alias("r")))
    return F.when(text.rlike(whole), found).otherwise(F.array().cast("array<struct<s:int,e:int,r:string>>"))


def recount(docs: DataFrame, edits: Column, tokenizer: str, leaf: int = 256) -> DataFrame:
    """Counts before and after the edits (array<struct<s, e, r>>) of each document; see SCHEMA."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(tokenizer)
        count = lambda part: len(enc.encode(part))
        for batch in batches:
            out = []
            for text, starts, ends, words in zip(batch["text"], batch["s"], batch["e"], batch["r"], strict=True):
                tree = CountTree(text, count, leaf)
                before = tree.tokens
                # From the back, so that positions of the others still hold.
                for s, e, r in sorted(zip(starts, ends, words, strict=True), key=lambda x: -x[0]):
                    tree.edit(int(s), int(e), r or "")
                out.append((before, len(starts), tree.tokens, tree.chars, tree.reencoded, len(tree.leaves)))
            names = ["n_tokens", "n_edits", "n_tokens_after", "n_chars_after", "n_reencoded", "n_leaves"]
            yield pd.DataFrame(out, columns=names).assign(doc_id=longs(batch["doc_id"]))

    given = F.coalesce(edits, F.array().cast("array<struct<s:int,e:int,r:string>>"))
    rows = docs.select(id_text(), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), given.alias("x"))
    return rows.select("doc_id", "text", "x.s", "x.e", "x.r").mapInPandas(task, SCHEMA)
