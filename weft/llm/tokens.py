"""Token ids of whole texts by the tokenizers library, with a bounded cache of pre-tokens.

A text over the plain Latin character set is split by the tokenizer's own pre-token pattern,
written with explicit classes, and each distinct pre-token is encoded by the library once per
worker.  Pre-tokens are encoded on their own by these tokenizers, so the ids are the same as of
the whole text.  Any other text, and any with the text of a special token, goes to the library whole.
"""

from __future__ import annotations

import functools
import os
import re
from array import array

import numpy as np

LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f"
SAFE = re.compile(f"[{LETTERS}0-9 \\n!-/:-@\\[-`{{-~]*")
#: The pre-token patterns of the two tokenizer kinds, for texts that SAFE matches.
PLAIN = {
    "word": re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[^ \\n{LETTERS}0-9]+"),
    "byte": re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[0-9]+| ?[^ \\n{LETTERS}0-9]+|[ \\n]+(?![^ \\n])|[ \\n]+"),
}

#: Byte-level tokenizers write printable Latin-1 bytes as themselves, the others from U+0100 on.
_OTHER = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
BYTE_LEVEL = {b: 256 + n for n, b in enumerate(_OTHER)}


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """ids(text) -> uint32 array.  ``limit`` bounds the cache of words, 1.5 times as much that of pre-tokens."""

    def __init__(self, path: str, limit: int = 400_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        # Texts that hold one of these go to the library, which gives such a token one id.
        self.added = sorted({t.content.lower() for t in self.tok.get_added_tokens_decoder().values()})
        self.kind = "word" if self.tok.normalizer is not None else "byte"
        self.pattern, self.limit = PLAIN[self.kind], limit
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.vocab = self.tok.get_vocab_size()

    def _whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _pieces(self, needed: set[str]) -> None:
        """Make sure that the ids of all ``needed`` pre-tokens are at hand; the library's model
        merges each, as it does for the pre-tokens of a whole text."""
        if len(self.pieces) > 1.5 * self.limit:
            self.pieces.clear()
        if missing := [p for p in needed if p not in self.pieces]:
            merge = self.tok.model.tokenize
            for piece in missing:
                if piece.isascii() and piece.isalpha():
                    mapped = piece
                else:
                    mapped = piece.encode().decode("latin-1").translate(BYTE_LEVEL)
                self.pieces[piece] = array("I", [t.id for t in merge(mapped)]).tobytes()

    def _joined(self, pieces: list[str]) -> bytes:
        self._pieces(set(pieces))
        return b"".join(map(self.pieces.__getitem__, pieces))

    def _learn(self, chunks: set[str]) -> None:
        """Ids of chunks (words between single spaces, with their space for byte kinds)."""
        lead = " " if self.kind == "byte" else ""
        split = {c: self.pattern.findall(lead + c) for c in chunks}
        self._pieces({p for ps in split.values() for p in ps})
        get = self.pieces.__getitem__
        for c, ps in split.items():
            self.words[c] = b"".join(map(get, ps))

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, "<u4")
        lowered = text.lower()
        if not SAFE.fullmatch(text) or any(t in lowered for t in self.added):
            return np.frombuffer(self._whole(text), "<u4")
        first = b""
        if self.kind == "word":
            words = lowered.split()
        elif text[0] == " " or text[-1] == " " or "  " in text or " \n" in text or "\n " in text:
            return np.frombuffer(self._joined(self.pattern.findall(text)), "<u4")
        else:
            head, _, rest = text.partition(" ")
            words = rest.split(" ") if rest else []
            first = self._joined(self.pattern.findall(head))
        found = list(map(self.words.get, words))
        if None in found:
            if len(self.words) > self.limit:
                self.words.clear()
                self._learn(set(words))
            else:
                self._learn({w for w, f in zip(words, found, strict=True) if f is None})
            found = list(map(self.words.__getitem__, words))
        return np.frombuffer(first + b"".join(found), "<u4")


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each Python worker and tokenizer; workers are reused across tasks."""
    return Encoder(path)
