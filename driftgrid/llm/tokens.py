"""Token ids of whole texts by the tokenizers library, with a memo of what it returned for a word."""

from __future__ import annotations

import re
from array import array
from functools import lru_cache

import numpy as np

#: Ends every document.
END_ID = 0

_SAFE = re.compile(r"(?<=\S)(?= \S)")
_WORD = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")
#: How a byte-level vocabulary writes the bytes of Latin letters: those outside the printable range are moved up.
_BYTES = {b: 0x100 + n for n, b in enumerate([*range(0x21), *range(0x7F, 0xA1), 0xAD])}


class Encoder:
    """Encodes texts word by word.

    A single space between two visible characters always opens a new pre-token of a byte-level vocabulary, and a single
    line end is one, so a text can be cut there, and the ids of the pieces, joined, are the ids of the text. What the
    library returned for a piece is kept, because most pieces are common words: when ``memo`` pieces are known, those
    not met again are forgotten by the time as many new ones are. A run of Latin letters is one pre-token and goes to
    the library's BPE model directly; any other piece goes through its whole pipeline. Texts with other white space, or
    runs of it, are cut only at the single spaces. The string of a special token in a text is that token, as in the
    library's plain call.
    """

    def __init__(self, path: str, memo: int = 500_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.size = self.tokenizer.get_vocab_size()
        self.kind = np.dtype("<u2") if self.size <= 1 << 16 else np.dtype("<u4")
        self.code = "H" if self.kind.itemsize == 2 else "I"
        self.memo = memo
        self.after_space: dict[str, bytes] = {}
        self.plain: dict[str, bytes] = {}
        self.older: dict[bool, dict[str, bytes]] = {True: {}, False: {}}
        self.end = self._bytes([END_ID])
        self.line_end = self._library("\n")

    def _bytes(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def _library(self, piece: str) -> bytes:
        return self._bytes(self.tokenizer.encode(piece, add_special_tokens=False).ids)

    def _piece(self, word: str, space: bool) -> bytes:
        """The ids of a word, or of a space and the word; a word has no space within."""
        known = self.after_space if space else self.plain
        found = known.get(word)
        if found is not None:
            return found
        found = self.older[space].get(word)
        if found is not None:
            pass
        elif m := _WORD.fullmatch(word):
            if m[2]:
                found = self._piece(m[1], space) + self._piece(m[2], False)
            else:
                coded = (" " * space + word).encode().decode("latin-1").translate(_BYTES)
                found = self._bytes([t.id for t in self.model.tokenize(coded)])
        else:
            found = self._library(" " * space + word)
        if len(known) >= self.memo:
            self.older[space] = known.copy()
            known.clear()
        known[word] = found
        return found

    def encode(self, text: str | None) -> np.ndarray:
        """The ids of a text, with the end id; null counts as empty."""
        if not text:
            return np.frombuffer(self.end, self.kind)
        lines, visible = text.split("\n"), text.split()
        gaps = text.count(" ") + len(lines) - 1
        # only spaces and line ends beside the visible characters, and as many of them as gaps between words, so each is single
        if len(visible) - 1 != gaps or len("".join(visible)) + gaps != len(text):
            first, *rest = _SAFE.split(text)
            out = [self._library(first), *[self._piece(x[1:], True) if " " not in x[1:] else self._library(x) for x in rest]]
        else:
            out, after_space, plain = [], self.after_space.get, self.plain.get
            for line in lines:
                first, *rest = line.split(" ")
                found = list(map(after_space, rest))
                if None in found:
                    found = [self._piece(w, True) if x is None else x for w, x in zip(rest, found, strict=True)]
                out += [self.line_end, plain(first) or self._piece(first, False), *found]
            del out[0]
        out.append(self.end)
        return np.frombuffer(b"".join(out), self.kind)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each Python worker."""
    return Encoder(path)
