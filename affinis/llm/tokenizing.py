"""Whole-text tokenization with the ``tokenizers`` library.

Both vocabularies used here never join characters across a space that stands
between two other characters, so a text is encoded part by part and each part
once for every cache: words repeat, and most of the time goes into merges.
Parts made of Latin letters, digits and ASCII signs are cut by the tokenizer's
own split pattern and go straight to the library's BPE model; every other part
goes through its full pipeline.  A text that holds the string of an added token
(``<|endoftext|>``) goes whole through the library, which cuts it there and
strips as that token says.  ``tests/llm`` compares the ids with
``Tokenizer.encode`` on whole texts.
"""

from __future__ import annotations

import re
from array import array

import regex

#: The split patterns stated in the two tokenizer files.
BYTE_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

_PLAIN = re.compile("[!-~À-ɏ\n]+")
_BETWEEN = re.compile(r"(?<=\S) (?=\S)")
_RUN = re.compile(r"\s\s")


def _byte_chars() -> dict[int, str]:
    """Byte -> character of byte-level BPE: printable Latin-1 stands for
    itself, the other bytes follow from 256 on in ascending order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class _Parts(dict):
    """Part -> its ids as little-endian uint32 bytes; at most ``cap`` entries."""

    def __init__(self, encode, cap: int):
        super().__init__()
        self.encode, self.cap = encode, cap

    def __missing__(self, part: str) -> bytes:
        if len(self) >= self.cap:
            self.clear()
        self[part] = ids = self.encode(part)
        return ids


class TextEncoder:
    """Encode whole texts with one tokenizer file.

    ``kind`` is ``byte`` (byte-level, spaces belong to tokens) or ``word``
    (lower case, white space dropped).  ``cache_entries`` bounds memory only.
    """

    def __init__(self, path: str, kind: str, cache_entries: int = 500_000):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        added = self.tok.get_added_tokens_decoder().values()
        self.added = [t.content for t in added]
        self.whole = any(t.normalized for t in added)  # such a string may show in the normalized text alone
        self.kind = kind
        self.model = self.tok.model
        self.chars = _byte_chars()
        self.split = regex.compile(BYTE_SPLIT if kind == "byte" else WORD_SPLIT)
        self.lead = "\u0120" if kind == "byte" else ""  # the space, as the model has it
        self.pieces = _Parts(self._piece, cache_entries // 4)
        self.parts = _Parts(self._part, cache_entries)

    def _model(self, mapped: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(mapped)]).tobytes()

    def _piece(self, piece: str) -> bytes:
        return self._model(piece.encode("utf-8").decode("latin-1").translate(self.chars))

    def _full(self, text: str) -> bytes:
        return array("I", self.tok.encode(text, add_special_tokens=False).ids).tobytes()

    def _first(self, text: str) -> bytes:
        """A text, or a part with its space, cut by the split pattern."""
        if not _PLAIN.fullmatch(text.removeprefix(" ")):
            return self._full(text)
        return b"".join(map(self.pieces.__getitem__,
                            self.split.findall(text if self.lead else text.lower())))

    def _part(self, part: str) -> bytes:
        """A part and, for the byte kind, the space before it."""
        if part.isascii():
            if part.isalpha():
                return self._model(self.lead + (part if self.lead else part.lower()))
            if part[-1:] in (".", ",") and part[:-1].isalpha():
                return self.parts[part[:-1]] + self.pieces[part[-1]]
        return self._first(" " + part if self.lead else part)

    def encode(self, text: str | None) -> bytes:
        """Ids of the text as little-endian uint32 bytes; null and empty: none."""
        if not text:
            return b""
        if self.whole or any(s in text for s in self.added):
            return self._full(text)
        if not self.lead:
            return b"".join(map(self.parts.__getitem__, text.replace("\n", " ").split(" ")))
        if _RUN.search(text):
            head, *rest = _BETWEEN.split(text)
            return self._first(head) + b"".join([self._first(" " + p) for p in rest])
        head, *rest = text.split(" ")
        return self._first(head) + b"".join(map(self.parts.__getitem__, rest))


_ENCODERS: dict[tuple[str, str], TextEncoder] = {}


def encoder(path: str, kind: str) -> TextEncoder:
    """One encoder for each Python worker and tokenizer file."""
    if (path, kind) not in _ENCODERS:
        _ENCODERS[path, kind] = TextEncoder(path, kind)
    return _ENCODERS[path, kind]


def vocabulary_size(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)
