"""Token ids as the ``tokenizers`` library gives them, remembered per run of characters or per pre-token.

The word vocabulary splits a text before it merges, and always between a non-space character and white space behind it.
So the ids of a text are the ids of its runs between white space in a row, and a run that was seen before need not be
encoded again. Byte-level vocabularies split by a pattern, and the ids of a text are those of its pre-tokens in a row.
Their pattern always splits before a single space between other characters, so runs are cut there too, each with the
space before it, and only runs not met lately are matched against the pattern.
The library encodes every unseen one, and as a whole every text that this does not hold for: one with special strings,
with white space side by side, or with the control characters on whose class Python and the library differ. The memory of
the word vocabulary is bounded by twice ``most`` runs and as many pre-tokens, of which those not met lately go; that of
byte-level ones by twice ``RUNS`` runs likewise and ``PIECES`` other pre-tokens, which start anew when full. Workers live on for other operators' tasks, which
let it go by ``forget``.
"""

from __future__ import annotations

import gc
import os
import re
import struct
import unicodedata
from collections.abc import Callable
from functools import cached_property, lru_cache

import numpy as np
import regex

from .common import trim

MOST = 200_000
PIECES = 800_000
RUNS = 600_000
#: Characters of a run or pre-token whose ids are remembered.
SHORT = 64
SPACE = r"\t-\r\x20\x85\p{Z}"
#: The pre-token patterns of the public vocabularies.
WORDS = rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+"
BYTES = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"


def byte_letters() -> dict[str, int]:
    """The printable stand-in letter of each byte in byte-level vocabularies, by its public rule."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def lowered(text: str) -> str:
    """NFC, then lower case letter by letter (no final-sigma rule), as the word vocabulary's normalizer does."""
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFC", text)
    return (text.replace("Σ", "σ") if "Σ" in text else text).lower()


def unassigned(text: str) -> bool:
    """Whether a character is unassigned: on these pattern engines differ."""
    return not text.isascii() and any(unicodedata.category(c) == "Cn" for c in text)


packs = [struct.Struct(f"<{n}I").pack for n in range(32)]


class Known(dict):
    """Ids by pre-token; those of short ones are remembered."""

    def __init__(self, encode: Callable[[str], bytes]):
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        ids = self.encode(piece)
        if len(piece) <= SHORT:
            if len(self) >= PIECES:
                self.clear()
            self[piece] = ids
        return ids


class Recent(dict):
    """Ids by run or pre-token; of short ones the last ``most`` to twice as many that were met. Old ones move back when met."""

    def __init__(self, encode: Callable[[str], bytes], most: int):
        super().__init__()
        self.encode, self.most, self.old = encode, most, {}

    def __missing__(self, piece: str) -> bytes:
        if (ids := self.old.get(piece)) is None:
            ids = self.encode(piece)
        if len(piece) <= SHORT:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class Remembered:
    """Ids of whole texts for a tokenizers .json file of kind ``word`` or ``byte``; special strings become their ids.

    All ids are little-endian unsigned 32-bit."""

    #: White space beyond one space in front, and all of it in a pre-token of nothing else but a line break.
    odd = re.compile(r"(?!\A )\s|\A \Z")

    def __init__(self, path: str, kind: str, most: int = MOST):
        from tokenizers import Tokenizer

        self.path, self.whole = path, Tokenizer.from_file(path)
        self.words = kind == "word"
        self.known = Recent(self.encode_run, most)
        self.model, self.split = self.whole.model, regex.compile(WORDS if self.words else BYTES).findall
        self.shown = {b: c for c, b in byte_letters().items()}
        self.space = self.shown[32]
        self.pieces = Recent(self.merge, most) if self.words else Known(self.encode_piece)
        self.spaced = Recent(self.encode_spaced, RUNS)

    @cached_property
    def run(self):
        """Of runs, which are in normal form when they are cut."""
        from tokenizers import Tokenizer, normalizers

        own = Tokenizer.from_file(self.path)
        own.normalizer = normalizers.Sequence([])
        return own

    def encode_whole(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def merge(self, piece: str) -> bytes:
        shown = piece.replace(" ", self.space) if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(self.shown)
        return self.merged(shown)

    def merged(self, shown: str) -> bytes:
        """Of a pre-token in stand-in letters."""
        ids = [t.id for t in self.model.tokenize(shown)]
        return packs[len(ids)](*ids) if len(ids) < len(packs) else struct.pack(f"<{len(ids)}I", *ids)

    def encode_piece(self, piece: str) -> bytes:
        """KeyError: a text with this pre-token is encoded as a whole."""
        if piece != "\n" and self.odd.search(piece) or unassigned(piece):
            raise KeyError(piece)
        return self.merge(piece)

    def encode_spaced(self, run: str) -> bytes:
        """Of a run behind a single space, with that space. KeyError, as of any text with white space side by side or at an end."""
        if run.isalpha():  # one pre-token, of assigned characters
            return self.merged(self.space + run) if run.isascii() else self.merge(" " + run)
        if run[-1:] in (",", ".") and run[:-1].isalpha():
            return self.spaced[run[:-1]] + self.pieces[run[-1]]
        if not run or run[0].isspace() or run[-1].isspace():
            raise KeyError(run)
        first, *rest = self.split(" " + run)
        if not rest:
            return self.encode_piece(first)
        return self.spaced[first[1:]] + b"".join(map(self.pieces.__getitem__, rest))

    def encode_run(self, run: str) -> bytes:
        if unassigned(run):
            return np.array(self.run.encode(run, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.pieces.__getitem__, self.split(run)))

    def ids(self, text: str | None) -> bytes:
        """A null text has no ids."""
        if not text:
            return b""
        if "<|" in text or self.words and re.search("[\x1c-\x1f]", text):
            return self.encode_whole(text)
        if self.words:
            return b"".join(map(self.known.__getitem__, lowered(text).split()))
        first, *runs = text.split(" ")
        try:
            if first and not first[-1].isspace():
                return b"".join([*map(self.pieces.__getitem__, self.split(first)), *map(self.spaced.__getitem__, runs)])
        except KeyError:
            pass
        try:
            return b"".join(map(self.pieces.__getitem__, self.split(text)))
        except KeyError:
            return self.encode_whole(text)


@lru_cache(maxsize=4)
def remembered(path: str, kind: str, most: int = MOST) -> Remembered:
    """One per worker process."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Remembered(path, kind, most)


def forget() -> None:
    """Gives the memory of this worker's vocabularies back, for a task that has no use for them."""
    if remembered.cache_info().currsize:
        remembered.cache_clear()
        gc.collect()
        trim()
