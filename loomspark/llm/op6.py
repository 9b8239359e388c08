"""Byte-level BPE encoding and decoding with rank files, as the tiktoken library gives it.

A pre-token's bytes are read as Latin-1, so that pyahocorasick's automaton over the vocabulary finds every entry in them
in one pass; the longest at each place is kept. Encoding walks from place to place with the longest entry that fits,
goes to the next shorter entry where it does not, and back one token where none is left, marking the place as dead: each
place dies at most once, so the work is linear in the pre-token's length (times the few shorter entries of an entry).
Entry b fits behind a if merging by rank keeps the two apart when they stand alone; this is seen by undoing their merges,
latest first: none of the pairs that meet across the border may come before the merges undone so far. Answers are
remembered. A sequence in which all neighbours fit is the merges' result, and there is only one. A pre-token that is an entry is that
entry. Entries which the merges don't give for their own bytes stay out of the automaton.

Decoding joins the bytes of the ids; special strings inside texts are ordinary text. Null and empty texts have no ids
and the digest of nothing. Equal rows give equal rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_rows, table
from .memo import Known

SPACE = r"\t-\r\x20\x85\p{Z}"


class RankCodec:
    """Encoder and decoder for one rank file and one splitting pattern."""

    def __init__(self, path: str, pattern: str):
        import ahocorasick

        with open(path, "rb") as file:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}
        self.bytes_of = dict(map(reversed, self.ranks.items()))
        # the library's \s is Unicode's White_Space
        self.split = regex.compile(pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]")).findall
        self.fits_known: dict[int, bool] = {}
        self.pieces = Known(self.encode_piece)
        self.automaton = ahocorasick.Automaton()
        #: The two ids of an entry's last merge; of one byte, its own twice.
        self.halves = {r: (r, r) for b, r in self.ranks.items() if len(b) == 1}
        self.halves |= {r: tuple(two) for b, r in self.ranks.items() if len(b) > 1 and len(two := self.merged(b, 2)) == 2}
        usable = {self.bytes_of[r] for r in self.halves}
        self.shorter = {}
        for b in usable:
            r = self.ranks[b]
            self.automaton.add_word(b.decode("latin-1"), (r, len(b)))
            self.shorter[r] = next((self.ranks[b[:n]] for n in range(len(b) - 1, 0, -1) if b[:n] in usable), -1)
        self.automaton.make_automaton()
        self.length = {r: len(b) for b, r in self.ranks.items()}

    def merged(self, word: bytes, least: int = 1) -> list[int]:
        """Plain merging by rank, down to ``least`` parts, for vocabulary entries."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > least:
            best = min(((self.ranks[p], i) for i in range(len(parts) - 1) if (p := parts[i] + parts[i + 1]) in self.ranks), default=None)
            if best is None:
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return [self.ranks[p] for p in parts]

    def apart(self, a: int, b: int) -> bool:
        """Whether merging a's and b's bytes in a row gives the two."""
        rank, spelled, halves, limit = self.ranks.get, self.bytes_of, self.halves, 1 << 62
        while rank(spelled[a] + spelled[b], limit) >= limit:
            # undo the later merge of the two, or the other one where that is a byte; at equal rank the left one came first
            for left in (True, False) if a > b else (False, True):
                whole = a if left else b
                half = halves[whole][left]
                limit = whole if left else whole + 1
                if half != whole:
                    a, b = (half, b) if left else (a, half)
                    break
            else:
                return True
        return False

    def fits(self, a: int, b: int) -> bool:
        key = a << 32 | b
        if (got := self.fits_known.get(key)) is None:
            if len(self.fits_known) > 1_000_000:
                self.fits_known.clear()
            got = self.fits_known[key] = self.apart(a, b)
        return got

    def piece(self, word: bytes) -> list[int]:
        """Ids of one pre-token."""
        if (whole := self.ranks.get(word)) is not None:
            return [whole]
        n = len(word)
        longest = [-1] * (n + 1)
        for end, (r, size) in self.automaton.iter(word.decode("latin-1")):
            longest[end + 1 - size] = r  # ends come in rising order
        length, shorter, known = self.length, self.shorter, self.fits_known.get
        dead, out, at, token, last = bytearray(n + 1), [], 0, longest[0], -1
        while at < n:
            while token >= 0 and (dead[at + length[token]] or last >= 0 and not ((f := known(last << 32 | token)) or f is None and self.fits(last, token))):
                token = shorter[token]
            if token >= 0:
                out.append(last := token)
                at += length[token]
                token = longest[at]
            else:
                dead[at] = 1
                token = out.pop()
                at -= length[token]
                last = out[-1] if out else -1
        return out

    def encode_piece(self, piece: str) -> bytes:
        ids = self.piece(piece.encode())
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str | None) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        return b"".join(map(self.pieces.__getitem__, self.split(text))) if text else b""

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> RankCodec:
    """One per worker process."""
    return RankCodec(path, pattern)


def encode_decode(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, ids (binary, little-endian unsigned 32-bit) and decoded (binary)."""

    def run(batches):
        own = codec(path, pattern)
        for batch in batches:
            ids = []
            for at, (k, t) in enumerate(arrow_rows(batch, "k", "t")):
                ids.append((k, e := own.encode(t), own.decode(e)))
                if sum(len(x[1]) for x in ids) > 8_000_000 or at == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*ids), (pa.int64(), pa.binary(), pa.binary()))], names=[key, "ids", "decoded"])
                    ids = []

    return docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).mapInArrow(run, f"{key} long, ids binary, decoded binary")


def digests(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """As ``encode_decode``, but digests in place of the ids and bytes, so that only these leave the Python worker."""

    def run(batches):
        own = codec(path, pattern)
        for batch in batches:
            rows = []
            for k, t in arrow_rows(batch, "k", "t"):
                ids = own.encode(t)
                rows.append((k, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(own.decode(ids)).hexdigest()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string(), pa.string()))], names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).mapInArrow(run, f"{key} long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
