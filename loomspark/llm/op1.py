"""Token counts by a finite-state transducer over whole texts.

Compilation. The tokenizer's splits and normal form turn a text into symbols: the bytes of its words, the last byte of
a word as a symbol of its own. The merges become a deterministic transducer over these symbols. Let t(i) be the last
token of the merges' result for a word's first i symbols. That result for a longer prefix ends with the only token w
that ends there and may follow t at w's start, so a state needs t (and how many tokens were emitted there, relative to
now) only at those earlier positions from which some vocabulary entry may still run on: the failure chain of an
Aho-Corasick trie over the vocabulary. Each transition is annotated with the change in emitted tokens, which may be
zero or negative as a longer token replaces shorter ones. The last symbol of a word leads back to the start state.
States and transitions are compiled when first met and kept in a hash table of bounded size, which starts anew when it
is full.

Scan. All symbols of a batch of texts are cut into chunks of equal length, wherever that falls. A chunk's state map is
constant behind its first word end (all entry states lead to the same exit) and depends on the entry state only before
it. So all chunks run in lockstep from their first word end; the maps compose by a prefix scan (the last chunk with a
word end decides: a running maximum), and then the heads run, again all at once, from the exit states that the scan
gives them. Chunks inside one very long word have no word end: they take their entries one after another.

Null and empty texts have zero bytes and tokens. Equal rows give equal rows; other columns are ignored.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_rows, table, text_batches
from .memo import byte_letters, lowered

END = 256  # added to a word's last byte
CHUNK = 512
TABLE_BITS = 21


class Transducer:
    """Lazily compiled from a .json vocabulary with merges and a word-end suffix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            said = json.load(file)
        model, letter = said["model"], byte_letters()
        self.suffix = model["end_of_word_suffix"]
        self.special = [x["content"] for x in said["added_tokens"]]

        def symbols(token: str) -> tuple[int, ...]:
            last = token.endswith(self.suffix)
            out = [letter[c] for c in (token[: -len(self.suffix)] if last else token)]
            return (*out[:-1], out[-1] + END) if last else tuple(out)

        names = [t for t in model["vocab"] if t not in self.special]
        self.tokens = {symbols(t): n for n, t in enumerate(names)}
        of = {t: self.tokens[symbols(t)] for t in names}
        self.text = list(self.tokens)
        self.rank = {}
        for r, (a, b) in enumerate(m.split(" ") if isinstance(m, str) else m for m in model["merges"]):
            self.rank.setdefault((of[a], of[b]), (r, of[a + b]))
        # trie over all tokens that the merges give for their own symbols
        self.child, self.parent, self.sym, self.depth, self.token_at = {}, [0], [-1], [0], [-1]
        for t, n in self.tokens.items():
            if self.merged(t) != [n]:
                continue
            node = 0
            for s in t:
                key = node << 9 | s
                if key not in self.child:
                    self.child[key] = len(self.parent)
                    self.parent.append(node)
                    self.sym.append(s)
                    self.depth.append(self.depth[node] + 1)
                    self.token_at.append(-1)
                node = self.child[key]
            self.token_at[node] = n
        self.fails: dict[int, int] = {0: 0}
        self.fits: dict[int, bool] = {}
        self.forget()

    def merged(self, symbols: tuple[int, ...]) -> list[int]:
        """Plain merging by rank of a short symbol string; used for vocabulary entries and pairs of them."""
        now = [self.tokens[(s,)] for s in symbols]
        while len(now) > 1:
            best = min(((self.rank[p][0], i) for i, p in enumerate(zip(now, now[1:])) if p in self.rank), default=None)
            if best is None:
                break
            i = best[1]
            now[i : i + 2] = [self.rank[now[i], now[i + 1]][1]]
        return now

    def may_follow(self, a: int, b: int) -> bool:
        """Whether the merges keep tokens a and b apart when they stand alone side by side."""
        key = a << 20 | b
        if (got := self.fits.get(key)) is None:
            if len(self.fits) > 400_000:
                self.fits.clear()
            got = self.fits[key] = self.merged(self.text[a] + self.text[b]) == [a, b]
        return got

    def fail(self, node: int) -> int:
        """The node of the longest proper suffix that is in the trie."""
        if (got := self.fails.get(node)) is not None:
            return got
        up = self.parent[node]
        got = 0 if up == 0 else self.step(self.fail(up), self.sym[node])
        self.fails[node] = got
        return got

    def step(self, node: int, s: int) -> int:
        while (got := self.child.get(node << 9 | s)) is None and node:
            node = self.fail(node)
        return got or 0

    def forget(self) -> None:
        self.key = np.full(1 << TABLE_BITS, -1, np.int64)
        self.next = np.zeros(1 << TABLE_BITS, np.int32)
        self.emit = np.zeros(1 << TABLE_BITS, np.int16)
        # a state: trie node, and for each position that can still start a token how far back it is -> (last token or -1, tokens emitted there less those emitted now)
        start = (0, ((0, -1, 0),))
        self.states, self.number, self.filled = [start], {start: 0}, 0

    def compile(self, state: int, s: int) -> tuple[int, int]:
        node, open_at = self.states[state]
        at = {back: (last, less) for back, last, less in open_at}
        node = self.step(node, s)
        found, out = node, None
        while found:
            w = self.token_at[found]
            if w >= 0 and (got := at.get(self.depth[found] - 1)) and (got[0] < 0 or self.may_follow(got[0], w)):
                out = (w, got[1] + 1)
                break
            found = self.fail(found)
        if out is None:
            raise ValueError("no token ends here")
        w, delta = out
        if s >= END:
            return 0, delta
        keep, found = [(0, w, 0)], node
        while found:
            back = self.depth[found]
            last, less = at[back - 1]
            keep.append((back, last, less - delta))
            found = self.fail(found)
        new = (node, tuple(sorted(keep)))
        if (n := self.number.get(new)) is None:
            n = self.number[new] = len(self.states)
            self.states.append(new)
        return n, delta

    @staticmethod
    def slot(key: np.ndarray) -> np.ndarray:
        return (key * np.int64(0x9E3779B97F4A7C1) >> 22) & ((1 << TABLE_BITS) - 1)

    def follow(self, state: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One lockstep: next states and emitted counts."""
        key = state.astype(np.int64) << 9 | symbol
        mask = (1 << TABLE_BITS) - 1
        slot = self.slot(key)
        while True:
            there = self.key[slot]
            off = np.flatnonzero(there != key)
            if not len(off):
                return self.next[slot], self.emit[slot]
            empty = off[there[off] == -1]
            for k in set(key[empty].tolist()):
                at = int(self.slot(np.array([k], np.int64))[0])
                while self.key[at] not in (-1, k):
                    at = (at + 1) & mask
                if self.key[at] == -1:
                    self.next[at], self.emit[at] = self.compile(k >> 9, k & 511)
                    self.key[at] = k
                    self.filled += 1
            full = off[there[off] != -1]
            slot[full] = (slot[full] + 1) & mask

    def emitted(self, symbols: np.ndarray) -> np.ndarray:
        """Change in emitted tokens at each symbol; the stream starts and ends between words."""
        n = len(symbols)
        if not n:
            return np.zeros(0, np.int64)
        if self.filled > (1 << TABLE_BITS) * 6 // 10:
            self.forget()
        chunks = -(-n // CHUNK)
        grid = np.full(chunks * CHUNK, -1, np.int64)
        grid[:n] = symbols
        grid = grid.reshape(chunks, CHUNK)
        out = np.zeros((chunks, CHUNK), np.int64)
        ends = grid >= END
        resets = ends.any(1)
        head = np.where(resets, ends.argmax(1) + 1, CHUNK)  # symbols before this depend on the entry state
        grid_t = np.ascontiguousarray(grid.T)
        exits = np.zeros(chunks, np.int64)

        def run(lanes: np.ndarray, state: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
            for p in range(int(start.min(initial=CHUNK)), int(stop.max(initial=0))):
                on = np.flatnonzero((start <= p) & (p < stop) & (grid_t[p, lanes] >= 0))
                if len(on):
                    state[on], out[lanes[on], p] = self.follow(state[on], grid_t[p, lanes[on]])
            return state

        constant = np.flatnonzero(resets)
        exits[constant] = run(constant, np.zeros(len(constant), np.int64), head[constant], np.full(len(constant), CHUNK))
        # prefix scan of the state maps: the last chunk with a word end before each chunk
        last = np.maximum.accumulate(np.where(resets, np.arange(chunks), -1))
        before = np.concatenate([[-1], last[:-1]])
        distance = np.arange(chunks) - before  # 1: the chunk before has a word end; more: that many chunks of one word
        for d in range(1, int(distance.max()) + 1):
            lanes = np.flatnonzero(distance == d)
            entry = np.where(lanes > 0, exits[np.maximum(lanes - 1, 0)], 0)
            left = run(lanes, entry, np.zeros(len(lanes), np.int64), head[lanes])
            through = ~resets[lanes]
            exits[lanes[through]] = left[through]
        return out.reshape(-1)[:n]


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """0 white space, 1 letter, 2 number, 3 other, by code point."""
    out = np.full(0x110000, 3, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind in "LNZ":
            out[c] = {"L": 1, "N": 2, "Z": 0}[kind]
    out[[*range(9, 14), 0x85]] = 0
    return out


def symbols_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts in a row, and where each text's begin (with the end as last entry)."""
    points = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le"), np.uint32)
    starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
    kind = classes()[points]
    ahead = np.concatenate([kind[1:], [0]])
    end = (kind == 2) | ((kind == 1) | (kind == 3)) & (ahead != kind)
    quote = np.flatnonzero((points == 39) & (np.concatenate([[0], kind[:-1]]) != 3))
    if len(quote):
        padded = np.concatenate([points, [10, 10]])
        one, two = padded[quote + 1], padded[quote + 2]
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        end[quote[short | long]] = False
        end[quote[short] + 1] = True
        end[quote[long] + 1] = False
        end[quote[long] + 2] = True
    size = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
    to = np.cumsum(size)
    out = np.frombuffer("\n".join([*texts, ""]).encode(), np.uint8).astype(np.int64)
    out[to[end] - 1] += END
    keep = np.repeat(kind != 0, size)
    byte_starts = np.concatenate([[0], to])[starts]
    return out[keep], np.concatenate([[0], np.cumsum(keep)])[byte_starts]


@lru_cache(maxsize=1)
def transducer(path: str) -> Transducer:
    """One per worker process."""
    return Transducer(path)


def count_texts(texts: list[str | None], path: str) -> list[int]:
    """Tokens of each text, special strings inside texts counted as one token each."""
    machine = transducer(path)
    plain, extra = [], []
    for text in texts:
        text, n = text or "", 0
        if "<|" in text:
            for special in machine.special:
                n += text.count(special)
                text = text.replace(special, "\n")
        plain.append("\n".join(lowered(part) for part in text.split("\n")) if n else lowered(text))
        extra.append(n)
    symbols, starts = symbols_of(plain)
    total = np.concatenate([[0], np.cumsum(machine.emitted(symbols))])
    return (np.diff(total[starts]) + np.array(extra, np.int64)).tolist()


def count_tokens(docs: DataFrame, path: str, limit: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, n_bytes, n_tokens and over_limit (more than ``limit`` tokens)."""

    def run(batches):
        for batch in batches:
            for rows in text_batches(arrow_rows(batch, "k", "t")):
                counts = count_texts([t for _, t in rows], path)
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], kind), pa.array([len((t or "").encode()) for _, t in rows], pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())], names=[key, "n_bytes", "n_tokens", "over_limit"])

    of = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    kind = pa.int64()
    return of.select(F.col("k").cast("long").alias("k"), "t").mapInArrow(run, f"{key} long, n_bytes long, n_tokens long, over_limit boolean")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2048)
