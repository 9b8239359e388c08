"""Token-id output by an adaptive context-mixing range coder.

Format. A file row holds one *group*: whole documents in a row, about ``GROUP`` ids. Its payload is a header (magic,
counts, the documents' keys and lengths, deflated), then the sizes and CRC-32 checksums of its blocks of ``BLOCK`` ids,
then the blocks' 16-bit words. Every block starts from the same fresh model, so blocks decode independently, and a
damaged one is found by its checksum. The rows lie in Parquet files, which Spark's commit protocol writes to any store
that Spark reaches, safe against lost executors and repeated tasks.

Model, for each block. The last id that followed the same two ids (order 2) and the same one id (order 1) are
candidates. Whether a candidate is right is a binary choice; its probability mixes what all three orders say of it in
the logistic domain, with weights that learn online: adaptive estimates by the candidate's order-2 confidence and by its
order-1 confidence (none, where that order has another candidate), and by how often it came so far at all (order 0),
beside one by no context. An id that no candidate gives is coded by order 0 alone: four 16-way digits with adaptive
counts, each in the context of the digits before it. All arithmetic is in integers, so every machine decodes alike.

Two programs of the same coder write the same bytes and read each other's. Spark's tasks use the one in ``TokenIds.java``,
one id after another: texts are cut into ids in Python, and blocks are coded, decoded and checked in the JVM. The one here
needs no Spark. Python is too slow for one id at a time, so in it all blocks of a group advance together, one id per step,
with NumPy over blocks. Carries of the range coder are added to words already written and settled at the end.

Null and empty texts are documents of the end id alone. Repeated keys keep their rows, next to one another. An empty
table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_rows, cut, remove, shared_dir, table
from .jvm import function
from .memo import remembered

MAGIC = b"LMX1"
BLOCK = 2048
GROUP = 3_000_000
SLOTS = 1 << 10
STEP, MOST = 24, 1 << 12  # of a digit's adaptive counts
ONES = 0x0001000100010001

_squash = np.array([int(4096 / (1 + np.exp(-x / 256.0))) for x in range(-2048, 2048)], np.int64).clip(32, 4064)
_stretch = np.searchsorted(_squash, np.arange(4096)).clip(1, 4095).astype(np.int64) - 2048


class Coder:
    """Range coders of all blocks side by side; with ``words`` given they decode."""

    def __init__(self, lanes: int, words: np.ndarray | None = None):
        self.range = np.full(lanes, 1 << 32, np.int64)
        self.low = np.zeros(lanes, np.int64)
        self.at = np.zeros(lanes, np.int64)
        self.words = words
        if words is None:
            self.out = np.zeros((lanes, 2048), np.int64 if lanes < 64 else np.int32)
        else:
            self.low = words[:, 0].astype(np.int64) << 16 | words[:, 1]  # the code less the coder's low end
            self.at += 2

    def narrow(self, lane: np.ndarray, r: np.ndarray, lo: np.ndarray, f: np.ndarray) -> None:
        """Keeps [lo, lo + f) of the range in units of r."""
        if self.words is None:
            low = self.low.take(lane) + r * lo
            if len(over := (low >> 32).nonzero()[0]):
                self.out[lane[over], self.at[lane[over]] - 1] += 1
                low &= 0xFFFFFFFF
        else:
            low = self.low.take(lane) - r * lo
        span = r * f
        if len(small := (span < 1 << 16).nonzero()[0]):
            where, part = lane.take(small), low.take(small)
            at = self.at.take(where)
            if self.words is None:
                if int(at.max()) + 4 >= self.out.shape[1]:
                    self.out = np.concatenate([self.out, np.zeros_like(self.out)], 1)
                self.out[where, at] = part >> 16
                low[small] = (part & 0xFFFF) << 16
            else:
                low[small] = part << 16 | self.words[where, at]
            self.at[where] = at + 1
            span[small] <<= 16
        self.low[lane], self.range[lane] = low, span

    def bit(self, lane: np.ndarray, p: np.ndarray, bit: np.ndarray | None) -> np.ndarray:
        """p: of a set bit, in 4096ths."""
        r = self.range.take(lane) >> 12
        if bit is None:
            bit = self.low.take(lane) < r * p
        self.narrow(lane, r, np.where(bit, 0, p), np.where(bit, p, 4096 - p))
        return bit

    def digit(self, lane: np.ndarray, counts: np.ndarray, row: np.ndarray, digit: np.ndarray | None) -> np.ndarray:
        """One of 16; counts: rows of 16, which adapt, as four words of four 16-bit numbers, the first one lowest.

        A word times ``ONES`` holds the sums of its numbers from the first on, since none is beyond ``MOST``."""
        own, each, n = counts.take(row, 0), np.arange(len(row)), len(row)
        sums = own * ONES
        ends = np.empty((4, n), np.int64)
        np.right_shift(sums.T, 48, out=ends)
        for k in (1, 2, 3):
            ends[k] += ends[k - 1]
        total = ends[3]
        r = self.range.take(lane) // total
        if digit is None:
            goal = np.minimum(self.low.take(lane) // r, total - 1)
            word = (ends[:3] <= goal).sum(0)
        else:
            word = digit >> 2
        place = each * 4 + word
        before = np.where(word > 0, ends.reshape(-1).take((word - 1) * n + each), 0)
        sums = sums.reshape(-1).take(place)
        if digit is None:
            goal -= before
            inside = ((sums & 0xFFFF) <= goal).astype(np.int64) + ((sums >> 16 & 0xFFFF) <= goal) + ((sums >> 32 & 0xFFFF) <= goal)
            digit = word * 4 + inside
        else:
            inside = digit & 3
        shift = inside * 16
        f = own.reshape(-1).take(place) >> shift & 0xFFFF
        self.narrow(lane, r, before + (sums >> shift & 0xFFFF) - f, f)
        counts.reshape(-1)[row * 4 + word] += STEP << shift
        if len(full := (total > MOST - STEP).nonzero()[0]):
            numbers, rows = counts.view(np.int16), row.take(full)
            numbers[rows] = numbers[rows] + 1 >> 1
        return digit

    def finish(self) -> list[np.ndarray]:
        lanes = np.arange(len(self.low))
        for shift in (16, 0):
            if int(self.at.max()) + 2 >= self.out.shape[1]:
                self.out = np.concatenate([self.out, np.zeros_like(self.out)], 1)
            self.out[lanes, self.at] = self.low >> shift & 0xFFFF
            self.at += 1
        carry = np.zeros(len(lanes), self.out.dtype)
        for p in range(int(self.at.max()) - 1, -1, -1):
            full = self.out[:, p] + carry
            self.out[:, p], carry = full & 0xFFFF, full >> 16
        return [row[:n].astype("<u2") for row, n in zip(self.out, self.at)]


class Mixer:
    """Adaptive probability that a candidate is right, for each lane: four inputs, each by a context of its own."""

    def __init__(self, lanes: int):
        self.p = np.full((lanes * 4, 8), 1024, np.int64)
        self.w = np.full((lanes, 4), 20 << 10, np.int64)

    def code(self, coder: Coder, lane: np.ndarray, contexts: np.ndarray, bit: np.ndarray | None) -> np.ndarray:
        """contexts: a row of four, each below 8."""
        place = (lane * 32)[:, None] + _inputs + contexts
        flat, w = self.p.reshape(-1), self.w.take(lane, 0)
        x = flat.take(place)
        s = _stretch.take(x)
        p = _squash.take(np.minimum(np.maximum(np.einsum("ij,ij->i", s, w) >> 16, -2048), 2047) + 2048)
        bit = coder.bit(lane, p, bit)
        goal = bit.astype(np.int64) * 4095
        self.w[lane] = np.minimum(np.maximum(w + (s * (goal - p)[:, None] >> 9), -(1 << 18)), 1 << 18)
        flat[place] = x + (goal[:, None] - x >> 4)
        return bit


_inputs = np.arange(4) * 8


def _code(lengths: np.ndarray, ids: np.ndarray | None, words: np.ndarray | None):
    """Encodes ids[lane, step], or decodes; the same model drives both."""
    lanes, coder = len(lengths), Coder(len(lengths), words)
    two, one = Mixer(lanes), Mixer(lanes)
    next2, next1 = np.full(lanes * SLOTS, -1, np.int32), np.full(lanes * SLOTS, -1, np.int32)
    sure2, sure1 = np.zeros(lanes * SLOTS, np.int8), np.zeros(lanes * SLOTS, np.int8)
    often = np.zeros(lanes * SLOTS, np.int16)  # order 0: how often ids of a slot came
    digits = np.full((lanes * (1 + 16 + 256 + 256), 4), ONES, np.int64)
    steps = None if ids is None else np.ascontiguousarray(ids.T)
    out = np.zeros((int(lengths.max()), lanes), np.int64) if ids is None else None
    a, b = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
    for step in range(int(lengths.max())):
        lane = (lengths > step).nonzero()[0]
        known = None if ids is None else steps[step].take(lane)
        before, slots = b.take(lane), lane * SLOTS
        h1 = slots + (before * 40503 >> 4 & SLOTS - 1)
        h2 = slots + (a.take(lane) * 2654435761 + before * 40503 >> 5 & SLOTS - 1)
        c2, c1 = next2.take(h2).astype(np.int64), next1.take(h1).astype(np.int64)
        s2, s1 = sure2.take(h2).astype(np.int64), sure1.take(h1).astype(np.int64)
        found = np.full(len(lane), -1, np.int64)
        for mixer, c, may in ((two, c2, c2 >= 0), (one, c1, (c1 >= 0) & (c1 != c2))):
            if len(ask := (may & (found < 0)).nonzero()[0]):
                on, own = lane.take(ask), c.take(ask)
                contexts = np.zeros((len(ask), 4), np.int64)
                contexts[:, 0] = np.where(own == c2.take(ask), s2.take(ask) + 1, 0)
                contexts[:, 1] = np.where(own == c1.take(ask), s1.take(ask) + 1, 0)
                contexts[:, 2] = _rarity.take((often.take(slots.take(ask) + (own & SLOTS - 1)).astype(np.int64) << 11) // (step + 1))
                right = mixer.code(coder, on, contexts, None if known is None else known.take(ask) == own)
                found[ask[right]] = own[right]
        if len(rest := (found < 0).nonzero()[0]):
            on = lane.take(rest)
            base, own = on * 529, None if known is None else known.take(rest)
            d = [None] * 4 if own is None else [own >> k & 15 for k in (12, 8, 4, 0)]
            d0 = coder.digit(on, digits, base, d[0])
            d1 = coder.digit(on, digits, base + 1 + d0, d[1])
            d2 = coder.digit(on, digits, base + 17 + d0 * 16 + d1, d[2])
            d3 = coder.digit(on, digits, base + 273 + d1 * 16 + d2, d[3])
            found[rest] = d0 << 12 | d1 << 8 | d2 << 4 | d3
        for table_, sure, h, c, s in ((next2, sure2, h2, c2, s2), (next1, sure1, h1, c1, s1)):
            right = c == found
            swap = ~right & (s == 0)
            moved = swap.nonzero()[0]
            table_[h.take(moved)] = found.take(moved)
            sure[h] = np.where(right, np.minimum(s + 1, 3), np.maximum(s - 1, 0) * ~swap)
        often[slots + (found & SLOTS - 1)] += 1
        a[lane], b[lane] = before, found
        if out is not None:
            out[step, lane] = found
    return coder.finish() if words is None else out.T


#: Share of an id's slot so far, in 2048ths -> context: its order of magnitude.
_rarity = np.array([min(7, max(0, int(x).bit_length() - 1)) for x in range((1 << 11) + 1)], np.int64)


def encode_ids(ids: np.ndarray) -> bytes:
    """Blocks of ids below 65536: their number, then of each the ids, words and checksum, then all words."""
    n = len(ids)
    lengths = np.full(-(-n // BLOCK), BLOCK, np.int64)
    if not n:
        return struct.pack("<I", 0)
    lengths[-1] = n - BLOCK * (len(lengths) - 1)
    grid = np.zeros(len(lengths) * BLOCK, np.int64)
    grid[:n] = ids
    if int(ids.max()) > 0xFFFF:
        raise ValueError("ids of more than 16 bits")
    grid = grid.reshape(-1, BLOCK)
    words = _code(lengths, grid, None)
    heads = np.array([(m, len(w), zlib.crc32(row[:m].astype("<u4").tobytes())) for m, w, row in zip(lengths, words, grid)], "<u4")
    return struct.pack("<I", len(lengths)) + heads.tobytes() + b"".join(w.tobytes() for w in words)


def decode_ids(data: bytes) -> np.ndarray:
    """Raises ValueError where a block's checksum is not that of its ids."""
    (blocks,) = struct.unpack_from("<I", data)
    if not blocks:
        return np.zeros(0, "<u4")
    heads = np.frombuffer(data, "<u4", 3 * blocks, 4).reshape(-1, 3).astype(np.int64)
    flat = np.frombuffer(data, "<u2", offset=4 + 12 * blocks)
    grid, at = np.zeros((blocks, int(heads[:, 1].max()) + 4), np.int64), 0
    for k, size in enumerate(heads[:, 1]):
        grid[k, :size] = flat[at : at + size]
        at += size
    out = _code(heads[:, 0], None, grid)
    parts = [row[:n].astype("<u4") for row, n in zip(out, heads[:, 0])]
    for k, (part, crc) in enumerate(zip(parts, heads[:, 2])):
        if zlib.crc32(part.tobytes()) != crc:
            raise ValueError(f"block {k} is damaged")
    return np.concatenate(parts)


def group_head(keys: list[int | None], sizes: list[int]) -> bytes:
    """What lies before a group's blocks."""
    known = np.array([k is not None for k in keys], "u1")
    head = zlib.compress(known.tobytes() + np.array([k or 0 for k in keys], "<i8").tobytes() + np.array(sizes, "<u8").tobytes())
    return MAGIC + struct.pack("<II", len(keys), len(head)) + head


def narrow_ids(ids: list[bytes]) -> bytes:
    """Ids of four bytes as unsigned 16-bit numbers."""
    whole = np.frombuffer(b"".join(ids), "<u4")
    if len(whole) and int(whole.max()) > 0xFFFF:
        raise ValueError("ids of more than 16 bits")
    return whole.astype("<u2").tobytes()


def pack_group(keys: list[int | None], ids: list[bytes]) -> bytes:
    """A group's payload, as Spark's tasks make it of ``group_head`` and the JVM's coder."""
    return group_head(keys, [len(x) // 4 for x in ids]) + encode_ids(np.frombuffer(narrow_ids(ids), "<u2").astype(np.int64))


def unpack_group(payload: bytes) -> Iterator[tuple[int | None, np.ndarray]]:
    """Key and ids of each document."""
    if payload[:4] != MAGIC:
        raise ValueError("not a group of this format")
    n, size = struct.unpack_from("<II", payload, 4)
    head = zlib.decompress(payload[12 : 12 + size])
    known, keys, lengths = np.frombuffer(head, "u1", n), np.frombuffer(head, "<i8", n, n), np.frombuffer(head, "<u8", n, 9 * n)
    ids, at = decode_ids(payload[12 + size :]), 0
    for k, here, m in zip(keys.tolist(), known.tolist(), lengths.tolist()):
        yield (k if here else None), ids[at : at + m]
        at += m


def write_ids(docs: DataFrame, path: str, vocabulary: str, kind: str = "byte", end_id: int = 0, key: str = "doc_id", text: str = "text") -> None:
    """Encodes whole texts, adds ``end_id`` to each and writes groups in ascending key order: part, number, n_ids, payload."""

    def run(batches):
        own, end, part, number = remembered(vocabulary, kind), np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId(), 0
        keys, ids, size = [], [], 0

        def group():
            row = part, number, size, group_head(keys, [len(x) // 4 for x in ids]), narrow_ids(ids)
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=["part", "number", "n_ids", "head", "ids"])

        for batch in batches:
            for k, t in arrow_rows(batch, "k", "t"):
                keys.append(k)
                ids.append(own.ids(t) + end)
                size += len(ids[-1]) // 4
                if size >= GROUP:
                    yield group()
                    keys, ids, size, number = [], [], 0, number + 1
        if keys:
            yield group()

    # rows that share a key, or have none, may lie in several partitions, one behind the other
    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"), F.xxhash64(text).alias("h")).repartitionByRange("k", "h").sortWithinPartitions("k", "h")
    groups = rows.mapInArrow(run, "part int, number long, n_ids long, head binary, ids binary")
    groups.select("part", "number", "n_ids", F.concat("head", function(docs.sparkSession, "TokenIds", "Encode", "binary", "ids")).alias("payload")).write.parquet(path)


def read_documents(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """Decodes files of ``write_ids``: key, start (ids of all documents before), n_tokens, ids_crc32."""

    files = spark.read.schema("part int, number long, n_ids long, payload binary").parquet(path)
    # one row for each task of the writer, then one for each group of a task
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    earlier = Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    groups = files.select("part", "number", "n_ids").withColumn("inside", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0)))
    base = groups.join(parts.select("part", "before"), "part").select("part", "number", (F.col("before") + F.col("inside")).alias("base"))
    found = function(spark, "TokenIds", "Decode", f"array<struct<{key}: bigint, inner: bigint, n_tokens: bigint, ids_crc32: bigint>>", "payload")
    rows = files.select("part", "number", F.inline(found))
    return rows.join(base, ["part", "number"]).select(key, (F.col("base") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")


def op10_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = f"{shared_dir(spark)}/token-ids-{uuid.uuid4().hex}"
    write_ids(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    rows = cut(read_documents(spark, path))
    remove(spark, path)
    return rows
