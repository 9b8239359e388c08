"""Best-fit packing planned over a histogram of lengths.

1. One pass over the texts gives each document's token ids (with the end id) and cuts only those over the limit. Only
   narrow rows leave it: key, piece, start, length, checksum, the task's number and the row's number among this task's
   rows of the same length. They are checkpointed, so these numbers never change afterwards.
2. The histogram has at most ``limit`` lengths; it is the only thing that the driver sees. Best-fit decreasing runs over
   its counts: bins in the same state are one group, and a placement of many equal pieces is one *run* of ranks.
3. A piece's rank within its length is its number within its task plus the counts of earlier tasks (a window over
   tasks, not rows, so a length that holds a third of all rows needs no sorting in one place). Its slot is found by
   joining (length, rank) with the runs, whose number is bounded by the limit and not by the data.

Null and empty texts are documents of the end id alone. Repeated rows are packed once each. An empty table gives no
rows. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_rows, cut, table
from .memo import MOST, remembered


def plan_runs(histogram: dict[int, int], limit: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts: (length, first rank, ranks, first bin, offset), a run for each placement.

    Every bin of a run gets one piece; bins are numbered from 0.
    """
    runs, bins, free = [], 0, []  # free: sorted remaining sizes that have groups
    groups: dict[int, list[tuple[int, int]]] = {}

    def put(room: int, first: int, n: int) -> None:
        if n and room:
            if room not in groups or not groups[room]:
                insort(free, room)
            groups.setdefault(room, []).append((first, n))

    def fill(first: int, n: int, each: int, length: int, rank: int, offset: int) -> int:
        for k in range(each):
            runs.append((length, rank, n, first, offset + k * length))
            rank += n
        return rank

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect_left(free, length)
            if at == len(free):
                room, first, have = limit, bins, -(-left // (limit // length))
                bins += have
            else:
                room = free[at]
                first, have = groups[room].pop()
                if not groups[room]:
                    del free[at]
            each = room // length
            full = min(have, left // each)
            rank = fill(first, full, each, length, rank, limit - room)
            put(room - each * length, first, full)
            left -= full * each
            rest = min(left, each) if full < have else 0
            if rest:
                rank = fill(first + full, 1, rest, length, rank, limit - room)
                put(room - rest * length, first + full, 1)
                left -= rest
                full += 1
            put(room, first + full, have - full)
    return runs


def tokenized_pieces(docs: DataFrame, path: str, kind: str, end_id: int, limit: int, key: str = "doc_id", text: str = "text", most: int = MOST) -> DataFrame:
    """Checkpointed narrow rows of all pieces, with the task's number and the number among its rows of that length.

    ``most``: bounds the ids that a worker remembers; the result is the same."""

    def run(batches):
        own, end = remembered(path, kind, most), np.array([end_id], "<u4").tobytes()
        seen = np.zeros(limit + 1, np.int64)
        for batch in batches:
            out: list[tuple] = []
            for part, k, t in arrow_rows(batch, "part", "k", "t"):
                ids = own.ids(t) + end
                for piece, at in enumerate(range(0, len(ids) // 4, limit)):
                    own_ids = ids[4 * at : 4 * (at + limit)]
                    n = len(own_ids) // 4
                    out.append((k, piece, at, n, zlib.crc32(own_ids), part, int(seen[n])))
                    seen[n] += 1
            if out:
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(zip(*out), kinds)], names=[key, "piece", "start", "length", "ids_crc32", "part", "number"])

    rows = docs.select(F.spark_partition_id().alias("part"), F.col(key).cast("long").alias("k"), F.col(text).alias("t"))
    return cut(rows.mapInArrow(run, f"{key} long, piece int, start long, length long, ids_crc32 long, part int, number long"))


def pack(pieces: DataFrame, limit: int, key: str = "doc_id") -> DataFrame:
    """Places rows of ``tokenized_pieces``."""
    spark = pieces.sparkSession
    counts = cut(pieces.groupBy("length", "part").agg((F.max("number") + 1).alias("n")))
    histogram = dict(counts.groupBy("length").agg(F.sum("n")).collect())  # at most `limit` rows
    runs = sorted(plan_runs(histogram, limit))
    span = 1 << 44  # more than the pieces of one length
    starts = np.array([r[0] * span + r[1] for r in runs], np.int64)
    offset, bin_base = np.array([r[4] for r in runs], np.int64), np.array([r[3] for r in runs], np.int64)
    plan = spark.sparkContext.broadcast((starts, offset, bin_base))

    def place(batches):
        starts, offset, bin_base = plan.value
        for batch in batches:
            at = batch.column(batch.schema.get_field_index("length")).to_numpy() * span + batch.column(batch.schema.get_field_index("rank")).to_numpy()
            run = np.searchsorted(starts, at, "right") - 1
            names = [key, "piece", "start", "length", "ids_crc32"]
            columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(bin_base[run] + at - starts[run]), pa.array(offset[run])], names=[*names, "sequence_id", "offset"])

    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(F.col("length").alias("l"), F.col("part").alias("p"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = pieces.join(base, (F.col("length") == F.col("l")) & (F.col("part") == F.col("p"))).withColumn("rank", F.col("number") + F.col("before"))
    return ranked.select(key, "piece", "start", "length", "ids_crc32", "rank").mapInArrow(place, f"{key} long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, kind: str = "word", end_id: int = 1, limit: int = 4096, key: str = "doc_id", text: str = "text", most: int = MOST) -> DataFrame:
    """One row per piece: key, piece, start, length, ids_crc32, sequence_id and offset."""
    return pack(tokenized_pieces(docs, path, kind, end_id, limit, key, text, most), limit, key)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
