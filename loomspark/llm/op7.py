"""SimHash near-dedup by anchor-point covering.

Fingerprints: lower-cased words, shingles of ``words`` words, XXH64 with seed 42; a bit is set if it is in over half of
the shingles' hashes. Distinct fingerprints are classes; everything below runs over classes, so copies cost nothing. A
component of classes is named by its smallest document.

Search for pairs with at most four differing bits: cut the 64 bits into three blocks; some block then differs in at most
one bit. A block's first 15 bits are covered by the perfect Hamming code (covering radius 1) and its other bits by all
their values (radius 0); an anchor is one codeword of that product code. A fingerprint's home is its nearest anchor. It
is replicated to every anchor that lies within covering radius plus threshold and can be the home of a fingerprint one
bit away (at most 22, 14 or 15 as a rule), so each linked pair meets at the home of either. At an anchor all members are
compared. An anchor with over ``TILE`` members is dealt to pairs of tiles, so no task holds more than two tiles of it.
Anchors of a fixed code gather more members as the corpus grows; so beyond ``MANY`` distinct fingerprints two blocks of
32 bits are covered instead, each by two Hamming codes and two free bits: 64 times the anchors, some block differs in at
most two bits, and a fingerprint has a few hundred replicas.

Links become one spanning forest per task and buffer before they are shuffled; components are found by distributed
rounds. Null and empty texts have fingerprint zero, which links like any other. Rows that repeat a key have the class
of their own text each. Rows with a null key link like any other; a component without any key is named null. An empty
table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import memo, similar
from .common import anew, arrow_rows, bit_table, components, cut, forest, table, unused, with_hits

BITS = 4
#: First bit and size of each block.
THREE = ((0, 22), (22, 21), (43, 21))
TWO = ((0, 32), (32, 32))
#: Distinct fingerprints above which two blocks with more anchors and replicas take less work than three.
MANY = 1 << 27
TILE = 2048
BUFFER = 50_000


def fingerprint(text: str | None, words: int) -> int:
    """Unsigned 64-bit."""
    import xxhash

    found = (text or "").encode().lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(words, len(found))
    hashed, n = xxhash.xxh64_intdigest, len(found) - k + 1
    totals = np.zeros(64, np.int64)
    for at in range(0, n, 50_000):
        to = min(n, at + 50_000)
        h = np.array([hashed(joined[s:e], 42) for s, e in zip(starts[at:to].tolist(), ends[at + k - 1 : to + k - 1].tolist())], "<u8")
        totals += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * totals > n, bitorder="little").view("<u8")[0])


def homes(value: np.ndarray, size: int) -> np.ndarray:
    """Nearest anchors of block values of ``size`` bits: each whole piece of 15 bits goes to its nearest Hamming codeword."""
    for first in range(0, size - 14, 15):
        syndrome = np.zeros_like(value)
        for i in range(15):
            syndrome ^= (value >> first + i & 1) * (i + 1)
        value = np.where(syndrome > 0, value ^ (1 << np.maximum(syndrome - 1, 0) + first), value)
    return value


def replicas(fp: np.ndarray, blocks: tuple = THREE) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor) of all replicas of unsigned fingerprints; an anchor's number holds its block."""
    rows, anchors = [], []
    for b, (first, size) in enumerate(blocks):
        value = (fp >> np.uint64(first) & np.uint64((1 << size) - 1)).astype(np.int64)
        flips = [sum(1 << i for i in bits) for n in range(BITS // len(blocks) + 1) for bits in combinations(range(size), n)]
        near = np.stack([homes(value ^ x, size) for x in flips], 1)
        near.sort(1)
        new = np.concatenate([np.ones((len(fp), 1), bool), near[:, 1:] != near[:, :-1]], 1)
        row, _ = np.nonzero(new)
        rows.append(row)
        anchors.append(near[new] | b << 40)
    return np.concatenate(rows), np.concatenate(anchors)


def linked(group: np.ndarray, fp: np.ndarray) -> list[tuple]:
    """A spanning forest, over signed fingerprints, of the links within equal values of the sorted ``group``."""
    pairs, name = [], fp.view(np.int64)
    begin = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    left = np.repeat(np.concatenate([begin[1:], [len(group)]]), np.diff(np.concatenate([begin, [len(group)]]))) - np.arange(len(group)) - 1
    rows, d = np.arange(len(group)), 0
    while len(rows := rows[left[rows] > d]):
        d += 1
        near = rows[np.bitwise_count(fp[rows] ^ fp[rows + d]) <= BITS]
        if len(near):
            pairs.append(np.stack([name[near], name[near + d]], 1))
    if not pairs:
        return []
    return forest(map(tuple, np.unique(np.concatenate(pairs), axis=0).tolist()))


def set_class(text: str | None, words: int) -> int:
    """Unsigned name of a text's set of shingles."""
    return similar.class_of(similar.shingles(text, words))


def fingerprints(docs: DataFrame, words: int, key: str = "doc_id", text: str = "text", of=fingerprint) -> DataFrame:
    """Checkpointed (key, fp); fp is the fingerprint, or what ``of`` gives, as a signed long."""

    def run(batches):
        memo.forget()
        for batch in batches:
            rows = [(k, of(t, words)) for k, t in arrow_rows(batch, "k", "t")]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int64()), pa.array(np.array([f for _, f in rows], "<u8").view("<i8"))], names=[key, "fp"])

    return cut(docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).mapInArrow(run, f"{key} long, fp long"))


def links(classes: DataFrame, blocks: tuple | None = None) -> DataFrame:
    """(a, b): a forest of links between the distinct fingerprints of ``classes`` (fp) that holds every connection.

    ``blocks``: how the bits are cut; by the number of classes where not given. The result is the same.
    """
    blocks = blocks or (THREE if classes.count() <= MANY else TWO)

    def replicate(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 8000):
                fp = batch.column(0).slice(at, 8000).to_numpy()
                row, anchor = replicas(fp.view(np.uint64), blocks)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(fp[row])], names=["anchor", "fp"])

    def compare(batches):
        kept: list[np.ndarray] = []

        def flush(rows):
            if len(rows):
                found = linked(np.cumsum(np.concatenate([[0], (rows[1:, :2] != rows[:-1, :2]).any(1)])), rows[:, 2].copy().view(np.uint64))
                if found:
                    a, b = zip(*found)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            kept.append(np.stack([batch.column(i).to_numpy() for i in range(3)], 1))
            if sum(map(len, kept)) >= BUFFER:
                rows = np.concatenate(kept)
                whole = np.flatnonzero((rows[1:, :2] != rows[:-1, :2]).any(1))
                at = int(whole[-1]) + 1 if len(whole) else 0  # the last group may go on
                yield from flush(rows[:at])
                kept = [rows[at:]]
        if kept:
            yield from flush(np.concatenate(kept))

    members = classes.select("fp").mapInArrow(replicate, "anchor long, fp long")
    hot = members.groupBy("anchor").count().where(F.col("count") > TILE).select("anchor", F.ceil(F.col("count") / TILE).cast("int").alias("tiles"))
    tile = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
    dealt = members.join(hot, "anchor", "left").withColumn("tile", F.coalesce(tile, F.lit(0)))
    # every pair of tiles, the own one with each; a tile alone is the pair of itself
    other = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("tiles"), F.lit(1)) - 1))
    dealt = dealt.select("anchor", "tile", "fp", "tiles", other.alias("other"))
    pair = F.least("tile", "other") * F.lit(1 << 24).cast("long") + F.greatest("tile", "other")
    dealt = dealt.select("anchor", pair.alias("pair"), "fp").repartition("anchor", "pair").sortWithinPartitions("anchor", "pair")
    return dealt.mapInArrow(compare, "a long, b long")


def classes_of(marked: DataFrame, key: str = "doc_id", groups: DataFrame | None = None) -> DataFrame:
    """Checkpointed (f, name, n, component, alone) of each fingerprint: its smallest key, its rows, its component's
    smallest fingerprint and whether nothing links with it. ``groups``: (node, component) in place of those by differing bits."""
    classes = cut(marked.groupBy("fp").agg(F.min(key).alias("name"), F.count("*").alias("n")))
    found = classes.join(components(links(classes)) if groups is None else groups, F.col("fp") == F.col("node"), "left")
    return cut(found.select(F.col("fp").alias("f"), "name", "n", F.coalesce("component", "fp").alias("component"), F.col("node").isNull().alias("alone")))


def near_duplicates(docs: DataFrame, words: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, fingerprint and component_id."""
    marked = fingerprints(docs, words, key, text)
    found = classes_of(marked, key)
    # the names are dealt anew, so that a large component's classes can be split
    names = found.groupBy("component").agg(F.min("name").alias("component_id")).select(anew(F.col("component")).alias("c"), "component_id")
    named = found.join(names, F.col("component") == F.col("c")).select("f", "component_id")
    return marked.join(named, F.col("fp") == F.col("f")).select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, words: int = 4, key: str = "doc_id", text: str = "text", similarity: tuple[int, int] | None = None) -> DataFrame:
    """One row of ``docs`` of each component: its smallest key's, of rows that repeat it the smallest fingerprint's.

    A component whose keys are all null keeps one of its rows. ``similarity``: two integers whose ratio is the least
    Jaccard similarity of linked sets of shingles, in place of four differing bits: what fingerprints and anchors join is
    then confirmed by whole sets, and the links that four bits leave apart are found exactly (``similar``).

    Whole rows are shuffled only where they may go: keys of rows that share their component with others set bits of a
    table of bounded size, and rows without a set bit stay as they are. With more such keys than the table holds more
    rows take the exact way, which is right for all.
    """
    of = set_class if similarity else fingerprint
    marked = fingerprints(docs, words, key, text, of)
    found = classes_of(marked, key, similar.groups_of(docs, lambda prints: components(links(prints)), words, *similarity, text=text) if similarity else None)
    # of each component the class with its smallest key; ties by fingerprint
    first = found.groupBy("component").agg(F.min(F.struct(F.col("name").isNull(), "name", "f")).alias("x"))
    k, f, own, hit = (unused(docs, n) for n in ("chosen_key", "chosen_fp", "own_fp", "may_go"))
    chosen = cut(first.select(F.col("x.f").alias(f), F.col("x.name").alias(k)))
    shared = marked.join(found.where("not alone or n > 1").select("f"), F.col("fp") == F.col("f"), "left_semi").where(F.col(key).isNotNull())
    split_docs = with_hits(docs, F.col(key).cast("long"), bit_table(shared.select(key), key), hit)
    clear, maybe = split_docs.where(~F.col(hit)).drop(hit), split_docs.where(F.col(hit)).drop(hit)
    # a key of one row needs no look at the text; rows of the few others are told apart by their fingerprints
    often = marked.groupBy(F.col(key).alias("often")).count().where("count > 1").select("often")
    split = cut(chosen.join(often, F.col(k).eqNullSafe(F.col("often")), "left").select(f, k, (F.col("often").isNotNull() | F.col(k).isNull()).alias("is_often")))
    same = F.col(key).cast("long").eqNullSafe(F.col(k))
    once = clear.unionByName(maybe.join(split.where("not is_often").select(k), same, "left_semi"))
    if split.where("is_often").isEmpty():
        return once

    @F.arrow_udf("long")
    def print_of(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([of(t, words) for t in texts.to_pylist()], "<u8").view("<i8"))

    again = maybe.join(split.where("is_often").select(k), same, "left_semi").withColumn(own, print_of(F.col(text)))
    again = again.join(split.where("is_often").select(k, f), same & (F.col(own) == F.col(f)), "left_semi")
    return once.unionByName(again.dropDuplicates([key, own]).drop(own))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
