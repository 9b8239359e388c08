"""Links between texts whose sets of shingles have a Jaccard similarity of at least ``num`` / ``den``, found exactly.

Shingles are runs of ``words`` lower-cased words, compared by XXH64 with seed 42; a shorter text is one shingle. Equal
sets are one class, named by a hash of the sorted set; null and empty texts are the class of the empty set.

Candidates by SimHash: classes whose fingerprints the given search joins are looked at along their list by fingerprint,
each with its ``WINDOW`` next ones. Sets of a similarity of 0.8 often differ in ten bits, so the pairs that this leaves
are found exactly, by prefix filter: of shingles in one order for all sets, sets of such a similarity share one of their first
n - ceil(n * num / den) + 1. Frequent shingles come last, so that few sets meet at them; which ones count as frequent is
estimated on every ``EVERY``-th text and changes the work only, not the result. Sizes and places of a shared shingle
bound the overlap from above and rule out more, as do parities: two sets differ in at least as many shingles as in bits
of a table that every shingle flips one bit of. Candidates are confirmed by their whole sets.

A shingle's sets are compared in two passes: each with its ``WINDOW`` next ones, confirmed together with the candidates by
SimHash; then, at shingles of more sets, all that the confirmed links leave in different components, dealt to pairs of tiles, where parities are looked at before a
pair leaves its task. So a large group of near copies is
joined by its neighbours, and not by all of its pairs. Links of the second pass join components of the first.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import memo
from .common import arrow_rows, components, cut, release

EVERY, OFTEN, MOST = 8, 2, 200_000
WINDOW, TILE = 2, 2048
#: Earlier shingles that a class's row names.
BEFORE = 8
BUFFER = 50_000
#: Positions of the filter that keeps sets of no candidate from being dealt; others pass it by chance and are not joined.
POSITIONS = 1 << 24


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted, distinct."""
    import xxhash

    found = (text or "").encode().lower().split()
    if not found:
        return np.zeros(0, np.int64)
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k, hashed = min(words, len(found)), xxhash.xxh64_intdigest
    return np.unique(np.fromiter((hashed(joined[s:e], 42) for s, e in zip(starts[: len(found) - k + 1].tolist(), ends[k - 1 :].tolist())), np.uint64)).view(np.int64)


def class_of(own: np.ndarray) -> int:
    """Name of a set, unsigned."""
    import xxhash

    return xxhash.xxh64_intdigest(own.tobytes(), 42)


def fingerprint_of(hashes: np.ndarray) -> int:
    """SimHash of 64-bit hashes, unsigned: a bit is set if it is in over half of them."""
    totals = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 50_000):
        totals += np.unpackbits(hashes[at : at + 50_000].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * totals > len(hashes), bitorder="little").view("<u8")[0])


def chained(listed: DataFrame) -> DataFrame:
    """(a, b), a < b: each class with its ``WINDOW`` next ones of the same group. listed: (g, fp, c).

    The list is cut by ranges, so a large group takes many tasks; pairs across two of them are not given.
    """

    def run(batches):
        last = np.zeros((0, 2), np.int64)
        for batch in batches:
            rows = np.concatenate([last, np.stack([batch.column(i).to_numpy() for i in (0, 2)], 1)])
            pairs = [np.zeros((0, 2), np.int64)]
            for d in range(1, WINDOW + 1):
                i = np.arange(max(0, len(last) - d), len(rows) - d)
                i = i[rows[i, 0] == rows[i + d, 0]]
                pairs.append(np.sort(np.stack([rows[i, 1], rows[i + d, 1]], 1), axis=1))
            yield as_batch(np.concatenate(pairs), ["a", "b"])
            last = rows[-WINDOW:]

    return listed.repartitionByRange("g", "fp", "c").sortWithinPartitions("g", "fp", "c").mapInArrow(run, "a long, b long")


def parities(own: np.ndarray) -> bytes:
    """A bit for each residue of the set's shingles: whether their number is odd. At least two bits per shingle, a power of two."""
    size = max(64, 1 << (2 * len(own) - 1).bit_length())
    return np.packbits(np.bincount(own & (size - 1), minlength=size) & 1, bitorder="little").tobytes()


def may_be(x: bytes, y: bytes, n: int, m: int, num: int, den: int) -> bool:
    """Whether parities admit the similarity of sets of n and m shingles; the longer table folds to the shorter's residues."""
    x, y = (np.frombuffer(b, np.uint64) for b in (x, y))
    least = min(len(x), len(y))
    x, y = (np.bitwise_xor.reduce(b.reshape(-1, least), axis=0) for b in (x, y))
    return int(np.bitwise_count(x ^ y).sum()) * (num + den) <= (den - num) * (n + m)


def admitted(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray, tables: list[bytes], num: int, den: int) -> np.ndarray:
    """``may_be`` of many pairs: x and y are places in ``tables``, n and m the sets' sizes."""
    words = np.array([len(t) // 8 for t in tables], np.int64)
    x, y, n, m = (np.where(words[x] >= words[y], p, q) for p, q in ((x, y), (y, x), (n, m), (m, n)))
    out = np.zeros(len(x), bool)
    for long, short in {*zip(words[x].tolist(), words[y].tolist())}:
        at = np.flatnonzero((words[x] == long) & (words[y] == short))
        step = max(1, (1 << 20) // long)
        for k in range(0, len(at), step):
            part = at[k : k + step]
            own, other = (np.frombuffer(b"".join(tables[i] for i in z[part].tolist()), np.uint64) for z in (x, y))
            folded = np.bitwise_xor.reduce(own.reshape(-1, long // short, short), axis=1)
            apart = np.bitwise_count(folded ^ other.reshape(-1, short)).sum(1, dtype=np.int64)
            out[part] = apart * (num + den) <= (den - num) * (n[part] + m[part])
    return out


def first_ones(own: np.ndarray, often: np.ndarray, rank: np.ndarray, num: int, den: int) -> np.ndarray:
    """The set's first shingles. often: frequent shingles, sorted; rank: of each, the most frequent has the highest."""
    n = len(own)
    at = np.searchsorted(often, own)
    at[at == len(often)] = 0
    order = np.where(often[at] == own, rank[at] + 1, 0) if len(often) else np.zeros(n, np.int64)
    return own[np.argsort(order, kind="stable")][: n - -(-n * num // den) + 1]


def frequent(docs: DataFrame, words: int, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Estimated: frequent shingles, sorted; their ranks; their numbers of sets."""

    def run(batches):
        memo.forget()
        for batch in batches:
            for (t,) in arrow_rows(batch, "t"):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(t, words))], names=["s"])

    some = docs.select(F.col(text).alias("t")).where(F.pmod(F.xxhash64("t"), F.lit(EVERY)) == 0).distinct()
    counts = some.mapInArrow(run, "s long").groupBy("s").count().where(F.col("count") >= OFTEN)
    got = counts.orderBy(F.desc("count"), "s").limit(MOST).toArrow()
    s, n = (got.column(i).to_numpy().astype(np.int64) for i in (0, 1))
    order = np.lexsort((s, n))
    s, n = s[order], n[order]
    by = np.argsort(s)
    return s[by], by.astype(np.int64), n[by] * EVERY


def possible(rows: np.ndarray, other: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether the sizes and places (columns 3 and 4) of a shared shingle admit the similarity."""
    n, i, m, j = rows[:, 3], rows[:, 4], other[:, 3], other[:, 4]
    most = np.minimum(i, j) + 1 + np.minimum(n - 1 - i, m - 1 - j)
    return most * (num + den) >= num * (n + m)


def whole_groups(batches, columns: int):
    """Arrays of about ``BUFFER`` rows that hold whole groups of equal first two columns, of batches sorted by them."""
    kept: list[np.ndarray] = []
    for batch in batches:
        kept.append(np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(columns)], 1))
        if sum(map(len, kept)) >= BUFFER:
            rows = np.concatenate(kept)
            ends = np.flatnonzero((rows[1:, :2] != rows[:-1, :2]).any(1))
            at = int(ends[-1]) + 1 if len(ends) else 0  # the last group may go on
            if at:
                yield rows[:at]
            kept = [rows[at:]]
    if kept and len(rows := np.concatenate(kept)):
        yield rows


def groups(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row: its group's size and the number of rows behind it in the group."""
    begin = np.flatnonzero(np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(1)]))
    size = np.diff(np.concatenate([begin, [len(rows)]]))
    return np.repeat(size, size), np.repeat(begin + size, size) - np.arange(len(rows)) - 1


def as_batch(rows: np.ndarray, names: list[str]):
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[:, i])) for i in range(len(names))], names=names)


def confirmed(docs: DataFrame, tables: DataFrame, pairs: DataFrame, words: int, num: int, den: int, text: str) -> DataFrame:
    """Checkpointed: of the distinct ``pairs`` (a, b) of classes those of the similarity. tables: (c, size, odd)."""

    def sieve(batches):
        for batch in batches:
            a, b, n, m, x, y = (c.to_pylist() for c in batch.columns)
            keep = [may_be(*r, num, den) for r in zip(x, y, n, m)]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    left, right = (tables.select(F.col("c").alias(f"c{s}"), F.col("size").alias(f"n{s}"), F.col("odd").alias(f"o{s}")) for s in "ab")
    joined = pairs.join(left, F.col("a") == F.col("ca")).join(right, F.col("b") == F.col("cb")).select("a", "b", "na", "nb", "oa", "ob")
    pairs = cut(joined.mapInArrow(sieve, "a long, b long"))
    place = F.col("n").bitwiseAND(F.lit(POSITIONS - 1))
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("n")).select(place.alias("p"))
    filled = np.zeros(POSITIONS // 64, np.int64)
    table_ = nodes.groupBy(F.shiftright("p", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(p & 63 as int)))").alias("x")).toArrow()
    filled[table_.column(0).to_numpy()] = table_.column(1).to_numpy()
    filled = filled.view(np.uint64)

    def sets(batches):
        memo.forget()
        for batch in batches:
            names, own = [], []
            for (t,) in arrow_rows(batch, "t"):
                s = shingles(t, words)
                c = class_of(s)
                p = c % POSITIONS
                if int(filled[p >> 6]) >> (p & 63) & 1:
                    names.append(c)
                    own.append(s.tobytes())
                if len(own) >= 256:
                    yield pa.RecordBatch.from_arrays([pa.array(np.array(names, np.uint64).view(np.int64)), pa.array(own, pa.binary())], names=["c", "own"])
                    names, own = [], []
            if own:
                yield pa.RecordBatch.from_arrays([pa.array(np.array(names, np.uint64).view(np.int64)), pa.array(own, pa.binary())], names=["c", "own"])

    def check(batches):
        for batch in batches:
            a, b = [], []
            for at in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(i)[at].as_buffer(), np.int64) for i in (2, 3))
                both = len(np.intersect1d(x, y, assume_unique=True))
                if both * (num + den) >= num * (len(x) + len(y)):
                    a.append(batch.column(0)[at].as_py())
                    b.append(batch.column(1)[at].as_py())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    own = cut(docs.select(F.col(text).alias("t")).mapInArrow(sets, "c long, own binary").dropDuplicates(["c"]))
    left, right = own.select(F.col("c").alias("ca"), F.col("own").alias("x")), own.select(F.col("c").alias("cb"), F.col("own").alias("y"))
    both = pairs.join(left, F.col("a") == F.col("ca")).join(right, F.col("b") == F.col("cb")).select("a", "b", "x", "y")
    return cut(both.mapInArrow(check, "a long, b long"))


def groups_of(docs: DataFrame, joined_prints: Callable[[DataFrame], DataFrame], words: int = 5, num: int = 4, den: int = 5, text: str = "text") -> DataFrame:
    """(node, component) of every class that links with another: connected by similarities of ``num`` / ``den`` or more.

    joined_prints: gives (node, component) of distinct fingerprints (fp) that link with others.
    """
    often, rank, sets = frequent(docs, words, text)
    tiles = np.maximum(1, -(-sets // TILE))

    def prefixes(batches):
        memo.forget()
        for batch in batches:
            names, sizes, own, odd, prints = [], [], [], [], []

            def out():
                ends = np.cumsum([0, *map(len, own)]).astype(np.int32)
                values = np.concatenate(own) if own else np.zeros(0, np.int64)
                return pa.RecordBatch.from_arrays([pa.array(np.array(names, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), pa.ListArray.from_arrays(pa.array(ends), pa.array(values)), pa.array(odd, pa.binary()), pa.array(np.array(prints, np.uint64).view(np.int64))], names=["c", "size", "first", "odd", "fp"])

            for (t,) in arrow_rows(batch, "t"):
                s = shingles(t, words)
                names.append(class_of(s))
                sizes.append(len(s))
                own.append(first_ones(s, often, rank, num, den))
                odd.append(parities(s))
                prints.append(fingerprint_of(s))
                if len(own) >= 1024:
                    yield out()
                    names, sizes, own, odd, prints = [], [], [], [], []
            yield out()

    def deal(batches):
        for batch in batches:
            rows = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(4)], 1)
            tile = np.zeros(len(rows), np.int64)
            if len(often):
                at = np.searchsorted(often, rows[:, 0])
                at[at == len(often)] = 0
                tile = np.where(often[at] == rows[:, 0], rows[:, 1] % tiles[at], 0)
            yield as_batch(np.column_stack([rows[:, 0], tile, rows[:, 1:]]), ["s", "tile", "c", "size", "place"])

    def neighbours(batches):
        """Pairs (a, b), and rows of shingles with further pairs, which have a size."""
        for rows in whole_groups(batches, 5):
            size, left = groups(rows)
            pairs = [np.zeros((0, 2), np.int64)]
            for d in range(1, WINDOW + 1):
                i = np.flatnonzero(left >= d)
                i = i[possible(rows[i], rows[i + d], num, den)]
                pairs.append(np.stack([rows[i, 2], rows[i + d, 2]], 1))
            found = np.unique(np.concatenate(pairs), axis=0)
            yield as_batch(np.column_stack([found, np.zeros((len(found), 3), np.int64)]), ["a", "b", "c", "size", "place"])
            more = size > WINDOW + 1
            if len(often):
                at = np.searchsorted(often, rows[:, 0])
                at[at == len(often)] = 0
                more |= (often[at] == rows[:, 0]) & (tiles[at] > 1)
            if more.any():
                yield as_batch(rows[more], ["a", "b", "c", "size", "place"])

    texts = docs.select(F.col(text).alias("t"))
    first = cut(texts.mapInArrow(prefixes, "c long, size int, first array<long>, odd binary, fp long").dropDuplicates(["c"]))
    release(docs.sparkSession)
    found = joined_prints(first.select("fp").distinct())
    listed = first.select("c", "fp").join(found, F.col("fp") == F.col("node"), "left").select(F.coalesce("component", "fp").alias("g"), "fp", "c")
    alike = cut(chained(listed))
    release(docs.sparkSession)
    rows = first.select("c", "size", F.posexplode("first").alias("place", "s")).select("s", "c", "size", "place")
    dealt = rows.mapInArrow(deal, "s long, tile long, c long, size long, place long").select("s", F.col("tile").cast("int"), "c", F.col("size").cast("int"), F.col("place").cast("int"))
    met = cut(dealt.repartition("s", "tile").sortWithinPartitions("s", "tile", "c").mapInArrow(neighbours, "a long, b long, c long, size long, place long").distinct())
    release(docs.sparkSession)
    tried = met.where("size = 0").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).unionByName(alike).distinct()
    near = confirmed(docs, first, tried, words, num, den, text)
    release(docs.sparkSession)

    # shingles of more sets, as far as these lie in different components
    more = met.where("size > 0").select(F.col("a").alias("s"), "c", "size", "place")
    own = components(near)
    if more.isEmpty():
        return own
    joined = cut(more.join(own, F.col("c") == F.col("node"), "left").select("s", "c", "size", "place", F.coalesce("component", "c").alias("of")))
    mixed = joined.groupBy("s").agg(F.count("*").alias("n"), F.min("of").alias("low"), F.max("of").alias("high")).where("low <> high").select(F.col("s").alias("k"), F.ceil(F.col("n") / TILE).cast("int").alias("tiles"))

    def across(batches):
        """Pairs of different components that sizes, places and parities admit, but where they met just before."""
        tables, earlier, base = [], [], 0

        def met_before(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            # a pair that shares an earlier shingle was looked at there, or at a still earlier one
            return np.array([not earlier[i].isdisjoint(earlier[j]) for i, j in zip(x.tolist(), y.tolist())], bool)

        def numbered():
            for batch in batches:
                places = np.arange(base + len(tables), base + len(tables) + batch.num_rows)
                tables.extend(batch.column(6).to_pylist())
                earlier.extend(map(frozenset, batch.column(7).to_pylist()))
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(6)), pa.array(places)], names=[*batch.schema.names[:6], "at"])

        for rows in whole_groups(numbered(), 7):
            _, left = groups(rows)
            at, d, found = np.arange(len(rows)), 0, []
            while len(at := at[left[at] > d]):
                d += 1
                i = at[rows[at, 5] != rows[at + d, 5]]
                i = i[possible(rows[i], rows[i + d], num, den)]
                if len(i):
                    i = i[admitted(rows[i, 6] - base, rows[i + d, 6] - base, rows[i, 3], rows[i + d, 3], tables, num, den)]
                    i = i[~met_before(rows[i, 6] - base, rows[i + d, 6] - base)]
                    found.append(np.sort(np.stack([rows[i, 2], rows[i + d, 2]], 1), axis=1))
            if found:
                yield as_batch(np.unique(np.concatenate(found), axis=0), ["a", "b"])
            done = int(rows[-1, 6]) + 1
            del tables[: done - base], earlier[: done - base]
            base = done

    tile = F.pmod(F.xxhash64("c"), F.col("tiles")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other")
    rest = joined.join(mixed, F.col("s") == F.col("k")).join(first.select(F.col("c").alias("own"), "odd"), F.col("c") == F.col("own"))
    # the class's shingles just before this one, so that a pair is not given again and again
    before = F.collect_list("s").over(Window.partitionBy("c").orderBy("s").rowsBetween(-BEFORE, -1)).alias("before")
    rest = rest.withColumn("tile", tile).select("s", "c", "size", "place", "of", "odd", "tile", "tiles", before).select("*", other)
    pair = F.least("tile", "other") * F.lit(1 << 24).cast("long") + F.greatest("tile", "other")
    rest = rest.select("s", pair.alias("pair"), "c", "size", "place", "of", "odd", "before").repartition("s", "pair").sortWithinPartitions("s", "pair", "c")
    found = cut(rest.mapInArrow(across, "a long, b long").distinct().join(tried, ["a", "b"], "left_anti"))
    if found.isEmpty():
        return own
    # the components that links across them join, as a graph of components
    across_ = confirmed(docs, first, found, words, num, den, text)
    ends = across_.join(own.select(F.col("node").alias("na"), F.col("component").alias("ka")), F.col("a") == F.col("na"), "left").join(own.select(F.col("node").alias("nb"), F.col("component").alias("kb")), F.col("b") == F.col("nb"), "left")
    ends = cut(ends.select("a", "b", F.coalesce("ka", "a").alias("ka"), F.coalesce("kb", "b").alias("kb"), F.col("na").isNull().alias("new_a"), F.col("nb").isNull().alias("new_b")))
    joined = components(ends, "ka", "kb").select(F.col("node").alias("k"), F.col("component").alias("to"))
    new = ends.where("new_a").select(F.col("a").alias("node")).unionByName(ends.where("new_b").select(F.col("b").alias("node"))).distinct()
    every = own.unionByName(new.select("node", F.col("node").alias("component")))
    return every.join(joined, F.col("component") == F.col("k"), "left").select("node", F.coalesce("to", "component").alias("component"))
