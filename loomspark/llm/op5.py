"""Embedding near-dedup: all pairs by a cover tree and a dual traversal of it.

1. Vectors are normalised in double precision; equal ones become one class with a number and a count, so copies cost
   nothing.
2. The tree's top is shaped by a sample of at most ``SAMPLE`` classes: farthest-first centres, of which those further
   apart than 2 and 1 form levels, cut off at ``LEAVES`` centres. Every class joins its nearest leaf, and covering radii
   are the largest distances of all classes, so that bounds hold for all rows. Leaves are dealt to blocks of about
   ``BLOCK`` classes, large leaves to several by a hash.
3. Below, every block is built into levels of halving radii (``RADII``) by one task: a node's centre is one of its
   classes, and it splits where its own covering radius is larger than the level's. Each class keeps its path, the
   nodes that hold it; all levels below follow the data to the end, and none is cut off.
4. The dual traversal drops pairs of nodes whose centres are further apart than both covering radii and the threshold
   distance together. It drops pairs of leaves in the driver; then of every block only the nodes of one
   level, with their radii, are sent to pairs of blocks (the first whose radius is no more than the threshold distance);
   then classes go to the pairs where their node is left, and each pair of blocks descends from its top to single
   classes, whose cosine decides. A block, and a pair of blocks, gives counts and one spanning forest,
   not its links. Large products of nodes are looked through in single precision, with a margin for it, by radii rounded
   up to the levels'; what is left is compared in double precision.

Links are pairs with cosine of at least the threshold (in cases within 1e-12 of it by an exactly rounded sum); link
counts include copies. Vectors of different lengths never link. Vectors that are null, zero or hold null or non-finite
components link with nothing and are their own component. Rows that repeat an id are rows of their own, each with the
links of its own vector; null ids link like others and name a component only where it has no other id, by null. An
empty table gives no rows. Labels and other columns are never read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import anew, components, cut, table, union

SAMPLE, LEAVES, BLOCK = 2048, 256, 8192
#: Levels of a block's tree.
RADII = (1.0, 0.5, 0.25, 0.125, 0.0625)
#: Pairs whose distances are computed at once.
PAIRS = 1 << 16
#: Radii are rounded up to these where a bound holds for many pairs at once.
CLASSES = np.array([0.0, *RADII[::-1], 2.0])
#: Distances come from products of unit vectors, which are exact to 1e-15; near zero their roots are to 1e-7.
SLACK = 1e-6


def unit_vectors(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v): v holds the normalised doubles, null where the vector takes no part."""

    def run(batches):
        for batch in batches:
            out = []
            for x in batch.column(1):
                v = None
                if x.is_valid and len(x.values) and not x.values.null_count:
                    a = x.values.to_numpy(zero_copy_only=False).astype(np.float64)
                    top = np.abs(a).max()
                    if np.isfinite(top) and top > 0:
                        a = a / top
                        v = (a / np.sqrt((a * a).sum()) + 0.0).tobytes()
                out.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["id", "v"])

    return rows.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("x")).mapInArrow(run, "id long, v binary")


def matrix(vectors: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors with zeros behind shorter ones, and their own lengths."""
    return np.frombuffer(b"".join(v.ljust(8 * width, b"\0") for v in vectors)).reshape(-1, width), np.array([len(v) // 8 for v in vectors])


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * a @ b.T))


def tree_of(sample: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Leaf centres in farthest-first order, and the centres' numbers in each level (each level a prefix)."""
    order, apart = [0], []
    far = np.linalg.norm(sample - sample[0], axis=1)
    while len(order) < min(LEAVES, len(sample)) and far.max() > RADII[0]:
        at = int(far.argmax())
        apart.append(far[at])
        order.append(at)
        far = np.minimum(far, np.linalg.norm(sample - sample[at], axis=1))
    inserted = np.array([4.0, *apart])
    levels = [np.arange(int((inserted > r).sum())) for r in (2.0, RADII[0])]
    return sample[order], levels


def traverse(centres: np.ndarray, parents: list[np.ndarray], radii: list[np.ndarray], reach: float) -> np.ndarray:
    """Which pairs of leaves may hold pairs within ``reach``; parents[k]: of level k + 1's nodes, in level k."""
    gap = np.sqrt(np.maximum(0, ((centres[:, None] - centres[None]) ** 2).sum(2)))
    alive = np.ones((len(radii[0]), len(radii[0])), bool)
    for level, r in enumerate(radii):
        n = len(r)
        if level:
            alive = alive[np.ix_(parents[level - 1], parents[level - 1])]
        alive = alive & (gap[:n, :n] <= r[:, None] + r[None] + reach + SLACK) & (r[:, None] >= 0) & (r[None] >= 0)
    return alive


def net(v: np.ndarray, radius: float) -> np.ndarray:
    """For each vector the number of its centre, itself one of the vectors, within ``radius`` of it."""
    own, left = np.full(len(v), -1), np.arange(len(v))
    while len(left):
        some = left[:256]
        near = distances(v[some], v[some]) <= radius
        picked, free = [], np.ones(len(some), bool)
        for i in range(len(some)):
            if free[i]:
                picked.append(i)
                free &= ~near[i]
        centres = some[picked]
        gap = distances(v[left], v[centres])
        gap[np.searchsorted(left, centres), np.arange(len(centres))] = 0.0
        best = gap.argmin(1)
        inside = gap[np.arange(len(left)), best] <= radius
        own[left[inside]] = centres[best[inside]]
        left = left[~inside]
    return own


def paths(v: np.ndarray) -> np.ndarray:
    """paths[i, k]: the number of i's centre in level k. Nodes of a level lie within nodes of the level above."""
    out = np.zeros((len(v), len(RADII)), np.int64)
    node = np.zeros(len(v), np.int64)
    for k, radius in enumerate(RADII):
        if not k:
            node = net(v, radius)
        else:
            far = np.sqrt(np.maximum(0, 2 - 2 * (v * v[node]).sum(1)))
            for c in np.unique(node[far > radius]):
                members = np.flatnonzero(node == c)
                members = np.concatenate([[c], members[members != c]])  # the centre first, which so stays one
                node[members] = members[net(v[members], radius)]
        out[:, k] = node
    return out


class Tree:
    """A block's classes, in order of their paths, with the nodes of all levels. Of a node some classes may be missing;
    its first one is then taken for its centre, and radii are those of the classes at hand."""

    def __init__(self, v: np.ndarray, widths: np.ndarray, path: np.ndarray, rows: np.ndarray):
        order = np.lexsort(path.T[::-1])
        self.v, self.widths, self.rows = v[order], widths[order], rows[order]
        path = path[order]
        self.starts, self.radii, self.children = [], [], []
        for k in range(path.shape[1]):
            start = np.flatnonzero(np.concatenate([[True], path[1:, k] != path[:-1, k]])) if len(path) else np.zeros(0, np.int64)
            size = np.diff(np.concatenate([start, [len(path)]]))
            far = np.sqrt(np.maximum(0, 2 - 2 * (self.v * self.v[np.repeat(start, size)]).sum(1)))
            self.starts.append(start)
            self.radii.append(np.maximum.reduceat(far, start) * (size > 1) if len(start) else far)
        self.starts.append(np.arange(len(path)))
        self.radii.append(np.zeros(len(path)))
        for up, low in zip(self.starts, self.starts[1:]):
            self.children.append(np.searchsorted(low, np.concatenate([up, [len(path)]])))


def product(a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (x, y) of the ranges a0..a1 and b0..b1 of each place."""
    n = b1 - b0
    t = (a1 - a0) * n
    k = np.arange(t.sum()) - np.repeat(np.cumsum(t) - t, t)
    n = np.repeat(n, t)
    return np.repeat(a0, t) + k // n, np.repeat(b0, t) + k % n


def exact(a: np.ndarray, b: np.ndarray, threshold: float, dot: np.ndarray) -> np.ndarray:
    """Whether dot reaches the threshold; close cases by an exactly rounded sum, alike in whatever way dot was computed."""
    near = dot >= threshold
    for i in np.flatnonzero(np.abs(dot - threshold) < 1e-12):
        near[i] = math.fsum((a[i] * b[i]).tolist()) >= threshold
    return near


def candidates(va: np.ndarray, ra: np.ndarray, vb: np.ndarray, rb: np.ndarray, reach: float, same: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(x, y) of all pairs whose bounds leave them, and of few others; of the same nodes those with y at or behind x's chunk."""
    va, vb = (np.ascontiguousarray(v, np.float32) for v in (va, vb))
    ca, cb = (np.searchsorted(CLASSES, np.minimum(r, 2.0)) for r in (ra, rb))
    margin = 4e-7 * va.shape[1] + 1e-5  # more than single precision errs
    for i in np.unique(ca):
        for j in np.unique(cb):
            ia, ib = np.flatnonzero(ca == i), np.flatnonzero(cb == j)
            least, others = np.float32(1 - min(2.0, CLASSES[i] + CLASSES[j] + reach + SLACK) ** 2 / 2 - margin), vb[ib]
            for at in range(0, len(ia), 128):
                rows = ia[at : at + 128]
                begin = int(np.searchsorted(ib, rows[0])) if same else 0
                if begin < len(ib):
                    found = np.flatnonzero((va[rows] @ others[begin:].T >= least).ravel())
                    if len(found):
                        yield rows[found // (len(ib) - begin)], ib[found % (len(ib) - begin) + begin]


def dual(a: Tree, b: Tree, threshold: float, tried: list | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (x, y) of linked classes; each pair once where a is b. tried: gets the numbers of pairs looked at."""
    reach, last, same = math.sqrt(2 - 2 * threshold), len(a.starts) - 1, a is b

    def alive(level: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        dot = np.einsum("ij,ij->i", a.v[a.starts[level][x]], b.v[b.starts[level][y]])
        if level == last:
            return exact(a.v[x], b.v[y], threshold, dot) & (a.widths[x] == b.widths[y])
        return np.sqrt(np.maximum(0, 2 - 2 * dot)) <= a.radii[level][x] + b.radii[level][y] + reach + SLACK

    def dense(level: int, a0: int, a1: int, b0: int, b1: int):
        if tried is not None:
            tried.append((level, (a1 - a0) * (b1 - b0)))
        own = same and a0 == b0
        for x, y in candidates(a.v[a.starts[level][a0:a1]], a.radii[level][a0:a1], b.v[b.starts[level][b0:b1]], b.radii[level][b0:b1], reach, own):
            for at in range(0, len(x), PAIRS):
                yield x[at : at + PAIRS] + a0, y[at : at + PAIRS] + b0

    def products(level: int, a0, a1, b0, b1):
        t = (a1 - a0) * (b1 - b0)
        for i in np.flatnonzero(t > PAIRS):
            yield from dense(level, int(a0[i]), int(a1[i]), int(b0[i]), int(b1[i]))
        small = np.flatnonzero(t <= PAIRS)
        part = np.cumsum(t[small]) // PAIRS
        for i in np.split(small, np.flatnonzero(np.diff(part)) + 1) if len(small) else []:
            x, y = product(a0[i], a1[i], b0[i], b1[i])
            if tried is not None:
                tried.append((level, len(x)))
            yield x, y

    def down(level: int, a0, a1, b0, b1):
        for x, y in products(level, a0, a1, b0, b1):
            if same:
                x, y = (z[(x < y) if level == last else (x <= y)] for z in (x, y))
            keep = alive(level, x, y)
            x, y = x[keep], y[keep]
            if not len(x):
                continue
            if level == last:
                yield x, y
            else:
                up, low = a.children[level], b.children[level]
                yield from down(level + 1, up[x], up[x + 1], low[y], low[y + 1])

    if len(a.v) and len(b.v):
        yield from down(0, np.array([0]), np.array([len(a.starts[0])]), np.array([0]), np.array([len(b.starts[0])]))


def near_pairs(rows: DataFrame, threshold: float, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row per row of ``rows``: key, n_links, component_id and kept."""
    reach = math.sqrt(2 - 2 * threshold)
    units = cut(unit_vectors(rows, key, vector))
    found = units.where("v is not null").groupBy("v").agg(F.min("id").alias("name"), F.count("*").alias("n"))
    classes = cut(found.withColumn("number", F.monotonically_increasing_id()))
    longest = classes.agg(F.max(F.length("v"))).first()[0]
    if longest is None:
        return units.select(F.col("id").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    width = longest // 8
    sample = [bytes(r.v) for r in classes.select("v").orderBy(F.xxhash64("v"), "v").limit(SAMPLE).collect()]
    centres, levels = tree_of(matrix(sample, width)[0])
    # nested levels: a node's parent is the nearest centre of the level above
    gap = np.linalg.norm(centres[:, None] - centres[None], axis=2)
    parents = [gap[np.ix_(low, up)].argmin(1) for up, low in zip(levels, levels[1:])]

    def column(batch, name):
        return batch.column(batch.schema.get_field_index(name))

    def measure(batches):
        for batch in batches:
            distance = distances(matrix(column(batch, "v").to_pylist(), width)[0], centres)
            node, out = distance.argmin(1), []
            for level in range(len(levels) - 1, -1, -1):
                for k in np.unique(node):
                    out.append((level, int(k), float(distance[node == k, k].max()), int((node == k).sum())))
                if level:
                    node = parents[level - 1][node]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.float64(), pa.int64()))], names=["level", "node", "r", "n"])

    radii, sizes = [np.full(len(x), -1.0) for x in levels], np.zeros(len(centres), np.int64)
    for row in classes.select("v").mapInArrow(measure, "level int, node int, r double, n long").groupBy("level", "node").agg(F.max("r").alias("r"), F.sum("n").alias("n")).collect():  # a row for each node
        radii[row.level][row.node] = row.r
        if row.level == len(levels) - 1:
            sizes[row.node] = row.n
    alive, leaf_r = traverse(centres, parents, radii, reach), radii[-1]
    # leaves in tree order share blocks; a large leaf has several of its own
    first, blocks, filled, block = np.zeros(len(centres), np.int64), np.ones(len(centres), np.int64), 0, 0
    for leaf in np.lexsort([np.arange(len(centres)), *([parents[-1]] if parents else [])]):
        if sizes[leaf] > BLOCK:
            block += 1 if filled else 0
            first[leaf], blocks[leaf], filled = block, -(-sizes[leaf] // BLOCK), 0
            block += blocks[leaf]
        else:
            if filled + sizes[leaf] > BLOCK:
                block, filled = block + 1, 0
            first[leaf] = block
            filled += sizes[leaf]

    def assign(batches):
        for batch in batches:
            leaf = distances(matrix(column(batch, "v").to_pylist(), width)[0], centres).argmin(1)
            own = first[leaf] + column(batch, "salt").to_numpy() % blocks[leaf]
            yield pa.RecordBatch.from_arrays([pa.array(own), *(column(batch, x) for x in ("v", "number", "n"))], names=["block", "v", "number", "n"])

    def linked(trees: tuple[Tree, Tree], number: np.ndarray, n: np.ndarray) -> tuple[list, list, list]:
        """Columns a, b and links: counts of classes have no b, edges of the spanning forest count nothing."""
        links, root = np.zeros(len(number), np.int64), np.arange(len(number))
        for x, y in dual(*trees, threshold):
            x, y = trees[0].rows[x], trees[1].rows[y]
            links += np.bincount(x, n[y], len(links)).astype(np.int64) + np.bincount(y, n[x], len(links)).astype(np.int64)
            root = union(root, x, y)
        some, moved = np.flatnonzero(links), np.flatnonzero(root != np.arange(len(root)))
        return [*number[some].tolist(), *number[moved].tolist()], [*[None] * len(some), *number[root[moved]].tolist()], [*links[some].tolist(), *[0] * len(moved)]

    def build(group: pa.Table) -> pa.Table:
        """A block's classes with their paths, of centres of the level that is sent the covering radii; and the block's own links."""
        v, widths = matrix(group.column("v").to_pylist(), width)
        number, n = (group.column(x).to_numpy() for x in ("number", "n"))
        path = paths(v)
        top = path[:, sent]
        radius = np.full(len(v), -1.0)
        np.maximum.at(radius, top, np.sqrt(np.maximum(0, 2 - 2 * (v * v[top]).sum(1))) * (top != np.arange(len(v))))
        tree = Tree(v, widths, path, np.arange(len(v)))
        a, b, links = linked((tree, tree), number, n)
        rows, more = [None] * len(v), [None] * len(a)
        return pa.table({
            "block": pa.concat_arrays([*group.column("block").chunks, pa.array(more, pa.int64())]), "node": pa.array([*top.tolist(), *more], pa.int64()), "r": pa.array([*radius.tolist(), *more], pa.float64()), "path": pa.array([*(x.tobytes() for x in path), *more], pa.binary()),
            "v": pa.concat_arrays([*group.column("v").chunks, pa.array(more, pa.binary())]), "number": pa.array([*number.tolist(), *more], pa.int64()), "n": pa.array([*n.tolist(), *more], pa.int64()), "a": pa.array([*rows, *a], pa.int64()), "b": pa.array([*rows, *b], pa.int64()), "links": pa.array([*rows, *links], pa.int64()),
        })

    # of the blocks' levels the first with nodes no wider than the links are long: wider ones meet nearly all others
    sent = next((k for k, r in enumerate(RADII) if r <= reach), len(RADII) - 1)
    n_blocks = int((first + blocks).max())
    holds = np.zeros((len(centres), n_blocks), np.float32)  # leaf, block
    for leaf in range(len(centres)):
        holds[leaf, first[leaf] : first[leaf] + blocks[leaf]] = 1

    def deal(batches):
        """Nodes, by the classes that are their centres, to the pairs of blocks that their bounds leave; in single precision."""
        step = max(1, min(2000, (1 << 22) // n_blocks))
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                v = matrix(column(batch, "v").to_pylist(), width)[0]
                distance, own, r = distances(v, centres), column(batch, "block").to_numpy(), column(batch, "r").to_numpy()
                row, to = np.nonzero((distance <= leaf_r[None] + r[:, None] + reach + SLACK).astype(np.float32) @ holds > 0)
                row, to = row[own[row] != to], to[own[row] != to]
                short = [x.tobytes() for x in v.astype(np.float32)]
                part = batch.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(own[row], to)), pa.array(np.maximum(own[row], to)), column(part, "block"), column(part, "node"), column(part, "r"), pa.array(short, pa.binary()).take(pa.array(row))], names=["p", "q", "block", "node", "r", "v"])

    def meet(group: pa.Table) -> pa.Table:
        """Which nodes of a pair of blocks are left, with both blocks."""
        p, q = group.column("p")[0].as_py(), group.column("q")[0].as_py()
        block, node, r = (group.column(x).to_numpy() for x in ("block", "node", "r"))
        v = np.frombuffer(b"".join(group.column("v").to_pylist()), np.float32).reshape(-1, width)
        left, right = np.flatnonzero(block == p), np.flatnonzero(block == q)
        keep = np.zeros(len(block), bool)
        for x, y in candidates(v[left], r[left], v[right], r[right], reach):
            keep[left[x]] = keep[right[y]] = True
        return pa.table({"p": pa.array(np.full(keep.sum(), p)), "q": pa.array(np.full(keep.sum(), q)), "at": pa.array(block[keep]), "top": pa.array(node[keep])})

    def compare(group: pa.Table) -> pa.Table:
        p, q = group.column("p")[0].as_py(), group.column("q")[0].as_py()
        block, number, n = (group.column(x).to_numpy() for x in ("block", "number", "n"))
        v, widths = matrix(group.column("v").to_pylist(), width)
        path = np.frombuffer(b"".join(group.column("path").to_pylist()), np.int64).reshape(-1, len(RADII))
        trees = [Tree(v[s], widths[s], path[s], s) for s in (np.flatnonzero(block == x) for x in (p, q))]
        return pa.table(dict(zip(("a", "b", "links"), (pa.array(x, pa.int64()) for x in linked(tuple(trees), number, n)))))

    dealt = classes.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(1 << 30))).mapInArrow(assign, "block long, v binary, number long, n long")
    built = cut(dealt.groupBy("block").applyInArrow(build, "block long, node long, r double, path binary, v binary, number long, n long, a long, b long, links long"))
    within = built.where("a is not null").select("a", "b", "links")
    tops = built.where("r >= 0").select("block", "node", "r", "v")
    pairs = tops.mapInArrow(deal, "p long, q long, block long, node long, r double, v binary")
    left = cut(pairs.groupBy("p", "q").applyInArrow(meet, "p long, q long, at long, top long"))
    wide = built.join(left, (F.col("block") == F.col("at")) & (F.col("node") == F.col("top"))).select("p", "q", "block", "path", "v", "number", "n")
    out = cut(within.unionByName(wide.groupBy("p", "q").applyInArrow(compare, "a long, b long, links long")))
    counts = out.where("b is null").groupBy("a").agg(F.sum("links").alias("links")).withColumnRenamed("a", "counted")
    joined = classes.join(components(out.where("b is not null")), F.col("number") == F.col("node"), "left").join(counts, F.col("number") == F.col("counted"), "left")
    joined = joined.select("v", "name", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "number").alias("component"))
    names = joined.groupBy("component").agg(F.min("name").alias("component_id")).select(anew(F.col("component")).alias("c"), "component_id")
    named = joined.join(names, F.col("component") == F.col("c")).select(F.col("v").alias("w"), "n_links", "component_id")
    given = units.where("v is not null").join(named, F.col("v") == F.col("w")).select("id", "n_links", "component_id")
    none = units.where("v is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return given.unionByName(none).select(F.col("id").alias(key), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_pairs(table(spark, sf_dir, "embeddings"), 0.9)
