"""Document quality by a linear-chain conditional random field over lines.

Every line is a step of a chain with two labels, good and bad. A line's features are shares of character classes, word
lengths, repeats within the line, within the document and of the whole line, and those of the lines before and behind
it. Lines of a labelled document carry its label for training: maximum likelihood of the chain (forward-backward,
gradient steps) on at most ``SAMPLE`` labelled documents, of each at most ``LINES`` lines in a row, chosen by a hash of
the key; of rows that repeat a key, one. That bounds what reaches the driver; scoring uses every line of every text.

A document's raw quality is the mean of its lines' marginals of good, weighted by length; a logistic curve fitted on the
same sample turns it into the score. Null and empty texts are one empty line. Equal texts have equal scores. With no
labelled rows the score is 0.5. An empty table gives no rows. Other columns (language, source) are never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import memo
from .common import arrow_rows, cut, table, text_batches

SAMPLE, LINES = 4000, 40
#: Character classes: 0 letter lower, 1 letter upper, 2 digit, 3 space, 4 sentence marks, 5 symbols, 6 other ASCII, 7 other
CLASSES = 8
WIDTH = CLASSES + 8


def _class_table() -> np.ndarray:
    out = np.full(0x110000, 7, np.uint8)
    for c in range(0x3000):
        x = chr(c)
        if x.isupper():
            out[c] = 1
        elif x.isalpha():
            out[c] = 0
        elif x.isdigit():
            out[c] = 2
        elif x.isspace():
            out[c] = 3
        elif x in ".,;:?'\"-()":
            out[c] = 4
        elif x in "#*$%&|<>!":
            out[c] = 5
        elif c < 128:
            out[c] = 6
    return out


_table: list[np.ndarray] = []


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all lines of all texts: own features, lengths in characters; and the number of lines of each text."""
    if not _table:
        _table.append(_class_table())
    texts = [t or "" for t in texts]
    lines = [t.split("\n") for t in texts]
    count = np.array([len(x) for x in lines], np.int64)
    flat = [x for y in lines for x in y]
    size = np.array([len(x) for x in flat], np.int64)
    kind = _table[0][np.frombuffer("".join(flat).encode("utf-32-le"), np.uint32)]
    shares = np.bincount(np.repeat(np.arange(len(flat)), size) * CLASSES + kind, minlength=CLASSES * len(flat)).reshape(-1, CLASSES)
    x = np.zeros((len(flat), WIDTH), np.float32)
    x[:, :CLASSES] = shares / np.maximum(size, 1)[:, None]
    at = 0
    for own in lines:
        seen, seen_lines = set(), set()
        for line in own:
            words = line.split()
            n = len(words)
            if n:
                once = set(words)
                pairs = set(zip(words, words[1:], words[2:]))
                k = n - 2
                x[at, CLASSES:] = (1.0 - len(once) / n, 1.0 - len(pairs) / k if k > 0 else 0.0, sum(map(str.__eq__, words, words[1:])) / n, len(pairs & seen) / k if k > 0 else 0.0, line in seen_lines, min(n, 60) / 60, min(len(line) / n, 20) / 20, 0.0)
                seen |= pairs
                seen_lines.add(line)
            else:
                x[at, -1] = 1.0
            at += 1
    return x, size, count


def with_neighbours(x: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Features of each line, of the one before and of the one behind (zero at a text's ends)."""
    starts = np.cumsum(count) - count
    before, behind = np.roll(x, 1, 0), np.roll(x, -1, 0)
    before[starts[count > 0]] = 0
    behind[(starts + count - 1)[count > 0]] = 0
    return np.concatenate([x, before, behind], 1)


def halves(e: np.ndarray, moves: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward log odds of good (with the line's own) and backward ones (without), over all chains at once.

    e: log odds of good of each line alone; moves[i, j]: log potential of label j behind label i (0 bad, 1 good).
    """
    order = np.argsort(-count, kind="stable")
    starts, most = (np.cumsum(count) - count)[order], int(count.max(initial=0))
    alive = np.searchsorted(-count[order], -np.arange(1, most + 1), "right")  # chains with at least that many lines
    fwd, bwd = np.zeros(len(e)), np.zeros(len(e))
    (bb, bg), (gb, gg) = moves
    for t in range(most):
        rows = starts[: alive[t]] + t
        fwd[rows] = e[rows] if not t else e[rows] + np.logaddexp(fwd[rows - 1] + gg, bg) - np.logaddexp(fwd[rows - 1] + gb, bb)
    for t in range(most - 2, -1, -1):
        rows = starts[: alive[t + 1]] + t
        odds = e[rows + 1] + bwd[rows + 1]
        bwd[rows] = np.logaddexp(odds + gg, gb) - np.logaddexp(odds + bg, bb)
    return fwd, bwd


def train(x: np.ndarray, count: np.ndarray, label: np.ndarray, rounds: int = 250) -> dict:
    """Fits the chain; label: of each text."""
    mean, spread = x.mean(0), x.std(0) + 1e-3
    z = with_neighbours((x - mean) / spread, count).astype(np.float64)
    y = np.repeat(label, count).astype(np.float64)
    w, bias, moves = np.zeros(z.shape[1]), 0.0, np.zeros((2, 2))
    n, first = len(y), np.zeros(len(y), bool)
    first[(np.cumsum(count) - count)[count > 0]] = True
    inner = np.flatnonzero(~first)
    state = np.zeros(len(w) + 5)
    speed = np.zeros_like(state)
    for k in range(1, rounds + 1):
        e = z @ w + bias
        fwd, bwd = halves(e, moves, count)
        p = 1 / (1 + np.exp(-(fwd + bwd).clip(-30, 30)))
        # marginals of neighbouring pairs, from what lies before the first and behind the second
        (bb, bg), (gb, gg) = moves
        a, b = inner - 1, inner
        four = np.stack([np.full(len(inner), bb), bg + e[b] + bwd[b], gb + fwd[a], gg + fwd[a] + e[b] + bwd[b]], 1)
        four = np.exp(four - four.max(1, keepdims=True))
        four /= four.sum(1, keepdims=True)
        seen = np.zeros(4)
        np.add.at(seen, (2 * y[a] + y[b]).astype(int), 1)
        grad = np.concatenate([(y - p) @ z / n - 1e-3 * w, [(y - p).mean()], (seen - four.sum(0)) / n - 1e-2 * moves.ravel()])
        state = 0.9 * state + 0.1 * grad
        speed = 0.99 * speed + 0.01 * grad**2
        step = 0.05 * (state / (1 - 0.9**k)) / (np.sqrt(speed / (1 - 0.99**k)) + 1e-8)
        w, bias, moves = w + step[: len(w)], bias + step[len(w)], moves + step[-4:].reshape(2, 2)
    return {"mean": mean, "spread": spread, "w": w, "bias": bias, "moves": moves, "a": 1.0, "b": 0.0}


def raw_quality(model: dict, x: np.ndarray, size: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Length-weighted mean of the marginals of good, for each text."""
    z = with_neighbours((x - model["mean"]) / model["spread"], count)
    fwd, bwd = halves(z @ model["w"] + model["bias"], model["moves"], count)
    p = 1 / (1 + np.exp(-(fwd + bwd).clip(-30, 30)))
    weight = size + 1.0
    starts = np.cumsum(count) - count
    return np.add.reduceat(p * weight, starts) / np.add.reduceat(weight, starts)


def calibrate(raw: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Logistic curve over the raw quality's log odds, by damped Newton steps."""
    s = np.log((raw + 1e-4) / (1 - raw + 1e-4))
    m = np.stack([s, np.ones_like(s)], 1)
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-(m @ w).clip(-30, 30)))
        h = (m * (p * (1 - p))[:, None]).T @ m + 1e-2 * np.eye(2)
        w = w + np.clip(np.linalg.solve(h, m.T @ (label - p) - 1e-2 * (w - [1.0, 0.0])), -1, 1)
    return float(w[0]), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, lines: int = LINES, key: str = "doc_id", text: str = "text") -> dict | None:
    """labels: (key, label 0 or 1), the rows to learn from. None where there are none."""
    chosen = labels.where(f"{key} is not null and label is not null").groupBy(key).agg(F.max("label").alias("label")).orderBy(F.xxhash64(key), key).limit(sample)
    # at most `sample` rows; numbered, as keys may be of any type
    chosen = cut(chosen.select(F.col(key).alias("label_key"), F.col("label").cast("int").alias("y"), F.monotonically_increasing_id().alias("number")))
    types = (pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64())

    def run(batches):
        memo.forget()
        for batch in batches:
            for rows in text_batches(arrow_rows(batch, "y", "t", "at")):
                x, size, count = features([r[1] for r in rows])
                ends, out = np.cumsum(count), []
                for (y, t, place), end, n in zip(rows, ends, count):
                    skip = (hash_of(t) % (n - lines + 1)) if n > lines else 0
                    part = slice(end - n + skip, end - n + skip + min(n, lines))
                    out.append((y, x[part].tobytes(), size[part].tobytes(), *place.values()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["y", "x", "size", "k", "h"])

    wanted = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(chosen), F.col("k") == F.col("label_key")).select("y", "t", F.struct("number", F.xxhash64("t").alias("h")).alias("at"))
    # of rows that repeat a key the one whose text has the smallest hash
    one = wanted.mapInArrow(run, "y int, x binary, size binary, k long, h long").groupBy("k").agg(F.min(F.struct("h", "x", "size", "y")).alias("r"))
    got = one.select("r.y", "r.x", "r.size").orderBy("x", "size", "y").collect()
    if not got:
        return None
    x = np.concatenate([np.frombuffer(r.x, np.float32).reshape(-1, WIDTH) for r in got])
    size = np.concatenate([np.frombuffer(r["size"], np.int64) for r in got])
    count = np.array([len(r["size"]) // 8 for r in got])
    label = np.array([r.y for r in got], np.float64)
    model = train(x, count, label)
    model["a"], model["b"] = calibrate(raw_quality(model, x, size, count), label)
    return model


def hash_of(text: str | None) -> int:
    import zlib

    return zlib.crc32((text or "").encode())


def scores(texts: list[str | None], model: dict | None) -> np.ndarray:
    if model is None:
        return np.full(len(texts), 0.5)
    raw = raw_quality(model, *features(texts))
    return 1 / (1 + np.exp(-(model["a"] * np.log((raw + 1e-4) / (1 - raw + 1e-4)) + model["b"]).clip(-30, 30)))


def score(docs: DataFrame, model: dict | None, threshold: float, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, score and predicted for every row of ``docs``."""

    def run(batches):
        for batch in batches:
            for rows in text_batches(arrow_rows(batch, "k", "t")):
                s = scores([t for _, t in rows], model)
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int64()), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[key, "score", "predicted"])

    return docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).mapInArrow(run, f"{key} long, score double, predicted int")


def accepted(docs: DataFrame, model: dict | None, threshold: float, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose own text scores ``threshold`` or more; no key is read and nothing shuffled."""

    @F.arrow_udf("boolean")
    def good(texts: pa.Array) -> pa.Array:
        memo.forget()
        parts = [scores([t for t, in rows], model) >= threshold for rows in text_batches(((t.as_py(),) for t in texts), lambda row: row[0])]
        return pa.array(np.concatenate(parts) if parts else [], pa.bool_())

    return docs.where(good(F.col(text)))


def bucket(key: str, of: int):
    """crc32 of the key as text, modulo ``of``."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(of))


def quality_model(spark: SparkSession, sf_dir: str) -> dict | None:
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")).where(bucket("doc_id", 5) != 0)
    return fit(table(spark, sf_dir, "documents"), labels)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score(table(spark, sf_dir, "documents"), quality_model(spark, sf_dir), 0.3)
    return scored.select("doc_id", F.coalesce(bucket("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")
