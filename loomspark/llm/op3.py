"""Toxicity by compression distance to two trained zstandard dictionaries.

Training (labelled rows only, at most ``SAMPLE`` documents of each kind on each side, chosen by a hash of the key). Words
and stems are counted in toxic and in ordinary documents, each once for every different word before it, so that copies
of a document count once; log-likelihood ratio and rate tell which mark toxic text. The passages around these, a word on
either side, are the toxic samples; random passages of ordinary documents, as many and alike in length, are the ordinary
ones; the library's trainer makes a dictionary of ``OWN`` bytes of either. Behind each stands the same dictionary of
``SHARED`` bytes, trained on windows of other ordinary documents, so that plain text costs the same under both and the
difference tells about the passages alone. At most ``PASSAGES`` samples of each sort, chosen by hash, reach the driver.

Scoring: a text is cut into windows of ``WINDOW`` bytes that overlap by ``OVERLAP``; each is compressed with either
dictionary. The gains of the toxic one (the largest, the mean of the three largest, the mean of all, how many and what
share reach each of some sizes) go through a logistic curve fitted on other labelled rows than the dictionaries saw, so
that it is calibrated on gains as new text shows them.

Null and empty texts are one empty window. Equal texts have equal scores. Rows that repeat a key are scored by their own
texts; of those that repeat a sampled key, words and passages of all are learnt and the curve learns from one. Without
labelled rows of both kinds, or without a mark, the score is 0. An empty table gives no rows. Labels, language, source
and any other columns are no input of a score.
"""

from __future__ import annotations

import re
from zlib import crc32
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_rows, cut, table

SAMPLE, PASSAGES = 1500, 30_000
WINDOW, OVERLAP, STEPS = 80, 16, (2, 3, 4, 5, 6, 8)
OWN, SHARED = 2048, 65_536
#: Passages cut at random from an ordinary document.
CUTS = 20
#: Least log-likelihood ratio, and times the other kind's rate.
RATIO, TIMES = 16.0, 4.0

_words = re.compile(r"[^\W\d_]{3,24}").findall


def stems(text: str | None) -> set[tuple[str, int]]:
    """The words of a text and their beginnings of four to seven characters, each with a hash of the word before it."""
    words = _words((text or "").lower())
    return {(w[:n], crc32(before.encode()) & 0xFFFFF) for before, w in set(zip(["", *words], words)) for n in {*range(4, min(len(w), 8)), len(w)}}


def windows(text: str | None) -> list[bytes]:
    data = " ".join((text or "").lower().split()).encode()
    return [data[max(0, at - OVERLAP) : at + WINDOW] for at in range(0, max(1, len(data)), WINDOW)]


@lru_cache(maxsize=4)
def compressors(toxic: bytes, ordinary: bytes):
    """A compressor for each dictionary; one pair per worker process."""
    import zstandard

    out = []
    for content in (toxic, ordinary):
        params = zstandard.ZstdCompressionParameters(compression_level=3, window_log=17, hash_log=15, chain_log=15, search_log=5, min_match=3, strategy=zstandard.STRATEGY_BTLAZY2, write_content_size=False, write_dict_id=False)
        own = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        own.precompute_compress(compression_params=params)
        out.append(zstandard.ZstdCompressor(dict_data=own, compression_params=params))
    return out


def gains(text: str | None, toxic: bytes, ordinary: bytes) -> list[float]:
    """Features of a text."""
    a, b = (c.compress for c in compressors(toxic, ordinary))
    got = np.array([len(b(w)) - len(a(w)) for w in windows(text)], np.float64)
    top, reached = np.sort(got)[-3:], [int((got >= x).sum()) for x in STEPS]
    return [top[-1], top.mean(), got.mean(), np.log1p(len(got)), *np.log1p(reached), reached[1] / len(got), reached[3] / len(got)]


def marked_passages(text: str | None, marked: set[str]) -> list[bytes]:
    """The words that are marked, or begin so, each with the words around it."""
    words, out = (text or "").lower().split(), []
    for i, word in enumerate(words):
        found = _words(word)
        if found and (found[0] in marked or any(found[0][:n] in marked for n in range(4, 8))):
            out.append((" ".join(words[max(0, i - 1) : i + 2]) + " ").encode())
    return out


def random_passages(text: str | None) -> list[bytes]:
    """As long as marked ones, from places that the text itself decides on."""
    words = (text or "").lower().split()
    places = np.random.default_rng(crc32((text or "").encode())).integers(0, max(1, len(words)), CUTS if words else 0)
    return [(" ".join(words[max(0, i - 1) : i + 2]) + " ").encode() for i in places.tolist()]


def trained(samples: list[bytes], size: int, k: int, d: int) -> bytes:
    """A dictionary by the library's trainer; of samples too few for it the samples themselves."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples, k=k, d=d).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def dictionaries(toxic: list[bytes], ordinary: list[bytes], plain: list[bytes]) -> tuple[bytes, bytes]:
    """From toxic and ordinary passages and windows of plain text."""
    own, shared = trained(toxic, OWN, 16, 6), trained(plain, SHARED, 64, 8)
    other = trained(ordinary, max(256, len(own)), 16, 6)[-len(own) :].rjust(len(own))
    return own + shared, other + shared


def logistic(x: np.ndarray, y: np.ndarray) -> dict:
    """Damped Newton steps with a light penalty, on standardised features."""
    mean, spread = x.mean(0), x.std(0) + 1e-6
    z = np.concatenate([(x - mean) / spread, np.ones((len(x), 1))], 1)
    w = np.zeros(z.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-(z @ w).clip(-30, 30)))
        h = (z * (p * (1 - p))[:, None]).T @ z + 0.5 * np.eye(len(w))
        w = w + np.clip(np.linalg.solve(h, z.T @ (y - p) - 0.5 * w), -2, 2)
    return {"mean": mean, "spread": spread, "w": w}


def chance(model: dict, x: np.ndarray) -> np.ndarray:
    z = (x - model["mean"]) / model["spread"]
    return 1 / (1 + np.exp(-(z @ model["w"][:-1] + model["w"][-1]).clip(-30, 30)))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, key: str = "doc_id", text: str = "text") -> dict | None:
    """labels: (key, label 1 toxic or 0), the rows to learn from. None where a kind is missing."""
    one = labels.where(f"{key} is not null and label is not null").groupBy(key).agg(F.max("label").cast("int").alias("y"))
    half = lambda y, n: one.where(F.col("y") == y).orderBy(F.xxhash64(key), key).limit(n)
    # at most two samples of either kind: even places learn words, odd ones the curve
    chosen = half(1, 2 * sample).unionByName(half(0, 2 * sample)).select(F.col(key).alias("label_key"), "y", F.pmod(F.xxhash64(key, F.lit(1)), F.lit(2)).alias("side"))
    chosen = cut(chosen.withColumn("number", F.monotonically_increasing_id()))
    wanted = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(chosen), F.col("k") == F.col("label_key"))

    def words(batches):
        for batch in batches:
            seen: set[tuple[int, str, int]] = set()
            for at, (y, t) in enumerate(arrow_rows(batch, "y", "t"), 1):
                seen.update((y, w, before) for w, before in stems(t))
                if len(seen) > 300_000 or at == batch.num_rows:
                    y_, w_, b_ = zip(*seen) if seen else ((), (), ())
                    yield pa.RecordBatch.from_arrays([pa.array(w_, pa.string()), pa.array(y_, pa.int32()), pa.array(b_, pa.int32())], names=["w", "y", "before"])
                    seen = set()

    learn = wanted.where("side = 0").select("y", "t").mapInArrow(words, "w string, y int, before int").distinct()
    counts = cut(learn.groupBy("w").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b")).where("a + b >= 3"))
    n, m = counts.agg(F.sum("a"), F.sum("b")).first()
    if not n or not m:
        return None
    p, q = F.col("a") / n, F.col("b") / m
    both = (F.col("a") + F.col("b")) / (n + m)
    log = lambda k, of, x: k * F.log(F.greatest(x, F.lit(1e-12))) + (of - k) * F.log(F.greatest(1 - x, F.lit(1e-12)))
    strength = 2 * (log(F.col("a"), F.lit(n), p) + log(F.col("b"), F.lit(m), q) - log(F.col("a"), F.lit(n), both) - log(F.col("b"), F.lit(m), both))
    # words of the bounded sample that mark toxic text
    marked = {r.w for r in counts.where((p > q) & (strength >= RATIO) & (p >= TIMES * (F.col("b") + 0.5) / m)).select("w").collect()}
    if not marked:
        return None

    def passages(batches):
        """Sort 0 toxic, 1 ordinary, 2 windows of plain text; ordinary documents go by halves to either of the latter."""
        for batch in batches:
            rows = []
            for y, t, half in arrow_rows(batch, "y", "t", "half"):
                rows += [(2, w) for w in windows(t)] if not y and half else [(1 - y, x) for x in (marked_passages(t, marked) if y else random_passages(t))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary()))], names=["sort", "x"])

    cuts = cut(wanted.where("side = 0").select("y", "t", F.pmod(F.xxhash64("label_key", F.lit(2)), F.lit(2)).alias("half")).mapInArrow(passages, "sort int, x binary"))
    pick = lambda sort, most: [bytes(r.x) for r in cuts.where(F.col("sort") == sort).orderBy(F.xxhash64("x"), "x").limit(most).collect()]
    bad = pick(0, PASSAGES)
    toxic, ordinary = dictionaries(bad, pick(1, len(bad)), pick(2, PASSAGES))

    def measure(batches):
        for batch in batches:
            rows = [(y, np.array(gains(t, toxic, ordinary)).tobytes(), k, h) for y, t, k, h in arrow_rows(batch, "y", "t", "number", "h")]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.int64(), pa.int64()))], names=["y", "x", "k", "h"])

    measured = wanted.where("side = 1").select("y", "t", "number", F.xxhash64("t").alias("h")).mapInArrow(measure, "y int, x binary, k long, h long")
    # of rows that repeat a key the one whose text has the smallest hash
    one = measured.groupBy("k").agg(F.min(F.struct("h", "x", "y")).alias("r"))
    got = one.select("r.y", "r.x").orderBy("x", "y").collect()
    if len({r.y for r in got}) < 2:
        return None
    y = np.array([r.y for r in got], np.float64)
    model = logistic(np.stack([np.frombuffer(r.x) for r in got]), y)
    return model | {"toxic": toxic, "ordinary": ordinary}


def score(docs: DataFrame, model: dict | None, threshold: float, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, score and predicted for every row of ``docs``."""

    def run(batches):
        for batch in batches:
            rows = [(k, gains(t, model["toxic"], model["ordinary"]) if model else None) for k, t in arrow_rows(batch, "k", "t")]
            if rows:
                s = chance(model, np.array([x for _, x in rows])) if model else np.zeros(len(rows))
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int64()), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[key, "score", "predicted"])

    return docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).mapInArrow(run, f"{key} long, score double, predicted int")


def bucket(key: str, of: int):
    """crc32 of the key as text, modulo ``of``."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(of))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label")).where(bucket("doc_id", 3) != 1)
    return score(docs, fit(docs, labels), 0.7).select("doc_id", F.coalesce(bucket("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", "predicted")
