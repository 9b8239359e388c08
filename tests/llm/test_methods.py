"""Fingerprints, covering codes, chains, token files and packing against independent ways; the queries' own columns."""

import itertools
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import xxhash
from pyspark.sql import functions as F

from loomspark.llm import op3, op4, op6, op7, op8, op10
from loomspark.llm.memo import Remembered, remembered


def plain_fingerprint(text, words):
    found = (text or "").encode()
    found = bytes(c + 32 if 65 <= c <= 90 else c for c in found)
    found = [w for w in found.translate(bytes(32 if c in b"\t\n\x0b\x0c\r" else c for c in range(256))).split(b" ") if w]
    if not found:
        return 0
    k = min(words, len(found))
    h = [xxhash.xxh64(b" ".join(found[i : i + k]), seed=42).intdigest() for i in range(len(found) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprint():
    for t in (None, "", " \t\n", "One", "one two three", "A b C d E f a b c d", "é É ß " * 9, "the quick\x0bbrown\x0cfox\rjumps over\tthe lazy dog\n" * 7, "x\x1cy z\x85w q"):
        assert op7.fingerprint(t, 4) == plain_fingerprint(t, 4) and op7.fingerprint(t, 5) == plain_fingerprint(t, 5)


@pytest.mark.parametrize("blocks", [op7.THREE, op7.TWO])
def test_linked_fingerprints_meet(spark, blocks):
    r = np.random.default_rng(1)
    x = r.integers(0, 2**64, 60, dtype=np.uint64)
    for k in range(5):
        y = x.copy()
        for i in range(len(y)):
            for bit in r.choice(64, k, replace=False):
                y[i] ^= np.uint64(1 << int(bit))
        mine, other = (set(zip(*map(np.ndarray.tolist, op7.replicas(v, blocks)))) for v in (x, y))
        assert {row for row, _ in mine & other} == set(range(60))
    fps = np.concatenate([x, x ^ np.uint64(0b1111), x ^ np.uint64(0b11111 << 30)])
    got = op7.links(spark.createDataFrame([(int(v),) for v in fps.view(np.int64)], "fp long"), blocks).collect()
    edges = {(e.a, e.b) for e in got}
    assert len(edges) == 60 and all(((a ^ b) & (1 << 64) - 1).bit_count() <= 4 for a, b in edges)  # at five bits, none


def test_marginals_by_enumeration():
    r = np.random.default_rng(5)
    count, moves = np.array([1, 4, 0, 6]), r.normal(size=(2, 2))
    e = r.normal(size=count.sum())
    fwd, bwd = op8.halves(e, moves, count)
    got, at = 1 / (1 + np.exp(-(fwd + bwd))), 0
    for n in count:
        own = e[at : at + n]
        weight = {y: np.exp(sum(own[i] * y[i] for i in range(n)) + sum(moves[y[i], y[i + 1]] for i in range(n - 1))) for y in itertools.product((0, 1), repeat=int(n))}
        for i in range(n):
            assert got[at + i] == pytest.approx(sum(w for y, w in weight.items() if y[i]) / sum(weight.values()))
        at += n


def test_token_files(spark, tmp_path):
    texts = [(i % 7 if i % 5 else None, f"{'common words of text ' * (i % 40)}{i} é") for i in range(60)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        op10.write_ids(df, f"{tmp_path}/a", P.path("byte_bpe_50k.json"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert spark.read.parquet(f"{tmp_path}/a").count() >= 2
    own, at = remembered(P.path("byte_bpe_50k.json"), "byte"), 0
    rows = op10.read_documents(spark, f"{tmp_path}/a").orderBy("start").collect()
    assert [r.doc_id for r in rows] == sorted((k for k, _ in texts), key=lambda k: (k is not None, k))
    for r in rows:
        assert r.start == at
        at += r.n_tokens
    assert sorted(r.ids_crc32 for r in rows) == sorted(zlib.crc32(own.ids(t) + b"\0" * 4) for _, t in texts)
    op10.write_ids(df.limit(0), f"{tmp_path}/b", P.path("byte_bpe_50k.json"))
    assert op10.read_documents(spark, f"{tmp_path}/b").count() == 0


def test_blocks_are_independent():
    ids = np.random.default_rng(2).zipf(1.3, 5000) % 50000
    whole = op10.encode_ids(ids)
    assert (op10.decode_ids(whole) == ids).all() and len(whole) < 2 * len(ids)
    second = op10.encode_ids(ids[op10.BLOCK : 2 * op10.BLOCK])
    assert second[16:] in whole  # a block's words are the same wherever it lies
    with pytest.raises(ValueError):
        op10.decode_ids(whole[: len(whole) // 2] + bytes([whole[len(whole) // 2] ^ 255]) + whole[len(whole) // 2 + 1 :])


def test_query_columns(spark):
    for name, op, rest, part, at in (("op3", op3.op3_toxicity, 3, 1, 0.7), ("op8", op8.op8_quality_classifier, 5, 0, 0.3)):
        rows = op(spark, "/root/testdata/sf0.01").collect()
        assert len(rows) == 1000 or len(rows) == spark.read.parquet("/root/testdata/sf0.01/documents.parquet").count(), name
        for r in rows:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % rest == part) and r.predicted == (r.score >= at) and 0 <= r.score <= 1


def test_held_out(spark):
    """Rows that no label was learnt from."""
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    t = op3.op3_toxicity(spark, "/root/testdata/sf0.1").where("held_out").join(labels, "doc_id").groupBy("toxic").agg(F.avg("predicted").alias("p")).collect()
    got = {r.toxic: r.p for r in t}
    assert got[1] > 0.35 and got[0] < 0.02
    q = op8.op8_quality_classifier(spark, "/root/testdata/sf0.1").where("held_out").join(labels, "doc_id").groupBy("quality").agg(F.avg("predicted").alias("p")).collect()
    got = {r.quality: r.p for r in q}
    assert got[1] > 0.98 and got[0] < 0.05


def test_packing_is_as_good_as_document_by_document(spark):
    r = np.random.default_rng(3)
    df = spark.createDataFrame([(i, "word " * int(n)) for i, n in enumerate(r.integers(1, 60, 300))], "doc_id long, text string")
    rows = op4.pack_documents(df, P.path("word_bpe_49k.json"), limit=64).collect()
    room = []
    for n in sorted((x.length for x in rows), reverse=True):  # best fit, longest first, one by one
        fits = [i for i, x in enumerate(room) if x >= n]
        if fits:
            room[min(fits, key=lambda i: room[i])] -= n
        else:
            room.append(64 - n)
    assert len({x.sequence_id for x in rows}) <= len(room)


def test_pairs_of_entries_are_judged_without_merging_them():
    own = op6.RankCodec(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    r, entries = np.random.default_rng(4), sorted(own.halves)
    pairs = [(entries[i], entries[j]) for n in (300, 3000, len(entries)) for i, j in r.integers(0, n, (1000, 2))]
    slow = {(a, b): own.merged(own.bytes_of[a] + own.bytes_of[b]) == [a, b] for a, b in pairs}
    assert 0 < sum(slow.values()) < len(slow)
    own.merged = None
    assert all(own.fits(a, b) == x for (a, b), x in slow.items())
    assert np.frombuffer(own.encode("unheardofcompositions\nof  letters\t"), "<u4").size > 3


def test_digits_adapt_as_sixteen_counts():
    """Four counts in a word are counted, halved and summed as sixteen plain ones, and the decoder finds the digits."""
    lanes, steps = 3, 700
    digits = np.random.default_rng(6).zipf(1.4, (steps, lanes)) % 16
    plain, lane = np.ones((lanes, 16), np.int64), np.arange(lanes)
    coder, counts = op10.Coder(lanes), np.full((lanes, 4), op10.ONES, np.int64)
    for row in digits:
        coder.digit(lane, counts, lane, row)
        full = plain.sum(1) > op10.MOST - op10.STEP
        plain[lane, row] += op10.STEP
        plain[full] = plain[full] + 1 >> 1
        assert (counts.view(np.int16) == plain).all()
    words = coder.finish()
    grid = np.zeros((lanes, max(map(len, words)) + 4), np.int64)
    for k, w in enumerate(words):
        grid[k, : len(w)] = w
    coder, counts = op10.Coder(lanes, grid), np.full((lanes, 4), op10.ONES, np.int64)
    assert all((coder.digit(lane, counts, lane, None) == row).all() for row in digits)


def test_token_ids_in_the_jvm(spark):
    """Spark's tasks code ids in the JVM, with the bytes of the NumPy coder, and find damage."""
    from loomspark.llm import jvm

    rng = np.random.default_rng(8)
    groups = [rng.zipf(1.3, n) % 50000 for n in (0, 1, 2048, 2049, 7000)] + [rng.integers(0, 65536, 5000), np.tile(rng.integers(0, 60000, 40), 130)]
    rows = spark.createDataFrame([(k, bytearray(ids.astype("<u2").tobytes())) for k, ids in enumerate(groups)], "k int, ids binary")
    found = dict(rows.select("k", jvm.function(spark, "TokenIds", "Encode", "binary", "ids")).collect())
    assert [bytes(found[k]) for k in range(len(groups))] == [op10.encode_ids(ids) for ids in groups]

    def documents(payload):
        kind = "array<struct<doc_id: bigint, inner: bigint, n_tokens: bigint, ids_crc32: bigint>>"
        return spark.createDataFrame([(payload,)], "payload binary").select(F.inline(jvm.function(spark, "TokenIds", "Decode", kind, "payload"))).collect()

    for ids in groups:
        n = len(ids) // 3
        parts, payload = [ids[:n], ids[n:]], bytearray(op10.pack_group([None, -7], [x.astype("<u4").tobytes() for x in (ids[:n], ids[n:])]))
        assert [tuple(r) for r in documents(payload)] == [(k, at, len(x), zlib.crc32(x.astype("<u4").tobytes())) for k, at, x in zip((None, -7), (0, n), parts)]
        if len(ids) > 2048:
            payload[-len(payload) // 4] ^= 255
            with pytest.raises(Exception, match="is damaged"):
                documents(payload)


def test_byte_level_runs():
    """Texts cut at single spaces have the library's ids, whatever white space they hold, and runs are remembered."""
    own, rng = Remembered(P.path("byte_bpe_50k.json"), "byte"), random.Random(5)
    letters = [*"ab1.,'s \n\t é漢ß<|\xa0\u2003\x1c\x85\u0301\u200b\u0378", "  ", "'ll", "word", "<|endoftext|>", " x"]
    for _ in range(5000):
        text = "".join(rng.choices(letters, k=rng.randrange(14)))
        assert own.ids(text) == (own.encode_whole(text) if text else b""), repr(text)
    own.ids("some words, in a\nrow")
    assert {"words", "words,", "in"} <= own.spaced.keys()
