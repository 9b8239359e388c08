import os
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomspark.llm import common, op7, similar


def texts():
    """Near copies with similarities around 0.8, a chain of them, a common passage and texts made of it alone."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    passage = [word() for _ in range(40)]
    out = [None, "", "One two", "one  TWO", "one two three"]
    for _ in range(12):
        base = [word() for _ in range(r.randint(30, 120))] + (passage if r.random() < 0.5 else [])
        out.append(" ".join(base))
        for _ in range(5):
            other = list(base)
            for at in r.sample(range(len(other)), r.randint(1, max(1, len(other) // 30))):
                other[at] = word()
            out.append(" ".join(other))
    base = list(passage)
    for i in range(14):
        out.append(" ".join(base))
        base = [*base[1:], word()] if i % 2 else [*base, word()]
    return out


def sets_of(text):
    words = (text or "").lower().split()
    k = min(5, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()


def groups(all_texts):
    sets = [sets_of(t) for t in all_texts]
    group = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                group = [group[j] if g == group[i] else g for g in group]
    return group


@pytest.mark.parametrize("window, tile, often", [(8, 2048, 8), (1, 3, 2)])
def test_keep_one_by_similarity(spark, monkeypatch, window, tile, often):
    for name, value in (("WINDOW", window), ("TILE", tile), ("OFTEN", often), ("EVERY", 1 if tile == 3 else similar.EVERY)):
        monkeypatch.setattr(similar, name, value)
    rows = list(enumerate(texts()))
    group = groups([t for _, t in rows])
    least = {g: min(i for i, x in enumerate(group) if x == g) for g in group}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id for r in op7.keep_one(docs, words=5, similarity=(4, 5)).collect()}
    assert got == set(least.values()) and len(got) < len(rows) - 20


def test_pipeline_stage_removes_copies_of_085(spark, tmp_path):
    r = random.Random(1)
    words = ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(200)]
    other = list(words)
    for at in (40, 100, 160):
        other[at] = "changed"
    assert 0.8 <= len(sets_of(" ".join(words)) & sets_of(" ".join(other))) / len(sets_of(" ".join(words)) | sets_of(" ".join(other))) < 0.88
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(other))], "doc_id long, text string").withColumn("lang", F.lit("en"))
    assert [x.doc_id for x in corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)).collect()] == [1]


def test_keep_one_finds_copies_by_fingerprints(spark, monkeypatch):
    monkeypatch.setattr(similar, "possible", lambda rows, other, num, den: np.zeros(len(rows), bool))  # the prefix filter gives nothing
    r = random.Random(3)
    rows = []
    for i in range(6):
        words = ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(400)]
        rows += [(3 * i, " ".join(words)), (3 * i + 1, " ".join([*words, "end"])), (3 * i + 2, " ".join([*words[:200], *words[:100]]))]
    sets = [np.array(sorted(similar.shingles(t, 5))) for _, t in rows]
    prints = [similar.fingerprint_of(s) for s in sets]
    assert all((prints[i] ^ prints[i + 1]).bit_count() <= op7.BITS for i in range(0, 18, 3))
    assert all(len(np.intersect1d(sets[i], sets[i + 2])) * 5 < 4 * len(np.union1d(sets[i], sets[i + 2])) for i in range(0, 18, 3))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id for x in op7.keep_one(docs, words=5, similarity=(4, 5)).collect()}
    assert got == {i for i in range(18) if i % 3 != 1}


def test_chained_joins_each_group(spark, monkeypatch):
    rows = [(i % 7 if i < 300 else i, i * 37 % 11, i) for i in range(320)]
    listed = spark.createDataFrame(rows, "g long, fp long, c long").repartition(3)
    monkeypatch.setattr(similar, "WINDOW", 2)
    for size in ("3", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            pairs = similar.chained(listed).collect()
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        group = {c: g for g, _, c in rows}
        assert all(p.a < p.b and group[p.a] == group[p.b] for p in pairs) and len(pairs) == len(set(pairs))
        assert 7 * (43 + 42 - 2) - 12 * 3 <= len(pairs) <= sum(2 * n - 3 for n in [43] * 6 + [42])


def test_fingerprint_of():
    r = np.random.default_rng(4)
    for n in (0, 1, 2, 7, 60_001):
        h = r.integers(0, 1 << 63, n).astype(np.int64)
        bits = [2 * int((h >> b & 1).sum()) > n for b in range(64)]
        assert similar.fingerprint_of(h) == sum(1 << b for b in range(64) if bits[b])


def test_admitted_is_may_be():
    r = np.random.default_rng(2)
    sets = [np.unique(r.integers(0, 1 << 60, int(n))) for n in r.integers(1, 400, 60)] + [np.zeros(0, np.int64)]
    sets += [np.unique(np.concatenate([s[: len(s) * 9 // 10], r.integers(0, 1 << 60, len(s) // 12)])) for s in sets]
    tables = [similar.parities(s) for s in sets]
    x, y = np.nonzero(np.ones((len(sets), len(sets)), bool))
    n = np.array([len(s) for s in sets])
    got = similar.admitted(x, y, n[x], n[y], tables, 4, 5)
    assert got.tolist() == [similar.may_be(tables[i], tables[j], int(n[i]), int(n[j]), 4, 5) for i, j in zip(x, y)]
    alike = [5 * len(np.intersect1d(sets[i], sets[j])) >= 4 * len(np.union1d(sets[i], sets[j])) for i, j in zip(x, y)]
    assert got[alike].all() and 60 < sum(alike) and not got.all()


def test_release_removes_shuffle_files(spark, monkeypatch):
    def files():
        return spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()

    called = []
    monkeypatch.setattr(similar, "release", lambda s: called.append(common.release(s)))
    rows = [(i, f"{i} " + "some words that are the same in all of the texts " * 3) for i in range(20)]
    op7.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), words=5, similarity=(4, 5)).count()
    assert called
    common.release(spark)
    time.sleep(3)
    for i in range(3):
        common.cut(spark.range(50).repartition(5 + i).groupBy("id").count())
    before, end = files(), time.time() + 30
    assert before
    common.release(spark)
    while files() >= before and time.time() < end:
        time.sleep(0.5)
    assert files() < before


def test_components_estimates_stay_small(spark):
    """Estimates of size, to which joins multiply, are not carried from round to round; nor do rounds leave files."""
    ids = list(range(3000))
    random.Random(4).shuffle(ids)
    edges = spark.createDataFrame(list(zip(ids, ids[1:])), "a long, b long").repartition(8)
    got = common.components(edges)
    assert len(str(got._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 20
    assert {tuple(r) for r in got.collect()} == {(i, 0) for i in ids}
    folder = common.shared_dir(spark).removeprefix("file:")
    assert not [x for x in os.listdir(folder) if x.startswith("components-")]
    none = common.components(edges.where("a < 0"))
    assert none.columns == ["node", "component"] and none.count() == 0
