import base64
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from loomspark.llm import common, memo, op1, op2, op3, op4, op5, op6, op7, op8, op9, op10

SCHEMA = "doc_id long, text string, lang string, source string, anchor int, count int"
TEXTS = [None, "", " ", "\n\n", "one", "the quick brown fox " * 30, "The Quick brown fox " * 30, "mail a.b@mail1.example.com or +1 (743) 555-3824, 70.23.22.57 and 4737097684299439.", "x" * 20000, "é Σ 中文 <|endoftext|> don't  stop\x1c", "a\nb\na\nb " * 40]
KINDS = ("email", "ip", "card", "phone")


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if i % 2 else "en", None, i, 1) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[5], rows[1]], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_tokens(docs, empty):
    from tokenizers import Tokenizer

    for name, kind in (("word_bpe_49k.json", "word"), ("byte_bpe_50k.json", "byte")):
        library, own = Tokenizer.from_file(P.path(name)), memo.remembered(P.path(name), kind)
        rnd = random.Random(5)
        for t in [*filter(None, TEXTS), *("".join(rnd.choice(["a", "the", " ", "\n", "'s", "9", "!", "é", "  "]) for _ in range(30)) for _ in range(200))]:
            ids = library.encode(t, add_special_tokens=False).ids
            assert own.ids(t) == np.array(ids, "<u4").tobytes()
            if kind == "word":
                assert op1.count_texts([t], P.path(name)) == [len(ids)]
    got = op1.count_tokens(docs, P.path("word_bpe_49k.json"), 2048)
    assert got.count() == len(TEXTS) + 2 and op1.count_tokens(empty, P.path("word_bpe_49k.json"), 2048).count() == 0


def test_memory_of_ids():
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    own, text = memo.Remembered(path, "word", 50), " ".join(f"a{i % 170}'s {'xyz' * (i % 40)} b" for i in range(400))
    assert own.ids(text) == np.array(Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    for held in (own.known, own.pieces):
        kept = {**held.old, **held}
        assert len(kept) <= 100 and max(map(len, kept)) <= memo.SHORT
    assert "b" in {**own.known.old, **own.known}
    memo.remembered(path, "word")
    memo.forget()
    assert memo.remembered.cache_info().currsize == 0


def test_byte_bpe(docs):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in op6.digests(docs, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).collect():
        t = TEXTS[r.doc_id] or ""
        assert r.ids_sha256 == hashlib.sha256(np.array(library.encode_ordinary(t), "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_packing(docs, empty):
    rows = op4.pack_documents(docs, P.path("word_bpe_49k.json"), limit=64).collect()
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 64
    assert len(bins) <= 1.25 * -(-sum(r.length for r in rows) // 64)
    assert op4.pack_documents(empty, P.path("word_bpe_49k.json")).count() == 0


def test_token_files(spark, docs, tmp_path):
    op10.write_ids(docs, f"{tmp_path}/ids", P.path("byte_bpe_50k.json"))
    own, start = memo.remembered(P.path("byte_bpe_50k.json"), "byte"), 0
    for r in op10.read_documents(spark, f"{tmp_path}/ids").orderBy("start").collect():
        ids = own.ids(TEXTS[r.doc_id]) + b"\0" * 4
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids) // 4, zlib.crc32(ids))
        start += len(ids) // 4
    data = bytearray(op10.encode_ids(np.arange(5000) % 50000))
    data[-40] ^= 1
    with pytest.raises((ValueError, IndexError)):
        op10.decode_ids(bytes(data))


def test_near_duplicates(docs, empty):
    rows = op7.near_duplicates(docs).collect()
    fp = {r.doc_id: int(r.fingerprint, 16) for r in rows}
    for i, t in enumerate(TEXTS):
        assert fp[i] == op7.fingerprint(t, 4)
    component = {r.doc_id: r.component_id for r in rows}
    for a in fp:
        for b in fp:
            if (fp[a] ^ fp[b]).bit_count() <= 4:
                assert component[a] == component[b]
    assert op7.keep_one(docs).count() == len(set(component.values())) and op7.near_duplicates(empty).count() == 0
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2**63, 300, dtype=np.uint64)
    for k in range(5):  # pairs at distance 0 to 4 meet at some anchor
        y = x.copy()
        for i in range(len(y)):
            for bit in rng.choice(64, k, replace=False):
                y[i] ^= np.uint64(1 << int(bit))
        row, anchor = op7.replicas(x)
        row2, anchor2 = op7.replicas(y)
        have = set(zip(row.tolist(), anchor.tolist())) & set(zip(row2.tolist(), anchor2.tolist()))
        assert {r for r, _ in have} == set(range(300))


def test_embeddings(spark):
    rng = np.random.default_rng(1)
    centre = rng.normal(size=(6, 8))
    rows = [(i, (centre[i % 6] + rng.normal(size=8) * 0.25).tolist()) for i in range(120)] + [(200, None), (201, [0.0] * 8), (202, [float("nan")] * 8), (203, centre[0].tolist()), (204, centre[0].tolist())]
    got = {r.vec_id: r for r in op5.near_pairs(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 0.9).collect()}
    v = {i: np.array(x) / np.linalg.norm(x) for i, x in rows if x and np.isfinite(x).all() and np.any(x)}
    for i in got:
        want = sum(j != i and v[i] @ v[j] >= 0.9 for j in v) if i in v else 0
        assert got[i].n_links == want
        assert all(got[j].component_id == got[i].component_id for j in v if i in v and v[i] @ v[j] >= 0.9)


def test_rules(docs, spark, empty):
    labels = spark.createDataFrame([(5, 1)], "doc_id long, label int")
    for r in op2.rules(docs, labels).collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", TEXTS[r.doc_id] or "")
        windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
        again = {p for i, w in enumerate(windows) if windows.count(w) > 1 for p in range(i, i + 8)}
        assert (r.n_words, r.n_repeat_words, r.word_chars) == (len(words), len(again), sum(map(len, words)))
    good = op2.measured(spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("a plain text of words").alias("text"), F.lit("en").alias("lang")))
    found = op2.cutoffs(good)
    assert {r for _, r, _ in found} == set(op2.RULES) and op2.cutoffs(good.limit(50)) == []
    assert op2.rules(empty, labels).count() == 0


def test_personal_data(docs):
    def base(t):
        for k, p in enumerate((r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")):
            for m in re.finditer(p, t):
                d = [int(c) for c in m[0] if c.isdigit()]
                luhn = sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(d[::-1])) % 10 == 0
                if k == 0 or k == 1 and all(int(x) <= 255 for x in m[0].split(".")) or k == 2 and 12 <= len(d) <= 19 and luhn or k == 3 and 9 <= len(d) <= 15:
                    yield m.start(), k, m.end()

    for r in op9.find_personal_data(docs).collect():
        want = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(base(TEXTS[r.doc_id] or "")))
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
    clean = {r.doc_id: r.text for r in op9.redact(docs).collect()}
    assert clean[7] == "mail [EMAIL] or [PHONE], [IP] and [CARD]." and clean[0] is None and clean[5] == TEXTS[5]


def test_classifiers(spark, docs):
    rnd = random.Random(2)
    words = [a + b for a in ("ab", "ho", "ri", "sto", "gre", "li", "pa", "nor", "ka", "mu") for b in ("le", "use", "ver", "ne", "en", "ght")]
    rows = []
    for i in range(160):
        t = [rnd.choice(words) for _ in range(60)]
        if i % 2:
            t[10:10] = ["horrible", "awful"]
            t[40:40] = ["awful"]
        rows.append((i, " ".join(t) if i % 4 < 2 else "\n".join(w.upper() + "!!" for w in t), int(i % 4 < 2), i % 2))
    df = spark.createDataFrame(rows, "doc_id long, text string, q int, x int")
    s = op8.score(df, op8.fit(df, df.select("doc_id", F.col("q").alias("label"))), 0.5).join(df, "doc_id")
    assert s.where("predicted = q").count() > 150
    s = op3.score(df, op3.fit(df, df.select("doc_id", F.col("x").alias("label"))), 0.5).join(df, "doc_id")
    assert s.where("predicted = x").count() > 130
    none = spark.createDataFrame([], "doc_id long, label int")
    assert op8.fit(docs, none) is None and op3.fit(docs, none) is None
    assert op3.score(docs, None, 0.7).count() == op8.score(docs, None, 0.3).count() == len(TEXTS) + 2


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (102, 101)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[102] == got[101] == got[100] == 100
