import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from loomspark.llm import op2, op7, op8

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, chosen_key int, kept_key int, own_fp string, fp int, label int"
WORDS = [a + b + c for a in ("ab", "ho", "ri", "sto", "gre", "li", "pa") for b in ("le", "use", "ver", "ne", "en") for c in ("", "s", "ment")]


def prose(seed, n=120):
    r = random.Random(seed)
    return ". ".join(" ".join(r.choice(WORDS) for _ in range(8)) for _ in range(n // 8)) + "."


def near(text):
    words = text.split(" ")
    return " ".join([*words[:-1], "end."])


@pytest.fixture(scope="module")
def rows():
    long = prose(1, 600)
    texts = [(i, prose(i)) for i in range(40)]
    texts += [(100, prose(3)), (101, near(prose(1, 600))), (102, long), (103, ""), (104, None), (105, "#### $$$ %%% " * 40), (106, "one two"), (107, prose(77) + " mail a.b@example.com or +1 (743) 555-3824")]
    texts += [(None, prose(200)), (None, prose(201)), (None, prose(5)), (None, prose(201)), (None, None), (7, prose(7)), (8, prose(300)), (9, "## $$ " * 50), (108, prose(400, 6000)), (108, prose(400, 6000))]
    return [(k, t, None if i % 5 == 0 else "en", None, None if i % 7 == 0 else len(t or ""), i, i, "x", i, 1) for i, (k, t) in enumerate(texts)]


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, SCHEMA).coalesce(3).write.parquet(f"{path}/documents.parquet")
    labels = [(i, int(i < 40), 0) for i in range(40)] + [(105, 0, 0), (9, 0, 0), (None, 1, 0), (1, None, 0), (2, 1, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def same(a, b):
    assert sorted(map(repr, a)) == sorted(map(repr, b))


def test_stages_against_brute_force(spark, rows, folder):
    names = [c.split(" ")[0] for c in SCHEMA.split(", ")]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", F.col("quality").alias("label"))

    # quality classifier: every row by its own text
    model = op8.fit(docs, labels)
    want = [r for r in rows if op8.scores([r[1]], model)[0] >= 0.3]
    got = corpus_pipeline.quality_classifier(spark, docs, folder)
    assert got.columns == names
    same([tuple(r) for r in got.collect()], want)

    # rules, over all rows
    def base_fails(t):
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
        again = {p for i, w in enumerate(windows) if windows.count(w) > 1 for p in range(i, i + 8)} if len(words) < 500 else set()
        return len(words) < 20 or 100 * len(again) > 30 * len(words)

    got = corpus_pipeline.quality_rules(spark, docs, folder)
    assert got.columns == names
    same([tuple(r) for r in got.collect()], [r for r in rows if not base_fails(r[1])])  # too few labels for a cutoff

    # one of each component, over all rows; the smallest key's
    prints = [op7.fingerprint(r[1], 4) for r in rows]
    group = list(range(len(rows)))
    for _ in rows:
        for i, a in enumerate(prints):
            for j, b in enumerate(prints):
                if (a ^ b).bit_count() <= 4:
                    group[i] = group[j] = min(group[i], group[j])
    got = corpus_pipeline.near_duplicates(spark, docs, folder)
    assert got.columns == names
    kept = [tuple(r) for r in got.collect()]
    assert len(kept) == len(set(group)) and len({group[rows.index(r)] for r in kept}) == len(kept)
    for r in kept:
        keys = [x[0] for x, g in zip(rows, group) if g == group[rows.index(r)] and x[0] is not None]
        assert r[0] == (min(keys) if keys else None)

    # personal data
    got = corpus_pipeline.personal_data(spark, docs, folder)
    assert got.columns == names
    clean = {(r.doc_id, r.fp): r for r in got.collect()}
    for r in rows:
        t = clean[r[0], r[8]].text
        assert t == (r[1].replace("a.b@example.com", "[EMAIL]").replace("+1 (743) 555-3824", "[PHONE]") if r[0] == 107 else r[1])
        assert clean[r[0], r[8]].n_chars == (None if r[4] is None else len(t or ""))  # a null text keeps its number

    # packing
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    pieces = []
    for r in rows:
        ids = [*library.encode(r[1] or "", add_special_tokens=False).ids, 1]
        pieces += [(r[0], at // 4096, at, len(ids[at : at + 4096]), zlib.crc32(np.array(ids[at : at + 4096], "<u4").tobytes())) for at in range(0, len(ids), 4096)]
    got = corpus_pipeline.packing(spark, docs, folder).collect()
    same([tuple(r)[:5] for r in got], pieces)


def test_whole_run(spark, folder):
    rows = corpus_pipeline.run(spark, folder).collect()
    ids = [r.doc_id for r in rows if r.piece == 0]
    some = [i for i in ids if i is not None]
    assert len(some) == len(set(some)) + 1 and some.count(8) == 2  # copies go; two texts under one key are two documents
    assert {0, 1, 2, 4, 6, 107} <= set(ids) and not {100, 103, 104, 105, 106} & set(ids)
    assert ids.count(None) == 2  # of five rows without key a copy, a repeated row and a null text go


def test_empty_tables(spark, folder, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert corpus_pipeline.quality_classifier(spark, docs, str(tmp_path)).count() == docs.count()  # no labels: 0.5 for all
    assert op2.passing(docs.limit(0), spark.read.parquet(f"{folder}/labels.parquet").withColumn("label", F.col("quality"))).count() == 0
