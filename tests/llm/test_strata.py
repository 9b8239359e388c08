from pyspark.sql import functions as F

from loomspark.llm import op2


def test_every_stratum_has_its_cutoffs(spark):
    measures = {"n_words": 100, "word_chars": 500, "n_symbols": 0, "n_dup_lines": 0, "n_repeat_words": 0, "n_lines": 5, "n_capitals": 0}
    rows = spark.range(257 * 1500).select(F.col("id").alias("doc_id"), (F.col("id") % 257).cast("string").alias("stratum"), *(F.lit(v).cast("long").alias(n) for n, v in measures.items()))
    found = op2.cutoffs(rows)
    assert len({s for s, _, _ in found}) == 257 and len(found) == 257 * len(op2.RULES)
    bad = rows.where("doc_id < 257").withColumn("n_symbols", F.lit(400).cast("long"))
    few = bad.limit(1).withColumn("stratum", F.lit("other"))
    got = op2.judged(bad.unionByName(rows.where("doc_id < 257")).unionByName(few), op2.admitted_cutoffs(rows))
    assert got.columns == [*rows.columns, "base_failed", "kept"]
    assert {(r.n_symbols > 0, r.stratum == "other", r.kept) for r in got.collect()} == {(True, False, False), (False, False, True), (True, True, True)}
