"""Quality rules with risk-controlled cutoffs, in DataFrame functions alone.

Base measures come from each whole text. Five rules compare a document's measure, in whole steps of a fixed grid, with a
cutoff of its stratum (its language). A cutoff is admitted if the labelled good documents of the stratum show, by the
exact binomial tail, that rejecting at it and above has a false-rejection rate of at most ``ALPHA`` / rules: the chance
of so few rejections under a higher rate must be at most ``DELTA`` / (strata * rules * steps), which is Bonferroni's
correction for all cutoffs tried. So with probability 1 - ``DELTA`` no stratum loses more than ``ALPHA`` of its good
documents. Of the admitted cutoffs the lowest holds; a stratum without enough labels has none and rejects nothing.

Null texts count as empty, null languages as ''. Repeated rows are judged alike. A text without words has zero
measures. An empty table gives no rows. Windows are compared by 64-bit hashes. Other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table, unused

ALPHA, DELTA = 0.05, 0.05
STEPS = 50
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Rule -> measure in whole steps; more is worse.
RULES = {
    "symbols": "50 * n_symbols div word_chars",
    "word_length": "word_chars div n_words",
    "dup_lines": "50 * n_dup_lines div n_lines",
    "repeats": "50 * n_repeat_words div n_words",
    "capitals": "50 * n_capitals div word_chars",
}


def let(value: Column, use) -> Column:
    """use(value) with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def repeated_words(words: Column, width: int) -> Column:
    """Words covered by windows of ``width`` words that occur at least twice in the array."""

    def covered(hashes: Column) -> Column:
        sorted_ = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def positions(s: Column) -> Column:
            same = lambda e, j: F.coalesce(F.get(s, j)["h"] == e["h"], F.lit(False))
            return F.sort_array(F.transform(F.filter(s, lambda e, j: same(e, j - 1) | same(e, j + 1)), lambda e: e["i"]))

        start = F.struct(F.lit(-width).alias("last"), F.lit(0).cast("long").alias("sum"))
        total = F.aggregate(let(sorted_, positions), start, lambda acc, p: F.struct(p.alias("last"), (acc["sum"] + F.least(F.lit(width), p - acc["last"])).alias("sum")), lambda acc: acc["sum"])
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(total)

    def of(hashed: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(1), F.size(hashed) - (width - 1)), lambda i: F.xxhash64(F.slice(hashed, i, F.lit(width))))
        return F.when(F.size(hashed) < width, F.lit(0).cast("long")).otherwise(let(windows, covered))

    return let(F.transform(words, lambda w: F.xxhash64(w)), of)


def measured(docs: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang", also: dict[str, Column] | None = None) -> DataFrame:
    """key, stratum, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines and n_capitals of each row.

    ``also``: further columns to carry along, by name.
    """
    more = {n: c.alias(n) for n, c in (also or {}).items()}
    t = F.coalesce(F.col(text), F.lit(""))
    count = lambda of, chars: F.length(of) - F.length(F.translate(of, chars, ""))
    words = F.filter(F.split(t, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    # each array is computed once, inside one expression
    by_words = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w, 8).alias("n_repeat_words")))
    by_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    got = docs.select(*more.values(), F.col(key).alias("doc_id"), F.coalesce(F.col(stratum), F.lit("")).alias("stratum"), by_words.alias("w"), by_lines.alias("x"), F.length(F.translate(t, SPACES, "")).cast("long").alias("word_chars"), count(t, SYMBOLS).cast("long").alias("n_symbols"), count(t, CAPITALS).cast("long").alias("n_capitals"))
    return got.select(*more, "doc_id", "stratum", "w.*", "x.*", "word_chars", "n_symbols", "n_capitals")


def steps() -> Column:
    """array<struct<rule, step>> of a measured row; a text without words is at step 0 of each."""
    return F.array(*(F.struct(F.lit(r).alias("rule"), F.least(F.coalesce(F.expr(f"case when n_words > 0 then {e} end"), F.lit(0)), F.lit(STEPS)).cast("int").alias("step")) for r, e in RULES.items()))


def admitted_cutoffs(good: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(stratum, rule, cutoff) from measured good documents, of every stratum with enough of them."""
    rate = alpha / len(RULES)
    totals = good.groupBy("stratum").agg(F.count("*").alias("n"))
    strata = max(1, totals.count())
    level = delta / (strata * len(RULES) * STEPS)
    counts = good.select("stratum", F.explode(steps()).alias("s")).groupBy("stratum", "s.rule", "s.step").count()
    # with fewer documents not even a cutoff without rejections is admitted
    enough = totals.where(F.col("n") * math.log1p(-rate) <= math.log(level))
    tried = enough.crossJoin(good.sparkSession.range(1, STEPS + 1).select(F.col("id").cast("int").alias("cutoff"))).select("stratum", "n", "cutoff", F.explode(F.array(*map(F.lit, RULES))).alias("rule"))
    over = counts.withColumnRenamed("count", "c").join(tried, ["stratum", "rule"]).where("step >= cutoff").groupBy("stratum", "rule", "cutoff").agg(F.sum("c").alias("k"))
    k = F.coalesce(F.col("k"), F.lit(0))
    # log of P(Bin(n, rate) <= k), term by term; hopeless counts are not summed
    odds, keep = math.log(rate) - math.log1p(-rate), math.log1p(-rate)
    step = lambda acc, i: let(acc["t"] + F.log((F.col("n") - i + 1) / i) + odds, lambda t: F.struct(t.alias("t"), (F.greatest(acc["s"], t) + F.log1p(F.exp(-F.abs(acc["s"] - t)))).alias("s")))
    first = F.struct((F.col("n") * keep).alias("t"), (F.col("n") * keep).alias("s"))
    tail = F.aggregate(F.filter(F.sequence(F.lit(0).cast("long"), k), lambda i: i > 0), first, step, lambda acc: acc["s"])
    admitted = tried.join(over, ["stratum", "rule", "cutoff"], "left").where(k <= F.col("n") * rate).where(tail <= math.log(level))
    return admitted.groupBy("stratum", "rule").agg(F.min("cutoff").alias("cutoff"))


def cutoffs(good: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> list[tuple[str, str, int]]:
    """The rows of ``admitted_cutoffs`` in the driver."""
    return [tuple(r) for r in admitted_cutoffs(good, alpha, delta).orderBy("stratum", "rule").collect()]


def judged(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Measured rows with base_failed and kept. found: (stratum, rule, cutoff)."""
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    own, of = unused(rows, "limits"), unused(rows, "limits_of")
    limit = lambda r: F.coalesce(F.max(F.when(F.col("rule") == r, F.col("cutoff"))), F.lit(STEPS + 1))
    limits = found.groupBy(F.col("stratum").alias(of)).agg(F.array(*map(limit, RULES)).alias(own))
    over = [F.coalesce(F.get(steps(), i)["step"] >= F.get(F.col(own), i), F.lit(False)) for i in range(len(RULES))]
    rejected = F.lit(False)
    for x in over:
        rejected = rejected | x
    # one row of each stratum with a cutoff, thus at most one for about a thousand labels
    rows = rows.join(F.broadcast(limits), F.col("stratum") == F.col(of), "left")
    return rows.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & ~rejected).drop(own, of)


def rules(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang", also: dict[str, Column] | None = None) -> DataFrame:
    """labels: (key, label 1 good or 0). Measured rows of ``docs`` with base_failed and kept; the key is named doc_id."""
    rows = cut(measured(docs, key, text, stratum, also))
    good = labels.where("label = 1").select(F.col(key).alias("good_id")).distinct()
    return judged(rows, cut(admitted_cutoffs(rows.join(good, F.col("doc_id") == F.col("good_id"), "left_semi"))))


def passing(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang") -> DataFrame:
    """The rows of ``docs`` that the rules keep. Every row is measured once and judged in place; whole rows are never shuffled."""
    kept = rules(docs, labels, key, text, stratum, {"own_row": F.struct("*")})
    return kept.where("kept").select("own_row.*")


RESULT = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return rules(table(spark, sf_dir, "documents"), labels).select(*RESULT)


_SQL_RULES = " UNION ALL ".join(f"SELECT doc_id, stratum, '{r}' AS rule, least(coalesce(CASE WHEN n_words > 0 THEN {e.replace(' div ', ' // ')} END, 0), {STEPS}) AS step FROM m" for r, e in RULES.items())
ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
  [x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS ls FROM d),
win AS (SELECT doc_id, i, array_to_string(ws[i:i+7], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY doc_id),
m AS (SELECT d.doc_id, d.stratum, CAST(len(w.ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS BIGINT) AS n_capitals,
  CAST(len(w.ls) AS BIGINT) AS n_lines, CAST(len(w.ls) - len(list_distinct(w.ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words
  FROM d JOIN w USING (doc_id) LEFT JOIN cov USING (doc_id)),
s AS ({_SQL_RULES}),
good AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1),
gs AS (SELECT s.* FROM s JOIN good USING (doc_id)),
tot AS (SELECT stratum, count(DISTINCT doc_id) AS n FROM gs GROUP BY stratum),
tried AS (SELECT stratum, n, rule, cutoff FROM tot, (SELECT DISTINCT rule FROM s), (SELECT unnest(range(1, {STEPS + 1})) AS cutoff)),
k AS (SELECT tried.stratum, tried.n, tried.rule, tried.cutoff, count(gs.doc_id) AS k FROM tried LEFT JOIN gs ON gs.stratum = tried.stratum AND gs.rule = tried.rule AND gs.step >= tried.cutoff GROUP BY ALL),
tail AS (SELECT stratum, rule, cutoff, sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({ALPHA / len(RULES)}) + (n - i) * ln(1 - {ALPHA / len(RULES)}))) AS p
  FROM (SELECT *, unnest(range(0, k + 1)) AS i FROM k WHERE k <= n * {ALPHA / len(RULES)}) GROUP BY ALL),
cuts AS (SELECT stratum, rule, min(cutoff) AS cutoff FROM tail WHERE p <= {DELTA} / ((SELECT count(*) FROM tot) * {len(RULES) * STEPS}) GROUP BY ALL),
bad AS (SELECT DISTINCT s.doc_id FROM s JOIN cuts ON s.stratum = cuts.stratum AND s.rule = cuts.rule AND s.step >= cuts.cutoff)
SELECT m.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND bad.doc_id IS NULL AS kept
FROM m LEFT JOIN bad USING (doc_id)
"""
