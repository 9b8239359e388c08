r"""Personal data by weak supervision, in DataFrame functions alone.

Base spans are four patterns with checks (address parts, Luhn, numbers of digits). The patterns are written so that a
search is linear in the text: possessive repeats where nothing that follows could use what they gave up, and starts only
where a run of their first characters starts or the last match ended.

Added spans, of three kinds: a ``secret`` candidate is every run of at least eight letters and digits that holds both, or
of nine or more digits alone; an ``iban`` candidate has the shape of an international account number; an ``ssn`` one that
of a social security number, 3-2-4 digits. Candidates that meet a base span are left out. Three labelers of each kind
vote: a pattern (for secrets the shape of a key or card number, for account numbers their check digits, for social
security numbers the ranges in use), a gazetteer (cue words before a secret or social security number, or the prefix of
a known sort of key; the countries with account numbers) and the context (an assignment or quote just before a secret, a
word for the number before the others). Expectation-maximisation over the counts of vote patterns of a kind (two hidden
classes, votes independent within a class; all other words of the texts are candidates without votes, so that a corpus
whose candidates are all personal data isn't split in two) gives each labeler's reliability and every vote pattern's probability. With
these as soft labels a naive Bayes classifier over votes, length, alphabet and case decides on spans. Votes and features
have few values, so only a table of bounded size (at most 3 * 8 * 4 * 3 * 3 rows) reaches the driver, and the counts
cover all candidates of the corpus.

Null and empty texts have no spans. Repeated rows are treated alike. An empty table gives no rows. Other columns are
ignored. Positions are code points, ends exclusive.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

KINDS = ("email", "ip", "card", "phone", "secret", "iban", "ssn")
#: Kinds that the method adds.
ADDED = KINDS[4:]
LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9])(?:[0-9]{9,}+(?![A-Za-z])|(?=[A-Za-z]*+[0-9])(?=[0-9]*+[A-Za-z])[A-Za-z0-9]{8,}+)(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: What a text must hold for a pattern to be tried.
NEEDS = {"email": "@", "phone": "+", "ssn": "-"}
#: Words that name a secret, and how keys of widely used services begin.
SECRET_WORDS = "password|passwd|passphrase|passcode|pwd|secret|token|bearer|authorization|credential|credentials|api_key|apikey|access_key|private_key|client_secret|signing_key|key|account|card|passport|login|pin|contraseña|clave|passwort|kennwort|schlüssel|mot de passe|clé|jeton"
KEY_PREFIXES = "AKIA|ASIA|AIza|ghp|gho|ghs|sk|pk|rk|xoxb|xoxp|glpat|npm|SG|ya29|eyJ"
#: Countries with international account numbers.
IBAN_COUNTRIES = ("AD", "AE", "AL", "AT", "AZ", "BA", "BE", "BG", "BH", "BR", "BY", "CH", "CR", "CY", "CZ", "DE", "DK", "DO", "EE", "EG", "ES", "FI", "FO", "FR", "GB", "GE", "GI", "GL", "GR", "GT", "HR", "HU", "IE", "IL", "IQ", "IS", "IT", "JO", "KW", "KZ", "LB", "LC", "LI", "LT", "LU", "LV", "LY", "MC", "MD", "ME", "MK", "MR", "MT", "MU", "NL", "NO", "PK", "PL", "PS", "PT", "QA", "RO", "RS", "SA", "SC", "SE", "SI", "SK", "SM", "ST", "SV", "TL", "TN", "TR", "UA", "VA", "VG", "XK")
IBAN_WORDS = "iban|bic|account|konto|kontonummer|bank|compte|cuenta|banque|banco"
SSN_WORDS = "ssn|social security|social|security|taxpayer|tin|itin"
BLOCK = 128


def let(value: Column, use) -> Column:
    """use(value) with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def ends_of(sizes: Column) -> Column:
    """Running sums of an array of sizes, in blocks: no step copies more than a block or the list of blocks."""

    def total(a: Column) -> Column:
        return F.aggregate(a, F.lit(0), lambda acc, x: acc + x)

    def of(s: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(s) - 1) / BLOCK).cast("int")), lambda b: total(F.slice(s, b * BLOCK + 1, F.lit(BLOCK))))
        before = let(blocks, lambda t: F.transform(t, lambda _, b: total(F.slice(t, F.lit(1), b))))
        return let(before, lambda t: F.transform(s, lambda _, i: F.get(t, F.floor(i / BLOCK).cast("int")) + total(F.slice(s, F.floor(i / BLOCK).cast("int") * BLOCK + 1, i % BLOCK + 1))))

    return F.when(F.size(sizes) == 0, F.array().cast("array<int>")).otherwise(let(sizes, of))


def matches(text: Column, kind: str) -> Column:
    """array<struct<start, end, k, m, before>> of all matches; k is the kind's number, before the text since the last."""
    pattern, k = PATTERNS[kind], KINDS.index(kind)

    def join(found: Column, pieces: Column) -> Column:
        sizes = F.transform(found, lambda m, i: F.length(F.get(pieces, i)) + F.length(m))
        return let(ends_of(sizes), lambda ends: F.transform(found, lambda m, i: F.struct((F.get(ends, i) - F.length(m)).alias("start"), F.get(ends, i).alias("end"), F.lit(k).alias("k"), m.alias("m"), F.substring(F.get(pieces, i), -24, 24).alias("before"))))

    none = F.array().cast("array<struct<start:int,end:int,k:int,m:string,before:string>>")
    got = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) == 0, none).otherwise(let(F.split(text, pattern, -1), lambda pieces: join(found, pieces))))
    return F.when(F.contains(text, F.lit(NEEDS[kind])), got).otherwise(none) if kind in NEEDS else got


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """Whether a string of digits passes."""
    n = F.length(d)

    def at(i: Column) -> Column:
        x = F.substr(d, n - i + 1, F.lit(1)).cast("int")
        twice = F.when(x > 4, 2 * x - 9).otherwise(2 * x)
        return F.when(i % 2 == 0, twice).otherwise(x)

    return F.aggregate(F.transform(F.sequence(F.lit(1), n), at), F.lit(0), lambda acc, x: acc + x) % 10 == 0


def passes(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(r"\A(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9]|)(?:\.|\z)){4}\z")
    if kind == "card":
        return let(digits(m), lambda d: F.length(d).between(12, 19) & F.when(F.length(d).between(12, 19), luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(digits(m)).between(9, 15)
    return F.lit(True)


def passing(kind: str):
    return lambda s: passes(kind, s["m"])


def of_kind(number: int):
    return lambda s: s["k"] == number


def remainder(m: Column) -> Column:
    """An account number's remainder by 97, letters as 10 to 35, its first four characters last."""
    chars = let(F.regexp_replace(m, "\\x20", ""), lambda x: F.split(F.concat(F.substr(x, F.lit(5)), F.substr(x, F.lit(1), F.lit(4))), ""))
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.filter(chars, lambda c: c != ""), F.lit(0), lambda acc, c: let(value(c), lambda v: (F.when(v > 9, acc * 100).otherwise(acc * 10) + v) % 97))


def votes(kind: str, m: Column, before: Column) -> list[Column]:
    """Regex, gazetteer and context labelers."""
    said = lambda words: F.lower(before).rlike(rf"(?<![a-z])(?:{words})[^a-z]{{0,6}}\z")
    if kind == "iban":
        out = [remainder(m) == 1, F.substr(m, F.lit(1), F.lit(2)).isin(*IBAN_COUNTRIES), said(IBAN_WORDS)]
    elif kind == "ssn":
        out = [m.rlike(r"\A(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)"), said(SSN_WORDS), before.rlike(r"[:#=]\s?\z")]
    else:
        shape = m.rlike(r"\A[0-9a-f]{32,}\z") | m.rlike(r"\A[0-9]{12,19}\z") | m.rlike(r"\A(?=.*[a-z])(?=.*[A-Z])(?=.*[0-9]).{16,}\z") | m.rlike(r"\A(?=.*[A-Z])(?=.*[0-9])[A-Z0-9]{16,}\z")
        out = [shape, said(SECRET_WORDS) | m.rlike(rf"\A(?:{KEY_PREFIXES})[A-Za-z0-9]{{12,}}") | before.rlike(rf"(?<![A-Za-z0-9])(?:{KEY_PREFIXES})[_.-]\z"), before.rlike(r"[=:]\s?[\"']?\z")]
    return [x.cast("int") for x in out]


def features(m: Column) -> list[Column]:
    size = F.length(m)
    return [
        F.when(size < 12, 0).when(size < 20, 1).when(size < 32, 2).otherwise(3),
        F.when(m.rlike(r"\A[0-9]+\z"), 0).when(m.rlike(r"\A[0-9a-fA-F]+\z"), 1).otherwise(2),
        F.when(~m.rlike("[A-Z]"), 0).when(~m.rlike("[a-z]"), 1).otherwise(2),
    ]


SIZES = (2, 2, 2, 4, 3, 3)
TABLE = 2 * 2 * 2 * 4 * 3 * 3


def combination(kind: str, m: Column, before: Column) -> Column:
    """One number for a candidate's kind, votes and features."""
    out = F.lit(ADDED.index(kind))
    for size, x in zip(SIZES, [*votes(kind, m, before), *features(m)]):
        out = out * size + x
    return out


def split_combination(number: int) -> tuple[int, ...]:
    """Votes and features, without the kind."""
    out = []
    for size in reversed(SIZES):
        number, x = divmod(number, size)
        out.append(x)
    return tuple(reversed(out))


def reliabilities(patterns: dict[tuple, int], rounds: int = 100) -> tuple[float, list[float], list[float], dict[tuple, float]]:
    """Expectation-maximisation over counts of vote patterns: the share of personal data, each labeler's chance to vote
    for it and for the rest, and every pattern's probability."""
    total = sum(patterns.values())
    soft = {v: float(sum(v) >= 2) for v in patterns}  # at first by majority
    prior, yes, no = 0.5, [0.5] * 3, [0.5] * 3  # P(vote | personal), P(vote | not)
    for _ in range(rounds):
        mass = sum(soft[v] * n for v, n in patterns.items())
        prior = min(0.999, max(1e-9, (mass + 1) / (total + 2)))
        for k in range(3):
            yes[k] = (sum(soft[v] * n for v, n in patterns.items() if v[k]) + 0.8) / (mass + 1)
            no[k] = (sum((1 - soft[v]) * n for v, n in patterns.items() if v[k]) + 0.2) / (total - mass + 1)
            yes[k], no[k] = (min(0.999, max(1e-6, p)) for p in (yes[k], no[k]))
        for v in patterns:
            a, b = math.log(prior), math.log(1 - prior)
            for k, x in enumerate(v):
                a += math.log(yes[k] if x else 1 - yes[k])
                b += math.log(no[k] if x else 1 - no[k])
            soft[v] = 1 / (1 + math.exp(min(50.0, max(-50.0, b - a))))
    return prior, yes, no, soft


def accepted(counts: dict[int, int], words: int, rounds: int = 100) -> list[int]:
    """Combinations that the classifier of their kind takes for personal data, from the counts of all combinations and
    the number of words, on which but for the candidates no labeler votes."""
    out = []
    for kind in range(len(ADDED)):
        own = {c: n for c, n in counts.items() if c // TABLE == kind}
        out += _accepted(own, max(0, words - sum(own.values())), rounds) if own else []
    return sorted(out)


def _accepted(counts: dict[int, int], others: int, rounds: int) -> list[int]:
    rows = [(split_combination(c), n) for c, n in sorted(counts.items())]
    patterns: dict[tuple, int] = {(0, 0, 0): others}
    for x, n in rows:
        patterns[x[:3]] = patterns.get(x[:3], 0) + n
    _, _, _, soft = reliabilities(patterns, rounds)
    # naive Bayes over votes and features, with the soft labels as weights
    weight = [[[1.0, 1.0] for _ in range(size)] for size in SIZES]
    for x, n in rows:
        for f, value in enumerate(x):
            weight[f][value][1] += n * soft[x[:3]]
            weight[f][value][0] += n * (1 - soft[x[:3]])
    sums = [[sum(v[c] for v in f) for c in (0, 1)] for f in weight]
    mass, total = sum(n * soft[x[:3]] for x, n in rows), sum(n for _, n in rows)
    prior = (mass + 1) / (total + 2)  # among candidates, which are few of all words
    out = []
    for (x, _), c in zip(rows, sorted(counts)):
        odds = math.log(prior / (1 - prior)) + sum(math.log(weight[f][v][1] / sums[f][1]) - math.log(weight[f][v][0] / sums[f][0]) for f, v in enumerate(x))
        if odds >= 0 and soft[x[:3]] >= 0.5:
            out.append(c)
    return out


def spans_of(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, list[int]]:
    """Checkpointed (key, base, more): base spans and candidates with their combinations; and the accepted ones."""
    t = F.coalesce(F.col(text), F.lit(""))
    narrow = lambda s: F.struct(s["start"].alias("start"), s["k"].alias("k"), s["end"].alias("end"))
    base = [F.transform(F.filter(matches(t, k), passing(k)), narrow) for k in KINDS[:4]]
    candidate = lambda kind: lambda s: F.struct(s["start"].alias("start"), s["k"].alias("k"), s["end"].alias("end"), combination(kind, s["m"], s["before"]).alias("c"))
    more = F.concat(*(F.transform(matches(t, kind), candidate(kind)) for kind in ADDED))
    words = (F.length(t) - F.length(F.translate(t, " \n", "")) + 1).cast("long")
    rows = docs.select(F.col(key).alias(key), F.sort_array(F.concat(*base)).alias("base"), more.alias("more"), words.alias("words"))
    free = F.filter("more", lambda c: ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    rows = cut(rows.select(key, "base", "words", F.when(F.size("base") == 0, F.col("more")).otherwise(free).alias("more")))
    counts = rows.select(F.explode("more.c").alias("c")).groupBy("c").count().collect()  # at most 3 * 288 rows
    return rows, accepted({r["c"]: r["count"] for r in counts}, rows.agg(F.sum("words")).first()[0] or 0)


def all_spans(taken: list[int]) -> Column:
    """Base and accepted spans in order."""
    added = F.transform(F.filter("more", lambda c: c["c"].isin(taken) if taken else F.lit(False)), lambda c: F.struct(c["start"].alias("start"), c["k"].alias("k"), c["end"].alias("end")))
    return F.sort_array(F.concat("base", added))


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["k"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, numbers of base spans, digest of the base spans, and all spans."""
    rows, taken = spans_of(docs, key, text)
    number = [F.size(F.filter("base", of_kind(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS[:4])]
    return rows.select(key, *number, F.sha2(written(F.col("base")).cast("binary"), 256).alias("base_sha256"), written(all_spans(taken)).alias("spans"))


def redact(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with each group of overlapping spans replaced by its first kind in brackets; other columns stay.

    The spans are found in the same pass over the text, so no join by key is needed and repeated keys do no harm.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    _, taken = spans_of(docs, key, text)
    narrow = lambda s: F.struct(s["start"].alias("start"), s["k"].alias("k"), s["end"].alias("end"))
    base = [F.transform(F.filter(matches(t, k), passing(k)), narrow) for k in KINDS[:4]]
    wanted = lambda kind: lambda s: combination(kind, s["m"], s["before"]).isin(taken) if taken else F.lit(False)
    more = F.concat(*(F.transform(F.filter(matches(t, kind), wanted(kind)), narrow) for kind in ADDED))
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))

    def rebuilt(spans: Column) -> Column:
        # what a span covers beyond all earlier ones; inside an earlier one nothing
        start = F.struct(F.lit(0).alias("to"), F.array().cast("array<struct<start:int,k:int,end:int,from:int>>").alias("out"))

        def step(acc: Column, s: Column) -> Column:
            own = F.struct(s["start"].alias("start"), s["k"].alias("k"), s["end"].alias("end"), acc["to"].alias("from"))
            return F.struct(F.greatest(acc["to"], s["end"]).alias("to"), F.when(s["end"] > acc["to"], F.concat(acc["out"], F.array(own))).otherwise(acc["out"]).alias("out"))

        def text_of(x: Column) -> Column:
            kept = F.transform(x["out"], lambda s: F.concat(F.substr(t, s["from"] + 1, F.greatest(s["start"] - s["from"], F.lit(0))), F.when(s["start"] >= s["from"], F.get(names, s["k"])).otherwise(F.lit(""))))
            return F.concat(F.array_join(kept, ""), F.substr(t, x["to"] + 1))

        return let(F.aggregate(spans, start, step), text_of)

    clean = let(F.sort_array(F.concat(*base, more)), lambda s: F.when(F.size(s) == 0, t).otherwise(rebuilt(s)))
    return docs.withColumn(text, F.when(F.col(text).isNotNull(), clean))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(table(spark, sf_dir, "documents"))
