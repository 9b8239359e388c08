"""Display and slug functions of strings, as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters with their plain forms.
PLAIN = dict(zip("àáâãäåçèéêëìíîïðñòóôõöøùúûüýÿāăąćčďđēěęğīıľłńňőřśşšťţůűźżž", "aaaaaaceeeeiiiidnoooooouuuuyyaaaccddeeegiillnnorssstt" + "uuzzz"))
LIGATURES = {"æ": "ae", "œ": "oe", "ß": "ss", "þ": "th"}


def slug(x: Column, longest: int = 255) -> Column:
    """Lower case, plain letters, every other run as one hyphen, none at the ends, at most ``longest`` characters."""
    c = F.lower(x)
    for a, b in LIGATURES.items():
        c = F.replace(c, F.lit(a), F.lit(b))
    c = F.translate(c, "".join(PLAIN), "".join(PLAIN.values()))
    c = F.regexp_replace(c, "[^a-z0-9]+", "-")
    return F.regexp_replace(F.substring(F.regexp_replace(c, "^-+|-+$", ""), 1, longest), "-+$", "")


def display_slug(x: Column) -> Column:
    """Without transliteration: other characters go, runs of space and hyphen become one hyphen."""
    c = F.regexp_replace(F.lower(x), r"[^a-z0-9\s-]", "")
    return F.regexp_replace(F.regexp_replace(c, r"[\s-]+", "-"), "^-+|-+$", "")


def initials(x: Column, n: int = 2) -> Column:
    """Upper-case first letters of the first ``n`` words."""
    words = F.filter(F.split(x, r"\s+"), lambda w: w != "")
    return F.array_join(F.transform(F.slice(words, 1, n), lambda w: F.upper(F.substring(w, 1, 1))), "")


def truncated(x: Column, longest: int = 30, end: str = "...") -> Column:
    """At most ``longest`` characters, the end mark included."""
    return F.when(F.length(x) <= longest, x).otherwise(F.concat(F.substring(x, 1, max(0, longest - len(end))), F.lit(end)))


def citation(names: Column) -> Column:
    """An array of names as one line: A; A & B; A, B & C; empty without names. Null names are left out."""
    known = F.array_compact(names)
    n = F.size(known)
    head = F.array_join(F.slice(known, F.lit(1), F.greatest(n - 1, F.lit(0))), ", ")
    return F.when(n > 1, F.concat(head, F.lit(" & "), F.element_at(known, -1))).when(n == 1, F.element_at(known, 1)).otherwise("")


def unique_slug(base: str, n: int) -> str:
    return base if n <= 1 else f"{base}-{n}"
