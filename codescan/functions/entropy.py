"""Character entropy and the secret-likeness test, as plain column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codescan.rules.languages import SECRET_PREFIXES

# Quoted literals with at least 12 leading plain characters.
STRING_LITERAL = r'"[^"\\]{12,}+(?:\\.[^"\\]*+)*+"|' r"'[^'\\]{12,}+(?:\\.[^'\\]*+)*+'"


def shannon_entropy(value: Column) -> Column:
    """Bits per character; one pass over the text per distinct character."""
    n = F.length(value)

    def term(ch):
        p = (n - F.length(F.replace(value, ch, F.lit("")))) / n
        return -p * F.log2(p)

    chars = F.array_distinct(F.split(value, ""))
    return F.coalesce(
        F.aggregate(F.transform(F.filter(chars, lambda c: c != ""), term), F.lit(0.0), lambda a, t: a + t),
        F.lit(0.0))


def has_secret_prefix(value: Column) -> Column:
    return F.greatest(*[value.startswith(p) for p in SECRET_PREFIXES])


def contains_secret_prefix(text: Column) -> Column:
    return F.greatest(*[text.contains(p) for p in SECRET_PREFIXES])


def secret_likeness(value: Column, entropy: Column) -> Column:
    """True when a literal looks like a credential, given its entropy."""
    long = F.length(value) >= 20
    plausible = (
        (F.length(value) >= 12)
        & ~value.rlike(r"^(https?://|//|/\*|\*/)")
        & (F.length(value) - F.length(F.replace(value, F.lit("/"), F.lit(""))) <= 4)
        & ~value.rlike("[ ()]")
    )
    bar = (F.when(has_secret_prefix(value), 3.0)
           .when(long & value.rlike("^[0-9a-fA-F]+$"), 3.5)
           .when(long & value.rlike("^[A-Za-z0-9+/=_-]+$"), 4.0)
           .when(long, 5.0))
    return plausible & (entropy >= bar)


def string_literals(text: Column) -> Column:
    """Array of literal contents, in order."""
    return F.transform(
        F.regexp_extract_all(text, F.lit(STRING_LITERAL), F.lit(0)),
        lambda q: F.substring(q, F.lit(2), F.length(q) - 2))
