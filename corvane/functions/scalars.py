"""Scalar helpers of the analyses, as native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SQL_VERBS = "SELECT|INSERT|UPDATE|DELETE"
IDENTIFIER = "^[A-Za-z_][A-Za-z0-9_]*$"


def sql_verb(x: Column) -> Column:
    return F.upper(x).rlike(SQL_VERBS)


def is_identifier(x: Column) -> Column:
    return x.rlike(IDENTIFIER)


def is_literal(x: Column) -> Column:
    return x.startswith('"') | x.startswith('L"') | x.startswith('u"')


def has_token(x: Column, token: str) -> Column:
    return F.array_contains(F.split(x, "[^A-Za-z0-9_]+"), token)


def collapsed(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def short_path(x: Column, parts: int = 2) -> Column:
    """The last segments of a path."""
    segments = F.split(x, "/")
    return F.array_join(F.slice(segments, F.greatest(F.size(segments) - parts + 1, F.lit(1)), parts), "/")


def line_count(x: Column) -> Column:
    return (F.length(x) - F.length(F.replace(x, F.lit("\n"))) + 1).cast("int")


def confidence(x: Column) -> Column:
    """Percentages become shares; then 0 to 1."""
    return F.least(F.greatest(F.when(x > 1, x / 100).otherwise(x), F.lit(0.0)), F.lit(1.0))


def saturating_add(a: Column, b: Column) -> Column:
    """The sum of two longs, held within the type's range."""
    wide = a.cast("decimal(20,0)") + b.cast("decimal(20,0)")
    return F.greatest(F.least(wide, F.lit((1 << 63) - 1).cast("decimal(20,0)")), F.lit(-(1 << 63)).cast("decimal(20,0)")).cast("bigint")


def effective_status(status: Column, review: Column) -> Column:
    """A review's word counts before the first verdict."""
    return F.when(review == "confirmed", "confirmed").when(review == "dismissed", "dismissed").when(review == "suspected-kept", "suspected").otherwise(status)


def severity_score(x: Column) -> Column:
    return F.when(x == "critical", 100).when(x == "high", 80).when(x == "medium", 60).when(F.coalesce(x, F.lit("")) != "", 40).otherwise(20)


def suspicion_score(x: Column) -> Column:
    return F.when(x == "confirmed", 1.0).when(x == "suspected", 0.7).otherwise(0.5)


def rank_score(severity: Column, suspicion: Column, weak_guard: Column | None = None) -> Column:
    """0.60 severity + 0.25 confidence in percent, less a fifth behind a weak guard, + 3 for critical and high."""
    share = suspicion_score(suspicion)
    if weak_guard is not None:
        share = F.when(weak_guard, share * 0.8).otherwise(share)
    return severity_score(severity) * 0.6 + share * 25.0 + F.when(severity.isin("critical", "high"), 3.0).otherwise(0.0)
