"""Filters and predicates.

Each is a plain ``filter`` so Catalyst pushes it into the scan where the
column comes straight from a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.functions.text import py_strip

ALL = "All"


def repo_scope(df: DataFrame, repo: str = "", col: str = "repo") -> DataFrame:
    """'' means all repositories."""
    return df if not repo else df.filter(F.col(col) == repo)


def language_or_global(df: DataFrame, language: str = "", col: str = "language") -> DataFrame:
    """rules of the language plus global ('') rules; '' = no filter."""
    if not language:
        return df
    return df.filter(F.col(col).isin(language, ""))


def rated(df: DataFrame) -> DataFrame:
    """only rows with a rating."""
    return df.filter(F.col("accepted") != -1)


def comment_matches(term: str, col: str = "comment"):
    """F12 predicate: case-insensitive regex on the trimmed term, NULL -> no match."""
    t = term.strip()
    return F.coalesce(F.col(col).rlike("(?i)" + t), F.lit(False))


def history_filter(df: DataFrame, repo: str = ALL, severity: str = ALL,
                   category: str = ALL, search: str = "") -> DataFrame:
    """F11 + F12: ANDed filters, 'All' disables one; blank search disables it."""
    out = df
    if repo != ALL:
        out = out.filter(F.col("repo") == repo)
    if severity != ALL:
        out = out.filter(F.col("severity") == severity)
    if category != ALL:
        out = out.filter(F.col("category") == category)
    if search.strip():
        out = out.filter(comment_matches(search))
    return out


def with_valid_date(df: DataFrame, col: str = "date") -> DataFrame:
    """drop rows with no valid date."""
    return df.filter(F.col(col).isNotNull())


def category_filter(df: DataFrame, category: str = ALL) -> DataFrame:
    """convention browser filter."""
    return df if category == ALL else df.filter(F.col("category") == category)


def non_blank_rules(df: DataFrame, col: str = "rule") -> DataFrame:
    """rules whose stripped text is empty are skipped."""
    return df.filter(py_strip(F.coalesce(F.col(col), F.lit(""))) != "")
