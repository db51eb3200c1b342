"""DuckDB oracle SQL fragments (independent of the Spark operators)."""

from __future__ import annotations

from revlens.sources.fixtures import with_fixtures  # noqa: F401

RATE = ("coalesce(CAST(count_if(accepted = 1) AS DOUBLE) / nullif(count_if(accepted <> -1), 0), 0.0)")


def ci(pred: str) -> str:
    """count_if as BIGINT (DuckDB returns HUGEINT)."""
    return f"CAST(count_if({pred}) AS BIGINT)"


def pct(x: str) -> str:
    return f"concat(CAST(round_even(({x}) * 100, 0) AS BIGINT), '%')"


NORM_SEV = ("CASE upper(severity) WHEN 'CRITICAL' THEN 'critical' WHEN 'WARNING' THEN 'high' "
            "WHEN 'SUGGESTION' THEN 'low' ELSE lower(severity) END")

ISO_TS = "coalesce(strftime(ts, '%Y-%m-%dT%H:%M:%S.%f'), '')"

# S07 store view over the reviews fixture
STORE_VIEW = f"""store AS (
  SELECT review_id, coalesce(repo, '') AS repo, coalesce(file, '') AS file,
         coalesce(severity, 'WARNING') AS severity, coalesce(category, 'general') AS category,
         coalesce(CAST(accepted AS INT), -1) AS accepted, {ISO_TS} AS timestamp,
         coalesce(comment, '') AS comment, coalesce(code_snippet, '') AS snippet,
         CAST(TRY_CAST({ISO_TS} AS TIMESTAMP) AS DATE) AS date
  FROM reviews)"""


def with_store(sql: str) -> str:
    """reviews fixture + the S07 store view as CTEs."""
    base = with_fixtures("SELECT 1", "reviews")
    head = base[: base.rindex("SELECT 1")].rstrip()
    return f"{head},\n{STORE_VIEW}\n{sql}"
