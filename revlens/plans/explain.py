"""Write the physical plans of the headline queries to a Markdown file.

    python -m revlens.plans.explain [sf_dir] [out.md]

``*(n)`` marks whole-stage codegen spans; FileScan lines show the pushed
filters and the pruned read schema; Exchange lines are the shuffles.
"""

from __future__ import annotations

import sys

HEADLINE = ["A05_repo_breakdown", "F04_delivery_disposition", "X05_changed_files", "J01_similar_reviews_scoped",
            "J03_relevant_conventions", "J04_functions_in_hunks", "J05_apply_feedback", "S09_get_filtered",
            "A14_A15_A18_J08_pr_rollup", "P01_P05_function_facts", "A17_findings_text"]


def plan_text(df, mode: str = "simple") -> str:
    jvm = df.sparkSession._jvm
    return jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)


def main(sf_dir: str = "/root/testdata/sf0.01", out: str = "docs/PLANS.md") -> None:
    from revlens.catalog import queries
    from revlens.session import get_session
    spark = get_session("local[8]", 8)
    qs = queries()
    parts = ["# Physical plans of the headline queries\n",
             f"Generated by `python -m revlens.plans.explain` on `{sf_dir}` (before adaptive re-planning).\n"]
    for name in HEADLINE:
        parts.append(f"## {name}\n\n```\n{plan_text(qs[name](spark, sf_dir)).strip()}\n```\n")
    with open(out, "w") as f:
        f.write("\n".join(parts))
    spark.stop()


if __name__ == "__main__":
    main(*sys.argv[1:])
