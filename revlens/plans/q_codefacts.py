"""Registered code-fact queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from revlens import wording as W
from revlens.catalog import register
from revlens.operators import codefacts as CF
from revlens.operators import diffs as D
from revlens.plans.sql import with_fixtures
from revlens.sources.fixtures import fixture
from revlens.sources.samples import facts_sql

# Known facts of the generated source files (see the source_text template):
# run() spans the class body, helper() is nested in it, top_N() is top level.
_K = "CASE WHEN p_size % 3 = 0 THEN 2 ELSE 0 END"


@register("P01_P05_function_facts", with_fixtures(f"""
SELECT file_id, name, CAST(start_line AS INT) AS start_line, CAST(end_line AS INT) AS end_line,
       CAST(complexity AS INT) AS complexity, has_docstring, CAST(param_count AS INT) AS param_count, is_method
FROM (
  SELECT p_partkey AS file_id, 'run' AS name, 1 AS start_line, 6 + {_K} AS end_line,
         3 + CASE WHEN p_size % 3 = 0 THEN 1 ELSE 0 END AS complexity, p_size % 2 = 0 AS has_docstring,
         2 AS param_count, true AS is_method FROM part
  UNION ALL
  SELECT p_partkey, 'helper', 5 + {_K}, 6 + {_K}, 1, false, 0, false FROM part
  UNION ALL
  SELECT p_partkey, 'top_' || p_partkey, 8 + {_K}, 9 + {_K}, 1, false, 3, false FROM part)""", "source_text"))
def p01(spark, sf):
    out = CF.python_functions(fixture(spark, sf, "source_text"))
    return out.select("file_id", "name", "start_line", "end_line", "complexity", "has_docstring",
                      "param_count", "is_method")


_FACTS = ["file_id", "name", "start_line", "end_line", "complexity", "has_docstring", "param_count", "is_method"]


@register("P01_P06_mixed_sources", facts_sql())
def p06(spark, sf):
    """Functions of files of several shapes and languages."""
    return CF.functions(fixture(spark, sf, "code_samples")).select(*_FACTS)


@register("P01_function_sources", with_fixtures(f"""
SELECT f.file_id, f.name, f.start_line, array_to_string(string_split(s.source, chr(10))[f.start_line + 1:f.end_line + 1], chr(10)) AS source
FROM ({facts_sql()}) f JOIN code_samples s ON s.file_id = f.file_id""", "code_samples"))
def p01_source(spark, sf):
    """The text of each function's lines."""
    return CF.functions(fixture(spark, sf, "code_samples")).select("file_id", "name", "start_line", "source")


@register("A23_X31_function_summary", with_fixtures(f"""
SELECT repo, pr_number, filename,
       CASE WHEN regexp_matches(filename, '\\.py$') THEN '* function f_' || file_id || ', lines 0 to 1, complexity 1'
            ELSE '{W.NO_FUNCTIONS}' END AS functions_summary
FROM diff_files WHERE coalesce(patch, '') <> ''""", "diff_files"))
def a23(spark, sf):
    cf = D.changed_files(fixture(spark, sf, "diff_files"))
    return CF.function_summary(cf, ["repo", "pr_number", "filename"])
