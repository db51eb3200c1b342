"""Convention rules from YAML files (S06) and load counters.

Each file is read whole (``wholetext``), and a Python UDTF yields one row
per rule, so files are parsed in parallel on the executors and no file
passes through the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

RULE_COLUMNS = "category string, language string, rule string, added_by string, repo string"


@udtf(returnType=RULE_COLUMNS)
class ConventionRules:
    """YAML text -> one row per item of its ``conventions`` list."""

    def eval(self, text: str):
        import yaml
        doc = yaml.safe_load(text or "") or {}
        items = doc.get("conventions", []) if isinstance(doc, dict) else doc
        for item in items or []:
            if not isinstance(item, dict):
                continue
            yield (item.get("category"), item.get("language"), item.get("rule"),
                   item.get("added_by"), item.get("repo"))


def read_convention_files(spark: SparkSession, path: str) -> DataFrame:
    """Every YAML file under ``path`` -> rule rows."""
    files = spark.read.text(path, wholetext=True)
    return files.lateralJoin(ConventionRules(F.col("value").outer())).drop("value")


def load_counters(rules: DataFrame) -> DataFrame:
    """A21 as one aggregation: rules read, skipped (blank) and written."""
    from revlens.functions.text import py_strip
    blank = py_strip(F.coalesce(F.col("rule"), F.lit(""))) == ""
    return rules.agg(F.count(F.lit(1)).alias("read"), F.count_if(blank).alias("skipped"),
                     F.count_if(~blank).alias("written"))


def observed_load(rules: DataFrame, name: str = "convention_load"):
    """A21 on a load job: the same counters collected with ``observe`` while
    the rows are written (no extra pass).  Returns (rows, Observation)."""
    from pyspark.sql import Observation
    from revlens.functions.text import py_strip
    obs = Observation(name)
    blank = py_strip(F.coalesce(F.col("rule"), F.lit(""))) == ""
    return rules.observe(obs, F.count(F.lit(1)).alias("read"), F.count_if(blank).alias("skipped"),
                         F.count_if(~blank).alias("written")), obs
