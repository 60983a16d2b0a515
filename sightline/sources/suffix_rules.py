"""Public-suffix rules from a rule file: one rule a line up to the first white space, // comments, wildcards (*.), exceptions (!), and two sections between marks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType

# The marks of the sections of a rule file, and what rules in them are called.
SECTIONS = {"ICANN DOMAINS": "icann", "PRIVATE DOMAINS": "private"}


@F.pandas_udf(StringType())
def _ascii(rules: pd.Series) -> pd.Series:
    """Rules as host names have them, with each label in its ASCII form; null where there is none."""

    def one(rule: str) -> str | None:
        try:
            return ".".join(label if label == "*" else label.encode("idna").decode("ascii") for label in rule.split("."))
        except UnicodeError:
            return None

    return rules.map(one)


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """rule, kind of a rule file, distinct. Lines outside the sections, blank lines and comments are no rules; case does not matter; rules in other scripts are turned into ASCII labels.
    The file is read whole, as a section's mark counts for all lines after it; such files have some ten thousand lines."""
    text = spark.read.text(path, wholetext=True)
    rows = []
    for mark, kind in SECTIONS.items():
        inside = F.regexp_extract("value", rf"(?s)//\s*===BEGIN {mark}===(.*?)(?://\s*===END {mark}===|//\s*===BEGIN |$)", 1)
        rows.append(text.select(F.explode(F.split(inside, r"\r?\n")).alias("line"), F.lit(kind).alias("kind")))
    rule = F.lower(F.regexp_extract(F.trim("line"), r"^(\S+)", 1))
    rules = rows[0].unionByName(rows[1]).filter("not startswith(trim(line), '//')").select(rule.alias("rule"), "kind").filter("rule <> ''")
    sign = F.when(F.col("rule").startswith("!"), "!").otherwise("")
    plain = F.regexp_replace(F.regexp_replace("rule", "^!", ""), "^[.]", "")
    return rules.select(F.concat(sign, _ascii(plain)).alias("rule"), "kind").filter("rule is not null").distinct()
