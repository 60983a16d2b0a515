"""Binary artifacts, partitioned tables and reports of cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def read_artifacts(spark: SparkSession, folder: str) -> DataFrame:
    """path, id (file name), content of binary files, in folders of any depth."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "[!_.]*").load(folder)
    return files.select("path", F.regexp_extract("path", r"([^/]*)$", 1).alias("id"), "content")


def write_artifacts(rows: DataFrame, folder: str) -> None:
    """Artifacts (id, content) stored many to a file: with a file each, the driver lists and commits as many files as there are artifacts."""
    rows.select("id", "content").write.mode("errorifexists").parquet(folder)


def read_stored_artifacts(spark: SparkSession, folder: str) -> DataFrame:
    """path, id, content of artifacts that ``write_artifacts`` stored."""
    return spark.read.schema("id string, content binary").parquet(folder).select(F.col("_metadata.file_path").alias("path"), "id", "content")


def write_case_tables(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """One folder per case; an existing table is not overwritten."""
    df.write.mode("errorifexists").partitionBy("case_id").format(kind).save(path)


# How many events a report lists, and what it says of runs without assertions.
REPORT_EVENTS = 200
NO_ASSERTION = "- No candidate assertion was created."


def shown(value: Column) -> Column:
    """A value within back ticks: one line, without back ticks of its own."""
    return F.concat(F.lit("`"), F.regexp_replace(F.coalesce(value.cast("string"), F.lit("none")), r"[`\r\n]+", " "), F.lit("`"))


def report_lines(runs: DataFrame, facts: dict[str, Column], assertions: DataFrame, events: DataFrame, most: int = REPORT_EVENTS) -> DataFrame:
    """run_id, section, ord, line of a run's report: a title with its facts (columns of ``runs`` by name, in order), its assertions (run_id, ord, subject, type, object) or that there are none, and its
    first events (run_id, sequence, at, kind, event_id)."""
    title = runs.select("run_id", F.lit(0).alias("section"), F.lit(0).cast("long").alias("ord"), F.lit("# Run summary").alias("line"))
    listed = F.posexplode(F.array(*[F.concat(F.lit(f"- {name}: "), shown(value)) for name, value in facts.items()])).alias("ord", "line")
    header = runs.select("run_id", F.lit(0).alias("section"), listed).withColumn("ord", F.col("ord").cast("long") + 1)
    made = assertions.select("run_id", F.lit(1).alias("section"), F.col("ord").cast("long").alias("ord"), F.concat(F.lit("- "), shown(F.col("subject")), F.lit(" **"), "type", F.lit("** "), shown(F.col("object"))).alias("line"))
    none = runs.join(assertions.select("run_id").distinct(), "run_id", "left_anti").select("run_id", F.lit(1).alias("section"), F.lit(0).cast("long").alias("ord"), F.lit(NO_ASSERTION).alias("line"))
    log = events.filter(F.col("sequence") <= most).select("run_id", F.lit(2).alias("section"), F.col("sequence").cast("long").alias("ord"), F.concat(F.lit("- "), shown(F.col("at")), F.lit(" "), "kind", F.lit(" ("), shown(F.col("event_id")), F.lit(")")).alias("line"))
    return title.unionByName(header).unionByName(made).unionByName(none).unionByName(log)


def write_report(lines: DataFrame, path: str) -> None:
    """Report lines as JSON lines, the lines of a run together and in order."""
    lines.repartition("run_id").sortWithinPartitions("run_id", "section", "ord").write.mode("errorifexists").json(path)
