"""Parquet tables of a data folder; only Spark's readers and writers touch the paths, so any store works."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset, a local session (as in tests) has one under its warehouse; a cluster has no folder
    that could stand in for it."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (folder or spark.conf.get("spark.sql.warehouse.dir") + "/sightline").rstrip("/")


def written(rows: DataFrame, name: str) -> DataFrame:
    """``rows``, written under the shared folder and read back, which cuts their lineage."""
    folder = f"{shared_folder(rows.sparkSession)}/{name}-{uuid.uuid4().hex}"
    rows.write.parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)
