"""Parquet tables of one data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, directory: str, name: str, *columns: str) -> DataFrame:
    """Table ``name`` of ``directory``, cut to ``columns`` when given (the cut reaches the scan)."""
    frame = spark.read.parquet(f"{directory}/{name}.parquet")
    return frame.select(*columns) if columns else frame


def spread(frame: DataFrame) -> DataFrame:
    """A small input, of fewer partitions than there are cores, spread over the cores; any other as it is.

    One file of one row group is one task, however costly its rows are. Large inputs have many and are not shuffled.
    For scans and projections of scans only: counting the partitions of a plan with an exchange would run it.
    """
    cores = frame.sparkSession.sparkContext.defaultParallelism
    return frame.repartition(cores) if frame.rdd.getNumPartitions() < cores else frame
