"""Hook events: one JSON object a line, read in batch or as a stream with the same explicit schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Nested arguments and results stay as the JSON text they came in; ``event_id`` is the sender's.
EVENT = "event_id long, session_id string, ts timestamp, hook_event_name string, tool_name string, cwd string, tool_input string, tool_response string"


def parsed(lines: DataFrame, line: str = "value", schema: str = EVENT) -> DataFrame:
    """The fields of ``schema`` and ``refused``: the line itself where it is no JSON object, else null.

    Blank lines are no events. Fields that are missing or of another type are null. Works on streams.
    """
    value = F.col(line)
    rows = lines.where(F.trim(value) != "").select(F.from_json(value, f"{schema}, refused string", {"columnNameOfCorruptRecord": "refused", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][XXX]"}).alias("e"), value.alias("line"))
    names = [c.split(" ")[0] for c in schema.split(", ")]
    no_object = ~F.ltrim("line").startswith("{") | F.col("e").isNull()
    return rows.select(*(F.col(f"e.{n}").alias(n) for n in names), F.when(no_object, F.col("line")).otherwise(F.col("e.refused")).alias("refused"))


def events(spark: SparkSession, path: str, schema: str = EVENT) -> DataFrame:
    return parsed(spark.read.text(path), schema=schema)


def event_stream(spark: SparkSession, path: str, schema: str = EVENT, **options: object) -> DataFrame:
    return parsed(spark.readStream.options(**options).text(path), schema=schema)
