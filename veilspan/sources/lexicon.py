"""The name lexicon and the code words that are never names."""

from __future__ import annotations

import csv
import hashlib
import io
import itertools
import re
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspan.operators.names import normalized

# Rows of the public files that stand for suppressed names.
SUPPRESSED = ("autres noms", "prenoms rares")
MOST = 2_000_000  # names an executor's detector may hold; a greater lexicon is met by joins


@F.pandas_udf(T.StringType())
def _normal(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else normalized(v))


def names(spark: SparkSession, path: str, column: str, kind: str, delimiter: str = ";") -> DataFrame:
    """``kind``, ``value``: distinct names of a delimited file in their normal form, without suppressed ones."""
    return _names(spark.read.csv(path, sep=delimiter, header=True), column, kind)


def _names(raw: DataFrame, column: str, kind: str) -> DataFrame:
    rows = raw.select(_normal(F.col(column)).alias("value"))
    return rows.where((F.col("value") != "") & ~F.col("value").startswith("_") & ~F.col("value").isin(*SUPPRESSED)).distinct().select(F.lit(kind).alias("kind"), "value")


MOST_BYTES = 256 << 20


def archived(spark: SparkSession, path: str, digest: str, column: str, kind: str, delimiter: str = ";", most: int = MOST_BYTES) -> DataFrame:
    """``names`` of the one delimited file in a ZIP archive, which is opened only if its SHA-256 is ``digest``.

    Refused, with an error in the task: another digest, more than one file, an archive or a file of more than ``most`` bytes.
    """
    archives = spark.read.format("binaryFile").load(path).select("path", "length", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for length, content in zip(batch.column("length").to_pylist(), batch.column("content").to_pylist(), strict=True):
                if length > most or hashlib.sha256(content).hexdigest() != digest.lower():
                    raise ValueError("the archive is not the one that was asked for")
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    inside = [e for e in archive.infolist() if not e.is_dir()]
                    if len(inside) != 1 or inside[0].file_size > most:
                        raise ValueError("the archive must hold one file of a bounded size")
                    rows = csv.DictReader(io.TextIOWrapper(archive.open(inside[0]), "utf-8-sig", newline=""), delimiter=delimiter)
                    while some := list(itertools.islice(rows, 50_000)):
                        yield pa.record_batch([pa.array([r[column] for r in some], pa.string())], names=["raw"])

    return _names(archives.mapInArrow(run, "raw string"), "raw", kind)


def counts(lexicon: DataFrame) -> DataFrame:
    """Distinct names by kind."""
    return lexicon.groupBy("kind").agg(F.count_distinct("value").alias("names"))


def contains(lexicon: DataFrame, most: int = MOST) -> Callable[[str, str], bool]:
    """Membership for detectors. The lexicon is counted first; one of more than ``most`` names is refused (see ``known_pairs``)."""
    n = lexicon.count()
    if n > most:
        raise ValueError(f"{n} names are too many to ship; join with known_pairs instead")
    held = {(r["kind"], r["value"]) for r in lexicon.collect()}  # at most ``most`` rows
    return lambda kind, value: (kind, normalized(value)) in held


def known_pairs(candidates: DataFrame, lexicon: DataFrame, first: str, second: str) -> DataFrame:
    """Candidates whose two words are a given and a family name in either order: two semi-joins for any size of lexicon."""
    plain = candidates.withColumn("__a", _normal(F.col(first))).withColumn("__b", _normal(F.col(second)))
    given, family = (lexicon.where(F.col("kind") == k).select(F.col("value")) for k in ("given", "family"))
    def both(x: str, y: str) -> DataFrame:
        a, b = given.withColumnRenamed("value", "__v"), family.withColumnRenamed("value", "__w")
        return plain.join(a, F.col(x) == F.col("__v"), "left_semi").join(b, F.col(y) == F.col("__w"), "left_semi")

    return both("__a", "__b").union(both("__b", "__a")).drop("__a", "__b").distinct()


_NAME = r"[A-Za-z_][A-Za-z0-9_]*"


def code_words(modules: DataFrame, least: int = 3) -> DataFrame:
    """``word``: parts of identifiers of three letters or more that stand in ``least`` modules (``module``, ``source``)."""

    @F.pandas_udf("array<string>")
    def parts(sources: pd.Series) -> pd.Series:
        split = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
        return sources.map(lambda s: sorted({p.lower() for name in re.findall(_NAME, s or "") for p in split.findall(name) if len(p) >= 3}))

    words = modules.select("module", F.explode(parts("source")).alias("word"))
    return words.groupBy("word").agg(F.count_distinct("module").alias("modules")).where(F.col("modules") >= least).select("word")
