"""Problem 2: a reproducible sample that stays stable as data grows.

Nested hash buckets: a key belongs for ever to one of ``BUCKETS`` fine buckets, a digest of the key alone. A fixed
permutation, itself a digest of seed and bucket number, orders the buckets; a sample is every key of the first
buckets of that order. The list of chosen buckets only ever grows at its end, so a key once chosen stays chosen
whatever arrives later, and neither order, partitioning nor copies of rows play a part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.sources.tables import table

DIGITS = 3
BUCKETS = 16**DIGITS
SEED = "veilspan"
FRACTION = 0.1


def bucket(key: Column, digits: int = DIGITS) -> Column:
    """The fine bucket of a key: the first hexadecimal digits of its SHA-256, as a number; null for null."""
    return F.conv(F.substring(F.sha2(key.cast("string"), 256), 1, digits), 16, 10).cast("int")


def bucket_order(spark: SparkSession, seed: str = SEED, digits: int = DIGITS) -> DataFrame:
    """``bucket``, ``rank``: the fixed permutation, of 16**digits rows (its only size, whatever the data)."""
    place = F.sha2(F.concat_ws(":", F.lit(seed), F.col("id").cast("string")), 256)
    numbers = spark.range(0, 16**digits, 1, 1)
    ordered = F.array_sort(F.collect_list(F.struct(place.alias("place"), F.col("id").cast("int").alias("bucket"))))
    return numbers.agg(F.transform(ordered, lambda x: x["bucket"]).alias("all")).select(F.posexplode("all").alias("rank", "bucket"))


def bucket_counts(records: DataFrame, key: str, digits: int = DIGITS) -> DataFrame:
    """``bucket``, ``keys``: distinct keys of every bucket that has any; counts of batches without common keys add up."""
    return records.select(F.col(key).cast("string").alias("k")).where("k is not null").distinct().groupBy(bucket(F.col("k"), digits).alias("bucket")).agg(F.count("*").alias("keys"))


def grown_list(spark: SparkSession, counts: DataFrame, least: int, already: int = 0, seed: str = SEED, digits: int = DIGITS) -> int:
    """How many buckets of the order to take so that they hold ``least`` keys; never fewer than ``already``.

    ``already`` is the number taken before, kept by the caller: a list once published is extended, not shortened.
    """
    per_bucket = dict(bucket_order(spark, seed, digits).join(counts, "bucket").select("rank", "keys").collect())  # at most 16**digits rows
    have, taken = 0, 0
    while taken < 16**digits and (taken < already or have < least):
        have += per_bucket.get(taken, 0)
        taken += 1
    return taken


def stable_sample(records: DataFrame, key: str, fraction: float = FRACTION, buckets: int | None = None, seed: str = SEED, digits: int = DIGITS) -> DataFrame:
    """Distinct chosen keys: ``key``, ``bucket``, ``rank`` (place of the bucket in the order).

    ``buckets`` takes that many buckets of the order, else ``fraction`` of all buckets is taken. Keys repeated in
    several rows or batches come out once, very long ones like any other; null keys never; ties cannot occur. An empty table gives an empty sample.
    Other columns of the table, whatever their names, are ignored.
    """
    taken = round(fraction * 16**digits) if buckets is None else buckets
    order = F.broadcast(bucket_order(records.sparkSession, seed, digits).where(F.col("rank") < taken))  # at most 16**digits rows
    keys = records.select(F.col(key).cast("string").alias("__key")).where("__key is not null")
    return keys.withColumn("bucket", bucket(F.col("__key"), digits)).join(order, "bucket").select(F.col("__key").alias(key), "bucket", "rank").distinct()


def p2_sample(spark: SparkSession, directory: str) -> DataFrame:
    """A tenth of the ids of quality."""
    return stable_sample(table(spark, directory, "quality", "id"), "id")


def p2_growth(spark: SparkSession, directory: str) -> DataFrame:
    """Per batch of quality, a record counting for its first one: its ids and those of them in the sample."""
    rows = table(spark, directory, "quality", "id", "batch_no")
    first = rows.where("id is not null").groupBy("id").agg(F.min("batch_no").alias("batch_no"))
    chosen = stable_sample(rows, "id").select("id", F.lit(1).alias("chosen"))
    return first.join(chosen, "id", "left").groupBy("batch_no").agg(F.count("*").alias("ids"), F.count("chosen").alias("sampled"))


_ORDER = f"""
  select bucket, row_number() over (order by place, bucket) - 1 as rank
  from (select cast(range as int) as bucket, sha256('{SEED}:' || range) as place from range({BUCKETS}))"""
_BUCKET = f"cast(('0x' || substr(sha256(id), 1, {DIGITS})) as int)"

QUERIES = {"p2_sample": p2_sample, "p2_growth": p2_growth}
SQL = {
    "p2_sample": f"""
with ranked as ({_ORDER})
select distinct id, k.bucket, cast(rank as int) as rank
from (select id, {_BUCKET} as bucket from quality where id is not null) k join ranked r on k.bucket = r.bucket
where rank < {round(FRACTION * BUCKETS)}""",
    "p2_growth": f"""
with ranked as ({_ORDER})
select batch_no, count(*) as ids, cast(sum(case when rank < {round(FRACTION * BUCKETS)} then 1 else 0 end) as bigint) as sampled
from (select id, min(batch_no) as batch_no, {_BUCKET} as bucket from quality where id is not null group by id) k
join ranked r on k.bucket = r.bucket group by batch_no""",
}
