"""Problem 6: percentiles of very large numeric columns, from mergeable summaries.

The summary is a randomized compactor hierarchy: levels of sorted buffers, of which a full one keeps every other
value, from a random start, and hands them one level up. Summaries of partitions, days or groups merge level by
level. Spark's own KLL aggregates are this structure, run in the JVM and with a partial summary per map task, so that
a group that holds a third of all rows sends one summary per task over the shuffle.

With ``K`` the rank of an answer is off by less than ``rank_error(K)`` of the group's size, with 99 % probability
per answer; groups of up to about ``K`` values are exact. Reruns may differ within that bound.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.sources.shared import shared_folder
from veilspan.sources.tables import table

K = 600
PERCENTS = (50, 90, 95, 99)
# Upper ends, exclusive, and names of the length bands.
BANDS = ((128, "short_lt128"), (512, "medium_128_511"), (None, "long_ge512"))


def rank_error(k: int = K) -> float:
    """Normalized rank error of a KLL summary (the published fit for one-sided 99 % confidence)."""
    return 2.296 / k**0.9021


def length_band(characters: Column, label: Column) -> Column:
    """The band of a length; where the length is null, the label if it is a known one, else null."""
    by_label = F.when(F.lower(label).isin([name for _, name in BANDS]), F.lower(label))
    band = F.when(characters < BANDS[0][0], BANDS[0][1]).when(characters < BANDS[1][0], BANDS[1][1]).otherwise(BANDS[2][1])
    return F.when(characters.isNull(), by_label).otherwise(band)


def usable(value: Column) -> Column:
    """A measured time, or null for one that is null, NaN, infinite or negative."""
    return F.when(~F.isnan(value) & (value >= 0) & (value < float("inf")), value)


def summaries(rows: DataFrame, groups: Sequence[str], columns: Sequence[str], k: int = K) -> DataFrame:
    """Per group the summary of each column: ``groups``, and for a column c ``c_sketch`` binary and ``c_n`` bigint.

    Equal values count as often as they come; repeated rows count again. Nulls are in no summary; a group without values has an empty summary and n 0. Null group keys form their own
    group. An empty table gives no rows. Columns that are not named are ignored.
    """
    kinds = dict(rows.dtypes)
    aggregates = []
    for c in columns:
        kind, cast = ("double", "double") if kinds[c] in ("double", "float") or kinds[c].startswith("decimal") else ("bigint", "bigint")
        aggregates += [getattr(F, f"kll_sketch_agg_{kind}")(F.col(c).cast(cast), F.lit(k)).alias(f"{c}_sketch"), F.count(c).alias(f"{c}_n")]
    return rows.groupBy(*groups).agg(*aggregates)


def merged(parts: DataFrame, groups: Sequence[str], kinds: dict[str, str], k: int = K) -> DataFrame:
    """Summaries of coarser groups from those of finer ones; ``kinds``: column -> ``double`` or ``bigint``."""
    aggregates = []
    for c, kind in kinds.items():
        aggregates += [getattr(F, f"kll_merge_agg_{kind}")(F.col(f"{c}_sketch"), F.lit(k)).alias(f"{c}_sketch"), F.sum(f"{c}_n").alias(f"{c}_n")]
    return parts.groupBy(*groups).agg(*aggregates)


def percentiles(parts: DataFrame, kinds: dict[str, str], percents: Sequence[int] = PERCENTS) -> DataFrame:
    """The summaries of ``parts`` replaced by ``c_p50`` and so on; null where the group has no values."""
    out = parts
    for c, kind in kinds.items():
        ask = getattr(F, f"kll_sketch_get_quantile_{kind}")
        for p in percents:
            out = out.withColumn(f"{c}_p{p}", F.when(F.col(f"{c}_n") > 0, ask(F.col(f"{c}_sketch"), F.lit(p / 100))))
    return out.drop(*(f"{c}_sketch" for c in kinds))


KINDS = {"elapsed_ms": "double", "characters": "bigint"}


def observations(spark: SparkSession, directory: str) -> DataFrame:
    """Timing without redelivered rows: ``model``, ``length_band``, ``day``, ``elapsed_ms`` (null if not usable), ``characters``."""
    rows = table(spark, directory, "timing", "obs_id", "model", "run_at", "characters", "length_band", "elapsed_ms")
    rows = rows.select(
        "obs_id", "model", length_band(F.col("characters"), F.col("length_band")).alias("length_band"), F.to_date("run_at").alias("day"),
        usable(F.col("elapsed_ms")).alias("elapsed_ms"), "characters",
    )
    # rows without an obs_id count once each, unless they are the same in every column
    alone = F.when(F.col("obs_id").isNull(), F.xxhash64(*rows.columns))
    return rows.withColumn("__alone", alone).dropDuplicates(["obs_id", "__alone"]).drop("obs_id", "__alone")


GROUPS = ["model", "length_band"]


def percentiles_by_grain(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """Percentiles at two grains: ``day`` (model, band and day) and ``band`` (model and band, from the merged days, ``day`` null)."""
    shared_folder(spark)
    days = summaries(rows, [*GROUPS, "day"], list(KINDS)).checkpoint()  # summaries only; read twice
    whole = merged(days, GROUPS, KINDS).withColumn("day", F.lit(None).cast("date"))
    parts = [part.select(F.lit(grain).alias("grain"), *GROUPS, "day", *(f"{c}{x}" for c in KINDS for x in ("_sketch", "_n"))) for part, grain in ((days, "day"), (whole, "band"))]
    return percentiles(parts[0].unionByName(parts[1]), KINDS)


def p6_percentiles(spark: SparkSession, directory: str) -> DataFrame:
    """Median and other percentiles of times and lengths by model and band, and by day."""
    return percentiles_by_grain(spark, observations(spark, directory))


def p6_bounds(spark: SparkSession, directory: str) -> DataFrame:
    """Per group, column and percentile of ``p6_percentiles``: the values and whether the answer's true rank is within twice the stated error.

    The stated error holds for 99 % of the answers, twice the error for practically all of them.
    """
    rows = observations(spark, directory)
    answers = percentiles_by_grain(spark, rows)
    asked = [(c, p) for c in KINDS for p in PERCENTS]
    spread = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.lit(p).alias("percent"), F.col(f"{c}_p{p}").cast("double").alias("answer")) for c, p in asked)))
    given = answers.select("grain", *GROUPS, "day", spread.alias("q")).select("grain", *GROUPS, "day", "q.*")
    values = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in KINDS)))
    held = rows.select(*GROUPS, "day", values.alias("v")).select(*GROUPS, "day", "v.*").where("value is not null")
    held = held.groupBy(*GROUPS, "day", "column", "value").agg(F.count("*").alias("n"))  # ties are many
    a, b = given.alias("a"), held.alias("b")
    same = (F.col("a.column") == F.col("b.column")) & ((F.col("a.grain") == "band") | F.col("a.day").eqNullSafe(F.col("b.day")))
    for g in GROUPS:
        same = same & F.col(f"a.{g}").eqNullSafe(F.col(f"b.{g}"))
    ranks = a.join(b, same).groupBy("a.grain", *(f"a.{g}" for g in GROUPS), "a.day", "a.column", "a.percent").agg(
        F.sum("b.n").alias("n"), F.sum(F.when(F.col("value") < F.col("answer"), F.col("b.n")).otherwise(0)).alias("below"), F.sum(F.when(F.col("value") <= F.col("answer"), F.col("b.n")).otherwise(0)).alias("upto")
    )
    wide = 2 * rank_error() * F.col("n") + 1
    return ranks.select("grain", *GROUPS, "day", "column", "percent", "n", (F.col("percent") / 100 * F.col("n")).between(F.col("below") - wide, F.col("upto") + wide).alias("within"))


QUERIES = {"p6_percentiles": p6_percentiles, "p6_bounds": p6_bounds}

_ROWS = """rows as (select model, case when characters < 128 then 'short_lt128' when characters < 512 then 'medium_128_511' when characters is not null then 'long_ge512'
    when lower(length_band) in ('short_lt128', 'medium_128_511', 'long_ge512') then lower(length_band) end as length_band, cast(run_at as date) as day,
    case when elapsed_ms >= 0 and isfinite(elapsed_ms) then elapsed_ms end as elapsed_ms, characters from (select * from timing qualify row_number() over (partition by obs_id order by recorded_at) = 1))"""
SQL = {
    "p6_bounds": f"""with {_ROWS}, long as (select model, length_band, day, 'elapsed_ms' as "column" from rows where elapsed_ms is not null union all select model, length_band, day, 'characters' from rows where characters is not null),
      grains as (select 'day' as grain, model, length_band, day, "column", count(*) as n from long group by all union all select 'band', model, length_band, null, "column", count(*) from long group by all)
      select grain, model, length_band, day, "column", cast(p as int) as percent, n, true as within from grains, unnest([{', '.join(map(str, PERCENTS))}]) as t(p)""",
}
