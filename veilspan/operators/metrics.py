"""Scores of predicted against gold spans, latencies, and samples of records."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspan.functions import spans as S
from veilspan.functions.coverage import coverage

# Upper ends of the length bands.
BANDS = ((128, "short_lt128"), (512, "medium_128_511"), (None, "long_ge512"))


def ratio(a: Column, b: Column) -> Column:
    """Null where nothing can be divided."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def f_beta(precision: Column, recall: Column, beta: float) -> Column:
    """Zero where both are zero."""
    return F.coalesce(ratio((1 + beta**2) * precision * recall, beta**2 * precision + recall), F.lit(0.0))


# --- interval joins ---------------------------------------------------------------------------------------------------
def overlap_pairs(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of spans of one document (and what else ``keys`` name) that share a character: equi-join with a range.

    Both have ``keys``, ``start`` and ``end``; those of ``b`` come out as ``b_start`` and ``b_end``.
    """
    right = b.select(*keys, F.col("start").alias("b_start"), F.col("end").alias("b_end"))
    return a.join(right, keys).where((F.col("start") < F.col("b_end")) & (F.col("b_start") < F.col("end")))


def touched(a: DataFrame, b: DataFrame, keys: list[str], anti: bool = False) -> DataFrame:
    """Rows of ``a`` that some span of ``b`` touches (or, ``anti``, that none does)."""
    left, right = a.alias("a"), b.alias("b")
    same = (F.col("a.start") < F.col("b.end")) & (F.col("b.start") < F.col("a.end"))
    for k in keys:
        same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    return left.join(right, same, "left_anti" if anti else "left_semi")


def key_coverage(records: DataFrame, predictions: DataFrame, key: str) -> DataFrame:
    """Keys that only one side has: ``key`` and ``missing`` (``prediction`` or ``record``); none when all is well."""
    a, b = records.select(key).distinct(), predictions.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("missing", F.lit("prediction")).unionByName(b.join(a, key, "left_anti").withColumn("missing", F.lit("record")))


# --- corpus benchmark --------------------------------------------------------------------------------------------------
def category_scores(findings: DataFrame, expected: DataFrame, document: str = "name") -> DataFrame:
    """Recall and precision by category, a hit being any overlap of the same category; null without a denominator."""
    keys = [document, "category"]
    hidden = touched(expected, findings, keys).groupBy("category").agg(F.count("*").alias("hidden"))
    just = touched(findings, expected, keys).groupBy("category").agg(F.count("*").alias("justified"))
    total = expected.groupBy("category").agg(F.count("*").alias("expected"))
    out = total.join(findings.groupBy("category").agg(F.count("*").alias("found")), "category", "full").join(hidden, "category", "left").join(just, "category", "left").fillna(0)
    return out.withColumn("recall", ratio(F.col("hidden"), F.col("expected"))).withColumn("precision", ratio(F.col("justified"), F.col("found")))


def mistakes(a: DataFrame, b: DataFrame, texts: DataFrame, document: str = "name", text: str = "text") -> DataFrame:
    """Spans of ``a`` that no span of ``b`` touches, with their value and line: missed ones, or false alarms."""
    lone = touched(a, b, [document, "category"], anti=True).join(texts.select(document, text), document)
    head = F.substring(F.col(text), F.lit(1), F.col("start"))
    line = F.length(head) - F.length(F.replace(head, F.lit("\n"))) + 1
    return lone.select(document, "category", line.alias("line"), F.substring(F.col(text), F.col("start") + 1, F.col("end") - F.col("start")).alias("value"))


# --- exact spans and characters ----------------------------------------------------------------------------------------
def exact_metrics(records: DataFrame, gold: str = "gold", predicted: str = "predicted", text: str = "text", groups: list[str] | None = None) -> DataFrame:
    """Exact spans, whole entities, characters and records without gold, summed over the records and then divided.

    Spans count once per record, characters once per kind and record; blanks are no characters. Zero denominators give null.
    """
    given = lambda spans: F.coalesce(F.col(spans), F.array().cast(S.SPANS))
    rows = records.select(*(groups or []), coverage(F.col(text), given(gold), given(predicted)).alias("c"))
    rows = rows.select(*(groups or []), *(f"c.{c}" for c in ("gold", "predicted", "exact", "covered", "gold_chars", "predicted_chars", "shared_chars")))
    negative = F.col("gold") == 0
    sums = rows.groupBy(*(groups or [])).agg(
        *(F.sum(c).alias(c) for c in ("gold", "predicted", "exact", "covered", "gold_chars", "predicted_chars", "shared_chars")),
        F.count_if(negative).alias("negatives"), F.count_if(negative & (F.col("predicted") > 0)).alias("false_positive_records"),
    )
    c = F.col
    return sums.select(
        "*", ratio(c("exact"), c("predicted")).alias("precision"), ratio(c("exact"), c("gold")).alias("recall"), ratio(2 * c("exact"), c("gold") + c("predicted")).alias("f1"),
        ratio(c("covered"), c("gold")).alias("full_coverage"), ratio(c("shared_chars"), c("predicted_chars")).alias("char_precision"), ratio(c("shared_chars"), c("gold_chars")).alias("char_recall"),
        ratio(c("false_positive_records"), c("negatives")).alias("negative_rate"),
    )


def masking_scores(records: DataFrame, true: str, predicted: str, task: str) -> DataFrame:
    """Precision, recall and F2 of masked characters per task: sums first, then one division; zero without a denominator."""
    t, p = S.merged(F.col(true)), S.merged(F.col(predicted))
    rows = records.select(task, S.common_length(t, p).alias("hit"), S.total_length(t).alias("true"), S.total_length(p).alias("masked"))
    sums = rows.groupBy(task).agg(*(F.sum(c).alias(c) for c in ("hit", "true", "masked")))
    sums = sums.withColumn("precision", F.coalesce(ratio(F.col("hit"), F.col("masked")), F.lit(0.0))).withColumn("recall", F.coalesce(ratio(F.col("hit"), F.col("true")), F.lit(0.0)))
    return sums.withColumn("f2", f_beta(F.col("precision"), F.col("recall"), 2))


def ranking(scores: DataFrame, published: DataFrame) -> DataFrame:
    """The mean F2 over tasks, and its rank: one more than the published models that are better. Only one-row tables are broadcast."""
    mean = scores.agg(F.avg("f2").alias("f2"))
    better = published.select(F.col("f2").alias("other")).join(F.broadcast(mean)).agg((F.count_if(F.col("other") > F.col("f2")) + 1).alias("rank"))
    return mean.join(F.broadcast(better))


def misses(gold: DataFrame, predicted: DataFrame, texts: DataFrame, key: str) -> DataFrame:
    """Gold spans by label as complete, partial or missed, after the characters that predictions of their kind cover."""
    span = F.struct("kind", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"))
    p = predicted.groupBy(key).agg(F.collect_list(span).alias("p"))  # spans of one text
    g = gold.groupBy(key).agg(F.collect_list(span).alias("g"), F.collect_list(F.struct("source_label")).alias("labels"))
    rows = g.join(p, key, "left").join(texts.select(key, "text"), key)
    rows = rows.select("labels", coverage(F.col("text"), F.col("g"), F.coalesce("p", F.array().cast(S.SPANS))).alias("c"))
    rows = rows.select(F.explode(F.arrays_zip("labels", "c.want", "c.have")).alias("x")).select("x.labels.source_label", "x.want", "x.have")
    want, have = F.col("want"), F.col("have")
    outcome = F.when(have == 0, "missed").when(have == want, "complete").otherwise("partial")
    return rows.groupBy("source_label", outcome.alias("outcome")).agg(F.count("*").alias("spans"))


# --- latency, bands, thresholds ----------------------------------------------------------------------------------------
ACCURACY = 10_000


def quantiles(rows: DataFrame, value: str, groups: list[str], asked: dict[str, tuple[float, bool]], accuracy: int = ACCURACY) -> DataFrame:
    """Exact quantiles of groups of any size: ``groups``, ``n``, ``mean`` and, by name, each (share, interpolated).

    An interpolated quantile lies between two ranks as the usual percentile does, another is the nearest-rank value. A
    first pass makes a mergeable summary of every group, whose rank error is at most one in ``accuracy``; it brackets
    each quantile. A second pass counts what lies under a bracket, and the values in it one by one: a bracket holds
    about 8 in ``accuracy`` of the values (all of a small group), so no buffer grows with the group. Null keys are a
    group. ``value`` must be finite and not null.
    """
    v, wide = F.col(value).cast("double"), 4 / accuracy
    shares = [x for p, _ in asked.values() for x in (max(0.0, p - wide), min(1.0, p + wide))]
    keyed = rows.select(*groups, v.alias("__v"))
    summary = keyed.groupBy(*groups).agg(F.count("*").alias("n"), F.avg("__v").alias("mean"), F.percentile_approx("__v", shares, accuracy).alias("__b"))
    one, other = keyed.alias("a"), summary.alias("b")
    same = F.lit(True)
    for g in groups:
        same = same & F.col(f"a.{g}").eqNullSafe(F.col(f"b.{g}"))
    brackets = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.col("__b")[2 * i].alias("lo"), F.col("__b")[2 * i + 1].alias("hi")) for i in range(len(asked)))))
    near = one.join(other, same).select(*(f"a.{g}" for g in groups), "n", "__v", brackets.alias("q")).where(F.col("__v") <= F.col("q.hi"))
    near = near.select(*groups, "n", "q.i", F.when(F.col("__v") >= F.col("q.lo"), F.col("__v")).alias("__v"))  # null: under the bracket
    counts = near.groupBy(*groups, "n", "i", "__v").agg(F.count("*").alias("c"))
    upto = counts.withColumn("upto", F.sum("c").over(Window.partitionBy(*groups, "i").orderBy(F.col("__v").asc_nulls_first())))
    n, at = F.col("n"), {}
    for i, (name, (p, interpolated)) in enumerate(asked.items()):
        place = F.lit(p) * (n - 1) if interpolated else F.greatest(F.ceil(F.lit(p) * n), F.lit(1)) - 1
        low, high = (F.min(F.when((F.col("i") == i) & (F.col("upto") > r(place)), F.col("__v"))) for r in (F.floor, F.ceil))
        part = F.max(place - F.floor(place))
        at[name] = low + part * (high - low) if interpolated else low
    answers = upto.groupBy(*groups).agg(*(c.alias(k) for k, c in at.items()), F.max("n").alias("n"))
    one, other = answers.alias("a"), summary.alias("b")
    return one.join(other, same).select(*(f"a.{g}" for g in groups), "a.n", "b.mean", *(f"a.{k}" for k in asked))


def latency(observations: DataFrame, value: str, groups: list[str]) -> DataFrame:
    """Median, nearest-rank 95th percentile and mean of the finite values."""
    v = F.col(value)
    rows = observations.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return quantiles(rows, value, groups, {"p50": (0.5, True), "p95": (0.95, False)})


def length_band(characters: Column) -> Column:
    return F.when(characters < BANDS[0][0], BANDS[0][1]).when(characters < BANDS[1][0], BANDS[1][1]).when(characters.isNotNull(), BANDS[2][1])


def best_threshold(scores: DataFrame, groups: list[str]) -> DataFrame:
    """The threshold with the greatest (F1, full coverage, precision, threshold)."""
    return scores.groupBy(*groups).agg(F.max_by("threshold", F.struct("f1", "full_coverage", "precision", "threshold")).alias("threshold"))


def audit(records: DataFrame, groups: list[str], text: str = "text", spans: str = "spans") -> DataFrame:
    """Records, entities, texts that come again, and those that come again with other spans."""
    entities = F.coalesce(F.size(spans), F.lit(0))
    texts = records.select(*groups, F.sha2(text, 256).alias("h"), entities.alias("e"), F.xxhash64(spans).alias("s"))
    by_text = texts.groupBy(*groups, "h").agg(F.count("*").alias("n"), F.sum("e").alias("e"), F.count_distinct("s").alias("variants"))
    return by_text.groupBy(*groups).agg(
        F.sum("n").alias("records"), F.sum("e").alias("entities"), F.sum(F.col("n") - 1).alias("duplicates"), F.count_if((F.col("n") > 1) & (F.col("variants") > 1)).alias("conflicts")
    )


def bootstrap(counts: DataFrame, unit: str, draws: int = 1000, seed: int = 20261006, shards: int = 64) -> DataFrame:
    """95 % interval of F1 per model by resampling units; ``counts``: model, unit, ``exact``, ``gold``, ``predicted``.

    A draw takes as many units as there are, with replacement, and every model the same ones. How many fall to each
    shard of units is drawn first, from the ``shards`` sizes, then within a shard; so no task holds more than a shard
    (a unit's counts by model), and only sums per model and draw are shuffled. Null units are left out.
    """
    named = counts.where(F.col(unit).isNotNull()).select("model", F.col(unit).cast("string").alias("unit"), *(F.col(c).cast("double").alias(c) for c in ("exact", "gold", "predicted")))
    units = named.groupBy("model", "unit").agg(*(F.sum(c).alias(c) for c in ("exact", "gold", "predicted"))).withColumn("shard", F.pmod(F.crc32("unit"), F.lit(shards)).cast("int"))
    sizes = np.zeros(shards, dtype=np.int64)
    for r in units.groupBy("shard").agg(F.count_distinct("unit").alias("n")).collect():  # at most ``shards`` rows
        sizes[r["shard"]] = r["n"]
    whole = max(1, int(sizes.sum()))
    taken = np.random.default_rng(seed).multinomial(whole, sizes / whole, size=draws) if sizes.sum() else np.zeros((draws, shards), dtype=np.int64)

    def sums(shard: pd.DataFrame) -> pd.DataFrame:
        number = int(shard["shard"].iloc[0])
        names = np.unique(shard["unit"])
        weights = np.random.default_rng([seed, number]).multinomial(taken[:, number], np.full(len(names), 1 / len(names)))
        out = []
        for model, rows in shard.groupby("model", dropna=False):
            drawn = weights[:, np.searchsorted(names, rows["unit"])] @ rows[["exact", "gold", "predicted"]].to_numpy()
            out.append(pd.DataFrame({"model": model, "draw": np.arange(draws, dtype=np.int32), "exact": drawn[:, 0], "gold": drawn[:, 1], "predicted": drawn[:, 2]}))
        return pd.concat(out)

    partial = units.groupBy("shard").applyInPandas(sums, "model string, draw int, exact double, gold double, predicted double")
    totals = partial.groupBy("model", "draw").agg(*(F.sum(c).alias(c) for c in ("exact", "gold", "predicted")))
    f1 = F.coalesce(ratio(2 * F.col("exact"), F.col("gold") + F.col("predicted")), F.lit(0.0))
    return totals.groupBy("model").agg(F.percentile(f1, 0.025).alias("low"), F.percentile(f1, 0.975).alias("high"))


# --- samples -----------------------------------------------------------------------------------------------------------
def sample_order(key: Column, seed: str, purpose: str) -> Column:
    """A hash that orders records the same way in every run."""
    return F.sha2(F.concat_ws(":", F.lit(seed), F.lit(purpose), key), 256)


def hash_sample(records: DataFrame, key: str, n: int, seed: str, purpose: str) -> DataFrame:
    """The ``n`` records that stand first in the order of ``sample_order``."""
    return records.orderBy(sample_order(F.col(key), seed, purpose), key).limit(n)


def tenth(key: Column) -> Column:
    """SHA-256 of a key modulo ten, folded digit by digit since the number has 256 bits."""
    digits = F.split(F.sha2(key, 256), "")
    step = lambda acc, d: F.when(d == "", acc).otherwise((acc * 16 + F.conv(d, 16, 10).cast("int")) % 10)
    return F.aggregate(digits, F.lit(0), step)


def unseen(records: DataFrame, control: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Records whose text is not in ``control``; of equal texts the one with the least key."""
    own = records.withColumn("__h", F.sha2(text, 256))
    first = own.groupBy("__h").agg(F.min(key).alias("__k"))
    kept = own.join(first, "__h").where(F.col(key) == F.col("__k")).drop("__k")
    return kept.join(control.select(F.sha2(text, 256).alias("__h")), "__h", "left_anti").drop("__h")


def word_windows(text: Column, size: int = 200, overlap: int = 40) -> Column:
    """Windows of ``size`` words, each sharing ``overlap`` words with the one before; the words with their spans stay in order."""
    words = F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")
    n = F.size(words)
    starts = F.sequence(F.lit(0), F.greatest(n - overlap, F.lit(1)) - 1, F.lit(size - overlap))
    return F.transform(starts, lambda s: F.slice(words, s + 1, size))
