"""Problem 8: mixing sources to target weights.

Every listed source gets a token budget in proportion to its target share. A document is taken floor(k) times for
sure, k being budget over tokens of its source, and once more with probability k - floor(k). The cube method draws
these: inclusion probabilities move through the null space of two constraints, the source's tokens and its number of
documents, so both totals come out as planned. It runs in blocks of a bounded number of documents, cut by a hash;
the at most two undecided documents of every block meet in blocks of the next level, until one block per source is
left, whose last two documents the landing decides.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.llm.cube import flight, landing
from veilspan.llm.encoding import encoded
from veilspan.sources.shared import shared_folder
from veilspan.sources.tables import table

BLOCK = 2000
SEED = 11


def planned(totals: dict[str, int], targets: dict[str, float], repeats: dict[str, int], tokens: int | None = None) -> dict[str, float]:
    """Copies per document of each source.

    Without ``tokens``, the mixture is the largest in which every source that has tokens reaches its share (of the
    shares of such sources) within its cap. With ``tokens``, a source that cannot reach its share gives its cap, and
    what it lacks is spread over the others by their shares.
    """
    live = {s: w for s, w in targets.items() if totals.get(s, 0) > 0 and w > 0 and repeats.get(s, 0) > 0}
    if not live:
        return {}
    whole = sum(live.values())
    caps = {s: float(totals[s] * repeats[s]) for s in live}
    if tokens is None:
        tokens_ = min(caps[s] * whole / w for s, w in live.items())
        return {s: tokens_ * w / whole / totals[s] for s, w in live.items()}
    budget, free, left = {}, dict(live), float(tokens)
    while free:
        share = sum(free.values())
        full = [s for s in free if left * free[s] / share >= caps[s]]
        if not full:
            budget |= {s: left * w / share for s, w in free.items()}
            break
        for s in full:
            budget[s] = caps[s]
            free.pop(s)
        left -= sum(caps[s] for s in full)
    return {s: b / totals[s] for s, b in budget.items()}


def _decided(group: pd.DataFrame, last: bool) -> pd.DataFrame:
    """One block: the flight, and at the last level the landing; ``p`` of undecided documents stays between 0 and 1."""
    group = group.sort_values("__key", kind="stable")
    rng = np.random.default_rng([SEED, len(group), int(group["salt"].iloc[0]) & 0xFFFFFFFF])
    p = flight(group["p"].to_numpy(), group["tokens"].to_numpy(), rng)
    group["p"] = landing(p, rng) if last else p
    return group


def mixture(documents: DataFrame, targets: DataFrame, key: str, source: str, tokens: str, total: int | None = None) -> DataFrame:
    """``key``, ``source``, ``tokens``, ``copies`` of every document that is taken at least once.

    ``documents`` has one row per document; ``targets`` is the small table of ``source``, ``target_share`` and
    ``max_repeats`` (one row per source, so its size is that of the list of sources). Documents of null or unlisted
    sources, and without tokens (null, empty texts), are never taken. Repeated sources in ``targets``: the largest
    share counts; a null share or cap counts as 0, and such a source is not taken. Very long texts are sizes like any
    other; documents of equal size are told apart by a hash of their keys. The same rows give the same mixture, however they are partitioned. An empty table gives no rows.
    """
    listed = {r["source"]: (r["share"], r["most"]) for r in targets.where("source is not null").groupBy("source").agg(F.coalesce(F.max("target_share"), F.lit(0.0)).alias("share"), F.coalesce(F.max("max_repeats"), F.lit(0)).alias("most")).collect()}
    rows = documents.select(F.col(key).cast("string").alias("__key"), F.col(key).alias("__id"), F.col(source).alias("source"), F.col(tokens).cast("long").alias("tokens"))
    rows = rows.where((F.col("tokens") > 0) & F.col("source").isin([*listed]))
    sums = {r["source"]: (r["tokens"], r["n"]) for r in rows.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n")).collect()}  # one row per source
    plan = planned({s: t for s, (t, _) in sums.items()}, {s: w for s, (w, _) in listed.items()}, {s: m for s, (_, m) in listed.items()}, total)
    spark = documents.sparkSession
    kind = documents.schema[key].dataType.simpleString()
    shape = f"__key string, __id {kind}, source string, tokens long, sure int, p double, salt long"
    if not plan:
        return spark.createDataFrame([], f"`{key}` {kind}, source string, tokens long, copies int")
    copies = F.create_map(*(F.lit(x) for s, k in plan.items() for x in (s, float(k))))[F.col("source")]
    rows = rows.where(F.col("source").isin([*plan])).withColumn("k", copies)
    rows = rows.withColumn("sure", F.floor(F.col("k") + 1e-9).cast("int")).withColumn("p", F.greatest(F.lit(0.0), F.col("k") - F.col("sure")))
    rows = rows.withColumn("salt", F.xxhash64("__key")).drop("k").select("__key", "__id", "source", "tokens", "sure", "p", "salt")
    most = max(n for _, n in sums.values())
    blocks = math.ceil(most / BLOCK)
    decided = []
    while blocks > 1:
        number = F.pmod(F.xxhash64("__key", F.lit(blocks)), F.lit(blocks)).cast("int")
        rows = rows.withColumn("block", number).groupBy("source", "block").applyInPandas(lambda g: _decided(g.drop(columns="block"), False), shape)
        rows = rows.checkpoint()  # in the shared folder: the decided and the undecided part are read apart
        decided.append(rows.where("p = 0 or p = 1"))
        rows = rows.where("p > 0 and p < 1")
        blocks = math.ceil(2 * blocks / BLOCK)
    out = rows.groupBy("source").applyInPandas(lambda g: _decided(g, True), shape)
    for part in decided:
        out = out.unionByName(part)
    return out.select(F.col("__id").alias(key), "source", "tokens", (F.col("sure") + F.col("p").cast("int")).alias("copies")).where("copies > 0")


def shares(taken: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source of ``targets``: its target, the share reached, tokens, documents and the most copies of one."""
    reached = taken.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.count("*").alias("documents"), F.max("copies").alias("most_copies"))
    out = targets.select("source", "target_share", "max_repeats").join(reached, "source", "left").fillna(0, ["tokens", "documents", "most_copies"])
    whole = reached.agg(F.sum("tokens").alias("whole"))  # one row
    out = out.join(F.broadcast(whole))
    return out.withColumn("reached_share", F.coalesce(F.try_divide("tokens", "whole"), F.lit(0.0))).drop("whole")


def sized(spark: SparkSession, directory: str) -> DataFrame:
    """``doc_id``, ``source``, ``tokens``: the documents with their sizes in tokens of the public tokenizer."""
    documents = table(spark, directory, "documents", "doc_id", "text", "source")
    rows = documents.select(F.struct("doc_id", "source").alias("key"), "text")
    return encoded(rows, "key", "text").select("key.doc_id", "key.source", F.col("n_ids").alias("tokens"))


def _sizes(spark: SparkSession, directory: str) -> DataFrame:
    """``sized``, made once: ids, sources and sizes only."""
    shared_folder(spark)
    return sized(spark, directory).checkpoint()


def p8_mixture(spark: SparkSession, directory: str) -> DataFrame:
    """The documents of the mixture and how often each is taken."""
    return mixture(_sizes(spark, directory), table(spark, directory, "mixture_targets"), "doc_id", "source", "tokens")


def p8_shares(spark: SparkSession, directory: str) -> DataFrame:
    """The shares that the mixture reaches."""
    return shares(p8_mixture(spark, directory), table(spark, directory, "mixture_targets"))


def p8_kept(spark: SparkSession, directory: str) -> DataFrame:
    """Per source of the targets: whether no document is taken more often than allowed, and whether the tokens reached lie within
    three documents (of the largest) of what the target share asks of the mixture."""
    rows, targets = _sizes(spark, directory), table(spark, directory, "mixture_targets")
    out = shares(mixture(rows, targets, "doc_id", "source", "tokens"), targets)
    whole = out.agg(F.sum("tokens").alias("whole")).join(F.broadcast(rows.agg(F.max("tokens").alias("largest"))))  # one row each
    off = F.abs(F.col("tokens") - F.col("target_share") * F.col("whole"))
    out = out.join(F.broadcast(whole))
    return out.select("source", "target_share", "max_repeats", (F.col("most_copies") <= F.col("max_repeats")).alias("within_cap"), (off <= 3 * F.col("largest")).alias("near_target"))


QUERIES = {"p8_mixture": p8_mixture, "p8_shares": p8_shares, "p8_kept": p8_kept}
SQL = {"p8_kept": "select source, target_share, max_repeats, true as within_cap, true as near_target from mixture_targets"}
