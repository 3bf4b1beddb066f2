"""Protection of a stream: the vault is written before any masked text leaves, and a repeated batch changes nothing."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from veilspan.operators import detect as D
from veilspan.operators import vault as V
from veilspan.sources.shared import shared_folder


@contextmanager
def deadline(spark: SparkSession, seconds: float | None) -> Iterator[None]:
    """Cancels the jobs of the block once ``seconds`` are over: it fails, and nothing of it is answered."""
    tag = f"deadline-{uuid.uuid4().hex}"
    timer = threading.Timer(seconds, spark.sparkContext.cancelJobsWithTag, [tag]) if seconds else None
    spark.sparkContext.addJobTag(tag)
    try:
        if timer:
            timer.daemon = True
            timer.start()
        yield
    finally:
        spark.sparkContext.removeJobTag(tag)
        if timer:
            timer.cancel()


def commit(
    batch: DataFrame, batch_id: int, keys: DataFrame, session: str, vault_path: str, out_path: str, length: int = 8, cipher: V.Cipher | None = None, seconds: float | None = None,
    note: Callable[[DataFrame, int], None] | None = None,
) -> None:
    """One micro-batch: new vault rows, then masked rows, each under the id of the batch, so that a rerun overwrites itself.

    Names that the vault already holds for a session are found again in the batch. A collision of ids fails the batch,
    and so does a batch that is not done in ``seconds``. The vault is read in the shards of the batch's sessions only.
    ``cipher`` closes the stored values; ``note`` gets the counts of the batch, without contents, for a journal.
    """
    spark = batch.sparkSession
    shared_folder(spark)
    opened = lambda v: v if cipher is None else V.decrypted(v, cipher)
    with deadline(spark, seconds):
        # what an earlier try of this batch wrote does not count: it is written anew
        known = opened(V.read_vault(spark, vault_path, batch, session, ["person_name"], batch_id))
        found = D.find_many(batch, session, known=known.select(F.col("session_id").alias(session), F.col("value").alias("name")))
        items = V.with_tokens(found, keys, session, length=length).checkpoint()
        new = V.vault_rows(items, session)
        vault = opened(V.read_vault(spark, vault_path, batch, session, but=batch_id))
        if not V.clashing(vault, new).isEmpty():
            raise ValueError("one token id stands for two values; use longer ids")
        fresh = V.appended(vault, new)
        V.write_vault(fresh if cipher is None else V.encrypted(fresh, cipher), vault_path, batch_id)
        done = V.protected(items)
        if note is not None:
            note(done.select(session, "counts"), batch_id)
        done.drop("items", "spans").write.mode("overwrite").parquet(f"{out_path}/batch_id={batch_id}")


def protect_stream(stream: DataFrame, keys: DataFrame, session: str, vault_path: str, out_path: str, checkpoint: str, **options: object) -> StreamingQuery:
    return stream.writeStream.foreachBatch(lambda b, i: commit(b, i, keys, session, vault_path, out_path, **options)).option("checkpointLocation", checkpoint).start()


def journal(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """An append-only journal of events as JSON lines, without their contents."""
    return rows.writeStream.format("json").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).start()


def purge(vault: DataFrame, active: DataFrame, session: str = "session_id", last: str = "last_active", days: int = 7, now: Callable = F.current_timestamp) -> DataFrame:
    """The vault without sessions that have ended or were silent for ``days``."""
    live = active.where(F.col(last) >= now() - F.expr(f"interval {days} days")).select(F.col(session).alias("session_id")).distinct()
    return vault.join(live, "session_id", "left_semi")
