"""Protection and its way back: placeholders in the texts, their values in a vault table.

The vault has one row per session, kind and token id; ids are keyed digests of the exact value. Writing is append-only
and the first value of an id stays; two values under one id are an error that an audit finds, never an overwrite.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.functions import spans as S
from veilspan.operators import tokens as T
from veilspan.operators.policy import category, mode

VAULT = ("session_id", "kind", "token_id", "value")


def session_pads(session: Column, master: bytes) -> tuple[Column, Column]:
    """Inner and outer pad of the digests of a session, whose key is the keyed digest of its name; null for a null session.

    A function of the row alone: nothing is joined. In production, read keys from a key table instead.
    """
    inner, outer = T.pads(master)
    key = F.sha2(F.concat(F.unhex(F.lit(outer)), F.unhex(F.sha2(F.concat(F.unhex(F.lit(inner)), F.encode(session.cast("string"), "UTF-8")), 256))), 256)

    def pad(byte: int) -> Column:
        word = lambda i: F.conv(F.substring(key, 8 * i + 1, F.lit(8)), 16, 10).cast("bigint")
        words = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.lpad(F.lower(F.hex(word(i).bitwiseXOR(F.lit(byte * 0x01010101)))), 8, "0"))
        return F.concat(F.array_join(words, ""), F.lit(f"{byte:02x}" * 32))

    return tuple(F.when(session.isNotNull(), pad(b)) for b in (0x36, 0x5C))


def session_keys(sessions: DataFrame, session: str, master: bytes) -> DataFrame:
    """A key table: ``session_id``, ``inner``, ``outer`` of each session, from a master key."""
    ids = sessions.select(F.col(session).cast("string").alias("session_id")).where("session_id is not null").distinct()
    inner, outer = session_pads(F.col("session_id"), master)
    return ids.select("session_id", inner.alias("inner"), outer.alias("outer"))


def with_tokens(found: DataFrame, keys: DataFrame | tuple[Column, Column], session: str, text: str = "text", length: int = T.ID_LENGTH) -> DataFrame:
    """``found`` (with ``spans``) and ``items``: for each span its kind, value, token id (null if redacted) and placeholder.

    ``keys``: a key table, or the two pads as columns of ``found`` (``session_pads``), which needs no join. A row whose
    session has no key gets redactions only: nothing can be restored without a key.
    """
    if isinstance(keys, tuple):
        joined = found.withColumns({"inner": keys[0], "outer": keys[1]})
    else:
        joined = found.join(keys.withColumnRenamed("session_id", "__session"), F.col(session).cast("string") == F.col("__session"), "left").drop("__session")

    def item(s: Column) -> Column:
        value = F.substring(F.col(text), s["start"] + 1, s["end"] - s["start"])
        identifier = F.when((mode(s["kind"]) == "pseudonymize") & F.col("inner").isNotNull() & F.col("outer").isNotNull(), T.token_id(value, F.col("inner"), F.col("outer"), length))
        shown = F.coalesce(T.token(s["kind"], identifier), T.redaction(s["kind"]))
        return F.struct(s["kind"].alias("kind"), value.alias("value"), identifier.alias("token_id"), shown.alias("placeholder"))

    return joined.withColumn("items", F.transform("spans", item)).drop("inner", "outer")


def protected(items: DataFrame, text: str = "text") -> DataFrame:
    """All columns, with ``text`` masked and ``counts``, the number of findings by kind."""
    n = lambda k: F.size(F.filter("items", lambda i: i["kind"] == k))
    kinds = F.array_distinct(F.transform("items", lambda i: i["kind"]))
    counts = F.map_from_entries(F.transform(kinds, lambda k: F.struct(k, n(k))))
    return items.withColumn("counts", counts).withColumn(text, S.replaced(F.col(text), F.col("spans"), F.transform("items", lambda i: i["placeholder"])))


def vault_rows(items: DataFrame, session: str) -> DataFrame:
    """The distinct values that can be restored: ``session_id``, ``kind``, ``token_id``, ``value``."""
    rows = items.select(F.col(session).cast("string").alias("session_id"), F.explode("items").alias("i")).where("i.token_id is not null")
    return rows.select("session_id", "i.kind", "i.token_id", "i.value").distinct()


def collisions(vault: DataFrame) -> DataFrame:
    """Ids with more than one value; a vault is sound when there are none."""
    return vault.groupBy("session_id", "kind", "token_id").agg(F.count_distinct("value").alias("values")).where("values > 1")


def clashing(vault: DataFrame, new: DataFrame) -> DataFrame:
    """Ids of ``new`` that stand for another value too, there or in the vault; the vault is only probed by these ids."""
    held = vault.select(*VAULT).join(new.select(*VAULT[:3]).distinct(), list(VAULT[:3]), "left_semi")
    return collisions(new.select(*VAULT).unionByName(held))


def appended(vault: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of ``new`` whose id the vault does not hold yet."""
    return new.select(*VAULT).join(vault.select(*VAULT[:3]), list(VAULT[:3]), "left_anti")


SHARDS = 256  # partitions of a stored vault by session, times its kinds


def shard(session: Column, shards: int = SHARDS) -> Column:
    return F.pmod(F.xxhash64(session.cast("string")), F.lit(shards)).cast("int")


def write_vault(rows: DataFrame, path: str, batch_id: int, shards: int = SHARDS) -> None:
    """Adds rows under the id of a batch, in folders by shard of the session and by kind; a rerun overwrites itself."""
    placed = rows.select(*VAULT).withColumn("shard", shard(F.col("session_id"), shards))
    placed.repartition("shard", "kind").write.mode("overwrite").partitionBy("shard", "kind").parquet(f"{path}/batch_id={batch_id}")


def read_vault(spark: SparkSession, path: str, sessions: DataFrame | None = None, session: str = "session_id", kinds: list[str] | None = None, but: int | None = None, shards: int = SHARDS) -> DataFrame:
    """A stored vault; only of some ``sessions`` and ``kinds`` if they are given, without the rows of batch ``but``.

    Folders of other shards and kinds are not read: a few sessions cost a few folders, whatever the vault has grown to.
    No vault is an empty one.
    """
    names = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not names.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(names):
        return spark.createDataFrame([], "session_id string, kind string, token_id string, value string")
    rows = spark.read.schema("session_id string, token_id string, value string, batch_id long, shard int, kind string").parquet(path)
    if but is not None:
        rows = rows.where(F.col("batch_id") != but)
    if kinds is not None:
        rows = rows.where(F.col("kind").isin(kinds))
    if sessions is not None:
        asked = sessions.select(F.col(session).cast("string").alias("session_id")).distinct()
        held = [r["s"] for r in asked.select(shard(F.col("session_id"), shards).alias("s")).distinct().collect()]  # at most ``shards`` numbers
        rows = rows.where(F.col("shard").isin(held)).join(asked, "session_id", "left_semi")
    return rows.select(*VAULT)


def restored(texts: DataFrame, vault: DataFrame, key: str, session: str, text: str = "text") -> DataFrame:
    """All columns, with the tokens of ``text`` replaced by their values.

    Tokens of other sessions, of another kind than they were made for, unknown ones, those with two values in the vault
    (``collisions``; which one was meant is not known) and redactions stay. Only the distinct tokens of texts that hold
    any are joined with the vault; ``key`` tells rows apart.
    """
    holds = F.col(text).contains("⟦")
    asked = texts.where(holds).select(F.col(key).alias("__key"), F.col(session).cast("string").alias("session_id"), F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(T.TOKEN_JAVA), F.lit(0)))).alias("token"))
    parts = asked.withColumn("kind", F.lower(F.regexp_extract("token", "⟦([A-Z0-9_]+):", 1))).withColumn("token_id", F.regexp_extract("token", ":([0-9A-F]+)⟧", 1))
    known = parts.join(vault.select(*VAULT), list(VAULT[:3])).repartition("__key")  # one exchange serves both groupings
    single = known.groupBy("__key", "token").agg(F.min("value").alias("value"), F.max("value").alias("other")).where("value = other")
    maps = single.groupBy("__key").agg(F.map_from_entries(F.collect_list(F.struct("token", "value"))).alias("__map"))
    joined = texts.join(maps, texts[key] == maps["__key"], "left").drop("__key")
    spans = S.matches(F.col(text), T.TOKEN_JAVA, "token")
    values = F.transform(F.col("__spans"), lambda s: F.coalesce(F.col("__map")[F.substring(F.col(text), s["start"] + 1, s["end"] - s["start"])], F.substring(F.col(text), s["start"] + 1, s["end"] - s["start"])))
    back = joined.withColumn("__spans", spans)
    return back.withColumn(text, F.when(F.col("__map").isNull(), F.col(text)).otherwise(S.replaced(F.col(text), F.col("__spans"), values))).drop("__spans", "__map")


# The path argument of the tools whose paths are restored; shell commands never are.
PATH_ARGUMENTS = {"Read": "file_path", "Edit": "file_path", "MultiEdit": "file_path", "Write": "file_path", "NotebookEdit": "notebook_path", "Glob": "path", "Grep": "path"}


def restored_paths(events: DataFrame, vault: DataFrame, key: str, session: str, tool: str = "tool_name", arguments: str = "tool_input") -> DataFrame:
    """``key``, ``path``: the path argument of an event, its tokens restored; no row for tools or events without one."""
    path = F.coalesce(*(F.when(F.col(tool) == t, F.get_json_object(arguments, f"$.{a}")) for t, a in PATH_ARGUMENTS.items()))
    rows = events.select(F.col(key), F.col(session), path.alias("path")).where("path is not null")
    return restored(rows, vault, key, session, text="path").select(key, "path")


def summary(items: DataFrame, *groups: str) -> DataFrame:
    """Counts by group, action and category, without any value."""
    rows = items.select(*groups, F.explode("items").alias("i"))
    action = F.when(F.col("i.token_id").isNotNull(), "pseudonymized").otherwise("redacted")
    return rows.groupBy(*groups, action.alias("action"), category(F.col("i.kind")).alias("category")).agg(F.count("*").alias("occurrences"))


class Cipher(NamedTuple):
    """How values are stored: a column to its cipher text, and back (null for what does not open)."""

    close: Callable[[Column], Column]
    open: Callable[[Column], Column]


def aes(key: Column) -> Cipher:
    """AES-GCM; the key comes as a column, so that no plan need show it as a literal."""
    return Cipher(lambda v: F.base64(F.aes_encrypt(v, key, F.lit("GCM"))), lambda v: F.try_aes_decrypt(F.unbase64(v), key, F.lit("GCM")).cast("string"))


def encrypted(vault: DataFrame, cipher: Cipher | Column) -> DataFrame:
    """The vault with its values closed; ``decrypted`` is the way back, null for a wrong key. A column is a key for AES-GCM."""
    cipher = aes(cipher) if isinstance(cipher, Column) else cipher
    return vault.withColumn("value", cipher.close(F.col("value")))


def decrypted(vault: DataFrame, cipher: Cipher | Column) -> DataFrame:
    cipher = aes(cipher) if isinstance(cipher, Column) else cipher
    return vault.withColumn("value", cipher.open(F.col("value")))
