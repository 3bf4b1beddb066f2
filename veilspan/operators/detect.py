"""Detection over DataFrames: priorities of the detectors, names shared in a batch, and native single rules."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan.functions import spans as S
from veilspan.functions import validators as check
from veilspan.operators import names as N
from veilspan.operators.policy import redacts
from veilspan.operators.rules import TOOL_NAME, Span, drop_touching, personal_data, secrets, settle, tool_vocabulary
from veilspan.operators.tabular import tabular
from veilspan.operators.tokens import PLACEHOLDER, PLACEHOLDER_JAVA
from veilspan.sources.batches import sliced
from veilspan.sources.shared import shared_folder

NameDetector = Callable[[str], list[Span]]
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def first_pass(text: str | None, names: NameDetector = N.context_names) -> list[Span]:
    """Secrets, then formatted and tabular data, then names; nothing that touches a placeholder.

    External markers are kept before each list yields to the ones before it, and names of tool words are none.
    """
    if not text:
        return []
    kept = secrets(text)
    data = N.keep_markers(text, settle(personal_data(text) + tabular(text)), redacts)
    kept = kept + drop_touching(data, kept)
    if N.name_gate(text):
        people = [s for s in N.completed(text, names(text)) if not tool_vocabulary(text[s.start : s.end])]
        kept = kept + drop_touching(N.keep_markers(text, people, redacts), kept)
    held = [Span("token", *m.span()) for m in PLACEHOLDER.finditer(text)] if "⟦" in text else []
    return drop_touching(sorted(kept, key=lambda s: s.start), held)


def with_known(text: str | None, found: list[Span], known: Iterable[str]) -> list[Span]:
    """The findings of a text and what known names add to them; external markers survive this too."""
    return N.keep_markers(text, N.spread(text, found, known), redacts) if text else found


def detected(text: str | None, names: NameDetector = N.context_names) -> list[Span]:
    """The findings of one text, its own names wherever they stand again in it."""
    found = first_pass(text, names)
    return with_known(text, found, {text[s.start : s.end] for s in found if s.kind == "person_name"})


def _array(rows: list[list[Span]]) -> pa.Array:
    return pa.array([[s._asdict() for s in r] for r in rows], _ARROW)


def with_spans(texts: DataFrame, text: str = "text", out: str = "spans", names: NameDetector = N.context_names, find: Callable[[str | None, NameDetector], list[Span]] = detected) -> DataFrame:
    """All columns and ``out``, the findings of ``text`` in order. Null and empty texts have none."""
    at = texts.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            found = _array([find(t, names) for t in b.column(at).to_pylist()])
            yield pa.record_batch([*b.columns, found], names=[*b.schema.names, out])

    return texts.mapInArrow(run, f"{_ddl(texts)}, `{out}` {S.SPANS}")


def _ddl(frame: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields)


def tool_words(name: Column) -> Column:
    """Whether every word of a name is a word of the tools."""
    return name.rlike(f"(?U){TOOL_NAME}")


MOST_NAMES = 2000  # names a batch may carry to each of its texts; a batch with more goes by the words of its texts


def _known(found: DataFrame, names: DataFrame, text: str, most: int) -> DataFrame:
    """``found`` (with ``__batch``) and ``__known``: the names of its batch that its text may hold.

    A batch of at most ``most`` names gives all of them to every text. In a larger one a text gets the names whose last
    word it holds, by an equi-join on batch and word, so no set grows with the batch.
    """
    counts = names.groupBy("__batch").agg(F.count("*").alias("__n"))
    sets = names.join(counts.where(F.col("__n") <= most), "__batch").groupBy("__batch").agg(F.collect_set("name").alias("__few"))
    large = counts.where(F.col("__n") > most).select("__batch")
    words = lambda c: F.filter(F.split(F.lower(c), r"(?U)[^\p{L}\p{N}\p{M}]+"), lambda w: w != "")
    by_word = names.join(large, "__batch").select("__batch", "name", F.try_element_at(words(F.col("name")), F.lit(-1)).alias("__w"))
    holding = found.join(large, "__batch").select("__batch", F.sha2(text, 256).alias("__h"), F.explode(F.array_distinct(words(F.col(text)))).alias("__w")).distinct()
    many = holding.join(by_word, ["__batch", "__w"]).groupBy("__batch", "__h").agg(F.collect_set("name").alias("__many"))
    out = found.withColumn("__h", F.sha2(text, 256)).join(sets, "__batch", "left").join(many, ["__batch", "__h"], "left")
    return out.withColumn("__known", F.coalesce("__few", "__many")).drop("__few", "__many", "__h")


def find_many(texts: DataFrame, batch: str, text: str = "text", known: DataFrame | None = None, names: NameDetector = N.context_names, most: int = MOST_NAMES) -> DataFrame:
    """``with_spans``, and every name found in a batch, or known for it, wherever it stands again in that batch.

    ``known``: the batch key and ``name``. Names meet the texts in joins on the batch key; the texts themselves are not
    grouped, so a batch of any number of texts stays spread over the partitions. Rows of a null batch share names too.
    """
    shared_folder(texts.sparkSession)
    key = F.coalesce(F.concat(F.lit("="), F.col(batch).cast("string")), F.lit(""))
    # detection is the costly part: done once, and kept in the shared folder for the three readers below
    found = with_spans(texts, text, names=names, find=first_pass).withColumn("__batch", key).checkpoint()
    own = found.where(F.exists("spans", lambda s: s["kind"] == "person_name")).select("__batch", F.explode(S.spellings(F.col(text), F.col("spans"))).alias("name"))
    if known is not None:
        own = own.unionByName(known.where(~tool_words(F.col("name"))).select(key.alias("__batch"), "name"))
    joined = _known(found, own.distinct(), text, most).drop("__batch")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            columns = dict(zip(b.schema.names, b.columns, strict=True))
            rows = zip(columns[text].to_pylist(), columns["spans"].to_pylist(), columns["__known"].to_pylist(), strict=True)
            columns["spans"] = _array([with_known(t, [Span(**x) for x in s], k or ()) for t, s, k in rows])
            yield pa.record_batch([columns[c] for c in out], names=out)

    out = [c for c in joined.columns if c != "__known"]
    return joined.mapInArrow(run, _ddl(joined.select(*out)))


# Native single rules: Java patterns, gated by a literal that every match holds.
EMAIL = r"(?<![\w.%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}\b"
PHONE_FR = r"(?<![\w+])(?<!\d[.,])0[1-9](?:[ .-]?\d{2}){4}(?!\w)(?![.,]\d)"
PHONE_PLUS = r"(?<![\w+])(?<!\d[.,])\+\d{1,3}(?:[ .-]?\d){6,14}(?!\w)(?![.,]\d)"
PHONE_NANP = r"(?<![\w+])(?<!\d[.,])(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\w)(?![.,]\d)"
CARD = r"(?<![\w+])(?<!\d[.,])\d(?:[ -]?\d){12,18}(?!\w)(?![.,]\d)"


def emails(text: Column) -> Column:
    return F.when(text.contains("@"), S.matches(text, EMAIL, "email")).otherwise(F.array().cast(S.SPANS))


def phones(text: Column) -> Column:
    found = S.without_overlaps(S.union(*(S.matches(text, p, "phone") for p in (PHONE_FR, PHONE_PLUS, PHONE_NANP))))
    return F.when(text.rlike(r"\d(?:[ .()-]{0,2}\d){6}"), found).otherwise(F.array().cast(S.SPANS))


def cards(text: Column) -> Column:
    found = S.matches(text, CARD, "payment_card")
    return F.filter(found, lambda s: check.payment_card(F.substring(text, s["start"] + 1, s["end"] - s["start"])))


def placeholders(text: Column) -> Column:
    return F.when(text.contains("⟦"), S.matches(text, PLACEHOLDER_JAVA, "token")).otherwise(F.array().cast(S.SPANS))
