"""Problem 4: visually identical text with different characters, brought to one form.

Width and presentation forms, odd spaces, invisible marks and accents apart from their letter are settled character
by character. Look-alike letters are settled token by token: the scripts of a token's letters are counted, and in a
token that mixes scripts the letters that are not of its dominant script are replaced by their look-alikes in it, when
the result is a word of the corpus vocabulary, which is gathered over all texts; else the next script of the token is
tried, since more than half of a short word's letters may have been exchanged. Tokens of one script stay, and so do
emoji and the joiners inside them, superscripts, fractions and typographic marks.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.llm.batches import sliced
from veilspan.llm.characters import INVISIBLE, LOOKALIKES, SPACES
from veilspan.sources.tables import table

#: Texts wholly of these characters need no repair; the test runs in the JVM.
ORDINARY = r"^[\x00-\x7E¡-¬®-İĲ-ſ‐-‖‘-„†-‧‰-″€]*$"
# Kinds of compatibility forms that only look like the ordinary character.
_FORMS = ("<wide>", "<narrow>", "<font>", "<initial>", "<medial>", "<final>", "<isolated>")
_JOINER, _VARIATIONS = "‍", "︎️"
_SUSPECT = re.compile(r"[^\x00-\x7E¡-¬®-İĲ-ſ‐-‖‘-„†-‧‰-″€]")
_WORD = re.compile(r"[^\W\d_]+")


def _emoji(c: str) -> bool:
    return bool(c) and (c >= "\U0001f000" or "←" <= c <= "➿" or "⬀" <= c <= "⯿" or c in "©®‼⁉™〰〽㊗㊙⃣")


@functools.lru_cache(maxsize=4096)
def _plain(c: str) -> str:
    """The ordinary character for a width or presentation form, space or invisible mark; else the character itself."""
    if c in SPACES:
        return " "
    if c in INVISIBLE:
        return ""
    if c in "  \u0085":
        return "\n"
    form = unicodedata.decomposition(c)
    if form.startswith(_FORMS) or form.startswith("<compat>") and ("ﬀ" <= c <= "ﭏ" or "Ⅰ" <= c <= "ⅿ"):
        return unicodedata.normalize("NFKC", c)
    return c


# Scripts with look-alikes of Latin letters; phonetic and dotless letters are an alphabet of their own.
SCRIPTS = ("latin", "cyrillic", "greek", "armenian")


@functools.lru_cache(maxsize=4096)
def script(c: str) -> str:
    """One of ``SCRIPTS``, ``odd`` (a letter of another Latin alphabet that looks like an ordinary one) or ``far``."""
    if c < "ɐ" and c not in LOOKALIKES or "Ḁ" <= c <= "ỿ":
        return "latin"
    name = unicodedata.name(c, "").split(" ", 1)[0].lower()
    return name if name in SCRIPTS[1:] else "odd" if c in LOOKALIKES else "far"


def _sisters() -> dict[str, dict[str, str]]:
    """Of every script, its letter for a letter of another one that looks the same."""
    to = {s: {} for s in SCRIPTS}
    to["latin"] = dict(LOOKALIKES)
    for c, plain in LOOKALIKES.items():
        if script(c) in SCRIPTS:
            to[script(c)].setdefault(plain, c)
    for s in SCRIPTS[1:]:
        to[s] |= {c: to[s][plain] for c, plain in LOOKALIKES.items() if script(c) != s and plain in to[s]}
    return to


_SISTERS = _sisters()


Edit = tuple[int, int, str]


def character_edits(text: str) -> list[Edit]:
    """(start, end, replacement) of the characters that have one ordinary form, whatever the words say."""
    out: list[Edit] = []
    n, done = len(text), 0
    for m in _SUSPECT.finditer(text):
        i = m.start()
        if i < done:
            continue
        c = text[i]
        if c == _JOINER or c in _VARIATIONS or c == "‌":
            before = text[i - 1] if i else ""
            k = i - 1
            while k > 0 and (text[k] in _VARIATIONS or "🏻" <= text[k] <= "🏿"):
                k -= 1
            after = text[i + 1] if i + 1 < n else ""
            if k >= 0 and _emoji(text[k]) and (c in _VARIATIONS or _emoji(after)) or c in _VARIATIONS and before and before in "0123456789#*":
                continue
            if c not in _VARIATIONS and before > "֏" and before.isalpha() and after > "֏" and after.isalpha() and script(before) == script(after) == "far":
                continue
        start = i
        if unicodedata.combining(c) and start and not unicodedata.combining(text[start - 1]) and start - 1 >= done:
            start -= 1
        end = i + 1
        while end < n and unicodedata.combining(text[end]):
            end += 1
        plain = unicodedata.normalize("NFC", "".join(map(_plain, text[start:end])))
        if plain != text[start:end]:
            out.append((start, end, plain))
        done = end
    return out


def applied(text: str, edits: list[Edit]) -> str:
    out, at = [], 0
    for s, e, new in edits:
        out += [text[at:s], new]
        at = e
    return "".join(out) + text[at:]


def moved(offset: int, edits: list[Edit], end: bool = False) -> int:
    """Where an offset of the old text lies in the new one; inside an edit, its start, or its end for an ``end``."""
    shift = 0
    for s, e, new in edits:
        if offset >= e:
            shift += len(new) - (e - s)
        elif offset > s:
            return s + shift + (min(len(new), offset - s) if not end else len(new))
        else:
            break
    return offset + shift


def by_dominance(word: str) -> list[str]:
    """The scripts of a token's letters, the dominant one first, where letters of several scripts or alphabets stand in it; else none.

    Phonetic and dotless letters are Latin. Of scripts with as many letters the first of ``SCRIPTS`` leads. Letters of
    far scripts have no look-alikes: such a token is left alone.
    """
    counts = Counter(script(c) for c in word if unicodedata.category(c) != "Lm")
    if counts["far"] or len(counts) < 2:
        return []
    counts["latin"] += counts.pop("odd", 0)
    return sorted((s for s in SCRIPTS if counts[s]), key=lambda s: -counts[s])


def look_alikes(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, spelling, script) of tokens that mix scripts: for each of their scripts, the dominant one first, the spelling in it, if there is one."""
    out = []
    for m in _WORD.finditer(text):
        word = m.group()
        for kind in by_dominance(word) if any(c > "ɏ" or c == "ı" for c in word) else ():
            spelled = "".join(c if script(c) == kind else _SISTERS[kind].get(c, c) for c in word)
            if all(script(c) == kind or unicodedata.category(c) == "Lm" for c in spelled):
                out.append((m.start(), m.end(), spelled, kind))
    return out


def _scan(batches: Iterator[pa.RecordBatch], latin: bool) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        sure, words = [], []
        for text in batch.column(1).to_pylist():
            edits = character_edits(text)
            tokens = look_alikes(applied(text, edits) if edits else text)
            sure.append(bool(edits))
            words.append(sorted({w.lower() for _, _, w, k in tokens if k == "latin" or not latin}))
        yield pa.record_batch([batch.column(0), pa.array(sure), pa.array(words, pa.list_(pa.string()))], names=["id", "sure", "words"])


def vocabulary(texts: DataFrame, column: str = "text") -> DataFrame:
    """``word``: every word of the texts that is written in letters of one script only, in lower case, once."""
    words = F.explode(F.split(F.lower(F.col(column)), r"[\s\d\p{Punct}«»’“”…–—°€]+"))
    return texts.select(words.alias("word")).where(F.col("word").rlike(r"^(?:[\p{IsLatin}&&[^ıȷɐ-ʯᴀ-ᶿꜱ]]+|\p{IsCyrillic}+|\p{IsGreek}+|\p{IsArmenian}+)$")).distinct()


def suspects(records: DataFrame, key: str, text: str, latin: bool = False) -> DataFrame:
    """``id``, ``sure`` (a character edit applies) and ``words`` (spellings that the vocabulary must confirm); ``latin``: of Latin words only."""
    rows = records.select(F.col(key).alias("id"), F.col(text).alias("text")).where(~F.col("text").rlike(ORDINARY))
    return rows.mapInArrow(lambda batches: _scan(batches, latin), f"id {records.schema[key].dataType.simpleString()}, sure boolean, words array<string>")


def odd_records(records: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """Distinct ``key`` of the records whose text holds a character that stands for another or cannot be seen.

    Null and empty texts hold none, very long ones are read whole; null keys are left out. Repeated rows add nothing. An empty table gives no rows.
    Other columns are ignored.
    """
    found = suspects(records, key, text, latin=True).where("id is not null").select("id", "sure", F.explode_outer(F.when(~F.col("sure"), F.col("words"))).alias("word"))
    words = vocabulary(records, text).withColumn("confirmed", F.lit(True))
    kept = found.join(words, "word", "left").where("sure or confirmed")
    return kept.select("id").distinct().withColumnRenamed("id", key)


def repaired_text(text: str, confirmed: set[str]) -> tuple[str, list[list[Edit]]]:
    """The text in one form and the two rounds of edits that lead to it."""
    first = character_edits(text)
    middle = applied(text, first) if first else text
    # of the spellings of a token the first that is a word: in its dominant script, else in another one of its own
    second = list({s: (s, e, w) for s, e, w, _ in reversed(look_alikes(middle)) if w.lower() in confirmed}.values())[::-1]
    return (applied(middle, second) if second else middle), [first, second]


def repaired(records: DataFrame, key: str = "id", text: str = "text", spans: str = "spans") -> DataFrame:
    """One row per key with ``text`` in one form and ``spans`` (array of structs with start and end) moved along.

    Of a key that comes several times, the first row in the order of its text is taken. A null text stays null, null
    spans stay null, spans outside the text stay as far outside. Null keys are left out. Other columns are ignored.
    """
    rows = records.select(F.col(key).alias("id"), F.col(text).alias("text"), F.col(spans).alias("spans")).where("id is not null")
    # the first row of an id by its text; of equal texts the one with the least spans
    rows = rows.groupBy("id").agg(F.min(F.struct("text", "spans")).alias("r")).select("id", "r.text", "r.spans")
    odd = rows.where(~F.col("text").rlike(ORDINARY))
    plain = rows.where(F.col("text").isNull() | F.col("text").rlike(ORDINARY))
    asked = suspects(records, key, text).select("id", F.explode("words").alias("word")).distinct()
    confirmed = asked.join(vocabulary(records, text), "word").groupBy("id").agg(F.collect_set("word").alias("confirmed"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts, all_spans = [], []
            for t, s, c in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), batch.column("confirmed").to_pylist(), strict=True):
                new, rounds = repaired_text(t, set(c or ()))
                texts.append(new)
                for edits in rounds if s else ():
                    s = [x | {"start": moved(x["start"], edits), "end": moved(x["end"], edits, True)} if x and x["start"] is not None and x["end"] is not None else x for x in s]
                all_spans.append(s)
            yield pa.record_batch([batch.column("id"), pa.array(texts, pa.string()), pa.array(all_spans, batch.schema.field("spans").type)], names=["id", "text", "spans"])

    done = odd.join(confirmed, "id", "left").mapInArrow(run, rows.schema)
    return plain.unionByName(done)


def p4_found(spark: SparkSession, directory: str) -> DataFrame:
    """Quality records with characters that stand for others or cannot be seen."""
    return odd_records(table(spark, directory, "quality", "id", "text"))


def p4_repaired(spark: SparkSession, directory: str) -> DataFrame:
    """Every quality record in one form, with its spans."""
    return repaired(table(spark, directory, "quality", "id", "text", "spans"))


QUERIES = {"p4_found": p4_found, "p4_repaired": p4_repaired}
