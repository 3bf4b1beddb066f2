"""Queries of the whole detector over forms written for every customer, with SQL that finds the same.

A form is a text with one value of each kind under its label, a table with an index column, external markers, words of
tools where a name stands, and the name of the next customer without any label. Half of the checksums, or a tenth, are
right. The same expression makes the text in Spark and in SQL; the SQL then reads the values back out of the text by
label and shape, computes the checksums, and builds masked texts by its own keyed digests.
"""

from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.functions import spans as S
from veilspan.operators import detect as D
from veilspan.operators import names as N
from veilspan.operators import policy as P
from veilspan.operators import tokens as T
from veilspan.operators import vault as V
from veilspan.sources import lexicon as L
from veilspan.sources.shared import shared_folder
from veilspan.sources.tables import spread, table

MASTER = b"0123456789abcdef0123456789abcdef"  # a fixed key for these queries only
SESSIONS = 10


def _digits(value: str, n: int) -> str:
    return f"lpad(cast({value} as string), {n}, '0')"


def _letters(value: str) -> str:
    return f"translate(cast({value} as string), '0123456789', 'abcdefghij')"


_BANK = 30006000011234567
_NIR = "(1850175000000 + k % 1000000)"
_TAX = "(1000000000 + k % 1000000000)"
#: Kind, what stands before the value, the value (Spark and DuckDB read it alike), its shape, its checksum in SQL.
FIELDS = (
    ("person_name", "Nom : ", f"'Zoe K' || {_letters('k')}", "Zoe K[a-j]+", ""),
    ("fr_siret", ". SIRET : ", f"'7' || {_digits('k * 104729 % 10000000000000', 13)}", r"\d{14}", "luhn"),
    ("fr_siren", " ; SIREN ", f"'7' || {_digits('k * 7919 % 100000000', 8)}", r"\d{9}", "luhn"),
    ("payment_card", ". Carte ", f"'4' || {_digits('k * 15485863 % 1000000000000000', 15)}", r"\d{16}", "luhn"),
    ("card_security_code", ", CVV : ", _digits("k % 1000", 3), r"\d{3}", ""),
    ("birth_date", ". Né le ", f"{_digits('k % 28 + 1', 2)} || '/' || {_digits('k % 12 + 1', 2)} || '/' || cast(1940 + k % 60 as string)", r"\d{2}/\d{2}/\d{4}", ""),
    ("fr_social_security_number", ", NIR ", f"cast({_NIR} as string) || {_digits(f'97 - {_NIR} % 97 + k % 2', 2)}", r"\d{15}", "97 - cast(substr({v}, 1, 13) as bigint) % 97 = cast(substr({v}, 14) as bigint)"),
    ("fr_tax_number", ", fiscal ", f"cast({_TAX} as string) || {_digits(f'{_TAX} % 511 + k % 2', 3)}", r"\d{13}", "cast(substr({v}, 1, 10) as bigint) % 511 = cast(substr({v}, 11) as bigint)"),
    ("iban", ". IBAN ", f"'FR' || {_digits(f'98 - (({_BANK % 97} * 1000000 + k % 1000000) * 1000000 + 152700) % 97 - k % 2', 2)} || '{_BANK}' || {_digits('k % 1000000', 6)}", r"FR\d{25}", "cast(substr({v}, 5) || '1527' || substr({v}, 3, 2) as hugeint) % 97 = 1"),
    ("fr_passport", ". Passeport ", f"{_digits('k % 100', 2)} || 'AB' || {_digits('k % 100000', 5)}", r"\d{2}AB\d{5}", ""),
    ("fr_license_plate", ", plaque ", f"'AB-' || {_digits('k % 1000', 3)} || '-CD'", r"AB-\d{3}-CD", ""),
    ("fr_driving_licence", ". Permis ", f"'P' || {_digits('k % 10000000000', 10)}", r"P\d{10}", ""),
    ("fr_identity_card", ", CNI : ", f"'C' || {_digits('k % 100000000000', 11)}", r"C\d{11}", ""),
    ("phone", ". Tel ", f"'06 ' || {_digits('k % 100', 2)} || ' ' || {_digits('k * 3 % 100', 2)} || ' ' || {_digits('k * 7 % 100', 2)} || ' ' || {_digits('k * 9 % 100', 2)}", r"06(?: \d{2}){4}", ""),
    ("email", ", mel ", "'u' || cast(k as string) || '@mail' || cast(k % 7 as string) || '.example'", r"u\d+@mail\d\.example", ""),
    ("fr_postal_address", ". Adresse ", "cast(k % 99 + 1 as string) || ' rue de la Paix, 75002 Paris'", r"\d+ rue de la Paix, \d{5} Paris", ""),
    ("stripe_secret_key", ".\nSTRIPE_SECRET_KEY=", f"'sk_live_key' || {_digits('k', 10)}", r"sk_live_key\d{10}", ""),
    ("secret_assignment", "\npassword=", f"'Pw' || {_digits('k', 6)} || '!'", r"Pw\d{6,}!", ""),
)
#: Parts that only some forms have: when, what stands before the value, the value, its shape, what follows.
PARTS = (
    ("k % 7 = 0", "\nContact : ", "'Person_001'", "Person_001", " et [PERSON_001]"),
    ("k % 3 = 0", "\n\n,first_name,email\n0,", f"'Ann' || {_letters('k')}", "Ann[a-j]+", ",-\n"),
)
_line = lambda text: " || chr(10) || ".join(f"'{x}'" for x in text.split("\n"))
FORM = " || ".join([
    *(f"{_line(before)} || {value}" for _, before, value, _, _ in FIELDS), f"chr(10) || 'Vu avec Zoe K' || {_letters('k + 1')} || ' hier.'", "case when k % 5 = 0 then chr(10) || 'Auteur : Claude Code' else '' end",
    *(f"case when {when} then {_line(before)} || {value} || {_line(after)} else '' end" for when, before, value, _, after in PARTS),
])


def forms(spark: SparkSession, d: str) -> DataFrame:
    """``k``, ``session`` (one of ten), ``batch`` (ten customers) and ``text``."""
    rows = spread(table(spark, d, "customer", "c_custkey")).select(F.col("c_custkey").cast("bigint").alias("k"))
    return rows.selectExpr("k", f"cast(k % {SESSIONS} as string) as session", "k - k % 10 as batch", f"{FORM} as text")


def form_findings(spark: SparkSession, d: str) -> DataFrame:
    """Every finding of every form, by the whole detector."""
    found = D.with_spans(forms(spark, d)).select("k", "text", F.explode("spans").alias("s"))
    return found.select("k", "s.kind", F.substring(F.col("text"), F.col("s.start") + 1, F.col("s.end") - F.col("s.start")).alias("value"))


def card_values(spark: SparkSession, d: str) -> DataFrame:
    """Payment cards by the native rule."""
    return forms(spark, d).select("k", F.explode(S.values(F.col("text"), D.cards(F.col("text")))).alias("value"))


def _items(spark: SparkSession, d: str, length: int = T.ID_LENGTH) -> DataFrame:
    found = D.with_spans(forms(spark, d))
    return V.with_tokens(found, V.session_pads(F.col("session"), MASTER), "session", length=length)


def masked_forms(spark: SparkSession, d: str) -> DataFrame:
    """Forms with tokens of their sessions and redactions in place of the findings."""
    return V.protected(_items(spark, d)).select("k", "text", F.aggregate(F.map_values("counts"), F.lit(0), lambda a, n: a + n).alias("findings"))


def protection_summary(spark: SparkSession, d: str) -> DataFrame:
    return V.summary(_items(spark, d), "session")


def vault_values(spark: SparkSession, d: str) -> DataFrame:
    return V.vault_rows(_items(spark, d), "session").groupBy("session_id", "kind").agg(F.count("*").alias("values"))


def restored_forms(spark: SparkSession, d: str) -> DataFrame:
    """Masked forms restored from the vault of their sessions: redactions stay. The detector runs once."""
    shared_folder(spark)
    items = _items(spark, d, T.LONG_ID).checkpoint()
    masked = V.protected(items).select("k", "session", "text")
    return V.restored(masked, V.vault_rows(items, "session"), "k", "session").select("k", "text")


def session_names(spark: SparkSession, d: str) -> DataFrame:
    """Names of forms whose batch is read together: each form also gets the name of the next customer, if that is in its batch."""
    found = D.find_many(forms(spark, d), "batch").select("k", "text", F.explode(F.filter("spans", lambda s: s["kind"] == "person_name")).alias("s"))
    return found.select("k", F.substring(F.col("text"), F.col("s.start") + 1, F.col("s.end") - F.col("s.start")).alias("name"))


# --- lexicon: regions as given names, nations as family names ---------------------------------------------------------
_FAMILY = "translate(lower(n_name), '0123456789_', 'abcdefghij')"


def _family() -> Column:
    return F.expr(_FAMILY)


def _lexicon(spark: SparkSession, d: str) -> DataFrame:
    rows = (table(spark, d, t).select(F.lit(kind).alias("kind"), c.alias("value")) for t, kind, c in (("region", "given", F.lower("r_name")), ("nation", "family", _family())))
    return next(rows).unionByName(next(rows)).distinct()


def _paired(spark: SparkSession, d: str) -> DataFrame:
    """Each customer with a given name ``g`` and a family name ``f`` that follow from its key."""
    customers = table(spark, d, "customer", "c_custkey").select(F.col("c_custkey").cast("bigint").alias("k"))
    given = table(spark, d, "region").select(F.col("r_regionkey").cast("bigint").alias("r"), F.lower("r_name").alias("g"))
    family = table(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("n"), _family().alias("f"))
    return customers.join(given, F.col("k") % 5 == F.col("r")).join(family, F.col("k") % 25 == F.col("n")).select("k", "g", "f")


def lexicon_counts(spark: SparkSession, d: str) -> DataFrame:
    return L.counts(_lexicon(spark, d))


def lexicon_names(spark: SparkSession, d: str) -> DataFrame:
    """Names in lower case that only the lexicon tells: in fields and, with what is joined to them, in file names."""
    held = L.contains(_lexicon(spark, d))
    rows = spread_pairs(_paired(spark, d))
    found = D.with_spans(rows, names=lambda text: N.context_names(text, held)).select("k", "text", F.explode("spans").alias("s"))
    return found.select("k", F.substring(F.col("text"), F.col("s.start") + 1, F.col("s.end") - F.col("s.start")).alias("name"))


def spread_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.select("k", F.concat(F.lit("prénom : "), "g", F.lit(", nom : "), "g", F.lit(" "), "f", F.lit("; cv_"), "g", F.lit("_"), "f", F.lit(".pdf, data_main.py")).alias("text"))


def lexicon_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of words that are a given and a family name in either order, by two semi-joins; every second pair is turned round, every third is broken."""
    turned = F.when(F.col("k") % 2 == 0, F.struct(F.col("g").alias("a"), F.col("f").alias("b"))).otherwise(F.struct(F.upper("f").alias("a"), F.initcap("g").alias("b")))
    rows = _paired(spark, d).select("k", turned.alias("p")).select("k", F.when(F.col("k") % 3 == 0, F.lit("nobody")).otherwise(F.col("p.a")).alias("a"), F.col("p.b").alias("b"))
    return L.known_pairs(rows, _lexicon(spark, d), "a", "b")


# --- whole documents ---------------------------------------------------------------------------------------------------
def reversible(spans: Column) -> Column:
    return F.filter(spans, lambda s: P.mode(s["kind"]) == "pseudonymize")


def restored_documents(spark: SparkSession, d: str) -> DataFrame:
    """Every document with its restorable findings masked and restored again: the text must be what it was. The detector runs once."""
    shared_folder(spark)
    rows = spread(table(spark, d, "documents", "doc_id", "text", "origin")).withColumn("session", F.coalesce("origin", F.lit("none")))
    found = D.with_spans(rows).withColumn("spans", reversible(F.col("spans")))
    items = V.with_tokens(found, V.session_pads(F.col("session"), MASTER), "session", length=T.LONG_ID).checkpoint()
    masked = V.protected(items).select("doc_id", "session", "text")
    return V.restored(masked, V.vault_rows(items, "session"), "doc_id", "session").select("doc_id", "text")


QUERIES = {f.__name__: f for f in (form_findings, card_values, masked_forms, protection_summary, vault_values, restored_forms, session_names, lexicon_counts, lexicon_names, lexicon_pairs, restored_documents)}

# --- SQL ---------------------------------------------------------------------------------------------------------------
_LUHN = "list_sum(list_transform(range(1, length({v}) + 1), lambda i: case when i % 2 = 1 then cast(substr({v}, -i, 1) as int) else (2 * cast(substr({v}, -i, 1) as int)) // 10 + (2 * cast(substr({v}, -i, 1) as int)) % 10 end)) % 10 = 0"
_FORMS = f"forms as (select k, cast(k % {SESSIONS} as string) as session, k - k % 10 as batch, {FORM} as text from (select cast(c_custkey as bigint) as k from customer))"
_escaped = lambda text: text.replace("\n", r"\n")


def _value(before: str, shape: str, check: str = "") -> str:
    v = f"regexp_extract(text, '{_escaped(before)}({shape})', 1)"
    return f"case when {v} <> '' and ({(_LUHN if check == 'luhn' else check).format(v=v)}) then {v} else '' end" if check else v


_SPOTS = [(kind, before, _value(before, shape, check)) for kind, before, _, shape, check in FIELDS] + [("person_name", before, _value(before, shape)) for _, before, _, shape, _ in PARTS]
_FOUND = f"found as (select k, session, batch, x.kind as kind, x.value as value from (select k, session, batch, unnest([{', '.join(f'struct_pack(kind := {chr(39)}{kind}{chr(39)}, value := {v})' for kind, _, v in _SPOTS)}]) as x from forms) where x.value <> '')"
_REDACTED = ("card_security_code", "stripe_secret_key", "secret_assignment")


def _session_pads() -> tuple[str, str]:
    """Pads of the ten sessions, by the standard library."""
    keys = [hmac.new(MASTER, str(i).encode(), hashlib.sha256).digest() for i in range(SESSIONS)]
    return tuple("list_extract([" + ", ".join(f"'{T.pads(k)[side]}'" for k in keys) + "], cast(k % 10 as int) + 1)" for side in (0, 1))


_INNER, _OUTER = _session_pads()


def _masked(kept: bool) -> str:
    """The text with a token or redaction for each value; with ``kept``, only the redactions."""
    out = "text"
    for kind, before, v in _SPOTS:
        if kind in _REDACTED:
            shown = f"'⟦{kind.upper()}:REDACTED⟧'"
        elif kept:
            continue
        else:
            shown = f"'⟦{kind.upper()}:' || upper(substr(sha256(unhex({_OUTER}) || unhex(sha256(unhex({_INNER}) || encode({v})))), 1, 8)) || '⟧'"
        out = f"replace({out}, {_line(before)} || {v}, {_line(before)} || case when {v} = '' then '' else {shown} end)"
    return out


_CATEGORY = f"case {' '.join(f'when kind = {chr(39)}{k}{chr(39)} then {chr(39)}{P.summary_category(k)}{chr(39)}' for k, *_ in FIELDS)} end"
_PAIRED = f"paired as (select cast(c_custkey as bigint) as k, lower(r_name) as g, {_FAMILY} as f from customer join region on c_custkey % 5 = r_regionkey join nation on c_custkey % 25 = n_nationkey)"
SQL = {
    "form_findings": f"with {_FORMS}, {_FOUND} select k, kind, value from found",
    "card_values": f"with {_FORMS}, {_FOUND} select k, value from found where kind = 'payment_card'",
    "masked_forms": f"with {_FORMS}, {_FOUND} select k, {_masked(False)} as text, (select cast(count(*) as int) from found where found.k = forms.k) as findings from forms",
    "protection_summary": f"with {_FORMS}, {_FOUND} select session, case when kind in {_REDACTED} then 'redacted' else 'pseudonymized' end as action, {_CATEGORY} as category, count(*) as occurrences from found group by all",
    "vault_values": f"with {_FORMS}, {_FOUND} select session as session_id, kind, count(distinct value) as \"values\" from found where kind not in {_REDACTED} group by all",
    "restored_forms": f"with {_FORMS} select k, {_masked(True)} as text from forms",
    "session_names": f"""with {_FORMS}, {_FOUND}, named as (select k, batch, value from found where kind = 'person_name')
      select k, value as name from named union all select f.k, n.value as name from forms f join named n on n.k = f.k + 1 and n.batch = f.batch and contains(f.text, 'avec ' || n.value || ' ')""",
    "lexicon_counts": f"select 'given' as kind, count(distinct lower(r_name)) as names from region union all select 'family', count(distinct {_FAMILY}) from nation",
    "lexicon_names": f"""with {_PAIRED} select k, g as name from paired union all select k, g || ' ' || f from paired
      union all select k, 'cv_' || g || '_' || f from paired where not contains(g, ' ') and not contains(f, ' ')""",
    "lexicon_pairs": f"with {_PAIRED} select k, case when k % 2 = 0 then g else upper(f) end as a, case when k % 2 = 0 then f else (select string_agg(upper(w[1]) || w[2:], ' ') from (select unnest(string_split(g, ' ')) as w)) end as b from paired where k % 3 <> 0",
    "restored_documents": "select doc_id, text from documents",
}
