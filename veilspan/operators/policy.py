"""What happens to a finding, how it is summed up, and which documents and paths are in scope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.operators.rules import SECRET_KINDS

# Kinds, their modes and their categories in summaries and in the quality benchmark.
PSEUDONYMIZED = tuple("person_name email phone postal_address fr_postal_address birth_date payment_card iban fr_social_security_number fr_tax_number fr_passport fr_license_plate fr_siret fr_siren fr_identity_card fr_driving_licence".split())
REDACTED = (*SECRET_KINDS, "card_security_code")
IDENTIFIERS = frozenset("fr_social_security_number fr_tax_number fr_passport fr_license_plate fr_siret fr_siren fr_identity_card fr_driving_licence".split())
OWN_CATEGORY = frozenset("person_name email phone birth_date".split())
DOCUMENT_SUFFIXES = tuple("txt md markdown rst csv tsv rtf html htm eml msg pdf doc docx odt log output sql xlsx xlsm xls ods".split())
RESTORABLE_SUFFIXES = tuple(
    "txt md markdown rst csv py pyi js jsx mjs cjs ts tsx java kt kts cs go rs rb php swift scala c h cc cpp hpp r lua pl dart vue svelte sql sh bash zsh ps1 psm1 bat cmd html htm css scss json jsonc yaml yml toml ini cfg conf properties env xml".split()
)


def redacts(kind: str) -> bool:
    """Whether a kind is redacted for good; kinds that are not known are."""
    return kind not in PSEUDONYMIZED


def summary_category(kind: str) -> str:
    if kind in SECRET_KINDS or kind == "card_security_code":
        return "secret"
    if kind in ("postal_address", "fr_postal_address"):
        return "address"
    if kind in ("payment_card", "iban"):
        return "banking"
    return kind if kind in OWN_CATEGORY else "identifier" if kind in IDENTIFIERS else "other"


def benchmark_category(kind: str) -> str:
    if kind == "card_security_code":
        return "banking"
    return {"person_name": "name"}.get(kind, summary_category(kind))


def kinds(spark: SparkSession) -> DataFrame:
    """The dimension of kinds: ``kind``, ``mode``, ``summary_category``, ``benchmark_category`` (some 25 rows)."""
    rows = [(k, "redact" if redacts(k) else "pseudonymize", summary_category(k), benchmark_category(k)) for k in (*PSEUDONYMIZED, *REDACTED)]
    return spark.createDataFrame(rows, "kind string, mode string, summary_category string, benchmark_category string")


def _mapped(kind: Column, values: dict[str, str], other: str) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for pair in values.items() for x in pair))[kind], F.lit(other))


def mode(kind: Column) -> Column:
    """``redact`` or ``pseudonymize``; ``redact`` for kinds that are not known."""
    return F.when(kind.isin(*PSEUDONYMIZED), "pseudonymize").otherwise("redact")


def category(kind: Column) -> Column:
    return _mapped(kind, {k: summary_category(k) for k in (*PSEUDONYMIZED, *REDACTED)}, "other")


def basename(path: Column, longest: int = 120) -> Column:
    """The last part of a path of either system, without control and format characters, at most ``longest`` long."""
    last = F.element_at(F.split(F.regexp_replace(path, r"[/\\]+$", ""), r"[/\\]"), -1)
    clean = F.regexp_replace(last, r"[\p{Cc}\p{Cf}\p{Cs}]", "")
    return F.when(F.length(clean) > longest, F.concat(F.substring(clean, 1, longest - 1), F.lit("…"))).otherwise(clean)


def restorable(path: Column) -> Column:
    """Whether a file of this name gets its values back: by suffix, or as ``.env`` and ``.env.*``."""
    name = F.lower(F.element_at(F.split(path, r"[/\\]"), -1))
    return name.rlike(rf"^\.env($|\.)|.\.(?:{'|'.join(RESTORABLE_SUFFIXES)})$")


def document_read(tool: Column, tool_input: Column, response: Column) -> Column:
    """Whether a tool event reads a document: by suffix, command, search target or line heads, or a foreign record."""
    suffixes = "|".join(DOCUMENT_SUFFIXES)
    named, headed = rf"(?i)\.(?:{suffixes})\b", rf"(?im)^(?:[A-Za-z]:)?[^\n:]*\.(?:{suffixes})[:-]"
    get = lambda path: F.coalesce(F.get_json_object(tool_input, f"$.{path}"), F.lit(""))
    search = get("path").rlike(named) | get("glob").rlike(named) | get("type").isin(*DOCUMENT_SUFFIXES) | F.coalesce(F.get_json_object(response, "$.content"), F.lit("")).rlike(headed)
    return (
        F.when(tool == "Read", get("file_path").rlike(rf"(?i)\.(?:{suffixes})$")).when(tool.isin("Bash", "PowerShell"), get("command").rlike(named))
        .when(tool == "Grep", search).otherwise(F.coalesce(tool, F.lit("")).startswith("mcp__"))
    )


def refused_write(content: Column) -> Column:
    """New content that holds a redaction would lose the value for good."""
    return F.coalesce(content, F.lit("")).contains(":REDACTED⟧")


def refused_edit(path: Column, strings: Column, placeholder: str) -> Column:
    """An edit whose old or new strings hold a placeholder, on a path whose values are restored."""
    return restorable(path) & F.exists(strings, lambda s: s.rlike(placeholder))


def allowed(value: Column, among: list[str], fallback: str) -> Column:
    return F.when(value.isin(among), value).otherwise(F.lit(fallback))


def eligible(datasets: DataFrame, licences: list[str]) -> DataFrame:
    """Active data with a licence of the list, and commercial use where the table says so."""
    rows = datasets.where(F.col("active") & F.col("licence").isin(licences))
    return rows.where("commercial") if "commercial" in datasets.columns else rows
