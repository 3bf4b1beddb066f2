"""Queries of the core over the driver's tables, each with SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from veilspan.functions import spans as S
from veilspan.operators import detect as D
from veilspan.operators import metrics as M
from veilspan.operators import policy as P
from veilspan.operators import tokens as T
from veilspan.operators import vault as V
from veilspan.operators.nested import json_leaves
from veilspan.sources.tables import spread, table

KEY = b"0123456789abcdef0123456789abcdef"  # a fixed key for these queries only
SEED = "20261005"


def _documents(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return table(spark, d, "documents", "doc_id", "text", *columns)


def _emails(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    rows = _documents(spark, d, *columns).where(F.col("text").contains("@"))
    return rows.withColumn("spans", D.emails(F.col("text")))


def email_values(spark: SparkSession, d: str) -> DataFrame:
    rows = _emails(spark, d)
    return rows.select("doc_id", F.explode(S.values(F.col("text"), F.col("spans"))).alias("value")).groupBy("doc_id", "value").agg(F.count("*").alias("n"))


def email_counts_by_lang(spark: SparkSession, d: str) -> DataFrame:
    return _emails(spark, d, "lang").groupBy("lang").agg(F.sum(F.size("spans")).alias("emails"), F.count_if(F.size("spans") > 0).alias("documents"))


def masked_emails(spark: SparkSession, d: str) -> DataFrame:
    rows = _emails(spark, d)
    return rows.where(F.size("spans") > 0).select("doc_id", S.replaced(F.col("text"), F.col("spans"), F.transform("spans", lambda s: F.lit("⟦EMAIL:REDACTED⟧"))).alias("text"))


def email_tokens(spark: SparkSession, d: str) -> DataFrame:
    inner, outer = T.pads(KEY)
    rows = email_values(spark, d).select("value").distinct()
    return rows.select("value", T.token(F.lit("email"), T.token_id(F.col("value"), F.lit(inner), F.lit(outer))).alias("token"))


def token_collisions(spark: SparkSession, d: str) -> DataFrame:
    """Ids cut to two digits, of which many stand for several values: the audit that a sound vault passes empty."""
    inner, outer = T.pads(KEY)
    short = T.token_id(F.col("value"), F.lit(inner), F.lit(outer), 2)
    return V.collisions(email_values(spark, d).select(F.lit("all").alias("session_id"), F.lit("email").alias("kind"), short.alias("token_id"), "value"))


def phone_values(spark: SparkSession, d: str) -> DataFrame:
    rows = spread(_documents(spark, d).where(F.col("text").isNotNull()))
    return rows.select("doc_id", F.explode(S.values(F.col("text"), D.phones(F.col("text")))).alias("value")).groupBy("doc_id", "value").agg(F.count("*").alias("n"))


def masked_documents(spark: SparkSession, d: str) -> DataFrame:
    """Every document with its findings masked, and their number by kind."""
    rows = spread(_documents(spark, d, "origin")).withColumn("session", F.coalesce("origin", F.lit("none")))
    items = V.with_tokens(D.with_spans(rows), V.session_pads(F.col("session"), KEY), "session")
    return V.protected(items).select("doc_id", "text", "counts")


def response_findings(spark: SparkSession, d: str) -> DataFrame:
    """Addresses and formatted numbers in the string leaves of tool responses by tool and kind, by the whole detector."""
    events = table(spark, d, "tool_events", "event_id", "tool_name", "tool_response").dropDuplicates(["event_id"])
    leaves = json_leaves(events.select(F.struct("event_id", "tool_name").alias("k"), "tool_response"), "k", "tool_response")
    found = D.with_spans(leaves).select(F.col("k.tool_name").alias("tool_name"), F.explode("spans").alias("s")).where(F.col("s.kind").isin(*RESPONSE_KINDS))
    return found.groupBy("tool_name", F.col("s.kind").alias("kind")).agg(F.count("*").alias("n"))


RESPONSE_KINDS = ("email", "private_key", "aws_access_key", "fr_license_plate", "fr_passport")


def leaf_counts(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "tool_events", "event_id", "tool_name", "tool_input").dropDuplicates(["event_id"])
    leaves = json_leaves(events.select(F.struct("event_id", "tool_name").alias("k"), "tool_input"), "k", "tool_input")
    return leaves.groupBy(F.col("k.tool_name").alias("tool_name")).agg(F.count("*").alias("leaves"), F.sum(F.length("text")).alias("characters"))


def document_reads(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "tool_events", "event_id", "tool_name", "tool_input", "tool_response").dropDuplicates(["event_id"])
    reads = P.document_read(F.col("tool_name"), F.col("tool_input"), F.lit(None).cast("string"))
    return events.groupBy("tool_name").agg(F.count("*").alias("events"), F.count_if(reads).alias("reads"))


def restorable_paths(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "tool_events", "event_id", "tool_input").dropDuplicates(["event_id"])
    path = F.get_json_object("tool_input", "$.file_path")
    return events.select("event_id", path.alias("path")).where("path is not null").select("event_id", P.basename(F.col("path")).alias("name"), P.restorable(F.col("path")).alias("restorable"))


def refused_writes(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "tool_events", "event_id", "tool_name", "tool_input").dropDuplicates(["event_id"]).where(F.col("tool_name").isin("Write", "Edit"))
    content = F.coalesce(F.get_json_object("tool_input", "$.content"), F.get_json_object("tool_input", "$.new_string"))
    return events.where(P.refused_write(content)).select("event_id", "tool_name")


def length_bands(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "quality", "dataset", "text").select("dataset", M.length_band(F.length("text")).alias("band"))
    return rows.groupBy("dataset", "band").agg(F.count("*").alias("records"))


def latency_by_model(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "timing", "obs_id", "model", "elapsed_ms").dropDuplicates(["obs_id"]).where("elapsed_ms >= 0")
    out = M.latency(rows, "elapsed_ms", ["model"])
    return out.select("model", "n", F.round("p50", 6).alias("p50"), "p95", F.round("mean", 6).alias("mean"))


def eligible_models(spark: SparkSession, d: str) -> DataFrame:
    return P.eligible(table(spark, d, "models"), ["MIT", "Apache-2.0"]).select("model", "licence")


def uncovered_keys(spark: SparkSession, d: str) -> DataFrame:
    """Gold records that no observation names (calibration is not timed), and observed ids that are no gold record."""
    records = table(spark, d, "quality", "id").unionByName(table(spark, d, "calibration", "id"))
    return M.key_coverage(records, table(spark, d, "timing", "id"), "id")


def hash_sample(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "quality", "id", "dataset").distinct()
    return M.hash_sample(rows, "id", 100, SEED, "calibration").select("id", "dataset")


def hash_tenths(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "quality", "id").distinct().select(M.tenth(F.col("id")).alias("tenth"))
    return rows.groupBy("tenth").agg(F.count("*").alias("records"))


def record_audit(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "quality", "id", "dataset", "text", "spans").dropDuplicates(["id"])
    return M.audit(rows, ["dataset"])


def unseen_records(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "quality", "id", "text").dropDuplicates(["id"])
    return M.unseen(rows, table(spark, d, "calibration", "text"), "id").select("id")


def _scored(spark: SparkSession, d: str) -> DataFrame:
    """Records with predictions drawn from their gold spans: those of a label, the end of long ones cut."""
    rows = table(spark, d, "quality", "id", "dataset", "text", "spans").dropDuplicates(["id"]).where("spans is not null")
    clean = F.filter("spans", lambda s: (s["start"] >= 0) & (s["end"] > s["start"]) & (s["end"] <= F.length("text")))
    gold = F.transform(clean, lambda s: S.span(s["kind"], s["start"], s["end"]))
    cut = F.transform(F.filter(clean, lambda s: s["source_label"].isNotNull()), lambda s: S.span(s["kind"], s["start"], F.when(s["end"] - s["start"] > 20, s["end"] - 3).otherwise(s["end"])))
    return rows.select("id", "dataset", "text", gold.alias("gold"), cut.alias("predicted"))


def exact_span_metrics(spark: SparkSession, d: str) -> DataFrame:
    out = M.exact_metrics(_scored(spark, d), groups=["dataset"])
    return out.select("dataset", "gold", "predicted", "exact", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")))


def span_character_metrics(spark: SparkSession, d: str) -> DataFrame:
    out = M.exact_metrics(_scored(spark, d), groups=["dataset"])
    return out.select("dataset", "covered", "gold_chars", "predicted_chars", "shared_chars", "negatives", *(F.round(c, 9).alias(c) for c in ("full_coverage", "char_precision", "char_recall", "negative_rate")))


def masking_f2(spark: SparkSession, d: str) -> DataFrame:
    out = M.masking_scores(_scored(spark, d), "gold", "predicted", "dataset")
    return out.select("dataset", "hit", "true", "masked", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f2")))


def interval_hits(spark: SparkSession, d: str) -> DataFrame:
    """Gold spans that some prediction of their kind touches, by kind."""
    rows = _scored(spark, d)
    gold = rows.select("id", F.explode("gold").alias("s")).select("id", "s.*")
    predicted = rows.select("id", F.explode("predicted").alias("s")).select("id", "s.*")
    return M.touched(gold, predicted, ["id", "kind"]).groupBy("kind").agg(F.count("*").alias("hidden"))


def miss_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Gold spans by label as complete, partial or missed."""
    rows = _scored(spark, d).join(table(spark, d, "quality", "id", "spans").dropDuplicates(["id"]), "id")
    gold = rows.select("id", F.explode("spans").alias("s")).select("id", "s.kind", "s.start", "s.end", "s.source_label").where("start >= 0 and end > start")
    gold = gold.join(rows.select("id", F.length("text").alias("n")), "id").where("end <= n").drop("n").distinct()
    predicted = rows.select("id", F.explode("predicted").alias("s")).select("id", "s.*").distinct()
    return M.misses(gold, predicted, rows.select("id", "text"), "id")


def merged_spans(spark: SparkSession, d: str) -> DataFrame:
    rows = _scored(spark, d)
    return rows.where(F.size("gold") > 0).select("id", F.size(S.merged(F.col("gold"))).alias("islands"), S.total_length(S.merged(F.col("gold"))).alias("characters"))


def bootstrap_f1(spark: SparkSession, d: str) -> DataFrame:
    rows = _scored(spark, d)
    counts = rows.select(F.col("dataset").alias("model"), "id", F.size(F.array_intersect("gold", "predicted")).alias("exact"), F.size("gold").alias("gold"), F.size("predicted").alias("predicted"))
    return M.bootstrap(counts, "id")


def word_window_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = _documents(spark, d).where("text is not null")
    return rows.select("doc_id", F.size(M.word_windows(F.col("text"))).alias("windows"))


def newest_sessions(spark: SparkSession, d: str) -> DataFrame:
    """The 128 sessions with the latest events: what a bounded queue keeps."""
    rows = table(spark, d, "tool_events", "session_id", "received_at").groupBy("session_id").agg(F.max("received_at").alias("last"))
    return rows.orderBy(F.desc("last"), "session_id").limit(128)


def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Events of a user grouped while no gap reaches 30 minutes."""
    rows = table(spark, d, "events", "event_id", "user_id", "ts")
    grouped = rows.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("events"))
    return grouped.select("user_id", F.col("w.start").alias("start"), "events")


def repeated_texts(spark: SparkSession, d: str) -> DataFrame:
    """What a cache keyed by the digest of a text would answer: documents, distinct texts, repeated reads, by language."""
    rows = _documents(spark, d, "lang").where("text is not null").select("lang", F.sha2("text", 256).alias("h"))
    return rows.groupBy("lang").agg(F.count("*").alias("documents"), F.count_distinct("h").alias("texts"))


def redelivered_events(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "tool_events", "event_id", "received_at")
    w = Window.partitionBy("event_id").orderBy("received_at")
    return rows.withColumn("n", F.row_number().over(w)).where("n > 1").select("event_id", "n")


QUERIES = {
    f.__name__: f
    for f in (
        masked_documents, email_values, email_counts_by_lang, masked_emails, email_tokens, token_collisions, phone_values, response_findings, leaf_counts, document_reads, restorable_paths, refused_writes, length_bands, latency_by_model, eligible_models, uncovered_keys, hash_sample, hash_tenths,
        record_audit, unseen_records, exact_span_metrics, span_character_metrics, masking_f2, interval_hits, miss_outcomes, merged_spans, bootstrap_f1, word_window_counts, newest_sessions, event_sessions,
        repeated_texts, redelivered_events,
    )
}

# --- SQL ---------------------------------------------------------------------------------------------------------------
# RE2 has no look-around: the guard before a match is consumed in a group, and blanks are doubled so that no two
# matches need the same one.
_RE_EMAIL = r"(?:^|[^\pL\pN_.%+-])([A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})(?:$|[^\pL\pN_])"
_WIDE = r"regexp_replace(text, '(\s|[,;|<>])', '\1\1', 'g')"
_EMAILS = f"select doc_id, lang, unnest(regexp_extract_all({_WIDE}, '{_RE_EMAIL}', 1)) as value from documents where text like '%@%'"
_INNER, _OUTER = T.pads(KEY)
_HMAC = f"upper(substr(sha256(unhex('{_OUTER}') || unhex(sha256(unhex('{_INNER}') || encode(value)))), 1, 8))"
_RE_PHONE = r"(?:^|[^\pL\pN_+.,]|[^0-9][.,])(\+\d{1,3}(?:[ .-]?\d){6,14}|0[1-9](?:[ .-]?\d{2}){4}|(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4})(?:$|[^\pL\pN_.,]|[.,](?:$|[^0-9]))"
_SUFFIXES = "|".join(P.DOCUMENT_SUFFIXES)
_QUOTED = ", ".join(f"'{s}'" for s in P.DOCUMENT_SUFFIXES)
_EVENTS = "(select * from tool_events qualify row_number() over (partition by event_id order by received_at) = 1)"
_QUALITY = "(select * from quality qualify row_number() over (partition by id order by ingested_at) = 1)"
_GOLD = f"""gold as (select distinct q.id, q.dataset, s.kind as kind, s.start as start, s."end" as stop, s.source_label as label
  from {_QUALITY} q, unnest(q.spans) as u(s) where s.start >= 0 and s."end" > s.start and s."end" <= length(q.text)),
predicted as (select distinct id, dataset, kind, start, case when stop - start > 20 then stop - 3 else stop end as stop from gold where label is not null),
g as (select distinct id, dataset, kind, start, stop from gold),
sets as (select distinct dataset from quality where spans is not null)"""
_PLACES = f"""texts as (select id, text from {_QUALITY}),
gp as (select distinct x.id, x.dataset, x.kind, x.i from (select id, dataset, kind, unnest(range(start, stop)) as i from g) x join texts t on t.id = x.id where not regexp_matches(substr(t.text, cast(x.i + 1 as bigint), 1), '[\\s\\x{{00A0}}\\x{{2000}}-\\x{{200A}}\\x{{202F}}\\x{{3000}}]')),
pp as (select distinct x.id, x.dataset, x.kind, x.i from (select id, dataset, kind, unnest(range(start, stop)) as i from predicted) x join texts t on t.id = x.id where not regexp_matches(substr(t.text, cast(x.i + 1 as bigint), 1), '[\\s\\x{{00A0}}\\x{{2000}}-\\x{{200A}}\\x{{202F}}\\x{{3000}}]'))"""
_ISLANDS = """(select id, dataset, start, stop, sum(fresh) over (partition by id order by start, stop desc) as island from
  (select *, case when start <= max(stop) over (partition by id order by start, stop desc rows between unbounded preceding and 1 preceding) then 0 else 1 end as fresh from {0}))"""

SQL = {
    "email_values": f"select doc_id, value, count(*) as n from ({_EMAILS}) group by doc_id, value",
    "email_counts_by_lang": f"""select d.lang, cast(coalesce(sum(n), 0) as bigint) as emails, count(n) as documents from documents d
      left join (select doc_id, count(*) as n from ({_EMAILS}) group by doc_id) e on d.doc_id = e.doc_id where d.text like '%@%' group by d.lang""",
    "email_tokens": f"select distinct value, '⟦EMAIL:' || {_HMAC} || '⟧' as token from ({_EMAILS})",
    "token_collisions": f"""select 'all' as session_id, 'email' as kind, token_id, count(distinct value) as "values"
      from (select value, substr({_HMAC}, 1, 2) as token_id from ({_EMAILS})) group by token_id having count(distinct value) > 1""",
    "masked_emails": rf"""select doc_id, masked as text from (select doc_id, text, regexp_replace(text, '(^|[^\pL\pN_.%+-])([A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{{2,}})', '\1⟦EMAIL:REDACTED⟧', 'g') as masked
      from documents where text like '%@%') where masked <> text""",
    "phone_values": rf"""select doc_id, value, count(*) as n from (select doc_id, unnest(regexp_extract_all(text, '{_RE_PHONE}', 1)) as value from documents where text is not null) group by doc_id, value""",
    "document_reads": f"""select tool_name, count(*) as events, count_if(case when tool_name = 'Read' then regexp_matches(coalesce(json_extract_string(i, '$.file_path'), ''), '(?i)\\.({_SUFFIXES})$')
        when tool_name in ('Bash', 'PowerShell') then regexp_matches(coalesce(json_extract_string(i, '$.command'), ''), '(?i)\\.({_SUFFIXES})\\b')
        when tool_name = 'Grep' then regexp_matches(coalesce(json_extract_string(i, '$.path'), ''), '(?i)\\.({_SUFFIXES})\\b') or regexp_matches(coalesce(json_extract_string(i, '$.glob'), ''), '(?i)\\.({_SUFFIXES})\\b')
          or coalesce(json_extract_string(i, '$.type'), '') in ({_QUOTED})
        else starts_with(coalesce(tool_name, ''), 'mcp__') end) as reads
      from (select tool_name, case when json_valid(tool_input) then tool_input end as i from {_EVENTS}) group by tool_name""",
    "leaf_counts": f"""select tool_name, count(*) as leaves, cast(sum(length(t.atom ->> '$')) as bigint) as characters
      from {_EVENTS} e, json_tree(e.tool_input) as t where t.type = 'VARCHAR' and json_valid(e.tool_input) group by tool_name""",
    "response_findings": rf"""with raw as (select tool_name, t.atom ->> '$' as t from {_EVENTS} e, json_tree(e.tool_response) as t where t.type = 'VARCHAR' and json_valid(e.tool_response)),
      leaves as (select tool_name, regexp_replace(t, '([a-z][a-z0-9+.-]*://[^\s:/@]*:)[^\s/@⟦⟧$]{{3,}}@', '\1 ', 'g') as text from raw),
      found as (select tool_name, unnest(list_concat([{{'kind': 'email', 'v': v}} for v in regexp_extract_all({_WIDE}, '{_RE_EMAIL}', 1)],
        [{{'kind': 'private_key', 'v': v}} for v in regexp_extract_all(text, '-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----[\s\S]*?-----END (?:[A-Z0-9]+ )*PRIVATE KEY-----')],
        [{{'kind': 'aws_access_key', 'v': v}} for v in regexp_extract_all(text, '\b(?:AKIA|ASIA)[0-9A-Z]{{16}}\b')],
        [{{'kind': 'fr_license_plate', 'v': v}} for v in regexp_extract_all(text, '\b[A-HJ-NP-TV-Z]{{2}}[- ]\d{{3}}[- ][A-HJ-NP-TV-Z]{{2}}\b')],
        [{{'kind': 'fr_passport', 'v': v}} for v in regexp_extract_all(text, '\b\d{{2}}[A-Z]{{2}}\d{{5}}\b')])) as x from leaves)
      select tool_name, x.kind as kind, count(*) as n from found group by all""",
    "restorable_paths": rf"""select event_id, name, regexp_matches(lower(name), '^\.env($|\.)|.\.({'|'.join(P.RESTORABLE_SUFFIXES)})$') as restorable
      from (select event_id, regexp_extract(json_extract_string(tool_input, '$.file_path'), '[^/\\]*$') as name from {_EVENTS} where json_valid(tool_input)) where name is not null""",
    "refused_writes": f"""select event_id, tool_name from {_EVENTS} where tool_name in ('Write', 'Edit') and json_valid(tool_input)
      and contains(coalesce(json_extract_string(tool_input, '$.content'), json_extract_string(tool_input, '$.new_string'), ''), ':REDACTED⟧')""",
    "length_bands": "select dataset, case when length(text) < 128 then 'short_lt128' when length(text) < 512 then 'medium_128_511' when text is not null then 'long_ge512' end as band, count(*) as records from quality group by all",
    "latency_by_model": """select model, count(*) as n, round(quantile_cont(elapsed_ms, 0.5), 6) as p50, quantile_disc(elapsed_ms, 0.95) as p95, round(avg(elapsed_ms), 6) as mean
      from (select * from timing qualify row_number() over (partition by obs_id order by recorded_at) = 1) where elapsed_ms >= 0 and isfinite(elapsed_ms) group by model""",
    "eligible_models": "select model, licence from models where active and licence in ('MIT', 'Apache-2.0')",
    "uncovered_keys": """with r as (select id from quality union select id from calibration), t as (select distinct id from timing)
      select id, 'prediction' as missing from r where id not in (select id from t where id is not null) union all select id, 'record' from t where id not in (select id from r where id is not null)""",
    "hash_sample": f"select id, dataset from (select distinct id, dataset from quality) order by sha256('{SEED}:calibration:' || id), id limit 100",
    "hash_tenths": """select cast(tenth as int) as tenth, count(*) as records from (select list_reduce(list_prepend(0, list_transform(range(1, 65), lambda i: cast(('0x' || substr(h, i, 1)) as int))), lambda a, d: (a * 16 + d) % 10) as tenth
      from (select distinct id, sha256(id) as h from quality)) group by tenth""",
    "record_audit": f"""select dataset, cast(sum(n) as bigint) as records, cast(sum(e) as bigint) as entities, cast(sum(n - 1) as bigint) as duplicates, count_if(n > 1 and variants > 1) as conflicts
      from (select dataset, text, count(*) as n, sum(coalesce(len(spans), 0)) as e, count(distinct coalesce(cast(spans as varchar), 'null')) as variants from {_QUALITY} group by dataset, text) group by dataset""",
    "unseen_records": f"select min(id) as id from {_QUALITY} where text not in (select text from calibration where text is not null) group by text",
    "exact_span_metrics": f"""with {_GOLD}, a as (select dataset, count(*) as gold from g group by dataset), b as (select dataset, count(*) as predicted from predicted group by dataset),
      c as (select dataset, count(*) as exact from (select * from g intersect select * from predicted) group by dataset),
      j as (select s.dataset, coalesce(gold, 0) as gold, coalesce(predicted, 0) as predicted, coalesce(exact, 0) as exact from sets s left join a using (dataset) left join b using (dataset) left join c using (dataset))
      select dataset, gold, predicted, exact, round(exact / nullif(predicted, 0), 9) as precision, round(exact / nullif(gold, 0), 9) as recall, round(2.0 * exact / nullif(gold + predicted, 0), 9) as f1 from j""",
    "span_character_metrics": f"""with {_GOLD}, {_PLACES},
      a as (select dataset, count(*) as gold_chars from gp group by dataset), b as (select dataset, count(*) as predicted_chars from pp group by dataset),
      c as (select gp.dataset, count(*) as shared_chars from gp join pp using (id, kind, i) group by gp.dataset),
      n as (select dataset, count(*) as gold from g group by dataset),
      v as (select dataset, count(*) as covered from g where not exists (select 1 from gp where gp.id = g.id and gp.kind = g.kind and gp.i >= g.start and gp.i < g.stop and not exists (select 1 from pp where pp.id = gp.id and pp.kind = gp.kind and pp.i = gp.i)) group by dataset),
      m as (select dataset, count(*) as negatives from {_QUALITY} where spans is not null and id not in (select id from g) group by dataset)
      select s.dataset, coalesce(covered, 0) as covered, coalesce(gold_chars, 0) as gold_chars, coalesce(predicted_chars, 0) as predicted_chars, coalesce(shared_chars, 0) as shared_chars, coalesce(negatives, 0) as negatives,
        round(coalesce(covered, 0) / nullif(gold, 0), 9) as full_coverage, round(coalesce(shared_chars, 0) / nullif(predicted_chars, 0), 9) as char_precision, round(coalesce(shared_chars, 0) / nullif(gold_chars, 0), 9) as char_recall,
        case when coalesce(negatives, 0) > 0 then 0.0 end as negative_rate
      from sets s left join a using (dataset) left join b using (dataset) left join c using (dataset) left join n using (dataset) left join v using (dataset) left join m using (dataset)""",
    "miss_outcomes": f"""with {_GOLD}, {_PLACES}, w as (select row_number() over () as k, * from gold),
      o as (select k, label, count(i) as want, count(case when exists (select 1 from pp where pp.id = x.id and pp.kind = x.kind and pp.i = x.i) then 1 end) as have
        from (select w.k, w.label, w.id, w.kind, t.i from w left join (select distinct id, kind, i from gp) t on t.id = w.id and t.kind = w.kind and t.i >= w.start and t.i < w.stop) x group by k, label)
      select label as source_label, case when have = 0 then 'missed' when have = want then 'complete' else 'partial' end as outcome, count(*) as spans from o group by all""",
    "interval_hits": f"with {_GOLD} select kind, count(*) as hidden from g where exists (select 1 from predicted p where p.id = g.id and p.kind = g.kind and g.start < p.stop and p.start < g.stop) group by kind",
    "merged_spans": f"""with {_GOLD} select id, cast(count(*) as int) as islands, cast(sum(stop - start) as int) as characters
      from (select id, island, min(start) as start, max(stop) as stop from {_ISLANDS.format('g')} group by id, island) group by id""",
    "masking_f2": f"""with {_GOLD}, t as (select id, dataset, min(start) as a, max(stop) as b from {_ISLANDS.format('g')} group by id, dataset, island),
      m as (select id, dataset, min(start) as a, max(stop) as b from {_ISLANDS.format('predicted')} group by id, dataset, island),
      h as (select t.dataset, sum(greatest(0, least(t.b, m.b) - greatest(t.a, m.a))) as hit from t join m on t.id = m.id group by t.dataset),
      j as (select s.dataset, coalesce(hit, 0) as hit, coalesce((select sum(b - a) from t where t.dataset = s.dataset), 0) as "true", coalesce((select sum(b - a) from m where m.dataset = s.dataset), 0) as masked from sets s left join h using (dataset)),
      r as (select *, coalesce(hit / nullif(masked, 0), 0.0) as p, coalesce(hit / nullif("true", 0), 0.0) as q from j)
      select dataset, cast(hit as bigint) as hit, cast("true" as bigint) as "true", cast(masked as bigint) as masked, round(p, 9) as precision, round(q, 9) as recall, round(coalesce(5 * p * q / nullif(4 * p + q, 0), 0.0), 9) as f2 from r""",
    "word_window_counts": r"""select doc_id, cast(case when n <= 41 then 1 else floor((n - 41) / 160) + 1 end as int) as windows
      from (select doc_id, len(list_filter(regexp_split_to_array(text, '[\s\x{000B}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+'), lambda w: w <> '')) as n from documents where text is not null)""",
    "newest_sessions": "select session_id, max(received_at) as last from tool_events group by session_id order by last desc, session_id limit 128",
    "event_sessions": """select user_id, min(ts) as start, count(*) as events from (select user_id, ts, sum(fresh) over (partition by user_id order by ts, event_id rows unbounded preceding) as s from
      (select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval 30 minute then 0 else 1 end as fresh from events)) group by user_id, s""",
    "repeated_texts": "select lang, count(*) as documents, count(distinct text) as texts from documents where text is not null group by lang",
    "redelivered_events": "select event_id, cast(n as int) as n from (select event_id, row_number() over (partition by event_id order by received_at) as n from tool_events) where n > 1",
}
