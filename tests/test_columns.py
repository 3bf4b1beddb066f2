"""Span algebra, validators and protection as columns, against the Python versions."""

from __future__ import annotations

import hashlib
import hmac
import random

import duckdb
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veilspan.functions import spans as S
from veilspan.functions import validators as check
from veilspan.operators import detect as D
from veilspan.operators import metrics as M
from veilspan.operators import policy as P
from veilspan.operators import tokens as T
from veilspan.operators import vault as V
from veilspan.operators.nested import map_strings
from veilspan.operators.rules import Span, drop_touching, settle
from veilspan.plans import form_queries as Q

KEY = b"k" * 32


def _spans(n: int, seed: int) -> list[Span]:
    r = random.Random(seed)
    out = []
    for _ in range(n):
        a = r.randrange(40)
        out.append(Span(r.choice("abc"), a, a + r.randrange(1, 12)))
    return out


def test_algebra_against_python(spark) -> None:
    rows = [(i, [tuple(s) for s in _spans(i % 9, i)], [tuple(s) for s in _spans(i % 4, 1000 + i)]) for i in range(60)]
    frame = spark.createDataFrame(rows, f"i int, a {S.SPANS}, b {S.SPANS}")
    out = frame.select("i", "a", "b", S.without_overlaps(F.col("a")).alias("w"), S.excluding(F.col("a"), F.col("b")).alias("x"), S.merged(F.col("a")).alias("m"), S.common_length(F.col("a"), F.col("b")).alias("c"), S.total_length(S.merged(F.col("a"))).alias("t"))
    for r in out.collect():
        a, b = [Span(*s) for s in r["a"]], [Span(*s) for s in r["b"]]
        assert [tuple(s) for s in r["w"]] == [tuple(s) for s in settle(a)]
        assert [tuple(s) for s in r["x"]] == [tuple(s) for s in drop_touching(a, b)]
        assert r["c"] == sum(max(0, min(s.end, t.end) - max(s.start, t.start)) for s in a for t in b)
        assert r["t"] == len({i for s in a for i in range(s.start, s.end)})


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="aé😀 @.xy-1", max_size=25), min_size=1, max_size=8))
def test_offsets_of_matches(spark, texts: list[str]) -> None:
    import re

    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for r in frame.select("t", S.matches(F.col("t"), r"[\w]+@[\w]+", "m").alias("m")).collect():
        assert [(s["start"], s["end"]) for s in r["m"]] == [m.span() for m in re.finditer(r"\w+@\w+", r["t"])]


def test_native_rules_agree(spark) -> None:
    from veilspan.operators.rules import personal_data

    texts = ["a.b@c.example, x@y.fr!", "06 12 34 56 78 +33 6 12 34 56 78 415-555-0132", "4111 1111 1111 1111 4111111111111112", "", "😀 é@b.co é"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    out = frame.select("t", S.union(D.emails(F.col("t")), D.phones(F.col("t")), D.cards(F.col("t"))).alias("s")).collect()
    for r in out:
        assert sorted(tuple(s) for s in r["s"]) == sorted(tuple(s) for s in personal_data(r["t"]))


def test_validator_columns(spark) -> None:
    values = ["4111 1111 1111 1111", "4111111111111112", "FR7630006000011234567890189", "FR7730006000011234567890189", "255081416802538", "0000000000000", "", "abc"]
    frame = spark.createDataFrame([(v,) for v in values], "v string")
    v = F.col("v")
    out = frame.select("v", check.payment_card(v).alias("card"), check.iban(v).alias("iban"), check.nir(v).alias("nir"), check.french_tax_number(v).alias("tax")).collect()
    assert [r["card"] for r in out] == [True] + [False] * 7
    assert [r["iban"] for r in out] == [False, False, True] + [False] * 5
    assert [r["nir"] for r in out] == [False] * 4 + [True] + [False] * 3
    assert [r["tax"] for r in out] == [False] * 5 + [True] + [False] * 2


def test_protect_and_restore(spark) -> None:
    texts = [(1, "s1", "Nom : Jean Dupont, a@b.example"), (2, "s1", "Jean Dupont encore, CVV 123"), (3, "s2", "a@b.example"), (4, "s1", None), (5, None, "a@b.example"), (6, "s1", "")]
    frame = spark.createDataFrame(texts, "id int, session string, text string")
    found = D.find_many(frame, "session")
    assert [r["spans"][0]["kind"] for r in found.where("id = 2").collect()] == ["person_name"]
    keys = V.session_keys(frame, "session", KEY)
    items = V.with_tokens(found, keys, "session")
    masked = {r["id"]: r for r in V.protected(items).collect()}
    assert "Dupont" not in masked[2]["text"] and ":REDACTED⟧" in masked[2]["text"] and masked[2]["counts"]["card_security_code"] == 1
    assert masked[4]["text"] is None and masked[6]["text"] == "" and masked[5]["text"] == "⟦EMAIL:REDACTED⟧"
    vault = V.vault_rows(items, "session")
    assert V.collisions(vault).count() == 0
    assert V.appended(vault, vault).count() == 0
    plain = spark.createDataFrame([(r["id"], r["session"], r["text"]) for r in masked.values()], "id int, session string, text string")
    back = {r["id"]: r["text"] for r in V.restored(plain, vault, "id", "session").collect()}
    assert back[1] == texts[0][2] and back[3] == "a@b.example"
    assert back[2].startswith("Jean Dupont encore") and ":REDACTED⟧" in back[2]
    token = masked[1]["text"].split("⟦EMAIL:")[1][:8]
    odd = spark.createDataFrame([(1, "s1", f"⟦PHONE:{token}⟧"), (2, "s2", masked[1]["text"]), (3, "s1", "⟦EMAIL:00000000⟧")], "id int, session string, text string")
    kept = {r["id"]: r["text"] for r in V.restored(odd, vault, "id", "session").collect()}
    assert kept[1] == f"⟦PHONE:{token}⟧" and kept[2] == masked[1]["text"] and kept[3] == "⟦EMAIL:00000000⟧"
    assert {(r["action"], r["category"], r["occurrences"]) for r in V.summary(items.where("id < 3")).collect()} == {("pseudonymized", "person_name", 2), ("pseudonymized", "email", 1), ("redacted", "secret", 1)}
    assert V.decrypted(V.encrypted(vault, F.lit("0" * 32)), F.lit("0" * 32)).exceptAll(vault).count() == 0


def test_clashing_tokens_stay(spark) -> None:
    vault = spark.createDataFrame([("s", "email", "00000001", "a@b.example"), ("s", "email", "00000001", "c@d.example"), ("s", "email", "00000002", "e@f.example")], "session_id string, kind string, token_id string, value string")
    masked = spark.createDataFrame([(1, "s", "⟦EMAIL:00000001⟧, ⟦EMAIL:00000002⟧")], "id int, session string, text string")
    assert V.restored(masked, vault, "id", "session").first()["text"] == "⟦EMAIL:00000001⟧, e@f.example"


def test_forms_whose_short_ids_clash(spark, tmp_path) -> None:
    inner = hmac.new(Q.MASTER, b"0", hashlib.sha256).digest()
    seen: dict[str, int] = {}
    for k in range(0, 10**7, 10):  # licences of session 0 until two have one id of 8 digits
        other = seen.setdefault(hmac.new(inner, f"P{k:010d}".encode(), hashlib.sha256).hexdigest()[:8], k)
        if other != k:
            break
    spark.createDataFrame([(k,), (other,)], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    got = {tuple(r) for r in Q.restored_forms(spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"create view customer as select * from '{tmp_path}/customer.parquet/*.parquet'")
    assert len(got) == 2 and got == set(con.execute(Q.SQL["restored_forms"]).fetchall())


def test_names_of_large_batches(spark) -> None:
    rows = [("s", "Nom : Jean Dupont"), ("s", "Nom : Ann Lee-Roy"), ("s", "jean dupont et Ann Lee-Roy, puis Jean"), ("t", "Jean Dupont"), (None, "Nom : Bob Ray"), (None, "Bob Ray dort"), ("s", None), ("s", "jean dupont et Ann Lee-Roy, puis Jean")]
    frame = spark.createDataFrame(rows, "session string, text string")
    few, many = ([tuple(r) for r in D.find_many(frame, "session", most=n).select("session", "text", "spans").orderBy("session", "text").collect()] for n in (2000, 1))
    assert few == many and len(few) == 8
    assert {(r[1], len(r[2])) for r in few if r[1]} >= {("jean dupont et Ann Lee-Roy, puis Jean", 2), ("Jean Dupont", 0), ("Bob Ray dort", 1)}


def test_paths(spark) -> None:
    frame = spark.createDataFrame([("s", "a@b.example")], "session string, text string")
    vault = V.vault_rows(V.with_tokens(D.with_spans(frame), V.session_keys(frame, "session", KEY), "session"), "session")
    token = "⟦EMAIL:" + vault.first()["token_id"] + "⟧"
    events = spark.createDataFrame([(1, "s", "Read", f'{{"file_path": "/x/{token}.txt"}}'), (2, "s", "Bash", f'{{"command": "cat {token}"}}'), (3, "t", "Glob", f'{{"path": "{token}"}}'), (4, "s", "Read", None)], "event_id int, session string, tool_name string, tool_input string")
    assert {tuple(r) for r in V.restored_paths(events, vault, "event_id", "session").collect()} == {(1, "/x/a@b.example.txt"), (3, token)}


def test_token_id_is_hmac(spark) -> None:
    inner, outer = T.pads(KEY)
    got = spark.createDataFrame([("é😀",)], "v string").select(T.token_id(F.col("v"), F.lit(inner), F.lit(outer)).alias("t")).first()["t"]
    assert got == hmac.new(KEY, "é😀".encode(), hashlib.sha256).hexdigest()[:8].upper()


def test_nested_strings(spark) -> None:
    frame = spark.sql("select named_struct('a', 'x', 'n', 1, 'l', array('y', null), 'm', map('k', 'z')) as v")
    got = frame.select(map_strings(F.col("v"), frame.schema["v"].dataType, F.upper).alias("v")).first()["v"]
    assert (got["a"], got["n"], got["l"], got["m"]) == ("X", 1, ["Y", None], {"k": "Z"})


def test_policy(spark) -> None:
    paths = ["a/.env", "x\\.env.local", "b/c.PY", "d.bin", "README", "e/f​.md"]
    frame = spark.createDataFrame([(p,) for p in paths], "p string").select(P.restorable(F.col("p")).alias("r"), P.basename(F.col("p")).alias("n")).collect()
    assert [r["r"] for r in frame] == [True, True, True, False, False, True] and frame[-1]["n"] == "f.md"
    kinds = spark.createDataFrame([("email",), ("jwt",), ("news",), ("card_security_code",)], "k string").select(P.mode(F.col("k")).alias("m"), P.category(F.col("k")).alias("c")).collect()
    assert [tuple(r) for r in kinds] == [("pseudonymize", "email"), ("redact", "secret"), ("redact", "other"), ("redact", "secret")]
    assert P.benchmark_category("card_security_code") == "banking"


def test_scores(spark) -> None:
    gold = [("PERSON", 0, 8), ("PERSON", 9, 12)]
    rows = [("t", "Jean Roy Ann", gold, [("PERSON", 0, 4), ("PERSON", 9, 12)]), ("t", "rien", [], [("PERSON", 0, 4)]), ("u", "rien", [], [])]
    frame = spark.createDataFrame(rows, f"task string, text string, gold {S.SPANS}, predicted {S.SPANS}")
    got = {r["task"]: r for r in M.exact_metrics(frame, groups=["task"]).collect()}
    assert (got["t"]["gold"], got["t"]["predicted"], got["t"]["exact"], got["t"]["covered"], got["t"]["gold_chars"], got["t"]["shared_chars"]) == (2, 3, 1, 1, 10, 7)
    assert got["t"]["negative_rate"] == 1.0 and got["u"]["precision"] is None and got["u"]["negative_rate"] == 0.0
    f2 = {r["task"]: r["f2"] for r in M.masking_scores(frame, "gold", "predicted", "task").collect()}
    assert abs(f2["t"] - 5 * (7 / 11) ** 2 / (4 * 7 / 11 + 7 / 11)) < 1e-12 and f2["u"] == 0.0
    found = spark.createDataFrame([("d", "email", 0, 5), ("d", "phone", 7, 9)], "name string, category string, start int, end int")
    expected = spark.createDataFrame([("d", "email", 4, 9), ("d", "name", 0, 3)], "name string, category string, start int, end int")
    scores = {r["category"]: r for r in M.category_scores(found, expected).collect()}
    assert scores["email"]["recall"] == 1.0 and scores["phone"]["recall"] is None and scores["phone"]["precision"] == 0.0 and scores["name"]["precision"] is None
    texts = spark.createDataFrame([("d", "a\nb c d e f")], "name string, text string")
    assert [(r["category"], r["line"]) for r in M.mistakes(found, expected, texts).collect()] == [("phone", 2)]
    lat = M.latency(spark.createDataFrame([("m", float(i)) for i in range(1, 11)] + [("m", float("nan"))], "model string, v double"), "v", ["model"]).first()
    assert (lat["p50"], lat["p95"], lat["n"]) == (5.5, 10.0, 10)
    boot = M.bootstrap(spark.createDataFrame([("m", str(i), 1, 2, 2) for i in range(30)], "model string, unit string, exact int, gold int, predicted int"), "unit", draws=50).first()
    assert boot["low"] == boot["high"] == 0.5


def test_windows_and_samples(spark) -> None:
    text = " ".join(str(i) for i in range(450))
    got = spark.createDataFrame([(text,), ("a b",), ("",)], "t string").select(M.word_windows(F.col("t")).alias("w")).collect()
    assert [[len(w) for w in r["w"]] for r in got] == [[200, 200, 130], [2], [0]]
    keys = [f"id{i}" for i in range(40)]
    got = spark.createDataFrame([(k,) for k in keys], "k string").select("k", M.tenth(F.col("k")).alias("t")).collect()
    assert all(r["t"] == int(hashlib.sha256(r["k"].encode()).hexdigest(), 16) % 10 for r in got)
