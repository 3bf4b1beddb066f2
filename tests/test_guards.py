"""What keeps findings right or answers back: words of tools, external markers, deadlines, archives, export paths."""

from __future__ import annotations

import hashlib
import io
import random
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from veilspan.functions import spans as S
from veilspan.operators import decoding as C
from veilspan.operators import detect as D
from veilspan.operators import exports as E
from veilspan.operators import metrics as M
from veilspan.operators import policy as P
from veilspan.operators import tabular as T
from veilspan.operators import vault as V
from veilspan.operators.rules import Span, drop_touching
from veilspan.sources import hooks as H
from veilspan.sources import lexicon as L
from veilspan.streaming import protect


def said(*words: str):
    """A detector that reports the given words, as an over-eager model does."""
    return lambda text: [Span("person_name", text.index(w), text.index(w) + len(w)) for w in words if w in text]


def values(text: str, found: list[Span]) -> list[str]:
    return [text[s.start : s.end] for s in found if s.kind == "person_name"]


def test_tool_words_are_no_names() -> None:
    text = "Claude Code relit le plan avec Claude Moreau."
    assert values(text, D.detected(text, said("Claude Code", "Claude Moreau"))) == ["Claude Moreau"]
    for label in ("author: Claude Code", "name: Read", "reported by Bash"):
        assert D.detected(label) == []


def test_markers_survive_spreading(spark) -> None:
    known = spark.createDataFrame([("s", "Person_001"), ("s", "Read"), ("s", "Ann Lee")], "session string, name string")
    frame = spark.createDataFrame([("s", "[PERSON_001] puis PERSON_001, ann lee; Read"), ("t", "Ann Lee")], "session string, text string")
    out = {r["session"]: r for r in D.find_many(frame, "session", known=known).collect()}
    assert [tuple(s) for s in out["s"]["spans"]] == [("person_name", 30, 37)] and out["t"]["spans"] == []
    both = "M. PERSON_001, [PERSON_002], [EMAIL_001]."
    assert D.detected(both, said("PERSON")) == []
    assert [s.kind for s in D.detected("PERSON_001@example.org et [EMAIL_001]", said("PERSON"))] == ["email"]


def test_columns_without_a_name() -> None:
    spell = lambda text: [text[s.start : s.end] for s in T.tabular(text)]
    assert spell(",first_name,email\n0,Ann,a@b.co") == ["Ann"] and spell("\tnom\tprénom\n1\ta\tBob") == ["a", "Bob"]
    assert spell('id,"last, name, of some one who signs",first_name\n1,"a, b",Ann') == []
    assert spell("id,it's first_name\n1,Ann") == [] and spell("id,first_name\n1,O'Neil, x") == ["O'Neil, x"]


def test_touching_is_linear() -> None:
    r = random.Random(1)
    some = [Span("a", i, i + r.randrange(1, 9)) for i in range(0, 400_000, 4)]
    rest = [Span("b", i, i + 2) for i in range(0, 400_000, 11)]
    start = time.time()
    kept = drop_touching(some, rest)
    assert time.time() - start < 3
    taken = {i for s in rest for i in range(s.start, s.end)}
    assert kept == [s for s in some if not taken & set(range(s.start, s.end))]


def test_characters_of_long_texts(spark) -> None:
    text = "é à " * 40_000
    spans = [("x", i, i + 3) for i in range(0, 150_000, 5)]
    frame = spark.createDataFrame([(text, spans, spans[::2])], f"text string, gold {S.SPANS}, predicted {S.SPANS}")
    start = time.time()
    r = M.exact_metrics(frame).first()
    places = [{i for _, a, b in some for i in range(a, b) if text[i] != " "} for some in (spans, spans[::2])]
    assert time.time() - start < 30 and (r["gold_chars"], r["predicted_chars"], r["shared_chars"]) == (len(places[0]), len(places[1]), len(places[1])) and r["covered"] == len(spans[::2])


def test_quantiles_of_large_groups(spark) -> None:
    import numpy as np

    r = np.random.default_rng(3)
    groups = {"a": np.round(r.lognormal(3, 2, 40_001), 3), "b": np.full(9000, 7.5), "c": np.array([4.0]), None: r.integers(0, 5, 1000).astype(float)}
    rows = [(k, float(v)) for k, x in groups.items() for v in x]
    frame = spark.createDataFrame(rows, "g string, v double").repartition(5)
    out = {x["g"]: x for x in M.quantiles(frame, "v", ["g"], {"p50": (0.5, True), "p95": (0.95, False), "p0": (0.0, True), "p100": (1.0, False)}, accuracy=200).collect()}
    for k, x in groups.items():
        want = [np.quantile(x, 0.5), np.quantile(x, 0.95, method="inverted_cdf"), x.min(), x.max()]
        assert np.allclose([out[k][c] for c in ("p50", "p95", "p0", "p100")], want) and out[k]["n"] == len(x)


def test_bootstrap_resamples_units(spark) -> None:
    import numpy as np

    r = np.random.default_rng(5)
    rows = [(m, f"u{i}", int(r.random() < share), 1, 1) for m, share in (("m", 0.7), ("n", 0.7)) for i in range(400)]
    frame = spark.createDataFrame(rows, "model string, unit string, exact int, gold int, predicted int")
    got = {x["model"]: (x["low"], x["high"]) for x in M.bootstrap(frame, "unit").collect()}
    for m in ("m", "n"):
        x = np.array([row[2] for row in rows if row[0] == m])
        want = np.quantile(x[r.integers(0, 400, (2000, 400))].mean(axis=1), [0.025, 0.975])
        assert np.abs(np.array(got[m]) - want).max() < 0.02
    alike = spark.createDataFrame([(m, u, e, g, p) for m in "xy" for _, u, e, g, p in rows[:400]], frame.schema)
    assert len({(x["low"], x["high"]) for x in M.bootstrap(alike, "unit").collect()}) == 1  # every model draws the same units


def test_vault_reads_few_shards(spark, tmp_path) -> None:
    path = str(tmp_path / "vault")
    assert V.read_vault(spark, path).count() == 0
    rows = spark.createDataFrame([(f"s{i % 40}", k, f"{i:08X}", f"v{i}") for i in range(200) for k in ("email", "person_name")], "session_id string, kind string, token_id string, value string")
    V.write_vault(rows, path, 0)
    V.write_vault(rows.limit(10), path, 1)
    asked = spark.createDataFrame([("s3",)], "session string")
    part = V.read_vault(spark, path, asked, "session", ["email"], but=1)
    assert {(r["session_id"], r["kind"]) for r in part.collect()} == {("s3", "email")} and part.count() == 5
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "shard" in plan.split("PartitionFilters")[1][:400]
    new = spark.createDataFrame([("s3", "email", f"{3:08X}", "other"), ("s9", "email", "FFFFFFFF", "x")], rows.schema)
    assert [r["token_id"] for r in V.clashing(rows, new).collect()] == [f"{3:08X}"] and V.clashing(rows, rows).isEmpty()
    cipher = V.aes(F.lit("0" * 16))
    assert V.decrypted(V.encrypted(rows, cipher), cipher).exceptAll(rows).isEmpty()


def test_deadline(spark) -> None:
    slow = spark.range(4, numPartitions=4).mapInArrow(lambda batches: (time.sleep(20) or b for b in batches), "id long")
    start = time.time()
    with pytest.raises(Exception), protect.deadline(spark, 1.5):  # noqa: B017
        slow.count()
    assert time.time() - start < 15
    with protect.deadline(spark, 60):
        assert spark.range(3).count() == 3


def test_hook_events(spark, tmp_path) -> None:
    lines = ['{"event_id":1,"session_id":"s","ts":"2026-01-02T03:04:05Z","tool_name":"Read","tool_input":{"file_path":"/a.txt","n":1},"tool_response":null}', "[1,2]", "not json", "", '{"event_id":"x","tool_name":"Bash"}']
    (tmp_path / "a.json").write_text("\n".join(lines) + "\n")
    batch = H.events(spark, str(tmp_path))
    out = batch.collect()
    assert [r["tool_name"] for r in out if r["refused"] is None] == ["Read"] and len(out) == 4
    first = next(r for r in out if r["event_id"] == 1)
    assert first["tool_input"] == '{"file_path":"/a.txt","n":1}' and first["tool_response"] is None and first["ts"] is not None
    stream = H.event_stream(spark, str(tmp_path)).writeStream.format("memory").queryName("hooks").start()
    stream.processAllAvailable()
    stream.stop()
    assert spark.table("hooks").exceptAll(batch).isEmpty() and spark.table("hooks").count() == 4


def test_lexicon_archive(spark, tmp_path) -> None:
    def packed(*parts: tuple[str, str]) -> tuple[str, str]:
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w") as z:
            for name, content in parts:
                z.writestr(name, content)
        path = tmp_path / f"{len(list(tmp_path.iterdir()))}.zip"
        path.write_bytes(data.getvalue())
        return str(path), hashlib.sha256(data.getvalue()).hexdigest()

    path, digest = packed(("n.csv", "sexe;prenom\n1;ÉLODIE\n1;Élodie\n2;AUTRES NOMS\n2;Zoé\n"))
    names = L.archived(spark, path, digest, "prenom", "given")
    assert {tuple(r) for r in names.collect()} == {("given", "elodie"), ("given", "zoe")} and L.counts(names).first()["names"] == 2
    two = packed(("a.csv", "prenom\nx\n"), ("b.csv", "prenom\ny\n"))
    for bad in ((path, "0" * 64), two):
        with pytest.raises(Exception):  # noqa: B017
            L.archived(spark, *bad, "prenom", "given").collect()
    with pytest.raises(Exception):  # noqa: B017
        L.archived(spark, path, digest, "prenom", "given", most=20).collect()


def test_plausible_names(spark) -> None:
    text = "fastino/x GLiNER2 ONNX Ann Lee-Roy a@Bob Read"
    words = ("fastino", "GLiNER2", "ONNX", "Ann Lee", "Bob", "Read")
    model = C.plausible_only(lambda texts: [[Span("person_name", t.index(w), t.index(w) + len(w)) for w in words] for t in texts])
    out = C.with_model(spark.createDataFrame([(text,)], "text string"), lambda: model).first()
    assert [text[s["start"] : s["end"]] for s in out["spans"]] == ["Ann Lee-Roy"]
    sizes = []
    C.plausible_only(lambda texts: sizes.append(len(texts)) or [[] for _ in texts])(["a", "b"])
    assert sizes == [2]


def test_export_paths(tmp_path) -> None:
    (tmp_path / "real").mkdir()
    (tmp_path / "link").symlink_to(tmp_path / "real")
    root = str(tmp_path / "real")
    assert E.export_path(root, "a.csv").name == "a.csv"
    (tmp_path / "real" / "old.sql").write_text("x")
    (tmp_path / "real" / "dead.csv").symlink_to(tmp_path / "nowhere")
    for folder, name in ((root, "../a.csv"), (root, "con.csv"), (root, "a.exe"), (str(tmp_path / "link"), "a.csv"), (str(tmp_path / "none"), "a.csv"), (root, "old.sql"), (root, "dead.csv")):
        with pytest.raises((ValueError, FileExistsError)):
            E.export_path(folder, name)


def test_first_workbooks(spark) -> None:
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("xl/workbook.xml", "<w/>")
    frame = spark.createDataFrame([(1, f"{i:02}.xlsx", bytearray(data.getvalue()) if i else bytearray(b"no"), {}) for i in range(4)], "event int, name string, content binary, tokens map<string,string>")
    out = E.restored_workbooks(frame, event="event", most=2).orderBy("name").collect()
    assert out[0]["content"] is None and bytes(out[3]["content"]) == data.getvalue()


def test_edit_guard_and_thresholds(spark) -> None:
    rows = spark.createDataFrame([("a.py", ["x ⟦EMAIL:0A1B2C3D⟧"]), ("a.bin", ["⟦EMAIL:0A1B2C3D⟧"]), ("a.py", ["x"]), ("a.py", [])], "p string, s array<string>")
    from veilspan.operators.tokens import PLACEHOLDER_JAVA

    assert [r[0] for r in rows.select(P.refused_edit(F.col("p"), F.col("s"), PLACEHOLDER_JAVA)).collect()] == [True, False, False, False]
    scores = spark.createDataFrame([("m", 0.3, 0.9, 0.5, 0.8), ("m", 0.5, 0.9, 0.6, 0.7), ("m", 0.7, 0.8, 0.9, 0.9), ("n", 0.1, 0.2, 0.2, 0.2)], "model string, threshold double, f1 double, full_coverage double, precision double")
    assert {r["model"]: r["threshold"] for r in M.best_threshold(scores, ["model"]).collect()} == {"m": 0.5, "n": 0.1}
    published = spark.createDataFrame([(0.9,), (0.5,), (0.7,)], "f2 double")
    mine = spark.createDataFrame([("t", 0.6), ("u", 0.8)], "task string, f2 double")
    assert tuple(M.ranking(mine, published).first()) == (0.7, 2) and M.ranking(mine, published.limit(0)).first()["rank"] == 1
