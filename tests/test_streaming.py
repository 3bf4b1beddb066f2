"""Streams: commit order, repeated batches, grouping of notifications."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from veilspan.operators import vault as V
from veilspan.streaming import notifications as N
from veilspan.streaming import protect as P


def test_commit_is_idempotent_and_knows_names(spark, tmp_path) -> None:
    vault, out = str(tmp_path / "vault"), str(tmp_path / "out")
    first = spark.createDataFrame([(1, "s", "Nom : Jean Dupont"), (2, "t", "a@b.example")], "id int, session string, text string")
    keys = V.session_keys(first, "session", b"m" * 32)
    for _ in range(2):
        P.commit(first, 0, keys, "session", vault, out)
    second = spark.createDataFrame([(3, "s", "Jean Dupont revient"), (4, "t", "Jean Dupont")], "id int, session string, text string")
    P.commit(second, 1, keys, "session", vault, out)
    rows = {r["id"]: r["text"] for r in spark.read.parquet(out).collect()}
    assert len(rows) == 4 and rows[3].startswith("⟦PERSON_NAME:") and rows[4] == "Jean Dupont"
    held = spark.read.parquet(vault)
    assert held.count() == 2 and V.collisions(held).isEmpty()


def test_stream_end_to_end(spark, tmp_path) -> None:
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.json").write_text(json.dumps({"id": 1, "session": "s", "text": "a@b.example"}) + "\n")
    keys = V.session_keys(spark.createDataFrame([("s",)], "session string"), "session", b"m" * 32)
    stream = spark.readStream.schema("id int, session string, text string").json(str(source))
    query = P.protect_stream(stream, keys, "session", str(tmp_path / "v"), str(tmp_path / "o"), str(tmp_path / "c"))
    query.processAllAvailable()
    query.stop()
    assert spark.read.parquet(str(tmp_path / "o")).first()["text"].startswith("⟦EMAIL:")


def test_batch_times() -> None:
    b = N.Batch()
    b.add({"pseudonymized": {"email": 2}, "document": "a"}, 100.0)
    assert b.due() == 102.0 and b.take(101.0) is None
    for t in range(101, 112):
        b.add({"redacted": {"secret": 1}, "document": str(t)}, float(t))
    assert b.due() == 110.0
    out = N.Batch.load(b.dump()).take(111.0)
    assert out == {"events": 12, "pseudonymized": {"email": 2}, "redacted": {"secret": 11}, "documents": ["a", "101", "102"]}
    b = N.Batch(sent=111.0)
    b.add({}, 112.0)
    assert b.due() == 141.0 and b.take(140.0) is None and b.take(141.0)["events"] == 1
    b = N.Batch()
    b.add({}, 100.0)
    assert b.take(300.0) is None and b.events == 0
    b.add({"redacted": {"secret": 10**9}}, 50.0)
    assert b.redacted == {"secret": 999_999}


def test_grouping_in_state(spark, tmp_path) -> None:
    source = tmp_path / "in"
    source.mkdir()
    lines = [{"session": s, "pseudonymized": {"email": 1}, "redacted": {}, "document": "d"} for s in ("x", "x", "y")]
    (source / "a.json").write_text("\n".join(map(json.dumps, lines)) + "\n")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema("session string, pseudonymized map<string,int>, redacted map<string,int>, document string").json(str(source))
    query = N.grouped(stream).writeStream.format("memory").queryName("notices").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    import time

    until = time.time() + 60
    while time.time() < until and spark.table("notices").count() < 2:
        time.sleep(1)
    query.stop()
    assert {(r["session"], r["events"], r["pseudonymized"]["email"]) for r in spark.table("notices").collect()} == {("x", 2, 2), ("y", 1, 1)}


def test_delivery_and_purge(spark) -> None:
    rows = [("off", True, True), ("always", False, None), ("auto", False, False), ("auto", True, True), ("auto", True, False)]
    got = spark.createDataFrame(rows, "m string, o boolean, f boolean").select(N.delivery(F.col("m"), F.col("o"), F.col("f")).alias("d")).collect()
    assert [r["d"] for r in got] == ["off", "send_always", "send_unknown", "suppress_foreground", "send_background"]
    vault = spark.createDataFrame([("a",), ("b",)], "session_id string")
    active = spark.sql("select 'a' as session_id, current_timestamp() as last_active union all select 'b', current_timestamp() - interval 8 days")
    assert [r[0] for r in P.purge(vault, active).collect()] == ["a"]


def test_due_batches(spark) -> None:
    pending = spark.createDataFrame([("a", 90.0, 97.0), ("b", 99.0, 99.5), ("c", 80.0, 99.5), ("d", 90.0, 97.0), ("e", 0.0, -50.0)], "session string, first double, last double")
    sent = spark.createDataFrame([("d", 95.0), ("a", 60.0)], "session string, time double")
    assert [r["session"] for r in N.due(pending, sent, 100.0).collect()] == ["c", "a"]
    assert [r["session"] for r in N.newest(pending, most=2).collect()] == ["b", "c"]
