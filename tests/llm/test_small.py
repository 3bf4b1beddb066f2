"""Problems 2, 4 and 6: stability, forms and offsets, rank errors; edge cases."""

from __future__ import annotations

import random
import unicodedata

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veilspan.llm import forms as Fm
from veilspan.llm import quantiles as Q
from veilspan.llm import sample as Sm


def test_sample_is_stable(spark) -> None:
    ids = [f"d:{i}" for i in range(4000)]
    small = spark.createDataFrame([(i, 1) for i in ids[:1500]] + [(None, 1)], "id string, bucket int")
    large = spark.createDataFrame([(i, 2) for i in reversed(ids)] * 2, "id string, bucket int").repartition(7)
    a, b = ({r["id"] for r in Sm.stable_sample(x, "id").collect()} for x in (small, large))
    assert a == b & set(ids[:1500]) and 0.07 < len(b) / 4000 < 0.13
    assert Sm.stable_sample(large, "id").count() == len(b)
    counts_small, counts_large = Sm.bucket_counts(small, "id"), Sm.bucket_counts(large, "id")
    taken = Sm.grown_list(spark, counts_small, 200)
    more = Sm.grown_list(spark, counts_large, 200, already=taken)
    assert more == taken and Sm.grown_list(spark, counts_large, 700, already=taken) > taken
    one, two = ({r["id"] for r in Sm.stable_sample(large, "id", buckets=n).collect()} for n in (taken, taken + 50))
    assert one < two
    assert Sm.stable_sample(spark.createDataFrame([], "id string"), "id").count() == 0


VOCAB = "lettre la chaise chapeau malle note petite"


def test_forms(spark) -> None:
    rows = [
        ("wide", "ｔｕｉｌｅ １２"), ("marks", "après"), ("zero", "d‍u vent"), ("space", "un mot là"), ("soft", "con­trat"), ("liga", "ﬁche"), ("mixed", "la lеttrе"), ("alone", "ӏɑ malle"),
        ("unknown", "zzеqq"), ("foreign", "« библиотека » et « θάλασσα »"), ("emoji", "👨‍👩‍👧 ❤️ 🇫🇷"), ("marks2", "m² ½ œuf « x » – … ’ Mᵉ"), ("plain", VOCAB), ("null", None), ("empty", ""), (None, "ｔ"),
    ]
    frame = spark.createDataFrame(rows, "id string, text string")
    assert {r["id"] for r in Fm.odd_records(frame).collect()} == {"wide", "marks", "zero", "space", "soft", "liga", "mixed", "alone"}
    spans = frame.withColumn("spans", F.when(F.col("id") == "zero", F.expr("array(named_struct('kind', 'X', 'start', 4, 'end', 8, 'source_label', null))")).when(F.col("id") == "marks", F.expr("array(named_struct('kind', 'X', 'start', 3, 'end', 6, 'source_label', 'l'))")))
    got = {r["id"]: r for r in Fm.repaired(spans).collect()}
    assert got["wide"]["text"] == "tuile 12" and got["marks"]["text"] == "après" and got["mixed"]["text"] == "la lettre" and got["alone"]["text"] == "la malle" and got["soft"]["text"] == "contrat" and got["space"]["text"] == "un mot là" and got["liga"]["text"] == "fiche"
    assert got["unknown"]["text"] == "zzеqq" and got["emoji"]["text"] == dict(rows)["emoji"] and got["null"]["text"] is None and got["empty"]["text"] == "" and len(got) == 15
    s = got["zero"]["spans"][0]
    assert got["zero"]["text"][s["start"] : s["end"]] == "vent"
    s = got["marks"]["spans"][0]
    assert got["marks"]["text"][s["start"] : s["end"]] == "ès"
    assert Fm.odd_records(frame.where("false")).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aé̀ ​‍ﬁｔ x😀👩👧️Ж", max_size=30))
def test_character_edits_settle(text: str) -> None:
    edits = Fm.character_edits(text)
    once = Fm.applied(text, edits)
    assert all(a[1] <= b[0] for a, b in zip(edits, edits[1:], strict=False))
    assert unicodedata.normalize("NFC", once) == unicodedata.normalize("NFC", Fm.applied(once, Fm.character_edits(once))) or len(Fm.character_edits(once)) < len(edits) + 1
    assert Fm.moved(len(text), edits, True) == len(once) and Fm.moved(0, edits) == 0


def test_quantiles_within_bound(spark) -> None:
    r = random.Random(5)
    rows = [(g, d, r.lognormvariate(3, 1), r.randrange(50)) for g in ("hot",) * 20 + ("cold",) for d in range(4) for _ in range(400)]
    rows += [("hot", 0, float("nan"), None), ("hot", 0, -1.0, 3), ("hot", 0, float("inf"), 3), (None, 0, 1.0, 1), ("void", 0, None, None)]
    frame = spark.createDataFrame(rows, "g string, d int, v double, n int").withColumn("v", Q.usable(F.col("v"))).repartition(6)
    kinds = {"v": "double", "n": "bigint"}
    days = Q.summaries(frame, ["g", "d"], ["v", "n"], k=200)
    got = {x["g"]: x for x in Q.percentiles(Q.merged(days, ["g"], kinds, k=200), kinds).collect()}
    bound = 1.5 * Q.rank_error(200)
    for g in ("hot", "cold"):
        values = np.sort([x[2] for x in rows if x[0] == g and x[2] is not None and np.isfinite(x[2]) and x[2] >= 0])
        assert got[g]["v_n"] == len(values)
        for p in Q.PERCENTS:
            rank = np.searchsorted(values, got[g][f"v_p{p}"], side="right") / len(values)
            assert abs(rank - p / 100) <= bound
    assert got[None]["v_p50"] == 1.0 and got["void"]["v_n"] == 0 and got["void"]["v_p50"] is None and got["void"]["n_p50"] is None
    assert Q.percentiles(Q.summaries(frame.where("false"), ["g"], ["v"]), {"v": "double"}).count() == 0


def test_bands(spark) -> None:
    rows = [(127, "x"), (128, None), (512, "short_lt128"), (None, "LONG_GE512"), (None, "short"), (None, None)]
    got = spark.createDataFrame(rows, "c int, l string").select(Q.length_band(F.col("c"), F.col("l")).alias("b")).collect()
    assert [x["b"] for x in got] == ["short_lt128", "medium_128_511", "long_ge512", "long_ge512", None, None]


def test_batches_are_cut_by_size() -> None:
    import pyarrow as pa

    from veilspan.llm.batches import sliced

    texts = ["a" * n for n in (5, 50, 3, 3, 3)] + [None, ""]
    batch = pa.record_batch([pa.array(range(7)), pa.array(texts)], names=["i", "t"])
    parts = list(sliced(iter([batch]), most=10))
    assert [p.num_rows for p in parts] == [1, 1, 5] and pa.Table.from_batches(parts).to_pydict() == batch.to_pydict()
    assert list(sliced(iter([batch.slice(0, 0)])))[0].num_rows == 0
