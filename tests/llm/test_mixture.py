"""Problem 8: the cube method's balance, the plan and the shares."""

from __future__ import annotations

import numpy as np
import pytest

from veilspan.llm import mixture as M
from veilspan.llm.cube import flight, landing


def test_flight_keeps_totals() -> None:
    for seed in range(20):
        rng = np.random.default_rng(seed)
        n = int(rng.integers(0, 200))
        p, sizes = rng.random(n), rng.integers(1, 500, n)
        if seed % 3 == 0:
            sizes[:] = 7
        out = flight(p, sizes, rng)
        assert abs(out.sum() - p.sum()) < 1e-6 and abs((out * sizes).sum() - (p * sizes).sum()) < 1e-3
        assert ((out > 1e-9) & (out < 1 - 1e-9)).sum() <= 2
        final = landing(out, rng)
        assert set(final.tolist()) <= {0.0, 1.0} and abs((final * sizes).sum() - (p * sizes).sum()) <= (2 * sizes.max() if n else 0)


def test_inclusion_probabilities() -> None:
    p, sizes = np.array([0.2, 0.5, 0.7, 0.6, 0.4, 0.6]), np.array([3, 9, 4, 7, 5, 6])
    draws = np.mean([flight(p, sizes, np.random.default_rng(s)) for s in range(3000)], axis=0)
    assert np.abs(draws - p).max() < 0.04
    landed = np.mean([landing(flight(p, sizes, r := np.random.default_rng(s)), r) for s in range(3000)], axis=0)
    assert np.abs(landed - p).max() < 0.04
    two = np.array([landing(np.array([0.9, 0.9]), np.random.default_rng(s)) for s in range(2000)])
    assert set(two.sum(axis=1)) == {1.0, 2.0} and abs(two.sum(axis=1).mean() - 1.8) < 0.05


def test_plan() -> None:
    plan = M.planned({"a": 100, "b": 1000, "c": 0}, {"a": 0.5, "b": 0.5, "c": 0.2}, {"a": 2, "b": 1, "c": 3})
    assert plan == {"a": 2.0, "b": 0.2}
    assert M.planned({"a": 100, "b": 1000}, {"a": 0.5, "b": 0.5}, {"a": 2, "b": 1}, tokens=1000) == {"a": 2.0, "b": 0.8}
    assert M.planned({}, {"a": 1.0}, {"a": 1}) == {}


def _documents(spark, n: int):
    rng = np.random.default_rng(4)
    rows = [(i, "big" if i % 3 else "small" if i % 2 else "rare" if i % 30 == 0 else None, int(rng.integers(1, 300)), "x") for i in range(n)]
    return spark.createDataFrame([*rows, (n + 1, "big", 0, "x"), (n + 2, "other", 50, "x"), (n + 3, "big", None, "x")], "doc_id long, source string, tokens long, copies string")


@pytest.mark.parametrize("block", [2000, 40])
def test_shares(spark, monkeypatch, block: int) -> None:
    monkeypatch.setattr(M, "BLOCK", block)
    documents = _documents(spark, 1500)
    targets = spark.createDataFrame([("big", 0.4, 1), ("small", 0.5, 2), ("rare", 0.1, 4), ("gone", 0.2, 2), ("other", None, 3)], "source string, target_share double, max_repeats int")
    taken = M.mixture(documents, targets, "doc_id", "source", "tokens").cache()
    rows = {r["source"]: r for r in M.shares(taken, targets).collect()}
    total = sum(r["tokens"] for r in rows.values())
    for source, share in (("big", 0.4), ("small", 0.5), ("rare", 0.1)):
        assert abs(rows[source]["tokens"] - share * total) <= 900
        assert rows[source]["most_copies"] <= rows[source]["max_repeats"]
    assert rows["gone"]["tokens"] == 0 and rows["gone"]["reached_share"] == 0
    ids = [r["doc_id"] for r in taken.collect()]
    assert len(ids) == len(set(ids)) and not set(ids) & {1501, 1502, 1503}
    again = M.mixture(documents.repartition(7), targets, "doc_id", "source", "tokens")
    assert again.exceptAll(taken).count() == 0 and taken.exceptAll(again).count() == 0


def test_empty(spark) -> None:
    targets = spark.createDataFrame([("a", 1.0, 1), (None, 0.5, 1)], "source string, target_share double, max_repeats int")
    none = _documents(spark, 3).where("false")
    assert M.mixture(none, targets, "doc_id", "source", "tokens").count() == 0
    assert [r["reached_share"] for r in M.shares(M.mixture(none, targets, "doc_id", "source", "tokens"), targets.where("source is not null")).collect()] == [0.0]
