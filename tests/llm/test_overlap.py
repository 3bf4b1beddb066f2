"""Problem 1 against brute force, and its edge cases."""

from __future__ import annotations

import random

import pytest

from veilspan.llm import overlap as O
from veilspan.llm.characters import level, levels

WORDS = "amber barley canyon delta ember falcon garden harbor island jasmine kettle lantern meadow nectar orchard pebble quartz river saddle timber valley willow".split()


def lcs(a: str, b: str) -> int:
    row = [0] * (len(b) + 1)
    for c in a:
        before = 0
        for j, d in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if c == d else max(row[j], row[j - 1])
    return row[-1]


def test_common_subsequence() -> None:
    r = random.Random(3)
    for _ in range(60):
        a, b = ("".join(r.choice("abcd") for _ in range(r.randrange(70))) for _ in range(2))
        assert O.common(a, b) == lcs(a, b)
        longer = max(len(a), len(b))
        assert O.alike(a, b, 0.6) == (min(len(a), len(b)) > 0 and lcs(a, b) >= 0.6 * longer)


def noisy(text: str, r: random.Random, rate: float) -> str:
    out = []
    for c in text:
        x = r.random()
        out.append("" if x < rate / 3 else c + c if x < 2 * rate / 3 else r.choice("aeiou") if x < rate else c)
    return "".join(out)


@pytest.mark.parametrize("hot", [500, 2])
def test_pairs_against_brute_force(spark, monkeypatch, hot: int) -> None:
    monkeypatch.setattr(O, "HOT", hot)
    r = random.Random(11)
    base = [" ".join(r.choice(WORDS) for _ in range(r.randrange(15, 60))) for _ in range(60)]
    first = [(f"q{i}", t) for i, t in enumerate(base)]
    second = [(f"c{i}", noisy(t, r, 0.08 * (i % 2))) for i, t in enumerate(base) if i % 2 or i % 3 == 0]
    second += [(f"s{i}", t.upper().replace("e", "é") + " !") for i, t in enumerate(base[:5])]
    first += [("q0", base[0]), ("n", None), ("e", ""), ("p", " ... "), (None, base[0])]
    second += [("x", "shares " + base[3][:60] + " ".join(r.choice(WORDS) for _ in range(40)))]
    q, c = (spark.createDataFrame(x, "id string, text string") for x in (first, second))
    links, a, b = O.cross_split_classes(q, c)
    got = {(r_["qid"], r_["cid"]) for r_ in links.join(a.selectExpr("cls as a", "id as qid"), "a").join(b.selectExpr("cls as b", "id as cid"), "b").collect()}
    want = {(i, j) for i, s in first if i for j, t in second if j and O.alike(level(s), level(t))}
    assert got <= want
    assert len(got) >= 0.97 * len(want)


def at_band(r: random.Random, low: int, high: int, least: float, most: float, n: int) -> list[tuple[str, str]]:
    """Pairs of levelled texts of ``low`` to ``high`` characters whose similarity lies in the band."""
    out: list[tuple[str, str]] = []
    while len(out) < n:
        a = "".join(r.choice(WORDS) for _ in range(high // 4))[: r.randrange(low, high)]
        b = noisy(a, r, r.uniform(0.08, 0.3))
        if least * max(len(a), len(b)) <= O.common(a, b) < most * max(len(a), len(b)):
            out.append((a, b))
    return out


LENGTHS = [(5, 15), (15, 30), (30, 60), (60, 110), (110, 220), (220, 400), (400, 1000), (1000, 1500)]


@pytest.mark.parametrize("low,high", LENGTHS)
@pytest.mark.parametrize("least,most", [(0.8, 0.85), (0.85, 0.9), (0.9, 1.0)])
def test_segments_by_band(low: int, high: int, least: float, most: float) -> None:
    pairs = at_band(random.Random(low), low, high, least, most, 60)
    found = 0
    for a, b in pairs:
        (ca, ma), (cb, mb) = O.keys_of([a], False), O.keys_of([b], True)
        shared = [(i, j) for i, c in enumerate(ca.tolist()) for j, d in enumerate(cb.tolist()) if c == d]
        apart = lambda x, y: sum((int(u) & 2**64 - 1 ^ int(v) & 2**64 - 1).bit_count() for u, v in zip(x, y, strict=True))
        found += any(ma[i][1] == mb[j][1] == -1 or apart(ma[i], mb[j]) <= O.RADIUS for i, j in shared)
    assert found >= 0.95 * len(pairs)


def test_very_short_texts(spark) -> None:
    pairs = [("dupont", "dupnt"), ("marie", "mrie"), ("abcdefghi", "abcdfghi"), ("abcde", "vwxyz")]
    q, c = (spark.createDataFrame([(f"{side}{i}", p[at]) for i, p in enumerate(pairs)], "id string, text string") for at, side in enumerate("qc"))
    links, a, b = O.cross_split_classes(q, c)
    got = {(x["qid"], x["cid"]) for x in links.join(a.selectExpr("cls as a", "id as qid"), "a").join(b.selectExpr("cls as b", "id as cid"), "b").collect()}
    assert got == {(f"q{i}", f"c{i}") for i in range(3)}


def test_pairs_at_four_fifths(spark) -> None:
    pairs = [p for low, high in LENGTHS[1:7] for p in at_band(random.Random(low), low, high, 0.8, 0.85, 15)]
    q, c = (spark.createDataFrame([(f"{side}{i}", p[at]) for i, p in enumerate(pairs)], "id string, text string") for at, side in enumerate("qc"))
    links, a, b = O.cross_split_classes(q, c)
    got = {(x["qid"], x["cid"]) for x in links.join(a.selectExpr("cls as a", "id as qid"), "a").join(b.selectExpr("cls as b", "id as cid"), "b").collect()}
    assert len({x for x in got if x[0][1:] == x[1][1:]}) >= 0.97 * len(pairs)


def test_hot_segments_lose_no_pair(spark, monkeypatch) -> None:
    r = random.Random(7)
    text = " ".join(r.choice(WORDS) for _ in range(40))
    q, c = (spark.createDataFrame([(f"{side}{i}", noisy(text, r, 0.06)) for i in range(40)], "id string, text string") for side in "qc")
    links = []
    for hot in (10**9, 3):
        monkeypatch.setattr(O, "HOT", hot)
        links.append({tuple(x) for x in O.cross_split_classes(q, c)[0].collect()})
    assert len(links[0]) > 500 and links[0] == links[1]


def test_hot_copies_and_empty_tables(spark) -> None:
    text = " ".join(WORDS) + " once more " + " ".join(reversed(WORDS))
    q = spark.createDataFrame([(f"q{i}", text) for i in range(300)], "id string, text string")
    c = spark.createDataFrame([("c1", text), ("c2", text + " tail")], "id string, text string")
    links, a, b = O.cross_split_classes(q, c)
    assert links.count() == 2 and a.count() == 300
    none = spark.createDataFrame([], "id string, text string")
    assert O.cross_split_classes(none, c)[0].count() == 0 and O.cross_split_classes(none, none)[0].count() == 0


def test_clashing_columns_and_long_texts(spark) -> None:
    long = " ".join(WORDS * 2000)
    q = spark.createDataFrame([("q", long, 1, "x")], "id string, text string, cls int, code string")
    links, _, _ = O.cross_split_classes(q, q)
    assert links.count() == 1


def test_no_codes_or_pairs_are_shuffled(spark) -> None:
    q, c = (spark.createDataFrame([(f"{side}{i}", " ".join(WORDS[i:] + WORDS[:i])) for i in range(20)], "id string, text string") for side in "qc")
    links = O.cross_split_classes(q, c)[0]
    assert "Exchange" not in links._jdf.queryExecution().executedPlan().toString()
    assert len([r for r in links.collect() if r["a"] == r["b"]]) == 20


def test_texts_side_by_side() -> None:
    r = random.Random(9)
    for _ in range(60):
        b, *others = ("".join(r.choice("abcdé") for _ in range(r.randrange(130))) for _ in range(7))
        others += [b, b[: r.randrange(len(b) + 1)], ""]
        for least in (0.5, 0.65, 0.8):
            assert O.all_alike(b, others, least) == [min(len(a), len(b)) > 0 and lcs(a, b) >= least * max(len(a), len(b)) for a in others]


def test_fronts_lose_no_pair() -> None:
    r = random.Random(5)
    met: dict[str, list[str]] = {}
    for low, high in LENGTHS:
        near = at_band(r, low, high, 0.8, 0.83, 30)
        for b, a in near:
            met.setdefault(b, []).extend([a, b, *(x for x, _ in near if 0.8 <= len(x) / len(b) <= 1.25)])
    assert O.fronts_allow([("a", [""]), ("", ["a"]), ("ab", ["ab"])], 0.8)[2]
    met["日本語漢字" * 30] = ["語漢" + "日本語漢字" * 29, "Ωжяλ" * 35] * 80
    kept = O.sifted(met)
    for b, others in met.items():
        assert [a for a in others if O.alike(a, b)] == [a for a in kept.get(b, []) if O.alike(a, b)]
    for least in (0.5, 0.65, 0.8):
        pairs = [("".join(r.choice("abcdé") for _ in range(r.randrange(1, 90))), "".join(r.choice("abcdé") for _ in range(r.randrange(1, 90)))) for _ in range(200)]
        for (b, a), k in zip(pairs, O.fronts_allow([(b, [a]) for b, a in pairs], least), strict=True):
            assert k or lcs(a, b) < least * max(len(a), len(b))


def test_few_unlike_texts_are_compared_whole(spark, monkeypatch) -> None:
    compared = []
    monkeypatch.setattr(O, "all_alike", lambda b, others, at=O.all_alike: (compared.extend(others), at(b, others))[1])
    r = random.Random(2)
    texts = [level(" ".join(r.choice(WORDS) for _ in range(40))) for _ in range(400)]
    batch = O._agreeing({b: texts[200:] for b in texts[:200]} | {texts[0]: [texts[0], *texts[200:]]})
    assert batch.num_rows == 1 and len(compared) < 400  # of 40,001 candidates


def test_meeting_against_brute_force() -> None:
    r = random.Random(4)
    base = ["".join(r.choice(WORDS) for _ in range(n)) for n in range(1, 40) for _ in range(4)]
    sides = [sorted({noisy(t, r, 0.1) for t in base} - {""}, key=len) for _ in range(2)]
    packs = [O._unpacked(*(p.column(c)[0].as_py() for c in ("texts", "bits")), wide) for p, wide in zip(map(O._pack, sides), (False, True), strict=True)]
    got = {(packs[0].flats[i], packs[1].flats[j]) for j, i in zip(*(p.tolist() for p in O._meeting(*packs)), strict=True)}
    bits, windows = ([dict(zip(x, f, strict=True)) for x, f in zip(xs, fs, strict=True)] for xs, fs in (
        ([[t for t in s if O._long(t)] for s in sides], [O.all_bits([t for t in s if O._long(t)]) for s in sides]),
        ([[t for t in s if len(t) < O.LEAST] for s in sides], [[O.window_codes(t) for t in s if len(t) < O.LEAST] for s in sides]),
    ))
    want = set()
    for a in sides[0]:
        for b in sides[1]:
            if min(len(a), len(b)) < 0.8 * max(len(a), len(b)):
                continue
            if a in bits[0] and b in bits[1]:
                same = bits[0][a] == bits[1][b]
                if same[O.FILTER :].reshape(O.TABLES, O.BLOCK).all(axis=1).any() and (~same[: O.FILTER]).sum() <= O.RADIUS:
                    want.add((a, b))
            if a in windows[0] and b in windows[1] and windows[0][a] & windows[1][b]:
                want.add((a, b))
    assert len(want) > 100 and got == want


def test_levels_of_many_texts() -> None:
    texts = [None, "", "Éa ß ﬁ ½ Ǆ\n", "x", " .,", "аbс Ωж 日本 ⁄ ²", "İ ŉ ΐ", *("".join(map(chr, range(i, i + 999))) for i in range(0, 0xD000, 999))] * 2
    assert levels(texts) == [level(t) for t in texts] and levels([]) == []
