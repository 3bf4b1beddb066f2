"""Characters that two lists of spans cover in one text, in time linear in the text and the spans.

Arrays of spans grow in steps inside Catalyst's higher-order functions, each of which copies what is there; so texts of
very many spans are counted here, on whole arrays of Arrow batches.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

_BLANKS = np.array([c for c in range(0x3001) if chr(c).isspace() and c not in range(0x1C, 0x20)], dtype=np.uint32)
_COUNTS = ("gold", "predicted", "exact", "covered", "gold_chars", "predicted_chars", "shared_chars")
COVERAGE = T.StructType([T.StructField(c, T.IntegerType()) for c in _COUNTS] + [T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("want", "have")])
_ARROW = pa.struct([*((c, pa.int32()) for c in _COUNTS), ("want", pa.list_(pa.int32())), ("have", pa.list_(pa.int32()))])


def _solid(text: str) -> np.ndarray:
    return ~np.isin(np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32), _BLANKS)


def _before(marks: np.ndarray) -> np.ndarray:
    """How many marks stand before each place, and in all."""
    return np.concatenate([[0], np.cumsum(marks)])


def _cover(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Places that some span covers."""
    edges = np.bincount(starts, minlength=n + 1) - np.bincount(ends, minlength=n + 1)
    return np.cumsum(edges)[:n] > 0


class _Spans:
    """The columns of an array of lists of spans, cut to a row at a time."""

    def __init__(self, lists: pa.ListArray) -> None:
        self.offsets = lists.offsets.to_numpy()
        self.there = lists.is_valid().to_numpy(zero_copy_only=False)
        self.kinds = lists.values.field("kind").to_numpy(zero_copy_only=False)
        self.starts, self.ends = (lists.values.field(f).to_numpy(zero_copy_only=False).astype(np.int64) for f in ("start", "end"))

    def row(self, i: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        part = slice(self.offsets[i], self.offsets[i + 1] if self.there[i] else self.offsets[i])
        starts = np.clip(self.starts[part], 0, n)
        return self.kinds[part], starts, np.maximum(starts, np.clip(self.ends[part], 0, n))


def _row(text: str, gold: tuple[np.ndarray, ...], predicted: tuple[np.ndarray, ...]) -> dict:
    solid = _solid(text)
    all_before, n = _before(solid), len(solid)
    places = [list(zip(*(x.tolist() for x in spans), strict=True)) for spans in (gold, predicted)]
    first, second = map(set, places)
    out = dict.fromkeys(_COUNTS, 0) | {"gold": len(first), "predicted": len(second), "exact": len(first & second)}
    want, have = all_before[gold[2]] - all_before[gold[1]], np.zeros(len(gold[0]), dtype=np.int64)
    for kind in {*gold[0].tolist(), *predicted[0].tolist()}:
        g, p = gold[0] == kind, predicted[0] == kind
        in_gold, in_predicted = _cover(gold[1][g], gold[2][g], n) & solid, _cover(predicted[1][p], predicted[2][p], n) & solid
        hit = _before(in_predicted)
        have[g] = hit[gold[2][g]] - hit[gold[1][g]]
        out["gold_chars"] += int(in_gold.sum())
        out["predicted_chars"] += int(in_predicted.sum())
        out["shared_chars"] += int((in_gold & in_predicted).sum())
    whole = {place for place, all_there in zip(places[0], want == have, strict=True) if all_there}
    return out | {"covered": len(whole), "want": want.tolist(), "have": have.tolist()}


@F.arrow_udf(COVERAGE)
def coverage(texts: pa.Array, gold: pa.Array, predicted: pa.Array) -> pa.Array:
    """``COVERAGE`` of each row: distinct spans, exact ones, those whose solid characters are all covered by their kind,
    solid characters by kind, and for each gold span its solid characters and how many of them predictions of its kind hold.

    Null lists are empty, a null text has no characters; spans are cut to the text.
    """
    g, p = _Spans(gold), _Spans(predicted)
    return pa.array([_row(t or "", g.row(i, len(t or "")), p.row(i, len(t or ""))) for i, t in enumerate(texts.to_pylist())], _ARROW)
