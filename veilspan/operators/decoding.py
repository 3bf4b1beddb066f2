"""Token labels of a name model to spans, its windows, and the seam for such a model."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan.functions.spans import SPANS
from veilspan.operators.names import completed, plausible
from veilspan.operators.rules import Span, tool_vocabulary
from veilspan.sources.batches import sliced

# Labels that are persons.
PERSONS = frozenset({"PER", "PERSON", "GIVEN_NAME", "SURNAME"})


def fragments_joined(text: str, spans: list[tuple[int, int]]) -> list[Span]:
    """Trimmed of blanks; what touches, or has only blanks between, is one name."""
    out: list[Span] = []
    for start, end in sorted(spans):
        piece = text[start:end]
        start, end = start + len(piece) - len(piece.lstrip()), end - len(piece) + len(piece.rstrip())
        if start >= end:
            continue
        if out and (start <= out[-1].end or text[out[-1].end : start].isspace()):
            out[-1] = out[-1]._replace(end=max(out[-1].end, end))
        else:
            out.append(Span("person_name", start, end))
    return out


def decoded(text: str, windows: list[list[dict]], threshold: float = 0.5) -> list[Span]:
    """Spans of token labels (label, start, end, score), window by window; ``I`` and ``E`` go on only in the same kind."""
    spans: list[list[int]] = []
    for window in windows:
        kind_before = None
        for token in window:
            mark, _, kind = token["label"].partition("-")
            if token["score"] < threshold or kind not in PERSONS:
                kind_before = None
                continue
            if kind == kind_before and mark in ("I", "E"):
                spans[-1][1] = token["end"]
            else:
                spans.append([token["start"], token["end"]])
            kind_before = None if mark in ("E", "S") else kind
    return fragments_joined(text, [tuple(s) for s in spans])


def uncovered(text: str, windows: list[list[dict]]) -> list[int]:
    """Places of letters, marks and numbers that no window covers; none when a model has read everything."""
    seen = {i for w in windows for t in w for i in range(t["start"], t["end"])}
    return [i for i, c in enumerate(text) if unicodedata.category(c)[0] in "LMN" and i not in seen]


def token_windows(n: int, size: int = 512, stride: int = 64) -> list[tuple[int, int]]:
    """Windows over ``n`` tokens, each sharing ``stride`` tokens with the one before; the last one ends at ``n``."""
    starts = range(0, max(n - stride, 1), size - stride)
    return [(s, min(s + size, n)) for s in starts]


def labelled(logits: np.ndarray, labels: list[str]) -> list[tuple[str, float]]:
    """Best label of every token with its softmax probability."""
    z = np.exp(logits - logits.max(axis=1, keepdims=True))
    p = z / z.sum(axis=1, keepdims=True)
    return [(labels[i], float(row[i])) for i, row in zip(p.argmax(axis=1), p, strict=True)]


def readable(text: Column) -> Column:
    """Text that holds no broken characters, as models and offsets need it."""
    return F.make_valid_utf8(text)


def best_alone(candidates: list[tuple[int, int, float]]) -> list[Span]:
    """The most confident first, without overlaps, in order of start."""
    out: list[Span] = []
    for start, end, _ in sorted(candidates, key=lambda c: -c[2]):
        if all(end <= s.start or s.end <= start for s in out):
            out.append(Span("person_name", start, end))
    return sorted(out, key=lambda s: s.start)


Model = Callable[[list[str]], list[list[Span]]]


def plausible_only(model: Model) -> Model:
    """A model whose findings must look like names and are no words of tools; what is left is widened to whole words."""

    def read(texts: list[str]) -> list[list[Span]]:
        kept = ([s for s in found if plausible(t, s) and not tool_vocabulary(t[s.start : s.end])] for t, found in zip(texts, model(texts), strict=True))
        return [completed(t, spans) for t, spans in zip(texts, kept, strict=True)]

    return read


def with_model(texts: DataFrame, model: Callable[[], Model], text: str = "text", out: str = "spans", size: int = 32) -> DataFrame:
    """Distinct texts through a model, loaded once per task, and joined back: equal texts are read once.

    ``model()`` gives a function from at most ``size`` texts to their spans; texts of like length come together, so
    that padding is small. The join is on the digest of the text.
    """
    keyed = texts.withColumn("__h", F.sha2(F.col(text), 256))
    once = keyed.where(F.col(text).isNotNull()).dropDuplicates(["__h"]).select("__h", F.col(text).alias("__t"))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = model()
        for b in sliced(batches):
            all_texts = b.column("__t").to_pylist()
            found: list[list[dict]] = [[]] * len(all_texts)
            order = sorted(range(len(all_texts)), key=lambda i: len(all_texts[i]))
            for some in (order[i : i + size] for i in range(0, len(order), size)):
                for i, spans in zip(some, read([all_texts[i] for i in some]), strict=True):
                    found[i] = [s._asdict() for s in spans]
            yield pa.record_batch([b.column("__h"), pa.array(found, kind)], names=["__h", out])

    found = once.mapInArrow(run, f"__h string, {out} {SPANS}")
    return keyed.join(found, "__h", "left").drop("__h").withColumn(out, F.coalesce(out, F.array().cast(SPANS)))
