"""Problem 7: the corpus as token ids of a public byte-level BPE tokenizer.

Frequent words of the corpus, counted over all its documents, are compiled with their ids into a minimal acyclic
transducer (``lexicon``) that executors memory-map; a task looks up the distinct words of a batch in it at once, and
merges the words it does not hold exactly, by rank. A table of the words seen so far saves repeated look-ups.
"""

from __future__ import annotations

import base64
import heapq
import itertools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.llm.batches import sliced
from veilspan.llm.lexicon import Lexicon, compiled
from veilspan.sources.shared import share_file
from veilspan.sources.tables import table

TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
# Fixed value: the published pattern that cuts a text into pieces, which are then merged apart.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MAX_WORDS = 1 << 16
LEAST_COUNT = 16
SEEN = 400_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def merged(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: again and again the leftmost pair of lowest rank is joined, in O(n log n)."""
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    end, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    gone = bytearray(n)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = after[i] if not gone[i] else n
        if gone[i] or j >= n or end[j] != stop:
            continue
        end[i], after[i], gone[j] = stop, after[j], 1
        if after[i] < n:
            before[after[i]] = i
            if (r := ranks.get(word[i : end[after[i]]])) is not None:
                heapq.heappush(heap, (r, i, end[after[i]]))
        if before[i] >= 0 and (r := ranks.get(word[before[i] : stop])) is not None:
            heapq.heappush(heap, (r, before[i], stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = after[i]
    return out


class Encoder:
    """Pieces of texts to ids, through the lexicon where it holds a piece."""

    def __init__(self, ranks: dict[bytes, int], lexicon: Lexicon | None = None) -> None:
        self.ranks, self.lexicon = ranks, lexicon
        self.pieces = regex.compile(PATTERN).findall
        self.seen: dict[str, tuple[int, ...]] = {}

    def learn(self, pieces: set[str]) -> None:
        new = [p for p in pieces if p not in self.seen]
        if not new:
            return
        if len(self.seen) + len(new) > SEEN:
            self.seen.clear()
            new = list(pieces)
        words = [p.encode() for p in new]
        places = self.lexicon.places(words) if self.lexicon else np.full(len(words), -1)
        for piece, word, place in zip(new, words, places.tolist(), strict=True):
            self.seen[piece] = self.lexicon.output(place) if place >= 0 else tuple(merged(word, self.ranks))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each); null and empty texts have none."""
        cut = [self.pieces(t) if t else () for t in texts]
        self.learn(set().union(*cut))
        get = self.seen.__getitem__
        if len(cut) < 1:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        parts = [np.fromiter(itertools.chain.from_iterable(map(get, c)), dtype=np.int32) for c in cut]
        return np.concatenate(parts), np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))


_ENCODERS: dict[tuple[str, str | None], Encoder] = {}


def _encoder(vocabulary: str, file: str | None) -> Encoder:
    """This worker's encoder, kept between tasks; both files came with the job."""
    key = (vocabulary, file)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(load_ranks(SparkFiles.get(vocabulary)), Lexicon(SparkFiles.get(file)) if file else None)
    return _ENCODERS[key]


def frequent_words(documents: DataFrame, text: str, most: int = MAX_WORDS, least: int = LEAST_COUNT) -> list[str]:
    """The letter runs of all texts that occur ``least`` times or more.

    If these are more than ``most``, the least count rises to the eighth of a power of two at which they are not, so
    that what the driver collects is bounded whatever the corpus and the number of partitions.
    """
    words = documents.select(F.explode(F.split(F.col(text).cast("string"), r"\P{L}+")).alias("w")).where("w <> ''")
    counts = words.groupBy("w").count().where(F.col("count") >= least).withColumn("step", F.floor(8 * F.log2("count")).cast("int")).persist()
    above, floor = 0, -1
    for r in sorted(counts.groupBy("step").agg(F.count("*").alias("words")).collect(), key=lambda r: -r["step"]):  # a few hundred rows at most
        above += r["words"]
        if above > most:
            floor = r["step"]
            break
    out = [r["w"] for r in counts.where(F.col("step") > floor).select("w").collect()]
    counts.unpersist()
    return sorted(out)


def word_lexicon(spark: SparkSession, documents: DataFrame, text: str, vocabulary: str, most: int = MAX_WORDS) -> str:
    """Compiles and shares the transducer of the corpus's frequent words, with and without the blank before them."""
    ranks = load_ranks(vocabulary)
    words = frequent_words(documents, text, most // 2)
    entries = {p.encode(): merged(p.encode(), ranks) for w in words for p in (w, f" {w}")}
    return share_file(spark, compiled(entries), "lexicon")


def encoded(documents: DataFrame, key: str, text: str, tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """``key``, ``ids`` (array<int>) and ``n_ids`` of every row, without special tokens.

    A text that spells a special token is ordinary text. Null, empty: an empty list. Very long
    texts and words are encoded whole; pairs of equal rank are merged from the left. Repeated keys and texts are kept
    row by row; a null key stays null. An empty table gives no rows. Other columns are ignored.
    """
    spark, path = documents.sparkSession, f"{tokenizers}/{vocabulary}"
    with open(path, "rb") as f:
        shipped = share_file(spark, f.read(), "vocabulary")  # only the driver needs the folder
    file = word_lexicon(spark, documents, text, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shipped, file)
        for batch in sliced(batches):
            ids, counts = encoder.encode(batch.column("__text").to_pylist())
            ends = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
            yield pa.record_batch([batch.column(0), pa.ListArray.from_arrays(ends, pa.array(ids)), pa.array(counts)], names=[key, "ids", "n_ids"])

    kind = documents.schema[key].dataType.simpleString()
    rows = documents.select(F.col(key), F.col(text).cast("string").alias("__text"))
    return rows.mapInArrow(run, f"`{key}` {kind}, ids array<int>, n_ids long")


def p7_ids(spark: SparkSession, directory: str) -> DataFrame:
    """Token ids of every document."""
    return encoded(table(spark, directory, "documents", "doc_id", "text"), "doc_id", "text").drop("n_ids")


QUERIES = {"p7_ids": p7_ids}
