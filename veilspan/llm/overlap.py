"""Problem 1: same or near-same records across splits.

Each text is levelled (case, spacing, punctuation, accents, look-alikes) and gets a similarity hash: its letters are
counted in eight soft sections along the text, and each bit says on which side of a random plane the counts lie. Texts
that agree in four fifths of their characters differ in few bits, since a letter that is lost or moved a little changes
little; other texts of one language differ in about half of them.

Texts of different splits meet on blocks of the hash (``TABLES`` segments of ``BLOCK`` bits each), a pair goes on
if other ``FILTER`` bits lie within the Hamming ``RADIUS`` and the lengths allow four fifths, and the longest common
subsequence confirms it exactly, where that of the fronts of both texts, which bounds it, does not exclude it before.
Pairs of texts under ``LEAST`` characters, whose hashes say little, meet on windows of characters at every position
instead, under 15 characters on their subsequences.

Copies are one class by the digest of their level form, so a text that fills a third of the rows costs one class.
Each side is written once, as packs of about ``HOT`` classes of like length with their bits; every pack of one side
meets every pack of the other whose lengths allow a pair, and blocks, radius and subsequence are seen to inside that
task. Neither codes nor candidates are shuffled, so what is written grows with the input, not with the pairs compared.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.llm.batches import sliced
from veilspan.llm.characters import levels
from veilspan.sources.shared import shared_folder
from veilspan.sources.tables import table

#: (least length of the longer text, length of the windows) of short texts.
GRADES = ((15, 4), (30, 6))
LEAST = 60
SIMILARITY = 0.8
HOT = 4096  # classes of a pack
MOST = 1 << 20  # characters of a pack; a longer text is one alone
AT_ONCE = 1 << 17  # pairs that share a code, looked at together
MOST_MET = 1 << 16  # candidates a task holds at once
SIDE_BY_SIDE = 1 << 13  # characters of the texts compared with one in one go
GROUP, WORTH, LONG = 1 << 20, 128, 1 << 12  # fronts are compared together: characters at most, candidates at least, characters of a text
PLACE = 32  # bits for the place of a text in its pack
TABLES, BLOCK, FILTER, RADIUS = 28, 9, 192, 57
SECTIONS, CLASSES = 8, 64
KEPT = 1 << 18  # classes a task remembers to have met
# How often the letters a to z stand in a thousand characters of French, English and German text.
FREQUENCY = (81, 11, 30, 40, 150, 11, 14, 25, 75, 4, 5, 45, 28, 73, 56, 25, 6, 68, 70, 70, 50, 14, 8, 3, 5, 5)


def digest(text: str) -> int:
    """A signed 64-bit class number of a levelled text."""
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little", signed=True)


@functools.lru_cache(maxsize=1)
def _planes() -> np.ndarray:
    """The planes, in whole numbers: all sums stay under 2**53, so a hash is the same in every task, whatever the batch.

    Each plane sums to nothing over the sections of a letter: how often a text has a letter in all says nothing, so that
    the bits are even whatever the language; where it has it does.
    """
    rates = np.array([f / 1000 for f in FREQUENCY] + [0.004] * 10 + [0.001] * (CLASSES - 36))
    planes = np.random.default_rng(7).normal(size=(FILTER + TABLES * BLOCK, SECTIONS, CLASSES)) * 100 / np.sqrt(rates)
    return np.rint(planes - planes.mean(axis=1, keepdims=True)).reshape(len(planes), -1).T


_LETTERS = np.arange(0x110000, dtype=np.uint32) % (CLASSES - 36) + 36
_LETTERS[ord("a") : ord("z") + 1] = np.arange(26)
_LETTERS[ord("0") : ord("9") + 1] = np.arange(26, 36)


def _classes_of(text: str) -> np.ndarray:
    return _LETTERS[np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)].astype(np.int64)


def hashes(texts: list[str]) -> np.ndarray:
    """Rows of FILTER + TABLES * BLOCK bits of levelled texts that are not empty."""
    lengths = np.array(list(map(len, texts)), dtype=np.int64)
    letters = _classes_of("".join(texts))
    owner = np.repeat(np.arange(len(texts)), lengths)
    at = np.arange(len(letters)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    # sixteenths of a section; what lies between the middles of two sections counts for both
    place = np.clip((2 * at + 1) * SECTIONS * 8 // lengths[owner] - 8, 0, 16 * (SECTIONS - 1))
    low, part = place >> 4, place & 15
    width = SECTIONS * CLASSES
    cell = owner * width + low * CLASSES + letters
    counts = np.bincount(cell, weights=16 - part, minlength=len(texts) * width + CLASSES)
    counts += np.bincount(cell + CLASSES, weights=part, minlength=len(counts))[: len(counts)]
    return counts[: len(texts) * width].reshape(len(texts), width) @ _planes() > 0


def _long(text: str) -> bool:
    """Whether a text can be in a pair whose longer one has ``LEAST`` characters."""
    return len(text) >= SIMILARITY * LEAST


MARKS = ("f", "g", "h")  # the filter bits; of a text on a window: its class, -1 and 0


def all_bits(texts: list[str]) -> np.ndarray:
    """Of long texts: a row of bits each."""
    return np.concatenate([np.zeros((0, FILTER + TABLES * BLOCK), dtype=bool), *(hashes(texts[i : i + 512]) for i in range(0, len(texts), 512))])


def _filter(bits: np.ndarray) -> np.ndarray:
    """A row of numbers that hold the filter bits."""
    return np.packbits(bits[:, :FILTER], axis=1, bitorder="little").view("<i8")


#: Logarithm of the ratio of lengths that a pair may have, with a little to spare, and the buckets of lengths, twice as wide.
_REACH = -math.log(SIMILARITY) * (1 + 1e-9)


def _buckets(length: int, wide: bool) -> range:
    """The bucket of a text of the first side; of the second side, those that hold a partner's."""
    at, reach = math.log(length), _REACH if wide else 0.0
    return range(int((at - reach) // (2 * _REACH)), int((at + reach) // (2 * _REACH)) + 1)


def block_codes(bits: np.ndarray, lengths: np.ndarray, wide: bool) -> tuple[np.ndarray, np.ndarray]:
    """(text index, code) of the blocks of long texts: the bucket of the length, the number of the block and its bits."""
    blocks = np.packbits(bits[:, FILTER:].reshape(-1, TABLES, BLOCK), axis=2, bitorder="little").view("<u2")[:, :, 0].astype(np.int64)
    blocks += np.arange(TABLES) << BLOCK
    at, reach = np.log(lengths), _REACH if wide else 0.0
    low, high = (((at + x) // (2 * _REACH)).astype(np.int64) for x in (-reach, reach))
    owner = np.repeat(np.arange(len(lengths)), high - low + 1)
    bucket = low[owner] + np.arange(len(owner)) - np.searchsorted(owner, owner)
    return np.repeat(owner, TABLES), (blocks[owner] + (bucket[:, None] * TABLES << BLOCK)).ravel()


def window_codes(text: str) -> set[int]:
    """Of a text under ``LEAST`` characters: codes of its windows, or of its subsequences."""
    found = _deletions(text) if len(text) < GRADES[0][0] else set()
    for (least, size), end in zip(GRADES, [*(g for g, _ in GRADES[1:]), LEAST], strict=True):
        # The longer text of a pair has the length of the grade, the shorter one at least SIMILARITY times that.
        if SIMILARITY * least <= len(text) < end:
            found |= {digest(text[j : j + size]) for j in range(len(text) - size + 1)}
    return found


def _deletions(text: str) -> set[int]:
    """Codes of the subsequences that a text shares with every one it agrees with in four fifths, for very short texts."""
    most = GRADES[0][0] - 1
    sizes = {math.ceil(SIMILARITY * n) for n in range(len(text), most + 1) if len(text) >= SIMILARITY * n}
    return {digest("".join(x)) for size in sizes for x in itertools.combinations(text, size)}


def _new(flats: list[str], seen: set[int]) -> list[str]:
    """The texts a task meets for the first time; once it has met ``KEPT`` of them, it starts anew."""
    new = []
    for t in flats:
        c = digest(t)
        if c not in seen:
            if len(seen) >= KEPT:
                seen.clear()
            seen.add(c)
            new.append(t)
    return new


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, 1 << 20):
        for at in range(0, batch.num_rows, 2048):
            yield batch.slice(at, 2048)


def _windows(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text index, code) of the windows of short texts."""
    found = np.array([(i, c) for i, t in enumerate(texts) if len(t) < LEAST for c in sorted(window_codes(t))], dtype=np.int64).reshape(-1, 2)
    return found[:, 0], found[:, 1]


def keys_of(texts: list[str], wide: bool) -> tuple[np.ndarray, np.ndarray]:
    """(codes, marks) of levelled texts that are not empty: the marks are the filter bits or, beside a window, the class, -1 and 0."""
    long = [t for t in texts if _long(t)]
    bits = all_bits(long)
    owner, code = block_codes(bits, np.array(list(map(len, long)), dtype=np.int64), wide)
    at, window = _windows(texts)
    beside = np.array([(digest(texts[i]), -1, 0) for i in at.tolist()], dtype=np.int64).reshape(-1, len(MARKS))
    return np.concatenate([code, window]), np.concatenate([_filter(bits)[owner], beside])


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Class of every row with a text."""
    for batch in _parts(batches):
        rows = [(i, digest(t)) for i, t in zip(batch.column("id").to_pylist(), levels(batch.column("text").to_pylist()), strict=True) if t]
        yield pa.record_batch([pa.array([i for i, _ in rows], pa.string()), pa.array([c for _, c in rows], pa.int64())], names=["id", "cls"])


def _flats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Level forms, where a task meets them for the first time."""
    seen: set[int] = set()
    for batch in _parts(batches):
        yield pa.record_batch([pa.array(_new([t for t in levels(batch.column("text").to_pylist()) if t], seen), pa.string())], names=["flat"])


PACKS = "low int, high int, texts binary, bits binary"


def _pack(texts: list[str]) -> pa.RecordBatch:
    texts = sorted(texts, key=len)
    bits = np.packbits(all_bits([t for t in texts if _long(t)]), axis=1)
    row = (len(texts[0]), len(texts[-1]), zlib.compress("\n".join(texts).encode(), 1), bits.tobytes())
    return pa.record_batch([pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["low", "high", "texts", "bits"])


def _packs(most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Distinct level forms with their bits, in packs of up to ``most`` texts of one bucket of lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[int, list[str]] = {}
        held: Counter = Counter()
        for batch in _parts(batches):
            for t in batch.column("flat").to_pylist():
                at = _buckets(len(t), False)[0]
                open_.setdefault(at, []).append(t)
                held[at] += len(t)
                if len(open_[at]) >= most or held[at] >= MOST:
                    yield _pack(open_.pop(at))
                    del held[at]
        yield from map(_pack, open_.values())

    return run


class Pack(NamedTuple):
    """A pack as a task reads it: texts by length, filter bits a word at a time, block codes above the places of their texts, windows."""

    flats: list[str]
    lengths: np.ndarray
    words: np.ndarray
    blocks: np.ndarray
    windows: tuple[np.ndarray, np.ndarray]


@functools.lru_cache(maxsize=24)
def _unpacked(texts: bytes, bits: bytes, wide: bool) -> Pack:
    flats = zlib.decompress(texts).decode().split("\n")
    lengths = np.array(list(map(len, flats)), dtype=np.int64)
    n = FILTER + TABLES * BLOCK
    rows = np.unpackbits(np.frombuffer(bits, np.uint8).reshape(-1, (n + 7) // 8), axis=1, count=n)
    short = len(flats) - len(rows)
    owner, codes = block_codes(rows, lengths[short:], wide)
    words = np.zeros((FILTER // 64, len(flats)), dtype=np.uint64)
    words[:, short:] = _filter(rows).T.view(np.uint64)
    at, window = _windows(flats[: np.searchsorted(lengths, LEAST)])
    order = np.argsort(window, kind="stable")
    return Pack(flats, lengths, words, np.sort((codes << PLACE) + short + owner), (at[order], window[order]))


def _able(x: Pack, y: Pack) -> tuple[np.ndarray, np.ndarray]:
    """For each text of ``x`` the first place in ``y``, and the one after the last, that four fifths allow by length."""
    return np.searchsorted(y.lengths, SIMILARITY * x.lengths, side="left"), np.searchsorted(SIMILARITY * y.lengths, x.lengths, side="right")


def _runs(first: np.ndarray, count: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, first[i] and the ``count[i]`` - 1 numbers after it), about ``AT_ONCE`` at a time."""
    met = np.flatnonzero(count > 0)
    first, count = first[met], count[met]
    ends = np.cumsum(count)
    at = 0
    while at < len(met):
        before = int(ends[at - 1]) if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + AT_ONCE, side="right")))
        n = count[at:stop]
        yield np.repeat(met[at:stop], n), np.arange(int(n.sum())) + np.repeat(first[at:stop] - (ends[at:stop] - n - before), n)
        at = stop


def _meeting(x: Pack, y: Pack) -> tuple[np.ndarray, np.ndarray]:
    """Places (in ``y``, in ``x``), in order, of texts of two packs that share a code, may agree by length and, but for windows, lie within the radius."""
    low, high = _able(x, y)
    out = [np.zeros(0, np.int64)]
    owner = x.blocks & (1 << PLACE) - 1
    some = (low < high)[owner]
    owner, code = owner[some], (x.blocks - owner)[some]
    first = np.searchsorted(y.blocks, code + low[owner])
    for i, j in _runs(first, np.searchsorted(y.blocks, code + high[owner]) - first):
        i, j = owner[i], y.blocks[j] & (1 << PLACE) - 1
        near = sum(np.bitwise_count(a[i] ^ b[j]) for a, b in zip(x.words, y.words, strict=True)) <= RADIUS
        out.append(np.unique(j[near] * len(x.flats) + i[near]))
    (owner, code), (other, codes) = x.windows, y.windows
    first = np.searchsorted(codes, code, side="left")
    for i, j in _runs(first, np.searchsorted(codes, code, side="right") - first):
        i, j = owner[i], other[j]
        able = (low[i] <= j) & (j < high[i])
        out.append(np.unique(j[able] * len(x.flats) + i[able]))
    return np.divmod(np.unique(np.concatenate(out)), len(x.flats))


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Classes of the texts of two packs that agree, equal ones included."""
    met: dict[str, list[str]] = {}
    held = 0
    for batch in batches:
        for at in range(batch.num_rows):
            ta, ba, tb, bb = (batch.column(c)[at].as_py() for c in ("texts_a", "bits_a", "texts_b", "bits_b"))
            x, y = _unpacked(ta, ba, False), _unpacked(tb, bb, True)
            places = np.stack(_meeting(x, y))
            for k in range(0, places.shape[1], MOST_MET):
                part = places[:, k : k + MOST_MET].tolist()
                for j, i in zip(*part, strict=True):
                    met.setdefault(y.flats[j], []).append(x.flats[i])
                held += len(part[0])
                if held > MOST_MET:
                    yield _agreeing(met)
                    met, held = {}, 0
    yield _agreeing(met)


def _agreeing(met: dict[str, list[str]]) -> pa.RecordBatch:
    """Classes of the texts that agree, of the candidates of each text."""
    found = [(digest(a), digest(b)) for b, others in sifted(met).items() for a, k in zip(others, all_alike(b, others), strict=True) if k]
    return pa.record_batch([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])


def sifted(met: dict[str, list[str]], least: float = SIMILARITY) -> dict[str, list[str]]:
    """The candidates of each text without those whose fronts say already that they don't agree with it in ``least`` of the longer one.

    Where a few texts of like length have candidates, or very long ones do, all of them stay.
    """
    out: dict[str, list[str]] = {}
    group: list[tuple[str, list[str]]] = []
    held = 0

    def close() -> None:
        kept = fronts_allow(group, least) if held >= WORTH and len(group[-1][0]) <= LONG else itertools.repeat(True)
        kept = iter(kept)
        for b, others in group:
            if left := list(itertools.compress(others, itertools.islice(kept, len(others)))):
                out.setdefault(b, []).extend(left)
        group.clear()

    for b in sorted(met, key=len):
        step = GROUP // max(1, len(b)) + 1
        for at in range(0, len(met[b]), step):
            part = met[b][at : at + step]
            if group and ((held + len(part)) * len(b) > GROUP or len(b) > 1.1 * len(group[0][0])):
                close()
                held = 0
            group.append((b, part))
            held += len(part)
    close()
    return out


def fronts_allow(group: list[tuple[str, list[str]]], least: float) -> list[bool]:
    """Whether texts and their candidates, pair by pair, may have a common subsequence of ``least`` of the longer one, by that of their fronts.

    Of two texts of n and m characters, none is longer than that of n - m + p characters of the one and p of the other in
    front, and m - p: what it has before and after a place where the rests of both are as long. For the p of all pairs,
    about half a text, this is found as in ``common``, for all pairs at once, by 63 bits of a word. Letters that
    are counted together in ``_LETTERS`` are taken as the same, so that the bound only rises.
    """
    row = np.repeat(np.arange(len(group)), [len(others) for _, others in group])
    n = np.array([len(b) for b, _ in group])[row]
    m = np.array([len(a) for _, others in group for a in others])
    p = int(min(max(n.max() / 2, (m - n).max()), m.min()))
    front = np.clip(p + n - m, 0, n)
    size = int(front.max())
    starts = [b[:size] for b, _ in group]
    lengths = np.array(list(map(len, starts)))
    at = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    cells = np.repeat(np.arange(len(group)) * CLASSES, lengths) + _classes_of("".join(starts))
    where = np.zeros((-(-size // 63), len(group) * CLASSES), dtype=np.uint64)
    np.add.at(where, (at // 63, cells), np.uint64(1) << (at % 63).astype(np.uint64))
    order = np.argsort(-front, kind="stable")  # a word is needed for those in front whose fronts reach it
    base = row[order] * CLASSES
    letters = _classes_of("".join([a[:p] for _, others in group for a in others])).reshape(len(m), p)[order].T
    full, top = np.uint64((1 << 63) - 1), np.uint64(63)
    v = np.full((len(where), len(m)), full)
    cell, u, t, one = np.empty_like(base), *(np.zeros(len(m), dtype=np.uint64) for _ in range(3))
    words = []
    for k, w in enumerate(where):
        c = int((front > 63 * k).sum())
        words.append((w.take, v[k, :c], cell[:c], u[:c], t[:c], one[:c], k > 0, k + 1 < len(where)))
    for letter in np.ascontiguousarray(letters):
        np.add(base, letter, out=cell)
        for take, x, at_, y, z, over, later, more in words:
            take(at_, out=y, mode="clip")
            y &= x
            np.add(x, y, out=z)
            if later:
                z += over  # what is carried from the word before
            if more:
                np.right_shift(z, top, out=over)
            x ^= y
            x |= z
            x &= full
    inside = np.clip(front[order] - 63 * np.arange(len(where))[:, None], 0, 63).astype(np.uint64)
    found = np.empty_like(m)
    found[order] = np.bitwise_count(~v & (np.uint64(1) << inside) - np.uint64(1)).sum(axis=0, dtype=np.int64)
    return (found + m - p >= least * np.maximum(n, m)).tolist()


@functools.lru_cache(maxsize=1 << 13)
def _places(text: str) -> dict[str, int]:
    """Where each character of a text stands, as the bits of a number."""
    where: dict[str, int] = {}
    for i, c in enumerate(text):
        where[c] = where.get(c, 0) | 1 << i
    return where


def common(a: str, b: str, least: float = 0.0) -> int:
    """Length of the longest common subsequence, by bits of one big integer per character; -1 once ``least`` is out of reach."""
    where = _places(a)
    full = (1 << len(a)) - 1
    v = full
    for at in range(0, len(b), 48):
        for c in b[at : at + 48]:
            u = v & where.get(c, 0)
            v = (v + u | v - u) & full
        if len(a) - v.bit_count() + max(0, len(b) - at - 48) < least:
            return -1
    return len(a) - v.bit_count()


def _reach(b: str, others: list[str], least: list[float]) -> list[bool]:
    """For each of ``others`` whether its longest common subsequence with ``b`` has its ``least`` length.

    As in ``common``, with the texts side by side in one integer, a bit free between them for what is carried.
    """
    where: dict[str, int] = {}
    starts, full, at = [], 0, 0
    for t in others:
        starts.append(at)
        for c, bits in _places(t).items():
            where[c] = where.get(c, 0) | bits << at
        full |= (1 << len(t)) - 1 << at
        at += len(t) + 1
    v = full
    for at in range(0, len(b), 48):
        for m in [where[c] for c in b[at : at + 48] if c in where]:
            u = v & m
            v = (v + u | v - u) & full
        rest = max(0, len(b) - at - 48)
        if 2 * rest < len(b):  # before that nothing is decided
            reached = [len(t) - (v >> s & (1 << len(t)) - 1).bit_count() + rest >= x for t, s, x in zip(others, starts, least, strict=True)]
            if not rest or not any(reached):
                return reached
    return [x <= 0 for x in least]  # ``b`` is empty


@functools.lru_cache(maxsize=1 << 14)
def _letters(text: str) -> np.ndarray:
    """How often a text has each letter, rare ones counted together."""
    return np.bincount(_classes_of(text), minlength=CLASSES).astype(np.int32)


def all_alike(b: str, others: list[str], least: float = SIMILARITY) -> list[bool]:
    """Whether levelled texts agree with ``b``, in order, in ``least`` of the characters of the longer one."""
    need = [least * max(len(a), len(b)) for a in others]
    left = [i for i, a in enumerate(others) if 0 < min(len(a), len(b)) >= need[i] and a != b]
    if left:  # no common subsequence holds more of a letter than both texts have
        shared = np.minimum(np.stack([_letters(others[i]) for i in left]), _letters(b)).sum(axis=1)
        left = [i for i, n in zip(left, shared.tolist(), strict=True) if n >= need[i]]
    out = [a == b != "" for a in others]
    step = max(1, SIDE_BY_SIDE // max(1, len(b)))
    for at in range(0, len(left), step):
        part = left[at : at + step]
        for i, k in zip(part, _reach(b, [others[i] for i in part], [need[i] for i in part]), strict=True):
            out[i] = k
    return out


def alike(a: str, b: str, least: float = SIMILARITY) -> bool:
    return all_alike(b, [a], least)[0]


def cross_split_classes(first: DataFrame, second: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links between the text classes of two splits, and the members of the classes.

    Both take ``id`` and ``text``. Returns ``links(a, b)``, classes of the first and of the second split whose level
    forms agree, in order, in at least four fifths of the characters of the longer one, equal classes included, and
    for each split ``(id, cls)``. Null ids, and texts that are null or hold no letter or digit, are in no class.
    Repeated rows add nothing. Empty tables give empty results. Other columns are ignored. Very long texts are compared
    whole: a pair costs time in the product of its lengths over the word size of the machine.
    """
    shared_folder(first.sparkSession)
    sides = [x.select(F.col("id").cast("string").alias("id"), F.col("text").cast("string").alias("text")).where("id is not null and text is not null") for x in (first, second)]
    left, right = (x.select("text").mapInArrow(_flats, "flat string").distinct().mapInArrow(_packs(HOT), PACKS).checkpoint() for x in sides)
    left, right = (x.select(*(F.col(c).alias(f"{c}_{side}") for c in x.columns)) for x, side in ((left, "a"), (right, "b")))
    able = (F.col("high_a") >= F.col("low_b") * (SIMILARITY - 1e-9)) & (F.col("high_b") >= F.col("low_a") * (SIMILARITY - 1e-9))
    # a product that keeps one pack of the second side's partition at hand and sends nothing to the driver
    links = left.join(right.hint("shuffle_replicate_nl"), able).select("texts_a", "bits_a", "texts_b", "bits_b").mapInArrow(_links, "a long, b long")
    return links, *(x.mapInArrow(_classes, "id string, cls long").distinct() for x in sides)


def _sides(spark: SparkSession, directory: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, directory, "quality", "id", "text"), table(spark, directory, "calibration", "id", "text")


def p1_found(spark: SparkSession, directory: str) -> DataFrame:
    """Pairs of one quality and one calibration record with the same or nearly the same text."""
    links, first, second = cross_split_classes(*_sides(spark, directory))
    a, b = first.select(F.col("cls").alias("a"), F.col("id").alias("qid")), second.select(F.col("cls").alias("b"), F.col("id").alias("cid"))
    return links.join(a, "a").join(b, "b").select(F.least("qid", "cid").alias("id_a"), F.greatest("qid", "cid").alias("id_b"))


def p1_report(spark: SparkSession, directory: str) -> DataFrame:
    """Per split and dataset of quality: records, those that overlap with calibration, and their pairs."""
    links, first, second = cross_split_classes(*_sides(spark, directory))
    sizes = second.groupBy(F.col("cls").alias("b")).agg(F.count("*").alias("copies"))
    touched = links.join(sizes, "b").groupBy(F.col("a").alias("cls")).agg(F.sum("copies").alias("pairs"))
    hit = first.join(touched, "cls").groupBy("id").agg(F.sum("pairs").alias("pairs"))
    gold = table(spark, directory, "quality", "id", "split", "dataset").where("id is not null")
    gold = gold.groupBy("id").agg(F.max("split").alias("split"), F.max("dataset").alias("dataset"))
    return (
        gold.join(hit, "id", "left").groupBy("split", "dataset")
        .agg(F.count("*").alias("records"), F.count("pairs").alias("overlapping"), F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"))
    )


QUERIES = {"p1_found": p1_found, "p1_report": p1_report}
