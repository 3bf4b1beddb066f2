"""A minimal acyclic transducer from words to lists of numbers, kept in one memory-mapped file.

Words are byte strings. States with the same continuations are one state, so that stems share their endings. Every
transition carries the number of words that sort before it below its state; the sum along a path is the place of the
word among all, which indexes the outputs. Look-up is vectorised over many words at once.
"""

from __future__ import annotations

import io
from collections.abc import Mapping, Sequence

import numpy as np


def compiled(entries: Mapping[bytes, Sequence[int]]) -> bytes:
    """The file of a lexicon; the empty word may not be an entry."""
    words = sorted(entries)
    register: dict[tuple, int] = {}
    rows: list[tuple[bool, tuple]] = []  # per frozen state: (ends a word, ((label, target), ...))
    path: list[tuple[list, bool]] = [([], False)]  # of the last word: (transitions with frozen targets, ends)

    def frozen(node: tuple[list, bool]) -> int:
        key = (node[1], tuple(node[0]))
        if key not in register:
            register[key] = len(rows)
            rows.append(key)
        return register[key]

    last = b""
    for word in [*words, b""]:
        same = 0
        while same < min(len(word), len(last)) and word[same] == last[same]:
            same += 1
        while len(path) > same + 1:
            node = path.pop()
            path[-1][0].append((last[len(path) - 1], frozen(node)))
        for _ in word[same:]:
            path.append(([], False))
        if word:
            path[-1] = (path[-1][0], True)
        last = word
    root = frozen(path[0])
    below: list[int] = []  # words from a state on; targets are always frozen before their sources
    for ends, moves in rows:
        below.append(ends + sum(below[t] for _, t in moves))
    keys, targets, before = [], [], []
    for state, (ends, moves) in enumerate(rows):
        n = int(ends)
        for label, target in moves:
            keys.append(state << 8 | label)
            targets.append(target)
            before.append(n)
            n += below[target]
    sizes = [len(entries[w]) for w in words]
    out = io.BytesIO()
    parts = [
        np.array([root, len(rows), len(keys), len(words), sum(sizes)], dtype=np.int64),
        np.array(keys, dtype=np.int64), np.array(targets, dtype=np.int32), np.array(before, dtype=np.int32),
        np.array([e for e, _ in rows], dtype=np.int8), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32),
        np.array([i for w in words for i in entries[w]], dtype=np.int32),
    ]
    for part in parts:
        out.write(part.tobytes())
        out.write(bytes(-out.tell() % 8))
    return out.getvalue()


class Lexicon:
    """A compiled lexicon, read from a memory-mapped file."""

    def __init__(self, path: str) -> None:
        data = np.memmap(path, dtype=np.uint8, mode="r")
        at = 0

        def take(kind: type, n: int) -> np.ndarray:
            nonlocal at
            part = data[at : at + n * np.dtype(kind).itemsize].view(kind)
            at += -(-part.nbytes // 8) * 8
            return part

        self.root, states, moves, words, outputs = (int(x) for x in take(np.int64, 5))
        self.keys, self.targets, self.before = take(np.int64, moves), take(np.int32, moves), take(np.int32, moves)
        self.ends, self.offsets, self.outputs = take(np.int8, states), take(np.int32, words + 1), take(np.int32, outputs)

    def places(self, words: Sequence[bytes]) -> np.ndarray:
        """The place of each word among the entries; -1 for words that are none."""
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        if not len(words) or not len(self.keys):
            return np.full(len(words), -1)
        chars = np.frombuffer(b"".join(words), dtype=np.uint8).astype(np.int64)
        starts = np.cumsum(lengths) - lengths
        state, place = np.full(len(words), self.root, dtype=np.int64), np.zeros(len(words), dtype=np.int64)
        live = np.flatnonzero(lengths > 0)
        place[lengths == 0] = -1
        step = 0
        while len(live):
            key = state[live] << 8 | chars[starts[live] + step]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            there = self.keys[at] == key
            place[live[~there]] = -1
            live, at = live[there], at[there]
            state[live] = self.targets[at]
            place[live] += self.before[at]
            step += 1
            over = lengths[live] == step
            done = live[over]
            place[done[self.ends[state[done]] == 0]] = -1
            live = live[~over]
        return place

    def output(self, place: int) -> tuple[int, ...]:
        return tuple(self.outputs[self.offsets[place] : self.offsets[place + 1]].tolist())
