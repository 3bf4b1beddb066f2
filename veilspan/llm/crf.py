"""A linear-chain conditional random field over sparse features: exact training by gradient, Viterbi decoding.

Three labels: outside, first token of a span, further token of a span.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

LABELS = ("O", "B", "I")
_NEVER = -1e4


class Crf:
    """Weights of features by label and of label pairs."""

    def __init__(self, weights: dict[str, tuple[float, float, float]], moves: list[list[float]], starts: list[float]) -> None:
        self.weights, self.moves, self.starts = weights, moves, starts

    def decode(self, tokens: Sequence[Sequence[str]]) -> list[int]:
        """The most probable label of every token, given the features of each."""
        get, moves = self.weights.get, self.moves
        (a0, a1, a2), (b0, b1, b2), (c0, c1, c2) = moves
        back: list[tuple[int, int, int]] = []
        x, y, z = self.starts
        first = True
        for features in tokens:
            o = b = i = 0.0
            for f in features:
                w = get(f)
                if w is not None:
                    o += w[0]
                    b += w[1]
                    i += w[2]
            if first:
                x, y, z, first = x + o, y + b, z + i, False
                back.append((0, 0, 0))
                continue
            best, steps = [], []
            for p, q, r, e in ((x + a0, y + b0, z + c0, o), (x + a1, y + b1, z + c1, b), (x + a2, y + b2, z + c2, i)):
                k = (0 if p >= r else 2) if p >= q else (1 if q >= r else 2)
                steps.append(k)
                best.append((p, q, r)[k] + e)
            x, y, z = best
            back.append((steps[0], steps[1], steps[2]))
        if not back:
            return []
        label = max(range(3), key=(x, y, z).__getitem__)
        out = [label]
        for steps_ in reversed(back[1:]):
            label = steps_[label]
            out.append(label)
        return out[::-1]


def _lse(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(a - top).sum(axis=axis))


class _Rows:
    """Rows of similar length as padded arrays."""

    def __init__(self, rows: Sequence[tuple[Sequence[Sequence[str]], Sequence[int]]], index: dict[str, int]) -> None:
        self.n, self.longest = len(rows), max(len(labels) for _, labels in rows)
        gold = np.zeros((self.n, self.longest), dtype=np.int64)
        self.there = np.zeros((self.n, self.longest), dtype=bool)
        features, tokens = [], []
        for r, (found, labels) in enumerate(rows):
            gold[r, : len(labels)] = labels
            self.there[r, : len(labels)] = True
            for t, token in enumerate(found):
                features += [index[f] for f in token]
                tokens += [r * self.longest + t] * len(token)
        self.features, self.tokens = np.array(features), np.array(tokens)
        self.hot = np.eye(len(LABELS))[gold] * self.there[..., None]
        self.pairs = np.einsum("rtk,rtl->kl", self.hot[:, :-1], self.hot[:, 1:])

    def gradient(self, w: np.ndarray, moves: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected minus observed counts of features, label pairs and first labels."""
        n, longest, there, k = self.n, self.longest, self.there, len(LABELS)
        e = np.stack([np.bincount(self.tokens, weights=w[self.features, j], minlength=n * longest) for j in range(k)], axis=1).reshape(n, longest, k)
        alpha, beta = np.zeros((n, longest, k)), np.zeros((n, longest, k))
        alpha[:, 0] = starts + e[:, 0]
        for t in range(1, longest):
            new = _lse(alpha[:, t - 1, :, None] + moves, 1) + e[:, t]
            alpha[:, t] = np.where(there[:, t, None], new, alpha[:, t - 1])
        for t in range(longest - 2, -1, -1):
            new = _lse(moves + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
            beta[:, t] = np.where(there[:, t + 1, None], new, 0)
        z = _lse(alpha[:, -1], 1)
        node = np.exp(alpha + beta - z[:, None, None]) * there[..., None]
        pair = np.exp(alpha[:, :-1, :, None] + moves + (e + beta)[:, 1:, None, :] - z[:, None, None, None]) * there[:, 1:, None, None]
        off = (node - self.hot).reshape(-1, k)
        of_features = np.stack([np.bincount(self.features, weights=off[self.tokens, j], minlength=len(w)) for j in range(k)], axis=1)
        return of_features, pair.sum((0, 1)) - self.pairs, off.reshape(n, longest, k)[:, 0].sum(0)


def train(rows: Sequence[tuple[Sequence[Sequence[str]], Sequence[int]]], steps: int = 100, rate: float = 0.25, decay: float = 1e-4) -> Crf:
    """Fits by full-batch gradient of the penalised likelihood (AdaGrad); the rows are held in memory, so bound them."""
    index: dict[str, int] = {}
    for features, _ in rows:
        for token in features:
            for f in token:
                index.setdefault(f, len(index))
    ordered = sorted((r for r in rows if r[1]), key=lambda r: len(r[1]))
    parts = [_Rows(ordered[i : i + 500], index) for i in range(0, len(ordered), 500)]
    k = len(LABELS)
    w, moves, starts = np.zeros((len(index), k)), np.zeros((k, k)), np.zeros(k)
    banned, start_ban = np.zeros((k, k)), np.array([0, 0, _NEVER])
    banned[0, 2] = _NEVER
    sums = [np.full_like(x, 1e-8) for x in (w, moves, starts)]
    for _ in range(steps):
        grads = [sum(g) / len(ordered) for g in zip(*(p.gradient(w, moves + banned, starts + start_ban) for p in parts), strict=True)]
        grads[0] += decay * w
        grads[1] += decay * moves
        for value, total, grad in zip((w, moves, starts), sums, grads, strict=True):
            total += grad**2
            value -= rate * grad / np.sqrt(total)
    weights = {f: tuple(w[i].tolist()) for f, i in index.items() if np.abs(w[i]).max() > 1e-3}
    return Crf(weights, (moves + banned).tolist(), (starts + start_ban).tolist())
