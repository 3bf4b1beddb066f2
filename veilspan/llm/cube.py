"""The flight phase of the cube method: balanced sampling by walking in the null space of the balancing constraints.

Units have inclusion probabilities and two balancing variables (a size, and 1 for the count). As long as three units
are undecided, there is a direction in which both totals stay as they are; walking along it until one unit reaches 0
or 1 decides at least one unit a step. At most two units stay undecided.
"""

from __future__ import annotations

import numpy as np

_NEAR = 1e-9


def flight(p: np.ndarray, sizes: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Probabilities after the flight: 0 or 1 but for at most two; sums of p and of p * sizes are kept."""
    p = p.astype(float).copy()
    open_ = [i for i in range(len(p)) if _NEAR < p[i] < 1 - _NEAR]
    p[p <= _NEAR] = 0.0
    p[p >= 1 - _NEAR] = 1.0
    draws = iter(rng.random(len(open_) + 1).tolist())
    hand: list[int] = []
    values, weights = p.tolist(), sizes.astype(float).tolist()
    for i in open_:
        hand.append(i)
        while len(hand) == 3:
            a, b, c = hand
            x, y, z = weights[a], weights[b], weights[c]
            # the null space of ((x, y, z), (1, 1, 1)); equal sizes leave a wider one, of which one direction serves
            u = (y - z, z - x, x - y)
            if abs(u[0]) + abs(u[1]) + abs(u[2]) < 1e-12:
                u = (1.0, -1.0, 0.0)
            up = down = float("inf")
            for k, d in zip(hand, u, strict=True):
                v = values[k]
                if d > 0:
                    up, down = min(up, (1 - v) / d), min(down, v / d)
                elif d < 0:
                    up, down = min(up, v / -d), min(down, (1 - v) / -d)
            step = up if next(draws, 0.5) * (up + down) < down else -down
            left = []
            for k, d in zip(hand, u, strict=True):
                v = values[k] + step * d
                if v <= _NEAR:
                    values[k] = 0.0
                elif v >= 1 - _NEAR:
                    values[k] = 1.0
                else:
                    values[k] = v
                    left.append(k)
            if len(left) == 3:  # rounding kept all three off their ends: the nearest one is there
                k = min(left, key=lambda i: min(values[i], 1 - values[i]))
                values[k] = float(values[k] > 0.5)
                left.remove(k)
            hand = left
    return np.array(values)


def landing(p: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Decides the last units of one source by one draw: their probabilities are laid end to end, and every unit that holds a
    point of the grid with this start and step 1 is taken. So each is taken with its probability, and their number is the
    rounded sum, up or down; the totals of sizes are kept in expectation.
    """
    edges = np.concatenate([[0.0], np.cumsum(np.where((p > _NEAR) & (p < 1 - _NEAR), p, 0.0))])
    hit = np.floor(edges - rng.random() + 1)
    return np.where((p > _NEAR) & (p < 1 - _NEAR), np.diff(hit), np.round(p))
