"""Adaptive search of one positive setting (L5): tree-structured Parzen estimator with
successive halving.

A round proposes a few values.  The first round draws them log-uniformly; later ones draw
candidates from a density of the better trials' logarithms and keep those where its
ratio to the density of the others is largest.  The values of a round are scored with the
smallest budget, the better half goes on to the next one, and so on.  Scores are
the caller's Spark jobs, one call for all values of a rung, and less is better.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

#: Share of the trials that count as good, and candidates drawn for a proposal.
GOOD_SHARE, CANDIDATES = 0.25, 24


@dataclass
class Trial:
    """A value, the last budget it was scored with, and that score."""

    trial: int
    value: float
    budget: float
    score: float
    best: bool = False


def density(x: np.ndarray, centres: np.ndarray, low: float, high: float) -> np.ndarray:
    """Mean of normal densities around the centres and a uniform one over the range."""
    width = max((high - low) / max(1, len(centres)), 1e-3 * (high - low))
    bumps = np.exp(-0.5 * ((x[:, None] - centres[None]) / width) ** 2) / (width * math.sqrt(2 * math.pi))
    return (bumps.sum(axis=1) + 1.0 / (high - low)) / (len(centres) + 1)


def propose(seen: list[Trial], low: float, high: float, n: int, rng: np.random.Generator) -> list[float]:
    """``n`` values between ``low`` and ``high`` (logarithms inside)."""
    a, b = math.log(low), math.log(high)
    if len(seen) < 4:
        return np.clip(np.exp(rng.uniform(a, b, n)), low, high).tolist()
    # a larger budget outranks a smaller one; within a budget the lower score is better
    order = sorted(seen, key=lambda t: (-t.budget, t.score, t.trial))
    n_good = max(2, math.ceil(GOOD_SHARE * len(seen)))
    good, rest = (np.log([t.value for t in part]) for part in (order[:n_good], order[n_good:]))
    out = []
    for _ in range(n):
        width = (b - a) / len(good)
        x = np.clip(rng.choice(good, CANDIDATES) + width * rng.standard_normal(CANDIDATES), a, b)
        x[-CANDIDATES // 6:] = rng.uniform(a, b, CANDIDATES // 6)
        gain = density(x, good, a, b) / density(x, np.append(rest, out), a, b)
        out.append(float(x[int(np.argmax(gain))]))
    return np.clip(np.exp(out), low, high).tolist()


def tune(score: Callable[[list[float], float], list[float]], low: float, high: float, n_trials: int, seed: int = 42,
         budgets: tuple[float, ...] = (1.0,), per_round: int = 4) -> list[Trial]:
    """All trials in order; ``best`` marks the lowest score among those of the full budget,
    the earlier one of equals.  ``score(values, budget)`` returns a score for each value."""
    rng = np.random.default_rng(seed)
    trials: list[Trial] = []
    while len(trials) < n_trials:
        values = propose(trials, low, high, min(per_round, n_trials - len(trials)), rng)
        alive = [Trial(len(trials) + i, v, 0.0, math.inf) for i, v in enumerate(values)]
        trials += alive
        for budget in budgets:
            for t, s in zip(alive, score([t.value for t in alive], budget)):
                t.budget, t.score = budget, float(s)
            if budget != budgets[-1]:
                alive = sorted(alive, key=lambda t: (t.score, t.trial))[:max(1, math.ceil(len(alive) / 2))]
    full = [t for t in trials if t.budget == budgets[-1]]
    min(full, key=lambda t: (t.score, t.trial)).best = True
    return trials
