"""Search of settings by tree-structured Parzen estimators.

After some random draws the tries are split into the better and the other ones. Each
setting has a density of either: a mixture of normal curves around the tried values, each
as wide as the way to its neighbours, and one over the whole range. Candidates are drawn
from the better tries' density, and the one that is likeliest there in proportion to the
others is tried next.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from math import erf, sqrt

import numpy as np


@dataclass(frozen=True)
class Range:
    """A setting between two ends, both included: whole numbers or not, on a logarithmic scale or not."""

    lo: float
    hi: float
    whole: bool = False
    log: bool = False

    def inner(self, value: float) -> float:
        return float(np.log(value)) if self.log else float(value)

    def ends(self) -> tuple[float, float]:
        """The ends on the inner scale; whole numbers have half a step around them."""
        margin = 0.5 if self.whole else 0.0
        return self.inner(max(self.lo - margin, self.lo / 2) if self.log else self.lo - margin), self.inner(self.hi + margin)

    def outer(self, x: float) -> float | int:
        value = float(np.exp(x)) if self.log else x
        value = min(max(value, self.lo), self.hi)
        return int(min(max(round(value), self.lo), self.hi)) if self.whole else value


# The ranges that boosted trees are searched in, by what MLlib calls the settings.
# Fewer rounds than the 1,000 to 5,000 of other libraries' ranges have to be asked for by ``SPACE | {...}``.
SPACE: dict[str, Range] = {
    "rounds": Range(1000, 5000, whole=True),
    "step": Range(0.005, 0.2, log=True),
    "depth": Range(3, 10, whole=True),
    "least_rows": Range(1, 10, whole=True),
    "rows_share": Range(0.5, 1.0),
    "features_share": Range(0.5, 1.0),
    "least_gain": Range(1e-8, 5.0, log=True),
}


def _normal(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.vectorize(erf)(x / sqrt(2)))


class Parzen:
    """A density over a range from the values of some tries."""

    def __init__(self, values: list[float], space: Range) -> None:
        self.lo, self.hi = space.ends()
        at = np.sort(np.array([space.inner(v) for v in values], float))
        edges = np.concatenate([[self.lo], at, [self.hi]])
        wide = np.maximum(edges[1:-1] - edges[:-2], edges[2:] - edges[1:-1])
        span = self.hi - self.lo
        self.middle = np.append(at, (self.lo + self.hi) / 2)
        self.width = np.append(np.clip(wide, span / min(100, 1 + 4 * len(at)), span), span)
        self.mass = _normal((self.hi - self.middle) / self.width) - _normal((self.lo - self.middle) / self.width)

    def draw(self, random: np.random.Generator, n: int) -> np.ndarray:
        out = np.empty(0)
        while len(out) < n:
            k = random.integers(0, len(self.middle), 4 * n)
            x = random.normal(self.middle[k], self.width[k])
            out = np.concatenate([out, x[(x >= self.lo) & (x <= self.hi)]])
        return out[:n]

    def log_density(self, x: np.ndarray) -> np.ndarray:
        z = (x[:, None] - self.middle) / self.width
        return np.log((np.exp(-z * z / 2) / (sqrt(2 * np.pi) * self.width * self.mass)).mean(axis=1) + 1e-300)


Try = tuple[dict[str, float | int], float]


def suggest(tries: list[Try], space: dict[str, Range], random: np.random.Generator, at_random: int = 10, share: float = 0.25, candidates: int = 24) -> dict[str, float | int]:
    """The settings to try next, given those tried and what they scored (larger is better)."""
    if len(tries) < at_random:
        return {n: r.outer(random.uniform(*r.ends())) for n, r in space.items()}
    ordered = [s for s, _ in sorted(tries, key=lambda t: -t[1])]
    cut = max(1, min(25, int(np.ceil(share * sqrt(len(ordered)) * 2))))
    out = {}
    for name, r in space.items():
        good, rest = (Parzen([s[name] for s in part], r) for part in (ordered[:cut], ordered[cut:]))
        x = good.draw(random, candidates)
        out[name] = r.outer(float(x[np.argmax(good.log_density(x) - rest.log_density(x))]))
    return out


def search(score: Callable[[dict[str, float | int]], float], space: dict[str, Range], tries: int = 20, seed: int = 42, at_random: int = 10, together: Callable[[list[dict[str, float | int]]], list[float]] | None = None) -> list[Try]:
    """All tries in order; the same seed gives the same ones.

    ``together``, if there is one, scores the random tries, which do not wait for each other, at once.
    """
    random = np.random.default_rng(seed)
    drawn = [suggest([], space, random, at_random) for _ in range(min(tries, at_random))]
    done = list(zip(drawn, map(float, together(drawn) if together else map(score, drawn)), strict=True))
    for _ in range(len(done), tries):
        settings = suggest(done, space, random, at_random)
        done.append((settings, float(score(settings))))
    return done
