"""Random numbers that depend only on (seed, step, function, agent, draw).

A draw hashes its coordinates, so it is the same however rows are dealt out and
a task that runs again draws again the same. Streams match other generators in
distribution only.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class AgentRandom:
    """Draws for one function in one step; each call of a method should give its own ``draw``."""

    seed: int
    step: int = 0
    function: str = ""
    id_col: str = "_id"

    def uniform(self, draw: int = 0) -> Column:
        """[0, 1), 53 bits."""
        h = F.xxhash64(F.lit(self.seed), F.lit(self.step), F.lit(self.function), F.col(self.id_col), F.lit(draw))
        return F.shiftrightunsigned(h, 11).cast("double") * F.lit(2.0**-53)

    def uniform_range(self, low: float, high: float, draw: int = 0) -> Column:
        return F.lit(float(low)) + self.uniform(draw) * F.lit(float(high) - float(low))

    def uniform_int(self, low: int, high: int, draw: int = 0) -> Column:
        """Both ends included."""
        return F.least(F.floor(F.lit(low) + self.uniform(draw) * F.lit(high - low + 1)), F.lit(high)).cast("long")

    def normal(self, draw: int = 0) -> Column:
        """Standard normal (Box-Muller); takes draws 2n and 2n + 1 of a stream of its own."""
        first = F.lit(1.0) - self.uniform(1_000_000 + 2 * draw)
        return F.sqrt(F.lit(-2.0) * F.log(first)) * F.cos(F.lit(2 * math.pi) * self.uniform(1_000_001 + 2 * draw))

    def log_normal(self, mean: float, deviation: float, draw: int = 0) -> Column:
        return F.exp(F.lit(float(mean)) + F.lit(float(deviation)) * self.normal(draw))

    def poisson(self, mean: float, draw: int = 0, most: int = 0) -> Column:
        """Inverse of the distribution: the number of cumulated probabilities at or below one draw."""
        if mean > 500:  # beyond, the normal approximation with continuity correction
            return F.greatest(F.lit(0), F.floor(F.lit(mean + 0.5) + F.lit(math.sqrt(mean)) * self.normal(draw))).cast("long")
        most = most or int(mean + 12 * math.sqrt(mean) + 20)
        p, total, steps = math.exp(-mean), 0.0, []
        for k in range(most):
            total += p
            steps.append(total)
            p *= mean / (k + 1)
        u = self.uniform(draw)
        return F.size(F.filter(F.array(*map(F.lit, steps)), lambda c: c <= u)).cast("long")


class HostRandom:
    """The same on the driver."""

    def __init__(self, seed: int):
        self.set_seed(seed)

    def set_seed(self, seed: int) -> None:
        self.seed, self._draw = seed, np.random.Generator(np.random.PCG64(seed))

    def get_seed(self) -> int:
        return self.seed

    def uniform(self, low=None, high=None):
        """[0, 1); or between two numbers, both included if they are integers."""
        if low is None:
            return float(self._draw.random())
        if isinstance(low, int) and isinstance(high, int):
            return int(self._draw.integers(low, high, endpoint=True))
        return float(self._draw.uniform(low, high))

    def normal(self) -> float:
        return float(self._draw.standard_normal())

    def log_normal(self, mean: float, deviation: float) -> float:
        return float(self._draw.lognormal(mean, deviation))

    def poisson(self, mean: float = 1.0) -> int:
        return int(self._draw.poisson(mean))
