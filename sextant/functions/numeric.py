"""Small numpy functions of the optimiser, each over a whole batch of scenarios."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


class Stream:
    """The 32-bit generator that seeds every simulation (mulberry32), drawn in blocks.

    The state grows by a constant per draw, so a block of draws is one array.
    """

    # Increment and shifts of the generator.
    STEP = 0x6D2B79F5
    SHIFTS = (15, 7, 14)

    def __init__(self, seed: int, block: int = 4096):
        self.state, self.block = seed & 0xFFFFFFFF, block
        self.ready: Iterator[float] = iter(())

    def draws(self, count: int) -> np.ndarray:
        state = (self.state + self.STEP * np.arange(1, count + 1, dtype=np.uint64)).astype(np.uint32)
        self.state = int(state[-1]) if count else self.state
        a, b, c = (np.uint32(s) for s in self.SHIFTS)
        t = (state ^ (state >> a)) * (state | np.uint32(1))
        t = t ^ (t + (t ^ (t >> b)) * (t | np.uint32(61)))
        return (t ^ (t >> c)) / 4294967296.0

    def __next__(self) -> float:
        for value in self.ready:
            return value
        self.ready = iter(self.draws(self.block).tolist())
        return next(self.ready)


def project(v: np.ndarray, floor: float, cap: float) -> np.ndarray:
    """Rows of ``v`` moved to the nearest point with sum 1 inside the box.

    The clipped sum falls in straight pieces as the shift grows: a Newton step ends
    on the right piece, and a halving of the bracket replaces one that leaves it.
    """
    lo, hi = v.min(axis=-1) - cap, v.max(axis=-1) - floor
    shift = (lo + hi) / 2
    for _ in range(100):
        moved = v - shift[..., None]
        excess = np.clip(moved, floor, cap).sum(axis=-1) - 1
        if (np.abs(excess) < 1e-10).all():
            break
        lo, hi = np.where(excess > 0, shift, lo), np.where(excess <= 0, shift, hi)
        free = ((moved > floor) & (moved < cap)).sum(axis=-1)
        step = shift + excess / np.maximum(free, 1)
        inside = (free > 0) & (step > lo) & (step < hi)
        shift = np.where(np.abs(excess) < 1e-10, shift, np.where(inside, step, (lo + hi) / 2))
    return np.clip(v - shift[..., None], floor, cap)


def max_sharpe(mu: np.ndarray, cov: np.ndarray, rf: float, floor: float, cap: float, iterations: int = 400) -> np.ndarray:
    """Long-only weights of the best Sharpe ratio met by projected gradient ascent.

    ``mu`` is ``(..., k)`` and ``cov`` ``(..., k, k)``; all leading entries ascend at once.
    """
    k = mu.shape[-1]
    floor, cap = min(floor, 1 / k), max(cap, 1 / k)
    w = project(np.full(mu.shape, 1 / k), floor, cap)
    best, best_ratio = w, np.full(mu.shape[:-1], -np.inf)
    rate = 0.1
    for _ in range(iterations):
        risk = np.einsum("...ij,...j->...i", cov, w)
        sigma = np.sqrt(np.maximum(1e-18, (w * risk).sum(axis=-1)))
        excess = (w * mu).sum(axis=-1) - rf
        better = excess / sigma > best_ratio
        best_ratio = np.where(better, excess / sigma, best_ratio)
        best = np.where(better[..., None], w, best)
        slope = mu / sigma[..., None] - risk * (excess / sigma**3)[..., None]
        w = project(w + rate * slope, floor, cap)
        rate *= 0.999
    return best


def portfolio_stats(w: np.ndarray, mu: np.ndarray, cov: np.ndarray, rf: float) -> tuple[float, float, float]:
    """Return, volatility and Sharpe ratio (NaN without volatility) of weights."""
    gain, vol = float(w @ mu), float(np.sqrt(max(0.0, w @ cov @ w)))
    return gain, vol, (gain - rf) / vol if vol > 0 else float("nan")


def bootstrap_blocks(rows: int, length: int, mean_block: float, scenarios: int, stream: Stream) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The blocks ``(scenario, first row, rows)`` of stationary bootstraps, circular and of geometric length.

    Each sample goes on until it has ``length`` rows, its last block cut there, and the
    next one draws on from the same stream.
    """
    if not rows or not length:
        return np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
    first, size, ends = np.zeros(0, np.int64), np.zeros(0, np.int64), []
    begin = 0
    while len(ends) < scenarios:
        at = np.searchsorted(np.cumsum(size[begin:]), length)
        if begin + at >= len(size):
            u, v = stream.draws(2 * max(1024, scenarios)).reshape(-1, 2).T
            first = np.append(first, (u * rows).astype(np.int64))
            size = np.append(size, np.maximum(1, np.floor(-mean_block * np.log(1 - v) + 0.5)).astype(np.int64))
            continue
        begin += int(at) + 1
        ends.append(begin)
    scenario = np.repeat(np.arange(scenarios, dtype=np.int32), np.diff([0, *ends]))
    first, size = first[:begin], size[:begin]
    before = np.cumsum(size) - size
    inside = before - before[np.array([0, *ends[:-1]])][scenario]
    return scenario, first, np.minimum(size, length - inside)


def bootstrap_indices(rows: int, length: int, mean_block: float, stream: Stream) -> np.ndarray:
    """Row numbers of one sample of ``bootstrap_blocks``."""
    _, first, size = bootstrap_blocks(rows, length, mean_block, 1, stream)
    return np.concatenate([np.arange(a, a + n) % rows for a, n in zip(first.tolist(), size.tolist(), strict=True)])
