"""Parameters of screens, weights and backtests."""

from __future__ import annotations

from dataclasses import dataclass, field

DAILY, MONTHLY = 252, 12
YEAR_SECONDS = 365 * 86_400


@dataclass(frozen=True)
class ScreenParams:
    """Thresholds of the screen; 0 counts as not given for ``min_years`` (20) and ``top_n`` (all)."""

    min_years: float = 15
    tolerance_5y: float = -0.05
    min_r2: float = 0.90
    min_cagr: float | None = 0.10
    max_drawdown: float | None = -0.45
    top_n: int = 20
    sort_by: str = "quality"
    ppy: int = DAILY
    #: Stored rows have null for an undefined metric, which the explorer reads as 0.
    undefined_as_zero: bool = False

    def least_points(self) -> int:
        """Points a series must have; halves round up."""
        return int((self.min_years or 20) * (self.ppy or DAILY) + 0.5)


@dataclass(frozen=True)
class WeightParams:
    floor: float = 0.02
    cap: float = 0.20
    rf: float = 0.03
    scenarios: int = 500
    window_years: float = 5
    mean_block: float = 21
    iterations: int = 250
    #: 0 counts as not given.
    seed: int = 42
    ppy: int = DAILY

    def window(self, rows: int) -> int:
        return min(rows, int((self.window_years or 5) * (self.ppy or DAILY) + 0.5))


@dataclass(frozen=True)
class Mode:
    """What differs between the daily batch and the monthly explorer."""

    name: str
    ppy: int
    weights: WeightParams
    #: Fewest aligned returns for a portfolio, and aligned points for a backtest.
    least_returns: int
    least_points: int
    oos_years: int = 7
    oos_min_years: int = 12


BATCH = Mode("batch", DAILY, WeightParams(), least_returns=252, least_points=30)
LIVE = Mode("live", MONTHLY, WeightParams(scenarios=150, mean_block=3, ppy=MONTHLY), least_returns=1, least_points=6)

SCHEMES = ("equal", "invvol", "resampled")
EXPLORER = ScreenParams(undefined_as_zero=True)


@dataclass(frozen=True)
class Universe:
    """A named set of symbols and where its list comes from."""

    id: str
    label: str
    benchmark: str
    source: str | None = None
    text_sources: tuple[str, ...] = ()
    tickers: tuple[str, ...] = field(default=())
