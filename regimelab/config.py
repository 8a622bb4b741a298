"""Fixed values of the study, stated once."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    # They must equal those of the study whose results these are.
    days_a_year: int = 252
    target: str = "SPY"
    core: tuple[str, ...] = ("SPY", "QQQ", "IWM", "^GSPC", "^VIX")
    sectors: tuple[str, ...] = ("XLK", "XLF", "XLE", "XLV", "XLI", "XLY", "XLP", "XLU", "XLB", "XLRE", "XLC")
    extension: tuple[str, ...] = ("TLT", "GLD", "USO", "BTC-USD")
    least_assets: int = 6
    columns: tuple[str, ...] = ("Open", "High", "Low", "Close", "Adj Close", "Volume")
    price_tolerance: float = 1e-6
    extreme_return: float = 0.20
    estimator_window: int = 21
    window: int = 63
    horizons: tuple[int, ...] = (1, 5, 22)
    least_train: int = 750
    refit: int = 21
    garch_refit: int = 63
    event_window: int = 10
    hurst_window: int = 252
    hawkes_window: int = 504
    hawkes_refit: int = 5
    states: int = 3
    bootstrap_draws: int = 500
    bootstrap_block: int = 21
    alarm_quantile: float = 0.90
    alarm_window: int = 504
    lookback: int = 40
    target_vol: float = 0.10
    most_leverage: float = 2.0
    cost: float = 1e-4
    quantiles: int = 5
    z_window: int = 252
    z_least: int = 126

    least_test: int = 250
    placebo_draws: int = 1000
    path_placebo: int = 500
    importance_repeats: int = 10
    trees: int = 300
    hmm_rounds: int = 500
    hmm_rounds_walk_forward: int = 300

    def universe(self, tickers: list[str], sectors: tuple[str, ...] | None = None) -> tuple[list[str], int]:
        """The sectors that are there and the least number of live ones; with too few sectors, all tickers and a lower number."""
        there = [t for t in (self.sectors if sectors is None else sectors) if t in tickers]
        if len(there) >= self.least_assets:
            return there, self.least_assets
        return list(tickers), max(2, min(self.least_assets, len(tickers)))


CONFIG = Config()

# Which mechanism each core feature stands for.
MECHANISMS = {
    "collective behaviour": ("corr_length", "eig_max_frac", "frac_eig_above_mp"),
    "critical slowing down": ("acf1", "var_of_vol", "susceptibility"),
    "self-excitation": ("hawkes_branching",),
    "changing disorder": ("entropy_eigen", "entropy_returns"),
    "composite": ("criticality",),
}
CORE_FEATURES = tuple(f for names in MECHANISMS.values() for f in names)
AUXILIARY_FEATURES = ("hurst_vol", "temperature")

# Names of feature columns, of models and of sets of features, as in the study's tables.
PHYSICS = ("corr_length", "eig_max_frac", "entropy_eigen", "frac_eig_above_mp", "entropy_returns", "temperature", "susceptibility", "acf1", "var_of_vol", "hurst_vol", "hawkes_branching", "criticality")
HAR = ("rv_d", "rv_w", "rv_m")
VIX = "log_vix"
COMPARED = (("HAR+Phys", "HAR"), ("HAR+VIX+Phys", "HAR+VIX"))
WARNING_SETS = {"vol_only": ("vol",), "criticality": ("criticality",), "crit+vol": ("criticality", "vol"), "crit+hawkes+vol": ("criticality", "hawkes_branching", "vol")}
EVENT_SIGNALS = ("criticality", "hawkes_branching", "corr_length", "entropy_eigen", "realized_vol", "VIX")
LEAD_SIGNALS = ("realized_vol", "VIX", "criticality", "hawkes_branching", "crit+VIX")
CHANCE = "(chance)"
