"""Run configuration: dataclasses read from YAML."""

from __future__ import annotations

from dataclasses import dataclass, field, fields
from pathlib import Path
from typing import Any

FILL_MODELS = ("naive", "top_of_book", "full_depth")


@dataclass
class BacktestConfig:
    initial_cash: float = 100_000.0
    fill_model: str = "top_of_book"
    slippage: dict[str, float] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.fill_model not in FILL_MODELS:  # an unknown model falls back
            self.fill_model = "top_of_book"

    def coefficient(self, symbol: str) -> float:
        return self.slippage.get(symbol, 0.0)


@dataclass
class BlendConfig:
    weights: dict[str, float] = field(default_factory=dict)
    min_weight: float = 0.0
    max_weight: float = 1.0

    def __post_init__(self) -> None:
        total = sum(self.weights.values())
        if self.weights and abs(total - 1) > 1e-6 and total:
            self.weights = {k: v / total for k, v in self.weights.items()}


@dataclass
class OptimizerConfig:
    gamma: float = 0.01
    max_gross: float = 2.0
    max_beta: float = 0.0
    tolerance: float = 1e-6
    max_iterations: int = 1000
    risk_aversion: float = 0.0
    market_vol: float = 0.0


@dataclass
class StrategyConfig:
    name: str = "sma"
    short: int = 20
    long: int = 50
    rebalance_time: str = "15:45"
    min_dollar: float = 50.0

    def rebalance_minute(self) -> int:
        h, m = self.rebalance_time.split(":")
        if not (0 <= int(h) < 24 and 0 <= int(m) < 60):
            raise ValueError(f"no time of day: {self.rebalance_time}")
        return int(h) * 60 + int(m)


def read(kind: type, source: str | Path | dict[str, Any]) -> Any:
    """A config of the given kind from a mapping or YAML file; unknown keys are ignored."""
    if not isinstance(source, dict):
        import yaml

        source = yaml.safe_load(Path(source).read_text()) or {}
    names = {f.name for f in fields(kind)}
    return kind(**{k: v for k, v in source.items() if k in names})
