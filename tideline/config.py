"""Typed settings of the four phases; files in YAML, with or without the phase's name as root key."""

from __future__ import annotations

import datetime as dt
from pathlib import Path
from typing import Literal

from pydantic import AliasChoices, BaseModel, Field, field_validator, model_validator

from .models.allocators import Allocator
from .models.states import make_detector


# The windows of stress that reports show by default.
STRESS = {n: tuple(map(dt.date.fromisoformat, days)) for n, days in {"2008 GFC": ("2008-09-01", "2009-03-31"), "2020 COVID": ("2020-02-15", "2020-04-30"), "2022 tightening": ("2022-01-01", "2022-10-31")}.items()}


def iso(value: str | dt.date | None) -> str | None:
    """A date as files give it, quoted or not."""
    return value if value is None else dt.date.fromisoformat(str(value)).isoformat()


def named(default, *others: str, **limits):
    """A setting that files may also give under another name; its own name is the first."""
    return Field(default, validation_alias=AliasChoices(*others), **limits)


class Settings(BaseModel):
    """Settings read from a YAML file."""

    model_config = {"extra": "forbid"}

    @classmethod
    def from_yaml(cls, path: str | Path):
        """FileNotFoundError if path isn't there, ValueError if it is empty."""
        import yaml

        raw = yaml.safe_load(Path(path).read_text())
        if not raw:
            raise ValueError(f"{path} is empty")
        return cls.model_validate(raw.get(cls.__name__.lower(), raw))


class Asset(BaseModel):
    ticker: str
    name: str = named("", "name", "description")
    inception: str | None = named(None, "inception", "approx_inception")
    _iso = field_validator("inception", mode="before")(iso)


class Series(BaseModel):
    id: str
    name: str = named("", "name", "description")
    optional: bool = False


class Windows(BaseModel):
    volatility_short: int = Field(21, ge=5)
    volatility_long: int = Field(63, ge=21)
    correlation: int = Field(63, ge=21)
    drawdown: int = Field(252, ge=63)


class Least(BaseModel):
    """Values that a window needs."""

    volatility: int = Field(15, ge=1)
    correlation: int = Field(30, ge=1)


def flat(raw: dict) -> dict:
    """Settings given in sections (universe, dates, sources, calendar, features, logging) as flat ones. Sections on downloads, folders and caches don't apply here."""
    universe, dates, calendar, features = (raw.get(k) or {} for k in ("universe", "dates", "calendar", "features"))
    prices, macro = ((raw.get("sources") or {}).get(k) or {} for k in ("prices", "macro"))
    rows = lambda items, key: [{key: k, **(v or {})} for k, v in items.items()]
    out = {"assets": rows(universe.get("assets") or {}, "ticker"), "series": rows(macro.get("series") or {}, "id"), "start": dates.get("start_date"), "end": dates.get("end_date")}
    out |= {"exchange": universe.get("exchange")} | {k: v for k, v in calendar.items() if k in Data.model_fields} | {k: v for k, v in features.items() if k in Data.model_fields}
    out |= {"price_column": prices.get("price_column"), "log_level": (raw.get("logging") or {}).get("level")}
    return {k: v for k, v in out.items() if v is not None}


class Data(Settings):
    assets: list[Asset] = []
    series: list[Series] = []
    start: str | None = None
    end: str | None = None
    exchange: str = "NYSE"
    price_column: str = "price"
    price_forward_fill: bool = False
    macro_max_staleness_days: int = Field(5, ge=1, le=30)
    windows: Windows = Windows()
    min_periods: Least = Least()
    correlation_exclude: list[str] = []
    trading_days_per_year: int = Field(252, ge=200, le=260)
    log_level: str = "INFO"

    @model_validator(mode="before")
    @classmethod
    def sections(cls, raw):
        return flat(raw) if isinstance(raw, dict) and "universe" in raw else raw

    _iso = field_validator("start", "end", mode="before")(iso)

    @field_validator("log_level")
    @classmethod
    def known_level(cls, value: str) -> str:
        if value.upper() not in ("DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL"):
            raise ValueError(f"unknown log level {value}")
        return value.upper()

    @property
    def tickers(self) -> list[str]:
        return [a.ticker for a in self.assets]

    @property
    def required_series(self) -> list[str]:
        return [s.id for s in self.series if not s.optional]


class Detection(Settings):
    """features: columns of the feature matrix; empty: the mean volatilities, mean fall and mean correlation of all assets."""

    method: str = "hmm"
    n_states: int = Field(3, ge=2, le=5)
    features: list[str] = []
    severity_features: list[str] = []
    min_train: int = Field(252, ge=30)
    refit_every: int = Field(63, ge=1)
    zscore_min_periods: int = named(60, "zscore_min_periods", "standardize_min_periods", ge=2)
    seed: int = named(42, "seed", "random_state")
    severity: list[int] | None = None
    covariance_type: str = "diag"
    n_iter: int = Field(100, ge=1)
    tol: float = Field(1e-4, gt=0)
    restarts: int = named(8, "restarts", "n_restarts", ge=1)
    min_covar: float = Field(1e-3, ge=0)
    jump_penalty: float = Field(50.0, ge=0)
    jump_n_init: int = Field(10, ge=1)
    cp_model: Literal["l2"] = "l2"
    cp_min_size: int = Field(10, ge=2)
    pen_scale: float = named(2.0, "pen_scale", "cp_pen_scale", gt=0)
    window: int = named(126, "window", "cp_window", ge=20)
    stress_windows: dict[str, tuple[dt.date, dt.date]] = STRESS

    @property
    def severity_indices(self) -> list[int] | None:
        """Places of the severity features among the features; severity, if given, comes first."""
        return self.severity or [self.features.index(c) for c in self.severity_features if c in self.features] or None

    def settings(self, method: str | None = None) -> dict:
        """What the named detector takes."""
        own = {
            "hmm": {"restarts": self.restarts, "covariance": self.covariance_type, "rounds": self.n_iter, "tol": self.tol, "floor": self.min_covar},
            "jump": {"penalty": self.jump_penalty, "tries": self.jump_n_init},
            "changepoint": {"scale": self.pen_scale, "window": self.window, "least": self.cp_min_size},
        }
        return {"n_states": self.n_states, "seed": self.seed, "severity": self.severity_indices} | own.get(method or self.method, {})

    def build(self, method: str | None = None):
        return make_detector(method or self.method, **self.settings(method))


class Allocation(Settings):
    """assets: those to hold, empty for all."""

    assets: list[str] = []
    lookback: int = Field(252, ge=20)
    rebalance_every: int = Field(21, ge=1)
    on_regime_change: bool = True
    w_max: float = Field(1.0, gt=0, le=1)
    turnover_penalty: float = Field(0.0, ge=0)
    risk_aversion: float = Field(10.0, gt=0)
    mean_shrink: float = named(0.5, "mean_shrink", "mean_shrinkage", ge=0, le=1)
    beta: float = named(0.95, "beta", "cvar_beta", gt=0.5, lt=1)
    linkage: Literal["single", "complete", "average"] = named("single", "linkage", "hrp_linkage")
    regime_map: dict[str, str] = {"calm": "mean_variance", "volatile": "risk_parity", "crisis": "min_cvar"}
    baselines: list[str] = ["equal_weight", "mean_variance", "risk_parity", "hrp", "min_cvar"]

    def allocator(self, name: str) -> Allocator:
        return Allocator(name, tuple((k, getattr(self, k)) for k in ("w_max", "turnover_penalty", "risk_aversion", "mean_shrink", "beta", "linkage")))

    def by_regime(self, names: tuple[str, ...] = ("calm", "volatile", "crisis")) -> dict[int, Allocator]:
        return {rank: self.allocator(self.regime_map[n]) for rank, n in enumerate(names) if n in self.regime_map}


class Backtest(Settings):
    """rf_asset: the asset whose returns count as risk-free, if it is among the prices; None for none."""

    assets: list[str] = []
    rf_asset: str | None = "BIL"
    cost_bps: float = Field(10.0, ge=0)
    n_blocks: int = named(16, "n_blocks", "cscv_blocks", ge=2)
    cost_grid: list[float] = named([0.0, 5.0, 10.0, 20.0], "cost_grid", "cost_grid_bps")
    stress_windows: dict[str, tuple[dt.date, dt.date]] = STRESS
