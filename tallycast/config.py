"""Engine settings and the filter specification."""

from __future__ import annotations

from dataclasses import dataclass, field

# Raw column names, required columns and data-quality limits.
REQUIRED_RAW_COLUMNS = (
    "Ordered Item",
    "SO Remaining Qty",
    "Booked Date",
    "SO Line Amount EGP",
    "Shipped Amount [USD]",
    "Not Shipped Amount [USD]",
)
OPTIONAL_RAW_COLUMNS = (
    "Shipped Qty",
    "Cancelled Qty",
    "Calculated Weight (Kg)",
    "Unit Weight (Kg)",
    "Country",
    "Order System",
    "Factory Name",
    "Cell Columns",
    "Item Class",
    "Order Number",
    "Description",
)
MAX_MISSING_PCT = {"sku": 5.0, "qty": 5.0, "date": 10.0}
FEW_ITEMS = 100
LONG_HISTORY_YEARS = 2.0

# Forecast method keys in reporting order.
METHODS = (
    "croston",
    "sba",
    "tsb",
    "adida",
    "iets",
    "arima",
    "prophet",
    "holt_winters",
    "weighted_ma",
    "ma_benchmark",
    "exponential_trend",
    "lstm",
    "lightgbm",
    "intelligent_growth",
    "advanced_ensemble",
    "ensemble",
)

# Weights of the advanced ensemble.
ENSEMBLE_WEIGHTS = {
    "croston": 1.2,
    "sba": 1.3,
    "tsb": 1.4,
    "arima": 1.6,
    "prophet": 1.5,
    "holt_winters": 1.4,
    "weighted_ma": 1.3,
    "exponential_trend": 1.2,
    "lstm": 1.8,
    "lightgbm": 1.7,
    "intelligent_growth": 1.9,
}

@dataclass(frozen=True)
class EngineConfig:
    """Settings read by the operators; every field has the default the engine is specified with."""

    min_periods: int = 12
    backtest_min_periods: int = 24
    intermittent_threshold_pct: float = 50.0
    adi_threshold: float = 1.32
    volatility_cv2: float = 0.5
    #: Patterns that text dates are read with, the first that fits; without any, ISO dates are read.
    date_format: str | tuple[str, ...] | None = None
    seed: int = 42
    meta_rows: int | None = None  # training rows of the meta-learner: all; a number draws about as many by hash
    ma_terms: bool = False  # the slot arima searches orders with moving-average terms
    smoothing_family: bool = False  # the slot iets chooses trend, season and kind of error by AICc and refines its gains
    change_points: bool = False  # the slot prophet is a trend with change points and a season of harmonics
    align_phase: bool = False
    noise: bool = False


@dataclass(frozen=True)
class Filters:
    """Conjunction of row filters; an empty field is no filter."""

    years: tuple[int, ...] = ()
    period_start: str | None = None
    period_end: str | None = None
    countries: tuple[str, ...] = ()
    systems: tuple[str, ...] = ()
    factories: tuple[str, ...] = ()
    exclude_countries: tuple[str, ...] = ()
    exclude_systems: tuple[str, ...] = ()
    category: str | None = None
    equals: dict[str, object] = field(default_factory=dict)
