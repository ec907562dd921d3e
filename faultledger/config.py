"""Settings of a run; every limit and pattern of the engine in one place."""

from dataclasses import dataclass, field
from decimal import Decimal

from faultledger import fixed_values as fixed
from faultledger.sources.contracts import CONTRACTS, Contract


@dataclass(frozen=True)
class Settings:
    source_patterns: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: dict(fixed.SOURCE_PATTERNS)
    )
    contracts: dict[str, Contract] = field(default_factory=lambda: dict(CONTRACTS))
    fx_rates: dict[str, Decimal] = field(
        default_factory=lambda: {p: Decimal(r) for p, r in fixed.FX_RATES.items()}
    )
    single_incident_usd: int = fixed.SINGLE_INCIDENT_USD
    weekly_total_usd: int = fixed.WEEKLY_TOTAL_USD
    high_risk_usd: int = fixed.HIGH_RISK_USD
    medium_risk_usd: int = fixed.MEDIUM_RISK_USD
    risk_window_days: int = fixed.RISK_WINDOW_DAYS
    plants: tuple[tuple[str, ...], ...] = fixed.PLANTS
    # Alert on the whole cleaned batch, or only on the rows that were new.
    alert_on_new_rows_only: bool = False
    # Also clean a missing part of a two-part category (kept as text by default).
    strict_nulls: bool = False
    # Whether CSV extracts have quoted line breaks, which make a file one task.
    # By default each file is looked through; a stream, which cannot, takes them
    # as possible.
    csv_multi_line: bool | None = None
    # Keep the sums of each load, so that a run's report reads no facts but its own.
    keep_sums: bool = True
    # Whether a run's report has a copy of all facts, or the bound up to which they are read.
    report_copies_raw: bool = False
