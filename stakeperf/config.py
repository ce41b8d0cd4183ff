"""Configuration: the asset table and the ledger parameters.

The asset table is configuration, not data; it is kept as a Python tuple and
turned into a (tiny) DataFrame or into literal arrays where a plan needs it.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date


@dataclass(frozen=True)
class AssetSpec:
    symbol: str
    category: str
    active: bool
    priority: float

    @property
    def column(self) -> str:
        """Ledger column name: the symbol with its first "-USD" removed."""
        return self.symbol.replace("-USD", "", 1)


# Must equal the reference's asset configuration.
# symbol, category, active, priority
ASSET_CONFIG: tuple[AssetSpec, ...] = (
    AssetSpec("GLD", "commodity", True, 1.0),
    AssetSpec("ETH-USD", "crypto", True, 1.0),
    AssetSpec("BTC-USD", "crypto", True, 1.0),
    AssetSpec("SOL-USD", "crypto", True, 2.0),
    AssetSpec("MATIC-USD", "crypto", True, 2.0),
    AssetSpec("NMR-USD", "crypto", True, 1.0),
    AssetSpec("SPXZ", "etf", True, 3.0),
)

# Metric names kept by the score filter, in this order
# (the order matters for the positional "parity" variant).
SCORE_METRICS: tuple[str, ...] = ("mmc", "fnc_v4")

# The token whose price converts payouts to USD, and the
# pattern that marks investment columns in the blotter.
TOKEN_COLUMN = "NMR"
INVESTMENT_PATTERN = "Inv"
CASH_COLUMNS: tuple[str, ...] = ("Principal", "Interest", "Adjustments")

# Fixed value: name of the portfolio roll-up beside the per-model results.
ALL_MODELS = "allmodels"


def active_assets(config: tuple[AssetSpec, ...] = ASSET_CONFIG) -> list[AssetSpec]:
    """Active assets ordered by (priority, symbol), as configured."""
    return sorted((a for a in config if a.active), key=lambda a: (a.priority, a.symbol))


@dataclass(frozen=True)
class LedgerConfig:
    """Date range and file names of the ledger half."""

    # The analysis date range and input file names configured
    # by the reference.
    start: date = date(2020, 12, 7)
    end: date = date(2025, 7, 25)
    assets: tuple[AssetSpec, ...] = ASSET_CONFIG
    investments_file: str = "investments.csv"
    fixedincome_file: str = "fixedincome.csv"
    cashbalance_file: str = "cashbalance.csv"
    holidays: tuple[date, ...] = field(default_factory=tuple)

    @property
    def asset_columns(self) -> list[str]:
        return [a.column for a in active_assets(self.assets)]
