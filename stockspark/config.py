"""Configuration objects passed to operators (frozen, hashable, driver-side)."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Optional


@dataclass(frozen=True)
class Normalization:
    """How one key piece is normalised (STR-1).

    case: "lower" | "upper" | "asis"; zero_pad: widen all-digit pieces to this
    width (0 = off); null_token: text a null cell becomes before normalising
    (the V1 tool turns null into "nan", the change feed into "").
    """
    case: str = "lower"
    trim: bool = True
    collapse_spaces: bool = True
    zero_pad: int = 0
    null_token: str = ""


@dataclass(frozen=True)
class SideMapping:
    """Role mapping for one snapshot (PRJ-1)."""
    key_cols: tuple = ()
    qty_col: str = "qty"
    sku_col: Optional[str] = None
    account_col: Optional[str] = None
    norm: Normalization = field(default_factory=Normalization)


DEFAULT_SEVERITY_MAP = {
    "Critical": {"pct": 0.00, "min_units": 0, "max_units": 0},
    "High": {"pct": 0.00, "min_units": 0, "max_units": 0},
    "Medium": {"pct": 0.05, "min_units": 1, "max_units": None},
    "Low": {"pct": 0.10, "min_units": 1, "max_units": None},
    "Very Low": {"pct": 0.20, "min_units": 1, "max_units": None},
}


@dataclass(frozen=True)
class TolerancePolicy:
    """Tolerance policy (CND-4/5)."""
    mode: str = "strict"              # "strict" | "tolerant"
    base_method: str = "max"          # max | min | avg | ecommerce | warehouse
    rounding: str = "floor"           # floor | ceil | round (half-even)
    equal_status_severity: str = "Medium"
    severity_map: tuple = tuple((k, v["pct"], v["min_units"], v["max_units"])
                                for k, v in DEFAULT_SEVERITY_MAP.items())

    def severities(self) -> dict:
        return {name: {"pct": pct, "min_units": mn, "max_units": mx}
                for name, pct, mn, mx in self.severity_map}


# Platform source codes used by the import-file tools.
DEFAULT_SOURCE_CODES = ("pos_337", "src_virtualstock")

# Order statuses and pack sizes of the order book.
ORDER_STATUSES = ("Pending", "Completed", "Cancelled")
PACK_SIZES = ("small", "medium", "large", "bulky", "extra_bulky")

# Order-book settings defaults.
SETTINGS_DEFAULTS = {
    "supplier_name_unique": False,
    "require_supplier_id_on_product": True,
    "allow_update_product_supplier": True,
    "allow_update_product_price": True,
    "allow_update_product_name": True,
    "enforce_price_gt_zero_on_import": True,
    "enforce_quantity_ge_zero_on_import": True,
    "freight_rate_small": 5.0,
    "freight_rate_medium": 10.0,
    "freight_rate_large": 20.0,
    "freight_rate_bulky": 35.0,
    "freight_rate_extra_bulky": 60.0,
    "freight_default_percent_of_price": 10.0,
}


@dataclass(frozen=True)
class FreightPolicy:
    """Per-unit freight (CND-8): a positive rate per pack size, else a percent of price."""
    rates: tuple = (("small", 5.0), ("medium", 10.0), ("large", 20.0),
                    ("bulky", 35.0), ("extra_bulky", 60.0))
    default_percent_of_price: float = 10.0


@dataclass(frozen=True)
class ImportPolicy:
    """Product import / upsert policy (DML-2/3/4)."""
    allow_update_name: bool = True
    allow_update_price: bool = True
    allow_update_supplier: bool = True
    enforce_price_gt_zero: bool = True
    enforce_quantity_ge_zero: bool = True
    forced_supplier: Optional[str] = None     # DML-4: supplier-scoped import
    blank_pack: str = "keep"                  # "keep" (DML-3) | "clear" (DML-4)


# Carriers accepted by the dispatch command.
CARRIERS = (
    ("AUSPOST_PARCEL", "Australia Post Parcels", ("STANDARD", "EXPRESS")),
    ("STARTRACK", "StarTrack", ("PRIORITY", "AUTHORITY_TO_LEAVE")),
    ("TOLL", "Toll IPEC", ("ROAD", "PRIORITY")),
)
