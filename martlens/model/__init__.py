"""Table schemas of the normalized and the star model."""

from martlens.model.schemas import (
    NORMALIZED,
    PERIOD_COLUMNS,
    STAR,
    STAR_KEYS,
    checked,
    conform,
    duplicate_keys,
)
from martlens.model.tables import Mart, Normalized

__all__ = [
    "NORMALIZED",
    "PERIOD_COLUMNS",
    "STAR",
    "STAR_KEYS",
    "Mart",
    "Normalized",
    "checked",
    "conform",
    "duplicate_keys",
]
