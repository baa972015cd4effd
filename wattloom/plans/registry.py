"""Every query of the library by name, with the equivalent SQL."""

from __future__ import annotations

from wattloom.plans.models import MODEL_SQL, MODELS
from wattloom.plans.queries import ORACLES, QUERIES

FLAGSHIP = "daily_deficit_mean"


def queries() -> dict:
    return QUERIES | MODELS


def oracle_sql() -> dict[str, str]:
    return ORACLES | MODEL_SQL
