"""All registered queries by name."""
from __future__ import annotations

from importlib import import_module

AREAS = ("prices", "scores", "macros", "backtests", "calibration", "users", "boards", "stores", "streams", "live")


def queries() -> dict:
    out: dict = {}
    for area in AREAS:
        out.update(import_module(f"tapelens.plans.{area}").QUERIES)
    return out


def oracle_sql() -> dict:
    out: dict = {}
    for area in AREAS:
        out.update(import_module(f"oracle.{area}").SQL)
    return out


def flagship(spark, root: str):
    """Latest scored cross-section of the whole history."""
    from ..functions.columns import rounded
    from .methodology import latest, scored_table

    out = latest(scored_table(spark, root))
    return rounded(out.select("as_of", "ticker", "class", "S_score", "rank_in_class", "selected", "state"))
