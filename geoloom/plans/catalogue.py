"""Every registered query of the geographic engine with its DuckDB oracle."""

from __future__ import annotations

from geoloom.plans import areas, conflation, elements, further, grids, measured, profiles, rasters, scalar, tagged, weather  # noqa: F401
from geoloom.plans.register import ORACLES, QUERIES


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
