"""All registered queries of the library itself."""

from __future__ import annotations

from weftline.plans import calibration, comparison, evaluation, intervals, modeling, publishing, records, series, views

MODULES = (series, evaluation, views, comparison, calibration, intervals, modeling, records, publishing)


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.SQL.items()}
