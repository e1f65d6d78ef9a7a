"""Registered queries against SQL on the smallest tables."""

import builtins
import dis
import importlib
import math
import os
import pkgutil
import types

import duckdb
import pytest

import __spark_entry__
import weftline
from weftline.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHECKED = [
    "bars_daily", "bars_hourly", "candles_valid", "ind_rsi14", "ind_change", "ind_green_run", "score_replay", "basket_score", "alerts", "checklist", "five_day_card", "feat_ranks252", "feat_q10_756",
    "labels_forward", "asof_inclusive", "asof_strict", "asof_tolerance", "breadth", "excess_return", "split_fraction", "split_summary", "confusion_storm", "direction_grid", "bin_temperature", "spearman_by_asset",
    "probability_metrics", "top_quintile_lift", "quality_audit", "quality_audit_daily", "market_briefing", "day_icons", "walk_forward_year", "range_errors", "redundant_pairs", "weighted_quantile", "trailing_intervals", "interval_coverage", "settlement_join", "hash_chain", "chain_breaks", "news_categories", "session_status",
    "comparison_by_asset", "comparison_macro", "equal_weather", "rows_for_keys", "adjusted_history", "news_payload", "symbol_search", "orphan_settlements", "dedupe_either", "stale_rows", "number_texts", "storm_report", "interval_schemes", "panel_gates", "vix_against_market", "last_settlements", "distinct_sets", "bounds_for_keys",
    "model_records", "fold_audit", "causal_tape", "fold_moments", "tape_quantiles", "interval_slices", "tape_weather", "weather_borders", "fold_gate", "cluster_transfer", "shift_strengths", "series_checks", "split_protocol",
    "contract_breaks", "registered_benchmarks", "situation_texts", "stations", "pulse_bars", "time_buckets", "symbol_texts", "symbol_aliases", "score_quotes", "paged_history", "cached_series", "rows_by_source", "digested_texts", "visible_rows",
    "chart_payload", "stream_hourly", "stream_settle", "cutoff_quantiles", "interval_pass_rates", "ridge_tape", "frozen_tape", "cohort_bundle", "score_parity", "split_by_bounds", "stream_forecasts",
    "ledger_segments", "segment_breaks", "ledger_appends", "snapshot_build", "benchmark_registration", "canonical_hashes", "score_texts", "truncation_check",
    "paged_source", "public_export", "ledger_status", "dashboard_quotes", "weather_report", "live_bars",
]


@pytest.fixture(scope="module")
def tables():
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(df):
    def cell(x):
        if x is None or x != x:
            return "null"
        if hasattr(x, "isoformat"):
            return x.isoformat().replace("T00:00:00", "")
        if isinstance(x, (int, float)) or hasattr(x, "dtype") and x.dtype.kind in "iuf":
            return repr(round(float(x), 9) + 0.0) if math.isfinite(float(x)) else str(x)
        return str(x)

    return sorted(tuple(cell(x) for x in row) for row in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", CHECKED)
def test_equals_sql(spark, tables, name):
    assert plain(catalog.queries()[name](spark, SF).toPandas()) == plain(tables.sql(catalog.oracle_sql()[name]).df())


def test_every_sql_has_a_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry(spark):
    if os.path.isdir(SF):
        assert __spark_entry__.entry(spark).count() > 0


def test_shifted_probability_equals_sql(spark, tables):
    got = plain(catalog.queries()["shifted_probability"](spark, SF).toPandas())
    assert got and got == plain(tables.sql(catalog.oracle_sql()["shifted_probability"]).df())


def functions(code):
    """A module's code object and those of all functions in it."""
    yield code
    for c in code.co_consts:
        if isinstance(c, types.CodeType):
            yield from functions(c)


@pytest.mark.parametrize("name", [m.name for m in pkgutil.walk_packages(weftline.__path__, "weftline.")])
def test_functions_name_what_exists(name):
    """A name that is not imported fails when its query runs, and not all queries run here."""
    module = importlib.import_module(name)
    with open(module.__file__, encoding="utf-8") as f:
        code = compile(f.read(), module.__file__, "exec")
    used = {i.argval for c in functions(code) for i in dis.get_instructions(c) if i.opname == "LOAD_GLOBAL"}
    assert not {n for n in used if not hasattr(module, n) and not hasattr(builtins, n)}
