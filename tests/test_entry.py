"""Driver contract smoke checks and a fast oracle subset at sf0.001."""

import pytest

import __spark_entry__ as E
from tests.oracle_check import compare

FAST = ["fixture_panel", "src2_csv_scan_polars", "prj5_prj6_derived_u1_u2", "win2_ewm_carry", "win4_expanding_folds",
        "agg9_exact_medians", "join3_st3_alignment_check", "agg11_agg12_agg13_mod9_mod11_fold_metrics",
        "row1_row6_imp2_create_features", "win7_early_stopping_keyed"]


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "E_I_interaction" in df.columns and "S_V_interaction" in df.columns


def test_every_query_has_a_callable():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 60


def test_fast_oracles_sf0001(spark):
    names = [n for n in FAST if n in E.queries()]
    res = compare(spark, "/root/testdata/sf0.001", names, verbose=False)
    bad = {k: v for k, v in res.items() if not v.get("ok")}
    assert not bad, bad


def test_panel_known_facts(spark):
    """FIXTURES section 2: 2,499 rows at sf0.01 and these null counts."""
    from marketflow.operators import profile
    from marketflow.plans.registry import panel
    p = panel(spark, "/root/testdata/sf0.01")
    assert p.count() == 2499
    nulls = {r["column"]: r["n_null"] for r in profile.columns_with_nulls(profile.null_counts(p)).collect()}
    assert nulls == {"E3": 39, "P9": 357, "S1": 24, "S2": 24, "S5": 143, "V2": 47, "V3": 47,
                     "forward_returns": 1, "market_forward_excess_returns": 1, "lagged_forward_returns": 1}
