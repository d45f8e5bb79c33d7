"""Every registered query with SQL gives the rows of that SQL; the others run and give rows."""

import pytest
from conftest import SF
from oracle_check import compare

from lumora.catalogue import ORACLES, QUERIES


@pytest.mark.parametrize("name", list(ORACLES))
def test_same_rows_as_sql(spark, name):
    assert compare(QUERIES[name](spark, SF), SF, ORACLES[name]) is None


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLES])
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).limit(1).count() == 1


LARGE = [
    "p11_every_kth", "p13_split_chronological", "b2_spearman", "b3_kendall", "d1_describe_numeric", "d2_extended_stats", "d13_outliers_modified_z",
    "d17_box_stats", "d24_outlier_report", "n22_scale_robust", "n24_label_encode", "t4_moving_average", "t6_ma_decompose", "t7_classical_decompose",
    "t10_acf_keyed", "t12_ljung_box", "t14_trend", "t16_change_points_window", "t18_segment_stats", "t19_anomalies_iqr", "t20_anomalies_dbscan",
    "t24_forecast_linear", "t30_best_model", "t31_future_dates_keyed", "m19_roc_points", "m19_auc", "m20_cross_validate", "r5_temporal_section",
]


@pytest.mark.parametrize("name", LARGE)
def test_large_plan_gives_the_same_rows(spark, large, name):
    assert compare(QUERIES[name](spark, SF), SF, ORACLES[name]) is None


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 11
    assert set(entry.oracle_sql()) <= set(entry.queries())
