import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shopstat.functions.distributions import chi2_upper_p, t_two_sided_p
from shopstat.operators.stats import chi_square, chi_square_cells, contingency, crosstab, crosstab_percent, moments, welch_ttest


def _units(spark, rows):
    return spark.createDataFrame(rows, "grp string, value double")


def test_moments_labels_nulls_single_row(spark):
    rows = [(" m ", 1.0), ("M", 3.0), ("M", None), ("f", 5.0), ("X", 9.0)]
    got = {r.group_name: r for r in moments(_units(spark, rows), "grp", "value", ["M", "F"]).collect()}
    assert set(got) == {"M", "F"}
    assert got["M"]["count"] == 3 and got["M"]["mean"] == 2.0        # n counts the null row
    assert got["M"]["stddev"] == pytest.approx(math.sqrt(2.0))
    assert got["F"]["count"] == 1 and got["F"]["stddev"] is None      # one-row group


def _welch_ref(a, b):
    m1, m2, v1, v2 = np.mean(a), np.mean(b), np.var(a, ddof=1), np.var(b, ddof=1)
    se2 = v1 / len(a) + v2 / len(b)
    t = (m1 - m2) / math.sqrt(se2)
    df = se2 ** 2 / ((v1 / len(a)) ** 2 / (len(a) - 1) + (v2 / len(b)) ** 2 / (len(b) - 1))
    return t, df, t_two_sided_p(t, df)


def test_welch_matches_reference(spark):
    a, b = [1.0, 2.0, 3.5, 4.0, 10.0], [2.0, 2.5, 2.7, 8.0]
    rows = [("A", x) for x in a] + [("B", x) for x in b] + [("C", 100.0)]
    r = welch_ttest(_units(spark, rows), "grp", "value", "A", "B", metric="m").first()
    t, df, p = _welch_ref(a, b)
    assert r.t_statistic == pytest.approx(t) and r.df == pytest.approx(df) and r.p_value == pytest.approx(p)
    assert r.n_1 == 5 and r.n_2 == 4
    assert "t-statistic: " in r.report and r.decision == "No statistically significant difference"


def test_welch_needs_both_groups(spark):
    rows = [("A", 1.0), ("A", 2.0)]
    assert welch_ttest(_units(spark, rows), "grp", "value", "A", "B").count() == 0
    with pytest.raises(ValueError):
        welch_ttest(_units(spark, rows), "grp", "value", "A", "B", strict=True)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.floats(-1e3, 1e3), min_size=2, max_size=12),
       st.lists(st.floats(-1e3, 1e3), min_size=2, max_size=12))
def test_swapping_groups_negates_t_keeps_p(spark, a, b):
    rows = [("A", x) for x in a] + [("B", x) for x in b]
    df = _units(spark, rows)
    r1 = welch_ttest(df, "grp", "value", "A", "B").first()
    r2 = welch_ttest(df, "grp", "value", "B", "A").first()
    if r1.t_statistic is None:
        assert r2.t_statistic is None
        return
    assert r2.t_statistic == pytest.approx(-r1.t_statistic)
    assert (r1.p_value is None and r2.p_value is None) or r2.p_value == pytest.approx(r1.p_value)


def _chi_ref(table, yates):
    o = np.array(table, dtype=float)
    e = o.sum(1, keepdims=True) * o.sum(0, keepdims=True) / o.sum()
    dev = np.abs(o - e)
    if yates:
        dev = np.maximum(dev - 0.5, 0)
    stat = float((dev ** 2 / e).sum())
    dof = (o.shape[0] - 1) * (o.shape[1] - 1)
    return stat, dof, chi2_upper_p(stat, dof)


def _cells(spark, table, cols=("g1", "g2")):
    rows = []
    for i, counts in enumerate(table):
        for c, n in zip(cols, counts):
            rows += [(f"m{i}", c)] * n
    rows.append((None, "g1"))          # null method drops out
    return spark.createDataFrame(rows, "method string, grp string")


@pytest.mark.parametrize("table", [[[12, 5], [7, 9]], [[10, 20], [30, 25], [5, 9]], [[3, 4], [5, 1], [7, 7], [2, 9], [4, 4]]])
def test_chi_square_matches_reference(spark, table):
    ct = crosstab(_cells(spark, table), "method", "grp", ["g1", "g2"])
    r = chi_square(ct, "method", ["g1", "g2"]).first()
    stat, dof, p = _chi_ref(table, yates=len(table) == 2)
    assert r.dof == dof and r.statistic == pytest.approx(stat) and r.p_value == pytest.approx(p)


def test_chi_square_transposed_2x2_same(spark):
    table = [[12, 5], [7, 9]]
    t_rows = [[12, 7], [5, 9]]
    a = chi_square(crosstab(_cells(spark, table), "method", "grp", ["g1", "g2"]), "method", ["g1", "g2"]).first()
    b = chi_square(crosstab(_cells(spark, t_rows), "method", "grp", ["g1", "g2"]), "method", ["g1", "g2"]).first()
    assert a.statistic == pytest.approx(b.statistic) and a.p_value == pytest.approx(b.p_value)


def test_no_degrees_of_freedom(spark):
    ct = crosstab(_cells(spark, [[3, 4]]), "method", "grp", ["g1", "g2"])
    r = chi_square(ct, "method", ["g1", "g2"]).first()
    assert (r.statistic, r.dof, r.p_value) == (0.0, 0, 1.0)


def test_group_without_rows(spark):
    ct = crosstab(_cells(spark, [[3, 0], [5, 0]]), "method", "grp", ["g1", "g2"])
    r = chi_square(ct, "method", ["g1", "g2"]).first()
    assert (r.statistic, r.dof, r.p_value) == (0.0, 0, 1.0)
    assert {x.method: x.g2 for x in crosstab_percent(ct, "method", ["g1", "g2"]).collect()} == {"m0": None, "m1": None}


def test_percent_sign_in_a_label(spark):
    df = _cells(spark, [[3, 4], [5, 1]], cols=("10%", "%s"))
    r = chi_square(crosstab(df, "method", "grp", ["10%", "%s"]), "method", ["10%", "%s"]).first()
    assert "10% / %s" in r.report


def test_labels_are_compared_trimmed_and_upper_case(spark):
    df = spark.createDataFrame([("m", " g1 "), ("m", "G1"), ("m", "g2"), ("n", "G2 ")], "method string, grp string")
    assert {r.method: (r.g1, r.g2) for r in crosstab(df, "method", "grp", ["g1", "g2"]).collect()} == {"m": (2, 1), "n": (0, 1)}


def test_no_spread_but_different_means(spark):
    r = welch_ttest(_units(spark, [("A", 2.0), ("A", 2.0), ("B", 5.0), ("B", 5.0)]), "grp", "value", "A", "B").first()
    assert r.t_statistic == float("-inf") and r.df == 1.0 and r.p_value == 0.0 and r.decision == "Significant difference"


def test_percent_columns_sum_to_100(spark):
    ct = crosstab(_cells(spark, [[10, 20], [30, 25], [5, 9]]), "method", "grp", ["g1", "g2"])
    pct = crosstab_percent(ct, "method", ["g1", "g2"], digits=6).collect()
    assert sum(r.g1 for r in pct) == pytest.approx(100.0, abs=1e-4)
    assert sum(r.g2 for r in pct) == pytest.approx(100.0, abs=1e-4)


def test_ttest_plan_has_one_python_node_on_the_result(spark):
    import __spark_entry__ as entry
    df = entry.queries()["ttest_order_value_by_segment"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "BatchEvalPython" not in plan
    # the Python node sits above the final (one-row) aggregate
    assert plan.index("ArrowEvalPython") < plan.index("HashAggregate")


def test_cluster_conf_sizes_partitions():
    from shopstat.session import cluster_conf
    conf = cluster_conf(100 << 40, 8000)
    assert int(conf["spark.sql.shuffle.partitions"]) == 100_000
    assert int(conf["spark.sql.files.maxPartitionBytes"]) > 1 << 30
    assert int(cluster_conf(1 << 40, 100)["spark.sql.shuffle.partitions"]) == (1 << 40) // (256 << 20)
    assert int(cluster_conf(1 << 20, 64)["spark.sql.shuffle.partitions"]) == 192


def test_equal_values_give_no_statistic(spark):
    rows = [("A", 2.0), ("A", 2.0), ("B", 2.0), ("B", 2.0)]
    r = welch_ttest(_units(spark, rows), "grp", "value", "A", "B").first()
    assert r.t_statistic is None and r.p_value is None
    assert r.decision == "No statistically significant difference"


def test_customer_with_two_methods_counts_in_two_cells(spark):
    rows = spark.createDataFrame([("card", "g1", 1), ("cash", "g1", 1), ("card", "g2", 2), ("card", "g2", 2)],
                                 "method string, grp string, customer_id long").distinct()
    got = {r.method: (r.g1, r.g2) for r in crosstab(rows, "method", "grp", ["g1", "g2"]).collect()}
    assert got == {"card": (1, 1), "cash": (1, 0)}


@pytest.mark.parametrize("table", [[[10, 20], [30, 25], [5, 9]], [[10, 20], [30, 25]], [[3, 0], [5, 4]], [[7, 0], [0, 9], [3, 3]], [[3, 4]], [[3, 0], [5, 0]]])
def test_long_contingency_equals_wide(spark, table):
    rows = _cells(spark, table)
    wide = chi_square(crosstab(rows, "method", "grp", ["g1", "g2"]), "method", ["g1", "g2"]).first()
    long = chi_square_cells(contingency(rows, "method", "grp"), "method", "grp").first()
    assert (long.n, long.dof, long.decision) == (wide.n, wide.dof, wide.decision)
    assert long.statistic == pytest.approx(wide.statistic, abs=1e-9) and long.p_value == pytest.approx(wide.p_value, abs=1e-9)


def test_long_contingency_keeps_a_third_group_and_drops_nulls(spark):
    table = [[10, 20, 3], [30, 25, 0], [5, 9, 8]]
    rows = _cells(spark, table, ("g1", " G2", "g3")).unionByName(spark.createDataFrame([("m0", None)], "method string, grp string"))
    cells = contingency(rows, "method", "grp")
    assert {(r.method, r.grp): r.n for r in cells.collect()} == {
        (f"m{i}", f"G{j + 1}"): n for i, counts in enumerate(table) for j, n in enumerate(counts) if n}
    stat, dof, p = _chi_ref(table, yates=False)
    r = chi_square_cells(cells, "method", "grp").first()
    assert (r.dof, r.n) == (dof, 110) and r.statistic == pytest.approx(stat) and r.p_value == pytest.approx(p)
    empty = chi_square_cells(contingency(rows.limit(0), "method", "grp"), "method", "grp")
    assert empty.collect() == []


def test_many_labels_never_meet_in_one_row(spark):
    rows = spark.range(200_000).selectExpr("concat('m', id % 2) AS method", "concat('label ', id % 100000) AS grp")
    cells = contingency(rows, "method", "grp")
    assert cells.count() == 100_000 and "collect_" not in cells._jdf.queryExecution().executedPlan().toString()
    r = chi_square_cells(cells, "method", "grp").first()           # every label has one method only
    assert r.dof == 99_999 and r.statistic == pytest.approx(200_000)
