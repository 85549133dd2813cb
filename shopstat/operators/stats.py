"""Group comparisons: moments, Welch t-test, contingency tables, chi-square.

All counting runs in Spark as global or grouped aggregates with map-side
partial aggregation, so a hot group never lands whole in one task.  Only the
final one-row result passes through a pandas UDF for the p-value.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopstat.functions.distributions import chi2_p_value, t_p_value
from shopstat.functions.text import norm_label

ALPHA = 0.05
REPORT_LINES = 1000
# Decision texts and report layout of the t-test.
T_SIGNIFICANT = "Significant difference"
T_NOT_SIGNIFICANT = "No statistically significant difference"
T_REPORT = "t-test — %s\nGroups: %s vs %s\nt-statistic: %.4f\np-value: %.4f\nConclusion: %s (alpha=%s)"


def moments(unit_df: DataFrame, group_col: str, value_col: str, groups) -> DataFrame:
    """Per group: mean, sample standard deviation and row count.

    ``count`` is the number of rows (units), including rows whose value is
    null; mean and stddev skip nulls.  Labels are compared trimmed and upper
    case.
    """
    wanted = [g.strip().upper() for g in groups]
    g = norm_label(F.col(group_col))
    return (
        unit_df.select(g.alias("group_name"), F.col(value_col).cast("double").alias("v"))
        .filter(F.col("group_name").isin(wanted))
        .groupBy("group_name")
        .agg(
            F.avg("v").alias("mean"),
            F.stddev_samp("v").alias("stddev"),
            F.count(F.lit(1)).alias("count"),
        )
    )


def _cond(col: Column, label: str, value: Column) -> Column:
    return F.when(col == F.lit(label), value)


def welch_ttest(unit_df: DataFrame, group_col: str, value_col: str, group_1: str, group_2: str,
                metric: str = "", alpha: float = ALPHA, strict: bool = False) -> DataFrame:
    """Welch's unequal-variance t-test of ``value_col`` between two groups.

    One global aggregate computes both groups' moments in a single row (no
    join, no pivot).  t and the Welch-Satterthwaite degrees of freedom are
    column expressions; the p-value is the only Python step, on that one row.
    If either group is empty the result has no row; ``strict`` raises
    instead (this runs the one-row aggregate once to check).
    """
    g1, g2 = group_1.strip().upper(), group_2.strip().upper()
    g = norm_label(F.col(group_col))
    v = F.col(value_col).cast("double")
    one = F.lit(1)
    row = (
        unit_df.select(g.alias("g"), v.alias("v"))
        .filter(F.col("g").isin(g1, g2))
        .agg(
            F.count(_cond(F.col("g"), g1, one)).alias("n_1"),
            F.avg(_cond(F.col("g"), g1, F.col("v"))).alias("mean_1"),
            F.stddev_samp(_cond(F.col("g"), g1, F.col("v"))).alias("std_1"),
            F.count(_cond(F.col("g"), g2, one)).alias("n_2"),
            F.avg(_cond(F.col("g"), g2, F.col("v"))).alias("mean_2"),
            F.stddev_samp(_cond(F.col("g"), g2, F.col("v"))).alias("std_2"),
        )
        .filter((F.col("n_1") > 0) & (F.col("n_2") > 0))
    )
    a = F.try_divide(F.col("std_1") * F.col("std_1"), F.col("n_1"))
    b = F.try_divide(F.col("std_2") * F.col("std_2"), F.col("n_2"))
    row = row.withColumns({"_a": a, "_b": b}).withColumn("_se2", F.col("_a") + F.col("_b"))
    gap = F.col("mean_1") - F.col("mean_2")
    # no spread in either group: equal means can't be compared (null), different ones differ for certain
    certain = (F.col("_se2") == 0) & (gap != 0)
    t = F.when(certain, F.signum(gap) * F.lit(float("inf"))).otherwise(F.try_divide(gap, F.sqrt("_se2")))
    df = F.when(F.col("_se2") == 0, F.lit(1.0)).otherwise(F.try_divide(
        F.col("_se2") * F.col("_se2"),
        F.try_divide(F.col("_a") * F.col("_a"), F.col("n_1") - 1)
        + F.try_divide(F.col("_b") * F.col("_b"), F.col("n_2") - 1),
    ))
    row = row.withColumns({"t_statistic": t, "df": df})
    row = row.withColumn("p_value", t_p_value(F.col("t_statistic"), F.col("df")))
    decision = F.when(F.col("p_value") < F.lit(alpha), F.lit(T_SIGNIFICANT)).otherwise(F.lit(T_NOT_SIGNIFICANT))
    report = F.format_string(
        T_REPORT,
        F.lit(metric), F.lit(g1), F.lit(g2), F.col("t_statistic"), F.col("p_value"), decision, F.lit(str(alpha)),
    )
    if strict and row.select("n_1").first() is None:
        raise ValueError(f"t-test needs both groups {g1!r} and {g2!r} to have rows")
    return row.select(
        F.lit(metric).alias("metric"), F.lit(g1).alias("group_1"), F.lit(g2).alias("group_2"),
        "n_1", "mean_1", "std_1", "n_2", "mean_2", "std_2", "t_statistic", "df", "p_value",
        decision.alias("decision"), report.alias("report"),
    )


def crosstab(df: DataFrame, row_col: str, col_col: str, col_values) -> DataFrame:
    """Counts of rows per (row value, column value), one column per value.

    Rows with a null row or column value drop out.  Column labels are
    compared trimmed and upper case on both sides, as in ``moments``.
    ``col_values`` is the fixed list of columns, so the pivot needs no extra
    pass to find them; missing cells are 0.
    """
    label = norm_label(F.col(col_col))
    wanted = {v: v.strip().upper() for v in col_values}
    counted = df.filter(F.col(row_col).isNotNull() & label.isin(list(wanted.values())))
    return counted.groupBy(row_col).agg(
        *[F.count(F.when(label == F.lit(u), F.lit(1))).alias(v) for v, u in wanted.items()])


def crosstab_percent(table: DataFrame, row_col: str, col_values, digits: int = 0) -> DataFrame:
    """Column percentages of a crosstab, rounded half to even; null in a
    column without any rows.  The column sums are one aggregate row, so a
    crosstab with very many categories isn't gathered in one task."""
    sums = table.agg(*[F.sum(v).alias(f"_sum_{i}") for i, v in enumerate(col_values)])
    return table.join(F.broadcast(sums)).select(
        row_col,
        *[F.bround(F.try_divide(F.col(v) * 100.0, F.col(f"_sum_{i}")), digits).alias(v) for i, v in enumerate(col_values)],
    )


def chi_square(table: DataFrame, row_col: str, col_values, alpha: float = ALPHA,
               question: str = "") -> DataFrame:
    """Pearson chi-square test of independence on a crosstab.

    Yates' continuity correction is applied when the table has one degree of
    freedom.  Without any (a single category, or a group without rows) the
    statistic is 0 and p is 1.  Margins are one aggregate row joined back;
    only the report gathers the categories' lines, and shows the first
    ``REPORT_LINES`` of them.
    """
    cols = list(col_values)
    row_sum = reduce(lambda x, y: x + y, [F.col(v) for v in cols])
    margins = table.agg(*[F.sum(v).alias(f"_colsum_{i}") for i, v in enumerate(cols)],
                        F.sum(row_sum).alias("_n"), F.count(F.lit(1)).alias("_rows"))
    t = table.withColumn("_row_sum", row_sum).join(F.broadcast(margins))
    n_cols = reduce(lambda x, y: x + y, [F.when(F.col(f"_colsum_{i}") > 0, 1).otherwise(0) for i in range(len(cols))])
    t = t.withColumn("_dof", (F.col("_rows") - 1) * (n_cols - 1))
    terms = []
    for i, v in enumerate(cols):
        e = F.try_divide(F.col("_row_sum").cast("double") * F.col(f"_colsum_{i}"), F.col("_n"))
        dev = F.abs(F.col(v) - e)
        dev = F.when(F.col("_dof") == 1, F.greatest(dev - 0.5, F.lit(0.0))).otherwise(dev)
        terms.append(F.when(F.col("_dof") > 0, F.coalesce(F.try_divide(dev * dev, e), F.lit(0.0))).otherwise(F.lit(0.0)))
    t = t.withColumn("_term", reduce(lambda x, y: x + y, terms))
    # report lines, one per category row (the crosstab is bounded by the categories)
    label = F.coalesce(F.col(row_col).cast("string"), F.lit("null"))
    count_line = F.concat(label, F.lit(": "), F.concat_ws(" / ", *[F.col(v).cast("string") for v in cols]))
    pct_line = F.concat(label, F.lit(": "), F.concat_ws(" / ", *[
        F.coalesce(F.format_string("%.0f%%", F.bround(F.try_divide(F.col(v) * 100.0, F.col(f"_colsum_{i}")), 0)), F.lit("-"))
        for i, v in enumerate(cols)]))
    res = t.agg(
        F.sum("_term").alias("statistic"),
        F.max("_dof").alias("dof"),
        F.max("_n").alias("n"),
        F.array_join(F.slice(F.array_sort(F.collect_list(count_line)), 1, REPORT_LINES), "\n").alias("_counts"),
        F.array_join(F.slice(F.array_sort(F.collect_list(pct_line)), 1, REPORT_LINES), "\n").alias("_pcts"),
    ).filter(F.col("n") > 0)
    res = res.withColumn("p_value", F.when(F.col("dof") > 0, chi2_p_value(F.col("statistic"), F.col("dof"))).otherwise(F.lit(1.0)))
    reject = F.col("p_value") < F.lit(alpha)
    decision = F.when(reject, F.lit("Reject independence")).otherwise(F.lit("No evidence against independence"))
    header = " / ".join(cols)
    report = F.format_string(
        "%s\nNumber of customers (%s):\n%s\nShare of customers within each column (%s)"
        ":\n%s\nNull hypothesis: the distributions are independent.\nP-value of Chi-square test = %.3f\n%s",
        F.lit(question), F.lit(header), F.col("_counts"), F.lit(header), F.col("_pcts"), F.col("p_value"),
        F.when(reject, F.lit("We reject the null hypothesis."))
        .otherwise(F.lit("We fail to reject the null hypothesis.")),
    )
    return res.select(
        "n", "statistic", F.col("dof").cast("bigint").alias("dof"), "p_value",
        decision.alias("decision"), report.alias("report"),
    )


def contingency(df: DataFrame, row_col: str, col_col: str) -> DataFrame:
    """Contingency table in long form, for labels that aren't known
    beforehand: one row per (row value, column label) that occurs, with its
    count ``n``, the margins ``row_n`` and ``col_n``, the count of all rows
    ``total`` and the count ``expected`` under independence.

    Rows with a null row or column value drop out; column labels are trimmed
    and upper case, as in ``crosstab``.  Both margins are aggregates of the
    counted cells joined back on their label, so no row and no task holds
    all labels, however many there are.
    """
    rows = df.select(F.col(row_col).alias("_r"), norm_label(F.col(col_col)).alias("_c")).filter("_r IS NOT NULL AND _c IS NOT NULL")
    cells = rows.groupBy("_r", "_c").agg(F.count(F.lit(1)).alias("n"))
    by_row = cells.groupBy("_r").agg(F.sum("n").alias("row_n"))
    by_col = cells.groupBy("_c").agg(F.sum("n").alias("col_n"))
    total = by_col.agg(F.sum("col_n").alias("total"))
    expected = F.col("row_n").cast("double") * F.col("col_n") / F.col("total")
    return (cells.join(by_row, "_r").join(by_col, "_c").join(F.broadcast(total))
            .select(F.col("_r").alias(row_col), F.col("_c").alias(col_col), "n", "row_n", "col_n", "total", expected.alias("expected")))


def chi_square_cells(cells: DataFrame, row_col: str, col_col: str, alpha: float = ALPHA) -> DataFrame:
    """Chi-square test of independence on the long form of ``contingency``:
    the same statistic, degrees of freedom and p-value as ``chi_square`` on
    the wide form, over all labels that occur.  No row for an empty table.

    A cell that doesn't occur adds its expected count; their sum is the
    total less the expected counts of the cells that do.  With one degree of
    freedom all four deviations are equal and the sum of 1 / expected is a
    product of both margins' sums, which gives Yates' correction without the
    absent cells.
    """
    dev = F.col("n") - F.col("expected")
    found = cells.agg(F.max("total").alias("n"), F.sum(dev * dev / F.col("expected")).alias("_met"), F.sum("expected").alias("_expected"),
                      F.max(F.abs(dev)).alias("_dev")).filter("n IS NOT NULL")
    rows = cells.groupBy(row_col).agg(F.max("row_n").alias("m")).agg(F.count(F.lit(1)).alias("_rows"), F.sum(1 / F.col("m")).alias("_by_row"))
    cols = cells.groupBy(col_col).agg(F.max("col_n").alias("m")).agg(F.count(F.lit(1)).alias("_cols"), F.sum(1 / F.col("m")).alias("_by_col"))
    both = found.join(F.broadcast(rows)).join(F.broadcast(cols)).withColumn("dof", (F.col("_rows") - 1) * (F.col("_cols") - 1))
    short = F.greatest(F.col("_dev") - 0.5, F.lit(0.0))
    statistic = (F.when(F.col("dof") == 0, F.lit(0.0))
                 .when(F.col("dof") == 1, short * short * F.col("n") * F.col("_by_row") * F.col("_by_col"))
                 .otherwise(F.col("_met") + F.greatest(F.col("n") - F.col("_expected"), F.lit(0.0))))
    both = both.withColumn("statistic", statistic)
    both = both.withColumn("p_value", F.when(F.col("dof") > 0, chi2_p_value(F.col("statistic"), F.col("dof"))).otherwise(F.lit(1.0)))
    decision = F.when(F.col("p_value") < F.lit(alpha), F.lit("Reject independence")).otherwise(F.lit("No evidence against independence"))
    return both.select("n", "statistic", F.col("dof").cast("bigint").alias("dof"), "p_value", decision.alias("decision"))
