"""Age and amount bands as pure column expressions (CASE chains).

Being plain ``when`` chains they stay inside whole-stage codegen and get
constant folding; no Python runs per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shopstat.functions.timeparts import years_between

# Age bands, upper bound (exclusive) and label.  Labels use an
# en dash.  Ages at or above the last bound, and unknown ages, are "Not set".
AGE_BANDS = [
    (14, "1: less than 14"),
    (18, "2: 14 – 17"),
    (24, "3: 18 – 23"),
    (28, "4: 24 – 27"),
    (35, "5: 28 – 34"),
    (50, "6: 35 – 49"),
    (66, "7: 50 – 65"),
    (99, "8: more than 65"),
]
AGE_NOT_SET = "9: Not set"

# Amount bands, upper bound (exclusive) and label.
AMOUNT_BANDS = [
    (0, "0: Not set"),
    (200000, "1: less than 200,000"),
    (300000, "2: 200,000 - 300,000"),
    (500000, "3: 300,000 - 500,000"),
    (2000000, "4: 500,000 - 2,000,000"),
    (100000000, "5: more than 2,000,000"),
]
AMOUNT_TOP = "6: more than 100,000,000"


def _band(value: Column, bands, otherwise: str) -> Column:
    expr = None
    for bound, label in bands:
        cond = value < F.lit(bound)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(otherwise))


def age_years(birth: Column, at: Column) -> Column:
    """Age as the number of calendar-year boundaries between the two dates."""
    return years_between(birth, at)


def age_category(birth: Column, at: Column) -> Column:
    """Age band at ``at``; unknown birth dates and ages of 99+ give 'Not set'.

    A birth date after ``at`` gives a negative age and falls in band 1.
    """
    return _band(age_years(birth, at), AGE_BANDS, AGE_NOT_SET)


def amount_category(amount: Column, bands=AMOUNT_BANDS, top: str = AMOUNT_TOP,
                    null_label: str | None = None) -> Column:
    """Amount band.  A null amount falls through every test to the top band,
    as in the source rule; pass ``null_label`` to label nulls instead."""
    banded = _band(amount, bands, top)
    if null_label is not None:
        banded = F.when(amount.isNull(), F.lit(null_label)).otherwise(banded)
    return banded
