import csv
import os

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Observation
from pyspark.sql import types as T

from shopstat.sources.files import read_csv_checked, read_csv_typed, read_ragged_csv, scan_csv
from shopstat.sources.quoted_csv import ranges, records

TEXTS = T.StructType([T.StructField(c, T.StringType()) for c in "abc"])


@pytest.fixture()
def small_splits(spark):
    """Splits of 64 bytes, so that every record may cross some."""
    keys = {"spark.sql.files.maxPartitionBytes": "64", "spark.sql.files.openCostInBytes": "64"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def _write(path, rows, header=("a", "b", "c"), **options):
    with open(path, "w", newline="", encoding="utf-8") as f:
        w = csv.writer(f, **options)
        w.writerow(header)
        w.writerows(rows)


ROWS = [(str(i), f"line one {i}\nline \"two\"\n\n, three" if i % 3 == 0 else f"plain {i}", "x" * (i % 90) + ('"' if i % 7 == 0 else "")) for i in range(120)]
LONG = [("1", "a\n" * 200 + '"quoted"\n', "y"), ("2", '""\n""', "z"), ("3", "p", "q")]


@pytest.mark.parametrize("rows", [ROWS, LONG, ROWS + LONG + ROWS, []])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_breaks_inside_quotes_across_splits(spark, tmpdir_path, small_splits, rows, end):
    path = os.path.join(tmpdir_path, "q.csv")
    _write(path, rows, lineterminator=end)
    got = read_csv_typed(spark, path, TEXTS)
    assert sorted((r.a, r.b, r.c or "") for r in got.collect()) == sorted(rows)
    if rows:
        assert got.rdd.getNumPartitions() > 1 and len(ranges(spark, path)) > 3
        assert any(r["tail"] for r in ranges(spark, path))
    one_task = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)
    assert sorted((r.a, r.b.replace("\r\n", "\n")) for r in one_task.collect()) == sorted((r.a, r.b) for r in got.collect())


def test_several_files_and_a_header_over_splits(spark, tmpdir_path, small_splits):
    folder = os.path.join(tmpdir_path, "many")
    os.makedirs(folder)
    header = ("a", "b\n" + "long name " * 20, "c")
    for k in range(3):
        _write(os.path.join(folder, f"{k}.csv"), [(f"{k}-{r[0]}", *r[1:]) for r in ROWS[:20 * k]], header)
    got = records(spark, folder).collect()
    assert len(got) == 60 and not any("long name" in r.record for r in got)


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(*[st.text(alphabet='ab,"\n é', min_size=1, max_size=25)] * 3), max_size=12))
def test_any_texts(spark, tmpdir_path, small_splits, rows):
    path = os.path.join(tmpdir_path, f"{abs(hash(tuple(rows)))}.csv")
    _write(path, rows, quoting=csv.QUOTE_ALL)
    got = scan_csv(spark, path, TEXTS, na_tokens=["\0"]).collect()
    assert sorted((r.a, r.b, r.c) for r in got) == sorted(rows)


NUMBERS = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType()), T.StructField("c", T.TimestampNTZType())])


def test_short_rows_are_padded_and_bad_rows_kept(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "bad.csv")
    with open(path, "w") as f:
        f.write("a,b,c\n1,x,2020-01-01 00:00:00\n3,y\n\n4\nbad,z,NA\n5,\"u\nv\",2020-01-02,extra\n6,w,soon\n")
    counts = Observation()
    accepted, rejected = read_csv_checked(spark, path, NUMBERS, counts=counts)
    assert sorted((r.a, r.b) for r in accepted.collect()) == [(1, "x"), (3, "y"), (4, None)] or \
        {r.a for r in accepted.collect()} == {1, 3, 4}
    bad = {r.record: r.reason for r in rejected.collect()}
    assert bad == {"bad,z,NA": "a: not of type bigint", '5,"u\nv",2020-01-02,extra': "more fields than the header",
                   "6,w,soon": "c: not of type timestamp_ntz"}
    assert counts.get == {"rows_in": 6, "rows_rejected": 3}
    with pytest.raises(Exception, match="not of type|more fields"):
        read_csv_typed(spark, path, NUMBERS).collect()
    lenient = {r.b: r.a for r in read_csv_typed(spark, path, NUMBERS, lenient=True).collect()}
    assert lenient["z"] is None and lenient["u\nv"] == 5
    plain = os.path.join(tmpdir_path, "plain.csv")
    with open(plain, "w") as f:
        f.write("a,b,c\n1,\"x, y\"\n2\n")
    assert sorted((r.a, r.b) for r in read_csv_typed(spark, plain, NUMBERS, multi_line=False).filter("b IS NOT NULL").collect()) == [(1, "x, y")]


def test_whole_floats_are_years(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "p.csv")
    with open(path, "w") as f:
        f.write("id,year\n1,2011.0\n2,2012\n3,2011.5\n4,later\n5.0,\n")
    got = read_ragged_csv(spark, path, types={"id": T.LongType(), "year": T.LongType()}).collect()
    assert sorted((r.id, r.year or 0) for r in got) == [(1, 2011), (2, 2012), (3, 0), (4, 0), (5, 0)]
