import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shopstat.operators.nested import attribute_types, booking_lines, event_attributes, parse_items

LINES_TEXT = [
    (1, "[]"),
    (2, None),
    (3, "[{'product_id': 7, 'quantity': 2, 'item_price': 10.5}, {'product_id': 8, 'quantity': 1, 'item_price': 3.0}]"),
    (4, "[{'product_id': None, 'quantity': 1, 'item_price': 2.0}]"),
    (5, "[{'product_id': 9, 'item_price': 4.0}]"),             # missing field
    (6, "[None, {'product_id': 10, 'quantity': 3, 'item_price': 1.5}]"),
]


def _tx(spark, rows):
    return spark.createDataFrame(rows, "booking_id long, product_metadata string")


def test_keep_empty_explode(spark):
    got = booking_lines(_tx(spark, LINES_TEXT), strict=True, keep_empty=True).orderBy("booking_id", "product_id")
    rows = [tuple(r) for r in got.collect()]
    assert (1, None, None, None, None) in rows and (2, None, None, None, None) in rows
    assert (3, 7, 2, 10.5, 21.0) in rows and (3, 8, 1, 3.0, 3.0) in rows
    assert (4, None, 1, 2.0, 2.0) in rows
    assert (5, 9, None, 4.0, None) in rows
    assert (6, None, None, None, None) in rows and (6, 10, 3, 1.5, 4.5) in rows
    assert len(rows) == 8


def test_strict_drop_empty(spark):
    got = booking_lines(_tx(spark, LINES_TEXT), strict=False, keep_empty=False)
    ids = sorted(r.booking_id for r in got.collect())
    assert ids == [3, 3, 4, 5, 6]


def test_malformed_strict_raises_lenient_empties(spark):
    bad = _tx(spark, [(1, "[{'product_id': 1, 'quantity': 2"), (2, "[{'product_id': 3, 'quantity': 1, 'item_price': 1.0}]")])
    with pytest.raises(Exception):
        booking_lines(bad, strict=True).collect()
    got = booking_lines(bad, strict=False, keep_empty=True).orderBy("booking_id").collect()
    assert [(r.booking_id, r.product_id) for r in got] == [(1, None), (2, 3)]


def test_explode_then_regroup_returns_items(spark):
    df = _tx(spark, LINES_TEXT[2:3])
    items = df.select(parse_items(F.col("product_metadata")).alias("a")).first().a
    regrouped = booking_lines(df).groupBy("booking_id").agg(F.count("*").alias("n")).first().n
    assert regrouped == len(items) == 2


def test_event_attributes_declared_and_open(spark):
    ev = spark.createDataFrame(
        [(1, "signup", "{'k': 5, 'x': 'a'}"), (2, "signup", "{'x': 'b'}"), (3, "signup", None), (4, "click", "{'k': 1}")],
        "event_id long, event_name string, event_metadata string")
    declared = event_attributes(ev, "signup", T.StructType([T.StructField("k", T.LongType())]))
    assert declared.columns == ["event_id", "k"]
    assert sorted((r.event_id, r.k) for r in declared.collect()) == [(1, 5), (2, None), (3, None)]
    open_keys = event_attributes(ev, "signup", as_map=True).orderBy("event_id").collect()
    assert open_keys[0].attributes == {"k": "5", "x": "a"} and open_keys[1].attributes == {"x": "b"}
    assert open_keys[2].attributes is None


def test_apostrophe_inside_string_field(spark):
    schema = T.StructType([T.StructField("name", T.StringType()), T.StructField("product_id", T.LongType())])
    df = spark.createDataFrame([("[{'name': \"O'Neil None\", 'product_id': 1}, {'name': 'plain', 'product_id': None}]",)],
                               "t string")
    items = df.select(parse_items(F.col("t"), schema).alias("a")).first().a
    assert [(i.name, i.product_id) for i in items] == [("O'Neil None", 1), ("plain", None)]


@pytest.mark.parametrize("text, want", [
    ("{'kw': 'a, None, b'}", {"kw": "a, None, b"}), ("{'kw': 'x, True]'}", {"kw": "x, True]"}),
    ("{'a': None, 'b': True, 'c': \"it's False\", 'd': False}", {"a": None, "b": "true", "c": "it's False", "d": "false"}),
    ("{'a': 'it\\'s None', 'b': None}", {"a": "it's None", "b": None}), ("{'None': 'None'}", {"None": "None"}),
])
def test_only_bare_words_are_rewritten(spark, text, want):
    ev = spark.createDataFrame([(1, "e", text)], "event_id long, event_name string, event_metadata string")
    assert event_attributes(ev, "e", as_map=True).first().attributes == want


def test_long_literals_and_malformed_events(spark):
    long = "[" + ", ".join("{'product_id': None, 'quantity': 1, 'item_price': 2.0}" for _ in range(3000)) + "]"
    assert booking_lines(_tx(spark, [(1, long)])).filter("product_id IS NULL AND quantity = 1").count() == 3000
    bad = spark.createDataFrame([(1, "e", "{'a': "), (2, "e", None)], "event_id long, event_name string, event_metadata string")
    with pytest.raises(Exception):
        event_attributes(bad, "e", as_map=True).collect()
    assert [r.attributes for r in event_attributes(bad, "e", strict=False, as_map=True).orderBy("event_id").collect()] == [None, None]


LITERALS = [
    (1, "[{'product_id': 7, 'quantity': 2, 'item_price': 10.5},]"),                                  # trailing comma
    (2, "({'product_id': 8, 'quantity': 0x10, 'item_price': 3.0}, {'product_id': 9, 'quantity': 1_0, 'item_price': 1e1})"),
    (3, "[{'product_id': 5, 'quantity': 1, 'item_price': 2.0}]"),                                    # JSON as it is
    (4, " "), (5, "[]"), (6, "()"),
]
LITERAL_ROWS = [(1, 7, 2, 10.5), (2, 8, 16, 3.0), (2, 9, 10, 10.0), (3, 5, 1, 2.0)]


@pytest.mark.parametrize("strict", [True, False])
def test_literals_that_json_lacks(spark, strict):
    got = booking_lines(_tx(spark, LITERALS), strict=strict, keep_empty=False).collect()
    assert sorted((r.booking_id, r.product_id, r.quantity, r.item_price) for r in got) == LITERAL_ROWS
    kept = booking_lines(_tx(spark, LITERALS), strict=strict, keep_empty=True).collect()
    assert sorted(r.booking_id for r in kept if r.product_id is None) == [4, 5, 6]


def test_no_literal_at_all(spark):
    bad = _tx(spark, LITERALS + [(9, "[{'product_id': f(1)}]")])
    with pytest.raises(Exception, match="not a literal"):
        booking_lines(bad, strict=True).collect()
    assert len(booking_lines(bad, strict=False, keep_empty=False).collect()) == len(LITERAL_ROWS)


def test_clean_rows_dont_pass_through_python(spark, tmpdir_path):
    _tx(spark, LITERALS).write.parquet(f"{tmpdir_path}/tx")
    plan = booking_lines(spark.read.parquet(f"{tmpdir_path}/tx"))._jdf.queryExecution().executedPlan().toString()
    python, = [i for i, line in enumerate(plan.splitlines()) if "ArrowEvalPython" in line]
    below = plan.splitlines()[python + 1:]
    # the Python branch reads a filtered scan of its own; the other branch stands before it
    assert "NOT" in "".join(below) and "Filter" in "".join(below)
    assert "ArrowEvalPython" not in "".join(plan.splitlines()[:python])
    assert sum("Scan parquet" in line for line in below) == 1


OPEN_EVENTS = [
    (1, "e", "{'k': 5, 'x': 'a', 'odd name': 1.5}"), (2, "e", "{'x': 'b', 'mixed': 3, 'list': [1, 2]}"), (3, "e", None),
    (4, "e", "{'k': 0x10, 'mixed': 'three', 'flag': True,}"), (5, "e", "{'nothing': None, 'odd name': 2, 'd': {'q': 1}}"), (6, "other", "{'z': 1}"),
    (7, "e", "{}"), (8, "e", "[1, 2]"),
]


def test_a_column_for_every_key(spark):
    ev = spark.createDataFrame(OPEN_EVENTS, "event_id long, event_name string, event_metadata string")
    got = event_attributes(ev, "e")
    assert dict(got.dtypes) == {"event_id": "bigint", "d": "string", "flag": "boolean", "k": "bigint", "list": "string", "mixed": "string",
                                "nothing": "string", "odd name": "double", "x": "string"}
    rows = {r.event_id: r.asDict() for r in got.collect()}
    assert set(rows) == {1, 2, 3, 4, 5, 7, 8}
    assert (rows[1]["k"], rows[1]["x"], rows[1]["odd name"]) == (5, "a", 1.5)
    assert (rows[2]["mixed"], rows[2]["list"], rows[2]["k"]) == ("3", "[1,2]", None)
    assert (rows[4]["k"], rows[4]["mixed"], rows[4]["flag"]) == (16, "three", True)
    assert (rows[5]["odd name"], rows[5]["nothing"], rows[5]["d"]) == (2.0, None, '{"q":1}')
    for i in (3, 7, 8):
        assert all(v is None for c, v in rows[i].items() if c != "event_id")


def test_attribute_names_must_be_usable(spark):
    ev = spark.createDataFrame([(1, "e", "{'event_id': 5}")], "event_id long, event_name string, event_metadata string")
    with pytest.raises(ValueError, match="event_id"):
        event_attributes(ev, "e")
    many = spark.range(30).selectExpr("parse_json(concat('{\"k', id, '\": 1}')) AS _v")
    with pytest.raises(ValueError, match="more than 20"):
        attribute_types(many, most_keys=20)
    none = spark.createDataFrame([], "event_id long, event_name string, event_metadata string")
    assert event_attributes(none, "e").columns == ["event_id"]
