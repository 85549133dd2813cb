from shopstat.llm import common as C


def test_sieve_lets_every_wanted_row_through(spark, monkeypatch):
    rows = spark.range(2000).selectExpr("id AS doc_id", "concat('t', id) AS text")
    wanted = rows.filter("doc_id % 37 = 0").select("doc_id").union(rows.limit(1).selectExpr("-5L AS doc_id"))
    ids = lambda df: {r.doc_id for r in df.filter("_maybe").collect()}
    want = {i for i in range(2000) if i % 37 == 0}
    got = ids(C.sieved(rows, wanted, "doc_id"))
    assert want <= got and len(got) < 2 * len(want)
    assert sorted(r.doc_id for r in C.without(rows, wanted, "doc_id").collect()) == [i for i in range(2000) if i % 37]
    monkeypatch.setattr(C, "SIEVE_BITS", 64)             # a full bitmap only lets more through
    assert want <= ids(C.sieved(rows, wanted, "doc_id"))
    assert sorted(r.doc_id for r in C.without(rows, wanted, "doc_id").collect()) == [i for i in range(2000) if i % 37]
    assert ids(C.sieved(rows, wanted.limit(0), "doc_id")) == set()
    assert C.without(rows, wanted.limit(0), "doc_id").count() == 2000


def test_materialise_keeps_rows_and_schema(spark):
    df = spark.createDataFrame([(1, None), (None, "x")], "a bigint, b string")
    back = C.materialise(df, "t")
    assert back.schema == df.schema and back.exceptAll(df).count() == 0
    assert C.materialise(df.limit(0), "t").schema == df.schema


def test_let_evaluates_once(spark):
    from pyspark.sql import functions as F
    r = spark.range(1).select(C.let(F.rand(), lambda x: F.array(x, x)).alias("v")).first().v
    assert r[0] == r[1]
