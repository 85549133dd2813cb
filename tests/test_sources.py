import os

import pytest
from pyspark.sql import types as T

from shopstat.operators.clean import products_clean
from shopstat.sources.files import read_csv_typed, read_ragged_csv
from shopstat.sources.sinks import conform, write_table


def test_ragged_csv(spark, tmpdir_path):
    header = "id,gender,masterCategory,subCategory,articleType,baseColour,season,year,usage,productDisplayName"
    body = [
        "1,Men,Apparel,Topwear,Shirts,Navy Blue,Fall,2011,Casual,Turtle Check Men Navy Blue Shirt",
        "2,Women,Apparel,Bottomwear,Jeans,Blue,Summer,2012,Casual,Name, with comma,extra,fields",
        "3,Men,Footwear,Shoes",                                   # fewer than 10 fields
        "",                                                       # blank line
        '4,Men,Apparel,Topwear,Tshirts,"Red, Dark",NA,2013,Sports,Quoted',   # quoted comma
    ]
    data = ("\r\n".join([header] + body) + "\r\n").encode() + b"5,Men,Acc\xff,Watch,Watches,Black,,2014,,Bad byte\n"
    path = os.path.join(tmpdir_path, "product.csv")
    with open(path, "wb") as f:
        f.write(data)
    df = read_ragged_csv(spark, path, types={"id": T.LongType(), "year": T.LongType()})
    assert df.columns == header.split(",")
    rows = {r.id: r for r in df.collect()}
    assert set(rows) == {1, 2, 3, 4, 5}
    assert rows[2].productDisplayName == "Name"                # only the first 10 pieces
    assert rows[3].articleType is None and rows[3].year is None
    # the quoted comma cuts, the quote then holds both pieces together
    assert (rows[4].baseColour, rows[4].season, rows[4].year, rows[4].usage) == ("Red\t Dark", None, 2013, "Sports")
    assert rows[4].productDisplayName is None                  # the eleventh piece is cut off
    assert rows[5].masterCategory == "Acc" and rows[5].season is None
    assert rows[1].productDisplayName == "Turtle Check Men Navy Blue Shirt"


def test_typed_csv_na_tokens(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "t.csv")
    with open(path, "w") as f:
        f.write("a,b,c\n1,2024-01-02 03:04:05,x\nNA,None,\nN/A,bad,y\n")
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.TimestampNTZType()),
                           T.StructField("c", T.StringType())])
    rows = read_csv_typed(spark, path, schema, lenient=True).collect()
    assert rows[0].a == 1 and rows[0].b.year == 2024 and rows[1].a is None and rows[1].c is None
    assert rows[2].b is None
    with pytest.raises(Exception):
        read_csv_typed(spark, path, schema, lenient=False).collect()


def test_conform_and_sink_roundtrip(spark, tmpdir_path):
    df = spark.createDataFrame([(1, 123.455, "7")], "id long, amt double, n string")
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("amt", T.DecimalType(18, 2)),
                           T.StructField("n", T.IntegerType()), T.StructField("missing", T.StringType())])
    out = conform(df, schema)
    assert out.schema == T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields]) \
        or [f.dataType for f in out.schema.fields] == [f.dataType for f in schema.fields]
    assert float(out.first().amt) == 123.46
    path = os.path.join(tmpdir_path, "tbl")
    write_table(out, path)
    back = spark.read.parquet(path)
    assert [f.dataType for f in back.schema.fields] == [f.dataType for f in schema.fields]
    bad = spark.createDataFrame([("x",)], "n string")
    with pytest.raises(Exception):
        conform(bad, T.StructType([T.StructField("n", T.IntegerType())])).collect()
    assert conform(bad, T.StructType([T.StructField("n", T.IntegerType())]), lenient=True).first().n is None


def test_products_lookup_left_join(spark):
    prods = spark.createDataFrame(
        [(1, "Men", "Apparel", "Topwear", "Shirts", "Blue", None, 2011, None, "A"),
         (2, "Women", "Apparel", None, "Jeans", "Red", "Fall", 2012, "Casual", "B"),
         (3, "Men", "Foot", "Shoes", "Boots", "Black", None, None, None, "C")],
        "id long, gender string, masterCategory string, subCategory string, articleType string, "
        "baseColour string, season string, year long, usage string, productDisplayName string")
    lookup = spark.createDataFrame(
        [("Apparel-Topwear-Shirts", "Clothes", "Tops", "Shirt"), ("Apparel-nan-Jeans", "Clothes", "Other", "Jeans")],
        "original_name_concat string, masterCategory_new string, subCategory_new string, articleType_new string")
    got = {r.prod_id: r for r in products_clean(prods, lookup, fill_not_set=True).collect()}
    assert got[1].category_level_2 == "Tops" and got[2].category_level_2 == "Other"   # null level prints nan
    assert got[3].category_level_1 is None                                            # unmatched key
    assert got[1].season == "Not set" and got[2].usage == "Casual"


def test_bucketed_table_and_catalog(spark, tmpdir_path):
    from shopstat.sources.sinks import tables_exist
    df = spark.range(0, 100).selectExpr("id AS booking_id", "id % 7 AS customer_id")
    write_table(df, os.path.join(tmpdir_path, "b"), table="bucketed_tx", bucket_by=["customer_id"],
                num_buckets=4, sort_by=["customer_id"])
    assert tables_exist(spark, ["bucketed_tx", "no_such_table"]) == {"bucketed_tx": True, "no_such_table": False}
    t = spark.table("bucketed_tx")
    plan = t.groupBy("customer_id").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan          # bucketed layout satisfies the grouping: no shuffle
    spark.sql("DROP TABLE bucketed_tx")


def test_transactions_clean_from_text(spark):
    from shopstat.operators.clean import TRANSACTIONS_SCHEMA, transactions_clean
    raw = spark.createDataFrame(
        [(1, 10, 10, "2024-01-01 23:59:59.700", "2024-01-02 00:00:01", 0.0, 0.0, None, "card", "P", 123.455),
         (2, 11, 11, "2024-01-01 10:00:00", "2024-01-03 09:00:00", 5.0, 1.5, "X", None, "F", None)],
        "booking_id long, session_id long, customer_id long, created_at string, shipment_date_limit string, "
        "shipment_fee double, promo_amount double, promo_code string, payment_method string, "
        "payment_status string, total_amount double")
    rows = {int(r.booking_id): r for r in transactions_clean(raw).collect()}
    assert [f.dataType for f in transactions_clean(raw).schema.fields] == [f.dataType for f in TRANSACTIONS_SCHEMA.fields]
    assert rows[1].created_at.microsecond == 0 and rows[1].days_to_shipment == 0
    assert rows[1].has_free_shipping == 1 and rows[1].has_promo == 0 and float(rows[1].total_amount) == 123.46
    assert rows[2].days_to_shipment == 1 and rows[2].promo_flag == 1 and rows[2].total_amount is None


def test_read_lookup_csv_and_parquet(spark, tmpdir_path):
    from shopstat.sources.files import read_lookup
    path = os.path.join(tmpdir_path, "lookup.csv")
    with open(path, "w") as f:
        f.write("original_name_concat,masterCategory_new\nA-B-C,New A\n")
    csv = read_lookup(spark, path)
    assert [tuple(r) for r in csv.collect()] == [("A-B-C", "New A")]
    pq = os.path.join(tmpdir_path, "lookup.parquet")
    csv.write.parquet(pq)
    assert read_lookup(spark, pq, fmt="parquet").count() == 1


def test_command_line(spark, capsys):
    from shopstat.__main__ import main
    assert main(["list"]) == 0
    listed = capsys.readouterr().out.split()
    assert "dm_transactions" in listed and len(listed) == 58
    assert main(["test", "1", "segment", "/root/testdata/sf0.001"]) == 0
    assert "t-statistic" in capsys.readouterr().out


def _pandas_rows(path, cols):
    import pandas as pd
    frame = pd.read_csv(path, dtype=str)[cols]
    return [tuple(None if pd.isna(v) else v for v in row) for row in frame.itertuples(index=False)]


def test_csv_by_name_quotes_breaks_and_tokens_as_pandas(spark, tmpdir_path):
    from shopstat.functions.text import NA_TOKENS
    path = os.path.join(tmpdir_path, "q.csv")
    with open(path, "w", newline="") as f:
        f.write('b,extra,a\n"say ""hi"", then",1,x\n"two\nlines",2,y\nplain,3,"O\'Neil"\n')
        f.writelines(f"{t},4,z{i}\n" for i, t in enumerate(NA_TOKENS))
    schema = T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.StringType())])
    got = [tuple(r) for r in read_csv_typed(spark, path, schema).collect()]
    assert sorted(got) == sorted(_pandas_rows(path, ["a", "b"])) if all(None not in r for r in got) else \
        sorted(got, key=str) == sorted(_pandas_rows(path, ["a", "b"]), key=str)
    assert sum(r[1] is None for r in got) == len(NA_TOKENS) == 19
    with pytest.raises(ValueError, match="lacks c"):
        read_csv_typed(spark, path, T.StructType([T.StructField("c", T.StringType())]))


def test_strict_csv_raises_on_rows_of_wrong_length(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "w.csv")
    with open(path, "w") as f:
        f.write("a,b\n1,2\n1,2,3\n")
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
    with pytest.raises(Exception):
        read_csv_typed(spark, path, schema).collect()
    assert read_csv_typed(spark, path, schema, lenient=True).count() == 2


def test_failing_overwrite_keeps_the_old_table(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "keep")
    write_table(spark.range(5), path)
    bad = spark.range(5).selectExpr("CAST(concat('x', id) AS INT) AS id")
    with pytest.raises(Exception):
        write_table(bad, path)
    assert spark.read.parquet(path).count() == 5 and os.listdir(tmpdir_path) == ["keep"]
    write_table(spark.read.parquet(path).filter("id < 3"), path)       # rows of the old table itself
    assert spark.read.parquet(path).count() == 3
    write_table(spark.range(4), table="kept_tbl")
    with pytest.raises(Exception):
        write_table(bad, table="kept_tbl")
    assert spark.table("kept_tbl").count() == 4
    write_table(spark.range(6), table="kept_tbl")
    assert spark.table("kept_tbl").count() == 6
    spark.sql("DROP TABLE kept_tbl")


RAW = {
    "transactions.csv": """booking_id,customer_id,session_id,created_at,shipment_date_limit,shipment_fee,promo_amount,promo_code,payment_method,payment_status,total_amount,product_metadata
b-1,1,s-1,2024-01-01T10:00:00.500000Z,2024-01-03T10:00:00.000000Z,0,10,P1,Card,Success,250000,"[{'product_id': 11, 'quantity': 2, 'item_price': 125000}]"
b-2,1,s-2,2024-01-02T10:00:00Z,2024-01-03T09:00:00Z,5000,0,,Cash,Success,90000,"[{'product_id': 12, 'quantity': 1, 'item_price': 85000}, {'product_id': 11, 'quantity': None, 'item_price': 1}]"
b-3,2,s-3,2024-01-02T11:00:00Z,2024-01-05T09:00:00Z,5000,0,NA,Cash,Failed,1000,[]
""",
    "click_stream.csv": """session_id,event_name,event_time,event_id,traffic_source,event_metadata
s-1,HOMEPAGE,2024-01-01T09:00:00.100Z,e1,MOBILE,
s-1,ADD_TO_CART,2024-01-01T09:01:00Z,e2,MOBILE,"{'product_id': 11, 'quantity': 2, 'item_price': 1250.005}"
s-1,BOOKING,2024-01-01T09:02:00Z,e3,MOBILE,{'payment_status': 'Success'}
s-2,CLICK,2024-01-02T09:00:00Z,e4,WEB,
""",
    "product.csv": """id,gender,masterCategory,subCategory,articleType,baseColour,season,year,usage,productDisplayName
11,Men,Apparel,Topwear,Shirts,"Red, Dark",Fall,2011,Casual,Shirt
12,Women,Footwear,Shoes,Boots,Black,Winter,2012,Casual,Boots
""",
    "customer.csv": """customer_id,gender,birthdate,device_type,device_version,home_location
1,F,1990-05-01,Android,9.0,Jakarta
2,M,,iOS,12,Bali
""",
    "lookup.csv": """original_name_concat,masterCategory_new,subCategory_new,articleType_new
Apparel-Topwear-Shirts,Clothes,Tops,Shirt
""",
}


def test_build_from_the_shops_own_files(spark, tmpdir_path):
    from shopstat.operators import clean
    from shopstat.plans.batch import build_tables
    from shopstat.sources.shop import SHOP_EVENTS, ShopFiles
    for name, text in RAW.items():
        with open(os.path.join(tmpdir_path, name), "w") as f:
            f.write(text)
    source = ShopFiles(spark, tmpdir_path, os.path.join(tmpdir_path, "lookup.csv"))
    paths = build_tables(spark, source, os.path.join(tmpdir_path, "out"))
    read = lambda n: spark.read.parquet(paths[n])
    declared = {"rd_transactions": clean.TRANSACTIONS_SCHEMA, "rd_customers": clean.CUSTOMERS_SCHEMA, "rd_prods": clean.PRODUCTS_SCHEMA,
                "rd_events_add_to_cart": clean.CART_SCHEMA, "rd_sessions": clean.sessions_schema(SHOP_EVENTS.counted, SHOP_EVENTS.markers)}
    for name, schema in declared.items():
        assert [(f.name, f.dataType) for f in read(name).schema.fields] == [(f.name, f.dataType) for f in schema.fields], name
    assert [f.name for f in read("rd_transactions_prods").schema.fields] == [f.name for f in clean.LINES_SCHEMA.fields] + ["id"]
    assert sorted(r.id for r in read("rd_transactions_prods").collect()) == [1, 2, 3, 4]
    tx = {r.booking_id: r for r in read("rd_transactions").collect()}
    assert tx["b-1"].created_at.microsecond == 0 and tx["b-3"].promo_code is None and tx["b-1"].has_free_shipping == 1
    cart = read("rd_events_add_to_cart").first()
    assert (cart.event_id, cart.prod_id, cart.quantity, float(cart.item_price), float(cart.prod_amount)) == ("e2", 11, 2, 1250.0, 2500.01)
    cust = {r.customer_id: r for r in read("rd_customers").collect()}
    assert (cust[1].gender, cust[1].device_type, cust[2].birthdate) == ("F", "Android", None)
    prods = {r.prod_id: r for r in read("rd_prods").collect()}
    assert prods[11].category_level_2 == "Tops" and prods[12].category_level_1 is None
    sess = {r.session_id: r for r in read("rd_sessions").collect()}
    assert sess["s-1"].ADD_TO_CART_cnt == 1 and sess["s-1"].BOOKING_time is not None and sess["s-2"].step2_time is not None
    mart = {r.booking_id: r for r in read("dm_transactions").collect()}
    assert set(mart) == {"b-1", "b-2"} and mart["b-2"].booking_number == 2
    assert {"has_BOOKING", "has_CLICK"} <= set(read("dm_sessions").columns)


def test_build_stops_on_a_bad_key(spark, tmpdir_path):
    from shopstat.plans.batch import build_tables
    from shopstat.sources.shop import ShopFiles
    for name, text in RAW.items():
        with open(os.path.join(tmpdir_path, name), "w") as f:
            f.write(text.replace("b-2,1", "b-1,1") if name == "transactions.csv" else text)
    source = ShopFiles(spark, tmpdir_path, os.path.join(tmpdir_path, "lookup.csv"))
    with pytest.raises(ValueError, match="rd_transactions.booking_id: 0 null, 1 duplicate"):
        build_tables(spark, source, os.path.join(tmpdir_path, "out"))
