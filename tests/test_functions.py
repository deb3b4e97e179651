import pytest
from pyspark.sql import functions as F

from shelfmatch.functions import text as tx
from shelfmatch.functions import vectors as vec
from shelfmatch.functions.codes import normalize_code
from shelfmatch.operators import products
from shelfmatch.operators.search import knn, where


def _map(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v"))).collect()]


def test_normalize_code(spark):
    given = ["51040948", "1040948", "1040948-2", "51040948-12", "7", "AB-12", "12-3-4", "", None]
    assert _map(spark, given, normalize_code) == ["1040948", "040948", "040948", "1040948", "7", "AB", "12-3", "", None]


def test_text(spark):
    given = ["Bnls Rnd Stk", "bnls rnd stk", "Sh Cut Rst-Rdy Trmd", "Tenderloin", None, ""]
    assert _map(spark, given, tx.expand_abbreviations) == ["Boneless Round Steak", "bnls rnd stk", "Short Cut Roast-Ready Trimmed", "Tenderloin", None, ""]
    assert _map(spark, ["  A   B\t", None, " x y"], tx.clean_text) == ["a b", None, "x y"]
    assert _map(spark, ["Bnls Stk"], tx.clean_and_expand) == ["bnls stk"]
    assert _map(spark, ["Bnls Stk"], lambda c: tx.clean_and_expand(c, False)) == ["Boneless Steak"]
    assert _map(spark, ["a; B ;c"], tx.variants) == [["a", "B", "c"]]


def test_enhanced_description(spark):
    df = spark.createDataFrame([("organic milk", 4.99, 32.5), ("x", None, None)], "d string, p double, q double")
    got = [r[0] for r in df.select(tx.enhanced_description("d", "p", "q")).collect()]
    assert got == ["organic milk, average price: $4.99, average quantity: 32.5", "x"]


def test_cosine_of_zero_vector(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 2.0]), ([2.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(vec.cosine("a", "b")).collect()] == [0.0, 1.0]


def test_fuzzy_headers(spark):
    df = spark.createDataFrame([(" Milk ", "1.5", "2")], "`The Product Long Description` string, `Unit Price` string, `Quantity` string")
    assert products.clean_transactions(df).first().asDict() == {"product_description": "milk", "price": 1.5, "quantity": 2}
    with pytest.raises(ValueError):
        products.clean_transactions(spark.createDataFrame([("a",)], "`Product Description` string"))


def test_soft_cast_keeps_what_fails(spark):
    df = spark.createDataFrame([("1", "x"), ("2", "3")], "a string, b string")
    assert dict(products.soft_cast(df, {"a": "long", "b": "long"}).dtypes) == {"a": "bigint", "b": "string"}


def test_knn_blocks_and_ties(spark, monkeypatch):
    from shelfmatch.operators import search

    monkeypatch.setattr(search, "BLOCK", 2)
    rows = spark.createDataFrame([(i, [1.0, float(i // 2)]) for i in range(6)], "vid long, vector array<double>")
    got = knn(rows.withColumnRenamed("vid", "qid"), rows, 2).orderBy("qid", "rk").collect()
    assert [(r.qid, r.vid) for r in got] == [(q, q // 2 * 2 + j) for q in range(6) for j in range(2)]
    assert knn(rows.filter("vid < 0").withColumnRenamed("vid", "qid"), rows, 2).count() == 0


def test_where(spark):
    df = spark.range(10).withColumn("k", F.col("id") % 3)
    assert df.filter(where({"$and": [{"k": 1}, {"id": {"$gt": 1, "$lte": 7}}]})).count() == 2
    assert df.filter(where(None)).count() == 10


def test_surrogate_ids_are_dense(spark):
    df = spark.createDataFrame([(f"d{i:03d}",) for i in range(57)], "d string")
    got = products.surrogate_ids(df, "d").orderBy("d").collect()
    assert [r["id"] for r in got] == [f"item_{i}" for i in range(57)]
