import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmatch.operators import evaluate, products, report, textsearch
from shelfmatch.operators.search import knn, knn_columns
from shelfmatch.sources.store import VectorTable

PRODUCTS = "ProductCode string, ProductDescription string, ord long"
MAPPING = "Fulton_code string, Pritzlaff_code string, Queen_code string, Moesle_code string, Anmar_code string, USDA_Code string, ord long"


def test_build_and_search(spark, tmp_path):
    raw = spark.createDataFrame([("51-1", "Beef  Round Steak", 0), ("2", "beef round steak", 1), ("3", "Pork Loin", 2), (None, "x", 3), ("4", None, 4), ("5", "Chicken Wing", 5)], PRODUCTS)
    mapping = spark.createDataFrame([("51", None, None, None, None, "BEEF", 0), (None, "3", None, None, None, "PORK", 1), ("9", None, None, None, None, None, 2)], MAPPING)
    table = VectorTable(spark, str(tmp_path / "v"))
    rows = {r.product_description: (r.id, r.product_code, r.usda_code) for r in textsearch.build(raw, mapping, table, textsearch.HashEmbedder()).collect()}
    assert rows == {"beef round steak": ("item_0", "51-1", "BEEF"), "chicken wing": ("item_1", "5", "NOT_FOUND"), "pork loin": ("item_2", "3", "PORK")}
    flat = table.df().select("id", "vector", "metadata.*")
    asked = spark.createDataFrame([("round beef",), ("pork",), (None,), ("pork",)], "query string")
    found = textsearch.search_text(asked, flat, textsearch.HashEmbedder(), 1, 0.2, expected=["product_description", "price"])
    assert found.columns[:5] == ["query", "rk", "id", "product_description", "price"]
    assert {(r.query, r.product_description, r.price) for r in found.collect()} == {("round beef", "beef round steak", "N/A"), ("pork", "pork loin", "N/A")}
    assert textsearch.search_text(asked, flat, textsearch.HashEmbedder(), 1, 2.0).count() == 0
    took = evaluate.latency(lambda q: textsearch.search_text(spark.createDataFrame([(q,)], "query string"), flat, textsearch.HashEmbedder()), ["pork", "beef"])
    assert took["n"] == 2 and 0 < took["min"] <= took["avg"] <= took["max"]


def test_model_embedder(spark):
    model = textsearch.ModelEmbedder(spark, lambda: lambda texts: np.array([[len(t), t.count("a"), 1.0] for t in texts]))
    got = spark.createDataFrame([("banana",), (None,)], "t string").select(model(F.col("t")).alias("v")).collect()
    assert [r.v for r in got] == [[6.0, 3.0, 1.0], [0.0, 0.0, 1.0]]


def test_own_text_is_no_hit(spark):
    rows = [(1, "A b", [1.0, 0.0]), (2, " a B ", [1.0, 0.0]), (3, "a c", [0.9, 0.1]), (4, None, [0.9, 0.1]), (5, "z", [0.0, 1.0])]
    table = spark.createDataFrame(rows, "vid long, text string, vector array<double>")
    found = textsearch.mutual_search_text(table.filter("vid = 1").withColumnRenamed("vid", "qid"), table)
    assert [(r.vid, r.rk) for r in found.orderBy("rk").collect()] == [(3, 1), (4, 2)]


def test_searches_agree(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.integers(-2, 3, 6).astype(float).tolist()) for i in range(5000)] + [(6000, [0.0] * 6), (6001, None), (6002, [None, 1.0, 0.0, 0.0, 0.0, 0.0])]
    vectors = spark.createDataFrame(rows, "vid long, vector array<double>").repartition(3)
    queries = vectors.filter("vid % 500 = 0").withColumnRenamed("vid", "qid")
    one, two = ({(r.qid, r.vid, r.rk, round(r.sim, 6)) for r in f(queries, vectors, 7).collect()} for f in (knn, knn_columns))
    assert one == two and len(one) == 7 * queries.count()


def test_texts_that_are_no_numbers(spark):
    rows = spark.createDataFrame([("A ", "1.5", 2.0), ("a", None, None)], "product_description string, price string, quantity double")
    assert products.build_product_metrics(rows).select("transaction_count", "avg_price").collect() == [(2, 1.5)]
    assert dict(products.soft_cast(rows, {"price": "double", "quantity": "long"}).dtypes) == {"product_description": "string", "price": "double", "quantity": "bigint"}
    bad = rows.unionAll(spark.createDataFrame([("b", "dear", 1.0)], rows.schema))
    assert dict(products.soft_cast(bad, {"price": "double"}).dtypes)["price"] == "string"
    with pytest.raises(Exception, match="no number"):
        products.build_product_metrics(bad).collect()


def test_reports(spark):
    df = spark.createDataFrame([("a", 1, 0.5), ("bcd", 22, None)], "name string, n long, x double")
    assert report.console(df) == "name   n       x\n----  --  ------\na      1  0.5000\nbcd   22\n"
    judged = spark.createDataFrame([(1, "a", 0.5, "a", True), (2, "b", 0.7, "a", False), (3, "b", 0.1, None, None)], "vid long, best string, similarity double, known string, is_correct boolean")
    text = report.markdown(report.match_accuracy(judged), report.similarity_stats(judged), report.correct_vs_incorrect(judged), stamp="end")
    assert "- correct: 1 (50.00%)" in text and "- median: 0.5000" in text and text.endswith("end\n")
