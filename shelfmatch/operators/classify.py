"""Products to categories, by the categories' prototype vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmatch.functions.vectors import cosine, norm
from shelfmatch.operators.runtime import cross_blocks
from shelfmatch.operators.search import BLOCK, knn


def prototypes(vectors: DataFrame, category: str = "label", order: str = "vid", vector: str = "vector") -> DataFrame:
    """The first vector of each category."""
    return vectors.filter(F.col(category).isNotNull()).groupBy(category).agg(F.min_by(vector, order).alias("vector"), F.min(order).alias("first_seen"))


def classify_best(products: DataFrame, protos: DataFrame, category: str = "label") -> DataFrame:
    """``vid, best, similarity``: the most similar prototype of each product; the one first seen wins a tie.

    Prototypes are the queries that go to the products, so products aren't moved but for the final
    ``max_by``, which tasks combine first. A zero vector has no best category.
    """
    scored = knn_all(protos.select(F.struct("first_seen", category).alias("c"), "vector"), products)
    best = scored.groupBy("vid").agg(F.max_by(F.struct("c", "sim"), F.struct(F.round("sim", 9), (-F.col("c.first_seen")).alias("f"))).alias("b"))
    return best.select("vid", F.col(f"b.c.{category}").alias("best"), F.col("b.sim").alias("similarity"))


def knn_all(protos: DataFrame, products: DataFrame) -> DataFrame:
    """Similarity of every product to every prototype; prototypes, a row a category, go to the products in blocks."""
    given = products.select("vid", "vector").filter(norm("vector") > 0)
    pairs = cross_blocks(given, protos.select("c", F.col("vector").alias("pv")), "c", BLOCK)
    return pairs.select("vid", "c", cosine("vector", "pv").alias("sim"))


def classify_threshold(protos: DataFrame, products: DataFrame, threshold: float, most: int = 100, category: str = "label") -> DataFrame:
    """``label, vid, sim``: the ``most`` nearest products of each category that reach the threshold."""
    near = knn(protos.select(F.col(category).alias("qid"), "vector"), products, most)
    return near.filter(F.col("sim") >= threshold).select(F.col("qid").alias(category), "vid", "sim")
