"""Precision, recall and F1 of searches and classifications."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmatch.functions.text import word_boundary_match
from shelfmatch.operators.search import knn


def ratio(a, b) -> Column:
    """0 where the divisor is 0."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def with_scores(df: DataFrame, tp: str, predicted, actual) -> DataFrame:
    df = df.withColumn("precision", ratio(tp, predicted)).withColumn("recall", ratio(tp, actual))
    return df.withColumn("f1", ratio(F.lit(2.0) * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def evaluate_mutual_search(queries: DataFrame, matches: DataFrame, categories: DataFrame) -> DataFrame:
    """One row: queries with a category, hits, correct hits and scores; a query counts once however many
    of its hits are right, so recall may pass 1. ``categories(vid, label)``."""
    known = queries.join(categories.select(F.col("vid").alias("qid"), F.col("label").alias("truth")), "qid").filter("truth is not null")
    rows = known.select("qid", "truth").join(matches.select("qid", "vid"), "qid", "left").join(categories.select("vid", "label"), "vid", "left")
    one = rows.agg(F.count_distinct("qid").alias("queries"), F.count("vid").alias("returned"), F.count_if(F.col("label") == F.col("truth")).alias("correct"))
    return with_scores(one, "correct", "returned", "queries")


def classification_metrics(predicted: DataFrame, truth: DataFrame, category: str = "label") -> DataFrame:
    """Per category, over distinct products: sizes, true and false positives, false negatives, scores."""
    p = predicted.select(category, "vid").distinct().withColumn("p", F.lit(1))
    t = truth.select(category, "vid").distinct().withColumn("t", F.lit(1))
    by = p.join(t, [category, "vid"], "full_outer").groupBy(category).agg(
        F.count("t").alias("n_true_products"), F.count("p").alias("n_predicted"), F.count_if(F.col("p").isNotNull() & F.col("t").isNotNull()).alias("true_positives")
    )
    by = by.withColumn("false_positives", F.col("n_predicted") - F.col("true_positives")).withColumn("false_negatives", F.col("n_true_products") - F.col("true_positives"))
    return with_scores(by, "true_positives", "n_predicted", "n_true_products")


def classification_overall(metrics: DataFrame) -> DataFrame:
    one = metrics.agg(
        F.count(F.lit(1)).alias("categories"), F.sum("n_true_products").alias("n_true_products"), F.sum("n_predicted").alias("n_predicted"), F.sum("true_positives").alias("true_positives")
    ).withColumn("avg_products", ratio("n_true_products", "categories"))
    return with_scores(one, "true_positives", "n_predicted", "n_true_products")


def rating(c: str) -> Column:
    return F.when(F.col(c) >= 0.8, "excellent").when(F.col(c) >= 0.6, "good").when(F.col(c) >= 0.4, "moderate").otherwise("poor")


def cluster_recall(found: DataFrame, variants: DataFrame) -> DataFrame:
    """``cluster, variants, found, recall``; ``found(cluster, description)``, ``variants(cluster, description)``; case is ignored."""
    low = lambda d: d.select("cluster", F.lower("description").alias("d")).distinct()
    rows = low(variants).join(low(found).withColumn("hit", F.lit(1)), ["cluster", "d"], "left")
    by = rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("variants"), F.count("hit").alias("found"))
    return by.withColumn("recall", ratio("found", "variants"))


def cluster_summary(recalls: DataFrame) -> DataFrame:
    """One row from ``cluster_recall``: clusters, mean recall, recall over all variants, perfect clusters and those without a find."""
    return recalls.agg(
        F.count(F.lit(1)).alias("clusters"), F.coalesce(F.avg("recall"), F.lit(0.0)).alias("mean_recall"),
        ratio(F.sum("found"), F.sum("variants")).alias("overall_recall"), F.count_if(F.col("found") == F.col("variants")).alias("perfect"), F.count_if(F.col("found") == 0).alias("none"),
    )


def worst_clusters(recalls: DataFrame, n: int = 3) -> DataFrame:
    """The ``n`` clusters of least recall, ties by name."""
    return recalls.orderBy("recall", "cluster").limit(n)


def recall_sweep(found: DataFrame, variants: DataFrame, grid: list[float]) -> DataFrame:
    """``threshold, cluster, variants, found, recall``; ``found(cluster, description, sim)``. Each variant is joined with its
    similarity once; the grid is then counted in one pass."""
    rows = variants.join(found, ["cluster", "description"], "left")
    each = rows.select("cluster", "sim", F.explode(F.lit(grid)).alias("threshold"))
    by = each.groupBy("threshold", "cluster").agg(F.count(F.lit(1)).alias("variants"), F.count_if(F.col("sim") >= F.col("threshold")).alias("found"))
    return by.withColumn("recall", ratio("found", "variants"))


def word_matches(variants: DataFrame, clusters: DataFrame, by: str = "cluster") -> DataFrame:
    """``cluster, c, description`` of the pairs of one cluster of which one text holds the other between word boundaries."""
    return clusters.join(variants, by).filter(word_boundary_match("c", "description")).select(by, "c", "description")


def evaluate_retrieval(vectors: DataFrame, clusters: DataFrame, most: int = 10) -> DataFrame:
    """One row: each member of a cluster queries for the others; a hit counts if it matches one of them at word boundaries.

    ``vectors(vid, vector)`` by description, ``clusters(cluster, description)``. The hits asked for are ``most``, or as many
    as there are vectors. Hits are joined with their query's cluster, so a cluster costs hits times members and no
    pair of members is listed."""
    k = min(most, vectors.count())
    hits = knn(vectors.withColumnRenamed("vid", "qid"), vectors, k).select(F.col("qid").alias("q"), F.col("vid").alias("hit"))
    size = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("members"))
    member = clusters.join(size.filter("members > 1"), "cluster").select("cluster", F.col("description").alias("q"), (F.col("members") - 1).alias("expected"))
    asked = hits.join(member, "q")
    other = clusters.select("cluster", F.col("description").alias("c"))
    good = asked.join(other, "cluster").filter("q <> c").groupBy("cluster", "q", "hit").agg(F.first("expected").alias("expected"), F.bool_or(word_boundary_match("c", "hit")).alias("good"))
    per = good.groupBy("cluster", "q").agg(F.count(F.lit(1)).alias("matched"), F.count_if("good").alias("correct"), F.first("expected").alias("expected"))
    one = per.agg(
        F.count(F.lit(1)).alias("total_queries"), F.sum("correct").alias("correct_matches"), F.sum(F.col("matched") - F.col("correct")).alias("false_positives"),
        F.sum(F.col("expected") - F.col("correct")).alias("false_negatives"), F.sum("matched").alias("returned"), F.sum("expected").alias("expected"),
    )
    return with_scores(one, "correct_matches", "returned", "expected")


def latency(search: Callable[[str], DataFrame], queries: list[str]) -> dict[str, float]:
    """Seconds of single searches, each run to its end: average, least and most."""
    took = []
    for q in queries:
        t = time.perf_counter()
        search(q).collect()
        took.append(time.perf_counter() - t)
    return {"n": len(took), "avg": sum(took) / max(1, len(took)), "min": min(took, default=0.0), "max": max(took, default=0.0)}
