"""Vector tables: id, vector and a struct of metadata, as Parquet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmatch.operators.search import FINAL, INITIAL, bidirectional, knn, where

METADATA = ["product_description", "product_code", "usda_code"]


def metadata(df: DataFrame, columns: list[str] = METADATA) -> Column:
    """A struct of strings, 'N/A' for null; raises if a column is absent."""
    absent = [c for c in columns if c not in df.columns]
    if absent:
        raise ValueError(f"Missing metadata columns: {absent}")
    return F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("N/A")).alias(c) for c in columns])


def absent_rows(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Rows of ``new`` whose id ``old`` doesn't have; of repeated ids one row."""
    return new.dropDuplicates([key]).join(old.select(key), key, "left_anti")


class VectorTable:
    """``id string, vector array<double>, metadata struct`` at a path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def exists(self) -> bool:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def df(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def add(self, rows: DataFrame, recreate: bool = False) -> None:
        """Append rows with new ids, or start anew."""
        if recreate or not self.exists():
            rows.dropDuplicates(["id"]).write.mode("overwrite").parquet(self.path)
        else:
            absent_rows(self.df(), rows).write.mode("append").parquet(self.path)

    def count(self) -> int:
        return self.df().count()

    def get(self, ids: list[str]) -> DataFrame:
        return self.df().filter(F.col("id").isin(list(ids)))

    def search(self, queries: DataFrame, k: int = FINAL, threshold: float | None = None, condition: dict | None = None, candidates: int = INITIAL) -> DataFrame:
        """``queries(qid, vector)`` -> hits with similarities and metadata, the full schema also when there are none."""
        rows = self.df().select("id", "vector", "metadata.*").filter(where(condition))
        near = knn(queries, rows.select(F.col("id").alias("vid"), "vector"), candidates)
        found = bidirectional(near, threshold, k).join(rows.drop("vector").withColumnRenamed("id", "vid"), "vid")
        return found.select("qid", F.col("vid").alias("id"), "rk", "forward_similarity", "backward_similarity", "bi_directional_similarity", (1 - F.col("forward_similarity")).alias("distance"), *METADATA)
