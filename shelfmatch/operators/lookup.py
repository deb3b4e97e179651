"""Code -> category lookups from a mapping of several code columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmatch.functions.codes import NOT_FOUND, normalize_code
from shelfmatch.functions.text import strip

ID_COLUMNS = ["Fulton_code", "Pritzlaff_code", "Queen_code", "Moesle_code", "Anmar_code"]
TARGET = "USDA_Code"
BROADCAST_ROWS = 1_000_000


def _unpivot(mapping: DataFrame, id_columns: list[str], target: str, order: str) -> DataFrame:
    """``target, row_ord, col_ord, code`` of every code that isn't null."""
    cells = F.array(*[F.struct(F.lit(i).alias("col_ord"), F.col(c).cast("string").alias("code")) for i, c in enumerate(id_columns)])
    return mapping.filter(F.col(target).isNotNull()).select(F.col(target).alias("target"), F.col(order).alias("row_ord"), F.inline(cells)).filter("code is not null")


def build_code_lookup(mapping: DataFrame, order: str, id_columns: list[str] = ID_COLUMNS, target: str = TARGET, normalize: bool = True) -> DataFrame:
    """``code, target``: of rows with the same normalised code the last in (row, column) order wins."""
    rows = _unpivot(mapping, id_columns, target, order).withColumn("code", normalize_code("code") if normalize else strip("code")).filter("code <> ''")
    return rows.groupBy("code").agg(F.max_by("target", F.struct("row_ord", "col_ord")).alias("target"))


def known_categories(mapping: DataFrame, products: DataFrame, code: str, order: str, id_columns: list[str] = ID_COLUMNS, target: str = TARGET) -> DataFrame:
    """``code, target`` for codes of ``products``; the last wins by (category as first seen, row, column)."""
    rows = _unpivot(mapping, id_columns, target, order).withColumn("code", strip("code"))
    seen = mapping.filter(F.col(target).isNotNull()).groupBy(F.col(target).alias("target")).agg(F.min(order).alias("cat_ord"))
    rows = rows.join(seen, "target").join(products.select(F.col(code).alias("code")).distinct(), "code", "left_semi")
    return rows.groupBy("code").agg(F.max_by("target", F.struct("cat_ord", "row_ord", "col_ord")).alias("target"))


def ground_truth_pairs(mapping: DataFrame, products: DataFrame, code: str, order: str, id_columns: list[str] = ID_COLUMNS, target: str = TARGET) -> DataFrame:
    rows = _unpivot(mapping, id_columns, target, order).select("target", strip("code").alias("code"))
    return rows.join(products.select(F.col(code).alias("code")), "code", "left_semi").select("target", "code").distinct()


def attach_category(products: DataFrame, lookup: DataFrame, code: str, normalize: bool = True) -> DataFrame:
    """``products`` with ``usda_code``, 'NOT_FOUND' where the lookup has none. The lookup is broadcast if it is small."""
    keys = lookup.select(F.col("code").alias("_code"), F.col("target").alias("usda_code"))
    if lookup.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        keys = F.broadcast(keys)
    own = normalize_code(code) if normalize else F.col(code)
    return products.withColumn("_own", own).join(keys, F.col("_own") == F.col("_code"), "left").withColumn("usda_code", F.coalesce("usda_code", F.lit(NOT_FOUND))).drop("_own", "_code")


def distinct_categories(mapping: DataFrame, order: str, target: str = TARGET) -> DataFrame:
    """Categories with the row in which each was first seen."""
    return mapping.filter(F.col(target).isNotNull()).groupBy(target).agg(F.min(order).alias("first_seen"))


def lookup_counters(mapping: DataFrame, id_columns: list[str] = ID_COLUMNS, target: str = TARGET) -> DataFrame:
    """One row: rows, rows skipped for want of a category, rows used, codes that are not null and codes that are empty when normalised."""
    used = F.col(target).isNotNull()
    codes = F.filter(F.array(*[F.col(c).cast("string") for c in id_columns]), lambda c: c.isNotNull())
    empty = F.size(F.filter(codes, lambda c: normalize_code(c) == ""))
    zero = lambda c: F.coalesce(F.sum(F.when(used, c)), F.lit(0))
    return mapping.agg(F.count(F.lit(1)).alias("total_rows"), F.count_if(~used).alias("skipped_rows"), F.count_if(used).alias("processed_rows"), zero(F.size(codes)).alias("codes"), zero(empty).alias("empty_codes"))


def unmapped_count(products: DataFrame, category: str = "usda_code") -> DataFrame:
    """One row: products, and those without a category."""
    return products.agg(F.count(F.lit(1)).alias("products"), F.count_if(F.col(category) == NOT_FOUND).alias("unmapped"))
