"""From transactions to products."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from shelfmatch.functions.text import clean_and_expand, normalize_description

REQUIRED = {"product_description": "string", "price": "double", "quantity": "long"}


def normalize_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower().replace(" ", "_") for c in df.columns])


def resolve_columns(df: DataFrame, required=tuple(REQUIRED)) -> DataFrame:
    """Rename a header that alone resembles a missing one; raise if one is still missing or is claimed twice."""
    claims: dict[str, str] = {}
    missing = []
    for want in (c for c in required if c not in df.columns):
        like = re.compile(".*" + ".*".join(map(re.escape, want.split("_"))) + ".*", re.IGNORECASE)
        found = [c for c in df.columns if like.match(c)]
        if len(found) == 1 and found[0] not in claims and found[0] not in required:
            claims[found[0]] = want
        else:
            missing.append(want)
    if missing:
        raise ValueError(f"Missing required columns: {missing}")
    return df.withColumnsRenamed(claims)


def soft_cast(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Cast each column whose values all can be cast; leave the others as they are. Numbers are cast by their
    schema; only texts need a pass over the data, one for all of them."""
    numbers = {c: k for c, k in kinds.items() if c in df.columns and isinstance(df.schema[c].dataType, NumericType)}
    df = df.withColumns({c: F.col(c).cast(k) for c, k in numbers.items()})
    texts = {c: k for c, k in kinds.items() if c in df.columns and c not in numbers and df.schema[c].dataType.simpleString() != k}
    if not texts:
        return df
    tried = {c: F.col(c).cast("string").try_cast(k) for c, k in texts.items()}
    bad = df.agg(*[F.count_if(F.col(c).isNotNull() & t.isNull()).alias(c) for c, t in tried.items()]).first()
    return df.withColumns({c: t for c, t in tried.items() if bad[c] == 0})


def clean_transactions(df: DataFrame) -> DataFrame:
    return soft_cast(_described(df), {"price": "double", "quantity": "long"})


def _described(df: DataFrame) -> DataFrame:
    out = resolve_columns(normalize_headers(df)).na.drop(subset=["product_description"])
    return out.withColumn("product_description", normalize_description("product_description"))


def _money_sum(c: str) -> Column:
    """Exact for amounts of two decimals, in whatever order they are added."""
    return F.sum(F.col(c).cast("decimal(18,2)")).cast("double")


def product_metrics(df: DataFrame, least: int = 1) -> DataFrame:
    """Per description: transactions, averages, extremes and total; ``least`` transactions or more.

    A price or quantity given as text that is no number is an error, found by the aggregate itself."""
    number = lambda c, k: F.col(c).cast(k) if isinstance(df.schema[c].dataType, NumericType) else F.col(c).cast("string").try_cast(k)
    rows = df.select("product_description", number("price", "double").alias("price"), number("quantity", "double").alias("quantity"), *[(F.col(c).isNotNull() & number(c, "double").isNull()).alias(f"bad_{c}") for c in ("price", "quantity")])
    out = rows.groupBy("product_description").agg(
        F.count(F.lit(1)).alias("transaction_count"),
        (_money_sum("price") / F.nullif(F.count("price"), F.lit(0))).alias("avg_price"),
        (_money_sum("quantity") / F.nullif(F.count("quantity"), F.lit(0))).alias("avg_quantity"),
        F.min("price").alias("min_price"),
        F.max("price").alias("max_price"),
        F.coalesce(_money_sum("quantity"), F.lit(0.0)).alias("total_quantity"),
        F.bool_or(F.col("bad_price") | F.col("bad_quantity")).alias("bad"),
    )
    checked = F.when(F.col("bad"), F.raise_error(F.lit("price or quantity holds a text that is no number")).cast("long")).otherwise(F.col("transaction_count"))
    return out.withColumn("transaction_count", checked).filter(F.col("transaction_count") >= least).drop("bad")


def build_product_metrics(df: DataFrame) -> DataFrame:
    return product_metrics(_described(df))


def build_unique_products(df: DataFrame, code: str, description: str, order: str, case_sensitive: bool = True) -> DataFrame:
    """One row per cleaned description with the first code in ``order``; rows without either are dropped."""
    rows = df.select(F.col(code).cast("string").alias("product_code"), F.col(description).cast("string").alias("d"), F.col(order).alias("o")).na.drop("any", subset=["product_code", "d"])
    rows = rows.withColumn("product_description", clean_and_expand("d", case_sensitive)).filter("product_description <> ''")
    return rows.groupBy("product_description").agg(F.min_by("product_code", "o").alias("product_code"))


def distinct_products(df: DataFrame, code: str, description: str) -> DataFrame:
    return df.select(code, description).distinct()


def surrogate_ids(df: DataFrame, by: str, prefix: str = "item_") -> DataFrame:
    """``item_<position>`` in the order of ``by`` (unique), without gathering all rows in one task: rows are
    range-partitioned and sorted once, and each partition starts at the count of those before it.

    The range comes from a sample, so the sorted rows are kept for both uses: as a checkpoint if the session has a
    folder for these, in the cache otherwise."""
    spark = df.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = df.repartitionByRange(parts, by).sortWithinPartitions(by).withColumn("_m", F.monotonically_increasing_id())
    ranged = ranged.checkpoint() if spark.sparkContext.getCheckpointDir() else ranged.persist()
    part = F.shiftright("_m", 33).cast("int")
    sizes = {r["p"]: r["n"] for r in ranged.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a partition
    starts, n = [], 0
    for p in range(max(sizes, default=0) + 1):
        starts.append(n)
        n += sizes.get(p, 0)
    place = F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)) + F.get(F.lit(starts), part)
    return ranged.withColumn("id", F.concat(F.lit(prefix), place.cast("string"))).drop("_m")


def null_profile(df: DataFrame) -> DataFrame:
    """``column_name, nulls``, in one pass."""
    one = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("nulls")) for c in df.columns])).alias("x")).select("x.*")
