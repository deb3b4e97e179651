"""Statistics over best-match results: ``vid, best, similarity, known, is_correct``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from shelfmatch.operators.evaluate import ratio

GRID = [0.1 + i * 0.05 for i in range(18)]


def judged(best: DataFrame, known: DataFrame) -> DataFrame:
    """With the known category and whether it was met (null where it isn't known)."""
    return best.join(known, "vid", "left").withColumn("is_correct", F.col("best") == F.col("known"))


def match_accuracy(results: DataFrame) -> DataFrame:
    one = results.agg(
        F.count(F.lit(1)).alias("total"), F.count("known").alias("known"), F.count_if(F.col("known").isNull()).alias("unknown"), F.count_if("is_correct").alias("correct"), F.count_if(~F.col("is_correct")).alias("incorrect")
    )
    return one.withColumn("known_share", ratio("known", "total")).withColumn("accuracy", ratio("correct", "known"))


def similarity_stats(results: DataFrame) -> DataFrame:
    s = F.col("similarity")
    return results.agg(*[F.round(x, 6).alias(n) for n, x in (("mean", F.avg(s)), ("median", F.median(s)), ("min", F.min(s)), ("max", F.max(s)), ("std", F.stddev_samp(s)))])


def correct_vs_incorrect(results: DataFrame) -> DataFrame:
    yes, no = F.avg(F.when(F.col("is_correct"), F.col("similarity"))), F.avg(F.when(~F.col("is_correct"), F.col("similarity")))
    return results.agg(F.round(yes, 6).alias("correct_avg"), F.round(no, 6).alias("incorrect_avg"), F.round(yes - no, 6).alias("difference"))


def category_performance(results: DataFrame) -> DataFrame:
    by = results.filter("known is not null").groupBy("known").agg(F.count(F.lit(1)).alias("total"), F.count_if("is_correct").alias("correct"))
    return by.withColumn("accuracy", ratio("correct", "total"))


def common_mismatches(results: DataFrame) -> DataFrame:
    return results.filter(~F.col("is_correct")).groupBy("known", "best").agg(F.count(F.lit(1)).alias("n"))


def accuracy_by_threshold(results: DataFrame, grid: list[float] = GRID) -> DataFrame:
    """A row for each threshold, in one pass; a threshold that nothing reaches has accuracy 0."""
    known = results.filter("known is not null")
    rows = known.select("is_correct", F.explode(F.filter(F.lit(grid), lambda t: F.col("similarity") >= t)).alias("threshold"))
    by = rows.groupBy("threshold").agg(F.count(F.lit(1)).alias("remaining_samples"), F.count_if("is_correct").alias("correct"))
    points = results.sparkSession.createDataFrame([(t,) for t in grid], "threshold double")
    return points.join(F.broadcast(by), "threshold", "left").select("threshold", ratio("correct", "remaining_samples").alias("accuracy"), F.coalesce("remaining_samples", F.lit(0)).alias("remaining_samples"))


def top_bottom(results: DataFrame, by: str, key: str, n: int) -> DataFrame:
    """The n largest and the n smallest, each a partial top-k."""
    hi = results.orderBy(F.round(by, 9).desc(), key).limit(n).withColumn("part", F.lit("top"))
    lo = results.orderBy(F.round(by, 9).asc(), key).limit(n).withColumn("part", F.lit("bottom"))
    return hi.unionAll(lo)


def sample_rows(results: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows by the digest of key and seed: the same rows on every run and every engine."""
    return results.orderBy(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))), key).limit(n)


def console(df: DataFrame, n: int = 50, digits: int = 4) -> str:
    """The first ``n`` rows as an aligned table, numbers to the right."""
    rows = df.limit(n).collect()
    shown = lambda x: "" if x is None else f"{x:.{digits}f}" if isinstance(x, float) else str(x)
    cells = [list(map(shown, r)) for r in rows]
    right = [isinstance(f.dataType, NumericType) for f in df.schema.fields]
    wide = [max([len(c), *(len(r[i]) for r in cells)]) for i, c in enumerate(df.columns)]
    line = lambda r: "  ".join(x.rjust(w) if to_right else x.ljust(w) for x, w, to_right in zip(r, wide, right, strict=True)).rstrip()
    return "\n".join([line(df.columns), line(["-" * w for w in wide]), *map(line, cells)]) + "\n"


def markdown(accuracy: DataFrame, stats: DataFrame, contrast: DataFrame, title: str = "Category match analysis", stamp: str = "") -> str:
    """A report of the three one-row results."""
    a, s, c = accuracy.first(), stats.first(), contrast.first()
    lines = [f"# {title}", "", "## Accuracy", "", f"- products: {a['total']}", f"- with a known category: {a['known']}", f"- correct: {a['correct']} ({a['accuracy']:.2%})", "", "## Similarity", ""]
    lines += [f"- {k}: {s[k]:.4f}" if s[k] is not None else f"- {k}: none" for k in ("mean", "median", "min", "max", "std")]
    lines += ["", "## Correct and incorrect", ""] + [f"- {k.replace('_', ' ')}: {c[k]:.4f}" if c[k] is not None else f"- {k}: none" for k in ("correct_avg", "incorrect_avg", "difference")]
    return "\n".join([*lines, "", stamp]).rstrip() + "\n"
