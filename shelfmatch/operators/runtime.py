"""Making this package known to the executors' Python workers."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ship(spark: SparkSession) -> None:
    """Send the package's modules, once a context."""
    context = spark.sparkContext
    if getattr(context, "_package_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    to = Path(tempfile.mkdtemp(prefix="package-")) / f"{root.name}.zip"
    with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    context.addPyFile(str(to))
    context._package_shipped = True


def map_arrow(df: DataFrame, f, schema) -> DataFrame:
    ship(df.sparkSession)
    return df.mapInArrow(f, schema)


def cross_blocks(rows: DataFrame, few: DataFrame, key: str, most: int) -> DataFrame:
    """Every row with every row of ``few``, a stated set, which goes to the rows by broadcast in blocks of about ``most``."""
    blocks = max(1, -(-few.count() // most))
    out = None
    for b in range(blocks):
        mine = few if blocks == 1 else few.filter(F.pmod(F.xxhash64(key), F.lit(blocks)) == b)
        part = rows.crossJoin(F.broadcast(mine))
        out = part if out is None else out.unionAll(part)
    return out
