"""SimHash near-duplicates, searched by pigeonring filtering.

A fingerprint's 64 bits are five segments in a ring. If two fingerprints differ in at most tau = 4
bits, some chain of consecutive segments has, for every length l, at most floor(l * 4 / 5) differences
in its first l segments: none in its first, at most one in the first two, two in three, three in four.
Candidates come from a join on the first two steps (a segment and its successor with one bit masked),
the later steps prune them, and the full Hamming distance decides.

Equal fingerprints are one node. Components come from ``components.link_buckets``: no bucket's pairs
are listed in full, and no link between different fingerprints is lost.

Defined results: a null or blank text has fingerprint zero, linked like any other; repeated rows are kept by ``group``
and share a component; null keys never are a component's least key unless all are null; an empty table
gives no rows; other columns are ignored by ``fingerprints`` and kept by ``drop_near_duplicates``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmatch.llm._common import drop, join_hot, map_arrow, release, store, table
from shelfmatch.llm.components import link_buckets, meet

WORDS = 4
DISTANCE = 4
SEED = 42
SLAB = 1 << 16  # hashes whose bits are counted at once


def _bits(hashes: list[int]) -> np.ndarray:
    """How many hashes have each of the 64 bits set."""
    out = np.zeros(64, np.int64)
    for at in range(0, len(hashes), SLAB):
        part = np.array(hashes[at : at + SLAB], np.uint64).view(np.uint8).reshape(-1, 8)
        out += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return out


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """Of a text in UTF-8. A bit is set if more than half of the shingles' hashes have it."""
    tokens = text.lower().split()
    if not tokens:
        return 0
    flat = b" ".join(tokens)
    digest = xxhash.xxh64_intdigest
    if len(tokens) <= words:
        hashes = [digest(flat, SEED)]
    else:
        ends, at = [], -1
        for t in tokens:
            at += len(t) + 1
            ends.append(at)
        starts = [0, *(e + 1 for e in ends[:-words])]
        hashes = [digest(flat[a:b], SEED) for a, b in zip(starts, ends[words - 1 :], strict=True)]
    set_ = _bits(hashes) * 2 > len(hashes)
    return int.from_bytes(np.packbits(set_, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """``key, fp``: the fingerprint as a signed 64-bit integer."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t or b"", words) for t in batch.column(1).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], [key, "fp"])

    return map_arrow(docs.select(key, F.col(text).cast("string").cast("binary").alias("_text")), run, f"{key} {kind}, fp long")


def segments(distance: int = DISTANCE) -> list[tuple[int, int]]:
    """(first bit, width) of the ring's distance + 1 segments."""
    m = distance + 1
    edges = [64 * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _part(c: Column, at: int, width: int) -> Column:
    return F.shiftrightunsigned(c, at).bitwiseAND(F.lit((1 << width) - 1))


def ring_keys(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """``fp`` -> ``(key, node)``: segment i, and segment i + 1 with bit j masked, for each i and j."""
    ring, keys = segments(distance), []
    for i, (at, width) in enumerate(ring):
        nxt, wide = ring[(i + 1) % len(ring)]
        own, other = _part(F.col("fp"), at, width), _part(F.col("fp"), nxt, wide)
        for j in range(wide):
            tag = i * 64 + j
            keys.append(own.bitwiseOR(F.shiftleft(other.bitwiseAND(F.lit(((1 << wide) - 1) & ~(1 << j))), 14)).bitwiseOR(F.lit(tag << 32)))
    return fps.select(F.col("fp").alias("node"), F.explode(F.array(*keys)).alias("key")).select("key", "node")


def ring_test(a: Column, b: Column, distance: int = DISTANCE) -> Column:
    """Some chain stays within its budgets at every length, then the Hamming distance."""
    ring = segments(distance)
    m = len(ring)
    x = a.bitwiseXOR(b)
    diff = [F.bit_count(_part(x, at, width)) for at, width in ring]
    chains = F.lit(False)
    for i in range(m):
        total, ok = F.lit(0), F.lit(True)
        for length in range(1, m):
            total = total + diff[(i + length - 1) % m]
            ok = ok & (total <= length * distance // m)
        chains = chains | ok
    return chains & (F.bit_count(x) <= distance)


def group(prints: DataFrame, key: str = "doc_id", distance: int = DISTANCE) -> DataFrame:
    """Stored ``key, fp`` rows -> ``key, fp, component_id`` (least key reachable), ``n_fingerprint``
    (rows of the same fingerprint)."""
    spark = prints.sparkSession
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    fps = store(prints.groupBy("fp").agg(F.min(key).alias("first"), F.count(F.lit(1)).alias("n_fingerprint")).repartition(spread, "fp"), "fingerprints")  # each row becomes 64
    test = lambda a, b: ring_test(a, b, distance)
    keys = sum(width for _, width in segments(distance))
    labels = link_buckets(
        ring_keys(fps.select("fp"), distance),
        fps.count() * keys,
        lambda pairs: pairs.filter(test(F.col("a"), F.col("b"))),
        lambda several: meet(several, lambda x, y: test(x("node"), y("node"))).distinct(),
    )
    linked = fps.join(labels.withColumnRenamed("node", "fp"), "fp")
    least = linked.groupBy("root").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("n"))
    linked = join_hot(linked, least, "root", "n").select("fp", F.col("component_id").alias("_far"))
    ids = store(fps.join(linked, "fp", "left").select("fp", F.coalesce("_far", "first").alias("component_id"), "n_fingerprint"), "components")
    drop(fps, labels)
    release(spark)
    return join_hot(prints, ids, "fp", "n_fingerprint")


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each component: that of the least key, and of those the text of least hash. Rows of equal key
    in different components are different documents. Documents without a key are kept. Columns of any name are kept as they are."""
    own = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("k"), F.xxhash64(F.col(text).cast("string")).alias("h")).alias("id")
    prints = store(fingerprints(docs.select(own, F.col(text).alias("t")), "id", "t"), "prints")
    keep = group(prints, "id").filter((F.col("id") == F.col("component_id")) & ~F.col("id.none")).select("id").distinct()
    rows = docs.select(own, F.struct(*docs.columns).alias("doc"))
    kept = rows.filter("not id.none").join(keep, "id").dropDuplicates(["id"])
    return kept.select("doc").unionByName(rows.filter("id.none").select("doc")).select("doc.*")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    prints = store(fingerprints(table(spark, sf_dir, "documents")), "prints")
    return group(prints).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_fingerprint")
