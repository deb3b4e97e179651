"""Exact nearest neighbours: blocks of queries against all vectors, top k found next to the data.

A block's matrix goes to the tasks (about ``BLOCK`` queries, so its size is fixed); each task keeps
the best k of all its vectors for every query, and only those are shuffled. More queries are more blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfmatch.functions.vectors import cosine
from shelfmatch.operators.runtime import cross_blocks, map_arrow

BLOCK = 4096
INITIAL, FINAL = 30, 5
FORWARD, BACKWARD = 0.25, 0.20
DIGITS = 9  # similarities that agree to so many digits tie, and go by id


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of unit length from a list column; a null row or entry counts as zero."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), int(lengths.max(initial=0))))
    out[np.arange(out.shape[1]) < lengths[:, None]] = pc.fill_null(pc.cast(column.flatten(), pa.float64()), 0.0).to_numpy(zero_copy_only=False)
    norms = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norms, out=np.zeros_like(out), where=norms > 0)


def _best(block, k: int):
    """A task's best k of all its vectors for every query, given out once, at its end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list, list, pa.DataType]]:
        ids, queries = block.value
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.empty(0), np.empty(0), np.empty(0, object)) for _ in ids]  # keys, similarities, ids
        least, kind = np.full(len(ids), -np.inf), None
        for whole in batches:
            kind = whole.schema.field(0).type
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                vids = np.array(batch.column(0).to_pylist(), dtype=object)
                m = _matrix(batch.column(1))
                if m.shape[1] not in (0, queries.shape[1]):
                    raise ValueError("vectors of different lengths")
                sims = queries @ m.T if m.shape[1] else np.zeros((len(ids), len(m)))
                keys = np.round(sims, DIGITS)
                for i in np.flatnonzero((keys >= least[:, None]).any(1)):
                    row = keys[i]
                    if len(row) > k:
                        new = np.flatnonzero(row >= max(least[i], np.partition(row, -k)[-k]))
                    else:
                        new = np.flatnonzero(row >= least[i])
                    key, sim, vid = (np.concatenate(x) for x in zip(held[i], (row[new], sims[i, new], vids[new]), strict=True))
                    by_id = np.argsort(vid, kind="stable")
                    order = by_id[np.argsort(-key[by_id], kind="stable")][:k]
                    held[i] = key[order], sim[order], vid[order]
                    if len(order) == k:
                        least[i] = key[order[-1]]
        if kind is not None:
            for at in range(0, len(ids), 512):
                part = range(at, min(at + 512, len(ids)))
                yield [ids[i] for i in part for _ in held[i][2]], [v for i in part for v in held[i][2]], [x for i in part for x in held[i][1].tolist()], kind

    return run


def knn(queries: DataFrame, vectors: DataFrame, k: int, qid: str = "qid", vid: str = "vid", vector: str = "vector") -> DataFrame:
    """``qid, vid, sim, rk``: the k most similar vectors of each query, by cosine, ties by id.

    A zero vector has similarity 0 to all. No queries or no vectors give no rows.
    """
    spark = vectors.sparkSession
    qkind, vkind = queries.schema[qid].dataType.simpleString(), vectors.schema[vid].dataType.simpleString()
    schema = f"{qid} {qkind}, {vid} {vkind}, sim double"
    rows = queries.select(qid, F.col(vector).cast("array<double>").alias("v"))
    blocks = max(1, -(-rows.count() // BLOCK))
    out = None
    for b in range(blocks):
        mine = rows if blocks == 1 else rows.filter(F.pmod(F.xxhash64(qid), F.lit(blocks)) == b)
        got = mine.toArrow()
        if not got.num_rows:
            continue
        sent = spark.sparkContext.broadcast((got.column(0).to_pylist(), _matrix(got.column(1).combine_chunks())))
        best = _best(sent, k)
        types = got.schema.field(0).type

        def run(batches, best=best, types=types):
            for q, v, s, vt in best(batches):
                yield pa.RecordBatch.from_arrays([pa.array(q, types), pa.array(v, vt), pa.array(s, pa.float64())], [qid, vid, "sim"])

        part = map_arrow(vectors.select(vid, F.col(vector).cast("array<double>").alias("v")), run, schema)
        out = part if out is None else out.unionAll(part)
    if out is None:
        out = spark.createDataFrame([], schema)
    by = Window.partitionBy(qid).orderBy(F.round("sim", DIGITS).desc(), vid)
    return out.withColumn("rk", F.row_number().over(by)).filter(F.col("rk") <= k)


def knn_columns(queries: DataFrame, vectors: DataFrame, k: int, qid: str = "qid", vid: str = "vid", vector: str = "vector") -> DataFrame:
    """The same result as ``knn`` from expressions alone: blocks of queries are broadcast, and each partition keeps its best k
    of a query before the shuffle. For short vectors and few queries, or where Python workers aren't wanted."""
    pairs = cross_blocks(vectors.select(vid, F.col(vector).alias("_v")), queries.select(qid, F.col(vector).alias("_q")), qid, BLOCK)
    scored = pairs.select(qid, vid, cosine("_q", "_v").alias("sim"))
    by = Window.partitionBy(qid).orderBy(F.round("sim", DIGITS).desc(), vid)
    return scored.withColumn("rk", F.row_number().over(by)).filter(F.col("rk") <= k)


def bidirectional(neighbours: DataFrame, threshold: float | None = None, final: int | None = FINAL, qid: str = "qid", vid: str = "vid") -> DataFrame:
    """Forward, backward and mean similarity of the first search's hits; the threshold comes before the final cut."""
    out = neighbours.withColumns({"forward_similarity": F.col("sim"), "backward_similarity": F.col("sim")})
    out = out.withColumn("bi_directional_similarity", (F.col("forward_similarity") + F.col("backward_similarity")) / 2)
    if threshold is not None:
        out = out.filter(F.col("bi_directional_similarity") >= threshold)
    place = F.row_number().over(Window.partitionBy(qid).orderBy(F.round("bi_directional_similarity", DIGITS).desc(), vid))
    out = out.withColumn("rk", place)
    return out if final is None else out.filter(F.col("rk") <= final)


def mutual_search(neighbours: DataFrame, forward: float = FORWARD, backward: float = BACKWARD, final: int = FINAL) -> DataFrame:
    """Of the hits, without the query itself, those that pass both thresholds, the best ``final``."""
    both = bidirectional(neighbours.filter("qid <> vid"), None, None).filter((F.col("forward_similarity") >= forward) & (F.col("backward_similarity") >= backward))
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.round("bi_directional_similarity", DIGITS).desc(), "vid"))
    return both.withColumn("rk", place).filter(F.col("rk") <= final)


def reciprocal(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """Each hit of each query with the query's rank among the hit's own neighbours (null if beyond k)."""
    ahead = knn(queries, vectors, k + 1).filter("qid <> vid")
    hits = ahead.select(F.col("vid").alias("qid")).distinct().join(vectors.select(F.col("vid").alias("qid"), "vector"), "qid")
    back = knn(hits, vectors, k + 1).filter("qid <> vid").select(F.col("qid").alias("vid"), F.col("vid").alias("qid"), F.col("rk").alias("back_rk"))
    return ahead.join(back, ["qid", "vid"], "left")


_COMPARE = {"$eq": lambda c, v: c == v, "$ne": lambda c, v: c != v, "$gt": lambda c, v: c > v, "$gte": lambda c, v: c >= v, "$lt": lambda c, v: c < v, "$lte": lambda c, v: c <= v, "$in": lambda c, v: c.isin(list(v)), "$nin": lambda c, v: ~c.isin(list(v))}


def where(condition: dict | None) -> Column:
    """A filter dictionary (``$and``, ``$or`` and comparisons by field) as a column, so that it is pushed down."""
    if not condition:
        return F.lit(True)
    out = None
    for name, value in condition.items():
        if name in ("$and", "$or"):
            parts = [where(x) for x in value]
            this = parts[0]
            for p in parts[1:]:
                this = this & p if name == "$and" else this | p
        elif isinstance(value, dict):
            this = None
            for op, v in value.items():
                one = _COMPARE[op](F.col(name), v)
                this = one if this is None else this & one
        else:
            this = F.col(name) == value
        out = this if out is None else out & this
    return out
