"""Copies among images by local descriptors.

Corners (Harris response, the strongest ``CORNERS`` a scale in each ``CELL`` x ``CELL`` pixels that are the largest
around) are found at two scales. Each has an orientation (the intensity centroid's direction, in ``TURNS`` steps) and 256 binary
tests of a smoothed patch, turned by it. The 256 bits are dealt ``ROUNDS`` times into ``PIECES`` pieces; images
that share a piece of the same place are candidates (a Hamming-table join: two descriptors that differ in fewer
than ``PIECES`` bits always share one; of those ``NEAREST`` apart about a fifth do, so that of twenty such
descriptors one is almost sure to). For a candidate pair all descriptors are compared, and matches vote for a common turn, scale
and shift; a pair with ``VOTES`` agreeing matches is a link. Classes are components of links.

Descriptors are made where the bytes are read, and only they are shuffled. Images with equal bytes are one node, and a word's images are never paired with all others
(``components.link_buckets``).

Images are binary PGM (P5, 8 bits). Defined results: null bytes, bytes of another format and images too
small for a patch have no descriptors; equal bytes still make one class, but every null is a class of its
own; a null key is never the least of its class unless all are null; ties of a corner's response go by place; repeated rows are kept; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmatch.llm._common import drop, join_hot, map_arrow, release, store, table
from shelfmatch.llm.components import link_buckets

CORNERS = (24, 12)
CELL = 96
BLOCK = 64
TURNS = 32
RADIUS = 10
NEAREST = 40  # bits by which matching descriptors may differ
PIECES, ROUNDS = 10, 2  # of the tables: each key holds 25 or 26 bits
VOTES = 5
PAIRS = 256  # compared at once
SLACK = 3.0  # pixels by which shifts may differ
_HEAD = re.compile(rb"P5\s+(\d+)\s+(\d+)\s+255\s")


def _tests() -> np.ndarray:
    """TURNS x 256 x 2 points (dy, dx): a fixed random pattern, turned."""
    rng = np.random.default_rng(20)
    points = np.clip(rng.normal(0, RADIUS / 2.2, (256, 2, 2)), -RADIUS * 0.7, RADIUS * 0.7)
    turns = 2 * np.pi * np.arange(TURNS) / TURNS
    y, x = points[..., 0], points[..., 1]
    turned = np.stack([np.stack([np.sin(t) * x + np.cos(t) * y, np.cos(t) * x - np.sin(t) * y], -1) for t in turns])
    return np.rint(turned).astype(np.int64)


TESTS = _tests()
_SPAN = np.arange(-RADIUS, RADIUS + 1)
_DISC = (_SPAN[:, None] ** 2 + _SPAN[None, :] ** 2) <= RADIUS**2


def _pieces() -> list[list[int]]:
    """For each table the masks of a descriptor's four words, as signed 64-bit integers."""
    rng = np.random.default_rng(21)
    out = []
    for _ in range(ROUNDS):
        for bits in np.array_split(rng.permutation(256), PIECES):
            masks = [sum(1 << int(b) % 64 for b in bits if b // 64 == k) for k in range(4)]
            out.append([m - (1 << 64) if m >= 1 << 63 else m for m in masks])
    return out


def table_keys(words: str) -> Column:
    """The distinct table keys of all descriptors of the column."""
    word = lambda i, k: F.get(F.col(words), i * 4 + k)
    keys = lambda i: F.array(*[F.xxhash64(F.lit(t), *[word(i, k).bitwiseAND(F.lit(m)) for k, m in enumerate(masks)]) for t, masks in enumerate(_pieces())])
    each = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor(F.size(words) / 4).cast("int") - 1)), keys)
    return F.when(F.size(words) > 0, F.array_distinct(F.flatten(each)))


def pgm(pixels: np.ndarray) -> bytes:
    h, w = pixels.shape
    return b"P5 %d %d 255\n" % (w, h) + np.clip(np.rint(pixels), 0, 255).astype(np.uint8).tobytes()


def pixels_of(data: bytes | pa.Buffer | None) -> np.ndarray | None:
    data = memoryview(data or b"")
    m = _HEAD.match(data)
    if not m:
        return None
    w, h = int(m[1]), int(m[2])
    if w * h == 0 or len(data) - m.end() < w * h:
        return None
    return np.frombuffer(data, np.uint8, w * h, m.end()).reshape(h, w).astype(np.float32)


def _box(a: np.ndarray, r: int) -> np.ndarray:
    """Mean over (2 r + 1) squares, edges repeated."""
    for axis in (0, 1):
        p = np.pad(a, [(r + 1, r) if k == axis else (0, 0) for k in (0, 1)], mode="edge").cumsum(axis, dtype=np.float64)
        n = a.shape[axis]
        a = (np.take(p, range(2 * r + 1, 2 * r + 1 + n), axis) - np.take(p, range(n), axis)) / (2 * r + 1)
    return a


def _largest_around(a: np.ndarray, r: int) -> np.ndarray:
    for axis in (0, 1):
        p = np.pad(a, [(r, r) if k == axis else (0, 0) for k in (0, 1)], constant_values=-np.inf)
        a = np.lib.stride_tricks.sliding_window_view(p, 2 * r + 1, axis).max(-1)
    return a


def descriptors(image: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(n x 4: x, y in full-size pixels, turn, scale), (n x 4 words)."""
    spots, words = [], []
    level = image
    for scale, most in enumerate(CORNERS):
        if level is None or min(level.shape) < 2 * RADIUS + 3:
            break
        gy, gx = np.gradient(level)
        xx, yy, xy = _box(gx * gx, 2), _box(gy * gy, 2), _box(gx * gy, 2)
        strength = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2
        inner = np.zeros(level.shape, bool)
        inner[RADIUS + 1 : -RADIUS - 1, RADIUS + 1 : -RADIUS - 1] = True
        ok = inner & (strength > 1e-3) & (strength >= _largest_around(strength, 3))
        ys, xs = np.nonzero(ok)
        side = CELL >> scale
        cell = ys // side * (level.shape[1] // side + 1) + xs // side
        order = np.lexsort((xs, ys, -strength[ys, xs], cell))
        first = np.searchsorted(cell[order], cell[order])  # of the cell
        order = order[np.arange(len(order)) - first < most]
        ys, xs = ys[order], xs[order]
        smooth = _box(level, 1)
        if len(ys):
            patch = smooth[ys[:, None, None] + _SPAN[None, :, None], xs[:, None, None] + _SPAN[None, None, :]] * _DISC
            patch = patch - patch.sum((1, 2), keepdims=True) / _DISC.sum() * _DISC
            angle = np.arctan2((patch * _SPAN[:, None]).sum((1, 2)), (patch * _SPAN).sum((1, 2)))
            turn = np.rint(angle / (2 * np.pi) * TURNS).astype(np.int64) % TURNS
            t = TESTS[turn]
            v = smooth[ys[:, None, None] + t[..., 0], xs[:, None, None] + t[..., 1]]
            words.append(np.packbits(v[..., 0] < v[..., 1], axis=1).view(np.uint64))
            size = 1 << scale
            spots.append(np.stack([xs * size, ys * size, turn, np.full(len(xs), scale)], 1))
        h, w = level.shape[0] // 2 * 2, level.shape[1] // 2 * 2
        level = level[:h, :w].reshape(h // 2, 2, w // 2, 2).mean((1, 3))
    if not spots:
        return np.zeros((0, 4), np.int64), np.zeros((0, 4), np.uint64)
    return np.concatenate(spots), np.concatenate(words)


def agreeing(sa: np.ndarray, wa: np.ndarray, sb: np.ndarray, wb: np.ndarray) -> int:
    """The most matches that share one turn, scale and shift."""
    if not len(sa) or not len(sb):
        return 0
    i, j = [], []
    for at in range(0, len(wa), BLOCK):
        apart = np.bitwise_count(wa[at : at + BLOCK, None] ^ wb[None]).sum(2)
        x, y = np.nonzero((apart <= NEAREST) & (apart == apart.min(1, keepdims=True)))
        i.append(x + at)
        j.append(y)
    i, j = np.concatenate(i), np.concatenate(j)
    if len(i) < VOTES:
        return 0
    turn = (sb[j, 2] - sa[i, 2]) % TURNS
    scale = sb[j, 3] - sa[i, 3]
    angle, size = 2 * np.pi * turn / TURNS, 2.0**scale
    dx = sb[j, 0] - size * (np.cos(angle) * sa[i, 0] - np.sin(angle) * sa[i, 1])
    dy = sb[j, 1] - size * (np.sin(angle) * sa[i, 0] + np.cos(angle) * sa[i, 1])
    best = 0
    for k in range(len(i)):
        near_turn = np.abs((turn[k] - turn + TURNS // 2) % TURNS - TURNS // 2) <= 1
        same = near_turn & (scale[k] == scale) & (np.hypot(dx[k] - dx, dy[k] - dy) <= SLACK)
        if same.sum() > best:
            best = max(best, min(len(set(i[same].tolist())), len(set(j[same].tolist()))))
    return best


def _spread(media: DataFrame, key: str) -> DataFrame:
    """``key, node, spots, words`` of every row, ``node`` a hash of its bytes; the bytes go no further."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, PAIRS):
                batch = whole.slice(at, PAIRS)
                got = [descriptors(pixels_of(x.as_buffer())) for x in batch.column(2)]
                lists = [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(x[k].size for x in got)]), pa.int32()), pa.array(np.concatenate([x[k].ravel() for x in got]).astype(t, copy=False).view(v))) for k, t, v in ((0, np.int32, np.int32), (1, np.uint64, np.int64))]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], [key, "node", "spots", "words"])

    kind = media.schema[key].dataType.simpleString()
    return map_arrow(media.select(key, "node", "data"), run, f"{key} {kind}, node long, spots array<int>, words array<long>")


def _rows_of(column: pa.Array, kind: type) -> list[np.ndarray]:
    """A list column's rows as n x 4 arrays, without a Python object for each entry."""
    flat = np.asarray(column.flatten(), np.int64).view(kind)
    ends = np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))
    return [flat[a:b].reshape(-1, 4) for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def _consensus(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, PAIRS):
            batch = whole.slice(at, PAIRS)
            sa, wa, sb, wb = (_rows_of(batch.column(k), kind) for k, kind in ((2, np.int64), (3, np.uint64), (4, np.int64), (5, np.uint64)))
            votes = [agreeing(*x) for x in zip(sa, wa, sb, wb, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(votes, pa.int32())], ["a", "b", "votes"])


def copies(media: DataFrame, key: str = "media_id", data: str = "data") -> DataFrame:
    """``key, class_id`` (least key of the class), ``n_equal`` (rows of the same bytes), of every row."""
    bytes_of = media.select(key, F.col(data).alias("data"))
    rows = store(_spread(bytes_of.withColumn("node", F.when(F.col("data").isNotNull(), F.xxhash64("data"))), key), "descriptors")
    given = rows.filter("node is not null")
    heads = store(given.groupBy("node").agg(F.min(key).alias("first"), F.count(F.lit(1)).alias("n_equal")), "images")
    found = store(given.groupBy("node").agg(F.first("spots").alias("spots"), F.first("words").alias("words")), "found")  # equal for all rows of a node
    members = found.select("node", F.explode(table_keys("words")).alias("key"))

    def linked(pairs: DataFrame) -> DataFrame:
        a = found.select(F.col("node").alias("a"), F.col("spots").alias("sa"), F.col("words").alias("wa"))
        b = found.select(F.col("node").alias("b"), F.col("spots").alias("sb"), F.col("words").alias("wb"))
        both = pairs.join(a, "a").join(b, "b").select("a", "b", "sa", "wa", "sb", "wb")
        return map_arrow(both, _consensus, "a long, b long, votes int").filter(F.col("votes") >= VOTES).select("a", "b")

    labels = link_buckets(members, members.count(), linked)
    drop(found)
    named = heads.select("node", "first", "n_equal").join(labels, "node", "left")
    least = named.filter("root is not null").groupBy("root").agg(F.min("first").alias("far"))
    ids = store(named.join(least, "root", "left").select("node", F.coalesce("far", "first").alias("class_id"), "n_equal"), "classes")
    drop(heads, labels)
    release(media.sparkSession)
    out = join_hot(given.select(key, "node"), ids, "node", "n_equal").select(key, "class_id", "n_equal")
    return out.unionByName(rows.filter("node is null").select(key, F.col(key).alias("class_id"), F.lit(1).cast("long").alias("n_equal")))


SIDE = 96


def render(vector: list[float] | None) -> np.ndarray:
    """A picture of a vector: its entries are the weights of a square grid of cosine waves, of 8 x 8 or as many as there are entries."""
    given = np.array([x or 0.0 for x in ([] if vector is None else vector)], np.float64)
    n = max(8, math.isqrt(max(0, len(given) - 1)) + 1)
    v = np.zeros(n * n)
    v[: len(given)] = given
    at = (np.arange(SIDE) + 0.5) / SIDE * np.pi
    waves = np.cos(np.outer(np.arange(2, 2 * n + 2, 2), at) + np.arange(n)[:, None])
    field = np.einsum("uv,uy,vx->yx", v.reshape(n, n), waves, waves, optimize=True)
    spread = field.std()
    return 128 + (field - field.mean()) * (45 / spread if spread > 1e-9 else 0)


def pictures(vectors: DataFrame) -> DataFrame:
    """``media_id, data``: a picture of every vector (id 2 n), and for every twentieth an edited copy
    (id 2 n + 1): cropped to three quarters a side, darker and of less contrast. A null id gives a picture of null id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, data = [], []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                p = render(v)
                ids.append(None if i is None else 2 * i)
                data.append(pgm(p))
                if i is not None and i % 20 == 0:
                    ids.append(2 * i + 1)
                    data.append(pgm(p[9 : 9 + SIDE * 3 // 4, 14 : 14 + SIDE * 3 // 4] * 0.8 + 12))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(data, pa.binary())], ["media_id", "data"])

    return map_arrow(vectors.select("vec_id", "embedding"), run, "media_id long, data binary")


def op7_media_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of every picture of ``embeddings``, and of the edited copies among them."""
    return copies(pictures(table(spark, sf_dir, "embeddings")))
