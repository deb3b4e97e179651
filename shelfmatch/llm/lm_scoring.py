"""Language-model scores from a hashed maximum-entropy model.

The model is log-linear in three factors: p(w | h) = p(class(w) | h) p(group(w) | class(w), h) p(w | group(w)). Classes and
groups each are a softmax over hashed features of the history h: the last word, the last two words, and the last but one
(a skip feature), and a bias; those of the groups are hashed together with the class. Frequent words are classes of their own, the other words of a bounded
vocabulary (all words from some count on) share classes of about equal mass, each of which is dealt into ``GROUPS`` groups of about equal mass; all remaining words share hashed classes. Within a group
words go by their count, in a hashed class with 0.1 added and one more unit for the words never seen.
So the probabilities of all words, an unseen one of each hashed class and the end add up to one.

Counts are taken over every training text, and the number of feature buckets grows with the square root of the number of
training tokens, up to ``MOST_BUCKETS``, which bounds the broadcast. Weights are trained in rounds, each on its own share of the
training texts: tasks send observed and expected feature counts, in shards that are summed in two levels,
and each update moves a weight by the logarithm of their ratio, divided by the number of active features
(the step of iterative scaling, an ascent on the likelihood). Expected counts are summed as whole numbers of 1 / ``UNIT``, so the
weights don't depend on how texts are dealt to tasks. Only the weights and the
vocabulary, of at most ``vocabulary`` words, go to the tasks; the counts of all other words are met by a join.

Defined results: a null text is an empty one, which still has its end; repeated rows are each scored; a null key
is neither held out nor learned from; no training text makes every base probability 1 and the classes
uniform; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmatch.llm._common import map_arrow, store, table

END = b""  # no word is empty
ALPHA = 0.1
VOCABULARY = 1 << 18
SINGLE, SHARED, HASHED = 40, 16, 8
CLASSES = SINGLE + SHARED + HASHED
GROUPS = 32  # of a shared class
LEAST_BUCKETS, MOST_BUCKETS = 4096, 1 << 17  # for the last word and for the last two; half as many for the last but one
ACTIVE = 3 + 1
UNIT = 1 << 15  # expected counts are rounded to a part in so many
ROUNDS = 3
PRIOR = 1.0
LIMIT = 12.0  # of a weight's size, but for the bias, so that products of factors stay within a float's bounds
SHARDS, FAN = 16, 64
TASK_TOKENS = 1 << 27  # training tokens to a task, at most
SHORT_RUN = 32
KEYS = 1 << 22  # observed features counted at once
FLUSH = 300_000
STEP = 1 << 15  # tokens whose softmax is held at once
NEAR = 1 << 11  # tokens whose products are made at once, in the processor's cache


def tokens_of(text: bytes | None) -> list[bytes]:
    out = (text or b"").lower().split()
    out.append(END)
    return out


def held_out(key: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string")), F.lit(10)) == 0, F.lit(False))


def _texts(docs: DataFrame, text: str) -> Column:
    return F.col(text).cast("string").cast("binary").alias("_text")


def count_words(train: DataFrame, text: str = "text") -> DataFrame:
    """``word binary, n long`` over all tokens; the end is the empty word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
            seen.clear()
            return b

        for batch in batches:
            for t in batch.column(0).to_pylist():
                seen.update(tokens_of(t))
                if len(seen) >= FLUSH:
                    yield out()
        if seen:
            yield out()

    return map_arrow(train.select(_texts(train, text)), run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """What a task needs to score; its size is bounded by the parameters."""

    ids: dict[bytes, int]
    cls: np.ndarray  # class of each id
    base: np.ndarray  # log10 base probability of each id; hashed classes' own are met by the join
    inner: np.ndarray  # log10 probability within the class
    total: int
    distinct: int
    hashed_total: np.ndarray
    hashed_distinct: np.ndarray
    group: np.ndarray  # of each id within its class; -1 where the class has none
    buckets: tuple[int, int, int]
    weights: np.ndarray  # of classes: bias, then the buckets of each feature
    deep: np.ndarray  # of groups: a bias for each shared class, then the buckets of each feature

    def histories(self, ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The last word and the last but one before each token of its text; 1 where there is none."""
        one = np.concatenate([[0], ids[:-1]]).astype(np.uint64) + 2
        two = np.concatenate([[0, 0], ids[:-2]])[: len(ids)].astype(np.uint64) + 2
        one[starts] = 1
        two[starts] = 1
        second = starts + 1
        second = second[second < len(ids)]
        two[second] = 1
        return one, two

    def features(self, one: np.ndarray, two: np.ndarray, cls: np.ndarray | None = None) -> list[np.ndarray]:
        """Rows of the active weights: those of the classes, or of the groups of a shared class."""
        a, b, c = self.buckets
        mix = lambda x, n: ((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(n)
        first, salt = 1, np.uint64(0)
        if cls is not None:
            first, salt = SHARED, (cls.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        rows = [first + mix(one + salt, a), first + a + mix(one * np.uint64(1_000_003) + two + salt, b), first + a + b + mix(two + np.uint64(7) + salt, c)]
        bias = np.zeros(len(one), np.int64) if cls is None else cls - SINGLE
        return [bias, *(r.astype(np.int64) for r in rows)]

    def factors(self) -> tuple[np.ndarray, np.ndarray]:
        """Exponentials of the weights of classes and groups, once a task."""
        return np.exp(self.weights), np.exp(self.deep)

    def log_classes(self, rows: list[np.ndarray]) -> np.ndarray:
        """Natural logarithms of all class probabilities."""
        with np.errstate(divide="ignore"):
            return np.log(softmax(self.factors()[0], rows).astype(np.float64))

    def log_parts(self, factors: tuple[np.ndarray, np.ndarray], ids: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Natural logarithm of the probability of each token's class and group."""
        cls = self.cls[ids]
        out = log_softmax(factors[0], self.features(one, two), cls)
        deep = np.flatnonzero(self.group[ids] >= 0)
        if len(deep):
            out[deep] += log_softmax(factors[1], self.features(one[deep], two[deep], cls[deep]), self.group[ids[deep]])
        return out

    def lookup(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        words, starts = [], []
        for t in texts:
            starts.append(len(words))
            words += tokens_of(t)
        first, crc = len(self.cls) - HASHED, zlib.crc32
        flat = np.fromiter(map(self.ids.get, words, repeat(-1)), np.int64, len(words))
        rare = np.flatnonzero(flat < 0)
        flat[rare] = [first + crc(words[k]) % HASHED for k in rare.tolist()]
        return flat, np.array(starts, np.int64), words


def _products(factors: np.ndarray, rows: list[np.ndarray]) -> Iterator[tuple[slice, np.ndarray]]:
    """Products of the features' factors, ``NEAR`` tokens at a time, in one place that the next block overwrites."""
    held = np.empty((2, NEAR, factors.shape[1]), factors.dtype)
    for at in range(0, len(rows[0]), NEAR):
        here = slice(at, min(at + NEAR, len(rows[0])))
        z, other = held[:, : here.stop - at]
        np.take(factors, rows[0][here], axis=0, out=z, mode="clip")  # clip: written without a copy; all rows are in range
        for r in rows[1:]:
            z *= np.take(factors, r[here], axis=0, out=other, mode="clip")
        yield here, z


def softmax(factors: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    """Probabilities of each token from the products of its features' factors."""
    out = np.empty((len(rows[0]), factors.shape[1]), factors.dtype)
    for here, z in _products(factors, rows):
        np.divide(z, z.sum(1, keepdims=True), out=out[here])
    return out


def log_softmax(factors: np.ndarray, rows: list[np.ndarray], chosen: np.ndarray) -> np.ndarray:
    """Natural logarithm of the probability of each token's chosen column; the others aren't made."""
    p = np.empty(len(chosen), factors.dtype)
    for here, z in _products(factors, rows):
        p[here] = z[np.arange(len(z)), chosen[here]] / z.sum(1)
    return np.log(p.astype(np.float64))


def _blocks(batches: Iterator[pa.RecordBatch], column: int, rows: int = 64) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _frequent(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """The words, by falling count, of all counts from the least step on that leaves ``most`` words at the most.

    Steps are single counts up to 4,096 and 64 to an octave beyond, so the driver gets a few thousand of
    them and then the words themselves, not every partition's most frequent.
    """
    step = F.when(F.col("n") <= 4096, F.col("n")).otherwise(4097 + F.floor(F.log2(F.col("n") / 4096) * 64))
    steps = sorted(((r["step"], r["v"]) for r in counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("v")).collect()), reverse=True)
    least, held = None, 0
    for at, v in steps:
        held += v
        if held > most:
            break
        least = at
    if least is None:
        return []
    got = counts.filter(step >= least).select("word", "n").toArrow()
    return sorted(zip(got["word"].to_pylist(), got["n"].to_pylist(), strict=True), key=lambda w: (-w[1], w[0]))


def _new_model(spark: SparkSession, counts: DataFrame, vocabulary: int) -> Model:
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    top = _frequent(counts, vocabulary)
    size = np.array([n for _, n in top], np.float64)
    cls = np.zeros(len(top) + HASHED, np.int64)
    cls[: min(SINGLE, len(top))] = np.arange(min(SINGLE, len(top)))
    shared = size[SINGLE:]
    if len(shared):
        mass = (np.cumsum(shared) - shared / 2) / shared.sum()
        cls[SINGLE : len(top)] = SINGLE + np.minimum((mass * SHARED).astype(int), SHARED - 1)
    cls[len(top) :] = SINGLE + SHARED + np.arange(HASHED)
    hashed = np.zeros((HASHED, 2))
    for r in counts.groupBy(F.pmod(F.crc32("word"), F.lit(HASHED)).alias("h")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect():
        hashed[r["h"]] = r["n"], r["v"]
    for w, n in top:
        hashed[zlib.crc32(w) % HASHED] -= n, 1
    mass = np.bincount(cls[: len(top)], weights=size, minlength=CLASSES).astype(np.float64)
    mass[SINGLE + SHARED :] = hashed[:, 0]
    group = np.full(len(cls), -1, np.int64)
    groups = np.zeros((SHARED, GROUPS))
    for k in range(SHARED):
        own = np.flatnonzero(cls[: len(top)] == SINGLE + k)
        if len(own):
            middle = (np.cumsum(size[own]) - size[own] / 2) / size[own].sum()
            group[own] = np.minimum((middle * GROUPS).astype(int), GROUPS - 1)
            groups[k] = np.bincount(group[own], weights=size[own], minlength=GROUPS)
    inner = np.zeros(len(cls))
    shared_ids = np.flatnonzero(group >= 0)
    inner[shared_ids] = np.log10(size[shared_ids] / groups[cls[shared_ids] - SINGLE, group[shared_ids]])
    base = np.zeros(len(cls))
    base[: len(top)] = np.log10((size + ALPHA) / (total + ALPHA * (distinct + 1)))
    n = LEAST_BUCKETS
    while 4 * (2 * n) ** 2 <= total and n < MOST_BUCKETS:
        n *= 2
    buckets = (n, n, n // 2)
    weights = np.zeros((1 + sum(buckets), CLASSES), np.float32)
    deep = np.zeros((SHARED + sum(buckets), GROUPS), np.float32)
    there = mass > 0
    there[SINGLE + SHARED :] = True  # unseen words
    weights[0] = np.where(there, np.log((mass + PRIOR) / (mass.sum() + PRIOR * CLASSES)), -np.inf)
    filled = groups > 0
    some = filled.any(1, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        deep[:SHARED] = np.where(some, np.where(filled, np.log(groups / groups.sum(1, keepdims=True)), -np.inf), 0)
    return Model({w: i for i, (w, _) in enumerate(top)}, cls, base, inner, int(total), int(distinct), hashed[:, 0], hashed[:, 1], group, buckets, weights, deep)


class _Counts:
    """Observed and expected counts of a weight matrix."""

    def __init__(self, shape: tuple[int, int]):
        self.shape, self.keys, self.held = shape, [], 0
        self.seen, self.due = np.zeros(shape[0] * shape[1], np.int64), np.zeros(shape, np.int64)

    def add(self, rows: list[np.ndarray], p: np.ndarray, chosen: np.ndarray) -> None:
        """``p`` is overwritten."""
        np.rint(np.multiply(p, np.float32(UNIT), out=p), out=p)
        p = p.astype(np.int32)  # the sums of STEP tokens stay within 31 bits
        for r in rows:
            order = np.argsort(r.astype(np.uint16) if self.shape[0] <= 1 << 16 else r, kind="stable")
            at = r[order]
            first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            self._add_runs(p, order, at, first)
            self.keys.append(r * self.shape[1] + chosen)
            self.held += len(r)
        if self.held >= KEYS:
            self.count()

    def _add_runs(self, p: np.ndarray, order: np.ndarray, at: np.ndarray, first: np.ndarray) -> None:
        """Add the sum of each run's rows: long runs one by one, short ones together, a row of each at a time."""
        if len(first) == 1:
            self.due[at[0]] += np.add.reduce(p, axis=0, dtype=np.int32)
            return
        n = np.diff(np.append(first, len(at)))
        for a, k in zip(first[n > SHORT_RUN].tolist(), n[n > SHORT_RUN].tolist(), strict=True):
            self.due[at[a]] += np.add.reduce(np.take(p, order[a : a + k], axis=0), axis=0, dtype=np.int32)
        some = np.flatnonzero(n <= SHORT_RUN)
        some = some[np.argsort(-n[some], kind="stable")]
        if len(some):
            fall, from_ = n[some], first[some]
            total = np.take(p, order[from_], axis=0)
            for k in range(1, int(fall[0])):
                m = int(np.searchsorted(-fall, -k))  # runs of more than k rows
                total[:m] += np.take(p, order[from_[:m] + k], axis=0)
            self.due[at[from_]] += total

    def count(self) -> None:
        if self.keys:
            self.seen += np.bincount(np.concatenate(self.keys), minlength=len(self.seen))
            self.keys, self.held = [], 0

    def shards(self) -> list[bytes]:
        self.count()
        both = np.stack([self.seen.reshape(self.shape), self.due], 2)
        return [zlib.compress(x.tobytes(), 1) for x in np.array_split(both, SHARDS)]


def _gradient(model):
    """A task's observed and expected counts of its share of texts, in shards of the buckets, classes before groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        factors = m.factors()
        top, deep = _Counts(m.weights.shape), _Counts(m.deep.shape)
        some = False
        for block in _blocks(batches, 0):
            ids, starts, _ = m.lookup(block.column(0).to_pylist())
            one, two = m.histories(ids, starts)
            some = True
            for at in range(0, len(ids), STEP):
                w, x, y = ids[at : at + STEP], one[at : at + STEP], two[at : at + STEP]
                cls = m.cls[w]
                rows = m.features(x, y)
                top.add(rows, softmax(factors[0], rows), cls)
                inside = np.flatnonzero(m.group[w] >= 0)
                if len(inside):
                    rows = m.features(x[inside], y[inside], cls[inside])
                    deep.add(rows, softmax(factors[1], rows), m.group[w[inside]])
        if some:
            part = TaskContext.get().partitionId() % FAN
            shards = top.shards() + deep.shards()
            yield pa.RecordBatch.from_arrays([pa.array(range(len(shards)), pa.int32()), pa.array([part] * len(shards), pa.int32()), pa.array(shards, pa.binary())], ["shard", "part", "data"])

    return run


def _added(pdf: pd.DataFrame) -> pd.DataFrame:
    total = 0
    for d in pdf["data"]:
        total = total + np.frombuffer(zlib.decompress(d), np.int64)
    return pd.DataFrame({"shard": pdf["shard"].iloc[:1], "data": [zlib.compress(total.tobytes(), 1)]})


def _moved(weights: np.ndarray, shards: list[bytes], biases: int) -> np.ndarray:
    both = np.concatenate([np.frombuffer(zlib.decompress(d), np.int64) for d in shards]).reshape(*weights.shape, 2).astype(np.float64)
    out = weights + np.log((both[..., 0] + PRIOR) / (both[..., 1] / UNIT + PRIOR)) / ACTIVE
    out[biases:] = np.clip(out[biases:], -LIMIT, LIMIT)
    return out.astype(np.float32)


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: int = VOCABULARY, rounds: int = ROUNDS) -> tuple[Model, DataFrame]:
    """The model of the given texts and the stored counts ``word, n`` of all their words."""
    spark = docs.sparkSession
    counts = store(count_words(docs, text), "counts")
    model = _new_model(spark, counts, vocabulary)
    share = F.pmod(F.xxhash64(key), F.lit(rounds))
    for turn in range(rounds):
        sent = spark.sparkContext.broadcast(model)
        mine = docs.filter(share == turn).select(_texts(docs, text))
        # a gradient has one size whatever its texts, so there are a few to a core, not one to each file
        mine = mine.coalesce(max(2 * spark.sparkContext.defaultParallelism, -(-model.total // TASK_TOKENS)))
        parts = map_arrow(mine, _gradient(sent), "shard int, part int, data binary")
        summed = parts.groupBy("shard", "part").applyInPandas(_added, "shard int, data binary").groupBy("shard").applyInPandas(_added, "shard int, data binary")
        got = {r["shard"]: bytes(r["data"]) for r in summed.collect()}
        sent.unpersist()
        if got:
            model.weights = _moved(model.weights, [got[k] for k in range(SHARDS)], 1)
            model.deep = _moved(model.deep, [got[SHARDS + k] for k in range(SHARDS)], SHARED)
    return model, counts


def score(docs: DataFrame, model: Model, counts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_tokens, n_known, base_score, score`` of every row.

    Words of the vocabulary are scored in the task; each text's other words are joined, once a
    word, with the counts of all words.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = sent.value
        row = TaskContext.get().partitionId() << 33
        first = len(m.cls) - HASHED
        factors = m.factors()
        for block in _blocks(batches, 1):
            ids, starts, words = m.lookup(block.column(1).to_pylist())
            (one, two), logs = m.histories(ids, starts), np.empty(len(ids))
            for at in range(0, len(ids), STEP):
                logs[at : at + STEP] = m.log_parts(factors, ids[at : at + STEP], one[at : at + STEP], two[at : at + STEP])
            known = ids < first
            total = np.add.reduceat(logs / np.log(10) + m.inner[ids], starts)
            base = np.add.reduceat(m.base[ids], starts)
            ends = np.append(starts[1:], len(ids))
            names, times, cuts = [], [], [0]
            rare = np.flatnonzero(~known)
            lo, hi = np.searchsorted(rare, starts), np.searchsorted(rare, ends)
            for a, b in zip(lo, hi, strict=True):
                c = Counter([words[k] for k in rare[a:b].tolist()])
                names += c
                times += c.values()
                cuts.append(len(names))
            offsets = pa.array(cuts, pa.int32())
            ints = lambda x: pa.array(np.asarray(x, np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    block.column(0), ints(row + np.arange(block.num_rows)), ints(ends - starts), ints(np.add.reduceat(known.astype(np.int64), starts)), pa.array(base), pa.array(total),
                    pa.ListArray.from_arrays(offsets, pa.array(names, pa.binary())), pa.ListArray.from_arrays(offsets, pa.array(times, pa.int64())),
                ],
                [key, "row", "n_tokens", "n_known", "base", "own", "names", "times"],
            )
            row += block.num_rows

    parts = map_arrow(docs.select(key, _texts(docs, text)), run, f"{key} {kind}, row long, n_tokens long, n_known long, base double, own double, names array<binary>, times array<long>")
    # A text's own row rides along as a word that none has (a blank and the row), the others as (row, word, n).
    blank = F.concat(F.lit(b" "), F.col("row").cast("string").cast("binary"))
    whole = F.array(F.struct(blank.alias("names"), F.lit(0).cast("long").alias("times")))
    each = parts.select(key, "row", "n_tokens", "n_known", "base", "own", F.inline(F.concat(whole, F.arrays_zip("names", "times"))))
    mine = F.col("times") == 0
    each = each.select(
        "row", F.col("names").alias("word"), F.col("times").alias("n_in"), F.when(mine, F.struct(key, "n_tokens", "n_known", "base", "own")).alias("whole")
    )
    found = each.join(counts, "word", "left").withColumn("c", F.coalesce("n", F.lit(0)))
    hashed = F.pmod(F.crc32("word"), F.lit(HASHED))
    size = F.get(F.lit([float(x) for x in model.hashed_total + ALPHA * (model.hashed_distinct + 1)]), hashed)
    rare = F.col("n_in") > 0
    sums = found.groupBy("row").agg(
        F.max("whole").alias("w"),
        F.sum(F.when(rare & (F.col("c") > 0), F.col("n_in")).otherwise(0)).alias("more_known"),
        F.sum(F.when(rare, F.col("n_in") * F.log10((F.col("c") + F.lit(ALPHA)) / F.lit(model.total + ALPHA * (model.distinct + 1)))).otherwise(0.0)).alias("more_base"),
        F.sum(F.when(rare, F.col("n_in") * F.log10((F.col("c") + F.lit(ALPHA)) / size)).otherwise(0.0)).alias("more_own"),
    )
    return sums.select(
        f"w.{key}", "w.n_tokens", (F.col("w.n_known") + F.col("more_known")).alias("n_known"), (F.col("w.base") + F.col("more_base")).alias("base_score"), (F.col("w.own") + F.col("more_own")).alias("score")
    )


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model, counts = train(docs.filter(F.col("doc_id").isNotNull() & ~held_out()))
    out = score(docs, model, counts)
    return out.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")
