"""Language identification by prediction by partial matching.

For each language a byte context tree of orders 0 to ``order`` is counted on labelled texts. Its
statistics are then frozen: a byte costs log2((T + q) / c) in the longest context in which it was
seen (c times, of T, with q different bytes there) plus log2((T + q) / q) for each longer context that
had to be escaped; behind order 0 a byte costs 8 bits. The language of least exact code length wins.

All languages' trees are merged into one, with the costs of every language at each node, so a text is
walked once, by array look-ups over whole Arrow batches.

The trees are fitted on a bounded sample: per language at most ``max_docs`` labelled documents, those of least
hash, and of a longer text ``max_chars`` characters from a place that its hash gives. More than
``MAX_LANGUAGES`` languages are an error. Every document is scored on its whole text.

Defined results: ``und`` and score 0 for a null text, a text without a letter, or where no language was
learned; rows with a null language are never learned from; equal code lengths go to the language first in
order; repeated rows are scored alike; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType
from pyspark.sql.window import Window

from shelfmatch.llm._common import map_arrow, table

ORDER = 4
MAX_DOCS = 400
MAX_CHARS = 20_000
MAX_LANGUAGES = 1000
PIECE = 1 << 20  # bytes walked at once
LETTER = re.compile(r"[^\W\d_]")


class Trees:
    """Frozen statistics of all languages."""

    def __init__(self, texts: dict[str, list[bytes]], order: int = ORDER):
        self.langs = sorted(texts)
        self.order = order
        n = len(self.langs)
        raw = [self._joined(texts[k]) for k in self.langs]  # small integers, as are all that follow a place
        seen = np.unique(np.concatenate([r[r >= 0] for r in raw])) if raw else np.array([], np.int16)
        self.symbol = np.zeros(257, np.int32)  # 0: never seen, and the gap between texts
        self.symbol[seen] = np.arange(1, len(seen) + 1)
        self.width = a = len(seen) + 1
        codes = [self.symbol[r] for r in raw]  # a gap is -1 and so takes the last entry, 0
        before = codes  # of each place, the gram of length g - 1 that ends there; only one length is held
        self.child: list[np.ndarray] = []
        counts = [np.stack([np.bincount(c, minlength=a).astype(np.float64) for c in codes])] if raw else []
        if raw:
            counts[0][:, 0] = 0
        parents, suffixes = ([np.zeros(a, np.int64)], [np.zeros(a, np.int64)]) if raw else ([], [])
        for _ in range(2, order + 2 if raw else 0):
            keys = [np.where((i[:-1] > 0) & (c[1:] > 0), i[:-1].astype(np.int64) * a + c[1:], 0) for i, c in zip(before, codes, strict=True)]
            grams = np.unique(np.concatenate([np.array([0]), *map(np.unique, keys)]))
            child = np.zeros(counts[-1].shape[1] * a, np.int32)
            child[grams] = np.arange(len(grams))
            child[0] = 0
            self.child.append(child)
            now = [np.concatenate([np.zeros(1, np.int32), child[k]]) for k in keys]
            del keys
            c = np.stack([np.bincount(i, minlength=len(grams)).astype(np.float64) for i in now])
            c[:, 0] = 0
            counts.append(c)
            parents.append(grams // a)
            suffix = np.zeros(len(grams), np.int64)
            for i, shorter in zip(now, before, strict=True):
                suffix[i] = shorter
            suffix[0] = 0
            suffixes.append(suffix)
            before = now
        self.cost, self.escape, self.offset = self._frozen(n, counts, parents, suffixes)

    @staticmethod
    def _joined(texts: list[bytes]) -> np.ndarray:
        parts = [np.array([-1], np.int16)]
        for t in texts:
            parts += [np.frombuffer(t, np.uint8).astype(np.int16), np.array([-1], np.int16)]
        return np.concatenate(parts)

    @staticmethod
    def _frozen(n, counts, parents, suffixes):
        """Per node of every level the cost of its last byte, and of an escape from it as a context."""
        log = np.log2
        costs, escapes = [], [np.zeros((1, n))]
        shorter = np.full((1, n), 8.0)
        offset = [0]
        for g, (c, parent, suffix) in enumerate(zip(counts, parents, suffixes, strict=True)):
            size = 1 if g == 0 else counts[g - 1].shape[1]
            total = np.stack([np.bincount(parent, weights=x, minlength=size) for x in c], 1)
            kinds = np.stack([np.bincount(parent, weights=(x > 0), minlength=size) for x in c], 1)
            with np.errstate(divide="ignore", invalid="ignore"):
                esc = np.where(total > 0, log((total + kinds) / np.maximum(kinds, 1)), 0.0)
                cost = np.where(c.T > 0, log((total + kinds)[parent] / c.T), esc[parent] + shorter[suffix])
            if g:
                cost[0] = 0
                esc[0] = 0
                escapes.append(esc)
            else:
                escapes[0] = esc
                cost[0] = esc[0] + 8.0  # a byte that no language has
            costs.append(cost)
            shorter = cost
            offset.append(offset[-1] + len(cost))
        if not costs:
            return np.zeros((1, 0), np.float32), [], offset
        return np.concatenate(costs), escapes, offset

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """Exact code lengths in bits: a row a text, a column a language."""
        out = np.zeros((len(texts), len(self.langs)))
        todo, size = [], 0
        for k, t in enumerate(texts):
            for at in range(0, len(t), PIECE):
                part = t[max(0, at - self.order) : at + PIECE]
                todo.append((k, part, min(at, self.order)))
                size += len(part)
                if size >= PIECE:
                    self._walk(todo, out)
                    todo, size = [], 0
        if todo:
            self._walk(todo, out)
        return out

    def _walk(self, todo: list[tuple[int, bytes, int]], out: np.ndarray) -> None:
        raw = np.frombuffer(b"\0" + b"\0".join([p for _, p, _ in todo]), np.uint8)
        ends = np.cumsum([len(p) + 1 for _, p, _ in todo])
        starts = ends - np.array([len(p) for _, p, _ in todo])
        code = self.symbol[raw]
        code[starts - 1] = 0
        a = self.width
        levels = [code]
        best = code.copy()
        deepest = np.zeros(len(code), np.int8)
        for g, child in enumerate(self.child, 1):
            before = levels[-1]
            now = np.zeros(len(code), np.int32)
            np.take(child, before[:-1] * a + code[1:], out=now[1:], mode="clip")
            levels.append(now)
            hit = now > 0
            best[hit] = now[hit] + self.offset[g]
            deepest[hit] = g
        bits = self.cost[best]
        for g in range(1, len(levels)):  # contexts of g bytes that were there but didn't help
            ctx = levels[g - 1]
            lost = np.flatnonzero((deepest[1:] < g) & (ctx[:-1] > 0)) + 1
            bits[lost] += self.escape[g][ctx[lost - 1]]
        bits[starts - 1] = 0
        for (k, _, skip), s in zip(todo, starts, strict=True):
            if skip:
                bits[s : s + skip] = 0
        sums = np.add.reduceat(bits, starts - 1, axis=0, dtype=np.float64)
        for (k, _, _), x in zip(todo, sums, strict=True):
            out[k] += x

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float]]:
        """Language, posterior under equal priors, bits a byte."""
        fit = [k for k, t in enumerate(texts) if t and LETTER.search(t)] if self.langs else []
        raw = [texts[k].encode("utf-8", "surrogatepass") for k in fit]
        langs, scores, rates = ["und"] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
        if fit:
            bits = self.lengths(raw)
            least = bits.argmin(1)
            best = bits[np.arange(len(fit)), least]
            share = 1 / np.exp2(np.maximum(best[:, None] - bits, -1000)).sum(1)
            for j, k in enumerate(fit):
                langs[k], scores[k], rates[k] = self.langs[least[j]], float(share[j]), float(best[j] / len(raw[j]))
        return langs, scores, rates


def sample(labelled: DataFrame, key: str, text: str, lang: str, max_docs: int = MAX_DOCS, max_chars: int = MAX_CHARS) -> dict[str, list[bytes]]:
    """At most ``max_docs`` texts a language, those of least hash; a hash bound keeps most rows out of the sort."""
    rows = labelled.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    rows = rows.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"), F.xxhash64(key, text).alias("h"))
    many = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MAX_LANGUAGES + 1).collect()
    if not many:
        return {}
    if len(many) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    shares = F.create_map(*[F.lit(x) for r in many for x in (r["lang"], min(1.0, 3 * max_docs / r["n"]))])
    near = rows.filter(F.pmod("h", F.lit(1 << 20)) <= shares[F.col("lang")] * (1 << 20))
    over = F.length("text") - max_chars
    near = near.withColumn("text", F.when(over > 0, F.substring(F.col("text"), (F.pmod("h", over + 1) + 1).cast("int"), F.lit(max_chars))).otherwise(F.col("text")))
    top = near.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 20)), "h", "text"))).filter(F.col("k") <= max_docs)
    out: dict[str, list[bytes]] = {}
    for r in top.select("lang", "text").collect():
        out.setdefault(r["lang"], []).append(r["text"].encode())
    return out


def learned_from(key: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(key).cast("string")), F.lit(3)) != 1


def predict(docs: DataFrame, trees: Trees, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, lang_pred, score, bits_per_byte`` of every row."""
    model = docs.sparkSession.sparkContext.broadcast(trees)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores, rates = model.value.predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rates, pa.float64())], [key, "lang_pred", "score", "bits_per_byte"])

    return map_arrow(docs.select(key, F.col(text).cast("string").alias("_text")), run, f"{key} {kind}, lang_pred string, score double, bits_per_byte double")


def with_language(docs: DataFrame, trees: Trees, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``bits_per_byte`` of each row; columns of those names go."""
    model = docs.sparkSession.sparkContext.broadcast(trees)
    added = {"lang_pred": pa.string(), "score": pa.float64(), "bits_per_byte": pa.float64()}
    names = [c for c in docs.columns if c not in added]
    kept = docs.select(*names).withColumn(text, F.col(text).cast("string"))
    schema = StructType([*kept.schema.fields, *(StructField(n, StringType() if n == "lang_pred" else DoubleType()) for n in added)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = model.value.predict(batch.column(names.index(text)).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(g, t) for g, t in zip(got, added.values(), strict=True))], [*names, *added])

    return map_arrow(kept, run, schema)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    trees = Trees(sample(docs.filter(learned_from()), "doc_id", "text", "lang"))
    out = predict(docs.select("doc_id", "text"), trees)
    return out.select("doc_id", F.coalesce(~learned_from(), F.lit(False)).alias("held_out"), "lang_pred", "score", "bits_per_byte")
