"""Benchmark decontamination by template canonicalisation.

Words are lower-cased and stripped of punctuation; numbers, names (capitalised words inside a sentence) and
units (behind a number) become typed placeholders. Windows of ``width`` such tokens are hashed and joined
with those of the benchmark. What matched at one offset between a document and an item is a passage. A window
counts if its own slots agree: each name or unit of the item stands for one of the document's, to which others
may come down as well; numbers are free, as equal ones may part (3 apples and 3 dollars). So a question asked
again with other numbers or names is caught, and windows that conflict don't count, but take no others with them.

A passage counts if it holds at least ``LEAST_RUN`` windows or ``LEAST_SHARE`` of an item's windows. An item
of fewer tokens than ``WIDTH`` is one window of its own length. Windows of which more than half are slots, and
items of one window, are searched for verbatim too (lower-cased words, with the bare punctuation between them);
items of fewer than ``SHORTEST`` tokens only so, and those under ``LEAST_WORDS`` words not at all. A capitalised
word at the start of a document's line is tried both as a sentence's first word and as a name.

Every document is read whole, once; a bitmap of fixed size keeps windows that can't match out of the join.
The benchmark's windows are broadcast up to ``BROADCAST_ROWS`` and joined by a shuffle beyond.

Defined results: null, empty and short texts match nothing; null ids are reported as null; repeated rows are
each reported; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmatch.llm._common import join_hot, map_arrow, store, table

WIDTH = 8
SHORTEST = 5
LEAST_WORDS = 3
LEAST_RUN = 6
LEAST_SHARE = 0.5
BITS = 22
BROADCAST_ROWS = 500_000
KEEP_WORDS = 200_000
NUM, NAME, UNIT = "<num>", "<name>", "<unit>"
NUMBER_WORDS = frozenset("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split())
UNITS = frozenset("mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres mg g kg t lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years usd eur gbp dollar dollars cent cents euro euros percent mph kmh hz khz mhz ghz w kw v".split())
_NUMBER = re.compile(r"[+\-]?[$€£]?\d[\d.,:/]*%?")
_WITH_UNIT = re.compile(r"([+\-]?[$€£]?\d[\d.,]*)([^\W\d_]+)")
_EDGE = re.compile(r"\A[\W_]+|[\W_]+\Z")
_ENDS = ".!?:;"
_AROUND = ".,;:!?\"'()[]{}“”‘’"  # no part of a verbatim word
_MARKS = ".,;:!?"
_SPECIAL = NUMBER_WORDS | UNITS
_P = 0x9E3779B97F4A7C15 | 1


N, U, T, W = 1, 2, 3, 0  # kinds: number, perhaps a unit, title case, plain word


def _digest(s: str) -> int:
    return xxhash.xxh64_intdigest(s, 7)


def parts_of(raw: str) -> list[tuple[int, str]]:
    """(kind, value) of a word's template tokens: none of bare punctuation, two of a number with its unit."""
    core = _EDGE.sub("", raw)
    if not core:
        return []
    low = core.lower()
    if low in NUMBER_WORDS or (core[0].isdigit() and _NUMBER.fullmatch(core)):
        return [(N, low)]
    if core[0].isdigit() and (m := _WITH_UNIT.fullmatch(core)):
        return [(N, m[1]), (U, m[2].lower())]
    if low in UNITS:
        return [(U, low)]
    if len(core) > 1 and core[0].isupper() and core[1:].islower():
        return [(T, low)]
    return [(W, low)]


def _row(raw: str) -> tuple[int, int, int, int, int, bool]:
    """(tokens, kind, hash, second kind, second hash, whether it ends a sentence) of a word; words of letters alone, or
    with one mark behind them, go by a shorter way to the same."""
    end = raw[-1] in _ENDS
    core = raw if raw.isalpha() else raw[:-1] if raw[-1] in _MARKS and raw[:-1].isalpha() else ""
    if core:
        low = core if core.islower() else core.lower()
        if low not in _SPECIAL:
            return 1, T if len(core) > 1 and core[0].isupper() and core[1:].islower() else W, xxhash.xxh64_intdigest(low, 7), W, 0, end
    parts = parts_of(raw)
    two = [(k, _digest(NUM) if k == N else _digest(v)) for k, v in parts] + [(W, 0)] * (2 - len(parts))
    return len(parts), *two[0], *two[1], end


class _Words(dict):
    """Word -> its number; what it stands for is worked out for all new words of a batch at once."""

    def __init__(self):
        super().__init__()
        self.raws: list[str] = []
        self.plain: dict[int, int] = {}
        self.known = 0
        self.table = [np.zeros(0, k) for k in self._KINDS]

    _KINDS = (np.int64, np.int8, np.uint64, np.int8, np.uint64, bool)

    def columns(self) -> list[np.ndarray]:
        """The rows of all words as arrays; only words since the last call are looked at."""
        new = self.raws[self.known :]
        if new:
            n = len(self.raws)
            if n > len(self.table[0]):
                self.table = [np.concatenate([c[: self.known], np.zeros(2 * n - self.known, c.dtype)]) for c in self.table]
            for c, v in zip(self.table, zip(*map(_row, new), strict=True), strict=True):
                c[self.known : n] = np.array(v, c.dtype)
            self.known = n
        return self.table

    def verbatim(self, ids: np.ndarray) -> np.ndarray:
        """Hashes of the words as they stand, made when they are asked for."""
        some, back = np.unique(ids, return_inverse=True)
        for k in some.tolist():
            if k not in self.plain:
                self.plain[k] = _digest("=" + (self.raws[k].lower().strip(_AROUND) or self.raws[k]))
        return np.array([self.plain[k] for k in some.tolist()], np.uint64)[back]

    def __missing__(self, raw: str) -> int:
        self[raw] = at = len(self.raws)
        self.raws.append(raw)
        return at


class Templates:
    """The template tokens of some texts, one behind the other."""

    def __init__(self, texts: list[str | None], words: _Words):
        flat: list[str] = []
        counts = []
        line_ends = []
        for t in texts:
            had = len(flat)
            for line in (t or "").splitlines():
                flat += line.split()
                line_ends.append(len(flat))
            counts.append(len(flat) - had)
        ids = np.fromiter(map(words.__getitem__, flat), np.int64, len(flat))
        n, kind, digest, kind2, digest2, ends = words.columns()
        doc = np.repeat(np.arange(len(texts)), counts)
        before = np.concatenate([[0], np.cumsum(ends[ids])])  # sentence ends before each word
        real = np.flatnonzero(n[ids] > 0)
        again = np.zeros(len(real), bool)  # behind another word of its text
        again[1:] = doc[real[1:]] == doc[real[:-1]]
        start = ~again
        start[1:] |= before[real[1:]] > before[real[:-1]]
        line_start = np.zeros(len(real) + 1, bool)
        line_start[np.searchsorted(real, line_ends)] = True  # the first word behind each line end
        times = n[ids[real]]
        at = np.repeat(np.arange(len(real)), times)
        self.second = np.zeros(len(at), bool)
        self.second[1:] = at[1:] == at[:-1]
        self.word = ids[real][at]
        self.doc = doc[real][at]
        self.raw = (words, ids, n[ids] == 0, real, at)
        kinds = np.where(self.second, kind2[self.word], kind[self.word])
        self.hashes = np.where(self.second, digest2[self.word], digest[self.word])
        behind_number = np.zeros(len(at), bool)
        behind_number[1:] = (kinds[:-1] == N) & (self.doc[1:] == self.doc[:-1])
        unit, name = (kinds == U) & behind_number, (kinds == T) & ~start[at] & ~self.second
        self.hashes[unit] = _digest(UNIT)
        self.hashes[name] = _digest(NAME)
        self.slot = np.where(kinds == N, 1, np.where(unit, 2, np.where(name, 3, 0)))
        turned = name & line_start[at]
        self.views = [(self.hashes, self.slot)]  # the second one takes names at the start of a line for plain words
        if turned.any():
            self.views.append((np.where(turned, digest[self.word], self.hashes), np.where(turned, 0, self.slot)))
        self.sizes = np.bincount(self.doc, minlength=len(texts)) if len(at) else np.zeros(len(texts), np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]]).astype(np.int64)
        self.raws = words.raws

    @cached_property
    def verbatim(self) -> tuple[np.ndarray, np.ndarray]:
        """(verbatim hash of each token, hash of the bare punctuation between it and the token before)."""
        words, ids, is_bare, real, at = self.raw
        plain = words.verbatim(ids)
        bare = np.concatenate([np.zeros(1, np.uint64), np.cumsum(np.where(is_bare, plain, np.uint64(0)), dtype=np.uint64)])
        gap = np.zeros(len(real), np.uint64)
        gap[1:] = bare[real[1:]] - bare[real[:-1] + 1]
        return np.where(self.second, np.uint64(1), plain[real][at]), np.where(self.second, np.uint64(0), gap[at])

    def slots(self, p: int, width: int, view: int = 0) -> list[str | None]:
        slot = self.views[view][1]
        return [None if not k else " nup"[k] + ":" + parts_of(self.raws[w])[int(s)][1] for k, w, s in zip(slot[p : p + width].tolist(), self.word[p : p + width].tolist(), self.second[p : p + width].tolist(), strict=True)]

    def words_of(self) -> np.ndarray:
        """Words from each text's first token to its last."""
        out = np.zeros(len(self.sizes), np.int64)
        some = self.sizes > 0
        place = self.raw[3][self.raw[4]]
        out[some] = place[self.starts[some] + self.sizes[some] - 1] - place[self.starts[some]] + 1
        return out

    def windows(self, width: int, view: int = 0, verbatim: bool = False) -> np.ndarray:
        """Hash of the window at each token; 0 where it leaves its text or, unless ``verbatim``, fewer than half of
        its tokens are words."""
        n = len(self.hashes) - width + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        hashes, slot = self.views[view]
        if verbatim:
            hashes, gap = self.verbatim
        out = np.full(n, -width if verbatim else width, np.int64).astype(np.uint64)
        for j in range(width):
            out = out * np.uint64(_P) + hashes[j : j + n]
            if verbatim and j:
                out += gap[j : j + n]
            out ^= out >> np.uint64(29)
        wrong = self.doc[:n] != self.doc[width - 1 :]
        if not verbatim:
            total = np.concatenate([[0], np.cumsum(slot > 0)])
            wrong |= (total[width:] - total[:-width]) * 2 > width
        out[wrong] = 0
        return out

    def of_items(self) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(width, negative of verbatim windows; view; hashes; which count) of texts that each have one width."""
        own, long_enough = np.minimum(self.sizes, WIDTH), self.words_of() >= LEAST_WORDS
        for width in range(1, WIDTH + 1):
            plain = self.windows(width, verbatim=True)
            doc = self.doc[: len(plain)]
            mine = (own[doc] == width) & (plain != 0)
            if width < SHORTEST:
                yield -width, 0, plain, mine & long_enough[doc]
                continue
            found = self.windows(width)
            yield width, 0, found, mine & (found != 0)
            yield -width, 0, plain, mine & ((found == 0) | (self.sizes[doc] <= WIDTH))

    def of_documents(self, widths: list[int]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        for width in widths:
            first = self.windows(abs(width), verbatim=width < 0)
            yield width, 0, first, first != 0
            if width > 0 and len(self.views) > 1:
                found = self.windows(width, 1)
                yield width, 1, found, (found != 0) & (found != first)


ROWS = "{key} {kind}, row long, width int, hash long, pos int, size int, slots array<string>"


def _emit(key: str, widths: list[int] | None, bitmap: np.ndarray | None):
    """Rows of the windows; without ``widths`` each text has windows of its own width. Verbatim ones have it negative."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words = _Words()
        row = TaskContext.get().partitionId() << 33
        names = [key, "row", "width", "hash", "pos", "size", "slots"]
        for whole in batches:
            for at in range(0, whole.num_rows, 100):
                batch = whole.slice(at, 100)
                if len(words) > KEEP_WORDS:
                    words = _Words()
                t = Templates(batch.column(1).to_pylist(), words)
                cols = [[], [], [], [], [], []]
                take = []
                for width, view, found, ok in t.of_items() if widths is None else t.of_documents(widths):
                    if bitmap is not None:
                        spot = (found >> np.uint64(64 - BITS)).astype(np.int64)
                        ok = ok & (bitmap[spot >> 3] >> (spot & 7) & 1).astype(bool)
                    for p in np.flatnonzero(ok).tolist():
                        k = int(t.doc[p])
                        take.append(k)
                        for c, v in zip(cols, (row + k, width, int(found[p].astype(np.int64)), p - int(t.starts[k]), int(t.sizes[k]) - abs(width) + 1, t.slots(p, abs(width), view)), strict=True):
                            c.append(v)
                row += batch.num_rows
                if take:
                    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.string())]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(take)), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names)

    return run


def template_windows(rows: DataFrame, key: str, text: str, widths: list[int] | None = None, bitmap: np.ndarray | None = None) -> DataFrame:
    """Template windows of each text: of ``width`` (or all of a shorter text), or of the given widths."""
    kind = rows.schema[key].dataType.simpleString()
    return map_arrow(rows.select(key, F.col(text).cast("string").alias("_text")), _emit(key, widths, bitmap), ROWS.format(key=key, kind=kind))


def passages(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """``key, row, item, n_windows, share, identical``: the passages that documents share with items."""
    spark = docs.sparkSession
    items = template_windows(benchmark, item, item_text).select(F.col(item).alias("_item"), F.col("row").alias("item_row"), "width", "hash", F.col("pos").alias("item_pos"), F.col("size").alias("item_size"), F.col("slots").alias("item_slots"))
    items = items.persist()
    try:
        many = items.count()
        widths = sorted(r[0] for r in items.select("width").distinct().collect())
        spots = items.select(F.shiftrightunsigned("hash", 64 - BITS).cast("int").alias("s")).distinct().toPandas()["s"].to_numpy(np.int64)
    finally:
        items.unpersist()
    bitmap = np.zeros(1 << (BITS - 3), np.uint8)
    np.bitwise_or.at(bitmap, spots >> 3, (1 << (spots & 7)).astype(np.uint8))
    found = template_windows(docs, key, text, widths or [WIDTH], bitmap)
    small = F.broadcast(items) if many <= BROADCAST_ROWS else items
    hits = found.join(small, ["width", "hash"]).withColumn("at", F.col("pos") - F.col("item_pos"))
    hits = hits.withColumn("pairs", F.filter(F.arrays_zip(F.col("item_slots").alias("i"), F.col("slots").alias("d")), lambda x: x["i"].isNotNull() | x["d"].isNotNull()))
    bound = F.array_distinct(F.filter("pairs", lambda x: ~F.coalesce(x["i"].startswith("n:"), F.lit(False))))
    verbatim = F.col("width") < 0
    agree = verbatim | (F.size(bound) == F.size(F.array_distinct(F.transform(bound, lambda x: x["i"]))))
    by = hits.groupBy("row", "item_row", "at").agg(
        F.first(key, ignorenulls=True).alias(key),
        F.first("_item", ignorenulls=True).alias(item),
        F.max("item_size").alias("item_size"),
        F.count_distinct(F.when(agree, F.col("item_pos"))).alias("n_windows"),
        F.min(verbatim | F.forall("pairs", lambda x: x["i"].eqNullSafe(x["d"]))).alias("identical"),
    )
    # first() of a column that is the same for all rows of the group: a row's key, an item's id
    whole = by.filter("n_windows > 0").groupBy("row", "item_row").agg(
        F.first(key, ignorenulls=True).alias(key), F.first(item, ignorenulls=True).alias(item), F.max("item_size").alias("item_size"), F.sum("n_windows").alias("n_windows"), F.min("identical").alias("identical")
    )
    whole = whole.withColumn("share", F.least(F.lit(1.0), F.col("n_windows") / F.col("item_size")))
    return whole.filter((F.col("n_windows") >= LEAST_RUN) | (F.col("share") >= LEAST_SHARE)).select(key, "row", item, "n_windows", "share", "identical")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text shares no passage with the benchmark.

    Texts, not keys, are what is dropped, so null and repeated keys do no harm. Columns of any name are kept as they are.
    """
    digest = F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")), 256).alias("digest")
    bad = store(passages(docs.select(digest, F.col(text).alias("t")), benchmark, key="digest", text="t").select("digest").distinct(), "contaminated")
    marked = docs.select(digest, F.struct(*docs.columns).alias("doc"))
    if bad.count() <= BROADCAST_ROWS:
        return marked.join(F.broadcast(bad), "digest", "left_anti").select("doc.*")
    counted = bad.join(marked.groupBy("digest").agg(F.count(F.lit(1)).alias("n")), "digest")
    return join_hot(marked, counted, "digest", "n").filter("n is null").select("doc.*")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and item that share a passage."""
    return passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "item_id", "n_windows", F.round("share", 6).alias("share"), "identical")
