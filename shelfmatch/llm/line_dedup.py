"""Fuzzy line dedup by MinHash, in DataFrame operations only.

Lines are compared by their sets of character shingles of length ``SHINGLE``. A signature has
BANDS x ROWS minima over all shingles, whatever the line's length: shingle hashes under exclusive-or with fixed
masks, of which each orders the hashes anew. Lines that share a band are candidates (a pair at similarity 0.8
with probability 0.993), the exact Jaccard similarity of their full shingle sets decides, and a distributed
union-find joins links to components. Of each component the first line (by document key, then place) stays, in its document.

Rows of files are numbered by their file and place in it, and read from there again; any other rows are numbered once, in a stored
copy, and everything after reads that copy. So a row's number means the same row wherever the input came from. Equal lines are one node, so copies cost a row each and no pairs. A node is a line's 64-bit hash; where two
different lines share it (a second hash tells), these lines are compared whole, by their text, and not by similarity.

Every line that isn't blank takes part. Lines of fewer than ``SHINGLE`` characters have no shingle and are compared whole.
Defined results: a null text stays null and has no lines; an empty text stays as it is; equal keys are told
apart by the row's place in the table; repeated rows lose their lines to the first; empty tables give
no rows; a column ``n_lines`` or ``dropped`` of the input is replaced, all other columns are kept as they are.
"""

from __future__ import annotations

from contextlib import ExitStack
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmatch.llm._common import bucketed, drop, few, join_hot, numbered, release, store, table
from shelfmatch.llm.components import WIDE, link_buckets, meet, pivots

SHINGLE = 8
BANDS, ROWS = 7, 3
SIMILARITY = 0.8
BLOCK = 1 << 14
PASSES, SMALL = 8, 50_000  # over the members of large buckets that hold several components, if they are more than SMALL; pivots are looked for if their pairs are
WORD_BITS = 4  # a line is marked in 2^4 words of 64 bits
WORDS = [f"w{k}" for k in range(1 << WORD_BITS)]
LANES = 4  # shingles to a row while signatures are made


def _masks() -> list[int]:
    """Fixed masks from a multiplicative generator, as signed 64-bit integers."""
    out, x = [], 0x2545F4914F6CDD1D
    for _ in range(BANDS * ROWS):
        x = (x * 6364136223846793005 + 1442695040888963407) % (1 << 64)
        out.append(x - (1 << 64) if x >= 1 << 63 else x)
    return out


def _identity(line: Column) -> Column:
    return F.xxhash64(line)


def occurrences(rows: DataFrame, key: str, text: str, rid: str) -> DataFrame:
    """``h, at(key, rid, pos), line`` of each line that isn't blank."""
    each = rows.select(F.col(key).alias("k"), F.col(rid).alias("rid"), F.posexplode(F.split(F.col(text).cast("string"), "\n", -1)).alias("pos", "line"))
    return each.filter(F.col("line").rlike(r"\S")).select(_identity(F.col("line")).alias("h"), F.struct("k", "rid", "pos").alias("at"), "line")


def _blocks(rows: DataFrame) -> DataFrame:
    """Cut ``line`` into overlapping blocks that hold ``BLOCK`` shingles each at most, four bytes a character."""
    n = F.length("line") - (SHINGLE - 1)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")))
    rows = rows.select("h", "line", F.explode(starts).alias("b"))
    return rows.select("h", F.encode(F.substring(F.col("line"), F.col("b") * BLOCK + 1, F.lit(BLOCK + SHINGLE - 1)), "UTF-32").alias("part"))


def _hashes(lines: DataFrame) -> DataFrame:
    """``h, line`` -> ``h, s0 ...``: hashes of the shingles of lines that have one.

    Shingles are cut from characters of a fixed width, as a place in UTF-8 is only found by counting from the start.
    ``LANES`` neighbouring shingles make a row, as rows cost more than shingles; behind the last one it is taken again."""
    rows = _blocks(lines.filter(F.length("line") >= SHINGLE).select("h", "line")).withColumn("last", F.length("part") - (4 * SHINGLE - 1))
    rows = rows.select("h", "part", "last", F.explode(F.sequence(F.lit(1), F.col("last"), F.lit(4 * LANES))).alias("p"))
    shingle = lambda i: F.substring(F.col("part"), F.least(F.col("p") + 4 * i, F.col("last")), F.lit(4 * SHINGLE))
    return rows.select("h", *[F.xxhash64(shingle(i)).alias(f"s{i}") for i in range(LANES)])


def signatures(lines: DataFrame) -> DataFrame:
    """Distinct ``h, line``, clustered by ``h``, of lines that have a shingle -> ``node, bands array<long>``; no shuffle of its own."""
    rows = _hashes(lines)
    least = lambda m: F.min(F.least(*[F.col(f"s{i}").bitwiseXOR(F.lit(m)) for i in range(LANES)]))
    sig = rows.groupBy("h").agg(*[least(m).alias(f"m{i}") for i, m in enumerate(_masks())])
    bands = [F.xxhash64(F.lit(b), *[f"m{b * ROWS + r}" for r in range(ROWS)]) for b in range(BANDS)]
    return sig.select(F.col("h").alias("node"), F.array(*bands).alias("bands"))


def shingle_set(line: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(line, F.lit(f"(?s)(?=(.{{{SHINGLE}}}))"), F.lit(1)))


def _similar(a: Column, b: Column) -> Column:
    """Exact Jaccard test. What is used twice is bound to a lambda's variable, so that each set is made once."""
    sets = F.array(F.struct(shingle_set(a).alias("x"), shingle_set(b).alias("y")))
    sizes = F.transform(sets, lambda s: F.struct(F.size(F.array_intersect(s["x"], s["y"])).alias("both"), (F.size(s["x"]) + F.size(s["y"])).alias("all")))
    return F.exists(sizes, lambda n: n["both"] >= SIMILARITY * (n["all"] - n["both"]))


def _marked(lines: DataFrame) -> DataFrame:
    """``h, line``, clustered by ``h``, -> ``node, line, marks, w0 ...``: the number of shingles, repeats included, and a
    bit for each shingle's hash; no shuffle of its own."""
    s = [F.col(f"s{i}") for i in range(LANES)]
    bit = lambda x, k: F.when(F.shiftrightunsigned(x, 64 - WORD_BITS) == k, F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(F.lit(63)).cast("int"))).otherwise(F.lit(0).cast("long"))
    words = [F.bit_or(reduce(Column.bitwiseOR, [bit(x, k) for x in s])).alias(f"w{k}") for k in range(1 << WORD_BITS)]
    marks = _hashes(lines).groupBy("h").agg(*words)
    return lines.join(marks.hint("shuffle_hash"), "h").select(F.col("h").alias("node"), "line", (F.length("line") - (SHINGLE - 1)).alias("marks"), *WORDS)


def _may_be_similar(x, y) -> Column:
    """False only where the sets of shingles can't be similar: each bit that differs stands for a shingle or more
    that only one of the lines has, and similar sets have a share of such shingles at most."""
    differ = reduce(Column.__add__, [F.bit_count(x(w).bitwiseXOR(y(w))) for w in WORDS])
    return (1 + SIMILARITY) * differ <= (1 - SIMILARITY) * (x("marks") + y("marks")) + 1e-6


def _nearly_similar(x, y) -> Column:
    """The same for members of large buckets, closer: by how many of the shingles' 32-bit hashes agree, less what collisions
    of these may take away. A pair that shares several keys is met under the least."""
    n, m = F.size(x("hashes")), F.size(y("hashes"))
    both = F.size(F.array_intersect(x("hashes"), y("hashes")))
    slack = 8 + (n + m).cast("double") * (n + m) / (1 << 31)
    once = F.array_min(F.array_intersect(x("keys"), y("keys"))) == x("key")
    return once & (F.least(n, m) >= SIMILARITY * F.greatest(n, m)) & ((1 + SIMILARITY) * (both + slack) >= SIMILARITY * (n + m))


def link_lines(lines: DataFrame) -> DataFrame:
    """``node, root`` of all lines ``h, line`` (stored in buckets by ``h``, which is unique) that are similar to another.

    Signatures and the lines that candidates need come from the buckets without a shuffle of text. Only lines that share
    a bucket with another are read again, once, and marked: most pairs that fail the test fail by their marks. The marked
    lines are kept in buckets too, so only pairs, and the text or marks of a pair's first line, are shuffled."""
    sig, made, tested, held = store(few(signatures(lines)), "signatures"), [], [], ExitStack()
    members = sig.select("node", F.explode("bands").alias("key"))

    def prepare(tried: DataFrame) -> None:
        nodes = tried.select(F.col("first").alias("h")).unionAll(tried.select("node")).distinct()
        marked = _marked(lines.join(nodes.hint("shuffle_hash"), "h", "left_semi").select("h", "line"))
        made.append(held.enter_context(bucketed(marked, "node", "marked")))

    def exact(pairs: DataFrame) -> DataFrame:
        have = made[0].select("node", "line")
        out = store(pairs.join(have.toDF("a", "la"), "a").join(have.toDF("b", "lb"), "b").filter(_similar(F.col("la"), F.col("lb"))).select("a", "b"), "similar")
        tested.append(out)
        return out

    def similar(pairs: DataFrame) -> DataFrame:
        marks = made[0].drop("line")
        both = pairs.join(marks.select(F.col("node").alias("a"), F.struct("*").alias("x")), "a").join(marks.select(F.col("node").alias("b"), F.struct("*").alias("y")), "b")
        some = store(both.filter(_may_be_similar(lambda c: F.col(f"x.{c}"), lambda c: F.col(f"y.{c}"))).select("a", "b"), "some")
        out = exact(some)
        drop(some)
        return out

    def among(several: DataFrame) -> DataFrame:
        links, rest = pivots(several, similar, SMALL)
        marks = made[0].drop("line")
        narrow = store(rest.filter(F.col("n") <= WIDE).join(marks, "node"), "marks")
        found = [store(few(meet(narrow, _may_be_similar)).distinct(), "pairs")]
        drop(narrow)
        wide = rest.filter(F.col("n") > WIDE)
        passes = PASSES if (rows := wide.count()) > SMALL else min(rows, 1)
        if passes:
            keys = wide.groupBy("node").agg(F.collect_set("key").alias("keys"))  # a key a band at most
            sets = store(keys.join(made[0], "node").withColumn("hashes", F.transform(shingle_set(F.col("line")), lambda s: F.hash(s))).drop("line"), "sets")
            for k in range(passes):  # a share of the keys at a time, as a node's set goes to each of its keys
                mine = wide if passes == 1 else wide.filter(F.pmod(F.xxhash64("key"), F.lit(passes)) == k)
                with_sets = store(mine.join(sets, "node"), "sets")
                found.append(store(few(meet(with_sets, lambda x, y: _may_be_similar(x, y) & _nearly_similar(x, y))), "pairs"))
                drop(with_sets)
                release(several.sparkSession, 0.2)
            drop(sets)
        if rest is not several:
            drop(rest)
        out = exact(reduce(DataFrame.unionAll, found))
        drop(*found)
        return reduce(DataFrame.unionAll, [*links, out])

    with held:
        labels = link_buckets(members, sig.count() * BANDS, similar, among, prepare)
    drop(sig, *tested)
    return labels


def repeated_lines(rows: DataFrame, key: str, text: str, rid: str) -> DataFrame:
    """Stored ``rid, drops array<int>``: places of the lines to remove, of each row that has any. ``rows`` are
    ``numbered`` in ``rid``."""
    spark = rows.sparkSession
    occ = occurrences(rows, key, text, rid)
    other = F.xxhash64(F.lit(SHINGLE), "line")
    distinct = occ.groupBy("h").agg(F.first("line").alias("line"), F.min("at").alias("at"), F.count(F.lit(1)).alias("n"), (F.min(other) != F.max(other)).alias("shared"))
    with bucketed(distinct, "h", "distinct") as lines:
        release(spark, 0.5)
        own = lines.filter(~F.col("shared"))
        labels = link_lines(own.select("h", "line"))
        rooted = own.select("h", "at", "n").join(labels.withColumnRenamed("node", "h"), "h", "left")
        rooted = store(few(rooted.filter("root is not null or n > 1")), "rooted")
        shared = store(few(lines.filter("shared").select("h")), "shared")
    drop(labels)
    alone = rooted.filter("root is null").select("h", F.col("at").alias("keep"), "n")
    joined = rooted.filter("root is not null")
    firsts = joined.groupBy("root").agg(F.min("at").alias("keep"), F.count(F.lit(1)).alias("members"))
    act = store(alone.unionByName(join_hot(joined, firsts, "root", "members").select("h", "keep", "n")), "act")
    drop(rooted)
    release(spark)
    places = store(occ.select("h", "at"), "lines")
    gone = join_hot(places, act.hint("shuffle_hash"), "h", "n").filter("keep is not null and not (at <=> keep)").select("at")
    if not shared.isEmpty():
        again = occ.join(shared, "h").select("line", "at")
        gone = gone.unionByName(again.join(again.groupBy("line").agg(F.min("at").alias("keep")), "line").filter("not (at <=> keep)").select("at"))
    drops = store(gone.groupBy(F.col("at.rid").alias("rid")).agg(F.collect_list("at.pos").alias("drops")), "drops")  # a place comes once
    drop(places, act, shared)
    release(spark, 0.5)
    return drops


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the repeated lines taken out of ``text``, and ``n_lines``, ``dropped`` (the
    places, from 0, of the lines that were taken out, in order)."""
    names = [c for c in docs.columns if c not in ("n_lines", "dropped")]
    rid = "rid"
    while rid in names:
        rid = "_" + rid
    rows = numbered(docs.select(*names), rid)
    drops = repeated_lines(rows, key, text, rid)
    lines = F.split(F.col(text).cast("string"), "\n", -1)
    gone = F.col("d.drops")
    kept = F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone), lambda i: F.get(lines, i)), "\n")
    return rows.join(drops.select(F.col("rid").alias(rid), F.struct("drops").alias("d")), rid, "left").select(
        *[(F.when(gone.isNull(), F.col(c)).otherwise(kept).alias(c) if c == text else F.col(c)) for c in names],
        F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.sort_array(gone), F.array().cast("array<int>")).alias("dropped"),
    )


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
