"""A training corpus from ``documents``: five stages, each one an operator of ``shelfmatch.llm``.

1. language: documents without a language (no letter), or that every language's model finds dearer than
   plain bytes, go.
2. lines: of similar lines the first stays; a document that loses all its text by this goes.
3. near duplicates: one document of each SimHash component stays.
4. benchmark: documents that share a passage with the benchmark go.
5. encoding: ids of the remaining texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmatch.llm import decontamination, language_id, line_dedup, sentencepiece_codec, simhash_dedup
from shelfmatch.llm._common import drop, drop_left, left, store, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
BITS_OF_A_BYTE = 8.0

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_made: list[str] = []  # tables that the latest stage's result reads


def _tidy(stage: Stage) -> Stage:
    """A stage's input is the written result of the one before, so what that one's plan read can go."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop_left(spark, _made)
        there = set(left())
        out = stage(spark, docs, sf_dir)
        _made[:] = [p for p in left() if p not in there]
        return out

    return run_stage


@_tidy
def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null texts go too, as they have no letter. The row's own text is what decides, so keys may repeat."""
    trees = language_id.Trees(language_id.sample(docs.filter(language_id.learned_from()), "doc_id", "text", "lang"))
    return language_id.with_language(docs, trees).filter((F.col("lang_pred") != "und") & (F.col("bits_per_byte") <= BITS_OF_A_BYTE)).select(*docs.columns)


@_tidy
def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document all of whose lines were taken out goes; one that was blank before is not this stage's matter."""
    out = line_dedup.dedup_lines(docs)
    emptied = (F.size("dropped") > 0) & (F.length(F.regexp_replace("text", r"\s+", "")) == 0)
    out = out.filter(~F.coalesce(emptied, F.lit(False)))
    names = [F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns]
    return out.select(*names)


@_tidy
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash_dedup.drop_near_duplicates(docs)


@_tidy
def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


@_tidy
def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode_decode(docs, sentencepiece_codec.model_path(), decoded=False, digests=True)


STAGES = [
    ("language ID", languages),
    ("line dedup", lines),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", benchmark),
    ("SentencePiece encoding", encoding),
]

#: The stages are models, components and an encoder, which SQL can't express; the tests hold ``run``
#: against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage's result is stored; the one before it, and what it was made from, then goes."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name.split()[0])
        if before is not None:
            drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
