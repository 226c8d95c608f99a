"""A training-data pipeline over `documents`: each stage works on all that the stage before it kept.

In every stage, documents may have nulls in any column, empty or very long texts, repeated rows, and columns beside
doc_id, text, lang and n_chars whose names clash with the stages' own; an empty table gives an empty table. All
stages but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from planeframe.llm import bpe, decontam, langid, line_dedup, minhash
from planeframe.llm.common import drop_written, flat, materialize, maybe_broadcast, narrow, place, written
from planeframe.llm.queries import table, tokenizer


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; the classifier learns from the labelled rows of docs itself.

    Null and empty texts and those without a letter go, and texts whose score is below the model's threshold. Ties
    of languages go to the one that sorts first; equal texts share their fate. Without labelled rows nothing is
    recognised and all documents go."""
    return langid.keep_known(docs, langid.fit(docs))


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the blocks of lines that an earlier document (smaller doc_id) holds. A document of which nothing
    is left (it lost lines, and the rest is blank) is a copy through and through and goes; n_chars follows the text.

    Null and empty texts and rows with a null doc_id stay as they are; repeated rows lose the same lines; of several
    texts of one doc_id the one with the smaller hash counts as earlier."""
    n = len(docs.columns)
    done = flat(line_dedup.dedup_lines(docs))  # then come the lines, how many went, and which
    text, chars = f"c{place(docs, 'text')}", f"c{place(docs, 'n_chars')}"
    left = done.filter(f"c{n + 1} = 0 OR trim({text}) <> ''")
    columns = [f"IF(c{n + 1} = 0, {c}, CAST(length({text}) AS BIGINT)) AS {c}" if c == chars else c for c in done.columns[:n]]
    return left.selectExpr(*columns).toDF(*docs.columns)


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8): the smallest doc_id.

    Of rows that repeat the kept doc_id, whatever their texts, the one with the smallest text hash stays (rows that
    are equal in both are the same document). Null, blank and empty texts and rows with a null doc_id belong to no
    group and stay."""
    ids = materialize(minhash.near_duplicates(docs).filter("doc_id IS NOT NULL AND n_shingles > 0").groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count("*").alias("n")), "ids")
    gone, several = ids.filter("NOT kept").select("doc_id"), ids.filter("kept AND n > 1").select("doc_id")
    d, t = F.col(f"c{place(docs, 'doc_id')}").cast("bigint"), F.col(f"c{place(docs, 'text')}")
    worded = t.rlike(r"[^\x20\x09-\x0D]")
    left = flat(docs).join(maybe_broadcast(gone), (d == F.col("doc_id")) & worded, "left_anti")
    if not several.isEmpty():
        names = left.columns
        side = maybe_broadcast(several)
        once = left.join(side, (d == F.col("doc_id")) & worded)
        once = once.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64(t)))).filter("place = 1").select(*names)
        left = left.join(side, (d == F.col("doc_id")) & worded, "left_anti").unionByName(once)
    return left.toDF(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with no benchmark item; null and blank texts overlap with nothing and stay, and rows are
    told apart by doc_id (null or not) and text."""
    return decontam.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and ids (the tokens) of each document, one row for each row.

    Null texts count as empty and have no tokens; null ids stay null."""
    return bpe.encode(narrow(docs, "doc_id", "text"), tokenizer("word_bpe_49k.json"), keep_ids=True).drop("decoded")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", language_id),
    ("line dedup", line_deduplication),
    ("near-dedup", near_deduplication),
    ("decontamination", decontamination),
    ("BPE", bpe_encoding),
]

#: The stages train a classifier, align texts and run a tokenizer, which SQL can't express; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again; what a stage wrote on the way is removed then."""
    docs, before = table(spark, sf_dir, "documents"), written()
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, f"stage{i}")
            drop_written(before, written() - 1)  # all but this stage's rows
            before = written() - 1
    return docs
