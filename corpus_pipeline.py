"""From documents to token ids: quality, near duplicates, repeated passages, benchmark passages, tokens.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept. All but the
last return the columns of documents. Text that a stage changes is its kept words joined by one space,
with n_chars counted anew; other rows pass unchanged, and only the quality, near-duplicate and
decontamination stages drop rows.

Cases: rows of one doc_id are one document, in parts. They stay or go together in the near-duplicate stage (as the part with the smallest
component does), never cut each other in the repeated-passage stage, and are judged one by one in the others. A document without an id can't
be ordered or named by it: it passes the near-duplicate and repeated-passage stages unchanged, and is no earlier copy of others there; the
other stages judge it by its text. Null and empty texts have no shingles, windows or tokens, and a quality score like any other. Very long texts are
read whole. Of ties the smallest id stays. Empty tables give empty results; other columns pass, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm import decontaminate, ngram_join, quality, substring_dedup, word_bpe
from strandlake.llm.shared import discard, materialize, table


def keep_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ranking accepts; it learns from the labelled ones among them."""
    return quality.keep_good(docs, quality.learn(docs, table(spark, sf_dir, "labels")))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, the document of smallest id; documents without an id pass."""
    first = ngram_join.jaccard_components(docs).where("doc_id is not null").groupBy("doc_id").agg(F.min("component_id").alias("least")).where("least < doc_id")
    return docs.join(first.select("doc_id"), "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that begin in earlier ones."""
    out = substring_dedup.remove_repeats(docs, outputs="rows")
    size = F.length("kept").cast(docs.schema["n_chars"].dataType)
    new = {"text": F.col("kept"), "n_chars": size}
    whole = F.col("n_removed") == 0
    return out.select(*[F.when(whole, F.col("row")[c]).otherwise(new[c]).alias(c) if c in new else F.col("row")[c].alias(c) for c in docs.columns])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth lies in benchmark windows."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded texts."""
    return word_bpe.encode_decode(docs)


STAGES = [
    ("quality", keep_good_quality),
    ("near_duplicates", keep_one_of_each_group),
    ("substring_dedup", remove_repeated_passages),
    ("decontamination", drop_contaminated),
    ("encoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs, done = materialize(stage(spark, docs, sf_dir), name), before
        if done is not None:
            discard(spark, done)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)


#: A fitted classifier is among the stages; tests hold the others against brute force.
ORACLE_SQL: str | None = None
