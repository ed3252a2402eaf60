"""A training corpus from raw documents: quality bands, toxicity, fuzzy lines, near-duplicate documents, packed sequences.

Each stage takes what the one before kept, with the columns of documents; the last one returns packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm import bayes_jaccard, common, kneser_ney, line_dedup, slack_packing, toxicity_cnn


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the rows whose doc_id and text are among gone (id, version: the text's hash); null ids are equal here."""
    key, version = common.fresh(docs, 2)
    gone = gone.select(F.col("doc_id").alias(key), F.col("version").alias(version)).distinct()
    same = docs["doc_id"].cast("long").eqNullSafe(gone[key]) & (F.xxhash64(docs["text"]) == gone[version])
    return docs.join(gone, same, "left_anti")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects what fails the base rules or lies outside its language's perplexity band.

    Null and empty texts fail the base rules; null languages are a language. Rows that repeat id and text go or stay together
    (of different languages, all go if one does); null ids are judged like others; extra columns pass through.
    """
    common.bounded_batches(spark)
    return _without(docs, kneser_ney.quality(docs).where(~F.col("kept")))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that score at or above their language's threshold.

    Each row is judged by itself, whatever its id, and comes out once; a null language has the common threshold, a null text
    the score of a text without words. Extra columns pass through.
    """
    common.bounded_batches(spark)
    net = toxicity_cnn.fit(docs, common.table(spark, sf_dir, "labels"))
    (score,) = common.fresh(docs, 1)
    toxic = F.col(score) >= toxicity_cnn.thresholds(net, F.col("lang"))
    return toxicity_cnn.with_score(docs, net, name=score).where(~toxic).drop(score)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out fuzzy repeats of lines; all documents stay, n_chars is that of the new text where lines are gone.

    Nulls, ties, repeated rows and extra columns as in line_dedup.dedup_lines.
    """
    (count,) = common.fresh(docs, 1)
    out = line_dedup.without_repeats(docs, "doc_id", "text", count)
    size = F.length("text").cast(docs.schema["n_chars"].dataType)
    return out.withColumn("n_chars", F.when(F.col(count) > 0, size).otherwise(F.col("n_chars"))).drop(count)


def duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates, that with the smallest doc_id.

    Texts without words stay. Nulls, ties and repeated rows as in bayes_jaccard.jaccard_join; extra columns pass through.
    """
    common.bounded_batches(spark)
    return _without(docs, bayes_jaccard.jaccard_join(docs).where(~F.col("kept")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents that are left into sequences of at most 2048 tokens; cases as in slack_packing.pack_documents."""
    import public_tokenizers

    common.bounded_batches(spark)
    return slack_packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", quality), ("toxicity", toxicity), ("lines", lines), ("duplicates", duplicates), ("packing", packing)]

#: Neither models nor tokenizers can be put in SQL; tests hold stages against plain versions on rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written and read again."""
    staged = common.Staged(spark, "pipeline")
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs, before = staged.write(stage(spark, docs, sf_dir), name), docs
        staged.drop(before)
    return staged.keep(docs)
