"""From raw documents to token ids: STAGES, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from kgloom.llm import bpe, line_dedup, mixing, quality, simhash
from kgloom.llm.scratch import Scratch

#: What each stage but the last returns: the columns of documents. Others that its input has go.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels of these documents, does not reject.

    Null and empty texts are scored as empty ones, long texts whole; null keys are scored but never
    learned from; rows that repeat key and text share a fate, also at the threshold (0.7 stays). An
    empty table stays empty. Columns besides COLUMNS go, whatever their names.
    """
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    return quality.drop_rejected(docs.select(COLUMNS), labels)


def unique_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the first of each group of near-equal lines; n_chars follows the text.

    Documents that keep none of their lines go; null and blank texts stay (n_chars null or as it
    was long). Null and repeated keys as in drop_lines(). An empty table stays empty. Columns besides
    COLUMNS go, whatever their names.
    """
    kept = line_dedup.drop_lines(docs.select(COLUMNS))
    return kept.withColumn("n_chars", F.length("text").cast("long"))


def unique_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one of the smallest doc_id.

    Null and empty texts are one group; rows that repeat key and text are one document; null keys
    as in drop_near_duplicates(). An empty table stays empty. Columns besides COLUMNS go.
    """
    return simhash.drop_near_duplicates(docs.select(COLUMNS))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, up to twice.

    A null source is a source; null and empty texts have no words, so their targets need none; ties
    in the seeded order go by key. An empty table stays empty. Columns besides COLUMNS go.
    """
    return mixing.mix_rows(docs.select(COLUMNS))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids, round_trip): ids of each whole text, decoded to prove them.

    Null and empty texts have no ids and are proven; repeated rows stay; an empty table stays empty.
    """
    import public_tokenizers

    coded = bpe.encode_proven(docs.select(COLUMNS), public_tokenizers.path("byte_bpe_50k.json"))
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "round_trip")


STAGES = [
    ("quality classifier", good_quality),
    ("line dedup", unique_lines),
    ("simhash near-dedup", unique_documents),
    ("mixing sources", mixed_sources),
    ("byte-level bpe", token_ids),
]

#: Not to be said in SQL: the first stage learns a model, the second and third find components.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
