"""From raw documents to token ids: five stages, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tableloom.llm import lang_id, line_dedup, mixing, near_dup, sentence_piece
from tableloom.llm.words import PART_ROWS
from tableloom.session import materialise

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"


def bound_batches(spark: SparkSession) -> None:
    """What lies between the JVM and Python holds as many documents as a task handles at a time, not ten times as many."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(PART_ROWS))


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or too far from every language learned from the labelled ones, go.

    NULL and empty texts have no letter; rows that repeat an id or a text are judged alike.
    """
    bound_batches(spark)
    model = lang_id.fit(docs)
    return lang_id.classify(docs, model, keep=COLUMNS).filter(~F.col("rejected")).select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that several documents share stay in the one with the smallest id; every document stays, if only empty."""
    kept = line_dedup.dedup_lines(docs, keep=("lang", "source"))
    return kept.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, from a similarity of 0.8, the document with the smallest id stays.

    Rows that share an id are judged each by its own text; of rows with one id and text a single one stays. Rows without
    an id, texts that are NULL or without words belong to no group and stay, the latter once per id.
    """
    bound_batches(spark)
    judged = near_dup.near_duplicates(docs, percent=80, with_copy=True).filter("kept").groupBy("doc_id", "copy")
    judged = judged.agg((F.count(F.lit(1)) > 1).alias("_repeated")).withColumnsRenamed({"doc_id": "_id", "copy": "_copy"})
    judged = materialise(judged, "judged")
    repeated = F.col("_repeated") & F.col("_id").isNotNull()
    copied = docs.select(*COLUMNS, F.xxhash64("text").alias("_text"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_copy"))
    single = copied.join(judged.filter(~repeated), same, "left_semi")
    alike = Window.partitionBy("doc_id", "_text").orderBy("lang", "source", "n_chars")
    several = copied.join(judged.filter(repeated), same, "left_semi").withColumn("_rank", F.row_number().over(alike))
    return single.select(*COLUMNS).unionByName(several.filter("_rank = 1").select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it; the one at a source's budget is cut to the words that are left."""
    return mixing.take_words(docs.select(*COLUMNS), mixing.mix(docs)).select(*COLUMNS)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, lang, source, ids, n_tokens, round_trip``."""
    bound_batches(spark)
    return sentence_piece.encode(docs, sentence_piece.read_model(MODEL_PATH), keep=("doc_id", "lang", "source"))


STAGES = [
    ("language_id", identify_languages),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("mix_sources", mix_sources),
    ("sentence_piece", encode_pieces),
]
ORACLE_SQL = None  # neither the language model nor the encoder can be written in SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
