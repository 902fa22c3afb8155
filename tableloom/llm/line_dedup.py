"""Lines that several documents share stay in one of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableloom.llm.words import LOWER, UPPER, WHITE
from tableloom.session import materialise


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _keyed_lines(docs: DataFrame, min_length: int) -> DataFrame:
    """One row per line whose key is long enough: document, place and the key's 128-bit hash."""
    lines = docs.select("doc_id", "_copy", F.posexplode(_lines(F.col("text"))).alias("_pos", "_line"))
    bare = F.btrim("_line", F.lit(WHITE))
    key = F.translate(bare, UPPER, LOWER)
    return lines.filter(F.char_length(bare) >= min_length).select(
        "doc_id", "_copy", "_pos", F.xxhash64(key).alias("_h1"), F.xxhash64(F.lit(1), key).alias("_h2")
    )


def dedup_lines(
    docs: DataFrame, min_docs: int = 2, min_length: int = 10, doc_id: str = "doc_id", text: str = "text", keep: Sequence[str] = ()
) -> DataFrame:
    """``doc_id, text, n_lines, n_dropped`` and the columns of ``keep``; ``text`` holds the lines that stay.

    A line's key is the line without white space at its ends and with A-Z lower-cased. Keys of at least
    ``min_length`` code points that at least ``min_docs`` documents hold lose their lines in all documents but the
    one with the smallest id; lines repeated within that document stay. NULL and empty texts are one empty line.
    Documents without an id keep all their lines and count for no key. Rows that repeat an id are one document when
    documents are counted, and each keeps its own row. Other columns are ignored.

    Plan: explode, hash, aggregate to the smallest id per key (combined before the shuffle, so a line in a third of
    all documents is one row per task), join the lines of other documents to the repeated keys, and cut the lines
    by their places. The join's shuffles stand alone, so a hot key is split at run time; texts shuffle once.
    """
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), *keep)
    docs = docs.withColumn("_copy", F.xxhash64("text"))
    keyed = _keyed_lines(docs.filter(F.col("doc_id").isNotNull()), min_length)
    # The smallest id of a key differs from its largest exactly if two documents hold it.
    counted = keyed if min_docs == 2 else keyed.select("_h1", "_h2", "doc_id").distinct()
    firsts = counted.groupBy("_h1", "_h2").agg(
        F.min("doc_id").alias("_first"), F.max("doc_id").alias("_last"), F.count(F.lit(1)).alias("_n")
    )
    repeated = firsts.filter((F.col("_first") < F.col("_last")) & (F.col("_n") >= min_docs))
    repeated = materialise(repeated.select("_h1", "_h2", "_first"), "repeated-lines")
    dropped = (
        keyed.join(repeated, ["_h1", "_h2"])
        .filter(F.col("doc_id") != F.col("_first"))
        .groupBy("doc_id", "_copy")
        .agg(F.collect_set("_pos").alias("_drop"))
    )
    # The lines cross the join as an array, so the lambda below reads them and never splits again.
    split = docs.select("doc_id", "_copy", *keep, _lines(F.col("text")).alias("_lines"))
    joined = split.join(dropped, ["doc_id", "_copy"], "left")
    places = F.sequence(F.lit(0), F.size("_lines") - 1)
    stay = F.when(F.col("_drop").isNull(), F.col("_lines")).otherwise(
        F.transform(F.array_except(places, "_drop"), lambda i: F.get("_lines", i))
    )
    return joined.select(
        "doc_id",
        *keep,
        F.array_join(stay, "\n").alias("text"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("_drop"), F.lit(0)).cast("long").alias("n_dropped"),
    )
