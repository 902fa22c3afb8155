"""Mixing sources to target weights: exact word budgets cut from a random order of each source."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tableloom.llm.words import WHITE, word_count
from tableloom.session import materialise

ROWS_PER_RANK_TASK = 100_000
KEY_BITS = 40  # of the random key; buckets are ranges of it


def _random_key(seed: int, doc_id: Column) -> Column:
    """Uniform in 0 .. 2**KEY_BITS - 1."""
    digest = F.md5(F.concat_ws("-", F.lit(str(seed)), doc_id.cast("string")))
    return F.conv(F.substring(digest, 1, KEY_BITS // 4), 16, 10).cast("long")


def source_targets(sources: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """``sources`` (source, source_size, rows) with ``target``: word budgets by weight, none above ``most`` times its size.

    The sources are numbered in code point order, NULL last, and take the weights in turn. They share ``share`` times
    all words; what a source cannot take is shared anew by weight until none is above its limit. Each round is one
    aggregate over the sources whose two sums visit the driver, so their number is not bounded by one task.
    """
    tasks = 1 + sources.count() // ROWS_PER_RANK_TASK
    order = [F.col("source").isNull(), F.col("source")]
    ranged = sources.repartitionByRange(tasks, *order).withColumn("_part", F.spark_partition_id())
    ranged = materialise(ranged, "sources")  # the part numbers are stored: a repeated task cannot renumber
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per part
    parts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    parts = parts.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1 + F.col("_start")
    turn = F.array(*[F.lit(float(w)) for w in weights])
    ranked = ranged.join(parts, "_part").withColumn("_weight", F.get(turn, (place % len(weights)).cast("int")))
    limit = F.col("source_size") * F.lit(float(most))
    level, full_before = 0.0, -1
    total = share * (ranked.agg(F.sum("source_size")).first()[0] or 0)
    while True:
        full = limit <= F.col("_weight") * F.lit(level)
        row = ranked.agg(
            F.coalesce(F.sum(F.when(full, limit)), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~full, F.col("_weight"))), F.lit(0.0)),
            F.count(F.when(full, 1)),
        ).first()
        if row[2] == full_before or not row[1]:
            break
        full_before, level = row[2], (total - row[0]) / row[1]
    target = F.when(full, limit).otherwise(F.col("_weight") * F.lit(level))
    return ranked.select("source", "source_size", "_rows_in", target.alias("target"))


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 11,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """``doc_id, _copy, size, source, source_size, target, taken``: how many words of each document the mix takes.

    A document's size is its number of words. Within a source the documents are ordered by a hash of id and seed; a
    target of ``e`` whole epochs and a rest takes every document ``e`` times and the rest from the start of the order,
    the last document in part, so that a source's words meet its target to less than one word. NULL is a source of
    its own; empty texts have size 0 and give nothing; ties and repeated rows are ordered by id, then by a hash of the
    text. Other columns are ignored. No row gives an empty table.

    Plan: sizes are measured once into a narrow table. The hash keys are uniform, so equal ranges of them hold about
    equal numbers of rows: a source of n rows gets about sqrt(n) ranges. Prefix sums run over the ranges' totals and
    inside each range, so neither window holds more than about sqrt(n) rows of any source, a hot one included.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.col(text).alias("text"))
    rows = rows.select(
        "doc_id",
        "source",
        word_count(F.col("text")).alias("size"),
        F.xxhash64("text").alias("_copy"),
        _random_key(seed, F.col("doc_id")).alias("_key"),
    )
    rows = materialise(rows, "sizes")
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_rows_in"))
    targets = materialise(source_targets(sources, weights, share, most), "targets")
    known = targets.withColumnRenamed("source", "_source")
    ranges = F.ceil(F.sqrt("_rows_in")).cast("long")
    joined = rows.join(known, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    joined = joined.withColumn("_range", F.floor(F.col("_key") * ranges / F.lit(float(1 << KEY_BITS))).cast("long"))
    totals = joined.groupBy("source", "_range").agg(F.sum("size").alias("_words"))
    ahead = Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        F.col("source").alias("_source"),
        F.col("_range").alias("_of"),
        F.coalesce(F.sum("_words").over(ahead), F.lit(0)).alias("_start"),
    )
    inside = Window.partitionBy("source", "_range").orderBy("_key", "doc_id", "_copy", "size")
    inside = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = joined.withColumn("_upto", F.sum("size").over(inside))
    placed = placed.join(totals, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_range") == F.col("_of")))
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    rest = budget - epochs * F.col("source_size")
    first = F.col("_start") + F.col("_upto") - F.col("size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - first))
    return placed.select(
        "doc_id", "_copy", "size", "source", "source_size", "target", (epochs * F.col("size") + part).cast("long").alias("taken")
    )


def take_words(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them; a part is a row of its first words.

    ``docs`` has the columns ``doc_id, text, lang, source, n_chars``. Rows that repeat an id and a text are taken
    alike. ``n_chars`` is counted anew.
    """
    docs = docs.withColumn("_copy", F.xxhash64("text"))
    plan = mixed.filter(F.col("taken") > 0).groupBy("doc_id", "_copy").agg(F.max("size").alias("_size"), F.max("taken").alias("_taken"))
    plan = plan.withColumnsRenamed({"doc_id": "_id", "_copy": "_of"})
    whole = F.floor(F.col("_taken") / F.col("_size")).cast("int")
    left = (F.col("_taken") % F.col("_size")).cast("int")
    copies = F.array_compact(F.concat(F.array_repeat(F.col("_size"), whole), F.array(F.when(left > 0, left.cast("long")))))
    joined = docs.join(plan, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_copy") == F.col("_of")))
    taken = joined.withColumn("_words", F.explode(copies))
    cut = F.when(F.col("_words") == F.col("_size"), F.col("text")).otherwise(_head(F.col("text"), F.col("_words")))
    taken = taken.select("doc_id", cut.alias("text"), "lang", "source")
    return taken.withColumn("n_chars", F.char_length("text").cast("long"))


def _head(text: Column, words: Column) -> Column:
    """The first ``words`` words with the white space between them."""
    pieces = F.split(F.btrim(text, F.lit(WHITE)), "(?<=[ \\t\\n\\x0B\\f\\r])(?=[^ \\t\\n\\x0B\\f\\r])")
    return F.btrim(F.array_join(F.slice(pieces, F.lit(1), words.cast("int")), ""), F.lit(WHITE))
