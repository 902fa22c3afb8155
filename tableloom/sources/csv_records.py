"""Records of CSV files whose quoted values hold line breaks, read by many tasks a file.

Whether a line break ends a record depends on all quotes before it. So every split of a file is read twice at once, as if
it began outside and as if it began inside a quoted value; both readings agree from the first line on that leads to the
same state either way, which is any line with a whole quoted value. What a split does to the state is one small row;
the states at all split starts follow from these by running sums, and pick the reading that holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tableloom.session import fits_broadcast, materialise

OUTSIDE, INSIDE, EITHER = 0, 1, 2  # how a reading began; EITHER once both agree
WHOLE, PIECE, TAIL, SPLIT = range(4)  # a record, a part of one begun in an earlier split, one that goes on, a split's end states
PIECE_CHARS = 1 << 20  # an unfinished record is handed on in pieces of about this size
_FIELDS = "file string, block long, reading int, kind int, at long, text string"


def ends_inside(line: str, inside: bool, sep: str) -> bool:
    """Whether a quoted value is open behind ``line``, if one was (``inside``) or was not open before it.

    A quote opens a value only where a field starts; inside, two quotes stand for one, and any other quote closes.
    """
    if '"' not in line:
        return inside
    pieces, closing = line.split('"'), False
    for at, piece in enumerate(pieces[:-1]):  # a quote follows each of them
        if closing:
            closing = False
            if not piece:  # the second of two quotes
                continue
            inside = False
        if inside:
            closing = True
        else:
            inside = piece.endswith(sep) or (at == 0 and not piece)
    return inside and not closing


class _Reading:
    """The records of a split under one assumption about its start."""

    def __init__(self, began: int):
        self.began, self.inside, self.own = began, began == INSIDE, began != INSIDE
        self.lines: list[str] = []
        self.size, self.at = 0, 0

    def line(self, text: str, number: int, sep: str) -> Iterator[tuple]:
        if not self.inside:
            self.at, self.own = number, True
        self.lines.append(text)
        self.size += len(text) + 1
        self.inside = ends_inside(text, self.inside, sep)
        if not self.inside:
            yield self._taken(WHOLE if self.own else PIECE)
            self.own = True
        elif self.size >= PIECE_CHARS and not self.own:
            yield self._taken(PIECE)
            self.at = number + 1

    def _taken(self, kind: int) -> tuple:
        made = (self.began, kind, self.at, "\n".join(self.lines))
        self.lines, self.size = [], 0
        return made

    def end(self) -> Iterator[tuple]:
        if self.lines:
            yield self._taken(TAIL if self.own else PIECE)


class _Split:
    def __init__(self, sep: str):
        self.readings, self.number, self.sep = [_Reading(OUTSIDE), _Reading(INSIDE)], 0, sep

    def line(self, text: str) -> Iterator[tuple]:
        for reading in self.readings:
            yield from reading.line(text, self.number, self.sep)
        self.number += 1
        if len(self.readings) == 2 and not any(r.inside for r in self.readings):
            self.readings = [_Reading(EITHER)]

    def end(self) -> Iterator[tuple]:
        """What is left, and the states at the end as a number: 2 * after INSIDE + after OUTSIDE."""
        for reading in self.readings:
            yield from reading.end()
        yield EITHER, SPLIT, 2 * self.readings[-1].inside + self.readings[0].inside, None


def _read_splits(lines: DataFrame, sep: str) -> DataFrame:
    """Rows of ``_FIELDS`` for ``lines`` (file, block, value), which come in the order of their files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, split = None, None
        for batch in batches:
            out = []
            for file, block, text in zip(*(batch[c].to_pylist() for c in ("file", "block", "value")), strict=True):
                if (file, block) != name:
                    if split:
                        out += [(*name, *row) for row in split.end()]
                    name, split = (file, block), _Split(sep)
                out += [(file, block, *row) for row in split.line(text)]
            yield _batch(out)
        if split:
            yield _batch([(*name, *row) for row in split.end()])

    return lines.mapInArrow(run, _FIELDS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"file": pa.string(), "block": pa.int64(), "reading": pa.int32(), "kind": pa.int32(), "at": pa.int64(), "text": pa.string()}
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds.values(), strict=True)], names=list(kinds))


def _starts(read: DataFrame) -> DataFrame:
    """``_file, _block, _start, _opened`` per split: the state it starts in, and the split where an open record began.

    A split may keep the state (2), swap it (1), or end in one state whatever came before (0, 3). So a split's start is
    the end of the last one of those, swapped once for each that swaps since.
    """
    splits = read.where(F.col("kind") == SPLIT).select("file", "block", F.col("at").alias("does"))
    order = Window.partitionBy("file").orderBy("block")  # one small row per split of a file
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    swaps = F.sum((F.col("does") == 1).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    splits = splits.withColumn("swaps", swaps)
    fixed = F.when(F.col("does").isin(0, 3), F.struct((F.col("does") == 3).cast("int").alias("end"), "swaps"))
    last = F.last(fixed, ignorenulls=True).over(before)
    gone = F.coalesce(F.lag("swaps").over(order), F.lit(0)) - F.coalesce(last["swaps"], F.lit(0))
    started = splits.withColumn("start", (F.coalesce(last["end"], F.lit(0)) + gone) % 2)
    tails = read.where(F.col("kind") == TAIL).select("file", "block", F.col("reading").alias("tail"))
    held = started.join(tails, ["file", "block"], "left").groupBy("file", "block", "start").agg(
        F.max(F.col("tail").isin(EITHER) | (F.col("tail") == F.col("start"))).alias("opens")
    )
    opened = F.last(F.when(F.col("opens"), F.col("block")), ignorenulls=True).over(before)
    return held.select(F.col("file").alias("_file"), F.col("block").alias("_block"), F.col("start").alias("_start"), opened.alias("_opened"))


def read_records(spark: SparkSession, files: list[str], sep: str) -> DataFrame:
    """``file, block, at, text``: every record but each file's first, in the order of ``block`` (of its first line) and ``at``.

    Lines end in a line feed; a carriage return before it is dropped at the end of a record. A record whose quotes are
    still open at the end of the file ends there. The splits are read once and written to the shared folder. A task
    holds one record, of those that go on into the next split at most a piece; records that cross splits are put together
    by a shuffle of their pieces alone.
    """
    lines = spark.read.option("lineSep", "\n").text(files)
    lines = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    read = materialise(_read_splits(lines, sep), "records")
    starts = materialise(_starts(read), "splits")
    same = (F.col("file") == F.col("_file")) & (F.col("block") == F.col("_block"))
    holds = (F.col("reading") == EITHER) | (F.col("reading") == F.col("_start"))
    parts = read.where(F.col("kind") != SPLIT)
    whole, cut = read.where(F.col("kind") == WHOLE), read.where(F.col("kind").isin(PIECE, TAIL))
    names = ("file", "block", "at", "text")
    if fits_broadcast(starts):  # and the records keep their order
        starts = F.broadcast(starts)
        whole = whole.join(starts, same).where(holds).select(*names)
    else:  # most records hold either way, and need no start
        sure = whole.where(F.col("reading") == EITHER).select(*names)
        whole = sure.unionByName(whole.where(F.col("reading") != EITHER).join(starts, same).where(holds).select(*names))
    rest = cut.join(starts, same).where(holds)
    first = F.when(F.col("kind") == TAIL, F.col("block")).otherwise(F.col("_opened"))
    pieces = F.sort_array(F.collect_list(F.struct("block", "at", "text")))
    crossing = rest.groupBy("file", first.alias("first")).agg(pieces.alias("pieces"))
    joined = F.array_join(F.transform("pieces", lambda p: p["text"]), "\n")
    crossing = crossing.select("file", F.col("first").alias("block"), F.col("pieces")[0]["at"].alias("at"), joined.alias("text"))
    records = whole.unionByName(crossing).where((F.col("block") > 0) | (F.col("at") > 0))
    return records.withColumn("text", F.regexp_replace("text", r"\r$", ""))
