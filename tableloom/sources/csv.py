"""CSV import with header clean-up and column types decided from all rows."""

from __future__ import annotations

import csv
import re
import unicodedata
from collections.abc import Collection, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableloom.sources.csv_records import read_records
from tableloom.sources.reserved import RESERVED_WORDS, TYPE_FUNCTION_WORDS

# Separators that are tried.
SEPARATORS = (",", "|", ";", "\t")
HEAD_ROWS = 2000  # tried first, to leave most types out of the pass over all rows

_TIME = r"[ T](\d{1,2}:\d{2}(?::\d{2}(?:\.\d{1,6}\d*)?)?)"
_MARK = r"([-/. ])"  # the same mark stands twice in a date


@dataclass(frozen=True)
class _Kind:
    """A type a text column may take: what its values look like, and how they are rewritten for a cast."""

    type: str
    pattern: str
    rewrites: tuple[tuple[str, str], ...] = ()

    def value(self, column: Column) -> Column:
        text = F.trim(column)
        for pattern, made in self.rewrites:
            text = F.regexp_replace(text, pattern, made)
        return text

    def fits(self, column: Column) -> Column:
        """True where the value reads as this type; NULLs fit every type."""
        return column.isNull() | (column.rlike(self.pattern) & self.value(column).try_cast(self.type).isNotNull())


def _dated(kind: str, time: str, tail: str) -> list[_Kind]:
    year_first = rf"^(\d{{4}}){_MARK}(\d{{1,2}})\2(\d{{1,2}}){time}$"
    year_last = rf"^(\d{{1,2}}){_MARK}(\d{{1,2}})\2(\d{{4}}){time}$"
    short = rf"^(\d{{2}}){_MARK}(\d{{1,2}})\2(\d{{1,2}}){time}$"
    this_century, last_century = short.replace(r"^(\d{2})", r"^([0-6]\d)", 1), short.replace(r"^(\d{2})", r"^([7-9]\d)", 1)
    return [
        _Kind(kind, year_first, ((year_first, f"$1-$3-$4{tail}"),)),
        _Kind(kind, short, ((this_century, f"20$1-$3-$4{tail}"), (last_century, f"19$1-$3-$4{tail}"))),
        _Kind(kind, year_last, ((year_last, f"$4-$3-$1{tail}"),)),
        _Kind(kind, year_last, ((year_last, f"$4-$1-$3{tail}"),)),
    ]


_NUMBER = r"-?(?!0\d)(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?"

# Tried in this order; a column takes the first type that all its values fit, else it stays text.
_KINDS = [
    _Kind("boolean", r"(?i)^(true|false|t|f|yes|no)$"),
    *_dated("date", "", ""),
    *_dated("timestamp_ntz", _TIME, " $5"),
    _Kind("timestamp", rf"^\d{{4}}-\d{{1,2}}-\d{{1,2}}{_TIME}(Z|[+-]\d{{2}}(:\d{{2}})?)$"),
    _Kind("bigint", r"^ *-?(0|[1-9]\d*) *$"),
    _Kind("decimal(38,0)", r"^ *-?(0|[1-9]\d*) *$"),
    _Kind("double", rf"^ *({_NUMBER}|(?i:nan)) *$"),
]


def normalize_names(names: list[str], keywords: Collection[str] = RESERVED_WORDS | TYPE_FUNCTION_WORDS) -> list[str]:
    """Header names as identifiers: lower case, accents and punctuation dropped, spaces to ``_``.

    A leading digit or a keyword gets a leading ``_``, a blank name becomes ``column`` and its place,
    and repeated names are numbered.
    """
    made: list[str] = []
    width = len(str(max(0, len(names) - 1)))
    for place, raw in enumerate(names):
        plain = "".join(ch for ch in unicodedata.normalize("NFKD", raw or "") if not unicodedata.combining(ch))
        kept = re.sub(r"[^a-z0-9_\s]", "", plain.lower()).strip()
        name = re.sub(r"\s+", "_", kept)
        if not (raw or "").strip():
            name = f"column{place:0{width}d}"
        elif not name or name[0].isdigit() or name in keywords:
            name = "_" + name
        unique, n = name, 0
        while unique in made:
            n += 1
            unique = f"{name}_{n}"
        made.append(unique)
    return made


def import_csv(spark: SparkSession, path: str, max_rows: int | None = None, sep: str | None = None) -> DataFrame:
    """Read CSV files with a header line; rows with a wrong number of fields are skipped.

    Large files are read by many tasks, also those whose quoted values hold line breaks (``csv_records``). Files whose
    headers hold the same names in another order are read by name; other names are an error. The separator is found
    from all lines unless given, and types are settled over all rows, so a skipped row never widens a column. With
    ``max_rows`` only the first rows are kept, in the order of the files' names and then of their lines.
    """
    if max_rows is not None and max_rows <= 0:
        raise ValueError(f"invalid max_rows: {max_rows}")
    lines = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("file"))
    sep = sep or find_separator(lines)
    groups = _headers(lines, sep)
    if not groups:
        raise ValueError(f"no header line in {path}")
    first = groups[0].names
    if any(set(g.names) != set(first) for g in groups):
        raise ValueError(f"the files below {path} differ in their columns: {sorted(g.names for g in groups)}")
    reader = spark.read.option("sep", sep).option("quote", '"').option("escape", '"')
    parts = [_rows_of(spark, reader, g, path if len(groups) == 1 else g.files, sep).select(*first, *_PLACE) for g in groups]
    text = reduce(DataFrame.unionByName, parts)
    # types hold for all rows, so it does not matter which rows the cap keeps
    typed = settle_types(text, first)
    return (typed if max_rows is None else _first_rows(typed, max_rows)).select(*first)


_PLACE = ("#file", "#block", "#at")  # of a row: its file, where its split starts, its place in there; no header name has a #
_PLAIN, _BROKEN, _RETURNS = range(3)  # lines are records; quoted values hold line breaks; lines end in a bare carriage return


@dataclass(frozen=True)
class _Group:
    """Files with the same columns that are read alike."""

    names: tuple[str, ...]
    kind: int
    files: list[str]


def _rows_of(spark: SparkSession, reader: DataFrameReader, group: _Group, paths: str | list[str], sep: str) -> DataFrame:
    """The files' rows as text, with ``_PLACE``."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in group.names])
    if group.kind == _BROKEN:
        options = {"sep": sep, "quote": '"', "escape": '"', "multiLine": "true", "maxCharsPerColumn": "-1", "columnNameOfCorruptRecord": "#bad"}
        records = read_records(spark, group.files, sep).where(F.trim("text") != "")
        fields = F.from_csv("text", T.StructType([*schema, T.StructField("#bad", T.StringType())]).toDDL(), options)
        rows = records.select(fields.alias("row"), *[F.col(c).alias(n) for c, n in zip(("file", "block", "at"), _PLACE, strict=True)])
        return rows.where(F.col("row.#bad").isNull()).select("row.*", *[F.col(f"`{n}`") for n in _PLACE]).drop("#bad")
    # all fields of a line are parsed, so a short line is noticed whatever columns are asked for
    reader = reader.option("header", True).option("mode", "DROPMALFORMED").option("columnPruning", False)
    rows = reader.option("multiLine", group.kind == _RETURNS).schema(schema).csv(paths)
    places = (F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    return rows.select("*", *[p.alias(n) for p, n in zip(places, _PLACE, strict=True)])


def _headers(lines: DataFrame, sep: str) -> list[_Group]:
    """The files by their column names and by how they are read; a file's header is its first line."""
    places = lines.select("file", "value", F.monotonically_increasing_id().alias("at"))
    odd = (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))) % 2 == 1
    first = places.groupBy("file").agg(F.min_by("value", "at").alias("header"), F.max(odd).alias("odd"))
    groups: dict[tuple, list[str]] = {}
    for file, header, broken in sorted(first.collect()):  # one row per file
        header = header.removeprefix("\ufeff").removesuffix("\r")
        kind = _RETURNS if "\r" in header else _BROKEN if broken else _PLAIN
        names = next(csv.reader([header.partition("\r")[0]], delimiter=sep), None)
        if names:
            groups.setdefault((tuple(normalize_names(names)), kind), []).append(file)
    return [_Group(names, kind, files) for (names, kind), files in groups.items()]


def _first_rows(df: DataFrame, n: int) -> DataFrame:
    """``n`` rows of the first files by name; of the last of these, the rows of its first lines."""
    file, block, at = (F.col(f"`{c}`") for c in _PLACE)
    for name, size in df.groupBy(file.alias("file")).count().orderBy("file").toLocalIterator():  # one row per file
        if n <= size:
            part = df.where(file == F.lit(name)).orderBy(block, at).limit(n)
            return df.where(file < F.lit(name)).unionByName(part)
        n -= size
    return df


def find_separator(lines: DataFrame) -> str:
    """The separator that splits most lines into the same number of fields, and into most fields; quotes are left out."""
    bare = F.regexp_replace("value", r'"[^"]*"?', "")
    order = F.array(*[F.lit(sep) for sep in SEPARATORS])
    width = lambda sep: F.length(bare) - F.length(F.replace(bare, sep, F.lit("")))
    splits = lines.select(F.explode(F.transform(order, lambda sep, i: F.struct(i.alias("i"), width(sep).alias("n")))).alias("s"))
    alike = splits.where("s.n > 0").groupBy("s.i", "s.n").count()
    best = alike.orderBy(F.desc("count"), F.desc("n"), "i").first()
    return SEPARATORS[best[0] if best else 0]


def settle_types(text: DataFrame, names: Sequence[str]) -> DataFrame:
    """Cast every text column of ``names`` to the first type that all its values fit; other columns stay.

    The first rows rule out most types for good; only the others are tried on all rows.
    """
    possible = _fitting(text.limit(HEAD_ROWS), {c: _KINDS for c in names}, blank_fits=True)
    left = _fitting(text, {c: kinds for c, kinds in possible.items() if kinds}, blank_fits=False)
    typed = []
    for c in names:
        kinds = left.get(c)
        typed.append(kinds[0].value(F.col(c)).cast(kinds[0].type).alias(c) if kinds else F.col(c))
    return text.select(*typed, *[F.col(f"`{c}`") for c in text.columns if c not in names])


def _fitting(text: DataFrame, tried: dict[str, list[_Kind]], blank_fits: bool) -> dict[str, list[_Kind]]:
    """For each column the kinds that all its values fit; a column without values fits all or none."""
    if not tried:
        return {}
    tests = [
        F.every(kind.fits(F.col(c))).alias(f"{i}_{n}")
        for i, (c, kinds) in enumerate(tried.items())
        for n, kind in enumerate(kinds)
    ]
    filled = [F.count(c).alias(f"{i}_filled") for i, c in enumerate(tried)]
    found = text.agg(*tests, *filled).first().asDict()  # one row
    return {
        c: [kind for n, kind in enumerate(kinds) if (found[f"{i}_{n}"] if found[f"{i}_filled"] else blank_fits)]
        for i, (c, kinds) in enumerate(tried.items())
    }


def list_csv(spark: SparkSession, folder: str) -> DataFrame:
    """Name, size and modification time of the CSV files under ``folder``; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.where(F.lower("path").endswith(".csv")).select(
        F.substring_index("path", "/", -1).alias("name"),
        "path",
        F.col("length").alias("size"),
        F.col("modificationTime").alias("modified"),
    )


def source_tag(owner: str, slug: str, file: str) -> str:
    # Fixed value: the form under which imported files are registered.
    return f"kaggle:{owner}/{slug}/{file}"
