"""Small tables with every awkward case."""

from pyspark.sql import types as T

CLASHING = ("_copy", "copy", "row", "key", "node", "n", "h", "rank", "size", "spans", "_lines", "target", "k0", "ids", "host", "label", "width")
DOCS = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())]
    + [T.StructField(c, T.StringType()) for c in ("lang", "source")]
    + [T.StructField("n_chars", T.LongType())]
    + [T.StructField(c, T.StringType()) for c in CLASHING]
)


def documents(spark, rows):
    """``rows``: (doc_id, text[, lang[, source]])."""
    full = [(*r, *([None] * (4 - len(r))), None if r[1] is None else len(r[1]), *CLASHING) for r in rows]
    return spark.createDataFrame(full, DOCS)


def collected(df, *order):
    return sorted(map(tuple, df.collect()), key=lambda r: tuple((x is None, str(x)) for x in r))
