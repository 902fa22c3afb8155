"""Ranked lexical search by NRA: impact-sorted lists, read in sequence, with score intervals per document."""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from tableloom.llm.byte_runs import TERM, run_hashes, sweeps
from tableloom.llm.words import map_batches, signed
from tableloom.session import materialise

SHARD_DOCS = 8192  # documents of a shard, the unit that is searched at once
SHARD_POSTINGS = 2 << 20  # and no more postings than that, but for a single document's
BLOCK_TERMS = 200_000  # terms of the queries that are sent to the workers at a time
FIRST_READ = 64  # entries read of each list at first; twice as many each time


class Shard:
    """Impact-sorted lists of one shard: documents by place, places in the order of their ids."""

    def __init__(self, terms: np.ndarray, places: np.ndarray, impacts: np.ndarray, size: int):
        order = np.lexsort((places, -impacts, terms))
        self.places, self.impacts, self.size = places[order], impacts[order], size
        self.terms, self.starts = np.unique(terms[order], return_index=True)
        self.ends = np.append(self.starts[1:], len(terms))

    def best(self, terms: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the ``k`` best documents with a score above 0, ties to the smaller place.

        A document's score lies between the sum of what was read of it and that sum plus, for every list it has not
        been met in, the last impact read there. Lists are read in parallel, by no other access, until no document that
        was never met can reach the kth lower bound and the interval of every one that can is a single number.
        """
        at = np.minimum(np.searchsorted(self.terms, terms), max(0, len(self.terms) - 1))
        held = [(self.starts[i], self.ends[i], w) for i, t, w in zip(at, terms, weights, strict=True) if len(self.terms) and self.terms[i] == t and w > 0]
        lower = np.zeros(self.size, np.int64)
        met = np.zeros((len(held), self.size), bool)
        frontier = np.zeros(len(held), np.int64)
        read, step = 0, FIRST_READ
        while True:
            for i, (start, end, weight) in enumerate(held):
                low, high = start + read, min(end, start + read + step)
                if low < high:
                    places = self.places[low:high]
                    lower[places] += weight * self.impacts[low:high]
                    met[i, places] = True
                frontier[i] = weight * self.impacts[high - 1] if high < end else 0
            read, step = read + step, 2 * step
            open_lists = np.flatnonzero(frontier)
            kth = np.partition(lower, -k)[-k] if self.size > k else 0
            if not len(open_lists):
                return self._first(np.flatnonzero(lower >= max(kth, 1)), lower, k)
            if kth > frontier.sum():
                rivals = np.flatnonzero(lower >= kth - frontier.sum())
                unknown = np.zeros(len(rivals), np.int64)
                for i in open_lists:
                    unknown += frontier[i] * ~met[i, rivals]
                able = lower[rivals] + unknown >= kth
                if not unknown[able].any():
                    return self._first(rivals[able], lower, k)

    @staticmethod
    def _first(places: np.ndarray, lower: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        chosen = places[np.lexsort((places, -lower[places]))][:k]
        return chosen, lower[chosen]


def _index_rows(batches: Iterator[dict], asked: np.ndarray) -> Iterator[dict]:
    """One row per shard: its documents, and the postings of the ``asked`` terms (sorted hashes)."""
    ids, sizes, postings, total = [], [], [], 0

    def shard() -> dict:
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i]))
        rank = np.empty(len(ids), np.int64)
        rank[order] = np.arange(len(ids))
        place, term, tf = (np.concatenate([p[k] for p in postings]) for k in range(3))
        n = np.array(sizes, np.int64)[order]
        return {
            "ids": [[ids[i] for i in order]],
            "sizes": [n.tobytes()],
            "holding": [int((n > 0).sum())],
            "length": [int(n.sum())],
            "terms": [term.astype(np.uint32).tobytes()],
            "places": [rank[place].astype(np.uint16).tobytes()],
            "tf": [tf.astype(np.uint32).tobytes()],
        }

    for batch in batches:
        for start, texts in sweeps(batch["text"]):
            hashes, bounds = run_hashes(texts, TERM)
            at = np.searchsorted(asked, hashes)
            known = at < len(asked)
            known[known] = asked[at[known]] == hashes[known]
            row = np.repeat(np.arange(len(texts)), np.diff(bounds))[known]
            pair, tf = np.unique(row * max(1, len(asked)) + at[known], return_counts=True)
            row, term = np.divmod(pair, max(1, len(asked)))
            doc_ids, low = batch["doc_id"].slice(start, len(texts)).to_pylist(), 0
            while low < len(texts):  # a sweep of many short texts may fill several shards
                high = min(len(texts), low + SHARD_DOCS - len(ids))
                a, b = np.searchsorted(row, (low, high))
                postings.append((row[a:b] - low + len(ids), term[a:b], tf[a:b]))
                ids += doc_ids[low:high]
                sizes += np.diff(bounds)[low:high].tolist()
                total, low = total + int(b - a), high
                if len(ids) >= SHARD_DOCS or total >= SHARD_POSTINGS:
                    yield shard()
                    ids, sizes, postings, total = [], [], [], 0
    if ids:
        yield shard()


def _frequencies(index: DataFrame, terms: int) -> np.ndarray:
    """Number of documents per asked term, added up in the tasks first; at most one entry per term reaches the driver."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        counts = np.zeros(terms, np.int64)
        for batch in batches:
            for x in batch["terms"].to_pylist():
                counts += np.bincount(np.frombuffer(x, np.uint32), minlength=terms)
        held = np.flatnonzero(counts)
        yield {"term": held, "df": counts[held]}

    found = map_batches(index.select("terms"), run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    df = np.zeros(terms, np.int64)
    df[found["term"].to_numpy()] = found["df"].to_numpy()
    return df


def _search_block(spark: SparkSession, rows: DataFrame, items: pa.Table, k: int, id_type) -> DataFrame:
    """``query, doc_id, score``: the ``k`` best of every shard for the queries of a block (``query`` numbers, ``term`` hashes)."""
    hashes = items["term"].to_numpy().astype(np.int64).view(np.uint64)
    asked, at = np.unique(hashes, return_inverse=True)
    query = items["query"].to_numpy()
    order = np.argsort(query, kind="stable")
    query, at = query[order], at[order]
    names, starts = np.unique(query, return_index=True)
    parts = np.split(at, starts[1:])
    sent = spark.sparkContext.broadcast(asked)
    fields = StructType([StructField("ids", ArrayType(id_type))]).add("sizes", "binary").add("holding", "long").add("length", "long")
    for name in ("terms", "places", "tf"):
        fields = fields.add(name, "binary")
    index = materialise(map_batches(rows, lambda batches: _index_rows(batches, sent.value), fields), "index")
    n, length = index.agg(F.sum("holding"), F.sum("length")).first()
    n, length = n or 0, length or 0
    weights = np.array([int(1000 * log((2 * n + 2) / (2 * df + 1))) for df in _frequencies(index, len(asked)).tolist()], np.int64)
    queries = spark.sparkContext.broadcast([(int(name), part, weights[part]) for name, part in zip(names, parts, strict=True)])

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            for row in range(len(batch["ids"])):
                ids = batch["ids"][row].values
                sizes = np.frombuffer(batch["sizes"][row].as_py(), np.int64)
                terms, places, tf = (np.frombuffer(batch[c][row].as_py(), t) for c, t in (("terms", np.uint32), ("places", np.uint16), ("tf", np.uint32)))
                m = 50 + 50 * sizes * n // max(1, length)
                tf, places = tf.astype(np.int64), places.astype(np.int64)
                shard = Shard(terms, places, 1_000_000_000 * tf // (1000 * tf + 20 * m[places]), len(ids))
                found = [(name, *shard.best(part, weight, k)) for name, part, weight in queries.value]
                chosen = np.concatenate([x[1] for x in found])
                yield {
                    "query": np.repeat([x[0] for x in found], [len(x[1]) for x in found]),
                    "doc_id": ids.take(pa.array(chosen)),
                    "score": np.concatenate([x[2] for x in found]),
                }

    out = StructType().add("query", "long").add("doc_id", id_type).add("score", "long")
    return map_batches(index.select("ids", "sizes", "terms", "places", "tf"), run, out)


def search(docs: DataFrame, items: DataFrame, k: int = 50, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best rows of ``docs`` for each id of ``items``.

    Terms are runs of ASCII letters, ASCII digits and all characters beyond ASCII, A-Z lower-cased. An item's terms count
    once; rows that share an item id are one query with the terms of all, a NULL id being one of them. With N documents
    that have a term, L terms in them with repeats, n terms in a document and df documents with a term, a term that occurs
    tf times adds w * (1000000000 tf div (1000 tf + 20 m)), where w = floor(1000 ln((2 N + 2) / (2 df + 1))) and m = 50 +
    (50 n N) div L. Only scores above 0 rank; equal ones by ascending id, NULL last. Rows of ``docs`` are documents each, also
    if they repeat an id or a text; NULL and empty texts have no term and never rank. No item with a term, or no
    document, gives no row. Other columns are ignored.

    Documents stay where they are read: each task indexes its own in shards, keeping the postings of asked terms, and
    searches them by NRA; ``k`` rows per item and shard meet. Queries go to the workers in blocks of about ``BLOCK_TERMS``
    terms, each with its own index. Terms are compared by 64-bit hashes.
    """
    spark = docs.sparkSession
    id_type = docs.schema[doc_id].dataType
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def term_rows(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            for start, texts in sweeps(batch["text"]):
                hashes, bounds = run_hashes(texts, TERM)
                taken = np.repeat(np.arange(start, start + len(texts)), np.diff(bounds))
                yield {"item_id": batch["item_id"].take(pa.array(taken)), "term": signed(hashes)}

    asked = items.select(F.col(item_id).alias("item_id"), F.col(text).alias("text"))
    kind = StructType().add("item_id", items.schema[item_id].dataType).add("term", "long")
    terms = materialise(map_batches(asked, term_rows, kind).distinct(), "terms")
    names = materialise(terms.select("item_id").distinct().withColumn("query", F.monotonically_increasing_id()), "queries")
    blocks = 1 + terms.count() // BLOCK_TERMS
    terms = terms.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)))
    terms = materialise(terms.join(names.withColumnRenamed("item_id", "_id"), F.col("item_id").eqNullSafe(F.col("_id"))).drop("_id"), "numbered")
    found = None
    for block in range(blocks):
        part = terms.filter(F.col("block") == block).select("query", "term").toArrow()
        if not part.num_rows:
            continue
        one = _search_block(spark, rows, part, k, id_type)
        if blocks > 1:
            one = materialise(one, "found")
        found = one if found is None else found.unionByName(one)
    if found is None:
        found = rows.select(F.lit(0).cast("long").alias("query"), "doc_id", F.lit(0).cast("long").alias("score")).limit(0)
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.join(names, "query").select("item_id", "rank", "doc_id", "score")
