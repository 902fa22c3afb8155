"""Jaccard join on word shingles by T-occurrence search (DivideSkip) over inverted lists."""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from math import log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tableloom.llm.bloom import BlockedBloom
from tableloom.llm.byte_runs import shingle_sets, sweeps
from tableloom.llm.components import components
from tableloom.llm.words import map_batches, signed
from tableloom.session import materialise

WIDTH = 4  # words of a shingle
SEGMENT_BYTES = 8 << 20  # bytes of texts for one segment of the code space
CHUNK_SHINGLES = 1 << 20  # shingles of the documents that ask for frequencies together
CHUNK_DOCS = 60_000  # at most; a document's place in its chunk takes 16 bits
BLOCK_SHINGLES = 1 << 20  # shingles of a block of sets that an index is made of
DENSE = 4096  # entries of short lists that a heap merges at most
LONG_SHARE = 0.01  # DivideSkip's constant: the larger, the fewer lists count as long
COUNTS, PLACES, DOCUMENT = 0, 1, 2  # kinds of rows in a segment, in this order


class InvertedLists:
    """Sets by shingle: for each shingle the sorted places of the sets that hold it."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        values = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        order = np.argsort(values, kind="stable")
        self.places = np.repeat(np.arange(len(sets)), self.sizes)[order]
        self.values, self.starts = np.unique(values[order], return_index=True)
        self.ends = np.append(self.starts[1:], len(values))

    def lists_of(self, query: np.ndarray) -> list[np.ndarray]:
        """The lists of a query's shingles, shortest first."""
        if not len(self.values):
            return []
        at = np.minimum(np.searchsorted(self.values, query), len(self.values) - 1)
        at = at[self.values[at] == query]
        at = at[np.argsort(self.ends[at] - self.starts[at], kind="stable")]
        return [self.places[self.starts[i] : self.ends[i]] for i in at]


def merge_skip(lists: list[list[int]], least: int) -> Iterator[tuple[int, int]]:
    """``(place, lists that hold it)`` for places in at least ``least`` of the sorted lists.

    A heap holds the next place of each list. If too few agree on the smallest, ``least - 1`` lists are taken off and
    jump to the place that is now smallest: no smaller one can be in ``least`` lists.
    """
    at = [0] * len(lists)
    heap = [(x[0], i) for i, x in enumerate(lists)]
    heapq.heapify(heap)
    while len(heap) >= least:
        place, taken = heap[0][0], []
        while heap and heap[0][0] == place:
            taken.append(heapq.heappop(heap)[1])
        if len(taken) >= least:
            yield place, len(taken)
            jump = place + 1
        else:
            while heap and len(taken) < least - 1:
                taken.append(heapq.heappop(heap)[1])
            if not heap:
                return
            jump = heap[0][0]
        for i in taken:
            at[i] = bisect_left(lists[i], jump, at[i])
            if at[i] < len(lists[i]):
                heapq.heappush(heap, (lists[i][at[i]], i))


def _merged(lists: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in at least ``least`` of the lists, with their number; where lists are dense, a heap gains nothing over a count."""
    if sum(map(len, lists)) > DENSE:
        counts = np.bincount(np.concatenate(lists))
        places = np.flatnonzero(counts >= least)
        return places, counts[places]
    found = list(merge_skip([x.tolist() for x in lists], least))
    return np.array([x[0] for x in found], np.int64), np.array([x[1] for x in found], np.int64)


def divide_skip(index: InvertedLists, query: np.ndarray, percent: int, asked: np.ndarray | None = None) -> np.ndarray:
    """Places of the index's sets with 100 * intersection >= ``percent`` * union with the query; of those ``asked`` if given.

    Any such set shares at least T = percent / 100 of the query's shingles. The longest lists are put aside; a place that
    is in T of all lists is in T less their number of the others, which are merged. The long ones are then probed by
    bisection for the places found, as long as a place's own bound is neither reached nor out of reach.
    """
    lists = index.lists_of(query)
    least = -(-percent * len(query) // 100)
    if not lists or len(lists) < least:
        return np.zeros(0, np.int64)
    aside = min(least - 1, int(least / (LONG_SHARE * log2(len(lists[-1]) + 1) + 1)))
    short, long = lists[: len(lists) - aside], lists[len(lists) - aside :]
    places, common = _merged(short, least - aside)
    if asked is not None:
        places, common = places[asked[places]], common[asked[places]]
    needed = -(-percent * (len(query) + index.sizes[places]) // (100 + percent))
    for left, held in zip(range(len(long), 0, -1), long, strict=True):
        possible = common + left >= needed
        places, common, needed = places[possible], common[possible], needed[possible]
        if (common >= needed).all():
            break
        at = np.minimum(np.searchsorted(held, places), len(held) - 1)
        common = common + (held[at] == places)
    return places[common >= needed]


def _code_rows(batches: Iterator[dict], segments: int) -> Iterator[dict]:
    """Per chunk of documents and segment of the code space: the codes with their counts, and where they stand.

    A shingle's code is its segment (upper half of the hash) and the lower half. Codes only order shingles and bring
    documents together; two shingles with one code cost time, not links.
    """
    task, number = TaskContext.get().partitionId() << 32, 0

    def chunk(sets: list[np.ndarray], rows: list[dict]) -> Iterator[dict]:
        name = task + number
        sizes = np.array([len(s) for s in sets])
        hashes = np.concatenate(sets)
        codes = (hashes >> np.uint64(32)) % np.uint64(segments) << np.uint64(32) | hashes & np.uint64(0xFFFFFFFF)
        order = np.argsort(codes, kind="stable")
        places = np.repeat(np.arange(len(sets), dtype=np.uint16), sizes)[order]
        unique, first, counts = np.unique(codes[order], return_index=True, return_counts=True)
        cuts = np.searchsorted(unique >> np.uint64(32), np.arange(segments + 1))
        ends = np.append(first, len(codes))
        low, many = unique.astype(np.uint32), counts.astype(np.uint16)
        held = [i for i in range(segments) if cuts[i] < cuts[i + 1]]
        for kind in (COUNTS, PLACES):
            a = [low[cuts[i] : cuts[i + 1]].tobytes() if kind == COUNTS else places[ends[cuts[i]] : ends[cuts[i + 1]]].tobytes() for i in held]
            b = [many[cuts[i] : cuts[i + 1]].tobytes() if kind == COUNTS else None for i in held]
            yield _rows(len(held), segment=held, kind=[kind] * len(held), chunk=[name] * len(held), a=a, b=b)
        yield _rows(len(rows), **{c: [r[c] for r in rows] for c in rows[0]}, chunk=[name] * len(rows))

    sets, rows, total = [], [], 0
    for batch in batches:
        for start, texts in sweeps(batch["text"]):
            ids = batch["doc_id"].slice(start, len(texts)).to_pylist()
            copies = batch["copy"].slice(start, len(texts)).to_pylist()
            for doc, copy, found in zip(ids, copies, shingle_sets(texts, WIDTH), strict=True):
                digest = xxhash.xxh3_128_digest(found.tobytes()) if len(found) and doc is not None else None
                spread = len(rows) % segments
                rows.append({"segment": spread, "kind": DOCUMENT, "place": len(sets), "doc_id": doc, "copy": copy, "n": len(found), "digest": digest})
                sets.append(found if doc is not None else found[:0])
                total += len(sets[-1])
                if total >= CHUNK_SHINGLES or len(sets) >= CHUNK_DOCS:
                    yield from chunk(sets, rows)
                    sets, rows, total, number = [], [], 0, number + 1
    if rows:
        yield from chunk(sets, rows)


_COLUMNS = ("segment", "kind", "chunk", "place", "doc_id", "copy", "n", "digest", "a", "b", "c")


def _rows(size: int, **given: list) -> dict:
    return {c: given.get(c, [None] * size) for c in _COLUMNS}


def _shared_codes(batches: Iterator[dict]) -> Iterator[dict]:
    """Of each chunk, the codes that at least two documents of all chunks hold, with their frequencies and places.

    The counts of a segment come first, then the places, a chunk at a time: a shingle that a third of all documents hold
    is one entry per chunk among the counts. Rows of documents go through.
    """
    segment, held, shared, often = None, {}, None, None
    for batch in batches:
        names = [batch[c].to_pylist() for c in ("segment", "kind", "chunk", "a", "b")]
        out, passed = [], np.zeros(len(names[0]), bool)
        for row, (own, kind, chunk, a, b) in enumerate(zip(*names, strict=True)):
            if own != segment:
                segment, held, shared = own, {}, None
            if kind == COUNTS:
                held[chunk] = (np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint16))
            elif kind == PLACES:
                if shared is None:
                    codes, at = np.unique(np.concatenate([x[0] for x in held.values()]), return_inverse=True)
                    total = np.bincount(at, np.concatenate([x[1] for x in held.values()]))
                    shared, often = codes[total > 1], np.minimum(total[total > 1], 1 << 31).astype(np.uint32)
                codes, counts = held.pop(chunk)
                if not len(shared):
                    continue
                at = np.minimum(np.searchsorted(shared, codes), len(shared) - 1)
                mine = shared[at] == codes
                if mine.any():
                    full = np.full(int(mine.sum()), own, np.uint64) << np.uint64(32) | codes[mine]
                    places = np.frombuffer(a, np.uint16)[np.repeat(mine, counts)]
                    full, df = np.repeat(full, counts[mine]), np.repeat(often[at[mine]], counts[mine])
                    out.append((chunk, places.tobytes(), full.tobytes(), df.tobytes()))
            else:
                passed[row] = True
        if out:
            chunk, a, b, c = zip(*out, strict=True)
            yield _rows(len(out), kind=[PLACES] * len(out), chunk=chunk, a=a, b=b, c=c)
        if passed.any():
            yield {c: batch[c].filter(pa.array(passed)) if c in batch else [None] * int(passed.sum()) for c in _COLUMNS}


def _rarest(batches: Iterator[dict], percent: int) -> Iterator[dict]:
    """``key, node, n``: each node's shared codes among its n - T + 1 rarest ones, T being what a partner must share.

    Codes that no other document holds are the rarest. Two linked sets have a code in common here, as the order by
    frequency and code is the same for both.
    """
    chunk, size, node, held = None, None, None, []

    def prefixes() -> dict:
        if not held:
            return {"key": [], "node": [], "n": []}
        place, key, df = (np.concatenate([x[k] for x in held]) for k in range(3))
        known = size[place] > 0
        place, key, df = place[known], key[known], df[known]
        order = np.lexsort((key, df, place))
        place, key = place[order], key[order]
        many = np.bincount(place, minlength=len(size))
        first = np.cumsum(many) - many
        rank = np.arange(len(place)) - first[place]
        least = -(-percent * size // 100)
        wanted = (size - least + 1) - (size - many)
        place, key = place[rank < wanted[place]], key[rank < wanted[place]]
        return {"key": signed(key), "node": node[place], "n": size[place]}

    for batch in batches:
        for row in zip(*(batch[c].to_pylist() for c in ("chunk", "kind", "place", "node", "n", "a", "b", "c")), strict=True):
            if row[0] != chunk:
                if chunk is not None:
                    yield prefixes()
                chunk, held = row[0], []
                size, node = np.zeros(CHUNK_DOCS, np.int64), np.zeros(CHUNK_DOCS, np.int64)
            if row[1] == DOCUMENT:
                size[row[2]], node[row[2]] = row[4], row[3]
            else:
                held.append((np.frombuffer(row[5], np.uint16), np.frombuffer(row[6], np.uint64), np.frombuffer(row[7], np.uint32)))
    if chunk is not None:
        yield prefixes()


def _sets(wanted: DataFrame, nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """``node, n, set`` of the wanted nodes; equal texts are one before they shuffle, and a Bloom filter keeps others out."""
    asked = materialise(nodes.join(wanted, "node", "left_semi").select("node", "n", "copy"), "asked")
    bloom = BlockedBloom.build(asked.select("copy").distinct(), "copy")
    if bloom:
        rows = rows.filter(bloom.possible(rows.sparkSession, F.col("copy")))
    texts = rows.groupBy("copy").agg(F.first("text").alias("text"))

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            for start, part in sweeps(batch["text"]):
                sets = [s.tobytes() for s in shingle_sets(part, WIDTH)]
                yield {k: batch[k].slice(start, len(part)) for k in ("node", "n")} | {"set": pa.array(sets, pa.binary())}

    return materialise(map_batches(asked.join(texts, "copy").select("node", "n", "text"), run, "node long, n long, set binary"), "sets")


def _links(found: Iterable[tuple[int, int]]) -> dict:
    found = list(found)
    return {"a": [x[0] for x in found], "b": [x[1] for x in found]}


def _star_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between each hub and the members of its group: the hub asks an index of each block of its partners."""
    blocks = members.groupBy("hub").agg(F.ceil(F.sum("n") / F.lit(float(BLOCK_SHINGLES))).cast("long").alias("blocks"))
    dealt = members.filter(F.col("node") != F.col("hub")).join(blocks, "hub")
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    asking = dealt.select("hub", "block", F.col("hub").alias("node"), F.lit(0).alias("role")).distinct()
    rows = dealt.select("hub", "block", "node", F.lit(1).alias("role")).unionByName(asking).join(sets, "node")
    rows = rows.select("hub", "block", "role", "node", "set").repartition("hub", "block").sortWithinPartitions("hub", "block", "role")

    def links(held: list[tuple]) -> Iterator[tuple[int, int]]:
        query, *rest = [np.frombuffer(r[4], np.uint64) for r in held]
        for place in divide_skip(InvertedLists(rest), query, percent):
            yield held[1 + place][3], held[0][3]

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for group in _groups(batches, ("hub", "block", "role", "node", "set"), 2):
            yield _links(links(group))

    return materialise(map_batches(rows, run, "a long, b long"), "links")


def _groups(batches: Iterator[dict], names: tuple[str, ...], keys: int) -> Iterator[list[tuple]]:
    """Rows of sorted batches by their first ``keys`` columns."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(batch[c].to_pylist() for c in names), strict=True):
            if held and row[:keys] != held[0][:keys]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _cross_links(members: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between nodes of one group with different labels; a task emits only what joins labels it has not joined.

    Only nodes outside a group's largest label ask. They are dealt to blocks of their own; each of these meets every
    block of the group, so members of the largest label never meet each other.
    """
    labelled = materialise(members.join(labels, "node"), "labelled")
    by_label = labelled.groupBy("hub", "label").agg(F.sum("n").alias("total"))
    tops = by_label.groupBy("hub").agg(F.max(F.struct("total", "label")).alias("top"), F.sum("total").alias("all"), F.count(F.lit(1)).alias("several"))
    tops = materialise(tops.filter(F.col("several") > 1), "mixed")

    def parts(total):
        return F.ceil(total / F.lit(float(BLOCK_SHINGLES))).cast("int")

    tops = tops.select("hub", F.col("top.label").alias("top"), parts(F.col("all") - F.col("top.total")).alias("few"), parts(F.col("top.total")).alias("many"))
    dealt = labelled.join(tops, "hub").withColumn("asks", F.col("label") != F.col("top"))
    spread = F.xxhash64("node")
    own = F.when(F.col("asks"), F.pmod(spread, F.col("few"))).otherwise(F.col("few") + F.pmod(spread, F.col("many"))).cast("int")
    last = F.when(F.col("asks"), F.col("few") + F.col("many") - 1).otherwise(F.col("few") - 1)
    dealt = dealt.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    dealt = dealt.select("hub", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "label").join(sets, "node")
    names = ("hub", "i", "j", "own", "node", "label", "set")
    rows = dealt.select(*names).repartition("hub", "i", "j").sortWithinPartitions("hub", "i", "j", "own")

    def links(held: list[tuple]) -> Iterator[tuple[int, int]]:
        label = np.array([r[5] for r in held])
        if (label == label[0]).all():
            return
        sets = [np.frombuffer(r[6], np.uint64) for r in held]
        index = InvertedLists(sets)
        for at, row in enumerate(held):
            if row[3] != row[1] or (label == label[at]).all():  # block i asks
                continue
            for other in divide_skip(index, sets[at], percent, label != label[at]):
                if label[other] != label[at]:
                    yield row[4], held[other][4]
                    label[label == label[other]] = label[at]

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for group in _groups(batches, names, 3):
            yield _links(links(group))

    return materialise(map_batches(rows, run, "a long, b long").distinct(), "links")


def similar_documents(docs: DataFrame, percent: int = 85, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id``: one row per row of ``docs``.

    Documents are linked if 100 * intersection >= ``percent`` * union of their sets of 4-word shingles (words as in
    ``words``; fewer than four words are one shingle). ``component_id`` is the smallest id that links reach. Texts that
    are NULL or without words have no shingle and no link. Rows without an id link with nothing and have no component.
    Rows that share an id are judged each by its own text; repeated rows stay. Other columns are ignored, and an empty
    table gives an empty result.

    Equal sets are folded to one node. All documents' shingles are counted over segments of a code space, so each
    document learns which of its shingles others share, and how often. By these frequencies its rarest shingles are its
    shortest inverted lists: linked documents share one. Documents that share a rare shingle are grouped by the smallest of
    them; a group's sets are searched by ``divide_skip``, at first for the smallest, then, in groups whose members are
    still apart, for every member outside the largest component. No pairs of a group are handed on, only links.
    """
    id_type = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).withColumn("copy", F.xxhash64("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    segments = 1 + size // SEGMENT_BYTES
    fields = f"segment int, kind int, chunk long, place int, doc_id {id_type}, copy long, n long, digest binary, a binary, b binary"
    coded = map_batches(rows, lambda batches: _code_rows(batches, segments), fields)
    coded = coded.repartition(segments, "segment").sortWithinPartitions("segment", "kind", "chunk")
    found = materialise(map_batches(coded, _shared_codes, f"{fields}, c binary"), "shared")

    described = found.filter(F.col("kind") == DOCUMENT).select("chunk", "place", "doc_id", "copy", "n", "digest")
    alike = Window.partitionBy("digest").orderBy("doc_id", "copy", "chunk", "place")
    first = described.filter(F.col("digest").isNotNull()).withColumn("rank", F.row_number().over(alike)).filter("rank = 1")
    nodes = materialise(first.drop("rank").withColumn("node", F.monotonically_increasing_id()), "nodes")

    asking = nodes.select("chunk", F.lit(DOCUMENT).alias("kind"), "place", "node", "n")
    shared = found.filter(F.col("kind") == PLACES).select("chunk", F.lit(PLACES + DOCUMENT).alias("kind"), "a", "b", "c")
    asking = asking.unionByName(shared, allowMissingColumns=True).repartition("chunk").sortWithinPartitions("chunk", "kind")
    rare = materialise(map_batches(asking, lambda batches: _rarest(batches, percent), "key long, node long, n long"), "rare")
    hubs = rare.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("high")).filter("hub < high")
    members = materialise(rare.join(hubs, "key").groupBy("hub", "node").agg(F.max("n").alias("n")), "members")
    sets = _sets(members.select("node"), nodes, rows).drop("n")

    links = _star_links(members, sets, percent)
    labels = materialise(components(members.select("node").distinct(), links), "labels")
    more = _cross_links(members, labels, sets, percent)
    if not more.isEmpty():
        labels = components(members.select("node").distinct(), links.unionByName(more))
    named = nodes.select("node", "digest", "doc_id").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    smallest = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    named = materialise(named.join(smallest, "label").select("digest", "component_id"), "components")
    out = described.join(named, "digest", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))
