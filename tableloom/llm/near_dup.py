"""Near duplicates: banded MinHash candidates, sequential Bayesian pruning, exact confirmation."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import cache
from math import ceil, comb, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tableloom.llm.bloom import BlockedBloom
from tableloom.llm.components import components
from tableloom.llm.words import WordHashes, lower_words, map_batches, mix
from tableloom.session import materialise

WIDTH = 5  # words of a shingle
BAND_ROWS = 5
BATCH = 24  # signature values compared between two looks at the posterior
MISS = 1e-6  # probability of losing a pair at the threshold by its bands, and the posterior one at each look
BLOCK_SHINGLES = 1 << 20  # shingles of a block of nodes
PAIRS_PER_BLOCK = 4096
CHUNK = 512  # shingles hashed at a time


def bands(percent: int) -> int:
    """So many that a pair of this similarity shares none with a chance of at most ``MISS``: 24 at 85, 35 at 80."""
    return 1 if percent >= 100 else ceil(log(MISS) / log(1 - (percent / 100) ** BAND_ROWS))


HASHES = bands(85) * BAND_ROWS


@cache
def _families(size: int) -> tuple[np.ndarray, np.ndarray]:
    drawn = np.random.Generator(np.random.PCG64(2024)).integers(0, 1 << 63, (2, size), dtype=np.uint64)
    return drawn[0] * np.uint64(2) + np.uint64(1), drawn[1]


def shingles(text: str | None, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; fewer words are one shingle, no words none."""
    words = lower_words(text)
    if not words:
        return np.zeros(0, np.uint64)
    coded = hashes.of(words)
    width = min(WIDTH, len(coded))
    code = np.full(len(coded) - width + 1, width, np.uint64)
    for k in range(width):
        code = mix(code + coded[k : len(coded) - width + 1 + k])
    return np.unique(code)


def signature(found: np.ndarray, size: int = HASHES) -> np.ndarray:
    """MinHash values, 32 bits each."""
    factor, shift = _families(size)
    short = found >> np.uint64(32)
    least = np.full(size, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(short), CHUNK):
        np.minimum(least, (short[start : start + CHUNK, None] * factor + shift).min(axis=0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


@cache
def least_matches(percent: int, miss: float = MISS) -> tuple[int, ...]:
    """After 1 x, 2 x, ... ``BATCH`` compared values, the fewest equal ones with which a pair goes on.

    With a uniform prior the similarity after m of n equal values is Beta(m + 1, n - m + 1) distributed, and the
    probability that it reaches t is that of at most m successes in n + 1 draws of chance t.
    """
    t, out = percent / 100, []
    for n in range(BATCH, bands(percent) * BAND_ROWS + 1, BATCH):
        chance, m = 0.0, -1
        while chance < miss:
            m += 1
            chance += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append(m)
    return tuple(out)


def _likely(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of rows survive all looks; a pair that fails one is not compared further."""
    alive, matches = np.arange(len(a)), np.zeros(len(a), np.int32)
    for look, least in enumerate(least_matches(percent)):
        part = slice(look * BATCH, (look + 1) * BATCH)
        matches = matches + (a[alive, part] == b[alive, part]).sum(axis=1)
        alive, matches = alive[matches >= least], matches[matches >= least]
    out = np.zeros(len(a), bool)
    out[alive] = True
    return out


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.uint32)


def _describe(batches: Iterator[dict], size: int) -> Iterator[dict]:
    hashes = WordHashes()
    for batch in batches:
        sizes, digests, signatures = [], [], []
        for x in batch["text"]:
            found = shingles(x.as_py(), hashes)
            sizes.append(len(found))
            digests.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
            signatures.append(signature(found, size).tobytes() if len(found) else None)
        yield {
            "doc_id": batch["doc_id"],
            "copy": batch["copy"],
            "n": pa.array(sizes, pa.int64()),
            "digest": pa.array(digests, pa.binary()),
            "sig": pa.array(signatures, pa.binary()),
        }


def _prune(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sizes and signatures leave a similarity of ``percent`` likely enough."""
    side = nodes.select("node", "n", "sig")
    both = pairs.join(side.withColumnsRenamed({"node": "a", "n": "na", "sig": "sa"}), "a")
    both = both.join(side.withColumnsRenamed({"node": "b", "n": "nb", "sig": "sb"}), "b")
    both = both.filter(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            keep = pa.array(_likely(_signatures(batch["sa"]), _signatures(batch["sb"]), percent))
            yield {"a": batch["a"].filter(keep), "b": batch["b"].filter(keep)}

    return map_batches(both.select("a", "b", "sa", "sb"), run, "a long, b long")


def _texts_of(asked: DataFrame, texts: DataFrame) -> DataFrame:
    """``asked`` (doc_id, copy, ...) with ``text``; a Bloom filter keeps all other texts out of the shuffle."""
    bloom = BlockedBloom.build(asked.select("copy").distinct(), "copy")
    if bloom:
        texts = texts.filter(bloom.possible(texts.sparkSession, F.col("copy")))
    return asked.join(texts, ["doc_id", "copy"])


def _same(held: np.ndarray, found: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets are similar enough."""
    at = np.searchsorted(held, found)
    at[at == len(held)] = 0
    common = int((held[at] == found).sum())
    return 100 * common >= percent * (len(held) + len(found) - common)


def _confirm(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full shingle sets are similar enough.

    The partners of a hub ``b`` are dealt to blocks; in each, the hub's text comes first and its partners stream by,
    so a task holds one hub and one batch of texts.
    """
    pairs = materialise(pairs, "pairs")
    blocks = 1 + pairs.count() // PAIRS_PER_BLOCK
    dealt = pairs.withColumn("block", F.pmod(F.xxhash64("a"), F.lit(blocks)))
    asked = dealt.select("b", "block", F.col("a").alias("node"), F.lit(1).alias("role"))
    hubs = dealt.select("b", "block", F.col("b").alias("node"), F.lit(0).alias("role")).distinct()
    asked = materialise(asked.unionByName(hubs).join(nodes.select("node", "doc_id", "copy"), "node"), "asked")
    rows = _texts_of(asked, texts).select("b", "block", "role", "node", "text")
    rows = rows.repartition("b", "block").sortWithinPartitions("b", "block", "role")

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        hashes, hub, held = WordHashes(), None, np.zeros(0, np.uint64)
        for batch in batches:
            left, right = [], []
            names = (batch[c].to_pylist() for c in ("b", "block", "role", "node"))
            for b, block, role, node, x in zip(*names, batch["text"], strict=True):
                found = shingles(x.as_py(), hashes)
                if role == 0:
                    hub, held = (b, block), found
                    continue
                assert hub == (b, block)
                if _same(held, found, percent):
                    left.append(node)
                    right.append(b)
            yield {"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())}

    return materialise(map_batches(rows, run, "a long, b long"), "links")


def _sets(wanted: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """``node, n, sig, set`` of the wanted nodes; ``set`` holds the shingles' hashes."""
    asked = nodes.join(wanted, "node", "left_semi")
    rows = _texts_of(asked, texts).select("node", "n", "sig", "text")

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        hashes = WordHashes()
        for batch in batches:
            found = [shingles(x.as_py(), hashes).tobytes() for x in batch["text"]]
            yield {k: batch[k] for k in ("node", "n", "sig")} | {"set": pa.array(found, pa.binary())}

    return materialise(map_batches(rows, run, "node long, n long, sig binary, set binary"), "sets")


def _link_across(members: DataFrame, percent: int) -> DataFrame:
    """Links between nodes with different labels in the buckets of ``members`` (key, band, blocks, node, label, n, sig, set).

    A bucket is cut into blocks of bounded size, and every two blocks meet in a group of their own. A pair is looked
    at in its first common band only; a task emits no pairs but the links that join labels it has not joined yet.
    """
    dealt = members.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int"))))
    names = ("key", "i", "j", "band", "own", "node", "label", "n", "sig", "set")
    dealt = dealt.select("*", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).select(*names)
    dealt = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def links(rows: list[tuple]) -> Iterator[tuple[int, int]]:
        if len({r[6] for r in rows}) < 2:
            return
        band, one_block = rows[0][3] * BAND_ROWS, rows[0][1] == rows[0][2]
        own, node, label, n = (np.array([r[k] for r in rows]) for k in (4, 5, 6, 7))
        sig = np.frombuffer(b"".join(r[8] for r in rows), np.uint32).reshape(len(rows), -1)
        sets = [np.frombuffer(r[9], np.uint64) for r in rows]
        for at in range(len(rows) - 1):
            rest = slice(at + 1, None)
            fit = (label[rest] != label[at]) & (100 * np.minimum(n[rest], n[at]) >= percent * np.maximum(n[rest], n[at]))
            if not one_block:
                fit &= own[rest] != own[at]
            found = at + 1 + np.flatnonzero(fit)
            if band and len(found):
                earlier = (sig[found, :band] == sig[at, :band]).reshape(len(found), -1, BAND_ROWS)
                found = found[~earlier.all(axis=2).any(axis=1)]
            if len(found):
                found = found[_likely(sig[found], np.broadcast_to(sig[at], (len(found), sig.shape[1])), percent)]
            for other in found:
                if label[other] != label[at] and _same(sets[at], sets[other], percent):
                    yield int(node[at]), int(node[other])
                    label[label == label[other]] = label[at]

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        key, held = None, []
        for batch in batches:
            found = []
            for row in zip(*(batch[c].to_pylist() for c in names), strict=True):
                if row[:3] != key:
                    found += links(held)
                    key, held = row[:3], []
                held.append(row)
            yield _pairs(found)
        yield _pairs(list(links(held)))

    return materialise(map_batches(dealt, run, "a long, b long").distinct(), "links")


def _pairs(found: list[tuple[int, int]]) -> dict:
    return {"a": pa.array([x[0] for x in found], pa.int64()), "b": pa.array([x[1] for x in found], pa.int64())}


def near_duplicates(
    docs: DataFrame, percent: int = 85, doc_id: str = "doc_id", text: str = "text", with_copy: bool = False
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``, and if asked ``copy`` (``xxhash64`` of the text): one row per row of ``docs``.

    Documents are linked if 100 * intersection >= ``percent`` * union of their sets of 5-word shingles (words as in
    ``words``; fewer than five words are one shingle). ``component_id`` is the smallest id that links reach, and
    ``kept`` marks the rows that hold it. Texts that are NULL or without words have no shingle and no link. Rows
    without an id link with nothing, have no component and are kept. Rows that share an id are judged each by its own
    text. Other columns are ignored.

    Equal sets are folded to one node first. Candidates share a band of the MinHash signature. Every node of a band's
    bucket is compared with the bucket's smallest node; links found so far give components, and only nodes of
    different components meet in a second comparison of the same buckets, in blocks that bring their sets along and
    emit only what joins components. So no pairs of a group leave a task, and no link between components is lost. A
    comparison looks at the signatures in batches and drops a pair once its posterior chance of reaching ``percent``
    is below ``MISS``; the survivors' full sets decide.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).withColumn("copy", F.xxhash64("text"))
    id_type = docs.schema[doc_id].dataType.simpleString()
    size = bands(percent) * BAND_ROWS
    described = map_batches(rows, lambda batches: _describe(batches, size), f"doc_id {id_type}, copy long, n long, digest binary, sig binary")
    described = materialise(described, "described")
    alike = Window.partitionBy("digest").orderBy("doc_id", "copy")
    usable = described.filter((F.col("n") > 0) & F.col("doc_id").isNotNull())
    nodes = usable.withColumn("rank", F.row_number().over(alike)).filter(F.col("rank") == 1).drop("rank")
    nodes = materialise(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    keys = [
        F.xxhash64(F.lit(b), F.substring("sig", b * BAND_ROWS * 4 + 1, BAND_ROWS * 4)) for b in range(bands(percent))
    ]
    banded = nodes.select("node", "n", F.posexplode(F.array(*keys)).alias("band", "key"))
    total = F.sum("n").alias("total")
    hubs = banded.groupBy("key").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("count"), total)
    hubs = materialise(hubs.filter(F.col("count") > 1), "hubs")
    shared = materialise(banded.join(hubs, "key"), "buckets")
    stars = shared.filter(F.col("node") != F.col("hub")).select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    links = _confirm(_prune(stars, nodes, percent), nodes, rows, percent)
    labels = components(nodes, links)
    labelled = materialise(shared.filter(F.col("count") > 2).drop("n").join(labels, "node"), "labelled")
    mixed = labelled.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    mixed = materialise(mixed.filter(F.col("low") != F.col("high")).select("key"), "mixed")
    members = materialise(labelled.join(mixed, "key"), "members")
    blocks = F.ceil(F.col("total") / F.lit(float(BLOCK_SHINGLES))).cast("long")
    members = members.withColumn("blocks", blocks).join(_sets(members.select("node"), nodes, rows), "node")
    more = _link_across(members, percent)
    if not more.isEmpty():
        labels = components(nodes, links.unionByName(more))
    labels = materialise(labels, "labels")
    smallest = nodes.join(labels, "node").groupBy("label").agg(F.min("doc_id").alias("component_id"))
    named = nodes.select("node", "digest").join(labels, "node").join(smallest, "label").select("digest", "component_id")
    named = materialise(named, "components")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    out = described.drop("sig").join(named, "digest", "left").withColumn("component_id", own)
    kept = F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id"))
    copies = ["copy"] if with_copy else []
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", kept.alias("kept"), *copies)
