"""A language model of words and word pairs in a log-frequency Bloom filter, and scores of texts under it.

The filter holds every n-gram and grows with their number: a count c is stored as 1 + floor(log2(c)) entries of
``BITS_PER_ENTRY`` bits, found again by probing until one misses. It lies in segments by hash, a table of one row each.
Up to ``BROADCAST`` bytes, counted before anything is collected, all segments go to every worker; beyond, the n-grams
that texts ask for go to their lots of segments and the answers come back, with the same scores.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableloom.llm.words import WordHashes, lower_words, map_batches, mix, signed, unmix, word_count
from tableloom.session import materialise

END, START = b" end", b" start"  # words hold no blank, so these are none
STORED = 1 << 62  # n-grams with less than such a share of all tokens are left out: none
BROADCAST = 128 << 20  # bytes of a filter that is sent to the workers
PROBES, BITS_PER_ENTRY = 4, 8  # about 2.4 in 100 probes for an absent n-gram hit
FREQUENT = 500_000  # at most so many words have a count of a FREQUENT-th of all tokens
CHUNK = 400_000  # tokens scored at a time
PIECE = 2048  # tokens of a row that waits for answers
ASKED = 1_000_000  # tokens whose n-grams are asked for at a time
COUNTED = 1_000_000  # tokens counted at a time
LOTS, LOT_SEGMENTS = 512, 64  # lots of segments that are counted together; beyond so many lots, they hold as many segments
BLOB = 256  # n-grams in a row on their way to their lot: bounds a batch of rows
HELD = 1 << 22  # partial counts of a lot that a task holds before it adds them up
TOKENS_PER_SEGMENT = 1 << 15
WEIGHT = 0.7  # of the longer n-gram against the shorter one
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _tokens(text: str | None, hashes: WordHashes) -> np.ndarray:
    return hashes.of([*lower_words(text), END])


def _chunks(batches: Iterator[dict], hashes: WordHashes, size: int) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of many documents at once: (row, its batch), tokens, the tokens before them, and places of the rows.

    A document longer than ``size`` is cut; its parts name the same row.
    """
    rows, tokens, before, at, n = [], [], [], [], 0
    start = np.array([hashes[START]], np.uint64)
    for batch in batches:
        for i, x in enumerate(batch["text"]):
            found = _tokens(x.as_py(), hashes)
            previous = np.concatenate((start, found[:-1]))
            for cut in range(0, len(found), size):
                part = found[cut : cut + size]
                rows.append((batch, i))
                tokens.append(part)
                before.append(previous[cut : cut + size])
                at.append(n)
                n += len(part)
                if n >= size:
                    yield rows, np.concatenate(tokens), np.concatenate(before), np.array(at)
                    rows, tokens, before, at, n = [], [], [], [], 0
    if rows:
        yield rows, np.concatenate(tokens), np.concatenate(before), np.array(at)


def _pairs(tokens: np.ndarray, before: np.ndarray) -> np.ndarray:
    return mix(before * _STEP + tokens)


def _segment_of(mixed: np.ndarray, segments: int) -> np.ndarray:
    """The segment is in the first bits of a mixed hash, so sorted ones lie by segment."""
    shift = np.uint64(64 - segments.bit_length() + 1)
    return (mixed >> shift).astype(np.int32) if segments > 1 else np.zeros(len(mixed), np.int32)


def _lots(segments: int) -> int:
    """A constant number as long as a lot's counts are few enough for a task, so rows that travel grow with the input alone."""
    return min(segments, max(LOTS, segments // LOT_SEGMENTS))


def _blobs(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """One binary per run of ``values``; ``starts`` are the places of the runs."""
    ends = (np.append(starts, len(values)) * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(values)])


def _values(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The values of binaries without NULL laid end to end, and their bounds."""
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int32)[column.offset : column.offset + len(column) + 1]
    values = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].view(kind)
    return values, (ends - ends[0]) // values.itemsize


def _cuts(found: np.ndarray, lots: int) -> tuple[np.ndarray, np.ndarray]:
    """The lots of sorted mixed hashes, and places where rows of one lot and at most ``BLOB`` of them start."""
    lot = _segment_of(found, lots)
    return lot, np.union1d(np.flatnonzero(np.diff(lot)) + 1, np.arange(0, len(found), BLOB))


def count_ngrams(texts: DataFrame, lots: int) -> DataFrame:
    """``lot, kind, keys, n``: partial counts; a row holds the mixed hashes, sorted, and counts of n-grams of a chunk and lot.

    Kind 1 are tokens, 0 pairs and the start of a text.
    """

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        hashes = WordHashes()
        for rows, tokens, before, _ in _chunks(batches, hashes, COUNTED):
            first = before[before == np.uint64(hashes[START])]
            for kind, keys in ((1, tokens), (0, np.concatenate((_pairs(tokens, before), first)))):
                found, n = np.unique(mix(keys), return_counts=True)
                lot, starts = _cuts(found, lots)
                yield {
                    "lot": lot[starts],
                    "kind": np.full(len(starts), kind, np.int8),
                    "keys": _blobs(found, starts),
                    "n": _blobs(n.astype(np.uint32), starts),  # a chunk has less than 2 * COUNTED tokens
                }

    return map_batches(texts.select("text"), run, "lot int, kind tinyint, keys binary, n binary")


def _firsts(keys: np.ndarray) -> np.ndarray:
    """Where a key of sorted ones differs from that before it."""
    return np.append(True, keys[1:] != keys[:-1])


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Each key once, sorted, with the sum of its counts."""
    keys, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(keys)
    keys = keys[order]
    starts = np.flatnonzero(_firsts(keys))
    return keys[starts], np.add.reduceat(n[order].astype(np.int64), starts)


def _quantised(n: np.ndarray, least: int) -> np.ndarray:
    return np.frexp(n // least)[1].astype(np.int64)  # the number of binary digits


def _restored(level: np.ndarray, least: int) -> np.ndarray:
    """The middle of the counts that a level stands for; 0 for level 0."""
    return np.where(level > 0, (least * (2.0 ** (level - 1) + 2.0**level) - 1) / 2, 0.0)


def _places(keys: np.ndarray, level: int | np.ndarray, bits: np.ndarray) -> Iterator[np.ndarray]:
    drawn = mix(keys + _STEP * np.atleast_1d(level).astype(np.uint64))
    place, step = drawn & np.uint64(0xFFFFFFFF), (drawn >> np.uint64(32)) | np.uint64(1)
    for _ in range(PROBES):
        yield (place * bits) >> np.uint64(32)
        place = (place + step) & np.uint64(0xFFFFFFFF)


def _segment_filter(keys: np.ndarray, counts: np.ndarray, least: int) -> bytes:
    """The filter of one segment, as large as its own entries ask for."""
    levels = _quantised(counts, least)
    owner = np.repeat(keys, levels)
    ends = np.cumsum(levels)
    level = np.arange(1, len(owner) + 1) - np.repeat(ends - levels, levels)
    bits = 64 * (1 + len(owner) * BITS_PER_ENTRY // 64)
    flags = np.zeros(bits, bool)
    for place in _places(owner, level, np.uint64(bits)):
        flags[place] = True
    return np.packbits(flags, bitorder="little").tobytes()


def _lot(held: dict[int, list], segments: int, least: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, bytes]]]:
    """The tokens of a lot, their counts, and the filters of its segments; ``held`` are partial counts by kind."""
    added = {kind: _added(parts) for kind, parts in held.items()}
    h, n = added.get(1, (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
    keys, counts = (np.concatenate(x) for x in zip(*added.values(), strict=True))
    keys, counts = keys[counts >= least], counts[counts >= least]
    order = np.argsort(keys)
    seg, keys, counts = _segment_of(keys[order], segments), unmix(keys[order]), counts[order]
    edges = [0, *(np.flatnonzero(np.diff(seg)) + 1).tolist(), len(seg)] if len(seg) else []
    filters = [(int(seg[a]), _segment_filter(keys[a:b], counts[a:b], least)) for a, b in zip(edges, edges[1:], strict=False)]
    return unmix(h), n, filters


def _build(counts: DataFrame, segments: int, least: int) -> DataFrame:
    """``kind, h, n, bits``: the counts of all tokens (kind 1), and one filter per segment (kind 2, h the segment, n its bytes).

    ``counts`` as ``count_ngrams`` gives them, all rows of a lot in one task, one lot after the other.
    """

    def rows(tokens: np.ndarray, counted: np.ndarray, filters: list[tuple[int, bytes]]) -> dict:
        bits = [raw for _, raw in filters]
        return {
            "kind": np.repeat(np.array([1, 2], np.int8), [len(tokens), len(bits)]),
            "h": np.concatenate([signed(tokens), np.array([segment for segment, _ in filters], np.int64)]),
            "n": np.concatenate([counted, np.array([len(raw) for raw in bits], np.int64)]),
            "bits": pa.concat_arrays([pa.nulls(len(tokens), pa.binary()), pa.array(bits, pa.binary())]),
        }

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        current, held, size = None, {}, 0
        for batch in batches:
            lot, kind = batch["lot"].to_numpy(), batch["kind"].to_numpy()
            (keys, ends), (n, _) = _values(batch["keys"], np.uint64), _values(batch["n"], np.uint32)
            edges = [0, *(np.flatnonzero((np.diff(lot) != 0) | (np.diff(kind) != 0)) + 1).tolist(), len(lot)]
            for a, b in zip(edges, edges[1:], strict=False):
                if lot[a] != current:
                    if held:
                        yield rows(*_lot(held, segments, least))
                    current, held, size = lot[a], {}, 0
                part = slice(ends[a], ends[b])
                held.setdefault(int(kind[a]), []).append((keys[part], n[part]))
                size += ends[b] - ends[a]
                if size > HELD:
                    held = {k: [_added(parts)] for k, parts in held.items()}
                    size = 0
        if held:
            yield rows(*_lot(held, segments, least))

    return map_batches(counts, run, "kind tinyint, h long, n long, bits binary")


@dataclass
class FrequencyFilter:
    """Segments in one array of bytes: all, or of ``segments`` in all those from ``first`` on."""

    data: np.ndarray
    starts: np.ndarray
    bits: np.ndarray
    least: int
    segments: int | None = None
    first: int = 0

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """The quantised count of each key: the number of probes that hit in a row."""
        return self.levels_of_mixed(mix(keys))

    def levels_of_mixed(self, mixed: np.ndarray) -> np.ndarray:
        seg, keys = _segment_of(mixed, self.segments or len(self.bits)) - self.first, unmix(mixed)
        out, alive, level = np.zeros(len(keys), np.int64), np.flatnonzero(self.bits[seg] > 0), 0
        while len(alive):
            level += 1
            hit = np.ones(len(alive), bool)
            own_bits, own_start = self.bits[seg[alive]], self.starts[seg[alive]]
            for place in _places(keys[alive], level, own_bits):
                hit &= (self.data[own_start + (place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 > 0
            alive = alive[hit]
            out[alive] = level
        return out

    def counts(self, keys: np.ndarray) -> np.ndarray:
        found, place = np.unique(mix(keys), return_inverse=True)  # by segment, so one's bits are read while they are near
        return _restored(self.levels_of_mixed(found), self.least)[place]


@dataclass
class Model:
    """``tokens``: a table (h, n) of exact counts; ``words`` and ``counts``: the frequent ones of it, sorted.

    ``filter`` is None if it is too large to be sent; ``parts`` (seg, bits) are its ``segments`` as a table.
    """

    filter: FrequencyFilter | None
    parts: DataFrame
    segments: int
    least: int
    tokens: DataFrame
    words: np.ndarray
    counts: np.ndarray
    total: int
    distinct: int


def train(
    docs: DataFrame, text: str = "text", stored: int = STORED, frequent: int = FREQUENT, broadcast: int = BROADCAST
) -> Model:
    """Count the tokens and pairs of all texts and store them in the filter.

    Tasks count what they read and shuffle rows of some hundred distinct n-grams of a chunk; one shuffle by
    lots of segments adds the counts up and lays out each segment's bits. A filter of at most ``broadcast`` bytes is collected in segments and sent
    to the workers, a larger one stays a table. Exact counts stay a table: only words with at least a ``frequent``-th
    of all tokens leave it, at most ``frequent`` of them. N-grams with less than a ``stored``-th of all tokens are left
    out of the filter; by default none is.
    """
    texts = docs.select(F.col(text).alias("text"))
    total = texts.agg(F.coalesce(F.sum(word_count(F.col("text"))), F.lit(0)) + F.count(F.lit(1))).first()[0]
    segments = 1 << (total // TOKENS_PER_SEGMENT).bit_length()
    least = max(1, -(-total // stored))
    counts = count_ngrams(texts, _lots(segments)).repartition("lot").sortWithinPartitions("lot", "kind")
    stats = materialise(_build(counts, segments, least), "ngrams", free=True)
    tokens = stats.filter(F.col("kind") == 1).select("h", "n")
    common = tokens.filter(F.col("n") * frequent >= total).toArrow().sort_by("h")
    held = stats.filter(F.col("kind") == 2)
    parts = held.select(F.col("h").cast("int").alias("seg"), "bits")
    size = held.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    built = _laid_out(parts.toLocalIterator(), size, segments, least, 0, segments) if size + 16 * segments <= broadcast else None
    words, counts = common["h"].to_numpy(), common["n"].to_numpy()
    return Model(built, parts, segments, least, tokens, words, counts, total, tokens.count())


def _laid_out(parts: Iterable[tuple[int, bytes]], size: int, segments: int, least: int, first: int, held: int) -> FrequencyFilter:
    """The filter of ``held`` segments from ``first`` on; ``parts`` are their bits, ``size`` bytes in all."""
    bits, starts = np.zeros(held, np.uint64), np.zeros(held, np.int64)
    data, end = np.zeros(size, np.uint8), 0
    for seg, raw in parts:
        data[end : end + len(raw)] = np.frombuffer(raw, np.uint8)
        bits[seg - first], starts[seg - first] = len(raw) * 8, end
        end += len(raw)
    return FrequencyFilter(data, starts, bits, least, segments, first)


@dataclass
class _Scorer:
    """What every worker gets."""

    words: np.ndarray
    counts: np.ndarray
    below: int

    def codes(self, keys: np.ndarray) -> np.ndarray:
        """1 + the place of each word (sorted, signed hashes) among the frequent ones, or 0."""
        place = np.minimum(np.searchsorted(self.words, keys), max(0, len(self.words) - 1))
        return np.where(self.words[place] == keys, place + 1, 0) if len(self.words) else np.zeros(len(keys), np.int64)

    def sums(self, count: np.ndarray, word: np.ndarray, context: np.ndarray, pair: np.ndarray, at: np.ndarray) -> dict:
        """Columns of the rows that start at ``at``; ``count`` are exact, ``word``, ``context`` and ``pair`` the filter's counts."""
        alone = (word + 1) / self.below
        chance = WEIGHT * np.minimum(1.0, pair / np.maximum(context, 1)) + (1 - WEIGHT) * alone
        chance = np.log10(np.where(context > 0, chance, alone))
        ends = np.append(at[1:], len(count))
        return {
            "n_tokens": ends - at,
            "n_known": np.add.reduceat((count > 0).astype(np.int64), at),
            "base": np.add.reduceat(np.log10((count + 1) / self.below), at),
            "chance": np.add.reduceat(chance, at),
        }

    def parted(self, tokens: np.ndarray, word: np.ndarray, context: np.ndarray, pair: np.ndarray, at: np.ndarray) -> dict:
        """Sums in which words that are not frequent count as 1 less ``below``: nothing; they are ``rare``, to be looked up."""
        key = signed(tokens)
        own, back = np.unique(key, return_inverse=True)
        code = self.codes(own)[back]
        sums = self.sums(np.append(self.below - 1, self.counts)[code], word, context, pair, at)
        others = code == 0
        rare = np.append(0, np.cumsum(others))[np.append(at, len(key))].astype(np.int32)
        return sums | {"n_known": sums["n_tokens"] - np.diff(rare), "rare": pa.ListArray.from_arrays(pa.array(rare), pa.array(key[others]))}


def _texts(rows: DataFrame, id_type: str, shared: Broadcast[_Scorer]) -> DataFrame:
    """Tokens of texts in pieces: numbered in the order they were read, ``chunk`` by chunk of about ``ASKED`` tokens.

    ``codes`` are 1 + the places of frequent words or 0, the low bytes of all before the next ones; ``others`` are the hashes
    of the rest, ``first`` is that of the token before the piece.
    """

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        hashes, chunk, number, size = WordHashes(), TaskContext.get().partitionId() << 33, 0, 0
        for found, tokens, before, at in _chunks(batches, hashes, CHUNK):
            ends = np.append(at[1:], len(tokens))
            cuts = [(b, i, c, min(c + PIECE, end)) for (b, i), start, end in zip(found, at, ends, strict=True) for c in range(start, end, PIECE)]
            key = signed(tokens)
            own, back = np.unique(key, return_inverse=True)
            code = shared.value.codes(own)[back].astype("<u4")
            chunks = []
            for *_, start, end in cuts:
                chunks.append(chunk)
                size += end - start
                if size >= ASKED:
                    chunk, size = chunk + 1, 0
            yield {
                "chunk": chunks,
                "at": np.arange(number, number + len(cuts)),
                "row": [b["row"][i].as_py() for b, i, _, _ in cuts],
                "doc_id": [b["doc_id"][i].as_py() for b, i, _, _ in cuts],
                "first": signed(before[[start for _, _, start, _ in cuts]]),
                "codes": [code[a:b].view(np.uint8).reshape(-1, 4).T.tobytes() for _, _, a, b in cuts],
                "others": [key[a:b][code[a:b] == 0].tobytes() for _, _, a, b in cuts],
            }
            number += len(cuts)

    return map_batches(rows, run, f"chunk long, at long, row long, doc_id {id_type}, first long, codes binary, others binary")


def _group(pieces: list[tuple[pa.Scalar, ...]], words: np.ndarray) -> tuple[np.ndarray, ...]:
    """Tokens of the pieces (first, codes, others), the tokens before them, places of the pieces, and the codes."""
    planes = [np.frombuffer(codes.as_buffer(), np.uint8).reshape(4, -1).T for _, codes, _ in pieces]
    at = np.append(0, np.cumsum([len(x) for x in planes]))[:-1]
    code = np.ascontiguousarray(np.concatenate(planes)).view("<u4")[:, 0].astype(np.int64)
    tokens = np.append(0, words)[code]
    tokens[code == 0] = np.concatenate([np.frombuffer(others.as_buffer(), np.int64) for _, _, others in pieces])
    tokens = tokens.view(np.uint64)
    before = np.append(np.uint64(0), tokens[:-1])
    before[at] = np.array([first.as_py() for first, _, _ in pieces], np.int64).view(np.uint64)
    return tokens, before, at, code


def _asked_of(tokens: np.ndarray, before: np.ndarray, at: np.ndarray, code: np.ndarray) -> list[np.ndarray]:
    """Mixed hashes of words that are not frequent, and of all other n-grams: frequent words, tokens before a piece, and pairs."""
    return [mix(tokens[code == 0]), mix(np.concatenate((tokens[code > 0], before[at], _pairs(tokens, before))))]


def _asked(texts: DataFrame, lots: int, shared: Broadcast[_Scorer]) -> DataFrame:
    """``lot, chunk, at, part, keys``: a row holds n-grams of a group and lot, mixed and sorted; parts are a group's n-grams in order.

    Parts below 0 are words whose exact count is asked for, too. A group are pieces of a chunk that a task reads one
    after the other, ``at`` is its first one: a chunk is several groups if tasks share it.
    """

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        pieces, start, end = [], None, None

        def rows() -> Iterator[dict]:
            for sign, found in zip((-1, 1), _asked_of(*_group(pieces, shared.value.words)), strict=True):
                found = np.sort(found)  # np.unique hashes first, which takes far longer
                found = found[_firsts(found)] if len(found) else found
                lot, starts = _cuts(found, lots)
                n = len(starts)
                part = np.arange(n) if sign > 0 else np.arange(-n, 0)
                yield {"lot": lot[starts], "chunk": np.full(n, start[0]), "at": np.full(n, start[1]), "part": part, "keys": _blobs(found, starts)}

        for batch in batches:
            places = zip(batch["chunk"].to_pylist(), batch["at"].to_pylist(), strict=True)
            for place, *piece in zip(places, batch["first"], batch["codes"], batch["others"], strict=True):
                if place != end:
                    if pieces:
                        yield from rows()
                    pieces, start = [], place
                pieces.append(piece)
                end = (place[0], place[1] + 1)
        if pieces:
            yield from rows()

    return map_batches(texts.select("chunk", "at", "first", "codes", "others"), run, "lot int, chunk long, at long, part int, keys binary")


def _packed(tokens: DataFrame, lots: int) -> DataFrame:
    """``lot, keys, n``: mixed hashes of words of a lot and their counts; the table has a lot's words one after the other."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            mixed = mix(batch["h"].to_numpy().view(np.uint64))
            lot = _segment_of(mixed, lots)
            starts = np.flatnonzero(_firsts(lot))
            yield {"lot": lot[starts], "keys": _blobs(mixed, starts), "n": _blobs(batch["n"].to_numpy(), starts)}

    return map_batches(tokens, run, "lot int, keys binary, n binary")


def _answers(asked: DataFrame, model: Model) -> DataFrame:
    """``chunk, at, part, levels, n``: each lot's filters and words come first and what groups ask of them streams by.

    ``n`` are exact counts, for parts below 0.
    """
    segments, lots, least = model.segments, _lots(model.segments), model.least
    each = segments // lots
    zero, no = F.lit(0).cast("long"), F.lit(b"").alias("n")

    def dealt(df: DataFrame, lot: Column, role: int, chunk: Column, at: Column, part: Column, data: str, n: Column) -> DataFrame:
        names = (lot.alias("lot"), F.lit(role).alias("role"), chunk.alias("chunk"), at.alias("at"), part.alias("part"), F.col(data).alias("data"), n)
        return df.select(*names)

    bits = dealt(model.parts, F.floor(F.col("seg") / each).cast("int"), 0, zero, zero, F.col("seg"), "bits", no)
    words = dealt(_packed(model.tokens, lots), F.col("lot"), 1, zero, zero, F.lit(0), "keys", F.col("n"))
    asked = dealt(asked, F.col("lot"), 2, F.col("chunk"), F.col("at"), F.col("part"), "keys", no)
    rows = asked.unionByName(bits).unionByName(words).repartition("lot").sortWithinPartitions("lot", "role")

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        current, bits, words, own = None, [], [], None
        for batch in batches:
            lot, role = batch["lot"].to_numpy(), batch["role"].to_numpy()
            edges = [0, *(np.flatnonzero((np.diff(lot) != 0) | (np.diff(role) != 0)) + 1).tolist(), len(lot)]
            for a, b in zip(edges, edges[1:], strict=False):
                if lot[a] != current:
                    current, bits, words, own = lot[a], [], [], None
                data = batch["data"].slice(a, b - a)
                if role[a] == 0:
                    bits += zip(batch["part"].slice(a, b - a).to_pylist(), data.to_pylist(), strict=True)
                    continue
                keys, ends = _values(data, np.uint64)
                if role[a] == 1:
                    words.append((keys, _values(batch["n"].slice(a, b - a), np.int64)[0]))
                    continue
                if own is None:
                    own, bits = _laid_out(bits, sum(len(raw) for _, raw in bits), segments, least, int(current) * each, each), []
                    known, counts = _added(words) if words else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
                exact = np.repeat(batch["part"].slice(a, b - a).to_numpy() < 0, np.diff(ends))
                n = _looked_up(keys[exact], known, counts)
                places = np.append(0, np.cumsum(exact))[ends[:-1]]
                names = {c: batch[c].slice(a, b - a) for c in ("chunk", "at", "part")}
                yield names | {"levels": _blobs(own.levels_of_mixed(keys).astype(np.int8), ends[:-1]), "n": _blobs(n, places)}

    return map_batches(rows, run, "chunk long, at long, part int, levels binary, n binary")


def _looked_up(keys: np.ndarray, known: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The count of each key, 0 if it is none of the sorted ``known`` ones."""
    if not len(known):
        return np.zeros(len(keys), np.int64)
    place = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[place] == keys, counts[place], 0)


def _spread(keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """For each key its value; ``values`` are those of the distinct keys in order."""
    order = np.argsort(keys)
    place = np.cumsum(_firsts(keys[order])) - 1 if len(keys) else order
    assert len(values) == (place[-1] + 1 if len(place) else 0)
    out = np.empty(len(keys), values.dtype)
    out[order] = values[place]
    return out


def _score_by_shuffle(rows: DataFrame, model: Model, id_type: str, scorer: _Scorer, schema: str) -> DataFrame:
    """The n-grams of each group are asked for once, in few rows, and levels and counts come back alone, in the n-grams' order.

    A task holds one group's answers and pieces. Texts and answers are written, so what is shuffled before goes once they are.
    """
    least = model.least
    shared = rows.sparkSession.sparkContext.broadcast(scorer)
    texts = materialise(_texts(rows, id_type, shared), "texts", free=True, compression="zstd")
    asked = _asked(texts, _lots(model.segments), shared)
    answers = materialise(_answers(asked, model), "answers", free=True, compression="zstd")
    nothing = [F.lit(None).cast(texts.schema[c].dataType).alias(c) for c in ("row", "doc_id", "first", "codes", "others")]
    answers = answers.select("chunk", "at", F.lit(0).alias("role"), "part", "levels", "n", *nothing)
    texts = texts.select(
        "chunk", "at", F.lit(1).alias("role"), F.lit(0).alias("part"), F.lit(b"").alias("levels"), F.lit(b"").alias("n"),
        "row", "doc_id", "first", "codes", "others",
    )
    both = answers.unionByName(texts).repartition("chunk").sortWithinPartitions("chunk", "at", "role", "part")

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        levels, exact, pieces, names = ([], []), [], [], {"row": [], "doc_id": []}

        def rows() -> dict:
            tokens, before, at, code = _group(pieces, shared.value.words)
            rare, other = _asked_of(tokens, before, at, code)
            level = [np.concatenate([np.zeros(0, np.int8), *x]).astype(np.int64) for x in levels]
            rare_word, other = (_spread(x, _restored(y, least)) for x, y in zip((rare, other), level, strict=True))
            frequent = len(tokens) - len(rare)
            word, before_piece, pair = np.empty(len(tokens)), other[frequent : frequent + len(at)], other[frequent + len(at) :]
            word[code == 0], word[code > 0] = rare_word, other[:frequent]
            context = np.append(word[:1], word[:-1])
            context[at] = before_piece
            count = np.append(0, shared.value.counts)[code]
            count[code == 0] = _spread(rare, np.concatenate([np.zeros(0, np.int64), *exact]))
            return names | shared.value.sums(count, word, context, pair, at)

        for batch in batches:
            role = batch["role"].to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(role) != 0) + 1).tolist(), len(role)]
            for a, b in zip(edges, edges[1:], strict=False):
                part = {c: x.slice(a, b - a) for c, x in batch.items()}
                if role[a] == 0:
                    if pieces:  # of the group before
                        yield rows()
                        levels, exact, pieces, names = ([], []), [], [], {"row": [], "doc_id": []}
                    values, ends = _values(part["levels"], np.int8)
                    cut = ends[np.searchsorted(part["part"].to_numpy(), 0)]
                    levels[0].append(values[:cut])
                    levels[1].append(values[cut:])
                    exact.append(_values(part["n"], np.int64)[0])
                else:
                    pieces += zip(part["first"], part["codes"], part["others"], strict=True)
                    for c, own in names.items():
                        own += part[c].to_pylist()
        if pieces:
            yield rows()

    return map_batches(both, run, schema)


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` for every row.

    Tokens are the words, A-Z lower-cased, and one end; NULL reads as empty and has the end alone. ``base_score`` adds
    log10((c + 1) / (N + V + 1)) with exact counts. ``score`` is the log10 probability under the interpolated model,
    ``WEIGHT * c(vw) / c(v) + (1 - WEIGHT) * (c(w) + 1) / (N + V + 1)`` with counts as the filter tells them, or the last
    term alone after a word it doesn't hold. A model of no text has N = V = 0. Rows that repeat an id are scored each
    by its own text; other columns are ignored.

    Frequent words are looked up where the text is read. The others leave as hashes and meet the exact counts in a
    join; none of them has more than a small share of the training tokens. Beside a filter that is not sent, they are
    asked for with the n-grams.
    """
    spark = docs.sparkSession
    below = model.total + model.distinct + 1
    scorer = _Scorer(model.words, model.counts, below)
    id_type = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text")
    )

    schema = f"row long, doc_id {id_type}, n_tokens long, n_known long, base double, chance double"
    if model.filter is None:
        parts = materialise(_score_by_shuffle(rows, model, id_type, scorer, schema), "scores", free=True)
    else:
        shared = spark.sparkContext.broadcast((model.filter, scorer))

        def run(batches: Iterator[dict]) -> Iterator[dict]:
            lm, own = shared.value
            hashes = WordHashes()
            for found, tokens, before, at in _chunks(batches, hashes, CHUNK):
                names = {c: [b[c][i].as_py() for b, i in found] for c in ("row", "doc_id")}
                word = lm.counts(tokens)
                context = np.append(word[:1], word[:-1])  # but for a text's first, a token's context is the token before it
                context[at] = lm.counts(before[at])
                yield names | own.parted(tokens, word, context, lm.counts(_pairs(tokens, before)), at)

        parts = materialise(map_batches(rows, run, f"{schema}, rare array<long>"), "scores", free=True)
        asked = parts.select("row", "doc_id", F.explode("rare").alias("h")).join(model.tokens, "h", "left")
        n = F.coalesce("n", F.lit(0))
        looked_up = asked.select(
            "row",
            "doc_id",
            F.lit(0).cast("long").alias("n_tokens"),
            (n > 0).cast("long").alias("n_known"),
            F.log10((n + 1) / F.lit(float(below))).alias("base"),
            F.lit(0.0).alias("chance"),
        )
        parts = parts.drop("rare").unionByName(looked_up)
    sums = parts.groupBy("row", "doc_id")
    out = sums.agg(*[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base", "chance")])
    return out.select(
        "doc_id", "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"),
        F.col("base").alias("base_score"), F.col("chance").alias("score"),
    )
