"""Structure repair of conversations: cheapest edits by a cost DP, the least audit by prefix-doubling path ranking.

A conversation's roles must read ``(s?(ua)+)?`` (s, u, a being the first letters of system, user, assistant). The states
of that automaton are 0 (nothing yet), 1 (after s), 2 (after u) and 3 (after a); it may end in 0 and 3. A node of the
edit graph is a place between rows and a state; an arc is an edit. Every node has at most one arc per letter, so an
audit names a path.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tableloom.llm.words import WHITE, map_batches
from tableloom.session import materialise

CHUNK = 4096  # rows of a conversation that are repaired at a time
GRAPH_ROWS = 1 << 16  # rows of all chunks in one graph
SOUND, TRUNCATED, DUPLICATE, BLANK = range(4)  # a row's first fault; a symbol is 4 * fault + initial
INITIALS = "sua"  # 0, 1, 2; any other is 3
LETTERS = b"DIKR"
DELETE, INSERT, KEEP, REROLE = LETTERS
DELETE_COST, INSERT_COST, REROLE_COST, TRUNCATED_COST = 3, 2, 2, 1
FAR = 1 << 40  # cost of what cannot be
AFTER = np.array([[1, 2, FAR, FAR], [FAR, 2, FAR, FAR], [FAR, FAR, 3, FAR], [FAR, 2, FAR, FAR]])  # state after keeping an initial
NEXT = np.array([2, 2, 3, 2])  # state after an inserted or changed row
ENDS = np.array([0, 4, 2, 0], np.int64)  # cost of the rows that are still missing at the end
MISSING = ["", "II", "I", ""]
ROLES = {2: "user", 3: "assistant"}  # by the state they lead to


def damage(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with planted faults, by crc32 of ``conv_id:turn`` modulo 20; a NULL reads as one space.

    0 drops the row, 1 empties its text, 2 takes ``.``, ``!`` and ``?`` out, 3 repeats the row, 4 makes it the user's.
    """
    name = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    drawn = F.crc32(name.cast("binary")) % 20
    text = F.coalesce("text", F.lit(" "))
    text = F.when(drawn == 1, "").when(drawn == 2, F.translate(text, ".!?", "")).otherwise(text)
    role = F.when(drawn == 4, "user").otherwise(F.coalesce("role", F.lit(" ")))
    times = F.when(drawn == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("times"), drawn.alias("drawn"))
    return rows.filter(F.col("drawn") != 0).withColumn("_time", F.explode("times")).select("conv_id", "turn", "role", "text")


def _same(left: str, right: str) -> Column:
    return F.col(left).eqNullSafe(F.col(right))


def _faults(rows: DataFrame) -> DataFrame:
    """Distinct rows with ``copies``, ``fault`` and whether they are ``first`` with their role and text."""
    held = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("copies"))
    held = materialise(held.withColumn("said", F.md5(F.concat_ws(":", F.length("role").cast("string"), "role", "text").cast("binary"))), "rows")
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    first = held.groupBy(F.col("conv_id").alias("_conv"), F.col("said").alias("_said")).agg(F.min(place).alias("_place"))
    same = _same("conv_id", "_conv") & (F.col("said") == F.col("_said"))
    ended = F.rtrim("text", F.lit(WHITE))
    end = F.right(ended, F.lit(1))
    fault = F.when(ended == "", BLANK).when(~end.isin(".", "!", "?"), TRUNCATED).otherwise(SOUND)
    out = held.join(first, same).withColumn("first", F.col("_place.turn").eqNullSafe(F.col("turn"))).withColumn("fault", fault)
    return out.select("conv_id", "turn", "role", "text", "copies", "first", "fault")


_ROW = ("conv_id", "part", "seq", "place", "role", "text", "symbols", "letters", "entry")


def _table(size: int, **given: list) -> dict:
    return {c: given.get(c, [None] * size) for c in _ROW}


def _chunks(batches: Iterator[dict]) -> Iterator[dict]:
    """Sorted rows, each with the chunk and the place it has there, and one row (place -1) per chunk with its symbols."""
    part, seq, conv, symbols = TaskContext.get().partitionId(), 0, None, bytearray()
    for batch in batches:
        rows = []
        for at, (own, role, copies, first, fault) in enumerate(zip(*(batch[c].to_pylist() for c in ("conv_id", "role", "copies", "first", "fault")), strict=True)):
            if symbols and own != conv:
                rows.append((conv, part, seq, -1, None, None, bytes(symbols), None, None))
                symbols, seq = bytearray(), seq + 1
            conv = own
            initial = INITIALS.find(role[:1]) if role else -1
            initial = initial if initial >= 0 else 3
            repeated = 4 * (BLANK if fault == BLANK else DUPLICATE) + initial
            start = 4 * fault + initial if first else repeated
            if start < 4 * DUPLICATE:  # others are deleted, whatever happens
                rows.append((own, part, seq, len(symbols), role, batch["text"][at].as_py(), None, None, None))
            symbols.append(start)
            left = copies - 1
            while left or len(symbols) >= CHUNK:
                if len(symbols) >= CHUNK:
                    rows.append((conv, part, seq, -1, None, None, bytes(symbols), None, None))
                    symbols, seq = bytearray(), seq + 1
                more = min(left, CHUNK - len(symbols))
                symbols += bytes([repeated]) * more
                left -= more
        yield dict(zip(_ROW, zip(*rows, strict=True), strict=True)) if rows else _table(0)
    if symbols:
        yield _table(1, conv_id=[conv], part=[part], seq=[seq], place=[-1], symbols=[bytes(symbols)])


class EditGraph:
    """The edit graphs of several chunks at once, each with the costs from its end on."""

    def __init__(self, chunks: list[bytes], ends: np.ndarray, ranked: bool = True):
        self.sizes = np.array([len(c) for c in chunks], np.int64)
        self.starts = np.concatenate([[0], np.cumsum((self.sizes + 1) * 4)])
        order = np.argsort(-self.sizes, kind="stable")
        cost = np.full((self.starts[-1], 4), FAR, np.int64)  # by node and letter, least first
        target = np.zeros((self.starts[-1], 4), np.int64)
        dist = np.full(self.starts[-1], FAR, np.int64)
        lasts = self.starts[:-1] + 4 * self.sizes
        states = np.arange(4)
        dist[lasts[:, None] + states] = ends
        flat = np.frombuffer(b"".join(chunks), np.uint8)
        offsets = np.concatenate([[0], np.cumsum(self.sizes)])
        for back in range(1, int(self.sizes.max(initial=0)) + 1):  # all chunks side by side, from their ends
            live = order[: np.searchsorted(-self.sizes[order], -back, "right")]
            symbol = flat[offsets[live + 1] - back].astype(np.int64)
            fault, initial = symbol >> 2, symbol & 3
            here = lasts[live] - 4 * back
            node, after = here[:, None] + states, here[:, None] + 4
            extra = np.where(fault >= DUPLICATE, FAR, np.where(fault == TRUNCATED, TRUNCATED_COST, 0))[:, None]
            kept = AFTER[:, initial].T
            for k, (to, price) in enumerate(
                (
                    (after + states, np.full_like(node, DELETE_COST)),
                    (here[:, None] + NEXT, np.full_like(node, INSERT_COST)),
                    (after + np.minimum(kept, 3), extra + np.where(kept < 4, 0, FAR)),
                    (after + NEXT, extra + REROLE_COST),
                )
            ):
                target[node, k] = to
                if k != 1:
                    cost[node, k] = price + dist[to]
            least = np.minimum(cost[node].min(axis=2), FAR)
            inserted = INSERT_COST + np.minimum(least[:, NEXT], INSERT_COST + least[:, NEXT[NEXT]])
            cost[node, 1] = inserted
            dist[node] = np.minimum(np.minimum(least, inserted), FAR)
        self.dist = dist
        if ranked:
            self._rank((cost == dist[:, None]) & (dist < FAR)[:, None], target)

    def _rank(self, optimal: np.ndarray, target: np.ndarray) -> None:
        """Ranks nodes by their least audits of 1, 2, 4, ... letters, and keeps where these lead."""
        nodes = np.arange(len(optimal))
        leads = optimal.any(axis=1)  # ends of chunks, and nodes from which no end is reached, stay where they are
        letter = np.where(leads, optimal.argmax(axis=1), -1)
        jump = np.where(leads, target[nodes, letter], nodes)
        self.jumps, rank, longest = [jump], letter + 1, 1
        while longest < 3 * (int(self.sizes.max(initial=0)) + 1):  # at most two rows are inserted next to each other
            pair = rank * (len(nodes) + 4) + rank[jump]
            rank = np.unique(pair, return_inverse=True)[1]
            jump = jump[jump]
            self.jumps.append(jump)
            longest *= 2
        # of a node's optimal arcs, the one with the least letter, then with the least audit behind it
        behind = np.where(optimal, np.arange(4) * (rank.max(initial=0) + 1) + rank[target], np.iinfo(np.int64).max)
        self.letter = np.where(leads, behind.argmin(axis=1), -1)

    def path(self, chunk: int, state: int) -> tuple[bytes, int]:
        """The least audit through a chunk from a state, and the state it leads to."""
        start = self.starts[chunk] + state
        nodes = np.array([start])
        for jump in self.jumps:  # the next 1, 2, 4, ... nodes are those reached from the known ones
            last = nodes[-1]
            if self.letter[last] < 0:
                break
            nodes = np.concatenate([nodes, jump[nodes]])
        letters = self.letter[nodes]
        end = nodes[-1] if (letters >= 0).all() else nodes[np.argmax(letters < 0)]
        letters = letters[letters >= 0]
        return np.frombuffer(LETTERS, np.uint8)[letters].tobytes(), int((end - self.starts[chunk]) % 4)


def _then(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Least costs through one part and then another."""
    return np.minimum((first[:, :, None] + second[None, :, :]).min(axis=1), FAR)


def _through(chunks: list[bytes]) -> np.ndarray:
    """For each chunk, the costs from each state before it to each state behind it."""
    ends = np.tile(np.where(np.eye(4, dtype=bool), 0, FAR), (len(chunks), 1))
    graph = EditGraph([c for c in chunks for _ in range(4)], ends, ranked=False)
    return np.stack([graph.dist[start : start + 4] for start in graph.starts[:-1]]).reshape(-1, 4, 4).transpose(0, 2, 1)


def _bounded(batches: Iterator[dict]) -> Iterator[dict]:
    """Batches of chunks, cut so that a graph has at most ``GRAPH_ROWS`` rows, or one chunk."""
    for batch in batches:
        start, rows = 0, 0
        sizes = [len(x) for x in batch["symbols"].to_pylist()]
        for at, size in enumerate(sizes):
            if rows and rows + size > GRAPH_ROWS:
                yield {k: v.slice(start, at - start) for k, v in batch.items()}
                start, rows = at, 0
            rows += size
        yield {k: v.slice(start) for k, v in batch.items()}


def _scan(parts: DataFrame, value: str, chunks: int, step: int, joined) -> DataFrame:
    """Doubling: each chunk's ``value`` with those of all chunks behind it (``step`` 1) or before it (-1).

    ``parts`` (conv, number, value binary) is joined with itself 1, 2, 4, ... chunks on; ``joined`` puts two together.
    """
    kind = parts.select("conv", "number", value).schema
    reach = 1
    while reach < chunks:
        other = parts.select(F.col("conv").alias("_conv"), (F.col("number") - step * reach).alias("_number"), F.col(value).alias("_value"))
        both = parts.join(other, (F.col("conv") == F.col("_conv")) & (F.col("number") == F.col("_number")), "left")

        def run(batches: Iterator[dict]) -> Iterator[dict]:
            for batch in batches:
                pairs = zip(batch[value].to_pylist(), batch["_value"].to_pylist(), strict=True)
                merged = [a if b is None else joined(a, b) for a, b in pairs]
                yield {"conv": batch["conv"], "number": batch["number"], value: pa.array(merged, pa.binary())}

        parts = materialise(map_batches(both.select("conv", "number", value, "_value"), run, kind), "scan")
        reach *= 2
    return parts


def _costs(x: bytes) -> np.ndarray:
    return np.frombuffer(x, np.int64).reshape(4, 4)


def _solved(chunks: DataFrame) -> DataFrame:
    """``chunks`` (conv, number, count, conv_id, part, seq, symbols) with ``end`` (costs) and ``entry`` (state).

    A conversation of one chunk starts in state 0 and ends in 0 or 3. Those of several are solved by two scans over their
    chunks: costs of all that follows, then states after all that precedes.
    """
    one = chunks.filter("count = 1").withColumn("end", F.lit(ENDS.tobytes())).withColumn("entry", F.lit(0))
    many = chunks.filter("count > 1")
    longest = many.agg(F.max("count")).first()[0]
    if longest is None:
        return one
    many = materialise(many, "many")

    def costs(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in _bounded(batches):
            found = _through(batch["symbols"].to_pylist())
            yield {k: batch[k] for k in ("conv", "number")} | {"costs": [x.tobytes() for x in found]}

    key = "conv long, number long"
    behind = materialise(map_batches(many.select("conv", "number", "symbols"), costs, f"{key}, costs binary"), "costs")
    behind = _scan(behind, "costs", longest, 1, lambda a, b: _then(_costs(a), _costs(b)).tobytes())
    next_costs = behind.select("conv", (F.col("number") - 1).alias("number"), F.col("costs").alias("_next"))
    many = many.join(next_costs, ["conv", "number"], "left")

    def leads(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in _bounded(batches):
            symbols, following = batch["symbols"].to_pylist(), batch["_next"].to_pylist()
            ends = [ENDS if x is None else np.minimum((_costs(x) + ENDS).min(axis=1), FAR) for x in following]
            graph = EditGraph(symbols, np.array(ends))
            states = [bytes(graph.path(i, q)[1] for q in range(4)) for i in range(len(symbols))]
            yield {k: batch[k] for k in ("conv", "number")} | {"end": [e.tobytes() for e in ends], "states": states}

    led = materialise(map_batches(many.select("conv", "number", "symbols", "_next"), leads, f"{key}, end binary, states binary"), "states")
    before = _scan(led.select("conv", "number", "states"), "states", longest, -1, lambda a, b: bytes(a[q] for q in b))
    before = before.select("conv", (F.col("number") + 1).alias("number"), F.conv(F.hex(F.substring("states", 1, 1)), 16, 10).cast("int").alias("entry"))
    found = many.drop("_next").join(led.drop("states"), ["conv", "number"]).join(before, ["conv", "number"], "left")
    return one.unionByName(found.withColumn("entry", F.coalesce("entry", F.lit(0))))


def _audits(chunks: DataFrame, id_type: str) -> DataFrame:
    """Rows of ``_ROW`` for the chunks, with the letters of their audits."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in _bounded(batches):
            symbols = batch["symbols"].to_pylist()
            graph = EditGraph(symbols, np.array([np.frombuffer(x, np.int64) for x in batch["end"].to_pylist()]).reshape(-1, 4))
            letters = [graph.path(i, q)[0] for i, q in enumerate(batch["entry"].to_pylist())]
            given = {c: batch[c] for c in ("conv_id", "part", "seq", "symbols", "entry")}
            yield _table(len(symbols), **given, place=[-1] * len(symbols), letters=letters)

    return map_batches(chunks.select("conv_id", "part", "seq", "symbols", "end", "entry"), run, _fields(id_type))


def _fields(id_type: str) -> str:
    return f"conv_id {id_type}, part int, seq int, place int, role string, text string, symbols binary, letters binary, entry int"


class _Report:
    """What is said about one conversation; its repaired text is hashed as it streams by."""

    def __init__(self, conv):
        self.conv, self.hash, self.audit, self.written = conv, hashlib.sha256(), [], 0
        self.faults, self.illegal, self.cost, self.last, self.state = [0] * 4, 0, 0, None, 0
        self.pending: Iterator | None = None
        self.expected: tuple[int, int] | None = None  # place and letter of the next row that stays

    def write(self, role: str, text: str) -> None:
        self.hash.update(("\n" * bool(self.written) + role + ":" + text).encode("utf-8", "surrogatepass"))
        self.written += 1

    def chunk(self, symbols: bytes, letters: bytes) -> None:
        self.finish()
        self.audit.append(letters)
        found = np.frombuffer(symbols, np.uint8)
        for fault, n in zip(*np.unique(found >> 2, return_counts=True), strict=True):
            self.faults[fault] += int(n)
        initials = found & 3
        if self.last is not None:
            initials = np.concatenate([[self.last], initials])
        legal = np.isin(initials[:-1] * 4 + initials[1:], (1, 6, 9))  # su, ua, au
        self.illegal += int((~legal).sum())
        self.last = initials[-1]
        self.cost += DELETE_COST * letters.count(b"D") + INSERT_COST * letters.count(b"I") + REROLE_COST * letters.count(b"R")
        self.pending = self._edits(symbols, letters)

    def _edits(self, symbols: bytes, letters: bytes) -> Iterator[tuple[int, int]]:
        """(place, letter) of the rows that stay; inserted ones are written on the way."""
        place = 0
        for letter in letters:
            if letter == INSERT:
                self.insert()
                continue
            if letter != DELETE:
                self.cost += TRUNCATED_COST * (symbols[place] >> 2 == TRUNCATED)
                yield place, letter
                self.state = NEXT[self.state] if letter == REROLE else AFTER[self.state, symbols[place] & 3]
            place += 1

    def insert(self) -> None:
        self.state = NEXT[self.state]
        self.write(ROLES[int(self.state)], "")

    def row(self, place: int, role: str, text: str) -> None:
        if self.expected and self.expected[0] == place:
            self.write(ROLES[int(NEXT[self.state])] if self.expected[1] == REROLE else role, text)
            self.advance()

    def advance(self) -> None:
        self.expected = next(self.pending, None) if self.pending else None

    def finish(self) -> None:
        assert self.expected is None, "a row that stays is missing"
        self.pending = None

    def done(self) -> dict:
        self.finish()
        missing = MISSING[int(self.state)]
        for _ in missing:
            self.insert()
        audit = b"".join(self.audit).decode() + missing
        cost = self.cost + INSERT_COST * len(missing)
        names = ("conv_id", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
        values = (self.conv, self.faults[BLANK], self.faults[DUPLICATE], self.faults[TRUNCATED], self.illegal, cost, audit, self.hash.hexdigest())
        return dict(zip(names, values, strict=True))


def _reports(batches: Iterator[dict]) -> Iterator[dict]:
    """Sorted chunks and rows of whole conversations: a chunk comes before its rows."""
    report, started, names = None, False, ("conv_id", "place", "role", "text", "symbols", "letters")
    for batch in batches:
        out = []
        for conv, place, role, text, symbols, letters in zip(*(batch[c].to_pylist() for c in names), strict=True):
            if not started or conv != report.conv:
                if started:
                    out.append(report.done())
                report, started = _Report(conv), True
            if place < 0:
                report.chunk(symbols, letters)
                report.advance()
            else:
                report.row(place, role, text)
        if out:
            yield {k: [x[k] for x in out] for k in out[0]}
    if started:
        yield {k: [v] for k, v in report.done().items()}


def repair(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """One row per ``conv_id`` of ``ids``: gaps, faults, cost, audit and hash of the cheapest repair of its ``rows``.

    ``rows`` has ``conv_id, turn, role, text``; other columns are ignored. A conversation's rows are taken by turn, NULL
    first, then by role and text. ``gaps`` counts turns missing between the first and the last. A row's first fault
    counts: blank (no visible character), duplicate (its role and text stood earlier), truncated (last visible character
    none of ``.!?``). ``illegal`` counts neighbours whose role initials are not su, ua or au. Edits: Keep costs 0, Rerole to
    user or assistant 2, Delete 3 (the only one for blank and duplicate rows), Insert of an empty user or assistant row
    2; a truncated row that stays adds 1. ``audit`` is the ASCII-least string of initials among the cheapest edits that
    give ``(s?(ua)+)?``, and ``repaired_sha256`` the hash of the result, ``role:text`` by lines. A conversation without
    rows has zeros, an empty audit and the hash of the empty string. NULL ids are one conversation, NULL and empty
    texts are blank, a NULL role is one space; repeated rows are faults like any other, and an empty table gives no row.

    Rows that are alike in all columns are counted before they meet. Rows are range-sorted, so a conversation with most
    rows is spread over many tasks; each cuts it to chunks of ``CHUNK`` rows, a byte a row, whose costs and states are
    put together by doubling. Only the last pass, a hash in reading order, streams a whole conversation through one task,
    which holds its audit and one row at a time.
    """
    spaced = [F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")]
    id_type = rows.schema["conv_id"].dataType.simpleString()
    faults = materialise(_faults(rows.select("conv_id", "turn", *spaced)), "faults")
    turns = faults.groupBy("conv_id").agg(F.max("turn").alias("high"), F.min("turn").alias("low"), F.count_distinct("turn").alias("turns"))
    gaps = turns.select(F.col("conv_id").alias("_gap"), F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).cast("long").alias("gaps"))
    order = ("conv_id", F.asc_nulls_first("turn"), "role", "text")
    ranged = faults.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "role", "text", "copies", "first", "fault")
    cut = materialise(map_batches(ranged, _chunks, _fields(id_type)), "chunks")
    number = F.row_number().over(Window.partitionBy("conv_id").orderBy("part", "seq")).cast("long")  # one row per CHUNK rows
    chunks = cut.filter("place < 0").select("conv_id", "part", "seq", "symbols", number.alias("number"))
    counts = chunks.groupBy(F.col("conv_id").alias("_id")).agg(F.max("number").alias("count"), F.min(F.struct("part", "seq")).alias("at"))
    conv = F.col("at.part").cast("long") * F.lit(1 << 32) + F.col("at.seq")  # the first chunk stands for the conversation
    chunks = materialise(chunks.join(counts, _same("conv_id", "_id")).withColumn("conv", conv).drop("_id", "at"), "chunks")
    streamed = cut.filter("place >= 0").unionByName(_audits(_solved(chunks), id_type))
    streamed = streamed.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq", "place")
    fields = f"conv_id {id_type}, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    reports = map_batches(streamed, _reports, fields).withColumnRenamed("conv_id", "_id")
    out = ids.select("conv_id").distinct().join(reports, _same("conv_id", "_id"), "left").join(gaps, _same("conv_id", "_gap"), "left")
    counted = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", *counted, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))
