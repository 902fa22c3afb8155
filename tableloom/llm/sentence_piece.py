"""SentencePiece encoding as a shortest path through a weighted transducer, and decoding.

The transducer is the composition of three: the normaliser (blanks become U+2581, one is put in front), the pieces (a
trie whose final states emit an id) and the byte fallback (a character that no piece covers emits its UTF-8
bytes). Each input is composed with it, and the tropical shortest path is read off.

A unigram model weighs a piece by its negative score. A BPE model has no such additive weights: its encoding is the
one path on which every two adjacent pieces are what merging their joined text gives. There the transducer keeps the
last piece as its state, and an arc weighs 0 if the pair agrees with the merges and infinity otherwise; one path of
finite weight is left at every position.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from tableloom.llm.words import map_batches

BLANK = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6  # fixed values: piece types of the file format
UNIGRAM, BPE = 1, 2  # fixed values: model types of the file format
DONE = float("-inf")  # the score where nothing merges
UNKNOWN_PENALTY = 10.0  # fixed value: how far below the lowest score an uncovered character lies
MAX_MODEL_BYTES = 64 << 20
CACHE_SEGMENTS = 180_000  # segments in each of two generations that a worker remembers
LONG_SEGMENT = 64
CACHE_PAIRS = 250_000  # piece pairs a worker remembers


@dataclass
class PieceTransducer:
    """Compiled from the bytes of a model file; encodes and decodes texts."""

    model: bytes
    remembered: int = CACHE_SEGMENTS
    pieces: list[str] = field(init=False)
    scores: list[float] = field(init=False)

    def __post_init__(self) -> None:
        from sentencepiece import sentencepiece_model_pb2 as proto

        read = proto.ModelProto.FromString(self.model)
        normal = read.normalizer_spec
        self.kind, self.prefix = read.trainer_spec.model_type, normal.add_dummy_prefix
        self.squeeze = normal.remove_extra_whitespaces
        if self.kind not in (UNIGRAM, BPE) or normal.precompiled_charsmap or not normal.escape_whitespaces:
            raise ValueError("only unigram and BPE models with an identity character map")
        if read.trainer_spec.treat_whitespace_as_suffix or any(p.type == USER_DEFINED for p in read.pieces):
            raise ValueError("blanks as suffix and user-defined pieces are not supported")
        self.pieces, self.scores = [p.piece for p in read.pieces], [p.score for p in read.pieces]
        self.types = [p.type for p in read.pieces]
        self.bytes = {int(p.piece[1:-1], 16): i for i, p in enumerate(read.pieces) if p.type == BYTE}
        self.unknown = next(i for i, t in enumerate(self.types) if t == UNKNOWN)
        self.fallback = read.trainer_spec.byte_fallback
        self.unknown_text = read.trainer_spec.unk_surface
        self.ids = {p: i for i, p in enumerate(self.pieces) if self.types[i] == NORMAL}
        self.trie: dict = {}
        for piece, i in self.ids.items():
            node = self.trie
            for char in piece:
                node = node.setdefault(char, {})
            node[""] = i
        lowest = min((self.scores[i] for i in self.ids.values()), default=0.0)
        self.unknown_weight = UNKNOWN_PENALTY - lowest
        # Where no piece spans a place, every path can be cut there, and its parts remembered. A run is blanks and the
        # letters, or the other characters, that follow them; numerals count as others.
        numerals = re.escape("".join(sorted({c for p in self.ids for c in p if c.isalnum() and not c.isalpha()})))
        letters, others = rf"[^\W\d_{numerals}]", rf"(?:[^\w{BLANK}]+|[\d_{numerals}]+)"
        self.runs = re.compile(rf"{BLANK}*{letters}+|{BLANK}*{others}+|{BLANK}+").findall
        bare = [piece.lstrip(BLANK) for piece in self.ids]
        self.can_cut = not any(BLANK in piece or len(self.runs(piece)) > 1 for piece in bare)
        self.longest = max(map(len, self.ids), default=1)
        self.piece_score = {p: self.scores[i] for p, i in self.ids.items()}
        self.merges: dict[str, list[tuple[float, str, str]] | None] = {}  # at most one entry per piece and character
        self.found: dict[str, tuple[int, ...]] = {}  # segments of late
        self.before: dict[str, tuple[int, ...]] = {}  # and those before them
        self.agree: dict[tuple[str, str], bool] = {}

    def normalise(self, text: str) -> str:
        if self.squeeze:
            text = " ".join(x for x in text.split(" ") if x)
        text = text.replace(" ", BLANK)
        return BLANK + text if text and self.prefix else text

    def _merges(self, piece: str) -> list[tuple[float, str, str]] | None:
        """Every state of a piece's own merging: the next merge's score and the parts at both ends.

        The best score merges first, the leftmost of equals. None if the parts never become the piece.
        """
        if piece in self.merges:
            return self.merges[piece]
        parts, states, score = list(piece), [], self.piece_score
        while len(parts) > 1:
            found = [score.get(a + b, DONE) for a, b in zip(parts, parts[1:], strict=False)]
            best = max(found)
            if best == DONE:
                break
            states.append((best, parts[0], parts[-1]))
            at = found.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        states.append((DONE, parts[0], parts[-1]))
        self.merges[piece] = found = states if len(parts) == 1 else None
        return found

    def _agrees(self, last: str, piece: str) -> bool:
        """Whether merging the joined text of two pieces gives the two pieces: no merge crosses their border."""
        if len(self.agree) >= CACHE_PAIRS:
            self.agree.clear()
        left, right = self._merges(last) if last else None, self._merges(piece)
        known = right is not None
        i = j = 0
        while known and left:
            next_left, _, end = left[i]
            next_right, start, _ = right[j]
            across = self.piece_score.get(end + start, DONE)
            if across > next_left and across >= next_right:
                known = False
            elif next_left == DONE == next_right:
                break
            elif next_left >= next_right:
                i += 1
            else:
                j += 1
        self.agree[last, piece] = known
        return known

    def _arcs(self, text: str, start: int) -> list[str]:
        """The pieces that begin at ``start``, shortest first; an uncovered character stands for itself."""
        node, end, out = self.trie, start, []
        get = node.get
        for char in text[start : start + self.longest]:
            if (node := get(char)) is None:
                break
            end += 1
            get = node.get
            if "" in node:
                out.append(text[start:end])
        if not out or len(out[0]) > 1:
            out.insert(0, text[start])
        return out

    def _merge_path(self, text: str) -> list[str]:
        """The one path of finite weight: long arcs are tried first, and states without a way on are left for good."""
        n, at, last = len(text), 0, ""
        path: list[str] = []
        if not text:
            return path
        options, dead = [self._arcs(text, 0)], set()
        agree = self.agree
        while at < n:
            open_arcs = options[-1]
            while open_arcs:
                piece = open_arcs.pop()
                if dead and at + len(piece) in dead:
                    continue
                known = agree.get((last, piece))
                if known or (known is None and self._agrees(last, piece)):
                    break
            else:
                dead.add(at)
                options.pop()
                at -= len(path.pop())
                last = path[-1] if path else ""
                continue
            path.append(piece)
            at, last = at + len(piece), piece
            options.append(self._arcs(text, at) if at < n else [])
        return path

    def _light_path(self, text: str) -> list[str]:
        """The path of least total weight; of equals the one found first from the left."""
        n = len(text)
        weight, back = [0.0] + [float("inf")] * n, [0] * (n + 1)
        for start in range(n):
            node, end, single = self.trie, start, False
            while end < n and (node := node.get(text[end])) is not None:
                end += 1
                if "" in node:
                    single |= end == start + 1
                    if (total := weight[start] - self.scores[node[""]]) < weight[end]:
                        weight[end], back[end] = total, start
            if not single and (total := weight[start] + self.unknown_weight) < weight[start + 1]:
                weight[start + 1], back[start + 1] = total, start
        path, at = [], n
        while at:
            path.append(text[back[at] : at])
            at = back[at]
        return path[::-1]

    def _segment_ids(self, segment: str) -> tuple[int, ...]:
        path = self._merge_path(segment) if self.kind == BPE else self._light_path(segment)
        out: list[int] = []
        for piece in path:
            if (i := self.ids.get(piece)) is not None:
                out.append(i)
            elif self.fallback:
                out.extend(self.bytes[b] for b in piece.encode("utf-8"))
            else:
                out.append(self.unknown)
        return tuple(out)

    def encode(self, text: str | None) -> list[int]:
        """Ids of the whole text; none for NULL and the empty text."""
        normal = self.normalise(text or "")
        out: list[int] = []
        for segment in _segments(normal) if self.can_cut else [normal]:
            ids = self.found.get(segment)
            out += self._remembered(segment) if ids is None else ids
        if not self.fallback:  # neighbouring unknown characters are one piece
            out = [i for k, i in enumerate(out) if i != self.unknown or not k or out[k - 1] != i]
        return out

    def _remembered(self, segment: str) -> tuple[int, ...]:
        """Ids of a segment that is not among the recent ones: those before, or the paths of its runs."""
        if (ids := self.before.pop(segment, None)) is None:
            runs = self.runs(segment) if self.can_cut else [segment]
            if len(runs) == 1:
                ids = self._segment_ids(segment)
            else:
                parts = [self.found.get(run) or self._remembered(run) for run in runs]
                ids = tuple(i for part in parts for i in part)
        if len(segment) <= LONG_SEGMENT:
            if len(self.found) >= self.remembered:
                self.found, self.before = {}, self.found
            self.found[segment] = ids
        return ids

    def decode(self, ids: Sequence[int]) -> str:
        """The text of the ids, without the blank put in front; bytes that are no UTF-8 become U+FFFD."""
        out, raw = [], bytearray()
        for i in ids:
            if self.types[i] == BYTE:
                raw.append(int(self.pieces[i][1:-1], 16))
                continue
            if raw:
                out.append(_decoded(raw))
                raw = bytearray()
            if self.types[i] != CONTROL:
                out.append(self.unknown_text if self.types[i] == UNKNOWN else self.pieces[i])
        if raw:
            out.append(_decoded(raw))
        text = "".join(out)
        if self.prefix and text.startswith(BLANK):
            text = text[1:]
        return text.replace(BLANK, " ")


def _segments(text: str) -> list[str]:
    """``text`` cut before every run of blanks that follows another character."""
    parts = text.split(BLANK)
    out, blanks = ([parts[0]] if parts[0] else []), 0
    for part in parts[1:]:
        blanks += 1
        if part:
            out.append(BLANK * blanks + part)
            blanks = 0
    return [*out, BLANK * blanks] if blanks else out


def _decoded(raw: bytearray) -> str:
    return raw.decode("utf-8", "replace")


_compiled: dict[int, PieceTransducer] = {}


def _transducer(model: bytes, remembered: int = CACHE_SEGMENTS) -> PieceTransducer:
    """Compiled once per worker process."""
    key = hash((model, remembered))
    if key not in _compiled:
        _compiled.clear()
        _compiled[key] = PieceTransducer(model, remembered)
    return _compiled[key]


def read_model(path: str | Path) -> bytes:
    """The model file, read on the driver and sent to the workers, which need not see it."""
    data = Path(path).read_bytes()
    if len(data) > MAX_MODEL_BYTES:
        raise ValueError(f"a model of {len(data)} bytes is too large to copy to every worker")
    return data


def encode(
    docs: DataFrame, model: bytes, text: str = "text", keep: Sequence[str] = ("doc_id",), remembered: int = CACHE_SEGMENTS
) -> DataFrame:
    """The columns of ``keep`` with ``ids``, ``n_tokens`` and ``round_trip`` (whether decoding gives the text back).

    Whole texts are encoded; NULL and empty texts have no ids, and NULL reads as empty. The round trip fails only for
    texts that hold U+2581 itself, and where the model normalises blanks or lacks byte fallback. Repeated rows are
    encoded alike; other columns are ignored. No shuffle. A worker remembers up to 2 * ``remembered`` segments, some 300
    bytes each; the ids do not depend on it.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(text).alias("text"))
    kept = [StructField(f"k{i}", docs.schema[c].dataType) for i, c in enumerate(keep)]
    made = [StructField("ids", ArrayType(IntegerType())), StructField("n_tokens", LongType()), StructField("round_trip", BooleanType())]

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        machine = _transducer(shared.value, remembered)
        for batch in batches:
            ids, same = [], []
            for x in batch["text"]:
                value = x.as_py() or ""
                found = machine.encode(value)
                same.append(machine.decode(found) == value)
                ids.append(np.array(found, np.int32))
            lengths = [len(x) for x in ids]
            offsets = pa.array(np.concatenate(([0], np.cumsum(lengths))).astype(np.int32))
            flat = pa.array(np.concatenate([np.zeros(0, np.int32), *ids]), pa.int32())
            lists = pa.ListArray.from_arrays(offsets, flat)
            rest = {k: v for k, v in batch.items() if k != "text"}
            yield rest | {"ids": lists, "n_tokens": pa.array(lengths, pa.int64()), "round_trip": pa.array(same, pa.bool_())}

    out = map_batches(rows, run, StructType(kept + made))
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "ids", "n_tokens", "round_trip")


def decode(rows: DataFrame, model: bytes, ids: str = "ids", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns of ``keep`` with ``text``, decoded from ``ids``; NULL ids give NULL."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    picked = rows.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(ids).alias("ids"))
    kept = [StructField(f"k{i}", rows.schema[c].dataType) for i, c in enumerate(keep)]
    text_type = StructType([*kept, StructField("text", StringType())])

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        machine = _transducer(shared.value)
        for batch in batches:
            texts = [None if (x := v.as_py()) is None else machine.decode(x) for v in batch["ids"]]
            yield {k: v for k, v in batch.items() if k != "ids"} | {"text": pa.array(texts, pa.string())}

    out = map_batches(picked, run, text_type)
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "text")

