"""Random draws as plain columns.

A draw is a hash of (key, row id): no state, no partition number, no task order. The same
seed therefore gives the same table on any number of partitions, and a task that is run
again after a lost executor writes the same rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

BITS = 63
SPACE = 1 << BITS
_SEPARATOR = "\x1f"


def draw_key(*parts: object) -> int:
    """Stable signed 64-bit key for a stream, from its seed and name parts."""
    digest = hashlib.md5("|".join(map(str, parts)).encode()).digest()
    return int.from_bytes(digest[:8], "big", signed=True)


def hash64(key: int, ids: Sequence[Column]) -> Column:
    """Signed 64-bit hash; for one id column it is a bijection of the id."""
    return F.xxhash64(F.lit(key).cast("bigint"), *ids)


class Draws:
    """The streams of one field: ``u(k)`` is uniform over 0 .. 2**63 - 1 for every row."""

    def __init__(self, stream: Sequence[object], ids: Sequence[Column], rank: Column | None = None, family: Sequence[object] = ()):
        """``rank`` numbers the rows from 0 without gaps; a single id does unless given.

        Streams of one ``family`` (by default each its own) are numbered on and keep apart what is to be distinct.
        """
        self.stream, self.family = tuple(stream), tuple(family) or tuple(stream)
        self.ids = tuple(id_.cast("bigint") for id_ in ids)
        self.rank = self.ids[0] if rank is None and len(self.ids) == 1 else rank

    def h(self, k: object = 0) -> Column:
        return hash64(draw_key(*self.stream, k), self.ids)

    def u(self, k: object = 0) -> Column:
        return F.shiftrightunsigned(self.h(k), 1)

    def below(self, n: int, k: object = 0) -> Column:
        """Uniform integer in 0 .. n - 1."""
        if not 1 <= n <= SPACE:
            raise ValueError(f"cannot draw from {n} values")
        return self.u(k) if n == SPACE else self.u(k) % F.lit(n).cast("bigint")

    def pick(self, values: Sequence[str], k: object = 0) -> Column:
        return F.get(constant_array(values), self.below(len(values), k).cast("int"))

    def weighted(self, values: Sequence[str], weights: Sequence[float], k: object = 0) -> Column:
        """Pick by weight; cut points over the draw range are fixed on the driver."""
        if len(values) != len(weights) or sum(weights) <= 0 or min(weights) < 0:
            raise ValueError("weights must match the values, be >= 0 and not all be 0")
        u, total, seen, chosen = self.u(k), sum(weights), 0.0, None
        for value, weight in zip(values[:-1], weights[:-1]):
            seen += weight
            hit = u < F.lit(cut_point(seen / total)).cast("bigint")
            chosen = F.when(hit, value) if chosen is None else chosen.when(hit, value)
        return F.lit(values[-1]) if chosen is None else chosen.otherwise(values[-1])

    def chance(self, p: float, k: object) -> Column:
        """True with probability ``p``."""
        if p >= 1:
            return F.lit(True)
        return self.u(k) < F.lit(cut_point(p)).cast("bigint")

    def digits(self, n: int, k: object = 0) -> Column:
        """``n`` decimal digits; more than 18 take one draw per 18."""
        blocks = [min(18, n - at) for at in range(0, n, 18)]
        parts = [
            F.lpad(self.below(10**size, k if i == 0 else f"{k}.{i}").cast("string"), size, "0")
            for i, size in enumerate(blocks)
        ]
        return parts[0] if len(parts) == 1 else F.concat(*parts)

    def letters(self, n: int, alphabet: str, k: object = 0) -> Column:
        """``n`` letters of ``alphabet``; one draw serves as many as fit in 63 bits."""
        base, per_draw = len(alphabet), 1
        while base ** (per_draw + 1) < SPACE:
            per_draw += 1
        parts = []
        for i in range(n):
            u = self.u(k if i < per_draw else f"{k}.{i // per_draw}")
            at = _div(u, base ** (i % per_draw)) % F.lit(base) + F.lit(1)
            parts.append(F.substring(F.lit(alphabet), at.cast("int"), F.lit(1)))
        return parts[0] if n == 1 else F.concat(*parts)


class DistinctDraws(Draws):
    """Draws of which no two rows get the same: the digits of a permuted row number, in mixed radix.

    What a generator draws is only known once it has drawn: a first run notes the size of each draw, and ``planned``
    gives the draws for a second run. Draws beyond ``MOST_DISTINCT`` combinations are plain ones; the others differ
    already. More rows than combinations are an error of the job.
    """

    def __init__(self, plain: Draws, sizes: Sequence[int] = ()):
        super().__init__(plain.stream, plain.ids, plain.rank, plain.family)
        self.plain, self.sizes, self.asked = plain, tuple(sizes), []
        space = math.prod(self.sizes)
        if self.sizes:
            known = self.rank < F.lit(space)
            row = F.when(known, self.rank).otherwise(F.raise_error(F.lit(f"more rows than the {space} unique values")))
            self.value = permuted(row, space, draw_key(*self.family, "distinct"))

    def planned(self) -> DistinctDraws:
        sizes: list[int] = []
        for n in self.asked:
            if math.prod(sizes) * n > MOST_DISTINCT:
                break
            sizes.append(n)
        return DistinctDraws(self.plain, sizes)

    def below(self, n: int, k: object = 0) -> Column:
        at = len(self.asked)
        self.asked.append(n)
        if at >= len(self.sizes):
            return self.plain.below(n, k)
        digit = _div(self.value, math.prod(self.sizes[:at]))
        return digit if at == len(self.sizes) - 1 else digit % F.lit(n).cast("bigint")

    def u(self, k: object = 0) -> Column:
        return self.below(SMALL_SPACE, k)

    def weighted(self, values: Sequence[str], weights: Sequence[float], k: object = 0) -> Column:
        """Every value once; weights say nothing then."""
        return self.pick(values, k)

    def letters(self, n: int, alphabet: str, k: object = 0) -> Column:
        parts = [self.below(len(alphabet), f"{k}.{i}") for i in range(n)]
        return F.concat(*[F.substring(F.lit(alphabet), (p + F.lit(1)).cast("int"), F.lit(1)) for p in parts])


MOST_DISTINCT = 1 << 62
SMALL_SPACE = 10**10  # of a raw draw that is to be distinct; generators take no smaller remainder of one
SWAPS = 12


def permuted(number: Column, size: int, key: int) -> Column:
    """A permutation of 0 .. size - 1 for any size: in each round a number and its mirror image swap places or not.

    Both of a pair see the same hash, so a round undoes itself and none can send two numbers to one place.
    """
    rounds = [(draw_key(key, "mirror", i) % size, draw_key(key, "swap", i)) for i in range(SWAPS)]
    keys = F.array(*[F.struct(F.lit(m).cast("bigint").alias("mirror"), F.lit(k).cast("bigint").alias("key")) for m, k in rounds])

    def swap(x: Column, turn: Column) -> Column:
        other = (turn["mirror"] + (F.lit(size).cast("bigint") - x)) % F.lit(size).cast("bigint")
        return F.when(F.xxhash64(turn["key"], F.greatest(x, other)) % F.lit(2) == 0, x).otherwise(other)

    return F.aggregate(keys, number.cast("bigint"), swap)


def constant_array(values: Sequence[object], kind: str = "string") -> Column:
    """An array literal in one expression: the optimizer folds it, and building it costs two calls, not one per value."""
    texts = [str(v) for v in values]
    if any(_SEPARATOR in t for t in texts):
        return F.lit(list(values))
    array = F.split(F.lit(_SEPARATOR.join(texts)), _SEPARATOR)
    return array if kind == "string" else array.cast(f"array<{kind}>")


def cut_point(p: float) -> int:
    return min(SPACE - 1, round(p * SPACE))


def _div(a: Column, n: int) -> Column:
    """Whole-number division of a non-negative column."""
    return a if n == 1 else F.call_function("div", a, F.lit(n).cast("bigint"))
