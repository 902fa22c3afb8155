"""The draws of ``tableloom.functions.draw`` written a second time, in SQL.

The 64-bit hash of one or more integers is spelled out with 128-bit arithmetic, so generated
values can be checked by an engine that shares no code with ours.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from tableloom.functions.draw import SPACE, draw_key

# The constants of the public 64-bit xxHash.
P1, P2, P3, P4, P5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261
M = 1 << 64
HASH_SEED = 42  # fixed value: the engine's default hash seed


def load(spark, sf_dir: str, table: str):
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _rotate(x: int, by: int) -> int:
    return ((x << by) | (x >> (64 - by))) % M


def hash_of(value: int, seed: int) -> int:
    """Hash of one 64-bit integer."""
    h = (seed + P5 + 8) % M ^ (_rotate(value % M * P2 % M, 31) * P1 % M)
    h = (_rotate(h, 27) * P1 + P4) % M
    h = (h ^ (h >> 33)) * P2 % M
    h = (h ^ (h >> 29)) * P3 % M
    return h ^ (h >> 32)


def _u(n: int) -> str:
    return f"{n}::UHUGEINT"


def _turn(x: str, by: int) -> str:
    return f"((({x} << {by}) % {_u(M)}) + ({x} >> {64 - by}))"


def draws(source: str, ids: Sequence[str], streams: Mapping[str, Sequence | None]) -> str:
    """``SELECT *, <name>...`` over ``source`` with one draw in 0 .. 2**63 - 1 per stream.

    ``name`` holds the draw and ``name_h`` the full 64 bits. A stream of None hashes the ids alone.
    """
    starts = {n: HASH_SEED if s is None else hash_of(draw_key(*s), HASH_SEED) for n, s in streams.items()}
    state = {name: _u((start + P5 + 8) % M) for name, start in starts.items()}
    query = f"SELECT * FROM ({source})"
    for step, id_ in enumerate(ids):
        mixed = f"(({id_})::UHUGEINT * {_u(P2)}) % {_u(M)}"
        query = f"SELECT *, {mixed} AS _m{step} FROM ({query})"
        query = f"SELECT *, ({_turn(f'_m{step}', 31)} * {_u(P1)}) % {_u(M)} AS _n{step} FROM ({query})"
        for stage, (template, before) in enumerate(
            (
                ("xor({state}, _n%d)" % step, None),
                (f"({_turn('{x}', 27)} * {_u(P1)} + {_u(P4)}) % {_u(M)}", 0),
                (f"(xor({{x}}, {{x}} >> 33) * {_u(P2)}) % {_u(M)}", 1),
                (f"(xor({{x}}, {{x}} >> 29) * {_u(P3)}) % {_u(M)}", 2),
                ("xor({x}, {x} >> 32)", 3),
            )
        ):
            made = ", ".join(
                f"{template.replace('{state}', state[n]).replace('{x}', f'_s{step}_{before}_{n}')} AS _s{step}_{stage}_{n}"
                for n in streams
            )
            query = f"SELECT *, {made} FROM ({query})"
        state = {n: f"((_s{step}_4_{n} + {_u(P5 + 8)}) % {_u(M)})" for n in streams}
    last = len(ids) - 1
    made = ", ".join(f"(_s{last}_4_{n} >> 1)::BIGINT AS {n}, _s{last}_4_{n} AS {n}_h" for n in streams)
    return f"SELECT * EXCLUDE ({_helpers(len(ids), streams)}), {made} FROM ({query})"


def _helpers(steps: int, streams) -> str:
    names = [f"_{c}{s}" for s in range(steps) for c in "mn"]
    names += [f"_s{s}_{g}_{n}" for s in range(steps) for g in range(5) for n in streams]
    return ", ".join(names)


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def pick(values: Sequence, draw: str) -> str:
    """SQL for the value a draw picks from a list."""
    items = ", ".join(text(v) if isinstance(v, str) else str(v) for v in values)
    return f"([{items}])[{draw} % {len(values)} + 1]"


def padded(draw: str, digits: int) -> str:
    return f"lpad(({draw} % {10**digits})::VARCHAR, {digits}, '0')"


def letters(draw: str, n: int, alphabet: str) -> str:
    base = len(alphabet)
    return " || ".join(f"substr({text(alphabet)}, (({draw} // {base**i}) % {base} + 1)::INT, 1)" for i in range(n))


def share(p: float) -> int:
    """The draw below which a chance of ``p`` holds."""
    return min(SPACE - 1, round(p * SPACE))
