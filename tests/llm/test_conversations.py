import hashlib
import random
import zlib
from functools import cache

import pytest

from tableloom.llm import conversations

WHITE = " \t\n\x0b\f\r"
SCHEMA = "turn long, text string, conv_id long, role string, copies int, place string, count long"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        drawn = zlib.crc32(name.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if drawn == 1:
            text = ""
        if drawn == 2:
            text = text.translate({ord(c): None for c in ".!?"})
        if drawn == 4:
            role = "user"
        out += [] if drawn == 0 else [(conv, turn, role, text)] * (2 if drawn == 3 else 1)
    return out


def cheapest(rows):
    """Cost and least audit by plain recursion over suffixes."""
    after = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}

    @cache
    def best(i, state, inserted=0):
        found = []
        if i == len(rows) and state in (0, 3):
            found.append((0, ""))
        if inserted < 2:
            cost, audit = best(i, 3 if state == 2 else 2, inserted + 1)
            found.append((cost + 2, "I" + audit))
        if i < len(rows):
            fault, role = rows[i]
            cost, audit = best(i + 1, state)
            found.append((cost + 3, "D" + audit))
            if fault in ("", "truncated"):
                extra = int(fault == "truncated")
                if (state, role[:1]) in after:
                    cost, audit = best(i + 1, after[state, role[:1]])
                    found.append((cost + extra, "K" + audit))
                cost, audit = best(i + 1, 3 if state == 2 else 2)
                found.append((cost + 2 + extra, "R" + audit))
        return min(found, default=(10**9, ""))

    for i in range(len(rows), 0, -50):  # fill the cache from the end
        for state in range(4):
            best(i, state)
    return best(0, 0)


def brute(rows, ids):
    out = []
    for conv in set(ids):
        own = sorted((r[1:] for r in rows if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        faults, said = [], set()
        for _, role, text in own:
            seen = text.rstrip(WHITE)
            faults.append("blank" if not seen else "duplicate" if (role, text) in said else "truncated" if seen[-1] not in ".!?" else "")
            said.add((role, text))
        cost, audit = cheapest(tuple(zip(faults, (r[1] for r in own), strict=True)))
        at, state, lines = 0, 0, []
        for letter in audit:
            if letter == "I":
                state = 3 if state == 2 else 2
                lines.append(("user:", "assistant:")[state - 2])
                continue
            _, role, text = own[at]
            at += 1
            if letter == "R":
                state = 3 if state == 2 else 2
                role = ("user", "assistant")[state - 2]
            elif letter == "K":
                state = {"s": 1, "u": 2, "a": 3}[role[0]]
            if letter != "D":
                lines.append(f"{role}:{text}")
        turns = [r[0] for r in own if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(own, own[1:], strict=False)]
        illegal = sum(p not in ("su", "ua", "au") for p in pairs)
        sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out.append((conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha))
    return sorted(out, key=str)


def table(spark, rows):
    return spark.createDataFrame([(t, x, c, r, 1, "p", 2) for c, t, r, x in rows], SCHEMA)


def run(spark, rows):
    given = table(spark, rows)
    return sorted(map(tuple, conversations.repair(conversations.damage(given), given).collect()), key=str)


def talk(seed, conversations=150, longest=14):
    drawn = random.Random(seed)
    rows = []
    for conv in range(conversations):
        for turn in range(drawn.randrange(longest)):
            role = drawn.choice(("system", "user", "assistant", "user", "assistant", "tool"))
            text = drawn.choice(("Yes.", "No!", "Well", "", " \n", "Why?", f"t{drawn.randrange(9)}.", "Long " * 50))
            rows.append((conv, drawn.choice((turn, turn, turn, turn + 3, None)), role, text))
    drawn.shuffle(rows)
    return rows


SPECIAL = [
    (900, 0, "user", "Only."), (901, None, None, None), (902, 5, "system", "Alone."), (None, 1, "user", "Hi."), (None, 2, "assistant", "Ho"),
    (903, 0, "", "no role."), (904, 0, "user", "x" * 200_000 + "."), (904, 1, "assistant", "é."), (905, 3, "user", "Same."), (905, 3, "user", "Same."),
    (905, 3, "assistant", "Same."), (906, -7, "user", "A."), (906, 900, "assistant", "B!"), (907, 1, "User", "upper."), (908, 1, "ünï", "y."),
]


def test_repairs_as_plain_recursion(spark):
    rows = talk(1) + SPECIAL
    assert run(spark, rows) == brute(damaged(rows), [r[0] for r in rows])


def test_a_conversation_of_most_rows_is_cut_and_joined(spark, monkeypatch, no_broadcast):
    monkeypatch.setattr(conversations, "CHUNK", 7)
    monkeypatch.setattr(conversations, "GRAPH_ROWS", 30)
    drawn = random.Random(2)
    rows = talk(3, 20) + [(77, i, drawn.choice(("user", "assistant", "assistant", "system")), drawn.choice((f"a{i}.", f"b{i}", "", "c."))) for i in range(300)]
    assert run(spark, rows) == brute(damaged(rows), [r[0] for r in rows])


def test_equal_rows_are_counted_not_sent(spark):
    rows = [(5, None, "user", "Same?")] * 9000 + [(5, 1, "assistant", "Fine.")]
    given = table(spark, rows)
    found = conversations.repair(given, given).collect()[0]
    assert (found.duplicate, found.cost, found.audit) == (8999, 8999 * 3, "K" + "D" * 8999 + "K")
    assert found.repaired_sha256 == hashlib.sha256(b"user:Same?\nassistant:Fine.").hexdigest()


def test_no_rows(spark):
    assert run(spark, []) == []
    empty = table(spark, [])
    ids = table(spark, [(4, 0, "user", "gone")])
    nothing = hashlib.sha256(b"").hexdigest()
    assert list(map(tuple, conversations.repair(empty, ids).collect())) == [(4, 0, 0, 0, 0, 0, 0, "", nothing)]


@pytest.mark.parametrize("state", range(4))
def test_ranked_path_is_the_least_of_all_cheapest(state):
    drawn = random.Random(state)
    for _ in range(60):
        symbols = bytes(drawn.randrange(16) for _ in range(drawn.randrange(1, 9)))
        graph = conversations.EditGraph([symbols], conversations.ENDS[None, :])
        names = {0: "", 1: "truncated", 2: "duplicate", 3: "blank"}
        rows = tuple((names[x >> 2], "suao"[x & 3].replace("o", "tool")) for x in symbols)
        if state == 0:
            cost, audit = cheapest(rows)
            letters, end = graph.path(0, 0)
            assert graph.dist[0] == cost and letters.decode() + conversations.MISSING[end] == audit
        else:
            letters, end = graph.path(0, state)
            assert graph.dist[state] >= conversations.FAR or letters.decode().replace("I", "").__len__() == len(symbols)
