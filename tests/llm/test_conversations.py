import hashlib
import itertools
import random
import re
import zlib

import pytest

from kinlight.llm import conversations

PATTERN = re.compile("(s?(ua)+)?")
WHITE = " \t\n\x0b\x0c\r"


def faults_of(rows):
    seen, found = set(), []
    for _, role, text in rows:
        said = text.strip(WHITE)
        found.append("blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else "sound")
        seen.add((role, text))
    return found


def brute(rows):
    """Cheapest edits by a search over all of them, by cost and then letters."""
    faults = faults_of(rows)
    best = (1 << 30, "", ())

    def go(i, cost, audit, kept):
        nonlocal best
        roles = "".join(r[0] for r, _ in kept)
        if cost > best[0] or not (PATTERN.fullmatch(roles) or PATTERN.fullmatch(roles + "a") or PATTERN.fullmatch(roles + "ua")):
            return
        if i == len(rows) and PATTERN.fullmatch(roles):
            best = min(best, (cost, audit, kept))
        if audit[-3:] != "III":
            for role in ("user", "assistant"):
                go(i, cost + 2, audit + "I", (*kept, (role, "")))
        if i < len(rows):
            _, role, text = rows[i]
            go(i + 1, cost + 3, audit + "D", kept)
            if faults[i] in ("sound", "truncated"):
                more = int(faults[i] == "truncated")
                if role[:1] in ("s", "u", "a"):
                    go(i + 1, cost + more, audit + "K", (*kept, (role, text)))
                for other in ("user", "assistant"):
                    go(i + 1, cost + 2 + more, audit + "R", (*kept, (other, text)))

    go(0, 0, "", ())
    return best


def expected(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, hash) of one conversation in order."""
    faults, (cost, audit, kept) = faults_of(rows), brute(rows)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest)


def in_order(rows):
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    key = lambda t, r, x: (t is not None, t or 0, hashlib.sha256(f"{len(r.encode())}:{r}:{x}".encode()).digest())
    return sorted(rows, key=lambda row: key(*row))


def reports_of(spark, rows, ids=None):
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], "conv_id long, turn long, role string, text string, kind int, codes string")
    ids = df if ids is None else spark.createDataFrame([(i,) for i in ids], "conv_id long")
    found = conversations.reports(df, ids).collect()
    return {r.conv_id: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in found}


def test_repairs_are_the_cheapest_and_least(spark):
    rng = random.Random(5)
    rows = []
    for conv in range(60):
        for turn in range(rng.randrange(1, 6)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rng.choice(["a.", "b!", "c", "", " \t", "d? \n", None, "e"])
            rows.append((conv if conv else None, rng.choice([turn, turn * 2, None]), role, text))
    by = {}
    for conv, *row in rows:
        by.setdefault(conv, []).append(tuple(row))
    want = {conv: expected(in_order(r)) for conv, r in by.items()}
    assert reports_of(spark, rows) == want


def test_pieces_of_a_conversation_are_joined(spark, monkeypatch):
    monkeypatch.setattr(conversations, "CHUNK_ROWS", 3)
    rows = [(1, t, r, f"{x}.") for t, (r, x) in enumerate([("user", 1), ("user", 2), ("user", 1), ("assistant", 3), ("assistant", 4), ("system", 5), ("user", 6)])]
    assert reports_of(spark, rows + [(2, 0, "user", "a.")], [1, 2, 3]) == {
        1: expected(in_order([r[1:] for r in rows])),
        2: expected([(0, "user", "a.")]),
        3: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()),
    }


def test_repaired_turns(spark):
    rows = [(1, 0, "system", "s."), (1, 1, "assistant", "x" * 3_000_000 + "."), (1, 2, "assistant", ""), (1, 3, "user", "b?"), (2, 5, "tool", " ")]
    found = conversations.repaired(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = sorted(tuple(r) for r in found.collect())
    assert got == [(1, 0, "K", "system", "s."), (1, 1, "I", "user", ""), (1, 2, "K", "assistant", "x" * 3_000_000 + "."), (1, 3, "K", "user", "b?"), (1, 4, "I", "assistant", "")]
    assert PATTERN.fullmatch("".join(g[3][0] for g in got))


def test_odd_tables(spark):
    schema = "conv_id string, turn int, role string, text string"
    assert conversations.reports(spark.createDataFrame([], schema), spark.createDataFrame([], schema)).count() == 0
    many = spark.range(3000).selectExpr("'c' AS conv_id", "CAST(null AS int) AS turn", "'user' AS role", "'same.' AS text")
    (row,) = conversations.reports(many, many).collect()
    assert (row.conv_id, row.gaps, row.duplicate, row.cost) == ("c", 0, 2999, 2999 * 3 + 2)
    assert sorted(row.audit) == sorted("KI" + "D" * 2999)


def test_damage(spark):
    rows = [(c, t, "assistant", "One. Two! Three?") for c in range(40) for t in (*range(4), None)]
    got = sorted(map(tuple, conversations.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()), key=str)
    want = []
    for c, t, role, text in rows:
        fault = zlib.crc32(f"{c}:{' ' if t is None else t}".encode()) % 20
        row = (c, t, "user" if fault == 4 else role, "" if fault == 1 else "One Two Three" if fault == 2 else text)
        want += [] if fault == 0 else [row, row] if fault == 3 else [row]
    assert got == sorted(want, key=str)


def test_table_stays_small():
    automaton, at = conversations.RepairAutomaton(), 0
    while at < len(automaton.costs):
        for x in range(16):
            automaton._fill(at, x)
        at += 1
    assert at < 32


@pytest.mark.parametrize("codes,want", [("AQBQ", bytes([0, 1])), ("FQF", bytes([5, 7])), ("GQG", bytes([6, 6]))])
def test_symbols(codes, want):
    assert conversations.symbols_of(codes) == want
