"""Weighted CYK repair against a search over all edits, a chart of all splits, and damage computed in Python."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from freshet.llm import cyk_repair

WHITE = " \t\n\x0b\x0c\r"


def shortest(rows):
    """(cost, audit, lines) of rows (role class, fault, role, text) by trying every string of edits."""
    best = None
    for n in range(len(rows), len(rows) + 4):  # deleting everything costs 3 a row, so more insertions never pay in so few rows
        for letters in itertools.product("DIKR", repeat=n):
            if n - letters.count("I") != len(rows):
                continue
            for line in outcome(rows, letters):
                if best is None or line[:2] < best[:2]:
                    best = line
    return best


def outcome(rows, letters):
    choices, at = [], 0
    cost = 0
    for letter in letters:
        if letter == "I":
            cost += 2
            choices.append([("u", "user", ""), ("a", "assistant", "")])
            continue
        role, fault, name, text = rows[at]
        at += 1
        if letter == "D":
            cost += 3
            continue
        if fault == 2:
            return
        cost += fault + (2 if letter == "R" else 0)
        choices.append([("u", "user", text), ("a", "assistant", text)] if letter == "R" else [(role, name, text)])
    for picked in itertools.product(*choices):
        if re.fullmatch("(s?(ua)+)?", "".join(p[0] for p in picked)):
            yield cost, "".join(letters), [f"{p[1]}:{p[2]}" for p in picked]


def test_least_cost_of_every_short_conversation():
    """Every conversation of up to three rows, some of four."""
    kinds = [(r, f, {"s": "system", "u": "user", "a": "assistant", "x": "tool"}[r], "t") for r in "suax" for f in (0, 1, 2)]
    cases = [c for n in (1, 2) for c in itertools.product(kinds, repeat=n)]
    pick = random.Random(3)
    cases += [tuple(pick.choice(kinds) for _ in range(n)) for n in (3,) * 40 + (4,) * 4]
    for rows in cases:
        symbols = "".join(chr(65 + 3 * "suax".index(r) + f) for r, f, *_ in rows)
        cells = cyk_repair.chart(symbols).cells
        assert min(cells[0], cells[3] or (99, "")) == shortest(rows)[:2], rows


def full_chart(symbols):
    """CYK over all spans and all splits."""
    n = len(symbols)
    cell = {(i, 1): cyk_repair.ROWS[s] for i, s in enumerate(symbols)}
    for size in range(2, n + 1):
        for i in range(n - size + 1):
            ways = [cyk_repair.product(cell[i, k], cell[i + k, size - k]) for k in range(1, size)]
            assert all(w == ways[0] for w in ways)  # every split gives the same cells
            cell[i, size] = ways[0]
    return cell[0, n]


@pytest.mark.parametrize("seed", range(8))
def test_one_split_equals_all_splits(seed):
    pick = random.Random(seed)
    symbols = "".join(pick.choice(list(cyk_repair.SYMBOLS)) for _ in range(pick.randint(1, 24)))
    assert cyk_repair.chart(symbols).cells == full_chart(symbols)


def automaton(symbols):
    """(cost, audit) from left to right over the places of the pattern."""
    def insert(state):
        for _ in range(4):
            for role in "ua":
                for p, q in cyk_repair.STEPS[role]:
                    if p in state:
                        new = (state[p][0] + 2, state[p][1] + "I")
                        state[q] = min(state.get(q, new), new)
        return state

    state = insert({0: (0, "")})
    for s in symbols:
        role, fault = cyk_repair.SYMBOLS[s]
        moves = [(p, p, 3, "D") for p in range(4)]
        if fault < 2:
            moves += [(p, q, fault, "K") for p, q in cyk_repair.STEPS[role]] + [(p, q, 2 + fault, "R") for to in "ua" for p, q in cyk_repair.STEPS[to]]
        new = {}
        for p, q, cost, letter in moves:
            if p in state:
                way = (state[p][0] + cost, state[p][1] + letter)
                new[q] = min(new.get(q, way), way)
        state = insert(new)
    return min(state[p] for p in (0, 3) if p in state)


def brute(rows):
    """Expected result of `repaired_conversations` for (conv_id, turn, role, text)."""
    out = []
    for conv in {r[0] for r in rows}:
        after = []
        for c, turn, role, text in rows:
            if c != conv:
                continue
            role, text = " " if role is None else role, " " if text is None else text
            kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            after += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
        after.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, symbols, counts = set(), "", [0, 0, 0]
        for _, role, text in after:
            ended = text.rstrip(WHITE)
            fault = 0 if not ended else 1 if (role, text) in seen else 2 if ended[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                counts[fault] += 1
            symbols += chr(65 + 3 * "suax".index(role[:1] if role[:1] in ("s", "u", "a") else "x") + {0: 2, 1: 2, 2: 1, None: 0}[fault])
        turns = [r[0] for r in after if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(after, after[1:]))
        cost, audit = automaton(symbols) if after else (0, "")
        kept = len(audit) - audit.count("D")
        lines, at = [], 0
        for letter in audit:
            here = "user" if (len(lines) - kept % 2) % 2 == 0 else "assistant"
            if letter == "I":
                lines.append(f"{here}:")
                continue
            _, role, text = after[at]
            at += 1
            if letter != "D":
                lines.append(f"{role if letter == 'K' else here}:{text}")
        out.append((conv, gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def run(spark, rows):
    df = spark.createDataFrame([(*r, "x", 7) for r in rows], "conv_id long, turn long, role string, text string, at string, symbol long")
    found = cyk_repair.repaired_conversations(df)
    assert found.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return sorted(map(tuple, found.collect()), key=repr)


def made(seed, conversations, turns):
    pick = random.Random(seed)
    texts = ["Yes.", "No!", "and then", " ", "", None, "Why?\n", "x" * 50 + ".", "...", "é.", "a "]
    roles = ["system", "user", "assistant", "tool", "", None, "user", "assistant"]
    return [(c, t if pick.random() > 0.05 else None, pick.choice(roles), pick.choice(texts) if pick.random() < 0.4 else f"Text {c} {t}.")
            for c in conversations for t in range(pick.randint(1, turns))]


def test_equals_plain_python(spark):
    rows = made(1, [*range(60), None, -5], 9)
    rows += rows[:20] + [(99, 2**62, "user", "Far."), (99, -(2**62), "assistant", "Farther."), (98, None, "user", "Hi.")]
    assert run(spark, rows) == brute(rows)


def test_long_conversations_cross_blocks(spark, monkeypatch):
    monkeypatch.setattr(cyk_repair, "BLOCK_BITS", 2)
    monkeypatch.setattr(cyk_repair, "FAN_BITS", 1)
    rows = made(2, [1], 400) + made(4, [1], 900) + made(3, [2, 3], 120)
    assert run(spark, rows) == brute(rows)


def test_dropped_and_empty(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert run(spark, [(gone, 0, "user", "Hi.")]) == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert run(spark, []) == []


def test_rows_of_the_repair(spark):
    df = spark.createDataFrame([(1, 1, "user", "A."), (1, 2, "user", "B."), (1, 3, "system", "C")], "conv_id long, turn long, role string, text string")
    done = cyk_repair.repair(df)
    assert [tuple(r) for r in done.conversations.select("cost", "audit", "illegal").collect()] == [(5, "KIKR", 2)]
    rows = [(r["edit"], r["role"], r["text"]) for r in done.rows.orderBy("place").collect()]
    assert rows == [("K", "user", "A."), ("I", "assistant", ""), ("K", "user", "B."), ("R", "assistant", "C")]
