"""Conversation repair against a dynamic program over all edit strings, and against plain loops."""

import hashlib
import random
import zlib

import pytest

from lectern.llm import dialogue

COLUMNS = "conv_id long, turn long, role string, text string, n int, code string"
NEXT = (2, 2, 3, 2)


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else text.translate(str.maketrans("", "", ".!?")) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def mend(rows):
    """Rows of one conversation -> results; forwards over all states, keeping the least (cost, edits)."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
    seen, faults = set(), []
    for _, _, role, text in rows:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    best = {0: (0, "", ())}

    def settle(states):
        """Inserted rows, as many as help."""
        for _ in range(3):
            for q, (c, a, o) in list(states.items()):
                new = (c + 5, a + "I", (*o, ("user" if NEXT[q] == 2 else "assistant") + ":"))
                if NEXT[q] not in states or new[:2] < states[NEXT[q]][:2]:
                    states[NEXT[q]] = new
        return states

    for (_, _, role, text), fault in zip(rows, faults):
        new = {}
        for q, (c, a, o) in settle(dict(best)).items():
            tries = [(q, c + 2, a + "D", o)]
            if fault not in ("blank", "duplicate"):
                c += 5 * (fault == "truncated")
                if role[:1] == "s" and q == 0:
                    tries.append((1, c, a + "K", (*o, f"{role}:{text}")))
                if role[:1] == ("a" if NEXT[q] == 3 else "u"):
                    tries.append((NEXT[q], c, a + "K", (*o, f"{role}:{text}")))
                tries.append((NEXT[q], c + 1, a + "R", (*o, f"{'user' if NEXT[q] == 2 else 'assistant'}:{text}")))
            for to, *way in tries:
                if to not in new or way[:2] < list(new[to][:2]):
                    new[to] = tuple(way)
        best = new
    end = settle(dict(best))
    cost, audit, out = min(end[q] for q in (0, 3) if q in end)
    turns = [r[1] for r in rows if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    initials = [r[2][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    return (gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def brute(rows):
    broken = damage(rows)
    return sorted(((c, *mend([r for r in broken if r[0] == c])) for c in {r[0] for r in rows}), key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("conv_id", *dialogue.RESULTS).collect()), key=repr)


def some_rows(seed, sizes):
    rng = random.Random(seed)
    rows = []
    for conv, n in enumerate(sizes):
        for turn in range(n):
            role = rng.choice(["user", "assistant"]) if rng.random() < 0.3 else ("user", "assistant")[turn % 2]
            role = "system" if turn == 0 and rng.random() < 0.4 else rng.choice(["system", "tool", None, "", "ü"]) if rng.random() < 0.05 else role
            text = rng.choice(["Yes.", "no", "Really? ", " \t", "", None, "ä!\n", f"Text {rng.random()}.", f"long {rng.random()}"])
            rows.append((conv, None if rng.random() < 0.05 else turn + (turn > 3), role, text))
    return rows


@pytest.mark.parametrize("segment", [1, 3, 16])
def test_equals_a_dynamic_program(spark, segment):
    rows = some_rows(segment, [0, 1, 2, 3, 5, 8, 8, 8, 13, 40, 150, *[k % 9 for k in range(60)]])
    rows += [(None, 1, "user", "Hi."), (None, None, "assistant", "Ho."), *rows[40:60]]
    table = spark.createDataFrame([(*r, 7, "x") for r in rows], COLUMNS).repartition(5)
    assert got(dialogue.repaired_after_damage(table, segment)) == brute(rows)


def test_all_rows_lost_and_empty_tables(spark):
    lost = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    table = spark.createDataFrame([(lost, 0, "user", "Hi.", 1, "")], COLUMNS)
    assert got(dialogue.repaired_after_damage(table)) == [(lost, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert dialogue.repaired_after_damage(table.limit(0)).collect() == []


def test_one_conversation_over_many_blocks(spark, monkeypatch):
    blocks = dialogue.ordered.blocks
    monkeypatch.setattr(dialogue.ordered, "blocks", lambda df, keys, order: blocks(df, keys, order, 7))
    rows = some_rows(9, [900, 4, 700]) + [(0, 3, "user", "Same.")] * 40 + [(2, 1, "user", "")] * 33
    table = spark.createDataFrame([(*r, 7, "x") for r in rows], COLUMNS)
    assert got(dialogue.repaired_after_damage(table)) == brute(rows)
