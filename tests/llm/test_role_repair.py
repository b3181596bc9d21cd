import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pytest

from zonewise.llm import role_repair
from zonewise.llm.queries import op13_role_repair

LEGAL = {("0", "s"): "S", ("0", "u"): "U", ("S", "u"): "U", ("U", "a"): "A", ("A", "u"): "U"}


def cheapest(rows):
    """(cost, audit) over (initial, kind) rows by search through the automaton of (s?(ua)+)?."""
    heap, seen = [(0, "", 0, "0")], set()
    while heap:
        cost, audit, i, q = heapq.heappop(heap)
        if (i, q) in seen:
            continue
        seen.add((i, q))
        if i == len(rows) and q in "0A":
            return cost, audit
        for r in "ua":
            if (q, r) in LEGAL:
                heapq.heappush(heap, (cost + 2, audit + "I", i, LEGAL[q, r]))
        if i < len(rows):
            initial, kind = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, q))
            if kind in (role_repair.SOUND, role_repair.CUT):
                more = int(kind == role_repair.CUT)
                for r, price, letter in [(initial, 0, "K"), ("u", 2, "R"), ("a", 2, "R")]:
                    if (q, r) in LEGAL:
                        heapq.heappush(heap, (cost + price + more, audit + letter, i + 1, LEGAL[q, r]))


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fault = zlib.crc32(key.encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        row = (conv, turn, "user" if fault == 4 else role, text)
        out += [row, row] if fault == 3 else [row]
    return out


def expected(rows, damaged):
    by_conv = defaultdict(list)
    for row in damaged:
        by_conv[row[0]].append(row)
    out = []
    for conv in {r[0] for r in rows}:
        own = sorted(by_conv[conv], key=lambda r: (r[1] is not None, r[1] or 0))
        seen, kinds = set(), []
        for _, _, role, text in own:
            t = text.strip("\x20\t\n\x0b\x0c\r")
            kinds.append(1 if not t else 2 if (role, text) in seen else 0 if t[-1] in ".!?" else 3)
            seen.add((role, text))
        turns = [r[1] for r in own if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        initials = [r[2][:1] for r in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit = cheapest(list(zip(initials, kinds)))
        state, lines, at = "0", [], 0
        for letter in audit:
            role, text = ("", "") if letter == "I" else own[at][2:]
            at += letter != "I"
            if letter == "D":
                continue
            initial = role[:1] if letter == "K" else "a" if state == "U" else "u"
            role = role if letter == "K" else {"u": "user", "a": "assistant"}[initial]
            state = LEGAL[state, initial]
            lines.append(f"{role}:{text}")
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out.append((conv, gaps, *(kinds.count(k) for k in (1, 2, 3)), illegal, cost, audit, digest))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", range(4))
def test_blocks_equal_search(seed):
    rng = random.Random(seed)
    for _ in range(1500):
        rows = [(rng.choice("suat "), rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(rng.randrange(10))]
        fold = role_repair.Fold()
        cuts = sorted(rng.randrange(len(rows) + 1) for _ in range(2))
        for part in (rows[: cuts[0]], rows[cuts[0] : cuts[1]], rows[cuts[1] :]):
            if part:
                fold.add(role_repair.block("".join(i for i, _ in part), bytes(k for _, k in part)))
        assert fold.result() == cheapest(rows)


def test_tables_of_another_grammar():
    p = role_repair.Parser((("Doc", "X"), ("X", "uXa"), ("X", "")))

    def accepted(string):
        tops = {0}
        for c in string:
            tops = {n for t in tops for n in p.shift(t, c)}
        return any(map(p.accepts, tops))

    assert [s for s in ("", "ua", "uuaa", "uuuaaa", "u", "uaa", "uau", "au") if accepted(s)] == ["", "ua", "uuaa", "uuuaaa"]


def test_real_table_equals_search(spark, table):
    rows = [tuple(r) for r in table("conversations").select("conv_id", "turn", "role", "text").collect()]
    got = sorted((tuple(r) for r in op13_role_repair(spark, "/root/testdata/sf0.001").collect()), key=str)
    assert got == expected(rows, damage(rows))
    assert any("I" in r[7] for r in got) and any("R" in r[7] for r in got) and any("D" in r[7] for r in got)


def conversations(spark, rows):
    return spark.createDataFrame(
        [(*r, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, place string, kind string"
    )


def test_edges(spark):
    rng = random.Random(5)
    long = [(7, t, rng.choice(["user", "assistant", "tool"]), f"Words {t % 700}.") for t in range(1500)]
    rows = [
        (None, 0, "user", "Hi."), (None, 1, "assistant", "Yes."), (1, None, "user", "First?"), (1, 3, None, "x."), (1, 9, "assistant", None),
        (2, 0, "user", ""), (3, 0, "system", "Only a system line."), (4, 0, "", "No role."), (4, 1, "assistant", "Ends without"),
        (5, 0, "user", "Same."), (5, 1, "assistant", "Same."), (5, 2, "user", "Same."), (6, 5, "user", "U!"), (6, 5, "user", "U!"),
    ] + long
    got = role_repair.repair(conversations(spark, rows).repartition(5)).drop("n_repaired").collect()
    filled = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    assert sorted(map(tuple, got), key=str) == expected(rows, filled)
    assert role_repair.repair(conversations(spark, [])).collect() == []


def test_every_conversation_is_returned(spark):
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = [(dropped, 0, "user", "Gone."), (-1, 4, "assistant", "Alone.")]
    got = {r.conv_id: r for r in role_repair.report(conversations(spark, rows)).collect()}
    assert set(got) == {dropped, -1}
    assert tuple(got[dropped])[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
