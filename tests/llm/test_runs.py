import hashlib
import random
import re
import zlib

import pytest

from zonewise.llm import runs
from zonewise.llm.queries import op11_periodic_runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(w):
    """(start, length, period) of all wanted runs, period by period."""
    out = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(6, 4 * q):
                if not any(all(w[k] == w[k + r] for k in range(i, i + length - r)) for r in range(1, q)):
                    out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def expected(doc_id, text):
    w = WORD.findall(text or "")
    n = len(w)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute(w)
    best = (None, None, None, None)
    for s, length, q in found:
        if best[0] is None or length * best[2] > best[1] * q:
            best = (s, length, q, 1000 * length // q)
    dropped = {k for s, length, q in found for k in range(s + q, s + length)}
    kept = " ".join(x for k, x in enumerate(w) if k not in dropped)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    return (doc_id, len(found), *best, *(hashlib.sha256(x.encode()).hexdigest() for x in (lines, kept)))


@pytest.mark.parametrize("letters", [1, 2, 3, 6])
def test_runs_equal_brute_force(letters):
    rng = random.Random(letters)
    given = []
    for _ in range(400):
        n = rng.randrange(70)
        w = [b"%d" % rng.randrange(letters) for _ in range(n)]
        if n > 4 and rng.random() < 0.5:
            a, p = rng.randrange(n), rng.randrange(1, n // 3 + 1)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        given.append(w)
    assert [[tuple(r) for r in rows.tolist()] for rows in runs.find(given)] == [brute(w) for w in given]


def test_nested_and_touching_runs():
    text = "a a a a a a b a a a a a a b a a a a a a b a a a a a a b c d c d c d c d e"
    w = text.encode().split()
    rows = [tuple(r) for r in runs.find([w])[0].tolist()]
    assert rows == brute(w)
    assert (0, 28, 7) in rows and (28, 8, 2) in rows and rows.count((0, 6, 1)) == 1


def test_real_table_equals_brute_force(spark, table):
    got = sorted(map(tuple, op11_periodic_runs(spark, "/root/testdata/sf0.001").collect()))
    assert got == sorted(expected(r.doc_id, r.text) for r in table("documents").collect())
    assert sum(r[1] > 0 for r in got) > 5


def test_edges(spark, docs):
    given = [
        (1, None), (2, ""), (3, " \t\n"), (4, "a"), (4, "a"), (5, "x " * 30_000), (6, "a b\x1c " * 6), (None, "y y y y y y"),
        (7, "a b c " * 3 + "d " + "ü é " * 4), (8, "no run at all here"), (9, "a a a a a"),
    ]
    got = runs.digest(runs.periodic_runs(docs(given).repartition(3), ["doc_id"])).collect()
    planted = [expected(i, t) if i is None else None for i, t in given]
    assert len(got) == len(given) and planted[7] in [tuple(r) for r in got]
    by_id = {r.doc_id: r for r in got}
    assert by_id[1].n_runs == by_id[2].n_runs == 0 and by_id[1].start is None
    assert by_id[1].collapsed_sha256 == hashlib.sha256(b"").hexdigest()
    assert (by_id[5].length, by_id[5].period, by_id[5].exponent_milli) == (30_000, 1, 30_000_000)
    assert by_id[6].period == 1 and by_id[9].n_runs == 0 and by_id[7].n_runs == 1
    assert runs.periodic_runs(docs([]), ["doc_id"]).collect() == []


def test_collapsed_text_and_runs_are_returned(spark, docs):
    row = runs.periodic_runs(docs([(1, "go a b a b a b a b on")]), ["doc_id", "row"]).first()
    assert row.collapsed == "go a b on" and row.row.row == "x"
    assert [tuple(r) for r in row.runs] == [(1, 8, 2)] and tuple(row.best) == (1, 8, 2)
