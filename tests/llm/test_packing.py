import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from zonewise.llm import encoding, packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", "  a  b", "a\n\n b \n", "\tx y", "<|endoftext|> hi", "a\x1c b", "é̈ ̈x", " ", "\n", "a\x85 b", "x  ", "a\x00b c"]


def fewest(items, capacity):
    """Brute force: fewest sequences that hold all items."""
    items, best = sorted(items, reverse=True), [len(items)]

    def place(i, rooms):
        if len(rooms) >= best[0] and i < len(items):
            return
        if i == len(items):
            best[0] = min(best[0], len(rooms))
            return
        for k in {r: k for k, r in enumerate(rooms) if r >= items[i]}.values():
            rooms[k] -= items[i]
            place(i + 1, rooms)
            rooms[k] += items[i]
        rooms.append(capacity - items[i])
        place(i + 1, rooms)
        rooms.pop()

    place(0, [])
    return best[0]


def test_fixed_sets_leave_an_optimal_packing():
    draw = random.Random(1)
    for _ in range(600):
        capacity = draw.choice([10, 13, 20, 31])
        items = [draw.randint(1, capacity) for _ in range(draw.randint(0, 9))]
        fixed, left = packing.dominance_reduction(Counter(items), capacity)
        rest = [n for n, c in left.items() for _ in range(c)]
        assert sum(p.count for p in fixed) + fewest(rest, capacity) == fewest(items, capacity), items


def test_a_plan_holds_every_piece_once_and_comes_near_the_bound():
    draw = np.random.default_rng(0)
    counts = Counter((draw.lognormal(6, 1, 20_000).astype(int) % 1024 + 1).tolist())
    patterns = packing.plan(counts, 1024)
    held = Counter()
    for p in patterns:
        assert sum(n * r for n, r in p.lengths) <= 1024
        for n, r in p.lengths:
            held[n] += r * p.count
    assert held == counts
    assert sum(p.count for p in patterns) <= sum(n * c for n, c in counts.items()) / 1024 * 1.01 + 1


@pytest.mark.parametrize("name, spaces", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_remembered_words_give_the_ids_of_whole_texts(monkeypatch, name, spaces, table):
    monkeypatch.setattr(encoding, "REMEMBERED_WORDS", 5_000)
    path = public_tokenizers.path(name)
    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    made = encoding.Encoder(path, spaces)
    texts = ODD + [r.text or "" for r in table("documents").limit(60).collect()]
    for i in range(0, len(texts), 20):
        for text, ids in zip(texts[i : i + 20], made.ids(texts[i : i + 20])):
            assert list(ids) == plain.encode(text, add_special_tokens=False).ids, repr(text[:80])


def test_pack(docs):
    plain = Tokenizer.from_file(PATH)
    rows = [(1, "one two"), (2, None), (3, ""), (4, "word " * 2_500), (5, "one two"), (5, "one two"), (None, "lost " * 40)]
    out = packing.pack(docs(rows), PATH, capacity=64).collect()
    want = Counter()
    for doc_id, text in rows:
        ids = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        first = (len(ids) - 1) % 64 + 1
        starts = [0, *range(first, len(ids), 64)]
        for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)])):
            want[(doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    by_sequence = {}
    for r in out:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64


def test_pack_nothing(docs):
    assert packing.pack(docs([]), PATH).collect() == []
