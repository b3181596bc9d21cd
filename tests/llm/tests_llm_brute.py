"""Plain versions of two operators, for the pipeline test."""

import re

WORD = re.compile(r"[0-9a-z\u0080-\U0010ffff]+")


def components(texts, k, similarity):
    """doc_id -> smallest doc_id of its group, by comparing all pairs."""

    def shingles(text):
        w = (text or "").encode().lower().split()
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())

    sets = sorted((i, shingles(t)) for i, t in texts.items())
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and 100 * len(a & b) >= similarity * len(a | b):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return {i: find(i) for i in parent}


def hit_documents(texts, items, window=10):
    def words(text):
        return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))

    wanted = set()
    for item in items:
        w = words(item)
        n = min(window, len(w))
        if n:
            wanted |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    sizes = {len(x) for x in wanted}
    out = set()
    for i, text in texts.items():
        w = words(text)
        if any(tuple(w[k : k + n]) in wanted for n in sizes for k in range(len(w) - n + 1)):
            out.add(i)
    return out
