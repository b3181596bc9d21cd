import random
import re

from zonewise.llm import licenses
from zonewise.llm.queries import op12_license_scan

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PHRASES = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}


def fold(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def base(text):
    w = fold(text)
    places = [
        (i, label) for p, label in PHRASES.items() for i in range(len(w) - len(p) + 1) if tuple(w[i : i + len(p)]) == p
    ]
    firsts = [i for i, _ in places]
    return len(w), len(places), min(firsts, default=None), max(firsts, default=None), ",".join(sorted({x for _, x in places}))


def test_matching_statistics_equal_brute_force():
    rng = random.Random(3)
    for _ in range(150):
        sequences = [[rng.randrange(3) for _ in range(rng.randrange(1, 9))] for _ in range(3)]
        built = licenses.Automaton(sequences)
        text = [rng.randrange(4) for _ in range(30)]
        for i, (state, length) in enumerate(built.statistics(text), 1):
            whole = [s for n in range(i, -1, -1) for s in [text[i - n : i]] if any(_at(t, s) for t in sequences) or not n]
            assert length == len(whole[0])
            if length:
                want = {(k, e) for k, t in enumerate(sequences) for e in _at(t, text[i - length : i])}
                assert set(built.ends[state]) == want and len(built.ends[state]) == len(want)


def _at(t, s):
    return [k + len(s) for k in range(len(t) - len(s) + 1) if t[k : k + len(s)] == s] if s else []


def test_base_equals_brute_force(spark, table):
    given = {r.doc_id: r.text for r in table("documents").collect()}
    for r in op12_license_scan(spark, "/root/testdata/sf0.001").collect():
        want = base(given[r.doc_id])
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == want
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
        # Licence lines of the given texts that hold no phrase.
        assert ("cc-by-nc" in r.labels.split(",")) == ("Licensed under CC BY-NC 4.0" in (given[r.doc_id] or ""))


def test_long_texts_with_changes_are_covered(spark, docs):
    grant = licenses.TEMPLATES["mit"][2].split()
    changed = " ".join(w for i, w in enumerate(grant) if i % 17 != 8)
    apart = " ".join(grant[:20]) + " filler" * 40 + " " + " ".join(grant[20:40])
    given = [
        (1, f"Copyright 2020 Someone. {changed}. The end."), (2, apart), (3, None), (4, ""), (5, "the rights to use the software"),
        (6, "word " * 50_000 + "Licensed under CC BY-SA 4.0."), (6, "word " * 50_000 + "Licensed under CC BY-SA 4.0."),
        (None, "mit license, MIT-License; mit  licenses"), (7, "Licensed under CC BY 4.0"),
        (8, " ".join(licenses.TEMPLATES["unlicense"]) + " x " * 30 + " ".join(licenses.TEMPLATES["isc"])),
    ]
    got = licenses.report(licenses.scan(docs(given), ["doc_id"])).collect()
    by_id = {r.doc_id: r for r in got}
    assert len(got) == len(given)
    assert by_id[1].labels == "mit" and by_id[1].n_base == 0 and 0.7 < by_id[1].score < 1
    assert by_id[1].spans[0]["first"] == 3 and by_id[1].spans[0]["behind"] == 3 + len(fold(changed))
    assert by_id[2].labels == by_id[5].labels == "" and by_id[3].score == by_id[4].score == 0
    assert by_id[6].labels == "cc-by-sa" and by_id[7].labels == "cc-by" and by_id[8].labels == "isc,unlicense"
    assert (by_id[None].n_base, by_id[None].first_word, by_id[None].last_word) == (2, 0, 2)
    assert licenses.scan(docs([]), ["doc_id"]).collect() == []


def test_own_templates(docs):
    found = licenses.scan(docs([(1, "say hello big wide world now")]), ["doc_id"], {"x": ["hello big wide world"]}, {})
    row = licenses.report(found).first()
    assert (row.labels, row.score, row.n_base) == ("x", 1.0, 0)
