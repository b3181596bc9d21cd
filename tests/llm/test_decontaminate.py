import hashlib
import re

from zonewise.llm import decontaminate

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def tokens(text):
    return WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))


def brute(docs, items, window=10):
    out = []
    for doc_id, text in docs:
        w = tokens(text)
        hit, found = set(), set()
        for item, t in items:
            v = tokens(t)
            n = min(window, len(v))
            wanted = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if n else set()
            for i in range(len(w) - n + 1) if n else ():
                if tuple(w[i : i + n]) in wanted:
                    hit.update(range(i, i + n))
                    found.add(str(item))
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(found), digest, bool(hit)))
    return sorted(out, key=str)


LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"


def rows():
    items = [(1, LONG), (2, "Short ITEM"), (3, None), (4, "!!"), (5, LONG[6:]), (10, "Ünïcode wörds é"), (2, "Short ITEM")]
    docs = [
        (1, f"before {LONG.upper()} after"), (2, LONG.replace(" ", "-")), (3, "a short, item!"), (4, None), (5, ""),
        (6, " ".join(LONG.split()[:9])), (7, " ".join(LONG.split()[:10]) + " x " + " ".join(LONG.split()[3:])),
        (8, "ünïcode wörds é"), (8, "ünïcode wörds é"), (9, ("filler " * 5000) + LONG), (None, "short item"), (11, "clean"),
        (12, "short"), (13, "item short"),
    ]
    return docs, items


def test_report_equals_brute_force(spark, docs, monkeypatch):
    given, items = rows()
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    for block in (decontaminate.BLOCK_BYTES, 60):
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
        got = sorted(map(tuple, decontaminate.report(docs(given).repartition(3), benchmark).collect()), key=str)
        assert got == brute(given, items)


def test_real_tables_equal_brute_force(table):
    given = [(r.doc_id, r.text) for r in table("documents").collect()]
    items = [(r.item_id, r.text) for r in table("benchmark").collect()]
    got = sorted(map(tuple, decontaminate.report(table("documents"), table("benchmark")).collect()), key=str)
    assert got == brute(given, items)


def test_clean_documents_and_spans(spark, docs):
    given, items = rows()
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    kept = decontaminate.clean(docs(given), benchmark)
    assert kept.columns == docs(given).columns
    # 8 differs from its item in a letter beyond A-Z, which keeps its case.
    assert sorted(r.doc_id for r in kept.collect()) == [4, 5, 6, 8, 8, 11, 12, 13]
    cut = {r.doc_id: r.text for r in decontaminate.clean(docs(given), benchmark, remove="spans").collect()}
    assert cut[1] == "before  after" and cut[3] == "a !" and cut[4] is None and cut[11] == "clean"
    assert cut[7] == " x "


def test_empty_tables(spark, docs):
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.report(docs([]), nothing).collect() == []
    assert [r.n_hit for r in decontaminate.report(docs([(1, "a b")]), nothing).collect()] == [0]
