from collections import Counter
from itertools import permutations

from seabright.llm import filter_audit

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_tokens int, failed int, part string"
LABELS = "doc_id long, quality int, toxic int, part string"


def plain(docs, labels):
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, t in labels if t == 1}
    rows = []
    for i, text, source in docs:
        text = text or ""
        words = text.encode().split()
        smaller = [j for j, other, _ in docs if (other or "") == text and j is not None and i is not None and j < i]
        failed = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text),
            "D": any(c in "#$%&*|" for c in text), "E": bool(smaller),
        }
        rows.append((source or "", {k for k, v in failed.items() if v}, i in good, i in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        mine, total = [r for r in rows if r[0] == part], Counter()
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, x in enumerate(order, 1):
                gone = [r for r in left if x in r[1]]
                left = [r for r in left if x not in r[1]]
                total[x] += len(gone)
                out[part, order, step] = [len(left), len(gone), sum(x in r[1] for r in mine) - len(gone), sum(r[1] == {x} for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(total[order[step - 1]])
    return out


def odd_rows():
    long = " ".join(f"w{i}" for i in range(250))
    same, other = long * 40, long * 39 + long.replace("w249", "w248")
    rows = [
        (1, long, "a"), (2, long, "a"), (2, long, "b"), (3, long, None), (None, long, ""), (None, long, "a"), (4, None, "a"), (5, "", "b"), (6, " \t\n ", "b"),
        (7, "x " * 300, "b"), (8, "ABC " * 300, "b"), (9, long + " 5%", "a"), (10, same, "a"), (11, other, "a"), (12, same, "b"), (13, same[:-1] + "\U0001f600", "b"), (0, "ABC " * 300, "a"),
        (14, "\U0001f600" * 64 + "a", "a"), (15, "\U0001f600" * 64 + "b", "a"), (16, "\U0001f600" * 64 + "a", "a"), (17, "a\x1cb \x0b\x0cc", "c"),
    ]
    labels = [(1, 1, 0), (2, 1, 1), (2, 0, None), (2, 1, 1), (7, None, 1), (12, 1, 0), (None, 1, 1), (99, 1, 1)]
    return rows, labels


def run(spark, rows, labels):
    docs = spark.createDataFrame([(i, t, "en", s, 0, 7, 1, "clash") for i, t, s in rows], DOCS)
    found = filter_audit.audit_filters(docs, spark.createDataFrame([(*x, "clash") for x in labels], LABELS))
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return {(r.part, r.filter_order, r.step): [r[n] for n in names] for r in found.collect()}


def test_audit_against_a_plain_one(spark):
    rows, labels = odd_rows()
    assert run(spark, rows, labels) == plain(rows, labels)


def test_full_texts_decide_where_hashes_collide(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(filter_audit, "_block", lambda text, k: F.when(F.char_length(text) > filter_audit.BLOCKS[k], F.lit(1).cast("long")))
    rows, labels = odd_rows()
    assert run(spark, rows, labels) == plain(rows, labels)


def test_shuffled_classes(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "MOST_CLASSES", 0)
    rows, labels = odd_rows()
    assert run(spark, rows, labels) == plain(rows, labels)


def test_no_documents(spark):
    assert run(spark, [], []) == {}
