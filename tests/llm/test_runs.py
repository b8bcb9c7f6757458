import hashlib
import random
import zlib

import numpy as np
import pytest

from seabright.llm import periodic_runs, queries


def plain_runs(words, least_length=6, least_exponent=4):
    """Every stretch of every period, the smallest period of each."""
    numbers = {w: i for i, w in enumerate(dict.fromkeys(words))}
    a, found = np.array([numbers[w] for w in words], np.int64), {}
    for q in range(1, len(words) // least_exponent + 1):
        same = np.concatenate([[0], a[q:] == a[:-q], [0]]).astype(np.int8)
        for begin, end in zip(np.flatnonzero(np.diff(same) == 1).tolist(), np.flatnonzero(np.diff(same) == -1).tolist()):
            if end - begin + q >= max(least_length, least_exponent * q):
                found.setdefault((begin, end - begin + q), q)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("least_length, least_exponent", [(6, 4), (2, 2), (1, 3), (10, 2)])
def test_runs_of_many_texts_at_once(least_length, least_exponent, monkeypatch):
    rng = random.Random(least_length)
    for n in range(400):
        if n == 200:
            monkeypatch.setattr(periodic_runs, "AT_ONCE", 7)
        texts = []
        for _ in range(rng.randint(0, 5)):
            size, kinds = rng.randint(0, 60), rng.choice([1, 2, 3, 5, 30])
            words = [rng.randrange(kinds) for _ in range(size)]
            if size and rng.random() < 0.6:
                a = rng.randrange(size)
                p = rng.randint(1, max(1, (size - a) // 3))
                words = [words[i] if i < a else words[a + (i - a) % p] for i in range(size)]
                words[rng.randrange(size)] = 99 if rng.random() < 0.5 else words[0]
            texts.append([b"%d" % w for w in words])
        got = periodic_runs.maximal_runs(*periodic_runs._numbered(texts), least_length, least_exponent)
        base = np.cumsum([0, *map(len, texts)])
        want = [(base[k] + s, n, q) for k, words in enumerate(texts) for s, n, q in plain_runs(words, least_length, least_exponent)]
        assert list(zip(*(x.tolist() for x in got), strict=True)) == want


def test_long_runs():
    for n, q in ((200_000, 1), (100_000, 37)):
        got = periodic_runs.maximal_runs(*periodic_runs._numbered([[b"%d" % (i % q) for i in range(n)]]))
        assert [x.tolist() for x in got] == [[0], [n], [q]]


def plain_row(doc_id, text):
    words = (text or "").encode().split()
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    gone = {i for s, k, q in runs for i in range(s + q, s + k)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    lines = "".join(f"{s},{k},{q}\n" for s, k, q in runs)
    digest = lambda raw: hashlib.sha256(raw).hexdigest()
    return (doc_id, len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2], digest(lines.encode()), digest(b" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_query_against_a_plain_one(spark, sf_dir, documents):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect() + documents.collect()]
    rows += [(i, "a b c d e f g h i j k l " * 3) for i in range(200, 260)] + [(300, "z " * 5_000)]
    docs = spark.createDataFrame([(i, t, 3, "clash") for i, t in rows], "doc_id long, text string, h int, words string")
    got = periodic_runs.run_digests(periodic_runs.periodic_runs(queries.with_periodic_tails(docs))).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted((plain_row(*r) for r in rows), key=key)


def test_empty_table_and_a_bad_exponent(spark, nothing):
    assert periodic_runs.run_digests(periodic_runs.periodic_runs(queries.with_periodic_tails(nothing))).count() == 0
    with pytest.raises(ValueError):
        periodic_runs.maximal_runs(np.zeros(3, np.int64), np.zeros(3, np.int64), 6, 1)
