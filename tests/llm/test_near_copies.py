import random
from collections import Counter

import corpus_pipeline
from seabright.llm import near_copies


def plain_set(text):
    found = text.lower().split()
    return {" ".join(found[i : i + 5]) for i in range(len(found) - 4)} or ({" ".join(found)} if found else set())


def plain_components(texts):
    sets, parent = [plain_set(t or "") for t in texts], list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if len(a & b) >= 0.8 * len(a | b) - 1e-9 and (r := find(i)) != (s := find(j)):
                parent[max(r, s)] = min(r, s)
    return [find(i) for i in range(len(texts))]


def made():
    rng = random.Random(11)
    words = [f"w{i}" for i in range(400)]
    passage = rng.choices(words, k=60)
    texts = []
    for n in (5, 8, 20, 40, 90, 150, 300):
        for _ in range(6):
            base = rng.choices(words, k=n)
            texts.append(" ".join(base))
            for _ in range(5):  # copies of every similarity, from one another too
                for _ in range(rng.randint(0, max(1, n // 30))):
                    base = list(base)
                    base[rng.randrange(n)] = rng.choice(words)
                texts.append(" ".join(base))
    texts += [" ".join(passage + rng.choices(words, k=rng.randint(5, 60))) for _ in range(60)]
    return texts + ["", None, "  ", "one two", "One  two", "one"]


def test_components_are_those_of_all_pairs(spark):
    texts = made()
    want = plain_components(texts)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for tile in (4, 4096):
        got = {r.doc_id: r.component for r in near_copies.near_copy_components(docs, tile=tile).collect()}
        assert len(got) == len(texts)
        assert len(set(want)) == len(set(got.values())) == len({(want[i], got[i]) for i in got})
    kept = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(want))


def test_copies_that_only_the_original_links_are_one_group(spark):
    rng, texts = random.Random(21), []
    for g in range(4):
        base = [f"g{g}x{i}" for i in range(150)]
        texts.append(" ".join(base))
        for c in range(30):
            changed = set(rng.sample(range(7, 150, 12), 3))
            texts.append(" ".join(f"g{g}c{c}x{i}" if i in changed else w for i, w in enumerate(base)))
    assert len(set(plain_components(texts))) == 4
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component for r in near_copies.near_copy_components(docs).collect()}
    assert [len({got[i] for i in range(k, k + 31)}) for k in range(0, 124, 31)] == [1] * 4


def test_every_component_keeps_one_row(spark):
    rows = [(1, "a b c d e f"), (1, "u v w x y z"), (2, "u v w x y z"), (None, "k l m n o p"), (None, "k l m n o p"), (3, "a b c d e f"), (3, "a b c d e f")]
    kept = near_copies.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(r.text for r in kept) == Counter(set(t for _, t in rows))
    assert near_copies.keep_one_of_each(spark.createDataFrame([], "doc_id long, text string")).count() == 0
