import random

import numpy as np

from seabright.llm import minmax


def plain_sets(texts, words):
    lower = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
    out = []
    for t in texts:
        found = (t or "").encode().translate(lower).split()
        out.append({b" ".join(found[i : i + words]) for i in range(len(found) - words + 1)} or ({b" ".join(found)} if found else set()))
    return out


def plain(rows, words=2):
    sets, parent = plain_sets([t for _, t in rows], words), list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b) and (r := find(i)) != (s := find(j)):
                parent[max(r, s)] = min(r, s)
    ids = {}
    for k, (i, _) in enumerate(rows):
        ids.setdefault(find(k), []).append(i)
    least = {root: min((i for i in found if i is not None), default=None) for root, found in ids.items()}
    out = [(i, len(sets[k]), least[find(k)], i is not None and i == least[find(k)]) for k, (i, _) in enumerate(rows)]
    return sorted(out, key=str)


def made(seed=5):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    passage, texts = rng.choices(words, k=40), []
    for n in (1, 2, 3, 5, 6, 10, 11, 20, 40, 90, 200):
        for _ in range(5):
            base = rng.choices(words, k=n)
            texts.append(" ".join(base))
            for _ in range(6):
                for _ in range(rng.randint(0, max(1, n // 20))):
                    base = list(base)
                    base[rng.randrange(n)] = rng.choice(words)
                texts.append(" ".join(base))
    texts += [" ".join(passage + rng.choices(words, k=rng.randint(3, 30))) for _ in range(80)]
    return texts


def test_components_are_those_of_all_pairs(spark):
    rows = [(1000 - i, t) for i, t in enumerate(made())]
    rows += [(5, "A b  C"), (6, "a\tB\nc"), (7, None), (8, ""), (9, " \x0b"), (None, "a b c"), (None, "only one without an id"), (6, "other words in this row"), (5, "A b  C"), (10, "É x"), (11, "é x"), (12, "y" * 5000)]
    docs = spark.createDataFrame([(i, t, 1, "clash") for i, t in rows], "doc_id long, text string, size int, node string")
    want = plain(rows)
    for options in ({}, {"tile": 8, "radius": None}):
        got = minmax.minmax_components(docs, words=2, **options).collect()
        assert sorted(map(tuple, got), key=str) == want, options


def starred(groups=4, copies=30, n=120, edits=5, seed=21):
    """Groups of an original and copies of it, each alike to the original but not to the other copies."""
    rng, texts = random.Random(seed), []
    for g in range(groups):
        base = [f"g{g}x{i}" for i in range(n)]
        texts.append(" ".join(base))
        for c in range(copies):
            changed = set(rng.sample(range(1, n, 4), edits))
            texts.append(" ".join(f"g{g}c{c}x{i}" if i in changed else w for i, w in enumerate(base)))
    return texts


def test_copies_that_only_the_original_links_are_one_group(spark):
    rows = list(enumerate(starred()))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain(rows)
    assert len({r[2] for r in want}) == 4
    assert sorted(map(tuple, minmax.minmax_components(docs, words=2).collect()), key=str) == want


def test_no_link_is_missed_at_the_threshold(spark):
    """Pairs of sets at a similarity of exactly 0.8 or a little more, of every size."""
    rng, rows = random.Random(9), []
    for extra in [1, 2, 3, 5, 9, 18, 45] * 30:  # 8 of 10 are shared
        tag = len(rows)
        shared = [f"s{tag}x{i}" for i in range(8 * extra)]
        left, right = (shared + [f"{side}{tag}x{i}" for i in range(extra)] for side in "lr")
        rng.shuffle(left)
        rows += [(len(rows), " ".join(left)), (len(rows) + 1, " ".join(right))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minmax.minmax_components(docs, words=1).collect()}
    assert [got[i] for i, _ in rows] == [i - i % 2 for i, _ in rows]


def test_signature_values_agree_as_often_as_the_sets_do():
    rng = np.random.default_rng(3)
    by = minmax.multipliers(400, 1)
    for share in (0.2, 0.5, 0.8):
        same = rng.integers(0, 2**63, int(300 * share), np.uint64)
        a, b = (np.concatenate([same, rng.integers(0, 2**63, (300 - len(same)) // 2, np.uint64)]) for _ in range(2))
        left, right = minmax.signature(a, by, 64), minmax.signature(b, by)
        agree = np.mean([(x == y).mean() for x, y in zip(left, right, strict=True)])
        assert abs(agree - share) < 0.06
        assert (left[0] == (by[:, None] * a).min(axis=1)).all() and (left[1] == (by[:, None] * a).max(axis=1)).all()


def test_no_documents(spark, nothing):
    assert minmax.minmax_components(nothing).count() == 0
