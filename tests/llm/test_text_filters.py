import hashlib
import math
import random
import re
from collections import Counter
from functools import cache

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from seabright.llm import chat_log, components, pii, pii_tagger, quality_lm, simhash, url_reputation
from seabright.llm.queries import RULES


# URL reputation


def test_url_parts(spark):
    urls = [None, "", "no scheme", "http://Ex.COM", "HTTP://A.b.Org/p/q?x#y", "s://h?q/z", "s://É.com#f", "a://b://c/d", "x:///p"]
    got = spark.createDataFrame([(u,) for u in urls], "url string").select(url_reputation.host_of(F.col("url")).alias("h"), url_reputation.path_of(F.col("url")).alias("p")).collect()
    assert [tuple(r) for r in got] == [("", ""), ("", ""), ("", ""), ("ex.com", ""), ("a.b.org", "/p/q"), ("h", ""), ("É.com", ""), ("b:", "//c/d"), ("", "/p")]


def test_domains(spark):
    got = spark.createDataFrame([("a.b.example.com",), ("x.y.co.uk",), ("co.uk",), ("host",), ("",)], "h string")
    got = got.select(url_reputation.domain_of(F.col("h")).alias("d"), url_reputation.suffix_of(F.col("h")).alias("s")).collect()
    assert [tuple(r) for r in got] == [("example.com", "com"), ("y.co.uk", "co.uk"), ("co.uk", "co.uk"), ("host", "host"), ("", "")]
    hosts = ["a.com:8080", "joe:x@a.com", "a.com.", "10.0.0.1:80", "[::1]:80", "b.gov.au", "x.co.museum", "q.b.blog.io"]
    site = url_reputation.site_of(F.col("h"))
    got = spark.createDataFrame([(h,) for h in hosts], "h string").select(site, url_reputation.domain_of(site, ["blog.io"]), url_reputation.suffix_of(site, ["blog.io"])).collect()
    assert [tuple(r) for r in got] == [("a.com", "a.com", "com")] * 3 + [("10.0.0.1", "10.0.0.1", ""), ("[::1]", "[::1]", ""), ("b.gov.au", "b.gov.au", "gov.au"), ("x.co.museum", "co.museum", "museum"), ("q.b.blog.io", "b.blog.io", "blog.io")]


def test_rules_and_shrinkage(spark):
    pages = [(i, f"http://good.a.net/{i}") for i in range(200)] + [(1000 + i, f"http://bad.b.net/{i}") for i in range(200)]
    pages += [(5000, "http://www.example.org/es/1"), (5001, "http://example.org/en/12"), (5002, "http://example.org/en/2"), (5003, "http://notexample.org/es/"), (5004, "http://q.com/de/x"), (5005, None), (None, "http://new.a.net/")]
    labels = [(i, 1, 0) for i in range(200)] + [(1000 + i, 0, 0) for i in range(200)] + [(None, 1, 0), (5005, None, None), (3, 1, 0)]
    got = url_reputation.judge_urls(spark.createDataFrame([(i, u, "x") for i, u in pages], "page_id long, url string, verdict string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), RULES)
    by = {r.page_id: r for r in got.collect()}
    assert len(by) == len(pages)
    assert {by[i].verdict for i in range(200)} == {"allow"} and {by[1000 + i].verdict for i in range(200)} == {"block"}
    assert [by[i].rule for i in range(5000, 5006)] == ["example.org/es/", "example.org/en/1", "org/", "org/", "com/de/", None]
    assert [by[i].verdict for i in range(5000, 5005)] == ["block", "block", "allow", "allow", "block"]
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.verdict for r in url_reputation.judge_urls(spark.createDataFrame(pages, "page_id long, url string"), none, []).collect()} == {"block"}
    assert url_reputation.judge_urls(spark.createDataFrame([], "page_id long, url string"), none, RULES).count() == 0


# SimHash


def plain_print(text, words=4):
    found = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    shingles = [" ".join(found[i : i + words]) for i in range(len(found) - words + 1)] or ([" ".join(found)] if found else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("text", ["", "  ", "a", "one two three", "one two three four", "A b C d E f É\u00a0g\x0bh\x1ci", "x " * 50, "the cat " * 30 + "sat"])
def test_fingerprint(text):
    assert simhash.majority(simhash.shingle_hashes(text, 4, 42)) == simhash.majority(simhash.shingle_hashes(text, 4, 42, at_once=2)) == plain_print(text)


def test_fingerprint_of_a_very_long_text():
    text = "ab Cd  e\n" * 120_000
    assert simhash.majority(simhash.shingle_hashes(text, 4, 42)) == simhash.majority(simhash.shingle_hashes(" ".join(text.split()), 4, 42)) == plain_print(text[:9000])


@pytest.mark.parametrize("radius", [1, 3, 4, 6])
def test_bit_sliced_links(radius):
    rng = np.random.default_rng(radius)
    fp = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fp = np.concatenate([fp, fp ^ np.uint64(1), fp[:20] ^ np.uint64(0b1011 << 30), fp[:10] ^ np.uint64(0b11111 << 7), fp[:5] ^ np.uint64(0x7F)])
    planes = simhash.BitPlanes(fp)
    for shift in (1, 2, 40, 63, 64, 65, 100):
        ask = np.arange(len(fp)) + shift < len(fp)
        want = [i for i in range(len(fp) - shift) if int(fp[i] ^ fp[i + shift]).bit_count() <= radius]
        assert planes.near(shift, ask, radius).tolist() == want


def union(n, pairs):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    return [find(i) for i in range(n)]


def test_links_with_tiles(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 30, dtype=np.uint64)
    crowd = np.unique([int(base[0]) ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 63, (300, 2))]).astype(np.uint64)
    fp = np.unique(np.concatenate([base, base ^ np.uint64(6), crowd]))
    want = union(len(fp), [(i, j) for i in range(len(fp)) for j in range(i) if int(fp[i] ^ fp[j]).bit_count() <= 4])
    at = {int(x): i for i, x in enumerate(fp.view(np.int64))}
    assert [simhash.runs_of(n, 4) for n in (0, 10**6, 10**9, 10**12)] == [(6, 2), (6, 2), (8, 4), (9, 5)]
    for tile, agree in ((16, None), (4096, 3), (4096, 4)):
        edges = simhash.near_links(spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp long"), tile=tile, agree=agree).collect()
        assert union(len(fp), [(at[e.u], at[e.v]) for e in edges]) == want
        assert all(len({want[at[e.u]], want[at[e.v]]}) == 1 for e in edges)


@pytest.mark.parametrize("hubs", [100_000, 1])
def test_components(spark, hubs, monkeypatch):
    monkeypatch.setattr(components, "HUBS", hubs)
    monkeypatch.setattr(components, "SMALLEST_HUB", 5000 if hubs > 1 else 3)
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(rng.randrange(100, 400), rng.randrange(100, 400)) for _ in range(150)] + [(500, 500 + i) for i in range(1, 60)] + [(7, 7)]
    want = union(600, edges)
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got.get(i, i) == want[i] for i in range(600))
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_near_duplicates(spark, documents, nothing):
    rows = simhash.near_duplicate_components(documents).collect()
    texts = [(r.doc_id, r.text or "") for r in documents.collect()]
    assert sorted((r.doc_id or 0, r.fingerprint) for r in rows) == sorted((i or 0, f"{plain_print(t):016x}") for i, t in texts)
    by = {r.doc_id: r.component_id for r in rows}
    assert by[1] == by[8] == 1 and by[2] == by[3] == by[4] == 2 and by[None] is None
    kept = simhash.keep_one_of_each(documents)
    assert kept.columns == documents.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 5, 6, 7, 9, 10, 11]
    assert simhash.near_duplicate_components(nothing).count() == 0 and simhash.keep_one_of_each(nothing).count() == 0


# Chat formatting


def test_render_reads_back(spark):
    rows = [(1, 0, "user", "a <|im_end|> \\<| \\"), (1, 1, "assistant", "b\\|<|im_start|>assistant<|im_sep|>"), (1, 1, "assistant", None), (1, 3, None, "<"), (2, None, "assistant", ""), (None, 5, "user", "|x\n"), (3, 2, "<|role\n", "<<|")]
    events = spark.createDataFrame([(c, s, "message", None, r, t, 9) for c, s, r, t in rows], "conv_id long, seq long, kind string, message_id string, role string, text string, n_turns int")
    rendered = chat_log.render(chat_log.fold_events(events))
    for r in rendered.withColumn("turns", chat_log.read_back(F.col("formatted"))).collect():
        mine = sorted(((s is not None, s or 0, ro or "", t or "") for c, s, ro, t in rows if c == r.conv_id))
        assert [tuple(t) for t in r.turns] == [m[2:] for m in mine]
    d = {r.conv_id: r for r in chat_log.digests(rendered).collect()}
    said = "b\\|<|im_start|>assistant<|im_sep|>"
    assert (d[1].n_turns, d[1].loss_chars, d[1].loss_sha256) == (4, len(said), hashlib.sha256(said.encode()).hexdigest())
    assert d[2].loss_chars == 0 and d[2].loss_sha256 == hashlib.sha256(b"").hexdigest()
    assert chat_log.digests(chat_log.render(chat_log.fold_events(events.limit(0)))).count() == 0


def test_fold(spark):
    log = [
        (1, 1, "message", "u1", "user", "hi"), (1, 2, "delta", "a1", "assistant", "he"), (1, 3, "delta", "a1", None, "llo"), (1, 4, "message", "u2", "user", "more?"), (1, 5, "delta", "a2", "assistant", "x"),
        (1, 6, "edit", "u1", None, "hey"), (1, 7, "regenerate", "a1", None, None), (1, 8, "delta", "a1", None, "good day"), (1, 9, "message", "u3", "user", "thanks"), (1, 10, "delta", "a3", "assistant", None), (2, 1, "message", None, "user", "plain"),
    ]
    got = chat_log.fold_events(spark.createDataFrame(log, "conv_id long, seq long, kind string, message_id string, role string, text string")).orderBy("conv_id", "seq").collect()
    assert [(r.conv_id, r.role, r.text) for r in got] == [(1, "user", "hey"), (1, "assistant", "good day"), (1, "user", "thanks"), (1, "assistant", ""), (2, "user", "plain")]


# Quality


def plain_kneser_ney(texts):
    """Interpolated modified Kneser-Ney probability of any n-gram, straight from the definition."""
    N = quality_lm.ORDER
    counts = {N: Counter(g for t in texts for g in plain_grams(t))}
    for k in range(N - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    ds, contexts = {}, {k: {} for k in counts}
    for k, c in counts.items():
        n = Counter(c.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
        raw = (1 - 2 * y * n[2] / n[1] if n[1] else 0.5, 2 - 3 * y * n[3] / n[2] if n[2] else 1.0, 3 - 4 * y * n[4] / n[3] if n[3] else 1.5)
        ds[k] = [0, *(min(max(d, 0.05), i - 0.05) for d, i in zip(raw, (1, 2, 3), strict=True))]
        for g, x in c.items():
            total, held = contexts[k].get(g[:-1], (0, 0.0))
            contexts[k][g[:-1]] = total + x, held + ds[k][min(x, 3)]

    def p(g):
        k = len(g)
        if not k:
            return 1 / (len(counts[1]) + 1)
        if g[:-1] not in contexts[k]:
            return p(g[1:])
        total, held = contexts[k][g[:-1]]
        c = counts[k].get(g, 0)
        return (c - ds[k][min(c, 3)] + held * p(g[1:])) / total

    return cache(p)


def plain_grams(text):
    text = quality_lm.START * (quality_lm.ORDER - 1) + text
    return [text[i : i + quality_lm.ORDER] for i in range(len(text) - quality_lm.ORDER + 1)]


def plain_perplexity(p, text):
    return round(math.exp(-sum(math.log(p(g)) for g in plain_grams(text)) / len(text)), 4) if text else None


def test_model_is_kneser_ney(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab. C9é日") for _ in range(rng.randint(0, 60))) for _ in range(30)] + [""]
    counts = quality_lm.count_grams(spark.createDataFrame([(1, t) for t in texts] + [(0, "abc")], "fold int, text string"))
    p = plain_kneser_ney(texts)
    asked = {g for t in texts for g in plain_grams(t)} | {"".join(rng.choice("ab. C9é日Ж") for _ in range(4)) for _ in range(200)}
    rows = quality_lm.probabilities(spark.createDataFrame([(1, g) for g in asked], "fold int, gram string"), quality_lm.kneser_ney(counts)).collect()
    assert len(rows) == len(asked) and all(abs(r.p - p(r.gram)) < 1e-9 for r in rows)
    letters = {c for t in texts for c in t}
    assert abs(sum(p("ab." + c) for c in letters) + p("ab.Ж") - 1) < 1e-9


def test_grams_of_many_letters():
    """More distinct letters than four digits of a 62-bit number can tell apart."""
    text = "".join(chr(c) for c in range(0x3400, 0x3400 + 200)) + "".join(chr(0x10000 + c) for c in range(56_000))
    grams = quality_lm.Grams(["", text, "ab"])
    assert grams.pairs is not None
    assert grams.spelled(grams.numbers).to_pylist() == plain_grams(text) + plain_grams("ab")
    few = quality_lm.Grams(["xyz", "a\0b"])
    assert few.spelled(few.numbers).to_pylist() == plain_grams("xyz") + plain_grams("a\ufffdb")


def percentile(values, share):
    values = sorted(values)
    at = share * (len(values) - 1)
    low = int(at)
    return values[low] + (values[min(low + 1, len(values) - 1)] - values[low]) * (at - low)


def test_quality_is_the_plain_method(spark, sf_dir, monkeypatch):
    """Perplexities, limits and decisions of the contract query over a whole table, by a plain script; blocks cut small."""
    monkeypatch.setattr(quality_lm, "BLOCK", 100_000)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fold = {r.doc_id: r.fold for r in docs.select("doc_id", quality_lm.fold_of(F.col("doc_id").cast("long")).alias("fold")).collect()}
    trusted = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect() if r.quality == 1 and r.toxic != 1}
    rows = [(r.doc_id, r.lang, r.text or "") for r in docs.collect()]
    model = [plain_kneser_ney([t for d, _, t in rows if d in trusted and fold[d] == f]) for f in (0, 1)]
    plain = {d: plain_perplexity(model[1 - fold[d]], t) for d, _, t in rows}
    slack = {d: math.exp(1 / math.sqrt(max(1, len(t))) + 120 / max(1, len(t))) for d, _, t in rows}
    half_up = lambda x: math.floor(x * 100 + 0.5) / 100
    limits = {}
    for lang in {l for _, l, _ in rows} | {"any"}:
        known = [d for d, l, _ in rows if d in trusted and plain[d] is not None and lang in (l, "any")]
        if known:
            limits[lang] = percentile([half_up(plain[d] * slack[d]) for d in known], 0.002) * 0.98, percentile([half_up(plain[d] / slack[d]) for d in known], 0.998) * 1.02
    got = {r.doc_id: r for r in quality_lm.judge_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).collect()}
    assert len(got) == len(rows) and len(trusted) > 20
    for d, lang, t in rows:
        low, high = limits.get(lang, limits["any"])
        low, high = low / slack[d], high * slack[d]
        assert got[d].length == len(t) and (plain[d] is None) == (got[d].perplexity is None)
        if plain[d] is not None:
            assert abs(got[d].perplexity - plain[d]) < 2e-4 and abs(got[d].low - low) < 0.02 and abs(got[d].high - high) < 0.02
            if min(abs(plain[d] - low), abs(plain[d] - high)) > 0.05:
                assert got[d].keep == (low <= plain[d] <= high)


def test_quality_on_held_out_labels(spark, sf_dir):
    docs, labels = spark.read.parquet(sf_dir.replace("sf0.001", "sf0.01") + "/documents.parquet"), spark.read.parquet(sf_dir.replace("sf0.001", "sf0.01") + "/labels.parquet")
    seen = labels.where("doc_id % 2 = 0")
    held = quality_lm.judge_quality(docs, seen).join(labels.where("doc_id % 2 = 1"), "doc_id").groupBy("quality").agg(F.avg(F.col("keep").cast("double")).alias("kept")).collect()
    kept = {r.quality: r.kept for r in held}
    assert kept[1] >= 0.97 and kept[0] <= 0.2


def test_quality_edges(spark, documents, nothing):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = quality_lm.judge_quality(documents, none).collect()
    assert len(rows) == documents.count() and {r.keep for r in rows if r.length} == {True} and not any(r.keep for r in rows if not r.length)
    some = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (9, 0, 1), (None, 1, 0), (777, 1, None)], "doc_id long, quality int, toxic int")
    assert quality_lm.judge_quality(documents, some).count() == documents.count()
    assert quality_lm.keep_good(documents, none).columns == documents.columns
    assert quality_lm.judge_quality(nothing, some).count() == 0
    odd = documents.select("*", *(F.lit(1).alias(c) for c in ("of_lang", "low", "keep", "row", "length", "perplexity", "block"))).drop("lang")
    assert quality_lm.keep_good(odd, some).columns == odd.columns and quality_lm.judge_quality(odd, some).count() == documents.count()


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_texts_of_by_broadcast_and_by_filter(spark, documents, most, monkeypatch):
    monkeypatch.setattr(quality_lm, "MOST_IDS", most)
    ids = spark.createDataFrame([(1,), (9,), (777,)], "doc_id long")
    assert sorted(r.doc_id for r in quality_lm.texts_of(documents, ids).collect()) == [1, 1, 9]


# Personal data


def plain_spans(text):
    """The patterns as the contract writes them."""
    found = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for kind, pattern in ((2, r"[0-9]([\x20-]?[0-9])+"), (3, r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if (13 <= len(digits) <= 19 and pii_tagger.luhn(digits)) if kind == 2 else 9 <= len(digits) <= 15:
                found.append((kind, *m.span()))
    return found


def test_patterns():
    rng = random.Random(3)
    parts = [*"ab.@+-1234567890 ()[]_%\n", "a@b.co", "1.2.3.4", "4111 1111 1111 1111", "+1 (988) 555-2485", "@", "..", "é"]
    for _ in range(5000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(text) == plain_spans(text)
    for text in ("1" * 100_000, "a." * 50_000 + "@", "1-" * 50_000, "+1" + " 1" * 50_000, "1." * 50_000):
        pii.base_spans(text)  # in linear time


def test_gradients():
    tagger = pii_tagger.Tagger(hidden=3, seed=1)
    x, y = (np.stack(a) for a in zip(*(pii_tagger.Examples(1).window(7) for _ in range(4)), strict=True))
    _, grads = tagger.gradients(x, y)
    rng = np.random.default_rng(0)
    for name, g in grads.items():
        for at in rng.integers(0, g.size, 6):
            values = []
            for step in (1e-5, -1e-5):
                tagger.p[name].flat[at] += step
                values.append(tagger.gradients(x, y)[0])
                tagger.p[name].flat[at] -= step
            assert abs((values[0] - values[1]) / 2e-5 - g.flat[at]) < 1e-6, name


def test_viterbi_is_the_best_path():
    from itertools import product

    tagger = pii_tagger.Tagger(hidden=2, seed=3)
    tagger.p["t"] = np.random.default_rng(1).normal(size=tagger.p["t"].shape)
    x = np.array([[1, 28, 29, 5]], np.uint8)
    e = tagger.emissions(x)[:, :, 0]
    best = max(product(range(pii_tagger.TAGS), repeat=4), key=lambda p: sum(e[i, t] for i, t in enumerate(p)) + sum(tagger.p["t"][a, b] for a, b in zip(p, p[1:])))
    assert tagger.decode(x)[0].tolist() == list(best)


def test_tagger_adds_what_patterns_miss():
    tagger, examples = pii_tagger.fitted(), pii_tagger.Examples(12345)
    rng, hit, total, false = examples.rng, 0, 0, 0
    for _ in range(200):
        text, spans = "", set()
        for _ in range(12):
            kind = rng.randrange(4)
            made = getattr(examples, pii_tagger.KINDS[kind])() if rng.random() < 0.2 else ""
            if made:
                spans.add((kind, len(text), len(text) + len(made)))
            text += (made or (examples.lookalike() if rng.random() < 0.2 else examples.word())) + " "
        ((base, found),) = pii.find_spans([text], tagger)
        assert set(base) <= set(found)
        total += len(spans - set(base))
        hit += len(spans & set(found) - set(base))
        false += len(set(found) - set(base) - spans)
    assert hit / total > 0.5 and false <= 0.1 * hit


WRITTEN_BY_HAND = {
    0: ["anna.schmidt (at) firma (dot) de", "bob at example dot com", "j.doe[at]company[dot]org", "sales at shop dot net", "marie_curie (at) labo.fr", "info [at] museum [dot] org", "paul (at) hotel (dot) com", "peter at school dot org"],
    1: ["10[.]20[.]30[.]40", "192.168[.]1[.]1", "8[.]8[.]4[.]4", "172.16.5[.]9"],
    2: ["4111.1111.1111.1111", "5500/0000/0000/0004", "4012.8888.8888.1881", "6011/0009/9013/9424"],
    3: ["(212) 555-0187", "312-555-0143", "415.555.0126", "(646) 555-0199", "0049 30 1234567", "202-555-0171"],
}
PROSE = "please write or call before the end of the week and we will send you the details about our new offer because many people have asked for it since the spring sale at the market was over in 1998 with 25 prizes on page 12 of the 300 copies v2.1 cost 19.99 dated 2021-05-03 room 42 at noon dot com boom 123-45-6789".split()


def test_tagger_on_text_of_another_kind():
    """English sentences with data written by hand, none from the training generator: what the tagger adds to the patterns."""
    rng, tagger = random.Random(77), pii_tagger.fitted()
    hit = total = false = 0
    for _ in range(300):
        text, spans = "", set()
        for _ in range(6):
            text += " ".join(rng.choice(PROSE) for _ in range(rng.randint(5, 25))) + " "
            if rng.random() < 0.4:
                kind = rng.randrange(4)
                made = rng.choice(WRITTEN_BY_HAND[kind])
                spans.add((kind, len(text), len(text) + len(made)))
                text += made + rng.choice((" ", ". ", ", "))
        ((base, found),) = pii.find_spans([text], tagger)
        spans -= {s for s in spans if any(s[1] < b and a < s[2] for _, a, b in base)}
        total += len(spans)
        hit += len(spans & set(found))
        false += len(set(found) - set(base) - spans)
    print(f"precision {hit / (hit + false):.2f}, recall {hit / total:.2f}")
    assert hit / total >= 0.4 and hit / (hit + false) >= 0.85


def test_tagger_is_kept_in_the_shared_folder(spark, monkeypatch):
    monkeypatch.setattr(pii_tagger, "_FITTED", {})
    first = pii_tagger.kept(spark, 640)
    monkeypatch.setattr(pii_tagger, "_FITTED", {})
    monkeypatch.setattr(pii_tagger, "fitted", None)  # not called again
    second = pii_tagger.kept(spark, 640)
    assert all(np.array_equal(a, second.p[k]) for k, a in first.p.items())


def test_windows_cover_whole_texts():
    W, S, M = pii.WIDTH, pii.STRIDE, pii.MARGIN
    for n in (0, 1, W - 1, W, W + 1, W + S, W + S + 1, 5000):
        count = pii.windows_of(n)
        assert (count - 1) * S + W >= n and (count < 2 or (count - 2) * S + W < n)
        if n:
            tags = np.arange(1, count + 1, dtype=np.int8)[:, None].repeat(W, 1)
            out = pii.reconcile(n, tags).tolist()
            middle = lambda w, i: abs(2 * (i - w * S) - W + 1)
            for i, tag in enumerate(out):
                near = [w for w in range(count) if w * S <= i < w * S + W]
                assert middle(tag - 1, i) == min(middle(w, i) for w in near)


def test_decoding_leaves_out_only_windows_without_spans():
    tagger = pii_tagger.fitted()
    examples = pii_tagger.Examples(5)
    x = np.stack([examples.window(64)[0] for _ in range(200)])
    scores = tagger.emissions(x)
    e, step = scores.transpose(0, 2, 1), tagger.fast["t"]
    score, back = e[0], []
    for t in range(1, len(e)):
        ways = score[:, :, None] + step[None]
        back.append(ways.argmax(axis=1))
        score = ways.max(axis=1) + e[t]
    now, rows, plain = score.argmax(axis=1), np.arange(len(x)), np.zeros(x.shape, np.int8)
    for t in range(len(e) - 1, -1, -1):
        plain[:, t] = now
        if t:
            now = back[t - 1][rows, now]
    assert np.array_equal(tagger.decode(x), plain)
    out = tagger._run(x)[1]
    assert np.allclose(e, tagger._features(out) @ tagger.p["o"] + tagger.p["ob"], atol=1e-3)


def plain_viterbi(e, step):
    """Best tags (window, time) by scores and back pointers of every pair of tags at every position."""
    score, back = e[0], []
    for t in range(1, len(e)):
        ways = score[:, None] + step[:, :, None]
        back.append(ways.argmax(axis=0))
        score = ways.max(axis=0) + e[t]
    path, rows = [score.argmax(axis=0)], np.arange(e.shape[2])
    for b in reversed(back):
        path.append(b[path[-1], rows])
    return np.array(path[::-1]).T


def test_decoding_breaks_ties_as_plain_viterbi(monkeypatch):
    rng, tagger = np.random.default_rng(4), pii_tagger.Tagger(hidden=2)
    for _ in range(20):
        tagger.p["t"] = rng.integers(-2, 3, tagger.p["t"].shape).astype(float)
        tagger.ready()
        e = rng.integers(-4, 2, (12, pii_tagger.TAGS, 300)).astype(np.float32)
        e[:, 0] += 2
        monkeypatch.setattr(tagger, "emissions", lambda x: e.copy())  # noqa: B023
        assert np.array_equal(tagger.decode(np.zeros((300, 12), np.uint8)), plain_viterbi(e, tagger.p["t"]))


def test_paths_take_less_than_back_pointers_for_every_pair(monkeypatch):
    """Prose with some look-alikes, where few windows hold a tag but none could be left out by a bound on single positions."""
    from time import thread_time

    tagger, examples = pii_tagger.fitted(), pii_tagger.Examples(6)
    text = " ".join(examples.lookalike() if examples.rng.random() < 0.05 else examples.word() for _ in range(40_000))
    x = pii_tagger.classes_of(text)[: 768 * pii.WIDTH].reshape(768, pii.WIDTH)
    e = tagger.emissions(x)
    monkeypatch.setattr(tagger, "emissions", lambda x: e.copy())

    def seconds(f):
        began = thread_time()
        f()
        return thread_time() - began

    ours = min(seconds(lambda: tagger.decode(x)) for _ in range(5))
    plain = min(seconds(lambda: plain_viterbi(e, tagger.fast["t"])) for _ in range(5))
    print(f"{tagger.decode(x).any(axis=1).mean():.2f} of windows hold a tag; {ours / plain:.2f} of the plain search's time")
    assert np.array_equal(tagger.decode(x), plain_viterbi(e, tagger.fast["t"])) and ours < 0.6 * plain


def test_spans_of_tags():
    tags = np.array([0, 1, 2, 2, 1, 4, 4, 2, 0, 0, 6, 5, 6, 8, 7, 7, 8], np.int8)
    spans, at = [], 0
    while at < len(tags):
        end = at + 1
        if tags[at]:
            kind = (int(tags[at]) - 1) // 2
            while end < len(tags) and tags[end] == 2 + 2 * kind:
                end += 1
            spans.append((kind, at, end))
        at = end
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(pii, "plausible", lambda kind, text: True)
        patch.setattr(pii, "_cut_short", lambda *a: False)
        assert pii.tagged_spans("x" * len(tags), tags) == spans and len(spans) == 9


def test_merge_is_the_plain_rule():
    rng = random.Random(8)
    for _ in range(300):
        spans = lambda n: [(rng.randrange(4), a, a + rng.randint(1, 9)) for a in (rng.randrange(60) for _ in range(n))]
        base, added = spans(rng.randint(0, 6)), spans(rng.randint(0, 8))
        out, floor = list(base), 0
        for kind, a, b in sorted(added, key=lambda s: (s[1], -s[2])):
            if a >= floor and not any(x < b and a < y for _, x, y in base):
                out.append((kind, a, b))
                floor = b
        assert pii.merge(base, added) == sorted(out)


def test_redaction(spark, documents, nothing):
    rows = {r.doc_id: r for r in pii.find_personal_data(documents).collect()}
    assert (rows[9].n_email, rows[9].n_ip, rows[9].n_card, rows[9].n_phone) == (1, 1, 1, 1)
    text = next(r.text for r in documents.collect() if r.doc_id == 9)
    assert rows[9].base_sha256 == hashlib.sha256(",".join(f"{pii_tagger.KINDS[k]}:{a}:{b}" for k, a, b in plain_spans(text)).encode()).hexdigest()
    assert rows[2].spans == rows[3].spans == "" and len(pii.find_personal_data(documents).collect()) == documents.count()
    clean = pii.redact(documents)
    assert clean.columns == documents.columns
    by = {r.doc_id: r for r in clean.collect()}
    assert by[9].text == "write to [EMAIL] or [IP], card [CARD], [PHONE]" and by[9].n_chars == len(by[9].text) and by[2].text is None
    assert by[1].text == "The quick brown fox jumps over the lazy dog."
    assert pii.find_personal_data(nothing).count() == 0 and pii.redact(nothing).count() == 0
