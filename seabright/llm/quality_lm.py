"""Quality classifier: interpolated modified Kneser-Ney perplexity against language-specific quantiles.

The model is over characters (code points) in n-grams of ``ORDER``; its tables grow with the trusted text and are nowhere held whole.

Training: each task counts its trusted documents' n-grams, and the counts are summed in shards by n-gram: raw counts at the top order, counts of
distinct left neighbours below, three discounts each from the counts of counts, and totals of every context.
Scoring: documents are gathered in blocks of ``BLOCK`` characters where they are read. A block asks for its distinct n-grams; the asked n-grams of all blocks are joined
in shards with the counts and contexts of each order, lowest first, and what comes out is joined to the blocks that asked. Texts move once, compressed, to
meet their block's probabilities.

The trusted documents are in two folds by a hash of the id, each with counts of its own, and every document is scored by the
fold that it is not in: so trusted documents' perplexities, from which the thresholds come, are those of text the model has not seen, like all others'.
Documents whose perplexity lies above the ``upper`` or below the ``lower`` quantile of the trusted documents of their
language, widened by ``margin``, are rejected.

``docs`` are read twice, and must come in the same order both times, as tables do (``materialize`` other frames first): a block whose answers are
missing is an error, never a wrong score.

Edge cases: null and empty texts have no n-grams; their perplexity is null and they are rejected. Very long texts are a block of their own. A language without trusted documents
takes the quantiles of all trusted documents; with no trusted documents at all everything that has text is kept. Null
languages are one language, and so is a table without ``lang``. Repeated label rows of an id count once, and it is trusted if any row says so. Repeated documents each get a row.
A NUL counts as U+FFFD. Extra columns, whatever their names, are ignored by ``judge_quality`` and kept by ``keep_good``. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seabright.llm.common import materialize, release_memory
from seabright.llm.packing import text_slices

ORDER = 4
#: Characters (bytes of UTF-8) of a block of documents, but for a single longer one.
BLOCK = 16_000_000
#: Bytes of text whose n-grams are laid out at once.
AT_ONCE = 2_000_000
#: Stands before the first character.
START = "\x02"
#: Ids that are broadcast to pick texts; beyond, a filter of bits spares most texts the shuffle to an exact join.
MOST_IDS = 1_000_000
MOST_LANGUAGES = 10_000
CHANGED = "documents were not read in the same order twice: materialize them first"


class Grams:
    """The n-grams of texts, one for each character, as numbers; and the distinct ones."""

    def __init__(self, texts: list[str]):
        k = ORDER - 1
        codes = np.frombuffer("".join([START * k + t for t in texts]).encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = np.where(codes == 0, np.uint32(0xFFFD), codes)
        self.lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        present = np.zeros(0x110000, bool)
        present[codes] = True
        self.alphabet = np.flatnonzero(present).astype(np.uint32)
        ids = (np.cumsum(present) - 1)[codes]
        own = np.ones(len(codes), bool)
        ends = np.cumsum(self.lengths + k)
        for i in range(k):
            own[ends - 1 - i] = False  # begins no n-gram of its text
        base = len(self.alphabet)
        n = len(codes) - k
        if n <= 0:
            self.pairs, self.numbers = None, np.empty(0, np.int64)
        elif base**ORDER < 2**62:
            self.pairs, number = None, ids[:n].copy()
            for i in range(1, ORDER):
                number = number * base + ids[i : i + n]
            self.numbers = number[own[:n]]
        else:  # numbers of numbers of pairs
            pairs = ids[:-1] * base + ids[1:]
            self.pairs = np.unique(pairs)
            rank = np.searchsorted(self.pairs, pairs)
            self.numbers = (rank[:n] * len(self.pairs) + rank[2 : 2 + n])[own[:n]]

    def spelled(self, numbers: np.ndarray) -> pa.Array:
        """The n-grams of numbers as strings."""
        base = len(self.alphabet)
        if self.pairs is None:
            ids = np.stack([numbers // base**i % base for i in range(ORDER - 1, -1, -1)], axis=1) if base else np.empty((0, ORDER), np.int64)
        else:
            two = np.stack([self.pairs[numbers // len(self.pairs)], self.pairs[numbers % len(self.pairs)]], axis=1)
            ids = np.stack([two // base, two % base], axis=2).reshape(-1, ORDER)
        letters = np.ascontiguousarray(self.alphabet[ids]).view(f"<U{ORDER}").ravel()
        return pa.array(letters.tolist(), pa.string())


def fold_of(doc_id: Column) -> Column:
    """0 or 1 by a hash of the id."""
    return F.coalesce(F.pmod(F.xxhash64(doc_id), F.lit(2)), F.lit(0)).cast("int")


def count_grams(texts: DataFrame) -> DataFrame:
    """(fold, gram, n) over all rows of ``texts`` (fold, text): summed within a task, then in shards by gram."""

    def run(batches):
        for part in (p for batch in batches for p in text_slices(batch, most_bytes=AT_ONCE)):
            for fold in (0, 1):
                mine = Grams([t for f, t in zip(part.column("fold").to_pylist(), part.column("text").to_pylist(), strict=True) if t and f == fold])
                found, n = np.unique(mine.numbers, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), fold, np.int32)), mine.spelled(found), pa.array(n, pa.int64())], ["fold", "gram", "n"])
        release_memory()

    return texts.mapInArrow(run, "fold int, gram string, n long").groupBy("fold", "gram").agg(F.sum("n").alias("n"))


def discounts(counts: DataFrame) -> dict[int, tuple[float, float, float]]:
    """The three discounts of modified Kneser-Ney for each fold, from the counts of counts one to four."""
    out = {}
    for row in counts.groupBy("fold").agg(*(F.count_if(F.col("n") == k).alias(f"n{k}") for k in (1, 2, 3, 4))).collect():
        n1, n2, n3, n4 = (row[f"n{k}"] for k in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 else 0.5
        raw = (1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5)
        out[row["fold"]] = tuple(min(max(d, 0.05), k - 0.05) for d, k in zip(raw, (1, 2, 3), strict=True))
    return out


def kneser_ney(counts: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """For each order from one: (fold, gram, own), the discounted share of each seen n-gram in its context, and (fold, context, weight), what a context leaves to the lower order.

    ``counts`` are (fold, gram, n) of the top order. A lower order's counts are of distinct left neighbours.
    """
    levels = {ORDER: counts}
    for k in range(ORDER - 1, 0, -1):
        levels[k] = materialize(levels[k + 1].groupBy("fold", F.substring("gram", 2, k).alias("gram")).agg(F.count("*").alias("n")), f"counts-{k}")
    out = []
    for k in range(1, ORDER + 1):
        by_fold = discounts(levels[k])
        d = [sum((F.when(F.col("fold") == f, v[i]).otherwise(0.0) for f, v in by_fold.items()), F.lit(0.0)) for i in range(3)]
        n = F.col("n")
        rows = levels[k].withColumn("context", F.substring("gram", 1, k - 1))
        times = [F.count_if(n == 1), F.count_if(n == 2), F.count_if(n > 2)]
        contexts = rows.groupBy("fold", "context").agg(F.sum(n).alias("total"), *(t.alias(f"t{i}") for i, t in enumerate(times)))
        contexts = materialize(contexts.select("fold", "context", "total", (sum((d[i] * F.col(f"t{i}") for i in range(3)), F.lit(0.0)) / F.col("total")).alias("weight")), f"contexts-{k}")
        taken = F.when(n == 1, d[0]).when(n == 2, d[1]).otherwise(d[2])
        own = rows.join(contexts, ["fold", "context"]).select("fold", "gram", ((n - taken) / F.col("total")).alias("own"))
        out.append((materialize(own, f"order-{k}"), contexts.select("fold", "context", "weight")))
    return out


def probabilities(asked: DataFrame, model: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """(fold, gram, p) of the distinct n-grams ``asked`` (fold, gram) of the top order; unseen ones back off along their contexts' weights."""
    wanted = {ORDER: asked}
    for k in range(ORDER - 1, 0, -1):
        wanted[k] = wanted[k + 1].select("fold", F.substring("gram", 2, k).alias("gram")).distinct()
    letters = {r["fold"]: r["v"] for r in model[0][0].groupBy("fold").agg(F.count("*").alias("v")).collect()}
    even = sum((F.when(F.col("fold") == f, F.lit(1.0 / (v + 1))).otherwise(0.0) for f, v in letters.items()), F.lit(0.0))  # one more for characters never seen
    lower = None
    for k, (own, contexts) in enumerate(model, 1):
        rows = wanted[k].withColumns({"context": F.substring("gram", 1, k - 1), "rest": F.substring("gram", 2, k - 1)})
        rows = rows.join(own, ["fold", "gram"], "left").join(contexts, ["fold", "context"], "left")
        rows = rows.withColumn("q", F.when(even > 0, even).otherwise(1.0)) if lower is None else rows.join(lower.select("fold", F.col("gram").alias("rest"), F.col("p").alias("q")), ["fold", "rest"])
        lower = materialize(rows.select("fold", "gram", (F.coalesce("own", F.lit(0.0)) + F.coalesce("weight", F.lit(1.0)) * F.col("q")).alias("p")), f"probabilities-{k}")
    return lower


def _blocks(batches, most: int) -> Iterator[tuple[int, pa.Table, list[str], int]]:
    """Blocks of rows of one fold: the other fold, the rows, their texts, and a number made of the texts."""
    held: dict[int, list[pa.RecordBatch]] = {0: [], 1: []}
    sizes = {0: 0, 1: 0}

    def block(fold: int):
        rows = pa.Table.from_batches(held[fold])
        held[fold], sizes[fold] = [], 0
        texts = [t or "" for t in pc.struct_field(rows["row"], "text").to_pylist()]
        digest = xxhash.xxh64(seed=1 + fold)
        for t in texts:
            digest.update(t.encode("utf-8", "surrogatepass"))
            digest.update(b"\0")
        number = digest.intdigest()
        return 1 - fold, rows, texts, number - (number >> 63 << 64)

    for batch in batches:
        for fold in (0, 1):
            mine = batch.filter(pc.equal(batch.column("fold"), fold)).select(["row", "bytes"])
            if mine.num_rows:
                held[fold].append(mine)
                sizes[fold] += pc.sum(mine.column("bytes")).as_py() + 8 * mine.num_rows
                if sizes[fold] >= most:
                    yield block(fold)
    for fold in (0, 1):
        if held[fold]:
            yield block(fold)


def _runs(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Stretches of about AT_ONCE characters of texts, with their first places."""
    begin, size = 0, 0
    for at, t in enumerate(texts):
        size += len(t)
        if size >= AT_ONCE:
            yield begin, texts[begin : at + 1]
            begin, size = at + 1, 0
    if begin < len(texts):
        yield begin, texts[begin:]


def _asks(most: int):
    def run(batches):
        for fold, _, texts, number in _blocks(batches, most):
            found = [pa.array([], pa.string())]
            for _, part in _runs(texts):
                grams = Grams(part)
                found.append(grams.spelled(np.unique(grams.numbers)))
            distinct = pa.chunked_array(found).unique()
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(distinct), number, np.int64)), pa.array(np.full(len(distinct), fold, np.int32)), distinct], ["block", "fold", "gram"])
        release_memory()

    return run


def _packed(most: int):
    def run(batches):
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        for _, rows, _, number in _blocks(batches, most):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema, options=options) as out:
                out.write_table(rows)
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "packed"])
        release_memory()

    return run


def text_perplexities(texts: list[str], gram: pa.Array, p: np.ndarray) -> list[float | None]:
    """Perplexity of each text, rounded to four places, from the probabilities of all its n-grams."""
    out: list[float | None] = [None] * len(texts)
    logs = np.log(p)
    for begin, part in _runs(texts):
        places = [i for i, t in enumerate(part) if t]
        if not places:
            continue
        grams = Grams([part[i] for i in places])
        distinct = np.unique(grams.numbers)
        at = pc.index_in(grams.spelled(distinct), value_set=gram)
        if at.null_count:
            raise RuntimeError(CHANGED)
        each = logs[at.to_numpy()][np.searchsorted(distinct, grams.numbers)]
        mean = np.add.reduceat(each, np.cumsum(grams.lengths) - grams.lengths) / grams.lengths
        for i, m in zip(places, mean.tolist(), strict=True):
            out[begin + i] = round(float(np.exp(-m)), 4)
    return out


def _scores(keep: list[str]):
    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        if not blocks.num_rows:
            raise RuntimeError(CHANGED)
        gram, p = answers["gram"].combine_chunks(), answers["p"].to_numpy()
        parts = []
        for packed in blocks["packed"]:
            rows = pa.ipc.open_stream(packed.as_buffer()).read_all()
            texts = pc.struct_field(rows["row"], "text").to_pylist()
            found = text_perplexities([t or "" for t in texts], gram, p)
            row = rows["row"].combine_chunks()
            kept = pa.StructArray.from_arrays([row.field(c) for c in keep], fields=[row.type.field(c) for c in keep])
            parts.append(pa.table({"row": kept, "length": pa.array([len(t or "") for t in texts], pa.int64()), "perplexity": pa.array(found, pa.float64())}))
        release_memory()
        return pa.concat_tables(parts)

    return run


def scored(docs: DataFrame, model: list[tuple[DataFrame, DataFrame]], keep: list[str], most: int | None = None) -> DataFrame:
    """row (the columns ``keep`` of a document), length and perplexity of every document, by the model of the fold that it is not in."""
    most = most or BLOCK
    columns = list(dict.fromkeys([*keep, "text"]))
    row = F.struct(*(F.col(c).cast("string").alias(c) if c == "text" and c not in keep else F.col(c) for c in columns))
    rows = docs.select(fold_of(F.col("doc_id").cast("long")).alias("fold"), F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long").alias("bytes"), row.alias("row"))
    asks = materialize(rows.mapInArrow(_asks(most), "block long, fold int, gram string"), "asked")
    answers = asks.join(probabilities(asks.select("fold", "gram").distinct(), model), ["fold", "gram"]).select("block", "gram", "p")
    blocks = rows.mapInArrow(_packed(most), "block long, packed binary")
    shape = T.StructType([docs.schema[c] for c in keep])
    out = T.StructType([T.StructField("row", shape), T.StructField("length", T.LongType()), T.StructField("perplexity", T.DoubleType())])
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_scores(keep), out)


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids labelled good and not toxic."""
    return labels.where("doc_id is not null and quality = 1 and coalesce(toxic, 0) <> 1").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()


def _places(doc_id: Column, bits: int) -> Column:
    """Three bits of a filter of 2 ** bits for an id."""
    return F.array(*(F.pmod(F.xxhash64(doc_id, F.lit(i)), F.lit(1 << bits)) for i in range(3)))


def filter_bits(ids: int) -> int:
    """The size of a filter for so many ids, as a power of two: ten bits an id or more, from 8 KB to 64 MB."""
    return min(29, max(16, (10 * ids).bit_length()))


def id_filter(ids: DataFrame, bits: int) -> np.ndarray:
    """A Bloom filter of ids (doc_id), 2 ** bits bits whatever their number."""
    places = ids.select(F.explode(_places(F.col("doc_id"), bits)).alias("bit"))
    one = F.expr("shiftleft(1L, cast(bit & 63 as int))")
    words = places.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(one).alias("bits")).toArrow()  # at most 2 ** (bits - 6) rows
    out = np.zeros(1 << bits - 6, np.int64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy()
    return out


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, text) of the documents in ``ids``. A filter of fixed size spares most others the shuffle; the join is exact."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    count = ids.count()
    if count <= MOST_IDS:
        return rows.join(F.broadcast(ids), "doc_id", "left_semi")
    bits = filter_bits(count)
    shared = docs.sparkSession.sparkContext.broadcast(id_filter(ids, bits))

    def run(batches):
        words = shared.value
        for batch in batches:
            at = batch.column("at").flatten().to_numpy().reshape(-1, 3)
            seen = (words[at >> 6] >> (at & 63) & 1).all(axis=1)
            yield batch.select(["doc_id", "text"]).filter(pa.array(seen))

    return rows.withColumn("at", _places(F.col("doc_id"), bits)).mapInArrow(run, "doc_id long, text string").join(ids, "doc_id", "left_semi")


def train(docs: DataFrame, trusted: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """The model of both folds, each of the documents of one fold whose id is in ``trusted``."""
    texts = texts_of(docs, trusted)
    return kneser_ney(materialize(count_grams(texts.select(fold_of(F.col("doc_id")).alias("fold"), "text")), "grams"))


def _slack(spread: float, foreign: float) -> Column:
    n = F.greatest("length", F.lit(1))
    return F.exp(F.lit(spread) / F.sqrt(n) + F.lit(foreign) / n)


def _limits(judged: DataFrame, trusted: DataFrame, upper: float, lower: float, margin: float, spread: float, foreign: float) -> DataFrame:
    """all, of_lang, low, high: a row for each language of trusted documents, and one (all true) for all of them. ``judged`` has doc_id, lang, length, perplexity."""
    ppl = F.col("perplexity")
    known = judged.where(ppl.isNotNull()).join(trusted, "doc_id", "left_semi").select("lang", F.round(ppl * _slack(spread, foreign), 2).alias("most"), F.round(ppl / _slack(spread, foreign), 2).alias("least"))
    cut = [(F.percentile("most", F.lit(lower)) * (1 - margin)).alias("low"), (F.percentile("least", F.lit(upper)) * (1 + margin)).alias("high")]  # of rounded values: few distinct ones, however many rows
    shape = [F.lit(False).alias("all"), F.col("lang").alias("of_lang"), "low", "high"]
    whole = known.agg(*cut).select(F.lit(True).alias("all"), F.lit(None).cast("string").alias("of_lang"), "low", "high")
    return materialize(known.groupBy("lang").agg(*cut).select(*shape).unionByName(whole), "limits")


def _judged(rows: DataFrame, limits: DataFrame, spread: float, foreign: float) -> DataFrame:
    """``rows`` (with lang, length, perplexity) with low, high and keep."""
    own = limits.where("not all").select("of_lang", "low", "high")
    if own.count() <= MOST_LANGUAGES:  # any more are left to a shuffled join
        own = F.broadcast(own)
    whole = limits.where("all").first()
    rows = rows.join(own, F.col("lang").eqNullSafe(F.col("of_lang")), "left").drop("of_lang")
    rows = rows.withColumns({
        "low": F.coalesce("low", F.lit(whole["low"]).cast("double")) / _slack(spread, foreign),
        "high": F.coalesce("high", F.lit(whole["high"]).cast("double")) * _slack(spread, foreign),
    })
    inside = F.coalesce(F.col("perplexity").between(F.col("low"), F.col("high")), F.lit(True))
    return rows.withColumn("keep", F.col("perplexity").isNotNull() & inside)


def _with_lang(docs: DataFrame) -> DataFrame:
    return docs if "lang" in docs.columns else docs.withColumn("lang", F.lit(None).cast("string"))


def judge_quality(docs: DataFrame, labels: DataFrame, upper: float = 0.998, lower: float = 0.002, margin: float = 0.02, spread: float = 1.0, foreign: float = 120.0) -> DataFrame:
    """doc_id, lang, length, perplexity, low, high, keep of every document.

    A mean over few characters scatters, and one foreign item (a key, a number) weighs much in a short text. So a document of n characters gets the benefit of a
    factor exp(spread / sqrt(n) + foreign / n) both ways; the quantiles are of trusted documents' perplexities after the same allowance.
    """
    trusted = trusted_ids(labels)
    named = _with_lang(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    rows = materialize(scored(named, train(named, trusted), ["doc_id", "lang"]).select("row.*", "length", "perplexity"), "perplexities")
    return _judged(rows, _limits(rows, trusted, upper, lower, margin, spread, foreign), spread, foreign).select("doc_id", "lang", "length", "perplexity", "low", "high", "keep")


def keep_good(docs: DataFrame, labels: DataFrame, upper: float = 0.998, lower: float = 0.002, margin: float = 0.02, spread: float = 1.0, foreign: float = 120.0) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    trusted = trusted_ids(labels)
    rows = materialize(scored(docs, train(docs, trusted), docs.columns), "scored")
    lang = F.col("row.lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    named = rows.select(F.col("row.doc_id").cast("long").alias("doc_id"), lang.alias("lang"), "length", "perplexity", "row")
    limits = _limits(named.drop("row"), trusted, upper, lower, margin, spread, foreign)
    return _judged(named, limits, spread, foreign).where("keep").select("row.*")
