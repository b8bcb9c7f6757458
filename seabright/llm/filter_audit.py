"""What document filters remove in every order, with exact duplicates found by partition refinement.

Each filter says which documents fail it; one of them, ``duplicates``, fails documents whose text a smaller id holds. How many a filter
removes depends on those before it, so every order of the filters is counted, from the numbers of documents by part and set of failed filters.

Duplicates: documents are classes of equal length in code points, split by the hash of one block of the text after the other (blocks grow eightfold);
classes of one document drop out before the next block. The full texts of what survives are compared: they are keys of an aggregate, and
the smallest id of each text is the one that does not fail.

Scaling: texts are read twice and never shuffled, but for those of classes with more than one member, and those once a map task and text. All else are rows of a few
numbers. Classes are passed on as a broadcast table up to ``MOST_CLASSES`` and beyond that as a shuffled join of two written tables, whose hot keys Spark splits.
Copies that are a third of all rows combine on the map side.

Edge cases: a null text is empty, a null part the empty string. Texts of any length are read whole. Null ids are smaller than none and none is smaller than they, so they never fail as
duplicates and lose no label. Rows of one id and text are no duplicates of one another; each counts. Labels may repeat: one of the kind is enough. Extra columns are ignored. No documents give no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seabright.llm.common import materialize

SPACES = " \t\n\x0b\x0c\r"
#: Where blocks of a text begin, in code points; the last goes on to its end.
BLOCKS = (0, 64, 512, 4096, 32_768, 262_144, 2_097_152)
#: Classes to broadcast, at most (eight bytes each).
MOST_CLASSES = 1_000_000

Failing = Callable[[Column, Column], Column]


def short(least: int) -> Failing:
    """Fewer than ``least`` words."""
    return lambda text, words: F.size(words) < least


def repetitive(percent: int) -> Failing:
    """Distinct words are less than ``percent`` of all."""
    return lambda text, words: 100 * F.size(F.array_distinct(words)) < percent * F.size(words)


def shouting(percent: int) -> Failing:
    """Capitals A-Z are more than ``percent`` of the code points."""
    return lambda text, words: 100 * F.regexp_count(text, F.lit("[A-Z]")) > percent * F.char_length(text)


def holding(characters: str) -> Failing:
    """Any of the characters, given as a class of a regular expression."""
    return lambda text, words: text.rlike(characters)


FILTERS: dict[str, Failing] = {"A": short(200), "B": repetitive(50), "C": shouting(2), "D": holding("[#$%&*|]")}


def _block(text: Column, k: int) -> Column:
    """Hash of block k; null where the text ends before it."""
    begin = BLOCKS[k]
    size = BLOCKS[k + 1] - begin if k + 1 < len(BLOCKS) else 2**31 - 1 - begin
    return F.when(F.char_length(text) > begin, F.xxhash64(F.substring(text, begin + 1, size)))


def _refined(key: Column, block: Column) -> Column:
    return F.when(block.isNull(), key).otherwise(F.xxhash64(key, block))


def _within(rows: DataFrame, classes: DataFrame, on: list[str]) -> DataFrame:
    """The rows whose key is in ``classes``, a written table."""
    return rows.join(F.broadcast(classes) if classes.count() <= MOST_CLASSES else classes, on, "left_semi")


def refine(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of rows (length, blocks, ...), those whose length and block hashes another row has too, with ``class``; and the table of classes (class)."""
    longest = rows.agg(F.max("length")).first()[0] or 0
    for k, begin in enumerate(BLOCKS):
        if k and longest <= begin:
            break
        rows = rows.withColumn("class", _refined(F.col("class") if k else F.xxhash64("length"), F.col("blocks")[k]))
        classes = materialize(rows.groupBy("class").agg(F.count("*").alias("n")).where("n > 1").select("class"), "classes")
        rows = _within(rows, classes, ["class"])
    return rows, classes


def first_holders(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(class, tag, doc_id): the smallest id of each distinct text of the classes, found by comparing whole texts."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).where("doc_id is not null")
    key = F.xxhash64(F.char_length("text"))
    for k in range(len(BLOCKS)):
        key = _refined(key, _block(F.col("text"), k))
    alike = _within(rows.select("doc_id", "text", key.alias("class")), classes, ["class"])
    return alike.groupBy("class", "text").agg(F.min("doc_id").alias("doc_id")).select("class", F.xxhash64(F.lit("tag"), "text").alias("tag"), "doc_id")


def failures(docs: DataFrame, labels: DataFrame, filters: dict[str, Failing], duplicates: str) -> DataFrame:
    """n by part, failed (bit k for the k-th filter by name), good and toxic."""
    names = sorted([*filters, duplicates])
    bit = {name: 1 << k for k, name in enumerate(names)}
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    bare = F.btrim("text", F.lit(SPACES))
    worded = rows.withColumn("words", F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, "[\\x20\\x09-\\x0D]+")))
    mask = sum((F.when(fails(F.col("text"), F.col("words")), bit[name]).otherwise(0) for name, fails in filters.items()), F.lit(0))
    marked = worded.select(
        "doc_id", "part", mask.alias("failed"), F.char_length("text").alias("length"), F.array(*(_block(F.col("text"), k) for k in range(len(BLOCKS)))).alias("blocks"), F.xxhash64(F.lit("tag"), "text").alias("tag"),
    )
    lost = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    spread = F.when(F.col("doc_id").isNull(), F.pmod("tag", F.lit(1024))).otherwise(0)  # rows without id do not meet in one task
    joined = marked.withColumn("deal", spread).join(lost.withColumn("deal", F.lit(0).cast("long")), ["doc_id", "deal"], "left").drop("deal")
    joined = materialize(joined.withColumns({"good": F.coalesce("good", F.lit(False)), "toxic": F.coalesce("toxic", F.lit(False))}), "audit-rows")

    alike, classes = refine(joined)
    first = materialize(first_holders(docs, classes), "first-holders")
    by = ["part", "failed", "good", "toxic"]
    again = alike.where("doc_id is not null").join(first, ["class", "tag", "doc_id"], "left_anti").groupBy(*by).agg(F.count("*").alias("n"))
    total = joined.groupBy(*by).agg(F.count("*").alias("n"))
    moved = again.select("part", F.explode(F.array(F.struct("failed", (-F.col("n")).alias("n")), F.struct((F.col("failed") + bit[duplicates]).alias("failed"), "n"))).alias("m"), "good", "toxic")
    every = total.unionByName(moved.select("part", "m.failed", "good", "toxic", "m.n"))
    return every.groupBy(*by).agg(F.sum("n").alias("n")).where("n > 0")


def states(names: list[str]) -> Column:
    """Every filter with every set of filters before it: k, bit, before (a set of bits), and the orders and steps at which it is so."""
    found: dict[tuple[int, int], list[str]] = {}
    for order in permutations(range(len(names))):
        for i, k in enumerate(order):
            row = f"named_struct('filter_order', '{''.join(names[j] for j in order)}', 'step', {i + 1})"
            found.setdefault((k, sum(1 << j for j in order[:i])), []).append(row)
    rows = [f"named_struct('k', {k}, 'bit', {1 << k}, 'before', {before}, 'places', array({', '.join(places)}))" for (k, before), places in found.items()]
    return F.expr(f"array({', '.join(rows)})")


def orders(counted: DataFrame, names: list[str]) -> DataFrame:
    """The rows of the audit from n by part, failed, good and toxic: every part, order and step, zeros included."""
    held = counted.groupBy("part").agg(F.collect_list(F.struct("failed", "n", "good", "toxic")).alias("held"))  # at most four for each set of filters
    rows = held.select("part", "held", F.explode(states(names)).alias("s")).select("part", "held", "s.*")

    def total(fits: Callable[[Column], Column]) -> Column:
        return F.aggregate("held", F.lit(0).cast("long"), lambda sum_, x: sum_ + F.when(fits(x), x["n"]).otherwise(0))

    fails, gone = (lambda x: x["failed"].bitwiseAND(F.col("bit")) != 0), (lambda x: x["failed"].bitwiseAND(F.col("before")) != 0)
    counts = rows.select(
        "part", "k", "places",
        total(lambda x: ~fails(x) & ~gone(x)).alias("kept"), total(lambda x: fails(x) & ~gone(x)).alias("removed"), total(lambda x: fails(x) & gone(x)).alias("redundant"),
        total(lambda x: x["failed"] == F.col("bit")).alias("unique_fails"), total(lambda x: fails(x) & ~gone(x) & x["good"]).alias("good_lost"), total(lambda x: fails(x) & ~gone(x) & x["toxic"]).alias("toxic_lost"),
    )
    shared = counts.withColumn("shapley", F.sum(F.col("removed") * F.size("places")).over(Window.partitionBy("part", "k")))
    return shared.withColumn("place", F.explode("places")).select("part", "place.filter_order", "place.step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit_filters(docs: DataFrame, labels: DataFrame, filters: dict[str, Failing] = FILTERS, duplicates: str = "E") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: for every value of ``source``, order of the filters (one letter each) and step."""
    return orders(failures(docs, labels, filters, duplicates), sorted([*filters, duplicates]))
