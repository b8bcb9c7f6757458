"""Contacts: identifiers, classification by words, colours; and small catalogue operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Groups with their colours, and the words and phrases that name them, in the order in which they are asked. What is not a mine
# comes before what is like one, and that before ordnance, so that neither is taken for ordnance.
CLASS_GROUPS = [
    ("cleared", "#78889a", ["nombo", "non mine", "nonmine", "not a mine", "no contact", "nothing", "cleared", "clear", "false", "discounted", "rejected", "noise", "artefact"]),
    ("suspect", "#ff7a1a", ["mine like", "minelike", "milco", "milec", "mine echo", "suspect", "suspected", "possible", "probable", "contact of interest", "poi", "unknown"]),
    ("ordnance", "#ff3b30", ["mine", "uxo", "ordnance", "munition", "shell", "bomb", "torpedo", "depth charge", "explosive", "eod", "projectile"]),
    ("wreck", "#c77dff", ["wreck", "hull", "vessel", "aircraft", "plane", "barge", "boat"]),
    ("utility", "#3ec8ff", ["pipe", "pipeline", "cable", "chain", "rope", "net", "netting", "mooring", "anchor", "umbilical", "wire"]),
    ("debris", "#f0b429", ["debris", "scrap", "junk", "rubbish", "litter", "tyre", "tire", "drum", "container", "trolley", "metal", "object"]),
    ("geology", "#9fb0bf", ["boulder", "rock", "rocky", "stone", "outcrop", "reef", "cobble"]),
    ("seabed", "#b3814d", ["scour", "sand", "sandwave", "sand wave", "ripple", "sediment", "mud", "clay", "gravel", "trawl", "trawl mark", "depression", "pockmark", "dredge", "seabed feature", "feature"]),
    ("biology", "#5fd38d", ["weed", "seaweed", "kelp", "vegetation", "fish", "shoal", "coral", "biological", "biology"]),
    ("area", "#7aa7ff", ["area", "area of interest", "aoi", "box", "zone", "datum", "search"]),
]
# The colour of no class, and those of classes outside every group.
UNCLASSED = "#f0b429"
FALLBACK = ["#4fa3e8", "#8f7ae0", "#35b8a6", "#7cc45a", "#c9a227", "#5ec8c0"]


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9]+", " "))


def stem(word: Column) -> Column:
    """A word of more than three letters without one final s."""
    return F.when((F.length(word) > 3) & word.endswith("s"), word.substr(F.lit(1), F.length(word) - 1)).otherwise(word)


def class_group(text: Column) -> Column:
    """The first group of which a word (whole, plural or not) or a phrase occurs; null for none."""
    plain = normalised(text)
    words = F.transform(F.split(plain, " "), stem)
    out = F.lit(None).cast("string")
    for name, _, terms in reversed(CLASS_GROUPS):
        single = [t[:-1] if len(t) > 3 and t.endswith("s") else t for t in terms if " " not in t]
        fits = F.arrays_overlap(words, F.array(*map(F.lit, single)))
        for phrase in (t for t in terms if " " in t):
            fits = fits | F.contains(plain, F.lit(phrase))
        out = F.when(fits, name).otherwise(out)
    return out


def word_hash(text: Column) -> Column:
    """FNV-1a of 32 bits over the characters of a normalised text, all of one byte."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(codes, F.lit(2166136261).cast("long"), lambda h, c: (h.bitwiseXOR(c) * 16777619).bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))


def class_colour(text: Column) -> Column:
    """The colour of a class: its group's, one of a few by the hash of an unknown word, or that of no class."""
    plain, group = normalised(text), class_group(text)
    out = F.when(plain == "", UNCLASSED).otherwise(F.element_at(F.array(*map(F.lit, FALLBACK)), (word_hash(plain) % len(FALLBACK) + 1).cast("int")))
    for name, colour, _ in CLASS_GROUPS:
        out = F.when(group == name, colour).otherwise(out)
    return out


def contact_colour(text: Column, own: Column) -> Column:
    """A classified contact has its class's colour, any other its own."""
    return F.when(normalised(text) != "", class_colour(text)).otherwise(F.coalesce(F.when(own != "", own), F.lit(UNCLASSED)))


def next_id(contacts: DataFrame) -> DataFrame:
    """One row: the id after the largest C-number, C001 for none."""
    number = F.expr("try_cast(substr(id, 2) as int)")
    return contacts.agg((F.coalesce(F.max(F.when(F.col("id").startswith("C"), number)), F.lit(0)) + 1).alias("n")).select(F.format_string("C%03d", "n").alias("id"))


def upsert(contacts: DataFrame, changes: DataFrame) -> DataFrame:
    """Contacts with those of ``changes`` in place of the ones of the same id."""
    return contacts.join(changes, "id", "left_anti").unionByName(changes)


def own_or_pool(own: DataFrame, pool: DataFrame) -> DataFrame:
    """Own datasets and those of the pool whose name is not taken."""
    return own.unionByName(pool.join(own, "name", "left_anti"))


def targets_from(contacts: DataFrame, ids: list[str] | None = None) -> DataFrame:
    """Targets of the chosen contacts in the order chosen, or of all datum contacts; radius 50 where none is given."""
    named = [F.coalesce("name", "id").alias("name"), F.when(F.col("radius") > 0, F.col("radius")).otherwise(50.0).alias("radius")]
    if ids is None:
        return contacts.where("source = 'datum'").select("id", *named, "lat", "lon")
    chosen = contacts.sparkSession.createDataFrame(list(enumerate(ids)), "place int, id string")
    return F.broadcast(chosen).join(contacts, "id").select("place", "id", *named, "lat", "lon")


def visible(layers: DataFrame) -> DataFrame:
    """Layers (id, parent, shown) all of whose ancestors are shown, however deep. The tree is a project's layer list; a cycle is an error."""
    out = layers.select("id", "parent", "shown", F.col("parent").alias("up"), F.col("shown").alias("all_shown"))
    above = layers.select(F.col("id").alias("up"), F.col("parent").alias("next"), F.col("shown").alias("up_shown"))
    most = layers.count()
    for _ in range(most + 1):
        if out.where("up is not null").isEmpty():
            return out.where("all_shown").select("id", "parent", "shown")
        out = out.join(above, "up", "left").withColumn("all_shown", F.col("all_shown") & F.coalesce("up_shown", F.lit(True))).withColumn("up", F.col("next")).drop("next", "up_shown")
    raise ValueError("layers form a cycle")


def safe_name(text: Column) -> Column:
    """A name fit for a file, which cannot leave its folder: every other character becomes an underscore."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[^A-Za-z0-9_-]", "_")


def iso8601(seconds: Column) -> Column:
    """UTC time of Unix seconds, with milliseconds only where there are any."""
    ms = F.round(seconds * 1000).cast("long")
    at = F.timestamp_add("MILLISECOND", ms, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    return F.when(ms % 1000 == 0, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))


def hms(seconds: Column) -> Column:
    s = F.floor(seconds).cast("long")
    return F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)


def fingerprint(settings: object) -> str:
    """Key of a settings object: FNV-1a, 64 bits, over its JSON."""
    import json

    h = 0xCBF29CE484222325
    for byte in json.dumps(settings, separators=(",", ":"), sort_keys=True).encode():
        h = (h ^ byte) * 0x100000001B3 & (1 << 64) - 1
    return f"{h:016x}"
