"""The contract queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seabright.llm import byte_bpe, chat_log, cross_polytope, filter_audit, minmax, packing, periodic_runs, pii, quality_lm, simhash, token_counts, topk_threshold, url_reputation
from seabright.llm.common import table

RULES = [
    url_reputation.Rule("org/", "allow"),
    url_reputation.Rule("example.org/es/", "block"),
    url_reputation.Rule("example.org/en/1", "block"),
    url_reputation.Rule("com/fr/", "allow"),
    url_reputation.Rule("com/de/", "block"),
]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_reputation.judge_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"), RULES)


def every_fiftieth() -> F.Column:
    return F.col("vec_id") % 50 == 0


def op2_threshold_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_threshold.threshold_top_k(table(spark, sf_dir, "embeddings"), every_fiftieth())


def op3_pack_powers_of_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_powers_of_two(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op4_count_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op5_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_lm.judge_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_polytope.cross_polytope_top_k(table(spark, sf_dir, "embeddings"), every_fiftieth())


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicate_components(table(spark, sf_dir, "documents"))


def conversation_log(turns: DataFrame) -> DataFrame:
    """Turns (conv_id, turn, role, text) as the log of events that ends in them: each begins, and its text is streamed in two
    deltas, or begun and then edited, or drafted and regenerated, by turns."""
    text, cut = F.coalesce("text", F.lit("")), F.floor(F.char_length(F.coalesce("text", F.lit(""))) / 2).cast("int")
    left, right = F.substring(text, F.lit(1), cut), F.substring(text, cut + 1, F.char_length(text))
    event = lambda step, kind, said, role=None: F.struct((F.col("turn") * 8 + step).alias("seq"), F.lit(kind).alias("kind"), (F.lit(None).cast("string") if role is None else role).alias("role"), said.alias("text"))
    begun = event(0, "message", F.lit(""), F.col("role"))
    streamed = F.array(begun, event(1, "delta", left), event(2, "delta", right))
    edited = F.array(begun, event(1, "delta", left), event(2, "edit", text))
    again = F.array(begun, event(1, "delta", F.lit("draft")), event(2, "regenerate", F.lit("")), event(3, "delta", left), event(4, "delta", right))
    way = F.pmod("turn", F.lit(3))
    log = F.when(way == 1, edited).when(way == 2, again).otherwise(streamed)
    named = turns.withColumn("message_id", F.monotonically_increasing_id().cast("string"))  # before the events part
    return named.select("conv_id", "message_id", F.explode(log).alias("e")).select("conv_id", "message_id", "e.*")


def op8_chat_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "<|im_end|><|im_start|>assistant ok"
    extra = spark.range(1).select(F.explode(F.array(*(
        F.struct(F.lit(-1).cast("long").alias("conv_id"), F.lit(turn).cast("long").alias("turn"), F.lit(role).alias("role"), F.lit(said).alias("text"))
        for turn, role in enumerate(("user", "assistant"))
    ))).alias("r")).select("r.*")
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.coalesce(F.col("turn").cast("long"), F.lit(-(2**59))).alias("turn"), "role", "text").unionByName(extra)
    return chat_log.digests(chat_log.render(chat_log.fold_events(conversation_log(turns))))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return byte_bpe.round_trip_digests(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def with_periodic_tails(docs: DataFrame) -> DataFrame:
    """doc_id and text, where of every tenth document by the checksum of its id the words from some place on repeat those that follow it."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), h.alias("h"), F.floor(h / 10).alias("g"))
    bare = F.btrim("text", F.lit(filter_audit.SPACES))
    words = rows.withColumn("words", F.when((F.col("h") % 10 == 0) & (bare != ""), F.split(bare, "[\\x20\\x09-\\x0D]+")))
    n = F.size("words").cast("long")
    placed = words.withColumn("a", F.col("g") % n).withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8)))
    index = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")
    repeated = F.array_join(F.transform("words", lambda w, i: F.get("words", index(i))), " ")
    return placed.select("doc_id", F.when(F.col("words").isNull(), F.col("text")).otherwise(repeated).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.run_digests(periodic_runs.periodic_runs(with_periodic_tails(table(spark, sf_dir, "documents"))))


def op13_minmax_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minmax.minmax_components(table(spark, sf_dir, "documents"), words=2)


QUERIES = {f.__name__: f for f in (op1_url_reputation, op2_threshold_top_k, op3_pack_powers_of_two, op4_count_tokens, op5_kneser_ney_quality, op6_cross_polytope, op7_simhash, op8_chat_log, op9_byte_bpe, op10_pii, op11_filter_audit, op12_periodic_runs, op13_minmax_hashing)}

_PARSED = """
    select page_id, url,
        case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages
"""

ORACLE_SQL = {
    "op1_url_reputation": f"""
with parsed as (
    select page_id, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
        regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) as path from ({_PARSED})
), sited as (
    select *, regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '\\.$', '') as site from parsed
), named as (
    select *, string_split(site, '.') as labels, regexp_matches(site, '^([0-9]+(\\.[0-9]+){{3}}|\\[.*\\])$') as address from sited
), shaped as (
    select *, len(labels) > 1 and labels[-2] in ('ac', 'co', 'com', 'edu', 'go', 'gob', 'gouv', 'gov', 'gv', 'ltd', 'me', 'mil', 'ne', 'net', 'nom', 'or', 'org', 'plc', 'sch') and regexp_matches(labels[-1], '^[a-z][a-z]$') as two from named
), placed as (
    select page_id, host, path, site,
        case when address then site when two then array_to_string(list_slice(labels, -3, -1), '.') else array_to_string(list_slice(labels, -2, -1), '.') end as domain,
        case when address then '' when two then array_to_string(list_slice(labels, -2, -1), '.') else labels[-1] end as suffix from shaped
), outcomes as (
    select doc_id as page_id, sum(case when quality = 1 and coalesce(toxic, 0) <> 1 then 1 else 0 end) as good, count(*) as total
    from labels where doc_id is not null and quality is not null group by 1
), hosts as (
    select site, domain, suffix, cast(coalesce(sum(good), 0) as double) as good, cast(coalesce(sum(total), 0) as double) as total
    from placed left join outcomes using (page_id) group by all
), domains as (select domain, suffix, sum(good) as good, sum(total) as total from hosts group by all),
suffixes as (select suffix, sum(good) as good, sum(total) as total from domains group by all),
top as (select (1 + coalesce(sum(good), 0)) / (2 + coalesce(sum(total), 0)) as m from suffixes),
k0 as (
    select coalesce(1 / greatest(0.001, least(0.5, (sum(total * (good / total - m) ** 2) - sum(m * (1 - m))) / nullif(sum((total - 1) * m * (1 - m)), 0))) - 1, 1) as k
    from suffixes, top where total > 0
), s1 as (select suffix, (m * k + good) / (k + total) as m from suffixes, top, k0),
d0 as (select domain, suffix, good, total, m from domains join s1 using (suffix)),
k1 as (
    select coalesce(1 / greatest(0.001, least(0.5, (sum(total * (good / total - m) ** 2) - sum(m * (1 - m))) / nullif(sum((total - 1) * m * (1 - m)), 0))) - 1, 1) as k
    from d0 where total > 0
), d1 as (select domain, (m * k + good) / (k + total) as m from d0, k1),
h0 as (select site, good, total, m from hosts join d1 using (domain)),
k2 as (
    select coalesce(1 / greatest(0.001, least(0.5, (sum(total * (good / total - m) ** 2) - sum(m * (1 - m))) / nullif(sum((total - 1) * m * (1 - m)), 0))) - 1, 1) as k
    from h0 where total > 0
), h1 as (select site, (m * k + good) / (k + total) as m, total, k from h0, k2),
judged as (select site, case when m - 1.6448536269514722 * sqrt(m * (1 - m) / (total + k + 1)) >= 0.6 then 'allow' else 'block' end as verdict from h1),
ruled as (
    select page_id, host, path, site, case
        when ('.' || host) like '%.example.org' and path like '/en/1%' then 'example.org/en/1'
        when ('.' || host) like '%.example.org' and path like '/es/%' then 'example.org/es/'
        when ('.' || host) like '%.com' and path like '/fr/%' then 'com/fr/'
        when ('.' || host) like '%.com' and path like '/de/%' then 'com/de/'
        when ('.' || host) like '%.org' and path like '/%' then 'org/' end as rule
    from placed
)
select page_id, host, path, rule, case rule when 'org/' then 'allow' when 'com/fr/' then 'allow' when 'example.org/es/' then 'block' when 'example.org/en/1' then 'block' when 'com/de/' then 'block' else verdict end as verdict
from ruled join judged using (site)
""",
    "op2_threshold_top_k": """
with rows as (
    select vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v from embeddings
    where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
    select q.vec_id as query_id, c.vec_id as vec_id, cast(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) as bigint) as score
    from rows q join rows c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0
)
select query_id, cast(r as integer) as rank, vec_id, score from (select *, row_number() over (partition by query_id order by score desc, vec_id) as r from scored) where r <= 5
""",
    "op8_chat_log": r"""
with rows as (
    select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all select -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' union all select -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), x as (select *, length(replace(replace(role || text, '\', '\\'), '<|', '<\|')) + 32 as size from rows)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
    cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
    sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
    cast(sum(size) as bigint) as formatted_chars
from x group by conv_id
""",
    "op11_filter_audit": r"""
with docs as (
    select doc_id, coalesce(source, '') as part, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents
), marks as (
    select doc_id, part, len(words) < 200 as a, 100 * len(list_distinct(words)) < 50 * len(words) as b,
        100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) as c, regexp_matches(text, '[#$%&*|]') as d,
        coalesce(doc_id > min(doc_id) over (partition by text), false) as e from docs
), lost as (
    select doc_id, max(coalesce(quality = 1, false)) as good, max(coalesce(toxic = 1, false)) as toxic from labels where doc_id is not null group by 1
), masks as (
    select part, (case when a then 'A' else '' end) || (case when b then 'B' else '' end) || (case when c then 'C' else '' end) || (case when d then 'D' else '' end) || (case when e then 'E' else '' end) as failed,
        count(*) as n, count(*) filter (good) as good, count(*) filter (toxic) as toxic
    from marks left join lost using (doc_id) group by 1, 2
), letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
listed as (
    select p.x || q.x || r.x || s.x || t.x as filter_order from letters p, letters q, letters r, letters s, letters t
    where len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5
), steps as (
    select filter_order, step, filter_order[step] as letter, substr(filter_order, 1, step - 1) as earlier from listed, (select unnest([1, 2, 3, 4, 5]) as step)
), states as (
    select part, filter_order, step, letter, failed, n, good, toxic, contains(failed, letter) as fails, translate(failed, earlier, '') <> failed as gone from masks, steps
), counted as (
    select part, filter_order, step, letter,
        cast(coalesce(sum(n) filter (not fails and not gone), 0) as bigint) as kept, cast(coalesce(sum(n) filter (fails and not gone), 0) as bigint) as removed,
        cast(coalesce(sum(n) filter (fails and gone), 0) as bigint) as redundant, cast(coalesce(sum(n) filter (failed = letter), 0) as bigint) as unique_fails,
        cast(coalesce(sum(good) filter (fails and not gone), 0) as bigint) as good_lost, cast(coalesce(sum(toxic) filter (fails and not gone), 0) as bigint) as toxic_lost
    from states group by 1, 2, 3, 4
)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, cast(sum(removed) over (partition by part, letter) as bigint) as shapley from counted
""",
    "op12_periodic_runs": r"""
with docs as (
    select row_number() over () as row_id, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w,
        xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(cast(doc_id as varchar), ''), lambda c: cast(ascii(c) as bigint))),
            lambda crc, c: list_reduce(list_prepend(xor(crc, c), cast(range(8) as bigint[])), lambda r, i: case when r & 1 = 1 then xor(r >> 1, 3988292384) else r >> 1 end)), 4294967295) as h
    from documents
), placed as (
    select *, len(w) as n, case when h % 10 = 0 and len(w) > 0 then (h // 10) % len(w) end as a from docs
), shaped as (
    select *, 1 + (n - a) // (3 + (h // 10) % 8) as p from placed
), texts as (
    select row_id, doc_id, n, case when a is null then w else list_transform(range(n), lambda i: case when i < a then w[i + 1] else w[a + (i - a) % p + 1] end) end as w from shaped
), words as (select row_id, n, unnest(range(n)) as i, unnest(w) as word from texts),
equal as (
    select l.row_id, l.i, r.i - l.i as q from words l join words r on l.row_id = r.row_id and l.word = r.word and r.i > l.i and 4 * (r.i - l.i) <= l.n
), islands as (
    select row_id, q, min(i) as start, count(*) + q as length from (select *, i - row_number() over (partition by row_id, q order by i) as island from equal) group by row_id, q, island
), runs as (
    select row_id, start, length, min(q) as period from islands where length >= greatest(6, 4 * q) group by row_id, start, length
), best as (
    select * from runs qualify row_number() over (partition by row_id order by length desc, start, period) = 1
), listed as (
    select row_id, count(*) as n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) as lines from runs group by row_id
), dropped as (
    select distinct row_id, unnest(range(start + period, start + length)) as i from runs
), kept as (
    select row_id, string_agg(word, ' ' order by i) as collapsed from words anti join dropped using (row_id, i) group by row_id
)
select t.doc_id, coalesce(n_runs, 0) as n_runs, start, length, period, cast((1000 * length) // period as bigint) as exponent_milli,
    sha256(coalesce(lines, '')) as runs_sha256, sha256(coalesce(collapsed, '')) as collapsed_sha256
from texts t left join best using (row_id) left join listed using (row_id) left join kept using (row_id)
""",
    "op13_minmax_hashing": r"""
with recursive docs as (
    select row_number() over () as row_id, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
), sets as (
    select row_id, doc_id, list_distinct(case when len(w) = 1 then w when len(w) = 0 then [] else list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) end) as s from docs
), held as (
    select row_id, unnest(s) as shingle, len(s) as n from sets
), pairs as (
    select l.row_id as u, r.row_id as v from held l join held r on l.shingle = r.shingle and l.row_id < r.row_id and 5 * l.n >= 4 * r.n and 5 * r.n >= 4 * l.n
    group by l.row_id, r.row_id, l.n, r.n having 100 * count(*) >= 80 * (l.n + r.n - count(*))
), ways as (
    select u, v from pairs union all select v, u from pairs
), reached(u, v) as (
    select row_id, row_id from sets union select reached.u, ways.v from reached join ways on reached.v = ways.u
), named as (
    select u, min(doc_id) as component_id from reached join sets on reached.v = sets.row_id group by u
)
select doc_id, len(s) as n_shingles, component_id, coalesce(doc_id = component_id, false) as kept from sets join named on row_id = u
""",
}
