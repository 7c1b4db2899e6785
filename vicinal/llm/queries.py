"""The corpus operators' queries, with production parameters, and their SQL where SQL can say it."""

from __future__ import annotations

import secrets
from collections.abc import Callable
from math import ceil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinal.llm import chat, hardneg, langid, license, linededup, media, mixing, neardup, packing, phrases, pii, quality, warc
from vicinal.llm.common import unspool
from vicinal.sources.interim import delete


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = mixing.plan_sizes(_table(spark, sf_dir, "documents"))
    return d.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def tokenizer_path() -> str:
    """The vocabulary file, where the installed package has it on every executor."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_identify_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    d = langid.identify(docs, langid.fit(docs))
    return d.withColumn("held_out", langid.held_out(F.col("doc_id")))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(_table(spark, sf_dir, "documents"))


def op4_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path())


def op5_format_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    f = chat.format_chat(turns.unionByName(own))
    f = f.select("conv_id", "formatted", chat.read_back(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    digest = F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").cast("binary"), 256)
    return f.select("conv_id", F.size("turns").cast("long").alias("n_turns"), digest.alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"))


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = media.media_features(media.to_media(_table(spark, sf_dir, "documents")))
    return f.withColumn("feature", F.lower(F.hex("low_hash"))).drop("low_hash")


def op8_pseudonymize(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a deployment sets its own key, and keeps it for later runs; else the pseudonyms are those of this run
    key = spark.conf.get("spark.vicinal.pii.key", None) or secrets.token_hex(32)
    d = pii.pseudonymize(_table(spark, sf_dir, "documents").select("doc_id", "text"), key=key)
    return d.select("doc_id", F.size("pii").cast("long").alias("n_pii"), F.array_join(F.array_sort(F.array_distinct(F.transform("pii", lambda x: x["kind"]))), ",").alias("kinds"), "text")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.scan_licenses(_table(spark, sf_dir, "documents")).drop("spans")


def op10_dedup_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("removed")


def op11_mine_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    e = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding", label.alias("label"))
    h = hardneg.hard_negatives(e, F.col("vec_id") % 100 == 0)
    return h.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, folder = warc.write_archives(_table(spark, sf_dir, "pages"))
    out = warc.resolved(warc.read_records(index, payload=False))  # reads the archives, so that they can go
    unspool(index)
    delete(spark, folder)
    return out


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": op1_mix_sources,
    "op2_identify_language": op2_identify_language,
    "op3_quality_rules": op3_quality_rules,
    "op4_pack": op4_pack,
    "op5_format_chat": op5_format_chat,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_media_columns": op7_media_columns,
    "op8_pseudonymize": op8_pseudonymize,
    "op9_license_scan": op9_license_scan,
    "op10_dedup_lines": op10_dedup_lines,
    "op11_mine_phrases": op11_mine_phrases,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_warc_archives": op13_warc_archives,
    "pipeline": pipeline,
}

_OP1 = """
with recursive d as (select row_number() over () as rid, doc_id, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT as size, case when source is null then '' else '=' || source end as k, md5(coalesce(doc_id::VARCHAR, '')) as hk, length(bin(size)) * 100000 + rpad(substr(bin(size), 1, 5), 5, '0')::INT as up from documents),
s as (select k, sum(size)::BIGINT as source_size from d group by k),
w as (select *, [5.0, 2.0, 1.0][((row_number() over (order by k = '', k) - 1) % 3) + 1]::DOUBLE as w, source_size * 3.0::DOUBLE as cap, (sum(source_size) over ())::DOUBLE as total from s),
r as (select *, total - coalesce(sum(cap) over (order by cap / w, k rows between unbounded preceding and 1 preceding), 0) as rest, sum(w) over (order by cap / w, k rows between current row and unbounded following) as open from w),
f as (select *, rest * w > cap * open as is_full from r),
t as (select k, source_size, case when is_full then cap else (total - coalesce(sum(case when is_full then cap end) over (), 0)) * w / sum(case when not is_full then w end) over () end as target from f),
large as (select rid, k, size, target, source_size, row_number() over big as i, (sum(size) over (big rows unbounded preceding))::BIGINT as s from d join t using (k) where size * 64 > source_size window big as (partition by k order by size desc, hk, doc_id)),
f2 as (select k, i, rid, size, greatest(floor(target / source_size), least(ceil(target / source_size), floor((2 * floor(target / source_size * s)::BIGINT + size) / (2 * size))))::BIGINT as c, size * greatest(floor(target / source_size), least(ceil(target / source_size), floor((2 * floor(target / source_size * s)::BIGINT + size) / (2 * size))))::BIGINT as a from large where i = 1
  union all select l.k, l.i, l.rid, l.size, greatest(floor(target / source_size), least(ceil(target / source_size), floor((2 * (floor(target / source_size * s)::BIGINT - a) + l.size) / (2 * l.size))))::BIGINT, a + l.size * greatest(floor(target / source_size), least(ceil(target / source_size), floor((2 * (floor(target / source_size * s)::BIGINT - a) + l.size) / (2 * l.size))))::BIGINT from f2 join large l on l.k = f2.k and l.i = f2.i + 1),
fixed as (select k, max(a) as a, sum(size)::BIGINT as w from f2 group by k),
g as (select t.k, source_size, target, case when source_size - coalesce(w, 0) > 0 then least(ceil(target / source_size)::BIGINT * 16777216, greatest(floor(target / source_size)::BIGINT * 16777216, floor((target - coalesce(a, 0)) / (source_size - coalesce(w, 0)) * 16777216)::BIGINT)) else 0 end as rate, ('0x' || substr(md5('0:' || t.k), 1, 6))::BIGINT as start from t left join fixed using (k)),
o as (select d.*, g.source_size, g.target, g.rate, g.start, f2.c, row_number() over (partition by d.k, f2.c is null order by case when substr(hk, 32, 1) < '8' then up else 10000000 - up end, hk, doc_id, d.size) as i from d join g on d.k = g.k left join f2 on f2.rid = d.rid)
select doc_id, size, source_size, target::DOUBLE as target, coalesce(c, ((rate * i + start) >> 24) - ((rate * (i - 1) + start) >> 24)) * size as taken from o
"""

_OP5 = r"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e as (select *, length(regexp_replace(text, '([\[<])(\\*)(/?s>|/?INST\]|/?SYS\]|/?ROLE\]|TURN\])', '\1\2\\\3', 'g')) as n, length(regexp_replace(role, '([\[<])(\\*)(/?s>|/?INST\]|/?SYS\]|/?ROLE\]|TURN\])', '\1\2\\\3', 'g')) as rn,
  coalesce(lag(role) over (partition by conv_id order by turn nulls first, role, text) = role, false) as same from c)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::BIGINT as loss_chars, sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum(n + case when same then 6 else case role when 'user' then 13 when 'assistant' then 7 when 'system' then 11 else 19 + rn end end)::BIGINT as formatted_chars
from e group by conv_id
"""

#: Components by the smallest id that each document reaches.
_OP6 = r"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select doc_id, case when len(w) >= 5 then list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) when len(w) > 0 then [array_to_string(w, ' ')] else [] end as g from d),
x as (select doc_id, len(g) as n, unnest(g) as g from s),
p as (select a.doc_id as u, b.doc_id as v, any_value(a.n) as nu, any_value(b.n) as nv, count(*) as shared from x a join x b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
l as (select u, v from p where 100 * shared >= 75 * (nu + nv - shared)), e as (select u, v from l union all select v, u from l),
r(doc_id, root) as (select doc_id, doc_id from s union select e.v, r.root from r join e on e.u = r.doc_id),
c as (select doc_id, min(root) as component_id from r group by 1)
select doc_id, len(g)::BIGINT as n_shingles, component_id, doc_id = component_id as kept from s join c using (doc_id)
"""

_OP9 = """
with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as text from documents),
w as (select rid, doc_id, text, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from d),
p(phrase, label) as (values {phrases}),
t(label, ts, need, width) as (values {templates}),
b as (select rid, p.label, unnest(list_filter(range(len(w)), lambda i: w[i + 1 : i + len(string_split(phrase, ' '))] = string_split(phrase, ' '))) as "at" from w, p where list_has_all(w, string_split(phrase, ' '))),
base as (select rid, count(*) as n, min("at") as a, max("at") as z, string_agg(distinct label, ',' order by label) as labels, list(distinct label) as ls from b group by rid),
c as (select rid, label, ts, need, width, w, unnest(range(len(w))) as s from w, t where len(list_intersect(w, ts)) >= need),
m as (select rid, label, len(list_intersect(w[s + 1 : s + width], ts)) / len(ts) as c from c where len(list_intersect(w[s + 1 : s + width], ts)) >= need),
near as (select rid, max(c) as c, list(distinct label) as ls from m group by rid)
select doc_id, len(w)::BIGINT as n_words, coalesce(base.n, 0)::BIGINT as n_base, base.a::BIGINT as first_word, base.z::BIGINT as last_word, coalesce(base.labels, '') as base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base.ls, []), coalesce(near.ls, [])))), ',') as labels, case when base.n > 0 then 1.0 else coalesce(near.c, 0.0) end::DOUBLE as score
from w left join base using (rid) left join near using (rid)
""".format(
    phrases=", ".join(f"('{p}', '{x}')" for p, x in license.PHRASES.items()),
    templates=", ".join(f"('{x}', {sorted(set(t.split()))}, {ceil(license.THRESHOLD * len(set(t.split())) - 1e-9)}, {license.width(t, license.THRESHOLD)})" for t, x in license.TEMPLATES.items()),
)

_OP11 = r"""
with d as (select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
p as (select lang, regexp_extract_all(unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') as w from d),
g as (select lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' '))) as phrase from p, (values (1), (2), (3)) s(k) where len(w) >= k),
f as (select lang, k, phrase, count(*) as f from g group by 1, 2, 3),
n as (select lang, sum(f)::BIGINT as n from f where k = 1 group by 1),
c as (select lang, k, phrase, f as a, string_split(phrase, ' ') as w from f where k > 1 and f >= 10),
u as (select lang, array_to_string(w[1:2], ' ') as phrase, a from c where k = 3 union all select lang, array_to_string(w[2:3], ' '), a from c where k = 3),
x as (select lang, phrase, max(a) as longer from u group by 1, 2),
t as (select c.*, j from c left join x using (lang, phrase), (values (1), (2)) s(j) where j < k and (longer is null or 100 * longer < 50 * a)),
s as (select t.lang, t.phrase, t.a, j, l.f as l, r.f as r, ((1000000::HUGEINT * t.a * t.a) // (l.f::HUGEINT * r.f))::BIGINT as score from t
  join f l on l.lang = t.lang and l.phrase = array_to_string(w[1:j], ' ') and l.k = j join f r on r.lang = t.lang and r.phrase = array_to_string(w[j + 1 :], ' ') and r.k = t.k - j),
b as (select * from s qualify row_number() over (partition by lang, phrase order by score, j) = 1)
select lang, rank, phrase, a, l, r, n, score from (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from b) join n using (lang) where rank <= 2000
"""

_OP12 = """
with e as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) as v from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as anchor_id, a.label as own, r.vec_id, r.label, list_inner_product(a.v, r.v)::BIGINT as score from e a, e r where a.vec_id % 100 = 0 and r.vec_id != a.vec_id),
p as (select anchor_id, own, vec_id as positive_id, score as positive_score, row_number() over (partition by anchor_id order by score desc, vec_id) as place from s where label = own qualify place <= 5),
n as (select p.anchor_id, positive_id, positive_score, vec_id as negative_id, score as negative_score, row_number() over (partition by p.anchor_id, place order by score desc, vec_id) as rank
  from p join s on p.anchor_id = s.anchor_id and s.label != p.own and 80 * positive_score <= 100 * score and score <= positive_score)
select anchor_id, positive_id, rank::INT as rank, negative_id, positive_score, negative_score from n where rank <= 5
"""

_OP13 = """
with p as (select page_id, coalesce(html, '') as h from pages),
g as (select page_id, strlen(h)::BIGINT as payload_bytes, sha1(h) as payload_digest, max(page_id) over (partition by h) as last from p),
r as (select *, payload_bytes >= 1000 and last is not null and (page_id is null or page_id < last) as again from g)
select page_id, payload_bytes, payload_digest, case when again then 'revisit' else 'response' end as record_type, case when again then last end as refers_to from r
"""

ORACLE_SQL: dict[str, str] = {"op1_mix_sources": _OP1, "op5_format_chat": _OP5, "op6_near_duplicates": _OP6, "op9_license_scan": _OP9, "op11_mine_phrases": _OP11, "op12_hard_negatives": _OP12, "op13_warc_archives": _OP13}
