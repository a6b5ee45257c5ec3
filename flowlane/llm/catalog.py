"""The registered queries of the training-data operators and their SQL twins.

A query is thin: it reads its whole table, calls its operator with production
parameters and derives the contract's columns.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlane.llm import (
    ann, audit, bitslice, bpe, embed_dedup, hard_negatives, html_main, packing, pii, quality, simhash, toxicity, warc)
from flowlane.llm.common import table

WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
BYTE_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), WORD_VOCABULARY)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_embed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode(table(spark, sf_dir, "documents"), BYTE_VOCABULARY, decode=True)
    return coded.select(
        "doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.extract(table(spark, sf_dir, "pages"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def relabelled(vectors: DataFrame) -> DataFrame:
    """The label of an id divisible by 7 becomes the next one of 0 to 9."""
    return vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(relabelled(table(spark, sf_dir, "embeddings")))


def op13_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitslice.search(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_packing, op2_quality, op3_toxicity, op4_embed_dedup, op5_bpe, op6_ann, op7_pii, op8_html, op9_simhash, op10_warc,
        op11_filter_audit, op12_hard_negatives, op13_exact_topk)}

#: The plain patterns, in the language of the SQL engine (no look-behind needed).
_PII_SQL = {
    "email": ("[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:[.][A-Za-z0-9-]+)+", "true"),
    "ip": ("[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+",
           "regexp_full_match(v, '(?:0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:[.]|$)){4}')"),
    "card": ("[0-9](?:[ -]?[0-9])+", """length(d) between 12 and 19 and list_sum(list_transform(range(length(d)), lambda i:
        (substr(d, length(d) - i, 1)::int * (i % 2 + 1))
        - case when substr(d, length(d) - i, 1)::int * (i % 2 + 1) > 9 then 9 else 0 end)) % 10 = 0"""),
    "phone": ("[+][0-9][ ().0-9-]+[0-9]", "length(d) between 9 and 15"),
    "iban": ("\\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}\\b", """length(replace(v, ' ', '')) between 15 and 34 and list_reduce(
        list_prepend(0::bigint, list_transform(string_split(substr(replace(v, ' ', ''), 5) || left(v, 4), ''),
        lambda c: (case when c < 'A' then ascii(c) - 48 else ascii(c) - 55 end)::bigint)),
        lambda a, c: (a * case when c > 9 then 100 else 10 end + c) % 97) = 1"""),
}


def _pii_sql() -> str:
    found = " union all ".join(f"""
    select doc_id, {rank} as rank, '{kind}' as kind, i, ms[i] as v, ps, ms from (
        select doc_id, unnest(range(1, len(ms) + 1)) as i, ms, ps from (
            select doc_id, regexp_extract_all(t, '{pattern}') as ms, string_split_regex(t, '{pattern}') as ps from d))"""
                               for rank, (kind, (pattern, _)) in enumerate(_PII_SQL.items()))
    checks = " ".join(f"when '{kind}' then {check}" for kind, (_, check) in _PII_SQL.items())
    counts = ", ".join(f"count(*) filter (kind = '{k}')::bigint as n_{k}" for k in pii.BASE)
    joined, scores = (f"string_agg({c}, ',' order by start, rank)" for c in ("span", "score"))
    words = " ".join(f"when '{k}' then regexp_matches(near_left, '{w}') or regexp_matches(near_right, '{w}')" for k, w in pii.NEARBY.items())
    base_score = " ".join(f"when '{k}' then {x}" for k, x in pii.SCORES.items())
    left = "||".join(f"right(coalesce({c}, ''), {pii.REACH})" for c in ("case when i > 1 then ps[i - 1] end", "case when i > 1 then ms[i - 1] end", "ps[i]"))
    right = "||".join(f"left(coalesce({c}, ''), {pii.REACH})" for c in ("ps[i + 1]", "ms[i + 1]", "ps[i + 2]"))
    return f"""
with d as (select doc_id, coalesce(text, '') as t from documents),
f as ({found}),
g as (select *, regexp_replace(v, '[^0-9]', '', 'g') as d,
      right({left}, {pii.REACH}) as near_left, left({right}, {pii.REACH}) as near_right,
      (list_sum(list_transform(ps[1:i], lambda x: length(x)))
       + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0))::bigint as start from f),
s as (select doc_id, rank, kind, start, concat_ws(':', kind, start, start + length(v)) as span,
      printf('%.1f', least(1, case kind {base_score} end + case when case kind {words} end then {pii.BONUS} else 0 end)::double) as score from g
      where case kind {checks} end),
a as (select doc_id, {counts}, {joined} filter (rank < {len(pii.BASE)}) as base, {joined} as spans, {scores} as scores from s group by doc_id)
select d.doc_id, {", ".join(f"coalesce(n_{k}, 0) as n_{k}" for k in pii.BASE)},
       sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans, coalesce(scores, '') as scores
from d left join a using (doc_id)"""


#: Rows whose vector takes part, as whole numbers (x); used by the two exact searches.
_WHOLE_SQL = """
e as (select *, list_transform(embedding, lambda x: floor(256 * x::double)) as x from embeddings
      where embedding is not null and len(embedding) = len(list_filter(embedding, lambda x: x is not null and isfinite(x))))"""

ORACLE_SQL: dict[str, str] = {
    "op11_filter_audit": """
with d as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as t from documents),
w as (select *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') as ws, min(doc_id) over (partition by t) as least from d),
m as (select part, (case when len(ws) < 50 then 1 else 0 end) + (case when 100 * len(list_distinct(ws)) < 65 * len(ws) then 2 else 0 end)
             + (case when 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) then 4 else 0 end)
             + (case when regexp_matches(t, '[#$%&*|]') then 8 else 0 end) + (case when doc_id > least then 16 else 0 end) as fails,
             coalesce(quality = 1, false) as good, coalesce(toxic = 1, false) as toxic from w left join labels using (doc_id)),
c as (select part, fails, count(*) as n, count(*) filter (good) as good, count(*) filter (toxic) as toxic from m group by all),
f as (select * from (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) as v(l, b)),
o as (select a.l || b.l || c.l || d.l || e.l as filter_order, [a.b, b.b, c.b, d.b, e.b] as bits
      from f a, f b, f c, f d, f e where len(list_distinct([a.b, b.b, c.b, d.b, e.b])) = 5),
s as (select filter_order, i as step, bits[i] as bit, coalesce(list_sum(bits[1:i - 1]), 0)::int as before
      from o, range(1, 6) as r(i)),
r as (select part, filter_order, step, bit,
             coalesce(sum(n) filter (fails & (before | bit) = 0), 0) as kept,
             coalesce(sum(n) filter (fails & before = 0 and fails & bit <> 0), 0) as removed,
             coalesce(sum(n) filter (fails & before <> 0 and fails & bit <> 0), 0) as redundant,
             coalesce(sum(n) filter (fails = bit), 0) as unique_fails,
             coalesce(sum(good) filter (fails & before = 0 and fails & bit <> 0), 0) as good_lost,
             coalesce(sum(toxic) filter (fails & before = 0 and fails & bit <> 0), 0) as toxic_lost
      from c, s group by part, filter_order, step, bit)
select part, filter_order, step::int as step, kept::bigint as kept, removed::bigint as removed, redundant::bigint as redundant,
       unique_fails::bigint as unique_fails, good_lost::bigint as good_lost, toxic_lost::bigint as toxic_lost,
       (sum(removed) over (partition by part, bit))::bigint as shapley
from r""",
    "op12_hard_negatives": "with " + _WHOLE_SQL.strip() + """,
l as (select vec_id, x, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label from e where label is not null),
s as (select a.vec_id as anchor_id, a.label = b.label as same, b.vec_id, list_dot_product(a.x, b.x)::bigint as score
      from l a join l b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0),
p as (select anchor_id, vec_id as positive_id, score as positive_score from s where same
      qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select anchor_id, positive_id, (row_number() over (partition by anchor_id, positive_id order by score desc, vec_id))::int as rank,
       vec_id as negative_id, positive_score, score as negative_score
from p join s using (anchor_id) where not same and 80 * positive_score <= 100 * score and 100 * score <= 100 * positive_score
qualify rank <= 5""",
    "op13_exact_topk": "with " + _WHOLE_SQL.strip() + """
select a.vec_id as query_id, (row_number() over (partition by a.vec_id order by list_dot_product(a.x, b.x) desc, b.vec_id))::int as rank,
       b.vec_id, list_dot_product(a.x, b.x)::bigint as score
from e a join e b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0 qualify rank <= 5""",
    "op7_pii": _pii_sql(),
    "op4_embed_dedup": """
with recursive u as (
    select vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings),
g as (select vec_id, list_cosine_similarity(v, v) is not null as ok, v from u),
l as (select a.vec_id as a, b.vec_id as b from g a, g b
      where a.vec_id <> b.vec_id and list_cosine_similarity(a.v, b.v) >= 0.95),
r(a, b) as (select vec_id, vec_id from u union select r.a, l.b from r join l on r.b = l.a),
c as (select a as vec_id, min(b) as component_id from r group by a),
n as (select a as vec_id, count(*) as n from l group by a)
select vec_id, coalesce(n, 0)::bigint as n_links, component_id, vec_id = component_id as kept
from c left join n using (vec_id)""",
    "op10_warc": """
with p as (select page_id, strlen(coalesce(html, '')) as n, sha256(coalesce(html, '')) as d from pages),
f as (select d, min(page_id) as first from p where n >= 100 group by d)
select page_id, n::bigint as payload_bytes, d as payload_digest,
       case when n >= 100 and page_id <> first then 'revisit' else 'response' end as record_type,
       case when n >= 100 and page_id <> first then first end as refers_to
from p left join f using (d)""",
}
