"""The registered queries of this subpackage, one per operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hopgrid.llm import bpe, decontaminate, pii, preference, quality, secrets, simhash, substrings, suffixes, warc
from hopgrid.llm.text import small_batches


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return small_batches(spark).read.parquet(f"{sf_dir}/documents.parquet")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_docs(spark, sf_dir))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(_docs(spark, sf_dir))


def op5_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(_docs(spark, sf_dir))


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(_docs(spark, sf_dir))


def op7_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference.neighbours(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(_docs(spark, sf_dir))


def op9_bpe(spark: SparkSession, sf_dir: str, name: str = "word_bpe_49k.json") -> DataFrame:
    import public_tokenizers

    return bpe.encode(_docs(spark, sf_dir), public_tokenizers.path(name), with_ids=False)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(small_batches(spark).read.parquet(f"{sf_dir}/pages.parquet"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_secrets": op1_secrets,
        "op2_quality": op2_quality,
        "op3_decontaminate": op3_decontaminate,
        "op4_simhash": op4_simhash,
        "op5_suffixes": op5_suffixes,
        "op6_substrings": op6_substrings,
        "op7_preference": op7_preference,
        "op8_pii": op8_pii,
        "op9_bpe": op9_bpe,
        "op10_warc": op10_warc,
        "pipeline": pipeline,
    }


OP3_SQL = r"""
with dw as (select doc_id, regexp_extract_all(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w, row_number() over () as r from documents),
iw as (select item_id, regexp_extract_all(translate(text,'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark),
iwin as (select distinct item_id, least(13, len(w)) as n, array_to_string(w[i:i+least(13,len(w))-1], ' ') as s
  from (select item_id, w, unnest(range(1, greatest(len(w)-12, 1)+1)) as i from iw where len(w)>0)),
sizes as (select distinct n from iwin),
dwin as (select r, i, n, array_to_string(w[i:i+n-1], ' ') as s from (select r, w, n, unnest(range(1, len(w)-n+2)) as i from dw, sizes where len(w)>=n)),
hits as (select r, i, d.n, item_id from dwin d join iwin using (n, s)),
pos as (select r, count(distinct p) as n_hit from (select r, unnest(range(i, i+n)) as p from (select distinct r, i, n from hits)) group by r),
its as (select r, count(*) as n_items, string_agg(cast(item_id as varchar), ',' order by cast(item_id as varchar)) as s from (select distinct r, item_id from hits) group by r)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(s, '')) as items_sha256,
  coalesce(n_hit > 0 and 20*n_hit >= len(w), false) as contaminated
from dw left join pos using (r) left join its using (r)
"""


OP6_SQL = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text,''), '[^\x20\x09-\x0D]+') w, row_number() over () as r from documents),
win as (select r, i, hash(array_to_string(w[i:i+34], ' ')) as h, md5(array_to_string(w[i:i+34], ' ')) as m from (select r, w, unnest(range(1, len(w)-33)) as i from d where len(w) >= 35)),
twice as (select h, m from win group by h, m having count(*) > 1),
hit as (select r, i from win join twice using (h, m)),
pos as (select r, list(distinct p) as gone from (select r, unnest(range(i, i+35)) as p from hit) group by r)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(len(gone), 0) as bigint) as n_removed,
  sha256(array_to_string(case when gone is null then w else [x for x, k in w if not list_contains(gone, k)] end, ' ')) as kept_sha256
from d left join pos using (r)
"""

OP7_SQL = """
with t as (select conv_id>>1 as pair_id, conv_id&1=0 as c, replace(coalesce(role,''),'<|im_','<| im_') as role, replace(coalesce(text,''),'<|im_','<| im_') as text,
  row_number() over (partition by conv_id order by turn nulls first, coalesce(role,''), coalesce(text,'')) as k from conversations where conv_id is not null),
sizes as (select pair_id, count(*) filter (c) as nc, count(*) filter (not c) as nr from t group by 1),
bad as (select a.pair_id, min(a.k) as k from t a join t b on a.pair_id=b.pair_id and a.k=b.k and a.c and not b.c where a.role<>b.role or a.text<>b.text group by 1),
n as (select s.pair_id, coalesce(bad.k-1, least(nc, nr)) as n from sizes s left join bad on bad.pair_id=s.pair_id),
r as (select t.*, n.n, '<|im_start|>'||role||chr(10)||text||'<|im_end|>'||chr(10) as s from t join n using (pair_id)),
z as (select *, cast(sum(length(s)) over (partition by pair_id, c, k>n order by k) as bigint) as hi from r),
x as (select *, (hi-11-length(text))||':'||(hi-1) as span from z)
select pair_id, max(n) as n_prompt_turns, coalesce(string_agg(s, '' order by k) filter (c and k<=n), '') as prompt,
  count(*) filter (c and k>n) as n_chosen_turns, coalesce(string_agg(s, '' order by k) filter (c and k>n), '') as chosen,
  coalesce(string_agg(span, ',' order by k) filter (c and k>n and role='assistant'), '') as chosen_loss,
  count(*) filter (not c and k>n) as n_rejected_turns, coalesce(string_agg(s, '' order by k) filter (not c and k>n), '') as rejected,
  coalesce(string_agg(span, ',' order by k) filter (not c and k>n and role='assistant'), '') as rejected_loss
from x group by pair_id
"""

OP10_SQL = """
with p as (select page_id, strlen(coalesce(html,'')) as payload_bytes, sha1(coalesce(html,'')) as payload_digest from pages),
k as (select payload_digest, max(page_id) as keep from p where payload_bytes >= 1000 group by 1)
select page_id, payload_bytes, p.payload_digest, case when keep <> page_id then 'revisit' else 'response' end as record_type,
  case when keep <> page_id then keep end as refers_to
from p left join k on p.payload_digest = k.payload_digest and payload_bytes >= 1000
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_decontaminate": OP3_SQL, "op6_substrings": OP6_SQL, "op7_preference": OP7_SQL, "op10_warc": OP10_SQL}
