"""The registered queries of the numbered operators, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import chat, decontaminate, language, lattice_lm, merkle, minhash, notices, pivot_search, sentencepiece_codec, structure, toxicity, url_filters, warc
from tidemark.llm.common import documents, labels
from tidemark.llm.sql import OP11_SQL, OP12_SQL, OP13_SQL


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.round_trip(documents(spark, sf_dir), vocabulary())


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = pivot_search.scaled(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return pivot_search.top_k(vectors, F.col("id") % 100 == 0, k=10)


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.url_report(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir), size=4, percent=80).drop("text_hash")


#: A conversation whose texts look like another template's control strings.
TRICKY = "</s>[INST] ok [/INST]"


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("bigint"), F.col("id"), F.when(F.col("id") == 0, "user").otherwise("assistant"), F.lit(TRICKY))
    return chat.chat_report(rows.union(extra))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("hamming")


def op7_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_lm.lm_report(documents(spark, sf_dir), vocabulary())


def op8_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notices.scanned(documents(spark, sf_dir))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_report(documents(spark, sf_dir))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_report(documents(spark, sf_dir), labels(spark, sf_dir))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest_report(documents(spark, sf_dir))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_report(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.repair_report(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


OP2_SQL = """
with v as (
    select row_number() over () as n, vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as v
    from embeddings
    where embedding is not null and len(embedding) > 0
      and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
    select q.n, q.vec_id as query_id, x.vec_id, list_sum(list_transform(list_zip(q.v, x.v), lambda p: p[1] * p[2]))::bigint as score
    from v q join v x on q.n <> x.n and len(q.v) = len(x.v)
    where q.vec_id % 100 = 0
)
select query_id, row_number() over (partition by n order by score desc, vec_id)::int as rank, vec_id, score
from s qualify rank <= 10
"""


#: All pairs that share a shingle, counted; then everything that links reach.
OP4_SQL = """
with recursive d as (
    select doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') as w from documents
), s as (
    select doc_id, unnest(list_distinct(case when len(w) < 4 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) end)) as shingle from d where len(w) > 0
), n as (select doc_id, count(*) as n from s group by 1
), p as (select x.doc_id as x, y.doc_id as y, count(*) as c from s x join s y on x.shingle = y.shingle and x.doc_id < y.doc_id group by all
), l as (
    select x, y from p join n a on a.doc_id = x join n b on b.doc_id = y where 100 * c >= 80 * (a.n + b.n - c)
), e as (select x, y from l union select y, x from l
), r as (select doc_id, doc_id as other from documents union select r.doc_id, e.y from r join e on e.x = r.other
)
select doc_id, coalesce(any_value(n.n), 0)::bigint as n_shingles, min(other) as component_id, min(other) = doc_id as kept from r left join n using (doc_id) group by doc_id
"""


#: Brute force over all windows that share a shingle: no seeds, fingerprints or blocks.
OP6_SQL = """
with items as (
    select item_id, list_filter(regexp_split_to_array(lower(text), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') as w from benchmark
), i as (select item_id, w, len(w) as n_words, least(5, len(w)) as k from items where len(w) > 0
), ish as (
    select item_id, n_words, k, list_transform(range(1, n_words - k + 2), lambda p: array_to_string(w[p:p + k - 1], ' ')) as sh from i
), icount as (select item_id, s, count(*) as c from (select item_id, unnest(sh) as s from ish) group by all
), d as (
    select doc_id, list_filter(regexp_split_to_array(lower(text), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') as w from documents
), dsh as (
    select doc_id, k, unnest(range(1, len(w) - k + 2)) as p, w from d, (select distinct k from ish) where len(w) >= k
), hits as (
    select distinct h.doc_id, h.p, i.item_id from (select doc_id, k, p, array_to_string(w[p:p + k - 1], ' ') as s from dsh) h
    join (select item_id, k, unnest(sh) as s from ish) i on h.s = i.s and h.k = i.k
), starts as (
    select distinct h.doc_id, h.item_id, i.n_words, i.k, greatest(1, least(h.p - o.o, len(d.w) - i.n_words + 1)) as b
    from hits h join ish i using (item_id) join d using (doc_id), (select unnest(range(0, (select max(n_words) from i))) as o) o where o.o <= i.n_words - i.k
), win as (
    select s.doc_id, s.item_id, s.n_words, s.b, unnest(list_transform(range(s.b, s.b + least(s.n_words, len(d.w)) - s.k + 1), lambda p: array_to_string(d.w[p:p + s.k - 1], ' '))) as s
    from starts s join d using (doc_id)
), wcount as (select doc_id, item_id, n_words, b, s, count(*) as c from win group by all
), sims as (
    select w.doc_id, w.item_id, w.n_words, w.b, sum(least(w.c, coalesce(i.c, 0))) as common, sum(w.c) as n
    from wcount w left join icount i on w.item_id = i.item_id and w.s = i.s group by all
), sim as (select s.doc_id, s.item_id, s.n_words, s.b, s.common / (s.n + len(i.sh) - s.common) as similarity from sims s join ish i using (item_id)
)
select doc_id, item_id, (b - 1)::int as start_word, n_words::int as n_words, similarity from sim where similarity * 100 >= 80
qualify row_number() over (partition by doc_id, item_id order by similarity desc, b) = 1
"""


OP3_SQL = """
with p as (
    select page_id, url, page_id % 365 + 19000 as fetch_day,
      regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#]*@)?(\\[[^\\]/?#]*\\]|[^/?#:@]*)', 1)), '\\.$', '') as host,
      regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*(/[^?#]*)', 1) as path,
      regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*/+([^/?#]+)', 1) as step
    from pages
), hosts as (
    select host from p where host <> '' union
    select array_to_string(list_reverse(list_reverse(string_split(host, '.'))[1:2]), '.') from p where host <> ''
), d as (
    select 'd:' || host as key, ('0x' || substr(md5(host), 1, 7))::bigint as x from hosts
), a as (
    select key, ('0x' || substr(md5(key), 1, 7))::bigint as x
    from (select distinct 'p:' || host || '/' || step as key from p where host <> '' and step <> '')
), rules as (
    select 'block' as list, key, 19000 + x % 200 as from_day, case when x % 2 = 0 then 19050 + x % 200 + x % 100 else 99999999 end as to_day from d where x % 3 = 0
    union all select 'block', key, 19200 + x % 200 + x % 150, 99999999 from d where x % 12 = 0
    union all select 'allow', key, 19000 + x % 250, 99999999 from a where x % 5 = 0
), met as (
    select p.page_id, r.list, r.key from p join rules r on r.from_day <= p.fetch_day and p.fetch_day < r.to_day and p.host <> ''
      and (('d:' || p.host) = r.key or (r.key[1:2] = 'd:' and ends_with(p.host, '.' || r.key[3:]))
        or (r.key[1:2] = 'p:' and starts_with(regexp_replace('p:' || p.host || p.path || '/', '/+', '/', 'g'), r.key || '/')))
), best as (
    select * from met qualify row_number() over (partition by page_id order by length(key) desc, list, key desc) = 1
)
select p.page_id, p.url, p.fetch_day, p.host, case when b.list = 'block' then 'blocked' else 'allowed' end as verdict, b.list, b.key as rule
from p left join best b using (page_id)
"""

_ESC = "regexp_replace(regexp_replace(regexp_replace({}, '&(amp|lt|lsqb|lf);', '&amp;\\1;', 'g'), '<(\\|im_start\\|>|\\|im_end\\|>|/?s>)', '&lt;\\1', 'g'), '\\[(/?INST\\])', '&lsqb;\\1', 'g')"

OP5_SQL = f"""
with r as (
    select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all select -7, 0, 'user', '{TRICKY}' union all select -7, 1, 'assistant', '{TRICKY}'
)
select conv_id, count(*)::bigint as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  sum(case when role = 'assistant' then length(text) else 0 end)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  sum(12 + length(replace({_ESC.format("role")}, chr(10), '&lf;')) + 1 + length({_ESC.format("text")}) + 11)::bigint as formatted_chars
from r group by conv_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_topk": OP2_SQL, "op4_minhash": OP4_SQL, "op3_url_filters": OP3_SQL, "op5_chat": OP5_SQL, "op6_decontaminate": OP6_SQL, "op11_merkle": OP11_SQL, "op12_warc": OP12_SQL, "op13_repair": OP13_SQL}
