"""The queries of this subpackage: operators with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_output import token_files

    return token_files(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import cascade

    got = cascade(_table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP2_SQL = """
with t as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
w as (select r, doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') as w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as ls from t),
g as (select r, i, list_slice(w, i, i + 7) as g from (select r, w, unnest(range(1, len(w) - 6)) as i from w where len(w) >= 8)),
d as (select r, i from (select r, i, count(*) over (partition by r, g) as n from g) where n > 1),
c as (select r, count(distinct p) as n from (select r, unnest(range(i, i + 8)) as p from d) group by r),
f as (select doc_id, cast(len(w) as bigint) as n_words, cast(length(array_to_string(w, '')) as bigint) as word_chars,
        cast(length(t) - length(translate(t, '#*$%&|<>', '')) as bigint) as n_symbols, cast(length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) as bigint) as caps,
        len(ls) as n_lines, cast(len(ls) - len(list_distinct(ls)) as bigint) as n_dup_lines, cast(coalesce(c.n, 0) as bigint) as n_repeat_words,
        len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) as n_stutter
      from w left join c using (r)),
b as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from f)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not (base_failed or 10 * n_symbols > 3 * n_words or 10 * caps > 4 * word_chars or word_chars > 40 * n_words or 100 * n_stutter > 30 * n_words or (n_lines >= 5 and 10 * n_dup_lines > 6 * n_lines)) as kept
from b
"""


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neardup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), width=3, percent=85)


#: The same links and components by brute force over all pairs that share a shingle.
OP3_SQL = """
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents),
s as (select doc_id, list_distinct(case when len(w) >= 3 then list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
                                        when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as sh from w),
e as (select doc_id, unnest(sh) as x from s),
c as (select a.doc_id as a, b.doc_id as b, count(*) as both_ from e a join e b on a.x = b.x and a.doc_id <> b.doc_id group by all),
l as (select a, b from c join s sa on sa.doc_id = a join s sb on sb.doc_id = b where 100 * both_ >= 85 * (len(sa.sh) + len(sb.sh) - both_)),
r as (select doc_id as a, doc_id as b from s union select r.a, l.b from r join l on r.b = l.a)
select s.doc_id, cast(len(sh) as bigint) as n_shingles, least(s.doc_id, m.c) as component_id, s.doc_id = least(s.doc_id, m.c) as kept
from s join (select a, min(b) as c from r group by a) m on m.a = s.doc_id
"""


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import held_out, toxicity

    found = toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("spans").cast("long").alias("n_spans"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_report

    return mix_report(_table(spark, sf_dir, "documents"))


#: Targets, blocks and draws again; which shard takes a block doesn't change how often it is taken.
OP5_SQL = """
with d0 as (select row_number() over () as r, doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as bigint) as size, md5(coalesce(cast(doc_id as varchar), 'null') || ':' || md5(coalesce(text, ''))) as key from documents),
s0 as (select source, cast(sum(size) as bigint) as source_size from d0 group by source),
s1 as (select *, row_number() over (order by source nulls last) as place from s0),
s2 as (select *, [3.0::double, 1.0::double, 2.0::double][(place - 1) % 3 + 1] as weight, cast(2 * source_size as double) as cap from s1),
s3 as (select *, 1.5::double * sum(source_size) over () as total, sum(weight) over () as w,
         coalesce(sum(cap) over o, 0) as c0, coalesce(sum(weight) over o, 0) as w0 from s2 window o as (order by cap / weight, place rows between unbounded preceding and 1 preceding)),
s4 as (select *, cap / weight <= (total - c0) / (w - w0) as is_full from s3),
s5 as (select *, sum(case when is_full then cap else 0 end) over () as ct, sum(case when is_full then weight else 0 end) over () as wt from s4),
s as (select source, place, source_size, case when is_full then cap else weight * (total - ct) / (w - wt) end as target from s5),
d as (select d0.*, s.place, s.source_size, s.target from d0 join s on d0.source is not distinct from s.source),
k as (select *, list_sum(list_transform(range(1, 7), lambda i: (strpos('0123456789abcdef', substr(key, i, 1)) - 1) * cast(pow(16, 6 - i) as bigint)))
         % greatest(1, least(16777216, cast(ceil(source_size / 65536.0) as bigint))) as block from d),
b0 as (select place, block, cast(sum(size) as bigint) as words, any_value(source_size) as source_size, any_value(target) as target from k group by place, block),
b1 as (select *, case when source_size > 0 then cast(floor(target / source_size) as bigint) else 0 end as passes from b0),
b2 as (select *, cast(round(target) as bigint) - passes * source_size as rest,
         cast(coalesce(sum(words) over (partition by place order by md5(place || ':' || cast(block as bigint) || ':block'), block rows between unbounded preceding and 1 preceding), 0) as bigint) as before_ from b1),
b as (select place, block, passes, before_ + words <= rest as whole_, case when before_ + words > rest and before_ < rest then rest - before_ end as room from b2),
e0 as (select k.r, k.place, k.key, k.size, b.room, sum(size) over (partition by k.place order by key range between unbounded preceding and current row) <= room as edge, sum(size) over (partition by k.place, key) as twins
       from k join b using (place, block) where room is not null),
FILL
e as (select r, edge from eLAST)
select doc_id, size, source_size, target, cast(size * (passes + case when whole_ or coalesce(edge, false) then 1 else 0 end) as bigint) as taken
from k join b using (place, block) left join e using (r)
"""


OP5_SQL = OP5_SQL.replace("FILL", "\n".join(f"""g{k} as (select * exclude (edge), edge as had, room - sum(case when edge then size else 0 end) over (partition by place) as gap from e{k - 1}),
h{k} as (select *, first_value(key) over (partition by place order by had, abs(twins - gap), key) as best from g{k}),
e{k} as (select r, place, key, size, room, had or (key = best and abs(twins - gap) < gap) as edge, twins from h{k}),""" for k in range(1, 5))).replace("eLAST", "e4")


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import top_k, usable

    vectors = _table(spark, sf_dir, "embeddings").where(usable(F.col("embedding")))
    return top_k(vectors.select("vec_id", F.col("embedding").alias("weights")), F.col("vec_id") % 50 == 0, 5, scale=256)


OP6_SQL = """
with v as (select row_number() over () as r, vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as hugeint)) as w from embeddings
           where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
p as (select q.r, q.vec_id as query_id, c.vec_id, coalesce(cast(list_sum(list_transform(range(1, 1 + least(len(q.w), len(c.w))), lambda i: q.w[i] * c.w[i])) as bigint), 0) as score
      from v q join v c on q.vec_id % 50 = 0 and q.r <> c.r),
k as (select query_id, cast(row_number() over (partition by r order by score desc, vec_id nulls last) as int) as rank, vec_id, score from p)
select query_id, rank, vec_id, score from k where rank <= 5
"""


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import digests, format_conversations, text_parts

    said = r"\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    messages = _table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    return digests(format_conversations(text_parts(messages.unionByName(extra))))


OP7_SQL = """
with m as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
           union all select -7, 0, 'user', '\\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\\### Assistant: </turn> ok')
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(coalesce(sum(case when role = 'assistant' then length(text) end), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn, role, text), '')) as loss_sha256,
  cast(sum(14 + 2 * length(role) - length(translate(role, '#<:' || chr(92), '')) + 2 * length(text) - length(translate(text, '#<' || chr(92), ''))) as bigint) as formatted_chars
from m group by conv_id
"""


def op8_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of the compacted store's last version, with its text's size and digest."""
    from .scratch import Scratch
    from .sharding import ShardStore, arrivals

    store = ShardStore(spark, Scratch(spark, "shards").folder("store"))
    store.append_each(_table(spark, sf_dir, "documents"), arrivals())
    store.compact()
    store.vacuum()
    return store.read().select("doc_id", "lang", "source", "n_chars", F.octet_length("text").cast("long").alias("n_bytes"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


OP8_SQL = "select doc_id, lang, source, n_chars, cast(octet_length(encode(text)) as bigint) as n_bytes, md5(text) as text_md5 from documents"


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import digests

    return digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urlfilter import url_filter

    return url_filter(_table(spark, sf_dir, "pages"))


def op10_sql() -> str:
    """Trust, distrust and lean by recursion, the steps that take them below SETTLED and a few more."""
    from math import ceil, log

    from .urlfilter import BLOCKED, DAMPING, RULES, SETTLED, THRESHOLD, TRUSTED

    up, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    bad = " or ".join(f"host = '{h}' or ends_with(host, '.{h}')" for h in BLOCKED)
    good = "host in (" + ", ".join(f"'{h}'" for h in TRUSTED) + ")"
    fits = [(r, v, *r.split("/", 1)) for v, r in sorted(RULES, key=lambda x: -len(x[1]))]
    case = lambda k: "case " + " ".join(f"when (p.host = '{x[2]}' or ends_with(p.host, '.{x[2]}')) and starts_with(path, '/{x[3]}') then '{x[k]}'" for x in fits) + " end"
    steps = ceil(log(SETTLED) / log(DAMPING)) + 3
    return f"""
with recursive p as (select page_id, coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), '{up}', '{low}'), '') as host, coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's'), '') as path, html from pages),
l as (select host as src, regexp_replace(translate(unnest(regexp_extract_all(coalesce(html, ''), '(?:href|src)\\s*=\\s*["'']?\\s*(?:https?:)?//([^/?#"''\\s>]+)', 1, 'i')), '{up}', '{low}'), '^[^@]*@', '') as dst from p),
e as (select src, dst, count(*) as n from l where src <> '' and dst <> '' and src <> dst group by src, dst),
shares as materialized (select src, dst, n / sum(n) over (partition by src) as ahead, n / sum(n) over (partition by dst) as back from e),
hosts as (select host from p where host <> '' union select dst from e),
seeds as materialized (select host, case when {bad} then 0.0 when {good} then 1.0 else 0.0 end::double as good, case when {bad} then 1.0 else 0.0 end::double as bad from hosts),
r as (
  select 0 as k, host, {1 - DAMPING} * good as t, {1 - DAMPING} * bad as d, {1 - DAMPING} * bad as l from seeds
  union all
  select r.k + 1, r.host, {1 - DAMPING} * s.good + {DAMPING} * coalesce(f.t, 0), {1 - DAMPING} * s.bad + {DAMPING} * coalesce(b.d, 0), {1 - DAMPING} * s.bad + {DAMPING} * coalesce(b.l, 0)
  from r join seeds s on s.host = r.host
  left join (select dst, sum(t * ahead) as t from shares join r on src = host group by dst) f on f.dst = r.host
  left join (select src, sum(d * back) as d, sum(l * ahead) as l from shares join r on dst = host group by src) b on b.src = r.host
  where r.k < {steps} and exists (select 1 from shares))
select page_id, p.host, path, {case(0)} as rule, coalesce({case(1)}, case when greatest(x.d, x.l) - x.t >= {THRESHOLD} then 'block' else 'allow' end) as verdict
from p left join (select * from r where k = (select max(k) from r)) x on x.host = p.host
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_token_files, op2_quality, op3_near_duplicates, op4_toxicity, op5_mixing, op6_top_k, op7_chat, op8_shards, op9_bpe, op10_url_filter)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op2_quality": OP2_SQL, "op3_near_duplicates": OP3_SQL, "op5_mixing": OP5_SQL, "op6_top_k": OP6_SQL, "op7_chat": OP7_SQL, "op8_shards": OP8_SQL, "op10_url_filter": op10_sql()}
