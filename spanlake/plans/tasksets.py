"""Task prompts with answers, and small operators over states and requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanlake.functions import text as T
from spanlake.operators import attention as A
from spanlake.operators import prompts as P
from spanlake.operators import retrieval as R
from spanlake.operators import textgen as G
from spanlake.operators import updates as U

from .attention import LOGITS, _logits
from .corpora import WORDS
from .registry import query, table

NUMBER = "(1000000 + ('0x' || substr(md5({0}), 1, 12))::bigint % 9000000)::varchar"
WORD = "translate(substr(md5({0}), 1, 10), '0123456789', 'ghijklmnop')"


def _text(x: str) -> str:
    return "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _needle(key: str, value: str) -> str:
    return f"'One of the special magic numbers for ' || {key} || ' is: ' || {value} || '.'"


def _hidden(noise: str, size: int, keys: int, values: int, queries: int) -> str:
    one = queries * values == 1
    body = (P.singular(P.HIDDEN) if one else P.HIDDEN).replace("{kind}", "number" if one else "numbers")
    parts = body.replace("{context}", "\x00context\x00").replace("{query}", "\x00query\x00").split("\x00")
    whole = " || ".join(p if p in ("context", "query") else _text(p) for p in parts)
    listed = "names[1]" if queries == 1 else f"array_to_string(names[1:{queries - 1}], ', ') || ', and ' || names[{queries}]"
    return f"""with s as (select doc_id as sample from documents),
k as (select sample, k, {WORD.format("'42:' || sample || '/key/' || k")} as key from s, (select unnest(range(0, {keys})) as k)),
h as (select sample, k, v, key, {NUMBER.format("'42:' || sample || '/value/' || k || '/' || v")} as value from k, (select unnest(range(0, {values})) as v)),
hp as (select *, row_number() over (partition by sample order by md5('42:' || sample || '/needle/' || k || '/' || v), k, v) as place from h),
n as (select sample, pos, {noise} as sentence from s, (select unnest(range(0, {size})) as pos)),
d as (select sample, pos, row_number() over (partition by sample order by md5('42:' || sample || '/place/' || pos), pos) as n from n),
pl as (select sample, pos, row_number() over (partition by sample order by pos desc) as place from d where n <= {keys * values}),
l as (select sample, pos, 1 as kind, sentence from n union all select sample, pos, 0, {_needle("key", "value")} from hp join pl using (sample, place)),
c as (select sample, string_agg(sentence, chr(10) order by pos, kind, sentence) as context from l group by sample),
q as (select * from (select sample, k, key, row_number() over (partition by sample order by md5('42:' || sample || '/query/' || k), k) as q from k) where q <= {queries}),
a as (select sample, list(value order by q, v) as outputs from h join q using (sample, k) group by sample),
qn as (select sample, list(key order by q) as names from q group by sample),
ql as (select sample, {listed} as query from qn)
select sample, {whole} as input, outputs from c join ql using (sample) join a using (sample)"""


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("sample"))


@query(_hidden(_text(P.NOISE), 12, 1, 1, 1))
def niah_prompt_repeat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One needle in a haystack of one repeated sentence; the prompt in the singular."""
    return P.needle_prompts(_samples(spark, sf_dir), "repeat", 12)


@query(_hidden(_needle(WORD.format("'42:' || sample || '/other/' || pos"), NUMBER.format("'42:' || sample || '/others/' || pos")), 12, 4, 2, 2))
def niah_prompt_needle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four keys of two values among other needles; two keys are asked for."""
    return P.needle_prompts(_samples(spark, sf_dir), "needle", 12, keys=4, values=2, queries=2)


def _track(noises: int, chains: int, hops: int) -> str:
    n = hops + 1
    body = " || ".join(p if p in ("context", "query") else _text(p) for p in P.TRACK.replace("{context}", "\x00context\x00").replace("{query}", "\x00query\x00").split("\x00") if p)
    return f"""with s as (select doc_id as sample from documents),
d as (select sample, translate(substr(md5('42:' || sample || '/variable/' || i), 1, 5), '0123456789abcdef', 'ABCDEFGHIJKLMNOP') as var, i from s, (select unnest(range(0, {chains * n + 8})) as i)),
f as (select sample, var, min(i) as i from d group by sample, var), g as (select sample, var, row_number() over (partition by sample order by i) as no from f),
v as (select sample, var, (no - 1) // {n} as chain, (no - 1) % {n} as hop, 10000 + ('0x' || substr(md5('42:' || sample || '/start/' || ((no - 1) // {n})), 1, 12))::bigint % 90000 as value from g where no <= {chains * n}),
l as (select a.sample, a.var, a.chain, a.hop, a.value, case when a.hop = 0 then 'VAR ' || a.var || ' = ' || a.value else 'VAR ' || a.var || ' = VAR ' || b.var || ' ' end as line
  from v a left join v b on a.sample = b.sample and a.chain = b.chain and a.hop = b.hop + 1),
r as (select sample, chain, pos, row_number() over (partition by sample, chain order by md5('42:' || sample || '/at/' || chain || '/' || pos), pos) as no from s, (select unnest(range(0, {chains})) as chain), (select unnest(range(0, {noises})) as pos)),
p as (select sample, chain, pos, row_number() over (partition by sample, chain order by pos) - 1 as hop from r where no <= {n}),
x as (select sample, pos, {chains} as chain, 0 as hop, {_text(P.NOISE)} || chr(10) as line from s, (select unnest(range(0, {noises})) as pos) union all select sample, pos, chain, hop, line from l join p using (sample, chain, hop)),
c as (select sample, replace(string_agg(line, ' ' order by pos, chain, hop), '. ' || chr(10), '.' || chr(10)) as context from x group by sample),
a as (select sample, any_value(value)::varchar as query, list(var order by hop) as outputs from v where chain = 0 group by sample)
select sample, {body} as input, outputs from c join a using (sample)"""


@query(_track(12, 2, 4))
def vt_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two chains of four hops among twelve noise lines, one sample a document."""
    return P.tracking_prompts(_samples(spark, sf_dir), 12, chains=2, hops=4)


@query(f"""with w as (select distinct conv_id as sample, unnest({WORDS}) as word from conversations),
o as (select sample, word, row_number() over (partition by sample order by md5('42:' || sample || '/' || word), word) as n from w),
c as (select sample, word, unnest(range(1, case when n <= 10 then 7 else 2 end)) as copy from o),
p as (select sample, word, row_number() over (partition by sample order by md5('42:' || sample || '/' || word || '/' || copy), word) as no from c),
x as (select sample, string_agg(no || '. ' || word, ' ' order by no) as context from p group by sample),
a as (select sample, list(word order by n) as outputs from o where n <= 10 group by sample)
select sample, {" || ".join("context" if p == "context" else _text(p) for p in P.COMMON.replace("{context}", chr(0) + "context" + chr(0)).split(chr(0)))} as input, outputs from x join a using (sample)""")
def cwe_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The short variant: ten words of each conversation stand six times, all others once."""
    words = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("sample"), F.explode(T.words("text")).alias("word")).distinct()
    return P.common_prompts(words, frequent=6, rare=1)


@query(f"""with s as (select item_id as sample from benchmark), r as (select sample, k as rank,
  case when k = 1 then '...' else translate(substr(md5('42:' || sample || '/word/' || k), 1, 6), '0123456789', 'ghijklmnop') end as word, floor(300 * power(k::double, -2.0) / 1.6449340668482264)::int as n from s, (select unnest(range(1, 41)) as k)),
c as (select sample, rank, word, unnest(range(1, n + 1)) as copy from r where n > 0),
x as (select sample, string_agg(word, ' ' order by md5('42:' || sample || '/' || rank || '/' || copy), word) as context from c group by sample),
a as (select sample, list(word order by rank) as outputs from r where rank between 2 and 4 group by sample)
select sample, {" || ".join("context" if p == "context" else _text(p) for p in P.CODED.replace("{context}", chr(0) + "context" + chr(0)).split(chr(0)))} as input, outputs from x join a using (sample)""")
def fwe_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.coded_prompts(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("sample")), 300, 2.0, 40, 1.6449340668482264)


@query(f"""with d as (select text, row_number() over (order by text) - 1 as doc_idx from (select distinct text from benchmark)), t as (select count(*) as total from d),
q as (select item_id as q, text as query from benchmark),
p as (select q, i + 1 as place, (q + i * 7) % total as doc_idx from q, t, (select unnest(range(0, 3)) as i)),
c as (select q, string_agg('Document ' || place || ':' || chr(10) || text, chr(10) || chr(10) order by place) as context from p join d using (doc_idx) group by q)
select q, {" || ".join(p if p in ("context", "query") else _text(p) for p in P.QUESTION.replace("{context}", chr(0) + "context" + chr(0)).replace("{query}", chr(0) + "query" + chr(0)).split(chr(0)))} as input from c join q using (q)""")
def qa_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered documents around a question; here three places of a fixed pattern a question."""
    from spanlake.sources.questions import numbered

    b = table(spark, sf_dir, "benchmark")
    docs = numbered(b.select("text"))
    total = docs.agg(F.count("*").alias("_t"))
    placed = b.crossJoin(F.broadcast(total)).select(F.col("item_id").alias("q"), F.col("_t"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("i"))
    placed = placed.select("q", (F.col("i") + 1).alias("place"), ((F.col("q") + F.col("i") * 7) % F.col("_t")).alias("doc_idx"))
    return P.question_prompts(b.select(F.col("item_id").alias("q"), F.col("text").alias("query")), placed, docs)


@query(f"""with {LOGITS}, r as (select *, row_number() over (partition by "row" order by logit desc, token) as rank from l), k as (select * from r where rank <= 5),
w as (select *, exp((logit - max(logit) over (partition by "row")) / 0.7::double) as w from k), p as (select *, w / sum(w) over (partition by "row") as p from w),
c as (select *, sum(p) over (partition by "row" order by rank rows between unbounded preceding and current row) as upto from p),
u as (select *, ('0x' || substr(md5('3:' || "row"), 1, 8))::bigint / 4294967296.0::double as u from c)
select "row", arg_min(token, rank) as token from u where upto > u or rank = 5 group by "row" """)
def sampled_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A draw from the five likeliest tokens of every row."""
    return A.drawn(A.filtered(_logits(spark, sf_dir), top_k=5, temperature=0.7), 3)


@query("""with i as (select label as head, vec_id as idx, row_number() over (partition by label order by vec_id desc) - 1 as i from embeddings)
select i.head, i - 4 as dst_pos, idx, embedding[1]::double as first from i join embeddings e on e.vec_id = i.idx and e.label = i.head where i >= 4 and i < 12""")
def gather_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys and their places by a window [4, 12) of each head's index list (its tokens, last first)."""
    e = table(spark, sf_dir, "embeddings").select(F.col("label").alias("head"), F.col("vec_id").alias("token_pos"), "embedding")
    order = Window.partitionBy("head").orderBy(F.desc("token_pos"))
    index = e.select("head", F.col("token_pos").alias("idx"), (F.row_number().over(order) - 1).cast("long").alias("i"))
    return R.gather_window(e, index, 4, 8).select("head", "dst_pos", "idx", F.element_at("embedding", 1).cast("double").alias("first"))


@query("""select event_id, user_id % 4 as layer, row_number() over (order by user_id % 4, event_id) - 1 as place from events""")
def build_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index builds in order of layer, then arrival."""
    jobs = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 4).alias("layer"))
    return R.by_priority(jobs, "layer", "event_id").select("event_id", "layer", "place")


@query("select event_type as model, arg_max(event_id, (ts, event_id)) as newest from events group by event_type")
def newest_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each model's snapshots the one written last, the larger name among equals."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("event_type").alias("model")).agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("newest"))


@query("select event_type as stage, count(*) as n, round(sum(value), 4) as total, round(avg(value), 6) as mean from events group by event_type")
def stage_timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("event_type").alias("stage")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.round(F.avg("value"), 6).alias("mean"))


@query("""with st as (select user_id as seq_id, 8 * count(*) as capacity, user_id % 3 as heads, count(*) as tokens from events group by user_id),
rq as (select user_id as seq_id, user_id % 2 * 40 + 30 as length, user_id % 3 as heads from events group by user_id)
select seq_id, capacity >= length and st.heads = rq.heads as reused, case when capacity >= length and st.heads = rq.heads then capacity else length end::bigint as capacity, 0::bigint as tokens
from rq left join st using (seq_id)""")
def sequence_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of sequences for the next request: kept and emptied where the shapes fit, else new."""
    e = table(spark, sf_dir, "events")
    state = e.groupBy(F.col("user_id").alias("seq_id")).agg(F.count("*").alias("tokens")).withColumns({"capacity": F.col("tokens") * 8, "heads": F.col("seq_id") % 3})
    asked = e.select(F.col("user_id").alias("seq_id")).distinct().withColumns({"length": F.col("seq_id") % 2 * 40 + 30, "heads": F.col("seq_id") % 3})
    return U.reset_sequences(state, asked).select("seq_id", "reused", "capacity", "tokens")
