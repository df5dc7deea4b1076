"""Text corpora: generators, scoring, resuming, templates, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanlake.functions import text as T
from spanlake.operators import scoring as S
from spanlake.operators import textgen as G
from spanlake.sources import jsonl, tasks

from .registry import query, table

WORDS = r"list_filter(string_split(trim(regexp_replace(text, '[ \t\n\r\f\x0B]+', ' ', 'g')), ' '), lambda w: w <> '')"


@query(r"""select doc_id, regexp_replace(regexp_replace(text, '[ \t\n\r\f\x0B]+', ' ', 'g'), '^ | $', '', 'g') as text from documents""")
def flatten_whitespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.flattened("text").alias("text"))


@query(f"""select word, count(*) as n from (select unnest({WORDS}) as word from documents) group by word order by n desc, word limit 50""")
def cwe_topwords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most common words of the corpus: a top-k report over partial counts."""
    return table(spark, sf_dir, "documents").select(F.explode(T.words("text")).alias("word")).groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(50)


@query(f"""with w as (select distinct doc_id as sample, unnest({WORDS}) as word from documents),
o as (select sample, word, row_number() over (partition by sample order by md5('42:' || sample || '/' || word), word) as r from w),
c as (select sample, word, unnest(range(1, case when r <= 10 then 4 else 2 end)) as copy from o)
select sample, row_number() over (partition by sample order by md5('42:' || sample || '/' || word || '/' || copy), word) as no, word from c""")
def cwe_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each document's words ten stand three times, all others once, numbered in seeded order."""
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("sample"), "text")
    return G.common_words_of_texts(texts, 10, 3, 1)


@query("select k as rank, floor(50000 * power(k::double, -2.0) / 1.6449340668482264)::bigint as n from (select unnest(range(1, 201)) as k)")
def fwe_zeta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.zeta_counts(spark, 50000, 2.0, 200, 1.6449340668482264)


CHAINS = """lines as (select c as chain, h as hop, 'V' || c || 'X' || h as var, case when h > 0 then 'V' || c || 'X' || (h - 1) end as source from (select unnest(range(0, 20)) as c), (select unnest(range(0, 5)) as h))"""


@query(f"""with recursive {CHAINS}, reach as (select var, var as root, 0 as hop from lines where hop = 0 union all select l.var, r.root, r.hop + 1 from lines l join reach r on l.source = r.var)
select var, root, hop from reach""")
def vt_chain_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = G.variable_chains(spark, 20, 4)
    return G.closure(lines.select("var", "source"), lines.where("hop = 0").select("var"))


@query("""with k as (select doc_id as sample, 'key' || doc_id as key from documents)
select sample, key, v::int as value_no, (1000000 + ('0x' || substr(md5('42:' || sample || '/' || key || '/' || v), 1, 12))::bigint % 9000000)::varchar as value
from k, (select unnest(range(0, 4)) as v)""")
def niah_needles(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("sample"), F.concat(F.lit("key"), F.col("doc_id").cast("string")).alias("key"))
    return G.needles(keys, 4).select("sample", "key", "value_no", "value")


SENTENCES = r"list_filter(list_transform(string_split_regex(text, '[.\n]+'), lambda x: trim(x)), lambda x: x <> '')"


@query(f"""with k as (select doc_id as sample, 'key' || doc_id as key from documents),
v as (select sample, (1000000 + ('0x' || substr(md5('42:' || sample || '/' || key || '/0'), 1, 12))::bigint % 9000000)::varchar as value, key from k),
h as (select sample, value, 'One of the special magic numbers for ' || key || ' is: ' || value || '.' as sentence from v),
d as (select doc_id as sample, {SENTENCES} as s from documents),
u as (select sample, unnest(s) as sentence, generate_subscripts(s, 1) - 1 as pos from d), n as (select sample, count(*) as n from u group by sample),
p as (select h.sample, floor(round((('0x' || substr(md5('42:' || h.sample || '/' || sentence), 1, 8))::bigint % 40) * 100 / 39.0::double) * n / 100.0::double)::bigint as pos, 0 as kind, sentence, value from h join n using (sample)),
e as (select * from p union all select sample, pos, 1, sentence, null from u where sample in (select sample from p))
select sample, string_agg(sentence, ' ' order by pos, kind, sentence) as input, list(value order by value) filter (kind = 0) as outputs from e group by sample""")
def niah_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Needles between the sentences of documents."""
    docs = table(spark, sf_dir, "documents")
    keys = docs.select(F.col("doc_id").alias("sample"), F.concat(F.lit("key"), F.col("doc_id").cast("string")).alias("key"))
    parts = F.filter(F.transform(F.split("text", r"[.\n]+"), lambda x: F.trim(x)), lambda x: x != "")
    sentences = docs.select(F.col("doc_id").alias("sample"), F.posexplode(parts).alias("pos", "sentence"))
    return G.haystack(sentences, G.needles(keys))


@query("""with d as (select text, row_number() over (order by text) - 1 as doc_idx from (select distinct text from documents)), t as (select count(*) as total from d),
q as (select item_id as q, item_id % total as gold, total from benchmark, t),
c as (select q, gold as doc_idx, 0 as step from q union all select q, (gold + i) % total, 1 from q, (select unnest([1, 2]) as i)
  union all select q, ('0x' || substr(md5('42:' || q || '/' || i), 1, 12))::bigint % total, 2 from q, (select unnest(range(1, 33)) as i)
  union all select q, (('0x' || substr(md5('42:' || q || '/0'), 1, 12))::bigint % total + i) % total, i + 3 from q, (select unnest(range(0, 12)) as i)),
e as (select q, doc_idx, min(step) as step from c group by q, doc_idx),
f as (select *, row_number() over (partition by q order by step, md5('42:' || q || '/' || doc_idx)) as n from e)
select q, row_number() over (partition by q order by md5('43:' || q || '-' || doc_idx)) as place, doc_idx, step = 0 as gold from f where n <= 8""")
def qa_distractors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight documents a question: its own, the two after it as those of the same article, and drawn ones."""
    from spanlake.sources.questions import numbered

    docs = numbered(table(spark, sf_dir, "documents").select("text"))
    total = docs.agg(F.count("*").alias("_t"))
    own = lambda i: (F.col("item_id") + i) % F.col("_t")
    questions = table(spark, sf_dir, "benchmark").crossJoin(F.broadcast(total)).select(F.col("item_id").alias("q"), F.array(own(0)).alias("context"), F.array(own(1), own(2)).alias("more_context"))
    return G.with_distractors(questions, docs, 8).select("q", F.col("place").cast("long").alias("place"), "doc_idx", "gold")


@query(f"""with t as (select doc_id, lang, len({WORDS}) as tokens from documents), r as (select *, (sum(tokens) over (partition by lang order by doc_id rows between unbounded preceding and current row))::bigint as running from t)
select doc_id, lang, tokens, running from r where running <= 5000""")
def length_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.within_budget(table(spark, sf_dir, "documents"), 5000, "lang", "doc_id").select("doc_id", "lang", "tokens", "running")


@query(f"""with t as (select doc_id, lang, len({WORDS}) as tokens from documents),
r as (select lang, row_number() over w as n, (sum(tokens) over w)::bigint as used, count(*) over (partition by lang) as total from t window w as (partition by lang order by doc_id rows between unbounded preceding and current row))
select lang, coalesce(max(n) filter (ok), 0)::bigint as units, coalesce(max(used) filter (ok), 0)::bigint as tokens from (select *, (n % 10 = 0 or n = total) and used + 128 <= 4096 as ok from r) group by lang""")
def length_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents of each language fit 4096 tokens, in steps of ten, with 128 to spare for the answer."""
    return G.fitting_units(table(spark, sf_dir, "documents"), 4096, 128, 10, "lang", "doc_id")


@query("select c::int as chunk, (500 // 7 + (case when c < 500 % 7 then 1 else 0 end))::bigint as n, c + 42 as seed from (select unnest(range(0, 7)) as c)")
def chunk_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.chunk_sizes(spark, 500, 7)


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as predictions for the first three words of a benchmark item: that of the same number, modulo their count."""
    b = table(spark, sf_dir, "benchmark")
    n = b.agg(F.count("*").alias("n"))
    b = b.select(F.col("item_id").alias("k"), F.slice(F.split("text", " "), 1, 3).alias("outputs"))
    d = table(spark, sf_dir, "documents").crossJoin(F.broadcast(n)).select("doc_id", "lang", "text", (F.col("doc_id") % F.col("n")).alias("k"))
    return d.join(b, "k").select(F.col("doc_id").alias("index"), F.col("lang").alias("task"), F.col("text").alias("pred"), "outputs")


PRED = r"""p as (select d.doc_id as "index", d.lang as task, lower(regexp_replace(regexp_replace(trim(d.text), '[\x00-\x1F]', chr(10), 'g'), '^\s+|\s+$', '', 'g')) as pred, string_split(b.text, ' ')[1:3] as refs from documents d join benchmark b on b.item_id = d.doc_id % (select count(*) from benchmark))"""


@query(f"""with {PRED} select task, round(avg(len(list_filter(refs, lambda r: contains(pred, lower(r))))::double / len(refs)) * 100, 2) as score, sum(case when pred = '' then 1 else 0 end)::bigint || '/' || count(*) as nulls from p group by task""")
def match_all_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.evaluate(_predictions(spark, sf_dir), "all")


@query(f"""with {PRED} select task, round(avg(case when len(list_filter(refs, lambda r: contains(pred, lower(r)))) > 0 then 1.0::double else 0.0::double end) * 100, 2) as score, sum(case when pred = '' then 1 else 0 end)::bigint || '/' || count(*) as nulls from p group by task""")
def match_part_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.evaluate(_predictions(spark, sf_dir), "part")


@query("select lang as task, sum(case when length(trim(text)) = 0 then 1 else 0 end)::bigint || '/' || count(*) as nulls from documents group by lang")
def null_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "documents")
    return p.groupBy(F.col("lang").alias("task")).agg(F.concat_ws("/", F.sum((F.length(F.trim("text")) == 0).cast("long")), F.count("*")).alias("nulls"))


@query(r"""with p as (select doc_id, (case when doc_id % 3 = 0 then ': ' when doc_id % 3 = 1 then ':' else '' end) || text || (case when doc_id % 2 = 0 then '. ' else '' end) as x from documents),
s as (select doc_id, case when starts_with(x, ': ') then regexp_replace(x[3:], '^\s+|\s+$', '', 'g') when starts_with(x, ':') then regexp_replace(x[2:], '^\s+|\s+$', '', 'g') else x end as x from p)
select doc_id, case when suffix(x, '.') then regexp_replace(left(x, -1), '\s+$', '') else x end as pred from s""")
def postprocess_pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    head = F.when(F.col("doc_id") % 3 == 0, ": ").when(F.col("doc_id") % 3 == 1, ":").otherwise("")
    x = F.concat(head, F.col("text"), F.when(F.col("doc_id") % 2 == 0, ". ").otherwise(""))
    return d.select("doc_id", T.clean_prediction(x).alias("pred"))


@query("""with p as (select doc_id, repeat('<|begin_of_text|>', (doc_id % 3)::int) || text as x from documents)
select doc_id, case when doc_id % 3 > 1 then '<|begin_of_text|>' || string_split(x, '<|begin_of_text|>')[-1] else x end as fixed from p""")
def fix_begin_of_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    x = F.concat(F.repeat(F.lit(T.BEGIN_TOKEN), (F.col("doc_id") % 3).cast("int")), F.col("text"))
    return d.select("doc_id", T.one_begin(x).alias("fixed"))


@query("select doc_id as \"index\", text as input from documents where doc_id not in (select doc_id from labels)")
def resume_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples that have no prediction yet (labels stand for the finished ones)."""
    samples = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("index"), F.col("text").alias("input"))
    return jsonl.unfinished(samples, table(spark, sf_dir, "labels").select(F.col("doc_id").alias("index")))


@query("""select conv_id, string_agg('<' || role || '>' || trim(text) || '</' || role || '>', chr(10) order by turn) || chr(10) || '<assistant>' as prompt from conversations group by conv_id""")
def chat_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation through a template, with the answer's prefix at the end."""
    line = G.fill_template(F.lit("<{role}>{text}</{role}>"), {"role": F.col("role"), "text": F.trim("text")})
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", line.alias("line")).alias("t"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list("t")), lambda t: t["line"]), "\n")
    return turns.groupBy("conv_id").agg(joined.alias("j")).select("conv_id", F.concat("j", F.lit("\n<assistant>")).alias("prompt"))


HTML = r"""regexp_replace(regexp_replace(regexp_replace(html, '<(script|style)\b.*?</(script|style)>|<!--.*?-->', ' ', 'gis'), '<br\s*/?>|</(p|div|li|tr|h[1-6]|title)>', chr(10), 'gi'), '<[^>]*>', '', 'g')"""


@query(rf"""select page_id, regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace({HTML}, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '[ \t]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'), '^[ \n]+|[ \n]+$', '', 'g') as text from pages""")
def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.html_text("html").alias("text"))


@query("""select c as id, try_cast(nullif(regexp_extract(n, '(\\d+(?:\\.\\d+)?)[bB](?:$|[^a-zA-Z])', 1), '') as double) as billions from (select unnest(range(0, 4)) as c, unnest(['Model-8B-Instruct', 'model-0.5b', 'plain', 'M-72B']) as n)""".replace("\\\\", "\\"))
def model_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.createDataFrame([(0, "Model-8B-Instruct"), (1, "model-0.5b"), (2, "plain"), (3, "M-72B")], "id long, name string")
    return df.select("id", T.model_size("name").alias("billions"))


@query("select i::int as i, round(i * 100 / 39.0::double)::int as depth from (select unnest(range(0, 40)) as i)")
def needle_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(1).select(F.posexplode(T.depths()).alias("i", "depth"))


@query("""select * from (values ('niah', 8::bigint, 128), ('variable_tracking', 1, 30), ('common_words_extraction', 1, 120), ('freq_words_extraction', 1, 50), ('qa', 2, 32)) t(task, n, tokens)""")
def task_config_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.task_table(spark).groupBy("task").agg(F.count("*").alias("n"), F.max("tokens_to_generate").alias("tokens"))


@query("select doc_id as \"ID\", lang as \"Task\", text as \"Prediction\" from documents where doc_id in (select doc_id from labels)")
def submission_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of tasks that have a file (a semi-join), of every task and of none, as one submission table."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left_semi")
    return tasks.submission(d.select(F.col("lang").alias("task"), F.col("doc_id").alias("index"), F.col("text").alias("pred")))


@query("""select page_id, row_number() over (order by url, page_id) - 1 as number, (sum(length(html) + 2) over (order by url, page_id rows between unbounded preceding and current row) - length(html) - 2)::bigint as start from pages""")
def crawl_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages joined in order of their names: where each stands in the corpus."""
    p = table(spark, sf_dir, "pages").select("page_id", "url", F.col("html").alias("text"))
    return G.joined_corpus(p, ["url", "page_id"]).select("page_id", "number", "start")


@query("select doc_id, lang, row_number() over (partition by lang order by md5('42:' || doc_id), doc_id) as place from documents")
def seeded_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("lang").orderBy(G.shuffled(F.col("doc_id"), 42), "doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", "lang", F.row_number().over(order).cast("long").alias("place"))


@query("select row_number() over (order by text) - 1 as doc_idx, length(text) as n_chars from (select distinct text from documents)")
def distinct_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct texts in order, numbered from 0, by sorted ranges."""
    from spanlake.sources.questions import numbered

    return numbered(table(spark, sf_dir, "documents").select("text")).select("doc_idx", F.length("text").cast("long").alias("n_chars"))


@query(r"""with d as (select doc_id, source, text, list_filter(list_transform(string_split_regex(text, '[.\n]+'), lambda x: trim(x)), lambda x: x <> '') as s from documents)
select doc_id, len(s) as sentences, list_max(list_transform(s, lambda x: length(x))) as longest from d""")
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.filter(F.transform(F.split("text", r"[.\n]+"), lambda x: F.trim(x)), lambda x: x != "")
    d = table(spark, sf_dir, "documents").select("doc_id", s.alias("s"))
    return d.select("doc_id", F.size("s").cast("long").alias("sentences"), F.array_max(F.transform("s", lambda x: F.length(x).cast("long"))).alias("longest"))
