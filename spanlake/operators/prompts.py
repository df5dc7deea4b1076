"""Prompts of long-context tasks, with their answers, as DataFrames: one row a sample.

Draws are seeded md5 orders and numbers, as in ``textgen``. A sample's rows meet in one task: a sample is one prompt,
bounded by the context length it is made for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanlake.functions.text import seeded_number

from .textgen import fill_template, shuffled

#: Sentences and templates of the tasks.
NOISE = "The grass is green. The sky is blue. The sun is yellow. Here we go. There and back again."
NEEDLE = "One of the special magic {kind} for {key} is: {value}."
HIDDEN = "Some special magic {kind} are hidden within the following text. Make sure to memorize it. I will quiz you about the {kind} afterwards.\n{context}\nWhat are all the special magic {kind} for {query} mentioned in the provided text?"
COMMON = "Below is a numbered list of words. In these words, some appear more often than others. Memorize the ones that appear most often.\n{context}\nQuestion: What are the 10 most common words in the above list?"
CODED = "Read the following coded text and track the frequency of each coded word. Find the three most frequently appeared coded words. {context}\nQuestion: Do not provide any explanation. Please ignore the dots '....'. What are the three most frequently appeared words in the above coded text?"
TRACK = "Memorize and track the chain(s) of variable assignment hidden in the following text.\n\n{context}\nQuestion: Find all variables that are assigned the value {query} in the text above."
ANSWER = "Answer the question based on the given documents. Only give me the answer and do not output any other words."
QUESTION = ANSWER + "\n\nThe following are given documents.\n\n{context}\n\n" + ANSWER + "\n\nQuestion: {query}"


def _name(*parts: Column | str) -> Column:
    return F.concat_ws("/", *(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def value_of(kind: str, name: Column, seed: int) -> Column:
    """A number of seven digits, a word of letters or a uuid, by the name's hash."""
    h = shuffled(name, seed)
    if kind == "numbers":
        return seeded_number(name, seed).cast("string")
    if kind == "words":
        return F.translate(F.substring(h, 1, 10), "0123456789", "ghijklmnop")
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))


def singular(template: str) -> str:
    """The template for one value of one key."""
    return template.replace("Some", "A").replace("are all", "is").replace("are", "is").replace("answers", "answer")


def needle_prompts(samples: DataFrame, haystack: str, size: int, keys: int = 1, values: int = 1, queries: int = 1, key_kind: str = "words", value_kind: str = "numbers", seed: int = 42) -> DataFrame:
    """(sample, input, outputs) from (sample): needles among ``size`` sentences, all one (``repeat``) or other needles (``needle``).

    Of max(keys, queries) keys, ``queries`` are asked for; the answers are all their values.
    """
    keys = max(keys, queries)
    many = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    s = F.col("sample")

    def sentence(key: Column, value: Column) -> Column:
        return fill_template(F.lit(NEEDLE), {"kind": F.lit(value_kind), "key": key, "value": value})

    named = samples.select("sample", many(keys).alias("k")).withColumn("key", value_of(key_kind, _name(s, "key", F.col("k")), seed))
    hidden = named.select("sample", "k", "key", many(values).alias("v")).withColumn("value", value_of(value_kind, _name(s, "value", F.col("k"), F.col("v")), seed))
    hidden = hidden.withColumn("sentence", sentence(F.col("key"), F.col("value")))
    order = Window.partitionBy("sample").orderBy(shuffled(_name(s, "needle", F.col("k"), F.col("v")), seed), "k", "v")
    hidden = hidden.withColumn("place", F.row_number().over(order))
    noise = samples.select("sample", many(size).alias("pos"))
    other = sentence(value_of(key_kind, _name(s, "other", F.col("pos")), seed), value_of(value_kind, _name(s, "others", F.col("pos")), seed))
    noise = noise.withColumn("sentence", F.lit(NOISE) if haystack == "repeat" else other)
    drawn = Window.partitionBy("sample").orderBy(shuffled(_name(s, "place", F.col("pos")), seed), "pos")
    places = noise.select("sample", "pos", F.row_number().over(drawn).alias("n")).where(F.col("n") <= keys * values)
    places = places.withColumn("place", F.row_number().over(Window.partitionBy("sample").orderBy(F.desc("pos"))))
    lines = noise.select("sample", "pos", F.lit(1).alias("kind"), "sentence").unionByName(hidden.join(places, ["sample", "place"]).select("sample", "pos", F.lit(0).alias("kind"), "sentence"))
    context = lines.groupBy("sample").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "kind", "sentence"))), lambda x: x["sentence"]), "\n").alias("context"))
    asked = Window.partitionBy("sample").orderBy(shuffled(_name(s, "query", F.col("k")), seed), "k")
    picked = named.withColumn("q", F.row_number().over(asked)).where(F.col("q") <= queries)
    answers = hidden.join(picked.select("sample", "k", "q"), ["sample", "k"]).groupBy("sample").agg(F.transform(F.sort_array(F.collect_list(F.struct("q", "v", "value"))), lambda x: x["value"]).alias("outputs"))
    query = picked.groupBy("sample").agg(F.transform(F.sort_array(F.collect_list(F.struct("q", "key"))), lambda x: x["key"]).alias("names"))
    listed = F.col("names")[0] if queries == 1 else F.concat(F.array_join(F.slice("names", 1, queries - 1), ", "), F.lit(", and "), F.col("names")[queries - 1])
    one = queries * values == 1
    text = fill_template(F.lit(singular(HIDDEN) if one else HIDDEN), {"kind": F.lit(value_kind[:-1] if one else value_kind), "query": F.col("query"), "context": F.col("context")})
    return context.join(query.withColumn("query", listed), "sample").join(answers, "sample").select("sample", text.alias("input"), "outputs")


def common_prompts(words: DataFrame, common: int = 10, frequent: int = 30, rare: int = 3, seed: int = 42) -> DataFrame:
    """(sample, input, outputs) from distinct (sample, word): a shuffled numbered list; the answers are the common words.

    Contexts below 4096 tokens take ``frequent`` 6 and ``rare`` 1.
    """
    s = F.col("sample")
    top = F.row_number().over(Window.partitionBy("sample").orderBy(shuffled(_name(s, F.col("word")), seed), "word"))
    rows = words.select("sample", "word", top.alias("n"))
    copies = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(F.col("n") <= common, frequent).otherwise(rare))))
    place = shuffled(_name(s, F.col("word"), F.col("copy")), seed)
    listed = F.transform(F.sort_array(F.collect_list(F.struct(place.alias("p"), "word"))), lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x["word"]))
    context = copies.groupBy("sample").agg(F.array_join(listed, " ").alias("context"))
    answers = rows.where(F.col("n") <= common).groupBy("sample").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "word"))), lambda x: x["word"]).alias("outputs"))
    return context.join(answers, "sample").select("sample", fill_template(F.lit(COMMON), {"context": F.col("context")}).alias("input"), "outputs")


def coded_prompts(samples: DataFrame, total: int, alpha: float, vocabulary: int, zeta: float, letters: int = 6, seed: int = 42) -> DataFrame:
    """(sample, input, outputs) from (sample): zeta-distributed coded words, the most frequent one noise dots; the answers are ranks 2 to 4."""
    s, k = F.col("sample"), F.col("rank").cast("double")
    rows = samples.select("sample", F.explode(F.sequence(F.lit(1), F.lit(vocabulary))).alias("rank"))
    word = F.translate(F.substring(shuffled(_name(s, "word", F.col("rank")), seed), 1, letters), "0123456789", "ghijklmnop")
    rows = rows.withColumn("word", F.when(F.col("rank") == 1, "...").otherwise(word)).withColumn("n", F.floor(F.lit(float(total)) * F.pow(k, F.lit(-alpha)) / F.lit(zeta)).cast("int"))
    copies = rows.where("n > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n"))))
    place = shuffled(_name(s, F.col("rank"), F.col("copy")), seed)
    context = copies.groupBy("sample").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(place.alias("p"), "word"))), lambda x: x["word"]), " ").alias("context"))
    answers = rows.where("rank between 2 and 4").groupBy("sample").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "word"))), lambda x: x["word"]).alias("outputs"))
    return context.join(answers, "sample").select("sample", fill_template(F.lit(CODED), {"context": F.col("context")}).alias("input"), "outputs")


def question_prompts(questions: DataFrame, placed: DataFrame, docs: DataFrame) -> DataFrame:
    """(q, input) from (q, query), (q, place, doc_idx) and (doc_idx, text): documents numbered in order of their places."""
    rows = placed.join(docs, "doc_idx").select("q", F.struct("place", "text").alias("d"))
    listed = F.transform(F.sort_array(F.collect_list("d")), lambda x, i: F.concat(F.lit("Document "), (i + 1).cast("string"), F.lit(":\n"), x["text"]))
    context = rows.groupBy("q").agg(F.array_join(listed, "\n\n").alias("context"))
    return context.join(questions, "q").select("q", fill_template(F.lit(QUESTION), {"query": F.col("query"), "context": F.col("context")}).alias("input"))


def tracking_prompts(samples: DataFrame, noises: int, chains: int = 1, hops: int = 4, seed: int = 42) -> DataFrame:
    """(sample, input, outputs) from (sample): chains of assignments among ``noises`` noise lines; the answers are chain 0's variables.

    A chain's lines stand in order at distinct places. With no more noise lines than a chain has, the noise is cut into
    its sentences; if they are still too few, chains end early and the answers are the variables that stand in the text.
    """
    s, need = F.col("sample"), chains * (hops + 1)
    units = [NOISE + "\n"] * noises
    if noises <= hops + 1:
        units = [x + "." if x.strip() else x for unit in units for x in unit.split(".")]
    lines = min(hops + 1, len(units) - 1)
    if lines < 1:
        raise ValueError("no noise to hide a chain in")
    many = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # distinct names: each hashed name at its first draw, the first ones of eight more than are needed
    named = samples.select("sample", many(need + 8).alias("i"))
    name = F.translate(F.substring(shuffled(_name(s, "variable", F.col("i")), seed), 1, 5), "0123456789abcdef", "ABCDEFGHIJKLMNOP")
    named = named.groupBy("sample", name.alias("var")).agg(F.min("i").alias("i"))
    named = named.select("sample", "var", (F.row_number().over(Window.partitionBy("sample").orderBy("i")) - 1).alias("n")).where(F.col("n") < need)
    named = named.select("sample", "var", F.floor(F.col("n") / (hops + 1)).cast("int").alias("chain"), (F.col("n") % (hops + 1)).alias("hop"))
    value = seeded_number(_name(s, "start", F.col("chain")), seed, 5).cast("string")
    before = F.lag("var").over(Window.partitionBy("sample", "chain").orderBy("hop"))
    line = F.when(F.col("hop") == 0, F.concat(F.lit("VAR "), "var", F.lit(" = "), value)).otherwise(F.concat(F.lit("VAR "), "var", F.lit(" = VAR "), before, F.lit(" ")))
    named = named.withColumns({"value": value, "line": line}).where(F.col("hop") < lines)
    drawn = Window.partitionBy("sample", "chain").orderBy(shuffled(_name(s, "at", F.col("chain"), F.col("pos")), seed), "pos")
    places = samples.select("sample", many(chains).alias("chain")).withColumn("pos", many(len(units)))
    places = places.withColumn("n", F.row_number().over(drawn)).where(F.col("n") <= lines)
    places = places.select("sample", "chain", "pos", (F.row_number().over(Window.partitionBy("sample", "chain").orderBy("pos")) - 1).alias("hop"))
    noise = F.array(*(F.lit(u) for u in units))
    rows = samples.select("sample", F.posexplode(noise).alias("pos", "line")).select("sample", "pos", F.lit(chains).alias("chain"), F.lit(0).alias("hop"), "line")
    rows = rows.unionByName(named.join(places, ["sample", "chain", "hop"]).select("sample", "pos", "chain", "hop", "line"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "chain", "hop", "line"))), lambda x: x["line"]), " ")
    context = rows.groupBy("sample").agg(F.replace(joined, F.lit(". \n"), F.lit(".\n")).alias("context"))
    first = named.where("chain = 0").groupBy("sample").agg(F.first("value").alias("query"), F.transform(F.sort_array(F.collect_list(F.struct("hop", "var"))), lambda x: x["var"]).alias("outputs"))
    return context.join(first, "sample").select("sample", fill_template(F.lit(TRACK), {"query": F.col("query"), "context": F.col("context")}).alias("input"), "outputs")
