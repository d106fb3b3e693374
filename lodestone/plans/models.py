"""Queries on question sets, scorers of every kind and checkpoints. Stand-ins for models are plain functions of the text, loaded as a model is."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import numbers, scorers
from lodestone.operators import bpe, bundles, conversations, evaluation, templates, tokens
from lodestone.plans.registry import Registry
from lodestone.plans.stores import WORDS_SQL, merging_sql
from lodestone.tables import table

R = Registry()


def _md5(c) -> F.Column:
    return F.md5(c.cast("binary"))


def _said(messages) -> F.Column:
    return _md5(F.array_join(F.transform(messages, lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|"))


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = templates.conversations(table(spark, sf_dir, "conversations"))
    rows = c.select(F.col("conv_id").alias("index"), "messages", F.concat(F.lit("out"), F.col("conv_id")).alias("output"), F.array(F.lit("aa"), F.concat(F.lit("g"), F.col("conv_id"))).alias("generated_outputs"))
    return templates.candidates(rows).join(rows.select("index", "messages"), "index")


_LAST = "WITH l AS (SELECT conv_id AS index, arg_max(text, turn) AS t FROM conversations GROUP BY conv_id), c AS (SELECT index, t, unnest(['out' || index, 'aa', 'g' || index]) AS c, unnest([0, 1, 2]) AS pos FROM l)"


@R.query(_LAST + " SELECT index, string_agg((length(t || chr(10) || chr(10) || c) % 11)::VARCHAR, ',' ORDER BY pos) AS reward FROM c GROUP BY index")
def reward_scorer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One number for each candidate, grouped back by prompt."""
    load = lambda: lambda texts: [float(len(t) % 11) for t in texts]
    each = _candidates(spark, sf_dir)
    each = each.withColumn("score", scorers.scored(templates.safety_text(F.col("messages"), F.col("candidate")), load, 16))
    lists = templates.regrouped(each, "score", name="reward")
    return lists.select("index", F.array_join(F.transform("reward", lambda x: x.cast("long").cast("string")), ",").alias("reward"))


@R.query(_LAST + " SELECT index, string_agg(CASE WHEN length(t || chr(10) || chr(10) || c) % 3 = 1 THEN 'harmful' ELSE 'safe' END, ',' ORDER BY pos) AS safety_class FROM c GROUP BY index")
def safety_scorer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two logits for each candidate; the greater names the class, the first of equal ones."""
    load = lambda: lambda texts: [[1.0, float(len(t) % 3) % 2 * 2] for t in texts]
    each = _candidates(spark, sf_dir)
    each = each.withColumn("label", scorers.safety_classes(templates.safety_text(F.col("messages"), F.col("candidate")), load))
    return templates.regrouped(each, "label", name="safety_class").select("index", F.array_join("safety_class", ",").alias("safety_class"))


@R.query("SELECT conv_id AS index, round(sum(length(text)) / count(*), 6) AS loss FROM conversations GROUP BY conv_id")
def sample_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean of the losses that a model gives to the tokens of a sample, here the lengths of its messages."""
    load = lambda: lambda texts: [[float(len(p)) for p in t.split("\x00")] for t in texts]
    c = templates.conversations(table(spark, sf_dir, "conversations"))
    losses = scorers.scored(F.array_join(F.transform("messages", lambda m: m["content"]), "\x00"), load, 64, None, "array<double>")
    mean = evaluation.shifted_masked_loss(F.col("l"), F.transform("l", lambda x: F.lit(1)))
    return c.select(F.col("conv_id").alias("index"), losses.alias("l")).select("index", F.round(mean, 6).alias("loss"))


@R.query("SELECT doc_id, round(a / sqrt(a * a + b * b + 1), 6) AS x, round(b / sqrt(a * a + b * b + 1), 6) AS y FROM (SELECT doc_id, (length(text) % 13)::DOUBLE AS a, (length(text) % 5)::DOUBLE AS b FROM documents)")
def embedding_scorer(spark: SparkSession, sf_dir: str) -> DataFrame:
    load = lambda: lambda texts: [[float(len(t) % 13), float(len(t) % 5), 1.0] for t in texts]
    e = table(spark, sf_dir, "documents").select("doc_id", scorers.embedded(F.col("text"), load).alias("e"))
    return e.select("doc_id", F.round(F.get("e", 0), 6).alias("x"), F.round(F.get("e", 1), 6).alias("y"))


@R.query("SELECT item_id, array_to_string(list_transform(range(8), lambda i: substr(text, 1, i + 1)), '|') AS completions FROM benchmark")
def sample_generator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight completions of each prompt, here its beginnings."""
    load = lambda: lambda texts: [[t[: i + 1] for i in range(8)] for t in texts]
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(scorers.generated(F.col("text"), load, 8), "|").alias("completions"))


@R.query("SELECT conv_id, md5('<|bos|>' || string_agg(CASE role WHEN 'user' THEN '<|user_start|>' || text || '<|user_end|>' WHEN 'assistant' THEN '<|assistant_start|>' || text || '<|assistant_end|>' ELSE '' END, '' ORDER BY turn) || '<|assistant_start|>') AS h FROM conversations GROUP BY conv_id")
def request_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = templates.conversations(table(spark, sf_dir, "conversations"))
    return c.select("conv_id", _md5(conversations.request_text(F.col("messages"))).alias("h"))


_MC = "'Multiple Choice question: ' || text || chr(10) || '- yes={0}' || chr(10) || '- no={1}' || chr(10) || '- so={2}' || chr(10){3} || chr(10) || 'Respond only with the letter of the correct answer.'"


@R.query(f"SELECT item_id, md5('user:' || {_MC.format('1', '2', '3', '')} || '|assistant:' || (item_id % 3 + 1)) AS h, item_id % 3 = 0 AS correct FROM benchmark")
def labelled_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions whose choices bring their own letters, and a response judged."""
    letters = F.array(*[F.lit(x) for x in "123"])
    m = conversations.labelled_choices(F.col("text"), F.array(F.lit("yes"), F.lit("no"), F.lit("so")), letters, (F.col("item_id") % 3 + 1).cast("string"))
    return table(spark, sf_dir, "benchmark").select("item_id", _said(m).alias("h"), conversations.letter_is_right(m, letters, F.lit("1")).alias("correct"))


_MC4 = _MC.format("A", "B", "C", " || '- or=D' || chr(10)")


@R.query(f"SELECT item_id, md5('user:' || {_MC4} || '|assistant:' || substr('ABCD', (item_id % 4 + 1)::INTEGER, 1)) AS h FROM benchmark")
def numbered_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = conversations.numbered_choices(F.col("text"), F.array(*[F.lit(x) for x in ("yes", "no", "so", "or")]), F.col("item_id") % 4)
    return table(spark, sf_dir, "benchmark").select("item_id", _said(m).alias("h"))


@R.query("""SELECT item_id, md5('user:q|assistant:' || '1' || chr(10) || '2*3' || chr(10) || '6' || chr(10) || '!|user:' || text || '|assistant:so ' || chr(10) || item_id || '+1' || chr(10) || (item_id + 1) || chr(10) || chr(10) || '#### ' || item_id) AS h,
(item_id = 7)::INTEGER AS correct FROM benchmark""")
def worked_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After one solved example; the calculator's calls become parts, and a response names a number."""
    k = F.col("item_id").cast("string")
    answer = F.concat(F.lit("so <<"), k, F.lit("+1="), (F.col("item_id") + 1).cast("string"), F.lit(">>\n#### "), k)
    m = conversations.worked_answer(F.col("text"), answer, [(F.lit("q"), F.lit("1<<2*3=6>>!"))])
    return table(spark, sf_dir, "benchmark").select("item_id", _said(m).alias("h"), conversations.worked_is_right(m, F.lit("I think #### 7")).alias("correct"))


@R.query("""SELECT item_id, md5('user:import a' || chr(10) || 'def f' || item_id || '():|assistant:import a' || chr(10) || 'def f' || item_id || '():' || chr(10) || ' return 1') AS h,
md5('import a' || chr(10) || chr(10) || 'y = ' || item_id || chr(10) || chr(10) || 'assert 1' || chr(10) || 'check(f' || item_id || ')') AS program FROM benchmark""")
def program_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversation of a program to be completed, and the text of the program that would judge a completion; it isn't run."""
    name = F.concat(F.lit("f"), F.col("item_id"))
    prompt = F.concat(F.lit("import a\ndef "), name, F.lit("():"))
    done = F.concat(F.lit("So:\n```python\ny = "), F.col("item_id"), F.lit("\n```"))
    run = conversations.program_to_run(prompt, done, F.lit("assert 1"), name)
    return table(spark, sf_dir, "benchmark").select("item_id", _said(conversations.program_task(prompt, F.lit(" return 1"))).alias("h"), _md5(run).alias("program"))


@R.query("""WITH r AS (SELECT o_custkey, o_orderkey, o_totalprice AS x, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS r FROM orders), s AS (SELECT o_custkey, min(o_orderkey) AS seen FROM orders WHERE o_custkey % 2 = 0 GROUP BY 1),
v AS (SELECT o_custkey, list(x ORDER BY o_orderkey) FILTER (seen IS NULL OR o_orderkey > seen) AS v, any_value(seen) AS seen, max(o_orderkey) AS last FROM r LEFT JOIN s USING (o_custkey) WHERE r <= 6 GROUP BY 1)
SELECT o_custkey, last AS o_orderkey, round(CASE WHEN seen IS NULL THEN list_reduce(v, lambda a, x: 0.8 * a + (1 - 0.8) * x) ELSE list_reduce(list_prepend(1000.0, coalesce(v, [])), lambda a, x: 0.8 * a + (1 - 0.8) * x) END, 4) AS ema FROM v""")
def resumed_ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the averages go on from a state at their first checkpoint."""
    o = table(spark, sf_dir, "orders")
    state = o.where("o_custkey % 2 = 0").groupBy("o_custkey").agg(F.min("o_orderkey").alias("o_orderkey")).withColumn("ema", F.lit(1000.0))
    return evaluation.resumed_ema(o, state, ["o_custkey"], "o_orderkey", "o_totalprice").select("o_custkey", "o_orderkey", F.round("ema", 4).alias("ema"))


@R.query("SELECT a.o_custkey, round(0.5 * a.p + 0.5 * b.p, 4) AS p FROM (SELECT o_custkey, max(o_totalprice) AS p FROM orders GROUP BY 1) a JOIN (SELECT o_custkey, min(o_totalprice) AS p FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) b USING (o_custkey)")
def two_way_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    left = o.groupBy("o_custkey").agg(F.max("o_totalprice").alias("p"))
    right = o.where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.min("o_totalprice").alias("p"))
    return evaluation.two_way_mean(left, right, ["o_custkey"], "p").select("o_custkey", F.round("p", 4).alias("p"))


@R.query("SELECT doc_id, source || '-' || upper(lang) || '/' || doc_id || '.txt' AS name, upper(lang) AS lang FROM documents")
def rendered_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nested field set by its dotted name, and a template of dotted names."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.struct("source", F.struct("lang").alias("inner")).alias("meta"))
    d = bundles.flattened(bundles.with_field(d, "meta.inner.lang", F.upper("meta.inner.lang")))
    fields = {c: F.col(f"`{c}`") for c in d.columns}
    return d.select("doc_id", bundles.rendered("{meta.source}-{meta.inner.lang}/{doc_id}.txt", fields).alias("name"), F.col("`meta.inner.lang`").alias("lang"))


@R.query("SELECT l_orderkey, bool_or(l_returnflag IN ('A', 'R')) AS hit FROM lineitem GROUP BY 1")
def extension_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a repository has a file of certain kinds."""
    files = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.concat(F.lit("a.b/f."), "l_returnflag")).alias("paths"))
    return files.select("l_orderkey", bundles.with_extension(F.col("paths"), (".A", ".R")).alias("hit"))


@R.query("SELECT item_id, n AS start, n + 1 + item_id % 3 AS last FROM (SELECT item_id, len(string_split(text, ' ')) AS n FROM benchmark)")
def continuation_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.split("text", " ")
    s = evaluation.continuation_span(w, F.concat(w, F.array_repeat(F.lit("x"), (F.col("item_id") % 3 + 1).cast("int"))))
    return table(spark, sf_dir, "benchmark").select("item_id", s["start"].cast("long").alias("start"), s["end"].cast("long").alias("last"))


@R.query("SELECT vec_id, vec_id % 3 < 2 AS close FROM embeddings")
def nested_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of numbers that are equal, all but equal, or different in one place."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    moved = F.when(F.col("vec_id") % 3 == 1, F.transform(v, lambda x: x * (1 + 1e-9))).when(F.col("vec_id") % 3 == 2, F.transform(v, lambda x, i: F.when(i == 9, x + 1).otherwise(x))).otherwise(v)
    return table(spark, sf_dir, "embeddings").select("vec_id", numbers.close_lists(v, moved).alias("close"))


@R.query("WITH RECURSIVE " + merging_sql("w", WORDS_SQL, 40) + " SELECT word AS pretoken, s AS naive, s AS encoded FROM w WHERE step = (SELECT max(step) FROM w)")
def naive_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens of each distinct pre-token, in hexadecimal digits: by every merge applied in order, and by rank."""
    docs = table(spark, sf_dir, "documents")
    v = bpe.train_on(docs, 40)
    shared = spark.sparkContext.broadcast(v)
    shown = lambda parts: "".join(f"<{p.hex()}>" for p in parts)

    def naive(words):
        return words.map(lambda w: shown(bpe.naive_encode(w.encode(), shared.value)))

    def encoded(words):
        rank = {p: i for i, p in enumerate(shared.value.merges)}
        return words.map(lambda w: shown(bpe.encode_word(w.encode(), rank)))

    by = lambda f: F.pandas_udf(f, "string")(F.col("pretoken"))
    return tokens.pretoken_counts(docs).select("pretoken", by(naive).alias("naive"), by(encoded).alias("encoded"))
