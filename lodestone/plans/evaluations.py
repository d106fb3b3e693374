"""Queries on evaluation scores. Orders, lines and customers stand in for samples, tests and tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import arrays, text
from lodestone.operators import evaluation, quantiles, templates
from lodestone.plans.registry import Registry
from lodestone.sources import writers
from lodestone.tables import table

R = Registry()


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("task"), (F.col("o_orderstatus") == "F").alias("correct"))


def _baselines(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("1-URGENT", 25.0), ("2-HIGH", 50.0), ("5-LOW", 0.0)], "task string, baseline double")


_ACC = "SELECT o_orderpriority AS task, avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END) AS accuracy, count(*) AS total FROM orders GROUP BY 1"
_CENTRED = f"SELECT task, accuracy, (accuracy - 0.01 * b) / (1 - 0.01 * b) AS centred FROM ({_ACC}) JOIN (VALUES ('1-URGENT', 25.0), ('2-HIGH', 50.0), ('5-LOW', 0.0)) v(t, b) ON t = task"


@R.query(f"SELECT task, round(accuracy, 6) AS accuracy, total FROM ({_ACC})")
def task_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.accuracy(_answers(spark, sf_dir), ["task"]).select("task", F.round("accuracy", 6).alias("accuracy"), "total")


@R.query(f"SELECT task, round(accuracy, 6) AS accuracy, round(centred, 6) AS centred FROM ({_CENTRED})")
def centred_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = evaluation.centred_scores(evaluation.accuracy(_answers(spark, sf_dir), ["task"]), _baselines(spark))
    return s.select("task", F.round("accuracy", 6).alias("accuracy"), F.round("centred", 6).alias("centred"))


@R.query(f"SELECT round(avg(centred), 6) AS core FROM ({_CENTRED})")
def core_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = evaluation.centred_scores(evaluation.accuracy(_answers(spark, sf_dir), ["task"]), _baselines(spark))
    return evaluation.macro_mean(s).select(F.round("core", 6).alias("core"))


@R.query(f"SELECT format('{{:<35}}, {{:<10}}, {{:<10}}', task, printf('%.6f', accuracy), printf('%.6f', centred)) AS value FROM ({_CENTRED})")
def score_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writers.report(evaluation.centred_scores(evaluation.accuracy(_answers(spark, sf_dir), ["task"]), _baselines(spark)))


_CHAT = "CASE c_custkey % 7 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(evaluation.CHAT_TASKS)) + " END"
_CHAT_BASE = "CASE t " + " ".join(f"WHEN '{t}' THEN {b}" for t, b in evaluation.CHAT_TASKS.items()) + " END"


@R.query(f"SELECT round(avg((a - b) / (1 - b)), 6) AS chat_core FROM (SELECT t, avg(CASE WHEN c_acctbal > 4000 THEN 1.0 ELSE 0.0 END) AS a, {_CHAT_BASE} AS b FROM (SELECT {_CHAT} AS t, c_acctbal FROM customer) GROUP BY t)")
def chat_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(t) for t in evaluation.CHAT_TASKS])
    rows = table(spark, sf_dir, "customer").select(F.get(names, (F.col("c_custkey") % 7).cast("int")).alias("task"), (F.col("c_acctbal") > 4000).alias("correct"))
    return evaluation.chat_core(evaluation.accuracy(rows, ["task"])).select(F.round("chat_core", 6).alias("chat_core"))


@R.query("SELECT o_custkey, bool_or(o_orderstatus = 'F') AS passed FROM orders GROUP BY o_custkey")
def any_of_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_custkey", (F.col("o_orderstatus") == "F").alias("correct"))
    return evaluation.any_of_k(rows, ["o_custkey"])


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = lambda c: F.when(c, "pass").otherwise("fail")
    return table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).cast("string").alias("task_id"), status(F.col("o_orderstatus") != "O").alias("base_status"), status(F.col("o_totalprice") > 150000).alias("plus_status"))


_TOTALS = "SELECT (o_custkey % 50)::VARCHAR AS task_id, count(*) AS n, count(*) FILTER (o_orderstatus <> 'O') AS base, count(*) FILTER (o_orderstatus <> 'O' AND o_totalprice > 150000) AS plus FROM orders GROUP BY 1"


@R.query(_TOTALS)
def task_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.task_totals(_results(spark, sf_dir))


def _pass_sql(c: str, k: int) -> str:
    return f"round(avg(CASE WHEN n - {c} < {k} THEN 1.0 WHEN {c} = 0 THEN 0.0 ELSE 1 - list_reduce(list_prepend(1.0, list_transform(range(n - {c} + 1, n + 1), lambda i: (1 - {k} / i)::DOUBLE)), lambda a, b: a * b) END), 6)"


@R.query(" UNION ALL ".join(f"SELECT {k} AS k, {_pass_sql('base', k)} AS base, {_pass_sql('plus', k)} AS plus FROM ({_TOTALS}) HAVING min(n) >= {k}" for k in (1, 10)))
def pass_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = evaluation.pass_rates(evaluation.task_totals(_results(spark, sf_dir)), (1, 10))
    return rates.select("k", F.round("base", 6).alias("base"), F.round("plus", 6).alias("plus"))


@R.query("SELECT 'T/' || o_orderkey AS task_id, o_orderkey FROM orders WHERE o_orderkey % 3 < 2")
def matched_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    mark = F.when(F.col("o_orderkey") % 2 == 0, "T/").otherwise("T_")
    samples = o.select(F.concat(mark, F.col("o_orderkey")).alias("task_id"), "o_orderkey")
    problems = o.where("o_orderkey % 3 < 2").select(F.concat(F.lit("T/"), F.col("o_orderkey")).alias("task_id"))
    return evaluation.matched_samples(samples, problems).select("task_id", "o_orderkey")


@R.query("SELECT vec_id, (list_position(e, list_min(e)) - 1)::INTEGER AS choice FROM (SELECT vec_id, embedding[1:4] AS e FROM embeddings)")
def least_loss_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", arrays.first_least(F.slice("embedding", 1, 4)).alias("choice"))


@R.query("SELECT vec_id, round(list_avg(list_transform(embedding[5:20], lambda x: x::DOUBLE)), 6) AS loss FROM embeddings")
def span_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.transform("embedding", lambda x: x.cast("double"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(evaluation.span_loss(e, F.lit(5), F.lit(21)), 6).alias("loss"))


@R.query("SELECT l_returnflag, round(avg(l_discount), 6) AS mean_loss, round(sum(l_discount * l_quantity) / sum(l_quantity) * 1.44269, 6) AS bits_per_byte FROM lineitem WHERE l_linenumber < 4 GROUP BY 1")
def bits_per_byte(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumn("mask", (F.col("l_linenumber") < 4).cast("int"))
    out = evaluation.bits_per_byte(rows, ["l_returnflag"], "l_discount", "l_quantity")
    return out.select("l_returnflag", F.round("mean_loss", 6).alias("mean_loss"), F.round("bits_per_byte", 6).alias("bits_per_byte"))


@R.query("SELECT vec_id, round(list_avg(list_transform(list_filter(generate_series(1, 64), lambda i: i % 3 <> 0), lambda i: embedding[i]::DOUBLE)), 6) AS loss FROM embeddings")
def masked_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = arrays.masked_labels(F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: (i % 3 != 0).cast("int")))
    e = F.transform("embedding", lambda x: x.cast("double"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(evaluation.shifted_masked_loss(e, labels), 6).alias("loss"))


@R.query("""WITH r AS (SELECT o_custkey, o_orderkey, o_totalprice AS x, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS r FROM orders),
v AS (SELECT o_custkey, list(x ORDER BY o_orderkey) AS v FROM r WHERE r <= 6 GROUP BY 1)
SELECT o_custkey, round(list_reduce(v, lambda a, x: 0.8 * a + (1 - 0.8) * x), 4) AS ema FROM v""")
def checkpoint_ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.ema(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderkey", "o_totalprice").select("o_custkey", F.round("ema", 4).alias("ema"))


@R.query("SELECT o_custkey, round(quantile_cont(o_totalprice, 0.99), 4) AS p99 FROM orders GROUP BY o_custkey")
def percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantiles.percentiles_by(table(spark, sf_dir, "orders"), ["o_custkey"], "o_totalprice", 0.99, "p99").select("o_custkey", F.round("p99", 4).alias("p99"))


@R.query("""SELECT l_returnflag, l_linestatus, round(quantile_cont(l_discount, 0.37), 6) AS p37 FROM lineitem GROUP BY ALL
UNION ALL SELECT '*', '*', round(quantile_cont(CASE WHEN l_linenumber <> 3 THEN l_extendedprice END, 0.905), 6) FROM lineitem""")
def tied_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of values that repeat much in a few large groups, and of a whole column with nulls."""
    rows = table(spark, sf_dir, "lineitem")
    groups = quantiles.percentiles_by(rows, ["l_returnflag", "l_linestatus"], "l_discount", 0.37, "p37").select("l_returnflag", "l_linestatus", F.round("p37", 6).alias("p37"))
    p = quantiles.percentile(rows.select(F.when(F.col("l_linenumber") != 3, F.col("l_extendedprice")).alias("x")), "x", 0.905)
    return groups.unionByName(spark.range(1).select(F.lit("*").alias("l_returnflag"), F.lit("*").alias("l_linestatus"), F.round(F.lit(p), 6).alias("p37")))


@R.query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS r FROM orders) WHERE r <= 2")
def last_checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderkey")))
    return table(spark, sf_dir, "orders").withColumn("r", r).where("r <= 2").select("o_custkey", "o_orderkey")


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    examples = F.array(F.struct(F.lit("q1").alias("query"), F.array(F.lit("a"), F.lit("b")).alias("choices"), F.lit(1).alias("gold")))
    return b.select("item_id", F.col("text").alias("query"), F.array(F.lit("yes"), F.lit("no"), F.lit("so")).alias("choices"), examples.alias("examples"))


@R.query("SELECT item_id, md5('q1 b' || chr(10) || chr(10) || text || ' yes|' || 'q1 b' || chr(10) || chr(10) || text || ' no|' || 'q1 b' || chr(10) || chr(10) || text || ' so') AS h FROM benchmark")
def choice_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = templates.choice_prompts(F.col("query"), F.col("choices"), F.col("examples"))
    return _items(spark, sf_dir).select("item_id", F.md5(F.array_join(p, "|").cast("binary")).alias("h"))


@R.query("SELECT item_id, md5('c2 z' || chr(10) || chr(10) || 'A ' || text || '|' || 'c2 z' || chr(10) || chr(10) || 'B ' || text) AS h FROM benchmark")
def schema_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    examples = F.array(F.struct(F.array(F.lit("c1"), F.lit("c2")).alias("context_options"), F.lit("z").alias("continuation"), F.lit(1).alias("gold")))
    p = templates.schema_prompts(F.array(F.lit("A"), F.lit("B")), F.col("text"), examples)
    return table(spark, sf_dir, "benchmark").select("item_id", F.md5(F.array_join(p, "|").cast("binary")).alias("h"))


@R.query("SELECT item_id, md5('ctx go' || chr(10) || chr(10) || trim(text) || '|' || 'ctx go' || chr(10) || chr(10) || trim(text) || ' end') AS h FROM benchmark")
def continuation_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    examples = F.array(F.struct(F.lit(" ctx ").alias("context"), F.lit("go").alias("continuation")))
    p = templates.continuation_prompts(F.col("text"), F.lit("end"), examples)
    return table(spark, sf_dir, "benchmark").select("item_id", F.md5(F.array_join(p, "|").cast("binary")).alias("h"))


@R.query("""SELECT item_id, md5('Multiple Choice question: ' || text || chr(10) || '- yes=A' || chr(10) || '- no=B' || chr(10) || '- so=C' || chr(10) || chr(10) || 'Respond only with the letter of the correct answer.') AS h FROM benchmark""")
def multiple_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    letters = F.array(*[F.lit(x) for x in "ABCD"])
    return _items(spark, sf_dir).select("item_id", F.md5(templates.multiple_choice(F.col("query"), letters, F.col("choices")).cast("binary")).alias("h"))


@R.query("SELECT item_id, n + 1 AS start, n + 2 AS last FROM (SELECT item_id, len(string_split(text, ' '))::INTEGER AS n FROM benchmark)")
def choice_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.split("text", " ")
    prompts = F.array(F.concat(w, F.array(F.lit("="), F.lit("yes"))), F.concat(w, F.array(F.lit("="), F.lit("no"))))
    spans = evaluation.choice_spans(prompts)
    return table(spark, sf_dir, "benchmark").select("item_id", F.get(spans, 0)["start"].alias("start"), F.get(spans, 0)["end"].alias("last"))


@R.query("SELECT item_id, 1 AS start, n + 1 AS last FROM (SELECT item_id, len(string_split(text, ' '))::INTEGER AS n FROM benchmark)")
def context_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.split("text", " ")
    spans = evaluation.context_spans(F.array(F.concat(F.array(F.lit("A.")), w), F.concat(F.array(F.lit("B.")), w)))
    return table(spark, sf_dir, "benchmark").select("item_id", F.get(spans, 0)["start"].alias("start"), F.get(spans, 0)["end"].alias("last"))


@R.query("SELECT item_id, least(n, 20) AS n, (n - 3 - greatest(0, n - 20))::INTEGER AS start FROM (SELECT item_id, len(string_split(text, ' '))::INTEGER AS n FROM benchmark)")
def cropped_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.split("text", " ")
    c = evaluation.cropped_spans(w, F.size(w) - 3, F.size(w), 20)
    return table(spark, sf_dir, "benchmark").select("item_id", F.size(c["tokens"]).alias("n"), c["start"].alias("start"))


@R.query("SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN replace(CASE WHEN conv_id % 3 = 0 THEN '1,' ELSE '' END || conv_id, ',', '') END AS answer, CASE WHEN turn % 2 = 0 THEN conv_id % 3 <> 0 ELSE true END AS correct FROM conversations")
def gsm_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    lead = F.when(F.col("conv_id") % 3 == 0, "1,").otherwise("")
    t = F.when(F.col("turn") % 2 == 0, F.concat(F.col("text"), F.lit("#### "), lead, F.col("conv_id"))).otherwise(F.col("text"))
    reference = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("#### "), F.col("conv_id"))).otherwise(F.lit(""))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.gsm_answer(t).alias("answer"), text.gsm_correct(reference, t).alias("correct"))
