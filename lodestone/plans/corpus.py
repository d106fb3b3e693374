"""Queries on documents and conversations: scans, filters, templates, pre-token counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import numbers, text
from lodestone.operators import filters, templates, tokens
from lodestone.plans.registry import Registry
from lodestone.session import shared_folder
from lodestone.streaming import streams
from lodestone.tables import table

R = Registry()
# DuckDB's engine has no lookahead; without that alternative the pieces differ only where white space is doubled
PIECES_SQL = "regexp_extract_all(text, '" + text.PRETOKEN.replace(r"|\s+(?!\S)", "").replace("'", "''") + "')"
# what stands in for a source's path and score: the tables have neither
PATHS = ("dclm-edu", "finemath", "cosmopedia-v2-textbook-7b", "stack_edu_375plus_20B", "finepdfs-edu", "pleias_synth", "all_chat", "other")
_PATH_SQL = "CASE doc_id % 8 " + " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(PATHS)) + " END"
_SCORE_SQL = "((n_chars % 500) / 100.0)"


def _path() -> Column:
    return F.get(F.array(*[F.lit(p) for p in PATHS]), F.col("doc_id") % 8)


def _score() -> Column:
    return (F.col("n_chars") % 500) / F.lit(100.0)


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").withColumns({"path": _path(), "score": _score()}).withColumns(
        {"metadata": F.struct(F.col("score").alias("edu_score"), F.array(F.col("score"), F.col("score") + 0.5).alias("fw_edu_scores"))}
    )


def _columns() -> dict[str, Column]:
    return {"score": F.col("score"), "edu_score": F.col("metadata.edu_score"), "page_scores": F.col("metadata.fw_edu_scores")}


@R.query("SELECT source, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY source")
def parquet_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@R.query(f"SELECT pretoken, count(*) AS cnt FROM (SELECT unnest({PIECES_SQL}) AS pretoken FROM documents) GROUP BY pretoken")
def pretoken_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.pretoken_counts(table(spark, sf_dir, "documents"))


@R.query(f"SELECT pretoken, count(*) AS cnt FROM (SELECT unnest({PIECES_SQL}) AS pretoken FROM documents) GROUP BY pretoken ORDER BY cnt DESC, pretoken LIMIT 200")
def pretoken_counts_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.top(tokens.pretoken_counts(table(spark, sf_dir, "documents")), 200)


@R.query(f"SELECT pretoken, count(*) AS cnt FROM (SELECT unnest({PIECES_SQL}) AS pretoken FROM documents) GROUP BY pretoken")
def pretoken_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counted batch by batch into a table, from which they are added up."""
    to = shared_folder(spark, "counts")
    streams.write_counts(streams.table_stream(spark, f"{sf_dir}/documents.parquet"), f"{to}/out", f"{to}/progress").awaitTermination()
    return streams.counts_so_far(spark, f"{to}/out")


@R.query(f"SELECT source, sum(len({PIECES_SQL}))::BIGINT AS n_tokens FROM documents GROUP BY source")
def pretokens_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.sum(F.size(text.pretokens(F.col("text")))).alias("n_tokens"))


def _stage_sql(stage: int) -> str:
    rules = []
    for part, (kind, limits) in filters.THRESHOLDS.items():
        if limits[stage - 1] is not None:
            rules.append(f"(p NOT LIKE '%{part}%' OR s > {limits[stage - 1]})")
    return f"SELECT doc_id, p AS path, round(s, 6) AS score FROM (SELECT doc_id, text, {_PATH_SQL} AS p, {_SCORE_SQL}::DOUBLE AS s FROM documents) WHERE {' AND '.join(rules)}"


@R.query(_stage_sql(1))
def source_thresholds_stage1(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _scored(spark, sf_dir)
    return filters.filter_sources(df, F.col("path"), 1, F.col("text"), _columns()).select("doc_id", "path", F.round("score", 6).alias("score"))


@R.query(_stage_sql(2))
def source_thresholds_stage2(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _scored(spark, sf_dir)
    return filters.filter_sources(df, F.col("path"), 2, F.col("text"), _columns()).select("doc_id", "path", F.round("score", 6).alias("score"))


@R.query(_stage_sql(3) + " AND (p = 'all_chat' OR length(text) > 4000)")
def source_thresholds_stage3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stage 3 has no rule of its own for dclm-edu, so its score isn't among the columns that rules read."""
    df = _scored(spark, sf_dir)
    columns = {k: v for k, v in _columns().items() if k != "edu_score"}
    return filters.filter_sources(df, F.col("path"), 3, F.col("text"), columns).select("doc_id", "path", F.round("score", 6).alias("score"))


@R.query(f"SELECT doc_id, round_even(greatest(0.0, least({_SCORE_SQL}::DOUBLE + 0.5, 5.0)), 0)::INTEGER AS int_score FROM documents WHERE round_even(greatest(0.0, least({_SCORE_SQL}::DOUBLE + 0.5, 5.0)), 0) >= 3")
def int_score_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("doc_id", numbers.int_score(F.col("score") + 0.5).alias("int_score")).where("int_score >= 3")


@R.query("SELECT doc_id, source FROM documents WHERE lang = 'en' AND source IN ('src1', 'src2', 'src3')")
def category_and_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where((F.col("lang") == "en") & F.col("source").isin("src1", "src2", "src3")).select("doc_id", "source")


@R.query("SELECT doc_id, source FROM (SELECT doc_id, source, count(*) OVER (PARTITION BY source) AS n, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS p FROM documents) WHERE p >= floor(n * 0.25) AND p < floor(n * 0.5)")
def head_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.head_fraction(table(spark, sf_dir, "documents"), ["doc_id"], 0.25, 0.5, ["source"]).select("doc_id", "source")


def _repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as repositories and their lines as files."""
    files = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct(F.concat(F.lit("f"), F.col("l_linenumber")).alias("path"), F.when(F.col("l_returnflag") == "N", "Python").otherwise("C").alias("language")).alias("f"))
    files = files.groupBy("l_orderkey").agg(F.collect_list("f").alias("files"))
    label = F.when(F.col("o_orderpriority").startswith("1"), "Python").when(F.col("o_orderpriority").startswith("2"), F.lit(None)).otherwise("C")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("repo_name"), label.alias("gha_language"), F.col("o_orderkey").alias("l_orderkey")).join(files, "l_orderkey")


@R.query("""
WITH f AS (SELECT l_orderkey, avg(CASE WHEN l_returnflag = 'N' THEN 1.0 ELSE 0.0 END) AS share FROM lineitem GROUP BY l_orderkey)
SELECT o_orderkey::VARCHAR AS repo_name FROM orders JOIN f ON l_orderkey = o_orderkey
WHERE o_orderpriority LIKE '1%' OR share > 0.75""")
def repos_in_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.repos_in_language(_repos(spark, sf_dir))


@R.query("SELECT l_orderkey::VARCHAR AS repo_name, round(avg(CASE WHEN l_returnflag = 'N' THEN 1.0 ELSE 0.0 END), 6) AS share FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey")
def language_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _repos(spark, sf_dir).select("repo_name", F.round(filters.language_share(F.col("files"), "Python"), 6).alias("share"))


@R.query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def semi_join_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").where("quality = 1")
    return table(spark, sf_dir, "documents").join(good, "doc_id", "left_semi").select("doc_id", "source")


@R.query("SELECT c_custkey, t, length(regexp_replace(t, '[^0-9a-fA-F]', '', 'g')) >= 0.9 * length(t) AS hexy FROM (SELECT c_custkey, md5(c_name) || left('zyxwvuts', (c_custkey % 8)::INTEGER) AS t FROM customer)")
def mostly_hex(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.concat(F.md5(F.col("c_name").cast("binary")), F.expr("left('zyxwvuts', cast(c_custkey % 8 as int))"))
    return table(spark, sf_dir, "customer").select("c_custkey", t.alias("t")).withColumn("hexy", text.mostly_hex(F.col("t")))


@R.query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND l_linenumber = o_orderkey % 4 + 1)")
def listed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("repo_name"), F.col("l_linenumber").cast("long").alias("path"), F.lit("print('x')").alias("text"))
    listing = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("repo_name"), (F.col("o_orderkey") % 4 + 1).alias("path"))
    return filters.listed_files(files, listing).select(F.col("repo_name").alias("l_orderkey"), F.col("path").cast("int").alias("l_linenumber"))


@R.query("""
WITH t AS (SELECT quantile_cont(o_totalprice, 0.3) AS t FROM orders)
SELECT o_orderkey, CASE WHEN o_totalprice < 0.95 * t THEN 0 ELSE 1 END AS band FROM orders, t
WHERE o_totalprice < 0.95 * t OR (o_totalprice > 1.5 * t AND o_totalprice < 1.75 * t)""")
def loss_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.loss_band(table(spark, sf_dir, "orders"), 0.3, "o_totalprice").select("o_orderkey", "band")


_TRUNCATED = """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1 AS f FROM conversations),
p AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place FROM r WHERE NOT (f AND role = 'system')),
k AS (SELECT *, place // 2 AS pair FROM p WHERE place % 2 = 0 OR role = 'assistant'),
s AS (SELECT *, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY pair RANGE UNBOUNDED PRECEDING) AS spent FROM k),
w AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY place DESC) AS last FROM s WHERE spent <= 1500)
SELECT conv_id, turn, role FROM w WHERE NOT (last = 1 AND role = 'assistant')"""


@R.query(_TRUNCATED)
def truncated_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.truncated_turns(table(spark, sf_dir, "conversations"), 1500).select("conv_id", "turn", "role")


@R.query("SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id HAVING sum(length(text)) < 2000")
def message_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = templates.conversations(table(spark, sf_dir, "conversations"))
    return c.where(filters.within_budget(F.col("messages"), 2000)).select("conv_id", F.size("messages").cast("long").alias("n"))


@R.query("""
SELECT conv_id, concat_ws(',', CASE WHEN min(length(text)) = 0 THEN 'empty_message' END, CASE WHEN max(length(text)) > 4000 THEN 'message_chars' END, CASE WHEN sum(length(text)) > 8000 THEN 'total_chars' END,
  CASE WHEN bool_or(role NOT IN ('user', 'assistant')) THEN 'role' END, CASE WHEN conv_id % 5 > 2 THEN 'temperature' END,
  CASE WHEN conv_id % 7 = 0 THEN 'top_k' END, CASE WHEN (conv_id % 11) * 500 NOT BETWEEN 1 AND 2048 THEN 'max_tokens' END) AS faults
FROM (SELECT conv_id, role, CASE WHEN conv_id % 9 = 4 AND turn = 1 THEN '' ELSE text END AS text FROM conversations) GROUP BY conv_id""")
def request_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all conversations, some with a message emptied."""
    rows = table(spark, sf_dir, "conversations")
    c = templates.conversations(rows.withColumn("text", F.when((F.col("conv_id") % 9 == 4) & (F.col("turn") == 1), "").otherwise(F.col("text"))))
    faults = filters.request_faults(F.col("messages"), (F.col("conv_id") % 5).cast("double"), (F.col("conv_id") % 7).cast("int"), (F.col("conv_id") % 11 * 500).cast("int"))
    return c.select("conv_id", F.array_join(faults, ",").alias("faults"))


_THINK_SQL = "CASE WHEN doc_id % 3 = 0 THEN left(text, 20) || chr(10) || '<think>' || substring(text, 21) ELSE text END"


def _thinking(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.when(F.col("doc_id") % 3 == 0, F.concat(F.substring("text", 1, 20), F.lit("\n<think>"), F.expr("substring(text, 21)"))).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").withColumn("t", t)


@R.query("SELECT doc_id, md5(text || '<|endoftext|>') AS h FROM documents")
def training_text_stage1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(templates.training_text(F.col("text"), 1).cast("binary")).alias("h"))


_STAGE3 = """CASE WHEN instr(t, chr(10) || '<think>') > 0 THEN '<|bos|><|user_start|>' || left(t, instr(t, chr(10) || '<think>') - 1) || '<|user_end|><|assistant_start|>'
 || substring(t, instr(t, chr(10) || '<think>')) || '<|assistant_end|><|endoftext|>' ELSE '<|bos|>' || t || '<|endoftext|>' END"""


@R.query(f"SELECT doc_id, md5({_STAGE3}) AS h FROM (SELECT doc_id, {_THINK_SQL} AS t FROM documents)")
def training_text_stage3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _thinking(spark, sf_dir).select("doc_id", F.md5(templates.training_text(F.col("t"), 3).cast("binary")).alias("h"))


@R.query(f"SELECT doc_id, md5(CASE WHEN {_PATH_SQL} = 'all_chat' THEN text ELSE text || '<|endoftext|>' END) AS h FROM documents")
def training_text_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(templates.training_text_by_path(F.col("text"), _path(), 1).cast("binary")).alias("h"))


@R.query("SELECT doc_id, md5(source || chr(10) || '<think>' || lang || '</think>' || chr(10) || text) AS h FROM documents")
def reasoning_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(templates.reasoning_text(F.col("source"), F.col("lang"), F.col("text")).cast("binary")).alias("h"))


_CHAT = """
WITH m AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i,
  sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS u FROM conversations),
s AS (SELECT conv_id, text AS sys FROM m WHERE i = 1 AND role = 'system'),
x AS (SELECT m.conv_id, turn, CASE WHEN role = 'user' AND u = 1 AND coalesce(sys, '') <> '' THEN '<|user_start|>' || sys || chr(10) || chr(10) || text || '<|user_end|>'
  WHEN role = 'user' THEN '<|user_start|>' || text || '<|user_end|>' WHEN role = 'assistant' THEN '<|assistant_start|>' || text || '<|assistant_end|>' ELSE '' END AS said
  FROM m LEFT JOIN s ON m.conv_id = s.conv_id)
"""


@R.query(_CHAT + "SELECT conv_id, md5('<|bos|>' || string_agg(said, '' ORDER BY turn) || '<|endoftext|>') AS h FROM x GROUP BY conv_id")
def chat_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = templates.conversations(table(spark, sf_dir, "conversations"))
    return c.select("conv_id", F.md5(templates.chat_text(F.col("messages")).cast("binary")).alias("h"))


@R.query(_CHAT + "SELECT conv_id, md5('<|bos|>' || string_agg(said, '' ORDER BY turn) || '<|assistant_start|>') AS h FROM x GROUP BY conv_id")
def chat_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = templates.conversations(table(spark, sf_dir, "conversations"))
    return c.select("conv_id", F.md5(templates.chat_text(F.col("messages"), generation=True).cast("binary")).alias("h"))


def _sft(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = templates.conversations(table(spark, sf_dir, "conversations"))
    return c.select(F.col("conv_id").alias("index"), "messages", F.concat(F.lit("out"), F.col("conv_id")).alias("output"), F.array(F.lit("aa"), F.concat(F.lit("g"), F.col("conv_id"))).alias("generated_outputs"))


@R.query("SELECT DISTINCT conv_id AS index, concat_ws(',', length('out' || conv_id), 2, length('g' || conv_id)) AS reward FROM conversations")
def candidate_rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = templates.candidates(_sft(spark, sf_dir))
    lists = templates.regrouped(each.withColumn("score", F.length("candidate")), "score", name="reward")
    return lists.select("index", F.array_join(F.transform("reward", lambda x: x.cast("string")), ",").alias("reward"))


@R.query("WITH l AS (SELECT conv_id, arg_max(text, turn) AS t FROM conversations GROUP BY conv_id) SELECT conv_id AS index, md5(t || chr(10) || chr(10) || 'out' || conv_id) AS h FROM l")
def safety_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sft(spark, sf_dir).select("index", F.md5(templates.safety_text(F.col("messages"), F.col("output")).cast("binary")).alias("h"))


@R.query("SELECT conv_id AS index, md5(string_agg(text, chr(10) ORDER BY turn) || chr(10) || 'out' || conv_id) AS h FROM conversations GROUP BY conv_id")
def embedding_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sft(spark, sf_dir).select("index", F.md5(templates.embedding_text(F.col("messages"), F.col("output")).cast("binary")).alias("h"))


@R.query("SELECT conv_id AS index, count(*) + 1 AS n, 'out' || conv_id AS last FROM conversations GROUP BY conv_id")
def with_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = templates.with_answer(F.col("messages"), F.col("output"))
    return _sft(spark, sf_dir).select("index", F.size(m).cast("long").alias("n"), F.element_at(m, -1)["content"].alias("last"))


@R.query("SELECT doc_id, md5(array_to_string(list_filter([text, source, lang], lambda x: x <> ''), '|')) AS h FROM documents")
def split_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.concat(F.col("text"), F.lit("<|endoftext|>"), F.col("source"), F.lit("<|user_start|>"), F.col("lang"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(F.array_join(text.without_marks(t), "|").cast("binary")).alias("h"))


@R.query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = streams.table_stream(spark, f"{sf_dir}/events.parquet")
    if dict(events.dtypes)["ts"] == "timestamp_ntz":
        events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    to = shared_folder(spark, "windows")
    streams.write_windows(events, f"{to}/out", f"{to}/progress").awaitTermination()
    return streams.windows_so_far(spark, f"{to}/out").select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))
