"""Queries on token stores, budgets, windows, set operations and selections."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import arrays, text
from lodestone.functions.permutations import place_sql
from lodestone.operators import bpe, evaluation, selection, tokens
from lodestone.plans.corpus import PIECES_SQL
from lodestone.plans.registry import Registry
from lodestone.session import dealt, remove_table, shared_folder, shared_table
from lodestone.tables import table

R = Registry()
_N = "len(string_split(text, ' '))"


def _store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths of words as tokens."""
    return table(spark, sf_dir, "documents").select("doc_id", "source", F.transform(F.split("text", " "), F.length).alias("tokens")).withColumn("n", F.size("tokens").cast("long"))


@R.query(f"SELECT doc_id, n, (coalesce(sum(n) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS start FROM (SELECT doc_id, {_N} AS n FROM documents)")
def ragged_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.running_start(_store(spark, sf_dir).select("doc_id", "n"), "doc_id", "n").select("doc_id", "n", "start")


@R.query(f"SELECT doc_id FROM (SELECT doc_id, coalesce(sum(n) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM (SELECT doc_id, source, {_N} AS n FROM documents)) WHERE b <= 3000")
def token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_budget(_store(spark, sf_dir), F.lit(3000), ["doc_id"], "n", ["source"]).select("doc_id")


@R.query(f"""SELECT doc_id, source FROM (SELECT doc_id, source, coalesce(sum(n) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b
FROM (SELECT doc_id, source, {_N} AS n FROM documents)) WHERE b <= CASE source WHEN 'src1' THEN 1000 WHEN 'src2' THEN 4000 ELSE -1 END""")
def source_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    budgets = spark.createDataFrame([("src1", 1000), ("src2", 4000)], "source string, budget long")
    return tokens.mixture(_store(spark, sf_dir), budgets, "source", ["doc_id"], "n").select("doc_id", "source")


_FLAT = f"WITH t AS (SELECT doc_id, list_transform(string_split(text, ' '), lambda x: length(x)) AS tok FROM documents), s AS (SELECT unnest(tok) AS token, doc_id, generate_subscripts(tok, 1) AS i FROM t), p AS (SELECT token::INTEGER AS token, doc_id, i, row_number() OVER (ORDER BY doc_id, i) - 1 AS pos FROM s)"


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.running_start(_store(spark, sf_dir), "doc_id", "n")


@R.query(_FLAT + " SELECT pos // 129 AS block, string_agg(token, ',' ORDER BY pos) AS tokens FROM p GROUP BY 1 HAVING count(*) = 129")
def token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.blocks(_placed(spark, sf_dir), 129).select("block", F.array_join("tokens", ",").alias("tokens"))


@R.query(_FLAT + """, n AS (SELECT count(*) AS total FROM p), b AS (SELECT pos // 129 AS block, list(token ORDER BY pos) AS t FROM p GROUP BY 1 HAVING count(*) = 129)
SELECT block // 8 AS batch, block % 8 AS row, array_to_string(t[1:128], ',') AS input, array_to_string(t[2:129], ',') AS target FROM b, n WHERE (block // 8) * 8 * 129 < total - 128 - 8 * 129""")
def sequential_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = _store(spark, sf_dir).agg(F.sum("n")).scalar()
    windows = tokens.blocks(_placed(spark, sf_dir), 129)
    return tokens.sequential_batches(windows, 128, 8, total).select("batch", "row", F.array_join("input", ",").alias("input"), F.array_join("target", ",").alias("target"))


@R.query(_FLAT + " SELECT pos, token, lead(token) OVER (PARTITION BY doc_id ORDER BY i) AS target FROM p")
def next_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.next_tokens(_placed(spark, sf_dir)).select("pos", "token", "target")


@R.query(f"""WITH d AS (SELECT doc_id, {_N} AS n FROM documents), e AS (SELECT doc_id, n, sum(n) OVER (ORDER BY doc_id) AS e FROM d), v AS (SELECT coalesce(max(e), 0) AS v FROM e WHERE e <= 20000)
SELECT doc_id, CASE WHEN e <= v THEN 'val' ELSE 'train' END AS part, (CASE WHEN e <= v THEN e - n ELSE e - n - v END)::BIGINT AS start FROM e, v""")
def validation_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.validation_split(_store(spark, sf_dir).select("doc_id", "n"), "doc_id", "n", 20000).select("doc_id", "part", "start")


@R.query(f"""WITH m AS (SELECT doc_id, n, coalesce(sum(n) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM (SELECT doc_id, {_N} AS n FROM documents)),
q AS (SELECT o_orderkey, (o_orderkey * 37) % (SELECT sum(n)::BIGINT FROM m) AS pos FROM orders)
SELECT o_orderkey, pos, doc_id AS file, (pos - s)::BIGINT AS local FROM q JOIN m ON pos >= s AND pos < s + n""")
def locate_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = tokens.running_start(_store(spark, sf_dir).select(F.col("doc_id").alias("file"), F.col("n").alias("n_tokens")), "file", "n_tokens")
    total = manifest.agg(F.sum("n_tokens")).scalar()
    starts = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") * 37 % total).alias("pos"))
    return tokens.locate(starts, manifest).select("o_orderkey", "pos", "file", "local")


_SPANS = _FLAT + """, x AS (SELECT *, sum(CASE WHEN token IN (3, 4) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM p),
y AS (SELECT doc_id, g, list(token ORDER BY i) AS t, count(*) AS n FROM x GROUP BY 1, 2 HAVING count(*) > 1), m AS (SELECT floor(quantile_cont(n, 0.99))::INTEGER AS most FROM y)"""


@R.query(_SPANS + " SELECT array_to_string(t[1:most], ',') AS tokens, count(*) AS cnt FROM y, m GROUP BY 1")
def boundary_spans_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.boundary_spans(_store(spark, sf_dir), [3, 4], -1, most_percent=99).select(F.array_join("tokens", ",").alias("tokens"), "cnt")


_STARTS = "q AS (SELECT i AS sample, ('0x' || substr(md5('7:' || i), 1, 15))::BIGINT % greatest(1, (SELECT count(*) FROM p) - 64) AS first FROM range(100) t(i))"


@R.query(_FLAT + f", {_STARTS} SELECT sample, first AS pos, string_agg(token, ',' ORDER BY p.pos) AS tokens FROM q JOIN p ON p.pos BETWEEN first AND first + 64 GROUP BY sample, first")
def random_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = _placed(spark, sf_dir)
    total = placed.agg(F.sum("n")).first()[0]
    return tokens.random_windows(placed, total, 64, 100, 7).select("sample", "pos", F.array_join("tokens", ",").alias("tokens"))


@R.query(_FLAT + """, x AS (SELECT doc_id, token AS l, lead(token) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM p)
SELECT l AS left, r AS right, count(*) AS cnt FROM x WHERE r IS NOT NULL GROUP BY 1, 2""")
def pair_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.pair_counts(_store(spark, sf_dir).select(F.col("tokens").alias("ids"), F.lit(1).cast("long").alias("cnt")))


@R.query(_FLAT + """, x AS (SELECT doc_id, token AS l, lead(token) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM p)
SELECT l AS left, r AS right, count(*) AS cnt FROM x WHERE r IS NOT NULL GROUP BY 1, 2 ORDER BY cnt DESC, l::VARCHAR || r DESC, l DESC, r DESC LIMIT 1""")
def most_frequent_pair_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As most_frequent_pair, by the other rule for ties: the greater of the joined tokens."""
    counts = tokens.pair_counts(_store(spark, sf_dir).select(F.col("tokens").alias("ids"), F.lit(1).cast("long").alias("cnt")))
    return counts.orderBy(F.desc("cnt"), F.desc(F.concat(F.col("left").cast("string"), F.col("right").cast("string"))), F.desc("left"), F.desc("right")).limit(1)


@R.query(_FLAT + """, x AS (SELECT doc_id, token AS l, lead(token) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM p)
SELECT l AS left, r AS right, count(*) AS cnt FROM x WHERE r IS NOT NULL GROUP BY 1, 2 ORDER BY cnt DESC, l DESC, r DESC LIMIT 1""")
def most_frequent_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = tokens.pair_counts(_store(spark, sf_dir).select(F.col("tokens").alias("ids"), F.lit(1).cast("long").alias("cnt")))
    return counts.orderBy(F.desc("cnt"), F.desc("left"), F.desc("right")).limit(1)


@R.query(f"SELECT round(avg(strlen(text) / {_N}), 6) AS bytes_per_token FROM (SELECT text FROM documents ORDER BY doc_id LIMIT 100)")
def compression_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("n", F.size(F.split("text", " ")))
    return tokens.compression_ratio(docs, "text", "n").select(F.round("bytes_per_token", 6).alias("bytes_per_token"))


@R.query("SELECT doc_id, md5(text) AS h FROM documents")
def bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    vocabulary = bpe.train_on(docs, 200)
    return bpe.decode(bpe.encode(docs, vocabulary), vocabulary).select("doc_id", F.md5(F.col("text").cast("binary")).alias("h"))


def merging_sql(name: str, start: str, n: int) -> str:
    """A recursive table of words, written <token><token>.. in hexadecimal digits, with one more merge at each step: the most frequent pair, the greatest of equals."""
    return f"""{name} AS (SELECT 0 AS step, word, s, cnt, '' AS l, '' AS r FROM ({start})
UNION ALL SELECT step + 1, word, replace(s, '<' || b.l || '><' || b.r || '>', '<' || b.l || b.r || '>'), cnt, b.l, b.r FROM {name},
(SELECT l, r FROM (SELECT t[i] AS l, t[i + 1] AS r, cnt FROM (SELECT t, cnt, unnest(range(1, len(t))) AS i FROM (SELECT string_split(s[2:len(s) - 1], '><') AS t, cnt FROM {name})))
GROUP BY l, r ORDER BY sum(cnt) DESC, l DESC, r DESC LIMIT 1) b WHERE step < {n})"""


WORDS_SQL = f"""SELECT pretoken AS word, regexp_replace(lower(hex(encode(pretoken))), '(..)', '<\\1>', 'g') AS s, count(*) AS cnt
FROM (SELECT unnest({PIECES_SQL}) AS pretoken FROM documents) GROUP BY pretoken"""
_BPE = "WITH RECURSIVE " + merging_sql("w", WORDS_SQL, 100)
_STORE_SQL = f"""x AS (SELECT doc_id, unnest(p) AS word, generate_subscripts(p, 1) AS i FROM (SELECT doc_id, {PIECES_SQL} AS p FROM documents)),
e AS (SELECT word, s FROM w WHERE step = (SELECT max(step) FROM w))"""


@R.query(_BPE + " SELECT DISTINCT step - 1 AS rank, upper(l) AS left, upper(r) AS right FROM w WHERE step > 0")
def bpe_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = bpe.train_on(table(spark, sf_dir, "documents"), 100)
    return v.merge_table(spark).select("rank", F.hex("left").alias("left"), F.hex("right").alias("right"))


@R.query(_BPE + f""", {_STORE_SQL}, n AS (SELECT doc_id, sum(len(string_split(s, '><'))) AS n FROM x JOIN e USING (word) GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0)::INTEGER AS n_tokens FROM documents LEFT JOIN n USING (doc_id)""")
def bpe_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    v = bpe.train_on(docs, 100)
    return bpe.encode(docs, v).select("doc_id", F.size(arrays.checked_tokens(F.col("tokens"))).alias("n_tokens"))


_SPANS_SQL = """d AS (SELECT doc_id, string_agg(s, '' ORDER BY i) AS s FROM x JOIN e USING (word) GROUP BY doc_id),
parts AS (SELECT unnest(string_split(regexp_replace(s, '<((?:[0-9a-f][0-9a-f])*(?:2c|2e|3a)(?:[0-9a-f][0-9a-f])*)>', '|<\\1>', 'g'), '|')) AS s FROM d),
lists AS (SELECT string_split(s[2:len(s) - 1], '><') AS t FROM parts WHERE contains(s, '><')),
spans AS (SELECT '<' || array_to_string(t[1:(SELECT floor(quantile_cont(len(t), 0.99))::INTEGER FROM lists)], '><') || '>' AS word, count(*) AS cnt FROM lists GROUP BY 1)"""


@R.query(_BPE + f", {_STORE_SQL}, {_SPANS_SQL}, " + merging_sql("u", "SELECT word, word AS s, cnt FROM spans", 50) + """
SELECT DISTINCT step - 1 AS rank, upper(l) AS left, upper(r) AS right FROM w WHERE step > 0
UNION ALL SELECT DISTINCT step + (SELECT max(step) FROM w) - 1, upper(l), upper(r) FROM u WHERE step > 0""")
def resumed_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """100 merges within words; and, from the saved vocabulary, 50 over spans of tokens between points, commas and colons, cut to the 99th percentile of their lengths."""
    docs = dealt(table(spark, sf_dir, "documents"))
    saved = shared_folder(spark, "vocabulary")
    bpe.save(spark, bpe.train_on(docs, 100), saved)
    v = bpe.load(spark, saved)
    opens = [i for i, t in enumerate(v.tokens()) if set(t) & set(b".,:")]
    store = shared_table(bpe.encode(docs, v).select("tokens"), "tokens")
    more = bpe.resume(v, tokens.boundary_spans(store, opens, most_percent=99, counted=False), 50)
    remove_table(store)
    return more.merge_table(spark).select("rank", F.hex("left").alias("left"), F.hex("right").alias("right"))


@R.query(_FLAT + """, x AS (SELECT *, sum(CASE WHEN token IN (3, 4) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM p),
y AS (SELECT doc_id, g, string_agg(token, ',' ORDER BY i) AS tokens, count(*) AS n FROM x GROUP BY 1, 2) SELECT tokens, count(*) AS cnt FROM y WHERE n > 1 GROUP BY tokens""")
def boundary_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.boundary_spans(_store(spark, sf_dir), [3, 4], -1).select(F.array_join("tokens", ",").alias("tokens"), "cnt")


@R.query("SELECT doc_id, doc_id + 1 AS score FROM documents")
def attached_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results that come as a list beside the rows, in the rows' order and without their key."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    results = docs.select(F.col("doc_id").alias("at"), (F.col("doc_id") + 1).alias("score"))
    return selection.attached(docs, results, ["doc_id"], ["at"], ["score"])


@R.query("SELECT a.item_id, md5(b.text) AS h FROM (SELECT item_id, row_number() OVER (ORDER BY item_id) AS i FROM benchmark) a JOIN (SELECT text, row_number() OVER (ORDER BY item_id DESC) AS i FROM benchmark) b USING (i)")
def positional_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    right = b.select((-F.col("item_id")).alias("k"), F.md5(F.col("text").cast("binary")).alias("h"))
    return selection.attached(b.select("item_id"), right, ["item_id"], ["k"], ["h"])


@R.query("SELECT doc_id AS id, 'd' AS kind FROM documents UNION ALL SELECT item_id, 'b' FROM benchmark")
def concatenated(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit("d").alias("kind"))
    return d.unionByName(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.lit("b").alias("kind")))


@R.query("SELECT source FROM documents UNION SELECT lang FROM documents")
def union_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("source").union(d.select("lang")).distinct()


@R.query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def not_yet_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.sources.writers import resumed

    return resumed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id").select("doc_id")


@R.query("SELECT doc_id, row_number() OVER (ORDER BY doc_id DESC) - 1 AS idx FROM documents")
def dense_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", (-F.col("doc_id")).alias("k"))
    return selection.indexed(d, ["k"]).select("doc_id", "idx")


@R.query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents) WHERE i >= 10 AND i < 150 AND (i - 10) % 3 = 0")
def task_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.view(selection.indexed(table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"]), 10, 150, 3).select("doc_id")


@R.query("SELECT mode, doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, (count(*) OVER ()) AS n FROM documents), (VALUES ('strided'), ('ceil'), ('floor')) m(mode) WHERE CASE mode WHEN 'strided' THEN i % 7 = 2 WHEN 'ceil' THEN i // ((n + 6) // 7) = 2 ELSE i // (n // 7) = 2 END")
def shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = selection.indexed(table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"])
    n, out = d.count(), None
    for mode in ("strided", "ceil", "floor"):
        one = selection.shard(d, 7, 2, mode, n).select(F.lit(mode).alias("mode"), "doc_id")
        out = one if out is None else out.unionByName(one)
    return out


@R.query("SELECT 0 AS task, vec_id AS local FROM embeddings UNION ALL SELECT 1, item_id FROM benchmark")
def task_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("idx"))
    return selection.sequence([e, table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("idx"))]).select("task", "local")


def _values(rows: list[tuple]) -> str:
    return ", ".join(f"({', '.join(map(str, r))})" for r in rows)


#: Tables of expected places for tasks of these sizes: what the standard generator gives.
_SIZES = (20, 40, 50, 100, 400, 500)


def _shuffled_pairs(n: int) -> list[tuple[int, int]]:
    pairs = [(k, i) for k in range(2) for i in range(n)]
    random.Random(42).shuffle(pairs)
    return pairs


def _places(n: int) -> list[tuple[int, int, int]]:
    rows = list(range(n))
    random.Random(1337).shuffle(rows)
    return [(n, row, place) for place, row in enumerate(rows)]


def _sampled(n: int) -> list[tuple]:
    return [(n, i, "'" + ",".join(map(str, random.Random(1234 + i).sample([j for j in range(n) if j != i], 5))) + "'") for i in range(n)]


@R.query(f"SELECT task, local, place FROM (VALUES {_values([(n, k, i, p) for n in _SIZES for p, (k, i) in enumerate(_shuffled_pairs(n))])}) v(n, task, local, place) WHERE n = (SELECT count(*) FROM benchmark)")
def task_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = selection.indexed(table(spark, sf_dir, "benchmark").select("item_id"), ["item_id"]).select("idx")
    return selection.mixture([e, e], 42)


@R.query(f"SELECT item_id, place FROM (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS i, count(*) OVER () AS n FROM benchmark) JOIN (VALUES {_values([x for n in _SIZES for x in _places(n)])}) v(m, row, place) ON m = n AND row = i")
def seeded_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = selection.indexed(table(spark, sf_dir, "benchmark").select("item_id"), ["item_id"])
    return selection.shuffled(e, e.count(), 1337).select("item_id", "place")


@R.query(f"SELECT i AS idx, shots FROM (VALUES {_values([x for n in _SIZES for x in _sampled(n)])}) v(n, i, shots) WHERE n = (SELECT count(*) FROM benchmark)")
def few_shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = selection.indexed(table(spark, sf_dir, "benchmark"), ["item_id"])
    return selection.few_shots(e, e.count(), 5, ["item_id", "text"]).select("idx", F.array_join(F.transform("examples", lambda x: x["item_id"]), ",").alias("shots"))


@R.query("SELECT doc_id, md5('42:' || doc_id) AS place FROM documents ORDER BY place, doc_id LIMIT 50")
def hashed_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id")
    return selection.hash_shuffled(d, "doc_id", 42).orderBy("place", "doc_id").limit(50)


@R.query("WITH RECURSIVE r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS idx FROM documents), " + place_sql("SELECT idx, (SELECT count(*) FROM documents) AS n FROM r", 17)
         + " SELECT doc_id, y AS place FROM walk JOIN r USING (idx) WHERE round = 0 AND step > 0 AND y < n")
def permuted_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = selection.indexed(table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"])
    return selection.permuted(docs, docs.count(), 17).select("doc_id", "place")


@R.query("""WITH RECURSIVE r AS (SELECT 0 AS task, row_number() OVER (ORDER BY page_id) - 1 AS local FROM pages UNION ALL SELECT 1, row_number() OVER (ORDER BY s_suppkey) - 1 FROM supplier),
i AS (SELECT *, local + CASE task WHEN 0 THEN 0 ELSE (SELECT count(*) FROM pages) END AS idx FROM r), """ + place_sql("SELECT idx, (SELECT count(*) FROM r) AS n FROM i", 5)
         + " SELECT task, local, y AS place FROM walk JOIN i USING (idx) WHERE round = 0 AND step > 0 AND y < n")
def corpus_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = selection.indexed(table(spark, sf_dir, "pages").select("page_id"), ["page_id"]).select("idx")
    suppliers = selection.indexed(table(spark, sf_dir, "supplier").select("s_suppkey"), ["s_suppkey"]).select("idx")
    return selection.corpus_mixture([pages, suppliers], 5).select("task", "local", "place")


@R.query()
def facility_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.facility_location(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


@R.query(_FLAT + ", x AS (SELECT token AS t, round(count(*) / (SELECT count(*) FROM p), 12) AS prob FROM p GROUP BY 1), c AS (SELECT t, prob, sum(prob) OVER (ORDER BY prob DESC, t ROWS UNBOUNDED PRECEDING) AS c, row_number() OVER (ORDER BY prob DESC, t) AS r FROM x), k AS (SELECT * FROM c WHERE r = 1 OR c <= 0.6) SELECT t, round(prob / sum(prob) OVER (), 6) AS prob FROM k")
def nucleus(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = _store(spark, sf_dir).select(F.explode("tokens").alias("t"))
    total = stream.agg(F.count("*")).scalar()
    probs = stream.groupBy("t").agg(F.count("*").alias("n")).select(F.lit(0).alias("g"), "t", F.round(F.col("n") / total, 12).alias("prob"))
    return evaluation.nucleus(probs, ["g"], "t", 0.6).select("t", F.round("prob", 6).alias("prob"))


@R.query("SELECT doc_id, md5(regexp_replace(t, '^\\s+|\\s+$', '', 'g')) AS h FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN ' ' || chr(9) || text || chr(10) ELSE text || '   ' END AS t FROM documents)")
def stripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.when(F.col("doc_id") % 3 == 0, F.col("text")).when(F.col("doc_id") % 3 == 1, F.concat(F.lit(" \t"), "text", F.lit("\n"))).otherwise(F.concat("text", F.lit("   ")))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.strip(t).cast("binary")).alias("h"))
