"""Queries on functions of strings, arrays and numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import arrays, numbers, text
from lodestone.plans.registry import Registry
from lodestone.sources.writers import as_json
from lodestone.tables import table

R = Registry()
_D = "list_transform(embedding, lambda x: x::DOUBLE)"


def _joined(v, digits: int):
    """A list of numbers as text, in units of the last digit, so that engines print it alike."""
    return F.array_join(F.transform(v, lambda x: F.round(x * 10**digits).cast("long").cast("string")), ",")


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))


@R.query(f"SELECT vec_id, round(sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS norm, round(list_sum(list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y))))), 5) AS total FROM (SELECT vec_id, {_D} AS v FROM embeddings)")
def normalised_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("v")
    return _vectors(spark, sf_dir).select("vec_id", F.round(arrays.l2_norm(v), 6).alias("norm"), F.round(arrays.total(arrays.normalised(v)), 5).alias("total"))


@R.query(f"SELECT a.vec_id, round(list_cosine_similarity(a.v, b.v), 6) AS cos FROM (SELECT vec_id, {_D} AS v FROM embeddings) a JOIN (SELECT vec_id - 1 AS vec_id, {_D} AS v FROM embeddings) b ON a.vec_id = b.vec_id")
def cosine_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    w = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w"))
    return v.join(w, "vec_id").select("vec_id", F.round(arrays.cosine(F.col("v"), F.col("w")), 6).alias("cos"))


@R.query(f"SELECT vec_id, round(list_max(list_transform(v, lambda x: exp(x / 0.5))) / list_sum(list_transform(v, lambda x: exp(x / 0.5))), 6) AS top, round(ln(list_sum(list_transform(v, lambda x: exp(x)))), 6) AS lse FROM (SELECT vec_id, {_D} AS v FROM embeddings)")
def softmax_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("v")
    return _vectors(spark, sf_dir).select("vec_id", F.round(F.array_max(arrays.softmax(v, 0.5)), 6).alias("top"), F.round(arrays.logsumexp(v), 6).alias("lse"))


@R.query(f"SELECT round(avg(pow(ln(list_sum(list_transform(v, lambda x: exp(x)))), 2)), 6) AS z_loss FROM (SELECT {_D} AS v FROM embeddings)")
def z_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, sf_dir).agg(F.round(F.avg(F.pow(arrays.logsumexp(F.col("v")), F.lit(2))), 6).alias("z_loss"))


@R.query(f"SELECT vec_id, array_to_string(list_transform(v, lambda x: round(x / sqrt(list_avg(list_transform(v, lambda y: y * y)) + 1e-5) / sqrt(3) * 1e5)::BIGINT), ',') AS v FROM (SELECT vec_id, {_D} AS v FROM embeddings)")
def rms_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, sf_dir).select("vec_id", _joined(arrays.rms_norm(F.col("v"), position=3), 5).alias("v"))


@R.query(f"SELECT vec_id, round(list_avg(list_transform(v, lambda x: pow(x, 4))) / greatest(pow(list_avg(list_transform(v, lambda x: x * x)), 2), 1e-8), 5) AS k FROM (SELECT vec_id, {_D} AS v FROM embeddings)")
def raw_kurtosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, sf_dir).select("vec_id", F.round(arrays.raw_kurtosis(F.col("v")), 5).alias("k"))


@R.query("WITH x AS (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i, (vec_id + 1) % 2 AS m FROM embeddings), a AS (SELECT label, i, sum(v * m) / greatest(sum(m), 1e-9) AS v FROM x GROUP BY 1, 2) SELECT label, string_agg((round(v * 1e5))::BIGINT, ',' ORDER BY i) AS mean FROM a GROUP BY label")
def masked_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = arrays.masked_mean_by(table(spark, sf_dir, "embeddings"), ["label"], "embedding", (F.col("vec_id") + 1) % 2, 64)
    return m.select("label", _joined(F.col("mean"), 5).alias("mean"))


@R.query("SELECT vec_id, round((embedding[1]::DOUBLE + embedding[4]::DOUBLE * 3) / 2, 6) AS first FROM embeddings")
def masked_mean_of_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three rows of two numbers for each vector, the second masked."""
    v = lambda i, f=1.0: F.get("embedding", i).cast("double") * f
    rows = F.array(F.array(v(0), v(1)), F.array(v(2), v(2)), F.array(v(3, 3.0), v(4)))
    m = arrays.masked_mean(rows, F.array(F.lit(1.0), F.lit(0.0), F.lit(1.0)), 2)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.get(m, 0), 6).alias("first"))


@R.query("SELECT item_id, array_to_string(t[greatest(1, len(t) - 29):], ',') AS cropped, array_to_string(list_concat(t, list_transform(range(greatest(0, 60 - len(t))), lambda i: 0)), ',') AS padded FROM (SELECT item_id, list_transform(string_split(text, ' '), lambda x: length(x)) AS t FROM benchmark)")
def crop_and_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.transform(F.split("text", " "), F.length)
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(arrays.left_crop(t, 30), ",").alias("cropped"), F.array_join(arrays.right_pad(t, F.lit(60), 0), ",").alias("padded"))


# word lengths modulo 3 as ids; pairs of different ids and of equal ones
@R.query("SELECT doc_id, md5(replace(t, '12', '9')) AS h, md5(replace(t, '11', '9')) AS same FROM (SELECT doc_id, array_to_string(list_transform(string_split(text, ' '), lambda x: length(x) % 3), '') AS t FROM documents)")
def merged_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = F.transform(F.split("text", " "), lambda x: F.length(x) % 3)
    h = lambda right: F.md5(F.array_join(arrays.merged_pair(F.col("ids"), F.lit(1), F.lit(right), F.lit(9)), "").cast("binary"))
    return table(spark, sf_dir, "documents").select("doc_id", ids.alias("ids")).select("doc_id", h(2).alias("h"), h(1).alias("same"))


@R.query("""SELECT a.page_id, len(list_filter(range(1, least(length(a.url), length(b.url)) + 1), lambda i: left(a.url, i::INTEGER) = left(b.url, i::INTEGER))) AS prefix
FROM pages a JOIN pages b ON b.page_id = a.page_id + 1""")
def common_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many characters the addresses of a page and of the next one have in common from the start."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.split("url", "").alias("a"))
    after = pages.select((F.col("page_id") - 1).alias("page_id"), F.col("a").alias("b"))
    return pages.join(after, "page_id").select("page_id", arrays.common_prefix(F.array("a", "b")).cast("long").alias("prefix"))


@R.query("""SELECT o_orderkey, regexp_replace(t, '<<([^>]*)=([^>]*)>>', chr(10) || '\\1' || chr(10) || '\\2' || chr(10), 'g') AS parts
FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN 'They paid <<' || o_custkey || '*3=' || 3 * o_custkey || '>> and ' ELSE '' END || o_orderpriority || CASE WHEN o_orderkey % 2 = 0 THEN ', <<7+1=8>> left' ELSE '' END AS t FROM orders)""")
def gsm_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with none, one or two calls."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    paid = F.when(k % 3 > 0, F.concat(F.lit("They paid <<"), c, F.lit("*3="), 3 * c, F.lit(">> and "))).otherwise("")
    t = F.concat(paid, "o_orderpriority", F.when(k % 2 == 0, ", <<7+1=8>> left").otherwise(""))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.gsm_parts(t).alias("parts"))


@R.query("SELECT o_orderkey, 'import a' || o_orderkey || chr(10) || 'from b import c' AS imports, 'x = ' || o_orderkey AS program FROM orders")
def program_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    code = F.concat(F.lit("# c\n  import a"), k, F.lit(" \n\nfrom b import c\nx = 1\nimport d"))
    said = F.concat(F.lit("Sure:\n```python\nx = "), k, F.lit("\n```\nand\n```\ny\n```"))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.leading_imports(code).alias("imports"), text.first_program(said).alias("program"))


@R.query("SELECT c_custkey, CASE WHEN c_mktsegment IN ('AUTOMOBILE') THEN 'A' WHEN c_mktsegment = 'BUILDING' THEN 'B' WHEN c_mktsegment = 'FURNITURE' THEN NULL WHEN c_mktsegment = 'HOUSEHOLD' THEN 'D' WHEN c_mktsegment = 'MACHINERY' THEN 'A' END AS letter FROM customer")
def picked_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.when(F.col("c_mktsegment") == "FURNITURE", F.lit("zz")).when(F.col("c_mktsegment") == "HOUSEHOLD", F.lit("(d)")).otherwise(F.lower("c_mktsegment"))
    t = F.when(F.col("c_mktsegment") == "MACHINERY", F.lit("The answer")).otherwise(t)
    return table(spark, sf_dir, "customer").select("c_custkey", text.picked_letter(t, F.array(*[F.lit(x) for x in "ABCD"])).alias("letter"))


@R.query("SELECT c_custkey, c_name || '.tar' AS stem, 'o__' || c_name AS flat, 'T/' || c_custkey AS task FROM customer")
def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        "c_custkey", text.stem(F.concat(F.lit("/x/y/"), F.col("c_name"), F.lit(".tar.gz"))).alias("stem"),
        text.flat_name(F.concat(F.lit("o/"), F.col("c_name"))).alias("flat"), text.task_key(F.concat(F.lit("T_"), F.col("c_custkey"))).alias("task"),
    )


@R.query("SELECT doc_id, strlen(text) AS n, length(text) - length(replace(text, ' ', '')) AS spaces, length(text) - length(replace(text, chr(10), '')) AS newlines FROM documents")
def printable_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = text.printable_bytes(F.col("text").cast("binary"))
    count = lambda c: F.length(F.col("s")) - F.length(F.replace("s", F.lit(c), F.lit("")))
    d = table(spark, sf_dir, "documents").select("doc_id", shown.alias("s"))
    return d.select("doc_id", F.length("s").cast("long").alias("n"), count("Ġ").cast("long").alias("spaces"), count("Ċ").cast("long").alias("newlines"))


@R.query("""SELECT doc_id, p || CASE WHEN strlen(p) < least(61, strlen(text)) THEN chr(65533) ELSE '' END || doc_id AS t, p || doc_id AS dropped
FROM (SELECT doc_id, text, left(text, len(list_filter(range(1, 62), lambda i: i <= length(text) AND strlen(left(text, i::INTEGER)) <= 61))::INTEGER) AS p FROM documents)""")
def repaired_utf8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 61 bytes of each text, which may end within a character, with the id after them."""
    raw = F.concat(F.substring(F.col("text").cast("binary"), 1, 61), F.col("doc_id").cast("string").cast("binary"))
    return table(spark, sf_dir, "documents").select("doc_id", text.repaired_utf8(raw).alias("t"), text.repaired_utf8(raw, drop=True).alias("dropped"))


@R.query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN source ELSE 'x' || source END AS t FROM documents")
def without_leading(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.concat(F.when(F.col("doc_id") % 2 == 0, "<|bos|>").otherwise("x"), F.col("source"))
    return table(spark, sf_dir, "documents").select("doc_id", text.without_leading(t, "<|bos|>").alias("t"))


# each event stands for a step of a training run of 1201 steps
_T = "SELECT event_id, event_id % 1201 AS t FROM events"


@R.query(f"""SELECT event_id, t, round(CASE WHEN t < 100 THEN t / 100 * 0.02 WHEN t < 1000 THEN 0.001 + 0.5 * (1 + cos((t - 100) / 900 * pi())) * 0.019 ELSE 0.001 END, 9) AS cosine,
round(CASE WHEN t < 50 THEN 0 WHEN t < 150 THEN (t - 50) / 100 * 0.02 ELSE 0.02 END, 9) AS stable, round(0.001 + (1 - sqrt(t / 1200)) * 0.019, 9) AS decay,
round(CASE WHEN t < 100 THEN t / 100 * 0.02 ELSE 0.02 * pow(2, -((t >= 300)::INT + (t >= 700)::INT) / 2) END, 9) AS seesaw, round(0.85 + least(greatest(t, 1), 300) / 300 * (0.95 - 0.85), 9) AS momentum FROM ({_T})""")
def rate_schedules(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("t")
    r = lambda c: F.round(c, 9)
    return table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 1201).alias("t")).select(
        "event_id", "t", r(numbers.cosine_rate(t, 0.02, 0.001, 100, 1000)).alias("cosine"), r(numbers.stable_rate(t, 0.02, 50, 100)).alias("stable"),
        r(numbers.decay_rate(t, 0.02, 0.001, 0, 1200)).alias("decay"), r(numbers.seesaw_rate(t, 0.02, 100, [300, 700])).alias("seesaw"),
        r(numbers.momentum(t, 0.95)).alias("momentum"),
    )


@R.query(f"""SELECT event_id, t, round((6.0 * {numbers.parameters(12, 768, 2048, 32000)} + 12 * 12 * 12 * 64 * 1024) * (384 * 1024 / (1 + t / 100)) / {numbers.PEAK[8]}, 9) AS mfu, t * 384 * 1024 AS tokens,
(100 // 7 + (CASE WHEN t % 7 < 100 % 7 THEN 1 ELSE 0 END))::INTEGER AS local_batch FROM ({_T})""")
def throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("t")
    params = numbers.parameters(12, 768, 2048, 32000)
    mfu = numbers.utilisation(1 + t / 100, 384, 1024, params, 12, 12, 64, 8)
    return table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 1201).alias("t")).select("event_id", "t", F.round(mfu, 9).alias("mfu"), (t * 384 * 1024).alias("tokens"), numbers.local_batch(100, 7, t % 7).alias("local_batch"))


@R.query("SELECT l_orderkey, l_linenumber, abs(l_extendedprice - l_quantity * round(l_extendedprice / l_quantity, 6)) <= greatest(1e-7 * greatest(abs(l_extendedprice), abs(l_quantity * round(l_extendedprice / l_quantity, 6))), 0.0) AS close FROM lineitem")
def tolerant_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("l_extendedprice"), F.col("l_quantity") * F.round(F.col("l_extendedprice") / F.col("l_quantity"), 6)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", numbers.close(a, b).alias("close"))


@R.query("SELECT '{\"r_regionkey\":' || r_regionkey || ',\"r_name\":\"' || r_name || '\"}' AS value FROM region")
def json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_json(table(spark, sf_dir, "region").select("r_regionkey", "r_name"))


@R.query("SELECT event_id, json_extract_string(props, '$.page') AS page FROM events")
def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.page").alias("page"))
