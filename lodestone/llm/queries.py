"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.tables import table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from lodestone.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from lodestone.llm.mixing import mixture_rates, train

    docs = table(spark, sf_dir, "documents")
    return mixture_rates(docs, train(docs, table(spark, sf_dir, "labels")), tokenizer_path=public_tokenizers.path("byte_bpe_50k.json"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.suffix_dedup import suffix_dedup

    return suffix_dedup(table(spark, sf_dir, "documents"))


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.media_columns import store_texts, stored_digest

    return stored_digest(store_texts(table(spark, sf_dir, "documents")))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.minhash import near_dedup

    return near_dedup(table(spark, sf_dir, "documents"), shingle=2)


def op6_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.features import crc_of_id
    from lodestone.llm.quality_knn import quality_scores, train

    docs, held = table(spark, sf_dir, "documents"), crc_of_id("doc_id") % 5 == 0
    model = train(docs, table(spark, sf_dir, "labels"), where=~held)
    return quality_scores(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")


def op7_toxicity_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.features import crc_of_id
    from lodestone.llm.toxicity_fm import toxicity_scores, train

    docs, held = table(spark, sf_dir, "documents"), crc_of_id("doc_id") % 4 == 2
    machine = train(docs, table(spark, sf_dir, "labels"), where=~held)
    return toxicity_scores(docs, machine).select("doc_id", held.alias("held_out"), "score", "predicted")


def op8_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.line_frequency import quality_rules

    return quality_rules(table(spark, sf_dir, "documents")).drop("n_lines", "n_common")


def op8_common_lines_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.line_frequency import without_common_lines

    out = without_common_lines(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", "n_removed", "kept", F.when(F.col("kept"), F.sha2(F.col("text").cast("binary"), 256)).alias("kept_sha256"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.line_dedup import line_dedup

    out = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op9_all_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As op9_line_dedup, over lines of every length but the empty ones."""
    from lodestone.llm.line_dedup import line_dedup

    out = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), min_chars=1)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.secret_scan import digest, secret_scan

    return digest(secret_scan(table(spark, sf_dir, "documents")))


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.turn_repair import repaired_digest

    return repaired_digest(table(spark, sf_dir, "conversations"))


def op12_log_reassembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.log_reassembly import events, reassemble, text_log

    return events(reassemble(text_log(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where("toxic = 1"))))


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.fingerprints import edit_fingerprints

    return edit_fingerprints(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_packing, op2_mixing, op3_suffix_dedup, op4_media_columns, op5_minhash, op6_quality_knn, op7_toxicity_fm, op8_line_frequency, op8_common_lines_removed, op9_line_dedup, op9_all_lines, op10_secret_scan, op11_turn_repair, op12_log_reassembly, op13_fingerprints)}


_SPACE, _WORD = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"

#: Quality rules: figures of each text, and lines that more of the host's documents hold than greatest(20, 1 % of them), or than 500.
OP8_SQL = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}+') AS w FROM documents),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, (VALUES (0), (1), (2)) v(k) GROUP BY doc_id),
l AS (SELECT doc_id, source, lower(trim(regexp_replace(line, '{_SPACE}+', ' ', 'g'))) AS line FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM d)),
h AS (SELECT source, least(greatest(20.0, count(DISTINCT doc_id) * 0.01), 500.0) AS most FROM d GROUP BY source),
c AS (SELECT l.source, line FROM l JOIN h USING (source) WHERE line <> '' GROUP BY l.source, line, most HAVING count(DISTINCT doc_id) > most),
v AS (SELECT doc_id, sum(length(line)) AS total, coalesce(sum(length(line)) FILTER ((source, line) IN (SELECT (source, line) FROM c)), 0) AS common FROM l WHERE line <> '' GROUP BY doc_id),
b AS (SELECT d.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  (SELECT count(*) - count(DISTINCT x) FROM (SELECT unnest(list_filter(string_split(text, chr(10)), lambda y: regexp_matches(y, '{_WORD}'))) AS x)) AS n_dup_lines,
  coalesce(rep.n, 0) AS n_repeat_words FROM d LEFT JOIN rep USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND (total IS NULL OR total - common >= 0.3 * total) AS kept
FROM b LEFT JOIN v USING (doc_id)"""

#: The kept texts without those lines.
OP8_REMOVED_SQL = OP8_SQL.rpartition("\nSELECT ")[0] + f""",
k AS (SELECT doc_id, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND (total IS NULL OR total - common >= 0.3 * total) AS kept FROM b LEFT JOIN v USING (doc_id)),
s AS (SELECT doc_id, source, unnest(x) AS line, generate_subscripts(x, 1) AS i FROM (SELECT doc_id, source, string_split(text, chr(10)) AS x FROM d)),
m AS (SELECT doc_id, i, line, coalesce((source, lower(trim(regexp_replace(line, '{_SPACE}+', ' ', 'g')))) IN (SELECT (source, line) FROM c), false) AS g FROM s)
SELECT doc_id, count(*) FILTER (g) AS n_removed, kept, CASE WHEN kept THEN sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT g), '')) END AS kept_sha256
FROM m JOIN k USING (doc_id) GROUP BY doc_id, kept"""

#: Line dedup: distinct long lines meet where a half is equal, and are compared.
OP9_SQL = """
WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents),
l AS (SELECT doc_id, unnest(x) AS line, generate_subscripts(x, 1) AS i FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY doc_id, i) AS pos FROM l WHERE length(line) >= 30),
d AS (SELECT line, min(pos) AS pos, length(line) AS n FROM o GROUP BY line),
k AS (SELECT line, pos, unnest(['f' || n || '/' || left(line, n // 2), 'l' || n || '/' || right(line, n - n // 2),
  'f' || (n - 1) || '/' || left(line, (n - 1) // 2), 'l' || (n - 1) || '/' || right(line, n - 1 - (n - 1) // 2)]) AS key FROM d),
near AS (SELECT DISTINCT a.line FROM k a JOIN k b ON a.key = b.key AND b.pos < a.pos WHERE levenshtein(a.line, b.line) = 1),
gone AS (SELECT o.doc_id, o.i FROM o JOIN d USING (line) WHERE o.pos > d.pos OR line IN (SELECT line FROM near)),
m AS (SELECT l.doc_id, l.i, l.line, gone.i IS NOT NULL AS g FROM l LEFT JOIN gone ON l.doc_id = gone.doc_id AND l.i = gone.i)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (g) AS n_removed, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT g), '')) AS kept_sha256 FROM m GROUP BY doc_id"""

#: The same over lines of every length but the empty one; there DuckDB's distance, which counts bytes, would tell two letters of two bytes apart by two edits.
_LONGER = "length({b}.line) = length({a}.line) + 1 AND len(list_filter(range(1, length({b}.line) + 1), lambda i: left({b}.line, i::INTEGER - 1) || substr({b}.line, i::INTEGER + 1) = {a}.line)) > 0"
_ONE_EDIT = f"""(length(a.line) = length(b.line) AND len(list_filter(range(1, length(a.line) + 1), lambda i: substr(a.line, i::INTEGER, 1) <> substr(b.line, i::INTEGER, 1))) = 1
  OR {_LONGER.format(a='a', b='b')} OR {_LONGER.format(a='b', b='a')})"""
OP9_ALL_SQL = OP9_SQL.replace("length(line) >= 30", "length(line) >= 1").replace("levenshtein(a.line, b.line) = 1", _ONE_EDIT)


def oracle_sql() -> dict[str, str]:
    """SQL where it can express a query over whole tables in reasonable time; the others are tested against brute force."""
    return {"op8_line_frequency": OP8_SQL, "op8_common_lines_removed": OP8_REMOVED_SQL, "op9_line_dedup": OP9_SQL, "op9_all_lines": OP9_ALL_SQL}
