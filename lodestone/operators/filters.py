"""Filters of documents, repositories, conversations and scored rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import mostly_hex
from lodestone.operators.quantiles import percentile
from lodestone.operators.tokens import running_start
from lodestone.session import if_small

# For each part of a source's path, the score that its rows must exceed, by stage 1, 2 and 3; None where it isn't defined.
THRESHOLDS = {
    "dclm-edu": ("edu_score", (2.75, 3.2, None)),
    "finemath": ("score", (3.7, 4.1, 4.25)),
    "cosmopedia-v2-textbook-7b": ("score", (2.0, 2.3, 2.5)),
    "stack_edu_375plus_20B": ("score", (3.75, 4.1, 4.25)),
    "finepdfs_en_2020plus_edu": ("score", (1.75, 2.1, 2.4)),
    "finepdfs-edu": ("page_scores", (1.75, 2.1, 2.4)),
    "pleias_synth": ("score", (1.65, 1.85, 2.1)),
}
#: At stage 3 a text has more characters than this.
STAGE3_CHARS = 4000


def source_rule(path: Column, stage: int, columns: dict[str, Column]) -> Column:
    """Whether a row passes the strict thresholds of every rule whose name its path contains. `columns` has score, edu_score and page_scores, as far as there are any; a null score fails."""
    keep = F.lit(True)
    for part, (kind, limits) in THRESHOLDS.items():
        if kind not in columns:
            continue
        limit = limits[stage - 1]
        value = F.array_min(columns[kind]) if kind == "page_scores" else columns[kind]
        passes = F.raise_error(F.lit(f"{part} has no threshold at stage {stage}")).cast("boolean") if limit is None else F.coalesce(value > limit, F.lit(False))
        keep = keep & F.when(F.contains(path, F.lit(part)) & ~F.contains(path, F.lit("all_chat")), passes).otherwise(True)
    return keep


def filter_sources(df: DataFrame, path: Column, stage: int, text: Column, columns: dict[str, Column]) -> DataFrame:
    """Rows that pass their source's rule and, at stage 3, have a long text; rows of all_chat all pass."""
    keep = source_rule(path, stage, columns)
    if stage == 3:
        keep = keep & (F.contains(path, F.lit("all_chat")) | (F.length(text) > STAGE3_CHARS))
    return df.where(keep)


def head_fraction(df: DataFrame, order: list[str], low: float, high: float, by: list[str] | None = None) -> DataFrame:
    """Rows whose place in the order lies in [int(low * n), int(high * n)), n being the rows of the group."""
    by = by or []
    placed = running_start(df.withColumn("__one", F.lit(1)), order, "__one", "__place", by)
    sizes = df.groupBy(*[F.col(c).alias(f"__of{i}") for i, c in enumerate(by)]).agg(F.count("*").alias("__n"))
    on = F.lit(True)
    for i, c in enumerate(by):
        on = on & F.col(c).eqNullSafe(F.col(f"__of{i}"))
    ranked = placed.join(if_small(sizes, 64), on) if by else placed.withColumn("__n", df.agg(F.count("*")).scalar())
    kept = (F.col("__place") >= F.floor(F.col("__n") * low)) & (F.col("__place") < F.floor(F.col("__n") * high))
    return ranked.where(kept).select(*df.columns)


def language_share(files: Column, language: str) -> Column:
    """The share of files in a language; null without files."""
    return F.when(F.size(files) > 0, F.size(F.filter(files, lambda f: f["language"].eqNullSafe(F.lit(language)))) / F.size(files))


def repos_in_language(repos: DataFrame, language: str = "Python", share: float = 0.75) -> DataFrame:
    """repo_name of repositories labelled with the language, or labelled otherwise with more than `share` of their files in it; each once."""
    labelled = F.col("gha_language").eqNullSafe(F.lit(language))
    return repos.where(labelled | F.coalesce(~labelled & (language_share(F.col("files"), language) > share), F.lit(False))).select("repo_name").distinct()


def listed_files(files: DataFrame, listing: DataFrame) -> DataFrame:
    """Files that their repository lists and that aren't mostly hexadecimal."""
    return files.join(listing, ["repo_name", "path"], "left_semi").where(~mostly_hex(F.col("text")))


def loss_band(df: DataFrame, keep: float = 0.25, loss: str = "loss") -> DataFrame:
    """With t the int(100 * keep)-th percentile of the losses: those under 0.95 t (band 0) and those between 1.5 t and 1.75 t (band 1), NaN and null left out."""
    real = df.where(~F.isnan(loss) & F.col(loss).isNotNull())
    t = F.lit(percentile(real, loss, int(keep * 100) / 100)).cast("double")
    low, high = F.col(loss) < 0.95 * t, (F.col(loss) > 1.5 * t) & (F.col(loss) < 1.75 * t)
    return real.where(low | high).withColumn("band", F.when(F.col(loss) < 0.95 * t, 0).otherwise(1))


def truncated_turns(turns: DataFrame, limit: int, literal: bool = False) -> DataFrame:
    """Turns (conv_id, turn, role, text) of the longest run of whole user and assistant pairs whose characters stay within the limit, ending with a user turn.

    A leading system turn is set aside first; `literal` pairs by position with it in place, in which case the odd turn of a
    pair that isn't the assistant's is passed over.
    """
    by = Window.partitionBy("conv_id").orderBy("turn")
    rows = turns.withColumn("__first", F.row_number().over(by) == 1)
    if not literal:
        rows = rows.where(~(F.col("__first") & (F.col("role") == "system")))
    rows = rows.withColumn("__place", F.row_number().over(by) - 1).withColumn("__pair", F.floor(F.col("__place") / 2))
    rows = rows.where((F.col("__place") % 2 == 0) | (F.col("role") == "assistant"))
    spent = F.sum(F.length("text")).over(Window.partitionBy("conv_id").orderBy("__pair").rangeBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("__spent", spent).where(F.col("__spent") <= limit)
    last = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("__place")))
    rows = rows.withColumn("__last", last).where(~((F.col("__last") == 1) & (F.col("role") == "assistant")))
    return rows.select(*turns.columns)


def within_budget(messages: Column, budget: int) -> Column:
    """Whether there are messages and their characters together are fewer than the budget."""
    chars = F.aggregate(messages, F.lit(0), lambda s, m: s + F.length(m["content"]))
    return (F.size(messages) > 0) & (chars < budget)


# Limits of a request.
REQUEST = {"messages": 500, "message_chars": 4000, "total_chars": 8000, "temperature": (0.0, 2.0), "top_k": (1, 200), "max_tokens": (1, 2048)}


def request_faults(messages: Column, temperature: Column, top_k: Column, max_tokens: Column) -> Column:
    """The names of the limits that a request breaks; null settings break none."""
    sizes = F.transform(messages, lambda m: F.length(m["content"]))
    outside = lambda c, k: F.when((c < REQUEST[k][0]) | (c > REQUEST[k][1]), k)
    return F.array_compact(F.array(
        F.when(F.size(messages) == 0, "empty"),
        F.when(F.size(messages) > REQUEST["messages"], "messages"),
        F.when(F.exists(messages, lambda m: F.length(m["content"]) == 0), "empty_message"),
        F.when(F.exists(sizes, lambda n: n > REQUEST["message_chars"]), "message_chars"),
        F.when(F.aggregate(sizes, F.lit(0), lambda s, n: s + n) > REQUEST["total_chars"], "total_chars"),
        F.when(F.exists(messages, lambda m: ~m["role"].isin("user", "assistant")), "role"),
        outside(temperature, "temperature"), outside(top_k, "top_k"), outside(max_tokens, "max_tokens"),
    ))
