"""Scores of evaluations: choices, accuracies, centred scores, pass rates, averages of checkpoints and weighted losses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.arrays import common_prefix, common_suffix, span_mean
from lodestone.functions.numbers import BITS, centred, pass_at_k
from lodestone.functions.text import task_key
from lodestone.session import if_small


def accuracy(rows: DataFrame, by: list[str], correct: str = "correct") -> DataFrame:
    """accuracy and total of each group."""
    return rows.groupBy(*by).agg(F.coalesce(F.avg(F.col(correct).cast("double")), F.lit(0.0)).alias("accuracy"), F.count("*").alias("total"))


def any_of_k(rows: DataFrame, by: list[str], correct: str = "correct") -> DataFrame:
    """Whether any of a problem's samples is right."""
    return rows.groupBy(*by).agg(F.bool_or(correct).alias("passed"))


def centred_scores(accuracies: DataFrame, baselines: DataFrame, task: str = "task", default: float | None = None) -> DataFrame:
    """Accuracies with their tasks' baselines (percent) and centred scores. A task without a baseline is left out, or has the default."""
    joined = accuracies.join(if_small(baselines, 64), task, "inner" if default is None else "left")
    if default is not None:
        joined = joined.withColumn("baseline", F.coalesce("baseline", F.lit(default)))
    return joined.withColumn("centred", centred(F.col("accuracy"), F.col("baseline")))


def macro_mean(scores: DataFrame, value: str = "centred") -> DataFrame:
    return scores.agg(F.avg(value).alias("core"))


# The chat tasks and the accuracy of guessing.
CHAT_TASKS = {"ARC-Easy": 0.25, "ARC-Challenge": 0.25, "MMLU": 0.25, "GSM8K": 0.0, "GSM8K_5shot": 0.0, "GSM8K_5shot_cot": 0.0, "HumanEval": 0.0}


def chat_core(accuracies: DataFrame, task: str = "task") -> DataFrame:
    """The mean of the chat tasks' centred accuracies; null unless all are there."""
    base = F.create_map(*[F.lit(x) for kv in CHAT_TASKS.items() for x in kv])
    known = accuracies.where(F.col(task).isin(*CHAT_TASKS)).withColumn("b", F.element_at(base, F.col(task)))
    score = F.avg((F.col("accuracy") - F.col("b")) / (1 - F.col("b")))
    return known.agg(F.when(F.count_distinct(task) == len(CHAT_TASKS), score).alias("chat_core"))


def matched_samples(samples: DataFrame, problems: DataFrame) -> DataFrame:
    """Samples whose task_id names a problem, as it stands or with underscores for slashes; others are left out. How problems are joined is left to the planner."""
    ids = problems.select(F.col("task_id").alias("p")).distinct()
    exact = samples.join(ids, F.col("task_id") == F.col("p"), "left")
    again = ids.withColumnRenamed("p", "q")
    both = exact.join(again, F.col("p").isNull() & (task_key(F.col("task_id")) == F.col("q")), "left")
    return both.withColumn("task_id", F.coalesce("p", "q")).drop("p", "q").where("task_id is not null")


def task_totals(results: DataFrame) -> DataFrame:
    """n, base (passes of the base tests) and plus (passes of both) of each task."""
    base = F.col("base_status") == "pass"
    return results.groupBy("task_id").agg(
        F.count("*").alias("n"), F.sum(base.cast("long")).alias("base"), F.sum((base & (F.col("plus_status") == "pass")).cast("long")).alias("plus")
    )


def pass_rates(totals: DataFrame, ks: tuple[int, ...] = (1, 10, 100)) -> DataFrame:
    """Per k, the means over tasks of pass@k for base and plus, as far as every task has k samples."""
    each = totals.select("n", *[pass_at_k(F.col("n"), F.col(c), k).alias(f"{c}_{k}") for k in ks for c in ("base", "plus")])
    means = each.agg(F.min("n").alias("least"), *[F.avg(f"{c}_{k}").alias(f"{c}_{k}") for k in ks for c in ("base", "plus")])
    rows = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"base_{k}").alias("base"), F.col(f"plus_{k}").alias("plus")) for k in ks])
    return means.select("least", F.explode(rows).alias("x")).where("x.k <= least").select("x.*")


def choice_spans(sequences: Column) -> Column:
    """For prompts that share a beginning: structs (start, end) of each one's own part."""
    start = common_prefix(sequences)
    return F.transform(sequences, lambda s: F.struct(start.alias("start"), F.size(s).alias("end")))


def context_spans(sequences: Column) -> Column:
    """For prompts that share an end: structs of that end's place in each."""
    n = common_suffix(sequences)
    return F.transform(sequences, lambda s: F.struct((F.size(s) - n).alias("start"), F.size(s).alias("end")))


def cropped_spans(tokens: Column, start: Column, end: Column, most: int) -> Column:
    """The last `most` tokens with the span moved along: struct tokens, start, end."""
    over = F.greatest(F.lit(0), F.size(tokens) - most)
    return F.struct(F.slice(tokens, over + 1, F.size(tokens)).alias("tokens"), (start - over).alias("start"), (end - over).alias("end"))


def span_loss(losses: Column, start: Column, end: Column) -> Column:
    """The mean loss of the tokens in [start, end): that of a token stands one place before it."""
    return span_mean(losses, start - 1, end - 1)


def bits_per_byte(rows: DataFrame, by: list[str], loss: str = "loss", size: str = "n_bytes", mask: str = "mask") -> DataFrame:
    """Mean loss of the tokens with mask 1, and their losses weighted by bytes, in bits."""
    live = F.col(mask) == 1
    weighted = F.sum(F.when(live, F.col(loss) * F.col(size))) / F.sum(F.when(live, F.col(size)))
    return rows.groupBy(*by).agg(F.avg(F.when(live, F.col(loss))).alias("mean_loss"), (weighted * BITS).alias("bits_per_byte"))


def shifted_masked_loss(losses: Column, labels: Column, shifted: bool = False) -> Column:
    """The mean of the losses whose label isn't -100. By default label i masks the loss at i, which predicts i + 1; `shifted` masks by label i + 1."""
    marks = F.slice(labels, F.lit(2), F.size(labels)) if shifted else labels
    kept = F.filter(F.zip_with(losses, marks, lambda x, y: F.when(y != -100, x)), lambda v: v.isNotNull())
    return F.when(F.size(kept) > 0, F.aggregate(kept, F.lit(0.0), lambda s, v: s + v) / F.size(kept))


def continuation_span(without: Column, whole: Column) -> Column:
    """Struct (start, end) of what a prompt with its continuation adds to that without; an error if it doesn't begin with it, or adds nothing."""
    n = F.size(without)
    ok = (n < F.size(whole)) & (F.slice(whole, F.lit(1), n) == without)
    return F.when(ok, F.struct(n.alias("start"), F.size(whole).alias("end"))).otherwise(F.raise_error(F.lit("a prompt is no beginning of that with its continuation")).cast("struct<start:int,end:int>"))


def resumed_ema(checkpoints: DataFrame, state: DataFrame, by: list[str], step: str, value: str, decay: float = 0.8, last: int = 6) -> DataFrame:
    """by, step and ema: the average that goes on from `state` (by, step, ema; may lack some) over those of the last checkpoints that come after it. A state that nothing follows stays."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(step)))
    rows = checkpoints.withColumn("__r", rank).where(F.col("__r") <= last)
    values = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(step).alias("s"), F.col(value).cast("double").alias("v")))).alias("x"))
    joined = values.join(state.select(*by, F.col(step).alias("__step"), F.col("ema").alias("__ema")), by, "full")
    fresh = F.filter(F.coalesce("x", F.array().cast("array<struct<s:bigint,v:double>>")), lambda y: F.col("__step").isNull() | (y["s"] > F.col("__step")))
    joined = joined.withColumn("x", F.transform(fresh, lambda y: F.struct(y["s"].cast("bigint").alias("s"), y["v"].alias("v"))))
    first = F.coalesce(F.col("__ema"), F.get("x", 0)["v"])
    follow = F.when(F.col("__ema").isNull(), F.slice("x", F.lit(2), F.greatest(F.size("x"), F.lit(1)))).otherwise(F.col("x"))
    ema = F.aggregate(follow, first, lambda a, y: decay * a + (1 - decay) * y["v"])
    return joined.select(*by, F.coalesce(F.array_max(F.transform("x", lambda y: y["s"])), F.col("__step").cast("bigint")).alias(step), ema.alias("ema"))


def two_way_mean(left: DataFrame, right: DataFrame, by: list[str], value: str) -> DataFrame:
    """The plain mean of two checkpoints' values, of those that both have."""
    return left.select(*by, F.col(value).alias("__l")).join(right.select(*by, F.col(value).alias("__r")), by).select(*by, (0.5 * F.col("__l") + 0.5 * F.col("__r")).alias(value))


def ema(checkpoints: DataFrame, by: list[str], step: str, value: str, decay: float = 0.8, last: int = 6) -> DataFrame:
    """The exponential average of the last checkpoints' values, in order; the first is taken as it is."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(step)))
    rows = checkpoints.withColumn("__r", rank).where(F.col("__r") <= last)
    values = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(step, value))).alias("x")).withColumn("v", F.col(f"x.{value}"))
    return values.select(*by, F.aggregate(F.slice("v", F.lit(2), F.size("v")), F.get("v", 0).cast("double"), lambda a, x: decay * a + (1 - decay) * x).alias("ema"))


def nucleus(rows: DataFrame, by: list[str], key: str, p: float, prob: str = "prob") -> DataFrame:
    """Tokens whose cumulated probability, from the likeliest down, is within p, and the first in any case; renormalised."""
    order = Window.partitionBy(*by).orderBy(F.desc(prob), key)
    kept = rows.withColumns({"__c": F.sum(prob).over(order.rowsBetween(Window.unboundedPreceding, 0)), "__r": F.row_number().over(order)}).where((F.col("__r") == 1) | (F.col("__c") <= p))
    return kept.withColumn(prob, F.col(prob) / F.sum(prob).over(Window.partitionBy(*by))).drop("__c", "__r")
