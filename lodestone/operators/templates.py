"""Texts built from rows: training templates, chats, prompts and candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import strip

THINK = "\n<think>"


def training_text(text: Column, stage: int) -> Column:
    """The text and its end marker; at stage 3 also its beginning, and as a chat if it holds a line that begins with <think>."""
    if stage != 3:
        return F.concat(text, F.lit("<|endoftext|>"))
    at = F.instr(text, THINK)
    chat = F.concat(
        F.lit("<|bos|><|user_start|>"), F.substring(text, F.lit(1), at - 1), F.lit("<|user_end|><|assistant_start|>"),
        F.substring(text, at, F.length(text)), F.lit("<|assistant_end|><|endoftext|>"),
    )
    return F.when(at > 0, chat).otherwise(F.concat(F.lit("<|bos|>"), text, F.lit("<|endoftext|>")))


def training_text_by_path(text: Column, path: Column, stage: int) -> Column:
    """As `training_text`, but texts of all_chat and the_stack_v2_ stay as they are."""
    return F.when(F.contains(path, F.lit("all_chat")) | F.contains(path, F.lit("the_stack_v2_")), text).otherwise(training_text(text, stage))


def reasoning_text(query: Column, reasoning: Column, answer: Column) -> Column:
    return F.concat(query, F.lit("\n<think>"), reasoning, F.lit("</think>\n"), answer)


def conversations(turns: DataFrame) -> DataFrame:
    """conv_id and messages (structs role, content) in order, from rows (conv_id, turn, role, text)."""
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    return turns.groupBy("conv_id").agg(ordered.alias("m")).select("conv_id", F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))


def chat_text(messages: Column, generation: bool = False) -> Column:
    """A conversation with its markers. A leading system message goes into the first user turn; other roles give nothing; null content is empty."""
    first = F.get(messages, 0)
    system = F.when(first["role"] == "system", F.coalesce(first["content"], F.lit(""))).otherwise(F.lit(""))
    start = F.struct(F.lit("").alias("text"), F.lit(False).alias("told"))

    def step(a: Column, m: Column) -> Column:
        content = F.coalesce(m["content"], F.lit(""))
        inject = (m["role"] == "user") & (system != "") & ~a["told"]
        user = F.concat(F.lit("<|user_start|>"), F.when(inject, F.concat(system, F.lit("\n\n"))).otherwise(F.lit("")), content, F.lit("<|user_end|>"))
        said = F.when(m["role"] == "user", user).when(m["role"] == "assistant", F.concat(F.lit("<|assistant_start|>"), content, F.lit("<|assistant_end|>"))).otherwise(F.lit(""))
        return F.struct(F.concat(a["text"], said).alias("text"), (a["told"] | inject).alias("told"))

    end = "<|assistant_start|>" if generation else "<|endoftext|>"
    return F.concat(F.lit("<|bos|>"), F.aggregate(messages, start, step, lambda a: a["text"]), F.lit(end))


def with_answer(messages: Column, output: Column) -> Column:
    """The messages and the output as the assistant's last one."""
    return F.concat(messages, F.array(F.struct(F.lit("assistant").alias("role"), output.alias("content"))))


def candidates(df: DataFrame, key: str = "index", output: str = "output", generated: str = "generated_outputs") -> DataFrame:
    """A row for each candidate: the output at position 0, then those generated. To be scored and given to `regrouped`."""
    return df.select(key, F.posexplode(F.concat(F.array(output), F.coalesce(F.col(generated), F.array().cast("array<string>")))).alias("pos", "candidate"))


def regrouped(scored: DataFrame, value: str, key: str = "index", name: str | None = None) -> DataFrame:
    """The values of the candidates of each key, as a list in their order."""
    return scored.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", value))).alias("x")).select(key, F.col(f"x.{value}").alias(name or value))


def safety_text(messages: Column, candidate: Column) -> Column:
    return F.concat(F.element_at(messages, -1)["content"], F.lit("\n\n"), candidate)


def embedding_text(messages: Column, output: Column) -> Column:
    """All contents and the output, one a line; null if one is null."""
    parts = F.concat(F.transform(messages, lambda m: m["content"]), F.array(output))
    return F.when(~F.exists(parts, lambda p: p.isNull()), F.array_join(parts, "\n"))


def multiple_choice(question: Column, letters: Column, choices: Column) -> Column:
    """A question with a line for each choice and its letter; as many lines as the shorter list has."""
    n = F.least(F.size(letters), F.size(choices))
    lines = F.zip_with(F.slice(letters, F.lit(1), n), F.slice(choices, F.lit(1), n), lambda k, c: F.concat(F.lit("- "), c, F.lit("="), k, F.lit("\n")))
    return F.concat(F.lit("Multiple Choice question: "), question, F.lit("\n"), F.array_join(lines, ""), F.lit("\nRespond only with the letter of the correct answer."))


def shots(examples: Column, shown, delimiter: str) -> Column:
    """Solved examples, each followed by a blank line; `shown` gives an example's question and answer."""
    def one(e: Column) -> Column:
        question, answer = shown(e)
        return F.concat(question, F.lit(delimiter), answer, F.lit("\n\n"))

    return F.array_join(F.transform(examples, one), "")


def choice_prompts(query: Column, choices: Column, examples: Column, delimiter: str = " ") -> Column:
    """A prompt for each choice, after the examples (structs query, choices, gold)."""
    head = F.concat(shots(examples, lambda e: (e["query"], F.get(e["choices"], e["gold"])), delimiter), query, F.lit(delimiter))
    return F.transform(choices, lambda c: F.concat(head, c))


def schema_prompts(contexts: Column, continuation: Column, examples: Column, delimiter: str = " ") -> Column:
    """A prompt for each context, after the examples (structs context_options, continuation, gold)."""
    head = shots(examples, lambda e: (F.get(e["context_options"], e["gold"]), e["continuation"]), delimiter)
    return F.transform(contexts, lambda c: F.concat(head, c, F.lit(delimiter), continuation))


def continuation_prompts(context: Column, continuation: Column, examples: Column, delimiter: str = " ") -> Column:
    """Two prompts: without the continuation, stripped, and with it; contexts are stripped."""
    head = F.concat(shots(examples, lambda e: (strip(e["context"]), e["continuation"]), delimiter), strip(context), F.lit(delimiter))
    return F.array(strip(head), F.concat(head, continuation))


def task_conversation(question: Column, answer: Column) -> Column:
    """A question and its answer as messages."""
    said = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return F.array(said("user", question), said("assistant", answer))
