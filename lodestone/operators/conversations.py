"""Rows of question sets as conversations, how their answers are judged, and the layout of a chat request."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.text import first_program, gsm_answer, gsm_parts, leading_imports, strip
from lodestone.operators.templates import multiple_choice, task_conversation

#: The letters of questions with four choices.
LETTERS = ("A", "B", "C", "D")


def _or_error(ok: Column, value: Column, said: str, kind: str) -> Column:
    return F.when(ok, value).otherwise(F.raise_error(F.lit(said)).cast(kind))


def labelled_choices(question: Column, choices: Column, letters: Column, answer: Column) -> Column:
    """Messages of a question whose choices bring their own letters; an error if the answer is none of them."""
    return task_conversation(multiple_choice(question, letters, choices), _or_error(F.array_contains(letters, answer), answer, "the answer is none of the letters", "string"))


def numbered_choices(question: Column, choices: Column, answer: Column) -> Column:
    """Messages of a question with four choices whose answer is the number of one, from 0."""
    letters = F.array(*[F.lit(x) for x in LETTERS])
    return task_conversation(multiple_choice(question, letters, _or_error(F.size(choices) == 4, choices, "there are not four choices", "array<string>")), F.get(letters, answer.cast("int")))


def letter_is_right(messages: Column, letters: Column, response: Column) -> Column:
    """Whether a response is the letter of the last message, white space aside; an error if it is no letter."""
    return _or_error(F.array_contains(letters, strip(response)), strip(response) == strip(F.element_at(messages, -1)["content"]), "the response is none of the letters", "boolean")


def worked_answer(question: Column, answer: Column, shots: list[tuple[Column, Column]] = ()) -> Column:
    """Messages of a question with a worked answer, whose calculator calls become parts, after those of solved examples."""
    return F.concat(*[task_conversation(q, gsm_parts(a)) for q, a in [*shots, (question, answer)]])


def worked_is_right(messages: Column, response: Column) -> Column:
    """1 if the number in the last line of the last message is that of the response, else 0; the reward is the same as a double."""
    reference = F.element_at(F.split(F.element_at(messages, -1)["content"], "\n"), -1)
    return gsm_answer(reference).eqNullSafe(gsm_answer(response)).cast("int")


def program_task(prompt: Column, solution: Column) -> Column:
    """Messages of a program's beginning and the whole program."""
    return task_conversation(prompt, F.concat(prompt, F.lit("\n"), solution))


def program_to_run(prompt: Column, completion: Column, test: Column, entry_point: Column) -> Column:
    """The text of the program that would show whether a completion is right: the prompt's imports, the completion's program, the tests and their call. Nothing is run."""
    return F.concat(leading_imports(prompt), F.lit("\n\n"), first_program(completion), F.lit("\n\n"), test, F.lit("\n"), F.lit("check("), entry_point, F.lit(")"))


def request_text(messages: Column) -> Column:
    """A chat request with its markers, ready for the assistant: user and assistant messages only, no system message."""
    said = F.transform(messages, lambda m: F.when(m["role"] == "user", F.concat(F.lit("<|user_start|>"), m["content"], F.lit("<|user_end|>")))
                       .when(m["role"] == "assistant", F.concat(F.lit("<|assistant_start|>"), m["content"], F.lit("<|assistant_end|>"))).otherwise(F.lit("")))
    return F.concat(F.lit("<|bos|>"), F.array_join(said, ""), F.lit("<|assistant_start|>"))
