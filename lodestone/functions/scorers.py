"""Scorers: models as columns. A scorer maps batches of texts to numbers, strings or lists; it is loaded once a task, on the executor.

`proxy_quality` is a stand-in without a model, for tests and examples: a deterministic expression, not a model's result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Given nothing, loads a model and gives a function from a list of texts to as many results.
Loader = Callable[[], Callable[[list[str]], list]]


def scored(text: Column, load: Loader, batch: int = 128, most_chars: int | None = None, kind: str = "double") -> Column:
    """A result of the type `kind` for each text, in batches; texts are cut to `most_chars`, if given, as a model's input is. Null texts score null."""

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for part in parts:
            out: list = [None] * len(part)
            known = [i for i, there in enumerate(part.notna()) if there]
            for k in range(0, len(known), batch):
                at = known[k : k + batch]
                for i, x in zip(at, model([part.iloc[i][:most_chars] for i in at]), strict=True):
                    out[i] = x
            yield pd.Series(out, index=part.index, dtype="float64" if kind == "double" else "object")

    return F.pandas_udf(run, kind)(text)


def classified(logits: Column, classes: tuple[str, ...]) -> Column:
    """The class of the greatest logit, the first on ties; null without logits."""
    at = F.array_position(logits, F.array_max(logits))
    return F.when(F.size(logits) > 0, F.get(F.array(*[F.lit(c) for c in classes]), (at - 1).cast("int")))


def safety_classes(text: Column, load: Loader, classes: tuple[str, ...] = ("safe", "harmful"), batch: int = 16, most_chars: int | None = None) -> Column:
    """What a classifier, whose results are logits, takes each text for."""
    return classified(scored(text, load, batch, most_chars, "array<double>"), classes)


def embedded(text: Column, load: Loader, batch: int = 32) -> Column:
    """The vector of each text, of length one."""

    def unit():
        model = load()

        def vectors(texts: list[str]) -> list:
            x = np.array(model(texts), np.float64)
            return list(x / np.maximum(1e-12, np.linalg.norm(x, axis=1, keepdims=True)))

        return vectors

    return scored(text, unit, batch, None, "array<double>")


def generated(prompt: Column, load: Loader, k: int = 8, batch: int = 16) -> Column:
    """k completions of each prompt; an error if a model gives another number."""
    out = scored(prompt, load, batch, None, "array<string>")
    return F.when(out.isNull() | (F.size(out) == k), out).otherwise(F.raise_error(F.lit(f"a model gave other than {k} completions")).cast("array<string>"))


def proxy_quality(text: Column) -> Column:
    """Proxy: five times the share of letters that are small, no model."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    small = F.length(F.regexp_replace(text, r"[^\p{Ll}]", ""))
    return F.when(letters > 0, 5.0 * small / letters).otherwise(F.lit(0.0))
