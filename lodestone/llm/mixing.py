"""Mixing sources to target weights by soft membership.

A softmax regression, trained on at most `bound` rows of the labelled table, gives each document a posterior over the
domains low (quality 0), toxic (toxic 1) and clean (neither). Document d with t tokens and posteriors p_k gives
r * t * p_k expected tokens to domain k if its rate is r. Rates r >= 0 are fitted by projected gradient on the least
squares between expected totals and targets, from r = 1, each domain scaled by its own size (by a hundredth of the tokens, if
it has less, so that a domain without documents doesn't pull at all others), in the norm sum t r^2, so that a step
changes the rate of a document by what it is, not by how long it is. Rates have no upper bound: a rare domain meets its
target by many copies of few documents. All documents take part in every step.

A step needs the K totals only. Since r is a function of the posteriors and the steps so far, it is recomputed from the
last few steps and the rates before them; nothing of the size of the corpus is kept per step, and nothing but K numbers
reaches the driver. Rates become whole numbers of copies by systematic rounding within each partition.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import cut
from lodestone.llm.features import Terms, Vocabulary, presence, sample_texts, sampled_rows, score_rows, telling_terms, term_counts

DOMAINS = ("low", "clean", "toxic")
TERM_KINDS = ("word", "prefix4", "prefix6", "shape")
#: Shares of tokens that the mixture should have.
TARGETS = {"low": 0.02, "clean": 0.95, "toxic": 0.03}


@dataclass
class Posterior:
    vocabulary: Vocabulary
    weights: np.ndarray  # a row for each term, two for repetition, one for the bias


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", where: Column | None = None, bound: int = 6000, terms: int = 512) -> Posterior:
    """The classifier from at most `bound` labelled rows; without any, posteriors are even."""
    sample = sample_texts(docs, labels, ["quality", "toxic"], id_col, text_col, bound, where)
    group = F.when(F.col("quality") == 0, 0).when(F.col("toxic") > 0, 2).otherwise(1)
    sizes = {r["g"]: r["n"] for r in sample.groupBy(group.alias("g")).agg(F.count("*").alias("n")).collect()}
    counts = cut(term_counts(sample, TERM_KINDS, group, 3).where(F.col("c0") + F.col("c1") + F.col("c2") >= 3))
    chosen = np.unique(np.concatenate([telling_terms(counts, [sizes.get(g, 0) for g in range(3)], k, terms, 3) for k in range(3)]))
    m = Posterior(Vocabulary(chosen), np.zeros((len(chosen) + 3, 3)))
    y, found, dense = sampled_rows(sample, m.vocabulary, TERM_KINDS, ["quality", "toxic"])
    kind = np.where(y[:, 0] == 0, 0, np.where(y[:, 1] > 0, 2, 1))
    if not len(kind):
        return m
    x = presence(found, len(chosen) + 3)
    x[:, -3:-1], x[:, -1] = np.sqrt(dense[:, 1:]), 1
    onehot = np.eye(3)[kind]
    rng, first, second = np.random.default_rng(5), 0.0, 0.0
    for step in range(1, 601):
        rows = rng.integers(0, len(kind), 256)
        b = x[rows].astype(np.float64)
        g = b.T @ (_softmax(b @ m.weights) - onehot[rows]) / len(rows) + 1e-4 * m.weights
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        m.weights -= 0.03 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return m


def memberships(t: Terms, m: Posterior) -> np.ndarray:
    """A row of posteriors for each text of a slice."""
    size = max(1, len(m.vocabulary))
    at = np.concatenate([m.vocabulary.find(t.by[k]) for k in TERM_KINDS])
    doc = np.concatenate([t.doc] * len(TERM_KINDS))
    pair = np.unique(doc[at >= 0] * size + at[at >= 0])
    doc, at = pair // size, pair % size
    z = np.stack([np.bincount(doc, m.weights[at, k], t.n_docs) for k in range(3)], 1)
    return _softmax(z + np.sqrt(np.stack([t.adjacent, t.repeated], 1)) @ m.weights[-3:-1] + m.weights[-1])


def posteriors(docs: DataFrame, model: Posterior, text_col: str = "text", tokenizer_path: str | None = None) -> DataFrame:
    """All columns of `docs` as own_0, own_1, ..., then tokens (words, or ids of the tokenizer and an end mark) and the posteriors low, clean and toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value
        if tokenizer_path is None:
            return lambda t, _: [t.n_words, *memberships(t, m).T.copy()]
        from lodestone.llm.packing import tokenizer

        ids = tokenizer(tokenizer_path).ids
        return lambda t, texts: [np.array([len(ids(x or "")) + 1 for x in texts.to_pylist()], np.int64), *memberships(t, m).T.copy()]

    own = docs.select(*[F.col(f"`{c}`").alias(f"own_{i}") for i, c in enumerate(docs.columns)])
    return score_rows(own, "", f"own_{docs.columns.index(text_col)}", "tokens long, low double, clean double, toxic double", make, True)


def rate(steps: list[list[float]], start: Column | None = None) -> Column:
    """The rate of a document after these steps from `start`, or from 1."""
    start = F.lit(1.0) if start is None else start
    if not steps:
        return start
    history = F.array(*[F.array(*[F.lit(float(x)) for x in g]) for g in steps])
    move = lambda g: sum((F.col(d) * g[k] for k, d in enumerate(DOMAINS)), F.lit(0.0))
    return F.aggregate(history, start, lambda r, g: F.greatest(F.lit(0.0), r - move(g)))


def fitted_rates(members: DataFrame, targets: dict[str, float], steps: int = 1000, tolerance: float = 1e-4, stall: float = 1e-5, replayed: int = 12) -> DataFrame:
    """`members` (the rows of `posteriors`, materialised) with rate, by projected gradient.

    The fit ends when each expected total is within `tolerance` of its target, relatively, or when a step moves no total
    by more than `stall` of all tokens. After every `replayed` steps the rates so far are materialised, so a step
    replays at most so many.
    """
    figures = members.agg(F.sum("tokens").alias("n"), *[F.sum(F.col("tokens") * F.col(a) * F.col(b)).alias(f"{a}_{b}") for a in DOMAINS for b in DOMAINS]).first()
    total = float(figures["n"] or 0)
    if total == 0:
        return members.withColumn("rate", F.lit(1.0))
    h = np.array([[figures[f"{a}_{b}"] for b in DOMAINS] for a in DOMAINS]) / total
    scale = 1 / np.maximum(np.diag(h), 1e-2)
    # the largest eigenvalue of the scaled normal matrix bounds the step
    step = 1 / max(1e-9, float(np.linalg.eigvalsh(np.sqrt(scale)[:, None] * h * np.sqrt(scale)).max()))
    weights = sum(targets.values())
    goal = np.array([targets[d] / weights for d in DOMAINS])
    taken: list[list[float]] = []
    start, before = None, None
    for _ in range(steps):
        if len(taken) == replayed:
            members, taken = cut(members.withColumn("rate", rate(taken, start))), []
            start = F.col("rate")
        row = members.select("tokens", *DOMAINS, rate(taken, start).alias("r")).agg(*[F.sum(F.col("r") * F.col("tokens") * F.col(d)).alias(d) for d in DOMAINS]).first()
        left = np.array([row[d] for d in DOMAINS]) / total - goal
        # the targets are met, or no step brings them nearer
        if np.abs(left / np.maximum(goal, 1e-6)).max() < tolerance or before is not None and np.abs(left - before).max() < stall:
            break
        before = left
        taken.append([round(float(x), 10) for x in step * scale * left])
    return members.withColumn("rate", rate(taken, start))


def with_copies(rated: DataFrame) -> DataFrame:
    """`rated` with copies, its rate rounded to a whole number.

    Within a partition, rows of one likeliest domain and of about equal length (to a power of two) form a stratum; the running
    sum of the fractions, from a seeded start, gives a copy more whenever it passes a whole number. So a fraction is the
    odds of rounding up, and the copies of a stratum differ from its rates by less than one.
    """
    last = len(rated.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, sums = TaskContext.get().partitionId(), {}
        for batch in batches:
            p = np.stack([batch.column(batch.schema.get_field_index(d)).to_numpy() for d in DOMAINS], 1)
            rates, tokens = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("rate", "tokens"))
            whole = np.floor(rates)
            stratum = p.argmax(1) * 64 + np.frexp(tokens.astype(np.float64))[1] if len(p) else np.zeros(0, np.int64)
            copies = whole.astype(np.int64)
            for k in np.unique(stratum):
                rows = np.flatnonzero(stratum == k)
                start = sums.get(k, np.random.default_rng([part, int(k)]).random())
                passed = start + np.concatenate(([0.0], np.cumsum((rates - whole)[rows])))
                copies[rows] += np.diff(np.floor(passed)).astype(np.int64)
                sums[k] = passed[-1] % 1.0
            yield pa.RecordBatch.from_arrays([*batch.columns[:last], pa.array(copies)], [*batch.schema.names[:last], "copies"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rated.schema.fields)
    return rated.mapInArrow(run, f"{fields}, copies long").withColumn("copies", F.col("copies").cast("int"))


def mixture_rates(
    docs: DataFrame, model: Posterior, targets: dict[str, float] = TARGETS, id_col: str = "doc_id", text_col: str = "text",
    steps: int = 1000, tokenizer_path: str | None = None,
) -> DataFrame:
    """id, tokens, p_low, p_clean, p_toxic, rate and copies of each row.

    Tokens are words or, with a tokenizer, its ids and an end mark. Null and empty texts have no words, the posteriors of
    the bias, and a rate as their posteriors have. Repeated rows count once each and are rounded each for itself. If targets
    can't be met (a domain without documents), the fit ends where steps bring them no nearer. An empty table gives an
    empty result. Only the id and the text are read, whatever other columns there are.
    """
    members = cut(posteriors(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), model, "text", tokenizer_path).drop("own_1"))
    rates = with_copies(fitted_rates(members, targets, steps))
    return rates.select(F.col("own_0").alias(id_col), "tokens", *[F.col(d).alias(f"p_{d}") for d in DOMAINS], "rate", "copies")


def mixed(
    docs: DataFrame, model: Posterior, targets: dict[str, float] = TARGETS, text_col: str = "text", steps: int = 1000, tokenizer_path: str | None = None
) -> DataFrame:
    """The rows of `docs`, each as many times as its copies (as `mixture_rates` has them); no row is joined or moved. All columns stay, whatever their names."""
    rows = with_copies(fitted_rates(cut(posteriors(docs, model, text_col, tokenizer_path)), targets, steps)).where("copies > 0")
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).select(*[F.col(f"own_{i}").alias(c) for i, c in enumerate(docs.columns)])
