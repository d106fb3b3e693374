"""Toxicity: a factorisation machine over hashed terms.

Terms are whole words and prefixes of four and six bytes, present or not. From at most `bound` labelled documents two
sets of terms are chosen by chi-squared: those that tell most alone, and those of the pairs that tell most beyond what
either tells alone, such as an insult and the mention of a group. Pairs are sought among the `pool` terms that most
toxic documents have. The machine learns a weight and a vector of `factors` numbers for each,
so that pairs of terms count as such: score = sigmoid(w0 + sum w_i + sum over pairs v_i . v_j). Training is Adam on
the log loss, on the driver; scoring maps slices of documents. What is broadcast is bounded by `terms` and `factors`.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import cut
from lodestone.llm.features import Terms, Vocabulary, presence, sample_texts, sampled_rows, score_rows, telling_terms, term_counts

TERM_KINDS = ("word", "prefix4", "prefix6")


@dataclass
class Machine:
    vocabulary: Vocabulary
    bias: float
    w: np.ndarray
    v: np.ndarray


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit(x: np.ndarray, y: np.ndarray, factors: int = 8, epochs: int = 30, rate: float = 0.02, decay: float = 1e-4, positive: float = 2.0, seed: int = 7) -> tuple[float, np.ndarray, np.ndarray]:
    """Bias, weights and vectors for the rows of x (0 or 1) and labels y; rows labelled 1, the few, weigh `positive` times."""
    rng = np.random.default_rng(seed)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    p = [np.array([np.log(share / (1 - share))]), np.zeros(x.shape[1]), rng.normal(0, 0.05, (x.shape[1], factors))]
    first, second, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for k in range(0, len(x), 256):
            b = x[order[k : k + 256]].astype(np.float64)
            s = b @ p[2]
            z = p[0] + b @ p[1] + 0.5 * ((s * s).sum(1) - b @ (p[2] ** 2).sum(1))
            label = y[order[k : k + 256]]
            g = (_sigmoid(z) - label) * np.where(label > 0, positive, 1.0) / len(b)
            grads = [np.array([g.sum()]), b.T @ g + decay * p[1], b.T @ (g[:, None] * s) - p[2] * (b.T @ g)[:, None] + decay * p[2]]
            step += 1
            for i, d in enumerate(grads):
                first[i] += 0.1 * (d - first[i])
                second[i] += 0.001 * (d * d - second[i])
                p[i] -= rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return float(p[0][0]), p[1], p[2]


def chi_squared(both: np.ndarray, positive: np.ndarray, n: float, p: float) -> np.ndarray:
    """How much being among `both` (of them `positive` labelled 1) of n documents tells about the label, which p have."""
    below = both * (n - both) * (p * (n - p))
    return np.where(below > 0, (positive * (n - p) - (both - positive) * p) ** 2 * n / np.where(below > 0, below, 1), 0.0)


def telling_pairs(x: np.ndarray, y: np.ndarray, most: int, least_docs: int) -> np.ndarray:
    """The columns of x (0 or 1) in the `most` pairs whose presence together tells most beyond the better of the two alone."""
    n, p = float(len(y)), float(y.sum())
    both, positive = (x.T @ x).astype(np.float64), (x[y > 0].T @ x[y > 0]).astype(np.float64)
    chi = chi_squared(both, positive, n, p)
    alone = np.diag(chi)
    gain = np.triu(chi - np.maximum(alone[:, None], alone[None, :]), 1)
    gain[(both < least_docs) | (positive * n <= both * p)] = 0
    flat = gain.ravel()
    best = np.argsort(-flat, kind="stable")[:most]
    best = best[flat[best] > 0]
    return np.unique(np.concatenate(np.divmod(best, len(gain)))) if len(best) else np.zeros(0, np.int64)


def frequent_in_positives(counts: DataFrame, most: int, least_docs: int) -> np.ndarray:
    rows = counts.where(F.col("c1") >= least_docs).orderBy(F.desc("c1"), "term").limit(most).select("term").collect()
    return np.array([r["term"] for r in rows], np.int64).view(np.uint64)


def train(
    docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text",
    where: Column | None = None, bound: int = 8000, terms: int = 256, least_docs: int = 5, pairs: int = 64, pool: int = 1024,
) -> Machine:
    """The machine from at most `bound` labelled rows for which `where` holds; without any, scores are 0.5."""
    sample = sample_texts(docs, labels, [label_col], id_col, text_col, bound, where)
    positive = (F.col(label_col) > 0).cast("int")
    sizes = {r["g"]: r["n"] for r in sample.groupBy(positive.alias("g")).agg(F.count("*").alias("n")).collect()}
    counts = cut(term_counts(sample, TERM_KINDS, positive, 2).where(F.col("c0") + F.col("c1") >= least_docs))
    alone = telling_terms(counts, [sizes.get(0, 0), sizes.get(1, 0)], 1, terms, least_docs)
    wide = Vocabulary(np.union1d(alone, frequent_in_positives(counts, pool, least_docs)))
    y, found, _ = sampled_rows(sample, wide, TERM_KINDS, [label_col])
    y = (y[:, 0] > 0).astype(np.float64)
    if not len(y):
        return Machine(wide, 0.0, np.zeros(0), np.zeros((0, 1)))
    x = presence(found, len(wide))
    chosen = np.union1d(wide.find(alone), telling_pairs(x, y, pairs, least_docs)).astype(np.int64)
    return Machine(Vocabulary(wide.terms[chosen]), *fit(x[:, chosen], y))


def probability(t: Terms, m: Machine) -> np.ndarray:
    """The score of each text of a slice."""
    size = max(1, len(m.vocabulary))
    at = np.concatenate([m.vocabulary.find(t.by[k]) for k in TERM_KINDS])
    doc = np.concatenate([t.doc] * len(TERM_KINDS))
    pair = np.unique(doc[at >= 0] * size + at[at >= 0])
    doc, at = pair // size, pair % size
    z = m.bias + np.bincount(doc, m.w[at], t.n_docs)
    for f in range(m.v.shape[1]):
        v = m.v[at, f]
        z += 0.5 * (np.bincount(doc, v, t.n_docs) ** 2 - np.bincount(doc, v * v, t.n_docs))
    return _sigmoid(z)


def toxicity_scores(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text", cut_at: float = 0.3, keep: bool = False) -> DataFrame:
    """id (all columns if `keep`), score and predicted (score >= cut_at) of each row.

    Null and empty texts and those without chosen terms score what the bias alone gives. Repeated rows have equal
    scores. An empty table gives an empty result. Only the id and the text are read, whatever other columns there are;
    with `keep`, columns called score and predicted are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def make():
        m = shared.value
        return lambda t, _: [probability(t, m)]

    return score_rows(docs, id_col, text_col, "score double", make, keep).withColumn("predicted", (F.col("score") >= cut_at).cast("int"))
