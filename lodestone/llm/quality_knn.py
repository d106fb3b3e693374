"""Quality classifier: nearest-neighbour voting in a latent semantic space.

At most `bound` labelled documents are the neighbours. Their weighted terms (word shapes, words, and how much a text
repeats itself) give a truncated singular value decomposition; each document is projected by it, scaled to length one,
and compared with every neighbour exactly: one matrix product per slice of documents. The `k` nearest vote with
weights that fall with their distance. What is broadcast is bounded by `bound`, `rank` and the size of the vocabulary.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.features import Terms, Vocabulary, frequent_terms, sample_texts, sampled_rows, score_rows, term_counts

#: Weights of the blocks of a document's term vector.
WEIGHTS = {"shape": 1.0, "word": 0.3, "repeat": 0.8}
#: Labelled rows whose terms the driver turns into numbers at once.
ROWS = 256
#: How fast a neighbour's vote falls with its distance (1 - cosine).
DECAY = 20.0


@dataclass
class Model:
    vocabulary: Vocabulary
    weight: np.ndarray  # of each term: its block's weight, for words times the inverse document frequency
    basis: np.ndarray
    neighbours: np.ndarray
    y: np.ndarray
    k: int
    prior: float


def _dense(doc: np.ndarray, term: np.ndarray, count: np.ndarray, n_words: np.ndarray, adjacent: np.ndarray, repeated: np.ndarray, m: Model) -> np.ndarray:
    """Weighted square roots of the terms' shares, and the figures of repetition."""
    keep = term >= 0
    n, size = len(n_words), len(m.vocabulary)
    share = np.bincount(doc[keep] * size + term[keep], count[keep], n * size).reshape(n, size) / np.maximum(1, n_words)[:, None]
    extra = np.sqrt(np.stack([adjacent, repeated], 1)) * WEIGHTS["repeat"]
    return np.concatenate([np.sqrt(share) * m.weight, extra], 1).astype(np.float32)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(1e-12, np.linalg.norm(x, axis=1, keepdims=True))


def latent_basis(x: np.ndarray, rank: int, rounds: int = 8, seed: int = 11) -> np.ndarray:
    """The first right singular vectors of x, by subspace iteration from a seeded start; fewer if x has fewer columns."""
    width = min(rank + 10, x.shape[1])
    q = np.random.default_rng(seed).normal(size=(x.shape[1], width)).astype(np.float32)
    for _ in range(rounds):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    b = x @ q
    _, v = np.linalg.eigh((b.T @ b).astype(np.float64))
    return np.ascontiguousarray(q @ v[:, ::-1][:, :rank].astype(np.float32))


def train(
    docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text",
    where: Column | None = None, bound: int = 4000, rank: int = 48, k: int = 24, shapes: int = 512, words: int = 1024,
) -> Model:
    """The model from at most `bound` labelled rows for which `where` holds; without any, scores are 0.5."""
    sample = sample_texts(docs, labels, [label_col], id_col, text_col, bound, where)
    # shapes recur in most texts and words rarely, so frequency alone chooses among both
    chosen, frequency = frequent_terms(term_counts(sample, ("shape", "word"), F.lit(0), 1), shapes + words, 3)
    vocabulary = Vocabulary(chosen)
    y, found, dense = sampled_rows(sample, vocabulary, ("shape", "word"), [label_col])
    y = (y[:, 0] > 0).astype(np.float64)
    if not len(y):
        return Model(vocabulary, np.zeros(0), np.zeros((2, 1), np.float32), np.zeros((0, 1), np.float32), y, k, 0.5)
    m = Model(vocabulary, np.log1p(len(y) / frequency) * WEIGHTS["word"], None, None, y, k, float(y.mean()))
    x = np.empty((len(found), len(vocabulary) + 2), np.float32)
    for at in range(0, len(found), ROWS):  # by parts, as the counts have doubles
        some, figures = found[at : at + ROWS], dense[at : at + ROWS]
        owner = np.repeat(np.arange(len(some)), [len(t) for t, _ in some])
        x[at : at + ROWS] = _dense(owner, np.concatenate([t for t, _ in some]), np.concatenate([c for _, c in some]), figures[:, 0], figures[:, 1], figures[:, 2], m)
    m.basis = latent_basis(x, rank)
    m.neighbours = _unit(x @ m.basis)
    return m


def vote(t: Terms, m: Model) -> np.ndarray:
    """The score of each text of a slice: of all neighbours as near as the k-th nearest, ties included, so no order of neighbours matters."""
    if not len(m.y):
        return np.full(t.n_docs, m.prior)
    doc = np.concatenate([t.doc, t.doc])
    term = m.vocabulary.find(np.concatenate([t.by["shape"], t.by["word"]]))
    x = _dense(doc, term, np.ones(len(doc)), t.n_words, t.adjacent, t.repeated, m).astype(np.float64)
    # rounded, so that a cosine doesn't depend on the slice it is computed in
    cos = np.round(_unit(x @ m.basis.astype(np.float64)) @ m.neighbours.astype(np.float64).T, 7)
    k = min(m.k, cos.shape[1])
    least = np.partition(cos, cos.shape[1] - k, axis=1)[:, cos.shape[1] - k, None]
    weight = np.where(cos >= least, np.exp(DECAY * (cos - 1)), 0.0)
    score = np.round(weight @ m.y / weight.sum(1), 9)
    return np.where(t.n_words > 0, np.clip(score, 0, 1), m.prior)


def quality_scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", cut_at: float = 0.3, keep: bool = False) -> DataFrame:
    """id (all columns if `keep`), score and predicted (score >= cut_at) of each row.

    Null and empty texts and those without words score the labelled share of label 1. Repeated rows have equal scores.
    An empty table gives an empty result. Only the id and the text are read, whatever other columns there are; with
    `keep`, columns called score and predicted are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value
        return lambda t, _: [vote(t, m)]

    return score_rows(docs, id_col, text_col, "score double", make, keep).withColumn("predicted", (F.col("score") >= cut_at).cast("int"))
