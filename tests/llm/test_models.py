from __future__ import annotations

import random

import numpy as np
import pytest

from lodestone.llm import mixing, quality_knn, toxicity_fm
from lodestone.llm.common import cut
from lodestone.llm.features import Terms, sample_texts
from tests.llm.fixtures import WORDS, frame, prose


def labelled(spark, seed=1, n=240):
    """Clean prose, shouting junk and repeats (quality 0), and prose with an insult (toxic 1)."""
    rng, docs, labels = random.Random(seed), [], []
    for i in range(n):
        kind = i % 4
        text = prose(rng, rng.randint(30, 90))
        if kind == 1:
            text = " ".join(w.upper() + "!!" for w in text.split()) if i % 8 == 1 else " ".join([rng.choice(WORDS)] * 60)
        if kind == 2:
            w = text.split()
            w.insert(rng.randrange(len(w)), rng.choice(["scoundrel", "rotter"]))
            text = " ".join(w)
        docs.append((i, text, "s"))
        labels.append((i, int(kind != 1), int(kind == 2)))
    docs += [(n, None, None), (n + 1, "", "s"), (n + 2, docs[0][1], "s")]
    return frame(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_model_takes_its_rows_by_parts(spark, monkeypatch):
    docs, labels = labelled(spark)
    most, dense = [], quality_knn._dense
    monkeypatch.setattr(quality_knn, "_dense", lambda *a: most.append(len(a[3])) or dense(*a))
    model = quality_knn.train(docs, labels)
    whole = most.copy()
    monkeypatch.setattr(quality_knn, "ROWS", 50)
    most.clear()
    parts = quality_knn.train(docs, labels)
    assert whole == [240] and most == [50, 50, 50, 50, 40]
    assert (parts.neighbours == model.neighbours).all() and (parts.basis == model.basis).all()


def test_quality(spark):
    docs, labels = labelled(spark)
    model = quality_knn.train(docs, labels, where=labels.doc_id % 3 != 0, bound=100)
    assert len(model.y) == 100
    rows = {r["doc_id"]: r for r in quality_knn.quality_scores(docs, model).collect()}
    assert len(rows) == 243 and all(0 <= r["score"] <= 1 for r in rows.values())
    held = [(rows[i]["predicted"], int(i % 4 != 1)) for i in range(0, 240, 3)]
    assert sum(p == y for p, y in held) >= 0.95 * len(held)
    assert rows[240]["score"] == rows[241]["score"] == pytest.approx(model.prior) and rows[242]["score"] == rows[0]["score"]


def terms_of(texts):
    raw = [t.encode() for t in texts]
    return Terms(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))


def plain_vote(text, m):
    """One text's score by its definition, word by word and neighbour by neighbour."""
    t = terms_of([text])
    n = int(t.n_words[0])
    x = np.zeros(len(m.vocabulary) + 2)
    for kind in ("shape", "word"):
        for h in t.by[kind]:
            at = np.flatnonzero(m.vocabulary.terms == h)
            if len(at):
                x[at[0]] += 1 / n
    x[:-2] = np.sqrt(x[:-2]) * m.weight
    words = text.lower().split()
    x[-2] = np.sqrt(sum(a == b for a, b in zip(words, words[1:], strict=False)) / n) * quality_knn.WEIGHTS["repeat"]
    x[-1] = np.sqrt(1 - len(set(words)) / n) * quality_knn.WEIGHTS["repeat"]
    z = x @ m.basis.astype(float)
    z /= np.linalg.norm(z)
    cos = [round(float(sum(p * q for p, q in zip(z, v, strict=True))), 7) for v in m.neighbours.astype(float)]
    least = sorted(cos)[-m.k]
    votes = [(np.exp(quality_knn.DECAY * (c - 1)), y) for c, y in zip(cos, m.y, strict=True) if c >= least]
    return sum(w * y for w, y in votes) / sum(w for w, _ in votes)


def test_vote_equals_brute_force(spark):
    docs, labels = labelled(spark)
    m = quality_knn.train(docs, labels, bound=60, k=5)
    assert np.allclose(np.linalg.norm(m.neighbours, axis=1), 1, atol=1e-4)
    texts = [r["text"] for r in docs.where("length(text) > 0").orderBy("doc_id").limit(40).collect()]
    got = quality_knn.vote(terms_of(texts), m)
    assert np.allclose(got, [plain_vote(t, m) for t in texts], atol=1e-5)
    # a text scores the same whatever slice it is in
    assert [quality_knn.vote(terms_of([t]), m)[0] for t in texts] == got.tolist()


def test_vote_takes_all_ties(spark):
    """Of equal neighbours none is left out by where it stands."""
    docs, labels = labelled(spark)
    m = quality_knn.train(docs, labels, bound=60, k=3)
    one = m.neighbours[:1]
    m.neighbours, m.y = np.concatenate([np.repeat(one, 8, 0), -one]), np.array([1, 0, 0, 0, 0, 0, 0, 1, 1.0])
    t = terms_of(["bana colo diri"])
    score = quality_knn.vote(t, m)[0]
    m.neighbours, m.y = m.neighbours[::-1].copy(), m.y[::-1].copy()
    assert score == quality_knn.vote(t, m)[0]


def test_the_sample_keeps_its_bound_whatever_ids_repeat(spark):
    docs = frame(spark, [(1, f"text number {i}", "s") for i in range(300)] + [(2, None, None)])
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    assert sorted(r["text"] for r in sample_texts(docs, labels, ["quality"], "doc_id", "text", 10).collect()) == ["", "text number 0"]


def test_probability_equals_the_sum_over_pairs(spark):
    docs, labels = labelled(spark)
    m = toxicity_fm.train(docs, labels, terms=40)
    texts = [r["text"] for r in docs.where("length(text) > 0").orderBy("doc_id").limit(30).collect()]
    want = []
    for text in texts:
        t = terms_of([text])
        have = [i for i, h in enumerate(m.vocabulary.terms) if any((t.by[k] == h).any() for k in toxicity_fm.TERM_KINDS)]
        z = m.bias + sum(m.w[i] for i in have) + sum(float(m.v[i] @ m.v[j]) for k, i in enumerate(have) for j in have[:k])
        want.append(1 / (1 + np.exp(-z)))
    assert np.allclose(toxicity_fm.probability(terms_of(texts), m), want, atol=1e-9)


def test_an_insult_counts_only_beside_a_group(spark):
    """Insult and group are as frequent in harmless texts as in toxic ones; only together are they toxic. Many terms tell more alone than they do."""
    rng, docs, labels = random.Random(5), [], []
    for i in range(900):
        toxic = i % 3 == 0
        insult, group = (True, True) if toxic else rng.choice([(True, False), (False, True), (False, False)])
        w = prose(rng, 25).split()
        # words that lean to toxic texts, so that few places are left for the pair
        w += [f"lean{k}" for k in range(30) if rng.random() < (0.9 if toxic else 0.55)]
        for there, word in ((insult, "rotter"), (group, "lowlanders")):
            if there:
                w.insert(rng.randrange(len(w)), word)
        docs.append((i, " ".join(w), "s"))
        labels.append((i, 1, int(toxic)))
    table, marks = frame(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    m = toxicity_fm.train(table, marks, where=marks.doc_id % 5 != 0, terms=8, pairs=16)
    t = terms_of(["rotter", "lowlanders"])
    assert (m.vocabulary.find(t.by["word"]) >= 0).all()
    alone = toxicity_fm.probability(terms_of(["bana rotter colo", "bana lowlanders colo", "lowlanders rotter colo"]), m)
    assert alone[2] > 2 * max(alone[0], alone[1])


def test_memberships_equal_a_plain_softmax(spark):
    docs, labels = labelled(spark)
    m = mixing.train(docs, labels, terms=40)
    texts = [r["text"] for r in docs.where("length(text) > 0").orderBy("doc_id").limit(20).collect()]
    want = []
    for text in texts:
        t = terms_of([text])
        z = m.weights[-1].copy()
        z += sum((m.weights[i] for i, h in enumerate(m.vocabulary.terms) if any((t.by[k] == h).any() for k in mixing.TERM_KINDS)), np.zeros(3))
        words = text.lower().split()
        z += np.sqrt(sum(a == b for a, b in zip(words, words[1:], strict=False)) / len(words)) * m.weights[-3]
        z += np.sqrt(1 - len(set(words)) / len(words)) * m.weights[-2]
        want.append(np.exp(z) / np.exp(z).sum())
    assert np.allclose(mixing.memberships(terms_of(texts), m), want, atol=1e-6)


def test_latent_basis_equals_the_singular_vectors():
    rng = np.random.default_rng(3)
    x = (rng.normal(size=(300, 60)) * 0.7 ** np.arange(60)).astype(np.float32)
    _, _, v = np.linalg.svd(x)
    got = quality_knn.latent_basis(x, 8)
    assert np.allclose(abs((got * v[:8].T).sum(0)), 1, atol=1e-3)


def test_toxicity(spark):
    docs, labels = labelled(spark)
    m = toxicity_fm.train(docs, labels, where=labels.doc_id % 3 != 0)
    rows = {r["doc_id"]: r for r in toxicity_fm.toxicity_scores(docs, m).collect()}
    held = [(rows[i]["predicted"], int(i % 4 == 2)) for i in range(0, 240, 3)]
    assert sum(p == y for p, y in held) >= 0.95 * len(held)
    assert rows[240]["score"] == rows[241]["score"]


def test_machine_learns_pairs():
    """Two terms that are toxic together and harmless alone, which a linear model can't have."""
    rng = np.random.default_rng(2)
    x = (rng.random((1500, 12)) < 0.5).astype(np.float32)
    y = x[:, 0] * x[:, 1]
    bias, w, v = toxicity_fm.fit(x, y, epochs=60)
    s = x @ v
    p = toxicity_fm._sigmoid(bias + x @ w + 0.5 * ((s * s).sum(1) - x @ (v * v).sum(1)))
    assert ((p >= 0.5) == (y > 0)).mean() > 0.99


def test_models_without_labels(spark):
    docs, labels = labelled(spark, n=8)
    none = labels.where("false")
    assert {r["score"] for r in quality_knn.quality_scores(docs, quality_knn.train(docs, none)).collect()} == {0.5}
    assert {r["score"] for r in toxicity_fm.toxicity_scores(docs, toxicity_fm.train(docs, none)).collect()} == {0.5}
    assert mixing.mixture_rates(docs, mixing.train(docs, none)).count() == 11
    empty = docs.where("false")
    m = quality_knn.train(empty, labels)
    assert quality_knn.quality_scores(empty, m).count() == 0 and mixing.mixture_rates(empty, mixing.train(docs, labels)).count() == 0


def test_scores_keep_columns(spark):
    docs, labels = labelled(spark, n=40)
    m = quality_knn.train(docs, labels)
    out = quality_knn.quality_scores(docs, m, keep=True)
    assert out.columns == [*docs.columns, "score", "predicted"] and out.where("text is null").count() == 1


def members(spark, rows):
    return cut(spark.createDataFrame(rows, "own_0 long, tokens long, low double, clean double, toxic double"))


def rates(spark, df, targets):
    return np.array([(r["tokens"], r["low"], r["clean"], r["toxic"], r["rate"]) for r in mixing.fitted_rates(df, targets, 200).collect()])


def test_rates_meet_targets(spark):
    rng = np.random.default_rng(4)
    p = rng.dirichlet([0.3, 0.9, 0.2], 300)
    t = rng.integers(1, 500, 300)
    x = rates(spark, members(spark, [(i, int(t[i]), *map(float, p[i])) for i in range(300)]), {"low": 0.1, "clean": 0.8, "toxic": 0.1})
    total = x[:, 0].sum()
    share = [(x[:, 4] * x[:, 0] * x[:, k]).sum() / total for k in (1, 2, 3)]
    assert np.allclose(share, [0.1, 0.8, 0.1], atol=1e-3) and (x[:, 4] >= 0).all()


def test_a_rare_domain_meets_its_target(spark):
    """0.2 % of the tokens are low and 2 % should be: no rate under 9 will do."""
    p = [(0.9, 0.1, 0.0)] * 2 + [(0.0002, 0.9998, 0.0)] * 978 + [(0.0, 0.1, 0.9)] * 20
    x = rates(spark, members(spark, [(i, 100, *q) for i, q in enumerate(p)]), {"low": 0.02, "clean": 0.95, "toxic": 0.03})
    share = [(x[:, 4] * x[:, 0] * x[:, k]).sum() / x[:, 0].sum() for k in (1, 2, 3)]
    assert np.allclose(share, [0.02, 0.95, 0.03], atol=2e-4) and x[:, 4].max() > 9


@pytest.mark.parametrize("replayed", [2, 12])
def test_steps_equal_a_plain_projected_gradient(spark, replayed):
    rng = np.random.default_rng(5)
    p, t = rng.dirichlet([0.5, 0.5, 0.5], 50), rng.integers(1, 90, 50)
    goal = np.array([0.7, 0.05, 0.25])
    df = members(spark, [(i, int(t[i]), *map(float, p[i])) for i in range(50)])
    h = (p * t[:, None]).T @ p / t.sum()
    scale = 1 / np.maximum(np.diag(h), 1e-2)
    step = 1 / np.linalg.eigvalsh(np.sqrt(scale)[:, None] * h * np.sqrt(scale)).max()
    r = np.ones(50)
    for _ in range(5):
        r = np.maximum(r - p @ (step * scale * ((r * t) @ p / t.sum() - goal)), 0)
    out = mixing.fitted_rates(df, dict(zip(mixing.DOMAINS, goal, strict=True)), 5, tolerance=0, stall=0, replayed=replayed)
    assert np.allclose([x["rate"] for x in out.orderBy("own_0").collect()], r, atol=1e-6)


def test_rounding_keeps_the_totals_of_each_stratum(spark):
    rng = np.random.default_rng(6)
    p = rng.dirichlet([0.3, 0.9, 0.2], 800)
    rows = [(i, int(rng.integers(1, 300)), *map(float, p[i]), float(rng.exponential(1))) for i in range(800)]
    df = spark.createDataFrame(rows, "own_0 long, tokens long, low double, clean double, toxic double, rate double").coalesce(1)
    out = mixing.with_copies(df).toPandas()
    assert (abs(out["copies"] - out["rate"]) < 1).all()
    stratum = out[["low", "clean", "toxic"]].to_numpy().argmax(1) * 64 + np.frexp(out["tokens"].astype(float))[1]
    assert (abs(out.groupby(stratum)[["copies", "rate"]].sum().diff(axis=1)["rate"]) < 1).all()


def test_a_domain_without_documents_leaves_the_others(spark):
    x = rates(spark, members(spark, [(i, 100, 1e-5, 1 - 1e-5, 0.0) for i in range(20)]), {"low": 0.02, "clean": 0.95, "toxic": 0.03})
    assert (abs(x[:, 4] - 0.95) < 0.05).all()


def test_mixed_repeats_rows_by_their_rates(spark):
    docs, labels = labelled(spark)
    model = mixing.train(docs, labels)
    copies = {}
    for r in mixing.mixture_rates(docs, model).collect():
        copies[r["doc_id"]] = r["copies"]
        assert abs(r["copies"] - r["rate"]) < 1
    out = mixing.mixed(docs, model)
    assert out.columns == docs.columns
    got = {}
    for r in out.select("doc_id").collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + 1
    assert got == {k: n for k, n in copies.items() if n}
