"""Vectors that tell words apart, exact neighbours, and training that no partitioning changes."""

import numpy as np
import pyarrow as pa
import pytest

from coincide.llm import quality

SENTENCES = ["The theorem follows from lemma two.", "Buy cheap pills online right now.", "Xq zzvtrk blorp mmm ewq kkk."]
#: Of the same form, so words alone tell the labels apart.
GOOD, BAD = "proof lemma theorem axiom corollary".split(), "casino jackpot pills bonus winner".split()


def labelled(spark, n=60):
    rng = np.random.default_rng(4)
    rows = [(k, " ".join(rng.choice(GOOD if k % 2 else BAD, 12)), k % 2) for k in range(n)]
    return (spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string"),
            spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id bigint, quality int"))


def test_sentences_of_one_form_have_different_terms():
    tf = quality.counts(pa.array(SENTENCES))
    x = quality.weighted(tf, np.ones(tf.shape[1], np.float32))
    similar = x @ x.T
    assert np.allclose(np.diag(similar), 1, atol=1e-5) and similar[np.triu_indices(3, 1)].max() < 0.95
    assert (quality.counts(pa.array([SENTENCES[0].upper()]))[0, quality.TERMS :] == tf[0, quality.TERMS :]).all()


def test_terms_by_hand():
    texts = [None, "", "ab", "one Two one\none", "é" * 3]
    tf = quality.counts(pa.array(texts))[:, quality.TERMS :].sum(1)
    runs = [max(len((t or "").encode()) - 3, 0) + len((t or "").split()) for t in texts]
    assert tf.tolist() == runs
    apart = np.concatenate([quality.counts(pa.array([t], pa.string())) for t in texts])
    assert (apart == quality.counts(pa.array(texts))).all()


def test_words_decide(spark):
    docs, labels = labelled(spark)
    model = quality.fit(docs, labels)
    new = spark.createDataFrame([(1, "axiom proof theorem"), (0, "jackpot winner casino")], "doc_id bigint, text string")
    rows = {r.doc_id: r for r in quality.predict(new, model).collect()}
    assert rows[1].score > 0.8 and rows[0].score < 0.2 and (rows[1].predicted, rows[0].predicted) == (1, 0)


def test_votes_are_those_of_the_nearest():
    rng = np.random.default_rng(2)
    vectors = quality.unit(rng.normal(size=(200, 16)).astype(np.float32))
    labels = rng.integers(0, 2, 200).astype(float)
    asked = quality.unit(rng.normal(size=(quality.BLOCK + 40, 16)).astype(np.float32))
    got = quality.vote(asked, quality.Model(None, None, vectors, labels, 0.5))
    for q, score in zip(asked, got):
        near = sorted(((float(np.dot(q, v)), k) for k, v in enumerate(vectors)), reverse=True)[: quality.NEIGHBOURS]
        weight = [max(c, 0) for c, _ in near]
        assert score == pytest.approx(sum(w * labels[k] for w, (_, k) in zip(weight, near)) / sum(weight), abs=1e-5)


def test_repeated_keys_train_alike_at_any_partitioning(spark):
    docs, labels = labelled(spark)
    docs = docs.unionByName(docs.selectExpr("doc_id", "concat(text, ' again ', doc_id) AS text"))
    labels = labels.unionByName(labels.selectExpr("doc_id", "1 - quality AS quality").where("doc_id < 6"))
    models = [quality.fit(docs.repartition(n), labels.repartition(n)) for n in (1, 4, 50)]
    for model in models[1:]:
        assert len(model.labels) == 60 and (model.labels == models[0].labels).all() and (model.idf == models[0].idf).all()
        assert np.allclose(model.vectors, models[0].vectors)
