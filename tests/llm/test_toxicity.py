import itertools
import zlib

import numpy as np
import pyarrow as pa

from tessera.llm import toxicity as X

from .common import docs, rows


def corpus(spark, sf="sf0.01"):
    d = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text")
    return d, spark.read.parquet(f"/root/testdata/{sf}/labels.parquet").select("doc_id", "toxic")


def test_held_out_accuracy(spark):
    d, labels = corpus(spark)
    data = d.join(labels, "doc_id").collect()
    held = lambda r: zlib.crc32(str(r.doc_id).encode()) % 5 == 0
    model = X.fit([(r.text, r.toxic) for r in data if not held(r)])
    test = [r for r in data if held(r)]
    score, _ = X.score_batch(model, pa.array([r.text for r in test]))
    y = np.array([r.toxic for r in test])
    assert ((score >= 0.5) == y).mean() > 0.93
    assert (score[y == 1] >= 0.5).mean() > 0.6 and (score[y == 0] >= 0.5).mean() < 0.02


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(3)
    e, t = rng.normal(size=(2, 5)), rng.normal(size=(2, 2))
    p, pairs = X._marginals(e, t)
    want_pairs = np.zeros((2, 2))
    for s in range(2):
        weight, hits = 0.0, np.zeros(5)
        own = np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=5):
            v = np.exp(sum(e[s, i] for i in range(5) if y[i]) + sum(t[a, b] for a, b in itertools.pairwise(y)))
            weight += v
            hits += v * np.array(y)
            for a, b in itertools.pairwise(y):
                own[a, b] += v
        assert np.allclose(p[s], hits / weight)
        want_pairs += own / weight
    assert np.allclose(pairs, want_pairs)
    # the ratio form used for scoring agrees, over texts of several lengths at once
    weights = np.zeros(1 << X.BITS, np.float32)
    f = np.arange(5)[:, None]
    weights[:5] = e[0]
    model = X.Model(weights, 0.0, np.exp(t), np.zeros(6))
    word = np.r_[np.arange(5), np.arange(3)]
    got = X._words(model, f, word, np.array([0, 5, 5, 8]))
    assert np.allclose(got[:5], p[0], atol=1e-5)
    assert np.allclose(got[5:], X._marginals(e[:1, :3], t)[0][0], atol=1e-5)


def test_spans_and_odd_rows(spark):
    d, labels = corpus(spark)
    model = X.train(d, labels)
    same = X.fit(X.labelled_sample(d, labels))
    assert np.array_equal(model.weights, same.weights) and np.array_equal(model.document, same.document)
    text = "Élan ñ and the thing. You IDIOT, stupid moron! of the rest"
    data = [(1, text), *rows(6)]
    out = X.annotate(docs(spark, data), model).collect()
    assert len(out) == len(data) and all(0 <= r.toxic_score <= 1 for r in out)
    (first,) = [r for r in out if r.text == text]
    covered = " ".join(text[s.start : s.end] for s in first.toxic_spans)
    assert "IDIOT" in covered and "moron" in covered and "thing" not in covered
    empty = {r.toxic_score for r in out if not (r.text or "").strip()}
    assert len(empty) == 1 and empty.pop() < 0.5
    assert X.annotate(docs(spark, []), model).collect() == []


def test_degenerate_labels(spark):
    for data in ([], [("a b c d", 1)], [("", 0), (None, 1)], [("a", 0), ("b", 1)]):
        score, _ = X.score_batch(X.fit(data), pa.array(["a", None]))
        assert ((score > 0) & (score < 1)).all()
    d = docs(spark, [(1, "x"), (2, None)])
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    assert X.labelled_sample(d, none) == []
    assert not X.train(d, none).weights.any()


def test_padding_changes_nothing():
    rng = np.random.default_rng(5)
    e, t = rng.normal(size=(3, 6)), rng.normal(size=(2, 2))
    lengths = (6, 3, 1)
    p, pairs = X._marginals(e, t, np.arange(6) < np.array(lengths)[:, None])
    alone = [X._marginals(e[k : k + 1, :n], t) for k, n in enumerate(lengths)]
    assert all(np.allclose(p[k, :n], alone[k][0][0]) for k, n in enumerate(lengths))
    assert np.allclose(pairs, sum(x for _, x in alone))


def test_short_texts_and_ends_are_learnt():
    rng = np.random.default_rng(6)
    say = lambda n: " ".join(f"word{chr(97 + k)}" for k in rng.integers(0, 20, n))
    data = [(say(40), 0) for _ in range(150)] + [(say(6), 0) for _ in range(50)]
    data += [(say(4) + " zqshort " + say(1), 1) for _ in range(25)] + [(say(30) + " vxending", 1) for _ in range(25)]
    model = X.fit(data)
    score, (p, *_) = X.score_batch(model, pa.array(["worda zqshort wordb", "worda vxending", "worda wordb wordc"]))
    assert p[1] > 0.5 and p[4] > 0.5 and p[5:].max() < 0.5
    assert score[0] > 0.5 and score[1] > 0.5 and score[2] < 0.5
