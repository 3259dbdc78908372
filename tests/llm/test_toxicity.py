import random

from corpus import docs, empty_docs, nasty, odd_docs  # noqa: F401
import numpy as np
from ludex.llm import toxicity
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.1"


def sample(n=600, seed=0):
    """Grade k: k bad words among harmless ones."""
    rng, rows, grades = random.Random(seed), [], []
    for _ in range(n):
        g = rng.choice([0, 0, 0, 1, 2])
        rows.append({b"w%d" % rng.randrange(200) for _ in range(20)} | {b"bad%d" % k for k in range(3 * g)})
        grades.append(g)
    return rows, np.array(grades)


def test_ordinal_model_orders_grades():
    words, grades = sample()
    m = toxicity.fit_ordinal(words, grades)
    assert len(m.thresholds) == 2 and m.thresholds[0] < m.thresholds[1]
    held, want = sample(300, 1)
    q = np.array([m.above(b" ".join(w).decode()) for w in held])
    # words with digits are cut, so score through the weights
    s = np.array([sum(m.weights.get(x, 0) for x in w) for w in held])
    q = 1 / (1 + np.exp(np.array(m.thresholds) - s[:, None]))
    assert (q[:, 0] >= q[:, 1]).all()
    expected = q.sum(axis=1)
    assert expected[want == 0].max() < expected[want == 2].min() and ((q > 0.5).sum(axis=1) == want).mean() > 0.95


def test_gradient_is_exact():
    """Two thresholds, three words: the fit reaches a stationary point of the penalised likelihood."""
    words, grades = sample(80)
    m = toxicity.fit_ordinal(words, grades, vocabulary=3, penalty=0.5, steps=4000)
    vocab = sorted(m.weights)

    def loss(theta):
        w, b = dict(zip(vocab, theta)), theta[3:]
        out = 0.0
        for ws, g in zip(words, grades):
            s = sum(w[x] for x in ws if x in w)
            p = np.r_[1, 1 / (1 + np.exp(b - s)), 0]
            out -= np.log(p[g] - p[g + 1]) / len(words)
        return out + 0.5 * sum(x * x for x in theta[:3]) / 2 / len(vocab)

    theta = np.r_[[m.weights[v] for v in vocab], m.thresholds]
    for k in range(5):
        e = np.zeros(5)
        e[k] = 1e-4
        assert abs(loss(theta + e) - loss(theta - e)) / 2e-4 < 2e-3


def test_one_grade_learns_nothing():
    assert toxicity.fit_ordinal([{b"a"}], np.array([0])).thresholds == []
    assert toxicity.fit_ordinal([], np.zeros(0, int)).thresholds == []


def test_labelled_documents(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    train = labels.where("doc_id % 2 = 0")
    got = toxicity.grade_documents(docs, train).join(labels.where("doc_id % 2 = 1").select("doc_id", F.col("toxic").alias("y")), "doc_id").toPandas()
    assert got[got.y == 1].toxic.mean() >= 0.8 and got[got.y == 0].toxic.mean() <= 0.01
    assert ((got.severity >= got.p_toxic) & (got.severity <= 2)).all()


def test_cases(spark, odd_docs, nasty, empty_docs):
    labels = spark.createDataFrame([(d, d % 2, None) for d in range(40)] + [(400, 1, 1), (1, 0, 0), (None, 1, 1), (999, 1, 0), (7, None, 1)],
                                   "doc_id long, toxic int, text int")
    assert toxicity.grade_documents(odd_docs, labels).count() == len(nasty)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {(r.severity, r.p_toxic, r.grade, r.toxic) for r in toxicity.grade_documents(odd_docs, none).collect()} == {(0.0, 0.0, 0, False)}
    assert toxicity.grade_documents(empty_docs, labels).count() == 0
