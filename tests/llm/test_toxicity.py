import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from triplane.llm.toxicity import BITS, PREFIX, REJECT_AT, Model, filter_toxicity, fit_ordinal, label_grade, score_toxicity, text_features, train

SF = "/root/testdata/sf0.01"


def naive_loss(model, rows, features, grades):
    eta = np.zeros(len(grades))
    for r, f in zip(rows, features):
        eta[r] += model.weights[list(model.features).index(f)]
    over = [np.ones(len(grades)), *(1 / (1 + np.exp(t - eta)) for t in model.thresholds), np.zeros(len(grades))]
    return -np.mean([np.log(over[g][i] - over[g + 1][i]) for i, g in enumerate(grades)])


def test_fit_recovers_ordered_grades():
    rng = np.random.default_rng(1)
    n = 1500
    x = rng.random((n, 6)) < 0.3
    signal = x @ np.array([3.0, 2, 1, -1, 0, 0])
    latent = signal + rng.logistic(size=n) * 0.5
    grades = np.searchsorted([1.5, 3.0, 4.5], latent)
    rows, features = np.nonzero(x)
    model = fit_ordinal(rows, features, grades)
    assert np.all(np.diff(model.thresholds) >= 0) and len(model.thresholds) == 3
    assert model.weights[0] > model.weights[1] > model.weights[2] > model.weights[4] > model.weights[3]
    null = Model(model.features, np.zeros(6), np.log((1 - (f := np.array([(grades > c).mean() for c in range(3)]))) / f))
    assert naive_loss(model, rows, features, grades) < 0.6 * naive_loss(null, rows, features, grades)
    margins = model.margins(rows, features, n)
    assert np.corrcoef(margins, signal)[0, 1] > 0.98


def test_fit_is_near_the_least_loss():
    rng = np.random.default_rng(2)
    n = 800
    x = rng.random((n, 5)) < 0.4
    grades = np.searchsorted([1.0, 3.0], x @ np.array([2.0, 1, 0.5, -1, 0]) + rng.logistic(size=n))
    rows, features = np.nonzero(x)
    model = fit_ordinal(rows, features, grades, steps=3000)
    least = naive_loss(model, rows, features, grades)
    for _ in range(40):
        step = rng.normal(size=7) * 0.05
        other = Model(model.features, model.weights + step[:5], np.sort(model.thresholds + step[5:]))
        assert naive_loss(other, rows, features, grades) > least - 1e-4


def test_grades_are_the_labels(spark):
    rows = [(1, 1, 0), (2, 0, 0), (3, 1, 1), (4, 0, 1), (5, None, 1), (6, 0, None)]
    labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    assert [r[0] for r in labels.select(label_grade(labels)).collect()] == [0, 0, 2, 1, 1, None]
    less = labels.drop("quality")
    assert [r[0] for r in less.select(label_grade(less)).collect()] == [0, 0, 1, 1, 1, None]


def naive_features(text):
    """Hashes of the words, and of the first bytes of longer ones, one by one."""
    def mixed(x):
        x &= (1 << 64) - 1
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % (1 << 64)
        x = (x ^ x >> 27) * 0x94D049BB133111EB % (1 << 64)
        return x ^ x >> 31

    found = set()
    for word in re.findall("[a-z0-9\u00aa-\u02ff]+", text.lower()):
        data = word.encode()
        total = [sum((c + 1) * pow(0x9E3779B97F4A7C15, k, 1 << 64) for k, c in enumerate(data[:end])) % (1 << 64) for end in (len(data), PREFIX)]
        found.add(mixed(total[0]) >> 64 - BITS)
        if len(data) > PREFIX:
            found.add(mixed(total[1] ^ 0x5851F42D4C957F2D) >> 64 - BITS)
    return found


def test_scores_are_the_plain_sums(spark, make_docs):
    texts = ["Some plain words, some longer ones", "longer longer longer", "", "Vile SLUR filth é naïveté", "x " * 5000 + "filth"]
    features = sorted(set().union(*map(naive_features, texts)))
    model = Model(np.array(features), np.random.default_rng(1).normal(size=len(features)), np.array([-0.5, 0.25, 2.0]))
    got = {r["doc_id"]: r for r in score_toxicity(make_docs([(i, t, "en", "a") for i, t in enumerate(texts)]), model).collect()}
    weight = dict(zip(features, model.weights, strict=True))
    for i, t in enumerate(texts):
        over = [1 / (1 + math.exp(theta - sum(weight[f] for f in naive_features(t)))) for theta in model.thresholds]
        assert got[i]["expected_severity"] == pytest.approx(sum(over)) and got[i]["toxic"] == (over[0] >= REJECT_AT)


def test_train_on_given_grades(spark, make_docs):
    words = ["calm", "rude", "vile slur"]
    docs = make_docs([(i, f"{words[i % 3]} text {i % 7}", "en", "a") for i in range(150)])
    labels = spark.createDataFrame([(i, i % 3) for i in range(150)], "doc_id long, level int")
    model = train(docs, labels, grade=F.col("level"))
    assert len(model.thresholds) == 2
    got = {r["doc_id"]: r["expected_severity"] for r in score_toxicity(docs, model).collect()}
    assert got[0] < 0.3 < 0.7 < got[1] < 1.3 < 1.7 < got[2]


def test_features_are_a_set_per_text():
    rows, features = text_features(["same same SAME", None, "", "other"])
    assert np.bincount(rows, minlength=4).tolist() == [1, 0, 0, 1]


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = train(docs, labels.where("doc_id % 3 <> 0"))
    scored = score_toxicity(docs, model)
    assert scored.count() == docs.count()
    held = scored.join(labels.where("doc_id % 3 = 0").withColumnRenamed("toxic", "is_toxic"), "doc_id").toPandas()
    toxic = held["is_toxic"] == 1
    assert held["toxic"][toxic].mean() >= 0.6  # some 270 labelled rows to learn from
    assert held["toxic"][~toxic].mean() <= 0.05
    assert held["expected_severity"][toxic].mean() > 3 * held["expected_severity"][~toxic].mean()


def test_odd_rows(spark, make_docs, odd_rows):
    labelled = [(500 + i, f"plain text number {i}" + (" vile slur filth" if i % 4 == 0 else ""), "en", "a") for i in range(80)]
    docs = make_docs(labelled + odd_rows)
    labels = spark.createDataFrame([(500 + i, None, int(i % 4 == 0), "x") for i in range(80)] + [(None, 1, 1, "x"), (3, 1, 1, "x"), (500, 1, None, "x"), (500, 1, 1, "x")], "doc_id long, quality int, toxic int, text string")
    model = train(docs, labels)
    got = score_toxicity(docs, model).collect()
    assert len(got) == 80 + len(odd_rows)
    verdict = {r["doc_id"]: r["toxic"] for r in got}
    assert all(verdict[500 + i] == (i % 4 == 0) for i in range(80))
    assert not any(verdict[i] for i in (1, 2, 3, 4, 5, 6, 7, 8))
    kept = filter_toxicity(docs, model)
    assert kept.columns == docs.columns and kept.count() == 60 + len(odd_rows)


@pytest.mark.parametrize("toxic", [0, 1])
def test_one_class_or_no_labels(spark, make_docs, toxic):
    docs = make_docs([(1, "a b c", "en", "a"), (2, None, "en", "a")])
    labels = spark.createDataFrame([(1, 1, toxic)] if toxic else [], "doc_id long, quality int, toxic int")
    model = train(docs, labels)
    assert [(r["expected_severity"], r["toxic"]) for r in score_toxicity(docs, model).collect()] == [(0.0, False)] * 2
    assert filter_toxicity(docs, model).count() == 2
    assert filter_toxicity(make_docs([]), model).count() == 0 and 0 < REJECT_AT < 1
