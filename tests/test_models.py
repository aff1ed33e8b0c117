import json
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from jobsignals.operators import linear, models, terms
from jobsignals.plans import training
from jobsignals.session import materialise


def corpus(spark, n=60, signal=True, seed=5):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        label = "adversarial" if i % 2 else "ordinary"
        mark = ("zeta" if i % 2 else "omega") if signal else rng.choice(["zeta", "omega"])
        words = [rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(6)] + [mark] * 3
        level = (5.0 if i % 2 else 1.0) if signal else rng.random()
        rows.append((f"{i:03d}", label, f"{label}_{i % 3}", " ".join(words), level + rng.random(), rng.random()))
    return spark.createDataFrame(
        rows, "episode_id string, label string, scenario_family string, text_normalized string, x double, y double"
    )


def brute_tfidf(docs):
    grams = {}
    for key, text in docs.items():
        w = text.split()
        grams[key] = Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:])])
    df = Counter(t for g in grams.values() for t in g)
    out = {}
    for key, g in grams.items():
        raw = {t: n * (math.log((1 + len(docs)) / (1 + df[t])) + 1) for t, n in g.items()}
        norm = math.sqrt(sum(v * v for v in raw.values()))
        out |= {(key, t): v / norm for t, v in raw.items()}
    return out


def test_tfidf_equals_brute_force(spark):
    df = corpus(spark)
    want = brute_tfidf({r[0]: r[3] for r in df.collect()})
    got = {(r.episode_id, r.term): r.weight for r in terms.tfidf(df, text="text_normalized").collect()}
    assert got == pytest.approx(want)


def test_rows_of_one_key_are_counted_as_one_document(spark):
    rows = [("a", "Uno dos uno dos"), ("a", "dos tres"), ("a", None), (None, "uno dos"), (None, "dos"), ("b", "x"), ("c", None)]
    df = spark.createDataFrame(rows, "episode_id string, text string")
    got = {(r.episode_id, r.term): r.tf for r in terms.ngrams(df).collect()}
    assert got == {
        ("a", "uno"): 2, ("a", "dos"): 3, ("a", "tres"): 1, ("a", "uno dos"): 2, ("a", "dos uno"): 1, ("a", "dos tres"): 1,
        (None, "uno"): 1, (None, "dos"): 2, (None, "uno dos"): 1,
    }


def test_held_out_weights_know_only_other_folds(spark):
    df = corpus(spark, 30).withColumn("fold", (F.col("episode_id").cast("int") % 3))
    docs = {r.episode_id: (r.text_normalized, r.fold) for r in df.collect()}
    out = terms.tfidf(df, text="text_normalized", fold="fold", folds=3)
    got = {(r.episode_id, r.term): r.weight for r in out.collect()}
    for key, (text, fold) in docs.items():
        train = [t for t, f in docs.values() if f != fold]
        w = text.split()
        tf = Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:])])
        seen = Counter(t for x in train for t in set(x.split()) | {f"{a} {b}" for a, b in zip(x.split(), x.split()[1:])})
        raw = {t: n * (math.log((1 + len(train)) / (1 + seen[t])) + 1) for t, n in tf.items() if seen[t]}
        norm = math.sqrt(sum(v * v for v in raw.values()))
        assert {t: v for (k, t), v in got.items() if k == key} == pytest.approx({t: v / norm for t, v in raw.items()})


def test_vectors_equal_the_relational_weights(spark):
    df = corpus(spark, 20)
    grams = terms.with_grams(df, "text_normalized")
    fitted = models.TextVectorizer().fit(grams)
    names = fitted.terms
    want = brute_tfidf({r.episode_id: r.text_normalized for r in df.collect()})
    for r in fitted.transform(grams).select("episode_id", "text_vector").collect():
        v = r.text_vector
        assert {names[i]: x for i, x in zip(v.indices, v.values)} == pytest.approx({t: x for (k, t), x in want.items() if k == r.episode_id})


def test_smaller_vocabulary_is_opt_in(spark, monkeypatch):
    grams = terms.with_grams(corpus(spark, 20), "text_normalized")
    assert len(models.TextVectorizer(max_terms=4).fit(grams).terms) == 4
    monkeypatch.setattr(models, "TERM_LIMIT", 3)
    with pytest.raises(ValueError):
        models.TextVectorizer().fit(grams)


ESTIMATORS = [
    models.TextLogistic(),
    models.TextSVM(),
    models.TelemetryForest(numbers=["x", "y"], num_trees=10),
    models.FusedForest(numbers=["x", "y"], num_trees=20, max_depth=4, min_leaf=2),
]


@pytest.mark.parametrize("estimator", ESTIMATORS, ids=lambda e: type(e).__name__)
def test_planted_signal_is_found_out_of_fold(spark, estimator):
    result = training.classify(corpus(spark), estimator)
    pred = result["predictions"].collect()
    assert sorted(r.episode_id for r in pred) == [f"{i:03d}" for i in range(60)]
    assert result["metrics"].first().accuracy > 0.9
    assert sum(r["count"] for r in result["confusion"].collect()) == 60
    assert sum(r.n for r in result["families"].collect()) == 60
    run = result["runs"].first()
    assert (run.folds, run.n_episodes, run.model) == (5, 60, type(estimator).__name__)
    assert json.loads(run.settings)["seed"] == 0 and set(json.loads(run.settings)) == set(vars(estimator))
    top = {(r.side, r["rank"]): r.term for r in result["terms"].collect()}
    if isinstance(estimator, models.TelemetryForest):
        assert top[("importance", 1)] in ("x", "zeta", "omega", "zeta zeta", "omega omega")
    else:
        assert "zeta" in top[("adversarial", 1)] and "omega" in top[("ordinary", 1)]


def test_the_vocabulary_of_a_forest_is_a_table_without_a_limit(spark, monkeypatch):
    monkeypatch.setattr(models, "TERM_LIMIT", 3)
    df = corpus(spark, 20)
    estimator = models.FusedForest(numbers=["x", "y"], num_trees=3)
    prepared = materialise(estimator.prepare(df, ["episode_id", "label"]))
    fitted = estimator.fit(prepared)
    names = {r.f: r.term for r in fitted.vectors.table.collect()}
    size = fitted.vectors.size
    assert sorted(names) == list(range(size)) and len(set(names.values())) == size
    want = brute_tfidf({r.episode_id: r.text_normalized for r in df.collect()})
    numbers = {r.episode_id: (r.x, r.y) for r in df.collect()}
    rows = estimator.assemble(prepared, fitted.vectors).select("episode_id", "_features").collect()
    assert len(rows) == 20
    for r in rows:
        v = dict(zip(r["_features"]["indices"], r["_features"]["values"]))
        assert {names[i]: x for i, x in v.items() if i < size} == pytest.approx({t: x for (k, t), x in want.items() if k == r.episode_id})
        assert [v.get(size + j, 0.0) for j in range(2)] == list(numbers[r.episode_id])


def test_labels_that_nothing_explains_are_not_learned(spark):
    result = training.classify(corpus(spark, 80, signal=False), models.TextLogistic(), describe=False)
    assert 0.25 < result["metrics"].first().accuracy < 0.75


def test_logistic_fit_is_the_minimum_of_the_penalised_sum(spark):
    df = corpus(spark, 40)
    estimator = models.TextLogistic(C=2.0, tol=1e-10)
    prepared = estimator.prepare(df, ["episode_id", "label"])
    fitted = estimator.fit(prepared)
    rows = estimator.assemble(prepared, fitted.vectors).select("_features", "label").collect()
    x = np.array([r[0].toArray() for r in rows])
    s = np.array([1.0 if r[1] == "adversarial" else -1.0 for r in rows])
    w, b = fitted.model.coefficients.toArray(), fitted.model.intercept
    pull = -s / (1 + np.exp(s * (x @ w + b)))
    assert np.abs(w + 2.0 * x.T @ pull).max() < 1e-3 and abs(pull.sum()) < 1e-3


def test_svm_fit_is_the_minimum_of_the_squared_hinge(spark):
    df = corpus(spark, 40).withColumn("text_normalized", F.when(F.col("episode_id") != "007", F.col("text_normalized")))
    estimator = models.TextSVM(C=2.0, tol=1e-7)
    prepared = materialise(estimator.prepare(df.repartition(3), ["episode_id", "label"]))
    fitted = estimator.fit(prepared)
    rows = estimator.assemble(prepared, fitted.vectors).select("_features", "label").collect()
    x = np.array([[*r[0].toArray(), 1.0] for r in rows])
    s = np.array([1.0 if r[1] == "adversarial" else -1.0 for r in rows])
    w = np.append(fitted.model.coefficients.toArray(), fitted.model.intercept)

    def gradient(w):
        return w - 4.0 * x.T @ (s * np.maximum(0.0, 1.0 - s * (x @ w)))

    assert np.linalg.norm(gradient(w)) <= 2e-7 * np.linalg.norm(gradient(0.0 * w))
    margins = x @ w
    got = [r.predicted for r in fitted.predict(prepared).collect()]
    assert got == ["adversarial" if m > 0 else "ordinary" for m in margins]


def test_minimise_ends_at_the_minimum_of_an_uneven_bowl():
    scale = np.array([1.0, 30.0, 1000.0])
    end = linear.minimise(lambda x: (scale @ (x - 1.0) ** 2 / 2, scale * (x - 1.0)), np.zeros(3), 100, 1e-9)
    assert end == pytest.approx(np.ones(3), abs=1e-6)


def test_fused_and_answered_results(spark):
    df = corpus(spark, 30)
    text, gpu = df.drop("x", "y"), df.drop("text_normalized")
    result = training.combined_shrunk_classifier(text, gpu, num_trees=5)
    assert result["metrics"].first().n == 30
    answers = df.select("episode_id", F.when(F.col("episode_id") != "007", F.col("label")).alias("answer"))
    scored = training.answered(text, answers)
    row = scored["metrics"].first()
    assert (row.n, row.n_valid, row.accuracy) == (30, 29, 1.0)


def test_run_all_writes_what_was_asked(spark, tmp_path):
    df = corpus(spark, 20)
    names = training.run_all(spark, df.drop("x", "y"), df.drop("text_normalized"), str(tmp_path), ["text_svm"])
    assert names == ["text_svm"]
    assert spark.read.parquet(f"{tmp_path}/predictions").count() == 20
