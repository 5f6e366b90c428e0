"""Evaluation, metrics, encoding and the classifier."""

from __future__ import annotations

from functools import reduce

import pandas as pd
import pytest
from pyspark.sql import functions as F

from codeloom.functions.scoring import argmax, pass_at_k
from codeloom.operators.batchmap import batch_map
from codeloom.operators.encode import fixed_length_rows, paired_rows
from codeloom.operators.evaluation import (
    capped_samples,
    compare_runs,
    evaluation_totals,
    problem_results,
    with_passed,
)
from codeloom.operators.labels import drop_label_conflicts, structure_features
from codeloom.operators.metrics import best_checkpoint, binary_metrics
from codeloom.operators.structure import file_reports
from codeloom.plans.classifier import evaluate as evaluate_classifier, held_out, predict, train
from codeloom.plans.evaluation import evaluate, programs


def expected_score(n, c, k):
    if n == 0:
        return 0.0
    return 1.0 if n - c < k else 1.0 - reduce(lambda a, i: a * (n - c - i) / (n - i), range(k), 1.0)


def test_pass_at_k(spark):
    cases = [(n, c, k) for n in (0, 1, 2, 5, 20) for c in range(0, n + 1) for k in (1, 2, 5, 10, 100)]
    df = spark.createDataFrame(cases, "n bigint, c bigint, k bigint")
    rows = df.select("n", "c", "k", pass_at_k(F.col("n"), F.col("c"), F.col("k")).alias("s")).collect()
    scores = {(r.n, r.c, r.k): r.s for r in rows}
    assert all(abs(scores[x] - expected_score(*x)) < 1e-12 for x in cases)
    assert scores[20, 3, 1] == pytest.approx(0.15) and scores[5, 4, 10] == 1.0 and scores[20, 0, 1] == 0.0
    for n, c, k in cases:
        assert scores.get((n, c + 1, k), 2) >= scores[n, c, k]


def sample_rows(spark):
    rows = [("a", i, 0 if i % 4 == 0 else 1, i == 8) for i in range(25)]
    rows += [("b", i, 0, False) for i in range(3)] + [("c", 0, None, None)]
    return spark.createDataFrame(rows, "task_id string, sample_no int, returncode int, timed_out boolean")


def test_results_and_means(spark):
    problems = spark.createDataFrame([("a",), ("b",), ("c",), ("none",)], "task_id string")
    results, means = evaluate(problems, sample_rows(spark), k_values=[1, 2, 6, 10], cap=20)
    assert {r.task_id: (r.n_samples, r.correct) for r in results.collect()} == {
        "a": (20, 4), "b": (3, 3), "c": (1, 0), "none": (0, 0),
    }
    assert tuple(evaluation_totals(results).first()) == (7, 24)
    got = {r.k: r.score for r in means.collect()}
    # 24 samples for 4 problems allow k up to 6
    assert set(got) == {1, 2, 6}
    for k, score in got.items():
        want = sum(expected_score(n, c, k) for n, c in [(20, 4), (3, 3), (1, 0), (0, 0)]) / 4
        assert score == pytest.approx(want)


def test_cap_is_optional(spark):
    everything = with_passed(capped_samples(sample_rows(spark), None))
    problems = spark.createDataFrame([("a",)], "task_id string")
    assert tuple(problem_results(problems, everything).first()) == ("a", 25, 6)


def test_programs(spark):
    problems = spark.createDataFrame([("t", "def f():\n", "assert f()", "f")], "task_id string, prompt string, test string, entry_point string")
    samples = spark.createDataFrame([("t", 0, "def f():\n    return 1\ndef g(): pass")], "task_id string, sample_no int, generated string")
    assert programs(problems, samples).first().program == "def f():\n    return 1\n\nassert f()"
    assert programs(problems, samples, include_prompt=False).first().program == "    return 1\n\nassert f()"


def test_compare_runs(spark):
    rows = [("base", "pass@1", 0.293), ("tuned", "pass@1", 0.341), ("base", "bleu", 62.1), ("other", "bleu", 1.0)]
    got = {r.metric: r for r in compare_runs(spark.createDataFrame(rows, "run string, metric string, score double"), "base", "tuned").collect()}
    assert got["pass@1"].delta == pytest.approx(0.048) and got["bleu"].after is None and got["bleu"].delta is None


def test_argmax(spark):
    df = spark.createDataFrame([([0.5, 0.5],), ([0.1, 3.0, 3.0],), ([-1.0],), ([1.0, float("nan"), 2.0],)], "v array<double>")
    assert [r[0] for r in df.select(argmax(F.col("v"))).collect()] == [0, 1, 0, 1]


@pytest.mark.parametrize(
    "pairs, want",
    [
        ([(1, 1), (1, 0), (0, 1), (0, 0), (1, 1)], (0.6, 2 / 3, 2 / 3, 2 / 3)),
        ([(1, 0), (0, 0)], (0.5, 0.0, 0.0, 0.0)),
        ([(0, 1)], (0.0, 0.0, 0.0, 0.0)),
        ([(1, 1)], (1.0, 1.0, 1.0, 1.0)),
    ],
)
def test_binary_metrics(spark, pairs, want):
    got = binary_metrics(spark.createDataFrame(pairs, "labels int, predicted int")).first()
    assert tuple(got) == pytest.approx(want)


def test_best_checkpoint(spark):
    rows = [("a", 500, 0.4), ("a", 1000, 0.6), ("a", 1500, 0.6), ("b", 500, 0.1)]
    got = best_checkpoint(spark.createDataFrame(rows, "run string, step int, f1 double")).collect()
    assert sorted(map(tuple, got)) == [("a", 1000, 0.6), ("b", 500, 0.1)]


def test_label_conflicts(spark):
    rows = [("x", 0), ("x", 1), ("y", 1), ("y", 1), ("z", 0)]
    got = drop_label_conflicts(spark.createDataFrame(rows, "func string, labels int"), "func", "labels").collect()
    assert sorted(map(tuple, got)) == [("y", 1), ("y", 1), ("z", 0)]


def test_structure_features(spark):
    files = spark.createDataFrame([("a.py", "def f():\n  if x:\n    pass\n")], "file string, text string")
    labels = spark.createDataFrame([("a.py", 1), ("gone.py", 0)], "file string, labels int")
    got = {r.file: list(r.features) for r in structure_features(labels, file_reports(files), "file").collect()}
    assert got == {"a.py": [1, 0, 0, 4, 3, 1], "gone.py": [0] * 6}


def test_encoding(spark):
    df = spark.createDataFrame([(1, "a b a!"), (2, ""), (3, "x " * 50)], "id int, text string")
    got = {r.id: r for r in fixed_length_rows(df, max_length=6, keep=["id"]).collect()}
    one = got[1].input_ids
    assert one[0] == one[2] != one[1] and one[4:] == [0, 0] and got[1].attention_mask == [1, 1, 1, 1, 0, 0]
    assert got[2].input_ids == [0] * 6 and got[3].attention_mask == [1] * 6
    assert all(0 < i <= 1000 for i in got[3].input_ids)
    pair = paired_rows(df.select("id", F.col("text").alias("code"), F.lit("s t").alias("summary"))).first()
    assert (len(pair.input_ids), len(pair.attention_mask), len(pair.labels)) == (256, 256, 128)


def test_batch_map(spark):
    df = spark.createDataFrame([(1, "a"), (2, "bb")], "id int, text string")

    def size(batch):
        return pd.DataFrame({"n": batch["text"].str.len(), "text": batch["text"].str.upper()})

    assert sorted(map(tuple, batch_map(df, size, "n bigint, text string").collect())) == [(1, 1, "A"), (2, 2, "BB")]
    dropped = batch_map(df, lambda b: size(b)[["n"]], "n bigint", drop_input=True)
    assert dropped.columns == ["n"] and sorted(r.n for r in dropped.collect()) == [1, 2]


def test_classifier(spark):
    rows = [(f"good code number {i} return value", 0) for i in range(60)]
    rows += [(f"buggy leak number {i} free null", 1) for i in range(60)]
    df = spark.createDataFrame(rows, "func string, labels int")
    held = held_out(F.col("func"))
    model = train(df.where(~held), features=1 << 10, iterations=5)
    assert 10 < df.where(held).count() < 50
    assert evaluate_classifier(model, df.where(held)).first().f1 > 0.9
    assert predict(model, df).columns == ["func", "labels", "predicted"]


def test_a_score_that_is_no_number_is_never_best(spark):
    nan = float("nan")
    rows = [("a", 1, 0.5), ("a", 2, nan), ("b", 3, nan), ("b", 4, None), ("c", 6, 0.1), ("c", 5, 0.1)]
    got = best_checkpoint(spark.createDataFrame(rows, "run string, step int, f1 double")).collect()
    assert sorted(map(str, map(tuple, got))) == ["('a', 1, 0.5)", "('b', 3, None)", "('c', 5, 0.1)"]
