"""Quantiles, status rules, evaluation."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewmill.operators.embed import HashingEmbedder
from reviewmill.operators.quantiles import Spot, exact_quantiles, linear
from reviewmill.plans import evaluate, profile, reports
from reviewmill.sizes import broadcast_if_small


@pytest.mark.parametrize("values", [
    [float(i) for i in range(1000)],
    [1.0] * 700 + [2.0] * 299 + [3.0],
    [random.Random(1).choice([0.1, 0.25, 7.5, 1e9]) for _ in range(900)],
    [5.0],
    [float("-inf"), 1.0, 2.0, float("inf")],
])
@pytest.mark.parametrize("accuracy", [10, 100, 100_000])
def test_order_statistics(spark, values, accuracy):
    df = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "v double").repartition(4)
    ranks = sorted({1, 2, len(values) // 4, len(values) // 2, len(values) - 1, len(values)} & set(range(1, len(values) + 1)))
    spots = [Spot(r / len(values), lambda n, r=r: F.lit(r - 1)) for r in ranks]
    got = exact_quantiles(df, ["v"], spots, accuracy).first()["values"]
    assert got == [sorted(values)[r - 1] for r in ranks]


@pytest.mark.parametrize("accuracy", [10, 200, 100_000])
def test_quantiles_equal_numpy(spark, accuracy):
    rng = random.Random(2)
    values = [(rng.gauss(0, 100), float(rng.randint(1, 5))) for _ in range(2000)]
    df = spark.createDataFrame([(*v, None) for v in values], "v double, w double, e double")
    probabilities = [0.0, 0.25, 0.5, 0.75, 0.99, 1.0]
    found = exact_quantiles(df, ["v", "w", "e"], [linear(q) for q in probabilities], accuracy)
    got = {r["column"]: r["values"] for r in found.collect()}
    assert set(got) == {"v", "w"}
    for name, column in zip("vw", zip(*values)):
        assert np.allclose(got[name], np.quantile(column, probabilities), rtol=1e-12)
    for n in range(1, 6):
        some = exact_quantiles(df.limit(n), ["v"], [linear(q) for q in probabilities], accuracy)
        assert np.allclose(some.first()["values"], np.quantile([v for v, _ in values[:n]], probabilities))
    assert exact_quantiles(df.limit(0), ["v"], [linear(0.5)]).count() == 0


def test_statistics_of_all_columns_take_two_scans(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.range(5000).selectExpr(*[f"rand({i}) * {i} AS {c}" for i, c in enumerate(profile.NUMERIC)]).write.parquet(path)
    context = spark.sparkContext
    context.setJobGroup(path, "describe")
    try:
        stats = profile.describe(spark.read.parquet(path))
        bins = profile.histogram(spark.read.parquet(path), profile.NUMERIC)
        high = profile.quantile_outliers(spark.read.parquet(path))
        before = set(context.statusTracker().getJobIdsForGroup(path))
        assert stats.count() == len(profile.NUMERIC) and bins.count() > 100 and high.count() == 50
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert len(before) <= 3  # the schemas of three reads, nothing else
    rows = stats.collect()
    assert {r["column"] for r in rows} == set(profile.NUMERIC) and all(r["q25"] <= r["q50"] <= r["q75"] for r in rows)
    plan = stats._jdf.queryExecution().executedPlan().toString()
    assert len(set(re.findall(r"FileScan parquet \[rating_raw#(\d+)", plan))) == 2  # shown more than once, read once each


def test_histogram_edges(spark):
    df = spark.createDataFrame([(0.0, 7.0), (0.5, 7.0), (10.0, 7.0), (None, 7.0)], "a double, b double")
    rows = {(r["column"], r["bin"]): r["n"] for r in profile.histogram(df, ["a", "b"], 10).collect()}
    assert rows == {("a", 1): 2, ("a", 10): 1, ("b", 6): 4}


CHECKS = dict(duplicate_ids=0, row_count_mismatch=0, invalid_ratings=0, extreme_tips=0, long_reviews=0,
              null_text=0.0, null_age=0.0, unmapped_rows=0, conflicting_ids=0)


@pytest.mark.parametrize(("change", "status"), [
    ({}, "pass"), ({"null_age": 0.21}, "warn"), ({"null_age": 0.2}, "pass"), ({"null_text": 0.41}, "warn"),
    ({"null_text": 0.51}, "fail"), ({"conflicting_ids": 1}, "warn"), ({"unmapped_rows": 2}, "warn"),
    ({"duplicate_ids": 1, "null_age": 0.9}, "fail"), ({"row_count_mismatch": -1}, "fail"),
    ({"long_reviews": 1}, "fail"), ({"extreme_tips": 1}, "fail"), ({"invalid_ratings": 1}, "fail"),
])
def test_status(spark, change, status):
    row = {**CHECKS, **change}
    df = spark.createDataFrame([tuple(row.values())], ", ".join(
        f"{k} {'double' if isinstance(v, float) else 'long'}" for k, v in row.items()))
    assert reports.source_status(df).first()["status"] == status


def test_metadata_raises_only_failures(spark):
    ok = spark.createDataFrame([("a", "pass")], "source_file string, status string")
    info = spark.createDataFrame([("r", "x", 9.0, -1)], "restaurant_name string, address string, avg_stars double, total_reviews int")
    meta = reports.validate_metadata(info, "info")
    assert meta.first().asDict()["invalid_avg_stars"] == 1
    assert reports.combined_status(ok).first()["status"] == "pass"
    assert reports.combined_status(ok, meta).first()["status"] == "fail"
    assert reports.validate_metadata(info.drop("address"), "i").first()["missing_columns"] == 1


def test_counts_add_up(spark):
    df = spark.createDataFrame([("a",), (None,), ("a",), ("NA",), (None,)], "g string")
    rows = reports.value_counts(df, ["g"]).collect()
    assert sum(r["n"] for r in rows) == 5 and {r["missing_pct"] for r in rows} == {40.0}
    assert sorted((r["value"], r["n"]) for r in rows) == [("NA", 1), ("NA", 2), ("a", 2)]


def test_repeats_count_missing_ids(spark):
    df = spark.createDataFrame([("s", "1"), ("s", "1"), ("s", None), ("s", None), ("s", "2")], "source_file string, review_id string")
    assert reports.duplicate_ids(df).first()["duplicate_ids"] == 2
    totals = reports.integrity_totals(df).first()
    assert (totals["unique_reviews"], totals["duplicate_reviews"]) == (2, 3)


def test_gold_evaluation(spark):
    question = "Where is the soup served hot?"
    gold = evaluate.gold_table(spark, {question: ["harbour", "Popular", "soup", "warm"], "And the bread?": ["fresh"]})
    log = spark.createDataFrame(
        [(question, "HARBOUR house is popular", 30.0), ("unknown?", "nothing", 10.0)],
        "question string, answer string, ms double")
    scored = {r["question"]: r for r in evaluate.score_semantic(
        evaluate.score_keywords(log, gold), gold, HashingEmbedder(64)).collect()}
    assert scored[question]["keyword_acc"] == 0.5 and scored["unknown?"]["keyword_acc"] == 0.0
    assert scored["unknown?"]["semantic_acc"] is None and scored[question]["semantic_acc"] > 0
    summary = evaluate.run_eval(log, gold, HashingEmbedder(64)).first()
    assert (summary["n"], summary["p95_ms"], summary["avg_keyword_acc"]) == (2, 10.0, 0.25)
    empty = evaluate.run_eval(log.limit(0), gold, HashingEmbedder(64)).first()
    assert empty["n"] == 0 and empty["p95_ms"] is None


@pytest.mark.parametrize(("n", "rank"), [(1, 1), (2, 1), (12, 11), (20, 19), (100, 95)])
def test_p95_rank(n, rank):
    assert evaluate.p95_rank(n) == rank


def test_one_answer_per_conversation(spark):
    rows = [(1, i, f"p{i} ") for i in range(25)] + [(2, 0, "  hi "), (2, 1, None), (3, 1_700_000_000, "late"), (3, 9_999, "early ")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, text string").repartition(4)
    found = {r["conv_id"]: r["answer"] for r in evaluate.assemble_answers(df).collect()}
    assert found == {1: "".join(f"p{i} " for i in range(25)).strip(), 2: "hi", 3: "early late"}


def test_broadcast_only_below_the_limit(spark):
    left = spark.range(100).withColumnRenamed("id", "k")
    side = spark.range(50).select(F.col("id").alias("k"), F.lit("v").alias("v"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        small = left.join(broadcast_if_small(side), "k")._jdf.queryExecution().toString()
        large = left.join(broadcast_if_small(side, max_rows=10), "k")._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in small and "BroadcastHashJoin" not in large
