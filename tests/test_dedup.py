"""Dedup and numbering against plain Python, under several partitionings."""

import random
import re

import pytest
from pyspark.sql import functions as F

from reviewmill.catalog import registry
from reviewmill.operators import dedup, enrich, numbering


def reviews(seed=1, n=3000):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        hot = rng.random() < 0.35
        rows.append((
            rng.choice(["a", "b"]) if not hot else "a",
            i * 7 + 3,
            None if hot else rng.choice([None, "x", "y", "z", f"t{rng.randint(0, 200)}"]),
            rng.choice([None, "ann", "bob"]), rng.choice(["r1", None]),
        ))
    return rows


SCHEMA = "source_file string, ord long, review_text string, customer_name string, restaurant_name string"


def first(rows, key):
    best = {}
    for r in sorted(rows, key=lambda r: r[1]):
        best.setdefault(key(r), r[1])
    return sorted(best.values())


@pytest.mark.parametrize("parts", [1, 4, 17])
def test_keep_first_any_partitioning(spark, parts):
    rows = reviews()
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    kept = sorted(r["ord"] for r in dedup.dedup_text(df).collect())
    assert kept == first(rows, lambda r: (r[0], r[2]))
    again = dedup.dedup_text(dedup.dedup_text(df))
    assert sorted(r["ord"] for r in again.collect()) == kept


@pytest.mark.parametrize("null_text", ["collapse", "keep"])
def test_two_steps_in_one(spark, null_text):
    rows = reviews(2)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    def text_key(r):
        return (r[0], r[2], r[1] if null_text == "keep" and r[2] is None else None)
    step1 = set(first(rows, text_key))
    step2 = first([r for r in rows if r[1] in step1], lambda r: (r[0], r[3], r[2], r[4]))
    got = sorted(r["ord"] for r in dedup.dedup_reviews(df, null_text=null_text).collect())
    assert got == step2


def test_empty_rows(spark):
    df = spark.createDataFrame([(None, None, "s"), ("", None, "s"), ("x", "y", "s")], "a string, b string, source_file string")
    assert dedup.drop_empty_rows(df, ["a", "b"]).count() == 2


@pytest.mark.parametrize("bits", [0, 6, 30])
@pytest.mark.parametrize("parts", [1, 9])
def test_numbering_is_one_to_n(spark, bits, parts):
    rows = reviews(3, 1000)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("review_id", F.lit("old")).repartition(parts)
    got = numbering.renumber(df, block_bits=bits).orderBy("review_id").collect()
    assert [r["review_id"] for r in got] == list(range(1, 1001))
    assert [(r["source_file"], r["ord"]) for r in got] == sorted((r[0], r[1]) for r in rows)


def test_enrich_matches_missing_names_and_multiplies(spark):
    left = spark.createDataFrame([(1, "a"), (2, None), (3, "c"), (4, "b")], "i int, restaurant_name string")
    info = spark.createDataFrame(
        [("a", 4.0, 10), ("a", 4.0, 10), ("b", 3.0, 1), ("b", 2.0, 1), (None, 1.0, 0)],
        "restaurant_name string, avg_stars double, total_reviews int")
    got = sorted((r["i"], r["avg_stars"]) for r in enrich.enrich_left_join(left, info).collect() if r["avg_stars"])
    assert got == [(1, 4.0), (2, 1.0), (4, 2.0), (4, 3.0)]
    assert enrich.enrich_left_join(left, info).count() == 5


def test_conflicts(spark):
    df = spark.createDataFrame(
        [("1", "a"), ("1", "b"), ("2", "a"), ("2", None), (None, "x"), (None, "y")],
        "review_id string, customer_name string")
    assert [r["review_id"] for r in enrich.conflicting_ids(df).collect()] == ["1"]
    assert enrich.flag_conflicts(df).count() == 2


@pytest.mark.parametrize("null_text", ["collapse", "keep"])
def test_counts_are_those_of_the_steps(spark, null_text):
    """One scan, with texts that repeat, are missing, and rows that are empty."""
    rng = random.Random(6)
    rows = [
        (i, rng.choice("ab"), rng.choice(["x", "y", None, None, f"t{i}"]), rng.choice(["n", None]), rng.choice(["d", None]))
        for i in range(300)
    ]
    df = spark.createDataFrame(rows, "ord long, source_file string, review_text string, customer_name string, location string")
    mapped = ["review_text", "customer_name", "location"]
    found = {r["source_file"]: r.asDict() for r in dedup.dedup_counts(df, mapped, null_text).collect()}
    filled = dedup.drop_empty_rows(df, mapped)
    text = dedup.first_ordinals(filled, ["review_text"], null_text=null_text).groupBy("source_file").count().collect()
    key = dedup.surviving_ordinals(filled, null_text=null_text).groupBy("source_file").count().collect()
    for r in text:
        assert found[r["source_file"]]["rows_text"] == r["count"]
    for r in key:
        n = found[r["source_file"]]
        assert n["rows_key"] == r["count"] and n["rows_dropped"] == n["rows_before"] - r["count"]
    assert sum(n["rows_nonempty"] for n in found.values()) == filled.count()
    plan = dedup.dedup_counts(df, mapped, null_text)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ") + plan.count("LocalTableScan") <= 2 and plan.count("Scan ExistingRDD") <= 1


def carrying_text(df) -> int:
    """Exchanges whose rows hold a text."""
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    plan = df._jdf.queryExecution().explainString(mode)
    return len(re.findall(r"\) Exchange\nInput \[\d+\]: \[[^\]]*\btext#", plan))


def test_reviews_move_their_texts_once(spark, small):
    """Texts went by document, by customer and by order where no side could be broadcast."""
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert carrying_text(registry.raw(spark, small)) == 1
        kept = registry.final(spark, small).select("review_id", "review_text")
        # the text itself, and its digest in the two uses of the survivors
        assert carrying_text(kept) == 3
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_text_keys_are_equal_where_texts_are(spark, small):
    digests = registry.text_keys(spark, small).select("ord", F.col("review_text").alias("key"))
    texts = registry.typed(spark, small).select("ord", F.sha2("review_text", 256).alias("own"))
    both = digests.join(texts, "ord", "full")
    assert both.count() == texts.count()
    assert both.filter(~F.col("key").eqNullSafe(F.col("own"))).count() == 0
