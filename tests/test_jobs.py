"""The whole job from a folder of files to tables and reports, and the plan shapes."""

import contextlib
import io
import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from reviewmill.catalog import registry
from reviewmill.catalog.files import stage_reviews
from reviewmill.fixture import table
from reviewmill.operators import chunks, dedup, enrich, numbering, search
from reviewmill.operators.embed import HashingEmbedder
from reviewmill.operators.vector_table import VectorTable, distinct_chunks
from reviewmill.plans import jobs, reports


def lines(path):
    out = []
    for name in sorted(os.listdir(path)):
        if name.startswith("part-"):
            with open(os.path.join(path, name), encoding="utf-8") as part:
                out += [json.loads(line) for line in part]
    return out


@pytest.fixture(scope="module")
def run(spark, small):
    raw = stage_reviews(spark, small)
    info = os.path.join(tempfile.mkdtemp(prefix="info-"), "restaurant_info.csv")
    with open(info, "w") as out:
        out.write("Restaurant Name,Address,Avg Stars,Total Reviews\nsrc1,Main St 1,4.5,10\nsrc2,Main St 2,,3\n")
    target = tempfile.mkdtemp(prefix="etl-")
    return jobs.run_etl(spark, raw, target, metadata=info, run_id="r1", at="t1", by="folder")


def test_rows_add_up(spark, small, run):
    status = lines(run.validation_json)
    raw = registry.raw(spark, small).count()
    final = spark.read.parquet(run.final)
    assert sum(r["row_count_raw"] for r in status) == raw
    assert sum(r["row_count_processed"] for r in status) == final.count()
    for row in status:
        assert row["row_count_raw"] - row["row_count_processed"] == row["row_count_mismatch"]
    ids = [r["review_id"] for r in final.select("review_id").orderBy("review_id").collect()]
    assert ids == list(range(1, len(ids) + 1))


def test_final_equals_the_direct_plan(spark, small, run):
    columns = ["gender_norm", "age_group", "ethnicity_norm", "restaurant_name", "customer_name"]
    direct = registry.deduped(spark, small)
    for column in columns:
        a = direct.groupBy(column).count().orderBy(column).collect()
        b = spark.read.parquet(run.final).groupBy(column).count().orderBy(column).collect()
        assert a == b, column


def test_validation_document(spark, run):
    document = {r["source"]: r for r in lines(run.document_json)}
    status = {r["source_file"]: r for r in lines(run.validation_json)}
    assert set(document) == set(status)
    overall = lines(run.status_json)[0]["status"]
    for name, row in document.items():
        assert (row["validation_id"], row["timestamp"], row["overall_status"]) == ("r1", "t1", overall)
        assert row["status"] == status[name]["status"]
        assert row["raw"]["total_rows"] == row["checks"]["row_count_raw"] == status[name]["row_count_raw"]
        assert row["processed"]["total_rows"] == row["checks"]["row_count_processed"]
    listed = {(r["source_file"], r["column"]) for r in lines(run.unmapped_json)}
    counted = {(n, u["column"]) for n, r in document.items() for u in r["warnings"].get("unmapped") or []}
    assert listed == counted


def test_reports(spark, run):
    assert lines(run.status_json)[0]["validation_id"] == "r1"
    bias = lines(run.bias_json)
    rows = spark.read.parquet(run.final).count()
    for column in reports.BIAS_COLUMNS:
        assert sum(r["n"] for r in bias if r["column"] == column) == rows
    assert {r["status"] for r in lines(run.files_json)} == {"ok"}
    final = spark.read.parquet(run.final)
    stars = {r["restaurant_name"]: r["s"] for r in final.groupBy("restaurant_name").agg(F.max("avg_stars").alias("s")).collect()}
    assert stars["src1"] == 4.5 and stars["src2"] is None and stars["src4"] is None
    lost = [r for r in lines(run.loss_json) if r["column"] == "rating_raw"]
    assert any(r["lost"] == r["raw_present"] > 0 for r in lost) and any(r["lost"] == 0 for r in lost)
    snapshot = spark.read.parquet(run.snapshot)
    assert "rating_scale" not in snapshot.columns and "review_length" in snapshot.columns


def test_csv_equals_parquet(spark, run):
    csv = spark.read.csv(
        run.final_csv, header=True, multiLine=True, escape='"')
    parquet = spark.read.parquet(run.final)
    assert csv.count() == parquet.count()
    a = sorted((int(r["review_id"]), r["review_text"]) for r in csv.collect())
    assert a == sorted((r["review_id"], r["review_text"]) for r in parquet.collect())


def test_index_jobs(spark, run):
    final = spark.read.parquet(run.final)
    embedder = HashingEmbedder(32)
    root = tempfile.mkdtemp(prefix="index-")
    counts = jobs.run_row_index(spark, final, f"{root}/rows", 1, embedder)
    with_text = final.filter(F.col("review_text").isNotNull()).count()
    assert (counts["indexed"], counts["failed"]) == (with_text, 0)
    assert VectorTable(spark, f"{root}/rows", dim=32).read().count() == with_text
    counts = jobs.run_chunk_index(final, f"{root}/chunks", embedder)
    jobs.run_chunk_index(final, f"{root}/chunks", embedder)
    assert distinct_chunks(spark.read.parquet(f"{root}/chunks")).count() == counts["indexed"]


def test_search_and_evaluate_stored_vectors(spark):
    root = tempfile.mkdtemp(prefix="answers-")
    rows = [("1", "Fresh bread", "north"), ("2", "cold soup", "north"), ("3", "fresh bread and soup", "south")]
    df = spark.createDataFrame([(i, t, 4.0, p, "r") for i, t, p in rows],
                               "review_id string, review_text string, rating_1_5 double, location string, restaurant_name string")
    jobs.run_row_index(spark, df, f"{root}/vectors", 1)
    questions = spark.createDataFrame([("fresh bread",), ("soup",), ("soup",)], "question string")
    hits = jobs.run_search(questions, f"{root}/vectors", f"{root}/hits", 2).collect()
    assert len(hits) == 4 and {"score", "location", "rating", "restaurant_name", "text"} <= set(hits[0].asDict())
    assert {(r["question"], r["review_id"]) for r in hits if r["rank"] == 1} == {("fresh bread", "1"), ("soup", "2")}
    only = jobs.run_search(questions, f"{root}/vectors", f"{root}/south", 2, {"location": ["south"]}).collect()
    assert {r["review_id"] for r in only} == {"3"}
    gold = spark.createDataFrame([("fresh bread", ["bread", "tea"]), ("soup", ["soup"])], "question string, keywords array<string>")
    summary = jobs.run_evaluate(gold, f"{root}/vectors", f"{root}/scores", 1).first()
    assert (summary["n"], summary["avg_keyword_acc"], summary["p95_ms"]) == (2, 0.75, None)
    assert 0 < summary["avg_semantic_acc"] <= 1


def test_row_index_takes_the_later_review_of_an_id(spark):
    root = tempfile.mkdtemp(prefix="index-")
    rows = [("R-1", "one"), ("R-2", "two"), ("7", "old"), ("7", "new"), ("R-1", " "), (None, "lone"), ("R-1", None)]
    df = spark.createDataFrame([(i, t, 1.0, "x") for i, t in rows], "review_id string, review_text string, rating_1_5 double, location string")
    counts = jobs.run_row_index(spark, df.coalesce(1), f"{root}/rows", 1, HashingEmbedder(16))
    assert counts == {"indexed": 4, "failed": 0, "replaced": 1}
    found = VectorTable(spark, f"{root}/rows", dim=16).read().collect()
    assert {r["review_id"]: r["text"] for r in found} == {"R-1": "one", "R-2": "two", "7": "new", "": "lone"}


def test_a_second_run_leaves_out_sources_that_are_gone(spark):
    root = tempfile.mkdtemp(prefix="rerun-")
    os.makedirs(f"{root}/raw")
    for name in ("a", "b"):
        with open(f"{root}/raw/{name}.csv", "w") as out:
            out.write(f"review_id,review_text,rating\n1,{name} one,3\n2,{name} two,4\n")
    first = jobs.run_etl(spark, f"{root}/raw", f"{root}/out", write_csv=False)
    assert spark.read.parquet(first.final).count() == 4
    os.rename(f"{root}/raw/b.csv", f"{root}/b.csv")
    second = jobs.run_etl(spark, f"{root}/raw", f"{root}/out", write_csv=False)
    texts = [r["review_text"] for r in spark.read.parquet(second.final).orderBy("review_id").collect()]
    assert texts == ["a one", "a two"]


# --- plan shapes -------------------------------------------------------------


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_filter_reaches_the_scan(spark, small):
    text = plan(search.filter_terms(table(spark, small, "documents"), {"lang": ["de"], "source": "src4"}).select("doc_id"))
    assert "PushedFilters: [" in text and "EqualTo(source,src4)" in text
    assert "text" not in text.split("ReadSchema:")[1].split("\n")[0]


def test_small_sides_hash_join(spark, small):
    left = registry.typed(spark, small)
    info = left.select("restaurant_name", F.lit(1.0).alias("avg_stars"), F.lit(1).alias("total_reviews"))
    text = plan(enrich.enrich_left_join(left, info))
    assert "BroadcastHashJoin LeftOuter" in text and "Cartesian" not in text and "NestedLoop" not in text


def test_topk_is_cut_before_the_shuffle(spark, small):
    events = table(spark, small, "events").withColumn("score", F.col("value"))
    assert "WindowGroupLimit" in plan(search.topk_per_query(events, 3, "user_id", "event_id"))


def test_search_has_no_cross_join(spark, small):
    docs = table(spark, small, "embeddings")
    queries = docs.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    text = plan(search.knn_exact(docs, queries))
    assert "Cartesian" not in text and "NestedLoop" not in text and text.count("Exchange hashpartitioning") <= 2


def test_dedup_hash_aggregates_narrow_rows(spark, small):
    text = plan(dedup.first_ordinals(registry.typed(spark, small), ["review_text"]))
    assert "HashAggregate" in text and "SortAggregate" not in text and "Window" not in text


def test_numbering_sends_only_block_counts_to_one_task(spark):
    df = spark.range(100_000).select(F.col("id").alias("ord"), F.lit("s").alias("source_file"), F.lit("x" * 50).alias("text"))
    text = plan(numbering.number_rows(df.filter("ord >= 0"), block_bits=10))
    assert text.count("Exchange SinglePartition") + text.count("Arguments: SinglePartition") == 1


def test_chunk_fold_is_evaluated_once(spark, small):
    text = plan(chunks.explode_chunks(table(spark, small, "documents").select("doc_id", "text"), "text"))
    assert text.count("aggregate(") == 1
