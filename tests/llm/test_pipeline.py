"""The registered queries and the pipeline."""

import hashlib

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from reviewmill.llm import common, queries
from tests.compare import compare, connect


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, small, con, name):
    df = queries.QUERIES[name](spark, small)
    if name in queries.ORACLES:
        assert compare(df, con, queries.ORACLES[name]) == []
    else:
        assert df.count() > 0


def stages(spark, docs, sf_dir):
    out = []
    for name, stage in corpus_pipeline.STAGES:
        docs = common.stored(stage(spark, docs, sf_dir), name)
        out.append(docs)
    return out


def test_pipeline(spark, small):
    docs = queries.table(spark, small, "documents")
    calm, apart, clean, private, last = stages(spark, docs, small)
    assert calm.schema == apart.schema == clean.schema == private.schema == docs.schema

    toxic = {r["doc_id"] for r in queries.op1_toxicity(spark, small).where("predicted = 1").collect()}
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    assert ids(calm) == ids(docs) - toxic and toxic
    assert ids(apart) < ids(calm)
    assert ids(clean) < ids(apart) and ids(private) == ids(clean) == ids(last)
    changed = private.join(clean.withColumnRenamed("text", "old"), "doc_id").where(F.col("text") != F.col("old"))
    assert changed.count() > 0
    library = Tokenizer.from_file(queries.byte_bpe())
    texts = {r["doc_id"]: r["text"] for r in private.collect()}
    for r in last.collect():
        found = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids"]) == (len(found), found)
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
    assert sorted(map(str, corpus_pipeline.run(spark, small).collect())) == sorted(map(str, last.collect()))


def test_pipeline_with_odd_rows(spark, small):
    """Nulls, repeated rows, clashing columns, and no rows at all."""
    docs = queries.table(spark, small, "documents").limit(30)
    odd = spark.createDataFrame(
        [(None, "lone text", None, None, None), (-1, None, "en", "s", 0), (-2, "", "en", "s", 0), (-2, "", "en", "s", 0),
         (-3, "twice the same", "en", "s", 1), (-3, "twice the same", "en", "s", 1)], docs.schema)
    more = docs.union(odd)
    for extra in ("score", "n_values", "benchmark_n_words", "kept_id", "n_hit"):
        more = more.withColumn(extra, F.lit("own"))
    kept = stages(spark, more, small)[3]
    assert kept.columns == more.columns
    assert kept.where(" and ".join(f"{c} = 'own'" for c in more.columns[5:])).count() == kept.count()
    ids = [r["doc_id"] for r in kept.collect()]
    assert {None, -1, -2, -3} <= set(ids) and ids.count(-2) == 2 and ids.count(-3) == 1
    assert stages(spark, docs.limit(0), small)[-1].collect() == []


def test_near_copies_are_dropped_by_row(spark, small):
    """Ids that stand on several texts or are null, and blank rows."""
    docs = queries.table(spark, small, "documents")
    long, lone, far = "a b c d e f g h i j k", "one two three four five six seven", "red green blue white black grey"
    rows = [(3, long, "en", "s", 1), (7, long, "en", "s", 1), (7, lone, "en", "s", 1), (None, long, "en", "s", 1),
            (None, far, "en", "s", 1), (None, far, "de", "s", 1), (9, "", "en", "s", 0), (9, "", "de", "s", 0)]
    kept = corpus_pipeline.without_near_copies(spark, spark.createDataFrame(rows, docs.schema), small)
    assert kept.columns == docs.columns
    found = sorted((str(r["doc_id"]), r["text"]) for r in kept.collect())
    assert found == sorted([("3", long), ("7", lone), ("None", far), ("9", ""), ("9", "")])
