"""Chunks, vectors and search against plain Python and numpy."""

import hashlib
import tempfile

import numpy as np
import pytest
from hypothesis import Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from reviewmill.operators import chunks, ivf, search
from reviewmill.operators.embed import HashingEmbedder, embed_batches, ingest_counts, with_vectors
from reviewmill.operators.vector_table import VectorTable, latest_per_key, merge_latest
from reviewmill.sizes import ADVISORY


def pieces(spark, texts, target=30, overlap=8):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1)
    rows = df.select("i", chunks.chunk_texts(F.col("t"), target, overlap).alias("c")).orderBy("i").collect()
    exploded = chunks.explode_chunks(df, "t", target, overlap).orderBy("i", "chunk_no").collect()
    found = [list(r["c"]) for r in rows]
    assert [(r["i"], r["chunk_text"]) for r in exploded] == [(i, c) for i, cs in enumerate(found) for c in cs if c]
    return found


def test_chunks_of_known_texts(spark):
    found = pieces(spark, [
        None, " \n ", "One. Two!", "Aaaa aaaa aaaa. Bbbb bbbb bbbb? Cc.", "No end  to\tthis sentence at all here",
        "First one here now. Second one here. Third.",
    ])
    assert found[:3] == [[], [], ["One. Two!"]]
    assert found[3] == ["Aaaa aaaa aaaa.", "Aaaa aaaa aaaa. Bbbb bbbb bbbb? Cc."]
    assert found[4][-1].endswith("No end to this sentence at all here"[-38:])
    assert found[5] == ["First one here now.", "First one here now. Second one here. Third."[-38:]]


TEXTS = st.lists(
    st.lists(st.text(alphabet="ab", min_size=1, max_size=6), min_size=1, max_size=20).map(" ".join), min_size=1, max_size=8
).map(lambda sentences: ". ".join(sentences) + ".")


@settings(max_examples=8, deadline=None, phases=[Phase.explicit, Phase.reuse, Phase.generate])
@given(texts=st.lists(TEXTS, min_size=1, max_size=10))
def test_chunk_properties(spark, texts):
    """Bounds, nothing lost, and no two neighbours that would have fitted together."""
    plain = pieces(spark, texts, overlap=0)
    for text, found in zip(texts, pieces(spark, texts)):
        assert all(len(c) <= 38 for c in found)
        assert text.endswith(found[-1][-5:])
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1)
    packed = df.select("i", chunks.chunk_pack(chunks.sentence_split(F.col("t")), 30).alias("c")).orderBy("i").collect()
    for text, row, found in zip(texts, packed, plain):
        done = [c for c in row["c"] if c]
        assert " ".join(done) == text and len(found) == len(row["c"])
        for left, right in zip(done, done[1:]):
            first = right.split(". ")[0].rstrip(".")
            # the very first sentence counts with a blank before it
            assert len(f"{left} {first}.") >= (29 if left == done[0] else 30)


def test_chunk_bounds(spark):
    text = " ".join("word" * (i % 7 + 1) + "." for i in range(800)) + " " + "x" * 5000
    df = spark.createDataFrame([(1, text)], "i int, t string")
    rows = chunks.explode_chunks(df, "t").collect()
    assert all(0 < len(r["chunk_text"]) <= 1440 for r in rows)
    whole = df.select(F.explode(chunks.chunk_texts(F.col("t"), overlap=0, split_long=True)).alias("c"))
    pieces = [r["c"] for r in whole.collect()]
    assert max(map(len, pieces)) < 1200
    assert "".join(pieces).replace(" ", "") == text.replace(" ", "")


def test_long_first_sentence_leaves_no_empty_chunk(spark):
    df = spark.createDataFrame([(1, "y" * 1300 + ". Next one.")], "i int, t string")
    assert [r["chunk_no"] for r in chunks.explode_chunks(df, "t").collect()] == [1, 2]


def test_embedder():
    embedder = HashingEmbedder(32)
    a, b, c = embedder.embed(["Good food", "good  food\n", ""])
    assert np.array_equal(a, b) and abs(np.linalg.norm(a) - 1) < 1e-6 and not c.any()


class Picky(HashingEmbedder):
    def embed(self, texts):
        if any("bad" in t for t in texts):
            raise ValueError("cannot embed")
        return super().embed(texts)


def test_failed_rows_have_no_vector(spark):
    df = spark.createDataFrame([(i, "bad" if i % 10 == 3 else f"text {i}") for i in range(200)], "i int, text string")
    out = embed_batches(df.repartition(3), Picky(16), batch=8)
    assert ingest_counts(out).collect()[0].asDict() == {"indexed": 180, "failed": 20}
    assert out.filter("vector is not null").agg(F.min(F.size("vector"))).first()[0] == 16


def make(spark, n=400, dim=8, seed=5, copies=0):
    rng = np.random.default_rng(seed)
    rows = rng.normal(size=(n, dim)).astype(np.float32)
    if copies:
        rows[:copies] = rows[0]
    docs = spark.createDataFrame(
        [(i, [float(x) for x in v], int(i % 5)) for i, v in enumerate(rows)],
        "vec_id long, embedding array<float>, label int")
    queries = spark.createDataFrame(
        [(f"q{i}", [float(x) for x in rows[i * 3]]) for i in range(20)], "query_id string, query_vector array<float>")
    return rows.astype(np.float64), docs, queries


def truth(rows, q, k, metric, keep=None):
    if metric == "cosine":
        s = rows @ q / np.linalg.norm(rows, axis=1) / np.linalg.norm(q)
    elif metric == "dot":
        s = rows @ q
    else:
        s = -np.sqrt(((rows - q) ** 2).sum(1))
    ids = [i for i in range(len(rows)) if keep is None or keep(i)]
    return sorted(ids, key=lambda i: (-round(s[i], 9), i))[:k]


def ranked(df):
    found = {}
    for r in df.orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append(r["vec_id"])
    return found


@pytest.mark.parametrize("metric", ["cosine", "dot", "l2"])
@pytest.mark.parametrize("parts", [1, 7])
def test_exact_search(spark, metric, parts):
    rows, docs, queries = make(spark)
    got = ranked(search.knn_exact(docs.repartition(parts), queries, 6, metric))
    assert got == {f"q{i}": truth(rows, rows[i * 3], 6, metric) for i in range(20)}


def test_ties_across_batches_go_to_the_smaller_id(spark, monkeypatch):
    rows, docs, queries = make(spark, copies=150)
    got = ranked(search.knn_exact(docs.repartition(5), queries, 6))
    assert got["q0"] == [0, 1, 2, 3, 4, 5]
    assert got == {f"q{i}": truth(rows, rows[i * 3], 6, "cosine") for i in range(20)}


def test_many_blocks_of_queries_read_the_documents_once(spark, tmp_path):
    rows, docs, queries = make(spark)
    docs.repartition(3).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    stored = search.store_queries(queries.coalesce(1), "query_id", "query_vector", 300)
    sizes = [len(ids) for ids, _ in stored.blocks()]
    assert len(sizes) >= 10 and sum(sizes) == 20
    found = search.knn_exact(docs, queries.coalesce(1), 6, block_bytes=300)
    assert ranked(found) == {f"q{i}": truth(rows, rows[i * 3], 6, "cosine") for i in range(20)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1 and plan.count("MapInArrow") == 1 and "Union" not in plan


def test_documents_beyond_one_buffer(spark, monkeypatch):
    _, docs, _ = make(spark)
    batches = docs.coalesce(1).toArrow().to_batches(max_chunksize=50)
    buffers = list(search._buffers(iter(batches), 5000))
    assert len(buffers) > 2 and sum(b.num_rows for b in buffers) == docs.count()


def test_queries_without_a_vector_or_of_other_size(spark):
    rows, docs, queries = make(spark)
    missing = spark.createDataFrame([("none", None)], queries.schema)
    assert "none" not in ranked(search.knn_exact(docs, queries.union(missing), 6))
    assert search.knn_exact(docs, missing, 6).count() == 0
    short = spark.createDataFrame([("short", [1.0])], queries.schema)
    with pytest.raises(ValueError, match="differ in size"):
        search.knn_exact(docs, queries.union(short), 6)


def test_filters(spark):
    rows, docs, queries = make(spark)
    pre = ranked(search.knn_exact(docs, queries, 6, filters={"label": [1, 2]}))
    assert pre == {f"q{i}": truth(rows, rows[i * 3], 6, "cosine", lambda d: d % 5 in (1, 2)) for i in range(20)}
    post = ranked(search.knn_exact(docs, queries, 6, filters={"label": 1}, filter_mode="post"))
    for i in range(20):
        wanted = [d for d in truth(rows, rows[i * 3], 6, "cosine") if d % 5 == 1]
        assert post.get(f"q{i}", []) == wanted


def test_k_above_n_returns_all(spark):
    _, docs, queries = make(spark, n=60)
    assert search.knn_exact(docs, queries, 100).count() == 20 * 60
    assert search.knn_exact(docs, queries.limit(0), 6).count() == 0


def test_wrong_dimensions_are_rejected(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([1.0],), (None,)], "vector array<float>")
    assert search.vector_dim_check(df, 2).first().asDict() == {"ok": 1, "wrong_dim": 2}
    fit, rest = search.split_by_dim(df, 2)
    assert (fit.count(), rest.count()) == (1, 2)


def test_approximate_search(spark):
    rows, docs, queries = make(spark, n=600)
    centres = ivf.train_centres(docs, 12)
    path = tempfile.mkdtemp(prefix="ivf-") + "/index"
    ivf.write_index(ivf.assign_lists(docs, centres), path)
    indexed = ivf.read_index(spark, path)
    assert indexed.count() == 600
    exact = search.knn_exact(docs, queries, 6)
    whole = ivf.knn_approx(indexed, centres, queries, 6, nprobe=12)
    assert ranked(whole) == ranked(exact)
    some = ivf.knn_approx(indexed, centres, queries, 6, nprobe=6)
    assert search.recall_at_k(exact, some, 6).first()["recall"] > 0.7


def test_lists_of_vectors_of_any_length(spark):
    """Directions in clusters, lengths from 0.1 to 10: the lists follow the direction."""
    rng = np.random.default_rng(8)
    middles = rng.normal(size=(16, 12))
    rows = (middles[rng.integers(0, 16, 800)] + 0.2 * rng.normal(size=(800, 12))) * rng.uniform(0.1, 10, (800, 1))
    docs = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rows)], "vec_id long, embedding array<float>")
    queries = docs.filter("vec_id % 20 = 0").select(F.col("vec_id").cast("string").alias("query_id"), F.col("embedding").alias("query_vector"))
    for metric in ("cosine", "l2"):
        centres = ivf.train_centres(docs, 16, metric=metric)
        indexed = ivf.assign_lists(docs, centres, metric=metric)
        found = ivf.knn_approx(indexed, centres, queries, 6, nprobe=4, metric=metric)
        exact = search.knn_exact(docs, queries, 6, metric)
        assert search.recall_at_k(exact, found, 6).first()["recall"] >= 0.85


def test_ties_are_cut_before_the_payload():
    order = np.zeros((500, 40))
    rows, cols = search._first_k(order, np.full(40, -np.inf), search.pa.array(range(499, -1, -1)), 6)
    assert len(rows) == 240 and set(rows.tolist()) == set(range(494, 500))


def test_merge_keeps_the_last_row_per_key(spark):
    schema = "review_id string, text string, seq long"
    batch = spark.createDataFrame([("1", "old", 1), ("1", "new", 2), ("2", "x", 3), (None, "n", 1), (None, "m", 2)], schema)
    assert sorted(r["text"] for r in latest_per_key(batch).collect()) == ["m", "new", "x"]
    stored = spark.createDataFrame([("1", "stored"), ("3", "kept"), (None, "gone")], "review_id string, text string")
    merged = merge_latest(stored, batch).collect()
    assert sorted((r["review_id"] or "", r["text"]) for r in merged) == [("", "m"), ("1", "new"), ("2", "x"), ("3", "kept")]
    with pytest.raises(Exception, match="no seq"):
        latest_per_key(spark.createDataFrame([("1", "x", None)], schema)).collect()


def test_vector_table(spark):
    path = tempfile.mkdtemp(prefix="vectors-") + "/t"
    table = VectorTable(spark, path, dim=8)
    assert table.read().count() == 0 and "vector" in table.read().columns

    def batch(rows):
        df = spark.createDataFrame(rows, "review_id string, text string, seq long")
        return df.withColumns({"location": F.lit("x"), "restaurant_name": F.lit("r"), "rating": F.lit(1.0).cast("float")})

    embedder = Picky(8)
    first = [(f"R-{i}", f"first {i}", i) for i in range(20)] + [("50", "bad text", 1), (None, "no id", 1)]
    assert table.upsert(batch(first), 1, embedder=embedder) == {"indexed": 21, "failed": 1, "replaced": 0}
    second = [("R-3", "second", 1), ("R-3", "third", 2), ("99", "new", 3), ("R-3", "tie", 1), (None, "later", 1)]
    for _ in range(2):
        assert table.upsert(batch(second), 2, embedder=embedder) == {"indexed": 3, "failed": 0, "replaced": 2}
    rows = table.read().collect()
    by_id = {r["review_id"]: r["text"] for r in rows}
    assert len(rows) == len(by_id) == 22
    assert (by_id["R-3"], by_id["99"], by_id["R-4"], by_id[None]) == ("third", "new", "first 4", "later")
    made = with_vectors(batch([("R-4", "with its vector", 1), ("R-5", None, 1)]), embedder)
    assert table.upsert(made, 3) == {"indexed": 1, "failed": 1, "replaced": 0}
    small = table.compact(path + "-small")
    assert small.versions().count() == small.read().count() == 22
    assert {r["review_id"]: r["text"] for r in small.read().collect()}["R-4"] == "with its vector"


@pytest.mark.parametrize("metric", ["cosine", "dot"])
def test_sifted_scores_are_those_of_the_whole_matrix(metric, monkeypatch):
    """Close vectors, copies, zeros and many lengths; few pairs are scored in double precision."""
    rng = np.random.default_rng(3)
    rows = rng.normal(size=(3000, 32)) * 10.0 ** rng.integers(-3, 4, (3000, 1))
    rows[100:140] = rows[5]
    rows[140:180] = rows[6] * (1 + 1e-7 * rng.normal(size=(40, 32)))
    rows[7] = 0
    rows = rows.astype(np.float32)
    asked = np.concatenate([rows[:40], np.zeros((1, 32))]).astype(np.float64)
    docs = search.pa.table({
        "vec_id": search.pa.array(range(len(rows))), "embedding": search.pa.array(list(rows), search.pa.list_(search.pa.float32())),
    })
    monkeypatch.setattr(search, "BATCH_ROWS", 250)
    scored, plain = [], search._Coarse.pairs

    def counted(*args):
        found = plain(*args)
        scored.append(0 if found is None else len(found[0]))
        return found

    monkeypatch.setattr(search._Coarse, "pairs", counted)
    row, query, score, order = search._local_topk(docs, asked, 6, metric, "vec_id", "embedding")
    for i, q in enumerate(asked):
        exact = search.score_matrix(rows.astype(np.float64), q[None], metric)[:, 0]
        wanted = sorted(range(len(rows)), key=lambda d: (-round(exact[d], 9), d))[:6]
        assert row[query == i].tolist() == wanted
        assert np.allclose(score[query == i], exact[wanted], rtol=1e-12, atol=1e-15)
    assert 0 < sum(scored) < rows.shape[0] * len(asked) // 6


def test_a_vector_that_is_not_finite_is_no_hit(spark):
    rows, docs, queries = make(spark)
    broken = spark.createDataFrame([(1000, [float("nan")] * 8, 1)], docs.schema)
    got = ranked(search.knn_exact(docs.union(broken).coalesce(1), queries, 6))
    assert got == {f"q{i}": truth(rows, rows[i * 3], 6, "cosine") for i in range(20)}


def test_tasks_send_neither_texts_nor_long_ids(spark):
    """The shown fields and the questions are joined to the k best; a task's hits are numbers."""
    rows, docs, queries = make(spark)
    docs = docs.withColumn("text", F.concat(F.lit("text of "), "vec_id"))
    long = queries.withColumn("query_id", F.concat(F.lit("x" * 40), "query_id"))
    hits = search.knn_exact(docs.repartition(3), long, 6, keep=("text",))
    assert hits.columns == ["query_id", "rank", "vec_id", "score", "text"]
    found = hits.collect()
    assert all(r["text"] == f"text of {r['vec_id']}" for r in found) and len(found) == 120
    got = {q[40:]: ids for q, ids in ranked(hits).items()}
    assert got == {f"q{i}": truth(rows, rows[i * 3], 6, "cosine") for i in range(20)}
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    sent = next(line for line in plan.splitlines() if "MapInArrow" in line)
    assert "text" not in sent.split(")")[-2] and "_row" in sent and "_query" in sent


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_chunk_pack_splits_a_text_once(spark, small):
    """One expression for all steps split the text and folded it again for every chunk."""
    from __spark_entry__ import queries

    plan = optimized(queries()["chunk_pack"](spark, small))
    assert plan.count("split(") == 1
    assert plan.count("aggregate(") == 1


def test_vectors_are_made_in_even_parts(spark, tmp_path, monkeypatch):
    """Parts of one per core and one more kept all other cores waiting; the session's own size stays."""
    seen = []
    write = VectorTable._write

    def noted(self, rows, version):
        seen.append(spark.conf.get(ADVISORY, None))
        write(self, rows, version)

    monkeypatch.setattr(VectorTable, "_write", noted)
    rows = spark.createDataFrame(
        [("a", 1, "x", "r", 1.0, "one two")],
        "review_id string, seq int, location string, restaurant_name string, rating float, text string",
    )
    store = VectorTable(spark, str(tmp_path / "even"), dim=16)
    assert store.upsert(rows, 1, embedder=HashingEmbedder(16)) == {"indexed": 1, "failed": 0, "replaced": 0}
    assert spark.conf.get(ADVISORY, None) is None
    spark.conf.set(ADVISORY, "32m")
    try:
        store.upsert(rows, 1, embedder=HashingEmbedder(16))
        assert spark.conf.get(ADVISORY, None) == "32m"
    finally:
        spark.conf.unset(ADVISORY)
    assert seen == ["16m", "32m"]


def test_embedder_takes_bucket_and_sign_from_hex_digits():
    words = [f"wört{i}" for i in range(300)]
    for word, row in zip(words, HashingEmbedder(64).embed(words)):
        digest = hashlib.md5(word.encode()).hexdigest()
        assert np.flatnonzero(row).tolist() == [int(digest[:8], 16) % 64]
        assert row.sum() == (1.0 if digest[8] < "8" else -1.0)


def buffer_of(rows, keys):
    kind = search.pa.list_(search.pa.float32())
    return search.pa.table({"vec_id": search.pa.array(keys), "embedding": search.pa.array(list(rows), kind)})


def test_only_the_best_of_a_buffer_are_scored_in_double(monkeypatch):
    """Pairs that a later document of the buffer beats were scored as well, about four times as many."""
    rng = np.random.default_rng(4)
    rows = rng.normal(size=(8000, 32)).astype(np.float32)
    asked = rng.normal(size=(40, 32))
    monkeypatch.setattr(search, "BATCH_ROWS", 250)
    scored, plain = [], np.einsum

    def counted(form, left, right):
        scored.append(len(left))
        return plain(form, left, right)

    monkeypatch.setattr(search.np, "einsum", counted)
    row, query, _, _ = search._local_topk(buffer_of(rows, range(8000)), asked, 6, "cosine", "vec_id", "embedding")
    for i, q in enumerate(asked):
        assert row[query == i].tolist() == truth(rows.astype(np.float64), q, 6, "cosine")
    assert 0 < sum(scored) < 40 * 6 * 1.5


@pytest.mark.parametrize("metric", ["cosine", "dot"])
def test_copies_within_the_bounds_are_not_piled_up(metric, monkeypatch):
    """Thousands of copies are the best of one query; the smallest keys win and few pairs are held."""
    rng = np.random.default_rng(6)
    rows = rng.normal(size=(6000, 32)).astype(np.float32)
    rows[rng.permutation(6000)[:4000]] = rows[0]
    keys = rng.permutation(6000)
    asked = np.concatenate([rows[:1], rng.normal(size=(63, 32))]).astype(np.float64)
    monkeypatch.setattr(search, "BATCH_ROWS", 200)
    held, plain = [], search._Best._raise_bar

    def noted(self):
        plain(self)
        held.append(sum(len(h[0]) for h in self.held))

    monkeypatch.setattr(search._Best, "_raise_bar", noted)
    row, query, _, _ = search._local_topk(buffer_of(rows, keys), asked, 6, metric, "vec_id", "embedding")
    for i, q in enumerate(asked):
        exact = search.score_matrix(rows.astype(np.float64), q[None], metric)[:, 0]
        wanted = sorted(range(6000), key=lambda d: (-round(exact[d], 9), keys[d]))[:6]
        assert row[query == i].tolist() == wanted
    assert max(held) <= 2 * 6 * len(asked)


def test_flags_are_found_at_any_size():
    rng = np.random.default_rng(7)
    for shape in [(1, 1), (3, 7), (64, 64), (100, 33), (257, 129)]:
        able = rng.random(shape) < 0.05
        assert search._flagged(able, able.size).tolist() == np.flatnonzero(able).tolist()
        assert search._flagged(np.ones(shape, bool), able.size // 16) is None
        assert search._flagged(np.zeros(shape, bool), 0).tolist() == []


def test_vectors_are_dealt_out_evenly_and_texts_move_once(spark, tmp_path):
    """Splits of the stored table made the tasks; the shown fields were joined before long ids and moved again."""
    rows, docs, queries = make(spark)
    docs.withColumn("text", F.concat(F.lit("text of "), "vec_id")).repartition(37).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    long = queries.withColumn("query_id", F.concat(F.lit("x" * 40), "query_id"))
    hits = search.knn_exact(docs, long, 6, keep=("text",))
    cores = spark.sparkContext.defaultParallelism
    plan = optimized(hits)
    assert f"], {cores}" in next(line for line in plan.splitlines() if "RepartitionByExpression [_row" in line)
    joins = [line for line in plan.splitlines() if "Join Inner" in line]
    assert [("_row" in j, "_query" in j) for j in joins] == [(True, False), (False, True)]
    assert {q[40:]: ids for q, ids in ranked(hits).items()} == {f"q{i}": truth(rows, rows[i * 3], 6, "cosine") for i in range(20)}
    assert search._even_tasks(spark, 0) == search._even_tasks(spark, 1) == cores
    assert search._even_tasks(spark, cores * search.DOC_BYTES + 1) == 2 * cores


def test_a_single_version_is_read_without_a_join(spark, tmp_path):
    store = VectorTable(spark, str(tmp_path / "lone"), dim=8)
    rows = spark.createDataFrame(
        [(k, 1, "x", "r", 1.0, f"text {k}") for k in ("a", "b", None)],
        "review_id string, seq int, location string, restaurant_name string, rating float, text string",
    )
    store.upsert(rows, 1, embedder=HashingEmbedder(8))
    lone = store.read()
    assert "Join" not in optimized(lone) and "version" not in lone.columns
    assert {r["review_id"]: r["text"] for r in lone.collect()} == {"a": "text a", "b": "text b", None: "text None"}
    store.upsert(rows.filter("review_id = 'a'").withColumn("text", F.lit("new")), 2, embedder=HashingEmbedder(8))
    both = store.read()
    assert "Join" in optimized(both)
    assert {r["review_id"]: r["text"] for r in both.collect()} == {"a": "new", "b": "text b", None: "text None"}
