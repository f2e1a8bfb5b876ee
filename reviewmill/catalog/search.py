"""Chunks, vectors, search and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewmill import fixture
from reviewmill.catalog.registry import (
    final, from_final, from_typed, query, r6, typed,
)
from reviewmill.fixture import table
from reviewmill.functions import vectors
from reviewmill.functions.text import SPACE_CLASS, norm_ws
from reviewmill.operators import chunks, ivf
from reviewmill.operators.embed import HashingEmbedder, ingest_counts, with_vectors
from reviewmill.operators.search import knn_exact, recall_at_k, result_projection, vector_dim_check
from reviewmill.operators.vector_table import (
    VectorTable, append_chunks, distinct_chunks, merge_latest,
)
from reviewmill.plans import evaluate, index, jobs
from reviewmill.session import scratch_dir
from reviewmill.sizes import spread

DIM = 256
EMBEDDER = HashingEmbedder(DIM)

# --- chunks ------------------------------------------------------------------


def chunk_ctes(relation: str, key: str, text: str) -> list[str]:
    return [
        f"normal AS (SELECT {key} AS k, trim(regexp_replace({text}, '{SPACE_CLASS}+', ' ', 'g')) AS t FROM {relation})",
        "sents AS (SELECT k, string_split(regexp_replace(t, '([.!?]) +', '\\1' || chr(31), 'g'), chr(31)) "
        "AS sentences FROM normal WHERE t <> '')",
        """folded AS (SELECT k, list_reduce(
          list_transform(sentences, lambda x: {'done': []::VARCHAR[], 'open': x}),
          lambda a, x: CASE WHEN length(a.open) + length(x.open) + 1 < 1200
            THEN {'done': a.done, 'open': a.open || ' ' || x.open}
            ELSE {'done': list_append(a.done, trim(a.open)), 'open': x.open} END,
          {'done': []::VARCHAR[], 'open': ''}) AS st FROM sents)""",
        "packed AS (SELECT k, CASE WHEN st.open <> '' THEN list_append(st.done, trim(st.open)) "
        "ELSE st.done END AS packed FROM folded)",
        """widened AS (SELECT k, list_transform(range(1, len(packed) + 1), lambda i:
          CASE WHEN len(packed) = 1 THEN packed[i] WHEN i = 1 THEN right(packed[i], 1440)
            ELSE right(packed[i - 1] || ' ' || packed[i], 1440) END) AS chunks FROM packed)""",
        """chunked AS (SELECT k, CAST(i - 1 AS INTEGER) AS chunk_no, chunks[i] AS chunk_text
          FROM (SELECT k, chunks, unnest(range(1, len(chunks) + 1)) AS i FROM widened) WHERE chunks[i] <> '')""",
    ]


_DOC_CHUNKS = "WITH " + ",\n".join(chunk_ctes("documents", "doc_id", "text"))


def _documents(spark, sf):
    return spread(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")


@query(
    "sentence_split",
    _DOC_CHUNKS + " SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, sentences[i] AS sentence FROM "
    "(SELECT k AS doc_id, sentences, unnest(range(1, len(sentences) + 1)) AS i FROM sents)",
)
def sentence_split(spark, sf):
    split = chunks.sentence_split(norm_ws(F.col("text")))
    return _documents(spark, sf).select("doc_id", F.posexplode_outer(split).alias("pos", "sentence"))


@query(
    "chunk_pack",
    _DOC_CHUNKS + " SELECT doc_id, CAST(i - 1 AS INTEGER) AS chunk_no, packed[i] AS chunk_text FROM "
    "(SELECT k AS doc_id, packed, unnest(range(1, len(packed) + 1)) AS i FROM packed)",
)
def chunk_pack(spark, sf):
    packed = chunks.packed_chunks(_documents(spark, sf), "text")
    exploded = F.posexplode_outer("_packed").alias("chunk_no", "chunk_text")
    return packed.select("doc_id", exploded).filter("chunk_no IS NOT NULL")


@query("chunk_overlap", _DOC_CHUNKS + " SELECT k AS doc_id, chunk_no, chunk_text FROM chunked")
def chunk_overlap(spark, sf):
    return chunks.explode_chunks(_documents(spark, sf), "text")


@query(
    "chunk_reviews",
    from_final("SELECT CAST(k AS VARCHAR) AS review_id, chunk_no, chunk_text FROM chunked",
               *chunk_ctes("final", "review_id", "review_text")),
)
def chunk_reviews(spark, sf):
    docs = index.chunk_projection(index.filter_nonempty_text(final(spark, sf)))
    return docs.select("review_id", "chunk_no", "chunk_text")


# --- vectors -----------------------------------------------------------------


def sparse_ctes(name: str, relation: str, key: str, text: str, dim: int = DIM) -> list[str]:
    """Non-zero cells of hashed word vectors as (k, b, w)."""
    return [
        f"""{name}_words AS (SELECT k, unnest(string_split(t, ' ')) AS word FROM (
          SELECT {key} AS k, trim(regexp_replace(lower({text}), '{SPACE_CLASS}+', ' ', 'g')) AS t FROM {relation})
          WHERE t <> '')""",
        f"""{name}_cells AS (SELECT k, b, sum(s) AS w FROM (
          SELECT k, ('0x' || substr(md5(word), 1, 8))::BIGINT % {dim} AS b,
            CASE WHEN substr(md5(word), 9, 1) < '8' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS s FROM {name}_words)
          GROUP BY k, b HAVING sum(s) <> 0)""",
        f"""{name} AS (SELECT k, b, CAST(CAST(w / sqrt(sum(w * w) OVER (PARTITION BY k)) AS FLOAT) AS DOUBLE) AS w
          FROM {name}_cells)""",
    ]


def _cells(df, key: str, vector: str):
    cells = df.select(key, F.posexplode(vector).alias("bucket", "weight"))
    return cells.filter("weight <> 0").withColumn("weight", F.round(F.col("weight").cast("double"), 5))


@query(
    "embed_text",
    "WITH " + ",\n".join(sparse_ctes("v", "documents", "doc_id", "text"))
    + " SELECT k AS doc_id, CAST(b AS INTEGER) AS bucket, round(w, 5) AS weight FROM v",
)
def embed_text(spark, sf):
    return _cells(with_vectors(_documents(spark, sf), EMBEDDER), "doc_id", "vector")


@query(
    "embed_batches",
    from_final("SELECT k AS review_id, CAST(b AS INTEGER) AS bucket, round(w, 5) AS weight FROM v",
               "docs AS (SELECT CAST(review_id AS VARCHAR) AS review_id, review_text AS text FROM final)",
               *sparse_ctes("v", "docs", "review_id", "text")),
)
def embed_batches(spark, sf):
    docs = index.embed_projection(final(spark, sf))
    return _cells(index.embed_documents(docs, EMBEDDER, "text", 8), "review_id", "vector")


@query(
    "ingest_counts",
    from_typed("SELECT count(review_text) AS indexed, count(*) - count(review_text) AS failed FROM typed"),
)
def ingest_counts_query(spark, sf):
    """A missing text has no vector and counts as failed."""
    return ingest_counts(with_vectors(typed(spark, sf).select("ord", "review_text"), EMBEDDER, "review_text"))


_PAIRS = "FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"


def _neighbours(spark, sf):
    a = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("a"))
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b"))
    return a.join(b, "vec_id")


@query("cosine", "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) "
       "AS similarity " + _PAIRS)
def cosine(spark, sf):
    return _neighbours(spark, sf).select("vec_id", r6(vectors.cosine(F.col("a"), F.col("b"))).alias("similarity"))


@query("l2_metric", "SELECT a.vec_id, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) "
       "AS distance " + _PAIRS)
def l2_metric(spark, sf):
    return _neighbours(spark, sf).select("vec_id", r6(vectors.l2(F.col("a"), F.col("b"))).alias("distance"))


@query(
    "vector_dim_check",
    "SELECT count(*) FILTER (label NOT IN (3, 5)) AS ok, count(*) FILTER (label IN (3, 5)) AS wrong_dim FROM embeddings",
)
def vector_dim_check_query(spark, sf):
    """Vectors of one label are cut short, those of another are missing."""
    cut = F.when(F.col("label") == 3, F.slice("embedding", 1, 32)).when(F.col("label") != 5, F.col("embedding"))
    return vector_dim_check(table(spark, sf, "embeddings").withColumn("vector", cut), 64)


# --- nearest neighbours ------------------------------------------------------


def _queries(spark, sf):
    """The stated query set: every row whose id is divisible by 20, against all rows."""
    return table(spark, sf, "embeddings").where("vec_id % 20 = 0").select(
        F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector")
    )


def _docs(spark, sf):
    return table(spark, sf, "embeddings")


def knn_sql(score: str, k: int = 6, where: str = "true", descending: bool = True) -> str:
    order = "DESC" if descending else "ASC"
    return f"""SELECT query_id, vec_id, rank, score FROM (
      SELECT query_id, vec_id, round(s, 6) AS score,
        CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) {order}, vec_id) AS INTEGER) AS rank
      FROM (SELECT q.vec_id AS query_id, d.vec_id, {score} AS s FROM embeddings q, embeddings d
        WHERE q.vec_id % 20 = 0 AND {where}))
      WHERE rank <= {k}"""


_COSINE = "list_cosine_similarity(q.embedding::DOUBLE[], d.embedding::DOUBLE[])"
_DOT = "list_dot_product(q.embedding::DOUBLE[], d.embedding::DOUBLE[])"
_L2 = "list_distance(q.embedding::DOUBLE[], d.embedding::DOUBLE[])"


def _hits(df):
    return df.select("query_id", "vec_id", "rank", r6("score").alias("score"))


@query("knn_exact", knn_sql(_COSINE))
def knn_exact_query(spark, sf):
    return _hits(knn_exact(_docs(spark, sf), _queries(spark, sf)))


@query("knn_cross", knn_sql(_DOT, 5))
def knn_cross(spark, sf):
    """Every query against every document by dot product; no pair leaves its task but the best."""
    return _hits(knn_exact(_docs(spark, sf), _queries(spark, sf), k=5, metric="dot"))


@query("knn_l2", knn_sql(_L2, descending=False))
def knn_l2(spark, sf):
    return _hits(knn_exact(_docs(spark, sf), _queries(spark, sf), metric="l2"))


@query("knn_filtered", knn_sql(_COSINE, where="d.label IN (1, 2, 3)"))
def knn_filtered(spark, sf):
    return _hits(knn_exact(_docs(spark, sf), _queries(spark, sf), filters={"label": [1, 2, 3]}))


@query(
    "knn_filtered_post",
    f"SELECT h.* FROM ({knn_sql(_COSINE)}) h JOIN embeddings d USING (vec_id) WHERE d.label = 4",
)
def knn_filtered_post(spark, sf):
    return _hits(knn_exact(_docs(spark, sf), _queries(spark, sf), filters={"label": 4}, filter_mode="post"))


def _index(spark, sf, lists):
    centres = ivf.train_centres(_docs(spark, sf), lists)
    path = scratch_dir(spark, "ivf")
    ivf.write_index(ivf.assign_lists(_docs(spark, sf), centres), path)
    return ivf.read_index(spark, path), centres


@query("knn_approx")
def knn_approx(spark, sf):
    """k-means centres depend on the engine, so there is no SQL twin; recall is reported below."""
    indexed, centres = _index(spark, sf, 16)
    return _hits(ivf.knn_approx(indexed, centres, _queries(spark, sf), nprobe=8))


@query("knn_approx_all_lists", knn_sql(_COSINE))
def knn_approx_all_lists(spark, sf):
    """With every list probed the approximate search is exact."""
    indexed, centres = _index(spark, sf, 8)
    return _hits(ivf.knn_approx(indexed, centres, _queries(spark, sf), nprobe=8))


@query("knn_approx_recall")
def knn_approx_recall(spark, sf):
    indexed, centres = _index(spark, sf, 16)
    found = ivf.knn_approx(indexed, centres, _queries(spark, sf), nprobe=8)
    return recall_at_k(knn_exact(_docs(spark, sf), _queries(spark, sf)), found, 6)


@query(
    "recall_at_k",
    f"""SELECT round(avg(r), 6) AS recall, count(*) AS queries FROM (
      SELECT e.query_id, count(f.vec_id) / 6.0 AS r FROM ({knn_sql(_COSINE)}) e
      LEFT JOIN ({knn_sql(_COSINE, where="d.label <= 4")}) f USING (query_id, vec_id) GROUP BY 1)""",
)
def recall(spark, sf):
    """Recall of a search that sees only half of the labels."""
    exact = knn_exact(_docs(spark, sf), _queries(spark, sf))
    part = knn_exact(_docs(spark, sf), _queries(spark, sf), filters={"label": [0, 1, 2, 3, 4]})
    return recall_at_k(exact, part, 6).select(r6("recall").alias("recall"), "queries")


# --- the vector table --------------------------------------------------------

# Ids that are no numbers, missing ones, and every tenth repeated.
_ID = "CASE WHEN ord % 17 = 0 THEN NULL WHEN ord % 4 = 0 THEN 'R-' || review_id ELSE review_id END"
_KEYED = f"""keyed AS (SELECT {_ID} AS review_id, ord, location, review_text AS text FROM typed WHERE review_text IS NOT NULL),
  newest AS (SELECT * FROM keyed QUALIFY row_number() OVER (PARTITION BY review_id, location = 'en' ORDER BY ord DESC) = 1),
  stored AS (SELECT * FROM newest n WHERE location = 'en'
    OR NOT EXISTS (SELECT 1 FROM newest m WHERE m.review_id IS NOT DISTINCT FROM n.review_id AND m.location = 'en'))"""


def _batches(spark, sf):
    docs = typed(spark, sf).filter(F.col("review_text").isNotNull()).select(
        F.expr(_ID).alias("review_id"), "ord", "location", F.col("review_text").alias("text")
    )
    return docs.filter("location <> 'en'"), docs.filter("location = 'en'")


@query("merge_latest", from_typed("SELECT review_id, location, text FROM stored", _KEYED))
def merge(spark, sf):
    first, second = _batches(spark, sf)
    empty = first.drop("ord").limit(0)
    return merge_latest(merge_latest(empty, first, seq="ord"), second, seq="ord")


def _upserted(spark, sf) -> VectorTable:
    store = VectorTable(spark, scratch_dir(spark, "vectors"), dim=DIM)
    for version, batch in enumerate(_batches(spark, sf)):
        docs = batch.withColumns({"restaurant_name": F.lit(None).cast("string"), "rating": F.lit(0).cast("float")})
        store.upsert(docs, version, seq="ord", embedder=EMBEDDER)
        store.upsert(docs, version, seq="ord", embedder=EMBEDDER)
    return store


@query("vector_upsert", from_typed(f"SELECT review_id, location, text, {DIM} AS dim FROM stored", _KEYED))
def vector_upsert(spark, sf):
    """Two batches, each applied twice; a batch applied again replaces itself."""
    rows = _upserted(spark, sf).read()
    return rows.select("review_id", "location", "text", F.size("vector").alias("dim"))


@query(
    "index_schema",
    from_typed("""SELECT field, type, (SELECT count(*) FROM stored) AS n_rows FROM (VALUES ('review_id', 'string'),
      ('location', 'string'), ('restaurant_name', 'string'), ('rating', 'float'), ('text', 'string'),
      ('vector', 'array<float>')) AS t(field, type)""", _KEYED),
)
def index_schema(spark, sf):
    """Fields of the stored table beside its row count."""
    rows = _upserted(spark, sf).read()
    fields = F.array(*[F.struct(F.lit(n).alias("field"), F.lit(t).alias("type")) for n, t in rows.dtypes])
    counted = rows.agg(F.count(F.lit(1)).alias("n_rows"))
    return counted.select(F.inline(fields), "n_rows")


@query(
    "vector_append",
    from_final("SELECT CAST(k AS VARCHAR) AS review_id, chunk_no, chunk_text FROM chunked",
               *chunk_ctes("final", "review_id", "review_text")),
)
def vector_append(spark, sf):
    """Chunk documents appended twice and read as one row per chunk."""
    path = scratch_dir(spark, "chunks")
    docs = index.chunk_projection(index.filter_nonempty_text(final(spark, sf)))
    vectors_of = index.embed_documents(docs, EMBEDDER, "chunk_text")
    append_chunks(vectors_of, path)
    append_chunks(vectors_of, path)
    return distinct_chunks(spark.read.parquet(path)).select("review_id", "chunk_no", "chunk_text")


# --- questions and answers ---------------------------------------------------

# An answer is an assistant turn; its question is the user turn before it.
ANSWERS = """
  SELECT q.text AS question, a.text AS answer, CAST(length(a.text) AS DOUBLE) * 1.5 AS ms,
         a.conv_id AS conv_id, a.turn AS turn
  FROM {conversations} a JOIN {conversations} q ON q.conv_id = a.conv_id AND q.turn = a.turn - 1
  WHERE a.role = 'assistant' AND q.role = 'user'
"""
# The gold keywords of a question are its own words.
GOLD_SQL = """
  SELECT text AS question, list_filter(string_split(regexp_replace(text, '[^a-zA-Z ]+', ' ', 'g'), ' '),
    lambda w: length(w) >= 2) AS keywords
  FROM (SELECT DISTINCT text FROM conversations WHERE role = 'user')
"""
_ANSWERED = [
    "answers AS (" + fixture.plain(ANSWERS) + ")",
    "gold AS (" + GOLD_SQL + ")",
    """scored AS (SELECT a.*, g.keywords, g.question IS NOT NULL AS known,
      CAST(len(list_filter(coalesce(g.keywords, []), lambda w: contains(lower(a.answer), lower(w)))) AS DOUBLE)
        / greatest(len(coalesce(g.keywords, [])), 1) AS keyword_acc
      FROM answers a LEFT JOIN gold g USING (question))""",
]


def _answers(spark, sf):
    return fixture.from_sql(spark, sf, ANSWERS)


def _gold(spark, sf):
    asked = table(spark, sf, "conversations").filter("role = 'user'")
    words = F.split(F.regexp_replace("text", "[^a-zA-Z ]+", " "), " ")
    long = F.filter(words, lambda w: F.length(w) >= 2)
    return asked.select("text").distinct().select(F.col("text").alias("question"), long.alias("keywords"))


@query("gold_table", "SELECT question, array_to_string(keywords, ' ') AS keywords FROM (" + GOLD_SQL + ")")
def gold_table(spark, sf):
    return _gold(spark, sf).withColumn("keywords", F.array_join("keywords", " "))


_WITH_ANSWERS = "WITH " + ",\n".join(_ANSWERED)


@query(
    "gold_join",
    _WITH_ANSWERS + " SELECT conv_id, turn, coalesce(len(keywords), 0) AS n_keywords, known FROM scored",
)
def gold_join(spark, sf):
    joined = evaluate.gold_join(_answers(spark, sf), _gold(spark, sf))
    size = F.coalesce(F.size("keywords"), F.lit(0)).cast("long")
    return joined.select("conv_id", "turn", size.alias("n_keywords"), F.col("keywords").isNotNull().alias("known"))


@query("keyword_accuracy", _WITH_ANSWERS + " SELECT conv_id, turn, round(keyword_acc, 6) AS keyword_acc FROM scored")
def keyword_accuracy(spark, sf):
    scored = evaluate.score_keywords(_answers(spark, sf), _gold(spark, sf))
    return scored.select("conv_id", "turn", r6("keyword_acc").alias("keyword_acc"))


_SEMANTIC = [
    "expected AS (SELECT question, array_to_string(keywords, ' ') AS gold_text FROM gold)",
    *sparse_ctes("gv", "expected", "question", "gold_text"),
    "texts AS (SELECT conv_id * 1000 + turn AS id, answer FROM answers)",
    *sparse_ctes("av", "texts", "id", "answer"),
    "gn AS (SELECT k, sqrt(sum(w * w)) AS n FROM gv GROUP BY k)",
    "an AS (SELECT k, sqrt(sum(w * w)) AS n FROM av GROUP BY k)",
    "dots AS (SELECT s.conv_id, s.turn, sum(gv.w * av.w) AS d FROM scored s JOIN gv ON gv.k = s.question "
    "JOIN av ON av.k = s.conv_id * 1000 + s.turn AND av.b = gv.b GROUP BY 1, 2)",
    """semantic AS (SELECT s.*, CASE WHEN known THEN coalesce(d / gn.n / an.n, 0.0) END AS semantic_acc
      FROM scored s LEFT JOIN dots USING (conv_id, turn) LEFT JOIN gn ON gn.k = s.question
      LEFT JOIN an ON an.k = s.conv_id * 1000 + s.turn)""",
]


@query(
    "semantic_accuracy",
    "WITH " + ",\n".join(_ANSWERED + _SEMANTIC) + " SELECT conv_id, turn, round(semantic_acc, 5) AS semantic_acc FROM semantic",
)
def semantic_accuracy(spark, sf):
    scored = evaluate.score_semantic(_answers(spark, sf), _gold(spark, sf), EMBEDDER)
    return scored.select("conv_id", "turn", F.round("semantic_acc", 5).alias("semantic_acc"))


@query(
    "p95_rank",
    """SELECT count(*) AS n, (SELECT round(value, 6) FROM (SELECT value, row_number() OVER (ORDER BY value) AS place
      FROM events) WHERE place = greatest(1, floor((SELECT count(*) FROM events) * 0.95))) AS p95_ms FROM events""",
)
def p95_rank(spark, sf):
    events = table(spark, sf, "events")
    p95 = evaluate.p95_value(events, "value")
    return events.agg(F.count("value").alias("n")).withColumn("p95_ms", r6(F.lit(p95)))


_P95 = ("(SELECT round_even(ms, 1) FROM (SELECT ms, row_number() OVER (ORDER BY ms) AS place FROM {0}) "
        "WHERE place = greatest(1, floor((SELECT count(*) FROM {0}) * 0.95)))")


@query(
    "eval_summary",
    "WITH " + ",\n".join(_ANSWERED + _SEMANTIC) + f""" SELECT count(*) AS n, {_P95.format('semantic')} AS p95_ms,
      round_even(avg(keyword_acc), 3) AS avg_keyword_acc, round_even(avg(semantic_acc), 3) AS avg_semantic_acc
      FROM semantic""",
)
def eval_summary(spark, sf):
    return evaluate.run_eval(_answers(spark, sf), _gold(spark, sf), EMBEDDER)


_SEARCH = [
    "docs AS (SELECT CAST(review_id AS VARCHAR) AS review_id, restaurant_name, review_text AS text FROM final "
    "WHERE review_text IS NOT NULL)",
    "questions AS (SELECT DISTINCT text AS question FROM conversations WHERE role = 'user')",
    *sparse_ctes("dv", "docs", "review_id", "text"),
    *sparse_ctes("qv", "questions", "question", "question"),
    "dn AS (SELECT k, sqrt(sum(w * w)) AS n FROM dv GROUP BY k)",
    "qn AS (SELECT k, sqrt(sum(w * w)) AS n FROM qv GROUP BY k)",
    "dots AS (SELECT qv.k AS question, dv.k AS review_id, sum(qv.w * dv.w) AS d FROM qv JOIN dv USING (b) GROUP BY 1, 2)",
    """hits AS (SELECT q.question, d.review_id, d.restaurant_name, d.text,
        coalesce(x.d / qn.n / dn.n, 0.0) AS score,
        CAST(row_number() OVER (PARTITION BY q.question ORDER BY round(coalesce(x.d / qn.n / dn.n, 0.0), 9) DESC, d.review_id) AS INTEGER) AS rank
      FROM questions q CROSS JOIN docs d LEFT JOIN dots x ON x.question = q.question AND x.review_id = d.review_id
      LEFT JOIN qn ON qn.k = q.question LEFT JOIN dn ON dn.k = d.review_id
      QUALIFY rank <= 5)""",
]


def _searched(spark, sf, **options):
    docs = with_vectors(index.embed_projection(final(spark, sf)), EMBEDDER)
    asked = table(spark, sf, "conversations").filter("role = 'user'")
    questions = asked.select(F.col("text").alias("question")).distinct()
    return questions, evaluate.search(questions, docs, EMBEDDER, **options)


@query("search_questions", from_final("SELECT question, rank, review_id, round(score, 5) AS score FROM hits", *_SEARCH))
def search_questions(spark, sf):
    _, hits = _searched(spark, sf, keep=())  # the texts are not shown
    return hits.select("question", "rank", "review_id", F.round("score", 5).alias("score"))


@query("search_stored", from_final(
    "SELECT question, rank, h.review_id, location, h.restaurant_name, rating, h.text, round(score, 5) AS score FROM hits h "
    "JOIN (SELECT CAST(review_id AS VARCHAR) AS review_id, coalesce(location, '') AS location, "
    "round(CAST(coalesce(rating_1_5, 0.0) AS FLOAT), 4) AS rating FROM final) USING (review_id)", *_SEARCH))
def search_stored(spark, sf):
    """Vectors stored by one job, questions answered by another: score and all stored fields."""
    path = scratch_dir(spark, "vectors")
    jobs.run_row_index(spark, final(spark, sf), path, 1, EMBEDDER)
    questions = table(spark, sf, "conversations").filter("role = 'user'").select(F.col("text").alias("question"))
    hits = jobs.run_search(questions, path, scratch_dir(spark, "hits"), embedder=EMBEDDER)
    return hits.select(
        "question", "rank", "review_id", "location", "restaurant_name", F.round("rating", 4).alias("rating"), "text",
        F.round("score", 5).alias("score"),
    )


@query("result_projection", from_final("SELECT review_id, restaurant_name, text FROM hits", *_SEARCH))
def result_projection_query(spark, sf):
    _, hits = _searched(spark, sf)
    return result_projection(hits)


@query(
    "answer_log",
    from_final("""SELECT question, string_agg(text, chr(10) ORDER BY rank) AS answer,
      string_agg(review_id, ',' ORDER BY rank) AS refs FROM hits GROUP BY 1""", *_SEARCH),
)
def answer_log(spark, sf):
    log = evaluate.answer_log(*_searched(spark, sf))
    return log.select("question", "answer", F.array_join("refs", ",").alias("refs"))


@query(
    "answer_assembly",
    f"""SELECT conv_id, trim(regexp_replace(string_agg(text, '' ORDER BY turn),
      '^{SPACE_CLASS}+|{SPACE_CLASS}+$', '', 'g')) AS answer FROM conversations WHERE role = 'assistant' GROUP BY 1""",
)
def answer_assembly(spark, sf):
    pieces = table(spark, sf, "conversations").filter("role = 'assistant'")
    return evaluate.assemble_answers(pieces)


