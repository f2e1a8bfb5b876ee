"""Scoring of answers, request parsing, answer assembly."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewmill.fixed import SERVICE_K
from reviewmill.functions.numbers import round_even
from reviewmill.functions.vectors import cosine
from reviewmill.operators.embed import Embedder, with_vectors
from reviewmill.operators.quantiles import ACCURACY, Spot, exact_quantiles
from reviewmill.operators.search import knn_exact
from reviewmill.sizes import broadcast_if_small


def gold_table(spark: SparkSession, gold: Mapping[str, list[str]]) -> DataFrame:
    """Questions with the words that a good answer has."""
    return spark.createDataFrame(list(gold.items()), "question string, keywords array<string>")


def gold_join(answers: DataFrame, gold: DataFrame) -> DataFrame:
    """Answers with the keywords of their question; null for an unknown question."""
    return answers.join(broadcast_if_small(gold), "question", "left")


def keyword_accuracy(answer: Column, keywords: Column) -> Column:
    """Share of keywords that occur in the answer, case-insensitive; no keywords give 0."""
    words = F.coalesce(keywords, F.array().cast("array<string>"))
    hits = F.filter(words, lambda k: F.contains(F.lower(answer), F.lower(k)))
    return F.size(hits) / F.greatest(F.size(words), F.lit(1))


def score_keywords(answers: DataFrame, gold: DataFrame) -> DataFrame:
    joined = gold_join(answers, gold)
    return joined.withColumn("keyword_acc", keyword_accuracy(F.col("answer"), F.col("keywords")))


def score_semantic(answers: DataFrame, gold: DataFrame, embedder: Embedder) -> DataFrame:
    """Cosine of the embedded keywords and the embedded answer; null for an unknown question."""
    expected = with_vectors(
        gold.withColumn("gold_text", F.array_join("keywords", " ")),
        embedder, "gold_text", "gold_vector",
    ).select("question", "gold_vector")
    joined = answers.join(broadcast_if_small(expected), "question", "left")
    scored = with_vectors(joined, embedder, "answer", "answer_vector")
    similarity = cosine(F.col("gold_vector"), F.col("answer_vector"))
    return scored.withColumn(
        "semantic_acc", F.when(F.col("gold_vector").isNotNull(), similarity)
    ).drop("gold_vector", "answer_vector")


def p95_rank(n: int) -> int:
    """1-based rank of the latency reported as p95; not the ceiling that percentiles use."""
    return max(1, int(n * 0.95))


def p95_value(df: DataFrame, column: str, accuracy: int = ACCURACY) -> Column:
    """The value at ``p95_rank``, to be used in another frame; null without any value."""
    spot = Spot(0.95, lambda n: F.greatest(F.floor(n * F.lit(0.95)), F.lit(1)) - 1)
    return exact_quantiles(df, [column], [spot], accuracy).select(F.get("values", F.lit(0))).scalar()


def eval_summary(scored: DataFrame, p95: Column | float | None) -> DataFrame:
    """Questions, p95 latency and mean scores; no questions give nulls."""
    semantic = F.avg("semantic_acc") if "semantic_acc" in scored.columns else F.lit(None)
    return scored.agg(
        F.count(F.lit(1)).alias("n"),
        round_even(F.lit(p95).cast("double"), 1).alias("p95_ms"),
        round_even(F.avg("keyword_acc"), 3).alias("avg_keyword_acc"),
        round_even(semantic.cast("double"), 3).alias("avg_semantic_acc"),
    )


def run_eval(answers: DataFrame, gold: DataFrame, embedder: Embedder) -> DataFrame:
    """Score a log of answers (question, answer, ms).

    The latency comes from the log itself: the scored rows would be embedded again for it.
    """
    scored = score_semantic(score_keywords(answers, gold), gold, embedder)
    return eval_summary(scored, p95_value(answers, "ms"))


def search(
    questions: DataFrame, docs: DataFrame, embedder: Embedder, k: int = SERVICE_K,
    key: str = "review_id", vector: str = "vector", keep=("restaurant_name", "text"), **options,
) -> DataFrame:
    """k nearest documents of every question, in one job. Needs ``question``."""
    queries = with_vectors(
        questions.select("question").distinct(), embedder, "question", "query_vector"
    )
    return knn_exact(
        docs, queries, k=k, key=key, vector=vector, query="question", keep=keep, **options
    )


def answer_log(questions: DataFrame, hits: DataFrame, key: str = "review_id") -> DataFrame:
    """One row per question: the passages in rank order as the answer, their ids as references.

    A question has at most k hits, so the lists are bounded.
    """
    ordered = F.sort_array(F.collect_list(F.struct("rank", "text", key)))
    found = hits.groupBy("question").agg(ordered.alias("found"))
    answers = found.select(
        "question",
        F.array_join(F.transform("found", lambda h: h["text"]), "\n").alias("answer"),
        F.transform("found", lambda h: h[key]).alias("refs"),
    )
    logged = questions.join(answers, "question", "left")
    return logged.withColumns(
        {
            "answer": F.coalesce("answer", F.lit("")),
            "refs": F.coalesce("refs", F.array().cast("array<string>")),
        }
    )


def request_query(request: Column) -> Column:
    """The query text of a JSON request: body.query, body.q, query, q; the first not empty.

    ``body`` may be an object or a string that holds JSON; a broken body counts as empty.
    """
    body = F.get_json_object(request, "$.body")
    found = [
        F.get_json_object(body, "$.query"),
        F.get_json_object(body, "$.q"),
        F.get_json_object(request, "$.query"),
        F.get_json_object(request, "$.q"),
    ]
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in found])


def parse_requests(requests: DataFrame, request: str = "request") -> DataFrame:
    """Adds ``query`` and the flag ``missing_query``."""
    parsed = requests.withColumn("query", request_query(F.col(request)))
    return parsed.withColumn("missing_query", F.col("query").isNull())


def assemble_answers(
    events: DataFrame, conversation: str = "conv_id", seq: str = "turn", text: str = "text",
    refs: str | None = None,
) -> DataFrame:
    """Streamed pieces joined in order to one trimmed answer per conversation.

    ``refs`` names a column of references, of which the last present one is kept.
    """
    piece = F.struct(F.col(seq).alias("seq"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    wanted = [F.array_sort(F.collect_list(piece)).alias("_pieces")]
    if refs:
        last = F.max_by(refs, F.when(F.col(refs).isNotNull(), F.col(seq)))
        wanted.append(last.alias("references"))
    joined = F.array_join(F.transform("_pieces", lambda p: p["text"]), "")
    space = r"[\s\x1c-\x1f]+"
    trimmed = F.regexp_replace(joined, f"(?U)^{space}|{space}$", "")
    return events.groupBy(conversation).agg(*wanted).withColumn("answer", trimmed).drop("_pieces")
