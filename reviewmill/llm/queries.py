"""The registered queries of the operators and, where SQL can express one, its DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewmill.llm import (
    ann, bpe, common, decontaminate, lm, near_dup, phrases, pii, resample, sharding, substring, token_counts,
    toxicity, warc,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with its SQL twin if there is one."""

    def add(run):
        QUERIES[run.__name__] = run
        if sql is not None:
            ORACLES[run.__name__] = sql.strip()
        return run

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- pieces of SQL -----------------------------------------------------------

WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FOLDED = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"


def crc_sql(text: str) -> str:
    """crc32 of ASCII text, bit by bit."""
    return f"""xor(list_reduce(list_concat([4294967295::BIGINT],
      list_transform(string_split({text}, ''), lambda ch: ascii(ch)::BIGINT)),
      lambda sum, byte: list_reduce(list_concat([xor(sum, byte)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
        lambda acc, step: xor(acc >> 1, (acc & 1) * 3988292384))), 4294967295)"""


# --- 1: toxicity ------------------------------------------------------------

TOXIC = 0.3


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.Model:
    trained = common.crc_mod(F.col("doc_id"), 4) != 2
    return toxicity.fit(docs, table(spark, sf_dir, "labels"), trained)


@query()
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.add_score(docs, toxicity_model(spark, docs, sf_dir))
    return scored.select(
        "doc_id", (common.crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "score",
        (F.col("score") >= TOXIC).cast("int").alias("predicted"),
    )


# --- 2: near-duplicates ------------------------------------------------------


@query(rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({FOLDED}, '{WORD}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS shingle FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared
  FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
  WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
r AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.other = e.a),
m AS (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM m LEFT JOIN n USING (doc_id)""")
def op2_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


# --- 3: BPE ------------------------------------------------------------------


def byte_bpe() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


def coded(docs: DataFrame) -> DataFrame:
    """Documents with ``ids`` and ``decoded``."""
    return bpe.decode(bpe.encode(docs, byte_bpe()), byte_bpe())


@query()
def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = coded(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", *bpe_digests())


def bpe_digests() -> list:
    return [
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    ]


# --- 4: sharding -------------------------------------------------------------


@query()
def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.assign_shards(table(spark, sf_dir, "documents"), 24)
    return found.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


# --- 5: token counts ---------------------------------------------------------


@query()
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = token_counts.count_tokens(docs, public_tokenizers.path("word_bpe_49k.json"))
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))


# --- 6: substring dedup ------------------------------------------------------


@query(rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS pos FROM d),
m AS (SELECT doc_id, pos, w[pos] AS word,
        CASE WHEN pos + 19 <= len(w) THEN array_to_string(w[pos:pos + 19], ' ') END AS passage FROM p),
r AS (SELECT doc_id, pos, word, passage IS NOT NULL
        AND row_number() OVER (PARTITION BY passage ORDER BY doc_id, pos) > 1 AS again FROM m),
g AS (SELECT doc_id, pos, word, max(again) OVER
        (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM r),
k AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed,
        string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone) AS kept FROM g GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed,
  sha256(coalesce(kept, '')) AS kept_sha256
FROM documents LEFT JOIN k USING (doc_id)""")
def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


# --- 7: language-model scores ------------------------------------------------


@query(rf"""
WITH d AS (SELECT doc_id, {crc_sql('doc_id::VARCHAR')} % 7 = 2 AS held_out,
  list_concat(regexp_extract_all({FOLDED}, '{WORD}'), [' ']) AS w FROM documents),
t AS (SELECT doc_id, held_out, unnest(w) AS v, unnest(list_concat(['  '], w[:-2])) AS u,
  unnest(list_concat([NULL, '  '], w[:-3])[:len(w)]) AS t FROM d),
one AS (SELECT v, count(*) AS c FROM t WHERE NOT held_out GROUP BY v),
two AS (SELECT u, v, count(*) AS c FROM t WHERE NOT held_out GROUP BY u, v),
ctx AS (SELECT u, sum(c) AS c FROM two GROUP BY u),
three AS (SELECT t, u, v, count(*) AS c FROM t WHERE NOT held_out AND t IS NOT NULL GROUP BY t, u, v),
ctx2 AS (SELECT t, u, sum(c) AS c FROM three GROUP BY t, u),
n AS (SELECT coalesce(sum(c), 0)::BIGINT AS tokens, count(*) AS types FROM one),
p AS (SELECT doc_id, held_out, one.c AS known, tokens,
    (coalesce(one.c, 0) + 1.0::DOUBLE) / (tokens + types + 1) AS base,
    (coalesce(two.c, 0) + {lm.STRENGTH} * base) / (coalesce(ctx.c, 0) + {lm.STRENGTH}) AS shorter,
    coalesce(three.c, 0) AS seen, coalesce(ctx2.c, 0) AS held
  FROM t CROSS JOIN n LEFT JOIN one USING (v) LEFT JOIN two USING (u, v) LEFT JOIN ctx USING (u)
    LEFT JOIN three USING (t, u, v) LEFT JOIN ctx2 USING (t, u))
SELECT doc_id, held_out, count(*) AS n_tokens, count(known) AS n_known, max(tokens) AS train_tokens,
  round(sum(log10(base)), 6) AS base_score,
  round(sum(log10((seen + {lm.STRENGTH} * shorter) / (held + {lm.STRENGTH}))), 6) AS score
FROM p GROUP BY doc_id, held_out""")
def op7_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    trained = common.crc_mod(F.col("doc_id"), 7) != 2
    found = lm.score_texts(table(spark, sf_dir, "documents"), trained)
    return found.select(
        "doc_id", (~F.col("trained")).alias("held_out"), "n_tokens", "n_known", "train_tokens",
        F.round("base_score", 6).alias("base_score"), F.round("score", 6).alias("score"),
    )


# --- 8: personal data --------------------------------------------------------


#: Names the secret of the pseudonyms; the sample key is for the test tables, which hold nothing private.
KEY_SETTING, SAMPLE_KEY = "spark.reviewmill.pseudonyms.key", "pseudonyms"


def pseudonym_key(spark: SparkSession) -> str:
    """The key that the session names, else the sample key."""
    return spark.conf.get(KEY_SETTING, None) or SAMPLE_KEY


@query()
def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    masked = pii.mask_text(table(spark, sf_dir, "documents").select("doc_id", "text"), pseudonym_key(spark))
    return masked.select("doc_id", "n_values", "text")


# --- 9: benchmark decontamination --------------------------------------------

_PLAIN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@query(rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({FOLDED}, '{_PLAIN}') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all({FOLDED}, '{_PLAIN}') AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, least(13, len(w)) AS size,
  unnest(list_transform(range(1, greatest(2, len(w) - 11)), lambda j: array_to_string(w[j:j + 12], ' '))) AS passage
  FROM i WHERE len(w) > 0),
z AS (SELECT DISTINCT size FROM p),
t AS (SELECT doc_id, size, unnest(range(1, len(w) - size + 2)) AS pos, w FROM d CROSS JOIN z WHERE len(w) >= size),
h AS (SELECT t.doc_id, t.pos, t.size, p.item_id FROM
  (SELECT doc_id, pos, size, array_to_string(w[pos:pos + size - 1], ' ') AS passage FROM t) t
  JOIN p ON t.size = p.size AND t.passage = p.passage),
c AS (SELECT doc_id, count(DISTINCT spot) AS n_hit FROM
  (SELECT doc_id, unnest(range(pos, pos + size)) AS spot FROM h) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM
  (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * n_hit >= len(w) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN l USING (doc_id)""")
def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_passages(docs, table(spark, sf_dir, "benchmark"))
    names = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        decontaminate.contaminated().alias("contaminated"),
    )


# --- 10: nearest neighbours --------------------------------------------------


@query()
def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


# --- 11: WARC ----------------------------------------------------------------


@query(f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
h AS (SELECT page_id, body, octet_length(encode(body)) AS size, sha1(body) AS hex FROM p),
d AS (SELECT page_id, body, size, list_transform(range(4), lambda g: ('0x' || substr(hex, 10 * g + 1, 10))::BIGINT) AS v FROM h),
f AS (SELECT page_id, size, array_to_string(list_transform(range(32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v[i // 8 + 1] >> (35 - 5 * (i % 8))) & 31) + 1, 1)), '') AS digest,
  min(page_id) OVER (PARTITION BY body) AS first FROM d)
SELECT page_id, size::BIGINT AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM f""")
def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived_pages(table(spark, sf_dir, "pages"))


# --- 12: importance resampling -----------------------------------------------

#: The bytes of a text, and crc32 by its table.
_BYTES = "list_transform(range(1, octet_length(encode(f)) + 1), lambda i: ('0x' || substr(hex(encode(f)), 2 * i - 1, 2))::BIGINT)"
_CRC = f"""xor(list_reduce(list_concat([4294967295::BIGINT], {_BYTES}),
      lambda acc, byte: xor(acc >> 8, tab[(xor(acc, byte) & 255) + 1])), 4294967295)"""


@query(rf"""
WITH crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
    lambda acc, step: xor(acc >> 1, (acc & 1) * 3988292384))) AS tab),
w AS (SELECT 'd' AS side, doc_id, regexp_extract_all({FOLDED}, '{_PLAIN}') AS w FROM documents
  UNION ALL SELECT 't', NULL, regexp_extract_all({FOLDED}, '{_PLAIN}') FROM benchmark),
x AS (SELECT side, doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM w),
k AS (SELECT f, {_CRC} % 10000 AS bucket FROM (SELECT DISTINCT f FROM x) CROSS JOIN crc),
n AS (SELECT bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 't') AS t FROM x JOIN k USING (f) GROUP BY bucket),
z AS (SELECT coalesce(sum(s), 0)::BIGINT AS S_, coalesce(sum(t), 0)::BIGINT AS T_ FROM n),
g AS (SELECT bucket, floor(1000 * ln(((t + 1) * (S_ + 10000))::DOUBLE / ((s + 1) * (T_ + 10000))::DOUBLE)) AS gain FROM n CROSS JOIN z),
m AS (SELECT doc_id, count(*) AS n_features, floor(sum(gain) / count(*))::BIGINT AS weight
  FROM x JOIN k USING (f) JOIN g USING (bucket) WHERE side = 'd' GROUP BY doc_id),
h AS (SELECT doc_id, len(w) AS words, ('0x' || substr(sha256('7:' || doc_id::VARCHAR), 1, 8))::BIGINT AS h FROM w WHERE side = 'd'),
o AS (SELECT doc_id, words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM h LEFT JOIN m USING (doc_id)),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS every FROM o WHERE words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 25 * every // 100 THEN place END AS rank
FROM o LEFT JOIN r USING (doc_id)""")
def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    drawn = resample.draw(docs, table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


# --- 13: phrases -------------------------------------------------------------


@query(rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang,
  regexp_extract_all(unnest(string_split_regex({FOLDED}, '[.,;:!?
-
]')), '[^ 	]+') AS w FROM documents),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang),
o AS (SELECT lang, size, unnest(list_transform(range(1, greatest(1, len(w) - size + 2)), lambda i: w[i:i + size - 1])) AS words
  FROM p CROSS JOIN (SELECT unnest(range(1, 6)) AS size) WHERE len(w) >= size),
f AS (SELECT lang, size, words, count(*) AS a FROM o GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, size, words, a, unnest(range(1, size)) AS k FROM f WHERE size > 1),
s AS (SELECT c.lang, c.words, c.size, c.a, k, l.a AS l, r.a AS r, n.n, ((1000::HUGEINT * c.a * n.n) // (l.a::HUGEINT * r.a))::BIGINT AS score
  FROM c JOIN f l ON l.lang = c.lang AND l.words = c.words[1:k] JOIN f r ON r.lang = c.lang AND r.words = c.words[k + 1:]
  JOIN n ON n.lang = c.lang),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, words ORDER BY score, k) AS best FROM s),
i AS (SELECT lang, a, words[j:j + m - 1] AS words FROM
  (SELECT lang, size, words, a, unnest(range(2, size)) AS m FROM f WHERE size > 2) x, LATERAL (SELECT unnest(range(1, x.size - x.m + 2)) AS j)),
u AS (SELECT lang, words, max(a) AS whole FROM i GROUP BY lang, words),
t AS (SELECT lang, array_to_string(words, ' ') AS phrase, a, l, r, n, score FROM b LEFT JOIN u USING (lang, words)
  WHERE best = 1 AND NOT coalesce(100 * whole >= 100 * a, false)),
q AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM t)
SELECT * FROM q WHERE rank <= 2000""")
def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents").select("lang", "text"))
