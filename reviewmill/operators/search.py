"""Exact and approximate nearest neighbours for a table of queries.

Documents are read once; where hits show their fields, the vectors are dealt out evenly once, and
nothing else of them moves. The queries are stored in the shared scratch folder;
each task holds some megabytes of documents and scores them against one block of queries after
the other, a matrix product per block. The k best per query and buffer are shuffled, nothing
else: a number for a long query id, and none of the fields that the hits show, which are joined to
the k best. Neither the driver nor a task holds all queries, so any number of them can be answered.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from reviewmill.fixed import SEARCH_K
from reviewmill.session import file_store, scratch_dir

# Queries of one block, and documents that a task holds while the blocks pass.
QUERY_ROWS = 4096
QUERY_BYTES = 32 * 1024 * 1024
DOC_BYTES = 64 * 1024 * 1024
# Scores are compared to this many digits, so that equal vectors tie in any batch.
SCORE_DIGITS = 9
BATCH_ROWS = 2048
# Cells of one score matrix: documents of a batch times queries.
SCORE_CELLS = 1 << 22
# Pairs scored at once, and the share of a matrix (one in so many) above which it is scored whole.
PAIR_ROWS = 16_384
DENSE = 16
# Ids of queries longer than this are numbers until the k best are known.
LONG_ID = 32


def filter_terms(df: DataFrame, filters: Mapping[str, object] | None) -> DataFrame:
    """Metadata filter: a list means any of its values, all fields must match."""
    for name, wanted in (filters or {}).items():
        if isinstance(wanted, (list, tuple, set)):
            df = df.filter(F.col(name).isin(*wanted))
        else:
            df = df.filter(F.col(name) == wanted)
    return df


def vector_dim_check(df: DataFrame, dim: int, vector: str = "vector") -> DataFrame:
    """Rows with and without the index dimension; a missing vector is wrong."""
    wrong = F.coalesce(F.size(vector) != dim, F.lit(True)) | F.col(vector).isNull()
    return df.agg(
        F.count_if(~wrong).alias("ok"), F.count_if(wrong).alias("wrong_dim")
    )


def split_by_dim(df: DataFrame, dim: int, vector: str = "vector") -> tuple[DataFrame, DataFrame]:
    """Rows that fit the index, and the rejected rest."""
    fits = F.coalesce((F.size(vector) == dim) & F.col(vector).isNotNull(), F.lit(False))
    return df.filter(fits), df.filter(~fits)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(len(column), dim)


def _unit(rows: np.ndarray) -> np.ndarray:
    sizes = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, sizes, out=np.zeros_like(rows), where=sizes > 0)


def score_matrix(docs: np.ndarray, queries: np.ndarray, metric: str) -> np.ndarray:
    """Scores (documents x queries), larger is closer; l2 is the negative distance."""
    if metric == "cosine":
        return _unit(docs) @ _unit(queries).T
    if metric == "dot":
        return docs @ queries.T
    if metric == "l2":
        # Differences, not |a|^2 + |b|^2 - 2ab, which loses the digits of close vectors.
        gaps = [((docs - q) ** 2).sum(axis=1) for q in queries]
        return -np.sqrt(np.stack(gaps, axis=1))
    raise ValueError(f"unknown metric {metric!r}")


def _first_k(order: np.ndarray, floor: np.ndarray, key: pa.Array, k: int):
    """(row, query) of at most k rows per query at or above its floor; of equals the smaller keys."""
    rows, cols = np.nonzero((order >= floor) & (order > -np.inf))
    best = _best(cols, order[rows, cols], _places(key)[rows], k)
    return rows[best], cols[best]


def _places(key: pa.Array) -> np.ndarray:
    """Rank of each key; a missing key comes first, as in Spark."""
    place = np.empty(len(key), np.int64)
    place[pc.sort_indices(key, null_placement="at_start").to_numpy()] = np.arange(len(key))
    return place


def _best(query: np.ndarray, order: np.ndarray, place: np.ndarray, k: int) -> np.ndarray:
    """Numbers of the k best pairs per query, by query."""
    best = np.lexsort((place, -order, query))
    sorted_query = query[best]
    return best[np.arange(len(best)) - np.searchsorted(sorted_query, sorted_query) < k]


def _kth(scores: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest score per query of a matrix (documents x queries)."""
    return np.partition(np.ascontiguousarray(scores.T), -k, axis=1)[:, -k]


class _Docs:
    """A buffer of documents as its blocks of queries meet it: lengths, places and single precision are
    made once, not once per block, and all products are written to the same memory."""

    def __init__(self, table: pa.Table, dim: int, metric: str, key: str, vector: str):
        flat = table.column(vector).combine_chunks().flatten().to_numpy(zero_copy_only=False)
        self.rows = flat.reshape(table.num_rows, dim)
        self.keys = table.column(key).combine_chunks()
        self.place = _places(self.keys)
        self.metric, self.step = metric, BATCH_ROWS
        self.sizes = np.empty(len(self.rows))
        self.single = np.empty(self.rows.shape if metric in ("cosine", "dot") else (0, dim), np.float32)
        self.longest: list[float | None] = []
        for part in self.parts():
            rows = self.rows[part].astype(np.float64)
            self.sizes[part] = sizes = np.linalg.norm(rows, axis=1)
            longest = sizes.max(initial=0.0) or 1.0
            self.longest.append(longest if np.isfinite(longest) else None)
            if len(self.single):
                by = np.where(sizes > 0, sizes, 1.0)[:, None] if metric == "cosine" else longest
                with np.errstate(invalid="ignore"):
                    self.single[part] = rows / by
        self._near, self._able = np.empty(0, np.float32), np.empty(0, bool)

    def parts(self) -> Iterator[slice]:
        """Steps through the rows. The first is short: the k-th best of its rows is found by a partition."""
        start, stop = 0, max(1, self.step // 4)
        while start < len(self.rows):
            stop = min(stop, len(self.rows))
            yield slice(start, stop)
            start, stop = stop, stop + self.step

    def matrix(self, rows: slice | np.ndarray) -> np.ndarray:
        return self.rows[rows].astype(np.float64)

    def exact(self, rows: np.ndarray) -> np.ndarray:
        """These rows in double precision, of unit length for cosine."""
        found = self.matrix(rows)
        if self.metric == "cosine":
            sizes = self.sizes[rows]
            found /= np.where(sizes > 0, sizes, 1.0)[:, None]
        return found

    def cells(self, rows: int, cols: int) -> tuple[np.ndarray, np.ndarray]:
        """Memory for a matrix of products and one of flags."""
        size = rows * cols
        if len(self._near) < size:
            self._near, self._able = np.empty(size, np.float32), np.empty(size, bool)
        return self._near[:size].reshape(rows, cols), self._able[:size].reshape(rows, cols)


class _Coarse:
    """Products in single precision that tell which pairs can be among the best.

    With lengths of at most one, the rounding of a product of ``dim`` terms is below ``slack``.
    """

    def __init__(self, queries: np.ndarray, metric: str):
        self.exact = _unit(queries) if metric == "cosine" else queries
        self.metric = metric
        sizes = np.linalg.norm(queries, axis=1)
        # Products are compared in units of the query's length; it is part of the score of 'dot' only.
        self.sizes = np.where(sizes > 0, sizes, 1.0) if metric == "dot" else np.ones(len(queries))
        unit = self.exact if metric == "cosine" else _unit(queries)
        self.single = np.ascontiguousarray(unit.astype(np.float32).T)
        self.slack = (queries.shape[1] + 4) * 2.0**-23 + 1e-6
        self.usable = metric in ("cosine", "dot") and bool(np.isfinite(sizes).all())

    def pairs(self, docs: _Docs, step: int, part: slice, bar: np.ndarray, k: int):
        """(row, query, least, most) of all pairs whose rounded score can reach the bar and the k-th of these
        documents, with bounds of that score; None if these are so many that the whole matrix is cheaper,
        or if a vector is not finite."""
        longest = docs.longest[step]
        if not self.usable or longest is None:
            return None
        scale = self.sizes * longest if self.metric == "dot" else self.sizes
        near, able = docs.cells(part.stop - part.start, len(bar))
        np.matmul(docs.single[part], self.single, out=near)
        with np.errstate(over="ignore"):
            floor = ((bar - 10.0**-SCORE_DIGITS) / scale - self.slack).astype(np.float32)
        if len(near) > k and np.isneginf(bar).any():
            floor = np.maximum(floor, _kth(near, k) - np.float32(2 * self.slack))
        np.greater_equal(near, floor, out=able)
        found = _flagged(able, able.size // DENSE)
        if found is None:
            return None
        rows, cols = np.divmod(found, able.shape[1])
        close = near.reshape(-1)[found].astype(np.float64)
        least = (close - self.slack) * scale[cols] - 10.0**-SCORE_DIGITS
        most = (close + self.slack) * scale[cols] + 10.0**-SCORE_DIGITS
        return rows + part.start, cols, least, most

    def scores(self, docs: _Docs, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        """Scores of pairs in double precision."""
        scores = np.empty(len(rows))
        for start in range(0, len(rows), PAIR_ROWS):
            some = slice(start, start + PAIR_ROWS)
            scores[some] = np.einsum("ij,ij->i", docs.exact(rows[some]), self.exact[cols[some]])
        return scores


def _flagged(able: np.ndarray, most: int) -> np.ndarray | None:
    """Places of the flags that are set; None if these are more than ``most``. Few are: 64 are looked at together."""
    flags = able.reshape(-1)
    packed = np.packbits(flags)
    if len(packed) % 8:
        packed = np.concatenate([packed, np.zeros(-len(packed) % 8, np.uint8)])
    words = np.flatnonzero(packed.view(np.uint64))
    if len(words) > most:
        return None
    places = np.flatnonzero(np.unpackbits(packed.reshape(-1, 8)[words]).view(bool))
    if len(places) > most:
        return None
    return words[places >> 6] * 64 + (places & 63)


def _local_topk(
    docs: pa.Table | _Docs, queries: np.ndarray, k: int, metric: str, key: str, vector: str
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """k best of these documents per query as (row, query, score, rounded score).

    Pairs are sifted in single precision; what may be among the best of all these documents is scored
    in double precision, so the outcome is that of the whole matrix.
    """
    if not isinstance(docs, _Docs):
        docs = _Docs(docs, queries.shape[1], metric, key, vector)
    tile = max(1, SCORE_CELLS // docs.step)
    found = []
    for start in range(0, len(queries), tile):
        row, query, score, order = _Best(docs, queries[start : start + tile], k).found()
        found.append((row, query + start, score, order))
    return tuple(np.concatenate(c) for c in zip(*found))


class _Best:
    """The k best documents for so many queries as one matrix of products holds.

    Pairs are held with bounds of their rounded scores. The k-th of the lower bounds is the ``bar`` below
    which a pair is dropped unscored. Where too many lie within the bounds of the k-th, such as copies of
    a document, these are scored at once, so at most some times k pairs per query are held.
    """

    def __init__(self, docs: _Docs, queries: np.ndarray, k: int):
        self.docs, self.queries, self.k = docs, queries, k
        self.coarse = _Coarse(queries, docs.metric)
        self.bar = np.full(len(queries), -np.inf)
        self.held: list[tuple[np.ndarray, ...]] = []  # row, query, bounds of the score, score or NaN

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, query, score, rounded score), by query."""
        waiting = 0
        for step, part in enumerate(self.docs.parts()):
            sifted = self.coarse.pairs(self.docs, step, part, self.bar, self.k)
            if sifted is None:
                self.held.append(self._whole(part))
            else:
                self.held.append((*sifted, np.full(len(sifted[0]), np.nan)))
            waiting += len(self.held[-1][0])
            if waiting >= len(self.queries) * self.k // 2:
                self._raise_bar()
                waiting = 0
        if waiting:
            self._raise_bar()
        self._score()
        row, query, order, _, score = self.held[0]
        return row, query, score, order

    def _whole(self, part: slice) -> tuple[np.ndarray, ...]:
        """Pairs of some documents from the matrix of all scores."""
        scores = score_matrix(self.docs.matrix(part), self.queries, self.docs.metric)
        order = np.where(np.isnan(scores), -np.inf, np.round(scores, SCORE_DIGITS))
        floor = np.maximum(self.bar, _kth(order, self.k)) if len(scores) > self.k else self.bar
        rows, cols = _first_k(order, floor, self.docs.keys.slice(part.start, len(scores)), self.k)
        return rows + part.start, cols, order[rows, cols], order[rows, cols], scores[rows, cols]

    def _raise_bar(self) -> None:
        row, query, least, most, score = (np.concatenate(c) for c in zip(*self.held))
        best = np.lexsort((-least, query))
        counts = np.bincount(query, minlength=len(self.queries))
        full = counts >= self.k
        self.bar[full] = least[best[(np.cumsum(counts) - counts + self.k - 1)[full]]]
        kept = most >= self.bar[query]
        self.held = [(row[kept], query[kept], least[kept], most[kept], score[kept])]
        if np.count_nonzero(kept) > 2 * self.k * len(self.queries):
            self._score()

    def _score(self) -> None:
        """Hold the k best only, with their scores."""
        row, query, least, most, score = (np.concatenate(c) for c in zip(*self.held))
        open_ = np.flatnonzero(np.isnan(score))
        score[open_] = self.coarse.scores(self.docs, row[open_], query[open_])
        order = np.where(np.isnan(score), least, np.round(score, SCORE_DIGITS))
        best = _best(query, order, self.docs.place[row], self.k)
        row, query, order = row[best], query[best], order[best]
        self.held = [(row, query, order, order, score[best])]


def topk_per_query(
    hits: DataFrame, k: int = SEARCH_K, query: str = "query_id", key: str = "vec_id",
    score: Column | None = None,
) -> DataFrame:
    """k best hits per query, ties by key. Spark cuts to k per task before the shuffle."""
    order = [F.desc("score") if score is None else score, F.col(key)]
    place = F.row_number().over(Window.partitionBy(query).orderBy(*order))
    return hits.withColumn("rank", place).filter(F.col("rank") <= k)


@dataclass
class StoredQueries:
    """Queries as a table in the scratch folder, which tasks read in blocks.

    ``label`` is the column that stands for a query in the hits of a task: its id, or its number
    where ids are long texts.
    """

    spark: SparkSession
    folder: str
    query: str
    vector: str
    dim: int
    field: StructField
    rows: int

    @property
    def label(self) -> str:
        return self.field.name

    def blocks(self) -> Iterator[tuple[pa.Array, np.ndarray]]:
        """Labels and vectors, at most ``rows`` at a time."""
        kind = to_arrow_type(self.field.dataType)
        store, root = file_store(self.folder)
        files = [f.path for f in store.get_file_info(pafs.FileSelector(root)) if f.path.endswith(".parquet")]
        for path in sorted(files):
            with store.open_input_file(path) as file:
                for batch in pq.ParquetFile(file).iter_batches(self.rows, columns=[self.label, self.vector]):
                    yield batch.column(self.label).cast(kind), _matrix(batch.column(self.vector), self.dim)

    def named(self, hits: DataFrame) -> DataFrame:
        """Hits with the id of their query."""
        if self.label == self.query:
            return hits
        ids = self.spark.read.parquet(self.folder).select(self.label, self.query)
        return hits.join(ids, self.label).drop(self.label)

    def __getstate__(self) -> dict:
        return {**self.__dict__, "spark": None}  # tasks read the folder


def store_queries(
    queries: DataFrame, query: str, vector: str, max_bytes: int = QUERY_BYTES, max_rows: int = QUERY_ROWS
) -> StoredQueries | None:
    """Write the queries once, so that they are embedded once; None if there are none.

    A query without a vector has no hits and is left out.
    """
    spark = queries.sparkSession
    folder = scratch_dir(spark, "queries")
    present = queries.select(query, vector).where(F.col(vector).isNotNull())
    present.withColumn("_query", F.monotonically_increasing_id()).write.parquet(folder)
    field = queries.schema[query]
    wide = F.max(F.octet_length(query)) if isinstance(field.dataType, StringType) else F.lit(0)
    sizes = spark.read.parquet(folder).withColumn("n", F.size(vector))
    least, most, longest = sizes.agg(F.min("n"), F.max("n"), wide).first()
    if least is None:
        return None
    if least != most:
        raise ValueError("query vectors differ in size")
    if (longest or 0) > LONG_ID:
        field = StructField("_query", LongType())
    rows = max(1, min(max_rows, max_bytes // (8 * most + 64)))
    return StoredQueries(spark, folder, query, vector, most, field, rows)


def _buffers(batches: Iterator[pa.RecordBatch], max_bytes: int = DOC_BYTES) -> Iterator[pa.Table]:
    """Batches together up to some bytes."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= max_bytes:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def knn_exact(
    docs: DataFrame,
    queries: DataFrame,
    k: int = SEARCH_K,
    metric: str = "cosine",
    filters: Mapping[str, object] | None = None,
    filter_mode: str = "pre",
    key: str = "vec_id",
    vector: str = "embedding",
    query: str = "query_id",
    query_vector: str = "query_vector",
    keep: Sequence[str] = (),
    block_bytes: int = QUERY_BYTES,
) -> DataFrame:
    """k nearest documents per query: (query, rank, key, score, kept columns).

    ``filter_mode`` 'pre' filters documents before the search; 'post' filters the k hits, so
    fewer may remain. For l2 the score is the distance, smaller first.
    """
    if filter_mode not in ("pre", "post"):
        raise ValueError(f"unknown filter mode {filter_mode!r}")
    if filter_mode == "pre":
        docs = filter_terms(docs, filters)
    shown = [c for c in dict.fromkeys(keep) if c != key]
    later = [c for c in (filters or {}) if filter_mode == "post"]
    lean = docs.select(*dict.fromkeys([key, *shown, *later]), vector).filter(F.col(vector).isNotNull())
    stored = store_queries(queries, query, query_vector, block_bytes)
    if stored is None:
        return _no_hits(lean, vector, query, queries).select(query, "rank", key, "score", *shown)
    whole = None
    if shown or later:
        # Hits take the number of a row; its fields are joined to the few that are left.
        folder = scratch_dir(docs.sparkSession, "searched")
        lean.withColumn("_row", F.monotonically_increasing_id()).write.parquet(folder)
        whole = docs.sparkSession.read.schema(StructType([*lean.schema.fields, StructField("_row", LongType())])).parquet(folder)
        tasks = _even_tasks(docs.sparkSession, whole.count() * (4 * stored.dim + 64))
        lean = whole.select(key, "_row", vector).repartition(tasks, "_row")
    found = score_stored(lean, stored, k, metric, key, vector)
    hits = topk_per_query(found, k, stored.label, key, score=F.desc("_order"))
    if metric == "l2":
        hits = hits.withColumn("score", -F.col("score"))
    hits = stored.named(hits)  # before the texts come, so that these move once
    if whole is not None:
        hits = hits.join(whole.drop(key, vector), "_row")
    if filter_mode == "post":
        hits = filter_terms(hits, filters)
    return hits.select(query, "rank", key, "score", *shown)


def _even_tasks(spark: SparkSession, size: int) -> int:
    """Tasks that hold one buffer each at most, as many for every core.

    Each task reads all queries and sends its k best: splits of some megabytes do that often, and one split
    more than there are cores makes all others wait. An eighth is left for long keys and uneven parts, as the
    few rows of a second buffer would meet all queries again.
    """
    cores = spark.sparkContext.defaultParallelism
    return max(1, -(-size // (DOC_BYTES * 7 // 8 * cores))) * cores


def _no_hits(docs: DataFrame, vector: str, query: str, queries: DataFrame) -> DataFrame:
    empty = docs.drop(vector).limit(0)
    return empty.withColumns(
        {
            query: F.lit(None).cast(queries.schema[query].dataType),
            "score": F.lit(None).cast("double"),
            "rank": F.lit(None).cast("int"),
        }
    )


def score_stored(
    docs: DataFrame,
    stored: StoredQueries,
    k: int,
    metric: str,
    key: str,
    vector: str,
    pairs: Callable[[pa.Table, np.ndarray], Iterator[tuple[pa.Table, np.ndarray]]] | None = None,
) -> DataFrame:
    """The k best documents of each buffer per query, in one pass over the documents.

    ``pairs`` takes a buffer and a block of query vectors and gives (documents, numbers of the
    queries that are compared with them); without it every query meets every document.
    """
    payload = [f for f in docs.schema.fields if f.name not in (vector, "list_id")]
    schema = StructType(
        [
            stored.field,
            *payload,
            StructField("score", DoubleType()),
            StructField("_order", DoubleType()),
        ]
    )
    names = [f.name for f in payload]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for buffer in _buffers(batches):
            ready = None if pairs else _Docs(buffer, stored.dim, metric, key, vector)
            for ids, matrix in stored.blocks():
                met = pairs(buffer, matrix) if pairs else [(buffer, np.arange(len(matrix)))]
                for part, asked in met:
                    if not part.num_rows:
                        continue
                    row, query, score, order = _local_topk(ready or part, matrix[asked], k, metric, key, vector)
                    labels = ids.take(pa.array(asked[query]))
                    payload = part.select(names).take(pa.array(row)).columns
                    hits = pa.table([labels, *payload, pa.array(score), pa.array(order)], [stored.label, *names, "score", "_order"])
                    yield from hits.combine_chunks().to_batches()

    return docs.filter(F.size(vector) == stored.dim).mapInArrow(run, schema)


def result_projection(hits: DataFrame) -> DataFrame:
    """The fields a search answer shows."""
    return hits.select("review_id", "restaurant_name", "text")


def recall_at_k(exact: DataFrame, found: DataFrame, k: int, query="query_id", key="vec_id"):
    """Mean share of the true k nearest that were found; one row.

    Counted by joining (query, key) pairs, so no list of hits is built.
    """
    truth = exact.filter(F.col("rank") <= k).select(query, key)
    seen = found.filter(F.col("rank") <= k).select(query, key, F.lit(1).alias("seen"))
    per_query = (
        truth.join(seen, [query, key], "left")
        .groupBy(query)
        .agg((F.count("seen") / F.lit(k)).alias("recall"))
    )
    return per_query.agg(F.avg("recall").alias("recall"), F.count(F.lit(1)).alias("queries"))
