"""Near-duplicate groups by bottom-k sketches.

A document is the set of its four-word shingles (64-bit hashes). Sets that are equal form a class,
so copies are one row from here on. The k smallest hashes of a set, under one hash function, are
its sketch.

*Inverted lists.* Two sets with Jaccard 0.8 or more share about 0.8 k retained values, and fewer
than ``least_shared`` of them with a probability of 3e-8 (sets of up to 38 shingles: never). So, if
each class orders its retained values from rare to common, the two must meet in the first
``m - least_shared + 1`` of the m values that others have too. Only these are listed. Passages that
many documents share are common and drop out of the lists of documents that hold anything else.

*Stars instead of pairs.* A list is joined to its leader only, the class with the most shared
values. The union sketch of both filters, exact Jaccard on full sets decides. If that leaves the
members of one leader in one component, no further pair can change the result.

*Open groups.* The members of the other leaders go through lists and stars once more, now with all
their shingles, ordered by how many of these members have them. What the members have in common
(a template) is last in that order, so those with enough text of their own meet in no list. Let m
of a member's n shingles be shared with any other. Two similar sets have at least 4/9 of the sum of
their sizes in common, so one of them is *tight*, 9 m >= 8 n. Lists without a tight member are left
out. In what is open even then, tight members are compared with all members, block against block,
inside tasks; only links that join two components come out. So no pair that matters is skipped.
Rows are linear in the shingles but for that last step, where T tight ones among M members make
2 T M / ``BLOCK_ROWS`` rows; tight members of one template are similar to each other, and so are
one component already, unless they lack parts of it.

*Hot keys.* A value, leader or component may belong to a third of all classes. How many classes have
a value is asked in a packed exchange (``common.py``), to which a chunk of classes sends it once.
What is joined on leaders and components is grouped first, with partial sums, and written as a
table, so that both sides of the join are plain exchanges and adaptive execution can split the hot
one.

*What moves.* Classes have numbers. Only texts that a bitmap of the wanted ones lets through are
joined, and full sets are stored in buckets of their class, so that no join on it moves them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewmill.llm import common as c

SHINGLE = 4
THRESHOLD = 80  # percent
KEPT = 48
LEAST_SHARED = 22
#: Members and shingles of a block in the comparison of open groups.
BLOCK_ROWS, BLOCK_SHINGLES = 512, 1 << 20
#: Bytes of values in a chunk of classes, and 64-bit words at most in the bitmap of wanted texts.
CHUNK_BYTES = 4 << 20
BITMAP_WORDS = 1 << 18
_OTHER = np.uint64(0xA0761D6478BD642F)


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes per text; a shorter text is one shingle, no words none."""
    found = c.Texts(texts, lower=True)
    at, h = found.windows(size)
    h = h.view(np.int64)
    bounds = np.searchsorted(at, found.first)
    sets = []
    for i, n in enumerate(found.counts):
        if 0 < n < size:
            words = found.words[found.first[i] : found.first[i + 1]]
            sets.append(c.window_hashes(words, int(n)).view(np.int64))
        else:
            sets.append(np.unique(h[bounds[i] : bounds[i + 1]]))
    return sets


def _class_key(shingles: np.ndarray) -> bytes | None:
    """128 bits that equal sets share."""
    if not len(shingles):
        return None
    h = shingles.view(np.uint64)
    sums = np.array([c.mix(h).sum(dtype=np.uint64), c.mix(h ^ _OTHER).sum(dtype=np.uint64)])
    return sums.tobytes()


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, sets in _parts(batches):
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array([len(s) for s in sets], pa.int64()),
             c.binaries([_class_key(s) for s in sets]), c.binaries([s[:KEPT].tobytes() for s in sets])],
            names=["id", "tag", "n", "key", "sketch"])


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, sets in _parts(batches):
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), c.binaries([_class_key(s) for s in sets]),
             c.binaries([s.tobytes() for s in sets])],
            names=["cls", "key", "found", "shingles"])


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Pieces of the batches with the shingle sets of their texts (second column), one piece alive at a time."""
    for batch in batches:
        first = 0
        for part in c.text_parts(batch.column(1)):
            yield batch.slice(first, len(part)), shingle_sets(part)
            first += len(part)
        pa.default_memory_pool().release_unused()


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Estimate by the union sketch, then exact Jaccard, for each row's two sets."""
    for batch in batches:
        linked = []
        for a, b in zip(batch.column(2), batch.column(3)):
            a, b = np.frombuffer(a.as_buffer(), np.int64), np.frombuffer(b.as_buffer(), np.int64)
            linked.append(_sizes_fit(len(a), len(b)) and _estimate(a, b) and _similar(a, b))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(linked, pa.bool_())], names=["cls", "leader", "linked"])


def _sizes_fit(a: int, b: int) -> bool:
    return 100 * min(a, b) >= THRESHOLD * max(a, b)


def _estimate(a: np.ndarray, b: np.ndarray) -> bool:
    """Of the k smallest of the union, enough are in both; exact if the union has no more than k."""
    union = np.union1d(a[:KEPT], b[:KEPT])[:KEPT]
    both = np.intersect1d(a[:KEPT], b[:KEPT], assume_unique=True)
    return int(np.isin(union, both, assume_unique=True).sum()) >= min(LEAST_SHARED, len(union) * 4 // 5)


def _similar(a: np.ndarray, b: np.ndarray) -> bool:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * shared >= THRESHOLD * (len(a) + len(b) - shared)


def _least_common(n: np.ndarray) -> np.ndarray:
    """How many shingles any partner shares."""
    return (n * 4 + 4) // 5


def _least_shared(n: np.ndarray) -> np.ndarray:
    """How many retained values any partner shares. Sets of up to 38 are compared whole."""
    return np.where(n * 5 <= 4 * KEPT, _least_common(n), LEAST_SHARED)


def components(edges: DataFrame) -> DataFrame:
    """(vertex, comp) for edges (a, b): the smallest vertex that can be reached.

    Each round takes the smallest label among the neighbours, then the label of that label, until
    nothing changes. Every round is a written table.
    """
    both = c.stored(edges.union(edges.select("b", "a")).distinct(), "edges")
    labels = c.stored(both.groupBy(F.col("a").alias("vertex")).agg(F.least(F.min("b"), F.first("a")).alias("comp")), "labels")
    while True:
        near = (
            both.join(labels.select(F.col("vertex").alias("b"), "comp"), "b")
            .groupBy(F.col("a").alias("vertex")).agg(F.min("comp").alias("near"))
        )
        stepped = labels.join(near, "vertex").select("vertex", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        jump = labels.select(F.col("vertex").alias("comp"), F.col("comp").alias("far"))
        new = c.stored(
            stepped.join(jump, "comp").select("vertex", F.least("comp", "far").alias("comp"), "old"), "labels"
        )
        changed = new.where(F.col("comp") != F.col("old")).limit(1).count()
        labels = new.select("vertex", "comp")
        if not changed:
            return labels


def _open_pairs(table: pa.Table) -> pa.Table:
    """Links between components from a block of tight members to a block of members of a leader's group."""
    cls = table["cls"].to_pylist()
    _, comp = np.unique(table["comp"].to_numpy(), return_inverse=True)
    sets = [np.frombuffer(x.as_buffer(), np.int64) for x in table["shingles"]]
    left = table["side"].to_numpy(zero_copy_only=False)
    sizes = np.array([len(s) for s in sets])
    rows = np.repeat(np.arange(len(sets)), sizes)
    every, column, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    number = np.cumsum(often > 1) - 1
    several = often[column] > 1
    rows, column = rows[several], number[column[several]]
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    l, r = np.flatnonzero(left), np.flatnonzero(~left)
    shared = np.zeros((len(l), len(r)), np.float32)
    width = 4096
    for begin in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        s, e = np.searchsorted(column, [begin, begin + width])
        part = np.zeros((len(sets), width), np.float32)
        part[rows[s:e], column[s:e] - begin] = 1
        shared += part[l] @ part[r].T
    shared = shared.astype(np.int64)
    union = sizes[l][:, None] + sizes[r][None, :] - shared
    linked = (100 * shared >= THRESHOLD * union) & (comp[l][:, None] != comp[r][None, :])
    parent = list(range(int(comp.max()) + 1))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    a, b = [], []
    for i, j in np.argwhere(linked):
        x, y = find(comp[l[i]]), find(comp[r[j]])
        if x != y:
            parent[x] = y
            a.append(cls[l[i]])
            b.append(cls[r[j]])
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _first_class(chunk: Column) -> Column:
    """A chunk is named by its task (upper 32 bits) and its number there; it has at most 2^19 classes."""
    number = F.shiftleft(chunk.bitwiseAND(F.lit((1 << 32) - 1)), 20)
    return F.shiftleft(F.shiftright(chunk, 32), 44) + number


def _values(row: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(class by place, value) of all values in a chunk."""
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in c.listed(row, "values")]
    return np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.concatenate(sets)


def _listed(chunks: DataFrame, least: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(cls, n, m, value): of the m values of a class that others have too, the rarest ``m - least(n) + 1``."""
    buckets = c.bucket_count(chunks)

    def ask(row: pa.RecordBatch):
        keys, often = np.unique(_values(row)[1], return_counts=True)
        bounds, often = c.split(keys, buckets), often.astype(np.uint32)
        return [
            (b, keys[s:e].tobytes(), often[s:e].tobytes())
            for b, (s, e) in enumerate(zip(bounds[:-1], bounds[1:])) if e > s
        ]

    def total(keys, often, _):
        _, which = np.unique(np.concatenate(keys), return_inverse=True)
        sums = np.bincount(which, np.concatenate(often)).astype(np.uint32)
        ends = np.cumsum([len(k) for k in keys])
        return [x.tobytes() for x in np.split(sums[which], ends[:-1])]

    def choose(row: pa.RecordBatch, back):
        of, values = _values(row)
        _, which = np.unique(values, return_inverse=True)
        often = np.concatenate([np.frombuffer(back[b], np.uint32) for b in sorted(back)])[which]
        several = often > 1
        of, values, often = of[several], values[several], often[several]
        order = np.lexsort((values, often, of))
        of, values = of[order], values[order]
        cls, n = (c.listed(row, x).to_numpy() for x in ("cls", "n"))
        m = np.bincount(of, minlength=len(n))
        place = np.arange(len(of)) - (np.cumsum(m) - m)[of]
        rare = place <= (m - least(n))[of]
        of, values = of[rare], values[rare]
        return pa.RecordBatch.from_arrays(
            [pa.array(cls[of]), pa.array(n[of]), pa.array(m[of]), pa.array(values.view(np.int64))],
            names=["cls", "n", "m", "value"])

    replies = c.answer(c.send(chunks.select("chunk", "values"), ask), total, np.uint32)
    return c.resume(chunks, replies, choose, "cls bigint, n bigint, m bigint, value bigint")


def _candidates(chunks: DataFrame, least: Callable[[np.ndarray], np.ndarray], tight: str = "true") -> DataFrame:
    """(cls, tight, leader): every class with the leader of each list that it is in.

    ``chunks`` hold classes: number, n and their values. ``tight`` is a condition on n and m, the
    number of its values that other classes have too; a list counts if it holds for a member.
    """
    listed = _listed(chunks, least)
    lists = c.stored(listed.select("cls", "n", "m", F.expr(tight).alias("tight"), "value"), "lists")
    leaders = c.stored(
        lists.groupBy("value").agg(F.max(F.struct("tight", "m", "n", "cls")).alias("top"), F.count("*").alias("members"))
        .where("members > 1 and top.tight").select("value", F.col("top.cls").alias("leader")),
        "leaders",
    )
    met = lists.join(leaders, "value").where(F.col("cls") != F.col("leader"))
    return c.stored(met.select("cls", "tight", "leader").distinct(), "pairs")


def _let_through(docs: DataFrame, first: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id and tag may be in ``first``, by a bitmap of bounded size."""
    found = F.xxhash64("id", "tag")
    place = {"word": F.pmod(F.shiftright(found, 6), F.lit(BITMAP_WORDS)), "bit": found.bitwiseAND(F.lit(63)).cast("int")}
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))
    bitmap = first.withColumns(place).groupBy("word").agg(F.bit_or(one).alias("bits"))
    met = docs.withColumns(place).join(F.broadcast(bitmap), "word")
    return met.where(F.getbit("bits", F.col("bit")) == 1).select(*docs.columns)


def _sets_of(docs: DataFrame, classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(cls, shingles) of the wanted classes, made again from the text of one document of each.

    A document is found by its id and a hash of its text, so that rows which share an id, or have
    none, do not all meet each other.
    """
    first = c.stored(wanted.join(classes, "cls").select("cls", "key", "first.id", "first.tag"), "wanted")
    near = _let_through(docs, first)
    texts = near.join(first, (near["tag"] == first["tag"]) & near["id"].eqNullSafe(first["id"])).select("cls", "text", "key")
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    made = texts.repartition(buckets, "cls").distinct().mapInArrow(
        _full_sets, "cls bigint, key binary, found binary, shingles binary"
    )
    return made.where(F.col("key") == F.col("found")).select("cls", "shingles")


def _star_links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): classes that are similar to their leader."""
    leaders = pairs.select(F.col("leader").alias("cls")).distinct()
    # by another name than its bucket's, a leader's set is exchanged, and a hot leader can be split
    right = sets.join(leaders, "cls", "left_semi").select(F.bitwise_not("cls").alias("to"), F.col("shingles").alias("other"))
    left = pairs.join(sets, "cls").select("cls", "leader", "shingles", F.bitwise_not("leader").alias("to"))
    star = left.join(right, "to").select("cls", "leader", "shingles", "other")
    star = c.stored(star.mapInArrow(_verify, "cls bigint, leader bigint, linked boolean"), "star")
    return star.where("linked").select(F.col("cls").alias("a"), F.col("leader").alias("b"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Group documents whose shingle sets have a Jaccard similarity of 0.8 or more, transitively.

    Words are runs of non-blank characters, A-Z in lower case. Returns id, ``n_shingles``,
    ``component_id`` (smallest id of the component) and ``kept`` (id = component_id), one row per
    input row. Null, empty and blank texts have no shingles and stand alone. Rows that repeat an id
    are rows of their own; those with the component's smallest id are all kept. A null id is larger
    than any other and kept only if its component has no other. Other columns are not read.
    """
    c.small_batches(df.sparkSession)
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("tag"))
    kind = dict(docs.dtypes)["id"]
    profile = c.stored(docs.mapInArrow(_profile, f"id {kind}, tag bigint, n bigint, key binary, sketch binary"), "profile")
    filled = profile.where("n > 0")
    smallest = F.min(F.struct(F.isnull("id").alias("no_id"), "id", "tag"))
    grouped = filled.groupBy("key").agg(smallest.alias("first"), F.first("n").alias("n"), F.first("sketch").alias("values"))
    chunks = c.chunk_table(grouped, "classes", ["key", "first", "n", "values"], CHUNK_BYTES)
    chunks = chunks.withColumn("cls", F.transform("n", lambda _, i: _first_class(F.col("chunk")) + i))
    classes = chunks.select(F.explode(F.arrays_zip("cls", "key", "first")).alias("of")).select("of.*")
    pairs = _candidates(chunks.select("chunk", "words", "cls", "n", "values"), _least_shared)
    wanted = pairs.select("cls").union(pairs.select("leader")).distinct()
    sets = c.bucketed(_sets_of(docs, classes, wanted), "sets", "cls")
    labels = _closed(components(_star_links(pairs, sets)), pairs, sets)

    named = (
        classes.join(labels.withColumnRenamed("vertex", "cls"), "cls", "left")
        .withColumn("comp", F.coalesce("comp", "cls"))
    )
    least = c.stored(named.groupBy("comp").agg(F.min("first").alias("least")), "smallest")
    of_class = named.join(least, "comp").select("key", F.col("least.id").alias("component_id"))
    grouped = filled.select("id", "n", "key").join(of_class, "key").select("id", "n", "component_id")
    alone = profile.where("n = 0").select("id", "n", F.col("id").alias("component_id"))
    return grouped.union(alone).select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id",
        F.col("id").eqNullSafe(F.col("component_id")).alias("kept"),
    )


def _members(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """(leader, cls, tight, comp): the members of each leader, itself among them, with their component."""
    own = pairs.select(F.col("leader").alias("cls"), F.lit(True).alias("tight"), "leader").distinct()
    return pairs.select("cls", "tight", "leader").union(own).join(
        labels.withColumnRenamed("vertex", "cls"), "cls", "left"
    ).withColumn("comp", F.coalesce("comp", "cls"))


def _closed(labels: DataFrame, pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The labels with the links between components that members of one leader have."""
    members = _members(pairs, labels)
    groups = c.stored(
        members.groupBy("leader").agg(F.min("comp").alias("low"), F.max("comp").alias("high"))
        .where("low <> high").select("leader"), "open-groups",
    )
    opened = c.stored(members.join(groups, "leader").select("cls").distinct(), "open")
    if opened.isEmpty():
        return labels
    size = (F.octet_length("shingles") / 8).cast("long").alias("n")
    whole = opened.join(sets, "cls").select("cls", size, F.col("shingles").alias("values"))
    again = _candidates(c.chunk_table(whole, "shingles", ["cls", "n", "values"], CHUNK_BYTES), _least_common, "9 * m >= 8 * n")
    labels = _joined(labels, _star_links(again, sets))
    return _joined(labels, c.stored(_block_links(again, sets, labels), "block-links"))


def _block_links(pairs: DataFrame, sets: DataFrame, labels: DataFrame) -> DataFrame:
    """(a, b): links that join components, between tight and other members of a leader."""
    members = _members(pairs, labels)
    sized = members.join(sets.select("cls", (F.octet_length("shingles") / 8).alias("n")), "cls")

    def blocks(which: Column) -> Column:
        return F.greatest(F.ceil(F.count_if(which) / BLOCK_ROWS), F.ceil(F.sum(F.when(which, F.col("n"))) / BLOCK_SHINGLES))

    groups = c.stored(
        sized.groupBy("leader").agg(
            F.min("comp").alias("low"), F.max("comp").alias("high"),
            blocks(F.col("tight")).alias("lefts"), blocks(F.lit(True)).alias("rights"),
        ).where("low <> high").select("leader", "lefts", "rights"),
        "open-groups",
    )
    spread = members.join(groups, "leader").withColumn("hash", F.xxhash64("cls"))

    def dealt(rows: DataFrame, own: str, other: str, side: bool) -> DataFrame:
        return rows.select(
            "leader", "cls", "comp", F.lit(side).alias("side"), F.pmod("hash", own).cast("long").alias(own),
            F.explode(F.sequence(F.lit(0).cast("long"), F.col(other).cast("long") - 1)).alias(other),
        )

    left, right = dealt(spread.where("tight"), "lefts", "rights", True), dealt(spread, "rights", "lefts", False)
    met = left.unionByName(right).join(sets, "cls")
    return met.groupBy("leader", "lefts", "rights").applyInArrow(_open_pairs, "a bigint, b bigint")


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after some components have been linked to each other."""
    own = labels.select(F.col("vertex").alias("a"), F.col("comp").alias("comp_a"))
    other = labels.select(F.col("vertex").alias("b"), F.col("comp").alias("comp_b"))
    between = links.join(own, "a", "left").join(other, "b", "left").select(
        F.coalesce("comp_a", "a").alias("a"), F.coalesce("comp_b", "b").alias("b")
    )
    merged = components(between.where("a <> b"))
    alone = links.select(F.col("a").alias("vertex")).union(links.select("b")).distinct()
    every = labels.union(
        alone.join(labels, "vertex", "left_anti").select("vertex", F.col("vertex").alias("comp"))
    )
    new = merged.select(F.col("vertex").alias("comp"), F.col("comp").alias("top"))
    return c.stored(every.join(new, "comp", "left").select("vertex", F.coalesce("top", "comp").alias("comp")), "labels")
