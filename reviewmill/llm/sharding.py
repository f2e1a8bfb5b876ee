"""Shards by a consistent-hash ring with virtual nodes and bounded loads, in DataFrame operations.

The ring has ``CELLS`` cells. Every shard owns some virtual nodes on it; a key's hash names its
cell, and the key belongs to the first node from there on, clockwise. Every shard has a capacity.
Keys are taken in ring order; one that meets a full shard goes on clockwise to the next node whose
shard has room. The capacities add up to the number of rows, so counts differ by at most one, and
only the overflow leaves its own arc.

What the walk needs is one count per cell (or per piece of a crowded cell). It yields, per piece,
which ranks go to which shard; rows take their rank in their piece by a window and join that table.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewmill.llm import common as c

CELLS = 1 << 16
NODES = 64
#: Rows from which a cell is cut into pieces, so that no window task holds a crowded one.
PIECE_ROWS = 100_000


def ring(shards: int, nodes: int = NODES) -> list[tuple[int, int]]:
    """(cell, shard) of the virtual nodes in clockwise order."""
    points = sorted(
        (int(hashlib.md5(f"shard {s} node {v}".encode()).hexdigest()[:16], 16), s)
        for s in range(shards) for v in range(nodes)
    )
    return [(point * CELLS >> 64, s) for point, s in points]


def walk(
    pieces: list[tuple[int, int, int]], shards: int, nodes: int = NODES
) -> list[tuple[int, int, int, int, int, int]]:
    """(cell, piece, first rank, end rank, shard, first slot) for pieces (cell, piece, rows).

    Pieces come in ring order. Shards with a low number take the odd rows.
    """
    total = sum(n for _, _, n in pieces)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    used = [0] * shards
    points = ring(shards, nodes)
    out = []
    home = 0
    for cell, piece, rows in pieces:
        while home < len(points) and points[home][0] < cell:
            home += 1
        at, taken = home, 0
        while taken < rows:
            shard = points[at % len(points)][1]
            n = min(rows - taken, room[shard] - used[shard])
            if n:
                out.append((cell, piece, taken, taken + n, shard, used[shard]))
                used[shard] += n
                taken += n
            at += 1
    return out


def _pieces(narrow: DataFrame, piece_rows: int) -> tuple[DataFrame, list[tuple[int, int, int]]]:
    """Rows with their ``piece``, and (cell, piece, rows) in ring order.

    A crowded cell is cut by more bits of the ids' digest, what is crowded even then (one id) by
    size and crc, and rows that have these in common too by row: it does not matter which is which.
    """
    spark = narrow.sparkSession
    content = ["order", "size", "crc"]
    keyed = narrow.withColumn("piece", F.lit(0).cast("long"))
    counts = sorted((r["cell"], 0, r["count"]) for r in narrow.groupBy("cell").count().collect())  # at most CELLS rows

    def cut(table: DataFrame, on: list[str], place: Column) -> tuple[DataFrame, list[tuple[int, int, int]]]:
        met = keyed.join(F.broadcast(table), on, "left")  # a row per piece_rows rows at most
        new = met.withColumn("piece", F.col("piece") * (1 << 20) + F.coalesce(place, F.lit(0))).drop("parts", "number")
        return new, sorted((r["cell"], r["piece"], r["count"]) for r in new.groupBy("cell", "piece").count().collect())

    for place in (
        F.shiftright(F.shiftright("order", 40) * F.col("parts"), 20),  # the order has 60 bits
        F.pmod(F.xxhash64(*content), F.col("parts")),
    ):
        crowded = [(cell, piece, 4 * -(-n // piece_rows)) for cell, piece, n in counts if n > piece_rows]
        if not crowded:
            return keyed, counts
        keyed, counts = cut(spark.createDataFrame(crowded, "cell int, piece long, parts long"), ["cell", "piece"], place)
    crowded = [(cell, piece) for cell, piece, n in counts if n > piece_rows]
    if not crowded:
        return keyed, counts
    few = F.broadcast(spark.createDataFrame(crowded, "cell int, piece long"))
    many = keyed.join(few, ["cell", "piece"]).groupBy("cell", "piece", *content).count().where(F.col("count") > piece_rows)
    hot = many.select("cell", "piece", *content, F.ceil(F.col("count") / piece_rows).alias("parts")).withColumn(
        "number", F.expr("sum(parts) over (partition by cell, piece order by `order`, size, crc) - parts")
    )
    rows = spark.createDataFrame(hot.collect(), hot.schema)
    return cut(rows, ["cell", "piece", *content], 1 + F.col("number") + F.pmod(F.xxhash64("row"), F.col("parts")))


def assign_shards(
    df: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", nodes: int = NODES,
    piece_rows: int = PIECE_ROWS,
) -> DataFrame:
    """Give every row a shard from 0 on and a slot in it; rows per shard differ by at most one.

    Returns id, ``size`` (UTF-8 bytes of the text plus 8, null: 8), ``text_crc32`` (null: of the
    empty text), ``shard`` and ``slot`` (0, 1, ... in each shard). The key is the id; a null id is
    a key of its own. Rows that share an id share a cell; a crowded cell is cut into pieces by the id,
    then by size and crc, so one id may hold any part of the rows and the order of the input does not
    matter. Equal rows get different slots. An empty table has no rows.
    Only ids decide the ring position, so rows move little when others come or go. Other columns
    are not read.
    """
    spark = df.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    digest = F.md5(key.cast("binary"))
    narrow = c.stored(
        df.select(
            F.col(id_col).alias("id"), (F.octet_length(text) + F.lit(8)).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("crc"),
            F.conv(F.substring(digest, 1, 4), 16, 10).cast("int").alias("cell"),
            F.conv(F.substring(digest, 5, 15), 16, 10).cast("long").alias("order"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "shard-keys",
    )
    keyed, counts = _pieces(narrow, piece_rows)
    # one row per piece and per shard that it fills: at most CELLS + rows / piece_rows + shards
    table = spark.createDataFrame(
        walk(counts, shards, nodes), "cell int, piece long, first long, `end` long, shard int, slot0 long"
    )
    rank = F.expr("row_number() over (partition by cell, piece order by `order`, size, crc, row) - 1")
    ranked = keyed.withColumn("rank", rank.cast("long"))
    placed = ranked.join(  # the window has partitioned the rows by these keys already
        table,
        (ranked["cell"] == table["cell"]) & (ranked["piece"] == table["piece"])
        & (ranked["rank"] >= table["first"]) & (ranked["rank"] < table["end"]),
    )
    return placed.select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard",
        (F.col("slot0") + F.col("rank") - F.col("first")).alias("slot"),
    )
