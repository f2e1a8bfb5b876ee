"""Exact quantiles of any number of columns of any size, in two passes.

``percentile`` keeps every distinct value of a group in one task. Here a first pass makes a mergeable
sketch of every column. Around each wanted rank the sketch gives an interval that surely holds it. The
second pass counts, for all columns at once, the values inside of the intervals and the rows between
them. The sketch only steers; the counts are exact, so the answer is too.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The sketch is off by at most a row in so many, so an interval holds a few times that share.
ACCURACY = 100_000
# Kinds of counted entries: rows below all intervals, a value in one, rows after one.
BELOW, VALUE, AFTER = 0, 1, 2


@dataclass(frozen=True)
class Spot:
    """A wanted place among n ascending values: about a share of them, exactly ``place(n)``, from 0.

    Between two values it is interpolated.
    """

    share: float
    place: Callable[[Column], Column]


def linear(q: float) -> Spot:
    """The linearly interpolated quantile."""
    return Spot(q, lambda n: (n - 1) * F.lit(float(q)))


def present(column: str) -> Column:
    """The column's numbers; missing ones are left out."""
    value = F.col(column).cast("double")
    return F.when(~F.isnan(value), value)


def sketches(df: DataFrame, columns: Sequence[str], spots: Sequence[Spot], accuracy: int = ACCURACY, facts=None) -> DataFrame:
    """One row with a struct per column, c0, c1 and so on: rows ``n`` and ``cuts`` around the spots.

    ``facts(column)`` adds aggregates to a column's struct.
    """
    points = F.array(*[F.lit(p) for spot in spots for pair in _points(spot, accuracy) for p in pair])
    found = [
        F.struct(
            F.count(present(c)).alias("n"), F.percentile_approx(present(c), points, accuracy).alias("cuts"),
            *(facts(c) if facts else []),
        ).alias(f"c{i}")
        for i, c in enumerate(columns)
    ]
    return df.agg(F.struct(*found).alias("sketch"))


def _margins(accuracy: int) -> list[float]:
    """Shares to either side of a spot; the last one covers all rows."""
    found = [2 / accuracy]
    while found[-1] < 1:
        found.append(min(1.0, found[-1] * 16))
    return found


def _points(spot: Spot, accuracy: int) -> list[tuple[float, float]]:
    return [(max(0.0, spot.share - m), min(1.0, spot.share + m)) for m in _margins(accuracy)]


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], spots: Sequence[Spot], accuracy: int = ACCURACY,
    sketch: DataFrame | None = None,
) -> DataFrame:
    """(column, values): the value at each spot, a row per column that has any value.

    ``sketch`` is the result of ``sketches`` for the same columns and spots. Nothing runs before the
    result is asked for.
    """
    sketch = sketch if sketch is not None else sketches(df, columns, spots, accuracy)
    one = df.sparkSession.range(1, numPartitions=1)
    bounds = one.select(sketch.scalar().alias("s")).select(
        F.struct(*[_bounds(F.col(f"s.c{i}"), spots, accuracy).alias(f"c{i}") for i in range(len(columns))]).alias("b")
    )
    rows = df.select(*[present(c).alias(f"v{i}") for i, c in enumerate(columns)]).withColumn("b", bounds.scalar())
    entries = [_entry(i, len(spots)) for i in range(len(columns))]
    counted = (
        rows.select(F.inline(F.array(*entries))).where(F.col("x").isNotNull())
        .groupBy("i", "x", "kind").agg(F.count(F.lit(1)).alias("n"))
    )
    # per column the few rows inside the intervals, each value once
    ascending = Window.partitionBy("i").orderBy("x", "kind").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.withColumns({
        "to": F.sum("n").over(ascending), "total": F.sum("n").over(Window.partitionBy("i")),
    })
    ends = []
    for j, spot in enumerate(spots):
        place = spot.place(F.col("total"))
        low = F.floor(place).cast("long")
        ends += [
            F.max(_at(low + 1)).alias(f"low{j}"), F.max(_at(F.least(low + 2, "total"))).alias(f"high{j}"),
            F.max(place - low).alias(f"part{j}"),
        ]
    values = [_between(F.col(f"low{j}"), F.col(f"high{j}"), F.col(f"part{j}")) for j in range(len(spots))]
    name = F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("i") + 1)
    return ranked.groupBy("i").agg(*ends).select(name.alias("column"), F.array(*values).alias("values"))


def _bounds(sketch: Column, spots: Sequence[Spot], accuracy: int) -> Column:
    """lo0, hi0 and so on: intervals that surely hold the spots' ranks and their neighbours'."""
    margins = _margins(accuracy)
    need = 1.5 / accuracy + F.lit(3.0) / F.greatest(sketch["n"], F.lit(1))
    step = F.size(F.filter(F.array(*[F.lit(m) for m in margins[:-1]]), lambda m: m < need))
    fields = []
    for j in range(len(spots)):
        first = 2 * j * len(margins)
        fields.append(F.get(sketch["cuts"], first + 2 * step).alias(f"lo{j}"))
        fields.append(F.get(sketch["cuts"], first + 2 * step + 1).alias(f"hi{j}"))
    return F.struct(*fields)


def _entry(i: int, n_spots: int) -> Column:
    """What a row adds to a column: its value inside of an interval, else the last interval below it."""
    v, b = F.col(f"v{i}"), F.col(f"b.c{i}")
    inside = reduce(Column.__or__, [(v >= b[f"lo{j}"]) & (v <= b[f"hi{j}"]) for j in range(n_spots)])
    passed = [F.when(b[f"hi{j}"] < v, b[f"hi{j}"]) for j in range(n_spots)]
    below = F.greatest(*passed) if n_spots > 1 else passed[0]
    least = F.lit(float("-inf"))
    return F.struct(
        F.lit(i).alias("i"),
        F.when(inside, v).when(v.isNotNull(), F.coalesce(below, least)).alias("x"),
        F.when(inside, VALUE).when(below.isNull(), BELOW).otherwise(AFTER).alias("kind"),
    )


def _at(rank: Column) -> Column:
    hit = (F.col("kind") == VALUE) & (F.col("to") >= rank) & (F.col("to") - F.col("n") < rank)
    return F.when(hit, F.col("x"))


def _between(low: Column, high: Column, part: Column) -> Column:
    outside = F.raise_error(F.lit("a wanted rank lies outside of its interval")).cast("double")
    between = F.when((part == 0) | (low == high), low).otherwise(low + (high - low) * part)
    return F.when(low.isNull() | high.isNull(), outside).otherwise(between)
