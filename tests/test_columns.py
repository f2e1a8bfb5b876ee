"""Column functions on edge tables, with values worked out by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from reviewmill.fixed import GENDER_NORMS, NULL_SPELLINGS
from reviewmill import sizes
from reviewmill.functions import categories, dates, numbers, text, vectors
from reviewmill.plans import standardize


def apply(spark, function, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["out"] for r in df.orderBy("i").select("i", function(F.col("v")).alias("out")).orderBy("i").collect()]


def test_coerce_numeric(spark):
    cells = [" 5 ", "1e3", ".5", "5.", "+3", "-2", "0x10", "1_000", "1,000", "1.0d", "1f", "", "  ",
             "1e400", "\t7\n", "1 2", "nan", "inf", "-Infinity", "\xa05", None, "True"]
    wanted = [5.0, 1000.0, 0.5, 5.0, 3.0, -2.0, None, None, None, None, None, None, None,
              None, 7.0, None, None, float("inf"), float("-inf"), None, None, None]
    assert apply(spark, numbers.coerce_numeric, cells) == wanted


def test_strip_knows_every_space_python_knows(spark):
    cells = ["\t a　", "\x1cb\x1f", "\xa0c ", "", "  ", None, "d e"]
    wanted = [c.strip() if c is not None else None for c in cells]
    assert apply(spark, text.coerce_str, cells) == wanted
    assert apply(spark, text.clean_text, cells) == [w or None for w in wanted]


def test_clean_text_fill(spark):
    assert apply(spark, lambda c: text.clean_text(c, "NA"), [" ", None, "x"]) == ["NA", "NA", "x"]


def test_norm_ws(spark):
    cells = [" a \n\n b c ", "", "\x1d", "x"]
    assert apply(spark, text.norm_ws, cells) == [" ".join(c.split()) for c in cells]


def test_dupkey_keeps_the_ends(spark):
    assert apply(spark, text.norm_text_dupkey, ["  A\n\nB ", None]) == [" a b ", None]


def test_mentions_any(spark):
    cells = ["Long WAIT", "shop online", "no", None, "delayed"]
    assert apply(spark, text.mentions_any, cells) == [True, True, False, False, True]


def test_null_spellings(spark):
    cells = [*NULL_SPELLINGS, "na", "Null", " NA", "0"]
    wanted = [None] * len(NULL_SPELLINGS) + ["na", "Null", " NA", "0"]
    assert apply(spark, text.null_literals, cells) == wanted


def test_fmt_pct(spark):
    assert apply(spark, text.fmt_pct, [0.123, 1.0, 0.0, 0.1225], "double") == ["12.3%", "100.0%", "0.0%", "12.2%"]


def test_dates_first_layout_wins(spark):
    cells = ["2024-02-29", "2023-02-29", "02/03/2024", "13/02/2024", "2024/1/5", "Jan 5, 2024",
             "2024-01-05 10:30:00", "soon", "", None, "2024-01-05T10:30", "99/99/2024"]
    wanted = [dt.datetime(2024, 2, 29), None, dt.datetime(2024, 2, 3), dt.datetime(2024, 2, 13),
              dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 5, 10, 30),
              None, None, None, dt.datetime(2024, 1, 5, 10, 30), None]
    assert apply(spark, dates.coerce_date, cells) == wanted


def test_order_of_day_and_month_is_voted_by_source(spark):
    cells = {
        "day": ["03/04/2024", "25/12/2024", "31-01-2024", "04-03-2024 10:30", "2024-04-03", "04/25/2024", None],
        "month": ["03/04/2024", "12/25/2024", "04-03-2024", "25/12/2024", "01/31/2024"],
        "open": ["03/04/2024", "04-03-2024", "", "99/99/2024"],  # no cell decides: month first
    }
    rows = [(s, i, c) for s, found in cells.items() for i, c in enumerate(found)]
    df = spark.createDataFrame(rows, "source_file string, ord long, review_date string")
    read = standardize.coerce_types(standardize.apply_facts(df, standardize.source_facts(df)))
    got = {(r["source_file"], r["ord"]): r["review_date"] and r["review_date"].strftime("%m-%d") for r in read.collect()}
    wanted = {
        "day": ["04-03", "12-25", "01-31", "03-04", "04-03", "04-25", None],
        "month": ["03-04", "12-25", "04-03", "12-25", "01-31"],
        "open": ["03-04", "04-03", None, None],
    }
    assert got == {(s, i): d for s, found in wanted.items() for i, d in enumerate(found)}
    assert "_day_first" not in read.columns


@pytest.mark.parametrize(
    ("top", "scale"),
    [(None, 5), (0.0, 5), (5.0, 5), (5.1, 10), (10.0, 10), (10.5, 100), (100.0, 100), (100.1, 5)],
)
def test_scale(spark, top, scale):
    assert apply(spark, numbers.scale_from_max, [top], "double") == [scale]


def test_tips(spark):
    rows = [(None, 100.0, 20.0), (0.0, 100.0, 50.0), (10.0, 100.0, 50.0), (None, 0.0, 5.0),
            (None, -1.0, 5.0), (None, 100.0, None), (45.0, None, None), (0.0, None, 5.0)]
    df = spark.createDataFrame(rows, "p double, t double, a double").coalesce(1)
    filled = numbers.tip_fill(F.col("p"), F.col("t"), F.col("a"))
    got = df.select(filled.alias("f"), numbers.tip_cap(filled).alias("c")).collect()
    assert [r["f"] for r in got] == [20.0, 50.0, 10.0, None, None, None, 45.0, 0.0]
    assert [r["c"] for r in got] == [20.0, 30.0, 10.0, None, None, None, 30.0, 0.0]


def test_log_spent_keeps_null(spark):
    got = apply(spark, numbers.log_spent, [None, -5.0, 0.0, 1.718281828459045], "double")
    assert got[0] is None and got[1:3] == [0.0, 0.0] and abs(got[3] - 1) < 1e-12


def test_category(spark):
    cells = ["m", "female", "agender", None, "prefer not to say"]
    got = apply(spark, lambda c: categories.map_category(c, GENDER_NORMS), cells)
    assert got == ["male", "female", "agender", None, "na"]
    assert apply(spark, lambda c: categories.is_unmapped(c, GENDER_NORMS), cells) == [
        False, False, True, False, False]


def test_round_even(spark):
    assert apply(spark, lambda c: numbers.round_even(c, 2), [0.125, 0.375, 2.5], "double") == [0.12, 0.38, 2.5]


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    rows = df.select(vectors.cosine(F.col("a"), F.col("b")).alias("c"), vectors.l2(F.col("a"), F.col("b")).alias("d")).collect()
    assert abs(rows[0]["c"] - 0.5**0.5) < 1e-12 and rows[1]["c"] == 0.0
    assert rows[0]["d"] == 1.0 and abs(rows[1]["d"] - 2**0.5) < 1e-12


def test_row_key_is_stable(spark):
    df = spark.createDataFrame([("r", dt.datetime(2024, 1, 2), 1), (None, None, 2)], "n string, d timestamp_ntz, o long")
    key = categories.row_key(F.col("n"), F.col("d"), F.col("o"))
    first = [r[0] for r in df.select(key).collect()]
    assert first == [r[0] for r in df.repartition(5).select(key, "o").orderBy("o").collect()]
    assert first[0].startswith("r_2024-01-02 00:00:00_") and first[1].startswith("NA_NA_")


def test_a_side_is_broadcast_by_its_bytes(spark):
    rows = spark.range(200).select("id", F.repeat(F.lit("x"), 100_000).alias("text"))
    plan = lambda df: df._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" in plan(sizes.broadcast_if_small(rows))
    assert "ResolvedHint" not in plan(sizes.broadcast_if_small(rows, max_bytes=2_000_000))
    assert "ResolvedHint" not in plan(sizes.broadcast_if_small(rows, max_rows=199))
    assert "ResolvedHint" in plan(sizes.broadcast_if_small(rows.limit(0)))
    fetched = sizes._fetched(rows, 1000, 2_000_000)
    assert 2_000_000 < fetched.nbytes < 2_500_000
    assert sizes._fetched(rows, 150, 1 << 30).num_rows == 150
