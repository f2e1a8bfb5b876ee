"""Streams over several micro-batches, with replays and side by side."""

import os
import random


from reviewmill.streaming import intake

HEADERS = ["review_id", "review_text", "rating"]


def write(folder, number, rows):
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, f"f{number:03d}.csv")
    with open(path, "w") as out:
        out.write(",".join(HEADERS) + "\n" + "".join(",".join(map(str, r)) + "\n" for r in rows))
    os.utime(path, (1_000_000 + number, 1_000_000 + number))


def arriving(spark, folder):
    return intake.read_reviews(spark, folder, HEADERS, files_per_batch=1, source="s.csv")


def test_dedup_looks_up_its_own_texts_only(spark, tmp_path):
    """Repeats in a file, over files, of a missing text, and of one that half of the rows hold."""
    rng = random.Random(4)
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    first, n = {}, 0
    for number in range(20):
        rows = []
        for i in range(60):
            text = rng.choice(["the same", f"text {rng.randrange(400)}", f"own {number} {i}", ""])
            rows.append((f"{number}-{i}", text, i % 5))
            first.setdefault(text, f"{number}-{i}")
        n += len(rows)
        write(folder, number, rows)
    progress = intake.stream_dedup(arriving(spark, folder), out, str(tmp_path / "log"))
    found = {r["review_text"] or "": r["review_id"] for r in spark.read.parquet(out).collect()}
    assert found == first and spark.read.parquet(out).count() == len(first)
    batches = [p for p in progress if p["numInputRows"]]
    assert len(batches) == 20 and all(p["numInputRows"] == 60 for p in batches)
    assert batches[-1]["stateOperators"][0]["numRowsTotal"] == len(first)
    assert all(p["stateOperators"][0]["numRowsUpdated"] <= 60 for p in batches)
    # a batch that runs again after its commit was lost leaves the same rows
    os.remove(str(tmp_path / "log" / "commits" / "19"))
    for crc in (tmp_path / "log" / "commits").glob(".19.crc"):
        os.remove(crc)
    intake.stream_dedup(arriving(spark, folder), out, str(tmp_path / "log"))
    assert {r["review_text"] or "": r["review_id"] for r in spark.read.parquet(out).collect()} == first


def test_counts_of_two_streams_and_a_replay(spark, tmp_path):
    for name, files in (("a", 3), ("b", 2)):
        for number in range(files):
            write(str(tmp_path / name), number, [(i, "t" if i % 2 else "", "x" if i % 3 else i) for i in range(12)])

    def counts(name):
        base = tmp_path / f"of-{name}"
        totals = intake.stream_counts(arriving(spark, str(tmp_path / name)), *(str(base / x) for x in ("rows", "counts", "log")))
        return tuple(totals.first())

    assert counts("a") == (36, 18, 12)
    assert counts("b") == (24, 12, 8)
    for crc in (tmp_path / "of-a" / "log" / "commits").glob("*2*"):
        os.remove(crc)
    assert counts("a") == (36, 18, 12)
    assert spark.read.parquet(str(tmp_path / "of-a" / "rows")).count() == 36


def test_first_of_a_batch_of_many_files(spark, tmp_path):
    """All files are met at once; the first by path and position counts, and state is no Python group."""
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    rng = random.Random(9)
    first = {}
    for number in range(12):
        rows = [(f"{number}-{i}", f"text {rng.randrange(80)}", 1) for i in range(50)]
        for review, text, _ in rows:
            first.setdefault(text, review)
        write(folder, number, rows)
    whole = intake.read_reviews(spark, folder, HEADERS, files_per_batch=100, source="s.csv")
    progress = intake.stream_dedup(whole, out, str(tmp_path / "log"))
    assert {r["review_text"]: r["review_id"] for r in spark.read.parquet(out).collect()} == first
    state = next(p for p in progress if p["numInputRows"])["stateOperators"][0]
    assert state["operatorName"] == "dedupe" and state["numRowsTotal"] == len(first)


def test_staged_files_are_bounded(spark, small, monkeypatch):
    """More rows make more files of the same size, in as many micro-batches."""
    import glob

    from reviewmill.catalog import streams

    monkeypatch.setattr(streams, "FILE_ROWS", 20)
    files = streams.n_files(spark, small)
    assert files == 10
    found = glob.glob(streams.staged(spark, small) + "/part-*.csv")
    assert len(found) == files
