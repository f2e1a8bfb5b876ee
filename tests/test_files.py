"""Scans of small files with the header and cell variants of the reference inputs."""

import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from reviewmill.plans import standardize
from reviewmill.sources import files, headers, sinks


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="reviews-")


def put(folder, name, content, encoding="utf-8"):
    path = os.path.join(folder, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding=encoding, newline="") as out:
        out.write(content)
    return path


def test_header_rules():
    assert headers.normalize_header("  Guest \t Name ") == "guest_name"
    assert headers.simple_header(" Avg  Stars") == "avg__stars"
    mapped = headers.map_columns(["ID", "Review Number", "Date", "visit_date", "other"])
    assert mapped == {"review_id": "Review Number", "review_date": "Date"}
    with pytest.raises(ValueError, match="two columns"):
        headers.map_columns(["Rating", " rating "])


@pytest.mark.parametrize(
    ("line", "delimiter"),
    [("a,b;c;d", ";"), ("a\tb\tc,d", "\t"), ("a;b\tc", "\t"), ("a;b;c,d,e", ","), ("a", ","), ("a;b,c", ","), ("a\tb,c", ",")],
)
def test_choose_delimiter(line, delimiter):
    assert headers.choose_delimiter(line) == delimiter


def test_sniff_ignores_quotes():
    assert headers.sniff_delimiter('"a,b,c";d;e') == ";"
    assert headers.sniff_delimiter("a|b|c") == "|"
    assert headers.sniff_delimiter("a;b,c") == ","


def test_scan_maps_headers_and_missing_cells(spark, folder):
    folder = os.path.join(folder, "with space %41")
    put(folder, "a.csv", ' Review Number ,Guest Name,Rating\n1, Ann ,4\n2,NA,NaN\n3,"",5\n,,\n')
    put(folder, "b.txt", "id;comments;rating_out_of_10\n7;\"two\nlines; \"\"quoted\"\"\";8\n")
    put(folder, "notes.json", "{}")
    put(folder, "empty.csv", "")
    put(folder, "other.csv", "x,y\n1,2\n")
    sources = files.resolve_sources(spark, files.list_sources(spark, folder))
    assert {s.name: s.status for s in sources} == {
        "a.csv": "ok", "b.txt": "ok", "empty.csv": "unreadable", "other.csv": "ok"}
    rows = files.scan_reviews(spark, sources).orderBy("ord").collect()
    got = [(r["source_file"], r["review_id"], r["customer_name"], r["rating_raw"], r["review_text"]) for r in rows]
    assert got == [
        ("a.csv", "1", " Ann ", "4", None),
        ("a.csv", "2", None, None, None),
        ("a.csv", "3", None, "5", None),
        ("b.txt", "7", None, "8", 'two\nlines; "quoted"'),
    ]
    flagged = files.scan_reviews(spark, sources, drop_empty=False)
    assert flagged.count() == 6 and flagged.filter("has_content").count() == 4


def test_nothing_to_read(spark, folder):
    put(folder, "notes.json", "{}")
    with pytest.raises(FileNotFoundError):
        files.discover_files(spark, folder)
    with pytest.raises(ValueError, match="unsupported"):
        files.scan_csv(spark, os.path.join(folder, "notes.json"))


def test_lossy_bytes_and_empty_body(spark, folder):
    path = put(folder, "latin.csv", "review_id;review_text\n1;caf\xe9\n", "latin-1")
    assert files.scan_by_header(spark, path).collect()[0]["review_text"] == "caf�"
    assert files.scan_by_header(spark, put(folder, "none.csv", "  \n")).count() == 0


def test_null_scale_without_rating_column(spark, folder):
    put(folder, "a.csv", "id,comments\n1,x\n")
    put(folder, "b.csv", "id,rating\n1,many\n")
    sources = files.resolve_sources(spark, files.list_sources(spark, folder))
    rows = standardize.standardize(files.scan_reviews(spark, sources)).collect()
    assert {r["source_file"]: r["rating_scale"] for r in rows} == {"a.csv": None, "b.csv": 5}


@pytest.fixture
def awkward(folder):
    """Records with quoted line breaks, quotes and delimiters, in files of several blocks."""
    rng = random.Random(3)
    pieces = ["word", "two\nlines", "a\n\n\nb", 'say "hi"', "x,y", "end\r\nwin", '"', "", "é\n"]
    records = []
    for f in range(3):
        lines = ["review_id,comments,location"]
        for i in range(400):
            text = " ".join(rng.choice(pieces) for _ in range(rng.randint(1, 9)))
            records.append((f"{f}-{i}", text, f"loc{i}"))
            lines.append('{},"{}",{}'.format(f"{f}-{i}", text.replace('"', '""'), f"loc{i}"))
        put(folder, f"f{f}.csv", "\n".join(lines) + "\n")
    return folder, records


@pytest.mark.parametrize("multi_line", ["auto", True, "stitch"])
@pytest.mark.parametrize("split", [1_000, 10_000_000])
def test_order_and_content_do_not_depend_on_splits(spark, awkward, multi_line, split):
    folder, records = awkward
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    try:
        sources = files.resolve_sources(spark, files.list_sources(spark, folder))
        rows = files.scan_reviews(spark, sources, multi_line).orderBy("ord").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [r["review_id"] for r in rows] == [r[0] for r in records]
    assert [r["location"] for r in rows] == [r[2] for r in records]
    assert len({r["ord"] for r in rows}) == len(records)
    same = sum((r["review_text"] or "") == t for r, (_, t, _) in zip(rows, records))
    assert same == len(records)


@pytest.mark.parametrize("delimiter", [",", ";"])
def test_stitch_reads_stray_quotes_like_the_plain_reader(spark, folder, delimiter):
    rng = random.Random(8)
    bare = ['5" pipe', 'a"b"c', 'x"', "plain", "", " \"late", 'a""']
    quoted = ['"two\nlines"', '"a""b\n\n""c"', '""', '"x,y;z\n"', '"closed"rest"', '"end\r\nwin"', '"""\n"']
    for f in range(2):
        lines = [delimiter.join(["id", "comments", "location"])]
        for i in range(300):
            lines.append(delimiter.join([f"{f}-{i}", rng.choice(bare + quoted), rng.choice(bare + quoted)]))
        put(folder, f"f{f}.csv", "\n".join(lines) + "\n")
    paths = files.list_files(spark, folder)

    def read(multi_line):
        rows = files.read_delimited(spark, paths, ["id", "comments", "location"], delimiter, multi_line)
        return [tuple(r)[:3] for r in rows.orderBy("_path", "_position").collect()]

    wanted = read(True)
    assert [r[0] for r in wanted] == [f"{f}-{i}" for f in range(2) for i in range(300)]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    try:
        for split in (300, 2_000, 10_000_000):
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
            assert read("stitch") == wanted
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_only_lines_that_cross_a_split_are_grouped(spark, folder):
    """One scan of the text; records are not shuffled, but for those that meet a split's first lines or end."""
    lines = ["id,comments"] + [f'{i},"a\nb {i}"' if i % 3 else f"{i},plain" for i in range(3000)]
    path = put(folder, "a.csv", "\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    try:
        rows = files.read_delimited(spark, [path], ["id", "comments"])
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted(int(r["id"]) for r in rows.collect()) == list(range(3000))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "text" not in [x.strip() for x in plan.split()]
    grouped = []

    def count(node):
        if node.nodeName() == "Aggregate":
            frame = spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(rows._jdf.sparkSession(), node.children().head())
            grouped.append(frame.count())
        children = node.children()
        for i in range(children.size()):
            count(children.apply(i))

    count(rows._jdf.queryExecution().analyzed())
    pieces = len(open(path).read()) // 4000
    assert 0 < max(grouped) < 5 * pieces


def test_stray_quotes(spark, folder):
    path = put(folder, "a.csv", 'id,comments\n1,5" pipe\n2,"said ""so"""\n3,x"\n')
    assert [r["comments"] for r in files.scan_csv(spark, path).collect()] == ['5" pipe', 'said "so"', 'x"']


def test_csv_splits_keep_order(spark, folder):
    for f in range(4):
        put(folder, f"f{f}.csv", "id,location\n" + "".join(f"{f}-{i},x\n" for i in range(500 * (f + 1))))
    wanted = [f"{f}-{i}" for f in range(4) for i in range(500 * (f + 1))]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for split in (700, 3_000, 10_000_000):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
        spark.conf.set("spark.sql.files.openCostInBytes", "10")
        sources = files.resolve_sources(spark, files.list_sources(spark, folder))
        rows = files.scan_reviews(spark, sources, False).orderBy("ord").collect()
        assert [r["review_id"] for r in rows] == wanted
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_rerun_replaces_only_its_sources(spark, folder):
    out = os.path.join(folder, "out")
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "source_file string, x int")
    sinks.write_per_source(rows, out)
    sinks.write_per_source(spark.createDataFrame([("b", 3)], "source_file string, x int"), out)
    assert sorted(spark.read.parquet(out).select("source_file", "x").collect()) == [("a", 1), ("b", 3)]


def test_csv_round_trip(spark, folder):
    out = os.path.join(folder, "final.csv")
    texts = ['a "b"\nc', "x,y", None, "back\\slash", "plain"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for quote_all in (False, True):
        sinks.write_csv(df, out, quote_all)
        got = files.scan_csv(spark, out).orderBy(F.col("i").cast("int")).collect()
        assert [r["t"] for r in got] == texts


def test_paths_with_special_characters_keep_their_ranks(spark, folder):
    for name in ("b c.csv", "a%20x.csv", "ü.csv"):
        put(folder, name, "id,location\n1,x\n2,y\n")
    sources = files.resolve_sources(spark, files.list_sources(spark, folder))
    rows = files.scan_reviews(spark, sources).orderBy("ord").collect()
    assert [(r["source_file"], r["review_id"]) for r in rows] == [
        (n, i) for n in ("a%20x.csv", "b c.csv", "ü.csv") for i in ("1", "2")]


@pytest.mark.parametrize("n", [3, 60])
def test_headers_of_all_files_are_read_in_one_job(spark, folder, n):
    for i in range(n):
        put(folder, f"f{i:03d}.{'txt' if i % 3 == 2 else 'csv'}", "\n  \r\nid;a\n" if i % 3 == 2 else f"\nid,c{i % 2}\r\n{i},x\r\n")
    put(folder, "blank.csv", " \n\n")
    sources = files.list_sources(spark, folder)
    sources += files.sources_of([os.path.join(folder, "gone.csv")])
    context = spark.sparkContext
    context.setJobGroup(folder, "headers")
    try:
        resolved = files.resolve_sources(spark, sources)
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert len(context.statusTracker().getJobIdsForGroup(folder)) <= 2  # a shuffle of paths, its reader
    by_name = {s.name: s for s in resolved}
    assert by_name["blank.csv"].error == "file is empty" and by_name["gone.csv"].status == "unreadable"
    assert by_name["f002.txt"].raw_headers == ["id", "a"] and by_name["f002.txt"].delimiter == ";"
    assert by_name["f001.csv"].raw_headers == ["id", "c1"] and by_name["f001.csv"].sizes == [len("\nid,c1\r\n1,x\r\n")]
    rows = files.scan_reviews(spark, resolved).orderBy("ord").collect()
    assert [r["source_file"] for r in rows] == [f"f{i:03d}.csv" for i in range(n) if i % 3 != 2]


def test_ordinals_of_packed_files_do_not_meet(spark, folder):
    """A task counts the rows of all files that it reads, so positions pass the size of a file."""
    for f in range(30):
        put(folder, f"f{f:02d}.csv", "id\n" + "".join(f"{i}\n" for i in range(f % 7)))
    resolved = files.resolve_sources(spark, files.list_sources(spark, folder))
    rows = files.scan_reviews(spark, resolved, False).orderBy("ord").collect()
    assert [(r["source_file"], r["review_id"]) for r in rows] == [
        (f"f{f:02d}.csv", str(i)) for f in range(30) for i in range(f % 7)]
    assert len({r["ord"] for r in rows}) == len(rows)
