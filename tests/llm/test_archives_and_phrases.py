"""Archives, resampling and phrases against plain Python."""

import base64
import gzip
import hashlib
import io
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from reviewmill.llm import common, phrases, resample, warc


def fold(text):
    return "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or "")


# --- archives ----------------------------------------------------------------

PAGES = "page_id bigint, url string, html string, digest string, row int"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], PAGES).repartition(3)


def records_of(rows, least):
    groups = defaultdict(list)
    for i, _, html in rows:
        groups[html or ""].append(i)
    out = []
    for html, ids in groups.items():
        data = html.encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        first = min((x is None, x) for x in ids)[1] if len(set(ids)) > 1 else ids[0]
        alike = len(data) >= least
        for n, i in enumerate(sorted(ids, key=lambda x: (x is None, x or 0))):
            again = alike and n > 0
            out.append((i, len(data), digest, "revisit" if again else "response", first if again else None))
    return Counter(out)


@pytest.mark.parametrize("least", [0, 6])
def test_archives(spark, least):
    rng = random.Random(3)
    rows = [(i, f"http://a.example/{i}\r\nX: y", "é€ " * rng.randrange(4000) + str(i)) for i in range(60)]
    rows += [(100 + i, None, "the same page" * 30) for i in range(200)]  # a hot payload
    rows += [(7, "u", "twice"), (7, "u", "twice"), (None, "u", "twice"), (None, None, None), (None, "u", ""), (500, "u", None),
             (501, "u", "WARC/1.1\r\n\r\n\x1f\x8b"), (502, "u", "long" * 500_000)]
    found = warc.archived_pages(pages(spark, rows), least_bytes=least)
    assert Counter(tuple(r) for r in found.collect()) == records_of(rows, least)
    assert warc.archived_pages(pages(spark, [])).collect() == []


def test_conditions_are_tested_on_headers(spark, tmp_path, monkeypatch):
    rows = [(i, f"http://a.example/{i}", "same" if i % 3 else f"page {i}" * 999) for i in range(50)]
    path = str(tmp_path / "archives")
    warc.write_archives(pages(spark, rows), path)
    assert all(not f.startswith("records") or os.path.getsize(f"{path}/{f}") for f in os.listdir(path))
    with open(f"{path}/records-999999-lost.warc.gz", "wb") as f:  # of a task that was never committed
        f.write(warc.member(warc.record_bytes("response", {"Page-Id": "1"}, b"x")))
    every = warc.read_archives(spark, path, split_bytes=3000)
    assert every.count() == 50
    for condition, n in [
        ("record_type = 'revisit'", 32), ("record_type in ('response', 'metadata')", 18), ("refers_to is null", 18),
        ("not record_type = 'revisit' and content_length > 70", 17), ("target_uri like 'http://a.example/1%'", 11),
        ("record_type = 'revisit' and headers['page-id'] = '2'", 1), ("record_type <=> null", 0),
    ]:
        assert every.where(condition).count() == n, condition
    plan = every.where("record_type = 'revisit'")._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan and "Filter record_type" not in plan
    assert warc.read_archives(spark, path, payload=False).where("payload is not null").count() == 0


def test_unwanted_payloads_are_not_inflated(monkeypatch):
    big = os.urandom(300_000)
    data = b"".join(warc.member(warc.record_bytes(k, {"N": str(i)}, big)) for i, k in enumerate(["resource", "metadata"] * 5))
    read = []
    monkeypatch.setattr(warc._Gzip, "block", lambda self, n, real=warc._Gzip.block: read.append(n) or real(self, n))
    source = io.BufferedReader(io.BytesIO(data), 4096)
    found = list(warc.records(source, 0, len(data), lambda h: h["warc-type"] == "metadata" and h["n"] == "3"))
    assert len(read) == 1 and found[0][2] == big and found[0][1]["n"] == "3"
    assert gzip.decompress(data).count(big) == 10  # any gzip reader reads them


def test_foreign_archives(spark, tmp_path):
    """Uncompressed, in one gzip member per record without lengths, with folded headers, and nothing at all."""
    body = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n" + b"payload\r\n\r\nof it" * 9000
    record = (
        b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: http://x/\r\n  y\r\nContent-Type: application/http\r\n"
        b"content-length: %d\r\n\r\n" % len(body) + body + b"\r\n\r\n"
    )
    other = warc.record_bytes("metadata", {"Content-Type": None}, b"")
    (tmp_path / "a.warc").write_bytes(record + other + record)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(record) + gzip.compress(other) + gzip.compress(record))
    (tmp_path / "c.warc.gz").write_bytes(b"")
    for payload in (True, False):
        found = warc.read_archives(spark, str(tmp_path), payload=payload).collect()
        assert Counter(r["record_type"] for r in found) == {"response": 4, "metadata": 2}
        for r in found:
            if r["record_type"] == "response":
                assert r["target_uri"] == "http://x/ y" and r["content_length"] == len(body)
                assert r["payload"] == (bytearray(body.partition(b"\r\n\r\n")[2]) if payload else None)
    assert warc.read_archives(spark, str(tmp_path / "a.warc")).where("record_type = 'metadata'").count() == 1
    (tmp_path / "d.warc").write_bytes(b"no record\r\n\r\n")
    with pytest.raises(Exception, match="no WARC record"):
        warc.read_archives(spark, str(tmp_path / "d.warc")).collect()


# --- resampling --------------------------------------------------------------

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    words = WORD.findall(fold(text))
    return words, words + [" ".join(p) for p in zip(words, words[1:])]


def drawn(rows, target, buckets, least, percent, seed=7):
    of = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(map(of, features(text)[1]))
    for text in target:
        t.update(map(of, features(text)[1]))
    all_s, all_t = s.total(), t.total()
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)]
    out = []
    for i, text in rows:
        words, f = features(text)
        weight = sum(gain[of(x)] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(words), len(f), weight, score, None])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for n, r in enumerate(able[: percent * len(able) // 100]):
        r[5] = n + 1
    return Counter(map(tuple, out))


def test_crc_of_equal_lengths():
    rng = np.random.default_rng(1)
    for length in (0, 1, 7, 300):
        rows = rng.integers(0, 256, (50, length), dtype=np.uint8)
        assert resample.crc_rows(rows).tolist() == [zlib.crc32(r.tobytes()) for r in rows]


def test_features_of_texts():
    texts = ["", None, "One two ONE two", "é_x9 " * 3 + "ü" * 700 + " a", "!!", "w" * 511 + " b", "z"]
    found, one, left, two = resample.feature_crcs(pa.array(texts))
    at = 0
    for i, text in enumerate(texts):
        words, every = features(text)
        assert one[at : at + len(words)].tolist() == [zlib.crc32(w.encode()) for w in words]
        mine = (left >= at) & (left < at + len(words))
        assert two[mine].tolist() == [zlib.crc32(w.encode()) for w in every[len(words) :]]
        at += len(words)
    assert at == len(found.words)


@pytest.mark.parametrize("percent", [25, 100])
def test_draw(spark, percent):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcÄé1") for _ in range(rng.randrange(1, 5)))
    rows = [(i, " ".join(word() for _ in range(rng.randrange(0, 40)))) for i in range(300)]
    rows += [(5, rows[5][1])] * 3 + [(None, "a b c d e f g")] * 40 + [(900, None), (901, ""), (902, "?! ."), (903, "x " * 30_000)]
    target = [" ".join(word() for _ in range(50)) for _ in range(5)] + [None, ""]
    df = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], "doc_id bigint, text string, score string, rank int, hashes int")
    goal = spark.createDataFrame([(t, 1) for t in target], "text string, words int")
    found = resample.draw(df.repartition(4), goal, percent, buckets=97, least_words=5)
    got = Counter(tuple(r) for r in found.select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect())
    ranks = lambda counter: sorted(r[5] for r in counter.elements() if r[5])
    expected = drawn(rows, target, 97, 5, percent)
    assert got == expected and ranks(got) == list(range(1, len(ranks(got)) + 1))
    assert resample.draw(df.limit(0), goal).collect() == []
    alone = resample.draw(df.limit(9), goal.limit(0), buckets=97, least_words=5)
    assert alone.count() == 9


# --- phrases -----------------------------------------------------------------


def phrase_counts(rows, longest, least):
    n, f = Counter(), defaultdict(Counter)
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", fold(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in range(1, longest + 1):
                f[lang].update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    return n, {lang: {p: a for p, a in c.items() if a >= least} for lang, c in f.items()}


def ranked(rows, longest, least, top, covered=100):
    n, f = phrase_counts(rows, longest, least)
    out = []
    for lang, counts in f.items():
        found = []
        for p, a in counts.items():
            if len(p) < 2:
                continue
            whole = [b for q, b in counts.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if any(100 * b >= covered * a for b in whole):
                continue
            cuts = [(1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def phrase_rows(seed, size=250):
    rng = random.Random(seed)
    fixed = ["new york city hall", "a b a b a b a b", "Über allen Gipfeln ist Ruh", "x y"]
    rows = []
    for _ in range(size):
        parts = [rng.choice(fixed) if rng.random() < 0.3 else rng.choice("abcdefgh") for _ in range(rng.randrange(60))]
        text = "".join(p + rng.choice([" ", " ", "\t ", " ", ". ", ",", "\n", "\r\n", " ; "]) for p in parts)
        rows.append((rng.choice(["en", "en", "en", "de", None, ""]), text))
    return rows + [("en", None), (None, ""), ("fr", " . "), ("en", "x y " * 2000)]


@pytest.mark.parametrize("shards, slots", [(1, 10), (3, 16), (4, 5)])
def test_phrases(spark, monkeypatch, shards, slots):
    """Also with so few slots that most phrases share one."""
    monkeypatch.setattr(common, "CHUNK_CHARS", 2500)
    monkeypatch.setattr(phrases, "BUCKET_WORDS", 500)
    rows = phrase_rows(shards)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "lang string, text string, chunk string, n int").repartition(3)
    found = phrases.collocations(df, top=30, threshold=12, shards=shards, slot_bits=slots)
    assert sorted(map(tuple, found.collect())) == ranked(rows, 5, 12, 30)
    few = phrases.collocations(df, top=5, covered=80, threshold=40, longest=3, shards=shards, slot_bits=slots)
    assert sorted(map(tuple, few.collect())) == ranked(rows, 3, 40, 5, covered=80)


def test_lengths_are_counted_side_by_side(spark, monkeypatch):
    """Longer phrases start in the first cycle, and every phrase of a chunk is sent once."""
    monkeypatch.setattr(common, "CHUNK_CHARS", 2500)
    rows = phrase_rows(9)
    df = spark.createDataFrame(rows, "lang string, text string").repartition(6)
    counts, totals = phrases.count_phrases(df, threshold=12, shards=3)
    n, f = phrase_counts(rows, 5, 12)
    assert {(r["lang"], tuple(r["words"])): r["f"] for r in counts.collect()} == {
        (lang, p): a for lang, c in f.items() for p, a in c.items()}
    assert {r["lang"]: r["n"] for r in totals.collect()} == dict(n)
    reached = np.full(1 << 16, phrases.NEVER, np.uint8)
    row = pa.RecordBatch.from_pydict({"lang": [["en"]], "text": [["a b c a b d"]]})
    words = phrases._Words(row)
    assert phrases._counted(words, reached, 0, 3, 5)[1]["length"].tolist() == [1] * 4
    shift = np.uint64(48)
    for w in ("a", "b"):
        reached[int(common.mix(words.keys)[words.spelled().index(w)] >> shift)] = 0
    keys, entries = phrases._counted(words, reached, 1, 3, 5)
    assert sorted(zip(entries["length"].tolist(), entries["n"].tolist(), entries["start"].tolist())) == [
        (1, 1, 0), (1, 1, 0), (1, 2, 0), (1, 2, 0), (2, 2, 1)]
    assert len(phrases._counted(words, reached, 4, 3, 5)[0]) == 0  # a cycle later all is counted


def test_no_phrases(spark):
    empty = spark.createDataFrame([], "lang string, text string")
    assert phrases.collocations(empty).collect() == []
    assert phrases.collocations(spark.createDataFrame([("en", "a b"), (None, None)], "lang string, text string")).collect() == []
