"""Word and window hashes, chunks, and the operators on words, against plain Python."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from reviewmill.llm import common, decontaminate, lm, near_dup, substring

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, chunk string, words string, score string, n_words string"


def fold(text):
    return re.sub("[A-Z]+", lambda m: m.group().lower(), text or "")


def words(text):
    return WORD.findall(text or "")


def docs(spark, rows, parts=3):
    """Documents with extra columns whose names the operators use themselves."""
    full = [(i, t, "x", "y", "z", "w") for i, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(parts)


@pytest.fixture(scope="module")
def corpus():
    """Copies, near copies, shared passages, repeats inside a text, ties, nulls, a long text."""
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(300)] + ["Ünd", "naïve", "ÉTÉ", "I am"]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    base, passage = text(120), text(45)
    rows = [(i, text(rng.randint(1, 150))) for i in range(40)]
    for i in range(25):
        changed = base.split(" ")
        for _ in range(rng.randint(0, 4)):
            changed[rng.randrange(len(changed))] = rng.choice(vocab)
        rows.append((100 + i, " ".join(changed)))
    rows += [(200 + i, text(30) + "\n" + passage + "\t" + text(20)) for i in range(6)]
    rows += [(300, passage + " " + text(5) + " " + passage), (301, "one two"), (302, "ONE  two"), (303, "one")]
    rows += [(304, None), (305, ""), (306, " \t\n "), (307, rows[0][1]), (308, rows[0][1].upper())]
    rows += [(309, text(30_000)), (310, "a " * 60), (311, "b\x00c\x1fd " * 30), (312, "a " * 61)]
    return rows


def test_word_hashes_are_those_of_the_words():
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab Zz\té\n\x0b\U0001f600") for _ in range(rng.randint(0, 40))) for _ in range(300)]
    texts += [None, "", "x" * 3_000_000, "A b " * 700_000]
    found = common.Texts(pa.array(texts), lower=True)
    expected = [fold(w) for t in texts for w in words(t)]
    assert found.counts.tolist() == [len(words(t)) for t in texts]
    by_hash = {}
    for h, w in zip(found.words.tolist(), expected):
        assert by_hash.setdefault(h, w) == w
    assert len(by_hash) == len(set(expected))


def test_window_hashes():
    found = common.Texts(pa.array(["a b c a b", None, "b c a"]))
    at, h = found.windows(2)
    assert at.tolist() == [0, 1, 2, 3, 5, 6]
    assert h[0] == h[3] and h[1] == h[4] and h[2] == h[5] and len(set(h.tolist())) == 3


def repeats(rows, window=20):
    seen, out = {}, {}
    ordered = sorted(rows, key=lambda r: r[0])
    for i, t in ordered:
        w = words(t)
        for p in range(len(w) - window + 1):
            seen.setdefault(tuple(w[p : p + window]), (i, p))
    for i, t in ordered:
        w = words(t)
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if seen[tuple(w[p : p + window])] != (i, p):
                gone[p : p + window] = [True] * window
        out[i] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
    return out


def test_substring_dedup(spark, corpus, monkeypatch):
    monkeypatch.setattr(common, "CHUNK_CHARS", 2000)
    found = {r["doc_id"]: r for r in substring.remove_repeats(docs(spark, corpus)).collect()}
    expected = repeats(corpus)
    assert {i: (r["n_words"], r["n_removed"], r["kept"]) for i, r in found.items()} == expected
    assert all(sum(s["last"] - s["first"] + 1 for s in r["spans"]) == r["n_removed"] for r in found.values())
    assert found[310]["n_removed"] == 59 and found[312]["n_removed"] == 61


def test_substring_dedup_edges(spark):
    assert substring.remove_repeats(docs(spark, [])).collect() == []
    passage = " ".join(f"p{i}" for i in range(25))
    rows = [(None, passage), (1, passage), (1, passage), (2, None)]
    found = sorted((r["doc_id"] or 0, r["n_words"], r["n_removed"]) for r in substring.remove_repeats(docs(spark, rows)).collect())
    assert found == [(0, 25, 0), (1, 25, 25), (1, 25, 25), (2, 0, 0)]


def jaccard_components(rows):
    sets = {}
    for n, (i, t) in enumerate(rows):
        w = [fold(x) for x in words(t)]
        sets[n] = {tuple(w[p : p + 4]) for p in range(len(w) - 3)} if len(w) > 3 else ({tuple(w)} if w else set())
    parent = {n: n for n in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                parent[find(b)] = find(a)
    smallest = {}
    for n, (i, _) in enumerate(rows):
        smallest[find(n)] = min(smallest.get(find(n), i), i)
    return Counter((i, len(sets[n]), smallest[find(n)], i == smallest[find(n)]) for n, (i, _) in enumerate(rows))


def near(df):
    return Counter(tuple(r) for r in near_dup.near_duplicates(df).collect())


def test_near_duplicates(spark, corpus):
    assert near(docs(spark, corpus)) == jaccard_components(corpus)


def test_near_duplicates_in_a_group_without_a_centre(spark, monkeypatch):
    """Chains, and copies that are similar to a few others only, in blocks of a few rows."""
    monkeypatch.setattr(near_dup, "BLOCK_ROWS", 7)
    rng = random.Random(5)
    base = [f"w{rng.randrange(5000)}" for _ in range(90)]
    rows = []
    for i in range(60):
        if i % 3 == 0:
            text = list(base)
        for _ in range(rng.randint(1, 2)):
            text[rng.randrange(len(text))] = f"w{rng.randrange(5000)}"
        rows.append((i, " ".join(text)))
    expected = jaccard_components(rows)
    assert 1 < len({c for _, _, c, _ in expected}) < 40
    assert near(docs(spark, rows)) == expected


def test_near_duplicates_edges(spark):
    assert near(docs(spark, [])) == Counter()
    rows = [(7, None), (7, None), (3, "a b c d e"), (3, "a b c d e"), (9, "A b c d e"), (8, "x"), (6, "x"), (5, "")]
    assert near(docs(spark, rows)) == jaccard_components(rows)
    (found,) = near_dup.near_duplicates(docs(spark, [(None, "a b")])).collect()
    assert found["kept"] and found["component_id"] is None


def template_rows(n, shared, own, seed=7):
    """Texts that have a template in common and lines of their own, none similar to another."""
    rng = random.Random(seed)
    common_words = [f"t{i}" for i in range(shared)]
    return [(i, " ".join(common_words + [f"u{rng.randrange(10**9)}" for _ in range(own)])) for i in range(n)]


@pytest.mark.parametrize("own", [30, 60])
def test_a_template_that_many_share(spark, monkeypatch, own):
    """Sketches overlap, but no two texts are similar: pairs stay linear."""
    rows = template_rows(3000, 150, own)
    similar = [(5000 + i, rows[i][1] + " more") for i in range(5)]
    compared = []
    monkeypatch.setattr(near_dup, "_block_links", lambda pairs, sets, labels: compared.append(pairs.count()) or blocks(pairs, sets, labels))
    found = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(docs(spark, rows + similar)).collect()}
    assert found == {i: i if i < 5000 else i - 5000 for i, _ in rows + similar}
    assert compared and sum(compared) < 3 * len(rows)


blocks = near_dup._block_links


def test_rows_without_an_id_are_found_by_their_text(spark, monkeypatch):
    """Two thousand different near copies without an id, or with one: texts are joined once each."""
    base = [f"w{i}" for i in range(200)]
    joined = []
    monkeypatch.setattr(near_dup, "_sets_of", lambda *a: joined.append(sets_of(*a).count()) or sets_of(*a))
    for one in (None, 4):
        rows = [(one, " ".join(base[: i % 190] + [f"x{i}"] + base[i % 190 + 1 :])) for i in range(2000)]
        out = near_dup.near_duplicates(docs(spark, rows)).collect()
        assert len(out) == 2000 and {r["component_id"] for r in out} == {one}
    assert max(joined) <= 2000


sets_of = near_dup._sets_of


def test_rarest_shared_values(spark, monkeypatch):
    """Counts come back to classes that lie in several chunks."""
    monkeypatch.setattr(near_dup, "CHUNK_BYTES", 400)
    rng = random.Random(3)
    sets = [sorted({rng.randrange(60) << rng.choice([0, 58]) for _ in range(rng.randint(1, 30))}) for _ in range(40)]
    often = Counter(v for s in sets for v in s)
    expected = set()
    for i, s in enumerate(sets):
        ranked = sorted((often[v], v) for v in s if often[v] > 1)
        for _, v in ranked[: max(0, len(ranked) - (4 * len(s) + 4) // 5 + 1)]:
            expected.add((i, len(s), len(ranked), v - (1 << 64) * (v >> 63)))
    rows = [(i, len(s), bytearray(np.array(s, np.uint64).tobytes())) for i, s in enumerate(sets)]
    df = spark.createDataFrame(rows, "cls bigint, n bigint, values binary").repartition(3)
    chunks = common.chunk_table(df, "sets", ["cls", "n", "values"], 400)
    assert chunks.count() > 3
    found = near_dup._listed(chunks, near_dup._least_common)
    assert {tuple(r) for r in found.collect()} == expected and expected


def test_texts_that_nobody_wants_stay(spark, monkeypatch):
    """Few texts pass the bitmap, and no join exchanges the sets by class."""
    rows = [(i, f"a{i} b{i} c{i} d{i} e{i}") for i in range(3000)]
    long = [f"w{i}" for i in range(40)]
    rows += [(3000, " ".join(long)), (3001, " ".join(long + ["x"])), (None, " ".join(long + ["y"]))]
    moved, plans = [], []

    def let_through(*a):
        moved.append(through(*a).count())
        return through(*a)

    def stored(df, label):
        if label == "star":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return kept_table(df, label)

    monkeypatch.setattr(near_dup, "_let_through", let_through)
    monkeypatch.setattr(common, "stored", stored)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(docs(spark, rows)).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert found == {i: i for i in range(3001)} | {3001: 3000, None: 3000}
    assert len(moved) == 1 and 3 <= moved[0] < 20
    assert plans and all("Bucketed: true" in p for p in plans)


through, kept_table = near_dup._let_through, common.stored


def test_components(spark):
    edges = [(b"a", b"b"), (b"c", b"b"), (b"d", b"c"), (b"x", b"y"), (b"e", b"d"), (b"f", b"e")]
    df = spark.createDataFrame([(bytearray(a), bytearray(b)) for a, b in edges], "a binary, b binary")
    found = {bytes(r["vertex"]): bytes(r["comp"]) for r in near_dup.components(df).collect()}
    assert found == {**dict.fromkeys([b"a", b"b", b"c", b"d", b"e", b"f"], b"a"), b"x": b"x", b"y": b"x"}


def language_model(rows, train, strength, order):
    counts, held = Counter(), Counter()
    tokens = {n: [fold(w) for w in words(t)] + [None] for n, (_, t) in enumerate(rows)}

    def contexts(text, i):
        """The tokens before the i-th, from none to order - 1, the start mark among them."""
        past = ["", *text[:i]]
        return [tuple(past[len(past) - m :]) for m in range(min(order - 1, len(past)) + 1)]

    for n, (i, _) in enumerate(rows):
        if train(i):
            for at, v in enumerate(tokens[n]):
                for h in contexts(tokens[n], at):
                    counts[h, v] += 1
                    held[h] += 1
    total, types = held[()], sum(1 for h, _ in counts if not h)
    out = []
    for n, (i, _) in enumerate(rows):
        base = score = 0.0
        for at, v in enumerate(tokens[n]):
            p = (counts[(), v] + 1) / (total + types + 1)
            base += math.log10(p)
            for h in contexts(tokens[n], at)[1:]:
                p = (counts[h, v] + strength * p) / (held[h] + strength)
            score += math.log10(p)
        known = sum(counts[(), v] > 0 for v in tokens[n])
        out.append((i, len(tokens[n]), known, total, round(base, 6), round(score, 6)))
    return sorted(out, key=str)


def scored(df, train, order):
    rows = lm.score_texts(df, train, order=order).collect()
    return sorted(
        ((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 6))
         for r in rows), key=str)


def same_scores(found, wanted):
    for a, b in zip(found, wanted, strict=True):
        assert a[:4] == b[:4]
        assert a[4:] == pytest.approx(b[4:], abs=2e-6)


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_lm_scores(spark, corpus, monkeypatch, order):
    monkeypatch.setattr(common, "CHUNK_CHARS", 5000)
    found = scored(docs(spark, corpus), F.col("doc_id") % 3 != 0, order)
    same_scores(found, language_model(corpus, lambda i: i % 3 != 0, lm.STRENGTH, order))


def test_lm_edges(spark):
    assert scored(docs(spark, []), F.lit(True), 3) == []
    rows = [(1, None), (1, None), (2, "a a"), (None, "a"), (3, "a b a"), (4, "")]
    for order in (2, 3):
        same_scores(scored(docs(spark, rows), F.lit(False), order), language_model(rows, lambda i: False, lm.STRENGTH, order))
        known = scored(docs(spark, rows), F.col("doc_id") > 0, order)
        same_scores(known, language_model(rows, lambda i: i is not None, lm.STRENGTH, order))


def test_lm_long_texts_are_read_in_lanes(spark, monkeypatch):
    """Texts of several lanes, and of exactly one, two and three."""
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("abcdefg") for _ in range(n))) for i, n in enumerate([511, 512, 1023, 1024, 1535, 5000, 3])]
    same_scores(scored(docs(spark, rows), F.col("doc_id") != 4, 4), language_model(rows, lambda i: i != 4, lm.STRENGTH, 4))


def test_lm_keys_and_counts_are_packed_without_loss():
    rng = np.random.default_rng(4)
    top = 2**64 - 256
    for keys in ([0], [top], [0, 256], [0, top], [512, 768, 1024, 2**63], rng.integers(0, 2**55, 1000) << 8):
        keys = np.unique(np.array(keys, np.uint64))
        assert np.array_equal(lm._unpacked(lm._packed(keys)), keys)
    for counts in ([], [0], [14, 15], [15, 0, 16], [70_000, 1, 2**40, 15, 3], rng.integers(0, 40, 999)):
        counts = np.array(counts, np.int64)
        assert np.array_equal(lm._wide(lm._small(counts), len(counts)), counts)


PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def passages(rows, items):
    wanted = {}
    for item, t in items:
        w = PLAIN.findall(fold(t))
        size = min(13, len(w))
        for p in range(len(w) - size + 1 if w else 0):
            wanted.setdefault(tuple(w[p : p + size]), set()).add(item)
    sizes = {len(k) for k in wanted}
    out = []
    for i, t in rows:
        w = PLAIN.findall(fold(t))
        hit, found = set(), set()
        for size in sizes:
            for p in range(len(w) - size + 1):
                if tuple(w[p : p + size]) in wanted:
                    hit.update(range(p, p + size))
                    found |= wanted[tuple(w[p : p + size])]
        out.append((i, len(w), len(hit), sorted(x for x in found if x is not None), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_decontaminate(spark, corpus, block_bytes):
    rng = random.Random(9)
    source = [t for _, t in corpus if t and len(t.split()) > 60]
    items = [(n, " ".join(rng.choice(source).split()[p : p + rng.randint(1, 40)]) + "!") for n, p in enumerate(range(0, 60, 3))]
    items += [(90, "w1"), (91, "W2, w3"), (92, None), (93, ""), (94, "nothing of this kind"), (None, "w5 w6"), (0, items[0][1]), (95, "a a a"), (96, " ".join(["a"] * 14))]
    benchmark = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id bigint, text string, doc_id string")
    found = decontaminate.find_passages(docs(spark, corpus), benchmark, block_bytes=block_bytes)
    assert set(found.columns) == {"doc_id", "text", "chunk", "words", "score", "n_words", "n_hit", "spans", "items"}
    rows = found.withColumn("bad", decontaminate.contaminated()).collect()
    got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"], r["bad"]) for r in rows), key=str)
    assert got == passages(corpus, items)
    assert all(sum(s["last"] - s["first"] + 1 for s in r["spans"]) == r["n_hit"] for r in rows)


def test_decontaminate_edges(spark):
    benchmark = spark.createDataFrame([], "item_id bigint, text string")
    (row,) = decontaminate.find_passages(docs(spark, [(1, "a b")]), benchmark).collect()
    assert (row["n_words"], row["n_hit"], row["items"]) == (2, 0, [])
    some = spark.createDataFrame([("k", "a")], "item_id string, text string")
    assert decontaminate.find_passages(docs(spark, []), some).collect() == []
    assert decontaminate.find_passages(docs(spark, [(1, "b A")]), some).first()["items"] == ["k"]


def test_words_that_repeat_are_one_window(spark):
    """An item and a document of one word 20,000 times."""
    long = "a " * 20_000
    df = docs(spark, [(1, long), (2, "b a c"), (3, "a " * 12)])
    items = spark.createDataFrame([(7, long), (8, "a " * 13), (9, "a " * 13 + "b")], "item_id bigint, text string")
    found = {r["doc_id"]: (r["n_hit"], r["items"]) for r in decontaminate.find_passages(df, items).collect()}
    assert found == {1: (20_000, [7, 8, 9]), 2: (0, []), 3: (0, [])}


def test_kept_text_digest(spark):
    """The query's digest is that of the kept text."""
    (row,) = substring.remove_repeats(docs(spark, [(1, "é  b")])).select(F.sha2("kept", 256).alias("h")).collect()
    assert row["h"] == hashlib.sha256("é b".encode()).hexdigest()


def test_sets_of_short_texts():
    sets = near_dup.shingle_sets(pa.array(["a b", "A  B", "a b c", None, "a b c d", "a b c d e"]))
    assert [len(s) for s in sets] == [1, 1, 1, 0, 1, 2]
    assert np.array_equal(sets[0], sets[1]) and sets[0][0] != sets[2][0]
