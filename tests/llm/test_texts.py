"""Repeats, near duplicates, benchmark windows and fingerprints against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corvane.llm import decontaminate, fingerprint, nearjoin, repeats
from corvane.llm import textkit as tk

SF = "/root/testdata/sf0.001"


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def id_key(i):
    return (1 << 63) - 1 if i is None else i


def repeats_by_force(rows, width):
    first = {}
    for i, t in rows:
        w = spaced(t)
        for j in range(len(w) - width + 1):
            k = tuple(w[j : j + width])
            first[k] = min(first.get(k, 1 << 63), id_key(i))
    out = []
    for i, t in rows:
        w = spaced(t)
        keep = [True] * len(w)
        for j in range(len(w) - width + 1):
            if first[tuple(w[j : j + width])] < id_key(i):
                keep[j : j + width] = [False] * width
        kept = [x for x, k in zip(w, keep, strict=True) if k]
        out.append((i, len(w), len(w) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("width", [2, 13])
def test_repeats_are_those_of_brute_force(spark, edge_docs, width):
    rows = [(r.doc_id, r.text) for r in edge_docs.select("doc_id", "text").collect()]
    assert Counter(map(tuple, repeats.remove_repeats(edge_docs, width).collect())) == repeats_by_force(rows, width)


def test_repeats_on_driver_rows_however_they_are_dealt(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    for parts in (1, 7):
        assert Counter(map(tuple, repeats.remove_repeats(docs.repartition(parts)).collect())) == repeats_by_force(rows, 13)


def test_repeats_of_long_texts(long_docs):
    rows = [tuple(r) for r in long_docs.collect()]
    assert Counter(map(tuple, repeats.op2(long_docs).collect())) == repeats_by_force(rows, 13)


def in_process(rows, width):
    """The operator's steps one after another, without Spark: per row the words that go."""
    batch = pa.record_batch([pa.array([id_key(i) for i, _ in rows]), pa.array(range(len(rows)), pa.int64()), pa.array([t for _, t in rows], pa.large_string())], ["did", "row", "text"])
    parts = [batch.slice(k, 2) for k in range(0, len(rows), 2)]

    def meet(found):
        table = pa.Table.from_batches(list(found)).sort_by([("kind", "ascending"), ("bucket", "ascending")])
        return list(repeats.met(width, 4)(iter(table.to_batches(max_chunksize=3))))

    def spans(batches, kind):
        out = defaultdict(list)
        for b in batches:
            for k, r, a, z in zip(*(b.column(n).to_pylist() for n in ("kind", "row", "starts", "ends")), strict=True):
                if k == kind:
                    out[r] += zip(a, z, strict=True)
        return out

    found = meet(x for p in parts for x in repeats.first_step(width, 4)(iter([p])))
    open_ = spans(found, repeats.OPEN)
    lists = [pa.array([[x[j] for x in open_[r]] if r in open_ else None for r in range(len(rows))], pa.list_(pa.int32())) for j in (0, 1)]
    again = pa.record_batch([*batch.columns, *lists], ["did", "row", "text", "starts", "ends"])
    gone = [spans(found, repeats.REMOVED), spans(meet(repeats.second_step(width, 4)(iter([again]))), repeats.REMOVED)]
    return [{w for s in gone for a, z in s[r] for w in range(a, z)} for r in range(len(rows))]


@pytest.mark.parametrize("broken", [None, 1, 2])
def test_repeats_need_both_families_of_hashes(monkeypatch, broken):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice("abcdef") for _ in range(rng.randrange(60)))) for i in range(40)]
    rows += [(50, rows[3][1]), (51, rows[3][1] + " a b"), (52, "x " + rows[5][1])]
    true = tk.word_hashes
    # one family in which all words, and so all sequences of one length, are the same
    monkeypatch.setattr(tk, "word_hashes", lambda d, a, b, seed: np.full(len(a), 7, tk.U) if seed == broken else true(d, a, b, seed))
    got = in_process(rows, 5)
    first = {}
    for i, t in rows:
        w = t.split()
        for j in range(len(w) - 4):
            first[tuple(w[j : j + 5])] = min(first.get(tuple(w[j : j + 5]), 1 << 60), i)
    want = [{p for j in range(len(w) - 4) if first[tuple(w[j : j + 5])] < i for p in range(j, j + 5)} for i, w in ((i, t.split()) for i, t in rows)]
    assert got == want


def test_word_hashes_depend_on_all_bytes_and_the_seed():
    rng = np.random.default_rng(2)
    words = [b"", b"a", b"b", b"a\0", *(bytes(rng.integers(1, 256, n).astype(np.uint8)) for n in (7, 8, 9, 16, 63, 64, 65, 200))]
    words += [w[:-1] + bytes([w[-1] ^ 1]) for w in words[4:]]
    data = np.frombuffer(b"".join(words), np.uint8)
    end = np.cumsum([len(w) for w in words])
    start = end - [len(w) for w in words]
    a, b = (tk.word_hashes(data, start, end, s) for s in (1, 2))
    assert len(set(a.tolist()) | set(b.tolist())) == 2 * len(words)
    other = tk.word_hashes(np.concatenate([np.full(3, 9, np.uint8), data]), start + 3, end + 3, 1)
    assert (a == other).all()


def test_no_rows_give_no_rows(spark, no_docs):
    assert repeats.op2(no_docs).count() == 0
    assert nearjoin.op6(no_docs).count() == 0
    assert fingerprint.op4(no_docs).count() == 0


def sets_of(rows):
    out = []
    for _, t in rows:
        w = spaced(t)
        out.append({tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set())
    return out


def near_by_force(rows):
    sets = sets_of(rows)
    n, links, root = len(rows), [0] * len(rows), list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(n):
        for b in range(a):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                links[a] += 1
                links[b] += 1
                root[top(a)] = top(b)
    names = defaultdict(list)
    for i in range(n):
        names[top(i)].append(rows[i][0])
    least = {k: min((x for x in v if x is not None), default=None) for k, v in names.items()}
    return Counter((rows[i][0], least[top(i)] if links[i] else rows[i][0], links[i]) for i in range(n))


def test_near_links_are_those_of_brute_force(spark, edge_docs):
    rows = [(r.doc_id, r.text) for r in edge_docs.select("doc_id", "text").collect()]
    got = nearjoin.op6(edge_docs).select("doc_id", "class_id", "n_links").collect()
    assert Counter(map(tuple, got)) == near_by_force(rows)


def test_near_links_of_long_texts(long_docs):
    rows = [tuple(r) for r in long_docs.collect()]
    got = nearjoin.op6(long_docs).select("doc_id", "class_id", "n_links").collect()
    assert Counter(map(tuple, got)) == near_by_force(rows)


@pytest.mark.parametrize("limit", [("BLOCK", 4), ("BLOCK_SHINGLES", 300)])
def test_near_links_over_tiles(spark, monkeypatch, limit):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    near = docs.filter("doc_id < 6").select(F.explode(F.sequence(F.lit(0), F.lit(11))).alias("k"), "*").select((F.col("doc_id") * 100 + F.col("k") + 5000).alias("doc_id"), F.concat("text", F.lit(" z"), F.col("k").cast("string")).alias("text"))
    docs = docs.unionByName(near)
    monkeypatch.setattr(nearjoin, *limit)
    rows = [tuple(r) for r in docs.collect()]
    got = nearjoin.op6(docs).select("doc_id", "class_id", "n_links").collect()
    assert Counter(map(tuple, got)) == near_by_force(rows)


def test_near_links_of_copies_without_ids(spark):
    words = [f"v{i}" for i in range(200)]
    a, b, c, d, e = (" ".join(words[k : k + 40]) for k in range(0, 200, 40))
    rows = [(None, a), (None, a), (None, a + " z"), (7, b), (None, b + " z"), (None, b + " z y"), (8, c), (3, c + " z"), (4, d), (None, d), (None, e)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = nearjoin.op6(docs).select("doc_id", "class_id", "n_links").collect()
    assert Counter(map(tuple, got)) == near_by_force(rows)
    kept = Counter((r.doc_id, r.text) for r in nearjoin.one_of_each(docs).collect())
    assert kept.pop((None, a), 0) + kept.pop((None, a + " z"), 0) == 1
    assert kept == Counter([(7, b), (3, c + " z"), (4, d), (None, e)])


def test_one_of_each_class_stays(spark, edge_docs):
    kept = nearjoin.one_of_each(edge_docs)
    assert kept.columns == edge_docs.columns
    classes = Counter({r.class_id for r in nearjoin.op6(edge_docs).collect()})
    assert Counter(r.doc_id for r in kept.collect()) == classes
    clash = edge_docs.withColumnsRenamed({"source": "own_id", "did": "kept_digest"}).withColumn("row", F.lit("r"))
    assert nearjoin.one_of_each(clash).columns == clash.columns and nearjoin.one_of_each(clash).count() == kept.count()
    assert nearjoin.one_of_each(edge_docs.filter("false")).count() == 0


def test_unlike_texts_stay_under_null_and_repeated_ids(spark):
    words = [f"v{i}" for i in range(240)]
    a, b, c, d, e, f = (" ".join(words[k : k + 40]) for k in range(0, 240, 40))
    # a text and itself with a z at the end are one class; 5 is the least id of two classes
    rows = [(None, a), (None, b), (None, b), (5, c), (5, c), (5, d), (6, d + " z"), (None, d), (7, e), (None, e), (8, f), (8, f + " z"), (None, ""), (None, None), (9, "")]
    kept = nearjoin.one_of_each(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, src string").repartition(3))
    got = Counter((r.doc_id, r.text) for r in kept.collect())
    assert got.pop((8, f), 0) + got.pop((8, f + " z"), 0) == 1
    assert got == Counter([(None, a), (None, b), (5, c), (5, d), (7, e), (None, ""), (None, None), (9, "")])


def test_posterior_limits():
    limits = dict(nearjoin.least_matches(0.8, 1e-6))
    assert limits[32] < 0.8 * 32 and limits[160] < 0.8 * 160 and limits[160] > limits[32]


LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def overlap_by_force(docs, items, n=10):
    windows = defaultdict(set)
    for i, t in items:
        w = ALNUM.findall((t or "").translate(LOW))
        k = min(n, len(w))
        for j in range(len(w) - k + 1 if k and i is not None else 0):
            windows[tuple(w[j : j + k])].add(str(i))
    sizes, out = {len(x) for x in windows}, []
    for d, t in docs:
        w = ALNUM.findall((t or "").translate(LOW))
        hit, found = set(), set()
        for k in sizes:
            for j in range(len(w) - k + 1):
                if tuple(w[j : j + k]) in windows:
                    hit.update(range(j, j + k))
                    found |= windows[tuple(w[j : j + k])]
        out.append((d, len(w), len(hit), len(found), decontaminate.digest_of(list(found)), bool(hit)))
    return Counter(out)


def test_benchmark_overlap_of_long_texts_and_items(spark, long_docs):
    rows = [tuple(r) for r in long_docs.collect()]
    words = rows[[r[0] for r in rows].index(1)][1].split(" ")
    items = [(1, " ".join(words[5000:9000])), (2, " ".join(words[100:120])), (3, "none of this"), (4, words[7])]
    got = decontaminate.benchmark_overlap(long_docs, spark.createDataFrame(items, "item_id long, text string"), block_windows=700)
    want = overlap_by_force(rows, items)
    assert Counter((r.doc_id, r.n_words, r.n_hit, len(r["items"]), decontaminate.digest_of(r["items"]), r.n_hit > 0) for r in got.collect()) == want


@pytest.mark.parametrize("block_windows", [1_000_000, 40])
def test_benchmark_overlap_is_that_of_brute_force(spark, edge_docs, block_windows, monkeypatch):
    docs = edge_docs.select("doc_id", "text").unionByName(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"))
    items = spark.read.parquet(f"{SF}/benchmark.parquet").unionByName(spark.createDataFrame([(900, "one"), (901, "A b, c D"), (902, None), (903, ""), (None, "one"), (904, "w1x7 w2x1"), (901, "A b, c D")], "item_id long, text string"))
    blocks = decontaminate.item_blocks
    monkeypatch.setattr(decontaminate, "item_blocks", lambda i, n, s, _: blocks(i, n, s, block_windows))
    got = Counter(map(tuple, decontaminate.op10(docs, items).collect()))
    assert got == overlap_by_force([tuple(r) for r in docs.collect()], [tuple(r) for r in items.collect()])


def test_benchmark_without_rows(spark, edge_docs, no_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.op10(edge_docs, none).filter("contaminated").count() == 0
    some = spark.createDataFrame([(1, "one")], "item_id long, text string")
    assert decontaminate.op10(no_docs, some).count() == 0
    clean = decontaminate.clean_documents(edge_docs, some)
    assert clean.columns == edge_docs.columns and clean.count() == edge_docs.count() - 1


def test_fingerprints_of_edited_texts(spark, edge_docs):
    got = fingerprint.op4(edge_docs).collect()
    rows = sorted({(r.doc_id, r.text or "") for r in edge_docs.collect()}, key=lambda x: (x[0] is None, -(x[0] or 0)))
    after = {a: b for a, b in zip(rows, rows[1:] + rows[:1], strict=True)}
    assert len(got) == edge_docs.count()
    by = {r.doc_id: r for r in got}
    text = {i: t for i, t in rows}
    for i, t in rows:
        n = len(t) // 3
        edited = t[: len(t) - n] + after[i, t][1][:n]
        assert by[i].n_chars == len(t) and by[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b, c = sets_of([(0, t), (0, edited), (0, after[i, t][1])])
        for x, y, have in ((a, b, by[i].near_edited), (a, c, by[i].near_next)):
            true = len(x & y) / len(x | y) if x | y else 1.0
            assert abs(have - true) < 0.17 if len(x | y) > fingerprint.K else have == pytest.approx(true)
    for a in text:
        for b in text:
            assert (by[a].fingerprint == by[b].fingerprint) or text[a] != text[b]


def test_sketches_merge_and_estimate(spark):
    words = [f"t{i}" for i in range(1200)]
    a, b = " ".join(words[:800]), " ".join(words[400:])
    row = spark.createDataFrame([(a, b)], "a string, b string").select(fingerprint.sketch(F.col("a")).alias("a"), fingerprint.sketch(F.col("b")).alias("b"), fingerprint.sketch(F.col("a")).alias("c"))
    r = row.select(fingerprint.merged(F.col("a"), F.col("b")).alias("m"), fingerprint.resemblance(F.col("a"), F.col("b")).alias("j"), fingerprint.distinct_shingles(F.col("a")).alias("n"), fingerprint.containment(F.col("a"), F.col("b")).alias("k"), fingerprint.merged(F.col("a"), F.col("c")).alias("same"), "a").first()
    assert len(r.m) == fingerprint.K and r.same == r.a
    assert abs(r.j - 396 / 1196) < 0.12 and abs(r.n - 796) < 200 and abs(r.k - 396 / 796) < 0.2
