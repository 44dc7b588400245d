"""Toxicity, quality and language by held-out accuracy; edge cases."""

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corvane.llm import language, quality, toxicity
from corvane.llm import textkit as tk

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_toxicity_held_out(tables):
    docs, labels = tables
    got = toxicity.op5(docs, labels).join(labels, "doc_id").toPandas()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id]).all()
    out = got[got.held_out]
    assert ((out.score >= 0) & (out.score <= 1)).all() and ((out.score >= 0.7) == (out.predicted == 1)).all()
    assert (out.predicted == out.toxic).mean() > 0.9 and out[out.toxic == 0].predicted.mean() < 0.05


def test_quality_held_out(tables):
    docs, labels = tables
    got = quality.op7(docs, labels).join(labels, "doc_id").toPandas()
    out = got[got.held_out]
    assert (out.predicted == out.quality).mean() > 0.9


def test_language_held_out(tables):
    docs, _ = tables
    got = language.op8(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (got[got.held_out].lang == got[got.held_out].lang_pred).mean() > 0.97


def test_scores_don_t_see_labels_of_held_out_rows(tables):
    docs, labels = tables
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    other = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (toxicity.op5(docs, x).select("doc_id", "score").toPandas().sort_values("doc_id") for x in (labels, other))
    assert (a.score.values == b.score.values).all()


def test_edge_rows(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(4, 1, 0), (8, 0, 1), (9, 0, 1), (6, 1, 0), (None, 1, 1), (14, None, None), (4, 1, 0), (7, 1, 0)], "doc_id long, quality int, toxic int")
    n = edge_docs.count()
    for got in (toxicity.op5(edge_docs, labels), quality.op7(edge_docs, labels), toxicity.op5(edge_docs, labels.filter("false")), quality.op7(edge_docs, labels.filter("false"))):
        rows = got.collect()
        assert len(rows) == n and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in rows)
    assert toxicity.op5(no_docs, labels).count() == 0 and quality.op7(no_docs, labels).count() == 0


def test_language_edge_rows(spark, edge_docs, no_docs):
    rows = language.op8(edge_docs).collect()
    assert len(rows) == edge_docs.count()
    assert all((r.lang_pred == "und") == (r.doc_id in (1, 2, 11)) for r in rows)
    assert language.op8(no_docs).count() == 0
    unlabelled = edge_docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language.op8(unlabelled).collect()} == {"und"}
    kept = language.keep_identified(edge_docs)
    assert kept.columns == edge_docs.columns and kept.count() == edge_docs.count() - 3
    assert {r.lang for r in kept.collect()} == {"en"}
    assert language.keep_identified(no_docs).count() == 0
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by[1].spans == by[2].spans == by[11].spans == [] and [tuple(x) for x in by[13].spans] == [(0, 13, "en")]


def test_spans_of_mixed_text_and_scripts():
    model = language.Model(["the and of that thing with there"] * 5 + ["der und die nicht auch über sich"] * 5 + ["это все так как она они что"] * 5, ["en"] * 5 + ["de"] * 5 + ["ru"] * 5)
    spans = model.spans("the thing with there and that der nicht auch die über und sich это все что они")
    assert [x[2] for x in spans] == ["en", "de", "ru"]
    assert spans[0][:2] == (0, 6) and spans[1][0] == 6


# ---- the models' scores in plain Python


def mixed(x):
    m = (1 << 64) - 1
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & m
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & m
    return x ^ x >> 31


BASE = 0x9E3779B97F4A7C15


def gram_buckets(word: bytes, sizes, buckets):
    """The n-grams of a word between marks, and the whole of it."""
    padded, m = b"\x02" + word + b"\x03", (1 << 64) - 1
    value = lambda g: sum(mixed((b + 1) * BASE & m) * pow(BASE, i, 1 << 64) for i, b in enumerate(g)) & m
    out = [mixed(value(padded[i : i + n]) + n & m) % buckets for n in sizes for i in range(len(padded) - n + 1)]
    return [*out, mixed(value(padded) + 255 & m) % buckets]


def low(text):
    return re.sub(rb"[A-Z]", lambda x: x[0].lower(), text.encode())


TEXTS = ["The thing and that, with THERE", "der und die nicht 'auch' über sich 12", "это все так как она the they", "", "  42 -- !", "the und это " * 70, "a"]


def test_language_scores_and_path_are_those_of_plain_python():
    model = language.Model(["the and of that thing with there"] * 5 + ["der und die nicht auch über sich"] * 5 + ["это все так как она они что"] * 5, ["en"] * 5 + ["de"] * 5 + ["ru"] * 5)
    k = len(model.langs)

    def word_scores(w):
        text = w.decode()
        letters = [c for c in text if c.isalpha()]
        if not letters:
            return 0, np.zeros(k)
        grams = gram_buckets(w, language.SIZES, language.BUCKETS)
        s = sum(model.logs[g].astype(float) for g in grams) * min(len(grams), 12) / len(grams)
        s = np.clip(s - s.mean(), -model.most, model.most)
        scripts = Counter(language.SCRIPT_IDS[np.searchsorted(language.SCRIPT_STARTS, ord(c), "right") - 1] for c in letters)
        script = min(scripts, key=lambda x: (-scripts[x], x)) if any(b > 127 for b in w) else 0
        return len(letters), np.where(model.allowed[:, script], s, -2 * model.most)

    langs, _, shares, first, path = model.label(pa.array(TEXTS))
    for d, text in enumerate(TEXTS):
        own = [word_scores(w) for w in re.findall(rb"[^\x20\x09-\x0d]+", low(text))]
        got = path[first[d] : first[d + 1]].tolist()
        assert len(got) == len(own)
        if not own:
            continue
        table = np.array([s for _, s in own])
        best = table[0].copy()
        for s in table[1:]:
            best = np.maximum(best, best.max() - model.penalty) + s
        value = table[np.arange(len(got)), got].sum() - model.penalty * sum(a != b for a, b in zip(got, got[1:], strict=False))
        assert value == pytest.approx(best.max(), abs=1e-3)
        mass = np.bincount(got, [n for n, _ in own], k)
        assert langs[d] == (model.langs[mass.argmax()] if mass.sum() else "und") and shares[d] == pytest.approx(mass.max() / max(mass.sum(), 1e-9))


def test_the_path_over_stretches_is_a_best_one():
    rng = np.random.default_rng(1)
    model = language.Model(["a"] * 2 + ["b"] * 2 + ["c"], ["x", "x", "y", "y", "z"])
    for _ in range(60):
        n = rng.integers(0, 4 * language.STRETCH, rng.integers(1, 5))
        first = np.concatenate([[0], np.cumsum(n)])
        scores = rng.normal(0, 4, (first[-1], 3)).astype(np.float32)
        scores[rng.random(len(scores)) < 0.3] = 0
        path = model.path(scores.copy(), first)
        for a, b in zip(first[:-1], first[1:], strict=True):
            if b > a:
                best = scores[a].astype(float)
                for s in scores[a + 1 : b]:
                    best = np.maximum(best, best.max() - model.penalty) + s
                value = scores[np.arange(a, b), path[a:b]].astype(float).sum() - model.penalty * (np.diff(path[a:b]) != 0).sum()
                assert value == pytest.approx(best.max(), abs=1e-2)


def test_long_texts_are_labelled_in_pieces(long_docs):
    docs = long_docs.withColumn("lang", F.lit("xx"))
    rows = {r.doc_id: r for r in language.op8(docs).collect()}
    assert rows[6].lang_pred == "und" and {rows[i].lang_pred for i in range(1, 6)} == {"xx"}
    assert [tuple(x) for x in rows[1].spans] == [(0, 150_000, "xx")]
    model = language.Model([t for t in TEXTS[:3] for _ in range(3)], ["en"] * 3 + ["de"] * 3 + ["ru"] * 3)
    text = " ".join(TEXTS[:3] * 12_000)
    assert len(text.encode()) > 2 * tk.SLICE_BYTES
    whole, parts = model.spans(text), model.spans(" ".join(TEXTS[:3] * 12))
    assert whole[: len(parts) - 1] == parts[:-1] and whole[-1][1] == len(text.split())


def test_toxicity_margins_are_those_of_plain_python():
    rng = np.random.default_rng(3)
    weights = rng.normal(0, 1, toxicity.BUCKETS)
    got = toxicity.margins(TEXTS, weights, 0.25)
    for text, have in zip(TEXTS, got.tolist(), strict=True):
        words = set(re.findall(rb"[0-9a-z\x80-\xff]+", low(text)))
        assert have == pytest.approx(0.25 + sum(weights[g] for w in words for g in gram_buckets(w, toxicity.SIZES, toxicity.BUCKETS)))


def test_toxicity_weights_are_scaled_by_log_count_ratios():
    bad, good = ["vile hateful words here"] * 6, ["kind gentle words here"] * 6
    weights, bias = toxicity.fit(bad + good, np.array([1.0] * 6 + [0.0] * 6))
    score = lambda t: toxicity.margins([t], weights, bias)[0]
    assert score("vile") > score("words") > score("gentle") and score("unseen zzz") == pytest.approx(bias, abs=0.5)
    # as often in both: a ratio of nearly one
    assert abs(score("words") - bias) < 0.1 * abs(score("vile") - bias)


def test_quality_vectors_and_network_are_those_of_plain_python():
    texts = ["good calm words about calm things and good words"] * 4 + ["BUY!! 99 BUY!! now now now 99"] * 4 + ["calm words BUY!! 12", ""]
    vectors, net = quality.fit(texts, np.array([1.0] * 4 + [0.0] * 4 + [1.0, 0.0]))
    got = vectors.pooled(*quality.tokens(pa.array(texts)))
    shape = lambda w: re.sub(r"(.)\1+", r"\1", re.sub(r"[A-Z]", "A", re.sub(r"[a-z]", "a", re.sub(r"[0-9]", "0", w))))
    for text, row in zip(texts, got, strict=True):
        words = text.split()
        w, h, kind = quality.tokens(pa.array([text]))
        ids = vectors.ids(h, kind).tolist()
        assert len({(shape(a), k) for a, k in zip(words, kind.tolist(), strict=True)}) == len(set(kind.tolist()))
        own = [vectors.vectors[i].astype(float) for i in ids]
        n = max(len(words), 1)
        want = np.zeros(2 * quality.DIMS + 3)
        if words:
            want[: quality.DIMS] = np.mean(own, 0)
            want[quality.DIMS : 2 * quality.DIMS] = np.mean([vectors.vectors[i].astype(float) for i in set(ids)], 0)
        want[-3] = len(set(words)) / n
        want[-2] = sum(a == b for a, b in zip(words, words[1:], strict=False)) / n
        want[-1] = np.log1p(len(words)) / 5
        assert row == pytest.approx(want, abs=1e-5)
        hidden = np.tanh((row - net.mean) / net.scale @ net.params[0] + net.params[1])
        assert net.probability(row[None])[0] == pytest.approx(1 / (1 + np.exp(-(hidden @ net.params[2] + net.params[3][0]) / net.temperature)))


def test_long_texts_are_scored(long_docs, spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 1), (3, 0, 0), (4, 0, 1), (5, 1, 0)], "doc_id long, quality int, toxic int")
    for got in (toxicity.op5(long_docs, labels), quality.op7(long_docs, labels)):
        rows = got.collect()
        assert len(rows) == 6 and all(0 <= r.score <= 1 for r in rows)
