"""The pipeline against its stages by brute force, and the queries against their SQL."""

import zlib
from collections import Counter

import compare
import numpy as np
import pytest

from corvane.llm import packing, pseudonyms, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture
def keyed(spark):
    spark.conf.set(pseudonyms.KEY_SETTING, "a key of these tests")
    yield "a key of these tests"
    spark.conf.unset(pseudonyms.KEY_SETTING)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_gives_the_rows_of_its_sql(spark, name):
    assert not compare.differences(queries.QUERIES[name](spark, SF), queries.ORACLE_SQL[name], SF)


def test_pipeline_to_the_last_token(spark, keyed):
    import corpus_pipeline
    from test_texts import near_by_force, overlap_by_force
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    # no text of these is of many languages, so those without letters go
    rows = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    rows = [r for r in rows if r[0] in {c for _, c, _ in near_by_force(rows)}]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    bad = {x[0] for x in overlap_by_force(rows, items) if x[5]}
    kept = spark.createDataFrame([r for r in rows if r[0] not in bad], "doc_id long, text string")
    texts = {r.doc_id: r.text for r in pseudonyms.pseudonymised(kept, keyed).collect()}
    assert any(texts[i] != t for i, t in rows if i in texts)
    tokenizer, want = Tokenizer.from_file(packing.default_tokenizer()), Counter()
    for i, text in texts.items():
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 2]
        bounds = [0, *range((len(ids) - 1) % 1024 + 1, len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
            want[i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    got = corpus_pipeline.run(spark, SF).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by.values():
        ends = np.cumsum([n for _, n in sorted(pieces)])
        assert [a for a, _ in sorted(pieces)] == [0, *ends[:-1].tolist()] and ends[-1] <= 1024
    assert len(by) <= -(-sum(r.length for r in got) // 1024) + 2


def test_stages_keep_the_columns(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontaminate", "pseudonyms", "packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).schema.simpleString() == docs.schema.simpleString()


def test_stages_on_edge_rows_and_empty_tables(spark, edge_docs, no_docs):
    import corpus_pipeline

    kept = {name: stage(spark, edge_docs, SF) for name, stage in corpus_pipeline.STAGES}
    n = edge_docs.count()
    # null, empty and blank texts go; copies and near copies go; no benchmark text is here; nothing goes; each row is packed
    assert kept["language"].count() == n - 3
    assert Counter(r.doc_id for r in kept["near_duplicates"].collect()) == Counter([1, 2, 3, 4, 8, None, 11, 12, 13, 15, 16])
    assert kept["decontaminate"].count() == kept["pseudonyms"].count() == n
    assert Counter(r.doc_id for r in kept["packing"].filter("piece = 0").collect()) == Counter(r.doc_id for r in edge_docs.collect())
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_docs, SF).count() == 0


def test_pseudonyms_have_a_key_of_their_own_each_run(spark):
    import corpus_pipeline

    docs = spark.createDataFrame([(1, "card 4111111111111111", "en", "s", 21), (2, "4111111111111111 again", "en", "s", 22)], "doc_id long, text string, lang string, source string, n_chars long")
    one, two = ([r.text for r in corpus_pipeline.pseudonymised(spark, docs, SF).orderBy("doc_id").collect()] for _ in range(2))
    assert one != two and one[0].split()[1] == one[1].split()[0]
