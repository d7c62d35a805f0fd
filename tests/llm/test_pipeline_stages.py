"""Each stage on odd rows, on clashing names and next to a plain version."""

import collections

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from cairnmap.llm import mixing, perplexity
from tests.llm.test_corpus_operators import _components

SF = "/root/testdata/sf0.001"
CLEAN = " ".join(f"word{i}" for i in range(90))


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, None, "en", "a"), (2, "", "en", "a"), (3, CLEAN, None, None), (3, CLEAN, None, None), (None, CLEAN + " more", "en", "b"),
            (4, "again " * 500, "en", "b"), (5, " ".join(f"w{i}" for i in range(20_000)), "xx", "b"), (6, "short text", "en", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    for name in ("n_words", "kept", "copy", "position", "_size", "_offset", "_key", "_text", "gone_id", "a.b", "column_1"):
        docs = docs.withColumn(name, F.lit(f"own {name}"))
    return docs


@pytest.mark.parametrize("name,stage", P.STAGES[:-1])
def test_odd_rows_and_clashing_names(spark, odd, name, stage):
    out = stage(spark, odd, SF)
    assert out.columns == odd.columns
    rows = out.collect()
    assert all(r["n_words"] == "own n_words" and r["a.b"] == "own a.b" and r["kept"] == "own kept" for r in rows)
    assert stage(spark, odd.limit(0), SF).count() == 0
    ids = collections.Counter(r["doc_id"] for r in rows)
    if name == "quality rules":
        assert ids == {3: 2, None: 1, 5: 1}
    elif name == "n-gram Jaccard join":
        assert ids[1] == ids[2] == ids[4] == ids[5] == ids[6] == 1 and ids[3] == 2
    elif name == "quality classifier":
        assert not ids[1] and not ids[2]


def test_packing_of_odd_rows(spark, odd):
    got = P.best_fit_packing(spark, odd, SF).collect()
    per = collections.Counter(r.doc_id for r in got)
    assert per[5] == 10 and per[3] == 2 and per[1] == per[2] == 1
    assert len({r.bin_id for r in got if r.doc_id == 3}) == 2
    assert P.best_fit_packing(spark, odd.limit(0), SF).count() == 0


def test_kept_texts_equal_the_plain_components(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    component = _components([(r.doc_id, r.text) for r in docs.collect()])
    kept = {r.doc_id for r in P.jaccard_join(spark, docs, SF).collect()}
    assert kept == {i for i, (_, c) in component.items() if i == c}


def test_rejected_texts_are_those_above_the_threshold(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    judged = perplexity.classify_quality(docs, labels, ["doc_id"]).collect()
    wanted = {r.doc_id for r in judged if r.n_tokens > 0 and r.log_perplexity <= r.threshold}
    assert {r.doc_id for r in P.quality_classifier(spark, docs, SF).collect()} == wanted


def test_mix_equals_a_plain_walk(spark):
    """Copies of each row from a running sum over its source in the fixed order, and rows in the order of their times."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = P.mix_sources(spark, docs, SF).select("doc_id").collect()
    report = {r.doc_id: r for r in mixing.mix_report(docs).collect()}
    assert collections.Counter(r.doc_id for r in got) == {i: r.copies for i, r in report.items() if r.copies}
    by_source = collections.defaultdict(list)
    for r in docs.select("doc_id", "source", mixing.order_key(F.col("doc_id")).alias("k")).collect():
        by_source[r.source].append((r.k, r.doc_id))
    for rows in by_source.values():
        before = 0
        for _, i in sorted(rows):
            r = report[i]
            middles = [c * r.source_size + before + r.size / 2 for c in range(3)]
            assert r.copies == sum(m < r.target for m in middles)
            before += r.size
    times = [report[r.doc_id].position for r in got]
    first = {}
    for place, r in enumerate(got):
        first.setdefault(r.doc_id, (place, times[place]))
    order = [t for _, t in sorted(first.values())]
    assert all(a <= b + 1e-9 for a, b in zip(order, order[1:]))
