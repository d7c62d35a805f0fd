"""License scans, language, quality rules, toxicity: brute force, hostile rows and held-out accuracy."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

from cairnmap.llm import language, licenses, repetition, toxicity

SF = "/root/testdata/sf0.01"
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "word"), (4, "word"), (None, "Apache License, Version 2.0"), (5, "a b c d e f g h i j " * 3_000)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string").withColumn("score", F.lit("x")).withColumn("n_words", F.lit(7))


def test_license_phrases(spark):
    rows = ["licensed under the GNU General Public License, version 3", "MIT License. mit  license", "cc-by", "gnu general license",
            "Licensed under the Apache License, Version 2.0", "apache apache license", "Licensed under CC BY-NC 4.0"]
    got = licenses.scan_licenses(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.base_labels for r in got] == ["gpl", "mit", "cc-by", "", "apache", "apache", "cc-by"]
    assert [(r.n_base, r.first_word, r.last_word) for r in got] == [(1, 3, 3), (2, 0, 2), (1, 0, 0), (0, None, None), (1, 3, 3), (1, 1, 1), (1, 2, 2)]
    assert [r.labels for r in got] == ["gpl,gpl-3.0", "mit", "cc-by", "", "apache,apache-2.0", "apache", "cc-by,cc-by-nc"]
    assert all(0 <= r.score <= 1.000001 for r in got)


def test_license_odd_rows(odd):
    got = licenses.scan_licenses(odd).collect()
    assert len(got) == len(ODD)
    assert [(r.n_words, r.labels) for r in got if r.doc_id in (1, 2, 3)] == [(0, "")] * 3
    assert licenses.scan_licenses(odd.limit(0)).count() == 0


def _longest(words):
    n, out = len(words), [0] * len(words)
    for i in range(n):
        for j in range(n):
            k = 0
            while i != j and max(i, j) + k < n and words[i + k] == words[j + k]:
                k += 1
            out[i] = max(out[i], k)
    return out


def test_repeats_against_brute_force():
    from cairnmap.llm.bytetext import split_words

    rng = random.Random(5)
    for _ in range(60):
        texts = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 30))).encode() for _ in range(4)] + [None, b""]
        words = split_words(texts)
        assert list(repetition.repeat_lengths(words.hashes, words.owner)) == [x for t in texts for x in _longest((t or b"").split())]


def test_repetition_rows(spark, odd):
    got = repetition.measure_repetition(odd.drop("score", "n_words"), ["doc_id"]).collect()
    assert len(got) == len(ODD)
    assert all(r.base_failed and not r.kept for r in got)
    long_ = next(r for r in got if r.doc_id == 5)
    assert (long_.n_words, long_.longest_repeat, long_.n_covered) == (30_000, 29_990, 30_000)
    assert [(s.start, s.end) for s in long_.repeats] == [(0, 30_000)]
    clean = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(80)) + " é#")], "doc_id long, text string")
    row = repetition.measure_repetition(clean, ["doc_id"]).first()
    assert row.kept and (row.n_words, row.n_symbols, row.n_dup_lines) == (81, 1, 0)
    assert repetition.measure_repetition(clean.limit(0), ["doc_id"]).count() == 0


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    assert {r.h for r in docs.limit(20).select((held == F.lit(True)).alias("h")).collect()} <= {True, False}
    assert docs.filter(held).first().doc_id in [i for i in range(2_000) if zlib.crc32(str(i).encode()) % 5 == 0]
    got = language.identify(docs, language.train(docs.filter(~held)), ["doc_id", "lang"]).filter(held)
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95


def test_language_odd_rows(spark, odd):
    docs = spark.createDataFrame([("the house and the garden " * 5, "en"), ("das haus und der garten " * 5, "de"), (None, "en"), ("x", None)], "text string, lang string")
    model = language.train(docs)
    got = {r.doc_id: r for r in language.identify(odd.drop("score"), model, ["doc_id"]).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3
    assert got[4].lang_pred in ("de", "en") and 0 <= got[4].score <= 1
    empty = language.train(docs.limit(0))
    assert language.identify(odd.drop("score"), empty, ["doc_id"]).filter("lang_pred <> 'und'").count() == 0


def test_toxicity_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1
    got = toxicity.score_toxicity(docs, toxicity.train(docs.filter(~held), "toxic"), ["doc_id", "toxic"]).filter(held)
    right = got.agg(F.avg((F.col("toxic") == F.col("predicted")).cast("int"))).first()[0]
    assert right > 0.9


def test_toxic_sentence_is_located(spark, odd):
    rows = [(f"clean words number {i} here. more of them {i % 7}.", 0) for i in range(60)] + [(f"clean words here {i}. you idiot there. fine {i % 7}.", 1) for i in range(30)]
    model = toxicity.train(spark.createDataFrame(rows, "text string, y int"), "y")
    text = "A nice start. Oh you idiot there! The end."
    row = toxicity.score_toxicity(spark.createDataFrame([(1, text)], "doc_id long, text string"), model, ["doc_id"]).first()
    assert row.predicted == 1 and [text[o.start:o.end] for o in row.offences] == ["Oh you idiot there"]
    got = toxicity.score_toxicity(odd.drop("score"), model, ["doc_id"]).collect()
    assert len(got) == len(ODD) and all(r.predicted == 0 for r in got)
    nothing = toxicity.train(spark.createDataFrame([], "text string, y int"), "y")
    assert toxicity.score_toxicity(odd.drop("score"), nothing, ["doc_id"]).filter("predicted = 1").count() == 0
