"""Language and toxicity against plain loops over words, n-grams and sentences."""

import collections
import math
import re

import numpy as np
from pyspark.sql import functions as F

from cairnmap.llm import language, toxicity
from cairnmap.llm.bytetext import LOWER, NO_LETTER, split_words

SF = "/root/testdata/sf0.001"


def _grams(text):
    """Hashed n-gram counts of bytes, one at a time."""
    words = " ".join(re.findall(r"[a-z\x80-\U0010ffff]+", text.lower())).encode()
    framed, out = b" " + words + b" ", collections.Counter()
    for n, salt in ((1, 1), (2, 2 << 20), (3, 3 << 20)):
        for i in range(len(framed) - n + 1 if words else 0):
            h = framed[i]
            for j, base in zip(range(1, n), (257, 263)):
                h = h * base + framed[i + j]
            out[((h * 2654435761 + salt) % (1 << 32)) >> (32 - language.BITS)] += 1
    return out


def test_nearest_centroid_and_rejection(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.train(docs)
    rows = docs.limit(60).collect()
    odd = [(10**6, "zq xj qqq zzxq", None), (10**6 + 1, "文字だけの文章です", None)]
    asked = spark.createDataFrame([(r.doc_id, r.text, r.lang) for r in rows] + odd, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language.identify(asked, model, ["doc_id"]).collect()}
    for doc_id, text in [(r.doc_id, r.text) for r in rows] + [(i, t) for i, t, _ in odd]:
        grams = _grams(text)
        if not grams:
            continue
        norm = math.sqrt(sum((n * float(model.idf[b])) ** 2 for b, n in grams.items()))
        cosines = [sum(n * float(model.idf[b]) * float(c[b]) for b, n in grams.items()) / norm for c in model.centers]
        best = max(range(len(cosines)), key=lambda i: cosines[i])
        r = got[doc_id]
        assert abs(r.score - cosines[best]) < 1e-4
        assert r.lang_pred == model.languages[best] or abs(cosines[best] - max(c for c, x in zip(cosines, model.languages) if x == r.lang_pred)) < 1e-5
        assert r.rejected == (cosines[best] < model.floor[best]) or abs(cosines[best] - model.floor[best]) < 1e-5
    assert got[10**6].rejected and got[10**6 + 1].rejected


def test_document_frequencies_are_those_of_all_rows(spark):
    rows = [("the house", "en")] * 30 + [("das haus", "de")] * 3 + [("der garten", "de")]
    model = language.train(spark.createDataFrame(rows, "text string, lang string").repartition(4))
    held = collections.Counter(b for t, _ in rows for b in _grams(t))
    for b, n in held.items():
        assert math.isclose(model.idf[b], math.log((len(rows) + 1) / (n + 1)) + 1, rel_tol=1e-5)


def test_copies_do_not_fill_the_sample(spark):
    """Thousands of copies of one text are one of its language's sample; the other texts are drawn as well."""
    rows = [("same old words again", "en")] * 2000 + [(f"other text number {'abcdefghij'[i % 10] * (i // 10 + 1)}", "en") for i in range(30)]
    few = language.train(spark.createDataFrame(rows, "text string, lang string").repartition(6), sample=31)
    once = language.train(spark.createDataFrame(list(dict.fromkeys(rows)), "text string, lang string"), sample=31)
    assert len(few.languages) == len(once.languages) == language.CENTROIDS
    near = few.centers @ language.vectors([t.encode() for t, _ in rows[2000:]], few.idf).T
    assert near.max(axis=0).min() > 0.5


def _plain_noisy_or(text, weights, bias):
    raw, safe = (text or "").encode(), 1.0
    for sentence in re.split(rb"[.!?\n]", raw):
        words = split_words([sentence], NO_LETTER, LOWER)
        if len(words.start):
            z = sum(float(weights[int(h) >> (64 - toxicity.BUCKETS_BITS)]) for h in words.hashes) + bias
            safe *= 1 - 1 / (1 + math.exp(-min(max(z, -30), 30)))
    return 1 - safe


def test_scores_are_the_noisy_or_of_sentences(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rng = np.random.default_rng(2)
    model = (rng.normal(size=1 << toxicity.BUCKETS_BITS).astype(np.float32), -4.0)
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "...!"), (-4, "one.two!three\nfour"), (-5, "é" * 3000)], "doc_id long, text string")
    rows = docs.union(odd).repartition(5)
    texts = {r.doc_id: r.text for r in rows.collect()}
    for r in toxicity.score_toxicity(rows, model, ["doc_id"]).collect():
        wanted = _plain_noisy_or(texts[r.doc_id], *model)
        assert abs(r.score - wanted) < 1e-9 and r.predicted == int(wanted >= 0.7)


def test_long_texts_are_not_drawn(spark):
    rows = [(f"fine words {i}", 0) for i in range(20)] + [("bad bad " + "word " * 3000, 1)] * 5
    weights, bias = toxicity.train(spark.createDataFrame(rows, "text string, y int"), "y", most_bytes=1000)
    assert not weights.any()
    assert toxicity.train(spark.createDataFrame(rows, "text string, y int").withColumn("text", F.substring("text", 1, 900)), "y")[0].any()
