"""The word model of the quality classifier: plain dictionaries, own texts left out, words that are none."""

import math
import random

from pyspark.sql import functions as F

from cairnmap.llm import perplexity
from tests.llm.test_corpus_operators import _kneser_ney

SF = "/root/testdata/sf0.001"


def test_word_model_against_dictionaries(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    trusted = list({r.text: None for r in rows if r.doc_id % 2 == 0})
    ids: dict[str, int] = {}
    number = lambda t: [ids.setdefault(w, len(ids) + 1) for w in t.split()]
    numbered = [number(t) for t in trusted]
    model = _kneser_ney(numbered, len(ids) + 1)
    table, unknown = perplexity.word_model(spark.createDataFrame([(t,) for t in trusted], "text string").repartition(3))
    asked = spark.createDataFrame([(i, False, r.text, len(r.text.split())) for i, r in enumerate(rows)], "_row long, trusted boolean, text string, n_tokens long")
    got = {r._row: r.log_perplexity for r in perplexity.score_words(asked.repartition(5), table, unknown).collect()}
    assert table.count() > 20_000  # grows with the trusted text
    for i, r in enumerate(rows):
        s = [0, 0, *number(r.text)]
        if len(s) > 2:
            want = -sum(math.log(model(g)) for g in zip(s, s[1:], s[2:])) / (len(s) - 2)
            assert math.isclose(got[i], want, rel_tol=1e-9), r.doc_id


def test_own_text_is_left_out(spark):
    texts = [f"the cat sat on w{i} and the dog lay by w{i + 1}" for i in range(20)]
    table, unknown = perplexity.word_model(spark.createDataFrame([(t,) for t in [*texts, "odd one out", "odd one out"]], "text string"))
    rows = [(0, True, "odd one out", 3), (1, False, "odd one out", 3), (2, True, texts[5], 12)]
    got = {r._row: r.log_perplexity for r in perplexity.score_words(spark.createDataFrame(rows, "_row long, trusted boolean, text string, n_tokens long"), table, unknown).collect()}
    assert got[1] < got[2] + 1 and got[0] > got[1] + 1


def test_words_that_are_none_are_rejected(spark):
    """Random letters in the shapes of clean text have its case, lengths and punctuation."""
    sf, rng = "/root/testdata/sf0.01", random.Random(3)
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang"), spark.read.parquet(f"{sf}/labels.parquet")
    clean = docs.join(labels.filter("quality = 1"), "doc_id").filter("length(text) > 800").orderBy("doc_id").limit(60).collect()
    letter = lambda c: (rng.choice("abcdefghijklmnopqrstuvwxyz").upper() if c.isupper() else rng.choice("abcdefghijklmnopqrstuvwxyz")) if c.isascii() and c.isalpha() else c
    junk = spark.createDataFrame([(10**6 + r.doc_id, "".join(map(letter, r.text)), r.lang) for r in clean], docs.schema)
    got = perplexity.classify_quality(docs.union(junk), labels, ["doc_id"]).filter(F.col("doc_id") >= 10**6).agg(F.avg(F.col("kept").cast("int"))).first()[0]
    assert got < 0.05


def test_parts_passes_and_blocks_give_the_same_figures(spark, monkeypatch):
    """Texts dealt in several passes, with frequent words in blocks, are judged as by one part."""
    rng = random.Random(5)
    words = ["the", "of", *[f"w{i}" for i in range(60)]]
    texts = [" ".join(rng.choices(words, [40, 20, *[1] * 60], k=rng.randint(1, 40))) for _ in range(150)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate([*texts, *texts[:9], "", None])], "doc_id long, text string, lang string").repartition(4)
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(155)], "doc_id long, quality int")
    judge = lambda: {r.doc_id: (r.n_tokens, r.log_perplexity, r.threshold, r.kept) for r in perplexity.classify_quality(docs, labels, ["doc_id"]).collect()}
    whole = judge()
    for name, value in {"PASSES": 3, "PASS_TOKENS": 100, "PART_TOKENS": 60, "BROADCAST_IDS": 0}.items():
        monkeypatch.setattr(perplexity, name, value)
    layout = perplexity.word_model(docs.join(labels.filter("quality = 1"), "doc_id").select("text"))[0]._layout
    assert layout.passes == 3 and len(layout.hot) >= 2 and layout.blocks.max() > 2
    dealt = judge()
    assert dealt.keys() == whole.keys() and len(dealt) == 161
    for doc_id, want in whole.items():
        got = dealt[doc_id]
        assert got[0] == want[0] and got[3] == want[3], doc_id
        assert all((x is None) == (y is None) and (x is None or math.isclose(x, y, rel_tol=1e-9)) for x, y in zip(got[1:3], want[1:3])), doc_id


def test_shuffled_grams_are_small(spark):
    """A pass over the 3-grams of repeated prose packs far fewer bytes than three hashes a token."""
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").limit(100)
    source = rows.select(F.xxhash64("text").alias("_own"), F.col("text").cast("binary").alias("text")).coalesce(1)
    model, _ = perplexity.word_model(rows)
    dealt = source.mapInArrow(perplexity._dealt(model._layout, 1, 0, 1, "_own", None), perplexity._BLOB)
    size, tokens = dealt.agg(F.sum(F.length("data"))).first()[0], rows.agg(F.sum(F.size(F.split(F.trim("text"), r"\s+")))).first()[0]
    assert size < 20 * tokens
